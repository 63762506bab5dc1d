"""One-to-one matching of the greatest total weight, solved within blocks.

The solver adds one support after the other; each addition looks for the cheapest
alternating path from it to a free primary, or to a support that gives up its
place. Weights are exact integers, so that equal totals are equal; of equally
good paths the one through the smallest ids is kept.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import in_blocks, spans

SCALE = 10_000


def solve(edges: list[tuple[str, str, int]]) -> dict[str, str]:
    """support to primary; a support stays out where that makes the total greater."""
    options: dict[str, dict[str, int]] = {}
    for support, primary, weight in sorted(edges):
        options.setdefault(support, {})[primary] = weight
    holder: dict[str, str] = {}
    held: dict[str, str] = {}
    for new in options:
        # cost[s]: of making s look for a place; came[s]: the support and primary that displace it.
        cost, came = {new: 0}, {}
        queue = [new]
        while queue:
            nearer: dict[str, None] = {}
            for s in queue:
                for p, w in options[s].items():
                    other = holder.get(p)
                    if other is None or other == s:
                        continue
                    c = cost[s] - w + options[other][p]
                    if other not in cost or c < cost[other]:
                        cost[other], came[other] = c, (s, p)
                        nearer[other] = None
            queue = sorted(nearer)
        ends = [(cost[s] - w, 0, s, p) for s in cost for p, w in options[s].items() if p not in holder]
        ends += [(cost[s], 1, s, "") for s in cost]
        _, gives_up, s, p = min(ends)
        if gives_up and s == new:
            continue
        if gives_up:
            del held[s]
        place = p
        while True:
            before = came.get(s)
            if not gives_up:
                holder[place], held[s] = s, place
            gives_up = 0
            if s == new:
                break
            s, place = before
    return held


def maximum_matching(edges: DataFrame, block: list[str]) -> DataFrame:
    """(block, support_id, primary_id) of the best one-to-one matching within each block.

    A block's remaining edges, three short columns each, are solved in one task, which
    takes one block after the other.
    """

    def run(rows: pa.Table) -> pa.Table:
        supports, primaries, weights = (rows.column(c).to_pylist() for c in ("support_id", "primary_id", "weight"))
        found, first = [], []
        for start, end in spans(rows, block):
            solved = solve(list(zip(supports[start:end], primaries[start:end], weights[start:end], strict=True)))
            found += solved.items()
            first += [start] * len(solved)
        named = rows.select([*block, "support_id", "primary_id"])
        pairs = [pa.array([f[i] for f in found], t) for i, t in enumerate(named.schema.types[-2:])]
        return pa.Table.from_arrays([*(rows.column(k).take(pa.array(first, "int64")) for k in block), *pairs], names=named.column_names)

    weighed = edges.select(*block, "support_id", "primary_id", (F.col("score") * SCALE).cast("long").alias("weight"))
    return in_blocks(weighed, block, [], run, weighed.select(*block, "support_id", "primary_id").schema)
