"""Near-duplicate documents by SimHash fingerprints within a Hamming radius.

A radius of 3 on 64 bits is cut into two segments of 32 bits: of three differing
bits, one segment holds at most one. Each distinct fingerprint is indexed under
the deletion variants of each segment, the segment with one bit made a wildcard
(2 x 32 keys), so that two fingerprints within the radius share a key. Equality
of keys gives candidates, ``bit_count`` of the exclusive or verifies them.

Copies collapse before the index: it holds distinct fingerprints. Within a key
every fingerprint is first compared with the smallest one only, which is linear
however large the key's group is; what that leaves open, pairs in different
components under one key, is compared in a second equality join, each pair with
an equal segment under one of its 32 keys only. Components come from alternating
large-star and small-star rounds over settled tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import id_key, released, row_key, settled, shuffled, whole

RADIUS = 3
SEED = 42
#: Shingles hashed and counted at a time, so that a text of any length takes bounded memory beside itself.
BLOCK = 1 << 16
#: Fingerprints that hold a 1 / HEAVY_SHARE part of all rows or more are looked up by broadcast.
HEAVY_SHARE = 4096


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of ``width`` words joined by a space, in blocks; of all words if there are fewer."""
    if not words:
        return
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(words) - width + 1, BLOCK):
        part = words[at : at + BLOCK + width - 1]
        joined = b" ".join(part)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes).tolist()
        n = len(part) - width + 1
        yield np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=False)), np.uint64, n
        )


def bit_table(hashes: np.ndarray) -> np.ndarray:
    """Row i, column j: bit 63 - j of hash i."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit integer; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(words, width):
        ones += bit_table(hashes).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n).view(">i8")[0]) if n else 0


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, row, fp) of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["doc_id", "row", "fp"])

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("text")).alias("row"), whole(F.col("text")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, fp long")


def variants(nodes: DataFrame, *carried: str) -> DataFrame:
    """Each fingerprint under its keys: segment, wildcard bit, and the segment without that bit."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    keys = F.flatten(
        F.transform(
            F.array(low, high),
            lambda segment, s: F.transform(
                F.sequence(F.lit(0), F.lit(31)),
                lambda p: F.shiftleft((s * 32 + p).cast("long"), 32).bitwiseOR(
                    segment.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), p)))
                ),
            ),
        )
    )
    return nodes.select(F.explode(keys).alias("key"), "fp", *carried)


def near(a: str, b: str, radius: int = RADIUS):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b).

    Large-star and small-star in turn until nothing changes, however many rounds
    that takes; every round is aggregated map-side and settled, no neighbourhood is
    gathered in one row.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(CAST(pmod(xxhash64(b, a), 4294967296) AS DECIMAL(38, 0)))")).first())

    edges = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before, now = None, state(edges)
    while now != before:
        before, last = now, edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = settled(
            small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
            .where("a <> b")
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        released(last)
        now = state(edges)
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")


def _labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root): every node, with itself where it has no edge."""
    roots = components(edges).withColumnRenamed("node", "fp")
    return settled(nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def _spread(df: DataFrame) -> DataFrame:
    """Small settled tables lie in few files; what grows out of their rows is made by as many tasks as a shuffle has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _wildcard():
    """The bit of a fingerprint that a ``key`` leaves out."""
    return F.shiftrightunsigned("key", 32).cast("int")


def _telling(index: DataFrame) -> DataFrame:
    """Rows of ``index`` under keys of which a pair can be new.

    Fingerprints with an equal segment share all its 32 keys: they are compared under
    that of its lowest bit only. Every other key is for pairs that differ in its
    wildcard bit and needs rows with either value of it.
    """
    bit = F.call_function("shiftrightunsigned", F.col("fp"), _wildcard()).bitwiseAND(F.lit(1))
    ends = index.groupBy("key").agg(F.min(bit).alias("lo"), F.max(bit).alias("hi"))
    return shuffled(index).join(ends.where((_wildcard() % 32 == 0) | (F.col("lo") < F.col("hi"))).select("key"), "key")


def _blocks(index: DataFrame) -> DataFrame:
    """Rows of ``index`` under each block of the segment that the key doesn't cover.

    Fingerprints within 3 bits that share a key differ in at most 3 bits of the other
    segment, so one of its four blocks of 8 bits is equal, and in at most 2 if they
    differ in the wildcard bit, so one of three blocks of 11, 11 and 10 bits is: a key
    that very many fingerprints share is cut into 256 or 2,048 groups a block, and no
    pair is lost.
    """
    other = F.when(F.col("key").bitwiseAND(F.lit(1 << 37)) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))

    def cut(n: int, width: int):
        return F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda i: i * 2048 + F.call_function("shiftright", other, i * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int"),
        )

    return index.select("*", F.explode(F.when(_wildcard() % 32 == 0, cut(4, 8)).otherwise(cut(3, 11))).alias("block"))


def linked(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root) of distinct fingerprints: the components of all pairs within ``radius``, none left out.

    ``radius`` is 3 or less: for more, two segments give no guarantee.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two segments with one wildcard find pairs that differ in 3 bits at most")
    index = variants(_spread(nodes))
    pivots = index.groupBy("key").agg(F.min("fp").alias("pivot"), F.max("fp").alias("top")).where("pivot < top").select("key", "pivot")
    stars = shuffled(index).join(pivots, "key").where((F.col("fp") != F.col("pivot")) & near("fp", "pivot", radius))
    stars = settled(stars.select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct())
    known = _labelled(nodes, stars)
    index = variants(_spread(known), "root")
    mixed = index.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    mixed_rows = settled(shuffled(index).join(mixed, "key"))
    open_ = settled(_telling(mixed_rows))
    released(mixed_rows)
    left = _blocks(open_.select("key", "fp", F.col("root").alias("ra"))).withColumnRenamed("fp", "a")
    right = _blocks(open_.select("key", "fp", F.col("root").alias("rb"))).withColumnRenamed("fp", "b")
    more = shuffled(left).join(right, ["key", "block"]).where((F.col("ra") < F.col("rb")) & near("a", "b", radius)).select("ra", "rb")
    more = more.groupBy("ra", "rb").agg(F.lit(1).alias("one"))
    merged = components(more.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    merged = merged.select(F.col("node").alias("root"), F.col("root").alias("final"))
    found = settled(known.join(merged, "root", "left").select("fp", F.coalesce("final", "root").alias("root")))
    released(stars, known, open_)
    return found


def _looked_up(rows: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with the columns that ``found`` has for their fingerprint, and ``n`` rows of it.

    Fingerprints that hold a 1 / HEAVY_SHARE part of all rows or more, such as that of
    empty texts or of a text copied very often, are looked up by broadcast: there are
    at most HEAVY_SHARE of them.
    """
    total = found.agg(F.sum("n")).first()[0] or 0
    least = max(2, -(-total // HEAVY_SHARE))
    heavy = found.where(F.col("n") >= least).select(F.col("fp").alias("h"), *[F.col(c).alias(f"h_{c}") for c in columns], F.lit(True).alias("heavy"))
    light = found.where(F.col("n") < least).select("fp", *columns)
    marked = rows.join(F.broadcast(heavy), F.col("fp") == F.col("h"), "left")
    of_heavy = marked.where("heavy").select(*rows.columns, *[F.col(f"h_{c}").alias(c) for c in columns])
    return of_heavy.unionByName(marked.where("heavy IS NULL").select(*rows.columns).join(shuffled(light), "fp").select(*rows.columns, *columns))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, row, fp, component_id) of each row of ``docs``.

    Texts are lower-cased A-Z and cut into words ``[^\\x20\\x09-\\x0D]+``; shingles
    of ``width`` words count as often as they occur, a shorter text is one
    shingle, and one without words (null, empty, white space) has fingerprint
    zero and links like any other. ``component_id`` is the smallest doc_id that
    links of ``radius`` or fewer differing bits reach; null ids count only where
    a component has no other, then it is null. Equal rows stay separate rows.
    ``row`` tells texts under one doc_id apart.
    """
    rows, found = _rooted(docs, width, radius)
    return _looked_up(rows, found, "component_id").select("doc_id", "row", "fp", "component_id")


def _rooted(docs: DataFrame, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, fp) of each row, and (fp, n, component_id, first) of each fingerprint; settled.

    ``first`` is the smallest (id, row) of the component.
    """
    rows = settled(fingerprints(docs, width))
    ident = F.struct(id_key(F.col("doc_id")).alias("i"), F.col("row").alias("r"))
    nodes = settled(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("id"), F.min(ident).alias("own")))
    of_root = shuffled(nodes).join(linked(nodes.select("fp"), radius), "fp")
    first = of_root.groupBy("root").agg(F.min("id").alias("component_id"), F.min("own").alias("first"))
    found = settled(of_root.join(first, "root").select("fp", "n", "component_id", "first"))
    released(nodes)
    return rows, found


def keep_one(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` of which each is the first of its component.

    First is the smallest doc_id, then the smallest ``row`` key; of equal rows one
    stays. Texts that share a doc_id but not a component stay both. A null doc_id
    sorts last. All columns pass through, an empty table stays empty.
    """
    _, found = _rooted(docs, width, radius)
    kept = found.groupBy(F.col("first.i").alias("__id"), F.col("first.r").alias("__row")).agg(F.lit(1).alias("one")).drop("one")
    keyed = docs.select(id_key(F.col("doc_id")).alias("__id"), row_key(F.col("text")).alias("__row"), F.struct("*").alias("__doc"))
    one = keyed.join(kept, ["__id", "__row"], "left_semi").dropDuplicates(["__id", "__row"])
    return one.select(*[F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])
