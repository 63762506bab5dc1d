"""Many short batches: what a step makes or calls for each of them, and the same results as pair by pair."""

import itertools
import random
from datetime import date
from decimal import Decimal
from functools import reduce

import pyarrow as pa
import pytest

from sheaf.operators import integrity, layout, linkage
from sheaf.operators.blocks import spans, whole_blocks
from sheaf.settings import Settings

from .test_linkage import FIELDS, SCHEMA, page

SETTINGS = Settings()


def drawn_pages(seed, batches):
    draw, found = random.Random(seed), []
    day = lambda: draw.choice([None, date(2024, 1, 1), date(2024, 1, 5), date(2024, 2, 1)])
    for b in range(batches):
        for i in range(draw.randrange(1, 9)):
            kind = draw.choice(["lodging_invoice", "lodging_statement", "lodging_statement", "taxi_itinerary", "taxi_invoice"])
            start = day()
            given = {"amount": draw.choice([None, Decimal(1), Decimal(2)]), "order_number": draw.choice([None, None, "x", "y"]), "vendor": draw.choice(["v", "w"])}
            given |= {"service_start": start, "service_end": start, "traveler": draw.choice([None, "a", "b"]), "confidence": draw.choice([None, 0.2, 0.9, 0.9])}
            found += page(str(b), f"{kind[0]}{i}", kind, **given)
    return found


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([tuple(p.get(f) for f in FIELDS) for p in drawn_pages(7, 150)], SCHEMA)


def test_contenders_tell_as_much_as_all_candidates(spark, pages):
    """Pairs of no consequence are left out before they are written, and nothing changes."""
    every, few = linkage.candidates(pages), linkage.contenders(pages)
    assert 0 < few.count() < every.count() / 2
    told = {(r.batch_id, r.support_id): r.all_limited for r in linkage.supports(pages).collect()}
    limited = {}
    for r in every.collect():
        limited.setdefault((r.batch_id, r.support_id), []).append(r.confidence_limited)
    known = {k: [x for x in v if x is not None] for k, v in limited.items()}
    assert told == {k: all(v) if v else None for k, v in known.items()}
    rows = lambda df: sorted(map(repr, df.collect()))
    slow, fast = linkage.rejections(every), linkage.rejections(few, told=linkage.supports(pages))
    assert rows(slow) == rows(fast) and {r.reason for r in fast.collect()} >= {"low_observation_confidence", "low_confidence_association", "ambiguous_association"}
    a, b = linkage.matches(every, slow), linkage.matches(few, fast)
    assert rows(a) == rows(b) and b.count()
    assert rows(linkage.unmatched(pages, every, slow, a)) == rows(linkage.unmatched(pages, few, fast, b))


def test_no_call_for_each_batch(spark, pages):
    """Solver and packing run through a task's batches in one Python call, not in one for each."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    items = spark.createDataFrame([(str(b), g, 0, f"{b}-{g}", 100.0) for b in range(50) for g in range(3)], "batch_id string, group_seq int, item_seq int, page_id string, min_height double")
    packed = layout.pack(items, SETTINGS)
    pairs = linkage.candidates(pages)
    for df in (packed, linkage.matches(pairs, linkage.rejections(pairs))):
        assert "MapInArrow" in plan(df) and "FlatMapGroupsInPandas" not in plan(df)
    assert {(r.batch_id, r.group_seq): r.output_page for r in packed.collect()} == {(str(b), g): g // 2 for b in range(50) for g in range(3)}


def test_blocks_stay_whole_across_arrow_batches():
    draw = random.Random(3)
    for _ in range(200):
        keys = [k for k in range(draw.randrange(6)) for _ in range(draw.randrange(1, 7))]
        rows, cut = pa.record_batch({"k": pa.array(keys, "int64")}), draw.randrange(1, 6)
        tables = list(whole_blocks([rows.slice(i, cut) for i in range(0, len(keys), cut)], ["k"]))
        assert [k for t in tables for k in t["k"].to_pylist()] == keys
        found = [t["k"].to_pylist()[a:b] for t in tables for a, b in spans(t, ["k"])]
        assert found == [list(g) for _, g in itertools.groupby(keys)]


def test_common_widths_are_those_of_the_bisection_page_by_page():
    draw, usable, listed, want = random.Random(11), SETTINGS.usable_width, [], []
    for _ in range(300):
        items = [{"min_width": draw.uniform(5, 90), "max_width": draw.uniform(90, 200), "ratio": draw.uniform(0.5, 3.5)} for _ in range(draw.randrange(1, 7))]
        room, (lo, hi) = SETTINGS.usable_height - SETTINGS.item_gap_mm * (len(items) - 1), (0.0, usable)
        clamped = lambda i, w: max(i["min_width"], min(w, i["max_width"], usable)) / i["ratio"]  # noqa: B023, E731
        total = lambda w: reduce(lambda a, i: a + clamped(i, w), items, 0.0)  # noqa: B023, E731 - sum() compensates
        for _ in range(layout.STEPS):
            middle = (lo + hi) / 2
            lo, hi = (middle, hi) if total(middle) <= room else (lo, middle)
        listed.append(items)
        want.append(lo if total(0.0) <= room + 1e-7 else 0.0)
    assert layout.common_widths(pa.array(listed), SETTINGS).tolist() == want
    assert layout.common_widths(pa.array(listed[:0], pa.array(listed).type), SETTINGS).tolist() == []


@pytest.mark.parametrize("few", [0, 4, 16])
def test_overlaps_of_few_and_of_many(spark, few):
    draw = random.Random(2)
    rows = [(p, i, draw.uniform(0, 150), draw.uniform(0, 200), draw.uniform(0, 120), draw.choice([0.0, 40.0, 90.0])) for p in range(30) for i in range(draw.randrange(1, 12))]
    found = integrity.overlaps(spark.createDataFrame(rows, "p int, id int, x double, y double, w double, h double"), "p", few=few)
    over = lambda a, b: min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]) > 1e-7 and min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]) > 1e-7
    sound = [r for r in rows if r[4] > 0 and r[5] > 0]
    assert sorted(map(tuple, found.collect())) == sorted((a[0], a[1], b[1]) for a in sound for b in sound if a[0] == b[0] and a[1] < b[1] and over(a, b))


def test_a_page_of_few_is_not_dealt_to_cells(spark, made):
    rows = spark.createDataFrame([(p, i, 10.0, 70.0 * i, 183.0, 65.0) for p in range(40) for i in range(4)], "p int, id int, x double, y double, w double, h double")
    with made("Generate") as generated:
        assert integrity.overlaps(rows, "p").count() == 0
    assert sum(n for _, n in generated) == 0
