"""Pixel checks: matches, shifts, extra ink; orders, providers and layout inputs on odd rows."""

import numpy as np
import pytest

from sheaf.functions import geometry as G
from sheaf.operators import inputs, issues, render
from pyspark.sql import functions as F


def drawing(height=200, width=300, seed=1):
    rng = np.random.default_rng(seed)
    image = np.full((height, width), 255, np.uint8)
    for _ in range(40):
        y, x = rng.integers(10, height - 20), rng.integers(10, width - 40)
        image[y : y + 3, x : x + 25] = 0
    return image


def test_a_constant_image_stays_so_through_every_filter():
    flat = np.full((50, 70), 128, np.uint8)
    assert (render.blurred(flat) == 128).all()
    assert (render.resized(flat, 33, 21) == 128).all() and render.resized(flat, 33, 21).shape == (21, 33)


def test_blur_has_the_variance_asked_for():
    dot = np.zeros((21, 21), np.uint8)
    dot[10, 10] = 255
    line = render.blurred(dot).astype(float).sum(axis=0)
    at = np.arange(21) - 10
    assert abs((line * at**2).sum() / line.sum() - 0.25) < 0.06


def test_a_patch_matches_itself_shifted_and_scaled_but_no_other():
    a = drawing()
    assert render.patches_match(a, a)
    assert render.patches_match(a, np.roll(a, 1, axis=1))
    assert render.patches_match(np.kron(a, np.ones((2, 2), np.uint8)), a)
    assert not render.patches_match(a, drawing(seed=2))
    lost = a.copy()
    lost[:, 150:] = 255
    assert not render.patches_match(a, lost)
    with pytest.raises(ValueError):
        render.patches_match(a[:4, :4], a[:4, :4])


def test_tiles_agree_with_a_plain_loop():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (70, 90)).astype(np.uint8)
    b = np.clip(a.astype(int) + rng.integers(-4, 5, a.shape), 0, 255).astype(np.uint8)
    b[0:6, 0:30] = 255 - b[0:6, 0:30]

    def plain(a, b):
        d = np.abs(a.astype(int) - b)
        tiles = [d[y : y + 32, x : x + 32] for y in range(0, 70, 32) for x in range(0, 90, 32)]
        inks = (a < 245).mean(), (b < 245).mean()
        return (
            d.mean() / 255 <= 0.012
            and max(t.mean() for t in tiles) / 255 <= 0.20
            and max((t >= 32).mean() for t in tiles) <= 0.35
            and abs(inks[0] - inks[1]) <= max(0.0001, 0.25 * max(inks))
        )

    for other in (a, b, drawing(70, 90)):
        assert render._alike(a, other) == plain(a, other)


def test_ink_outside_of_placements():
    page = np.full((1188, 840), 255, np.uint8)  # four pixels a millimetre
    page[400:440, 400:480] = 0
    assert not render.stray_ink(page, [(100, 100, 20, 10)])
    assert render.stray_ink(page, [])
    assert render.stray_ink(page, [(100, 100, 5, 10)])


def test_issue_rows(spark):
    a, b = drawing().tobytes(), drawing(seed=2).tobytes()
    rows = [("b", "same", 0, a, 300, 200, a, 300, 200), ("b", "other", 1, a, 300, 200, b, 300, 200), ("b", "none", 2, a, 300, 200, None, 300, 200), ("b", "size", 3, a, 300, 200, b, 3, 2)]
    names = "batch_id string, page_id string, output_page int, source binary, source_width int, source_height int, output binary, output_width int, output_height int"
    found = {r.source_page_ids[0]: (r.code, r.output_page, r.severity) for r in render.content_issues(spark.createDataFrame(rows, names)).collect()}
    failed = "content_verification_failed"
    assert found == {"other": ("content_mismatch", 2, "error"), "none": (failed, 3, "error"), "size": (failed, 4, "error")}

    pages = spark.createDataFrame([("b", 0, a, 300, 200), ("b", 1, None, 1, 1), ("b", 2, bytes([255]) * 60_000, 300, 200)], "batch_id string, output_page int, pixels binary, pixel_width int, pixel_height int")
    none = spark.createDataFrame([], "batch_id string, output_page int, x double, y double, width double, height double")
    found = {r.output_page: (r.code, r.message) for r in render.stray_issues(pages, none).collect()}
    assert found == {1: ("unexpected_output_content", issues.TEXTS["unexpected_output_content"][0]), 2: (failed, issues.PAGE_TEXTS[failed][0])}
    whole = spark.createDataFrame([("b", 0, 0.0, 0.0, 210.0, 297.0), ("b", 0, 1.0, 1.0, None, 5.0)], none.schema)
    assert [r.output_page for r in render.stray_issues(pages, whole).collect()] == [2]


def test_every_hard_code_has_texts_and_unknown_codes_have_none(spark):
    assert set(issues.HARD) <= set(issues.TEXTS)
    rows = spark.range(1).select(*issues.issue(F.lit("b"), "made_up", F.array())).collect()
    assert (rows[0].message, rows[0].action, rows[0].severity) == ("", "", "warning")


def test_layout_inputs_never_vanish(spark):
    groups = spark.createDataFrame(
        [("a", 1, ["p"], ["q"]), ("a", 2, ["p"], []), ("b", 1, ["p"], ["lost"]), ("c", 1, ["p"], []), ("d", 1, [], [])],
        "batch_id string, group_seq int, primary_page_ids array<string>, support_page_ids array<string>",
    )
    pages = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "p"), ("c", "p"), ("d", "y"), ("d", "x")], "batch_id string, page_id string")
    observed = pages.where("batch_id <> 'c'")
    found = sorted(tuple(r) for r in inputs.layout_errors(groups, pages, pages, observed).collect())
    assert found == [("a", "p", "repeated"), ("b", "lost", "page"), ("c", "p", "observation"), ("d", "x", "ungrouped")]
    assert inputs.layout_errors(groups.where("false"), pages.where("false"), pages, pages).count() == 0


def test_local_observations_of_empty_tables_and_nulls(spark):
    pages = spark.createDataFrame([("b", "p", "s", None), ("b", "q", None, "　text ")], "batch_id string, page_id string, source_id string, text string")
    sources = spark.createDataFrame([("b", "s", None, "application/pdf", None)], "batch_id string, source_id string, stem string, media_type string, metadata array<struct<key:string,value:string>>")
    found = {r.page_id: (r.text, r.confidence, r.evidence, r.fields) for r in inputs.local_observations(pages, sources).collect()}
    assert found == {"p": ("", 0.2, [], None), "q": ("text", 0.4, ["embedded_pdf_text"], None)}
    assert inputs.local_observations(pages.where("false"), sources.where("false")).count() == 0


def test_a_box_of_a_sheet_is_a4():
    assert round(210 * G.MM_TO_POINT, 3) == 595.276
