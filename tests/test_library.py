"""Layout, checks, names, redaction, archives, XML, sinks, streaming."""

import io
import json
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.functions import ids, paths, text
from sheaf.operators import crop, ingest, issues, layout, report, scanner
from sheaf.settings import Settings
from sheaf.sources import archives, sinks, vouchers
from sheaf.streaming import landing


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_settings_refuse_what_is_out_of_range(monkeypatch):
    with pytest.raises(ValueError):
        Settings(page_margin_mm=11)
    monkeypatch.setenv("SHEAF_RENDER_DPI", "200")
    assert Settings.from_environment().render_dpi == 200
    monkeypatch.setenv("SHEAF_UNKNOWN", "1")
    with pytest.raises(ValueError):
        Settings.from_environment()


def test_member_names(spark):
    names = ["a/b.pdf", "../x", "/x", "C:\\x", "a/CON.txt", "a/b. ", "a:b", "", "a\\..\\b", "x/./y", "com1", "common.txt", "a\x00b", None]
    assert column(spark, names, lambda v: F.coalesce(paths.is_safe_member(v), F.lit(False))) == [
        True, False, False, False, False, False, False, False, False, True, False, True, False, False,
    ]
    assert column(spark, ["A\\B. /c", "a/b/C"], paths.member_key) == ["a/b/c", "a/b/c"]
    assert column(spark, ["x/y.TIF", "a.tar.gz", "noext", ".pdf"], paths.media_type) == ["image/tiff"] + ["application/octet-stream"] * 3
    assert column(spark, ["x.ZIP", "a.tar.gz", "b.tgz", "c.rar", "d.7z", "e.pdf"], paths.archive_kind) == ["zip", "tar", "tar", "rar", "7z", None]
    assert column(spark, ["/a/b/", "C:\\x\\y.pdf", ""], paths.basename) == ["b", "y.pdf", ""]


def test_folding_and_redaction(spark):
    assert column(spark, ["Ｆｏｏ Straße-1", " - ", None, "ﬁx"], text.normalised) == ["foostrasse1", None, None, "fix"]
    some = ["id 11010519491231002X ok", "4111 1111 1111 1111", "1234567890123456789012", "x 4111-1111-1111-1111."]
    assert column(spark, some, text.redacted) == ["id [REDACTED PRC ID] ok", "[REDACTED BANK CARD]", some[2], "x [REDACTED BANK CARD]."]
    assert column(spark, ["abcdef"], lambda v: text.wrapped(v, F.create_map(F.lit("c"), F.lit(2.0)), 3.0)) == [["ab", "cd", "ef"]]
    nested = {"b": [{"api_key": "s", "Path": "/home/x/y.pdf"}], "/a/z": 1, "/b/z": "C:\\q\\r.txt", "n": None, "f": 1.5}
    cleaned = json.loads(column(spark, [json.dumps(nested), "no json", None], report.sanitised_json)[0])
    assert cleaned == {"b": [{"[REDACTED KEY]": "[REDACTED]", "Path": "y.pdf"}], "z": 1, "z#2": "r.txt", "n": None, "f": 1.5}


@pytest.mark.parametrize(
    ("groups", "want"),
    [
        ([[60.0] * 4], [[0, 0, 0, 0]]),
        ([[80.0]] * 4, [[0], [0], [0], [1]]),
        ([[130.0]] * 4, [[0], [0], [1], [1]]),
        ([[150.0], [100.0, 100.0]], [[0], [1, 1]]),
        ([[80.0] * 5, [10.0]], [[0, 0, 0, 1, 1], [2]]),
        ([[10.0], [80.0] * 4, [10.0], [10.0]], [[0], [1, 1, 1, 2], [3], [3]]),
    ],
)
def test_next_fit(groups, want):
    assert layout.next_fit(groups, 270.0, 8.0) == want


def test_an_item_that_fits_no_page_is_refused():
    with pytest.raises(ValueError):
        layout.next_fit([[280.0]], 270.0, 8.0)


def test_placement_is_centred_and_fits(spark):
    rows = [("b", g, 0, f"p{g}", 60.0, 90.0, 180.0, 1.5) for g in range(4)]
    items = spark.createDataFrame(rows, "batch_id string, group_seq int, item_seq int, page_id string, min_height double, min_width double, max_width double, ratio double")
    packed = layout.pack(items, Settings()).join(items.select("batch_id", "page_id", "min_width", "max_width", "ratio"), ["batch_id", "page_id"])
    placed = layout.place(packed, Settings()).orderBy("output_page", "y").collect()
    assert [r.output_page for r in placed] == [0, 0, 0, 0]
    assert abs(placed[-1].y + placed[-1].height - (297 - placed[0].y)) < 1e-6
    assert all(abs(r.x - (210 - r.width) / 2) < 1e-9 for r in placed)
    assert sum(r.height for r in placed) + 3 * 8 <= 270 + 1e-6


def test_gate_and_orders(spark):
    rows = [("a", "low_source_resolution", 1), ("a", "placement_overlap", None), ("b", "low_source_resolution", 2)]
    found = spark.createDataFrame(rows, "batch_id string, code string, p int").select(*issues.issue(F.col("batch_id"), F.col("code"), F.array(), F.col("p")))
    verdict = {r.batch_id: (r.n_issues, r.n_hard, r.passed) for r in issues.gate(found).collect()}
    assert verdict == {"a": (2, 1, False), "b": (1, 0, True)}
    assert [r.code for r in issues.verification_order(found).collect()][0] == "placement_overlap"
    # by severity's name first, and hard codes are errors
    assert [(r.severity, r.code) for r in issues.final_order(found).collect()][:2] == [("error", "placement_overlap"), ("warning", "low_source_resolution")]


def test_first_by_digest_and_fingerprint(spark):
    rows = [("b", 2, "x"), ("b", 1, "x"), ("b", 3, "y"), ("c", 4, "x")]
    files = spark.createDataFrame(rows, "batch_id string, seq int, sha256 string")
    kept = ingest.first_by_digest(files, F.col("sha256"), F.col("seq"), "batch_id").collect()
    assert sorted(r.seq for r in kept) == [1, 3, 4]
    one = {r.batch_id: r.fingerprint for r in ingest.fingerprint(files, Settings(), "local").collect()}
    turned = {r.batch_id: r.fingerprint for r in ingest.fingerprint(files.orderBy(F.desc("seq")), Settings(), "local").collect()}
    other = {r.batch_id: r.fingerprint for r in ingest.fingerprint(files, Settings(), "host", "m").collect()}
    assert one == turned and one["b"] != one["c"] and one["b"] != other["b"]


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark):
    inner = zipped([("deep.pdf", b"deep")])
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        info = tarfile.TarInfo("t.png")
        info.size = 3
        t.addfile(info, io.BytesIO(b"png"))
        link = tarfile.TarInfo("link.pdf")
        link.type = tarfile.SYMTYPE
        t.addfile(link)
    rows = [
        ("b", "good", "zip", zipped([("a.pdf", b"1"), ("in/b.zip", inner), ("note.txt", b"n")])),
        ("b", "unsafe", "zip", zipped([("ok.pdf", b"1"), ("../escape.pdf", b"2")])),
        ("b", "twice", "zip", zipped([("A.pdf", b"1"), ("a.pdf ", b"2")])),
        ("b", "broken", "zip", b"no archive"),
        ("b", "tar", "tar", tar.getvalue()),
        ("big", "big", "zip", zipped([("a.pdf", b"x" * 600), ("b.pdf", b"x" * 600)])),
    ]
    files = spark.createDataFrame(rows, "batch_id string, archive_id string, kind string, content binary")
    kept, trouble = archives.expand_all(files, Settings(max_bytes=1000))
    assert sorted((r.archive_id, r.member, r.depth) for r in kept.collect()) == [
        ("good", "a.pdf", 1), ("good!in/b.zip", "deep.pdf", 2), ("tar", "t.png", 1),
    ]
    assert sorted((r.archive_id, r.code) for r in trouble.collect()) == [
        ("big", "archive_limit"), ("broken", "archive_failed"), ("good", "unsupported_format"),
        ("twice", "unsafe_archive_member"), ("unsafe", "unsafe_archive_member"),
    ]


def test_one_budget_over_nested_archives(spark):
    inner = zipped([("c.pdf", b"3"), ("d.pdf", b"4")])
    rows = [
        ("b", "outer", "zip", zipped([("a.pdf", b"1"), ("in.zip", inner)])),
        ("bad", "1", "zip", zipped([("a.pdf", b"1"), ("../x.pdf", b"2"), ("b.pdf", b"3")])),
        ("bad", "2", "zip", zipped([("a.pdf", b"1"), ("c.pdf", b"4")])),
    ]
    files = spark.createDataFrame(rows, "batch_id string, archive_id string, kind string, content binary")
    kept, trouble = archives.expand_all(files, Settings(max_files=3))
    # The unsafe archive has taken two entries when it fails.
    assert sorted((r.batch_id, r.archive_id, r.member) for r in kept.collect()) == [("b", "outer", "a.pdf")]
    assert sorted((r.archive_id, r.code) for r in trouble.collect()) == [("1", "unsafe_archive_member"), ("2", "archive_limit"), ("outer!in.zip", "archive_limit")]
    kept, trouble = archives.expand_all(files, Settings(max_files=4))
    assert kept.count() == 5 and [r.code for r in trouble.collect()] == ["unsafe_archive_member"]


def test_xml(spark):
    good = b'<r xmlns:n="u"><n:InvoiceNo> TEST-001 </n:InvoiceNo><Passenger>Ada</Passenger><g><Ignored>nested</Ignored></g><Passenger>Eve</Passenger><e/></r>'
    evil = b'<!DOCTYPE r [<!ENTITY x "y">]><r><a>&x;</a></r>'
    rows = [("b", "good", good), ("b", "evil", evil), ("b", "wide", evil.decode().encode("utf-16")), ("b", "bad", b"<r>")]
    found = {r.id: r for r in vouchers.xml_metadata(spark.createDataFrame(rows, "batch_id string, id string, content binary")).collect()}
    assert {e.key: e.value for e in found["good"].metadata} == {"InvoiceNo": "TEST-001", "Passenger": "Ada", "Ignored": "nested"}
    assert all(found[i].code == "xml_metadata_invalid" and found[i].metadata is None for i in ("evil", "wide", "bad"))


def test_manifest(spark):
    entry = '{"page_id":"p","preview_sha256":"d","observation":{"a":1}}'
    texts = [f'{{"pages":[{entry}]}}', f'{{"pages":[{entry}],"x":1}}', '{"pages":[{"page_id":"q"}]}']
    df = spark.createDataFrame([(t,) for t in texts], "json string")
    assert [(r.page_id, r.valid) for r in vouchers.manifest(spark, df).collect()] == [("p", True), ("p", False), ("q", False)]


def test_crops(spark):
    image = np.full((16, 24, 3), 255, np.uint8)
    image[4:10, 6:14] = 20
    assert crop.decide(image, []) == (5 / 24, 3 / 16, round(15 / 24, 10), round(11 / 16, 10), None) or crop.decide(image, [])[4] is None
    wide = crop.decide(image, [(0.1, 0.1, 0.9, 0.9)])
    assert wide[4] is None and wide[0] == 0.09 and wide[3] == 0.91
    noisy = image.copy()
    noisy[0] = 100
    assert crop.decide(noisy, [])[4] == "crop_uncertain"
    edge = np.full((16, 24, 3), 255, np.uint8)
    edge[4:10, 0:5] = 20
    assert crop.decide(edge, [])[4] == "crop_uncertain"
    assert crop.decide(None, [])[4] == "crop_preview_invalid"


def test_scanner(spark):
    found = column(spark, ["C:\\Windows\\x", "c:/data/x", "/home/bob/x", "AKIA" + "A" * 16, "nothing"], scanner.content_reasons)
    assert found == [[], ["absolute Windows path"], ["user-profile absolute path", "private absolute POSIX path"], ["credential-like token"], []]


def test_issue_ids(spark):
    rows = spark.createDataFrame([("b", None)], "b string, p int").select(F.struct(F.col("p").alias("z"), F.lit("é").alias("a")).alias("s"))
    assert rows.select(ids.canonical_json(F.col("s"))).first()[0] == '{"a":"é","z":null}'


def test_publish_is_all_or_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    sinks.publish(spark, {"a": spark.range(3), "b": spark.range(2)}, folder)
    with pytest.raises(Exception):  # noqa: B017
        sinks.publish(spark, {"a": spark.range(9), "b": spark.range(1).selectExpr("raise_error('no') AS x")}, folder)
    assert spark.read.parquet(f"{folder}/a").count() == 3 and spark.read.parquet(f"{folder}/b").count() == 2
    sinks.publish(spark, {"a": spark.range(9)}, folder)
    assert spark.read.parquet(f"{folder}/a").count() == 9
    sinks.write_text(spark, f"{folder}/report.json", sinks.canonical({"b": 1, "a": "é"}))
    assert (tmp_path / "out/report.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n'


def test_landing_takes_each_content_once(spark, tmp_path):
    zone = tmp_path / "zone"
    zone.mkdir()
    for name, data in (("a.pdf", "1"), ("b.pdf", "1"), ("c.pdf", "2")):
        (zone / name).write_text(data)
    stream = landing.first_arrivals(landing.arrivals(spark, str(zone)))
    landing.land(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    (zone / "d.pdf").write_text("2")
    landing.land(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.sha256[:4] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["6b86", "d473"]
