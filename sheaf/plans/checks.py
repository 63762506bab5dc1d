"""Queries of inputs, providers, verification and evaluation inputs, registered with those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text
from ..operators import evaluation, inputs, integrity, render, report
from ..sources.tables import table
from .catalog import query


def _string(name: str):
    return F.col(name).cast("string")


# --- inputs and orders ----------------------------------------------------------------------


@query("SELECT source AS batch_id, CAST(doc_id AS VARCHAR) AS page_id, row_number() OVER (PARTITION BY source ORDER BY CAST(doc_id AS VARCHAR)) AS ordinal FROM documents")
def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("batch_id"), _string("doc_id").alias("page_id"))
    return inputs.in_order(pages, "pages")


@query("""
SELECT l_suppkey AS batch_id, CAST(l_partkey AS VARCHAR) AS support_id, CAST(l_orderkey AS VARCHAR) AS primary_id,
       row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(l_partkey AS VARCHAR), CAST(l_orderkey AS VARCHAR)) AS ordinal
FROM lineitem
""")
def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("batch_id"), _string("l_partkey").alias("support_id"), _string("l_orderkey").alias("primary_id")
    )
    return inputs.in_order(pairs, "candidates")


@query("""
SELECT o_custkey AS batch_id, [CAST(o_orderkey AS VARCHAR)] AS source_page_ids, o_orderpriority AS code,
       row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderkey AS VARCHAR), o_orderpriority) AS ordinal
FROM orders
""")
def link_issue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("batch_id"), F.array(_string("o_orderkey")).alias("source_page_ids"), F.col("o_orderpriority").alias("code")
    )
    return inputs.in_order(told, "link_issues")


@query("""
SELECT l_suppkey AS batch_id, l_orderkey || ':' || l_linenumber AS page_id,
       row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, l_quantity, l_discount, l_orderkey || ':' || l_linenumber) AS ordinal
FROM lineitem
""")
def placement_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("batch_id"),
        F.concat_ws(":", _string("l_orderkey"), _string("l_linenumber")).alias("page_id"),
        F.col("l_linenumber").alias("output_page"),
        F.col("l_quantity").alias("y"),
        F.col("l_discount").alias("x"),
    )
    return inputs.in_order(placed, "placements").select("batch_id", "page_id", "ordinal")


@query("""
WITH b AS (SELECT c_custkey AS batch_id, ['auto', 'host', 'local'][CAST(c_custkey % 3 AS INTEGER) + 1] AS provider, c_custkey % 5 = 0 AS has FROM customer),
c AS (SELECT *, CASE WHEN provider <> 'auto' THEN provider WHEN has THEN 'host' ELSE 'local' END AS chosen FROM b)
SELECT batch_id, CASE WHEN chosen = 'host' AND NOT has THEN 'host_manifest_missing'
                      WHEN chosen = 'local' AND batch_id IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 1) THEN 'image_requires_host'
                      WHEN batch_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 <> 3) THEN 'no_pages' END AS error
FROM c WHERE error IS NOT NULL
""")
def provider_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    named = F.get(F.array(*map(F.lit, ("auto", "host", "local"))), (key % 3).cast("int"))
    batches = table(spark, sf_dir, "customer").select(key.alias("batch_id"), named.alias("provider"), (key % 5 == 0).alias("has_manifest"))
    orders = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 4 == 1, "image/png").otherwise("application/pdf")
    sources = orders.select(F.col("o_custkey").alias("batch_id"), kind.alias("media_type"))
    return inputs.provider_errors(batches, sources, orders.where("o_orderkey % 4 <> 3").select(F.col("o_custkey").alias("batch_id")))


@query("""
SELECT d.source AS batch_id, d.doc_id AS page_id, l.quality AS observation, CASE WHEN l.quality IS NULL THEN 'observation_missing' END AS error
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def host_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("batch_id"), F.col("doc_id").alias("page_id"))
    seen = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("observation"))
    return inputs.host_observations(docs, docs.join(seen, "page_id").select("batch_id", "page_id", "observation"))


@query("""
SELECT source AS batch_id, doc_id AS page_id,
       CAST(CASE WHEN doc_id % 3 = 0 AND doc_id % 9 <> 0 THEN 0.7 WHEN doc_id % 2 = 0 THEN 0.4 ELSE 0.2 END AS DOUBLE) AS confidence,
       concat_ws('+', CASE WHEN doc_id % 2 = 0 THEN 'embedded_pdf_text' END,
                 CASE WHEN doc_id % 3 = 0 AND doc_id % 9 <> 0 THEN 'structured_xml_metadata' END) AS evidence,
       CASE WHEN doc_id % 3 = 0 AND doc_id % 9 <> 0 THEN CAST(doc_id AS VARCHAR) END AS invoice_number
FROM documents
""")
def local_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document has XML of its name in other letters; every ninth has two, so neither counts."""
    doc = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("batch_id"), "doc_id")
    entry = F.struct(F.lit("InvoiceNo").alias("key"), doc.cast("string").alias("value"))
    shown = docs.select(
        "batch_id", doc.alias("source_id"), F.format_string("Straße-%d", doc).alias("stem"), F.lit("application/pdf").alias("media_type"), F.array().cast("array<struct<key:string,value:string>>").alias("metadata")
    )
    xml = docs.where("doc_id % 3 = 0").select(
        "batch_id", (-doc).alias("source_id"), F.format_string("STRASSE-%d", doc).alias("stem"), F.lit("application/xml").alias("media_type"), F.array(entry).alias("metadata")
    )
    sources = shown.unionByName(xml).unionByName(xml.where("source_id % 9 = 0"))
    pages = docs.select("batch_id", doc.alias("page_id"), doc.alias("source_id"), F.when(doc % 2 == 0, " seen ").otherwise("  ").alias("text"))
    found = inputs.local_observations(pages, sources)
    number = F.try_element_at("fields", F.lit("invoice_number"))
    return found.select("batch_id", "page_id", "confidence", F.concat_ws("+", "evidence").alias("evidence"), number.alias("invoice_number"))


@query("""
WITH o AS (SELECT o_custkey AS batch_id, o_orderkey AS k FROM orders), p AS (
  SELECT batch_id, k AS g, 0 AS i, k AS page_id FROM o WHERE k % 19 <> 0
  UNION ALL SELECT batch_id, k, 1, CASE WHEN k % 2 = 0 THEN k ELSE -k END FROM o WHERE k % 19 <> 0 AND k % 11 = 0
), f AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY batch_id, page_id ORDER BY g, i) > 1 THEN 'repeated' WHEN page_id < 0 THEN 'page'
                 WHEN page_id % 13 = 0 THEN 'crop' WHEN page_id % 17 = 0 THEN 'observation' END AS error FROM p
), first AS (SELECT batch_id, arg_min(page_id, (g, i)) AS page_id, arg_min(error, (g, i)) AS error FROM f WHERE error IS NOT NULL GROUP BY batch_id)
SELECT * FROM first
UNION ALL SELECT batch_id, min(k), 'ungrouped' FROM o WHERE k % 19 = 0 AND batch_id NOT IN (SELECT batch_id FROM first) GROUP BY batch_id
""")
def layout_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("page_id"))
    other = F.when(key % 11 == 0, F.array(F.when(key % 2 == 0, key).otherwise(-key))).otherwise(F.array().cast("array<bigint>"))
    groups = pages.where("page_id % 19 <> 0").select(
        "batch_id", key.alias("group_seq"), F.array(key).alias("primary_page_ids"), other.alias("support_page_ids")
    )
    return inputs.layout_errors(groups, pages, pages.where("page_id % 13 <> 0"), pages.where("page_id % 17 <> 0"))


# --- verification ---------------------------------------------------------------------------


@query("""
WITH d AS (SELECT o_orderkey AS k, o_orderkey % 23 <> 0 AS readable, o_orderkey % 29 = 0 AS encrypted FROM orders),
p AS (SELECT l_orderkey AS k, l_linenumber AS page, l_partkey AS v FROM lineitem WHERE l_orderkey % 31 <> 0),
n AS (SELECT d.*, (SELECT count(*) FROM p WHERE p.k = d.k) AS n, (SELECT count(*) FROM lineitem WHERE l_orderkey = d.k) + CASE WHEN d.k % 37 = 0 THEN 1 ELSE 0 END AS expected FROM d),
w AS (SELECT *, CASE WHEN NOT readable THEN 'pdf_unreadable' WHEN encrypted THEN 'pdf_encrypted' WHEN n = 0 THEN 'pdf_empty' WHEN n <> expected THEN 'pdf_page_count' END AS code FROM n),
q AS (SELECT p.* FROM p JOIN w ON w.k = p.k WHERE coalesce(w.code, 'pdf_page_count') = 'pdf_page_count')
SELECT CAST(k AS VARCHAR) AS batch_id, code, CAST(NULL AS INTEGER) AS output_page FROM w WHERE code IS NOT NULL
UNION ALL SELECT CAST(k AS VARCHAR), 'pdf_annotations', CAST(page AS INTEGER) FROM q WHERE v % 7 = 0
UNION ALL SELECT CAST(k AS VARCHAR), 'pdf_non_a4', CAST(page AS INTEGER) FROM q WHERE v % 5 = 1 OR v % 3 = 2
UNION ALL SELECT CAST(k AS VARCHAR), 'pdf_page_clipped', CAST(page AS INTEGER) FROM q WHERE v % 11 = 0
""")
def document_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by part: turned every third, short every fifth, cropped every eleventh."""
    part = F.col("l_partkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("page"), "l_partkey")
    wide, high = 210 * G.MM_TO_POINT, 297 * G.MM_TO_POINT
    pages = lines.where("batch_id % 31 <> 0").select(
        "batch_id",
        "page",
        G.box(0, 0, wide, F.when(part % 5 == 1, high - 1.0).otherwise(high - 0.5)).alias("media"),
        G.box(F.when(part % 11 == 0, 1.0).otherwise(0.5), 0, wide, high).alias("crop"),
        F.when(part % 3 == 2, 90).otherwise(-360).alias("rotation"),
        (part % 7 == 0).cast("int").alias("n_annotations"),
    )
    counted = lines.groupBy("batch_id").agg(F.count("*").alias("n"))
    key = F.col("batch_id")
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id")).join(counted, "batch_id", "left").select(
        "batch_id", (key % 23 != 0).alias("readable"), (key % 29 == 0).alias("encrypted"), (F.coalesce("n", F.lit(0)) + (key % 37 == 0).cast("int")).alias("expected_pages")
    )
    return integrity.document_issues(documents, pages).select("batch_id", "code", "output_page")


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS batch_id, CAST(l_linenumber AS INTEGER) AS output_page,
       CASE WHEN l_partkey % 7 = 0 THEN 'renderer_missing' WHEN l_partkey % 7 = 1 OR l_partkey % 7 = 2 THEN 'renderer_failed'
            WHEN l_partkey % 9 - 4 NOT BETWEEN -2 AND 2 THEN 'render_size_mismatch' END AS code
FROM lineitem WHERE code IS NOT NULL
""")
def render_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At 300 dpi a sheet is 2480 by 3508 pixels; up to two more or fewer are fine."""
    part = F.col("l_partkey")
    state = F.when(part % 7 == 0, "missing").when(part % 7 == 1, "failed").when(part % 7 != 2, "ok")
    renders = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"),
        F.col("l_linenumber").alias("page"),
        state.alias("state"),
        (2480 + part % 9 - 4).alias("pixel_width"),
        F.lit(3508).alias("pixel_height"),
    )
    return integrity.render_issues(renders, 300).select("batch_id", "output_page", "code")


@query("""
SELECT source AS batch_id, 'source_asset_invalid' AS code, CAST(doc_id AS VARCHAR) AS page_id FROM documents
WHERE doc_id % 13 = 0 OR doc_id % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 3 = 0
""")
def source_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are missing, encrypted, of two pages, 0.02 points off or without a height; 0.005 points off are fine."""
    doc = F.col("page_id")
    assets = table(spark, sf_dir, "documents").select(
        F.col("source").alias("batch_id"), F.col("doc_id").alias("page_id"), (300.0 + F.col("n_chars") % 400).alias("width_pt"), F.lit(400.0).alias("height_pt")
    )
    found = assets.where("page_id % 13 <> 0").select(
        "batch_id",
        "page_id",
        F.lit(True).alias("readable"),
        (doc % 11 == 0).alias("encrypted"),
        F.when(doc % 7 == 0, 2).otherwise(1).alias("n_pages"),
        (F.col("width_pt") + F.when(doc % 5 == 0, 0.02).otherwise(0.005)).alias("found_width"),
        F.when(doc % 3 != 0, F.col("height_pt")).alias("found_height"),
    )
    return integrity.source_issues(assets, found).select("batch_id", "code", F.get("source_page_ids", F.lit(0)).alias("page_id"))


@query("""
WITH p AS (
  SELECT DISTINCT l_orderkey AS b, l_linenumber * CAST(1000000000000 AS BIGINT) + l_partkey * 1000000 + l_suppkey AS seq, CASE WHEN l_partkey % 17 = 0 THEN 1 ELSE l_linenumber END AS page_id, l_partkey AS v,
         CASE WHEN l_partkey % 23 = 0 THEN -1 WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS pg,
         CAST(10 + (l_linenumber - 1) * CASE WHEN l_partkey % 13 = 0 THEN 15 ELSE 26 END + CASE WHEN l_partkey % 41 = 0 THEN 190 ELSE 0 END AS DOUBLE) AS x, l_partkey % 29 = 0 AS flat, l_partkey % 31 = 0 AS skew
  FROM lineitem
), e AS (
  SELECT p.*, CASE
    WHEN row_number() OVER (PARTITION BY b, page_id ORDER BY seq) > 1 THEN 'duplicate'
    WHEN page_id = 7 THEN 'missing_asset' WHEN pg < 0 THEN 'negative_page' WHEN flat THEN 'bad_geometry' WHEN x + 20 > 210 THEN 'off_sheet' WHEN skew THEN 'aspect_mismatch'
    WHEN EXISTS (SELECT 1 FROM p q WHERE q.b = p.b AND q.pg = p.pg AND q.seq < p.seq AND NOT q.flat AND least(q.x, p.x) + 20 - greatest(q.x, p.x) > 1e-7) THEN 'overlap' END AS error
  FROM p
), f AS (SELECT b, min(seq) AS seq, arg_min(page_id, seq) AS page_id, arg_min(error, seq) AS error FROM e WHERE error IS NOT NULL GROUP BY b)
SELECT b AS batch_id, CAST(seq AS BIGINT) AS seq, CAST(page_id AS BIGINT) AS page_id, error FROM f
UNION ALL SELECT DISTINCT b, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 'page_gap' FROM p WHERE b % 5 = 0 AND b NOT IN (SELECT b FROM f)
""")
def compose_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order side by side on a sheet (a line number may stand twice), some too near, too far right, without a height, skewed, or without an asset."""
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    step = F.when(part % 13 == 0, 15).otherwise(26)
    placed = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"),
        (line.cast("long") * 10**12 + part * 10**6 + F.col("l_suppkey")).alias("seq"),
        F.when(part % 17 == 0, 1).otherwise(line).cast("long").alias("page_id"),
        F.when(part % 23 == 0, -1).when(F.col("l_orderkey") % 5 == 0, 1).otherwise(0).alias("output_page"),
        (10 + (line - 1) * step + F.when(part % 41 == 0, 190).otherwise(0)).cast("double").alias("x"),
        F.lit(10.0).alias("y"),
        F.lit(20.0).alias("width"),
        F.when(part % 29 == 0, 0.0).when(part % 31 == 0, 31.0).otherwise(30.0).alias("height"),
        G.box(0, 0, 1, 1).alias("crop"),
    ).distinct()
    pages = placed.select("batch_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long"))).alias("page_id")).distinct()
    assets = pages.select("*", F.lit(200.0).alias("width_pt"), F.lit(300.0).alias("height_pt"))
    found = integrity.compose_errors(placed, assets)
    return found.select(F.col("batch_id").cast("long").alias("batch_id"), "seq", "page_id", "error")


@query("""
SELECT CAST(lang AS VARCHAR) AS batch_id, CAST(doc_id AS VARCHAR) AS page_id,
       CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN 'source_resolution_unverifiable' ELSE 'low_source_resolution' END AS code
FROM documents WHERE CASE WHEN doc_id % 5 = 0 THEN doc_id % 2 = 0 ELSE 300.0 * (0.1 + (n_chars % 50) * 0.01) / greatest(100.0 / 300, (100.0 + doc_id % 60) / 300) + 1e-7 < 300 END
""")
def resolution_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    placed = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("batch_id"),
        doc.alias("page_id"),
        F.lit(0).alias("output_page"),
        F.lit(100.0).alias("width"),
        (100.0 + doc % 60).alias("height"),
        F.lit(300.0).alias("width_pt"),
        F.lit(300.0).alias("height_pt"),
        G.box(0, 0, 1, 1).alias("crop"),
        F.when(doc % 5 != 0, 0.1 + (F.col("n_chars") % 50) * 0.01).alias("raster_scale"),
        (doc % 2 == 0).alias("is_raster"),
    )
    return integrity.low_resolution(placed, 300).select("batch_id", F.get("source_page_ids", F.lit(0)).alias("page_id"), "code")


@query("""
WITH a AS (SELECT lang AS b, doc_id FROM documents UNION ALL SELECT lang, doc_id FROM documents WHERE doc_id % 6 = 0)
SELECT b AS batch_id, CAST(doc_id AS VARCHAR) AS page_id, 'asset_duplicate' AS code FROM a GROUP BY b, doc_id HAVING count(*) > 1
UNION ALL SELECT b, CAST(doc_id AS VARCHAR), 'asset_mapping_mismatch' FROM a WHERE doc_id % 10 = 0
""")
def asset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.col("lang").alias("batch_id"), F.col("doc_id").alias("page_id"))
    found = integrity.asset_issues(pages.unionByName(pages.where("page_id % 6 = 0")), pages.where("page_id % 10 <> 0"))
    return found.select("batch_id", F.get("source_page_ids", F.lit(0)).alias("page_id"), "code")


@query()
def content_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as pixels, 40 by 40, held against themselves, against themselves backwards, and against nothing."""
    doc = F.col("doc_id")
    pixels = F.substring(F.rpad(F.regexp_replace("text", "[^ -~]", " "), 1600, "text "), 1, 1600)
    shown = F.when(doc % 3 == 0, pixels).when(doc % 3 == 1, F.reverse(pixels))
    side = F.lit(40)
    patches = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("batch_id"), doc.alias("page_id"), F.lit(0).alias("output_page"),
        pixels.cast("binary").alias("source"), side.alias("source_width"), side.alias("source_height"),
        shown.cast("binary").alias("output"), side.alias("output_width"), side.alias("output_height"),
    )
    return render.content_issues(patches).select("batch_id", F.get("source_page_ids", F.lit(0)).alias("page_id"), "code")


# --- reports and evaluation -----------------------------------------------------------------


@query("""
WITH r AS (SELECT source AS batch_id, sum(20 + n_chars % 60) OVER (PARTITION BY source ORDER BY doc_id) <= 600 AS shown FROM documents)
SELECT batch_id, count(*) FILTER (shown) AS n_shown, count(*) FILTER (NOT shown) AS n_omitted FROM r GROUP BY batch_id
""")
def review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("batch_id"), "doc_id", (20 + F.col("n_chars") % 60).alias("height"))
    return report.review_page(rows, "height", 600, "doc_id")


@query("""
SELECT o_orderkey, CASE WHEN length(o_orderpriority) <= 4 THEN o_orderpriority WHEN length(o_orderpriority) <= 8 THEN o_orderpriority[1:4] || '|' || o_orderpriority[5:]
                        ELSE o_orderpriority[1:4] || '|' || o_orderpriority[5:7] || '…' END AS lines FROM orders
""")
def truncated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    widths = F.create_map(F.lit("M"), F.lit(1.0))
    lines = text.truncated(text.wrapped(F.col("o_orderpriority"), widths, 4.0), widths, 4.0, 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("|", lines).alias("lines"))


@query("""
SELECT o.o_custkey AS case_id, row_number() OVER (PARTITION BY o.o_custkey ORDER BY l.l_linenumber, l.l_quantity, l.l_discount, k.key) AS ordinal, k.key,
       k.key IS NOT NULL AND l.l_linenumber > 1 AS valid
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN (SELECT o_custkey, o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) || ':0' AS key FROM orders WHERE o_orderkey % 9 <> 0) k
  ON k.o_custkey = o.o_custkey AND k.o_orderkey = o.o_orderkey
""".replace("l.l_discount, k.key", "l.l_discount, k.key NULLS FIRST"))
def placed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("page_id"))
    key = F.concat(F.sha2(_string("page_id"), 256), F.lit(":0"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), (F.col("l_linenumber") - 2).alias("output_page"), F.col("l_quantity").alias("y"), F.col("l_discount").alias("x")
    )
    found = evaluation.placed_keys(lines.join(orders, "page_id"), orders.where("page_id % 9 <> 0").withColumn("key", key))
    return found.select("case_id", "ordinal", "key", "valid")


@query("""
WITH g AS (SELECT o_custkey AS case_id, o_orderpriority AS g, o_orderkey AS k FROM orders)
SELECT DISTINCT case_id, CASE WHEN bool_or(k % 9 = 0) THEN NULL ELSE string_agg('k' || k, ',' ORDER BY 'k' || k) END AS members FROM g GROUP BY case_id, g
""")
def group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("page_id"), "o_orderpriority")
    groups = pages.groupBy("case_id", F.col("o_orderpriority").alias("group_id")).agg(F.collect_list("page_id").alias("page_ids"))
    keyed = pages.where("page_id % 9 <> 0").select("case_id", "page_id", F.concat(F.lit("k"), _string("page_id")).alias("key"))
    return evaluation.group_keys(groups, keyed).select("case_id", F.array_join("members", ",").alias("members"))
