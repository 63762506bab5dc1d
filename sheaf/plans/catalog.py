"""Queries over the driver's tables, one or more for each operator, with their DuckDB counterparts.

The tables hold no vouchers, so each query maps them to an operator's roles; what
is planted to make a case occur is planted the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import settled
from ..functions import geometry as G
from ..functions import ids, paths, text
from ..operators import binding, classify, crop, evaluation, ingest, integrity, issues, layout, linkage, report, scanner
from ..settings import Settings
from ..sources import vouchers
from ..sources.tables import table
from . import run as runs

SETTINGS = Settings()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct documents, sized, packed and placed: a row for each output page."""
    placed = place_pages(spark, sf_dir)
    return placed.groupBy("batch_id", "output_page").agg(F.count("*").alias("n_items"), F.round(F.sum("height"), 6).alias("height"))


# --- ingest ---------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha256, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY sha256(text)")
def dedup_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), "n_chars")
    return ingest.first_by_digest(docs, F.col("sha256"), F.col("doc_id"))


EVENT_ORDER = ["purchase", "signup", "click", "view", "error"]


@query("""
SELECT event_type, CAST(list_position(['purchase', 'signup', 'click', 'view', 'error'], event_type) - 1 AS INTEGER) AS rank, count(*) AS n
FROM events GROUP BY event_type
""")
def category_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "events").withColumn("rank", classify.rank_in(F.col("event_type"), EVENT_ORDER))
    return ranked.groupBy("event_type", "rank").agg(F.count("*").alias("n")).orderBy("rank")


@query("""
SELECT source AS batch_id, count(*) AS n_sources,
       sha256('{"host_manifest_sha256":null,"provider":"local","schema_version":1,"settings":{"item_gap_mm":8.0,"page_margin_mm":13.5,"render_dpi":300},"sources":['
              || string_agg('"' || h || '"', ',' ORDER BY h) || ']}') AS fingerprint
FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY source
""")
def batch_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("batch_id"), F.sha2("text", 256).alias("sha256"))
    return ingest.fingerprint(docs, SETTINGS, "local")


#: Planted names, by page_id modulo their number; the last one is a page's own path.
NAMES = ["../up.pdf", "C:\\x\\y.pdf", "/abs/a.pdf", "dir/con.txt", "a//./b.PDF", "dir /x.pdf", "a/b:c.pdf", "", "Nul", "ok\\deep\\A.pdf"]
_NAMES_SQL = "[" + ", ".join("'" + n + "'" for n in NAMES) + "]"
_MEMBERS_SQL = f"""
members AS (
  SELECT page_id, CAST(page_id % 20 AS VARCHAR) AS archive_id,
         CASE WHEN page_id % 11 < 10 THEN {_NAMES_SQL}[CAST(page_id % 11 AS INTEGER) + 1]
              ELSE regexp_replace(url, '^[a-z]+://', '') END AS member
  FROM pages
), split AS (
  SELECT *, list_filter(string_split(replace(member, '\\', '/'), '/'), lambda p: p <> '' AND p <> '.') AS parts FROM members
)"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = (F.col("page_id") % 11).cast("int")
    own = F.regexp_replace("url", "^[a-z]+://", "")
    named = F.when(place < 10, F.get(F.array(*map(F.lit, NAMES)), place)).otherwise(own)
    return table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 20).cast("string").alias("archive_id"), named.alias("member"))


_DEVICES_SQL = ", ".join(f"'{d}'" for d in paths.DEVICES)


@query(f"""
WITH {_MEMBERS_SQL}
SELECT page_id, member,
       member <> '' AND NOT starts_with(replace(member, '\\', '/'), '/') AND NOT regexp_matches(member, '^[A-Za-z]:')
       AND len(list_filter(parts, lambda p: p = '..' OR contains(p, ':') OR rtrim(p, ' .') <> p
                           OR lower(string_split(p, '.')[1]) IN ({_DEVICES_SQL}))) = 0 AS safe,
       array_to_string(list_transform(parts, lambda p: lower(rtrim(p, ' .'))), '/') AS member_key
FROM split
""")
def safe_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("member")
    return _members(spark, sf_dir).select("page_id", "member", paths.is_safe_member(m).alias("safe"), paths.member_key(m).alias("member_key"))


@query(f"""
WITH {_MEMBERS_SQL}, keyed AS (
  SELECT archive_id, array_to_string(list_transform(parts, lambda p: lower(rtrim(p, ' .'))), '/') AS member_key FROM split
)
SELECT archive_id, member_key, count(*) AS n FROM keyed GROUP BY archive_id, member_key HAVING count(*) > 1
""")
def member_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = ingest.unsafe_members(_members(spark, sf_dir).select("archive_id", "member"))
    return checked.where("collides").groupBy("archive_id", "member_key").agg(F.count("*").alias("n"))


@query("""
WITH RECURSIVE m AS (
  SELECT lang AS batch_id, source AS archive_id, n_chars AS bytes, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents
), fold AS (
  SELECT batch_id, CAST(0 AS BIGINT) AS rn, CAST(60 AS BIGINT) AS entries, CAST(120000 AS BIGINT) AS room, CAST([] AS VARCHAR[]) AS failed
  FROM (SELECT DISTINCT batch_id FROM m)
  UNION ALL
  SELECT f.batch_id, m.rn,
         CASE WHEN list_contains(f.failed, m.archive_id) OR f.entries <= 0 THEN f.entries ELSE f.entries - 1 END,
         CASE WHEN list_contains(f.failed, m.archive_id) OR f.entries <= 0 OR m.bytes > f.room THEN f.room ELSE f.room - m.bytes END,
         CASE WHEN list_contains(f.failed, m.archive_id) THEN f.failed
              WHEN f.entries <= 0 OR m.bytes > f.room THEN list_append(f.failed, m.archive_id) ELSE f.failed END
  FROM fold f JOIN m ON m.batch_id = f.batch_id AND m.rn = f.rn + 1
), done AS (SELECT batch_id, arg_max(failed, rn) AS failed FROM fold GROUP BY batch_id)
SELECT m.batch_id, m.archive_id, count(*) AS n_members, NOT bool_or(list_contains(d.failed, m.archive_id)) AS accepted
FROM m JOIN done d ON m.batch_id = d.batch_id GROUP BY m.batch_id, m.archive_id
""")
def archive_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("batch_id"), F.col("source").alias("archive_id"), F.col("n_chars").alias("bytes"), F.col("doc_id").alias("seq")
    )
    folded = ingest.within_budget(docs, max_entries=60, max_bytes=120_000)
    return folded.groupBy("batch_id", "archive_id").agg(F.count("*").alias("n_members"), F.bool_and("accepted").alias("accepted"))


# --- metadata and binding -------------------------------------------------------------------


@query("""
SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events
""")
def leaf_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").select("event_id", F.explode(vouchers.leaf_entries(F.col("props"))).alias("e"))
    return found.select("event_id", "e.key", "e.value")


@query("""
WITH m AS (
  SELECT o_orderkey, [{'key': 'InvoiceNo', 'value': CAST(o_orderkey AS VARCHAR)}, {'key': 'InvoiceNumber', 'value': 'second'},
                      {'key': 'Amount', 'value': CASE WHEN o_orderkey % 2 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR) || '.50' END}] AS e,
         o_orderpriority FROM orders
)
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS invoice_number, NULLIF(trim(o_orderpriority), '') AS vendor,
       CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) + 0.5 END AS amount
FROM m
""")
def metadata_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    pairs = [("InvoiceNo", key), ("InvoiceNumber", F.lit("second")), ("Seller", F.col("o_orderpriority"))]
    pairs.append(("Amount", F.when(F.col("o_orderkey") % 2 == 0, "n/a").otherwise(F.concat(key, F.lit(".50")))))
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    found = table(spark, sf_dir, "orders").select("o_orderkey", entries.alias("e"))
    fields = binding.metadata_fields(F.col("e"))
    return found.select(
        "o_orderkey",
        F.try_element_at(fields, F.lit("invoice_number")).alias("invoice_number"),
        F.try_element_at(fields, F.lit("vendor")).alias("vendor"),
        binding.metadata_amount(F.col("e")).cast("double").alias("amount"),
    )


@query("""
SELECT o.o_orderkey, l.l_partkey, l.l_quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
WHERE (SELECT count(*) FROM lineitem x WHERE x.l_orderkey = o.o_orderkey) = 1
""")
def companion_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity")
    return binding.companions(orders, lines, "o_orderkey")


@query("""
WITH p AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS d FROM documents WHERE doc_id % 7 <> 0
           UNION ALL SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) FROM documents WHERE doc_id % 50 = 1 AND doc_id % 7 <> 0),
e AS (SELECT doc_id, sha256(CAST(doc_id + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS VARCHAR)) AS d FROM labels),
pc AS (SELECT doc_id, count(*) AS n, min(d) AS d FROM p GROUP BY doc_id),
ec AS (SELECT doc_id, count(*) AS n, min(d) AS d FROM e GROUP BY doc_id)
SELECT coalesce(pc.doc_id, ec.doc_id) AS doc_id,
       CASE WHEN pc.n > 1 OR ec.n > 1 THEN 'duplicate' WHEN ec.n IS NULL THEN 'missing' WHEN pc.n IS NULL THEN 'extra'
            WHEN pc.d = ec.d THEN 'matched' ELSE 'stale' END AS status
FROM pc FULL OUTER JOIN ec ON pc.doc_id = ec.doc_id
""")
def manifest_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(c.cast("string"), 256).alias("digest")
    docs = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select("doc_id", digest(F.col("doc_id")))
    docs = docs.unionByName(docs.where("doc_id % 50 = 1"))
    entries = table(spark, sf_dir, "labels").select("doc_id", digest(F.col("doc_id") + F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0)))
    return binding.bind(docs, entries, "doc_id")


# --- linkage --------------------------------------------------------------------------------


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as invoices, their line items as statements; a customer's are a batch."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = F.col("o_orderkey")
    band = lambda c: (F.floor(c / 100_000) * 100_000).cast("decimal(18,2)").alias("amount")
    shared = [
        F.when(key % 3 == 0, key.cast("string")).alias("order_number"),
        F.col("o_orderpriority").alias("vendor"),
    ]
    none = F.lit(None).cast("string")
    primary = orders.select(
        F.col("o_custkey").cast("string").alias("batch_id"),
        F.concat(F.lit("P"), key.cast("string")).alias("page_id"),
        F.lit("lodging_invoice").alias("document_type"),
        band(F.col("o_totalprice")),
        F.lit(None).cast("date").alias("issue_date"),
        F.to_date("o_orderdate").alias("service_start"),
        F.to_date("o_orderdate").alias("service_end"),
        *shared,
        F.when(key % 5 == 0, F.col("o_orderstatus")).alias("traveler"),
        none.alias("route"),
        F.when(key % 17 == 0, 0.5).otherwise(0.9).alias("confidence"),
    )
    totals = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"),
        F.to_date(F.min("l_shipdate")).alias("first"),
        F.to_date(F.max("l_shipdate")).alias("last"),
        F.max("l_linestatus").alias("status"),
    )
    support = totals.join(orders.select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey").select(
        F.col("o_custkey").cast("string").alias("batch_id"),
        F.concat(F.lit("S"), key.cast("string")).alias("page_id"),
        F.lit("lodging_statement").alias("document_type"),
        band(F.col("total")),
        F.lit(None).cast("date").alias("issue_date"),
        F.add_months("first", -12).alias("service_start"),
        F.col("last").alias("service_end"),
        *shared,
        F.when(key % 5 == 0, F.col("status")).alias("traveler"),
        none.alias("route"),
        F.lit(0.9).alias("confidence"),
    )
    return primary.unionByName(support)


_LINK_SQL = """
p AS (
  SELECT CAST(o_custkey AS VARCHAR) AS batch_id, 'P' || o_orderkey AS id, floor(o_totalprice / 100000) AS band, CAST(o_orderdate AS DATE) AS s0,
         CAST(o_orderdate AS DATE) AS s1, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS ord, o_orderpriority AS vendor,
         CASE WHEN o_orderkey % 5 = 0 THEN lower(o_orderstatus) END AS trav, CASE WHEN o_orderkey % 17 = 0 THEN 0.5 ELSE 0.9 END AS conf
  FROM orders
), t AS (
  SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total, CAST(min(l_shipdate) AS DATE) AS f, CAST(max(l_shipdate) AS DATE) AS l,
         max(l_linestatus) AS status FROM lineitem GROUP BY l_orderkey
), s AS (
  SELECT CAST(o_custkey AS VARCHAR) AS batch_id, 'S' || o_orderkey AS id, floor(total / 100000) AS band, CAST(f - INTERVAL 12 MONTH AS DATE) AS s0, l AS s1,
         CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS ord, o_orderpriority AS vendor,
         CASE WHEN o_orderkey % 5 = 0 THEN lower(status) END AS trav, 0.9 AS conf
  FROM t JOIN orders ON l_orderkey = o_orderkey
), raw AS (
  SELECT s.batch_id, s.id AS support_id, p.id AS primary_id, coalesce(p.ord = s.ord, false) AS o, p.band = s.band AS a, p.vendor = s.vendor AS v,
         p.s0 <= s.s1 AND s.s0 <= p.s1 AS d, coalesce(p.trav = s.trav, false) AS t, coalesce(p.trav <> s.trav, false) AS tc,
         least(p.conf, s.conf) < 0.65 AS confidence_limited
  FROM s JOIN p ON s.batch_id = p.batch_id
), pairs AS (
  SELECT *, CASE WHEN confidence_limited THEN CAST(0 AS DECIMAL(6,4)) ELSE CAST(greatest(0, least(1, 0.20
           + CASE WHEN o THEN 0.55 ELSE 0 END + CASE WHEN a THEN 0.35 ELSE -0.45 END + CASE WHEN v THEN 0.15 ELSE 0 END
           + CASE WHEN d THEN 0.15 ELSE -0.30 END + CASE WHEN t THEN 0.10 ELSE 0 END - CASE WHEN tc THEN 0.25 ELSE 0 END)) AS DECIMAL(6,4)) END AS score
  FROM raw
)"""


@query(f"""
WITH {_LINK_SQL}
SELECT batch_id, support_id, primary_id, CAST(score AS DOUBLE) AS score, confidence_limited,
       concat_ws(',', CASE WHEN o THEN 'order_exact' END, CASE WHEN a THEN 'amount_exact' END, CASE WHEN v THEN 'vendor' END,
                 CASE WHEN d THEN 'date_overlap' END, CASE WHEN t THEN 'traveler' END) AS evidence,
       concat_ws(',', CASE WHEN NOT a THEN 'amount_conflict' END, CASE WHEN NOT d THEN 'date_conflict' END,
                 CASE WHEN tc THEN 'traveler_conflict' END) AS conflicts
FROM pairs
""")
def link_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = linkage.candidates(observations(spark, sf_dir), ascii_only=True)
    return pairs.select(
        "batch_id",
        "support_id",
        "primary_id",
        F.col("score").cast("double").alias("score"),
        "confidence_limited",
        F.array_join("evidence", ",").alias("evidence"),
        F.array_join("conflicts", ",").alias("conflicts"),
    )


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations, contending pairs and rejections, settled where several steps read them."""
    pages = settled(observations(spark, sf_dir))
    pairs = settled(linkage.contenders(pages, ascii_only=True))
    return pages, pairs, linkage.rejections(pairs, told=linkage.supports(pages))


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages, pairs, rejected = _linked(spark, sf_dir)
    return pages, settled(linkage.matches(pairs, settled(rejected)))


_REJECT_SQL = """
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY batch_id, support_id ORDER BY score DESC, primary_id) AS k,
         lead(score) OVER (PARTITION BY batch_id, support_id ORDER BY score DESC, primary_id) AS second,
         bool_and(confidence_limited) OVER (PARTITION BY batch_id, support_id) AS all_limited FROM pairs
), by_support AS (
  SELECT batch_id, support_id, CASE WHEN score < 0.65 AND all_limited THEN 'low_observation_confidence'
         WHEN score < 0.65 THEN 'low_confidence_association' WHEN score - second < 0.08 THEN 'ambiguous_association' END AS reason
  FROM ranked WHERE k = 1
), left_over AS (
  SELECT q.* FROM pairs q JOIN by_support b ON q.batch_id = b.batch_id AND q.support_id = b.support_id
  WHERE b.reason IS NULL AND q.score >= 0.65
), top AS (
  SELECT *, max(score) OVER (PARTITION BY batch_id, primary_id) AS best,
         nth_value(score, 2) OVER (PARTITION BY batch_id, primary_id ORDER BY score DESC, support_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM left_over
), rejected AS MATERIALIZED (
  SELECT batch_id, support_id, reason FROM by_support WHERE reason IS NOT NULL
  UNION ALL
  SELECT DISTINCT batch_id, support_id, 'ambiguous_association' FROM top WHERE best - second < 0.08 AND best - score < 0.08
)"""


@query(f"WITH {_LINK_SQL}, {_REJECT_SQL} SELECT * FROM rejected")
def link_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir)[2]


@query(f"""
WITH {_LINK_SQL}, {_REJECT_SQL}
SELECT q.batch_id, q.support_id, q.primary_id, CAST(q.score AS DOUBLE) AS score
FROM pairs q ANTI JOIN rejected r ON r.batch_id = q.batch_id AND r.support_id = q.support_id
WHERE q.score >= 0.65
""")
def link_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pairs, rejected = _linked(spark, sf_dir)
    open_ = linkage.eligible(pairs, rejected)
    return open_.select("batch_id", "support_id", "primary_id", F.col("score").cast("double").alias("score"))


@query()
def link_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _matched(spark, sf_dir)
    return found.select("batch_id", "support_id", "primary_id", F.col("score").cast("double").alias("score"))


@query()
def link_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = linkage.groups(*_matched(spark, sf_dir))
    return grouped.select("batch_id", "id", "rank", "members", F.col("score").cast("double").alias("score"))


@query("""
SELECT batch_id, count(*) AS n_pages, count(*) AS n_placed FROM (
  SELECT CAST(o_custkey AS VARCHAR) AS batch_id FROM orders
  UNION ALL
  SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
) GROUP BY batch_id
""")
def link_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is in exactly one group."""
    grouped = linkage.groups(*_matched(spark, sf_dir))
    members = grouped.select("batch_id", F.explode("members").alias("page_id"))
    counted = members.groupBy("batch_id").agg(F.count_distinct("page_id").alias("n_placed"), F.count("*").alias("n_pages"))
    return counted.select("batch_id", "n_pages", "n_placed")


# --- layout ---------------------------------------------------------------------------------


@query("""
WITH d AS (
  SELECT doc_id, 300.0 + n_chars % 400 AS w, 200.0 + doc_id % 500 AS h, doc_id % 4 AS k, 0.02 + (doc_id % 5) * 0.01 AS th, doc_id % 3 = 0 AS qr FROM documents
), r AS (
  SELECT *, CAST(w / h AS DOUBLE) AS ratio,
         greatest(CASE WHEN k > 0 THEN 2.2 / round((0.3 + th) - 0.3, 10) ELSE 0 END,
                  CASE WHEN qr THEN greatest(25.0 / round(0.8 - 0.4, 10), (25.0 / round(0.8 - 0.3, 10)) / (w / h)) ELSE 0 END) AS boxed,
         least(1.0, 183.0 / (w / 72 * 25.4), 270.0 / (h / 72 * 25.4)) AS fit
  FROM d
), b AS (
  SELECT *, CASE WHEN k > 0 OR qr THEN boxed ELSE h / 72 * 25.4 * fit END AS min_h, CASE WHEN k > 0 OR qr THEN boxed * ratio ELSE w / 72 * 25.4 * fit END AS min_w,
         least(270.0, 183.0 / ratio) AS max_h FROM r
)
SELECT doc_id, CAST(round(min_w, 6) AS DOUBLE) AS min_width, CAST(round(min_h, 6) AS DOUBLE) AS min_height, CAST(round(max_h, 6) AS DOUBLE) AS max_height,
       CASE WHEN min_w > least(183.0, max_h * ratio) + 1e-7 OR min_h > least(270.0, max_h) + 1e-7 THEN 'infeasible' ELSE 'ok' END AS status
FROM b
""")
def size_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    texts = F.when(doc % 4 > 0, F.array(G.box(0.1, 0.3, 0.9, F.lit(0.3) + (F.lit(0.02) + (doc % 5) * 0.01))))
    codes = F.when(doc % 3 == 0, F.array(G.box(0.3, 0.4, 0.8, 0.8)))
    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    items = table(spark, sf_dir, "documents").select(
        "doc_id",
        (300.0 + F.col("n_chars") % 400).alias("width_pt"),
        (200.0 + doc % 500).alias("height_pt"),
        G.box(0, 0, 1, 1).alias("crop"),
        F.coalesce(texts, none).alias("text_boxes"),
        F.coalesce(codes, none).alias("qr_boxes"),
        F.lit(None).cast("double").alias("raster_scale"),
    )
    found = layout.size_bounds(items, SETTINGS)
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in ("min_width", "min_height", "max_height")], "status")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    ratio = 1.0 + (F.col("doc_id") % 3) * 0.5
    height = 20.0 + F.col("n_chars") % 61
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("batch_id"),
        F.floor((F.row_number().over(w) - 1) / 5).alias("group_seq"),
        F.pmod(F.row_number().over(w) - 1, F.lit(5)).alias("item_seq"),
        F.col("doc_id").alias("page_id"),
        height.alias("min_height"),
        (height * ratio).alias("min_width"),
        (F.least(height * 1.5, F.lit(270.0), 183.0 / ratio) * ratio).alias("max_width"),
        ratio.alias("ratio"),
    )


_PACK_SQL = """
i AS (
  SELECT source AS batch_id, doc_id AS page_id, 20.0 + n_chars % 61 AS h, 1.0 + (doc_id % 3) * 0.5 AS ratio,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents
), g AS (
  SELECT *, (rn - 1) // 5 AS grp, (rn - 1) % 5 = 0 AS first, rn = max(rn) OVER (PARTITION BY batch_id, (rn - 1) // 5) AS last,
         sum(h) OVER (PARTITION BY batch_id, (rn - 1) // 5) + 8 * (count(*) OVER (PARTITION BY batch_id, (rn - 1) // 5) - 1) AS total FROM i
), o AS (SELECT *, total > 270 + 1e-7 AS over_full FROM g), packed AS (
  SELECT batch_id, page_id, rn, 0 AS output_page, CAST(h AS DOUBLE) AS used, over_full AND last AS closed FROM o WHERE rn = 1
  UNION ALL
  SELECT o.batch_id, o.page_id, o.rn,
         CASE WHEN stay THEN p.output_page ELSE p.output_page + 1 END, CAST(CASE WHEN stay THEN p.used + 8 + o.h ELSE o.h END AS DOUBLE), o.over_full AND o.last
  FROM packed p JOIN o ON o.batch_id = p.batch_id AND o.rn = p.rn + 1,
  LATERAL (SELECT CASE WHEN NOT o.over_full AND o.first THEN NOT p.closed AND p.used + 8 + o.total <= 270 + 1e-7
                       WHEN NOT o.over_full THEN true WHEN o.first THEN false ELSE p.used + 8 + o.h <= 270 + 1e-7 END AS stay) x
)"""


@query(f"WITH RECURSIVE {_PACK_SQL} SELECT batch_id, page_id, CAST(output_page AS INTEGER) AS output_page FROM packed")
def pack_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.pack(_items(spark, sf_dir), SETTINGS).select("batch_id", "page_id", "output_page")


@query(f"""
WITH RECURSIVE {_PACK_SQL}, full_items AS (
  SELECT p.batch_id, p.output_page, p.page_id, p.rn, CAST(i.h * i.ratio AS DOUBLE) AS mw, CAST(i.ratio AS DOUBLE) AS ratio,
         CAST(least(i.h * 1.5, 270.0, 183.0 / i.ratio) * i.ratio AS DOUBLE) AS xw
  FROM packed p JOIN i ON p.page_id = i.page_id AND p.batch_id = i.batch_id
), pages_of AS (
  SELECT batch_id, output_page, list({{'mw': mw, 'xw': xw, 'ratio': ratio}} ORDER BY rn) AS items, 270.0 - 8.0 * (count(*) - 1) AS room
  FROM full_items GROUP BY batch_id, output_page
), target AS (
  SELECT batch_id, output_page, room,
         list_reduce(list_transform(range(64), lambda k: {{'lo': CAST(0 AS DOUBLE), 'hi': CAST(0 AS DOUBLE)}}),
           lambda s, k: CASE WHEN list_sum(list_transform(items, lambda t: greatest(t.mw, least((s.lo + s.hi) / 2, t.xw, 183.0)) / t.ratio)) <= room
                             THEN {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2}} END,
           {{'lo': CAST(0 AS DOUBLE), 'hi': CAST(183 AS DOUBLE)}}).lo AS w
  FROM pages_of
), sized AS (
  SELECT f.batch_id, f.output_page, f.page_id, f.rn, greatest(f.mw, least(t.w, f.xw, 183.0)) AS width, greatest(f.mw, least(t.w, f.xw, 183.0)) / f.ratio AS height
  FROM full_items f JOIN target t ON f.batch_id = t.batch_id AND f.output_page = t.output_page
)
SELECT batch_id, CAST(output_page AS INTEGER) AS output_page, page_id, round((210 - width) / 2, 6) AS x,
       round(13.5 + (270 - (sum(height + 8) OVER (PARTITION BY batch_id, output_page) - 8)) / 2
             + coalesce(sum(height + 8) OVER (PARTITION BY batch_id, output_page ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS y,
       round(width, 6) AS width, round(height, 6) AS height
FROM sized
""")
def place_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    packed = layout.pack(items, SETTINGS).join(items.select("batch_id", "page_id", "min_width", "max_width", "ratio"), ["batch_id", "page_id"])
    placed = layout.place(packed, SETTINGS)
    return placed.select("batch_id", "output_page", "page_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


@query("""
SELECT l_orderkey, l_linenumber, CAST(round(0.5 * 2.834645669291339, 9) AS DOUBLE) AS scale_half,
       CASE WHEN l_quantity % 4 IN (1, 3) THEN l_tax ELSE l_quantity END AS shown_width,
       CAST(round_even(l_quantity / 25.4 * 300, 0) AS INTEGER) AS pixels
FROM lineitem WHERE l_linenumber = 1
""")
def page_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    w, _ = G.displayed(F.col("l_quantity"), F.col("l_tax"), (F.col("l_quantity") % 4 * 90).cast("int"))
    scale = G.page_transform(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(50.0), F.lit(0.0), F.lit(0.0), F.lit(200.0))["scale"]
    return lines.select(
        "l_orderkey", "l_linenumber", F.round(scale, 9).alias("scale_half"), w.alias("shown_width"), G.expected_pixels(F.col("l_quantity"), 300).alias("pixels")
    )


# --- checks and the gate --------------------------------------------------------------------


def _rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").alias("id"),
        (F.col("l_discount") * 1500).alias("x"),
        (F.col("l_quantity") * 5).alias("y"),
        F.lit(60.0).alias("w"),
        F.lit(40.0).alias("h"),
    )


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber AS id, l_discount * 1500 AS x, l_quantity * 5 AS y FROM lineitem)
SELECT a.l_orderkey, a.id AS first_id, b.id AS second_id FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.id < b.id
WHERE least(a.x, b.x) + 60 - greatest(a.x, b.x) > 1e-7 AND least(a.y, b.y) + 40 - greatest(a.y, b.y) > 1e-7
""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.overlaps(_rectangles(spark, sf_dir), "l_orderkey")


def _planted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Assets and placements of customers' orders: some left out, doubled, unknown, on page 3 only, or out of bounds."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    asset = orders.select(F.col("o_custkey").cast("string").alias("batch_id"), key.cast("string").alias("page_id"), F.lit(200.0).alias("width_pt"), F.lit(100.0).alias("height_pt"))
    page = F.when(key % 31 == 0, 3).otherwise(0)
    placed = orders.where("o_orderkey % 11 <> 0").select(
        F.col("o_custkey").cast("string").alias("batch_id"),
        F.when(key % 19 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(key.cast("string")).alias("page_id"),
        page.cast("int").alias("output_page"),
        F.when(key % 23 == 0, -1.0).otherwise(10.0).alias("x"),
        (key % 7 * 45.0).alias("y"),
        F.when(key % 13 == 0, 90.0).otherwise(80.0).alias("width"),
        F.lit(40.0).alias("height"),
        G.box(0, 0, 1, 1).alias("crop"),
    )
    return asset, placed.unionByName(placed.where("page_id LIKE '%5'").withColumn("output_page", F.col("output_page") + 1))


_PLANTED_SQL = """
assets AS (SELECT CAST(o_custkey AS VARCHAR) AS b, CAST(o_orderkey AS VARCHAR) AS id FROM orders),
once AS (
  SELECT CAST(o_custkey AS VARCHAR) AS b, CASE WHEN o_orderkey % 19 = 0 THEN 'x' ELSE '' END || o_orderkey AS id,
         CASE WHEN o_orderkey % 31 = 0 THEN 3 ELSE 0 END AS pg, CASE WHEN o_orderkey % 23 = 0 THEN -1.0 ELSE 10.0 END AS x,
         (o_orderkey % 7) * 45.0 AS y, CASE WHEN o_orderkey % 13 = 0 THEN 90.0 ELSE 80.0 END AS w
  FROM orders WHERE o_orderkey % 11 <> 0
), placed AS (SELECT *, 1 AS copy FROM once UNION ALL SELECT * REPLACE (pg + 1 AS pg), 2 FROM once WHERE id LIKE '%5'),
known AS (SELECT p.* FROM placed p JOIN assets a ON p.b = a.b AND p.id = a.id),
found AS (
  SELECT b, 'placement_duplicate' AS code, id AS ids, pg + 1 AS page FROM placed WHERE copy = 2
  UNION ALL SELECT b, 'placement_unknown_asset', id, pg + 1 FROM placed p WHERE NOT EXISTS (SELECT 1 FROM assets a WHERE a.b = p.b AND a.id = p.id)
  UNION ALL SELECT b, 'placement_invalid', id, pg + 1 FROM known WHERE x < 0
  UNION ALL SELECT b, 'placement_clipped', id, pg + 1 FROM known WHERE x >= 0 AND (x + w > 210 + 1e-7 OR y + 40 > 297 + 1e-7)
  UNION ALL SELECT b, 'placement_aspect_mismatch', id, pg + 1 FROM known WHERE x >= 0 AND abs(w / 40 - 2) > 2e-7
  UNION ALL SELECT m.b, 'placement_overlap', m.id || ',' || n.id, m.pg + 1 FROM known m JOIN known n
            ON m.b = n.b AND m.pg = n.pg AND m.id < n.id WHERE m.x >= 0 AND n.x >= 0 AND m.y = n.y
  UNION ALL SELECT b, 'placement_missing', id, NULL FROM assets a WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE a.b = p.b AND a.id = p.id)
  UNION ALL SELECT b, 'placement_page_gap', '', NULL FROM placed GROUP BY b HAVING max(pg) + 1 <> count(DISTINCT pg)
)"""


@query(f"WITH {_PLANTED_SQL} SELECT b AS batch_id, code, ids, CAST(coalesce(page, 0) AS INTEGER) AS output_page, count(*) AS n FROM found GROUP BY ALL")
def coverage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    asset, placed = _planted(spark, sf_dir)
    found = integrity.placement_issues(placed, asset)
    return found.groupBy("batch_id", "code", F.array_join("source_page_ids", ",").alias("ids"), F.coalesce("output_page", F.lit(0)).alias("output_page")).agg(F.count("*").alias("n"))


@query(f"""
WITH {_PLANTED_SQL}, all_codes AS (SELECT b, code FROM found UNION ALL SELECT b, 'low_source_resolution' FROM assets)
SELECT b AS batch_id, count(*) AS n_issues, count(*) FILTER (WHERE code <> 'low_source_resolution') AS n_hard,
       count(*) FILTER (WHERE code <> 'low_source_resolution') = 0 AS passed FROM all_codes GROUP BY b
""")
def issue_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    asset, placed = _planted(spark, sf_dir)
    soft = asset.select(*issues.issue(F.col("batch_id"), "low_source_resolution", F.array("page_id")))
    return issues.gate(integrity.placement_issues(placed, asset).unionByName(soft))


@query("""
WITH d AS (SELECT doc_id, 'page ' || doc_id || ' has card 4111 1111 1111 1111' AS message FROM documents)
SELECT doc_id, 'W-' || upper(substr(sha256('{"action":"look","code":"low_source_resolution","message":"' || message || '","output_page":' ||
       CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE CAST(doc_id AS VARCHAR) END || ',"severity":"warning","source_page_ids":["' || doc_id || '"]}'), 1, 10)) AS id,
       'page ' || doc_id || ' has card [REDACTED BANK CARD]' AS problem FROM d
""")
def warning_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    told = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.lit("low_source_resolution").alias("code"),
        F.lit("warning").alias("severity"),
        F.array(doc.cast("string")).alias("source_page_ids"),
        F.when(doc % 2 != 0, doc.cast("int")).alias("output_page"),
        F.concat(F.lit("page "), doc.cast("string"), F.lit(" has card 4111 1111 1111 1111")).alias("message"),
        F.lit("look").alias("action"),
    )
    fields = F.struct("action", "code", "message", "output_page", "severity", "source_page_ids")
    return told.select("doc_id", ids.issue_id(fields).alias("id"), text.redacted(F.col("message")).alias("problem"))


# --- redaction and scanning -----------------------------------------------------------------

_ID_SQL = "(^|[^0-9])[0-9]{17}[0-9Xx]($|[^0-9Xx])"
_CARD_SQL = "(^|[^0-9])(?:[0-9][ -]?){15,18}[0-9]($|[^0-9])"


@query(f"""
WITH a AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '{_ID_SQL}', '\\1[REDACTED PRC ID]\\2', 'g'), '{_ID_SQL}', '\\1[REDACTED PRC ID]\\2', 'g') AS t FROM documents),
b AS (SELECT doc_id, text, regexp_replace(regexp_replace(t, '{_CARD_SQL}', '\\1[REDACTED BANK CARD]\\2', 'g'), '{_CARD_SQL}', '\\1[REDACTED BANK CARD]\\2', 'g') AS t FROM a)
SELECT doc_id, sha256(t) AS redacted_sha256, t <> text AS changed FROM b
""")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("t", text.redacted(F.col("text")))
    return docs.select("doc_id", F.sha2("t", 256).alias("redacted_sha256"), (F.col("t") != F.col("text")).alias("changed"))


#: Planted at the end of texts, by doc_id modulo their number.
FINDINGS = [
    " see C:\\Users\\bob\\x",
    " /home/ann/notes",
    " sk-abcdefghijklmnopqrstuvwx",
    ' "model_response": 1',
    " C:\\Windows\\System32\\a",
    " /var/lib/apt/lists/x",
    " \"gray_report_path\" : 2",
    " D:/data/secret",
    "",
]
_FINDINGS_SQL = "[" + ", ".join("'" + f + "'" for f in FINDINGS) + "]"


@query(f"""
WITH d AS (SELECT doc_id, text || {_FINDINGS_SQL}[CAST(doc_id % 9 AS INTEGER) + 1] AS t FROM documents),
m AS (
  SELECT doc_id, t, list_transform(regexp_extract_all(t, '(?i)(?:^|[^a-z])([a-z]:[\\\\/][^\\r\\n]+)', 1), lambda p: lower(replace(p, '/', '\\'))) AS w,
         list_transform(regexp_extract_all(t, '(?i)(?:^|[^:a-z0-9_.-])(/(?:data|finance|home|private|srv|users|var)/[^\\s`"'']+)', 1), lambda p: lower(p)) AS x FROM d
)
SELECT doc_id, reasons FROM (SELECT doc_id, concat_ws(';',
  CASE WHEN len(list_filter(w, lambda p: NOT (starts_with(p[3:], '\\program files\\') OR starts_with(p[3:], '\\programdata\\') OR starts_with(p[3:], '\\windows\\')))) > 0
       THEN 'absolute Windows path' END,
  CASE WHEN regexp_matches(t, '(?i)(?:[a-z]:[\\\\/](?:users|documents and settings)[\\\\/][^\\\\/\\r\\n]+|/(?:users|home)/[^/\\r\\n]+)') THEN 'user-profile absolute path' END,
  CASE WHEN len(list_filter(x, lambda p: NOT starts_with(p, '/var/lib/apt/lists'))) > 0 THEN 'private absolute POSIX path' END,
  CASE WHEN regexp_matches(t, '(?:sk-[A-Za-z0-9_-]{{20,}}|gh[pousr]_[A-Za-z0-9]{{20,}}|AKIA[0-9A-Z]{{16}})') THEN 'credential-like token' END,
  CASE WHEN regexp_matches(t, '["''](?:model_response|response_body)["'']\\s*:') THEN 'model-response content' END,
  CASE WHEN regexp_matches(t, '["''](?:gray_output_path|gray_report_path)["'']\\s*:') THEN 'gray-test output content' END) AS reasons FROM m)
WHERE reasons <> ''
""")
def content_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = F.get(F.array(*map(F.lit, FINDINGS)), (F.col("doc_id") % 9).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", scanner.content_reasons(F.concat("text", planted)).alias("r"))
    return docs.where(F.size("r") > 0).select("doc_id", F.array_join("r", ";").alias("reasons"))


#: Planted file names, by doc_id modulo their number.
FILES = ["src/a.py", "Gray-Output/x.md", ".env.local", "out/final-report.json", "img/scan.PNG", "tmp_gray_1.py", "docs/readme.md", "Report.json", ".env"]
FILES += [f"x/{d}/a.md" for d in scanner.DIRECTORIES] + [f"x/a{s}" for s in scanner.ARTIFACTS]
FILES += ["a/.environment", "a/reports.json", "my_report.json", "a.pdf/b.txt", "a.tar.xz", "a/TMP_GRAY_2"]
_FILES_SQL = "[" + ", ".join("'" + f + "'" for f in FILES) + "]"


@query(f"""
WITH d AS (SELECT doc_id, {_FILES_SQL}[CAST(doc_id % {len(FILES)} AS INTEGER) + 1] AS path FROM documents),
n AS (SELECT *, string_split(lower(path), '/') AS parts, string_split(lower(path), '/')[-1] AS name FROM d)
SELECT doc_id, path,
  CASE WHEN list_has_any(parts, ['.model-cache', '.private-fixtures', 'gray-output', 'model-responses', 'output-final', 'qa-final']) THEN 'private artifact directory'
       WHEN name = '.env' OR starts_with(name, '.env.') THEN 'environment file'
       WHEN name = 'report.json' OR name LIKE '%-report.json' OR name LIKE '%\\_report.json' ESCAPE '\\' THEN 'private report'
       WHEN regexp_matches(name, '[^.][.](7z|bmp|gif|gz|heic|jpe?g|ofd|pdf|png|rar|tar|tgz|tiff?|webp|zip)$') THEN 'financial, archive, or preview artifact'
       WHEN starts_with(name, 'tmp_gray_') THEN 'one-off gray-test helper' END AS reason FROM n
""")
def path_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.get(F.array(*map(F.lit, FILES)), (F.col("doc_id") % len(FILES)).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", named.alias("path"))
    return docs.withColumn("reason", scanner.path_reason(F.col("path")))


@query("""
SELECT event_id, '{"[REDACTED KEY]":"[REDACTED]","k":' || json_extract_string(props, '$.k') || ',"path":"' || event_type || '.pdf"}' AS report FROM events
""")
def sanitised_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(
        F.lit('{"path": "/data/in/'),
        F.col("event_type"),
        F.lit('.pdf", "api_key": "abc", "k": '),
        F.get_json_object("props", "$.k"),
        F.lit("}"),
    )
    return table(spark, sf_dir, "events").select("event_id", report.sanitised_json(body).alias("report"))


# --- pixels and evaluation ------------------------------------------------------------------


@query("""
WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT vec_id, median(v) AS med FROM e GROUP BY vec_id)
SELECT e.vec_id, round(any_value(med), 6) AS median, round(stddev_pop(v), 6) AS deviation, round(max(v) - min(v), 6) AS range,
       round(avg(CASE WHEN abs(v - med) <= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS share
FROM e JOIN m ON e.vec_id = m.vec_id GROUP BY e.vec_id
""")
def region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.col("embedding").cast("array<double>")).alias("value"))
    found = crop.region_stats(pixels, "vec_id", distance=0.5)
    return found.select("vec_id", *[F.round(c, 6).alias(c) for c in ("median", "deviation", "range", "share")])


@query("""
WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
d AS (SELECT a.vec_id, a.x, abs(a.v - b.v) * 100 AS diff FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND a.x = b.x),
t AS (SELECT vec_id, x // 8 AS tx, sum(diff) AS s, count(*) AS n, avg(diff) AS m, avg(CASE WHEN diff >= 32 THEN 1.0 ELSE 0.0 END) AS p FROM d GROUP BY vec_id, x // 8)
SELECT vec_id, round(sum(s) / sum(n), 6) AS mean_diff, round(max(m), 6) AS local_mean, round(max(p), 6) AS local_strong FROM t GROUP BY vec_id
""")
def tile_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("x", "v"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), "x", F.col("v").alias("u"))
    pixels = e.join(after, ["vec_id", "x"]).select("vec_id", "x", F.lit(0).alias("y"), (F.abs(F.col("v") - F.col("u")) * 100).alias("diff"))
    found = crop.tile_difference(pixels, "vec_id", tile=8)
    return found.select("vec_id", *[F.round(c, 6).alias(c) for c in ("mean_diff", "local_mean", "local_strong")])


@query("""
WITH e AS (SELECT CAST(o_custkey % 10 AS INTEGER) AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) AS i FROM orders),
a0 AS (SELECT CAST(o_custkey % 10 AS INTEGER) AS c, o_orderkey AS k, o_orderkey + CASE WHEN o_orderkey % 20 = 0 THEN 15 ELSE 0 END AS pos FROM orders WHERE o_orderkey % 500 <> 0
       UNION ALL SELECT CAST(o_custkey % 10 AS INTEGER), o_orderkey, 100000000 + o_orderkey FROM orders WHERE o_orderkey % 777 = 0 AND o_orderkey % 500 <> 0),
a AS (SELECT c, k, row_number() OVER (PARTITION BY c ORDER BY pos, k) AS i FROM a0),
acc AS (SELECT coalesce(e.c, a.c) AS c, round(avg(CASE WHEN e.k = a.k THEN 1.0 ELSE 0.0 END), 9) AS order_accuracy FROM e FULL OUTER JOIN a ON e.c = a.c AND e.i = a.i GROUP BY 1),
cov AS (SELECT e.c, count(*) FILTER (WHERE n IS NULL) AS n_omitted, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates
        FROM e LEFT JOIN (SELECT c, k, count(*) AS n FROM a0 GROUP BY c, k) x ON e.c = x.c AND e.k = x.k GROUP BY e.c),
rec AS (SELECT c, round(avg(CASE WHEN f THEN 1.0 ELSE 0.0 END), 9) AS warning_recall FROM (
          SELECT CAST(o_custkey % 10 AS INTEGER) AS c, o_orderpriority, bool_or(o_orderkey % 500 <> 0 AND o_orderpriority <> '1-URGENT') AS f FROM orders GROUP BY 1, 2) GROUP BY c)
SELECT acc.c AS case_id, order_accuracy, n_omitted, CAST(0 AS BIGINT) AS n_unexpected, n_duplicates, warning_recall,
       order_accuracy = 1 AND n_omitted = 0 AND n_duplicates = 0 AND warning_recall = 1 AS release_gate_passed
FROM acc JOIN cov ON acc.c = cov.c JOIN rec ON acc.c = rec.c
""")
def gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).cast("int").alias("case_id"), "o_orderkey", "o_orderpriority")
    key = F.col("o_orderkey")
    actual = orders.where("o_orderkey % 500 <> 0").withColumn("pos", key + F.when(key % 20 == 0, 15).otherwise(0))
    actual = actual.unionByName(actual.where("o_orderkey % 777 = 0").withColumn("pos", 100_000_000 + key))
    e = evaluation.ordinals(orders, "o_orderkey", "o_orderkey")
    a = evaluation.ordinals(actual, "o_orderkey", "pos", "o_orderkey")
    accuracy = evaluation.order_accuracy(e, a).withColumn("order_accuracy", F.round("order_accuracy", 9))
    warned = evaluation.recall(orders, actual.where("o_orderpriority <> '1-URGENT'"), "o_orderpriority", "warning_recall")
    warned = warned.withColumn("warning_recall", F.round("warning_recall", 9))
    return evaluation.gate(accuracy.join(evaluation.coverage(e, a), "case_id").join(warned, "case_id"))


@query("""
WITH px AS MATERIALIZED (
  SELECT doc_id, i % 24 AS x, i // 24 AS y,
         CASE WHEN i % 24 >= doc_id % 5 AND i % 24 < doc_id % 5 + 8 AND i // 24 >= 4 AND i // 24 < 10 THEN 20 WHEN doc_id % 7 = 0 THEN (i * 9) % 200 ELSE 255 END AS v
  FROM documents, range(384) t(i) WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0
), bg AS (SELECT doc_id, trunc(median(v)) AS b FROM px WHERE x IN (0, 23) AND y IN (0, 15) GROUP BY doc_id),
p AS MATERIALIZED (SELECT px.*, abs(v - b) AS far FROM px JOIN bg ON px.doc_id = bg.doc_id),
outer_parts AS (
  SELECT doc_id, r, v, far FROM p, unnest([CASE WHEN x IN (0, 23) AND y IN (0, 15) THEN 'corner' END, CASE WHEN y = 0 THEN 'top' END, CASE WHEN y = 15 THEN 'bottom' END,
                                           CASE WHEN x = 0 THEN 'left' END, CASE WHEN x = 23 THEN 'right' END]) u(r) WHERE r IS NOT NULL
), plain AS (
  SELECT doc_id, r, avg(CASE WHEN far <= 10 THEN 1.0 ELSE 0.0 END) >= 0.98 AND stddev_pop(v) <= 4 AND max(v) - min(v) <= 4 AS fine FROM outer_parts GROUP BY doc_id, r
), c AS (SELECT doc_id, min(x) AS l, max(x) AS r, min(y) AS t, max(y) AS b FROM p WHERE far > 10 GROUP BY doc_id),
f AS (
  SELECT doc_id, least(round((l - 1) / 24, 10), 0.29) AS x0, least(round((t - 1) / 16, 10), 0.29) AS y0, greatest(round((r + 2) / 24, 10), 0.41) AS x1, greatest(round((b + 2) / 16, 10), 0.41) AS y1
  FROM c WHERE l > 1 AND t > 1 AND r < 22 AND b < 14 AND doc_id NOT IN (SELECT doc_id FROM plain WHERE NOT fine)
), removed AS (
  SELECT p.doc_id, u.r, avg(CASE WHEN far <= 10 THEN 1.0 ELSE 0.0 END) >= 0.98 AND stddev_pop(v) <= 4 AND max(v) - min(v) <= 4 AS fine
  FROM p JOIN f ON p.doc_id = f.doc_id, unnest([CASE WHEN x < floor(x0 * 24 + 1e-9) THEN 'left' END, CASE WHEN x >= ceil(x1 * 24 - 1e-9) THEN 'right' END,
                                               CASE WHEN y < floor(y0 * 16 + 1e-9) THEN 'top' END, CASE WHEN y >= ceil(y1 * 16 - 1e-9) THEN 'bottom' END]) u(r)
  WHERE u.r IS NOT NULL GROUP BY p.doc_id, u.r
), good AS (SELECT * FROM f WHERE doc_id NOT IN (SELECT doc_id FROM removed WHERE NOT fine))
SELECT d.source AS batch_id, CAST(d.doc_id AS VARCHAR) AS page_id, CAST(coalesce(x0, 0) AS DOUBLE) AS x0, CAST(coalesce(y0, 0) AS DOUBLE) AS y0,
       CAST(coalesce(x1, 1) AS DOUBLE) AS x1, CAST(coalesce(y1, 1) AS DOUBLE) AS y1,
       CASE WHEN d.doc_id % 11 = 0 THEN 'crop_physical_ticket_photo' WHEN d.doc_id % 13 = 0 THEN 'crop_low_observation_confidence' WHEN g.doc_id IS NULL THEN 'crop_uncertain' END AS code
FROM documents d LEFT JOIN good g ON d.doc_id = g.doc_id
""")
def crop_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic previews of 24 x 16 pixels: a dark rectangle on white, on a gradient, or at the border."""
    doc = F.col("doc_id")
    x, y = F.lit(24), F.lit(16)
    left = (doc % 5).cast("int")
    dark = lambda i: ((i % x) >= left) & ((i % x) < left + 8) & (F.floor(i / x) >= 4) & (F.floor(i / x) < 10)
    even = lambda i: F.when(doc % 7 == 0, F.pmod(i * 9, F.lit(200))).otherwise(255)
    grey = F.transform(F.sequence(F.lit(0), x * y - 1), lambda i: F.lpad(F.hex(F.when(dark(i), 20).otherwise(even(i))), 2, "0"))
    pixels = F.unhex(F.array_join(F.transform(grey, lambda g: F.concat(g, g, g)), ""))
    pages = table(spark, sf_dir, "documents").select(
        F.col("source").alias("batch_id"),
        doc.cast("string").alias("page_id"),
        F.when(doc % 11 == 0, "physical_ticket_photo").otherwise("unknown").alias("document_type"),
        F.when(doc % 13 == 0, 0.3).otherwise(0.9).alias("confidence"),
        F.array(G.box(0.3, 0.3, 0.4, 0.4)).alias("boxes"),
        pixels.alias("pixels"),
        x.alias("pixel_width"),
        y.alias("pixel_height"),
    )
    found = crop.choose_crops(pages)
    return found.select("batch_id", "page_id", "crop.x0", "crop.y0", "crop.x1", "crop.y1", "code")


@query()
def run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run over observations of orders: the verdict for each customer."""
    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    size = F.pmod(F.crc32("page_id"), F.lit(300)).cast("double")
    pages = observations(spark, sf_dir).select(
        "*",
        (200.0 + size).alias("width_pt"),
        F.lit(150.0).alias("height_pt"),
        G.box(0, 0, 1, 1).alias("crop"),
        none.alias("text_boxes"),
        none.alias("qr_boxes"),
        F.lit(None).cast("double").alias("raster_scale"),
    )
    return runs.run(pages, SETTINGS, ascii_only=True).verdict
