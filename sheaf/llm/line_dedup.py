"""Lines that many documents share stay in one of them.

Lines are exploded, keyed by two independent 64-bit hashes of their normalised
form, counted by distinct documents, and dropped from all documents but the
smallest id; every text is put together again from the positions that stay.
Only hashes, ids and positions are shuffled until that last step, which moves
each text once. A key that holds a large share of all lines is pre-aggregated
by document, and is looked up through a broadcast table with a proven bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, id_key, let, row_key, settled, whole

#: Keys that hold a 1 / HEAVY_SHARE part or more of all (shared key, document) pairs are
#: looked up by broadcast: there are at most HEAVY_SHARE of them, of 32 bytes each.
HEAVY_SHARE = 4096


def _keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, row, pos, k1, k2) of every line whose key is long enough.

    The key is the line without white space at its ends, with A-Z in lower case.
    """
    # What belongs to the whole text is computed before lines are exploded, else it would be for each of them.
    texts = docs.select(id_key(F.col("doc_id")).alias("id"), row_key(F.col("text")).alias("row"), ascii_lower(whole(F.col("text"))).alias("text"))
    lines = texts.select("id", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("id", "row", "pos", F.trim(F.col("line"), F.lit(BLANKS)).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select(
        "id", "row", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(7), "key").alias("k2")
    )


def repeated_lines(lines: DataFrame, min_docs: int = 2) -> DataFrame:
    """(k1, k2, keeper, n_docs) of the keys of ``lines`` found in ``min_docs`` documents; settled."""
    by_document = lines.groupBy("k1", "k2", "id").agg(F.lit(1).alias("one"))
    found = by_document.groupBy("k1", "k2").agg(F.min("id").alias("keeper"), F.count("one").alias("n_docs"))
    return settled(found.where(F.col("n_docs") >= min_docs))


def dropped_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(id, row, drops): sorted positions of the lines that each document loses."""
    lines = settled(_keyed_lines(docs, min_chars))  # each line is hashed once
    shared = repeated_lines(lines, min_docs)
    pairs = shared.agg(F.sum("n_docs")).first()[0] or 0
    least = max(1, -(-pairs // HEAVY_SHARE))
    heavy = shared.where(F.col("n_docs") >= least).select(
        F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.col("keeper").alias("h_keeper")
    )
    light = shared.where(F.col("n_docs") < least).select("k1", "k2", "keeper")
    marked = lines.join(F.broadcast(heavy), (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
    of_heavy = marked.where(F.col("h_keeper") < F.col("id")).select("id", "row", "pos")
    rest = marked.where(F.col("h_keeper").isNull()).select("id", "row", "pos", "k1", "k2")
    of_light = rest.join(light, ["k1", "k2"]).where(F.col("keeper") < F.col("id")).select("id", "row", "pos")
    return of_heavy.unionByName(of_light).groupBy("id", "row").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def _kept(lines: Column, drops: Column) -> Column:
    """The lines between the dropped positions, in time linear in both arrays."""
    ends = F.concat(drops, F.array(F.size(lines)))
    parts = F.transform(
        ends,
        lambda end, i: F.slice(
            lines,
            F.when(i > 0, drops[i - 1] + 2).otherwise(F.lit(1)),
            end - F.when(i > 0, drops[i - 1] + 1).otherwise(F.lit(0)),
        ),
    )
    return F.array_join(F.flatten(parts), "\n")


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with ``text`` replaced, and n_lines, n_dropped (long).

    The key of a line is the line without ``[\\x20\\x09-\\x0D]`` at its ends, with
    A-Z in lower case. Keys of ``min_chars`` code points or more that are found in
    ``min_docs`` documents or more lose all their lines but those in the smallest
    doc_id; within that document repeats stay. Null and empty texts are one empty
    line. Rows that share a doc_id are one document for the count, and each of
    them is returned; a null doc_id counts as the largest. Documents that lose
    all lines keep an empty text. Other columns pass through.
    """
    drops = dropped_lines(docs, min_chars, min_docs).select(
        F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("drops").alias("__drops")
    )
    keyed = docs.select(
        id_key(F.col("doc_id")).alias("__id"), row_key(F.col("text")).alias("__row"), F.struct("*").alias("__doc")
    )
    joined = keyed.join(drops, ["__id", "__row"], "left")
    text = F.col("__doc.text")
    split = F.split(whole(text), "\n")
    return joined.select(
        *[F.col(f"__doc.`{c}`").alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped")],
        F.when(F.col("__drops").isNull(), whole(text))
        .otherwise(let(split, lambda lines: _kept(lines, F.col("__drops"))))
        .alias("text"),
        (F.char_length(whole(text)) - F.char_length(F.replace(whole(text), F.lit("\n"), F.lit(""))) + 1)
        .cast("long")
        .alias("n_lines"),
        F.when(F.col("__drops").isNull(), 0).otherwise(F.size("__drops")).cast("long").alias("n_dropped"),
    )
