"""Quality rules whose cutoffs come with a guarantee on good documents, in DataFrame functions only.

Each rule rejects texts with too much of something. Labelled documents are dealt in
two halves by their id. The bad ones of the first half propose cutoffs in every
stratum (language): those that reject a given share of them, loosest first. The
good ones of the second half certify them: a cutoff holds if an exact binomial test
rules out, at the corrected level, that it rejects more than the allowed share
of good documents. Levels are shared out over strata and rules (Bonferroni);
within a rule the first failure ends the sequence, whose order doesn't depend on
the half that tests it, so no further correction is due. Where nothing is certified
a rule rejects nothing.

Figures are measured once for each document and settled. Cutoffs and counts come
from histograms of them over all labels, in bins of a thousandth of the logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, let, settled, whole

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Shares of good documents that all rules together may reject, and the chance that the guarantee fails.
FALSE_REJECTION = 0.1
ERROR = 0.1
#: So many good labelled documents or fewer certify no cutoff at any level.
TOO_FEW = 100
#: Figures that are too large in texts to reject.
RULES = ("symbol_share", "upper_share", "mark_rate", "dup_line_share", "repeat_share", "mean_word")
#: Shares of the bad documents that proposed cutoffs reject. The least is some times what a
#: rule may reject of the good ones, so that a rule which can't tell them apart fails at once.
SHARES = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
#: Cutoffs of more strata than this aren't broadcast.
BROADCAST_STRATA = 100_000


def bin_of(figure: Column) -> Column:
    """The number of a figure's bin; all that a rule compares."""
    return F.floor(F.log1p(figure) * 1000).cast("int")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(whole(text), "[\\x20\\x09-\\x0D]+"), "")


def _chars_in_words(text: Column) -> Column:
    out = whole(text)
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return F.char_length(out)


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more, by sorting (hash, place)."""

    def in_order(pairs: Column) -> Column:
        twice = F.transform(
            pairs,
            lambda p, k: F.when(
                (p["h"] == F.get(pairs, k + 1)["h"]) | ((k > 0) & (p["h"] == F.get(pairs, F.greatest(k - 1, F.lit(0)))["h"])), p["i"]
            ),
        )
        return let(F.sort_array(F.array_compact(twice)), total)

    def total(places: Column) -> Column:
        new = F.transform(places, lambda p, k: F.coalesce(F.least(F.get(places, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(new, F.lit(0), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, in_order))


def repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in the text, the first occurrence included."""
    n = F.size(words) - (WINDOW - 1)
    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(n < 2, 0).otherwise(let(hashes, _covered))


def measures(docs: DataFrame, *carried: Column) -> DataFrame:
    """The carried columns, the counts of each text, and the figure of each rule."""
    text = whole(F.col("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    counted = docs.select(
        *carried,
        let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"))).alias("__w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("__l"),
        _chars_in_words(F.col("text")).alias("__c"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).alias("__s"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("__u"),
        F.regexp_count(text, F.lit("[!?]")).alias("__m"),
    )
    names = counted.columns[: len(carried)]

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return counted.select(
        *names,
        F.col("__w.n").cast("long").alias("n_words"),
        F.col("__c").cast("long").alias("word_chars"),
        F.col("__s").cast("long").alias("n_symbols"),
        F.col("__l.d").cast("long").alias("n_dup_lines"),
        F.col("__w.r").cast("long").alias("n_repeat_words"),
        share("__s", "__c").alias("symbol_share"),
        share("__u", "__c").alias("upper_share"),
        share("__m", "__w.n").alias("mark_rate"),
        share("__l.d", "__l.n").alias("dup_line_share"),
        share("__w.r", "__w.n").alias("repeat_share"),
        share("__c", "__w.n").alias("mean_word"),
    )


def tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of the binomial distribution, summed term by term; 1 where k is above the mean."""
    start = F.struct((n * F.log1p(F.lit(-p))).alias("t"), F.lit(0.0).alias("s"))
    odds = F.lit(p / (1 - p))
    summed = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        start,
        lambda a, i: F.struct((a["t"] + F.log((n - i).cast("double") / (i + 1) * odds)).alias("t"), (a["s"] + F.exp(a["t"])).alias("s")),
        lambda a: a["s"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(summed)


def cutoffs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, n_good, <rule>...): the bin over which each rule rejects, null where no cutoff is certified.

    Calibrates on all labelled documents that pass the base rules; a document with
    several labels counts as its lowest. ``n_good`` are those that certify. Strata of
    ``TOO_FEW`` of them or fewer certify nothing and aren't tested; strata without a
    certified cutoff have no row.
    """
    return _certified(measures(docs, F.col("doc_id").cast("long").alias("of_id"), stratum(F.col("lang")).alias("stratum")), labels)


def _certified(figures: DataFrame, labels: DataFrame) -> DataFrame:
    """``cutoffs`` from measured figures with of_id and stratum."""
    marked = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("of_id"))
        .agg(F.min("quality").alias("good"))
    )
    bins = F.array(*[F.struct(F.lit(rule).alias("rule"), bin_of(F.col(rule)).alias("bin")) for rule in RULES])
    proposes = F.pmod(F.xxhash64("of_id", F.lit(3)), F.lit(2)) == 0
    found = figures.where(~base_failed()).join(marked, "of_id").select("stratum", "good", proposes.alias("proposes"), F.explode(bins).alias("b"))
    counted = found.groupBy("stratum", "b.rule", "b.bin").agg(
        F.count_if((F.col("good") == 0) & F.col("proposes")).alias("bad"), F.count_if((F.col("good") == 1) & ~F.col("proposes")).alias("good")
    )
    in_rule = Window.partitionBy("stratum", "rule")
    above = in_rule.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    summed = counted.select(
        "stratum",
        "rule",
        "bin",
        F.coalesce(F.sum("bad").over(above), F.lit(0)).alias("bad_above"),
        F.coalesce(F.sum("good").over(above), F.lit(0)).alias("good_above"),
        F.sum("bad").over(in_rule).alias("n_bad"),
        F.sum("good").over(in_rule).alias("n_good"),
    )
    summed = settled(summed.where((F.col("n_good") > TOO_FEW) & (F.col("n_bad") > 0)))
    strata = summed.select("stratum").distinct().count()
    level = ERROR / len(RULES) / max(1, strata)
    # The loosest cutoff for each share: the largest bin over which that share of the bad ones lies.
    proposed = summed.withColumn("share", F.explode(F.array(*map(F.lit, SHARES)))).where(F.col("bad_above") >= F.col("share") * F.col("n_bad"))
    loosest = F.max_by(F.struct("bin", "good_above"), "bin").alias("c")
    proposed = proposed.groupBy("stratum", "rule", "n_good", "share").agg(loosest)
    passed = tail(F.col("c.good_above"), F.col("n_good"), FALSE_REJECTION / len(RULES)) <= level
    tested = proposed.select("stratum", "rule", "n_good", "share", F.col("c.bin").alias("bin"), passed.alias("passed"))
    run = F.min(F.col("passed").cast("int")).over(Window.partitionBy("stratum", "rule").orderBy("share"))
    held = tested.withColumn("run", run).where("run = 1")
    table = held.groupBy("stratum").agg(F.max("n_good").alias("n_good"), *[F.min(F.when(F.col("rule") == r, F.col("bin"))).alias(r) for r in RULES])
    return settled(table)


def stratum(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit(""))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, *carried: Column) -> DataFrame:
    """The carried columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Words are ``[^\\x20\\x09-\\x0D]+``. A text fails the base rules with fewer than 20
    words, or if over 30 % of its words stand in 8-word windows that occur twice or
    more in it; null and empty texts have no words and fail. Of the rest, ``kept``
    is false where a rule's figure is over the cutoff that ``cutoffs`` certifies
    for the document's stratum, its ``lang`` (null: a stratum of its own). Without
    labels, or with too few, only the base rules reject. Equal rows stay separate,
    an empty table stays empty; ``carried`` columns can have any name but those above.
    """
    figures = settled(measures(docs, *carried, F.col("doc_id").cast("long").alias("__of_id"), stratum(F.col("lang")).alias("__in")))
    limits = _certified(figures.select(F.col("__of_id").alias("of_id"), F.col("__in").alias("stratum"), "n_words", "n_repeat_words", *RULES), labels)
    limits = limits.select(F.col("stratum").alias("__stratum"), *[F.col(r).alias(f"__{r}") for r in RULES])
    small = limits.count() <= BROADCAST_STRATA
    found = figures.join(F.broadcast(limits) if small else limits, F.col("__in") == F.col("__stratum"), "left")
    over = F.lit(False)
    for rule in RULES:
        over = over | F.coalesce(bin_of(F.col(rule)) > F.col(f"__{rule}"), F.lit(False))
    names = [c for c in found.columns if c not in RULES and not c.startswith("__")]
    return found.select(*names, base_failed().alias("base_failed"), (~base_failed() & ~over).alias("kept"))
