"""License notices by phrases and by an exact set-similarity join, in DataFrame functions only.

A block is a window of consecutive words, over line ends too, taken as the set of
its words. It meets a template if it holds at least the threshold's share of the
template's words; so that the template makes up as much of it, it has no more words
than the template's length by the threshold. The join finds every such block: words
are ordered by global frequency, rarest first; a template of n words of which o must
be found shares one of its first n - o + 1 words with every block that meets it
(prefix), such a block has o words (length), and o of the words around the shared
one come no earlier in the order (position). What passes is verified, window by window.

Only words of templates can be common, so texts are cut down to the places of these;
templates and their words are parameters, which bounds all that is broadcast or
sent to the driver. Each text is read once: its counts, the template words that it
holds and, where those could meet a template, their places are settled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, id_key, let, row_key, settled, whole

WORD_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
THRESHOLD = 0.9
#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices as words, and their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license apache"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial license"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
]


def words_of(text: Column) -> Column:
    """Runs of digits, letters and all characters beyond ASCII, A-Z in lower case."""
    return F.array_remove(F.split(ascii_lower(text), WORD_BREAK), "")


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def needed_words(notice: str, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * len(set(notice.split())), 9)))


def block_words(notice: str, threshold: float) -> int:
    """The most words of a block for a template: more, and the template is less than the threshold's share of it."""
    return math.floor(round(len(notice.split()) / threshold, 9))


def frequencies(read: DataFrame) -> dict[str, int]:
    """The number of documents that hold each word of the templates; over all documents."""
    present = read.select(F.explode("held").alias("word"))
    return {r.word: r.n for r in present.groupBy("word").agg(F.count("*").alias("n")).collect()}


def prefix_table(templates: list[tuple[str, str]], order: dict[str, int], threshold: float) -> list[tuple]:
    """(rank, label, size, needed, words in a block, ranks) for each word of the prefix of each template."""
    rows = []
    for label, notice in templates:
        ranks = sorted(order[w] for w in set(notice.split()))
        needed = needed_words(notice, threshold)
        rows += [(r, label, len(ranks), needed, block_words(notice, threshold), ranks) for r in ranks[: len(ranks) - needed + 1]]
    return rows


def possible_places(words: Column, held: Column, templates: list[tuple[str, str]], threshold: float) -> Column:
    """Places and words of all template words, if the text holds enough of any template anywhere; else null."""
    vocabulary = strings(sorted({w for _, notice in templates for w in notice.split()}))
    enough = F.lit(False)
    for _, notice in templates:
        enough = enough | (F.size(F.array_intersect(held, strings(sorted(set(notice.split()))))) >= needed_words(notice, threshold))
    found = F.transform(words, lambda w, i: F.when(F.array_contains(vocabulary, w), F.struct(i.alias("i"), w.alias("w"))))
    return F.when(enough, F.array_compact(found))


def matches(read: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(id, row, label, containment): the best block for each template word of a prefix that a text holds."""
    counts = frequencies(read)
    vocabulary = {w for _, notice in templates for w in notice.split()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    rows = prefix_table(templates, order, threshold)
    prefixes = read.sparkSession.createDataFrame(rows, "rank int, label string, size int, needed int, most int, ranks array<int>")
    rank_of = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    placed = read.where("places IS NOT NULL").select(
        "id", "row", F.transform("places", lambda p: F.struct(p["i"].alias("i"), F.element_at(rank_of, p["w"]).alias("r"))).alias("places")
    )
    starts = F.array(*[F.lit(r) for r in sorted({row[0] for row in rows})])
    reach = max(row[4] for row in rows)
    # Each shared word with the template words near it: at most ``reach`` on either side, one at a place.
    around = F.transform(
        "places",
        lambda p, j: F.when(
            F.array_contains(starts, p["r"]),
            F.struct(p["i"].alias("i"), p["r"].alias("rank"), F.slice("places", F.greatest(j - reach + 2, F.lit(1)), F.lit(2 * reach)).alias("near")),
        ),
    )
    shared = placed.select("id", "row", F.explode(F.array_compact(around)).alias("s")).select("id", "row", "s.i", "s.rank", "s.near")
    found = shared.join(F.broadcast(prefixes), "rank")
    common = F.filter("near", lambda p: F.array_contains(F.col("ranks"), p["r"]) & (F.abs(p["i"] - F.col("i")) < F.col("most")))
    found = found.select("id", "row", "label", "size", "needed", "most", "i", "rank", common.alias("common"))
    # Length, and position: the first common word of a block has all others behind it in the order.
    behind = F.array_distinct(F.transform(F.filter("common", lambda p: p["r"] >= F.col("rank")), lambda p: p["r"]))
    found = found.where(F.size(behind) >= F.col("needed"))
    # A block is best begun at a common word; those that hold the shared one.
    begun = F.filter("common", lambda p: p["i"] <= F.col("i"))
    held = F.transform(
        begun,
        lambda b: F.size(F.array_distinct(F.transform(F.filter("common", lambda p: p["i"].between(b["i"], b["i"] + F.col("most") - 1)), lambda p: p["r"]))),
    )
    verified = found.select("id", "row", "label", "size", "needed", F.array_max(held).alias("n")).where("n >= needed")
    return verified.select("id", "row", "label", (F.col("n") / F.col("size")).alias("containment"))


def phrase_places(words: Column, phrases: dict[str, str]) -> Column:
    """For each phrase, in order, the places where its words stand consecutively."""

    def places(phrase: str) -> Column:
        parts = phrase.split()
        at = F.sequence(F.lit(0), F.size(words) - 1)
        whole_phrase = lambda i: _all([F.get(words, i + k) == F.lit(p) for k, p in enumerate(parts)])
        there = _all([F.array_contains(words, p) for p in parts])
        return F.when(there, F.filter(at, lambda i: F.coalesce(whole_phrase(i), F.lit(False)))).otherwise(F.array().cast("array<int>"))

    return F.array(*[places(p) for p in phrases]).cast("array<array<int>>")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of ``docs``.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case.
    The base: all places where a phrase's words stand consecutively, over line
    ends too; first_word and last_word are the smallest and largest start of a
    place, words counted from 0, null without one. ``labels`` adds those of
    templates that a block of the text meets (see the module). ``score`` is the best
    containment of such a block, 1 with a phrase, 0 with neither. Labels are
    distinct, sorted and comma-joined; none: empty. Null and empty texts have no
    words. Equal rows stay separate rows, doc_id may be null, an empty table stays
    empty; other columns are not read.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    vocabulary = strings(sorted({w for _, notice in templates for w in notice.split()}))

    def read_words(w: Column) -> Column:
        held = F.array_intersect(w, vocabulary)
        places = let(held, lambda h: F.struct(h.alias("held"), possible_places(w, h, templates, threshold).alias("places")))
        return F.struct(F.size(w).cast("long").alias("n_words"), phrase_places(w, phrases).alias("at"), places.alias("t"))

    text = F.col("text")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(text).alias("row"), let(words_of(whole(text)), read_words).alias("p"))
    everywhere = F.flatten("p.at")
    labelled = [F.when(F.size(F.col("p.at")[i]) > 0, label) for i, label in enumerate(phrases.values())]
    read = settled(
        read.select(
            "doc_id",
            id_key(F.col("doc_id")).alias("id"),
            "row",
            F.col("p.n_words").alias("n_words"),
            F.size(everywhere).cast("long").alias("n_base"),
            F.array_min(everywhere).cast("long").alias("first_word"),
            F.array_max(everywhere).cast("long").alias("last_word"),
            F.array_compact(F.array(*labelled, F.lit(None).cast("string"))).alias("base"),
            F.col("p.t.held").alias("held"),
            F.col("p.t.places").alias("places"),
        )
    )
    if templates:
        met = matches(read, templates, threshold).groupBy("id", "row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
        joined = read.join(met, ["id", "row"], "left")
    else:
        joined = read.select("*", F.lit(None).cast("array<string>").alias("more"), F.lit(None).cast("double").alias("best"))
    joined_labels = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined_labels(F.col("base")).alias("base_labels"),
        joined_labels(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
