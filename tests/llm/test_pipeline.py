"""The stages on their own inputs, and the whole pipeline."""

import itertools
import random
import re
import string

import corpus_pipeline
import duckdb

from sheaf.llm import bpe, common, decontaminate, line_dedup, quality_rules, queries, set_links, simhash

SF = "/root/testdata/sf0.001"


def smallest_of_groups(texts):
    """All pairs of documents (id: text): five-word sets of similarity 0.8, or fingerprints within three bits."""
    ids = sorted(texts)
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (texts[i] or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))) for i in ids}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    fps = {i: simhash.fingerprint(texts[i], 5) for i in ids}
    group = {i: i for i in ids}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(ids, 2):
        both = len(sets[i] & sets[j])
        if both * 10 >= 8 * (len(sets[i]) + len(sets[j]) - both) or ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 3:
            a, b = sorted((top(i), top(j)))
            group[b] = a
    return {top(i) for i in ids}


def test_near_dedup_links_all_pairs_of_similarity(spark, monkeypatch):
    draw = random.Random(4)
    prose = lambda n: [f"w{draw.getrandbits(16)}" for _ in range(n)]
    passage, texts = prose(60), []
    for k in range(12):
        base = prose(draw.choice([6, 20, 80, 300, 1200]))
        if k % 2:
            base[3:3] = passage
        texts.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            for _ in range(draw.randrange(0, 1 + len(copy) // 25)):
                copy[draw.randrange(len(copy))] = "new" + str(draw.random())
            texts.append(" ".join(copy + prose(draw.choice([0, 0, len(copy) // 5]))).upper())
    texts += ["", None, " \n", "one two", "One  two", "one two three", "a b c d e", "a b c d e a b c d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = smallest_of_groups(dict(enumerate(texts)))
    assert 15 < len(want) < len(texts) - 30
    assert {r.doc_id for r in set_links.keep_one(docs).collect()} == want
    for sets, keys in ((2, 10), (2, 65536)):
        monkeypatch.setattr(set_links, "HOT_SETS", sets)
        monkeypatch.setattr(set_links, "HOT_KEYS", keys)
        assert {r.doc_id for r in set_links.keep_one(docs).collect()} == want
    assert set_links.keep_one(docs.limit(0)).collect() == []


def test_near_dedup_sends_no_exploded_table_to_the_driver(spark, broadcasts):
    draw = random.Random(7)
    texts = [" ".join(f"w{draw.getrandbits(16)}" for _ in range(150)) for _ in range(250)]
    texts += [t.replace("w", "v", draw.randrange(4)) for t in texts[:150]]
    docs = common.settled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    with broadcasts("160k") as sent:
        kept = {r.doc_id for r in set_links.keep_one(docs).collect()}
    assert kept == smallest_of_groups(dict(enumerate(texts)))
    assert max(sent, default=0) <= 160 * 1024 // 24


def test_stages_decide_as_their_operators(spark):
    from pyspark.sql import functions as F

    docs = common.table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = common.settled(stage(spark, docs, SF))
        if k < 4:
            assert out.columns == common.DOCUMENT_COLUMNS
        after = {r.doc_id: r for r in out.collect()}
        if k == 0:
            judged = quality_rules.judge(docs, common.table(spark, SF, "labels"), F.col("doc_id")).collect()
            assert set(after) == {r.doc_id for r in judged if r.kept} and len(after) < len(before)
        elif k == 1:
            assert {i: r.text for i, r in after.items()} == {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif k == 2:
            assert set(after) == smallest_of_groups(before)
        elif k == 3:
            held = {r.doc_id for r in decontaminate.leaks(docs, common.table(spark, SF, "benchmark")).collect()}
            assert set(after) == set(before) - held
        else:
            assert set(after) == set(before)
        docs = out
    result = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert result == sorted(map(tuple, docs.collect()))


def test_stages_take_nulls_repeats_clashing_names_and_empty_tables(spark):
    from pyspark.sql import functions as F

    docs = common.table(spark, SF, "documents").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (3, None, None, "s", 1)], docs.schema)
    odd = docs.unionByName(docs.limit(5)).unionByName(odd).withColumns({"row": F.lit(1), "fp": F.lit("x"), "doc": F.lit(2), "__id": F.lit(3), "key": F.lit(4)})
    for given in (odd, odd.limit(0)):
        n = given.count()
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, given, SF)
            rows = out.collect()
            assert len(rows) <= n and (n == 0 or rows), name
            if k < 4:
                assert out.columns == common.DOCUMENT_COLUMNS
            if k in (1, 4):
                assert len(rows) == n


def test_oracles(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in queries.ORACLE.items():
        want = sorted(map(tuple, con.execute(sql).fetchall()))
        assert sorted(map(tuple, queries.QUERIES[name](spark, SF).collect())) == want


def test_bpe_is_imported_from_the_operator():
    assert corpus_pipeline.stages.bpe_op is bpe
