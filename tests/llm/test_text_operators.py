"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from sheaf.llm import bpe, decontaminate, licenses, line_dedup, pieces, quality_model, quality_rules, simhash, token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, fp string, words string, key string"


def documents(spark, texts, ids=None):
    """With columns whose names operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None, "r", "f", "w", "k") for i, t in zip(ids, texts, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(4)
    base = [" ".join(draw.choice("ab cd efg hij Kl MNO p é ü".split()) + str(draw.randrange(40)) for _ in range(draw.randrange(5, 80))) for _ in range(40)]
    near = [t.replace("a", "b", 1) for t in base[:10]] + [t + " x" for t in base[:10]]
    lines = ["shared line one two\n" + base[0] + "\n Shared LINE one two \n\nshort", "shared line one two", "a\nb\n", "\n"]
    odd = [None, "", " \t\n", "one", "One", "two words", "two words", "a " * 3000, "x" * 5000, " \x1c\x85  nbsp\xa0here "]
    return base + near + base[5:8] + lines + odd


def test_simhash_links_all_pairs_within_the_radius(spark, texts):
    ids = [None if i == 3 else i // 2 if i > 60 else i for i in range(len(texts))]
    rows = simhash.near_duplicates(documents(spark, texts, ids)).collect()
    assert len(rows) == len(texts)

    def fingerprint(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        if not w:
            return 0
        n = min(3, len(w))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]), 42) for i in range(len(w) - n + 1)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = [fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(want)):
        for j in range(i):
            if (want[i] ^ want[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, d in enumerate(ids):
        if d is not None:
            r = root(i)
            least[r] = d if least[r] is None else min(least[r], d)
    expected = sorted((str(d), want[i], str(least[root(i)])) for i, d in enumerate(ids))
    assert sorted((str(r.doc_id), r.fp & (2**64 - 1), str(r.component_id)) for r in rows) == expected


def test_every_pair_within_three_bits_shares_a_key(spark):
    draw = random.Random(1)
    base = draw.getrandbits(64)
    some = {base} | {base ^ sum(1 << b for b in draw.sample(range(64), k)) for k in (1, 2, 3, 4, 5, 6) for _ in range(60)}
    some = sorted(x - 2**64 if x >= 2**63 else x for x in some)
    rows = {r.fp: r.root for r in simhash.linked(spark.createDataFrame([(x,) for x in some], "fp long")).collect()}
    seen = {}
    for x in some:
        todo, group = [x], {x}
        while todo:
            a = todo.pop()
            close = {b for b in some if ((a ^ b) & (2**64 - 1)).bit_count() <= 3} - group
            group |= close
            todo += close
        seen[x] = frozenset(group)
    assert len(set(rows.values())) == len(set(seen.values()))
    assert all(len({rows[b] for b in seen[a]}) == 1 for a in some)


def test_components_of_a_long_path_and_of_many_under_one_key(spark):
    path = spark.range(700).selectExpr("id * 7919 % 700 AS a", "(id * 7919 + 7919) % 700 AS b")
    assert {r.root for r in simhash.components(path).collect()} == {0}
    # One high segment, low segments in pairs two bits apart: all stand under the same keys.
    draw = random.Random(5)
    lows = [draw.getrandbits(32) for _ in range(300)]
    some = sorted({x ^ y for x in lows for y in (0, 0b101 << 20)})
    rows = {r.fp: r.root for r in simhash.linked(spark.createDataFrame([(x,) for x in some], "fp long")).collect()}
    close = lambda a, b: (a ^ b).bit_count() <= 3
    assert all(rows[a] == rows[b] for a in some for b in some if close(a, b))
    assert len(set(rows.values())) >= 290


def test_links_send_no_exploded_table_to_the_driver(spark, broadcasts):
    draw = random.Random(6)
    base = [draw.getrandbits(64) for _ in range(40)]
    some = {b ^ sum(1 << k for k in draw.sample(range(64), draw.randrange(4))) for b in base for _ in range(50)}
    nodes = simhash.settled(spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in sorted(some)], "fp long"))
    with broadcasts("96k") as sent:
        rows = simhash.linked(nodes).collect()
    assert len(rows) == len(some) and len({r.root for r in rows}) <= len(base)
    assert max(sent, default=0) <= 4 * len(some)


def test_pairs_with_an_equal_segment_are_compared_under_one_key(spark, made):
    # One low or high segment, the others in pairs two bits apart.
    draw = random.Random(8)
    parts = [x ^ y for x in (draw.getrandbits(31) for _ in range(150)) for y in (0, 0b101 << 20)]
    some = sorted({(7 << 32) + x for x in parts} | {(x << 32) + 9 for x in parts})
    nodes = simhash.settled(spark.createDataFrame([(x,) for x in some], "fp long"))
    with made("Generate") as ran:
        rows = {r.fp: r.root for r in simhash.linked(nodes).collect()}
    assert all(rows[a] == rows[b] for a in some for b in some if (a ^ b).bit_count() <= 3)
    cut = [n for what, n in ran if "[block#" in what]
    # Four blocks under one key on either side; under all 32 keys it would be 128.
    assert cut and sum(cut) <= 2 * 4 * len(some)


def test_every_pair_within_the_radius_is_compared(spark):
    draw = random.Random(9)
    base = draw.getrandbits(64)
    flips = [(), *((p,) for p in range(64)), *(tuple(draw.sample(range(64), k)) for k in (2, 3, 4, 5) for _ in range(60))]
    some = sorted({x - 2**64 if x >= 2**63 else x for x in (base ^ sum(1 << p for p in f) for f in flips)})
    index = simhash.variants(spark.createDataFrame([(x,) for x in some], "fp long").withColumn("root", F.col("fp")), "root")
    blocks = simhash._blocks(simhash._telling(simhash.settled(index))).select("key", "block", "fp")
    pairs = simhash.settled(blocks).join(blocks.withColumnRenamed("fp", "b"), ["key", "block"]).where("fp < b").select("fp", "b").distinct()
    found = {(r.fp, r.b) for r in pairs.collect()}
    assert {(a, b) for a in some for b in some if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3} <= found


def test_keep_one_keeps_the_smallest_id_of_each_group(spark):
    docs = documents(spark, ["same words here now", "same words here now", "other text altogether yes", "same words here now", None, ""], [5, 2, 7, 2, 9, None])
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == [2, 7, 9]
    two = documents(spark, ["one text about some thing of its own", "and quite another one on a thing apart", "one text about some thing of its own"], [5, 5, None])
    assert sorted((r.doc_id, r.text[:3]) for r in simhash.keep_one(two).collect()) == [(5, "and"), (5, "one")]
    assert simhash.keep_one(docs.limit(0)).columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_line_dedup(spark, texts):
    ids = [i if i != 7 else 6 for i in range(len(texts))]
    found = line_dedup.dedup_lines(documents(spark, texts, ids))
    assert found.columns[-3:] == ["text", "n_lines", "n_dropped"]
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    held = defaultdict(set)
    for i, t in zip(ids, texts, strict=True):
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    want = []
    for i, t in zip(ids, texts, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == i]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()) == sorted(want)


def test_line_dedup_of_frequent_keys_and_null_ids(spark, monkeypatch):
    docs = documents(spark, ["a very frequent line\nx", "A very frequent line ", None, "a very frequent line"], [None, 4, 5, 4])
    for share in (1, 4096):  # every shared key looked up by join, then by broadcast
        monkeypatch.setattr(line_dedup, "HEAVY_SHARE", share)
        rows = sorted((str(r.doc_id), r.text) for r in line_dedup.dedup_lines(docs).collect())
        assert rows == [("4", "A very frequent line "), ("4", "a very frequent line"), ("5", ""), ("None", "x")]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def tricky():
    draw = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "the", "'s", "'LL", "é", "日本", "12", "½", "<|endoftext|>", "\xa0", "\x1c", "\x85", "😀", "!", "z" * 30]
    return ["".join(draw.choice(parts) for _ in range(draw.randrange(50))) for _ in range(400)] + ["y" * 3000, "ab " * 2000]


def test_codec_is_the_librarys(tokenizer):
    with open(VOCABULARY, encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    some = tricky()
    for text, want in zip(some, tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
        assert codec.encode(text) == want.ids
        assert codec.decode(want.ids) == tokenizer.decode(want.ids, skip_special_tokens=False)
    assert codec.merge_many([b"a", b"ab", b"hello" * 300])[0] == np.array(tokenizer.encode("a").ids, np.int32).tobytes()


def test_pieces_are_the_texts():
    some = ["", *tricky(), "", "a\u2003 b \u00a0c d\u1680 e \u3000f \u205fg é h à i \x85 j", " x", "y ", ""]
    for texts in (pa.array(some), pa.array(some).slice(3, 200), pa.array([]).cast(pa.string())):
        for most in (1, 20, 1 << 20):
            joined = [""] * len(texts)
            for block in pieces.blocks(texts, most):
                found = [block.keys[i].decode() for i in block.index.to_pylist()]
                assert len({*block.keys}) == len(block.keys)
                for piece, owner in zip(found, block.owner, strict=True):
                    if joined[owner]:
                        assert piece[0] == " " and not joined[owner][-1].isspace() and not piece[1].isspace()
                    joined[owner] += piece
            assert joined == texts.to_pylist()


def test_memo_is_bounded_in_bytes():
    made = []
    memo = pieces.Memo(lambda keys: [made.append(k) or len(k) for k in keys], 20_000)
    for i in range(2_000):
        assert memo.values([b"%d" % i, b"x" * 65, b"kept"]) == [len(b"%d" % i), 65, 4]
        assert len(memo.young) + len(memo.old) <= 2 * 20_000 // pieces.ENTRY + 3 and b"x" * 65 not in memo.young
    assert made.count(b"kept") == 1 and made.count(b"x" * 65) == 2_000


def test_bpe_and_counts(spark, tokenizer, texts):
    some = texts + tricky()[:50]
    docs = documents(spark, some)
    want = [e.ids for e in tokenizer.encode_batch([t or "" for t in some], add_special_tokens=False)]
    rows = {r.doc_id: r for r in bpe.digests(docs, VOCABULARY, 200).collect()}
    whole = {r.doc_id: r for r in bpe.encoded(docs, VOCABULARY, 200).collect()}
    counts = {r.doc_id: r for r in token_counts.count_tokens(docs, VOCABULARY, batch_bytes=200).collect()}
    for i, (text, expected) in enumerate(zip(some, want, strict=True)):
        assert rows[i].n_tokens == counts[i].n_tokens == len(expected)
        assert whole[i].ids == expected and whole[i].decoded == (text or "")
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, expected)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert counts[i].n_bytes == len((text or "").encode()) and counts[i].over_limit == (len(expected) > 512)
    assert bpe.encoded(docs.limit(0), VOCABULARY).count() == bpe.digests(docs.limit(0), VOCABULARY).count() == token_counts.count_tokens(docs.limit(0), VOCABULARY).count() == 0


def test_counts_of_other_vocabularies(spark):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    some = ["Hello  World again", "", "ünï <|endoftext|> x", " lead"]
    for name in ("piece_bpe_32k.model", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        if name.endswith(".model"):
            want = [len(x) for x in SentencePieceProcessor(model_file=path).encode(some)]
        else:
            want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]
        got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(documents(spark, some), path).collect()}
        assert [got[i] for i in range(len(some))] == want


def test_decontamination_finds_every_similar_window(spark, texts):
    draw = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(n))) for i, n in enumerate([3, 8, 15, 20, 30, 30, 59])] + [(80, "what is seven times"), (81, "Seven")] + [(90, ""), (91, None), (None, "a b c d e f")]
    docs = [t or "" for t in texts] + ["Question: what is seven times six? answer", "what is  SEVEN", "one two what is seven\ntimes"]
    for item in items[:7] * 6:
        w = item[1].split()
        for _ in range(draw.randrange(3)):
            k = draw.randrange(len(w))
            w[k : k + draw.randrange(2)] = [draw.choice(vocabulary)]
        docs.append(draw.choice(["", docs[0] + " "]) + " ".join(w).upper() + draw.choice(["", " " + docs[1]]))

    def shingles(w):
        return decontaminate.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    want = {}
    for d, text in enumerate(docs):
        w = text.translate(LOWER).split()
        for i, item in items:
            v = (item or "").translate(LOWER).split()
            if i is None or not v or not w:
                continue
            n = min(len(v), len(w))
            scored = [(decontaminate.similarity(shingles(v), shingles(w[k : k + n])), -k) for k in range(len(w) - n + 1)]
            if (best := max(scored))[0] >= 0.8:
                want[d, i] = (round(best[0], 9), -best[1], n)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, similarity string")
    rows = decontaminate.leaks(documents(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word, r.n_words) for r in rows} == want and len(want) > 20
    assert sum(i == 80 for _, i in want) == 2 and sum(i == 81 for _, i in want) == 3
    kept = {r.doc_id for r in decontaminate.clean(documents(spark, docs), bench).collect()}
    assert kept == set(range(len(docs))) - {d for d, _ in want}
    assert decontaminate.leaks(documents(spark, docs), bench.limit(0)).count() == 0
    nulls = documents(spark, [None, "", items[4][1], items[4][1]], [None, 1, 2, None])
    cleaned = decontaminate.clean(nulls, bench)
    assert sorted(str(r.doc_id) for r in cleaned.collect()) == ["1", "None"] and cleaned.columns == nulls.columns
    assert decontaminate.clean(nulls, bench.limit(0)).count() == 4 and decontaminate.clean(nulls.limit(0), bench).count() == 0


def test_decontamination_of_documents_shorter_than_an_item(spark):
    draw = random.Random(12)
    items = [(i, [f"w{draw.randrange(200)}" for _ in range(n)]) for i, n in enumerate([5, 6, 10, 30, 31, 45, 60] * 3)]
    docs, want = [], set()

    def shingles(w):
        return decontaminate.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    for _, w in items:
        for cut in range(1, 8):
            docs += [w[cut:], w[:-cut], w[cut // 2 : len(w) - cut + cut // 2], w[: len(w) // 2] + w[len(w) // 2 + cut :]]
    for d, w in enumerate(docs):
        for i, v in items:
            if len(w) < len(v) and w and (score := decontaminate.similarity(shingles(v), shingles(w))) >= 0.8:
                want.add((d, i, round(score, 9), 0, len(w)))
    bench = spark.createDataFrame([(i, " ".join(v)) for i, v in items], "item_id long, text string")
    rows = decontaminate.leaks(documents(spark, [" ".join(w) for w in docs]), bench).collect()
    shorter = {(r.doc_id, r.item_id, round(r.similarity, 9), r.first_word, r.n_words) for r in rows if r.n_words < len(items[r.item_id][1])}
    assert shorter == want and len(want) > 100


def test_licenses(spark, texts):
    lines = [
        "Released under the MIT License.",
        "x\nLicensed under the Apache License, Version 2.0.\nunder the mit\nlicense",
        "This work is licensed under the GNU General Public License, version 3.",
        "CC BY-NC cc by nc\nLicensed under CC BY-NC 4.0.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation",
    ]
    draw = random.Random(3)
    for _, notice in licenses.TEMPLATES * 12:  # words left out, put in and put in another order
        w = notice.split()
        for _ in range(draw.randrange(4)):
            k = draw.randrange(len(w))
            w[k : k + draw.randrange(2)] = draw.choice([[], ["some"], ["license"], [w[-1]]]) or ["x"][: draw.randrange(2)]
        lines.append(" ".join(["the of"] * draw.randrange(9) + (w or ["x"]) + ["and a license"] * draw.randrange(4)))
    lines.append(" ".join(n for _, n in licenses.TEMPLATES * 20))
    some = lines + texts
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    want = []
    for i, t in enumerate(some):
        t = (t or "").translate(LOWER)
        w, places, base, best = re.findall(pattern, t), [], set(), 0.0
        for phrase, label in licenses.PHRASES.items():
            q = phrase.split()
            found = [k for k in range(len(w)) if w[k : k + len(q)] == q]
            places += found
            base |= {label} if found else set()
        labels = set(base)
        for label, notice in licenses.TEMPLATES:
            wanted = set(notice.split())
            length = int(len(notice.split()) / licenses.THRESHOLD + 1e-9)
            share = max((len(wanted.intersection(w[k : k + length])) for k in range(len(w))), default=0) / len(wanted)
            if share >= licenses.THRESHOLD:
                labels.add(label)
                best = max(best, share)
        want.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else best))
    docs = documents(spark, some)
    assert sorted(tuple(r) for r in licenses.scan(docs).collect()) == sorted(want)
    assert "gpl" in want[2][6] and "mit" in want[4][6]
    assert len({r[6] for r in want}) > 6 and sum(0 < r[7] < 1 for r in want) > 5
    assert licenses.scan(docs.limit(0)).count() == 0 and {r.labels for r in licenses.scan(docs, {}, []).collect()} == {""}


def test_wrapped_license_notices(spark):
    import textwrap

    prose = "some words that say nothing about it " * 5
    wrapped = []
    for _, notice in licenses.TEMPLATES:
        wrapped += [textwrap.fill(notice, width, initial_indent=head, subsequent_indent=head, break_long_words=False) for width, head in ((72, " * "), (40, "# "), (12, ""))]
    apart = "we licensed the picture under a contract signed at mit in boston, the museum said, and the license fee was paid"
    docs = documents(spark, [f"{prose}\n\n{w}\n\n{prose}" for w in wrapped] + [apart, "this is free software\n" + prose * 20 + "under the general public license", ""])
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i in range(len(wrapped)):
        assert licenses.TEMPLATES[i // 3][0] in rows[i].labels.split(",") and rows[i].score == 1.0, wrapped[i]
    assert all(rows[len(wrapped) + k].labels == "" and rows[len(wrapped) + k].score == 0 for k in (0, 1, 2))


def test_quality_rule_counts(spark, texts):
    some = texts + ["a b c d e f g h " * 4, "one two\none two\n \none two", "p q r s t u v w x p q r s t u v w"]
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, some)
    rows = {r.doc_id: r for r in quality_rules.judge(docs, labels, F.col("doc_id")).collect()}
    for i, t in enumerate(some):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = defaultdict(list)
        for k in range(len(w) - 7):
            windows[tuple(w[k : k + 8])].append(k)
        covered = {x for v in windows.values() if len(v) > 1 for k in v for x in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")]
        r = rows[i]
        counts = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts, t
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert r.kept == (not r.base_failed)  # one label certifies nothing
    assert quality_rules.judge(docs.limit(0), labels.limit(0), F.col("doc_id")).count() == 0


def test_quality_cutoffs_bound_false_rejection(spark):
    from math import comb

    good = ["the quick brown fox jumps over a lazy dog again and again while nobody looks at " + f"word{i} thing{i} other{i} more{i} last{i}" for i in range(700)]
    bad = [" ".join(f"w{i}{k}###" for k in range(25)) for i in range(50)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 700), 0) for i in range(750)], "doc_id long, quality int, toxic int")
    rows = quality_rules.judge(docs, labels, F.col("doc_id")).collect()
    assert all(r.kept == (r.doc_id < 700) for r in rows)
    p = 0.02
    cases = [(0, 100), (3, 200), (4, 200), (1, 50)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality_rules.tail(F.col("k"), F.col("n"), p).alias("t"))
    for r in df.collect():
        exact = sum(comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1))
        assert r.t == (1.0 if r.k >= r.n * p else pytest.approx(exact, rel=1e-9))


def test_quality_cutoffs_are_calibrated_on_all_labels(spark):
    n, rare = 40_000, 1_200
    plain = "concat_ws(' ', transform(sequence(1, 25), k -> concat('word', id, 'x', k)))"
    ids = spark.range(n + rare + 50)
    docs = ids.selectExpr("id AS doc_id", f"CASE WHEN id < {n + rare} THEN {plain} ELSE replace({plain}, 'x', '#########') END AS text", f"if(id < {n}, 'en', 'rare') AS lang")
    labels = ids.selectExpr("id AS doc_id", f"CAST(id < {n + rare} AS INT) AS quality", "0 AS toxic")
    limits = {r.stratum: r for r in quality_rules.cutoffs(docs, labels).collect()}
    assert set(limits) == {"rare"} and 450 < limits["rare"].n_good < 750  # no bad label proposes a cutoff for the other
    judged = quality_rules.judge(docs, labels, F.col("doc_id")).where("kept")
    assert judged.count() == n + rare and judged.agg(F.max("doc_id")).first()[0] < n + rare


def test_quality_cutoffs_of_strata_differ_and_keep_their_bound(spark):
    flat = [f"CAST(0.1 AS DOUBLE) AS {r}" for r in quality_rules.RULES if r not in ("symbol_share", "upper_share")]
    rows = spark.range(30_000).selectExpr(
        "id AS of_id", "if(id % 3 = 0, 'a', 'b') AS stratum", "100L AS n_words", "0L AS n_repeat_words",
        "CAST(id % 10 < 7 AS INT) AS quality", "pmod(xxhash64(id), 100000) / 100000D AS u", "pmod(xxhash64(id, 5), 100000) / 100000D AS v",
    )
    # Good ones overlap with bad ones; the second rule can't tell them apart.
    symbols = "CASE WHEN quality = 1 THEN pow(u, 4) * if(stratum = 'a', 0.3, 0.6) ELSE 0.1 + u END AS symbol_share"
    figures = rows.selectExpr("*", symbols, "v AS upper_share", *flat)
    found = {r.stratum: r for r in quality_rules._certified(figures, rows.select(F.col("of_id").alias("doc_id"), "quality")).collect()}
    assert found["a"].symbol_share < found["b"].symbol_share and all(r.upper_share is None and r.mean_word is None for r in found.values())
    allowed = quality_rules.FALSE_REJECTION / len(quality_rules.RULES)
    for stratum, r in found.items():
        over = F.avg((quality_rules.bin_of(F.col("symbol_share")) > r.symbol_share).cast("int"))
        shares = {x.quality: x.o for x in figures.where(F.col("stratum") == stratum).groupBy("quality").agg(over.alias("o")).collect()}
        assert shares[1] <= allowed and shares[0] > 0.5, (stratum, shares)


def test_quality_classifier_bounds_its_fit_and_takes_any_text(spark, monkeypatch):
    texts = [f"good words number {i} in a calm sentence" for i in range(60)] + [f"### {i} $$$ %%% buy {i} now !!!" for i in range(60)] + [None, "", "z" * 300_000, "z" * 300_000]
    docs = documents(spark, texts, [*range(123), 122])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality_model.quality_scores(docs, labels).collect()}
    assert sum(rows[i].score > rows[60 + i].score for i in range(60)) == 60 and all(0 <= r.score <= 1 for r in rows.values())
    monkeypatch.setattr(quality_model, "MAX_INDICATORS", 2_000)
    some = quality_model.quality_scores(docs, labels)
    assert some.count() == 124 and some.columns == ["doc_id", "held_out", "score", "predicted"]
    assert quality_model.quality_scores(docs.limit(0), labels).count() == 0


def test_quality_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    extra = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, None)], docs.schema))
    rows = quality_model.quality_scores(extra, labels).collect()
    assert len(rows) == docs.count() + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in judged) >= 0.9 * len(judged)
    none = quality_model.quality_scores(extra, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
