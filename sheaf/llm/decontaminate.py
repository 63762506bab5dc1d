"""Benchmark items inside documents, found by SimHash fingerprints of item-sized windows.

Every window as long as an item gets a SimHash over its word shingles; of a
document shorter than the item the whole is the one window. A
multi-index of Hamming blocks finds all items whose fingerprint is within the
radius: with more blocks than half the radius, one block differs by a bit at
most, so items stand in each block's table under their value and its one-bit
neighbours. Exact weighted-shingle similarity verifies the candidates.

A window without any shingle of an item of its length has similarity zero to all
of them; such windows are not fingerprinted, which loses nothing.

The benchmark is the stated query set: it is indexed in blocks of bounded size,
each block in one broadcast, and every block is held against all documents.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import whole
from .simhash import bit_table

WIDTH = 5
SIMILARITY = 0.8
#: Differing bits within which every fingerprint is found, and the blocks that guarantee it.
RADIUS = 20
BLOCKS = 11
#: Items and bytes of item text in one broadcast index.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 32 << 20
#: Windows fingerprinted at a time.
STEP = 1 << 13
#: Odd 64-bit multipliers.
FOLD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def all_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every shingle of WIDTH words; of all words if there are fewer."""
    return folded_hashes(word_hashes(words), min(WIDTH, len(words)))


def folded_hashes(each: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words: theirs are folded by an odd multiplier and mixed."""
    n = len(each)
    if not 0 < width <= n:
        return np.zeros(0, np.uint64)
    folded = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        folded *= FOLD
        folded += each[k : n - width + 1 + k]
    folded ^= folded >> np.uint64(31)
    folded *= MIX
    folded ^= folded >> np.uint64(29)
    return folded


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: a shingle weighs as often as it occurs."""
    both = sum(min(n, b[h]) for h, n in a.items() if h in b)
    return both / (a.total() + b.total() - both)


def _hits(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The places of ``hashes`` that are in the sorted ``known``."""
    if not len(known) or not len(hashes):
        return np.zeros(0, np.int64)
    return np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes)


class ItemIndex:
    """Items by length in shingles, each length with its block tables."""

    def __init__(self, items: list[tuple[int, str]]):
        cuts = np.linspace(0, 64, BLOCKS + 1).round().astype(int)
        self.blocks = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        if len(self.blocks) * 2 <= RADIUS:
            raise ValueError("too few blocks for one differing bit in one of them")
        self.of_length: dict[tuple[int, int], dict] = {}
        grouped = defaultdict(list)
        short = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = words_of(text)
            if 0 < len(words) < WIDTH:
                short[len(words)][int(all_hashes(words)[0])].append(item_id)
            elif words:
                grouped[len(words)].append((item_id, all_hashes(words)))
        #: Items of fewer words than a shingle, by their number of words.
        self.short = {n: (np.array(sorted(found), np.uint64), dict(found)) for n, found in short.items()}
        lengths_of: dict[int, set] = defaultdict(set)
        for n_words, group in grouped.items():
            for _, hashes in group:
                for h in hashes.tolist():
                    lengths_of[h].add(n_words)
            bits = np.stack([self._majority(bit_table(h).sum(axis=0, dtype=np.int64), len(h)) for _, h in group])
            self.of_length[n_words] = {
                "ids": [i for i, _ in group],
                "shingles": [Counter(h.tolist()) for _, h in group],
                "bits": bits,
                "fps": np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64),
                "tables": [self._table(bits[:, a:b]) for a, b in self.blocks],
            }
        self.lengths_of = dict(lengths_of)
        self.known = np.array(sorted(lengths_of), np.uint64)

    @staticmethod
    def _majority(ones: np.ndarray, n) -> np.ndarray:
        return (2 * ones > n).astype(np.uint8)

    @staticmethod
    def _values(bits: np.ndarray) -> np.ndarray:
        return bits.astype(np.int64) @ (1 << np.arange(bits.shape[1])[::-1])

    def _table(self, bits: np.ndarray) -> dict[int, list[int]]:
        """Items by a block's value, each under its own and all values one bit away."""
        table = defaultdict(list)
        for item, value in enumerate(self._values(bits).tolist()):
            table[value].append(item)
            for p in range(bits.shape[1]):
                table[value ^ 1 << p].append(item)
        return dict(table)

    def matches(self, text: str | None, threshold: float) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words) of the best window of each item found."""
        words = words_of(text)
        each = word_hashes(words)
        best: dict[int, tuple[int, float, int, int]] = {}
        for width, (known, of_hash) in self.short.items():  # one shingle each: similar is equal
            runs = folded_hashes(each, width)
            for p in _hits(runs, known).tolist():
                for item_id in of_hash[int(runs[p])]:
                    best.setdefault(item_id, (item_id, 1.0, p, width))
        hashes = folded_hashes(each, WIDTH)  # a shorter text has no shingle of a longer item
        starts = defaultdict(set)
        for p in _hits(hashes, self.known).tolist():
            for n_words in self.lengths_of[int(hashes[p])]:
                n = min(n_words - WIDTH + 1, len(hashes))
                starts[n_words].update(range(max(0, p - n + 1), min(p, len(hashes) - n) + 1))
        for n_words, found in starts.items():
            ordered = np.array(sorted(found))
            for lo in range(0, len(ordered), STEP):
                for item_id, score, first in self._windows(hashes, n_words, ordered[lo : lo + STEP], threshold):
                    if item_id not in best or (-score, first) < (-best[item_id][1], best[item_id][2]):
                        best[item_id] = (item_id, score, first, min(n_words, len(words)))
        return sorted(best.values())

    def _windows(self, hashes: np.ndarray, n_words: int, starts: np.ndarray, threshold: float) -> Iterator[tuple[int, float, int]]:
        group, n = self.of_length[n_words], min(n_words - WIDTH + 1, len(hashes))
        low = int(starts[0])
        used, at = np.unique((starts[:, None] - low + np.arange(n)).ravel(), return_inverse=True)
        table = bit_table(hashes[low + used]).astype(np.int16)
        bits = np.empty((len(starts), 64), np.uint8)
        at = at.reshape(len(starts), n)
        step = max(1, STEP // n)
        for lo in range(0, len(starts), step):
            bits[lo : lo + step] = self._majority(table[at[lo : lo + step]].sum(axis=1, dtype=np.int64), n)
        fps = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
        candidates = defaultdict(set)
        for (a, b), index in zip(self.blocks, group["tables"], strict=True):
            for w, value in enumerate(self._values(bits[:, a:b]).tolist()):
                if items := index.get(value):
                    candidates[w].update(items)
        for w, items in candidates.items():
            items = np.array(sorted(items))
            close = items[np.bitwise_count(group["fps"][items] ^ fps[w]) <= RADIUS]
            if len(close):
                first = int(starts[w])
                window = Counter(hashes[first : first + n].tolist())
                for item in close.tolist():
                    score = similarity(group["shingles"][item], window)
                    if score >= threshold:
                        yield group["ids"][item], score, first


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, in lists of bounded count and size; of one block alone at a time on the driver."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), whole(F.col("text")).alias("text")).where("item_id IS NOT NULL").distinct()
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        if found := [(r.item_id, r.text) for r in part.toLocalIterator()]:
            yield found


def leaks(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): items that a document holds.

    A row for each pair whose best window of the item's length has a weighted
    Jaccard similarity of ``threshold`` or more on five-word shingles (the best
    window, its place in words from 0; the earliest of equals). A document shorter
    than the item is one window, with the document's own number of words. Texts are
    lower-cased A-Z and cut at ``[\\x20\\x09-\\x0D]``. An item of fewer than five
    words is one shingle and is found wherever these words stand side by side; items
    without words or without an id match none. Null and empty texts hold none.
    Rows that share a doc_id are one document. Null doc_ids are kept as one.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    out = None
    for block in _item_blocks(items):
        index = spark.sparkContext.broadcast(ItemIndex(block))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    found += [(doc_id, *m) for m in index.value.matches(text.as_py(), threshold)]
                if found:
                    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.max_by(F.struct("similarity", "first_word", "n_words"), F.struct("similarity", -F.col("first_word"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose text holds no item (see ``leaks``); all columns pass through.

    Each row is judged by its own text where it is read, nothing is shuffled. Rows
    with a null or empty text stay, equal rows stay or go together.
    """
    spark = docs.sparkSession
    ship(spark)
    for block in _item_blocks(items):
        held = _holds(spark.sparkContext.broadcast(ItemIndex(block)), threshold)
        docs = docs.where(~F.arrow_udf(held, "boolean")(F.col("text")))
    return docs


def _holds(index: Broadcast, threshold: float) -> Callable[[pa.Array], pa.Array]:
    def held(texts: pa.Array) -> pa.Array:
        return pa.array([bool(index.value.matches(text.as_py(), threshold)) for text in texts], pa.bool_())

    return held
