"""Near-duplicate documents: SimHash fingerprints first, completed by shingle sets.

No radius on 64 bits holds every pair of similarity 0.8 under keys that still
select (such pairs differ in 4 to 19 bits), so the components of ``simhash`` are
completed here: two different texts are linked as well if the sets of their
shingles have a Jaccard similarity of ``SIMILARITY`` or more, all such pairs.

The completion is a set-similarity join with prefix, length and positional
filters. In any one order of all shingles, two sets of that similarity share a
shingle among the first n - ceil(s n) + 1 of each. The order is that of the
hashes, with frequent shingles (the ``HOT_KEYS`` most frequent at most) put last:
passages that many documents share then select nothing, and a text of which a
fifth is its own is a candidate of none. For that, every text counts an eighth of
its shingles, another eighth in each text. The order decides only how many
candidates there are, never which links are found.

Work is done on distinct sets, and only for shingles that join different
components: first each set against the smallest and the greatest under a shingle,
which is linear, then what is left in different components, pair by pair. Candidates
are held against bitmaps of ``BITS`` parities first: an element that only one of two
sets has changes one bit at most, so bitmaps that differ in more bits than similar
sets have such elements prove a pair dissimilar. What remains is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import simhash
from .common import id_key, released, row_key, settled, shuffled, whole

WIDTH = 5
SIMILARITY = 0.8
#: A shingle that so many different sets count is put last in the order.
HOT_SETS = 4
#: So many shingles at most are put last, the most frequent: they are sent to every worker, 8 bytes each.
HOT_KEYS = 65536
#: Parities in the bitmap of a set.
BITS = 2048
#: So many sets at most are named to every worker, 24 bytes each, to read their texts; more are joined by a shuffle.
NAMED = 65536


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted hashes of a text's different shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(np.concatenate([np.empty(0, np.uint64), *simhash.shingle_hashes(words, width)]))


def profile(text: str | None, width: int) -> tuple[int, np.ndarray]:
    """The SimHash of a text's shingles, and the sorted hashes of the different ones."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    ones, n, parts = np.zeros(64, np.int64), 0, [np.empty(0, np.uint64)]
    for hashes in simhash.shingle_hashes(words, width):
        ones += simhash.bit_table(hashes).sum(axis=0, dtype=np.int64)
        n += len(hashes)
        parts.append(hashes)
    return int(np.packbits(2 * ones > n).view(">i8")[0]) if n else 0, np.unique(np.concatenate(parts))


def bitmap(hashes: np.ndarray) -> bytes:
    """Bit i: whether an odd number of the hashes is i modulo BITS."""
    return np.packbits(np.bincount((hashes % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes()


def prefix(hashes: np.ndarray, similarity: Fraction, hot: np.ndarray) -> np.ndarray:
    """The first n - ceil(similarity n) + 1 of sorted ``hashes``, those in sorted ``hot`` last."""
    n = len(hashes)
    if not n:
        return hashes
    size = n - -(-n * similarity.numerator // similarity.denominator) + 1
    if len(hot):
        late = hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[:size]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("text")).alias("row"), whole(F.col("text")).alias("text"))


def counted(hashes: np.ndarray, set_id: int) -> np.ndarray:
    """The eighth of a set's hashes that it counts, which depends on the set."""
    return hashes[((hashes ^ np.uint64(set_id)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(61) == 0]


def _set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), simhash.SEED) if len(hashes) else 0


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def _lists(keys: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.empty(0, np.uint64), *keys]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(flat, pa.int64()))


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, row, fp, set, n, bits, counted) of each row: fingerprint; hash, size, bitmap and counted part of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sets = [], []
            for text in batch.column(2):
                fp, hashes = profile(text.as_py(), width)
                fps.append(fp)
                set_id = _set_id(hashes)
                sets.append((set_id, len(hashes), bitmap(hashes), counted(hashes, set_id)))
            ids, sizes, bits, keys = map(list, zip(*sets, strict=True)) if sets else ([], [], [], [])
            columns = [batch.column(0), batch.column(1), pa.array(fps, pa.int64()), _longs(ids), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), _lists(keys)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "fp", "set", "n", "bits", "counted"])

    ship(docs.sparkSession)
    return _texts(docs).mapInArrow(run, "doc_id long, row long, fp long, set long, n long, bits binary, counted array<long>")


def reordered(docs: DataFrame, width: int, similarity: float, hot: np.ndarray) -> DataFrame:
    """(set, n, prefix) of each row that has a word, the hashes in ``hot`` last in the order."""
    least = Fraction(str(similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [h for h in (shingle_set(t.as_py(), width) for t in batch.column(2)) if len(h)]
            columns = [_longs([_set_id(h) for h in sets]), pa.array([len(h) for h in sets], pa.int64()), _lists([prefix(h, least, hot) for h in sets])]
            yield pa.RecordBatch.from_arrays(columns, names=["set", "n", "prefix"])

    return _texts(docs).mapInArrow(run, "set long, n long, prefix array<long>")


def frequent(sets: DataFrame) -> np.ndarray:
    """The sorted hashes that HOT_SETS sets or more count, HOT_KEYS of them at most."""
    counts = sets.select(F.explode("counted").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_SETS)
    rows = counts.orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key").collect()
    return np.sort(np.array([r.key for r in rows], np.int64).view(np.uint64))


def _bodies(docs: DataFrame, owners: DataFrame, width: int) -> DataFrame:
    """(set, body) of the sets in ``owners`` (set, own): the sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], names=["set", "body"])

    owners = settled(owners.select("set", F.col("own.i").alias("i"), F.col("own.r").alias("row")))
    named = F.broadcast(owners) if owners.count() <= NAMED else shuffled(owners)
    texts = _texts(docs).select(id_key(F.col("doc_id")).alias("i"), "row", "text").join(named, ["i", "row"])
    return texts.select("set", "text").mapInArrow(run, "set long, body binary").dropDuplicates(["set"])


def _both(pairs: DataFrame, of_set: DataFrame, column: str) -> DataFrame:
    """``pairs`` with the ``column`` that ``of_set`` has for x as ``one`` and for y as ``other``."""
    one = of_set.select(F.col("set").alias("x"), F.col(column).alias("one"))
    other = of_set.select(F.col("set").alias("y"), F.col(column).alias("other"))
    return pairs.join(one, "x").join(other, "y")


def _verified(pairs: DataFrame, docs: DataFrame, of_set: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b) roots of the ``pairs`` (x, y, a, b, total) of sets that are similar; total is both sizes. Settled."""
    f = Fraction(str(similarity))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["x", "y", "a", "b"]
            if not batch.num_rows:
                continue
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("one", "other"))
            apart = np.bitwise_count(one ^ other).sum(axis=1, dtype=np.int64)
            total = batch.column("total").to_numpy()
            kept = apart * (f.denominator + f.numerator) <= total * (f.denominator - f.numerator)
            yield batch.select(names).filter(pa.array(kept, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for one, other in zip(batch.column("one"), batch.column("other"), strict=True):
                one, other = (np.frombuffer(v.as_buffer(), np.uint64) for v in (one, other))
                both = len(np.intersect1d(one, other, assume_unique=True))
                kept.append(both * f.denominator >= (len(one) + len(other) - both) * f.numerator)
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    left = settled(_both(pairs, shuffled(of_set), "bits").mapInArrow(close, "x long, y long, a long, b long"))
    needed = left.select(F.explode(F.array("x", "y")).alias("set")).distinct().join(shuffled(of_set.select("set", "own")), "set")
    bodies = settled(_bodies(docs, needed, width))
    found = settled(_both(left, bodies, "body").mapInArrow(run, "a long, b long").distinct())
    released(left, bodies)
    return found


def _possible(similarity: float):
    """Length and positional filter on rows (n, pos) against (m, at) under one shingle.

    For the first shingle that two sets share in the order, no more than it and what
    comes after it can be shared; a similar pair passes there.
    """
    f = Fraction(str(similarity))
    shared = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))
    return (
        (F.col("n") * f.denominator >= F.col("m") * f.numerator)
        & (F.col("m") * f.denominator >= F.col("n") * f.numerator)
        & (shared * (f.denominator + f.numerator) >= (F.col("n") + F.col("m")) * f.numerator)
    )


def _renamed(df: DataFrame, edges: DataFrame) -> DataFrame:
    """``df`` with each ``root`` replaced by that of its component under ``edges``."""
    merged = simhash.components(edges).select(F.col("node").alias("root"), F.col("root").alias("final"))
    return df.join(merged, "root", "left").withColumn("root", F.coalesce("final", "root")).drop("final")


def rooted(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = simhash.RADIUS) -> DataFrame:
    """(fp, set, own, root): each different fingerprint and set, its smallest (id, row), its component; settled."""
    rows = settled(profiles(docs, width))
    ident = F.struct(id_key(F.col("doc_id")).alias("i"), F.col("row").alias("r"))
    nodes = settled(rows.groupBy("fp", "set").agg(F.min(ident).alias("own")))
    nodes_rooted = settled(shuffled(nodes).join(simhash.linked(nodes.select("fp").distinct(), radius), "fp"))
    released(nodes)
    roots = nodes_rooted.groupBy("set").agg(F.min("root").alias("root"), F.min("own").alias("own"))
    distinct = rows.where("n > 0").select("set", "n", "bits", "counted").dropDuplicates(["set"])
    of_set = settled(distinct.join(roots, "set"))
    released(rows)
    same = nodes_rooted.select("set", F.col("root").alias("a")).join(shuffled(of_set.select("set", F.col("root").alias("b"))), "set")
    edges = settled(same.where("a <> b").select("a", "b").distinct())

    prefixes = reordered(docs, width, similarity, frequent(of_set)).dropDuplicates(["set"])
    sets = settled(prefixes.join(shuffled(of_set.select("set", "root")), "set"))
    index = sets.select("set", "n", "root", F.posexplode("prefix").alias("pos", "key"))

    def mixed(of: DataFrame) -> DataFrame:
        ends = of.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
        return settled(shuffled(of).join(ends.select("key"), "key"))

    def similar(candidates: DataFrame) -> DataFrame:
        pairs = candidates.where(_possible(similarity)).select(F.col("set").alias("x"), "y", F.col("root").alias("a"), "b", (F.col("n") + F.col("m")).alias("total"))
        return _verified(pairs.distinct(), docs, of_set, width, similarity)

    open_ = mixed(index)
    released(sets)
    for end in (F.min, F.max):
        against = open_.groupBy("key").agg(end(F.struct("set", "n", "root", "pos")).alias("p"))
        against = against.select("key", F.col("p.set").alias("y"), F.col("p.n").alias("m"), F.col("p.root").alias("b"), F.col("p.pos").alias("at"))
        found = similar(shuffled(open_).join(against, "key").where(F.col("root") != F.col("b")))
        edges = edges.unionByName(found)
        last, open_ = open_, mixed(_renamed(open_, found))
        released(last)
    other = open_.select("key", F.col("set").alias("y"), F.col("n").alias("m"), F.col("root").alias("b"), F.col("pos").alias("at"))
    edges = edges.unionByName(similar(shuffled(open_).join(other, "key").where(F.col("root") < F.col("b"))))
    # A round's roots are roots of the first too, the smallest of their components, so all edges meet in one graph.
    found = settled(_renamed(nodes_rooted, edges).select("fp", "set", "own", "root"))
    released(nodes_rooted, of_set, open_)
    return found


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = simhash.RADIUS) -> DataFrame:
    """The rows of ``docs`` of which each is the first of its component.

    Linked are texts whose fingerprints of ``width``-word shingles differ in ``radius``
    bits at most, and texts whose sets of such shingles have ``similarity`` or more; a
    text of fewer words is one shingle, texts without words (null, empty, white space)
    link with each other. Repeated shingles count once in a set. First is the smallest
    doc_id, then the smallest ``row`` key; of equal rows one stays, texts that share a
    doc_id but not a component stay both. A null doc_id sorts last. All columns pass
    through, an empty table stays empty.
    """
    found = rooted(docs, width, similarity, radius)
    kept = found.groupBy("root").agg(F.min("own").alias("own")).select(F.col("own.i").alias("__id"), F.col("own.r").alias("__row"))
    keyed = docs.select(id_key(F.col("doc_id")).alias("__id"), row_key(F.col("text")).alias("__row"), F.struct("*").alias("__doc"))
    one = keyed.join(kept, ["__id", "__row"], "left_semi").dropDuplicates(["__id", "__row"])
    return one.select(*[F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])
