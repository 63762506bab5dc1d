"""Byte-level BPE encoding and decoding, merged with a segment tree over adjacent pair ranks.

The tree's leaves are the ranks of adjacent pairs, its root names the leftmost
pair of the lowest rank. A merge rewrites three leaves at most, each in a
logarithmic walk, until the root holds no pair.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces as P
from ..shipping import ship
from .common import whole

#: The pattern of byte-level pre-tokens, and the code points that stand for bytes in vocabulary files.
PRE_TOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Bytes of pieces and ids remembered in each of two generations; bytes of text handled at a time.
MEMO_BYTES = 96 << 20
BATCH_BYTES = 1 << 21
#: Leaves of the trees that are merged together.
TREE_CELLS = 1 << 17
NO_RANK = 1 << 40
NO_PAIR = 1 << 62

_codecs: dict[int, Codec] = {}


def byte_letters() -> dict[str, int]:
    """The letter that a vocabulary file shows for each byte: itself where printable, else the next one from 256 on."""
    hidden = [b for b in range(256) if b not in set(SHOWN)]
    return {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """A vocabulary file's encoding and decoding."""

    def __init__(self, content: str):
        spec = P.load(content)
        model = spec["model"]
        if not P.splittable(spec) or model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")
        letters, vocab = byte_letters(), model["vocab"]
        self.bytes_of = {i: bytes(map(letters.__getitem__, token)) for token, i in vocab.items() if all(c in letters for c in token)}
        self.id_of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.id_of_byte[b] = vocab[letter]
        pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pairs.setdefault(vocab[left] << 32 | vocab[right], (rank, vocab[left + right]))
        ordered = sorted((k, *v) for k, v in pairs.items()) or [(-1, 0, 0)]
        self.pair_keys, self.pair_ranks, self.pair_ids = np.array(ordered, np.int64).T.copy()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first))) if self.added else None
        self.token_bytes = pa.array([self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)], pa.binary())
        self.token_sizes = pc.binary_length(self.token_bytes).to_numpy().astype(np.int64)
        # Ranks and merged ids of two bytes, which a merge begins with.
        left, right = np.repeat(self.id_of_byte, 256), np.tile(self.id_of_byte, 256)
        self.byte_ranks, self.byte_merged = (x.reshape(256, 256) for x in self.lookup(left, right))
        self.pre_memo = P.Memo(self.merge_many, MEMO_BYTES // 2, len)
        self.memo = P.Memo(self._codes, MEMO_BYTES, len)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of each pair; rank NO_RANK where the pair isn't mergeable."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == wanted, self.pair_ranks[at], NO_RANK), self.pair_ids[at]

    def merge_many(self, tokens: list[bytes]) -> list[bytes]:
        """Ids of each pre-token after all merges, as 32-bit integers.

        The trees of pre-tokens of about one length are rows of one array, and take
        a step together: rows whose root holds no pair are done.
        """
        out = [b""] * len(tokens)
        groups: dict[int, list[int]] = {}
        for at, token in enumerate(tokens):
            groups.setdefault(max(2, 1 << (len(token) - 1).bit_length()), []).append(at)
        for size, members in groups.items():
            step = max(1, TREE_CELLS // size)
            for lo in range(0, len(members), step):
                part = members[lo : lo + step]
                for at, ids in zip(part, self._merge_rows([tokens[m] for m in part], size), strict=True):
                    out[at] = ids
        return out

    def _merge_rows(self, tokens: list[bytes], size: int) -> list[bytes]:
        """As merge_many, for tokens of 1 to ``size`` bytes; ``size`` is a power of two."""
        n = np.fromiter(map(len, tokens), np.int64, len(tokens))
        shift = size.bit_length()
        flat = np.frombuffer(b"".join(t.ljust(size, b"\0") for t in tokens), np.uint8).reshape(-1, size)
        # Columns beyond a token hold no symbol; column ``size`` takes what would stand after the last one.
        ids = np.full((len(tokens), size + 1), -1, np.int64)
        ids[:, :size] = np.where(np.arange(size) < n[:, None], self.id_of_byte[flat], -1)
        after = np.broadcast_to(np.minimum(np.arange(1, size + 2), size), ids.shape).copy()
        before = np.broadcast_to(np.arange(-1, size), ids.shape).copy()
        merged = np.zeros_like(ids)
        tree = np.full((len(tokens), 2 * size), NO_PAIR, np.int64)
        rank, merged[:, : size - 1] = self.byte_ranks[flat[:, :-1], flat[:, 1:]], self.byte_merged[flat[:, :-1], flat[:, 1:]]
        tree[:, size : 2 * size - 1] = np.where((rank < NO_RANK) & (ids[:, 1:size] >= 0), rank << shift | np.arange(size - 1), NO_PAIR)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        rows = np.arange(len(tokens))
        while len(rows := rows[tree[rows, 1] < NO_PAIR]):
            i = tree[rows, 1] & (1 << shift) - 1
            j = after[rows, i]
            k, h = after[rows, j], before[rows, i]
            ids[rows, i], ids[rows, j] = merged[rows, i], -1
            after[rows, i] = k
            before[rows, k] = i
            tree[rows, size + j] = NO_PAIR
            for left, right in ((i, k), (h, i)):
                r, m = self.lookup(ids[rows, left], ids[rows, right])
                some = (left >= 0) & (ids[rows, right] >= 0)
                at = rows[some]
                tree[at, size + left[some]] = np.where(r < NO_RANK, r << shift | left, NO_PAIR)[some]
                merged[at, left[some]] = m[some]
            ends = k == size  # or beyond the token: then no pair starts at i
            ends |= ids[rows, k] < 0
            tree[rows[ends], size + i[ends]] = NO_PAIR
            up = np.stack([i, j, np.where(h >= 0, h, i)]) + size
            while up[0, 0] > 1:
                up >>= 1
                tree[rows, up] = np.minimum(tree[rows, 2 * up], tree[rows, 2 * up + 1])
        there = ids >= 0
        data, ends = ids[there].astype(np.int32).tobytes(), np.cumsum(there.sum(axis=1) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token's bytes, after all merges."""
        return list(array("i", self.merge_many([data])[0])) if data else []

    def _tokens(self, text: str) -> list[str | int]:
        """Pre-tokens, and the ids of special strings."""
        if self.special is None or not self.special.search(text):
            return PRE_TOKEN.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += PRE_TOKEN.findall(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + PRE_TOKEN.findall(text[at:])

    def _codes(self, keys: list[bytes]) -> list[bytes]:
        """Ids of each piece, as 32-bit integers."""
        texts = [k.decode() for k in keys]
        special = self.special.search if self.special is not None and self.special.search("\n".join(texts)) else None
        joined = [i for i, t in enumerate(texts) if P.alone(t) and not (special and special(t))]
        rest = sorted({*range(len(texts))} - {*joined}) if len(joined) < len(texts) else []
        out = [b""] * len(texts)
        if joined:
            tokens = pa.array(PRE_TOKEN.findall("\n".join([texts[i] for i in joined]))).cast(pa.binary()).dictionary_encode()
            known, index = tokens.dictionary.to_pylist(), tokens.indices.to_numpy()
            found = self.pre_memo.values(known)
            sizes = np.fromiter(map(len, found), np.int64, len(found))[index]
            feeds = np.flatnonzero(index == known.index(b"\n")) if len(joined) > 1 else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            starts, stops = ends[np.concatenate([[0], feeds + 1])].tolist(), ends[np.append(feeds, len(index))].tolist()
            data = _gathered(pa.array(found, pa.binary()).take(tokens.indices))
            for i, a, b in zip(joined, starts, stops, strict=True):
                out[i] = data[a:b]
        cut = [[t.encode() if isinstance(t, str) else t for t in self._tokens(texts[i])] for i in rest]
        wanted = list(dict.fromkeys(t for c in cut for t in c if isinstance(t, bytes)))
        ids = dict(zip(wanted, self.pre_memo.values(wanted), strict=True))
        for i, c in zip(rest, cut, strict=True):
            out[i] = b"".join([ids[t] if isinstance(t, bytes) else array("i", [t]).tobytes() for t in c])
        return out

    def codes(self, texts: pa.Array, batch_bytes: int = BATCH_BYTES) -> tuple[pa.Array, pa.Array]:
        """(lists of ids, the texts that they decode to) of ``texts``; equal pieces are merged once."""
        made, sizes = [], np.zeros(len(texts), np.int64)
        for block in P.blocks(texts, batch_bytes):
            found = self.memo.values(block.keys)
            made.append(_gathered(pa.array(found, pa.binary()).take(block.index)))
            first = int(block.owner[0])
            each = np.fromiter(map(len, found), np.int64, len(found))[block.index.to_numpy()]
            n = np.bincount(block.owner - first, each).astype(np.int64)
            sizes[first : first + len(n)] += n // 4
        ids = np.frombuffer(b"".join(made), np.int32)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
        return lists, self._decoded(ends, ids)

    def _decoded(self, ends: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The texts of ``ids`` cut at ``ends``; what isn't UTF-8 is replaced."""
        bounds = np.concatenate([[0], np.cumsum(self.token_sizes[ids])])[ends]
        return _strings(bounds, _gathered(self.token_bytes.take(pa.array(ids))))

    def encode(self, text: str) -> list[int]:
        return self.codes(pa.array([text]))[0][0].as_py()

    def decode(self, ids: Iterable[int]) -> str:
        ids = np.fromiter(ids, np.int32)
        return self._decoded(np.array([0, len(ids)]), ids)[0].as_py()


def _gathered(values: pa.Array) -> bytes:
    """The bytes of all values, one after another."""
    _, ends, data = values.buffers()
    bounds = np.frombuffer(ends, np.int32)[values.offset : values.offset + len(values) + 1]
    return data[int(bounds[0]) : int(bounds[-1])].to_pybytes() if data is not None else b""


def _strings(ends: np.ndarray, data: bytes) -> pa.Array:
    """``data`` cut at ``ends``, as text; what isn't UTF-8 is replaced."""
    out = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)], pa.string())
    return out


def _some(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, number) of texts side by side of ``most`` bytes or one text, so that what is made of them stays bounded."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, done = 0, 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, end - at
        at, done = end, int(ends[end - 1])


def _coded(docs: DataFrame, path: str, batch_bytes: int, shape: Callable[[pa.Array, pa.Array], list], schema: str, names: list[str]) -> DataFrame:
    """doc_id, and what ``shape`` makes of the ids and decoded texts of each row."""
    spark = docs.sparkSession
    ship(spark)
    with open(path, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(content.value)
        if key not in _codecs:
            _codecs[key] = Codec(content.value)
        for batch in batches:
            for at, n in _some(batch.column(1), 4 * batch_bytes):
                made = shape(*_codecs[key].codes(batch.column(1).slice(at, n), batch_bytes))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *made], names=["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    return rows.mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, ids, decoded) of each row of ``docs``: token ids, and the text that the ids decode to.

    ``path``: a byte-level BPE vocabulary (.json), sent in a broadcast that the file's
    size bounds. Special strings inside texts become their own ids, nothing else
    is added. Null and empty texts have no ids. Equal rows stay separate rows,
    doc_id may be null. Other columns of ``docs`` are not read.
    """
    return _coded(docs, path, batch_bytes, lambda ids, decoded: [ids, decoded], "doc_id long, ids array<int>, decoded string", ["ids", "decoded"])


def _digested(ids: pa.Array, decoded: pa.Array) -> list[pa.Array]:
    said = pc.binary_join(ids.cast(pa.list_(pa.string())), ",")
    sha = [[hashlib.sha256(memoryview(x.as_buffer())).hexdigest() for x in column.cast(pa.binary())] for column in (said, decoded)]
    return [pc.list_value_length(ids).cast(pa.int64()), pa.array(sha[0], pa.string()), pa.array(sha[1], pa.string())]


def digests(docs: DataFrame, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what ``encoded`` returns, made where the ids are."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _coded(docs, path, batch_bytes, _digested, schema, ["n_tokens", "ids_sha256", "decoded_sha256"])
