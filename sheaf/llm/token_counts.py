"""Token counts of whole texts by batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces as P
from ..shipping import ship
from .common import whole

#: Bytes encoded at a time; longer texts are split at safe places.
BATCH_BYTES = 1 << 21
#: Bytes of pieces and lengths remembered in each of two generations.
MEMO_BYTES = 96 << 20
#: Pieces encoded in one text.
JOINED = 2_000

_counters: dict[int, TokenCounter] = {}


class TokenCounter:
    """Lengths of encodings without begin, end or added special tokens."""

    def __init__(self, content: bytes, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if kind == "json":
            from tokenizers import Tokenizer

            text = content.decode()
            self.tokenizer = Tokenizer.from_str(text)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self.split = P.splittable(P.load(text))
            self.memo = P.Memo(self._piece_lengths, MEMO_BYTES)
            self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        elif kind == "model":
            from sentencepiece import SentencePieceProcessor

            self.tokenizer = SentencePieceProcessor(model_proto=content)
            self.split = False
        else:
            raise ValueError(f"a tokenizer file is .json or .model, not .{kind}")
        self.kind = kind

    def _lengths(self, texts: list[str]) -> list[int]:
        if self.kind == "model":
            return list(map(len, self.tokenizer.encode(texts, num_threads=1)))
        return list(map(len, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)))

    def _piece_lengths(self, keys: list[bytes]) -> list[int]:
        """As _lengths, of pieces; many are encoded in one text, between line feeds."""
        texts = [k.decode() for k in keys]
        out = [0] * len(texts)
        joined = [i for i, t in enumerate(texts) if P.alone(t)] if len(self.line_feed) == 1 else []
        rest = sorted({*range(len(texts))} - {*joined})
        for lo in range(0, len(joined), JOINED):
            part = joined[lo : lo + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join([texts[i] for i in part])], add_special_tokens=False)[0].ids, np.int64)
            ends = np.append(np.flatnonzero(ids == self.line_feed[0]), len(ids))
            for i, n in zip(part, np.diff(ends, prepend=-1) - 1, strict=True):
                out[i] = int(n)
        for i, n in zip(rest, self._lengths([texts[i] for i in rest]), strict=True):
            out[i] = n
        return out

    def counts(self, texts: pa.Array, batch_bytes: int = BATCH_BYTES) -> np.ndarray:
        """Tokens of each text. Equal pieces of a batch are encoded once."""
        out = np.zeros(len(texts), np.int64)
        if self.split:
            for block in P.blocks(texts, batch_bytes):
                lengths = np.array(self.memo.values(block.keys), np.int64)[block.index.to_numpy()]
                first = int(block.owner[0])
                found = np.bincount(block.owner - first, lengths).astype(np.int64)
                out[first : first + len(found)] += found
            return out
        sizes = pc.binary_length(texts).to_numpy()
        at = 0
        while at < len(texts):  # batches balanced by bytes, of whole texts
            end, size = at, 0
            while end < len(texts) and (end == at or size + sizes[end] <= batch_bytes):
                size += sizes[end]
                end += 1
            out[at:end] = self._lengths(texts.slice(at, end - at).to_pylist())
            at = end
        return out


def count_tokens(docs: DataFrame, path: str, limit: int = 512, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs``.

    ``path``: a vocabulary file of tokenizers (.json) or sentencepiece (.model); its
    content goes to the executors in a broadcast, which the file's size bounds.
    Special strings inside texts are handled as the library's default; nothing is
    truncated or padded. Null and empty texts have no tokens. Equal rows stay
    separate rows, doc_id may be null. Texts of a .json file that allows it are cut at
    safe places into batches of ``batch_bytes``; a .model file gets whole texts.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = path.rsplit(".", 1)[-1]
    with open(path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(content.value)
        if key not in _counters:
            _counters[key] = TokenCounter(content.value, kind)
        for batch in batches:
            n = _counters[key].counts(batch.column(2), batch_bytes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = whole(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    found = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
