"""Texts as pieces that a byte-level BPE tokenizer encodes alone just as it does in the text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

SPACE = 0x20
#: White space of one byte, and the separators that count as such in Python.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Longer pieces aren't remembered; what an entry of a Memo takes besides its bytes.
LONGEST, ENTRY = 64, 200


def splittable(spec: dict) -> bool:
    """Whether a tokenizer file has nothing that reaches over the places of ``cuts``."""
    pre = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")) and not re.search(r"\s", t["content"]) for t in added)
    return (
        spec.get("normalizer") is None
        and spec.get("post_processor") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and plain
    )


def _wide(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether three bytes are a white space character of UTF-8."""
    general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    return general | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))


def _narrow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == 0xC2) & ((b == 0x85) | (b == 0xA0))


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sorted places at which UTF-8 texts can be cut: their ``bounds``, and single spaces between other characters.

    The byte-level pattern gives a single space between characters that are not white
    space to the pre-token that follows it, and only runs of white space look at what
    comes after them, so nothing reaches over the place before such a space.
    """
    at = np.flatnonzero(data == SPACE)
    at = at[(at > 0) & (at < len(data) - 1)]
    for edge in (bounds, bounds - 1):  # the neighbours belong to the same text
        if len(at):
            found = np.minimum(np.searchsorted(at, edge), len(at) - 1)
            at = np.delete(at, found[at[found] == edge])
    at = at[~(_BLANK[data[at - 1]] | _BLANK[data[at + 1]])]
    far = np.minimum(at[:, None] + np.arange(1, 4), len(data) - 1)
    near = np.maximum(at[:, None] - np.arange(3, 0, -1), 0)
    a, b, c = data[far].T
    x, y, z = data[near].T
    at = at[~(_wide(a, b, c) | _narrow(a, b) | _wide(x, y, z) | _narrow(y, z))]
    found = np.sort(np.concatenate([bounds, at]), kind="stable")
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def alone(piece: str) -> bool:
    """Whether a piece is encoded between line feeds as it is alone: it holds none, and touches them with no white space but one space in front."""
    head = piece[1:2] if piece[:1] == " " else piece[:1]
    return "\n" not in piece and not head.isspace() and not piece[-1:].isspace() and head != ""


class Block:
    """Pieces side by side: their distinct values, and for each piece its value and its text."""

    def __init__(self, data: pa.Buffer, places: np.ndarray, owner: np.ndarray):
        pieces = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(places.astype(np.int32)), data])
        coded = pieces.dictionary_encode()
        self.keys: list[bytes] = coded.dictionary.to_pylist()
        self.index, self.owner = coded.indices, owner


def blocks(texts: pa.Array, most: int) -> Iterator[Block]:
    """The pieces of all ``texts``, in order, in blocks of about ``most`` bytes.

    Blocks are balanced by bytes; a long text spreads over several, and only a piece
    that can't be cut is larger than one. Empty texts have no pieces.
    """
    texts = texts.cast(pa.string())
    _, ends, data = texts.buffers()
    bounds = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or bounds[0] == bounds[-1]:
        return
    view = np.frombuffer(data, np.uint8)
    lo = 0
    while lo < len(texts):  # places are made for some texts at a time
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + 8 * most, "right")) - 1)
        start, end = int(bounds[lo]), int(bounds[hi])
        places = cuts(view[start:end], bounds[lo : hi + 1] - start) + start
        owner = np.searchsorted(bounds[lo : hi + 1], places[:-1], "right") - 1 + lo
        first = 0
        while first < len(owner):
            last = max(first + 1, int(np.searchsorted(places, places[first] + most, "right")) - 1)
            yield Block(data, places[first : last + 1], owner[first:last])
            first = last
        lo = hi


class Memo:
    """What was made of keys lately: two generations of ``most`` bytes or so, the older one is dropped whole."""

    def __init__(self, make: Callable[[list[bytes]], list], most: int, size: Callable[[Any], int] = lambda value: 0):
        self.make, self.most, self.size = make, most, size
        self.young, self.old, self.held = {}, {}, 0

    def values(self, keys: list[bytes]) -> list:
        """The value of each of the distinct ``keys``; keys over LONGEST bytes are not remembered."""
        out = list(map(self.young.get, keys))
        missing = [i for i, v in enumerate(out) if v is None]
        if not missing:
            return out
        if self.held > self.most:
            self.old, self.young, self.held = self.young, {}, 0
        fresh = []
        for i in missing:
            if (v := self.old.get(keys[i])) is None:
                fresh.append(i)
            else:
                out[i] = v
                self._keep(keys[i], v)
        for i, v in zip(fresh, self.make([keys[i] for i in fresh]), strict=True):
            out[i] = v
            if len(keys[i]) <= LONGEST:
                self._keep(keys[i], v)
        return out

    def _keep(self, key: bytes, value: Any) -> None:
        self.young[key] = value
        self.held += ENTRY + len(key) + self.size(value)


def load(content: str) -> dict:
    return json.loads(content)
