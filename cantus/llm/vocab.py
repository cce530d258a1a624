"""Fixed vocabularies in tasks: reading their files, and ids of many texts at once.

Texts of a batch lie in one buffer of bytes. They are cut where no token can cross, each distinct
piece is encoded once, and the ids of all pieces are gathered by number, so that work in Python follows
the distinct pieces and not the words.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about so many bytes; one longer text is a slice of its own.
SLICE = 4_000_000
SPACE = 32
MARK = "▁"


def contents(path: str) -> bytes:
    """A vocabulary file, read on the driver; tasks get the bytes, not the path."""
    with open(path, "rb") as f:
        return f.read()


def text_slices(texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """lo, hi, bytes and offsets of consecutive texts; nulls are empty. Offsets start at 0. A slice has ``size`` bytes (SLICE if not given)."""
    size = size or SLICE
    texts = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1))
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spaced(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with a space before each that isn't empty: bytes and offsets."""
    some = at[1:] > at[:-1]
    return np.insert(data, at[:-1][some], SPACE), at + np.concatenate([[0], np.cumsum(some)])


def texts_of(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The texts as an Arrow column."""
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data))


class Memo:
    """Ids of pieces of bytes. Distinct pieces are encoded once and their ids remembered as bytes; past ``room`` pieces or ``size`` bytes those not seen since the last time are forgotten."""

    def __init__(self, encode: Callable[[list[bytes]], list], room: int = 150_000, size: int = 8_000_000):
        self.encode, self.room, self.size, self.known, self.older, self.held = encode, room, size, {}, {}, 0

    def __call__(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and where each piece's ids begin, one place more at the end."""
        n = len(cuts) - 1
        if n <= 0:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(data)]).dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.known) > self.room or self.held > self.size:
            self.known, self.older, self.held = {}, self.known, 0
        fresh = [p for p in pieces if p not in self.known]
        new = [p for p in fresh if p not in self.older]
        self.known.update((p, self.older[p]) for p in fresh if p in self.older)
        self.known.update((p, array("i", x).tobytes()) for p, x in zip(new, self.encode(new), strict=True))
        self.held += sum(map(len, fresh))
        ids = [self.known[p] for p in pieces]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        begin, which = np.cumsum(size) - size, coded.indices.to_numpy()
        at = np.concatenate([[0], np.cumsum(size[which])])
        return flat[np.repeat(begin[which] - at[:-1], size[which]) + np.arange(at[-1])], at


def joined(entries: pa.Array, ids: np.ndarray) -> np.ndarray:
    """Bytes of the entries of a binary column, one after another."""
    raw = entries.take(pa.array(ids)).buffers()[2] if len(ids) else None
    return np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a message's fields in the protocol-buffer wire format."""
    i = 0

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            c = b[i]
            i, out, shift = i + 1, out | (c & 127) << shift, shift + 7
            if c < 128:
                return out

    while i < len(b):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
        else:
            n = number() if kind == 2 else {1: 8, 5: 4}[kind]
            i += n
            yield field, b[i - n : i]


@dataclass
class PieceModel:
    """A model file of pieces and scores whose pieces are merged pair by pair."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]  # fixed values: 1 normal, 2 unknown, 3 control, 4 user's own, 5 unused, 6 byte
    prefix: bool  # a mark stands before the text
    unknown: str  # what an unknown id is decoded to


def read_pieces(model: bytes) -> PieceModel:
    """Reads a model. Only merge-type ones that leave texts as they are, but for the mark, are taken; others raise ValueError."""
    pieces, scores, kinds, train, norm = [], [], [], {}, {}
    for field, value in _fields(model):
        if field == 1:
            p = dict(_fields(value))
            pieces.append(p.get(1, b"").decode())
            scores.append(float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0]))
            kinds.append(p.get(3, 1))
        elif field == 2:
            train = dict(_fields(value))
        elif field == 3:
            norm = dict(_fields(value))
    # fixed values: fields 3 and 35 of the training part (2: merges), 2 to 5 of the normaliser
    wrong = {
        "no merges": train.get(3, 1) != 2,
        "no bytes for unknown characters": not train.get(35, 0),
        "texts are rewritten": bool(norm.get(2, b"")),
        "spaces are removed": bool(norm.get(4, 1)),
        "spaces stay": not norm.get(5, 1),
        "pieces of the user or unused ones": bool({4, 5} & set(kinds)),
    }
    if any(wrong.values()):
        raise ValueError("not a model that can be read: " + ", ".join(k for k, v in wrong.items() if v))
    return PieceModel(pieces, scores, kinds, bool(norm.get(3, 1)), train.get(44, " ⁇ ".encode()).decode())
