"""Encoding to and decoding from a merge-type vocabulary of pieces, by an agenda of adjacent pairs ordered by score.

A text's symbols are its characters, a space being the mark. All adjacent pairs that make a piece
wait in a heap, the best score first, the leftmost of equals; the first is merged and makes two new pairs with its neighbours.
What no piece covers becomes bytes. Where two neighbouring characters stand side by side in no
piece of the vocabulary, no pair can ever cross: texts are cut there, and each distinct part has its own agenda, once.
Results are compared with the sentencepiece library's for every text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantus.llm import vocab as V

MARK = V.MARK


@lru_cache(1)
def encoder_of(model: bytes) -> Encoder:
    """The encoder of a model, kept with what it remembers while a worker lives."""
    return Encoder(model)


class Encoder:
    """Ids of texts and texts of ids, for batches."""

    def __init__(self, model: bytes):
        m = V.read_pieces(model)
        self.prefix, self.kinds, self.unknown = m.prefix, np.array(m.kinds), m.unknown
        self.ids = {p: i for i, p in enumerate(m.pieces) if m.kinds[i] == 1}
        self.cost = {p: -m.scores[i] for p, i in self.ids.items()}
        self.bytes = [0] * 256
        entries = []
        for i, (p, kind) in enumerate(zip(m.pieces, m.kinds, strict=True)):
            if kind == 6:
                self.bytes[int(p[3:5], 16)] = i
            entries.append({1: lambda p=p: p.replace(MARK, " ").encode(), 2: m.unknown.encode, 3: bytes, 6: lambda p=p: bytes([int(p[3:5], 16)])}[kind]())
        self.entries, self.size = pa.array(entries, pa.large_binary()), np.array([len(e) for e in entries])
        self.marked = np.array([p.startswith(MARK) and k == 1 for p, k in zip(m.pieces, m.kinds, strict=True)])
        self.beside = np.zeros(256 * 256, bool)  # pairs of bytes that some piece has side by side
        for p in self.ids:
            b = np.frombuffer(p.replace(MARK, " ").encode(), np.uint8).astype(int)
            self.beside[b[:-1] * 256 + b[1:]] = True
        self.memo = V.Memo(lambda parts: [self.merged(p.decode().replace(" ", MARK)) for p in parts])

    def merged(self, text: str) -> list[int]:
        """Ids of one marked part of a text."""
        cost, sym = self.cost.get, list(text)
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(c, i, i + 1, 2) for i, pair in enumerate(map(add, sym, sym[1:])) if (c := cost(pair)) is not None]
        heapify(agenda)
        while agenda:
            _, i, j, size = heappop(agenda)
            one, two = sym[i], sym[j]
            if not one or not two or len(one) + len(two) != size:
                continue  # one of the two has been merged since
            sym[i], sym[j] = one + two, ""
            k, h = right[j], left[i]
            right[i] = k
            if k < n:
                left[k] = i
                c = cost(sym[i] + sym[k])
                if c is not None:
                    heappush(agenda, (c, i, k, size + len(sym[k])))
            if h >= 0:
                c = cost(sym[h] + sym[i])
                if c is not None:
                    heappush(agenda, (c, h, i, len(sym[h]) + size))
        out = []
        for s in sym:
            if s:
                k = self.ids.get(s)
                out += [self.bytes[b] for b in s.encode()] if k is None else [k]
        return out

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie in ``data``, and where each text's begin."""
        raw = data.tobytes()
        if MARK.encode() in raw:  # a mark in a text is as good as a space
            texts = pc.replace_substring(V.texts_of(data, at), MARK, " ")
            _, _, data, at = next(whole(texts))
        if self.prefix:
            data, at = V.spaced(data, at)
        heads = np.zeros(len(data), bool)
        if len(data):  # no cut inside of a character
            heads[1:] = ~self.beside[data[:-1].astype(np.int64) * 256 + data[1:]] & (data[1:] & 0xC0 != 0x80)
        heads[at[:-1][at[:-1] < at[1:]]] = True
        cuts = np.concatenate([np.flatnonzero(heads), [len(data)]])
        ids, begin = self.memo(data, cuts)
        return ids, begin[np.searchsorted(cuts, at)]

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> pa.Array:
        """Texts of ids. The first mark is no space; bytes that are no characters become U+FFFD each."""
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data, at = V.joined(self.entries, ids), ends[begin]
        if self.prefix:
            shown = np.flatnonzero(self.kinds[ids] != 3)  # control ids are nothing
            first = np.searchsorted(shown, begin[:-1])
            first = np.where(first < len(shown), shown[np.minimum(first, max(len(shown) - 1, 0))] if len(shown) else 0, len(ids))
            has = first < begin[1:]
            has[has] = self.marked[ids[first[has]]]
            data, at = np.delete(data, ends[first[has]]), at - np.concatenate([[0], np.cumsum(has)])
        out = V.texts_of(data, at)
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            out = pa.array([self.told(ids[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.large_string())
        return out

    def told(self, ids: np.ndarray) -> str:
        """Text of one list of ids some of whose bytes are no characters."""
        out, held, first, entries = [], b"", self.prefix, self.entries

        def flush(held: bytes) -> Iterator[str]:
            while held:
                n = next((n for n in (1, 2, 3, 4) if _character(held[:n])), 0)
                yield held[:n].decode() if n else "�"
                held = held[n or 1 :]

        for i in ids:
            if self.kinds[i] == 6:
                held += entries[int(i)].as_py()
                continue
            out += flush(held)
            first, held = first and not held, b""
            text = entries[int(i)].as_py().decode()
            if text:
                out.append(text[1:] if first and self.marked[i] else text)
                first = False
        return "".join([*out, *flush(held)])


def _character(b: bytes) -> bool:
    try:
        return len(b.decode()) == 1
    except UnicodeDecodeError:
        return False


def whole(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """All texts as one slice."""
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    yield 0, len(texts), raw[off[0] : off[-1]], off - off[0]


def agreeing(library, texts: pa.Array, ids: np.ndarray, begin: np.ndarray, decoded: pa.Array) -> np.ndarray:
    """Which texts the library encodes to the same ids and decodes to the same text."""
    theirs = library.encode(texts.to_pylist(), num_threads=1)
    size = np.fromiter(map(len, theirs), np.int64, len(theirs))
    same = size == np.diff(begin)
    if same.all():  # compared at once
        flat = np.fromiter(chain.from_iterable(theirs), np.int32, int(size.sum()))
        wrong = np.concatenate([[0], np.cumsum(flat != ids)])
        same &= wrong[begin[1:]] == wrong[begin[:-1]]
    else:
        same &= [x == y.tolist() for x, y in zip(theirs, np.split(ids, begin[1:-1]), strict=True)]
    return same & pc.equal(pa.array(library.decode(theirs, num_threads=1), pa.large_string()), decoded).to_numpy(zero_copy_only=False)


def round_trip(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ids (array), decoded (their text again) and agrees (the library gives the same ids and text) of each row.

    ``model`` is the path of a model file. Null and empty texts have no ids and decode to the empty text.
    Texts of any length are taken whole; one without spaces is one agenda. Equal rows give equal rows; an empty table gives an
    empty table; other columns of ``docs``, whatever their names, play no part.
    """
    raw = docs.sparkSession.sparkContext.broadcast(V.contents(model))  # a fixed file of some 100 kB
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["kept"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()), T.StructField("agrees", T.BooleanType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        own, library = encoder_of(raw.value), sentencepiece.SentencePieceProcessor(model_proto=raw.value)
        for b in batches:
            for lo, hi, data, at in V.text_slices(b.column("text")):
                ids, begin = own.encode(data, at)
                decoded = own.decode(ids, begin)
                same = agreeing(library, V.texts_of(data, at), ids, begin, decoded)
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("kept")[lo:hi], lists, decoded.cast(pa.string()), pa.array(same)], names=["kept", "ids", "decoded", "agrees"])

    return rows.mapInArrow(work, schema).select("kept.*", "ids", "decoded", "agrees")
