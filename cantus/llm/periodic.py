"""Runs: stretches of words that repeat with a period, found on the diagonals of earlier occurrences.

The word at i and an earlier occurrence of it at i - q lie on diagonal q. A diagonal's match length is that of
the word before plus one; when a word doesn't go on, the diagonal ends, and if it was long enough its run is emitted there and then.

The table is sparse. A period q between 2**k and 2**(k + 1) needs a diagonal of at least 3 * 2**k matches (of 5 for q = 1), so in band k only
occurrences count whose last 3 * 2**k words are the same, and of these only the latest: if another one
follows within the band, or a shorter lag exists, both lags are periods of those words and, as the words are at
least as many as both together, so is their common divisor; then no run has such a lag as its smallest
period. That leaves one lag at most for each word and band, so a text of n words costs n log n at the most, however often it repeats a
word. Contexts are compared by exact numbers, made from those of their halves; words whose context stands once in a text leave first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantus.llm.vocab import text_slices, texts_of

#: A run has LEAST words and POWER times its period at least.
LEAST, POWER = 6, 4
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each text's words begin, one place more at the end, and all words; they stand between spaces and controls 9 to 13."""
    parts = pc.split_pattern_regex(texts, r"[ \t\n\x0b\f\r]+")
    words, at = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    some = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(some)])[at - at[0]], words.filter(pa.array(some))


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each key, and which keys stand more than once."""
    _, name, times = np.unique(keys, return_inverse=True, return_counts=True)
    return name, times[name] > 1


class Contexts:
    """Numbers of all stretches of words of some length that stand more than once in their text: equal if the stretches are."""

    def __init__(self, words: np.ndarray, at: np.ndarray):
        """``words`` are numbers of words of all texts, ``at`` is where texts begin."""
        self.n = len(words)
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.end = at[1:][text] if self.n else text  # of each word's text
        self.by = {1: self._kept(np.arange(self.n), text * (int(words.max(initial=0)) + 1) + words)}

    def _kept(self, where: np.ndarray, keys: np.ndarray) -> np.ndarray:
        name, again = _named(keys)
        full = np.full(self.n, -1, np.int64)
        full[where[again]] = name[again]
        return full

    def pairs(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a stretch of ``a`` words and then one of ``b`` begin inside of a text, and a key of both."""
        one, two = self.by[a], self.by[b]
        where = np.flatnonzero(one >= 0)
        where = where[where + a + b <= self.end[where]]
        where = where[two[where + a] >= 0]
        return where, one[where] * (int(two.max(initial=0)) + 1) + two[where + a]

    def reach(self, size: int) -> None:
        """Numbers stretches of ``size`` words, a power of two, from those of half as many; shorter ones than a quarter are let go."""
        if size not in self.by:
            self.reach(size // 2)
            self.by[size] = self._kept(*self.pairs(size // 2, size // 2))
            self.by = {k: v for k, v in self.by.items() if k * 4 >= size}


def find_runs(words: np.ndarray, at: np.ndarray, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and smallest period of all runs, by text, start and period. ``least`` is 6 or more, ``power`` 4 or more."""
    seen, found, band = Contexts(words, at), [], 1
    longest = int(np.diff(at).max(initial=0))
    while power * band <= longest:
        a, b = (2 * band, band) if band > 1 else (4, 1)
        seen.reach(a)
        where, key = seen.pairs(a, b)
        if not len(where):
            break
        context = a + b
        # the latest earlier occurrence of each context
        order = np.argsort(key, kind="stable")
        lag = np.zeros(seen.n + 1, np.int64)
        again = np.flatnonzero(key[order][1:] == key[order][:-1]) + 1
        lag[where[order[again]]] = where[order[again]] - where[order[again - 1]]
        lag[(lag < band) | (lag >= 2 * band)] = 0
        # match lengths on the diagonals: consecutive words with the same lag
        begin = np.flatnonzero((lag != 0) & (lag != np.concatenate([[0], lag[:-1]])))
        stop = np.flatnonzero((lag[:-1] != 0) & (lag[:-1] != lag[1:])) + 1
        q = lag[begin]
        length = stop - begin + context - 1 + q
        ok = length >= np.maximum(least, power * q)
        found.append(np.stack([begin[ok] - q[ok], length[ok], q[ok]]))
        band *= 2
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    text = np.searchsorted(at, start, "right") - 1
    order = np.lexsort((period, start))
    text, start, length, period = (x[order] for x in (text, start, length, period))
    return text, start - at[text], length, period


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, power: int = POWER) -> DataFrame:
    """The columns ``keep``, n_words, runs (array of start, length, period) and collapsed of each row.

    A run is a stretch of words with smallest period ``period``, of ``least`` words and ``power`` periods at least, that neither neighbour
    makes longer; ``start`` counts words from 0, and runs stand by start, then period. ``collapsed`` is the text without words that
    any run holds after its first period, joined by one space. Null, empty and blank texts have no words, no runs and collapse to the
    empty text. Texts of any length are taken whole, in one task each. Equal rows give equal rows, an empty table an empty one;
    other columns of ``docs``, whatever their names, play no part.
    """
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["kept"], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, begin in text_slices(b.column("text")):
                at, words = split_words(texts_of(data, begin))
                numbers = words.dictionary_encode().indices.to_numpy().astype(np.int64)
                doc, start, length, period = find_runs(numbers, at, least, power)
                # a word goes if more runs have begun to repeat than have ended before it
                depth = np.zeros(len(numbers) + 1, np.int64)
                np.add.at(depth, at[doc] + start + period, 1)
                np.add.at(depth, at[doc] + start + length, -1)
                stay = np.cumsum(depth[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(stay)])[at]
                short = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(stay)).cast(pa.string())), " ")
                runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)), pa.int32()), runs)
                yield pa.RecordBatch.from_arrays([b.column("kept")[lo:hi], pa.array(np.diff(at)), runs, short], names=["kept", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(work, schema).select("kept.*", "n_words", "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period; the smallest start, then period, of equals. Null without runs."""
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"] / r["period"]).alias("e"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    return F.struct(best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"))


def replayed(text: Column, h: Column) -> Column:
    """Where ``h`` is a multiple of 10: the words of the text, of which those from a place on repeat a few times; else the text itself.

    Word i >= a becomes word a + (i - a) % p, where g = h / 10, a = g % n and p = 1 + (n - a) / (3 + g % 8), all whole numbers.
    """
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def changed(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = F.pmod(g, n).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")

    again = F.transform(F.array(words), changed)[0]  # words are bound once, not spelled out at each use
    return F.when((h % 10 == 0) & (F.size(words) > 0), again).otherwise(text)
