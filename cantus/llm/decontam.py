"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of words, weighted by TF-IDF over hashed words, and put
into a latent space by a randomised singular value decomposition that Spark
tasks compute on all passages. Windows of documents are compared with benchmark
items by cosine there; candidates are then checked on the words: the longest
common subsequence with the item, and, for paraphrases, its answer part.

What passes that check has at least a share PARAPHRASE of the item's words, so
that some of the item's rarest words must stand near each other. An inverted
list of these words finds the places where they do; windows elsewhere can't
pass, whatever their cosine, and are not compared. This changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantus.llm.bytesoup import Slice, slices

DIMS = 1 << 14
RANK = 64
#: Each task of the fit sends a table of DIMS rows at most, so many to a row.
BUCKETS_A_BLOCK = 64
#: Windows are as long as an item, rounded up to one of these, and start at each quarter of that.
LENGTHS = (8, 12, 16, 24, 32, 48, 64, 96, 128)
COSINE = 0.1
#: Share of an item's words in their order that says copied; and the lower share that does with its answer part.
COPIED, PARAPHRASE, ANSWER = 0.75, 0.6, 0.8
#: Items of fewer words are found only as they are, all words in a row.
LEAST_WORDS = 5
#: So many of an item's rarest words, as a share of it, must stand near each other.
NEAR = 0.15
#: The benchmark's words are counted in the corpus if there are so many at most; beyond that, their buckets order them. Any order gives the same results.
COUNTED = 2_000_000
#: Items are held by each task in blocks of so many.
BLOCK = 50_000


def buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(50)).astype(np.int64)


@dataclass
class Space:
    idf: np.ndarray
    basis: np.ndarray  # DIMS x RANK, rows already weighted by idf
    words: np.ndarray  # sorted hashes of the benchmark's words
    times: np.ndarray  # how often each is in all documents

    def often(self, h: np.ndarray) -> np.ndarray:
        """How often words of the benchmark are in all documents; those that weren't counted come last, by their bucket."""
        at = np.minimum(np.searchsorted(self.words, h), max(0, len(self.words) - 1))
        known = self.words[at] == h if len(self.words) else np.zeros(len(h), bool)
        return np.where(known, self.times[at] if len(self.words) else 0, 1e15 - self.idf[buckets(h)])

    def running(self, b: np.ndarray) -> np.ndarray:
        """Sums of the weighted basis rows of all words before each."""
        total = np.zeros((len(b) + 1, self.basis.shape[1]), np.float32)
        np.cumsum(self.basis[b], axis=0, out=total[1:], dtype=np.float32)
        return total

    @staticmethod
    def vectors(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unit vectors of the passages from start to end."""
        v = total[end] - total[start]
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)
    step = max(1, size // 4)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - size) // step)), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, first[text] + k * step


def passage_counts(shared):
    """Texts to kind, key, n, summed by task. Kind 0: passages of 64 words that hold a word of the bucket ``key``, -1 for all passages; kind 1: occurrences of the benchmark's word of that number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        total, passages, times = np.zeros(DIMS + 1, np.int64), 0, np.zeros(len(words) + 1, np.int64)
        for b in batches:
            for s in slices(b.column("text")):
                h, n = s.hashes(), np.diff(s.first)
                rows = -(-n // 64)
                # each passage is a row of 64 numbers; DIMS stands where it has no word
                place = np.arange(n.sum()) + np.repeat((np.cumsum(rows) - rows) * 64 - s.first[:-1], n)
                table = np.full(int(rows.sum()) * 64, DIMS, np.uint16)
                table[place] = buckets(h)
                table = np.sort(table.reshape(-1, 64), axis=1)
                new = np.ones(table.shape, bool)
                new[:, 1:] = table[:, 1:] != table[:, :-1]
                total += np.bincount(table[new], minlength=DIMS + 1)
                passages += len(table)
                if len(words):
                    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                    times += np.bincount(at[words[at] == h], minlength=len(times))
        own = np.flatnonzero(times)
        key = np.concatenate([np.arange(-1, DIMS), own])
        kind = np.repeat(np.array([0, 1], np.int32), [DIMS + 1, len(own)])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(np.concatenate([[passages], total[:DIMS], times[own]]))], names=["kind", "key", "n"])

    return work


def item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in slices(b.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(s.hashes()).view(np.int64))], names=["word"])


def corpus_counts(docs: DataFrame, items: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """idf of each bucket over the passages of all documents, and how often the words of the benchmark are in these; DIMS + COUNTED numbers at most come to the driver."""
    words = items.select("text").mapInArrow(item_words, "word bigint").distinct()
    words = np.sort(np.array([r["word"] for r in words.collect()], np.int64).view(np.uint64)) if words.count() <= COUNTED else np.zeros(0, np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    n, times = np.zeros(DIMS + 1), np.zeros(len(words))
    for r in docs.select("text").mapInArrow(passage_counts(shared), "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect():
        if r["kind"]:
            times[r["key"]] = r["n"]
        else:
            n[r["key"] + 1] = r["n"]
    # squared, so that rare words outweigh the many common ones of a window
    return np.log((n[0] + 1) / (n[1:] + 1)) ** 2 + 0.01, words, times


def spread(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The start of the decomposition: each bucket's column and sign."""
    r = np.random.default_rng(3)
    return r.integers(0, width, DIMS), r.choice(np.array([-1.0, 1.0]), DIMS)


def passage_products(shared):
    """Texts to block, v: A'A times spread(), summed over all passages of 64 words of the task; v has the rows of BUCKETS_A_BLOCK buckets.

    A row of A is a passage's TF-IDF at length 1. The idf of the bucket in A' is left out here: it is the same for all passages.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, column, sign, width = shared.value
        weight, total, any_rows = sign * idf, np.zeros((width, DIMS)), False
        for b in batches:
            for s in slices(b.column("text")):
                bucket, n = buckets(s.hashes()).astype(np.uint16), np.diff(s.first)
                if not len(bucket):
                    continue
                any_rows, rows = True, -(-n // 64)
                passage = (np.arange(len(bucket)) + np.repeat((np.cumsum(rows) - rows) * 64 - s.first[:-1], n)) >> 6
                z = np.bincount(passage * width + column[bucket], weights=weight[bucket], minlength=int(rows.sum()) * width).reshape(-1, width)
                # words by bucket, and so each passage's repeats of it side by side
                order = np.argsort(bucket, kind="stable")
                of, at = bucket[order], passage[order]
                first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1])]))
                times = np.diff(np.append(first, len(of)))
                norm = np.bincount(at[first], weights=(times * idf[of[first]]) ** 2, minlength=len(z))
                z, size, bucket = (z / norm[:, None]).T.copy(), np.bincount(passage), bucket.astype(np.int64)
                for k in range(width):
                    total[k] += np.bincount(bucket, weights=np.repeat(z[k], size), minlength=DIMS)
        if any_rows:
            blocks = total.T.astype(np.float32).reshape(-1, BUCKETS_A_BLOCK * width)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks))), pa.array([x.tobytes() for x in blocks], pa.binary())], names=["block", "v"])

    return work


def summed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, v in zip(b.column("block").to_pylist(), b.column("v"), strict=True):
            x = np.frombuffer(v.as_buffer(), np.float32)
            total[k] = total[k] + x if k in total else x.astype(np.float64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "v"])


def fit_space(docs: DataFrame, items: DataFrame, rank: int = RANK) -> Space:
    """Randomised SVD of the TF-IDF matrix of all passages of documents and benchmark: A'A is applied to a thin random matrix in the tasks, and summed by row."""
    idf, words, times = corpus_counts(docs, items)
    width = rank + 8
    shared = docs.sparkSession.sparkContext.broadcast((idf, *spread(width), width))
    parts = docs.select("text").union(items.select("text")).mapInArrow(passage_products(shared), "block bigint, v binary")
    y = np.zeros((DIMS, width))
    for r in parts.repartition("block").mapInArrow(summed_blocks, "block bigint, v binary").collect():  # DIMS rows at most
        y[r["block"] * BUCKETS_A_BLOCK : (r["block"] + 1) * BUCKETS_A_BLOCK] = np.frombuffer(r["v"]).reshape(-1, width)
    u, _, _ = np.linalg.svd(y * idf[:, None], full_matrices=False)
    return Space(idf, (u[:, :rank] * idf[:, None]).astype(np.float32), words, times)


@dataclass
class Items:
    """A block of items, and the inverted list of their rarest words."""

    ids: list[int]
    words: list[np.ndarray]  # hashes
    answer: list[int]  # first word of the answer part
    size: np.ndarray  # window length
    vectors: np.ndarray
    least: np.ndarray  # how many places of its rare words an item needs
    known: np.ndarray  # sorted hashes of the rare words
    first: np.ndarray  # where each one's items begin in ``of``, one more at the end
    of: np.ndarray


def read_items(rows: list, space: Space) -> Items:
    """A block of items; the answer part is the last sentence, or the last third if there is one sentence only."""
    ids, words, answer, size, vec, least, rare, of = [], [], [], [], [], [], [], []
    for r in rows:
        s = next(slices(pa.array([r["text"] or ""])))
        h = s.hashes()
        if not len(h):
            continue
        ends = [k for k in range(len(h) - 1) if s.word(k)[-1:] in b".!?"]
        cut = ends[-1] + 1 if ends else len(h) * 2 // 3
        v = space.basis[buckets(h)].sum(0)
        # of the rarest so many words, a text that passes has ``near`` at least: the others are too few
        need = len(h) if len(h) < LEAST_WORDS else int(np.ceil(PARAPHRASE * len(h)))
        near = min(need, max(1, int(NEAR * len(h))))
        order = np.lexsort((np.arange(len(h)), h, space.often(h)))
        u = np.unique(h[order[: len(h) - need + near]])
        rare.append(u)
        of.append(np.full(len(u), len(ids)))
        ids.append(r["item_id"])
        words.append(h)
        answer.append(cut)
        least.append(near)
        size.append(next((x for x in LENGTHS if x >= len(h)), LENGTHS[-1]))
        vec.append(v / max(float(np.linalg.norm(v)), 1e-9))
    rare, of = (np.concatenate(rare), np.concatenate(of)) if rare else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(rare, kind="stable")
    known, n = np.unique(rare, return_counts=True)
    return Items(ids, words, answer, np.array(size, np.int64), np.array(vec, np.float32).reshape(len(ids), space.basis.shape[1]), np.array(least, np.int64), known, np.concatenate([[0], np.cumsum(n)]), of[order])


def common_in_order(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of one large number for the item."""
    where: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in text.tolist():
        m = where.get(w)
        if m:
            u = row & m
            row = (row + u) | (row - u)
            row &= full
    return len(item) - row.bit_count()


def check(items: Items, k: int, text: np.ndarray) -> tuple[float, float]:
    """Shares of the item's words, and of its answer part's, that the text has in their order."""
    item = items.words[k]
    tail = item[items.answer[k] :]
    return common_in_order(item, text) / len(item), common_in_order(tail, text) / max(1, len(tail))


def contaminated(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, rk, item_id, overlap, answer_overlap, cosine, start: one row per document and item found in it.

    Items without a word are in no document, and those under LEAST_WORDS only where all their words stand in a row. Null and empty
    texts hold no item. Rows that repeat give rows each; equal items are searched once for each item_id, null ids too.
    Other columns are ignored. The benchmark is read in blocks of about ``block`` items by a hash of the id.
    """
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", row_key().alias("rk"))
    n_items = items.count()
    space = fit_space(docs, items)
    sc, out = docs.sparkSession.sparkContext, None
    n_blocks = max(1, -(-n_items // block))
    for turn in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == turn) if n_blocks > 1 else items
        shared = sc.broadcast((space, read_items(part.select(F.col("item_id").cast("bigint").alias("item_id"), "text").dropDuplicates(["item_id", "text"]).orderBy("item_id", "text").collect(), space)))
        found = keyed.mapInArrow(search(shared), "doc_id bigint, rk bigint, item_id bigint, overlap double, answer_overlap double, cosine double, start bigint")
        out = found if out is None else out.union(found)
    return out


def row_key():
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("-")))


def search(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, items = shared.value
        for b in batches:
            docs, rks, rows = b.column("doc_id").to_pylist(), b.column("rk").to_pylist(), []
            for s in slices(b.column("text")):
                rows += [(docs[s.lo + t], rks[s.lo + t], *r) for t, *r in in_slice(space, items, s)]
            names = ["doc_id", "rk", "item_id", "overlap", "answer_overlap", "cosine", "start"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return work


def places(items: Items, s: Slice, h: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first word, last word) of the stretches of a slice where enough rare words of an item stand near each other."""
    at = np.minimum(np.searchsorted(items.known, h), len(items.known) - 1)
    word = np.flatnonzero(items.known[at] == h)
    at = at[word]
    n = items.first[at + 1] - items.first[at]
    word = np.repeat(word, n)
    item = items.of[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(items.first[at], n)]
    order = np.lexsort((word, item))
    word, item = word[order], item[order]
    text = np.searchsorted(s.first, word, "right") - 1
    # the span in which the check looks for an item
    span = np.maximum(items.size, [len(w) for w in items.words])[item] + items.size[item]
    end = np.arange(len(word)) + items.least[item] - 1
    ok = end < len(word)
    far = np.minimum(end, len(word) - 1)
    ok &= (item[far] == item) & (text[far] == text) & (word[far] - word < span)
    lo, hi = word[ok], word[far[ok]]
    if not len(lo):
        return
    text, item, span = text[ok], item[ok], span[ok]
    new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (lo[1:] > hi[:-1] + span[1:])]))
    last = np.maximum.reduceat(hi, new)
    yield from zip(text[new].tolist(), item[new].tolist(), lo[new].tolist(), last.tolist(), strict=True)


def in_slice(space: Space, items: Items, s: Slice) -> list[tuple]:
    """(text, item_id, overlap, answer overlap, cosine, first word) of a slice: the best window of each text and item that passes the checks."""
    h, best = s.hashes(), {}
    if not len(h) or not len(items.known):
        return []
    b = buckets(h)
    for t, item, first, last in places(items, s, h):
        size, words = int(items.size[item]), items.words[item]
        lo, hi = int(s.first[t]), int(s.first[t + 1])
        if len(words) < LEAST_WORDS:
            for a in range(max(lo, first - len(words)), min(hi - len(words), last) + 1):
                if np.array_equal(h[a : a + len(words)], words) and (t, item) not in best:
                    best[t, item] = (1.0, 1.0, 1.0, a - lo)
            continue
        # windows start at each quarter of their length; those whose surroundings meet the place
        step, longest = max(1, size // 4), max(size, len(words))
        count = 1 + max(0, -(-(hi - lo - size) // step))
        k0, k1 = max(0, (first - lo - longest - size) // step), min(count - 1, (last - lo + size) // step + 1)
        start = lo + np.arange(k0, k1 + 1) * step
        a, z = int(start[0]), min(hi, int(start[-1]) + size)
        total = space.running(b[a:z])
        cos = space.vectors(total, start - a, np.minimum(start + size, z) - a) @ items.vectors[item]
        for j in np.flatnonzero(cos >= COSINE):
            # half a window more on both sides, so that an item across two windows is whole in one
            y, e = max(lo, int(start[j]) - size // 2), min(hi, int(start[j]) + longest + size // 2)
            whole, tail = check(items, item, h[y:e])
            if whole >= COPIED or (whole >= PARAPHRASE and tail >= ANSWER):
                row = (whole, tail, float(cos[j]), int(start[j]) - lo)
                if (t, item) not in best or row[0] > best[t, item][0]:
                    best[t, item] = row
    return [(t, items.ids[i], *r) for (t, i), r in best.items()]


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, all columns kept, whatever their names.

    Null and empty texts hold none and stay. Rows that repeat doc_id and text go or stay together; an empty benchmark keeps all rows.
    """
    bad = contaminated(docs, items).select("rk").distinct()
    x = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), row_key().alias("key"))
    return x.join(bad, x["key"] == bad["rk"], "left_anti").select("row.*")
