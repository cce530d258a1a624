"""Toxicity by a support vector machine on a subsequence string kernel.

The kernel of two words counts the letter triples that they share in order, gaps
allowed and damped, so that ``id-i.ot`` or ``idxiot`` stay close to ``idiot``.
It is the inner product of explicit vectors: a triple's entry is the sum of
DECAY ** span over its places of SPAN letters at most, divided by the norm that
a word of as many different triples has. Nystroem landmarks, picked greedily so that they
cover the words of toxic sentences, give each word a short vector for a linear SVM.

It is trained on labelled sentences. A sentence is judged by its best word, and
a text by its best sentence. All sentences of clean texts are
negative; of a toxic one at least one is positive, which one the machine finds itself:
training and choosing the witness sentence alternate, and the clean sentences
judged worst join the training set in each turn.

The decision is linear in the explicit vectors, so that after training the
landmarks and weights fold into one table of triple weights, and whole texts
are scored by sums over its entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantus.llm.bytesoup import SPACES, Slice, mix, powers, slices
from cantus.llm.store import stable

DECAY, SPAN = 0.6, 6
#: Triples of a window start in so many letters; longer words are judged by their best window.
WIDTH = 12
LANDMARKS_TOXIC, LANDMARKS_CLEAN = 96, 16
#: Candidates for landmarks: so many of the words that tell most.
CANDIDATES = 600
#: Bounds of the labelled sample: about so many documents of each label, and characters of them, at most.
SAMPLE_PER_LABEL, SAMPLE_CHARS = 3000, 4_000_000
ROUNDS = 4
#: A word is first taken for a witness if the odds of its sentences' being toxic are exp(TELLING) times the usual ones.
TELLING = 1.5
#: A toxic text's best word is a witness in the next turn from this margin on.
WITNESS = -0.3
#: Hardest clean sentences that join the training set in a turn.
HARD = 3000
CODE = np.zeros(256, np.uint8)
for _i in range(26):
    CODE[97 + _i] = CODE[65 + _i] = _i + 1
for _b in range(128, 256):
    CODE[_b] = 27 + _b % 64
LETTERS = 91
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_STOPS = np.zeros(256, bool)
_STOPS[[10, 33, 46, 63]] = True


@dataclass
class Letters:
    """The words of a slice as runs of letter codes."""

    code: np.ndarray
    start: np.ndarray  # of each word
    end: np.ndarray
    text: np.ndarray  # row of the slice
    sentence: np.ndarray  # number within the slice

    def left(self) -> np.ndarray:
        """Letters from each place to the end of its word."""
        return np.repeat(self.end, self.end - self.start) - np.arange(len(self.code))

    def hashes(self) -> np.ndarray:
        p, inv = powers(len(self.code) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.code.astype(np.uint64) + np.uint64(1)) * p[: len(self.code)])])
        return mix((total[self.end] - total[self.start]) * inv[self.start] + (self.end - self.start).astype(np.uint64))


def letters(s: Slice) -> Letters:
    """Words between white space without what is no letter; words of one letter in a row are one word."""
    code = CODE[s.data]
    at = np.flatnonzero(code)
    begin = np.zeros(len(code), np.int32)
    begin[s.start] = 1
    word = np.cumsum(begin)[at] - 1
    size = np.bincount(word, minlength=len(s.start))
    own = np.flatnonzero(size)
    size, text = size[own], np.searchsorted(s.first, own, "right") - 1
    new = np.ones(len(own), bool)
    new[1:] = ~((size[1:] == 1) & (size[:-1] == 1) & (text[1:] == text[:-1]))
    first = np.flatnonzero(new)
    edge = np.concatenate([[0], np.cumsum(size)])
    start = edge[:-1][first]
    stops = np.cumsum(_STOPS[s.data])
    return Letters(code[at], start, np.append(start[1:], len(at)), text[first], stops[at[start]] if len(start) else start)


def norms() -> np.ndarray:
    """Squared entries of the triples that start at a letter with so many letters left in its word."""
    return np.array([sum(DECAY ** (2 * b + 2) for _, b in OFFSETS if b < left) for left in range(SPAN + 1)])


_NORMS = norms()


def windows(x: Letters, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and first letter of the best window of each word; words of under three letters have value -inf."""
    n = len(x.code)
    best, at = np.full(len(x.start), -np.inf), x.start.copy()
    if not n:
        return best, at
    left = x.left()
    c = np.concatenate([x.code.astype(np.int32), np.zeros(SPAN, np.int32)])
    mid, s = c * LETTERS, np.zeros(n, np.float32)
    for b in range(2, SPAN):
        ends = c[:n] * LETTERS**2 + c[b : n + b]
        got = table.take(ends + mid[1 : n + 1])
        for a in range(2, b):
            got += table.take(ends + mid[a : n + a])
        s += got * ((left > b) * np.float32(DECAY ** (b + 1)))
    total = np.concatenate([[0.0], np.cumsum(s, dtype=np.float64)])
    norm = np.concatenate([[0.0], np.cumsum(_NORMS.take(np.minimum(left, SPAN)))])
    size = x.end - x.start
    short = np.flatnonzero((size >= 3) & (size <= WIDTH))
    a, z = x.start[short], x.end[short]
    best[short] = (total[z] - total[a]) / np.sqrt(norm[z] - norm[a])
    long = np.flatnonzero(size > WIDTH)
    if len(long):
        count = size[long] - WIDTH + 1
        first = np.cumsum(count) - count
        a = np.arange(count.sum()) - np.repeat(first, count) + np.repeat(x.start[long], count)
        v = (total[a + WIDTH] - total[a]) / np.sqrt(norm[a + WIDTH] - norm[a])
        top = np.maximum.reduceat(v, first)
        best[long] = top
        hit = np.flatnonzero(v == np.repeat(top, count))
        of = np.repeat(np.arange(len(long)), count)[hit]
        at[long[of[::-1]]] = a[hit[::-1]]
    return best, at


def window_bytes(x: Letters, word: int, at: int) -> bytes:
    """The letters whose triples make up a window."""
    return x.code[at : min(int(x.end[word]), at + WIDTH + SPAN - 1)].tobytes()


def vector(w: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Triples of a window and their entries, which the same triple can have several of."""
    c = np.frombuffer(w, np.uint8).astype(np.int64)
    n, code, value, norm = len(c), [], [], 0.0
    for a, b in OFFSETS:
        k = max(0, min(WIDTH, n - b))
        code.append((c[:k] * LETTERS + c[a : a + k]) * LETTERS + c[b : b + k])
        value.append(np.full(k, DECAY ** (b + 1)))
        norm += k * DECAY ** (2 * b + 2)
    return np.concatenate(code), np.concatenate(value) / np.sqrt(max(norm, 1e-12))


def kernel(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    """Inner products of the vectors of two lists of windows."""
    vy = [vector(y) for y in ys]
    known = np.unique(np.concatenate([c for c, _ in vy])) if vy else np.zeros(0, np.int64)
    dense = np.zeros((len(known) + 1, len(ys)), np.float32)
    for k, (c, v) in enumerate(vy):
        np.add.at(dense[:, k], np.searchsorted(known, c), v)
    out = np.zeros((len(xs), len(ys)), np.float32)
    if not len(known):
        return out
    for lo in range(0, len(xs), 1024):
        vx = [vector(x) for x in xs[lo : lo + 1024]]
        size = np.array([len(c) for c, _ in vx])
        code, value = np.concatenate([c for c, _ in vx]), np.concatenate([v for _, v in vx])
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        hit = np.flatnonzero(known[at] == code)
        np.add.at(out, lo + np.repeat(np.arange(len(vx)), size)[hit], dense[at[hit]] * value[hit, None].astype(np.float32))
    return out


def landmarks(words: list[bytes], weight: np.ndarray, most: int) -> list[bytes]:
    """Greedy Nystroem landmarks: each next word is the one that explains most of the kernel that is left, by weight."""
    k = kernel(words, words).astype(np.float64)
    left, out = k.copy(), []
    for _ in range(min(most, len(words))):
        own = np.diag(left)
        gain = np.where(own > 1e-3, (weight[:, None] * left**2).sum(0) / np.maximum(own, 1e-3), 0)
        best = int(gain.argmax())
        if gain[best] < 0.05:
            break
        out.append(words[best])
        left = left - np.outer(left[:, best], left[best]) / own[best]
    return out


@dataclass
class Model:
    table: np.ndarray  # weight of each triple
    bias: float
    marks: list[bytes] = field(default_factory=list)
    slope: np.ndarray = field(default_factory=lambda: np.zeros(2))  # of the logistic function, and its intercept

    def margins(self, s: Slice) -> tuple[np.ndarray, Letters, np.ndarray]:
        """Margin of each word of a slice, the words, and where each one's best window begins."""
        x = letters(s)
        v, at = windows(x, self.table)
        return np.where(np.isfinite(v), v + self.bias, -np.inf), x, at


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps on the rows inside the margin."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(a.shape[1]), reg * np.eye(a.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        active = y * (a @ w) < 1
        if not active.any():
            break
        b = a[active] * weight[active, None]
        new = np.linalg.solve(ridge + b.T @ a[active], b.T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            return new[:-1], float(new[-1])
        w = new
    return w[:-1], float(w[-1])


def logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slope and intercept by halved Newton steps with a little ridge."""
    x, b = np.stack([m, np.ones_like(m)], 1), np.zeros(2)
    loss = lambda b: (weight * (np.logaddexp(0, x @ b) - y * (x @ b))).sum() + 5e-3 * b @ b
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (weight * (y - p)) - 1e-2 * b)
        while loss(b + step) > loss(b) and abs(step).max() > 1e-9:
            step = step / 2
        b = b + step
        if abs(step).max() < 1e-8:
            break
    return b


def varied(w: bytes, rng: np.random.Generator) -> list[bytes]:
    """The window with a letter put in, and with one said twice."""
    if len(w) < 4:
        return []
    k, j = int(rng.integers(1, len(w) - 1)), int(rng.integers(1, len(w) - 1))
    return [w[:k] + bytes([int(rng.integers(1, 27))]) + w[k:], w[:j] + w[j : j + 1] + w[j:]]


@dataclass
class Witnesses:
    """Of each group (text or sentence): the best word's value and window."""

    value: np.ndarray
    window: list[bytes]


def best_of(value: np.ndarray, group: np.ndarray, n: int, take) -> Witnesses:
    """The largest value of each group and, by ``take(i)``, its window; groups without words have value -inf."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, group, value)
    hit = np.flatnonzero((value == top[group]) & np.isfinite(value))
    of = np.full(n, -1)
    of[group[hit[::-1]]] = hit[::-1]
    return Witnesses(top, [take(int(i)) if i >= 0 else b"" for i in of])


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray, seed: int = 5) -> Model | None:
    """Train on texts with labels; ``weight`` says how many rows of the whole table a text stands for."""
    rng = np.random.default_rng(seed)
    parts = [(s.lo, letters(s)) for s in slices(pa.array(texts, pa.string()))]
    sent, base = [], 0
    for _, x in parts:
        sent.append(x.sentence + base)
        base += int(x.sentence.max(initial=0)) + 1
    doc = np.concatenate([x.text + lo for lo, x in parts])
    # a sentence is named by its text too: texts need not end in a stop
    _, sentence = np.unique(doc * (base + 1) + np.concatenate(sent), return_inverse=True)
    if not len(doc):
        return None
    bad = toxic[doc] == 1
    n_sent = int(sentence.max()) + 1
    sent_bad = np.zeros(n_sent, bool)
    sent_bad[sentence] = bad
    edge = np.cumsum([0, *(len(x.start) for _, x in parts)])

    def window(at: list[np.ndarray]):
        def take(i: int) -> bytes:
            p = int(np.searchsorted(edge, i, "right")) - 1
            return window_bytes(parts[p][1], i - edge[p], int(at[p][i - edge[p]]))

        return take

    # evidence at the start: sentences of each label that hold a word
    h = np.concatenate([x.hashes() for _, x in parts])
    _, word = np.unique(h, return_inverse=True)
    pair = np.unique(word.astype(np.int64) * n_sent + sentence)
    n_bad = np.bincount(pair // n_sent, weights=sent_bad[pair % n_sent])
    n_good = np.bincount(pair // n_sent) - n_bad
    prior = max(1, sent_bad.sum()) / max(1, (~sent_bad).sum())
    gain = np.log((n_bad + 0.5) / ((n_good + 0.5) * prior))
    size = np.concatenate([x.end - x.start for _, x in parts])
    plain = window([x.start for _, x in parts])
    _, place = np.unique(word, return_index=True)
    telling = np.flatnonzero((gain > TELLING) & (size[place] >= 3))
    telling = telling[np.argsort(-(n_bad * gain)[telling], kind="stable")]
    seen: dict[bytes, float] = {}
    for k in telling[:CANDIDATES]:
        w = plain(int(place[k]))
        seen[w] = seen.get(w, 0) + float(n_bad[k])
    often = list(seen)
    # at the start each toxic text has its most telling word as witness
    evidence = np.where((gain > TELLING) & (size[place] >= 3), n_bad * gain, 0)[word]
    found = best_of(np.where(bad, evidence, -np.inf), doc, len(texts), plain)
    positive: dict[bytes, float] = {}
    for v, w in zip(found.value, found.window, strict=True):
        if v > 0:
            positive[w] = positive.get(w, 0) + 1
    positive = {w: n for w, n in positive.items() if n > 1} or positive
    common = best_of(np.where(~bad & (size >= 3), rng.random(len(doc)), -np.inf), sentence, n_sent, plain)
    clean = sorted({w for w in common.window if w})
    clean = [clean[i] for i in rng.permutation(len(clean))[: HARD // 2]]
    if not positive or not clean:
        return None
    marks = landmarks(often, np.array([seen[w] for w in often]), LANDMARKS_TOXIC) + landmarks(clean[:300], np.ones(min(300, len(clean))), LANDMARKS_CLEAN)
    vals, vecs = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    root = vecs @ np.diag(1 / np.sqrt(np.maximum(vals, 1e-2))) @ vecs.T  # Nystroem: K^-1/2
    negative = dict.fromkeys(clean)
    model = Model(np.zeros(LETTERS**3, np.float32), 0.0, marks)
    for turn in range(ROUNDS):
        more = [v for w in positive for v in varied(w, rng)]
        rows = [*positive, *more, *negative]
        y = np.where(np.arange(len(rows)) < len(positive) + len(more), 1.0, -1.0)
        c = np.array([*(np.sqrt(n) for n in positive.values()), *(0.5 for _ in more), *(1.0 for _ in negative)])
        w, bias = svm(kernel(rows, marks).astype(np.float64) @ root, y, c)
        table = np.zeros(LETTERS**3, np.float64)
        for k, m in zip(root @ w, marks, strict=True):
            code, value = vector(m)
            np.add.at(table, code, k * value)
        model.table, model.bias = table.astype(np.float32), bias
        got = [windows(x, model.table) for _, x in parts]
        value, take = np.concatenate([v for v, _ in got]) + bias, window([a for _, a in got])
        if turn == ROUNDS - 1:
            break
        # witness sentences: the best one of each toxic text, and all others that the machine calls toxic
        texts_best, sents_best = best_of(np.where(bad, value, -np.inf), doc, len(texts), take), best_of(value, sentence, n_sent, take)
        positive = {}
        for v, win in [*zip(texts_best.value, texts_best.window, strict=True), *((v, win) for v, win, b in zip(sents_best.value, sents_best.window, sent_bad, strict=True) if b and v > 0)]:
            if v > WITNESS and win:
                positive[win] = positive.get(win, 0) + 1
        hard = [int(i) for i in np.argsort(-np.where(sent_bad, -np.inf, sents_best.value), kind="stable")[:HARD]]
        negative |= dict.fromkeys(sents_best.window[i] for i in hard if not sent_bad[i] and sents_best.window[i])
        positive = {k: n for k, n in positive.items() if k not in negative}
        if not positive:
            break
    top = np.full(len(texts), -3.0)
    np.maximum.at(top, doc, np.maximum(value, -3.0))
    model.slope = logistic(top, (toxic == 1).astype(float), weight)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, per_label: int, chars: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of about ``per_label`` training documents of each label, by a hash of the id; fewer if they are long.

    Documents labelled twice are toxic if one label says so.
    """
    rows = labels.filter(F.col("toxic").isNotNull() & train).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)))
    share = {r["toxic"]: min(1.0, per_label / r["count"]) for r in rows.groupBy("toxic").count().collect()}
    picked = rows.filter(picks(share))  # at most about 2 * per_label rows of three numbers
    sample = stable(docs.filter(F.length("text") > 0).select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("toxic", "at", "text"))
    for r in sample.groupBy("toxic").agg(F.sum(F.length("text")).alias("n")).collect():
        share[r["toxic"]] *= min(1.0, chars / r["n"])
    got = sample.filter(picks(share)).orderBy("toxic", "at", F.xxhash64("text")).collect()
    y = np.array([r["toxic"] for r in got], np.int64)
    return [r["text"] for r in got], y, np.array([1 / share[int(t)] for t in y])


def picks(share: dict[int, float]) -> Column:
    keep = F.lit(False)
    for label, x in share.items():
        keep = keep | ((F.col("toxic") == label) & (F.col("at") < int(1_000_000 * x) + 1))
    return keep


def train_model(docs: DataFrame, labels: DataFrame, train: Column, per_label: int = SAMPLE_PER_LABEL, chars: int = SAMPLE_CHARS) -> Model | None:
    """Learn from the labelled rows that ``train`` marks; None where either label is missing."""
    texts, y, weight = labelled_sample(docs, labels, train, per_label, chars)
    return fit(texts, y, weight) if {0, 1} <= set(y.tolist()) else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1), predicted, margin of every row.

    Whole texts are read. Null and empty texts, and those without a word of three letters, have the margin -3, the least there is.
    Without a model (no labelled rows of both kinds) every score is 0. Repeated rows get equal
    scores; labels and other columns are never looked at.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(-3.0).alias("margin"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 3 MB, whatever the input

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            top = np.full(b.num_rows, -3.0)
            for s in slices(b.column("text"), SPACES):
                m, x, _ = model.margins(s)
                np.maximum.at(top, x.text + s.lo, np.maximum(m, -3.0))
            p = 1 / (1 + np.exp(-np.clip(model.slope[0] * top + model.slope[1], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(top)], names=["doc_id", "score", "predicted", "margin"])

    return docs.mapInArrow(work, "doc_id bigint, score double, predicted int, margin double")
