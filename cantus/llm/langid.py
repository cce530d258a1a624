"""Language identification with averaged hashed subword embeddings.

A text is the mean of the embeddings of its byte n-grams, hashed into a fixed
table, and a linear softmax on that mean. Both are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows, in
tasks; only the result comes to the driver. As mean and softmax layer are
linear, embedding times weights is one table of bucket scores, scoring is a sum
of its rows, and models of several shares of the sample are one by their mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantus.llm.bytesoup import slices

BUCKETS = 1 << 16
ORDERS = (3, 4)
DIM = 16
#: Labelled rows for training: about so many of each language at most.
SAMPLE_PER_LANG = 600
#: Rows for training in all; and counts of so many languages at most are broadcast.
SAMPLE_ROWS, BROADCAST_LANGS = 300_000, 100_000
#: Bytes of text that a task looks at at once; what it holds of them beside the texts is a multiple of that.
SLICE = 1 << 17
#: A task learns from about so many rows at most; larger samples are dealt to shares, each with rows of all languages.
SHARE_ROWS = 10_000


def gram_runs(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the buckets of all n-grams, and where each text's begin; those that cross into the next text are left out."""
    if not len(data):
        return
    word = np.zeros(len(data) + 4, np.uint32)
    word[: len(data)] = data
    v, done = word[: len(data)].copy(), 1
    for n in ORDERS:
        for k in range(done, n):
            v |= word[k : len(data) + k] << np.uint32(8 * k)
        done = n
        h = (v * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        h = (h * np.uint32(0xC2B2AE35)) >> np.uint32(16)
        keep = np.ones(len(data), bool)
        for k in range(1, n):
            keep[np.maximum(at[1:] - k, at[:-1])[at[1:] > at[:-1]]] = False
        sizes = np.maximum(np.diff(at) - n + 1, 0)
        yield h[keep], np.concatenate([[0], np.cumsum(sizes)])


def bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text to lang, ids, counts: the distinct buckets of each text, as bytes of 32-bit numbers."""
    for b in batches:
        for s in slices(b.column("text"), size=SLICE):
            runs, ids, counts = list(gram_runs(s.data, s.at)), [], []
            for i in range(s.hi - s.lo):
                own = [h[at[i] : at[i + 1]] for h, at in runs]
                u, c = np.unique(np.concatenate(own) if own else np.zeros(0, np.uint32), return_counts=True)
                ids.append(u.astype(np.int32).tobytes())
                counts.append(c.astype(np.int32).tobytes())
            langs = b.column("lang").slice(s.lo, s.hi - s.lo).cast(pa.string())
            yield pa.RecordBatch.from_arrays([langs, pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "ids", "counts"])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages, embedding times weights
    bias: np.ndarray
    heat: float  # temperature of the calibrated softmax
    floor: float  # a lower calibrated probability rejects

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.heat
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 4.0, seed: int = 7, spare: float = 0.001) -> Model:
    """Train on (lang, bucket ids, counts); every fifth row sets the temperature and the rejection floor.

    The floor is such that a share ``spare`` at most of the right predictions on these rows is rejected.
    """
    rng = np.random.default_rng(seed)
    langs = sorted({r[0] for r in rows})
    where = {x: i for i, x in enumerate(langs)}
    e, w, bias = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    rows = [(where[x], np.asarray(i), np.asarray(c, np.float32)) for x, i, c in rows if len(i)]
    held, train = rows[::5], [r for k, r in enumerate(rows) if k % 5]
    steps, total = 0, max(1, epochs * len(train))
    for _ in range(epochs):
        for k in rng.permutation(len(train)):
            y, ids, c = train[k]
            # longer texts are also seen as short ones, so that the scores suit both
            if len(ids) > 30 and rng.random() < 0.5:
                pick = rng.choice(len(ids), rng.integers(8, 60))
                ids, c = np.unique(ids[pick], return_counts=True)
            share = (c / c.sum()).astype(np.float32)
            mean = share @ e[ids]
            z = mean @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            lr = rate * (1 - steps / total)
            back = w @ p
            w -= lr * 0.1 * np.outer(mean, p)
            bias -= lr * 0.01 * p
            e[ids] -= lr * share[:, None] * back
            steps += 1
    table = e @ w
    model = Model(langs, table, bias, 1.0, 0.0)
    if held:
        z = np.array([(c / c.sum()) @ table[i] + bias for _, i, c in held])
        y = np.array([r[0] for r in held])

        def loss(t: float) -> float:
            model.heat = t
            return -np.log(model.probabilities(z)[np.arange(len(y)), y] + 1e-9).mean()

        model.heat = min((0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
        p = model.probabilities(z)
        good = p.max(1)[p.argmax(1) == y]
        model.floor = float(min(0.5, np.quantile(good, spare))) if len(good) else 0.0
    return model


def sample(docs: DataFrame, train: Column, per_lang: int) -> tuple[DataFrame, int]:
    """About ``per_lang`` training rows of each language, chosen by a hash of id and text; fewer if there are so many languages that SAMPLE_ROWS would be exceeded. And about how many there are at most."""
    rows = docs.filter(train & F.col("lang").isNotNull() & (F.coalesce(F.char_length("text"), F.lit(0)) > 0)).select("lang", "text", F.pmod(F.xxhash64(F.lit(11), F.col("doc_id"), "text"), F.lit(1_000_000)).alias("at"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    langs = counts.count()
    most = min(per_lang, max(1, SAMPLE_ROWS // max(1, langs)))
    counts = F.broadcast(counts) if langs <= BROADCAST_LANGS else counts
    return rows.join(counts, "lang").filter(F.col("at") < F.floor(1_000_000 * F.least(F.lit(1.0), most / F.col("n"))) + 1).drop("n"), langs * most


MODEL = "lang string, scores binary, bias float, heat double, floor double"


def share_model(rows: pa.Table) -> pa.Table:
    """lang, ids, counts, at of a share to the model that it gives, a row for each language."""
    rows = rows.sort_by([("lang", "ascending"), ("at", "ascending")])
    ids, counts = ([np.frombuffer(x.as_buffer(), np.int32) for x in rows[k]] for k in ("ids", "counts"))  # not copied
    m = fit(list(zip(rows["lang"].to_pylist(), ids, counts, strict=True)))
    n = len(m.langs)
    return pa.table([pa.array(m.langs, pa.string()), pa.array([x.tobytes() for x in m.table.T], pa.binary()), pa.array(m.bias, pa.float32()), pa.array([m.heat] * n), pa.array([m.floor] * n)], names=["lang", "scores", "bias", "heat", "floor"])


def mean_model(models: pa.Table) -> pa.Table:
    """The models of all shares for one language to their mean."""
    scores = np.mean([np.frombuffer(x, np.float32) for x in models["scores"].to_pylist()], axis=0, dtype=np.float64).astype(np.float32)
    bias, heat, floor = (np.mean(models[k].to_numpy(), dtype=np.float64) for k in ("bias", "heat", "floor"))
    return pa.table([models["lang"].slice(0, 1), pa.array([scores.tobytes()], pa.binary()), pa.array([bias], pa.float32()), pa.array([heat]), pa.array([floor])], names=models.column_names)


def train_model(docs: DataFrame, train: Column, per_lang: int = SAMPLE_PER_LANG) -> Model | None:
    """Fit on a bounded sample of the labelled rows that ``train`` marks; None without any.

    Learning is done in tasks, in one for each SHARE_ROWS rows. A table of scores of each language comes to the driver.
    """
    rows, most = sample(docs, train, per_lang)
    rows = rows.mapInArrow(bucket_counts, "lang string, ids binary, counts binary").withColumn("at", F.xxhash64("ids"))
    share = F.pmod(F.xxhash64("at"), F.lit(max(1, -(-most // SHARE_ROWS))))
    models = rows.groupBy(share.alias("share")).applyInArrow(share_model, MODEL)
    if most > SHARE_ROWS:
        models = models.groupBy("lang").applyInArrow(mean_model, MODEL)
    got = models.orderBy("lang").toArrow()
    if not len(got):
        return None
    table = np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in got["scores"]], axis=1)
    return Model(got["lang"].to_pylist(), table, got["bias"].to_numpy(), float(np.median(got["heat"].to_numpy())), float(np.median(got["floor"].to_numpy())))


def judged(m: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the likeliest language's number and its probability."""
    best, prob = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for s in slices(texts, size=SLICE):
        z = np.zeros((s.hi - s.lo, len(m.langs)), np.float64)
        seen = np.zeros(s.hi - s.lo)
        for h, at in gram_runs(s.data, s.at):
            full = np.flatnonzero(np.diff(at) > 0)
            if len(full):
                rows = m.table[h]
                z[full] += np.add.reduceat(rows, at[full], axis=0)
                seen[full] += np.diff(at)[full]
        p = m.probabilities(z / np.maximum(seen, 1)[:, None] + m.bias)
        best[s.lo : s.hi], prob[s.lo : s.hi] = p.argmax(1), p.max(1)
    return best, prob


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id by default), lang_pred, score (calibrated probability), rejected for every row.

    Whole texts are scored. Texts that are null or hold no letter are ``und`` with score 0
    and rejected; so is every text if no labelled row was there to learn from.
    Texts of under three bytes are judged by the bias alone. Repeated rows are scored alike; columns not in ``keep`` are ignored.
    """
    keep = keep or ["doc_id"]
    cols = docs.select(*dict.fromkeys([*keep, "text"])).withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if model is None:
        return cols.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for b in batches:
            best, prob = judged(m, b.column("text"))
            letters = b.column("_letters").to_numpy(zero_copy_only=False).astype(bool)
            best[~letters], prob[~letters] = len(m.langs), 0.0
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(names[best], pa.string()), pa.array(prob), pa.array(~letters | (prob < m.floor))], names=[*keep, "lang_pred", "score", "rejected"])

    return cols.mapInArrow(score, schema)
