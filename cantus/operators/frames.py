"""Operators on chroma frames and samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantus.functions.labels import NOTES
from cantus.operators.timeline import KEY

#: Average pitch-class profiles of major and minor keys on C.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
#: Weights of root, third, fifth and the other third in a template; score of the state without chord.
ROOT, THIRD, FIFTH, CLASH = 1.0, 0.95, 0.85, -0.35
NO_CHORD_SCORE = 0.06
STATES = [*NOTES, *[f"{n}m" for n in NOTES], "N"]


def templates(harmonic: bool = True) -> list[list[float]]:
    """Weights of the 12 pitch classes for the 12 major and 12 minor triads."""
    out = []
    for minor in (False, True):
        for root in range(12):
            v = [0.0] * 12
            third, other = (3, 4) if minor else (4, 3)
            for step, weight in ((0, ROOT), (third, THIRD), (7, FIFTH), (other, CLASH)) if harmonic else ((0, 1.0), (third, 1.0), (7, 1.0)):
                v[(root + step) % 12] = weight
            out.append(v)
    return out


def frame_scores(chroma: Column, harmonic: bool = True) -> Column:
    """Cosine with each of the 24 templates, and the constant of the state without chord; all 0 for a silent frame."""
    norm = F.sqrt(F.aggregate(chroma, F.lit(0.0), lambda a, x: a + x * x))

    def cosine(t: list[float]) -> Column:
        dot = sum((F.element_at(chroma, i + 1) * w for i, w in enumerate(t) if w), F.lit(0.0))
        return F.when(norm > 0, dot / (norm * math.sqrt(sum(w * w for w in t)))).otherwise(0.0)

    return F.array(*[cosine(t) for t in templates(harmonic)], F.lit(NO_CHORD_SCORE))


def best_state(scores: Column, least: float | None = None) -> Column:
    """Label of the highest of the first 24 scores, the lowest index on ties; N below ``least``."""
    s = F.slice(scores, 1, 24)
    label = F.element_at(F.array(*[F.lit(x) for x in STATES]), F.array_position(s, F.array_max(s)).cast("int"))
    return label if least is None else F.when(F.array_max(s) < least, "N").otherwise(label)


def energy_gate(frames: DataFrame, decibels: float, key: str = KEY) -> DataFrame:
    """Chroma of frames whose rms is far below the song's highest as zeros; frames without rms are kept."""
    top = F.max("rms").over(Window.partitionBy(key))
    quiet = F.col("rms") < top * 10 ** (decibels / 20)
    return frames.withColumn("chroma", F.when(quiet, F.array_repeat(F.lit(0.0), 12)).otherwise(F.col("chroma")))


def key_of(frames: DataFrame, key: str = KEY) -> DataFrame:
    """key, tonic, mode, confidence: the key whose profile correlates best with the mean chroma; null without energy. Ties go to the lower tonic, major first."""
    mean = frames.select(key, F.posexplode("chroma").alias("pc", "x")).groupBy(key, "pc").agg(F.avg("x").alias("x"))
    rows = [(s, m, (pc + s) % 12, p[pc]) for s in range(12) for m, p in enumerate((MAJOR, MINOR)) for pc in range(12)]
    profiles = F.broadcast(frames.sparkSession.createDataFrame(rows, "shift int, minor int, pc int, w double"))  # 288 fixed rows
    g = mean.join(profiles, "pc").groupBy(key, "shift", "minor").agg(F.avg("x").alias("mx"), F.avg("w").alias("mw"), F.sum(F.col("x") * F.col("w")).alias("xw"), F.sum(F.col("x") ** 2).alias("xx"), F.sum(F.col("w") ** 2).alias("ww"))
    vx, vw = F.col("xx") - 12 * F.col("mx") ** 2, F.col("ww") - 12 * F.col("mw") ** 2
    r = F.when(vx > 1e-12, (F.col("xw") - 12 * F.col("mx") * F.col("mw")) / F.sqrt(vx * vw)).otherwise(0.0)
    best = g.withColumn("r", F.round(r, 9)).groupBy(key).agg(F.max(F.struct("r", (-F.col("shift")).alias("s"), (-F.col("minor")).alias("m"))).alias("b"), F.max("mx").alias("energy"))
    on = F.col("energy") > 0
    return best.select(
        key,
        F.when(on, F.element_at(F.array(*[F.lit(n) for n in NOTES]), 1 - F.col("b.s"))).alias("tonic"),
        F.when(on, F.when(F.col("b.m") == 0, "major").otherwise("minor")).alias("mode"),
        F.when(on, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("b.r")))).alias("confidence"),
    )


def segment_margins(frames: DataFrame, segments: DataFrame, period: float, key: str = KEY) -> DataFrame:
    """key, seq, margin: mean over a segment's frames of its own state's score less the best other one; 0 without a frame.

    A segment owns the frames from its own start to the next segment's start. ``frames`` has scores.
    """
    w = Window.partitionBy(key).orderBy("start", "seq")
    s = segments.withColumn("_a", F.bround(F.col("start") / period, 0).cast("long")).withColumn("_z", F.lead("_a").over(w))
    own = F.array_position(F.array(*[F.lit(x) for x in STATES]), F.col("label")).cast("int")
    e = s.select(key, F.col("_a").alias("frame_no"), F.lit(0).alias("_k"), F.struct("seq", own.alias("own")).alias("seg"))
    f = frames.select(key, "frame_no", F.lit(1).alias("_k"), "scores")
    u = Window.partitionBy(key).orderBy("frame_no", "_k").rowsBetween(Window.unboundedPreceding, 0)
    x = e.unionByName(f, allowMissingColumns=True).withColumn("seg", F.last("seg", ignorenulls=True).over(u)).filter("_k = 1 and seg is not null")
    mine = F.element_at("scores", F.col("seg.own"))
    other = F.array_max(F.transform("scores", lambda v, i: F.when(i != F.col("seg.own") - 1, v)))
    m = x.groupBy(key, F.col("seg.seq").alias("seq")).agg(F.avg(mine - other).alias("margin"))
    return segments.select(key, "seq").join(m, [key, "seq"], "left").fillna(0.0, ["margin"])


def peaks(samples: DataFrame, n_buckets: int, key: str = KEY) -> DataFrame:
    """key, bucket, lo, hi: least and most sample of each of min(n_buckets, frames) equal stretches; ``samples`` has sample_no from 0 and value."""
    total = samples.groupBy(key).agg((F.max("sample_no") + 1).alias("_f"))
    x = samples.join(total, key).withColumn("_n", F.least(F.lit(n_buckets), F.col("_f")))
    # the bucket i whose stretch [i f / n, (i + 1) f / n), floored, holds the frame
    i = F.expr("((sample_no + 1) * _n - 1) div _f")
    return x.groupBy(key, i.alias("bucket")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
