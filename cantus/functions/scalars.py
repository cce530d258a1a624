"""Scores, times and confidences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cantus.functions.labels import PITCH, lookup

#: Upper bounds of the confidence bands, and weights of key relations.
BANDS = [(0.2, "very_low"), (0.4, "low"), (0.6, "medium"), (0.8, "high")]
TOP_BAND = "very_high"
RELATION_WEIGHTS = {"exact": 1.0, "fifth": 0.5, "relative": 0.3, "parallel": 0.2, "other": 0.0, "unknown": 0.0}


def confidence_band(value: Column) -> Column:
    """Band of a confidence; null is 'unknown', never the lowest one."""
    c = F.when(value.isNull(), "unknown")
    for most, name in BANDS:
        c = c.when(value < most, name)
    return c.otherwise(TOP_BAND)


def key_parts(key: Column) -> Column:
    """struct(pc, mode, bad) of 'C major'; pc is null for unknown keys, bad marks malformed ones for quarantine."""
    x = F.trim(key)
    parts = F.split(x, r"\s+")
    unknown = F.lower(x).isin("unknown", "x", "none", "")
    two = F.size(parts) == 2
    tonic, mode = F.get(parts, F.lit(0)), F.lower(F.get(parts, F.lit(1)))
    none = unknown | F.lower(tonic).isin("unknown", "x", "none", "") | ~F.coalesce(mode.isin("major", "minor", "other"), F.lit(False))
    pc = F.coalesce(lookup(PITCH, tonic, "int"), lookup(PITCH, F.initcap(tonic), "int"))
    return F.struct(F.when(two & ~none, pc).alias("pc"), F.when(two & ~none, mode).alias("mode"), (~unknown & (~two | (two & ~none & pc.isNull()))).alias("bad"))


def key_relation(ref: Column, est: Column) -> Column:
    """exact, fifth (above), relative, parallel, other, or unknown; checked in this order."""
    a, b = key_parts(ref), key_parts(est)
    up, same = F.pmod(b["pc"] - a["pc"], F.lit(12)), a["mode"] == b["mode"]
    return (
        F.when(a["pc"].isNull() | b["pc"].isNull(), "unknown").when(same & (up == 0), "exact").when(same & (up == 7), "fifth")
        .when(~same & (((a["mode"] == "major") & (up == 9)) | ((a["mode"] == "minor") & (up == 3))), "relative").when(~same & (up == 0), "parallel").otherwise("other")
    )


def key_score(relation: Column) -> Column:
    return lookup(RELATION_WEIGHTS, relation, "double")


def tempo_errors(ref: Column, est: Column) -> Column:
    """struct(same, half, double, interpretation): absolute errors of the estimate and of its half and double readings; ties favour that order."""
    same, half, double = F.abs(est - ref), F.abs(est / 2 - ref), F.abs(est * 2 - ref)
    best = F.when((same <= half) & (same <= double), "same").when(half <= double, "half").otherwise("double")
    ok = (ref > 0) & (est > 0)
    return F.when(ok, F.struct(same.alias("same"), half.alias("half"), double.alias("double"), best.alias("interpretation")))


def metrical_alternatives(bpm: Column) -> Column:
    return F.array(bpm / 2, bpm * 2)


def real_time_factor(audio_seconds: Column, seconds: Column) -> Column:
    """Audio seconds per second of work; null unless both are above 0."""
    return F.when((audio_seconds > 0) & (seconds > 0), audio_seconds / seconds)


def format_timestamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm with half-even rounding; 'unknown' for null, null for negative times."""
    ms = F.bround(seconds * 1000, 0).cast("long")
    part = lambda a, b: F.floor(ms / a) % b if b else F.floor(ms / a)
    text = F.format_string("%02d:%02d:%02d.%03d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), ms % 1000)
    return F.when(seconds.isNull(), "unknown").when(seconds >= 0, text)


def format_duration(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on."""
    s = F.bround(seconds, 0).cast("long")
    text = F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))
    return F.when(seconds.isNull(), "unknown").when(seconds >= 0, text)


def parse_timestamp(text: Column) -> Column:
    """Seconds of SS, MM:SS or HH:MM:SS(.mmm); null if it is none of these."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: p.try_cast("double"))
    ok = (F.size(parts) <= 3) & F.forall(parts, lambda p: p.isNotNull())
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p)
    return F.when(ok & (total >= 0), total)


def normalize_text(text: Column) -> Column:
    """Lower case, with runs of punctuation, symbols and separators as one space (canonical composition is left to the source)."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\p{P}\p{S}\p{Z}\s]+", " "))


def logistic(margin: Column, slope: float, intercept: float) -> Column:
    """Probability of a margin, safe at both ends."""
    z = margin * F.lit(slope) + F.lit(intercept)
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def duration(start: Column, end: Column) -> Column:
    return end - start


def correct_fraction(correct: Column, seconds: Column) -> Column:
    return F.try_divide(correct, seconds)


def error_fraction(correct: Column, seconds: Column) -> Column:
    """The part of an event that is a miss."""
    return 1 - correct_fraction(correct, seconds)


def compress_chroma(chroma: Column, how: str) -> Column:
    """Negatives to 0, then raw, sqrt or log1p(15 x)."""
    f = {"raw": lambda x: x, "sqrt": F.sqrt, "log": lambda x: F.log1p(x * 15)}[how]
    return F.transform(chroma, lambda x: f(F.greatest(x, F.lit(0.0))))
