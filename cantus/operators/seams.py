"""Merging what windows of one recording reported, and words from a recogniser's tokens.

Rows carry the window's number ``idx``; the earlier window wins wherever two of them heard
the same time. One shuffle by the song each; no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantus.operators.timeline import KEY

#: Seconds by which an event may start before its window, and the largest gap that a seam leaves in one chord.
START_TOLERANCE = 1e-6
SEAM_TOLERANCE = 0.05
#: Fixed value: the mark that starts a word.
WORD_MARK = "▁"


def earlier_windows(key: str = KEY) -> Window:
    """All rows of the windows before the own one."""
    return Window.partitionBy(key).orderBy("idx").rangeBetween(Window.unboundedPreceding, -1)


def ignored_range(events: DataFrame, windows: DataFrame, tolerance: float = START_TOLERANCE, key: str = KEY) -> DataFrame:
    """The events that start before their window does: their engine did not heed the range it was given."""
    w = windows.select(key, "idx", F.col("start").alias("window_start"))
    return events.join(w, [key, "idx"]).filter(F.col("start") < F.col("window_start") - tolerance)


def merge_windows(events: DataFrame, tolerance: float = SEAM_TOLERANCE, key: str = KEY) -> DataFrame:
    """One timeline from the events (idx, seq, start, end, label, source) of overlapping windows.

    What earlier windows covered (to the largest of their ends) is clipped or dropped.
    The first event kept of a window continues the one before it if both have the same label and source, closed ends,
    and at most ``tolerance`` between them. Null sources are equal to each other. Returns key, seq, start, end, label, source.
    """
    x = events.withColumn("_f", F.max("end").over(earlier_windows(key)))
    x = x.filter(F.col("_f").isNull() | (F.col("start") >= F.col("_f")) | (F.col("end") > F.col("_f")))
    x = x.withColumn("start", F.greatest("start", "_f"))
    w = Window.partitionBy(key).orderBy("idx", "seq")
    before = lambda c: F.lag(c).over(w)
    seam = (
        (before("idx") != F.col("idx")) & (before("label") == F.col("label")) & before("source").eqNullSafe(F.col("source"))
        & F.col("end").isNotNull() & (before("end") <= F.col("start")) & (F.col("start") <= before("end") + tolerance)
    )
    x = x.withColumn("_new", F.when(F.coalesce(seam, F.lit(False)), 0).otherwise(1))
    x = x.withColumn("_g", F.sum("_new").over(w) - 1)
    at = F.struct("idx", "seq")
    return x.groupBy(key, F.col("_g").alias("seq")).agg(F.min_by("start", at).alias("start"), F.max_by("end", at).alias("end"), F.first("label").alias("label"), F.first("source").alias("source"))


def merge_lyrics(lines: DataFrame, windows: DataFrame, key: str = KEY) -> DataFrame:
    """Lines (idx, seq, start, end, words: array of text, start, end) of windows, on the clock of the song.

    Words that an earlier window heard go, and lines with them if no word is left;
    lines without any word stay. What a window covers reaches to its end or to the last time it names; a null start is never covered.
    """
    w = windows.select(key, "idx", F.col("start").alias("_ws"), F.col("end").alias("_we"))
    x = lines.join(w, [key, "idx"]).withColumn("start", F.col("start") + F.col("_ws")).withColumn("end", F.col("end") + F.col("_ws"))
    x = x.withColumn("words", F.transform("words", lambda a: F.struct(a["text"].alias("text"), (a["start"] + F.col("_ws")).alias("start"), (a["end"] + F.col("_ws")).alias("end"))))
    reach = F.greatest("_we", "end", F.array_max(F.transform("words", lambda a: F.coalesce(a["end"], a["start"]))))
    x = x.withColumn("_f", F.max(reach).over(earlier_windows(key)))
    kept = F.filter("words", lambda a: a["start"].isNull() | F.col("_f").isNull() | (a["start"] >= F.col("_f")))
    x = x.withColumn("_kept", kept).filter((F.coalesce(F.size("words"), F.lit(0)) <= 0) | (F.size("_kept") > 0))
    pos = F.row_number().over(Window.partitionBy(key).orderBy("idx", "seq")) - 1
    return x.select(key, pos.alias("seq"), "start", "end", F.col("_kept").alias("words"))


def words_of_tokens(tokens: DataFrame, key: str = KEY) -> DataFrame:
    """Words (idx, word_no, text, start, end) of tokens (idx, token_no, token, ts).

    A token starts a word if it is the first, or has a mark or space in front and more than punctuation; blank ones
    are skipped. A word ends where the next one starts; the last one of a window, and one whose next starts earlier, stays open.
    """
    text = F.replace("token", F.lit(WORD_MARK), F.lit(" "))
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    x = tokens.select(key, "idx", "token_no", "ts", text.alias("_t"), bare.alias("_b")).filter("_b != ''")
    w = Window.partitionBy(key, "idx").orderBy("token_no")
    opens = (F.row_number().over(w) == 1) | (F.col("_t").startswith(" ") & F.col("_b").rlike(r"[\p{L}\p{N}]"))
    x = x.withColumn("_o", opens.cast("int")).withColumn("word_no", F.sum("_o").over(w) - 1)
    parts = F.array_sort(F.collect_list(F.struct("token_no", "_b")))
    g = x.groupBy(key, "idx", "word_no").agg(F.array_join(F.transform(parts, lambda p: p["_b"]), "").alias("text"), F.min_by(F.struct("ts"), "token_no")["ts"].alias("start"))
    nxt = F.lead("start").over(Window.partitionBy(key, "idx").orderBy("word_no"))
    return g.withColumn("end", F.when(F.col("start").isNull() | (nxt >= F.col("start")), nxt))


def _agreed(c: str) -> Column:
    return F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))


def roll_up(results: DataFrame, key: str = KEY) -> DataFrame:
    """One row per song from its windows' results (idx, engine, confidence, processing_seconds, warnings).

    The first window names the engine; a confidence holds if all windows agree on it, times
    add up if every window has one, warnings are distinct in order.
    """
    said = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "warnings"))), lambda r: F.coalesce(r["warnings"], F.array().cast("array<string>"))))
    return results.groupBy(key).agg(
        F.min_by(F.struct("engine"), "idx")["engine"].alias("engine"), F.count("*").alias("windows"), _agreed("confidence").alias("confidence"),
        F.when(F.count("processing_seconds") == F.count("*"), F.sum("processing_seconds")).alias("processing_seconds"), F.array_distinct(said).alias("warnings"),
    )
