"""Lyrics with times from the text of ``.lrc`` and ``.srt`` files.

The parsers take rows (name, text), so that a folder read by Spark or any table serves; each line is a row as soon as
possible. They return (name, seq, text, start, end, words), in order of time, untimed lines last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The formats' stamps, tags and their bounds.
STAMP = r"\[\d{1,3}:\d{1,2}(?:\.\d{1,3})?\]"
WORD_STAMP = r"<\d{1,3}:\d{1,2}(?:\.\d{1,3})?>"
OFFSET = r"(?i)^\[offset:([+-]?)\s*(\d+)\]"
NOTES = r"^(?:\s*(?!" + STAMP + r")\[[^\]]{1,64}\])+\s*"
CLOCK = r"\d{2}:\d{2}:\d{2}[,.]\d{1,3}"
WORDS = "array<struct<text:string,start:double,end:double>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of whole files under a path that Spark can read; a byte-order mark goes."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return raw.select(F.col("_metadata.file_path").alias("name"), F.regexp_replace("value", "^﻿", "").alias("text"))


def clock(stamp: Column) -> Column:
    """Seconds of '[mm:ss.fff]', '<mm:ss.fff>' or 'hh:mm:ss,fff'; a fraction is padded on the right."""
    whole = F.regexp_extract(stamp, r"([\d:]+)", 1)
    fraction = F.rpad(F.regexp_extract(stamp, r"[.,](\d+)", 1), 3, "0").cast("int")
    seconds = F.aggregate(F.split(whole, ":"), F.lit(0), lambda acc, x: acc * 60 + x.cast("int"))
    return seconds + fraction / 1000.0


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("name", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line_no", "line"))


def _words(body: Column, line_end: Column) -> Column:
    """Stamped words of a line; a word ends at the next one's start, the last one with its line."""
    stamps = F.regexp_extract_all(body, F.lit(f"({WORD_STAMP})"), F.lit(1))
    pieces = F.slice(F.split(body, WORD_STAMP, -1), 2, F.size(stamps) + 1)
    pairs = F.zip_with(stamps, pieces, lambda s, p: F.struct(_strip(p).alias("text"), clock(s).alias("start")))
    said = F.filter(pairs, lambda p: p["text"] != "")
    after = F.slice(said, 2, F.size(said) + 1)
    return F.zip_with(said, after, lambda p, n: F.struct(p["text"].alias("text"), p["start"].alias("start"), F.coalesce(n["start"], line_end).alias("end")))


def parse_lrc(texts: DataFrame) -> DataFrame:
    """Lines of ``.lrc`` texts.

    A line with several stamps becomes one row for each, also with an empty body. An offset moves the later lines' stamps,
    not those of words. Tags and blank lines are skipped. A line ends at the next timed one's start; the last stays open.
    """
    x = _lines(texts).withColumn("stamps", F.regexp_extract("line", f"^((?:{STAMP})*)", 1))
    x = x.withColumn("body", _strip(F.expr("substring(line, length(stamps) + 1)"))).withColumn("timed", F.col("stamps") != "")
    tag = ~F.col("timed") & F.col("body").startswith("[offset:") & F.col("body").rlike(OFFSET)
    signed = F.regexp_extract("body", OFFSET, 2).cast("bigint") * F.when(F.regexp_extract("body", OFFSET, 1) == "-", -1).otherwise(1)
    so_far = Window.partitionBy("name").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("moved", F.coalesce(F.last(F.when(tag, signed), ignorenulls=True).over(so_far), F.lit(0)) / 1000.0)
    x = x.withColumn("body", F.when(F.col("timed"), F.col("body")).otherwise(_strip(F.regexp_replace("body", NOTES, ""))))
    x = x.filter(F.col("timed") | (~tag & (F.col("body") != "")))
    starts = F.transform(F.regexp_extract_all("stamps", F.lit(f"({STAMP})"), F.lit(1)), lambda s: F.round(clock(s) + F.col("moved"), 3))
    x = x.select("name", "line_no", "body", F.posexplode_outer(F.when(F.col("timed"), starts)).alias("k", "start"))
    w = Window.partitionBy("name").orderBy(F.col("start").isNull(), "start", "line_no", "k")
    x = x.withColumn("seq", F.row_number().over(w) - 1).withColumn("end", F.lead("start").over(w))
    clean = _strip(F.regexp_replace(F.regexp_replace("body", WORD_STAMP, " "), r"\s+", " "))
    return x.select("name", "seq", clean.alias("text"), "start", "end", _words(F.col("body"), F.col("end")).cast(WORDS).alias("words"))


def parse_srt(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of ``.srt`` texts, and the rejected ones (name, block_no, line, error).

    The first line with an arrow times a block; lines of digits alone and blocks without times or text are
    skipped. Rejected: 'timing' if two times are not found, 'reversed' if the end comes first.
    """
    blocks = texts.select("name", F.posexplode(F.split("text", r"\n\s*\n")).alias("block_no", "block"))
    lines = F.filter(F.transform(F.split("block", r"\r\n|\n|\r"), _strip), lambda a: a != "")
    x = blocks.withColumn("lines", lines).withColumn("at", F.array_position(F.transform("lines", lambda a: a.contains("-->")), True)).filter("at > 0")
    x = x.withColumn("line", F.get("lines", (F.col("at") - 1).cast("int"))).withColumn("times", F.regexp_extract_all("line", F.lit(f"({CLOCK})"), F.lit(1)))
    x = x.withColumn("start", clock(F.get("times", F.lit(0)))).withColumn("end", clock(F.get("times", F.lit(1))))
    x = x.withColumn("error", F.when(F.size("times") < 2, "timing").when(F.col("end") < F.col("start"), "reversed"))
    said = F.filter("lines", lambda a, i: (i != F.col("at") - 1) & ~a.rlike(r"^\d+$"))
    x = x.withColumn("text", F.array_join(said, " "))
    w = Window.partitionBy("name").orderBy("start", "block_no")
    good = x.filter("error is null and text != ''").select("name", (F.row_number().over(w) - 1).alias("seq"), "text", "start", "end", F.array().cast(WORDS).alias("words"))
    return good, x.filter("error is not null").select("name", "block_no", "line", "error")


def parse_timed_text(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of all texts by the suffix of their name, and the rejected ones (name, error): an unknown suffix, a bad block, or no line at all."""
    suffix = F.lower(F.regexp_extract("name", r"(\.[^./]+)$", 1))
    srt, bad = parse_srt(texts.filter(suffix == ".srt"))
    failed = bad.select("name", "error").distinct()
    lines = parse_lrc(texts.filter(suffix == ".lrc")).unionByName(srt.join(failed, "name", "left_anti"))
    unknown = texts.filter(~F.coalesce(suffix.isin(".lrc", ".srt"), F.lit(False))).select("name", F.lit("suffix").alias("error"))
    empty = texts.filter(suffix.isin(".lrc", ".srt")).join(lines.select("name").union(failed.select("name")).distinct(), "name", "left_anti").select("name", F.lit("empty").alias("error"))
    return lines, unknown.union(failed).union(empty)
