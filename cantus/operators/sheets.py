"""Sheets of lyrics with chords: one text per song, built by joins and ordered groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantus.operators.timeline import KEY, as_of


def _fold(text: Column) -> Column:
    """One printable line."""
    return F.replace(F.translate(text, "\n\r", "  "), F.lit("\t"), F.lit("    "))


def _in_order(order: str, text: str, glue: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]), glue)


def chords_over_words(lines: DataFrame, events: DataFrame, key: str = KEY) -> DataFrame:
    """(key, line_no, word_no, text, chord) of the words of lines whose words all have start and end; chord is the label that sounds as the word starts, null in a gap."""
    whole = F.col("start").isNotNull() & (F.size("words") > 0) & F.forall("words", lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    words = lines.filter(whole).select(key, "line_no", F.posexplode("words").alias("word_no", "w")).select(key, "line_no", "word_no", F.col("w.text").alias("text"), F.col("w.start").alias("t"))
    return as_of(words, events, key=key).select(key, "line_no", "word_no", "text", F.when(F.col("event.label") != "", F.col("event.label")).alias("chord"))


def chordpro(songs: DataFrame, lines: DataFrame, events: DataFrame, key: str = KEY) -> DataFrame:
    """(key, sheet) of songs (title, key_label, bpm; each may be null), their lines (line_no, kind, text, start, words) and chords.

    Lines without times of all words are printed plain, null texts empty; instrumental ones as an empty chorus. A song without lines has a heading alone.
    """
    piece = F.concat(F.when(F.col("word_no") > 0, " ").otherwise(""), F.coalesce(F.concat(F.lit("["), "chord", F.lit("]")), F.lit("")), F.coalesce("text", F.lit("")))
    sung = chords_over_words(lines, events, key).withColumn("piece", piece).groupBy(key, "line_no").agg(F.rtrim(_in_order("word_no", "piece", "")).alias("sung"))
    x = lines.join(sung, [key, "line_no"], "left")
    x = x.withColumn("line", F.when(F.col("kind") == "instrumental", "{soc}\n{eoc}").otherwise(F.coalesce("sung", _fold(F.col("text")), F.lit(""))))
    body = x.groupBy(key).agg(_in_order("line_no", "line", "\n").alias("body"))
    head = F.concat_ws(
        "\n", F.concat(F.lit("{title: "), F.coalesce("title", F.lit("Unknown title")), F.lit("}")), F.concat(F.lit("{key: "), "key_label", F.lit("}")),
        F.concat(F.lit("{tempo: "), F.bround("bpm", 0).cast("bigint").cast("string"), F.lit("}")), F.lit(""), "body",
    )
    return songs.join(body, key, "left").select(key, F.concat(head, F.lit("\n")).alias("sheet"))
