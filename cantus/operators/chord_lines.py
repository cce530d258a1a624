"""Lyrics with the chords above them: the column of each chord, labels that don't cover each other, and the rows in display order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantus.functions import labels as L
from cantus.operators import placement as PL
from cantus.operators.timeline import KEY, close_intervals

#: What a row between lines says, its least width, and its least span in seconds.
GAP_TEXT, GAP_WIDTH, GAP_SPAN = "· · ·", 24, 1.0
PLACED = T.ArrayType(T.StructType().add("label", "string").add("start", "double").add("end", "double").add("column", "integer").add("word", "integer"))


def word_offsets(text: str, words: str) -> Column:
    """Column of each word of the array ``words`` in the column ``text``, each searched from the end of the one before; a word that isn't there stands at the cursor."""
    found = f"if(coalesce(w.text, '') = '', 0, locate(w.text, {text}, a.cursor + 1))"
    at = f"if({found} > 0, {found} - 1, least(a.cursor, char_length({text})))"
    step = f"struct(array_append(a.at, {at}) as at, {at} + char_length(coalesce(w.text, '')) as cursor)"
    return F.expr(f"aggregate(coalesce({words}, array()), struct(cast(array() as array<int>) as at, 0 as cursor), (a, w) -> {step}, a -> a.at)")


def text_of(line_text: Column, words: Column) -> Column:
    """A line's own text, or its words joined."""
    joined = F.array_join(F.transform(F.coalesce(words, F.array().cast("array<struct<text:string,start:double,end:double>>")), lambda w: w["text"]), " ")
    return F.when(F.coalesce(line_text, F.lit("")) != "", line_text).otherwise(joined)


def chord_columns(chords: DataFrame, lines: DataFrame, key: str = KEY) -> DataFrame:
    """Chords (start, line: a line's seq) with column and word: where above their line they stand.

    ``lines`` has seq, start, stop (its end, known), text and words. Above the last timed word that started, the first one before all;
    without timed words in proportion to the line's time; always inside of the text. Word times are taken in the order of the words.
    """
    # a row of its own (explode) keeps the offsets from being computed anew for each word
    x = lines.select("*", F.explode(F.array(word_offsets("text", "words"))).alias("_at"))
    x = x.withColumn("_timed", F.expr("filter(transform(coalesce(words, array()), (w, i) -> struct(w.start as start, _at[i] as at, i as i)), w -> w.start is not null)"))
    x = chords.join(x.select(key, F.col("seq").alias("line"), F.col("start").alias("_s"), F.col("stop").alias("_e"), "text", "_timed"), [key, "line"])
    under = F.coalesce(F.expr("try_element_at(filter(_timed, w -> w.start <= start), -1)"), F.get("_timed", F.lit(0)))
    x = x.withColumn("_w", F.when(F.size("_timed") > 0, under))
    last = F.char_length("text") - 1
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("start") - F.col("_s")) / (F.col("_e") - F.col("_s"))))
    even = F.when(F.col("_e") > F.col("_s"), F.bround(share * last, 0).cast("int")).otherwise(0)
    column = F.when(last < 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.coalesce("_w.at", even), last)))
    return x.select(*chords.columns, column.cast("int").alias("column"), F.when(last >= 0, F.col("_w.i")).cast("int").alias("word"))


@F.pandas_udf(PLACED)
def apart(placed: pd.Series) -> pd.Series:
    """Labels of one row moved right until a space is between any two; the first keeps its column. Later ones start as early as those before let them."""

    def row(labels) -> list[dict]:
        out: list[dict] = []
        for c in sorted(labels, key=lambda c: (c["column"], c["start"])):
            at = c["column"]
            hit = True
            while hit:
                hit = False
                for o in out:
                    end = o["column"] + len(o["label"])
                    if at < end + 1 and o["column"] < at + len(c["label"]) + 1:
                        at, hit = end + 1, True
            out.append({**c, "column": at})
        return out

    return placed.map(lambda p: [] if p is None else row(p))


def chord_row(placed: Column) -> Column:
    """The labels at their columns as one text, without spaces at its end."""
    labels = F.array_sort(F.transform(placed, lambda c: F.struct(c["column"].alias("at"), c["label"].alias("label"))))
    return F.rtrim(F.aggregate(labels, F.lit(""), lambda a, c: F.concat(F.rpad(a, c["at"], " "), c["label"])))


def sheet_rows(lines: DataFrame, chords: DataFrame, flats: DataFrame | None = None, key: str = KEY) -> DataFrame:
    """key, pos, text, chord_row, chords, is_gap, start, end: lines with their chords, rows of chords between them, and untimed lines last.

    ``lines`` has seq, text, start, end and words (array of text, start, end); ``chords`` has seq, start, end and label. ``flats``
    (key, prefer_flats) says which songs are spelled with flats. Chords belong to the line they start in; those between lines
    are in rows of eight by the line that they precede. An open line lasts until the next one, the last one until the last chord, or four seconds.
    """
    timed = lines.filter("start is not null")
    c = chords.withColumn("_own", F.col("end"))
    c = close_intervals(c, F.col("start"), key).withColumn("end", F.greatest("start", "end"))
    if flats is not None:
        c = c.join(flats, key, "left").withColumn("label", F.when(F.coalesce("prefer_flats", F.lit(False)), L.spell_label(F.col("label"), F.lit(True))).otherwise(F.col("label"))).drop("prefer_flats")
    last = c.groupBy(key).agg(F.max("end").alias("_last"))
    stop = F.coalesce("end", F.lead("start").over(Window.partitionBy(key).orderBy("start", "seq")), F.when(F.col("_last") > F.col("start"), F.col("_last")), F.col("start") + 4.0)
    timed = timed.join(last, key, "left").withColumn("stop", stop).drop("_last").withColumn("text", text_of(F.col("text"), F.col("words")))
    owned = PL.owning_lines(c.select(key, "seq", "start", "end", "label", "_own"), timed.select(key, "seq", "start", F.col("stop").alias("end")), key)
    seated = chord_columns(owned.filter("line is not null"), timed, key)
    place = F.struct("label", "start", F.col("_own").alias("end"), "column", "word")
    above = seated.groupBy(key, F.col("line").alias("seq")).agg(F.collect_list(place).alias("chords")).withColumn("chords", apart(F.col("chords")))

    rows = timed.join(above, [key, "seq"], "left").select(key, "text", F.coalesce("chords", F.array().cast(PLACED)).alias("chords"), F.lit(False).alias("is_gap"), "start", "end", "seq")
    gaps = PL.gap_rows(owned.filter("line is null").drop("line"), GAP_SPAN, key)
    gap = F.struct("label", "start", F.col("_own").alias("end"), F.col("column").cast("int").alias("column"), F.lit(None).cast("int").alias("word"))
    g = gaps.groupBy(key, "before", "row", F.col("row_start"), F.col("row_end")).agg(F.collect_list(gap).alias("chords")).withColumn("chords", apart(F.col("chords")))
    rows = rows.unionByName(g.select(key, F.lit(GAP_TEXT).alias("text"), "chords", F.lit(True).alias("is_gap"), F.col("row_start").alias("start"), F.col("row_end").alias("end"), F.col("row").cast(lines.schema["seq"].dataType).alias("seq")))
    bare = lines.filter("start is null").select(key, text_of(F.col("text"), F.col("words")).alias("text"), F.array().cast(PLACED).alias("chords"), F.lit(False).alias("is_gap"), "start", F.lit(None).cast("double").alias("end"), "seq")
    rows = rows.unionByName(bare)
    order = Window.partitionBy(key).orderBy(F.col("start").isNull(), "start", F.col("is_gap").desc(), "seq")
    return rows.withColumn("pos", F.row_number().over(order) - 1).select(key, "pos", "text", chord_row(F.col("chords")).alias("chord_row"), "chords", "is_gap", "start", "end")
