"""Song tables derived from the general test tables, as Spark plans that grow with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A vocabulary of labels that the derived timelines draw from.
LABELS = ["C", "Dm", "Em7", "F", "G7", "Am", "Bdim", "N", "C#m7", "Ebmaj7", "F#sus4", "Ab", "Bbm6", "C/E", "D9", "Gadd9", "Aaug", "E5", "Am/C", "Fmaj7", "Bm7", "Dbm", "G/B", "X", "Asus2"]
#: Start of the clock of derived timelines.
EPOCH = "2024-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), (index % len(LABELS)).cast("int") + 1)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song_id, seq, start (microseconds), end (null), label, event_id, value: each user's events as one timeline, open ends."""
    e = read(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(EPOCH).cast("timestamp"))
    x = e.select(F.col("user_id").alias("song_id"), F.col("event_id").alias("seq"), start.alias("start"), F.lit(None).cast("bigint").alias("end"), vocabulary(F.col("event_id")).alias("label"), "value", "event_type")
    return x


def close(df: DataFrame) -> DataFrame:
    """Ends at the next start; the last event lasts two seconds."""
    w = Window.partitionBy("song_id").orderBy("start", "seq")
    return df.withColumn("end", F.coalesce("end", F.lead("start").over(w), F.col("start") + 2_000_000))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return close(raw_events(spark, sf_dir)).select("song_id", "seq", "start", "end", "label", "value")


def hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth event missing, every third with another label."""
    x = raw_events(spark, sf_dir).filter("seq % 5 != 0")
    x = x.withColumn("label", F.when(F.col("seq") % 3 == 0, vocabulary(F.col("seq") + 7)).otherwise(F.col("label")))
    return close(x).select("song_id", "seq", "start", "end", "label", "value")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song_id, frame_no, chroma: vectors in the order of their id within a label; absolute values of the first twelve numbers."""
    e = read(spark, sf_dir, "embeddings")
    no = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").alias("song_id"), no.alias("frame_no"), F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double"))).alias("chroma"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels as events: seconds are characters, right where quality is 1; every ninth confidence is unknown."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("seconds"))
    conf = F.when(F.col("doc_id") % 9 != 0, (F.col("doc_id") * 37 % 100) / 100.0)
    x = d.join(read(spark, sf_dir, "labels"), "doc_id")
    return x.select("doc_id", "seconds", (F.col("quality") * F.col("seconds")).alias("correct_seconds"), conf.alias("confidence"), (conf * 0.2).alias("margin"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song_id, turn, ref, hyp: a turn of a conversation and the one after it."""
    c = read(spark, sf_dir, "conversations")
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select(F.col("conv_id").alias("song_id"), "turn", F.col("text").alias("ref"), nxt.alias("hyp")).filter("hyp is not null")
