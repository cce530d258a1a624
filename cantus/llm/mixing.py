"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantus.llm.store import stable

WORD = r"[^\x20\x09-\x0D]+"
#: The hash has 60 bits; each level of the histogram looks at twelve more.
LEVEL_BITS, LEVELS, HASH_BITS = 12, 4, 60
#: The table of sources is broadcast only up to this many rows.
BROADCAST_SOURCES = 50_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Target of each (source, source_size): the budget is poured by weight and stops at the caps.

    Sorted by cap over weight, the capped sources come first, so that two sums
    over the sorted sources give the level at which the others stand.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    x = sources.withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    x = x.withColumn("cap_before", F.coalesce(F.sum("cap").over(order), F.lit(0.0))).withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    full = (F.col("budget") - F.col("cap_before")) * F.col("weight") >= F.col("cap") * F.col("weight_left")
    x = x.withColumn("full", full)
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    left = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    x = x.withColumn("target", F.round(F.when(F.col("full"), F.col("cap")).otherwise(rest * F.col("weight") / left), 6))
    return x.select("source", "source_size", "target")


def _spread(docs: DataFrame, table: DataFrame, rows: int) -> DataFrame:
    """Join a per-source table to documents: broadcast when it is small, else left to adaptive skew handling."""
    t = table.withColumnRenamed("source", "_source")
    return docs.join(F.broadcast(t) if rows <= BROADCAST_SOURCES else t, docs["source"].eqNullSafe(t["_source"])).drop("_source")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """How many words of each document a weighted mix takes: doc_id, source, size, source_size, target, taken.

    Sources in code-point order (null last) weigh ``weights``, repeating, and
    share ``share`` times all words; no source gets more than ``cap`` (at most 2)
    times its own words. A target beyond the source's size takes every
    document once and the rest a second time. Documents are chosen by a hash of
    their id: words are summed by source and hash bucket, the bucket where the
    running sum crosses the budget is refined by the next bits, level by level,
    and the final threshold filters documents without sorting them.

    Null or empty texts have size 0 and take 0. Rows that repeat a doc_id share
    one hash and are taken together. An empty table gives an empty result; other columns are ignored.
    """
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")
    sized = stable(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), h.alias("h")))
    sources = stable(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))
    n = sources.count()
    # r: words that the hash threshold has to give; once: whether every document is taken once beside that
    need = sources.withColumn("once", (F.col("target") > F.col("source_size")).cast("long")).withColumn("r", F.col("target") - F.col("once") * F.col("source_size"))
    need = need.withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        rest, last = HASH_BITS - level * LEVEL_BITS, level == LEVELS
        inside = _spread(sized.filter("size > 0"), need, n).filter(F.shiftright("h", rest + LEVEL_BITS) == F.col("prefix"))
        hist = inside.groupBy("source", F.shiftright("h", rest).alias("bucket")).agg(F.sum("size").alias("words"), F.min("below").alias("start"), F.min("r").alias("want"))
        run = F.col("start") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        hist = hist.withColumn("until", run).withColumn("crosses", F.col("until") >= F.col("want"))
        edge = hist.groupBy(F.col("source").alias("_source")).agg(
            F.min(F.when(F.col("crosses"), F.struct("bucket", "until", "words"))).alias("e"), F.max(F.struct("bucket", "until", "words")).alias("z")
        )
        e = F.coalesce("e", "z")
        edge = edge.select("_source", e["bucket"].alias("bucket"), e["until"].alias("until"), e["words"].alias("words"))
        need = need.join(F.broadcast(edge) if n <= BROADCAST_SOURCES else edge, need["source"].eqNullSafe(edge["_source"]), "left").drop("_source")
        low = F.col("until") - F.col("words")
        if last:  # the bucket on the edge goes in if that comes nearer
            near = (F.col("until") - F.col("r")) <= (F.col("r") - low)
            need = need.withColumn("threshold", F.coalesce((F.col("bucket") + F.when(near, 1).otherwise(0)), F.lit(0)))
        else:
            need = need.withColumn("prefix", F.coalesce("bucket", "prefix")).withColumn("below", F.coalesce(low, "below")).drop("bucket", "until", "words")
        need = stable(need)
    out = _spread(sized, need.select("source", "source_size", "target", "once", "threshold"), n)
    again = (F.shiftright("h", HASH_BITS - LEVELS * LEVEL_BITS) < F.col("threshold")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("once") + again)).alias("taken"))
