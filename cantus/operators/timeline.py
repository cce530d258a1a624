"""Operators on timelines: rows (key, seq, start, end, label) of half-open intervals.

``key`` columns name the song (or any other owner of a timeline); ``start``
and ``end`` are numbers on one clock. Each operator shuffles by the key once at most, and
those that only need windows of one song share its partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "song_id"


def in_order(key: str = KEY) -> Window:
    return Window.partitionBy(key).orderBy("start", "seq")


def close_intervals(df: DataFrame, track_end: Column | None = None, key: str = KEY, width=None) -> DataFrame:
    """Open ends close at the next start, the last one at ``track_end`` (null leaves it open).

    With ``width`` a song is windowed in buckets of time, and the first start of the next bucket that has one is carried to each, so that no task has a whole song.
    """
    last = track_end if track_end is not None else F.lit(None)
    if width is None:
        return df.withColumn("end", F.coalesce("end", F.lead("start").over(in_order(key)), last))
    x = df.withColumn("_b", F.floor(F.col("start") / width))
    after = Window.partitionBy(key).orderBy("_b")  # a row a bucket
    carry = x.groupBy(key, "_b").agg(F.min("start").alias("_s")).select(key, "_b", F.lead("_s").over(after).alias("_next"))
    x = x.withColumn("_lead", F.lead("start").over(Window.partitionBy(key, "_b").orderBy("start", "seq"))).join(carry, [key, "_b"], "left")
    return x.withColumn("end", F.coalesce("end", "_lead", "_next", last)).select(*dict.fromkeys([*df.columns, "end"]))


def check_partition(df: DataFrame, key: str = KEY) -> DataFrame:
    """Add error: 'negative', 'reversed' or 'overlap' (with the next interval), else null."""
    nxt = F.lead("start").over(in_order(key))
    return df.withColumn("error", F.when(F.col("start") < 0, "negative").when(F.col("end") < F.col("start"), "reversed").when(nxt < F.col("end"), "overlap"))


def bands(df: DataFrame, duration: Column, key: str = KEY) -> DataFrame:
    """Intervals clipped to their own end, the next start and the duration (if it is above 0); empty and late ones go. The next start is taken before any goes."""
    nxt = F.lead("start").over(in_order(key))
    limit = F.when(duration > 0, duration)
    out = df.withColumn("_d", limit).withColumn("end", F.least("end", nxt, "_d"))
    return out.filter((F.col("_d").isNull() | (F.col("start") < F.col("_d"))) & (F.col("end") > F.col("start"))).drop("_d")


def runs(df: DataFrame, value: str = "label", key: str = KEY, order: str = "seq") -> DataFrame:
    """Runs of equal values along ``order``: key, run, value, first and last of ``order``, count."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    x = df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w) - 1)
    return x.groupBy(key, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def frame_segments(frames: DataFrame, period: float, offset: float = 0.0, key: str = KEY) -> DataFrame:
    """Runs of frame labels as segments on the frame grid: key, seq, start, end, label. ``frames`` has frame_no, label and duration (null if unknown), which clamps the last end if it falls within the last segment."""
    r = runs(frames, "label", key, "frame_no").join(frames.groupBy(key).agg(F.max("duration").alias("_d")), key)
    w = Window.partitionBy(key).orderBy("run")
    start, end = F.col("first") * period + offset, (F.col("last") + 1) * period + offset
    end = F.when(F.lead("run").over(w).isNull() & (F.col("_d") > start) & (F.col("_d") < end), F.col("_d")).otherwise(end)
    return r.select(key, F.col("run").alias("seq"), start.alias("start"), end.alias("end"), "label")


def smooth_labels(frames: DataFrame, width: int = 5, key: str = KEY) -> DataFrame:
    """Majority of the labels in a centred window, clipped at the edges; the centre wins ties, else the first in the window."""
    half = width // 2
    w = Window.partitionBy(key).orderBy("frame_no").rowsBetween(-half, half)
    near = F.collect_list("label").over(w)
    x = frames.withColumn("_w", near)
    counts = F.transform("_w", lambda a: F.size(F.filter("_w", lambda b: a == b)))
    x = x.withColumn("_n", counts).withColumn("_m", F.array_max("_n"))
    own = F.size(F.filter("_w", lambda b: b == F.col("label"))) == F.col("_m")
    return x.withColumn("label", F.when(own, F.col("label")).otherwise(F.element_at("_w", F.array_position("_n", F.col("_m")).cast("int")))).drop("_w", "_n", "_m")


def merge_short(df: DataFrame, least: float, key: str = KEY) -> DataFrame:
    """Segments of under ``least`` join the one before; leading ones join the first segment whose end makes them long enough, under its label. Equal neighbours then become one.

    All short: one segment with the last label.
    """
    w = Window.partitionBy(key).orderBy("seq")
    every = Window.partitionBy(key)
    x = df.withColumn("_first", F.min("start").over(every))
    head = F.min(F.when(F.col("end") - F.col("_first") >= least, F.col("seq"))).over(every)
    last = F.max("seq").over(every)
    x = x.withColumn("_head", F.coalesce(head, last))
    # kept ones: the head, and later ones that are long enough
    x = x.withColumn("_keep", (F.col("seq") == F.col("_head")) | ((F.col("seq") > F.col("_head")) & (F.col("end") - F.col("start") >= least)))
    x = x.withColumn("_g", F.greatest(F.sum(F.col("_keep").cast("int")).over(w), F.lit(1)))
    g = x.groupBy(key, F.col("_g").alias("seq")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.when(F.col("_keep"), F.col("label"))).alias("label"))
    return coalesce_equal(g, key)


def coalesce_equal(df: DataFrame, key: str = KEY) -> DataFrame:
    """Neighbours of equal label as one segment, numbered anew."""
    w = Window.partitionBy(key).orderBy("seq")
    x = df.withColumn("_c", F.when(F.lag("label").over(w).eqNullSafe(F.col("label")) & F.lag("seq").over(w).isNotNull(), 0).otherwise(1)).withColumn("_r", F.sum("_c").over(w) - 1)
    return x.groupBy(key, F.col("_r").alias("seq")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("label").alias("label"))


def plan_windows(tracks: DataFrame, length: float, overlap: float, key: str = KEY) -> DataFrame:
    """key, idx, start, end: windows of ``length`` that overlap; the last is shortened, and none is planned that adds nothing. ``tracks`` has duration."""
    if not length > 0 or not 0 <= overlap < length:
        raise ValueError("length must be above 0, and overlap at least 0 and below it")
    step = length - overlap
    n = F.when(F.col("duration") > 0, F.greatest(F.lit(0), F.ceil((F.col("duration") - length) / step)).cast("int"))
    x = tracks.filter(n.isNotNull()).select(key, "duration", F.explode(F.sequence(F.lit(0), n)).alias("idx"))
    return x.select(key, "idx", (F.col("idx") * step).alias("start"), F.least(F.col("idx") * step + length, F.col("duration")).alias("end"))


def as_of(probes: DataFrame, events: DataFrame, time: str = "t", cover: bool = True, key: str = KEY, width=None) -> DataFrame:
    """Each probe with ``event``, the struct of the last event that started at or before its time (the later in seq on ties).

    With ``cover`` the event is null once its end is reached; an open end lasts. One sort per song, no range join. With ``width`` songs are sorted in buckets of
    time: the last event of each bucket is carried to the later ones (a row a bucket), so that no task has a whole song, however long.
    """
    cols = [c for c in events.columns if c != key]
    e = events.select(F.col(key), F.col("start").alias("_t"), F.lit(0).alias("_k"), F.col("seq").alias("_s"), F.struct(*cols).alias("event"))
    p = probes.select(F.col(key), F.col(time).alias("_t"), F.lit(1).alias("_k"), F.lit(0).cast(events.schema["seq"].dataType).alias("_s"), F.struct(*[c for c in probes.columns if c != key]).alias("probe"))
    both = e.unionByName(p, allowMissingColumns=True)
    parts = [key] if width is None else [key, "_b"]
    both = both if width is None else both.withColumn("_b", F.floor(F.col("_t") / width))
    w = Window.partitionBy(*parts).orderBy("_t", "_k", "_s").rowsBetween(Window.unboundedPreceding, 0)
    x = both.withColumn("event", F.last("event", ignorenulls=True).over(w)).filter("_k = 1")
    if width is not None:
        before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        ends = both.groupBy(key, "_b").agg(F.max_by("event", F.when(F.col("_k") == 0, F.struct("_t", "_s"))).alias("_last"))
        carry = ends.select(key, "_b", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
        x = x.join(carry, [key, "_b"]).withColumn("event", F.coalesce("event", "_carried"))
    if cover:
        x = x.withColumn("event", F.when(F.col("event.end").isNull() | (F.col("_t") < F.col("event.end")), F.col("event")))
    return x.select(key, "probe.*", "event")


def buckets(start: Column, end: Column, width) -> Column:
    """Numbers of the time buckets that an interval touches."""
    last = F.greatest(F.floor(start / width), F.ceil(end / width) - 1)
    return F.sequence(F.floor(start / width), last)


def overlap_join(left: DataFrame, right: DataFrame, width, how: str = "inner", key: str = KEY) -> DataFrame:
    """Pairs of intervals of a song that overlap: columns of the left prefixed l_, of the right r_, and overlap.

    An equi-join on (song, time bucket): a pair is counted in the bucket of its
    later start alone, so that long songs spread over buckets and no pair is double.
    """
    a = left.select(F.col(key), *[F.col(c).alias(f"l_{c}") for c in left.columns if c != key]).withColumn("_b", F.explode(buckets(F.col("l_start"), F.col("l_end"), width)))
    b = right.select(F.col(key), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key]).withColumn("_b", F.explode(buckets(F.col("r_start"), F.col("r_end"), width)))
    later = F.greatest("l_start", "r_start")
    x = a.join(b, [key, "_b"]).filter((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.floor(later / width) == F.col("_b")))
    return x.withColumn("overlap", F.least("l_end", "r_end") - later).drop("_b")


def covering(probes: DataFrame, events: DataFrame, width, key: str = KEY) -> DataFrame:
    """Each probe (probe_id, t) with the label of the latest event that still covers t, even if a later one has ended; null if none."""
    p = probes.withColumn("_b", F.floor(F.col("t") / width))
    e = events.withColumn("_b", F.explode(buckets(F.col("start"), F.col("end"), width))).withColumnRenamed("label", "e_label")
    hit = p.join(e, [key, "_b"]).filter((F.col("start") <= F.col("t")) & (F.col("t") < F.col("end")))
    best = hit.groupBy(key, "probe_id").agg(F.max_by("e_label", F.struct("start", "seq")).alias("label"))
    return probes.join(best, [key, "probe_id"], "left")


def boundaries(df: DataFrame, digits: int | None = 5, key: str = KEY) -> DataFrame:
    """key, t: distinct starts and ends, rounded if ``digits``."""
    t = F.explode(F.array("start", "end"))
    x = df.select(key, t.alias("t"))
    return (x.withColumn("t", F.bround("t", digits)) if digits is not None else x).distinct()


def nearest_distance(a: DataFrame, b: DataFrame, key: str = KEY) -> DataFrame:
    """key, t, distance from each boundary of a to the nearest one of b; null if b has none there. Two windows over the union, no range join."""
    both = a.select(key, "t", F.lit(1).alias("_a")).union(b.select(key, "t", F.lit(0).alias("_a")))
    other = F.when(F.col("_a") == 0, F.col("t"))
    before = F.last(other, ignorenulls=True).over(Window.partitionBy(key).orderBy("t", "_a").rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(other, ignorenulls=True).over(Window.partitionBy(key).orderBy("t", F.desc("_a")).rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn("distance", F.least(F.col("t") - before, after - F.col("t"))).filter("_a = 1").drop("_a")


def display_order(df: DataFrame, key: str = KEY) -> DataFrame:
    """Add pos: timed lines by start, then untimed ones, both as they stand."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(F.col("start").isNull(), "start", "seq")) - 1)


def uncovered(inserts: DataFrame, events: DataFrame, width, key: str = KEY) -> DataFrame:
    """The inserts (at) that no event covers: start <= at < end."""
    i = inserts.withColumn("_b", F.floor(F.col("at") / width))
    e = events.select(key, F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(buckets(F.col("start"), F.col("end"), width)).alias("_b"))
    return i.join(e, (i[key] == e[key]) & (i["_b"] == e["_b"]) & (e["_s"] <= i["at"]) & (i["at"] < e["_e"]), "left_anti").drop("_b")
