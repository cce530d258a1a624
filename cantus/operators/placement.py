"""Placing chords and words on lyric lines, and comparing change points and chord sequences.

Lines are rows (key, seq, start, end, ...) on the songs' clock, as timelines are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantus.functions import labels as L
from cantus.operators import aligning as A
from cantus.operators import scoring as SC
from cantus.operators import timeline as TL
from cantus.operators.store import written

KEY = "song_id"
#: Chords in a row between lines, and the widths of such a row in characters.
ROW_CHORDS, LEAST_WIDTH, MOST_WIDTH = 8, 24, 80


def words_at(probes: DataFrame, lines: DataFrame, words: DataFrame, key: str = KEY, width=None) -> DataFrame:
    """Each probe (t, ...) with line and word, the seq of what sounds there; null where nothing does.

    ``words`` has line (a line's seq), seq, start and end. An open word lasts until
    the next word of its line, else to the line's end. Two as-of joins; ``width`` as there.
    """
    cols = probes.columns
    x = TL.as_of(probes, lines, key=key, width=width).select(*cols, F.col("event.seq").alias("line"), F.col("event.end").alias("_line_end"))
    mine = Window.partitionBy(key, "line").orderBy("start", "seq")
    w = words.filter("start is not null").withColumn("_next", F.lead("start").over(mine))
    keyed = lambda df: df.withColumn("_at", F.struct(key, "line"))
    x = TL.as_of(keyed(x), keyed(w).drop(key, "line"), key="_at")
    still = F.col("event.end").isNotNull() | (F.col("t") < F.coalesce("event._next", "_line_end", F.col("t") + 1))
    return x.select(*cols, "line", F.when(F.col("line").isNotNull() & still, F.col("event.seq")).alias("word"))


def owning_lines(chords: DataFrame, lines: DataFrame, key: str = KEY) -> DataFrame:
    """Each chord with line (the seq of the line it belongs to, null between lines) and before (how many lines start by then).

    The line is the last one that started, while it lasts; a chord before all
    lines that still sounds when the first one starts is the first one's.
    """
    first = lines.groupBy(key).agg(F.min_by(F.struct("seq", "start"), F.struct("start", "seq")).alias("_first"))
    nth = lines.withColumn("nth", F.row_number().over(TL.in_order(key)).cast("bigint"))
    cols = chords.columns
    x = TL.as_of(chords, nth, time="start", cover=False, key=key).join(first, key, "left")
    inside = F.col("start") < F.col("event.end")
    opening = F.col("event").isNull() & (F.col("end") > F.col("_first.start"))
    return x.select(*cols, F.when(inside, F.col("event.seq")).when(opening, F.col("_first.seq")).alias("line"), F.coalesce("event.nth", F.lit(0)).alias("before"))


def gap_rows(gaps: DataFrame, least_span, key: str = KEY) -> DataFrame:
    """Chords between lines (before, seq, start, end, label) in rows of eight: adds row, row_start, row_end, width and column.

    A row spans from its first chord's start to its last one's end, ``least_span`` at least; columns are in proportion.
    """
    order = Window.partitionBy(key, "before").orderBy("start", "seq")
    x = gaps.withColumn("row", F.floor((F.row_number().over(order) - 1) / ROW_CHORDS))
    row = Window.partitionBy(key, "before", "row")
    x = x.withColumn("row_start", F.min("start").over(row)).withColumn("_last", F.max(F.struct("start", "seq", "end")).over(row)["end"])
    x = x.withColumn("row_end", F.greatest("_last", F.col("row_start") + least_span)).drop("_last")
    width = F.greatest(F.lit(LEAST_WIDTH), F.least(F.lit(MOST_WIDTH), 6 + F.sum(F.length("label") + 2).over(row)))
    share = (F.col("start") - F.col("row_start")) / (F.col("row_end") - F.col("row_start"))
    x = x.withColumn("width", width)
    return x.withColumn("column", F.least(F.col("width") - 1, F.greatest(F.lit(0), F.bround(share * (F.col("width") - 1)))).cast("int"))


def spread_words(lines: DataFrame, least: float = 0.8, each: float = 0.4, key: str = KEY) -> DataFrame:
    """key, line, word_no, text, start, end: the words of timed lines (seq, text, start, end), evenly over their line.

    A line without a usable end lasts until the next one, else ``each`` a word and ``least`` at least.
    With a column words (array of text, start, end), lines whose words all have times keep them.
    """
    timed = lines.filter("start is not null")
    words = F.expr(r"filter(split(text, '\\s+'), w -> w != '')")
    if "words" in lines.columns:  # a line without text is that of its words
        said = F.when(F.col("text") != "", F.col("text")).otherwise(F.array_join(F.transform("words", lambda w: w["text"]), " "))
        timed = timed.withColumn("text", F.coalesce(said, F.array_join(F.transform("words", lambda w: w["text"]), " ")))
    x = timed.withColumn("_next", F.lead("start").over(TL.in_order(key))).withColumn("_w", words).filter("size(_w) > 0")
    end = F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(F.col("_next"))
    x = x.withColumn("_end", F.when(end > F.col("start"), end).otherwise(F.col("start") + F.greatest(F.lit(least), each * F.size("_w"))))
    step = (F.col("_end") - F.col("start")) / F.size("_w")
    made = F.transform("_w", lambda w, i: F.struct(w.alias("text"), (F.col("start") + i * step).alias("start"), (F.col("start") + (i + 1) * step).alias("end")))
    if "words" in lines.columns:
        given = (F.size("words") > 0) & F.forall("words", lambda w: F.coalesce(w["end"] > w["start"], F.lit(False)))
        made = F.when(given, F.transform("words", lambda w: F.struct(w["text"].alias("text"), w["start"].alias("start"), w["end"].alias("end")))).otherwise(made)
    x = x.select(key, F.col("seq").alias("line"), F.posexplode(made).alias("word_no", "w"))
    return x.select(key, "line", "word_no", "w.text", "w.start", "w.end")


def _hits(ref: np.ndarray, hyp: np.ndarray, window) -> int:
    """Pairs of sorted points at most ``window`` apart, each point in one pair at most: the first that fit is best on a line."""
    n = i = 0
    for t in ref:
        while i < len(hyp) and hyp[i] < t - window:
            i += 1
        if i < len(hyp) and hyp[i] <= t + window:
            n, i = n + 1, i + 1
    return n


def point_islands(ref: DataFrame, hyp: DataFrame, window, key: str = KEY) -> DataFrame:
    """key, ref, hyp: sorted points (t) of both sides that lie together: a next one is at most ``window`` (or hardly more) later. Only points of one island can be matched."""
    both = ref.select(key, "t", F.lit(0).alias("side")).unionByName(hyp.select(key, "t", F.lit(1).alias("side")))
    w = Window.partitionBy(key).orderBy("t", "side")
    far = F.col("t") - F.lag("t").over(w) > window * (1 + 1e-9)
    x = both.withColumn("_far", far).withColumn("island", F.count_if("_far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    points = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("t"))))
    return x.groupBy(key, "island").agg(points(0).alias("ref"), points(1).alias("hyp")).select(key, "ref", "hyp")


def change_points(ref: DataFrame, hyp: DataFrame, window, digits: int | None = 5, trim: bool = False, key: str = KEY) -> DataFrame:
    """key, change_precision, change_recall, change_f1 of boundaries within ``window``; 0 if a side is empty. With ``trim`` each side's first and last boundary don't count.

    Points are matched island by island: one pair is a comparison, and only islands of more points are walked, as arrays.
    """
    def side(df: DataFrame) -> DataFrame:
        x = TL.boundaries(df, digits, key)
        if trim:
            song = Window.partitionBy(key)
            x = x.withColumn("_a", F.min("t").over(song)).withColumn("_z", F.max("t").over(song)).withColumn("t", F.when((F.col("t") > F.col("_a")) & (F.col("t") < F.col("_z")), F.col("t")))
        return x.select(key, "t")

    @F.pandas_udf("bigint")
    def walked(ref: pd.Series, hyp: pd.Series) -> pd.Series:
        return pd.Series([_hits(r, h, window) for r, h in zip(ref, hyp, strict=True)], dtype="int64")

    r, h = side(ref), side(hyp)
    met = point_islands(r.filter("t is not null"), h.filter("t is not null"), window, key).filter("size(ref) > 0 AND size(hyp) > 0")
    n, m = F.size("ref"), F.size("hyp")
    first = lambda c: F.get(c, F.lit(0))
    pairs = met.filter((n == 1) & (m == 1)).select(key, ((first("hyp") >= first("ref") - window) & (first("hyp") <= first("ref") + window)).cast("bigint").alias("n"))
    more = met.filter((n > 1) | (m > 1)).select(key, walked("ref", "hyp").alias("n"))
    hits = pairs.union(more).groupBy(key).agg(F.sum("n").alias("n"))
    sizes = r.select(key, F.col("t").alias("r"), F.lit(None).cast(h.schema["t"].dataType).alias("h")).unionByName(h.select(key, F.lit(None).cast(r.schema["t"].dataType).alias("r"), F.col("t").alias("h"))).groupBy(key).agg(F.count("r").alias("lr"), F.count("h").alias("lh"))
    x = sizes.join(hits, key, "left").fillna(0, ["n"])
    share = lambda of: F.coalesce(F.try_divide(F.col("n").cast("double"), F.col(of)), F.lit(0.0))
    p, c = share("lh"), share("lr")
    return x.select(key, p.alias("change_precision"), c.alias("change_recall"), F.coalesce(F.try_divide(2 * p * c, p + c), F.lit(0.0)).alias("change_f1"))


def take_scores(ref: DataFrame, hyp: DataFrame, width, window, digits: int | None = 5, key: str = KEY) -> DataFrame:
    """All scores of each song of the reference, a row a song: recall by time (raw and of triads), overlap, change points, distances, counts.

    Time is summed by pair of labels once, and both views of the labels are looked up for each pair.
    """
    ref, hyp = (written(df.select(key, "seq", "start", "end", "label"), "take") for df in (ref, hyp))  # each score reads them
    labels = ref.select("label").union(hyp.select("label")).distinct()
    views = labels.select("label", F.explode(F.array(L.triad_scoring(F.col("label")))).alias("triad"))
    known = L.features(views.select(F.explode(F.array("label", "triad")).alias("label")))
    views = views.join(known, "label", "left").join(known.toDF("triad", "tf"), "triad", "left").select("label", F.struct("f", "triad", "tf").alias("v"))
    x = SC.label_overlaps(ref, hyp, width, key).join(views.toDF("ref_label", "_r"), "ref_label", "left").join(views.toDF("hyp_label", "_h"), "hyp_label", "left")
    raw = L.equality(F.col("ref_label"), F.col("hyp_label"), F.col("_r.f"), F.col("_h.f"))
    triad = L.equality(F.col("_r.triad"), F.col("_h.triad"), F.col("_r.tf"), F.col("_h.tf"))
    hit = lambda score: F.sum(F.when(score > 0, F.col("overlap")).otherwise(0)) / F.sum("overlap")
    csr = x.groupBy(key).agg(hit(raw).alias("csr"), hit(triad).alias("csr_triads"))
    counts = lambda df, s: df.groupBy(key).agg(F.count("*").alias(f"{s}_segments"), F.count_if(F.col("label") != "N").alias(f"{s}_chords"))
    out = counts(ref, "reference").join(counts(hyp, "hypothesis"), key, "left").join(csr, key, "left")
    for part in (SC.segment_overlap(ref, hyp, width, key).withColumnRenamed("overlap", "segment_overlap"), change_points(ref, hyp, window, digits, key=key), SC.boundary_distances(ref, hyp, digits, key)):
        out = out.join(part, key, "left")
    zero = ["csr", "csr_triads", "segment_overlap", "change_precision", "change_recall", "change_f1", "hypothesis_segments", "hypothesis_chords"]
    return out.fillna(0, zero).select(key, "csr", "csr_triads", "segment_overlap", "change_precision", "change_recall", "change_f1", "ref_to_hyp", "hyp_to_ref", "reference_segments", "reference_chords", "hypothesis_segments", "hypothesis_chords")


def edit_ops(ref: list, hyp: list, swap: float = 1.0, gap: float = 1.0) -> list[tuple]:
    """Cheapest edits that turn one sequence into another: (kind, place in ref, place in hyp); a pair wins ties, then a missing one. Keeps rows, and no table of all places."""
    r, h, _ = SC.coded(ref, hyp)
    wrong, lost = A.whole_numbers(swap, gap)
    moves = A.trace(len(r), len(h), lambda i, lo, hi: np.where(h[lo:hi] == r[i], 0, -wrong), lost)
    kinds = {A.UP: lambda i, j: ("missing", i, None), A.LEFT: lambda i, j: ("extra", None, j), A.PAIR: lambda i, j: ("match" if r[i] == h[j] else "substitution", i, j)}
    return [kinds[k](i, j) for k, i, j in zip(moves.tolist(), *(x.tolist() for x in A.places(moves)), strict=True)]


def align_charts(chart: DataFrame, detected: DataFrame, swap: float = 1.0, gap: float = 1.0, key: str = KEY) -> DataFrame:
    """key, step, kind, reference, hypothesis: cheapest alignment of a chart's chords with the detected ones, compared as triads, given as written.

    Both sides are (key, seq, label) in the order of seq; one song is one row, and its sequences are aligned in memory as long as they are.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        x = df.select(key, F.struct("seq", "label", L.triad_chart(F.col("label")).alias("triad")).alias("x"))
        return x.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x")).select(key, F.col("x.label").alias(name), F.col("x.triad").alias(f"{name}_triads"))

    both = side(chart, "reference").join(side(detected, "hypothesis"), key, "full")
    none = F.array().cast("array<string>")
    both = both.select(key, *[F.coalesce(c, none).alias(c) for c in both.columns if c != key])

    @F.pandas_udf("array<struct<kind:string,reference:int,hypothesis:int>>")
    def edits(r: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "reference": a, "hypothesis": b} for k, a, b in edit_ops(list(x), list(y), swap, gap)] for x, y in zip(r, h)])

    x = both.withColumn("ops", edits("reference_triads", "hypothesis_triads")).select("*", F.posexplode("ops").alias("step", "op"))
    pick = lambda c: F.get(F.col(c), F.col(f"op.{c}"))
    return x.select(key, "step", "op.kind", pick("reference").alias("reference_label"), pick("hypothesis").alias("hypothesis_label"))


def chart_pairs(chart: DataFrame, detected: DataFrame, key: str = KEY) -> DataFrame:
    """key, n, heard: places (from 0) of the chords of a chart and of the detected ones that a cheapest alignment puts side by side, equal or not."""
    ops = align_charts(chart, detected, key=key)
    before = Window.partitionBy(key).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    x = ops.withColumn("n", F.count_if(F.col("kind") != "extra").over(before) - 1).withColumn("heard", F.count_if(F.col("kind") != "missing").over(before) - 1)
    return x.filter(F.col("kind").isin("match", "substitution")).select(key, "n", "heard")


def chart_agreement(ops: DataFrame, key: str = KEY, songs: DataFrame | None = None) -> DataFrame:
    """key, matches, substitutions, missing, extra, precision, recall; a side without chords scores 0. Songs (of ``songs``) without chords on both sides agree: 1 and 1."""
    n = lambda k: F.count_if(F.col("kind") == k)
    g = ops.groupBy(key).agg(n("match").alias("matches"), n("substitution").alias("substitutions"), n("missing").alias("missing"), n("extra").alias("extra"))
    ratio = lambda lost: F.coalesce(F.try_divide(F.col("matches"), F.col("matches") + F.col("substitutions") + F.col(lost)), F.lit(0.0))
    g = g.withColumns({"precision": ratio("extra"), "recall": ratio("missing")})
    if songs is None:
        return g
    return songs.select(key).distinct().join(g, key, "left").fillna(0, ["matches", "substitutions", "missing", "extra"]).fillna(1.0, ["precision", "recall"])


def layer_summary(events: DataFrame, key: str = KEY) -> DataFrame:
    """key, events, mean_confidence (of the known), unknown, sources (distinct, sorted, joined) of each song's chord layer."""
    g = events.groupBy(key).agg(F.count("*").alias("events"), F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("confidence").isNull()).alias("unknown"), F.array_sort(F.collect_set(F.when(F.col("source") != "", F.col("source")))).alias("s"))
    return g.withColumn("sources", F.array_join("s", ", ")).drop("s")


def run_status(steps: DataFrame, key: str = KEY) -> DataFrame:
    """key, status (succeeded: all steps ok, partial: some, failed: none) and processing_seconds (null if no step has a time)."""
    ok = F.count_if(F.col("status") == "ok")
    status = F.when(ok == F.count("*"), "succeeded").when(ok > 0, "partial").otherwise("failed")
    return steps.groupBy(key).agg(status.alias("status"), F.sum("processing_seconds").alias("processing_seconds"))
