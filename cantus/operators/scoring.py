"""Scores of hypothesis timelines against references, and summaries of them."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantus.functions.labels import with_equality, with_parsed
from cantus.functions.scalars import BANDS, TOP_BAND, confidence_band
from cantus.operators import aligning as A
from cantus.operators.timeline import KEY, boundaries, buckets, nearest_distance, overlap_join


def sides(ref: DataFrame, hyp: DataFrame, *on: str, view: str | None = None) -> DataFrame:
    """References and hypotheses of the same ``on`` (a song, say) side by side, their other columns as ref_ and hyp_; those of one side alone stay, with nulls.

    References that come in several views (column view) are never mixed: ``view`` names the one.
    """
    if "view" in ref.columns and view is None:
        raise ValueError("name the view of the reference")
    ref = ref.filter(F.col("view") == view).drop("view") if "view" in ref.columns else ref
    named = lambda df, s: df.select(*on, *(F.col(c).alias(f"{s}_{c}") for c in df.columns if c not in on))
    return named(ref, "ref").join(named(hyp, "hyp"), list(on), "full")


def label_overlaps(ref: DataFrame, hyp: DataFrame, width, key: str = KEY) -> DataFrame:
    """key, ref_label, hyp_label, overlap: how long each pair of labels sounds at once in a song."""
    pairs = overlap_join(ref.select(key, "start", "end", "label"), hyp.select(key, "start", "end", "label"), width, key=key)
    return pairs.groupBy(key, F.col("l_label").alias("ref_label"), F.col("r_label").alias("hyp_label")).agg(F.sum("overlap").alias("overlap"))


def duration_csr(ref: DataFrame, hyp: DataFrame, width, key: str = KEY) -> DataFrame:
    """key, equal, total, csr: overlapped time whose labels match over all overlapped time; an empty side gives 0. Both sides are partitions.

    Time is summed by pair of labels before labels are looked at; these are parsed once, from the two tables.
    """
    scored = with_equality(label_overlaps(ref, hyp, width, key), labels=ref.select("label").union(hyp.select("label")))
    hit = F.sum(F.when(F.col("score") > 0, F.col("overlap")).otherwise(0)).alias("equal")
    return csr_of_all(ref, hyp, scored.groupBy(key).agg(hit, F.sum("overlap").alias("total")), key)


def csr_of_all(ref: DataFrame, hyp: DataFrame, per: DataFrame, key: str) -> DataFrame:
    songs = ref.select(key).union(hyp.select(key)).distinct()
    per = songs.join(per, key, "left").fillna(0, ["equal", "total"])
    return per.withColumn("csr", F.coalesce(F.try_divide("equal", "total"), F.lit(0.0)))


def event_agreement(events: DataFrame, ref: DataFrame, width, key: str = KEY) -> DataFrame:
    """key, seq, seconds, correct_seconds of each event: time under reference segments of exactly its label, at most its length; misses are 0."""
    pairs = overlap_join(events.select(key, "seq", "start", "end", "label"), ref.select(key, "start", "end", "label"), width, key=key).filter("l_label = r_label")
    hit = pairs.groupBy(key, F.col("l_seq").alias("seq")).agg(F.sum("overlap").alias("_o"))
    x = events.join(hit, [key, "seq"], "left").withColumn("seconds", F.col("end") - F.col("start"))
    return x.withColumn("correct_seconds", F.least("seconds", F.coalesce("_o", F.lit(0)))).drop("_o")


def boundary_distances(ref: DataFrame, hyp: DataFrame, digits: int | None = 5, key: str = KEY) -> DataFrame:
    """key, ref_to_hyp, hyp_to_ref: median distance of each side's boundaries to the nearest of the other; null if that side is empty."""
    a, b = boundaries(ref, digits, key), boundaries(hyp, digits, key)
    med = lambda x, n: x.groupBy(key).agg(F.median("distance").alias(n))
    return med(nearest_distance(a, b, key), "ref_to_hyp").join(med(nearest_distance(b, a, key), "hyp_to_ref"), key, "full")


def directional_hamming(src: DataFrame, cuts: DataFrame, width, key: str = KEY) -> DataFrame:
    """key, distance: share of the source's time outside of the longest piece into which the other side's starts cut each interval.

    ``width`` of the time buckets is a number, or the name of a column that both sides have: an interval is a row a bucket, so long ones want wide buckets.
    """
    w = Window.partitionBy(key, "seq").orderBy("t")
    wide = F.col(width) if isinstance(width, str) else F.lit(width)
    points = cuts.select(key, F.col("start").alias("t"), F.floor(F.col("start") / wide).alias("_b"))
    s = src.select(key, "seq", "start", "end", F.explode(buckets(F.col("start"), F.col("end"), wide)).alias("_b"))
    inside = s.join(points, [key, "_b"]).filter("start < t and t < end").select(key, "seq", "start", "end", "t")
    marks = inside.union(src.select(key, "seq", "start", "end", F.col("start").alias("t"))).distinct()
    piece = F.coalesce(F.lead("t").over(w), F.col("end")) - F.col("t")
    longest = marks.withColumn("piece", piece).groupBy(key, "seq", "start", "end").agg(F.max("piece").alias("longest"))
    per = longest.groupBy(key).agg(F.sum(F.col("end") - F.col("start") - F.col("longest")).alias("lost"), (F.max("end") - F.min("start")).alias("span"))
    return per.select(key, F.coalesce(F.try_divide("lost", "span"), F.lit(0.0)).alias("distance"))


def segment_overlap(ref: DataFrame, hyp: DataFrame, width, key: str = KEY) -> DataFrame:
    """key, overlap: the smaller of one less each direction's distance."""
    a, b = directional_hamming(ref, hyp, width, key).withColumnRenamed("distance", "a"), directional_hamming(hyp, ref, width, key).withColumnRenamed("distance", "b")
    return a.join(b, key).select(key, F.least(1 - F.col("a"), 1 - F.col("b")).alias("overlap"))


def label_f1(ref: DataFrame, hyp: DataFrame, key: str = KEY) -> DataFrame:
    """key, bag_f1, set_f1: F1 of the labels as bags and as sets; two empty sides score 1."""
    r = ref.groupBy(key, "label").agg(F.count("*").alias("r"))
    h = hyp.groupBy(key, "label").agg(F.count("*").alias("h"))
    x = r.join(h, [key, "label"], "full").fillna(0, ["r", "h"])
    one = lambda c: (F.col(c) > 0).cast("int")
    g = x.groupBy(key).agg(F.sum(F.least("r", "h")).alias("bc"), F.sum("r").alias("br"), F.sum("h").alias("bh"), F.sum(one("r") * one("h")).alias("sc"), F.sum(one("r")).alias("sr"), F.sum(one("h")).alias("sh"))
    f1 = lambda c, a, b: F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(2 * F.col(c) / (F.col(a) + F.col(b)))
    return g.select(key, f1("bc", "br", "bh").alias("bag_f1"), f1("sc", "sr", "sh").alias("set_f1"))


def summarize(scores: DataFrame, metrics: list[str], by: str | None = None, totals: bool = False) -> DataFrame:
    """One row per metric (and group): mean, median, least, most, and how many have it, with ``totals`` the sum too; nulls are left out by metric."""
    ids = [by] if by else []
    long = scores.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(ids, metrics, "metric", "value")
    return long.groupBy(*ids, "metric").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("n"), *([F.sum("value").alias("total")] if totals else []))


def paired(a: DataFrame, b: DataFrame, metric: str, on: str) -> DataFrame:
    """One row: mean difference b - a of a metric over what both runs measured, its standard error and 95 % bounds, wins and losses."""
    d = a.select(on, F.col(metric).alias("_a")).join(b.select(on, F.col(metric).alias("_b")), on).select((F.col("_b") - F.col("_a")).alias("d"))
    g = d.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"))
    se = F.try_divide("sd", F.sqrt("n"))
    return g.select("n", "mean", se.alias("se"), (F.col("mean") - 1.96 * se).alias("low"), (F.col("mean") + 1.96 * se).alias("high"), "wins", "losses")


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Least number of insertions, deletions and changes between two sequences: a column of the table of distances is two whole numbers, whose bits say where it rises and falls."""
    n = len(a)
    if not n:
        return len(b)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every, last = (1 << n) - 1, 1 << n - 1
    rises, falls, out = every, 0, n
    for x in b:
        same = at.get(x, 0)
        down = same | falls
        across = ((same & rises) + rises ^ rises) | same
        more, less = falls | every & ~(across | rises), rises & across
        out += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & every, less << 1 & every
        rises, falls = less | every & ~(down | more), more & down
    return out


def _error_rate(cut: Callable[[str], Sequence]):
    @F.pandas_udf(T.DoubleType())
    def rate(ref: pd.Series, hyp: pd.Series) -> pd.Series:
        pairs = ((cut(a), cut(b)) for a, b in zip(ref.fillna(""), hyp.fillna(""), strict=True))
        return pd.Series([edit_distance(a, b) / len(a) if a else None for a, b in pairs], dtype="float64")

    return rate


def character_error_rate(ref: Column, hyp: Column) -> Column:
    """Edit distance of two texts over the reference's length; null without a reference."""
    return F.when(ref.isNotNull() & hyp.isNotNull(), _error_rate(str)(ref, hyp))


def word_error_rate(ref: Column, hyp: Column) -> Column:
    """Edit distance over words, divided by the reference's words; null without any. Words stand between spaces, and there may be any number."""
    return F.when(ref.isNotNull() & hyp.isNotNull(), _error_rate(lambda s: [w for w in s.split(" ") if w])(ref, hyp))


def align_labels(pairs: DataFrame, key: str = KEY) -> DataFrame:
    """Global alignment of two label sequences by song: matches, precision, recall, f1, score.

    ``pairs`` has key, ref and hyp (arrays of labels). Gaps cost 1 and mismatches
    a half; ties go to the diagonal, then up. Two empty sides are perfect. One song's sequences and
    a few rows as long as one of them are the only state of a step; rows are songs, so nothing is shuffled.
    """
    schema = f"{key} {pairs.schema[key].dataType.simpleString()}, matches double, precision double, recall double, f1 double, score double"

    def work(batches):
        for b in batches:
            out = []
            for k, r, h in zip(b[key], b["ref"], b["hyp"], strict=True):
                out.append((k, *align(*coded([] if r is None else list(r), [] if h is None else list(h)))))
            yield pd.DataFrame(out, columns=[key, "matches", "precision", "recall", "f1", "score"])

    return pairs.select(key, "ref", "hyp").mapInPandas(work, schema)


#: Views of a pair of labels: what must be equal.
VIEWS = ("exact", "root", "quality", "mirex")


def align_views(pairs: DataFrame, key: str = KEY) -> DataFrame:
    """key and f1, precision and recall of each of VIEWS, e.g. root_f1: alignments of ``pairs`` (key, ref, hyp).

    exact: equal labels; root: equal roots, silence has none; quality: equal qualities; mirex: labels whose
    notes match, worth up to 3, where a mismatch costs as much as a gap. Distinct labels are parsed, and distinct pairs of a song's
    labels scored, once, and sent along with the song.
    """
    kind = pairs.schema[key].dataType.simpleString()
    names = [f"{v}_{m}" for v in VIEWS for m in ("precision", "recall", "f1")]
    both = pairs.select(key, F.array_distinct(F.coalesce("ref", F.array())).alias("r"), F.array_distinct(F.coalesce("hyp", F.array())).alias("h"))
    used = both.select(key, F.explode("r").alias("ref_label"), "h").select(key, "ref_label", F.explode("h").alias("hyp_label"))
    scores = with_equality(used.select("ref_label", "hyp_label").distinct()).filter("score > 0")
    match = used.join(scores, ["ref_label", "hyp_label"]).groupBy(key).agg(F.collect_list(F.struct("ref_label", "hyp_label", "score")).alias("match"))
    one = both.select(key, F.explode(F.array_union("r", "h")).alias("label"))
    parts = with_parsed(one, "label").groupBy(key).agg(F.collect_list(F.struct("label", F.col("chord.root").alias("root"), F.col("chord.quality").alias("quality"))).alias("parts"))
    x = pairs.select(key, "ref", "hyp").join(parts, key, "left").join(match, key, "left")

    def work(batches):
        for b in batches:
            out = []
            for k, ref, hyp, own, hits in zip(b[key], b["ref"], b["hyp"], b["parts"], b["match"], strict=True):
                ref, hyp = [] if ref is None else list(ref), [] if hyp is None else list(hyp)
                root, quality = ({p["label"]: p[c] for p in ([] if own is None else own)} for c in ("root", "quality"))
                views = [coded(ref, hyp), coded([root[x] or ("no", i) for i, x in enumerate(ref)], [root[x] for x in hyp]), coded([quality[x] for x in ref], [quality[x] for x in hyp])]
                row = [k]
                for v in views:
                    row += align(*v)[1:4]
                r, h, table = coded(ref, hyp)
                ids = {x: i for x, i in zip([*ref, *hyp], [*r, *h], strict=True)}
                table = np.zeros_like(table)
                for p in [] if hits is None else hits:
                    table[ids[p["ref_label"]], ids[p["hyp_label"]]] = p["score"]
                out.append((*row, *align(r, h, table, miss=-1.0)[1:4]))
            yield pd.DataFrame(out, columns=[key, *names])

    return x.mapInPandas(work, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))


def coded(ref: list, hyp: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sequences as numbers, and a table of what each pair of numbers is worth: 1 if equal."""
    ids = {x: i for i, x in enumerate(dict.fromkeys([*ref, *hyp]))}
    return np.array([ids[x] for x in ref], int), np.array([ids[x] for x in hyp], int), np.eye(len(ids), dtype=np.float32)


def align(r: np.ndarray, h: np.ndarray, worth: np.ndarray, gap: float = 1.0, miss: float = -0.5) -> tuple[float, float, float, float, float]:
    """matches, precision, recall, f1, score of the best alignment; ``worth`` (whole numbers) of 0 is a mismatch. Keeps rows, and no table of all places."""
    n, m = len(r), len(h)
    if not n and not m:
        return 0.0, 1.0, 1.0, 1.0, 0.0
    lost, wrong, unit = A.whole_numbers(gap, miss, 1.0)
    score = np.where(worth > 0, (worth * unit).astype(np.int64), wrong)
    i, j = A.paired(A.trace(n, m, lambda k, lo, hi: score[r[k]][h[lo:hi]], lost))
    got = worth[r[i], h[j]]
    hits, p, q = float((got > 0).sum()), 0.0, 0.0
    if n and m:
        p, q = hits / m, hits / n
    return hits, p, q, (2 * p * q / (p + q) if p + q else 0.0), float(got.sum())


def word_time_errors(pairs: DataFrame, key: str = KEY) -> DataFrame:
    """key, median_seconds, mean_seconds, matched_words: distance of the starts of words that an edit alignment pairs and that are equal; null without any.

    ``pairs`` has key, ref and hyp, arrays of (text, start) as written. Words that are equal
    or swapped win ties, then those only in the reference.
    """
    kind = pairs.schema[key].dataType.simpleString()
    names = ["median_seconds", "mean_seconds", "matched_words"]

    def one(ref: pa.ListScalar, ref_at: pa.ListScalar, hyp: pa.ListScalar, hyp_at: pa.ListScalar) -> tuple[float | None, float | None, float]:
        same = np.array(A.same_pairs(ref.as_py() or [], hyp.as_py() or []), int).reshape(-1, 2)
        if not len(same):
            return None, None, 0.0
        d = np.abs(ref_at.values.to_numpy(zero_copy_only=False)[same[:, 0]] - hyp_at.values.to_numpy(zero_copy_only=False)[same[:, 1]])
        return float(np.median(d)), float(d.mean()), float(len(d))

    def work(batches):
        # row by row, so that no more than one song's words are Python objects
        for b in batches:
            rows = [one(*row) for row in zip(*(b.column(c) for c in ("ref", "ref_at", "hyp", "hyp_at")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(3))], names=[key, *names])

    flat = pairs.select(key, F.col("ref.text").alias("ref"), F.col("ref.start").alias("ref_at"), F.col("hyp.text").alias("hyp"), F.col("hyp.start").alias("hyp_at"))
    return flat.mapInArrow(work, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))


def edit_pairs(n: int, m: int, same: Callable[[int, int, int], np.ndarray]) -> list[tuple[int, int]]:
    """Places of the two sequences that a cheapest edit pairs and that are the same, in order; ``same(i, lo, hi)`` says which of lo to hi are as i. Where elements can be told by value, same_pairs() is faster."""
    i, j = A.paired(A.trace(n, m, lambda k, lo, hi: same(k, lo, hi).astype(np.int64) - 1, 1))
    return [(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if same(x, y, y + 1)[0]]


BAND_NAMES = [n for _, n in BANDS] + [TOP_BAND]


THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9)


def calibration_report(outcomes: DataFrame, *by: str, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Sums of outcomes for each ``by`` (a take, say), which can be stored, and pooled with others later: no ratio, no absolute value is in them.

    ``outcomes`` has seconds, correct_seconds, confidence (null: unknown, in no threshold).
    """
    p, s, c = F.col("confidence"), F.col("seconds"), F.col("correct_seconds")
    known = p.isNotNull()
    # the squared error of a confidence against seconds that are right and wrong
    square = c * (1 - p) * (1 - p) + (s - c) * p * p
    sums = {"seconds": s, "known": F.when(known, s), "correct": c, "square": F.when(known, square)}
    sums |= {f"s{int(t * 100)}": F.when(p >= t, s).otherwise(0) for t in thresholds} | {f"c{int(t * 100)}": F.when(p >= t, c).otherwise(0) for t in thresholds}
    sums |= {f"bias_{name}": F.when(confidence_band(p) == name, p * s - c).otherwise(0.0) for name in BAND_NAMES}
    aggs = [F.sum(v).alias(k) for k, v in sums.items()]
    return outcomes.groupBy(*by).agg(*aggs) if by else outcomes.agg(*aggs)


def pooled(reports: DataFrame, *by: str, total: bool = False) -> DataFrame:
    """Accuracy, Brier score, calibration error, and coverage and accuracy at each threshold of reports that are added up for each ``by``; with ``total`` for each left part of ``by`` too, and for all (null there).

    Brier and calibration error are over the known seconds, coverage over all. No reports give no row where ``by`` is given.
    """
    sums = [c for c in reports.columns if c in ("seconds", "known", "correct", "square") or c.startswith("bias_") or c[1:].isdigit()]
    group = reports.rollup(*by) if total and by else reports.groupBy(*by)
    x = group.agg(*(F.sum(c).alias(c) for c in sums))
    # distance of mean confidence and accuracy by band, over the known seconds
    gap = sum((F.abs(F.coalesce(c, F.lit(0.0))) for c in sums if c.startswith("bias_")), F.lit(0.0))
    cols = ["seconds", "known", F.try_divide("correct", "seconds").alias("accuracy"), F.try_divide("square", "known").alias("brier"), F.try_divide(gap, F.col("known")).alias("ece")]
    for n in (c[1:] for c in sums if c[0] == "s" and c[1:].isdigit()):
        cols += [F.try_divide(f"s{n}", "seconds").alias(f"coverage_{n}"), F.try_divide(f"c{n}", f"s{n}").alias(f"accuracy_{n}")]
    return x.select(*by, *cols)


def calibration(outcomes: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """One row: the pooled report of all outcomes."""
    return pooled(calibration_report(outcomes, thresholds=thresholds))


def band_report(outcomes: DataFrame, band: Column, names: list[str]) -> DataFrame:
    """band, seconds, correct, gap for every name, also those without seconds; gap: seconds times the distance of mean confidence and accuracy."""
    x = outcomes.filter("confidence is not null").groupBy(band.alias("band")).agg(F.sum("seconds").alias("seconds"), F.sum("correct_seconds").alias("correct"), F.sum(F.col("confidence") * F.col("seconds")).alias("mass"))
    every = outcomes.sparkSession.createDataFrame([(n,) for n in names], "band string")
    y = F.broadcast(every).join(x, "band", "left").fillna(0, ["seconds", "correct", "mass"])
    return y.select("band", "seconds", "correct", F.abs(F.col("mass") - F.col("correct")).alias("gap"))


def fit_logistic(outcomes: DataFrame, rounds: int = 100, tolerance: float = 1e-10) -> tuple[float, float, int] | None:
    """Slope, intercept and rounds of a logistic of margin for the right share of the seconds, by Newton steps.

    Each round is one aggregation of six sums; only they come to the driver. A step that makes the fit worse is halved. None with fewer than two margins or shares.
    """
    x = outcomes.filter("margin is not null and seconds > 0").select("margin", "seconds", (F.col("correct_seconds") / F.col("seconds")).alias("share"))
    n = x.agg(F.count_distinct("margin").alias("m"), F.count_distinct("share").alias("s")).collect()[0]
    if n["m"] < 2 or n["s"] < 2:
        return None
    x = x.cache()
    a, b, before, step = 8.0, 0.0, math.inf, (0.0, 0.0)
    for k in range(1, rounds + 1):
        z = F.greatest(F.lit(-300.0), F.least(F.lit(300.0), F.col("margin") * a + b))
        p = 1 / (1 + F.exp(-z))
        w, e = F.col("seconds") * p * (1 - p), F.col("seconds") * (F.col("share") - p)
        g = x.agg(F.sum(w * F.col("margin") ** 2).alias("mm"), F.sum(w * F.col("margin")).alias("m"), F.sum(w).alias("o"), F.sum(e * F.col("margin")).alias("em"), F.sum(e).alias("e"), F.sum(F.col("seconds") * (F.log1p(F.exp(z)) - F.col("share") * z)).alias("loss")).collect()[0]
        if g["loss"] > before * (1 + 1e-12):  # the step was too long: half of it
            step = (step[0] / 2, step[1] / 2)
            a, b = a - step[0], b - step[1]
            continue
        before = g["loss"]
        det = g["mm"] * g["o"] - g["m"] ** 2
        if abs(det) < 1e-300:
            break
        da, db = (g["em"] * g["o"] - g["e"] * g["m"]) / det, (g["e"] * g["mm"] - g["em"] * g["m"]) / det
        a, b, step = a + da, b + db, (da, db)
        if max(abs(da), abs(db)) < tolerance:
            break
    x.unpersist()
    return a, b, k


#: numbered() cuts the order into about so many parts.
PARTS = 200


def numbered(df: DataFrame, *order: str, out: str = "row") -> DataFrame:
    """Add the place of each row in the order of the columns, from 0.

    About PARTS rows, chosen by hash, cut the order into parts; rows are numbered
    inside of their part, and the counts of the parts before are added. No task sees all rows.
    """
    me = F.struct(*order)
    share = int(1_000_000 * min(1.0, PARTS / max(1, df.count()))) + 1
    cuts = df.filter(F.pmod(F.xxhash64(*order), F.lit(1_000_000)) < share).agg(F.array_sort(F.collect_set(me)).alias("_cuts"))
    x = df.crossJoin(F.broadcast(cuts)).withColumn("_part", F.size(F.filter("_cuts", lambda c: c <= me))).drop("_cuts")
    size = x.groupBy("_part").agg(F.count("*").alias("_n"))
    size = size.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # as many rows as there are parts
    here = Window.partitionBy("_part").orderBy(*order)
    return x.withColumn("_row", F.row_number().over(here) - 1).join(F.broadcast(size), "_part").withColumn(out, F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")


def parity_split(takes: DataFrame, *order: str) -> DataFrame:
    """Add held_out: every second row in the order of the columns (name by default)."""
    return numbered(takes, *(order or ("name",)), out="_place").withColumn("held_out", F.col("_place") % 2 == 1).drop("_place")
