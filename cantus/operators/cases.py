"""Benchmark of cases: references and hypotheses of songs, scored family by family, and reports of the scores.

A case has name, song, engine, ... and the structs reference and hypothesis. A
family of scores (lyrics, chords, key, tempo) is there only if both sides declare
it and the reference isn't empty; a hypothesis that declares an empty one is a
measured zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantus.functions import scalars as S
from cantus.functions import words as W
from cantus.operators import placement as PL
from cantus.operators import scoring as SC
from cantus.operators.store import written

KEY = "name"
#: Columns of a report, in its order.
CORE = ["song", "engine", "engine_version", "model", "duration_seconds", "processing_time_seconds", "peak_memory_bytes"]
NUMBERS = [
    "lyrics.wer", "lyrics.cer", "lyrics.word_timestamp_median_seconds", "lyrics.word_timestamp_mean_seconds", "lyrics.word_timestamp_matched_words",
    "chords.exact_f1", "chords.root_f1", "chords.quality_f1", "chords.mirex_f1", "chords.multiset_f1", "chords.palette_f1", "chords.segment_overlap",
    "chords.change_detection.precision", "chords.change_detection.recall", "chords.change_detection.f1", "chords.timing_error_median_seconds",
    "key.weighted_score", "key.exact", "key.relative", "tempo.absolute_bpm_error", "tempo.half_tempo_error", "tempo.double_tempo_error", "performance.real_time_factor",
]
TEXTS = ["key.relation", "tempo.interpretation"]
#: Distance at which a change of chord counts as found, and the least width of the time buckets of overlap joins.
WINDOW, WIDTH = 0.5, 60.0


def plain(metric: str) -> str:
    """The name of a metric's column; reports write it with dots."""
    return metric.replace(".", "_")


def declared(cases: DataFrame, family: str, empty: Column) -> DataFrame:
    """The cases whose two sides declare a family, with the columns ref and hyp; ``empty``, on ref, says when a reference has nothing to score."""
    x = cases.select(KEY, F.col(f"reference.{family}").alias("ref"), F.col(f"hypothesis.{family}").alias("hyp"))
    return x.filter(F.col("ref").isNotNull() & F.col("hyp").isNotNull() & ~empty)


def lyrics_scores(cases: DataFrame) -> DataFrame:
    """Word and character error rates of normalised texts."""
    x = declared(cases, "lyrics_text", F.lit(False)).select(KEY, W.normalize_transcript(F.col("ref")).alias("r"), W.normalize_transcript(F.col("hyp")).alias("h")).filter("r != ''")
    return x.select(KEY, SC.word_error_rate(F.col("r"), F.col("h")).alias("lyrics_wer"), SC.character_error_rate(F.col("r"), F.col("h")).alias("lyrics_cer"))


def timing_scores(cases: DataFrame) -> DataFrame:
    """Distances of the starts of equal words; both sides need words."""
    timed = lambda c: F.filter(c, lambda w: w["text"].isNotNull() & w["start"].isNotNull())
    x = declared(cases, "lyrics_words", F.lit(False)).select(KEY, timed("ref").alias("ref"), timed("hyp").alias("hyp")).filter("size(ref) > 0 AND size(hyp) > 0")
    return SC.word_time_errors(x, KEY).toDF(KEY, *(f"lyrics_word_timestamp_{c}" for c in ("median_seconds", "mean_seconds", "matched_words")))


def chord_scores(cases: DataFrame) -> DataFrame:
    """Overlap, found changes and timing of chord timelines. A case's time buckets are as wide as its chords are long on average, so that it has no more of them than chords."""
    x = declared(cases, "chords", F.size("ref") == 0)
    times = F.flatten(F.array("ref.start", "ref.end", "hyp.start", "hyp.end"))
    mean = (F.array_max(times) - F.array_min(times)) / (F.size("ref") + F.size("hyp"))
    x = x.withColumn("width", F.greatest(F.lit(WIDTH), mean))
    side = lambda c: x.select(KEY, "width", F.posexplode(c).alias("seq", "e")).select(KEY, "width", "seq", "e.*")
    ref, hyp = side("ref"), side("hyp")
    overlap = SC.segment_overlap(ref, hyp, "width", KEY).withColumnRenamed("overlap", "chords_segment_overlap")
    found = PL.change_points(ref, hyp, WINDOW, key=KEY).toDF(KEY, *(f"chords_change_detection_{m}" for m in ("precision", "recall", "f1")))
    apart = SC.boundary_distances(ref, hyp, key=KEY).select(KEY, F.col("ref_to_hyp").alias("chords_timing_error_median_seconds"))
    out = x.select(KEY).join(overlap, KEY, "left").join(found, KEY, "left").join(apart, KEY, "left")
    return out.fillna(0.0, [c for c in out.columns if c not in (KEY, "chords_timing_error_median_seconds")])


def label_scores(cases: DataFrame) -> DataFrame:
    """F1 of label sequences in four views, as bags and as sets."""
    x = declared(cases, "chord_labels", F.size("ref") == 0)
    side = lambda c: x.select(KEY, F.explode(c).alias("label"))
    bags = SC.label_f1(side("ref"), side("hyp"), KEY).toDF(KEY, "chords_multiset_f1", "chords_palette_f1")
    return SC.align_views(x, KEY).select(KEY, *(F.col(f"{v}_f1").alias(f"chords_{v}_f1") for v in SC.VIEWS)).join(bags, KEY, "left")


def field_scores(cases: DataFrame) -> DataFrame:
    """Key, tempo and speed: projections of the case itself. Tempos that aren't above 0 aren't scored."""
    key = F.when(F.col("reference.key").isNotNull() & F.col("hypothesis.key").isNotNull(), S.key_relation(F.col("reference.key"), F.col("hypothesis.key")))
    a, b = F.col("reference.tempo_bpm"), F.col("hypothesis.tempo_bpm")
    x = cases.select("*", key.alias("key_relation"), F.when((a > 0) & (b > 0), S.tempo_errors(a, b)).alias("t"))
    one = lambda name: F.when(F.col("key_relation").isNotNull(), (F.col("key_relation") == name).cast("double"))
    return x.select(
        KEY, "key_relation", S.key_score(F.col("key_relation")).alias("key_weighted_score"), one("exact").alias("key_exact"), one("relative").alias("key_relative"),
        F.col("t.same").alias("tempo_absolute_bpm_error"), F.col("t.half").alias("tempo_half_tempo_error"), F.col("t.double").alias("tempo_double_tempo_error"),
        F.col("t.interpretation").alias("tempo_interpretation"), S.real_time_factor(F.col("duration_seconds"), F.col("processing_time_seconds")).alias("performance_real_time_factor"),
    )


def score_cases(cases: DataFrame) -> DataFrame:
    """One row a case: name, CORE and a column for each metric, null where the case has none. ``name`` names a case; the families are joined on it."""
    parts = cases.sparkSession.sparkContext.defaultParallelism
    cases = written(cases.repartition(parts, KEY), "cases")  # each family reads its own columns of it; a case is little to read and much to score
    out = cases.select(KEY, *CORE)
    for scores in (lyrics_scores, timing_scores, chord_scores, label_scores, field_scores):
        out = out.join(scores(cases), KEY, "left")
    return out.select(KEY, *CORE, *(plain(m) for m in [*NUMBERS, *TEXTS]))


def engine_summary(scores: DataFrame, metrics: list[str], engine: str = "engine") -> DataFrame:
    """engine ('unknown' for null and empty), cases, and the mean of each metric over the cases that have it."""
    name = F.when(F.coalesce(F.col(engine), F.lit("")) == "", "unknown").otherwise(F.col(engine))
    return scores.groupBy(name.alias("engine")).agg(F.count("*").alias("cases"), *(F.avg(m).alias(m) for m in metrics))


def key_summary(keys: DataFrame, ref: str = "ref", est: str = "est") -> tuple[DataFrame, DataFrame]:
    """One row of accuracy and relative_error (0 without any key), and a row (relation, n) for each relation there is."""
    x = keys.select(S.key_relation(F.col(ref), F.col(est)).alias("relation"))
    share = lambda name: F.coalesce(F.avg((F.col("relation") == name).cast("double")), F.lit(0.0))
    every = keys.sparkSession.createDataFrame([(r,) for r in S.RELATION_WEIGHTS], "relation string")
    counts = F.broadcast(every).join(x.groupBy("relation").agg(F.count("*").alias("n")), "relation", "left").fillna(0, ["n"])
    return x.agg(share("exact").alias("accuracy"), share("relative").alias("relative_error")), counts


def fill_hypotheses(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """Cases with the output of an engine in their hypothesis.

    ``outputs`` has name, engine, engine_version, kind (chords, key, tempo, lyrics), the fields of that kind (chords,
    chord_labels, key, tempo_bpm, lyrics_text, lyrics_words), audio_seconds, processing_time_seconds and peak_memory_bytes.
    Only cases with audio and output change, and only the fields of the kind. A key that wasn't found is 'unknown'. An open last
    chord ends with the audio. The case's own duration wins over the measured one; measured time and memory win over stored ones.
    """
    o = outputs.select(KEY, F.struct(*(c for c in outputs.columns if c != KEY)).alias("o"))
    x = cases.join(o, KEY, "left").withColumn("hit", F.col("audio").isNotNull() & F.col("o").isNotNull())
    is_kind = lambda *k: F.col("hit") & F.col("o.kind").isin(*k)
    pick = lambda k, new, old: F.when(is_kind(k), new).otherwise(F.col(f"hypothesis.{old}"))
    chords = F.transform("o.chords", lambda c, i: F.struct(c["start"].alias("start"), F.coalesce(c["end"], F.get(F.col("o.chords"), i + 1)["start"], F.col("o.audio_seconds")).alias("end"), c["label"].alias("label")))
    new = {
        "lyrics_text": ("lyrics", F.col("o.lyrics_text")), "lyrics_words": ("lyrics", F.col("o.lyrics_words")), "chords": ("chords", chords),
        "chord_labels": ("chords", F.transform("o.chords", lambda c: c["label"])), "key": ("key", F.coalesce("o.key", F.lit("unknown"))),
        "tempo_bpm": ("tempo", F.coalesce("o.tempo_bpm", "hypothesis.tempo_bpm")),
    }
    hypothesis = F.struct(*(pick(k, v, c).alias(c) for c, (k, v) in new.items()))
    fill = {"engine": F.col("o.engine"), "engine_version": F.col("o.engine_version"), "duration_seconds": F.coalesce("duration_seconds", "o.audio_seconds")}
    fill |= {c: F.coalesce(f"o.{c}", c) for c in ("processing_time_seconds", "peak_memory_bytes")}
    x = x.withColumn("hypothesis", hypothesis).withColumns({c: F.when(F.col("hit"), v).otherwise(F.col(c)) for c, v in fill.items()})
    return x.select(*cases.columns)


def as_text(c: str, kind: str) -> Column:
    """A cell of a report: empty for null, six digits of a fraction."""
    value = F.col(c)
    if kind not in ("double", "float"):
        return F.coalesce(value.cast("string"), F.lit(""))
    # as %g does: no zeros at the end, powers of ten below 1e-4 and from 1e6 on
    e = F.floor(F.log10(F.abs(value)))
    text = F.when(value == 0, "0").when((e >= -4) & (e < 6), significant(value, e)).otherwise(F.regexp_replace(F.format_string("%.5e", value), r"\.?0*e", "e"))
    return F.when(value.isNull(), "").otherwise(text)


def significant(value: Column, exponent: Column) -> Column:
    """A number of six significant digits without zeros at its end."""
    out = F.lit(None).cast("string")
    for e in range(-4, 6):
        text = F.format_string(f"%.{5 - e}f", value)
        out = F.when(exponent == e, F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "") if e < 5 else text).otherwise(out)
    return out


def write_reports(scores: DataFrame, folder: str) -> None:
    """benchmark.json (a line a case), benchmark.csv (fixed columns, a header) and benchmark.md (summary by engine, then cases), each a folder of part files under ``folder``."""
    columns, scores = [*CORE, *NUMBERS, *TEXTS], written(scores, "scores")
    kinds = {f.name: f.dataType.simpleString() for f in scores.schema}
    metrics = F.struct(*(F.col(plain(m)).alias(m) for m in [*NUMBERS, *TEXTS]))
    scores.select(*CORE, metrics.alias("metrics")).write.mode("overwrite").json(f"{folder}/benchmark.json")
    cells = scores.select("name", *(as_text(plain(c), kinds[plain(c)]).alias(plain(c)) for c in columns))
    cells.select(*(F.col(plain(c)).alias(c) for c in columns)).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{folder}/benchmark.csv")
    markdown(scores).write.mode("overwrite").text(f"{folder}/benchmark.md")


def markdown(scores: DataFrame) -> DataFrame:
    """One column value: the lines of the report, in order, in one sorted table. Scores are written once: the summary, the cases and the sort's sample read them."""
    scores = written(scores, "scores")
    names = [plain(m) for m in [*NUMBERS, *TEXTS]]
    summary = engine_summary(scores, [plain(m) for m in NUMBERS])
    for m in TEXTS:
        summary = summary.withColumn(plain(m), F.lit(None).cast("string"))
    line = lambda df, *cols: F.concat(F.lit("| "), F.concat_ws(" | ", *(as_text(c, dict(df.dtypes)[c]) for c in cols)), F.lit(" |"))
    head = lambda part, *cols: [(part, 0, "| " + " | ".join(cols) + " |"), (part, 1, "| " + " | ".join("---" for _ in cols) + " |")]
    fixed = [(0, 0, "# Benchmark"), (0, 1, ""), (0, 2, "## Summary (mean per engine)"), (0, 3, ""), *head(1, "Engine", "Cases", *NUMBERS, *TEXTS), (2, 0, ""), (2, 1, "## Cases"), (2, 2, ""), *head(3, "Song", "Engine", "Duration (s)", *NUMBERS, *TEXTS)]
    lines = scores.sparkSession.createDataFrame([(p, k, "", t) for p, k, t in fixed], "part int, step int, at string, value string")
    rows = summary.select(F.lit(1).alias("part"), F.lit(2).alias("step"), F.col("engine").alias("at"), line(summary, "engine", "cases", *names).alias("value"))
    named = scores.withColumn("engine", F.coalesce("engine", F.lit("unknown")))
    rows = rows.union(named.select(F.lit(3), F.lit(2), F.col("name"), line(named, "song", "engine", "duration_seconds", *names)))
    return lines.union(rows).orderBy("part", "step", "at").select("value")
