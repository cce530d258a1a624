"""Registered queries of jobs that write: streams fed in parts, runs that are resumed, reports that are stored and pooled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantus.operators import jobs as JO
from cantus.operators import scoring as SC
from cantus.operators import seams as SE
from cantus.operators.store import fresh, written
from cantus.plans.more_queries import SECOND, _chord_layer, c8_effective_chords
from cantus.plans.queries import _OUT, _WIN, HOUR, ORACLES, _windowed, query, w7_merge_windows
from cantus.sources import corpus as CO
from cantus.sources import derived as D
from cantus.streaming import jobs as J

_RATES = "CAST(sum(s) AS BIGINT) AS seconds, CAST(sum(s) FILTER (p IS NOT NULL) AS BIGINT) AS known, sum(c) / sum(s) AS accuracy, sum(c * (1 - p) * (1 - p) + (s - c) * p * p) / sum(s) FILTER (p IS NOT NULL) AS brier"


@query(_OUT + f""", t AS (SELECT o.*, 'e' || o.doc_id % 3 AS engine, CASE WHEN o.doc_id % 2 = 0 THEN 'mix' ELSE 'solo' END AS view FROM o),
g AS (SELECT engine, view, {_RATES}, coalesce(sum(s) FILTER (p >= 0.7), 0) / sum(s) AS coverage_70 FROM t GROUP BY ROLLUP (engine, view)),
b AS (SELECT engine, view, least(floor(p * 5), 4) AS band, abs(sum(p * s - c)) AS gap FROM t WHERE p IS NOT NULL GROUP BY GROUPING SETS ((engine, view, least(floor(p * 5), 4)), (engine, least(floor(p * 5), 4)), (least(floor(p * 5), 4)))),
e AS (SELECT engine, view, sum(gap) AS gap FROM b GROUP BY ALL)
SELECT g.engine, g.view, seconds, known, round(accuracy, 9) AS accuracy, round(brier, 9) AS brier, round(gap / known, 9) AS ece, round(coverage_70, 9) AS coverage_70 FROM g LEFT JOIN e ON e.engine IS NOT DISTINCT FROM g.engine AND e.view IS NOT DISTINCT FROM g.view""")
def a5_pooled_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored report for each take, pooled by engine and view, by engine, and in all."""
    i = F.col("doc_id")
    x = D.outcomes(spark, sf_dir).withColumn("engine", F.format_string("e%d", i % 3)).withColumn("view", F.when(i % 2 == 0, "mix").otherwise("solo"))
    reports = written(SC.calibration_report(x.withColumn("take", F.floor(i / 50)), "take", "engine", "view"), "reports")
    digits = lambda c: F.round(c, 9).alias(c)
    return SC.pooled(reports, "engine", "view", total=True).select("engine", "view", "seconds", "known", *map(digits, ("accuracy", "brier", "ece", "coverage_70")))


@query("SELECT p_partkey AS name, p_size * 2 AS score FROM part")
def r13_resumed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the takes are measured; a run is killed after it wrote lines of a third; then it runs again, and again."""
    takes, folder, schema = D.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), "p_size"), fresh(spark, "results"), "name bigint, score int"
    measure = lambda x: x.select("name", (F.col("p_size") * 2).cast("int").alias("score"))
    left = lambda: CO.unmeasured(takes, CO.committed(spark, folder, schema))
    CO.append_run(measure(left().filter("name % 2 = 0")), folder, "first")
    CO.write_attempt(measure(left().filter("name % 3 = 0")), folder, "second")
    for _ in range(2):
        todo = left()
        if not todo.isEmpty():
            CO.append_run(measure(todo), folder, "second")
    return CO.committed(spark, folder, schema)


#: Events arrive in parts of five days by this clock: every seventh is a day and a half late, every fiftieth twelve days.
_LATE = {50: 288, 7: 36}
_PART = 120 * HOUR
_ARRIVED = f"""WITH a AS (SELECT event_type AS label, value, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS t, event_id FROM events),
p AS (SELECT *, (t + CASE WHEN event_id % 50 = 0 THEN {288 * HOUR} WHEN event_id % 7 = 0 THEN {36 * HOUR} ELSE 0 END) // {_PART} AS part FROM a),
m AS (SELECT part, max(max(t)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 * 1000 - {HOUR} AS mark FROM p GROUP BY part),
w AS (SELECT p.*, mark, (t // {3 * HOUR} - k) * {3 * HOUR} AS start FROM p JOIN m USING (part) CROSS JOIN range(2) r(k)),
x AS (SELECT *, coalesce(start + {6 * HOUR} <= mark, false) AS late FROM w)"""


def _late_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The events, and what sliding windows under a watermark of an hour emit as the parts arrive."""
    x, i = D.raw_events(spark, sf_dir), F.col("seq")
    late = F.coalesce(*(F.when(i % k == 0, h * HOUR) for k, h in _LATE.items()), F.lit(0))
    x = written(x.select(F.col("event_type").alias("label"), "value", F.timestamp_micros("start").alias("ts"), F.floor((F.col("start") + late) / _PART).alias("part")), "arrived")
    parts = [r[0] for r in x.select("part").distinct().orderBy("part").collect()]  # one number for each five days
    return x, J.feed((x.filter(F.col("part") == k).drop("part") for k in parts), lambda s: J.window_summary(s, "6 hours", "3 hours", "1 hour"), "update")


@query(_ARRIVED + f""" SELECT start, start + {6 * HOUR} AS "end", label, count(*) AS n, round(sum(value), 6) AS total FROM x WHERE NOT late GROUP BY start, label""")
def t1_late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of a stream in parts; rows behind the watermark of the parts before are dropped."""
    out = J.latest(_late_stream(spark, sf_dir)[1], "start", "end", "label")
    return out.select(F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "label", "n", F.round("total", 6).alias("total"))


@query(_ARRIVED + " SELECT label, CAST(count(*) FILTER (NOT late) AS BIGINT) AS counted, CAST(count(*) FILTER (late) AS BIGINT) AS late FROM x GROUP BY label")
def t1_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often rows counted in a window, and how often they came too late for one (an event is in two windows)."""
    x, out = _late_stream(spark, sf_dir)
    n = J.latest(out, "start", "end", "label").groupBy("label").agg(F.sum("n").alias("counted"))
    return x.groupBy("label").agg((F.count("*") * 2).alias("all")).join(n, "label", "left").fillna(0).select("label", "counted", (F.col("all") - F.col("counted")).alias("late"))


@query(f"SELECT song_id, seq, round(start * 1e-6, 6) AS start, round(\"end\" * 1e-6, 6) AS \"end\", label, source FROM ({ORACLES[w7_merge_windows.__name__]}) m")
def t2_seams_of_a_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of songs that arrive ten at a time, merged as they come."""
    x = _windowed(spark, sf_dir).withColumns({"start": F.col("start") * F.lit(SECOND), "end": F.col("end") * F.lit(SECOND), "idx": F.col("idx").cast("bigint")})
    x = written(x.select("song_id", "idx", "seq", "start", "end", "label", "source"), "windows")
    last = x.agg(F.max("idx")).collect()[0][0] or 0  # one number
    out = J.latest(J.feed((x.filter(F.floor(F.col("idx") / 10) == k) for k in range(last // 10 + 1)), J.seam_merge, "update"), "song_id", "seq")
    return out.select("song_id", "seq", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "label", "source")


@query(f"""SELECT song_id, seq, round(start * 1e-6, 6) AS start, round("end" * 1e-6, 6) AS "end", label, source FROM ({ORACLES[w7_merge_windows.__name__]}) m
WHERE song_id NOT IN (SELECT song_id FROM (WITH {_WIN} SELECT song_id, idx, min(start) AS s FROM cutup GROUP BY ALL) w WHERE song_id % 5 = 0 AND idx % 4 = 0 AND s < idx * {18 * HOUR} + 3600000000)""")
def c4_windowed_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of songs merged; every fourth window of every fifth song says that it began an hour later, and songs with an event before that are left out."""
    second = F.lit(SECOND)
    x = _windowed(spark, sf_dir).withColumns({"start": F.col("start") * second, "end": F.col("end") * second})
    late = F.when((F.col("song_id") % 5 == 0) & (F.col("idx") % 4 == 0), 3600.0).otherwise(0.0)
    windows = x.select("song_id", "idx").distinct().withColumn("start", F.col("idx") * 64_800.0 + late)
    none = windows.select("song_id", "idx", *(F.lit(None).cast(t).alias(c) for c, t in (("engine", "string"), ("confidence", "double"), ("processing_seconds", "double"), ("warnings", "array<string>"))))
    merged, _, _ = JO.windowed_chords(x, windows, none)
    return merged.select("song_id", "seq", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "label", "source")


@query("""WITH l AS (SELECT conv_id AS song_id, turn AS idx, k AS seq, turn * 40 + k * 16 + 0.0 AS s, turn * 40 + k * 16 + 15.0 AS e FROM conversations CROSS JOIN range(4) r(k)),
w AS (SELECT song_id, idx, seq, s, e, s + 4 * i AS ws, s + 4 * i + 3 AS we, i FROM l CROSS JOIN range(4) r(i) WHERE seq < 3),
f AS (SELECT song_id, idx, max(greatest(idx * 40 + 50.0, e)) AS reach FROM l GROUP BY ALL), g AS (SELECT song_id, idx, max(reach) OVER (PARTITION BY song_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM f),
k AS (SELECT l.song_id, l.idx, l.seq, l.s, l.e, count(w.i) AS n, min(w.ws) AS first FROM l JOIN g USING (song_id, idx) LEFT JOIN w ON w.song_id = l.song_id AND w.idx = l.idx AND w.seq = l.seq AND (f IS NULL OR w.ws >= f) GROUP BY ALL HAVING count(w.i) > 0 OR l.seq = 3)
SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY idx, seq) - 1 AS seq, s AS start, e AS "end", n AS n_words, first FROM k""")
def w8_merged_lyrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of fifty seconds each forty: three lines of four words and one without words in each; what an earlier window heard goes."""
    turns = D.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("song_id"), F.col("turn").alias("idx"))
    windows = turns.select("song_id", "idx", (F.col("idx") * 40.0).alias("start"), (F.col("idx") * 40.0 + 50).alias("end"))
    k = turns.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(3))))
    at = F.col("seq") * 16.0
    four = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.lit("la").alias("text"), (at + i * 4).alias("start"), (at + i * 4 + 3).alias("end")))
    lines = k.select("song_id", "idx", "seq", at.alias("start"), (at + 15).alias("end"), F.when(F.col("seq") < 3, four).otherwise(F.array().cast("array<struct<text:string,start:double,end:double>>")).alias("words"))
    merged = SE.merge_lyrics(lines, windows)
    return merged.select("song_id", "seq", "start", "end", F.size("words").alias("n_words"), F.get("words", F.lit(0))["start"].alias("first"))


@query(ORACLES[c8_effective_chords.__name__])
def t3_live_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers and then commands as a stream, a command of each song at a time: two semitones up, simplified, and a transposition that is undone."""
    base = _chord_layer(spark, sf_dir)
    layers = base.withColumn("kind", F.lit("base"))
    songs = base.filter("song_id % 3 = 0").select("song_id").distinct()
    command = lambda k, kind, n: songs.select("song_id", F.lit(k).cast("bigint").alias("seq"), F.lit(kind).alias("kind"), F.lit(n).cast("bigint").alias("semitones"))
    fields = [f"cast(null as {t}) as {c}" for c, t in J.TYPES.items() if c not in layers.columns]
    whole = layers.selectExpr("*", *fields)
    cmds = [command(k, *c).unionByName(whole.limit(0), allowMissingColumns=True) for k, c in enumerate([("transpose", 2), ("simplify", None), ("transpose", 5), ("undo", None)])]
    out = J.newest(J.feed((x.select(*whole.columns) for x in [whole, *cmds]), J.live_layers, "update", on_disk=True))
    return out.select("song_id", "seq", "root", "quality", "source", "label")
