"""The registered queries of the timeline library, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cantus.functions import labels as L
from cantus.functions import scalars as S
from cantus.functions import words as WO
from cantus.operators import cases as CA
from cantus.operators import decoding as DE
from cantus.operators import frames as FR
from cantus.operators import jobs as JO
from cantus.operators import placement as PL
from cantus.operators import scoring as SC
from cantus.operators import seams as SE
from cantus.operators import sheets as SH
from cantus.operators import timeline as TL
from cantus.sources import corpus as CO
from cantus.sources import derived as D
from cantus.sources import timed_text as TT
from cantus.streaming import jobs as J

QUERIES: dict = {}
ORACLES: dict = {}
HOUR = 3_600_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_LIST = "[" + ", ".join(f"'{x}'" for x in D.LABELS) + "]"
_RAW = f"""raw AS (SELECT user_id AS song_id, event_id AS seq, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS start, {_LIST}[1 + event_id % 25] AS label, value, event_type FROM events)"""
_REF = _RAW + """, ref AS (SELECT song_id, seq, start, coalesce(lead(start) OVER (PARTITION BY song_id ORDER BY start, seq), start + 2000000) AS "end", label, value FROM raw)"""
_HYP = f"""hyp AS (SELECT song_id, seq, start, coalesce(lead(start) OVER (PARTITION BY song_id ORDER BY start, seq), start + 2000000) AS "end", CASE WHEN seq % 3 = 0 THEN {_LIST}[1 + (seq + 7) % 25] ELSE label END AS label, value FROM raw WHERE seq % 5 <> 0)"""
_BOTH = f"WITH {_REF}, {_HYP}"


def _rows(table: dict) -> str:
    q = lambda s: "'" + str(s).replace("'", "''") + "'"
    return ", ".join(f"({q(k)}, {v if isinstance(v, (int, list)) else q(v)})" for k, v in table.items())


# parsing in SQL: the quality table holds suffixes in both cases
_PARSE = f"""pcs(note, pc) AS (VALUES {_rows(L.PITCH)}), suf(suffix, quality) AS (VALUES {_rows(L.SUFFIX_QUALITY)}), names AS (SELECT {L.NOTES} AS n),
lab AS (SELECT DISTINCT label FROM ref UNION SELECT DISTINCT label FROM hyp),
cut AS (SELECT label, upper(substr(label, 1, 1)) || substr(regexp_extract(label, '^([A-Ga-g][#b]{{0,2}})', 1), 2) AS r, regexp_extract(label, '^[A-Ga-g][#b]{{0,2}}(.*)$', 1) AS rest, lower(label) IN ('n', 'nc', 'no chord', 'nochord', 'none', 'silence', 'x') AS silent FROM lab),
cut2 AS (SELECT *, regexp_extract(rest, '^([^/]*)', 1) AS sfx, regexp_extract(rest, '^[^/]*/(.*)$', 1) AS bt FROM cut),
parsed AS (SELECT label, CASE WHEN NOT silent THEN names.n[1 + p.pc] END AS root, CASE WHEN silent THEN 'no_chord' WHEN p.pc IS NULL THEN 'unknown' WHEN rest LIKE '%/%' AND NOT regexp_full_match(bt, '[A-Ga-g][#b]{{0,2}}') THEN 'other' ELSE coalesce(s1.quality, s2.quality, 'other') END AS quality,
  CASE WHEN NOT silent AND bt <> '' THEN names.n[1 + b.pc] END AS bass
  FROM cut2 CROSS JOIN names LEFT JOIN pcs p ON p.note = r LEFT JOIN suf s1 ON s1.suffix = sfx LEFT JOIN suf s2 ON s2.suffix = lower(sfx) LEFT JOIN pcs b ON b.note = upper(substr(bt, 1, 1)) || substr(bt, 2))"""
_PCS = f"""iv(quality, steps) AS (VALUES {_rows(L.INTERVALS)}), voiced AS (SELECT label, root, quality, bass, list_position({L.NOTES}, root) - 1 AS rp, list_position({L.NOTES}, bass) - 1 AS bp, coalesce(steps, CASE WHEN quality = 'other' THEN [0, 7] END) AS steps FROM parsed LEFT JOIN iv USING (quality)),
sets AS (SELECT *, CASE WHEN root IS NULL THEN [] ELSE list_transform(steps, lambda i: (i + rp) % 12) END AS pcs FROM voiced)"""
_SCORE = """CASE WHEN r.label = 'N' OR h.label = 'N' OR len(r.pcs) = 0 OR len(h.pcs) = 0 THEN CAST(r.label = h.label AS INT)
 WHEN len(list_intersect(r.pcs, h.pcs)) >= CASE WHEN r.quality IN ('aug', 'dim') THEN 2 ELSE 3 END OR (len(list_intersect(r.pcs, h.pcs)) = 2 AND r.bp IS NOT NULL AND r.bp <> r.rp AND list_contains(h.pcs, r.bp))
 THEN 1 + CAST(coalesce(r.bp <> r.rp AND list_contains(h.pcs, r.bp), false) AS INT) + CAST(coalesce(h.bp <> h.rp AND list_contains(r.pcs, h.bp), false) AS INT) ELSE 0 END"""
_OVER = """ov AS (SELECT r.song_id, r.seq AS rseq, h.seq AS hseq, r.label AS rl, h.label AS hl, least(r."end", h."end") - greatest(r.start, h.start) AS o FROM ref r JOIN hyp h ON r.song_id = h.song_id AND r.start < h."end" AND h.start < r."end")"""
_CSR = f"""{_BOTH}, {_PARSE}, {_PCS}, {_OVER}, sc AS (SELECT r.label AS rl, h.label AS hl, {_SCORE} AS score FROM sets r CROSS JOIN sets h),
csr AS (SELECT song_id, CAST(sum(CASE WHEN score > 0 THEN o ELSE 0 END) AS BIGINT) AS equal, CAST(sum(o) AS BIGINT) AS total FROM ov JOIN sc USING (rl, hl) GROUP BY song_id),
songs AS (SELECT DISTINCT song_id FROM ref), full_csr AS (SELECT song_id, coalesce(equal, 0) AS equal, coalesce(total, 0) AS total, coalesce(equal / nullif(total, 0), 0) AS csr FROM songs LEFT JOIN csr USING (song_id))"""


@query(_CSR + " SELECT * FROM full_csr")
def j1_duration_csr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.duration_csr(D.reference(spark, sf_dir), D.hypothesis(spark, sf_dir), 12 * HOUR)


@query(_CSR + " SELECT 'csr' AS metric, avg(csr) AS mean, median(csr) AS median, min(csr) AS least, max(csr) AS most, count(csr) AS n FROM full_csr")
def a1_csr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.summarize(j1_duration_csr(spark, sf_dir), ["csr"])


@query(f"WITH {_REF} SELECT song_id, seq, start, \"end\", label FROM ref")
def w1_close_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.close_intervals(D.raw_events(spark, sf_dir), F.col("start") + 2_000_000, width=24 * HOUR).select("song_id", "seq", "start", "end", "label")


@query(f"""WITH {_REF}, x AS (SELECT song_id, seq, start, "end" + (seq % 4) * 1000 AS "end" FROM ref) SELECT song_id, seq, CASE WHEN lead(start) OVER (PARTITION BY song_id ORDER BY start, seq) < "end" THEN 'overlap' END AS error FROM x""")
def v2_partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = D.reference(spark, sf_dir).withColumn("end", F.col("end") + (F.col("seq") % 4) * 1000)
    return TL.check_partition(x).select("song_id", "seq", "error")


@query(f"""WITH {_REF}, x AS (SELECT song_id, seq, label, start, least("end", lead(start) OVER (PARTITION BY song_id ORDER BY start, seq), {400 * HOUR}) AS "end" FROM ref) SELECT * FROM x WHERE start < {400 * HOUR} AND "end" > start""")
def w2_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.bands(D.reference(spark, sf_dir), F.lit(400 * HOUR)).select("song_id", "seq", "label", "start", "end")


_TYPES = f"WITH {_RAW}, f AS (SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY start, seq) - 1 AS frame_no, event_type AS label FROM raw)"


def _type_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("song_id").orderBy("start", "seq")
    return D.raw_events(spark, sf_dir).select("song_id", (F.row_number().over(w) - 1).alias("frame_no"), F.col("event_type").alias("label")).withColumn("duration", F.lit(None).cast("double"))


@query(_TYPES + """, c AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY song_id ORDER BY frame_no) = label THEN 0 ELSE 1 END AS c FROM f), r AS (SELECT *, sum(c) OVER (PARTITION BY song_id ORDER BY frame_no) - 1 AS seq FROM c)
SELECT song_id, CAST(seq AS BIGINT) AS seq, label, min(frame_no) * 0.5 AS start, (max(frame_no) + 1) * 0.5 AS "end" FROM r GROUP BY song_id, seq, label""")
def w3_frame_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.frame_segments(_type_frames(spark, sf_dir), 0.5)


@query(_TYPES + """, n AS (SELECT a.song_id, a.frame_no, a.label AS own, b.label, count(*) AS n, min(b.frame_no) AS p FROM f a JOIN f b ON a.song_id = b.song_id AND b.frame_no BETWEEN a.frame_no - 2 AND a.frame_no + 2 GROUP BY ALL)
SELECT song_id, frame_no, arg_max(label, n * 1000000000 + CASE WHEN label = own THEN 100000000 ELSE 0 END - p) AS label FROM n GROUP BY song_id, frame_no""")
def w4_majority_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.smooth_labels(_type_frames(spark, sf_dir)).select("song_id", "frame_no", "label")


@query(f"""WITH RECURSIVE {_REF}, o AS (SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY start, seq) AS k, start, "end", label FROM ref),
t AS (SELECT song_id, k, start AS s, "end" AS e, label AS l, "end" - start >= {10 * HOUR} AS good, 0 AS g FROM o WHERE k = 1
 UNION ALL SELECT o.song_id, o.k, CASE WHEN NOT t.good OR o."end" - o.start < {10 * HOUR} THEN t.s ELSE o.start END, o."end",
  CASE WHEN NOT t.good THEN o.label WHEN o."end" - o.start < {10 * HOUR} THEN t.l ELSE o.label END, t.good OR o."end" - t.s >= {10 * HOUR},
  CASE WHEN t.good AND o."end" - o.start >= {10 * HOUR} THEN t.g + 1 ELSE t.g END FROM t JOIN o ON o.song_id = t.song_id AND o.k = t.k + 1),
g AS (SELECT song_id, g, min(s) AS start, max(e) AS "end", arg_max(l, k) AS label FROM t GROUP BY song_id, g),
c AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY song_id ORDER BY g) = label THEN 0 ELSE 1 END AS c FROM g), r AS (SELECT *, sum(c) OVER (PARTITION BY song_id ORDER BY g) - 1 AS seq FROM c)
SELECT song_id, CAST(seq AS BIGINT) AS seq, min(start) AS start, max("end") AS "end", any_value(label) AS label FROM r GROUP BY song_id, seq""")
def w5_merge_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = D.reference(spark, sf_dir).withColumn("seq", F.row_number().over(TL.in_order()))
    return TL.merge_short(x, 10 * HOUR).select("song_id", "seq", "start", "end", "label")


@query("""WITH t AS (SELECT o_orderkey AS song_id, CAST(o_orderkey % 97 AS DOUBLE) AS duration FROM orders), w AS (SELECT song_id, duration, unnest(range(0, 1 + CAST(greatest(0, ceil((duration - 30) / 25.0)) AS BIGINT))) AS idx FROM t WHERE duration > 0)
SELECT song_id, CAST(idx AS INT) AS idx, idx * 25.0 AS start, least(idx * 25.0 + 30, duration) AS "end" FROM w""")
def w6_plan_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("song_id"), (F.col("o_orderkey") % 97).cast("double").alias("duration"))
    return TL.plan_windows(t, 30.0, 5.0)


@query(f"""{_BOTH}, p AS (SELECT song_id, seq AS probe_id, start + 1000000 AS t FROM raw) SELECT p.song_id, p.probe_id, p.t, CASE WHEN p.t < h."end" THEN h.label END AS label FROM p ASOF LEFT JOIN hyp h ON p.song_id = h.song_id AND p.t >= h.start""")
def j3_chord_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.raw_events(spark, sf_dir).select("song_id", F.col("seq").alias("probe_id"), (F.col("start") + 1_000_000).alias("t"))
    return TL.as_of(p, D.hypothesis(spark, sf_dir), width=24 * HOUR).select("song_id", "probe_id", "t", F.col("event.label").alias("label"))


_LONG = """lng AS (SELECT song_id, seq, start, start + (1 + seq % 9) * 7200000000 AS "end", label FROM raw)"""


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = D.raw_events(spark, sf_dir)
    return x.withColumn("end", F.col("start") + (1 + F.col("seq") % 9) * 7_200_000_000).select("song_id", "seq", "start", "end", "label")


@query(f"""WITH {_RAW}, {_LONG}, p AS (SELECT song_id, seq AS probe_id, start + 3600000000 AS t FROM raw), m AS (SELECT p.song_id, probe_id, arg_max(label, struct_pack(a := start, b := seq)) AS label FROM p JOIN lng USING (song_id) WHERE start <= t AND t < "end" GROUP BY ALL)
SELECT song_id, probe_id, t, label FROM p LEFT JOIN m USING (song_id, probe_id)""")
def j6_covering_chord(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.raw_events(spark, sf_dir).select("song_id", F.col("seq").alias("probe_id"), (F.col("start") + HOUR).alias("t"))
    return TL.covering(p, _long(spark, sf_dir), 12 * HOUR).select("song_id", "probe_id", "t", "label")


@query(f"""WITH {_RAW}, {_LONG}, i AS (SELECT song_id, seq, start + 7200000000 AS "at" FROM raw) SELECT song_id, seq, "at" FROM i WHERE NOT EXISTS (SELECT 1 FROM lng WHERE lng.song_id = i.song_id AND lng.start <= i."at" AND i."at" < lng."end")""")
def j14_uncovered_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = D.raw_events(spark, sf_dir).select("song_id", "seq", (F.col("start") + 2 * HOUR).alias("at"))
    return TL.uncovered(i, _long(spark, sf_dir), 12 * HOUR)


@query(f"""{_BOTH}, {_OVER}, m AS (SELECT song_id, hseq AS seq, sum(o) AS o FROM ov WHERE rl = hl GROUP BY ALL) SELECT song_id, seq, "end" - start AS seconds, CAST(least("end" - start, coalesce(o, 0)) AS BIGINT) AS correct_seconds FROM hyp LEFT JOIN m USING (song_id, seq)""")
def j2_event_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.event_agreement(D.hypothesis(spark, sf_dir), D.reference(spark, sf_dir), 12 * HOUR).select("song_id", "seq", "seconds", "correct_seconds")


_BND = """a AS (SELECT DISTINCT song_id, unnest([start, "end"]) AS t FROM ref), b AS (SELECT DISTINCT song_id, unnest([start, "end"]) AS t FROM hyp)"""


@query(f"{_BOTH}, {_BND} SELECT song_id, t FROM a")
def u3_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.boundaries(D.reference(spark, sf_dir), None)


@query(f"{_BOTH}, {_BND}, d AS (SELECT a.song_id, a.t, min(abs(a.t - b.t)) AS d FROM a JOIN b USING (song_id) GROUP BY ALL), e AS (SELECT b.song_id, b.t, min(abs(a.t - b.t)) AS d FROM b JOIN a USING (song_id) GROUP BY ALL) SELECT song_id, x AS ref_to_hyp, y AS hyp_to_ref FROM (SELECT song_id, CAST(median(d) AS DOUBLE) AS x FROM d GROUP BY 1) FULL JOIN (SELECT song_id, CAST(median(d) AS DOUBLE) AS y FROM e GROUP BY 1) USING (song_id)")
def j7_boundary_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.boundary_distances(D.reference(spark, sf_dir), D.hypothesis(spark, sf_dir), None)


def _hamming(a: str, b: str, out: str) -> str:
    return f"""{out}m AS (SELECT song_id, seq, start, "end", start AS t FROM {a} UNION SELECT a.song_id, a.seq, a.start, a."end", b.start FROM {a} a JOIN {b} b ON a.song_id = b.song_id AND a.start < b.start AND b.start < a."end"),
{out}p AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY song_id, seq ORDER BY t), "end") - t AS piece FROM {out}m), {out}l AS (SELECT song_id, seq, start, "end", max(piece) AS lp FROM {out}p GROUP BY ALL), {out} AS (SELECT song_id, coalesce(sum("end" - start - lp) / nullif(max("end") - min(start), 0), 0) AS d FROM {out}l GROUP BY song_id)"""


@query(f"{_BOTH}, {_hamming('ref', 'hyp', 'x')}, {_hamming('hyp', 'ref', 'y')} SELECT song_id, least(1 - x.d, 1 - y.d) AS overlap FROM x JOIN y USING (song_id)")
def j9_segment_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.segment_overlap(D.reference(spark, sf_dir), D.hypothesis(spark, sf_dir), 12 * HOUR)


@query(f"""{_BOTH}, r AS (SELECT song_id, label, count(*) AS r FROM ref GROUP BY ALL), h AS (SELECT song_id, label, count(*) AS h FROM hyp GROUP BY ALL), x AS (SELECT song_id, label, coalesce(r, 0) AS r, coalesce(h, 0) AS h FROM r FULL JOIN h USING (song_id, label))
SELECT song_id, 2 * sum(least(r, h)) / (sum(r) + sum(h)) AS bag_f1, 2 * sum(CASE WHEN r > 0 AND h > 0 THEN 1 ELSE 0 END) / (sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) + sum(CASE WHEN h > 0 THEN 1 ELSE 0 END)) AS set_f1 FROM x GROUP BY song_id""")
def a10_label_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.label_f1(D.reference(spark, sf_dir), D.hypothesis(spark, sf_dir))


@query(f"WITH {_REF}, {_HYP}, {_PARSE} SELECT r.song_id, r.seq, label, p.root, p.quality, p.bass FROM ref r JOIN parsed p USING (label)")
def f1_parse_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_parsed(D.reference(spark, sf_dir), "label").select("song_id", "seq", "label", "chord.root", "chord.quality", "chord.bass")


@query(f"""WITH {_REF}, {_HYP}, {_PARSE}, sq(quality, sfx) AS (VALUES {_rows(L.QUALITY_SUFFIX)}), n AS (SELECT {L.NOTES} AS n)
SELECT r.song_id, r.seq, CASE WHEN p.quality = 'no_chord' THEN 'N' WHEN p.quality IN ('other', 'unknown') THEN label ELSE n.n[1 + (list_position(n.n, root) - 1 + r.seq) % 12] || sfx || CASE WHEN bass IS NOT NULL AND bass <> root THEN '/' || n.n[1 + (list_position(n.n, bass) - 1 + r.seq) % 12] ELSE '' END END AS moved
FROM ref r JOIN parsed p USING (label) CROSS JOIN n LEFT JOIN sq USING (quality)""")
def f4_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reference(spark, sf_dir).select("song_id", "seq", L.transpose(F.col("label"), (F.col("seq") % 12).cast("int")).alias("moved"))


@query(f"""{_BOTH}, {_PARSE} SELECT r.song_id, r.seq, CASE WHEN h.quality = 'no_chord' THEN 'N' WHEN h.root IS NULL THEN label WHEN h.quality = 'minor' THEN h.root || 'm' ELSE h.root END AS scoring,
CASE WHEN h.quality = 'no_chord' THEN 'N' WHEN h.root IS NULL THEN label WHEN h.quality IN ('minor', 'm7', 'm6', 'm9') THEN h.root || 'm' ELSE h.root END AS chart, CASE h.quality WHEN '7' THEN 'major' WHEN 'maj7' THEN 'major' WHEN 'add9' THEN 'major' WHEN '6' THEN 'major' WHEN '9' THEN 'major' WHEN 'm7' THEN 'minor' WHEN 'm6' THEN 'minor' WHEN 'm9' THEN 'minor' ELSE h.quality END AS simple
FROM ref r JOIN parsed h USING (label)""")
def f8_f9_f10_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = L.with_parsed(D.reference(spark, sf_dir), "label")
    return x.select("song_id", "seq", L.triad_scoring(F.col("label")).alias("scoring"), L.triad_chart(F.col("label")).alias("chart"), L.simplify(F.col("chord.quality")).alias("simple"))


@query(f"""WITH {_REF}, {_HYP}, {_PARSE}, {_PCS}, {_OVER} SELECT DISTINCT rl AS ref_label, hl AS hyp_label, CAST({_SCORE} AS DOUBLE) AS score FROM ov JOIN sets r ON r.label = rl JOIN sets h ON h.label = hl""")
def f7_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = TL.overlap_join(D.reference(spark, sf_dir), D.hypothesis(spark, sf_dir), 12 * HOUR).select(F.col("l_label").alias("ref_label"), F.col("r_label").alias("hyp_label")).distinct()
    return L.with_equality(p)


_KEYS = f"""WITH k AS (SELECT o_orderkey, {L.NOTES}[1 + o_custkey % 12] || CASE WHEN o_orderkey % 2 = 0 THEN ' major' ELSE ' minor' END AS ref, CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' ELSE {L.NOTES}[1 + (o_custkey + o_orderkey) % 12] || CASE WHEN o_orderkey % 3 = 0 THEN ' major' ELSE ' minor' END END AS est, (o_orderkey % 12) AS up, o_orderkey % 2 = 0 AS rmaj, o_orderkey % 3 = 0 AS emaj, o_orderkey % 11 = 0 AS unk FROM orders),
r AS (SELECT o_orderkey, CASE WHEN unk THEN 'unknown' WHEN rmaj = emaj AND up = 0 THEN 'exact' WHEN rmaj = emaj AND up = 7 THEN 'fifth' WHEN rmaj AND NOT emaj AND up = 9 THEN 'relative' WHEN NOT rmaj AND emaj AND up = 3 THEN 'relative' WHEN rmaj <> emaj AND up = 0 THEN 'parallel' ELSE 'other' END AS relation FROM k)"""


def _key_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.read(spark, sf_dir, "orders")
    note = lambda c: L.note_name(F.pmod(c, F.lit(12)).cast("int"))
    mode = lambda n: F.when(F.col("o_orderkey") % n == 0, " major").otherwise(" minor")
    est = F.when(F.col("o_orderkey") % 11 == 0, "unknown").otherwise(F.concat(note(F.col("o_custkey") + F.col("o_orderkey")), mode(3)))
    return o.select("o_orderkey", F.concat(note(F.col("o_custkey")), mode(2)).alias("ref"), est.alias("est"))


@query(_KEYS + " SELECT o_orderkey, relation, CASE relation WHEN 'exact' THEN 1.0 WHEN 'fifth' THEN 0.5 WHEN 'relative' THEN 0.3 WHEN 'parallel' THEN 0.2 ELSE 0.0 END::DOUBLE AS score FROM r")
def f13_key_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _key_pairs(spark, sf_dir).withColumn("relation", S.key_relation(F.col("ref"), F.col("est")))
    return x.select("o_orderkey", "relation", S.key_score(F.col("relation")).alias("score"))


@query(_KEYS + " SELECT relation, count(r.o_orderkey) AS n FROM (VALUES ('exact'), ('fifth'), ('relative'), ('parallel'), ('other'), ('unknown')) v(relation) LEFT JOIN r USING (relation) GROUP BY relation")
def a9_relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CA.key_summary(_key_pairs(spark, sf_dir))[1]


@query(_KEYS + " SELECT avg(CAST(relation = 'exact' AS DOUBLE)) AS accuracy, avg(CAST(relation = 'relative' AS DOUBLE)) AS relative_error FROM r")
def a9_key_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CA.key_summary(_key_pairs(spark, sf_dir))[0]


@query("""WITH t AS (SELECT p_partkey, 60.0 + p_size AS r, (60.0 + p_size) * [1.0, 0.5, 2.0, 1.1][1 + p_partkey % 4] AS e FROM part), d AS (SELECT p_partkey, abs(e - r) AS same, abs(e / 2 - r) AS half, abs(e * 2 - r) AS double FROM t)
SELECT p_partkey, CAST(same AS DOUBLE) AS same, CAST(half AS DOUBLE) AS half, CAST(double AS DOUBLE) AS double, CASE WHEN same <= half AND same <= double THEN 'same' WHEN half <= double THEN 'half' ELSE 'double' END AS interpretation FROM d""")
def f14_tempo_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.read(spark, sf_dir, "part").withColumn("r", F.lit(60.0) + F.col("p_size"))
    e = F.col("r") * F.element_at(F.array(F.lit(1.0), F.lit(0.5), F.lit(2.0), F.lit(1.1)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.withColumn("x", S.tempo_errors(F.col("r"), e)).select("p_partkey", "x.*")


@query(f"""WITH {_RAW} SELECT song_id, seq, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp, printf('%d', ms // 3600000) || printf(':%02d:%02d', ms // 60000 % 60, ms // 1000 % 60) AS clock, (ms // 1000)::DOUBLE AS back FROM (SELECT song_id, seq, 3600000 + start // 1000 AS ms FROM raw)""")
def f17_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    sec = (F.floor(F.col("start") / 1000) + 3_600_000) / 1000
    whole = F.floor(sec)
    return D.raw_events(spark, sf_dir).select("song_id", "seq", S.format_timestamp(sec).alias("stamp"), S.format_duration(whole).alias("clock"), S.parse_timestamp(S.format_timestamp(whole.cast("double"))).alias("back"))


@query()
def q4_character_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole normalised texts by code points, which the SQL's edit distance doesn't count; tested against brute force."""
    norm = lambda c: WO.normalize_transcript(F.col(c))
    return D.transcripts(spark, sf_dir).select("song_id", "turn", SC.character_error_rate(norm("ref"), norm("hyp")).alias("cer"))


@query()
def q3_word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = lambda c: WO.normalize_transcript(F.col(c))
    return D.transcripts(spark, sf_dir).select("song_id", "turn", SC.word_error_rate(norm("ref"), norm("hyp")).alias("wer"))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = lambda df, n: df.groupBy("song_id").agg(F.expr("transform(array_sort(collect_list(struct(start, seq, label))), x -> x.label)").alias(n))
    return seq(D.reference(spark, sf_dir), "ref").join(seq(D.hypothesis(spark, sf_dir), "hyp"), "song_id", "full")


@query()
def q1_label_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.align_labels(_sequences(spark, sf_dir))


_OUT = """WITH o AS (SELECT d.doc_id, coalesce(n_chars, 0) AS s, quality * coalesce(n_chars, 0) AS c, CASE WHEN d.doc_id % 9 <> 0 THEN (d.doc_id * 37 % 100) / 100.0 END::DOUBLE AS p FROM documents d JOIN labels l USING (doc_id))"""


@query(_OUT + """ SELECT CAST(sum(s) AS BIGINT) AS seconds, CAST(sum(s) FILTER (p IS NOT NULL) AS BIGINT) AS known, sum(c) / sum(s) AS accuracy, sum(c * (1 - p) * (1 - p) + (s - c) * p * p) / sum(s) FILTER (p IS NOT NULL) AS brier, (SELECT sum(g) FROM (SELECT abs(sum(p * s - c)) AS g FROM o WHERE p IS NOT NULL GROUP BY least(floor(p * 5), 4))) / sum(s) FILTER (p IS NOT NULL) AS ece, """
       + ", ".join(f"coalesce(sum(s) FILTER (p >= 0.{t}), 0) / sum(s) AS coverage_{t}0, sum(c) FILTER (p >= 0.{t}) / sum(s) FILTER (p >= 0.{t}) AS accuracy_{t}0" for t in "56789") + " FROM o")
def a5_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.calibration(D.outcomes(spark, sf_dir))


@query(_OUT + """, b AS (SELECT CASE WHEN p < 0.2 THEN 'very_low' WHEN p < 0.4 THEN 'low' WHEN p < 0.6 THEN 'medium' WHEN p < 0.8 THEN 'high' ELSE 'very_high' END AS band, s, c, p FROM o WHERE p IS NOT NULL)
SELECT band, CAST(sum(s) AS BIGINT) AS seconds, CAST(sum(c) AS BIGINT) AS correct, round(abs(sum(p * s) - sum(c)), 3) AS gap FROM b GROUP BY band""")
def a4_band_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [n for _, n in S.BANDS] + [S.TOP_BAND]
    return SC.band_report(D.outcomes(spark, sf_dir), S.confidence_band(F.col("confidence")), names).withColumn("gap", F.round("gap", 3))


@query()
def a7_fit_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.outcomes(spark, sf_dir)
    got = SC.fit_logistic(o) or (None, None, 0)
    p = S.logistic(F.col("margin"), got[0], got[1]) if got[0] is not None else F.lit(None).cast("double")
    return o.select("doc_id", "margin", p.alias("confidence"))


@query(f"""{_BOTH}, a AS (SELECT song_id, avg("end" - start) AS x FROM ref GROUP BY 1), b AS (SELECT song_id, avg("end" - start) AS y FROM hyp GROUP BY 1), d AS (SELECT y - x AS d FROM a JOIN b USING (song_id))
SELECT count(d) AS n, round(avg(d), 2) AS mean, round(stddev_samp(d) / sqrt(count(d)), 2) AS se, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses FROM d""")
def j15_paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda x: x.groupBy("song_id").agg(F.avg(F.col("end") - F.col("start")).alias("m"))
    return SC.paired(m(D.reference(spark, sf_dir)), m(D.hypothesis(spark, sf_dir)), "m", "song_id").select("n", F.round("mean", 2).alias("mean"), F.round("se", 2).alias("se"), "wins", "losses")


_FRAMES = "f AS (SELECT label AS song_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_no, list_transform(embedding[1:12], lambda x: abs(CAST(x AS DOUBLE))) AS c FROM embeddings)"
_COS = ", ".join("(" + " + ".join(f"c[{i + 1}] * {w}" for i, w in enumerate(t) if w) + f") / (sqrt(list_sum(list_transform(c, lambda x: x * x))) * {sum(w * w for w in t) ** 0.5!r})" for t in FR.templates())


@query(f"WITH {_FRAMES}, s AS (SELECT song_id, frame_no, [{_COS}] AS s FROM f) SELECT song_id, frame_no, round(list_max(s), 6) AS best, CASE WHEN list_max(s) < 0.5 THEN 'N' ELSE {FR.STATES}[list_position(s, list_max(s))] END AS label FROM s")
def f22_f23_frame_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = D.frames(spark, sf_dir).withColumn("s", FR.frame_scores(F.col("chroma")))
    return x.select("song_id", "frame_no", F.round(F.array_max(F.slice("s", 1, 24)), 6).alias("best"), FR.best_state(F.col("s"), 0.5).alias("label"))


@query(f"""WITH {_FRAMES}, m AS (SELECT song_id, [{", ".join(f"avg(c[{i}])" for i in range(1, 13))}] AS v FROM f GROUP BY song_id), p(minor, w) AS (VALUES (0, {FR.MAJOR}), (1, {FR.MINOR})), sh AS (SELECT unnest(range(12)) AS s),
x AS (SELECT song_id, s, minor, v[1 + i] AS a, w[1 + (i - s + 12) % 12] AS b FROM m CROSS JOIN p CROSS JOIN sh CROSS JOIN (SELECT unnest(range(12)) AS i)), r AS (SELECT song_id, s, minor, round(corr(a, CAST(b AS DOUBLE)), 9) AS r FROM x GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY r DESC, s, minor) AS n FROM r)
SELECT song_id, {L.NOTES}[1 + s] AS tonic, CASE WHEN minor = 0 THEN 'major' ELSE 'minor' END AS mode, round(greatest(0.0, least(1.0, r)), 6) AS confidence FROM k WHERE n = 1""")
def a11_key_of_song(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FR.key_of(D.frames(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query()
def q7_decoded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = D.frames(spark, sf_dir).withColumn("scores", FR.frame_scores(F.transform("chroma", lambda v: F.sqrt(v))))
    return DE.decode_frames(x)


@query("""WITH s AS (SELECT l_orderkey % 50 AS song_id, row_number() OVER (PARTITION BY l_orderkey % 50 ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS n, l_quantity AS v FROM lineitem), t AS (SELECT song_id, count(*) AS f FROM s GROUP BY 1)
SELECT song_id, CAST(((n + 1) * least(64, f) - 1) // f AS BIGINT) AS bucket, min(v) AS lo, max(v) AS hi FROM s JOIN t USING (song_id) GROUP BY ALL""")
def a13_waveform_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = D.read(spark, sf_dir, "lineitem")
    w = Window.partitionBy("song_id").orderBy("l_orderkey", "l_linenumber", "l_quantity")
    x = li.withColumn("song_id", F.col("l_orderkey") % 50)
    return FR.peaks(x.select("song_id", (F.row_number().over(w) - 1).cast("bigint").alias("sample_no"), F.col("l_quantity").alias("value")), 64)


@query("""SELECT conv_id AS song_id, string_agg(trim(text), ' ' ORDER BY turn) AS text, count(*) AS lines FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def a17_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JO.transcripts(D.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("song_id"), F.col("turn").alias("seq"), "text"))


@query("""WITH e AS (SELECT CASE WHEN event_id % 7 > 0 THEN event_type END AS engine, value, CASE WHEN event_id % 3 = 0 THEN value * 2 END AS other FROM events) SELECT coalesce(engine, 'unknown') AS engine, count(*) AS cases, avg(value) AS value, avg(other) AS other FROM e GROUP BY 1""")
def a2_engine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = D.read(spark, sf_dir, "events").select(F.when(i % 7 > 0, F.col("event_type")).alias("engine"), "value", F.when(i % 3 == 0, F.col("value") * 2).alias("other"))
    return CA.engine_summary(e, ["value", "other"])


@query("""SELECT p_name AS name, p_partkey, (row_number() OVER (ORDER BY p_name, p_partkey) - 1) % 2 = 1 AS held_out FROM part""")
def a8_parity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_partkey")
    return SC.parity_split(p, "name", "p_partkey")


# what windows of 24 hours with 6 hours in common report: the events that touch them, cut to them
_WIN = f"""{_REF}, cutup AS (SELECT song_id, i AS idx, seq, greatest(start, i * {18 * HOUR}) AS start, least("end", i * {18 * HOUR} + {24 * HOUR}) AS "end", label, CASE WHEN seq % 2 = 0 THEN 'a' END AS source
 FROM (SELECT *, unnest(range(greatest(0, (start - {24 * HOUR}) // {18 * HOUR} - 1), "end" // {18 * HOUR} + 1)) AS i FROM ref) WHERE start < i * {18 * HOUR} + {24 * HOUR} AND "end" > i * {18 * HOUR})"""


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = D.reference(spark, sf_dir)
    first = F.greatest(F.lit(0), F.floor((F.col("start") - 24 * HOUR) / (18 * HOUR)))
    x = x.withColumn("idx", F.explode(F.sequence(first, F.floor(F.col("end") / (18 * HOUR)))))
    start, end = F.col("idx") * 18 * HOUR, F.col("idx") * 18 * HOUR + 24 * HOUR
    x = x.filter((F.col("start") < end) & (F.col("end") > start))
    return x.select("song_id", "idx", "seq", F.greatest("start", start).alias("start"), F.least("end", end).alias("end"), "label", F.when(F.col("seq") % 2 == 0, "a").alias("source"))


@query(f"""WITH {_WIN}, reach AS (SELECT song_id, idx, max("end") AS e FROM cutup GROUP BY ALL), f AS (SELECT c.song_id, c.idx, c.seq, c.start, c."end", c.label, c.source, max(r.e) AS f FROM cutup c LEFT JOIN reach r ON r.song_id = c.song_id AND r.idx < c.idx GROUP BY ALL),
kept AS (SELECT song_id, idx, seq, greatest(start, coalesce(f, start)) AS start, "end", label, source FROM f WHERE f IS NULL OR start >= f OR "end" > f),
b AS (SELECT *, lag(idx) OVER w AS pi, lag("end") OVER w AS pe, lag(label) OVER w AS pl, lag(source) OVER w AS ps FROM kept WINDOW w AS (PARTITION BY song_id ORDER BY idx, seq)),
g AS (SELECT *, sum(CASE WHEN pi <> idx AND pl = label AND ps IS NOT DISTINCT FROM source AND start BETWEEN pe AND pe + 50000 THEN 0 ELSE 1 END) OVER (PARTITION BY song_id ORDER BY idx, seq) - 1 AS g FROM b)
SELECT song_id, CAST(g AS BIGINT) AS seq, min(start) AS start, max("end") AS "end", any_value(label) AS label, any_value(source) AS source FROM g GROUP BY song_id, g""")
def w7_merge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.merge_windows(_windowed(spark, sf_dir), 50_000)


@query(f"""WITH {_WIN}, w AS (SELECT song_id, idx, count(*) AS n, max(label) AS top FROM cutup GROUP BY ALL) SELECT song_id, min(idx) AS engine, count(*) AS windows, CASE WHEN min(n) = max(n) THEN min(n) END AS confidence,
CASE WHEN count(*) = count(CASE WHEN n % 20 <> 19 THEN 1 END) THEN CAST(sum(n) AS BIGINT) END AS processing_seconds, count(DISTINCT top) AS n_warnings FROM w GROUP BY song_id""")
def a16_windowed_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windowed(spark, sf_dir).groupBy("song_id", "idx").agg(F.count("*").alias("confidence"), F.array(F.max("label")).alias("warnings"))
    w = w.withColumn("engine", F.col("idx")).withColumn("processing_seconds", F.when(F.col("confidence") % 20 != 19, F.col("confidence")))
    return SE.roll_up(w).withColumn("n_warnings", F.size("warnings")).drop("warnings")


# tokens: the turns' texts in pieces, a mark before each word, and words of over four letters in two pieces
_TOK = """t AS (SELECT conv_id AS song_id, turn AS idx, unnest(regexp_split_to_array(text, '[ \\t\\r\\n]+')) AS w, generate_subscripts(regexp_split_to_array(text, '[ \\t\\r\\n]+'), 1) - 1 AS i FROM conversations WHERE text IS NOT NULL)"""


@query(f"""WITH {_TOK}, k AS (SELECT *, i = min(i) OVER (PARTITION BY song_id, idx) OR regexp_matches(w, '[\\p{{L}}\\p{{N}}]') AS opens FROM t WHERE regexp_matches(w, '\\S')), g AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY song_id, idx ORDER BY i) - 1 AS word_no FROM k),
m AS (SELECT song_id, idx, word_no, string_agg(regexp_replace(w, '^\\s+|\\s+$', '', 'g'), '' ORDER BY i) AS text, min(i) * 0.5 AS start FROM g GROUP BY ALL)
SELECT song_id, idx, CAST(word_no AS BIGINT) AS word_no, text, start, lead(start) OVER (PARTITION BY song_id, idx ORDER BY word_no) AS "end" FROM m""")
def w9_words_of_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("song_id"), F.col("turn").alias("idx"), F.posexplode(F.split("text", r"[ \t\r\n]+")).alias("i", "w"))
    halves = F.array(F.struct(F.lit(0).alias("k"), F.concat(F.lit(SE.WORD_MARK), F.substring("w", 1, 4)).alias("token")), F.struct(F.lit(1).alias("k"), F.expr("substring(w, 5)").alias("token")))
    x = c.withColumn("h", F.explode(halves)).select("song_id", "idx", (F.col("i") * 2 + F.col("h.k")).alias("token_no"), "h.token", (F.col("i") * 0.5).alias("ts"))
    return SE.words_of_tokens(x)


# lines of documents as stamped lines: minutes and seconds from the line's number
@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, i, trim(regexp_replace(replace(line, chr(13), ' '), '\\s+', ' ', 'g')) AS text, (i * 7) % 600 + 0.25 AS start FROM l),
n AS (SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY start, i) AS "end" FROM c)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, i) - 1 AS seq, text, start, "end" FROM n""")
def r6_stamped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.format_string("[%02d:%02d.25]", (F.floor(i * 7 / 60) % 10).cast("int"), (i * 7 % 60).cast("int"))
    lines = F.transform(F.split(F.replace("text", F.lit("\r"), F.lit(" ")), "\n"), lambda line, i: F.concat(at(i), line))
    texts = D.read(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("name"), F.array_join(lines, "\n").alias("text"))
    return TT.parse_lrc(texts).select(F.col("name").alias("doc_id"), "seq", "text", "start", "end")


_HOURLY = """SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS start, epoch_us(time_bucket(INTERVAL '6 hours', ts)) + 21600000000 AS "end", event_type AS label, count(*) AS n, sum(value) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL"""


@query(_HOURLY)
def t1_windowed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's last word on every window: one pass over all that is there, so none is late."""
    s = J.window_summary(J.event_stream(spark, sf_dir).withColumnRenamed("event_type", "label"), "6 hours", late="3650 days")
    return J.latest(J.drain(s, "update"), "start", "end", "label").select(F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "label", "n", "total")


# each turn is a line of words a second apart, under a chord that lasts for the first three of them
@query(f"""WITH t AS (SELECT conv_id AS song_id, turn AS line_no, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> '') AS ws, {_LIST}[1 + length(text) % 25] AS label FROM conversations WHERE text IS NOT NULL),
l AS (SELECT song_id, line_no, coalesce(array_to_string(list_transform(ws, lambda w, i: CASE WHEN i <= 3 THEN '[' || label || ']' ELSE '' END || w), ' '), '') AS line FROM t)
SELECT song_id, '{{title: ' || song_id || '}}' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS sheet FROM l GROUP BY song_id""")
def r14_chordpro(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.read(spark, sf_dir, "conversations").filter("text is not null").select(F.col("conv_id").alias("song_id"), F.col("turn").alias("line_no"), "text")
    at = F.col("line_no") * 100_000.0
    ws = F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w != "")
    lines = c.withColumn("start", at).withColumn("kind", F.lit("vocal")).withColumn("words", F.transform(ws, lambda w, i: F.struct(w.alias("text"), (at + i).alias("start"), (at + i + 1).alias("end"))))
    events = c.select("song_id", F.col("line_no").alias("seq"), at.alias("start"), (at + 2.5).alias("end"), D.vocabulary(F.length("text")).alias("label"))
    songs = c.select("song_id").distinct().select("song_id", F.col("song_id").cast("string").alias("title"), F.lit(None).cast("string").alias("key_label"), F.lit(None).cast("double").alias("bpm"))
    return SH.chordpro(songs, lines, events)


# charts: the lines of documents, each below a line of two chords over its first and fifth column
@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, i, list_filter(regexp_split_to_array(replace(line, chr(13), ' '), '\\s+'), lambda w: w <> '') AS ws FROM l), k AS (SELECT doc_id, len(ws) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS line FROM c WHERE len(ws) > 0)
SELECT doc_id, 2 * line + h AS chord_no, ['G', 'A'][1 + h] AS text, line AS lyric_line, CASE WHEN n > 1 THEN h ELSE 0 END AS word_index FROM k CROSS JOIN range(2) r(h)""")
def r9_chord_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split(F.replace("text", F.lit("\r"), F.lit(" ")), "\n"), lambda a: a.rlike(r"\S"))
    charted = F.flatten(F.transform(lines, lambda a: F.array(F.lit("G A"), F.concat(F.lit("~"), F.regexp_replace(a, r"^\s+", "")))))
    texts = D.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.array_join(charted, "\n").alias("text"))
    return CO.chart_chords(texts).select(F.col("name").alias("doc_id"), "chord_no", "text", "lyric_line", "word_index")


# every third event is a line of at most six hours with three words, the last one open
_LINES = f"""ln AS (SELECT song_id, seq, start, least("end", start + {6 * HOUR}) AS "end" FROM ref WHERE seq % 3 = 0)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = D.reference(spark, sf_dir).filter("seq % 3 = 0")
    return x.select("song_id", "seq", "start", F.least(F.col("end"), F.col("start") + 6 * HOUR).alias("end"))


@query(f"""{_BOTH}, {_LINES}, p AS (SELECT song_id, seq AS probe_id, start + (seq % 7) * {HOUR} AS t FROM raw),
w AS (SELECT song_id, seq AS line, k AS word, start + k * (("end" - start) // 4) AS s, CASE WHEN k < 2 THEN start + (k + 1) * (("end" - start) // 4) ELSE "end" END AS e FROM ln, range(3) r(k)),
a AS (SELECT p.*, l.seq AS line, l."end" AS le FROM p ASOF LEFT JOIN ln l ON p.song_id = l.song_id AND p.t >= l.start), b AS (SELECT song_id, probe_id, t, CASE WHEN t < le THEN line END AS line FROM a)
SELECT b.song_id, probe_id, t, b.line, max(w.word) AS word FROM b LEFT JOIN w ON w.song_id = b.song_id AND w.line = b.line AND w.s <= b.t AND b.t < w.e GROUP BY ALL""")
def j5_words_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    step = F.floor((F.col("end") - F.col("start")) / 4)
    w = lines.withColumn("k", F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(3)])))
    w = w.select("song_id", F.col("seq").alias("line"), F.col("k").alias("seq"), (F.col("start") + F.col("k") * step).alias("start"), F.when(F.col("k") < 2, F.col("start") + (F.col("k") + 1) * step).alias("end"))
    p = D.raw_events(spark, sf_dir).select("song_id", F.col("seq").alias("probe_id"), (F.col("start") + (F.col("seq") % 7) * HOUR).alias("t"))
    return PL.words_at(p, lines, w, width=24 * HOUR)


_OWN = f"""{_LINES}, nth AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY start, seq) AS nth FROM ln), fst AS (SELECT song_id, seq AS fseq, start AS fstart FROM nth WHERE nth = 1),
own AS (SELECT h.song_id, h.seq, h.start, h."end", h.label, CASE WHEN h.start < n."end" THEN n.seq WHEN n.seq IS NULL AND h."end" > fstart THEN fseq END AS line, coalesce(nth, 0) AS before FROM (hyp h ASOF LEFT JOIN nth n ON h.song_id = n.song_id AND h.start >= n.start) LEFT JOIN fst ON fst.song_id = h.song_id)"""


@query(f"{_BOTH}, {_OWN} SELECT song_id, seq, line, before FROM own")
def j10_owning_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PL.owning_lines(D.hypothesis(spark, sf_dir), _lines(spark, sf_dir)).select("song_id", "seq", "line", "before")


@query(f"""{_BOTH}, {_OWN}, g AS (SELECT *, (row_number() OVER (PARTITION BY song_id, before ORDER BY start, seq) - 1) // 8 AS "row" FROM own WHERE line IS NULL),
w AS (SELECT *, min(start) OVER r AS row_start, greatest(last_value("end") OVER (r ORDER BY start, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), min(start) OVER r + {HOUR}) AS row_end, greatest(24, least(80, 6 + sum(length(label) + 2) OVER r)) AS width FROM g WINDOW r AS (PARTITION BY song_id, before, "row"))
SELECT song_id, seq, before, CAST("row" AS BIGINT) AS "row", row_start, row_end, CAST(width AS BIGINT) AS width, CAST(least(width - 1, greatest(0, round_even((start - row_start) / (row_end - row_start) * (width - 1), 0))) AS INT) AS "column" FROM w""")
def w11_gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = PL.owning_lines(D.hypothesis(spark, sf_dir), _lines(spark, sf_dir)).filter("line is null")
    return PL.gap_rows(gaps, HOUR).select("song_id", "seq", "before", "row", "row_start", "row_end", "width", "column")


@query(r"""WITH c AS (SELECT conv_id AS song_id, turn AS seq, turn * 4.0 AS start, CASE WHEN turn % 2 = 0 THEN turn * 4.0 + 2 END AS e, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '') AS ws FROM conversations WHERE text IS NOT NULL),
n AS (SELECT *, lead(start) OVER (PARTITION BY song_id ORDER BY start, seq) AS nxt FROM c), l AS (SELECT song_id, seq, start, coalesce(e, CASE WHEN nxt > start THEN nxt END, start + greatest(0.8, 0.4 * len(ws))) AS e, ws FROM n WHERE len(ws) > 0),
x AS (SELECT *, unnest(range(0, len(ws))) AS i FROM l)
SELECT song_id, seq AS line, CAST(i AS INT) AS word_no, ws[i + 1] AS text, CAST(start AS DOUBLE) + i * ((CAST(e AS DOUBLE) - start) / len(ws)) AS start, CAST(start AS DOUBLE) + (i + 1) * ((CAST(e AS DOUBLE) - start) / len(ws)) AS "end" FROM x""")
def w14_spread_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.read(spark, sf_dir, "conversations").filter("text is not null")
    start = F.col("turn") * F.lit(4.0)
    return PL.spread_words(c.select(F.col("conv_id").alias("song_id"), F.col("turn").alias("seq"), "text", start.alias("start"), F.when(F.col("turn") % 2 == 0, start + 2).alias("end")))


_HITS = f"""b AS (SELECT song_id, list(DISTINCT t ORDER BY t) AS r FROM (SELECT song_id, unnest([start, "end"]) AS t FROM ref) GROUP BY 1), c AS (SELECT song_id, list(DISTINCT t ORDER BY t) AS h FROM (SELECT song_id, unnest([start, "end"]) AS t FROM hyp) GROUP BY 1), both_ AS (SELECT song_id, coalesce(r, []) AS r, coalesce(h, []) AS h FROM b FULL JOIN c USING (song_id)),
m AS (SELECT song_id, r, h, 1 AS i, 1 AS j, 0 AS n FROM both_ UNION ALL SELECT song_id, r, h, CASE WHEN h[j] < r[i] - {2 * HOUR} THEN i ELSE i + 1 END, CASE WHEN h[j] > r[i] + {2 * HOUR} THEN j ELSE j + 1 END, CASE WHEN abs(h[j] - r[i]) <= {2 * HOUR} THEN n + 1 ELSE n END FROM m WHERE i <= len(r) AND j <= len(h)),
hit AS (SELECT song_id, max(n) AS n, any_value(len(r)) AS lr, any_value(len(h)) AS lh FROM m GROUP BY song_id)"""


@query(_BOTH.replace("WITH ", "WITH RECURSIVE ", 1) + f", {_HITS} SELECT song_id, coalesce(n / nullif(lh, 0), 0) AS change_precision, coalesce(n / nullif(lr, 0), 0) AS change_recall, CASE WHEN n > 0 THEN 2.0 * n / (lr + lh) ELSE 0 END AS change_f1 FROM hit")
def j8_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PL.change_points(D.reference(spark, sf_dir), D.hypothesis(spark, sf_dir), 2 * HOUR, None)


_TRIAD = "CASE WHEN quality = 'no_chord' THEN 'N' WHEN root IS NULL THEN label WHEN quality = 'minor' THEN root || 'm' ELSE root END"
# the timelines with triads as labels; what follows them is the recall of any two timelines
_TRIADS = f"""WITH tr AS ({_BOTH}, {_PARSE} SELECT label AS full_label, {_TRIAD} AS triad FROM parsed), ref AS (SELECT song_id, seq, start, "end", triad AS label FROM ({_BOTH} SELECT * FROM ref) x JOIN tr ON x.label = tr.full_label), hyp AS (SELECT song_id, seq, start, "end", triad AS label FROM ({_BOTH} SELECT * FROM hyp) x JOIN tr ON x.label = tr.full_label)""" + _CSR.removeprefix(_BOTH)
_COUNTS = "(SELECT song_id, count(*) AS {0}_segments, count(*) FILTER (label <> 'N') AS {0}_chords FROM {1} GROUP BY song_id)"


@query(f"""SELECT song_id, csr, csr_triads, coalesce(overlap, 0) AS segment_overlap, coalesce(change_precision, 0) AS change_precision, coalesce(change_recall, 0) AS change_recall, coalesce(change_f1, 0) AS change_f1, ref_to_hyp, hyp_to_ref, reference_segments, reference_chords, coalesce(hypothesis_segments, 0) AS hypothesis_segments, coalesce(hypothesis_chords, 0) AS hypothesis_chords
FROM {_COUNTS.format("reference", f"({_BOTH} SELECT * FROM ref)")} LEFT JOIN {_COUNTS.format("hypothesis", f"({_BOTH} SELECT * FROM hyp)")} USING (song_id) LEFT JOIN ({ORACLES["j1_duration_csr"]}) USING (song_id) LEFT JOIN ({_TRIADS} SELECT song_id, csr AS csr_triads FROM full_csr) USING (song_id)
LEFT JOIN ({ORACLES["j9_segment_overlap"]}) USING (song_id) LEFT JOIN ({ORACLES["j8_change_points"]}) USING (song_id) LEFT JOIN ({ORACLES["j7_boundary_distance"]}) USING (song_id)""")
def a3_take_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PL.take_scores(D.reference(spark, sf_dir), D.hypothesis(spark, sf_dir), 12 * HOUR, 2 * HOUR, None)


@query()
def q2_chart_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PL.align_charts(D.reference(spark, sf_dir), D.hypothesis(spark, sf_dir))


@query()
def a18_chart_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PL.chart_agreement(q2_chart_alignment(spark, sf_dir), songs=D.raw_events(spark, sf_dir))


@query("""WITH e AS (SELECT user_id AS song_id, CASE WHEN event_id % 9 <> 0 THEN (event_id * 37 % 128) / 128.0 END AS confidence, CASE WHEN event_id % 4 > 0 THEN event_type END AS source FROM events)
SELECT song_id, count(*) AS events, avg(confidence) AS mean_confidence, count(*) - count(confidence) AS unknown, coalesce(string_agg(DISTINCT source, ', ' ORDER BY source), '') AS sources FROM e GROUP BY song_id""")
def a14_layer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.read(spark, sf_dir, "events")
    i = F.col("event_id")
    return PL.layer_summary(e.select(F.col("user_id").alias("song_id"), F.when(i % 9 != 0, (i * 37 % 128) / 128.0).alias("confidence"), F.when(i % 4 > 0, F.col("event_type")).alias("source")))


@query("""SELECT l_orderkey AS song_id, CASE WHEN bool_and(l_quantity > 20) THEN 'succeeded' WHEN bool_or(l_quantity > 20) THEN 'partial' ELSE 'failed' END AS status, sum(CASE WHEN l_linenumber > 1 THEN l_quantity END) AS processing_seconds FROM lineitem GROUP BY l_orderkey""")
def a15_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = D.read(spark, sf_dir, "lineitem")
    return PL.run_status(li.select(F.col("l_orderkey").alias("song_id"), F.when(F.col("l_quantity") > 20, "ok").otherwise("failed").alias("status"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).alias("processing_seconds")))


@query(r"""WITH w AS (SELECT unnest(regexp_split_to_array(text, '[ \t\r\n]+')) AS w FROM documents WHERE text IS NOT NULL) SELECT regexp_replace(lower(strip_accents(w)), '[^0-9a-z]', '', 'g') AS word, count(*) AS n FROM w WHERE w <> '' GROUP BY 1""")
def f19_folded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = D.read(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \t\r\n]+")).alias("w")).filter("w != ''")
    return w.groupBy("w").agg(F.count("*").alias("n")).groupBy(WO.folded("w").alias("word")).agg(F.sum("n").alias("n"))


@query()
def f20_same_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring words of the conversations' turns that are the same word."""
    ws = F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w != "")
    pairs = D.read(spark, sf_dir, "conversations").withColumn("ws", ws).filter("size(ws) > 1").select(F.explode(F.expr("transform(sequence(1, size(ws) - 1), i -> struct(ws[i - 1] as a, ws[i] as b))")).alias("p"))
    counted = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).select(WO.folded("a").alias("a"), WO.folded("b").alias("b"), "n")
    return WO.same_word(counted, "a", "b").groupBy("a", "b", "same").agg(F.sum("n").alias("n"))
