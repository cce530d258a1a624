"""More registered queries: labels, validity, edits, documents, cases and chart import, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cantus.functions import labels as L
from cantus.functions import scalars as S
from cantus.operators import cases as CA
from cantus.operators import charting as CH
from cantus.operators import chord_lines as CL
from cantus.operators import documents as DO
from cantus.operators import editing as ED
from cantus.operators import frames as FR
from cantus.operators import jobs as JO
from cantus.operators import scoring as SC
from cantus.operators import seams as SE
from cantus.operators import timeline as TL
from cantus.plans.queries import _BOTH, _COS, _FRAMES, _PARSE, _RAW, _REF, _WIN, HOUR, _rows, _sequences, _windowed, query
from cantus.sources import derived as D

_SPELLED = list(L.PITCH)
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs)).cast("int") + 1)
SECOND = 1e-6


@query(f"WITH p(note, pc) AS (VALUES {_rows(L.PITCH)}), x AS (SELECT p_partkey, {_LIST(_SPELLED)}[1 + p_partkey % {len(_SPELLED)}] AS note FROM part) SELECT p_partkey, {L.NOTES}[1 + pc] AS note FROM x JOIN p USING (note)")
def f2_canonical_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read(spark, sf_dir, "part").select("p_partkey", L.canonical_note(pick(_SPELLED, F.col("p_partkey"))).alias("note"))


_SUFFIXES = ", ".join(f"('{q}', '{s}')" for q, s in L.QUALITY_SUFFIX.items())
_RENDER = "CASE WHEN p.quality = 'no_chord' THEN 'N' WHEN root IS NULL THEN '?' ELSE root || {} || CASE WHEN bass IS NOT NULL AND bass <> root THEN '/' || bass ELSE '' END END"


@query(f"""{_BOTH}, {_PARSE}, sx(quality, suffix) AS (VALUES {_SUFFIXES}) SELECT r.song_id, r.seq, {_RENDER.format("CASE WHEN p.quality = 'other' THEN regexp_extract(r.label, '^[A-Ga-g][#b]{0,2}(.*)$', 1) ELSE coalesce(suffix, '') END")} AS label, {_RENDER.format("coalesce(suffix, '')")} AS event
FROM raw r JOIN parsed p USING (label) LEFT JOIN sx ON sx.quality = p.quality""")
def f3_render_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = L.with_parsed(D.raw_events(spark, sf_dir), "label")
    c = F.col("chord")
    return x.select("song_id", "seq", L.render(c["root"], c["quality"], c["bass"], c["extension"]).alias("label"), L.render_event(c["root"], c["quality"], c["bass"]).alias("event"))


_WORDS = [*L.COLON_QUALITIES]


@query(f"""WITH f(a, b) AS (VALUES {_rows(L.FLATS)}), q(w, s) AS (VALUES {_rows(L.COLON_QUALITIES)}), x AS (SELECT o_orderkey, {_LIST(_SPELLED)}[1 + o_orderkey % {len(_SPELLED)}] AS root, {_LIST(_WORDS)}[1 + o_orderkey % {len(_WORDS)}] AS word, CASE WHEN o_orderkey % 3 = 0 THEN {_LIST(_SPELLED)}[1 + o_custkey % {len(_SPELLED)}] WHEN o_orderkey % 3 = 1 THEN '5' END AS bass FROM orders)
SELECT o_orderkey, coalesce(r.b, root) || coalesce(q.s, word) || coalesce('/' || coalesce(c.b, bass), '') AS label FROM x LEFT JOIN f r ON r.a = root LEFT JOIN q ON q.w = word LEFT JOIN f c ON c.a = bass""")
def f5_colon_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = D.read(spark, sf_dir, "orders"), F.col("o_orderkey")
    bass = F.when(k % 3 == 0, F.concat(F.lit("/"), pick(_SPELLED, F.col("o_custkey")))).when(k % 3 == 1, "/5").otherwise("")
    return o.select("o_orderkey", L.from_colon(F.concat(pick(_SPELLED, k), F.lit(":"), pick(_WORDS, k), bass)).alias("label"))


@query(f"""WITH {_RAW}, n(a, b) AS (VALUES {", ".join(f"('{L.NOTES[k]}', '{v}')" for k, v in L.FLAT_NAMES.items())}), p AS (SELECT song_id, seq, label, song_id % 2 = 0 AS flats, regexp_extract(label, '^([A-G][#b]?)', 1) AS root, regexp_extract(label, '/(.*)$', 1) AS bass FROM raw)
SELECT song_id, seq, CASE WHEN flats AND label NOT IN ('N', 'X') THEN coalesce(r.b, root) || substr(regexp_extract(label, '^([^/]*)', 1), length(root) + 1) || CASE WHEN bass <> '' THEN '/' || coalesce(c.b, bass) ELSE '' END ELSE label END AS label FROM p LEFT JOIN n r ON r.a = root LEFT JOIN n c ON c.a = bass""")
def f11_spelled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = D.raw_events(spark, sf_dir)
    return x.select("song_id", "seq", L.spell_label(F.col("label"), F.col("song_id") % 2 == 0).alias("label"))


@query("SELECT p_partkey, [p_retailprice / 2, p_retailprice * 2] AS alternatives, CASE WHEN p_size > 5 AND p_retailprice > 0 THEN p_size / p_retailprice END AS factor FROM (SELECT *, p_size AS s FROM part)".replace("p_size > 5", "p_size > 0"))
def f15_f16_tempo_and_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read(spark, sf_dir, "part").select("p_partkey", S.metrical_alternatives(F.col("p_retailprice")).alias("alternatives"), S.real_time_factor(F.col("p_size"), F.col("p_retailprice")).alias("factor"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: greatest(CAST(x AS DOUBLE), 0))), 6) AS raw, round(list_sum(list_transform(embedding, lambda x: sqrt(greatest(CAST(x AS DOUBLE), 0)))), 6) AS root, round(list_sum(list_transform(embedding, lambda x: ln(1 + 15 * greatest(CAST(x AS DOUBLE), 0)))), 6) AS log FROM embeddings")
def f21_compressed_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("c"))
    total = lambda how: F.round(F.aggregate(S.compress_chroma(F.col("c"), how), F.lit(0.0), lambda a, x: a + x), 6)
    return e.select("vec_id", total("raw").alias("raw"), total("sqrt").alias("root"), total("log").alias("log"))


@query(f"WITH {_REF} SELECT song_id, seq, CASE WHEN label NOT IN ('N', 'X') THEN CASE WHEN label LIKE '%m' THEN label[:-2] ELSE label END END AS root, CASE WHEN label = 'N' THEN 'no_chord' WHEN label LIKE '%m' THEN 'minor' ELSE 'major' END AS quality, round(1 / (1 + exp(-(0.01 * (seq % 9) * 28.7942 - 0.0738))), 9) AS confidence, round(0.01 * (seq % 9), 6) AS score_margin FROM ref WHERE label <> 'X'".replace("NOT IN ('N', 'X')", "<> 'N'"))
def f25_events_of_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = D.reference(spark, sf_dir).filter("label != 'X'").withColumn("margin", 0.01 * (F.col("seq") % 9))
    return JO.events_of_segments(x, "frames").select("song_id", "seq", "root", "quality", F.round("confidence", 9).alias("confidence"), "score_margin")


_TYPED = ["Am", "c#7", "N", "n", "Bb", "C/E", "Gmaj7", "H", "", "F13b9", "Dbanana", "Esus4", " G ", "A#m9"]
_PLAIN = ", ".join(f"('{s}', '{q}')" for q, s in L.QUALITY_SUFFIX.items())


@query(f"""WITH s(suffix, quality) AS (VALUES {_PLAIN}), t AS (SELECT p_partkey, trim({_LIST(_TYPED)}[1 + p_partkey % {len(_TYPED)}]) AS x FROM part), u AS (SELECT *, upper(x[1:1]) || CASE WHEN x[2:2] = '#' THEN '#' ELSE '' END AS root FROM t),
v AS (SELECT *, substr(x, length(root) + 1) AS suffix FROM u), w AS (SELECT v.*, quality, upper(x) = 'N' AS silent,
 CASE WHEN x = '' THEN 'empty' WHEN upper(x) = 'N' THEN NULL WHEN x LIKE '%/%' THEN 'slash' WHEN x[2:2] = 'b' THEN 'flat' WHEN NOT list_contains({L.NOTES}, root) THEN 'root' WHEN quality IS NULL AND suffix <> '' AND NOT regexp_full_match(suffix, '(?:sus|add|maj|min|dim|aug|m|[0-9#b])+') THEN 'suffix' END AS error FROM v LEFT JOIN s USING (suffix))
SELECT p_partkey, CASE WHEN error IS NULL AND NOT silent THEN root END AS root, CASE WHEN error IS NULL THEN CASE WHEN silent THEN 'no_chord' ELSE coalesce(quality, 'other') END END AS quality, CASE WHEN error IS NULL AND NOT silent AND quality IS NULL THEN x END AS keep, error FROM w""")
def f26_typed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read(spark, sf_dir, "part").select("p_partkey", ED.typed_label(pick(_TYPED, F.col("p_partkey"))).alias("t")).select("p_partkey", "t.*")


_BOUNDS = """b AS (SELECT song_id, seq, CASE WHEN seq % 5 > 0 THEN start END AS start, CASE WHEN seq % 3 > 0 THEN "end" END AS "end", label FROM ref)"""


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("seq")
    return D.reference(spark, sf_dir).select("song_id", "seq", F.when(i % 5 > 0, F.col("start")).alias("start"), F.when(i % 3 > 0, F.col("end")).alias("end"), "label")


@query(f'WITH {_REF}, {_BOUNDS} SELECT song_id, seq, "end" - start AS duration, start IS NOT NULL AND "end" IS NOT NULL AS has_timestamps, label = \'N\' AS is_silence, CASE WHEN start IS NULL THEN NULL ELSE greatest(0.0, least(800.0, start / {400 * HOUR}.0 * 800)) END AS x FROM b')
def f27_interval_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = JO.interval_properties(_bounds(spark, sf_dir))
    at = F.when(F.col("start").isNotNull(), JO.track_position(F.col("start"), F.lit(400.0 * HOUR), F.lit(800.0)))
    return x.select("song_id", "seq", "duration", "has_timestamps", "is_silence", at.alias("x"))


@query("WITH o AS (SELECT d.doc_id, n_chars AS s, quality * n_chars AS c FROM documents d JOIN labels l USING (doc_id)) SELECT doc_id, c / nullif(s, 0) AS correct, 1 - c / nullif(s, 0) AS error FROM o")
def f28_event_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.col("correct_seconds"), F.col("seconds")
    return D.outcomes(spark, sf_dir).select("doc_id", S.correct_fraction(c, s).alias("correct"), S.error_fraction(c, s).alias("error"))


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, l_quantity - 5 AS start, CASE WHEN l_linenumber % 3 > 0 THEN l_extendedprice / 1000 END AS "end", CAST(l_partkey % 140 AS INT) AS pitch_midi, CAST(l_suppkey % 130 AS INT) AS velocity FROM lineitem)
SELECT l_orderkey, l_linenumber, start, CASE WHEN start < 0 THEN 'negative start' WHEN "end" < start THEN 'reversed' WHEN pitch_midi > 127 THEN 'pitch_midi out of range' WHEN velocity > 127 THEN 'velocity out of range' END AS error FROM n""")
def v1_note_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = D.read(spark, sf_dir, "lineitem")
    n = li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 5).alias("start"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_extendedprice") / 1000).alias("end"), (F.col("l_partkey") % 140).cast("int").alias("pitch_midi"), (F.col("l_suppkey") % 130).cast("int").alias("velocity"))
    return n.select("l_orderkey", "l_linenumber", "start", JO.validity("notes").alias("error"))


@query("SELECT conv_id, turn, text FROM conversations WHERE trim(coalesce(CASE WHEN turn % 3 = 0 THEN ' ' ELSE text END, '')) <> ''")
def v3_usable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, " ").otherwise(F.col("text")).alias("text"))
    return JO.usable(c, "lines")


@query(f"WITH {_WIN}, w AS (SELECT DISTINCT song_id, idx, idx * {18 * HOUR} + CASE WHEN idx % 4 = 0 THEN 60000000 ELSE 0 END AS s FROM cutup) SELECT song_id, idx, seq FROM cutup JOIN w USING (song_id, idx) WHERE start < s - 1000")
def v5_ignored_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _windowed(spark, sf_dir)
    start = F.col("idx") * 18 * HOUR + F.when(F.col("idx") % 4 == 0, 60_000_000).otherwise(0)
    return SE.ignored_range(x, x.select("song_id", "idx").distinct().withColumn("start", start), 1000).select("song_id", "idx", "seq")


@query("WITH f AS (SELECT label AS song_id, vec_id, abs(CAST(embedding[13] AS DOUBLE)) AS rms, list_sum(list_transform(embedding[1:12], lambda x: abs(CAST(x AS DOUBLE)))) AS t FROM embeddings) SELECT song_id, vec_id, round(CASE WHEN rms < max(rms) OVER (PARTITION BY song_id) * pow(10, -0.5) THEN 0 ELSE t END, 6) AS total FROM f")
def v7_energy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.read(spark, sf_dir, "embeddings")
    f = e.select(F.col("label").alias("song_id"), "vec_id", F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double"))).alias("chroma"), F.abs(F.element_at("embedding", 13).cast("double")).alias("rms"))
    return FR.energy_gate(f, -10.0).select("song_id", "vec_id", F.round(F.aggregate("chroma", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("WITH c AS (SELECT conv_id AS song_id, turn AS seq, CASE WHEN turn % 4 > 0 THEN 100 - turn END AS start FROM conversations) SELECT song_id, seq, start, row_number() OVER (PARTITION BY song_id ORDER BY start IS NULL, start, seq) - 1 AS pos FROM c")
def w10_display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    return TL.display_order(D.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("song_id"), t.alias("seq"), F.when(t % 4 > 0, 100 - t).alias("start")))


@query("SELECT p_name AS name, p_partkey FROM part ORDER BY p_name, p_partkey LIMIT 100")
def s1_first_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.read(spark, sf_dir, "part").select(F.struct("p_name", "p_partkey").alias("name"))
    return JO.first_takes(p, 100).select(F.col("name.p_name").alias("name"), "name.p_partkey")


@query(f"{_BOTH}, r AS (SELECT * FROM ref WHERE seq % 3 > 0) SELECT song_id, r.seq AS ref_seq, h.seq AS hyp_seq, r.label AS ref_label, h.label AS hyp_label FROM r FULL JOIN hyp h USING (song_id, start)")
def j13_sides_of_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One view of the reference, which has two, beside the hypothesis."""
    ref = D.reference(spark, sf_dir).withColumn("view", F.when(F.col("seq") % 3 > 0, "performed").otherwise("instructed"))
    both = SC.sides(ref, D.hypothesis(spark, sf_dir), "song_id", "start", view="performed")
    return both.select("song_id", "ref_seq", "hyp_seq", "ref_label", "hyp_label")


@query(f"""WITH {_RAW}, l AS (SELECT song_id, seq, CASE WHEN seq % 7 > 0 THEN start END AS s, CASE WHEN seq % 50 > 0 THEN start + {HOUR} END AS e FROM raw WHERE seq % 2 = 0), i AS (SELECT song_id, seq, CASE WHEN seq % 5 > 0 THEN start END AS s, CASE WHEN seq % 30 > 0 THEN start + {HOUR // 2} END AS e FROM raw WHERE seq % 2 = 1)
SELECT song_id, seq FROM i WHERE EXISTS (SELECT 1 FROM l WHERE l.song_id = i.song_id AND l.s < coalesce(i.e, 9e18) AND i.s < coalesce(l.e, 9e18))""")
def j14_overlapping_line_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, i = D.raw_events(spark, sf_dir), F.col("seq")
    part = lambda odd, s, e, n: x.filter(i % 2 == odd).select("song_id", "seq", F.when(i % s > 0, F.col("start").cast("double")).alias("start"), F.when(i % e > 0, F.col("start").cast("double") + n).alias("end"))
    return ED.overlapping_inserts(part(1, 5, 30, HOUR // 2), part(0, 7, 50, HOUR), 6.0 * HOUR).select("song_id", "seq")


@query(f"{_BOTH} SELECT song_id, seq, label FROM ref WHERE seq % 4 > 0 UNION ALL SELECT song_id, seq, label FROM hyp WHERE seq % 4 = 0")
def u4_overlaid_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["song_id", "seq", "label"]
    base = D.reference(spark, sf_dir).select(*cols)
    return ED.overlay(base, base.filter("seq % 4 = 0"), D.hypothesis(spark, sf_dir).filter("seq % 4 = 0").select(*cols), ["song_id", "seq"])


def _chord_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = L.with_parsed(D.reference(spark, sf_dir), "label")
    seconds = lambda c: F.col(c) * F.lit(SECOND)
    return x.select("song_id", "seq", seconds("start").alias("start"), seconds("end").alias("end"), "chord.root", "chord.quality", "chord.bass", "label", F.lit(None).cast("double").alias("confidence"), F.lit("engine").alias("source"))


_MOVED = f"{L.NOTES}[1 + (list_position({L.NOTES}, {{0}}) + 1) % 12]"
_SIMPLE = ", ".join(f"('{a}', '{b}')" for a, b in L.SIMPLER.items())


@query(f"""{_BOTH}, {_PARSE}, sx(quality, suffix) AS (VALUES {_SUFFIXES}), sm(quality, plain) AS (VALUES {_SIMPLE}),
a AS (SELECT r.song_id, r.seq, r.label, p.root, p.quality, p.bass, r.song_id % 3 = 0 AS moved FROM ref r JOIN parsed p USING (label)),
b AS (SELECT *, moved AND root IS NOT NULL AND quality NOT IN ('no_chord', 'other', 'unknown') AS t FROM a),
c AS (SELECT b.*, CASE WHEN t THEN {_MOVED.format("root")} ELSE root END AS r2, CASE WHEN t THEN {_MOVED.format("bass")} ELSE bass END AS b2, moved AND plain IS NOT NULL AS s, CASE WHEN moved THEN coalesce(plain, quality) ELSE quality END AS q2 FROM b LEFT JOIN sm USING (quality))
SELECT song_id, seq, r2 AS root, q2 AS quality, CASE WHEN s THEN 'user-simplify' WHEN t THEN 'user-transpose' ELSE 'engine' END AS source,
 CASE WHEN NOT t AND NOT s THEN label ELSE CASE WHEN q2 = 'no_chord' THEN 'N' WHEN r2 IS NULL THEN '?' ELSE r2 || coalesce(suffix, '') || CASE WHEN b2 IS NOT NULL AND b2 <> r2 THEN '/' || b2 ELSE '' END END END AS label FROM c LEFT JOIN sx ON sx.quality = q2""")
def c8_effective_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third song is moved up by two semitones and simplified; a second transposition is undone."""
    base = _chord_layer(spark, sf_dir)
    steps = [(0, "transpose", 2), (1, "simplify", None), (2, "transpose", 5), (3, "undo", None)]
    cmds = F.array(*(F.struct(F.lit(s).cast("bigint").alias("seq"), F.lit(k).alias("kind"), F.lit(n).cast("bigint").alias("semitones")) for s, k, n in steps))
    tape = base.filter("song_id % 3 = 0").select("song_id").distinct().select("song_id", F.explode(cmds).alias("c")).select("song_id", "c.*")
    return ED.effective_chords(base, tape)[0].select("song_id", "seq", "root", "quality", "source", "label")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chords = _chord_layer(spark, sf_dir)
    songs = chords.select("song_id").distinct().select("song_id", F.format_string("/music/%d.wav", "song_id").alias("path"), F.when(F.col("song_id") % 4 > 0, F.col("song_id") * 10.0).alias("duration"))
    lines = D.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("song_id"), F.col("turn").alias("seq"), "text", F.when(F.col("turn") % 2 == 0, F.col("turn") * 2.0).alias("start"), F.lit(None).cast("double").alias("end"), F.when(F.col("turn") % 5 == 4, "instrumental").otherwise("lyrics").alias("kind"))
    keys = songs.filter("song_id % 2 = 0").select("song_id", F.lit("C").alias("tonic"), F.lit("major").alias("mode"))
    return DO.assemble(songs, chords, lines, keys, songs.select("song_id", (60.0 + F.col("song_id")).alias("bpm")))


_DOC = f"""WITH {_REF}, g AS (SELECT song_id, count(*) AS n, md5(string_agg(label || ' ' || CAST(round(start * 1e-6) AS BIGINT), '|' ORDER BY start, seq)) AS labels FROM ref GROUP BY song_id), c AS (SELECT conv_id AS song_id, count(*) AS lines, md5(string_agg(coalesce(text, ''), '|' ORDER BY turn % 2, turn)) AS texts FROM conversations GROUP BY conv_id)
SELECT song_id, n AS chords, labels, coalesce(lines, 0) AS lines, coalesce(texts, md5('')) AS texts, CASE WHEN song_id % 2 = 0 THEN 'C major' END AS key, 60.0 + song_id AS bpm FROM g LEFT JOIN c USING (song_id)"""


def _shape(docs: DataFrame) -> DataFrame:
    d = lambda f: F.col(f"document.{f}")
    return docs.select("song_id", F.size(d("chords")).cast("bigint").alias("chords"), F.md5(F.array_join(F.transform(d("chords"), lambda c: F.concat_ws(" ", c["label"], F.round(c["start"]).cast("bigint"))), "|")).alias("labels"), F.size(d("lyrics")).cast("bigint").alias("lines"), F.md5(F.array_join(F.transform(d("lyrics"), lambda x: F.coalesce(x["text"], F.lit(""))), "|")).alias("texts"), F.when(d("key.tonic").isNotNull(), F.concat_ws(" ", d("key.tonic"), d("key.mode"))).alias("key"), d("tempo.bpm").alias("bpm"))


@query(_DOC)
def j17_assembled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(_documents(spark, sf_dir))


@query(_DOC)
def r10_documents_there_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(DO.from_json(DO.to_json(_documents(spark, sf_dir)))[0])


@query(f"""WITH {_REF}, g AS (SELECT song_id, string_agg('| ' || printf('%02d:%05.2f', CAST(floor(start * 1e-6 / 60) AS BIGINT), start * 1e-6 - floor(start * 1e-6 / 60) * 60) || ' | ' || printf('%02d:%05.2f', CAST(floor("end" * 1e-6 / 60) AS BIGINT), "end" * 1e-6 - floor("end" * 1e-6 / 60) * 60) || ' | ' || label || ' |', chr(10) ORDER BY start, seq) AS rows FROM ref GROUP BY song_id)
SELECT song_id, md5('# ' || song_id || '.wav' || chr(10) || chr(10) || '## Chords' || chr(10) || chr(10) || '| start | end | chord |' || chr(10) || '| ----- | --- | ----- |' || chr(10) || rows || chr(10)) AS sheet FROM g""")
def r15_markdown_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    chords = _chord_layer(spark, sf_dir)
    songs = chords.select("song_id").distinct().select("song_id", F.format_string("/music/%d.wav", "song_id").alias("path"), F.lit(None).cast("double").alias("duration"))
    return DO.markdown(DO.assemble(songs, chords)).select("song_id", F.md5("sheet").alias("sheet"))


@query(f"""{_BOTH}, n AS (SELECT DISTINCT song_id FROM hyp WHERE song_id % 3 = 0), x AS (SELECT * FROM hyp WHERE song_id % 3 = 0 UNION ALL SELECT * FROM ref WHERE song_id NOT IN (SELECT song_id FROM n)) SELECT song_id, count(*) AS chords, md5(string_agg(label, '|' ORDER BY start, seq)) AS labels FROM x GROUP BY song_id""")
def r16_documents_with_edited_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = D.hypothesis(spark, sf_dir).filter("song_id % 3 = 0").select("song_id", "seq", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "label")
    text = DO.to_json(DO.with_layers(_documents(spark, sf_dir), chords=h))
    chords = F.from_json("value", DO.ENVELOPE)["document"]["chords"]
    return text.select("song_id", F.size(chords).cast("bigint").alias("chords"), F.md5(F.array_join(F.transform(chords, lambda c: c["label"]), "|")).alias("labels"))


@query("""WITH d AS (SELECT user_id AS song_id, count(*) AS n FROM events GROUP BY 1), l AS (SELECT conv_id AS song_id, count(*) AS lines FROM conversations WHERE conv_id % 2 = 0 GROUP BY 1), c AS (SELECT conv_id AS song_id, count(*) AS lines FROM conversations GROUP BY 1)
SELECT song_id, coalesce(l.lines, c.lines, 0) AS lines, CASE WHEN l.lines IS NULL THEN NULL ELSE 'subtitles' END AS source FROM d LEFT JOIN l USING (song_id) LEFT JOIN c USING (song_id)""")
def c10_timed_lyrics_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.read(spark, sf_dir, "conversations").filter("conv_id % 2 = 0").select(F.col("conv_id").alias("song_id"), F.col("turn").alias("seq"), "text", F.col("turn").cast("double").alias("start"), F.lit(None).cast("double").alias("end"))
    x = DO.with_timed_lyrics(_documents(spark, sf_dir), lines, "subtitles")
    return x.select("song_id", F.size("document.lyrics").cast("bigint").alias("lines"), F.try_element_at("document.raw", F.lit("lyrics_override")).alias("source"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case a song: the reference and hypothesis timelines in seconds, keys and tempos by its number, and all turns beside those after them as lyrics."""
    empty = "array<struct<start:double,end:double,label:string>>"
    side = lambda df, n: df.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct((F.col("start") * SECOND).alias("start"), (F.col("end") * SECOND).alias("end"), "label"))).alias(n))
    turns = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", c))), lambda x: x[c]), " ")
    t = D.transcripts(spark, sf_dir).groupBy("song_id").agg(turns("ref").alias("rt"), turns("hyp").alias("ht"))
    x = side(D.reference(spark, sf_dir), "r").join(side(D.hypothesis(spark, sf_dir), "h"), "song_id", "left").join(t, "song_id", "left")
    i = F.col("song_id")
    key = lambda c, mode: F.concat(L.note_name(F.pmod(c, F.lit(12)).cast("int")), F.lit(mode))
    words = lambda c: F.transform(F.filter(F.split(c, " "), lambda w: w != ""), lambda w, k: F.struct(w.alias("text"), k.cast("double").alias("start")))
    make = lambda chords, text, k, bpm: F.struct(text.alias("lyrics_text"), words(text).alias("lyrics_words"), chords.alias("chords"), F.transform(chords, lambda c: c["label"]).alias("chord_labels"), k.alias("key"), bpm.alias("tempo_bpm"))
    hyp = F.when(i % 11 == 0, F.array().cast(empty)).when(i % 13 != 0, F.col("h"))
    return x.select(
        i.cast("string").alias("name"), F.format_string("song %d", i).alias("song"), F.when(i % 5 > 0, pick(["a", "b"], i)).alias("engine"), F.lit("1").alias("engine_version"), F.lit(None).cast("string").alias("model"),
        (100.0 + i).alias("duration_seconds"), F.when(i % 2 == 0, 10.0).alias("processing_time_seconds"), F.lit(None).cast("bigint").alias("peak_memory_bytes"), F.when(i % 3 > 0, "x.wav").alias("audio"),
        make(F.col("r"), F.col("rt"), key(i, " major"), 60.0 + i % 40).alias("reference"), make(hyp, F.col("ht"), F.when(i % 7 > 0, key(i + i % 8, " major")), F.when(i % 6 > 0, 60.0 + i % 37)).alias("hypothesis"),
    )


_CASE_SQL = f"""{_BOTH}, s AS (SELECT DISTINCT song_id AS i FROM ref), r AS (SELECT song_id AS i, label, count(*) AS r FROM ref GROUP BY ALL), h AS (SELECT song_id AS i, label, count(*) AS h FROM hyp WHERE song_id % 11 <> 0 GROUP BY ALL),
f AS (SELECT i, 2.0 * sum(least(coalesce(r, 0), coalesce(h, 0))) / sum(coalesce(r, 0) + coalesce(h, 0)) AS bag, 2.0 * count(*) FILTER (r > 0 AND h > 0) / (count(r) + count(h)) AS pal FROM r FULL JOIN h USING (i, label) GROUP BY i),
t AS (SELECT i, CASE WHEN i % 7 > 0 THEN CASE (i % 8) % 12 WHEN 0 THEN 'exact' WHEN 7 THEN 'fifth' ELSE 'other' END END AS rel, CASE WHEN i % 6 > 0 THEN abs((60.0 + i % 37) - (60.0 + i % 40)) END AS err FROM s)
SELECT CAST(i AS VARCHAR) AS name, CASE WHEN i % 13 <> 0 OR i % 11 = 0 THEN bag END AS multiset_f1, CASE WHEN i % 13 <> 0 OR i % 11 = 0 THEN pal END AS palette_f1, rel AS relation, CASE rel WHEN 'exact' THEN 1.0 WHEN 'fifth' THEN 0.5 WHEN 'other' THEN 0.0 END::DOUBLE AS weighted, CAST(err AS DOUBLE) AS tempo_error, CASE WHEN i % 2 = 0 THEN (100.0 + i) / 10 END::DOUBLE AS factor FROM s LEFT JOIN f USING (i) JOIN t USING (i)"""


@query(_CASE_SQL)
def v4_case_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of scores that both sides declare: bags and sets of labels, keys, tempos and speeds."""
    cases = _cases(spark, sf_dir)
    x = CA.declared(cases, "chord_labels", F.size("ref") == 0)
    side = lambda c: x.select("name", F.explode(c).alias("label"))
    bags = SC.label_f1(side("ref"), side("hyp"), "name")
    return CA.field_scores(cases).join(bags, "name", "left").select("name", F.col("bag_f1").alias("multiset_f1"), F.col("set_f1").alias("palette_f1"), F.col("key_relation").alias("relation"), F.col("key_weighted_score").alias("weighted"), F.col("tempo_absolute_bpm_error").alias("tempo_error"), F.col("performance_real_time_factor").alias("factor"))


@query()
def c2_case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CA.score_cases(_cases(spark, sf_dir))


@query(_CASE_SQL.split("SELECT CAST(i AS VARCHAR)")[0] + "SELECT CAST(i AS VARCHAR) AS name, CASE WHEN i % 3 > 0 THEN 'k' WHEN i % 5 > 0 THEN ['a', 'b'][1 + i % 2] END AS engine, CASE WHEN i % 3 > 0 AND i % 4 > 0 THEN 'D major' WHEN i % 3 > 0 THEN 'unknown' WHEN i % 7 > 0 THEN ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][1 + (i + i % 8) % 12] || ' major' END AS key, CASE WHEN i % 3 > 0 THEN 3.5 WHEN i % 2 = 0 THEN 10.0 END::DOUBLE AS seconds, CAST(100 + i AS DOUBLE) AS duration FROM s")
def j16_filled_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of an engine put into the cases with audio."""
    cases = _cases(spark, sf_dir)
    none = lambda t: F.lit(None).cast(t)
    out = cases.select("name", F.lit("k").alias("engine"), F.lit("2").alias("engine_version"), F.lit("key").alias("kind"), F.when(F.col("name").cast("bigint") % 4 > 0, "D major").alias("key"), none("array<struct<start:double,end:double,label:string>>").alias("chords"), none("double").alias("tempo_bpm"), none("string").alias("lyrics_text"), none("array<struct<text:string,start:double>>").alias("lyrics_words"), F.lit(7.0).alias("audio_seconds"), F.lit(3.5).alias("processing_time_seconds"), none("bigint").alias("peak_memory_bytes"))
    return CA.fill_hypotheses(cases, out).select("name", "engine", F.col("hypothesis.key").alias("key"), F.col("processing_time_seconds").alias("seconds"), F.col("duration_seconds").alias("duration"))


@query()
def q1_alignment_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.align_views(_sequences(spark, sf_dir))


@query()
def q5_word_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _cases(spark, sf_dir).select("name", F.col("reference.lyrics_words").alias("ref"), F.col("hypothesis.lyrics_words").alias("hyp")).filter("size(ref) > 0 and size(hyp) > 0")
    return SC.word_time_errors(x, "name")


@query()
def r12_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CA.markdown(c2_case_scores(spark, sf_dir))


_SUNG = "w AS (SELECT conv_id AS song_id, turn * 1000 + n AS n, CASE WHEN (turn + n) % 4 = 0 THEN CAST(turn * 50 + n AS DOUBLE) END AS hs, CASE WHEN (turn + n) % 4 = 0 THEN CAST(turn * 50 + n AS DOUBLE) + CAST(0.25 AS DOUBLE) * (1 + n % 3) END AS he FROM (SELECT conv_id, turn, unnest(range(0, greatest(1, least(9, length(text) // 20)))) AS n FROM conversations WHERE text IS NOT NULL))"


@query(f"""WITH {_SUNG}, u AS (SELECT song_id, CAST(greatest(0.1, coalesce(median(he - hs) FILTER (hs IS NOT NULL), 0.35)) AS DOUBLE) AS u FROM w GROUP BY song_id),
x AS (SELECT *, max(CASE WHEN hs IS NOT NULL THEN n END) OVER (PARTITION BY song_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pn, min(CASE WHEN hs IS NOT NULL THEN n END) OVER (PARTITION BY song_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fn FROM w JOIN u USING (song_id)),
y AS (SELECT x.*, greatest(p.he, p.hs + 0.05) AS pe, f.hs AS fs FROM x LEFT JOIN w p ON p.song_id = x.song_id AND p.n = pn LEFT JOIN w f ON f.song_id = x.song_id AND f.n = fn),
z AS (SELECT *, CASE WHEN pn IS NOT NULL AND fn IS NOT NULL THEN pe + greatest(0.0, fs - pe) * (n - pn) / (fn - pn) WHEN pn IS NOT NULL THEN pe + (n - pn) * u WHEN fn IS NOT NULL THEN greatest(0.0, fs - (fn - n) * u) ELSE n * u END AS s FROM y),
e AS (SELECT *, CASE WHEN pn IS NOT NULL AND fn IS NOT NULL THEN least(fs, s + greatest(0.05, greatest(0.0, fs - pe) / (fn - pn))) WHEN fn IS NOT NULL THEN least(fs, s + u) ELSE s + u END AS e FROM z)
SELECT song_id, n, round(coalesce(hs, s), 6) AS start, round(CASE WHEN hs IS NOT NULL THEN greatest(he, hs + 0.05) WHEN e <= s THEN s + 0.05 ELSE e END, 6) AS "end" FROM e""")
def w12_filled_word_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.read(spark, sf_dir, "conversations").filter("text is not null")
    n = F.greatest(F.lit(1), F.least(F.lit(9), F.floor(F.char_length("text") / 20).cast("int")))
    w = c.select(F.col("conv_id").alias("song_id"), "turn", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    hit = (F.col("turn") + F.col("k")) % 4 == 0
    start = F.col("turn") * 50.0 + F.col("k")
    w = w.select("song_id", (F.col("turn") * 1000 + F.col("k")).cast("bigint").alias("n"), F.when(hit, start).alias("heard_start"), F.when(hit, start + 0.25 * (1 + F.col("k") % 3)).alias("heard_end"))
    tracks = w.select("song_id").distinct().withColumn("duration", F.lit(None).cast("double"))
    return CH.fill_word_times(w, tracks).select("song_id", "n", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def _chart(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Turns of conversations as a transcript and, with some words lost, as a chart; chords over their words, and a detected one for each third."""
    c = D.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("song_id"), "turn", "text")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    transcript = c.select("song_id", F.col("turn").alias("seq"), F.array_join(words, " ").alias("text"), (F.col("turn") * 60.0).alias("start"), (F.col("turn") * 60.0 + 50).alias("end"))
    lines = c.select("song_id", F.col("turn").alias("line"), F.array_join(F.filter(words, lambda w: F.pmod(F.xxhash64(w), F.lit(6)) > 0), " ").alias("text"))
    chords = lines.select("song_id", "line", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    no = F.row_number().over(Window.partitionBy("song_id").orderBy("line", "k")) - 1
    chords = chords.select("song_id", no.cast("bigint").alias("seq"), D.vocabulary(F.col("line") * 3 + F.col("k")).alias("label"), "line", F.when(F.col("song_id") % 3 > 0, F.col("k") * 4).alias("word_no"))
    heard = chords.filter("seq % 3 > 0").select("song_id", "seq", (F.col("seq") * 18.0).alias("start"), F.lit(None).cast("double").alias("end"), "label")
    tracks = c.groupBy("song_id").agg((F.max("turn") * 60.0 + 60).alias("duration"))
    return lines, chords, heard, transcript, tracks


@query()
def c7_imported_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.import_chart(*_chart(spark, sf_dir))[0]


@query()
def c7_imported_lyrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.import_chart(*_chart(spark, sf_dir))[1]


@query()
def c6_chords_over_lyrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of a minute, and the events as chords between and above them."""
    c = D.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("song_id"), "turn", "text")
    ws = F.transform(F.filter(F.split("text", " "), lambda w: w != ""), lambda w, k: F.struct(w.alias("text"), F.when(F.col("turn") % 2 == 0, F.col("turn") * 7200.0 + k).alias("start"), F.lit(None).cast("double").alias("end")))
    lines = c.select("song_id", F.col("turn").alias("seq"), "text", F.when(F.col("turn") % 5 < 4, F.col("turn") * 7200.0).alias("start"), (F.col("turn") * 7200.0 + 3600).alias("end"), ws.alias("words"))
    lines = lines.withColumn("end", F.when(F.col("start").isNotNull(), F.col("end")))
    chords = D.reference(spark, sf_dir).select("song_id", "seq", (F.col("start") * SECOND).alias("start"), (F.col("end") * SECOND).alias("end"), "label").join(lines.select("song_id").distinct(), "song_id", "left_semi")
    return CL.sheet_rows(lines, chords, c.select("song_id", (F.col("song_id") % 2 == 0).alias("prefer_flats")).distinct()).select("song_id", "pos", "text", "chord_row", "is_gap", "start", "end")


@query()
def c3_chords_of_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.frames(spark, sf_dir).withColumn("rms", F.aggregate("chroma", F.lit(0.0), lambda a, x: a + x)).withColumn("duration", F.lit(None).cast("double"))
    return JO.chords_of_frames(f, 0.1).select("song_id", "seq", "start", "end", "root", "quality", "confidence", "score_margin")


@query(f"""WITH {_FRAMES}, s AS (SELECT song_id, frame_no, [{_COS}, {FR.NO_CHORD_SCORE!r}] AS s FROM f), x AS (SELECT song_id, frame_no // 10 AS seq, s, CAST(1 + (frame_no // 10) % 24 AS INT) AS own FROM s)
SELECT song_id, seq, round(avg(s[own] - list_max(list_concat(s[1 : own - 1], s[own + 1 :]))), 6) AS margin FROM x GROUP BY song_id, seq""")
def a12_segment_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of ten frames, each said to be the next of the 24 chords: how much better that is than the best other one."""
    f = D.frames(spark, sf_dir).withColumn("scores", FR.frame_scores(F.col("chroma")))
    seq = F.floor(F.col("frame_no") / 10)
    states = F.array(*map(F.lit, FR.STATES))
    segments = f.select("song_id", seq.alias("seq")).distinct().select("song_id", "seq", F.col("seq").cast("double").alias("start"), F.element_at(states, (F.col("seq") % 24 + 1).cast("int")).alias("label"))
    return FR.segment_margins(f, segments, 0.1).select("song_id", "seq", F.round("margin", 6).alias("margin"))


@query()
def c5_calibrated_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = D.hypothesis(spark, sf_dir).withColumn("margin", (F.col("seq") % 20) * 0.05).withColumn("confidence", F.col("margin"))
    takes = ev.select("song_id").distinct().withColumn("name", F.format_string("%08d", "song_id"))
    return JO.calibrate(ev, D.reference(spark, sf_dir), takes, 12 * HOUR)[2]


@query()
def c1_corpus_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    takes = D.raw_events(spark, sf_dir).select("song_id").distinct().withColumn("name", F.format_string("%08d", "song_id"))
    return JO.corpus_run(takes, D.reference(spark, sf_dir), D.hypothesis(spark, sf_dir), 12 * HOUR, 2 * HOUR, None)[1]
