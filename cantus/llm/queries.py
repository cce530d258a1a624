"""The queries opN_<name>, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantus.llm import decontam, htmltext, langid, licenses, linededup, lmscore, mixing, pairbitmaps, periodic, quality, sentencepieces, setjoin, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(folds: int, fold: int):
    """Rows whose crc32 of the id as text leaves this remainder."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == fold


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_model(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted", "margin")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(table(spark, sf_dir, "documents")).drop("spans")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.ngram_components(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train_model(docs, ~held_out(3, 1)))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "rejected")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines_removed")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality.line_rules(table(spark, sf_dir, "documents"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "overlap", "answer_overlap", "cosine", "start")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return pairbitmaps.link_scores(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts = docs.select("doc_id", periodic.replayed(F.col("text"), F.crc32(F.col("doc_id").cast("string"))).alias("text"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = periodic.periodic_runs(texts).withColumn("best", periodic.strongest(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_ngram_join": op3_ngram_join,
    "op4_mixing": op4_mixing,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_html_text": op9_html_text,
    "op10_lm_score": op10_lm_score,
    "op11_token_alignment": op11_token_alignment,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_periodic_runs": op13_periodic_runs,
}

_TEMPLATES = ", ".join(f"({i}, '{t}', '{label}')" for i, (t, label) in enumerate([*licenses.PHRASES, *licenses.NOTICES]))

OP2_SQL = rf"""
WITH tmpl(template, phrase, label) AS (VALUES {_TEMPLATES}),
tw AS (SELECT template, label, string_split(phrase, ' ') AS w FROM tmpl),
tg AS (SELECT template, label, len(w) - 2 AS size, i - 1 AS tpos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT template, label, w, unnest(range(1, len(w) - 1)) AS i FROM tw)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
v AS (SELECT doc_id, template, label, size, pos - tpos AS diag, count(*) AS votes, min(pos) AS lo, max(pos) AS hi FROM g JOIN tg USING (gram) GROUP BY ALL),
b AS (SELECT doc_id, count(*) AS n_base, min(diag) AS first_word, max(diag) AS last_word, list_sort(list(DISTINCT label)) AS bl FROM v WHERE template < {len(licenses.PHRASES)} AND votes = size GROUP BY doc_id),
r AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diag, lo ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN diag - lag(diag) OVER q > 3 OR lo - lag(hi) OVER q > size THEN 1 ELSE 0 END AS apart FROM v WHERE template >= {len(licenses.PHRASES)} WINDOW q AS (PARTITION BY doc_id, template ORDER BY diag, lo))),
h AS (SELECT r.doc_id, r.template, r.label, r.size, r.run, g.pos, tg.tpos FROM r JOIN tg ON r.template = tg.template JOIN g ON g.doc_id = r.doc_id AND g.gram = tg.gram AND g.pos - tg.tpos = r.diag),
k AS (SELECT *, coalesce(max(tpos) OVER (PARTITION BY doc_id, template, run ORDER BY pos, tpos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS most FROM h),
s AS (SELECT doc_id, template, label, CAST(count(*) FILTER (tpos > most) AS DOUBLE) / size AS coverage FROM k GROUP BY doc_id, template, label, size, run),
m AS (SELECT doc_id, list(DISTINCT label) FILTER (coverage >= 0.6) AS more, max(coverage) AS best FROM s GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(bl, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(more, [])))), ','), '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) >> 12 AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
x AS (SELECT *, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS budget,
  coalesce(sum(2.0 * source_size) OVER o, 0) AS cap_before, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left
  FROM s WINDOW o AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (budget - cap_before) * weight >= cap * weight_left AS is_full FROM x),
t AS (SELECT source, source_size, round(CASE WHEN is_full THEN cap ELSE (budget - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) * weight / sum(weight) FILTER (NOT is_full) OVER () END, 6) AS target FROM f),
n AS (SELECT *, CAST(target > source_size AS BIGINT) AS once, target - CAST(target > source_size AS BIGINT) * source_size AS r FROM t),
b AS (SELECT source, h, sum(size) AS words FROM d WHERE size > 0 GROUP BY source, h),
c AS (SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h) AS until FROM b),
e AS (SELECT n.source, arg_min(struct_pack(h := h, until := until, words := words), h) FILTER (until >= r) AS e1, arg_max(struct_pack(h := h, until := until, words := words), h) AS e2 FROM n JOIN c ON n.source IS NOT DISTINCT FROM c.source GROUP BY n.source),
z AS (SELECT n.*, coalesce(e1, e2) AS e FROM n LEFT JOIN e ON n.source IS NOT DISTINCT FROM e.source),
k AS (SELECT *, coalesce(e.h + CASE WHEN e.until - r <= r - (e.until - e.words) THEN 1 ELSE 0 END, 0) AS threshold FROM z)
SELECT d.doc_id, d.size, k.source_size, CAST(k.target AS DOUBLE) AS target, CAST(d.size * (k.once + CASE WHEN d.h < k.threshold THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
rp AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM rp GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
ll AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ll GROUP BY doc_id),
nl AS (SELECT doc_id, source, regexp_replace(regexp_replace(lower(trim(line, E' \t\n\x0b\f\r')), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') AS norm, max(length(line)) AS chars FROM ll GROUP BY ALL),
o AS (SELECT source, norm FROM nl GROUP BY source, norm HAVING count(DISTINCT doc_id) > 25),
sp AS (SELECT nl.doc_id, sum(chars) AS line_chars, sum(CASE WHEN o.norm IS NULL THEN 0 ELSE chars END) AS shared FROM nl LEFT JOIN o ON nl.norm = o.norm AND nl.source IS NOT DISTINCT FROM o.source GROUP BY nl.doc_id),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(line_chars, 0) AS lc, coalesce(shared, 0) AS sh
  FROM d LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN sp USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lc - sh >= 0.5 * lc AS kept FROM f
"""

OP13_SQL = r"""
WITH c AS (SELECT doc_id, text, xor(list_reduce([ascii(x) for x in string_split(CAST(doc_id AS VARCHAR), '')], lambda c, b: list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, b)), 4294967295), 4294967295) AS h FROM documents),
d AS (SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM c),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT doc_id, n, i, w[1 + CASE WHEN i < coalesce(a, n) THEN i ELSE a + (i - a) % p END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
e AS (SELECT x.doc_id, x.i, x.i - y.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
l AS (SELECT doc_id, q AS period, min(i) - q AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.doc_id = l.doc_id AND o.period < l.period AND l.period % o.period = 0 AND o.start <= l.start AND o.start + o.length >= l.start + l.length)),
z AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
b AS (SELECT doc_id, start, length, period FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id AND t.i >= r.start + r.period AND t.i < r.start + r.length) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""

ORACLES = {"op2_license_scan": OP2_SQL, "op4_mixing": OP4_SQL, "op7_quality_rules": OP7_SQL, "op13_periodic_runs": OP13_SQL}
