"""Registered queries of the formats of files: files are written from the tables into the shared folder and read, or texts are parsed as their files hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantus.operators import jobs as JO
from cantus.operators.store import fresh
from cantus.plans.more_queries import _chord_layer
from cantus.plans.queries import _REF, query
from cantus.sources import corpus as CO
from cantus.sources import derived as D
from cantus.sources import edits as EX
from cantus.sources import timed_text as TT


def _written_files(rows: DataFrame, name: str) -> str:
    """A folder of files, one for each row (file, value)."""
    folder = fresh(rows.sparkSession, name)
    rows.write.partitionBy("file").text(folder)
    return f"{folder}/*"


@query("""WITH t AS (SELECT p_name AS name, CASE p_size % 5 WHEN 0 THEN 'live' WHEN 1 THEN 'comp' ELSE 'solo' END AS split, CASE WHEN p_size % 7 = 0 THEN '/' ELSE '' END || 'a/' || p_partkey || '.wav' AS audio, sha256(CAST(p_partkey AS VARCHAR)) AS sha, CASE WHEN p_size % 11 > 0 THEN p_retailprice ELSE 0 END AS d, count(*) OVER (PARTITION BY p_name) AS n FROM part)
SELECT name, CASE WHEN error IS NULL THEN sha END AS audio_sha256, error FROM (SELECT *, CASE WHEN split = 'live' THEN 'split' WHEN audio LIKE '/%' THEN 'audio' WHEN d <= 0 THEN 'duration_seconds' WHEN n > 1 THEN 'duplicate' END AS error FROM t)""")
def r3_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes in manifests of a hundred, of which some are wrong; digests in upper case."""
    p, size = D.read(spark, sf_dir, "part"), F.col("p_size")
    sha = F.upper(F.sha2(F.col("p_partkey").cast("string"), 256))
    take = F.struct(
        F.col("p_name").alias("name"), F.when(size % 5 == 0, "live").when(size % 5 == 1, "comp").otherwise("solo").alias("split"), F.concat(F.when(size % 7 == 0, "/").otherwise(""), F.format_string("a/%d.wav", "p_partkey")).alias("audio"),
        F.lit("a.jams").alias("jams"), sha.alias("audio_sha256"), sha.alias("jams_sha256"), F.when(size % 11 > 0, F.col("p_retailprice").cast("double")).otherwise(0.0).alias("duration_seconds"),
    )
    files = p.groupBy(F.floor(F.col("p_partkey") / 100).alias("file")).agg(F.to_json(F.struct(F.collect_list(take).alias("takes"))).alias("value"))
    good, bad = CO.read_manifest(spark, _written_files(files, "manifests"))
    return good.select("name", "audio_sha256", F.lit(None).cast("string").alias("error")).unionByName(bad.select("name", F.lit(None).cast("string").alias("audio_sha256"), "error"))


@query("""SELECT doc_id || CASE doc_id % 4 WHEN 0 THEN '.WAV' WHEN 1 THEN '.mp3' WHEN 2 THEN '.txt' ELSE '' END AS path, coalesce(n_chars, 0) > 0 AS valid, CASE WHEN doc_id % 4 > 1 THEN 'extension' END AS warning FROM documents""")
def r5_audio_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of documents as files, with empty ones and odd suffixes."""
    i = F.col("doc_id")
    suffix = F.when(i % 4 == 0, ".WAV").when(i % 4 == 1, ".mp3").when(i % 4 == 2, ".txt").otherwise("")
    files = D.read(spark, sf_dir, "documents").select(F.concat(i.cast("string"), suffix).alias("path"), F.coalesce("n_chars", F.lit(0)).alias("length"))
    return CO.audio_inventory(files).select("path", "valid", "warning")


def _subtitles(c: DataFrame, name) -> DataFrame:
    """A subtitle text of each conversation: a block a turn; the second turn of every tenth conversation ends before it starts."""
    stamp = lambda s: F.concat(F.date_format(F.timestamp_seconds(s), "HH:mm:ss"), F.lit(",500"))
    start = F.col("turn") * 5
    end = F.when((F.col("conv_id") % 10 == 0) & (F.col("turn") == 1), start - 1).otherwise(start + 4)
    block = F.concat(F.col("turn").cast("string"), F.lit("\n"), stamp(start), F.lit(" --> "), stamp(end), F.lit("\n"), F.regexp_replace("text", r"\s+", " "), F.lit("\n"))
    return c.groupBy(name.alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("block")))), lambda x: x["block"]), "\n").alias("text"))


_SPOKEN = r"c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations WHERE text IS NOT NULL)"


@query(rf"""WITH {_SPOKEN} SELECT CAST(conv_id AS VARCHAR) AS name, CASE WHEN NOT bad THEN row_number() OVER (PARTITION BY conv_id, bad ORDER BY turn) - 1 END AS seq, CASE WHEN NOT bad THEN text END AS text, CASE WHEN NOT bad THEN turn * 5 + 0.5 END::DOUBLE AS start, CASE WHEN NOT bad THEN turn * 5 + 4.5 END::DOUBLE AS "end", CASE WHEN bad THEN 'reversed' END AS error
FROM (SELECT *, conv_id % 10 = 0 AND turn = 1 AS bad FROM c) WHERE bad OR text <> ''""")
def r7_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of subtitles, and the blocks that are rejected."""
    c = D.read(spark, sf_dir, "conversations").filter("text is not null")
    good, bad = TT.parse_srt(_subtitles(c, F.col("conv_id").cast("string")))
    good = good.select("name", F.col("seq").cast("bigint").alias("seq"), "text", "start", "end", F.lit(None).cast("string").alias("error"))
    return good.unionByName(bad.select("name", "error"), allowMissingColumns=True)


@query(rf"""WITH {_SPOKEN}, n AS (SELECT *, conv_id || ['.srt', '.LRC', '.txt', '.lrc'][1 + conv_id % 4] AS name FROM c), s AS (SELECT DISTINCT name FROM n WHERE conv_id % 20 = 0 AND turn = 1)
SELECT name, count(*) FILTER (text <> '' OR conv_id % 4 > 0) AS lines, CAST(sum(CASE WHEN conv_id % 4 = 0 THEN turn * 5 + 0.5 ELSE turn * 3 END) AS DOUBLE) AS starts, NULL AS error FROM n WHERE conv_id % 4 IN (0, 1) AND name NOT IN (SELECT name FROM s) GROUP BY name
UNION ALL SELECT DISTINCT name, NULL, NULL, CASE conv_id % 4 WHEN 0 THEN 'reversed' WHEN 2 THEN 'suffix' ELSE 'empty' END FROM n WHERE conv_id % 4 > 1 OR name IN (SELECT name FROM s)""")
def r8_texts_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as subtitles, stamped lines in two spellings, one of them without a line, and a format that isn't known."""
    c, i = D.read(spark, sf_dir, "conversations").filter("text is not null"), F.col("conv_id")
    name = F.concat(i.cast("string"), F.element_at(F.array(*map(F.lit, (".srt", ".LRC", ".txt", ".lrc"))), (i % 4).cast("int") + 1))
    stamped = F.concat(F.lit("["), F.date_format(F.timestamp_seconds(F.col("turn") * 3), "mm:ss"), F.lit(".00]"), F.regexp_replace("text", r"[\s\[\]<>]+", " "))
    lrc = c.filter(i % 4 == 1).groupBy(name.alias("name")).agg(F.array_join(F.array_sort(F.collect_list(stamped)), "\n").alias("text"))
    none = c.filter(i % 4 > 1).select(name.alias("name")).distinct().withColumn("text", F.lit("\n"))
    lines, bad = TT.parse_timed_text(_subtitles(c.filter(i % 4 == 0), name).unionByName(lrc).unionByName(none))
    good = lines.groupBy("name").agg(F.count("*").alias("lines"), F.sum("start").alias("starts"))
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad.select("name", "error"), allowMissingColumns=True)


@query(f"""WITH {_REF.removeprefix("WITH ")} SELECT row_number() OVER (PARTITION BY song_id ORDER BY seq) - 1 AS seq, round(start * 1e-6, 6) AS start, round("end" * 1e-6, 6) AS "end", label, NULL AS kind FROM ref UNION ALL SELECT 0, NULL, NULL, NULL, 'transpose' FROM ref WHERE song_id % 2 = 1 GROUP BY song_id""")
def r11_sidecars_there_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sidecar of each song, with a command for every second one, written as a file and read: its chords, numbered by their place, and its commands."""
    chords = _chord_layer(spark, sf_dir)
    songs = chords.select("song_id").distinct().withColumn("input_path", F.format_string("/%d.wav", "song_id")).withColumn("input_hash", F.lit(None).cast("string"))
    tape = songs.filter("song_id % 2 = 1").select("song_id", F.lit(0).cast("bigint").alias("seq"), F.lit("transpose").alias("kind"), F.lit(1).cast("bigint").alias("semitones"))
    tape = tape.select("*", *(F.lit(None).cast(t).alias(c) for c, t in EX.TYPES.items() if c != "semitones"))
    lyrics = spark.createDataFrame([], "song_id bigint, seq bigint, text string, start double, end double, kind string, source string")
    files = EX.sidecars(chords, lyrics, tape, songs, "some-edits").withColumnRenamed("song_id", "file")
    back, _, cmds, _ = EX.read_edits(spark, _written_files(files, "sidecars"))
    chords = back.select("seq", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "label", F.lit(None).cast("string").alias("kind"))
    return chords.unionByName(cmds.filter("semitones = 1").select("seq", "kind"), allowMissingColumns=True)


@query(f"""WITH {_REF.removeprefix("WITH ")} SELECT song_id, seq, start, row_number() OVER (ORDER BY song_id, start, seq) AS place FROM ref""")
def s3_playback_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in the order of playback; written in that order, they are numbered as they stand."""
    from cantus.operators import scoring as SC

    rows = JO.playback_order(D.reference(spark, sf_dir)).select("song_id", "seq", "start")
    return SC.numbered(rows, "song_id", "start", "seq", out="place").select("song_id", "seq", "start", (F.col("place") + 1).alias("place"))
