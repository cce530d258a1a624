"""Files of a corpus: cases, annotations, manifests, digests, results and chord charts, read by Spark alone.

Readers return good rows, and where rows can be bad also a table of (name, error).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cantus.functions import labels as L

#: Suffixes of audio files, and one chord of a chart.
AUDIO = "aac aif aiff alac amr ape caf dsf flac m4a mka mp3 mp4 mpc oga ogg opus wav webm wma wv".split()
CHART_CHORD = r"^(?:N(?:\.C\.)?|[A-G](?:#|b)?(?:maj7|m7|m6|m9|add9|sus2|sus4|dim|aug|m|7|6|9)?(?:/[A-G](?:#|b)?)?)$"

_SIDE = "struct<lyrics_text:string,lyrics_words:array<struct<text:string,start:double>>,chords:array<struct<start:double,end:double,label:string>>,chord_labels:array<string>,key:string,tempo_bpm:double>"
CASES = f"song string, engine string, engine_version string, model string, duration_seconds double, processing_time_seconds double, peak_memory_bytes bigint, audio string, reference {_SIDE}, hypothesis {_SIDE}"
ANNOTATIONS = "annotations array<struct<namespace:string,data:array<struct<time:double,duration:double,value:string>>>>"
TAKES = "takes array<struct<name:string,split:string,audio:string,jams:string,audio_sha256:string,jams_sha256:string,duration_seconds:double>>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("name", F.col("_metadata.file_name"))


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark cases, one JSON object per file; a case without song, reference or hypothesis (objects both) is rejected by the field's name."""
    x = _json(spark, path, CASES)
    x = x.withColumn("error", F.coalesce(*[F.when(F.col(c).isNull(), c) for c in ("reference", "hypothesis", "song")]))
    return x.filter("error is null").drop("error"), x.filter("error is not null").select("name", "error")


def read_annotations(spark: SparkSession, path: str, index: int = 0) -> tuple[DataFrame, DataFrame]:
    """(name, seq, start, end, label) of the index-th chord annotation of each file; observations without time are dropped. Rejected: no annotations, no chord one, no such index, no data."""
    if index < 0:
        raise ValueError("index must be 0 or more")
    chord = F.filter("annotations", lambda a: a["namespace"] == "chord")
    x = _json(spark, path, ANNOTATIONS).withColumn("chord", chord).withColumn("data", F.get("chord", F.lit(index))["data"])
    error = F.when(F.col("annotations").isNull(), "annotations").when(F.size("chord") == 0, "chord").when(F.size("chord") <= index, "index").when(F.col("data").isNull(), "data")
    x = x.withColumn("error", error)
    o = x.filter("error is null").select("name", F.posexplode("data").alias("seq", "o")).filter("o.duration > 0")
    start = F.coalesce("o.time", F.lit(0.0))
    return o.select("name", "seq", start.alias("start"), (start + F.col("o.duration")).alias("end"), L.from_colon(F.coalesce("o.value", F.lit(""))).alias("label")), x.filter("error is not null").select("name", "error")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Takes of a manifest, digests in lower case, and the rejected ones; of a name that is there twice all are rejected."""
    x = spark.read.schema(TAKES).option("multiLine", True).json(path).select(F.explode("takes").alias("t")).select("t.*")
    for c in ("audio_sha256", "jams_sha256"):
        x = x.withColumn(c, F.lower(c))
    is_not = lambda c: ~F.coalesce(c, F.lit(False))
    error = F.coalesce(
        *[F.when(is_not(F.col(c) != ""), c) for c in ("name", "split", "audio", "jams")], F.when(~F.col("split").isin("comp", "solo"), "split"),
        *[F.when(F.col(c).startswith("/"), c) for c in ("audio", "jams")], *[F.when(is_not(F.col(c).rlike("^[0-9a-f]{64}$")), c) for c in ("audio_sha256", "jams_sha256")],
        F.when(is_not(F.col("duration_seconds") > 0), "duration_seconds"), F.when(F.count("*").over(Window.partitionBy("name")) > 1, "duplicate"),
    )
    x = x.withColumn("error", error)
    return x.filter("error is null").drop("error"), x.filter("error is not null").select("name", "error")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of all files below a path, path relative to it. Spark reads the content only if it is asked for, and lists no empty files: for it they are missing."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    bare = F.regexp_replace("path", r"^[a-z0-9+.-]+:/*", "/")
    return x.select(F.substring_index(bare, path.rstrip("/") + "/", -1).alias("path"), "length", "content")


def verify_files(takes: DataFrame, files: DataFrame) -> DataFrame:
    """(name, file, status) of each take's two files: ok, missing or wrong digest."""
    want = takes.select("name", F.explode(F.array(F.struct(F.col("audio").alias("file"), F.col("audio_sha256").alias("sha")), F.struct(F.col("jams").alias("file"), F.col("jams_sha256").alias("sha")))).alias("w")).select("name", "w.*")
    have = files.select(F.col("path").alias("file"), F.sha2("content", 256).alias("found"))
    return want.join(have, "file", "left").select("name", "file", F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("sha"), "ok").otherwise("wrong").alias("status"))


def audio_inventory(files: DataFrame) -> DataFrame:
    """(path, length, extension, valid, warning): an empty file is invalid, an unknown suffix only warns. Take listings that have empty files from elsewhere, as ``read_files`` has none."""
    x = files.select("path", "length", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"))
    return x.withColumn("valid", F.col("length") > 0).withColumn("warning", F.when(~F.col("extension").isin(AUDIO), "extension"))


def pending(takes: DataFrame, spark: SparkSession, results: str) -> DataFrame:
    """The takes without a line in the results, JSON lines of another program; unreadable lines do not count."""
    done = spark.read.schema("name string").option("mode", "DROPMALFORMED").json(results).filter("name is not null").select("name").distinct()
    return takes.join(done, "name", "left_anti")


def append_results(results: DataFrame, path: str) -> None:
    """Put results (name and scores) to those of earlier runs, a line each."""
    results.write.mode("append").json(path)


def write_attempt(results: DataFrame, folder: str, run: str) -> str:
    """The lines of an attempt at a run, which don't count before commit_attempt() has its name."""
    attempt = uuid.uuid4().hex
    results.write.parquet(f"{folder}/lines/run={run}/attempt={attempt}")
    return attempt


def commit_attempt(spark: SparkSession, folder: str, run: str, attempt: str) -> None:
    """From now on the attempt's lines are the run's, and those of other attempts at it aren't."""
    spark.createDataFrame([(run, attempt)], "run string, attempt string").coalesce(1).write.json(f"{folder}/commits/{run}-{attempt}")


def append_run(results: DataFrame, folder: str, run: str) -> None:
    """Put the results of a run to those of others. A run that is killed leaves nothing that counts, one that is repeated replaces itself."""
    commit_attempt(results.sparkSession, folder, run, write_attempt(results, folder, run))


def committed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The lines (of this schema) of all runs: for each those of the attempt that was committed last. None where nothing was committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/commits")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    commits = spark.read.schema("run string, attempt string").option("recursiveFileLookup", True).json(f"{folder}/commits")
    last = commits.groupBy("run").agg(F.max_by("attempt", F.struct("_metadata.file_modification_time", "attempt")).alias("attempt"))  # a row a run
    lines = spark.read.schema(f"{schema}, run string, attempt string").option("basePath", f"{folder}/lines").parquet(f"{folder}/lines")
    return lines.join(last, ["run", "attempt"], "left_semi").drop("run", "attempt")


def unmeasured(takes: DataFrame, lines: DataFrame) -> DataFrame:
    """The takes (name) that no line of committed() has."""
    return takes.join(lines.select("name").distinct(), "name", "left_anti")


def chart_lines(texts: DataFrame) -> DataFrame:
    """(name, line_no, kind, text, content) of the non-empty lines of chord charts (name, text).

    kind: section ('[..]'), chord (all tokens are chords) or lyric. ``content`` numbers the lyric lines after the first section or chord line; those before are titles.
    """
    x = texts.select("name", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line_no", "text")).withColumn("bare", F.regexp_replace("text", r"^\s+|\s+$", "")).filter("bare != ''")
    tokens = F.filter(F.split("bare", r"[\s|]+"), lambda t: t != "")
    chords = (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.rlike(CHART_CHORD))
    x = x.withColumn("kind", F.when(F.col("bare").startswith("[") & F.col("bare").endswith("]"), "section").when(chords, "chord").otherwise("lyric"))
    w = Window.partitionBy("name").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    started = F.max(F.col("kind") != "lyric").over(w)
    x = x.withColumn("_c", (F.col("kind") == "lyric") & started)
    return x.select("name", "line_no", "kind", "text", F.when(F.col("_c"), F.sum(F.col("_c").cast("int")).over(w) - 1).alias("content"))


def chart_chords(texts: DataFrame) -> DataFrame:
    """(name, line_no, chord_no, text, column, lyric_line, word_index) of the chords of charts.

    A chord sits over the last word that starts at or before its column in the lyric line right below, later chords of a
    line over later words as long as there are any; without such a line both are null.
    """
    below = F.lead(F.struct("kind", "text", "content")).over(Window.partitionBy("name").orderBy("line_no"))
    x = chart_lines(texts).withColumn("below", below).filter("kind = 'chord'").withColumn("lyric", F.when(F.col("below.kind") == "lyric", F.col("below.text")))
    n = F.size(F.regexp_extract_all("lyric", F.lit(r"(\S+)"), F.lit(1)))
    tokens = [F.regexp_extract_all("text", F.lit(r"([|\s]*)([^|\s]+)"), F.lit(k)) for k in (1, 2)]
    x = x.select("name", "line_no", F.when(F.col("lyric").isNotNull(), n).alias("n"), "lyric", "below.content", F.posexplode(F.arrays_zip(tokens[0].alias("gap"), tokens[1].alias("chord"))).alias("i", "c"))
    so_far = Window.partitionBy("name", "line_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("column", F.sum(F.length("c.gap") + F.length("c.chord")).over(so_far) - F.length("c.chord"))
    # the words that start at or before the column are those of the line up to it
    upto = F.size(F.regexp_extract_all(F.expr("substring(lyric, 1, cast(column as int) + 1)"), F.lit(r"(\S+)"), F.lit(1)))
    x = x.withColumn("near", F.greatest(upto - 1, F.lit(0)) - F.col("i")).withColumn("at", F.least(F.col("n") - 1, F.max("near").over(so_far) + F.col("i")))
    no = F.row_number().over(Window.partitionBy("name").orderBy("line_no", "i")) - 1
    has = F.col("n") > 0
    return x.select("name", "line_no", no.alias("chord_no"), F.col("c.chord").alias("text"), "column", F.when(has, F.col("content")).alias("lyric_line"), F.when(has, F.col("at")).alias("word_index"))
