"""Edit sidecars: one JSON file a song, with its layers and the tape of commands over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantus.operators.editing import FIELDS, TYPES

#: What a sidecar says it is; the first part of the format names the program that wrote it.
FORMAT, VERSION, SCHEMA = "^[a-z]+-edits$", "1", "1"
CHORD = "start double, end double, root string, quality string, bass string, label string, confidence double, source string"
LINE = "text string, start double, end double, kind string, source string"


def _struct(columns: str) -> str:
    return "struct<" + ",".join(c.replace(" ", ":", 1) for c in columns.split(", ")) + ">"


DOCUMENT = f"schema_version string, document struct<format:string,edits_version:string,input_path:string,input_hash:string,chords:array<{_struct(CHORD)}>,lyrics:array<{_struct(LINE)}>,commands:array<map<string,string>>>"


def read_edits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """chords, lyrics, tape and rejected files, each with the file's name.

    Rejected: no such document, another format or version, no chords or commands, an unknown kind, a missing or an additional field,
    a value of the wrong type. Missing lyrics are none. A rejected file gives no rows elsewhere.
    """
    x = spark.read.schema(DOCUMENT).option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("name"), "document.*")
    c = F.col("commands")
    fields = F.create_map(*[y for k, v in FIELDS.items() for y in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    want = lambda m: F.try_element_at(fields, m["kind"])
    own = lambda m: F.filter(F.map_keys(m), lambda k: k != "kind")
    number = [k for k, t in TYPES.items() if t != "string"]

    def fits(m):
        bad = F.map_filter(m, lambda k, v: k.isin(number) & v.isNotNull() & v.try_cast("double").isNull())
        whole = F.map_filter(m, lambda k, v: k.isin("index", "semitones") & v.try_cast("bigint").isNull())
        text = F.map_filter(m, lambda k, v: k.isin("label", "text") & v.isNull())
        return (F.size(bad) == 0) & (F.size(whole) == 0) & (F.size(text) == 0)

    error = (
        F.when(~F.coalesce("format", F.lit("")).rlike(FORMAT), "format").when(F.coalesce("edits_version", F.lit("")) != VERSION, "version").when(F.col("chords").isNull(), "chords").when(c.isNull(), "commands")
        .when(F.exists(c, lambda m: want(m).isNull()), "kind").when(F.exists(c, lambda m: F.size(F.array_except(want(m), own(m))) > 0), "missing field")
        .when(F.exists(c, lambda m: F.size(F.array_except(own(m), want(m))) > 0), "unknown field").when(~F.forall(c, fits), "value")
    )
    x = x.withColumn("error", error)
    good = x.filter("error is null")
    layer = lambda col: good.select("name", F.posexplode(F.coalesce(col, F.array())).alias("seq", "e")).select("name", F.col("seq").cast("bigint").alias("seq"), "e.*")
    tape = good.select("name", F.posexplode("commands").alias("seq", "m"))
    tape = tape.select("name", F.col("seq").cast("bigint").alias("seq"), F.col("m")["kind"].alias("kind"), *(F.col("m")[k].try_cast(t).alias(k) for k, t in TYPES.items()))
    return layer("chords"), layer("lyrics"), tape, x.filter("error is not null").select("name", "error")


def sidecars(chords: DataFrame, lyrics: DataFrame, tape: DataFrame, songs: DataFrame, form: str, key: str = "song_id") -> DataFrame:
    """key, value: the sidecar of each song as JSON. ``songs`` has key, input_path and input_hash; commands keep exactly the fields of their kind, null ones too. ``form`` is the format that it names."""
    chord, line = ([c.split()[0] for c in cols.split(", ")] for cols in (CHORD, LINE))
    gather = lambda df, names, out: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(*names).alias("e")))).alias(out))
    value = lambda k: F.when(F.col("kind") == k, F.to_json(F.struct(F.lit(k).alias("kind"), *(F.col(f) for f in FIELDS[k])), {"ignoreNullFields": "false"}))
    cmds = tape.select(key, "seq", F.coalesce(*(value(k) for k in FIELDS)).alias("text")).filter("text is not null")
    cmds = cmds.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("c"))
    x = songs.join(gather(chords, chord, "chords"), key, "left").join(gather(lyrics, line, "lyrics"), key, "left").join(cmds, key, "left")
    layer = lambda c, kind: F.to_json(F.coalesce(F.transform(c, lambda r: r["e"]), F.array().cast(f"array<{kind}>")), {"ignoreNullFields": "false"})
    commands = F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("c", lambda r: r["text"]), ","), F.lit("")), F.lit("]"))
    head = F.to_json(F.struct("input_path", "input_hash"), {"ignoreNullFields": "false"})
    body = F.concat(F.lit('{"chords":'), layer("chords", _struct(CHORD)), F.lit(',"commands":'), commands, F.lit(f',"edits_version":"{VERSION}","format":"{form}",'), F.expr("substring(" + "h" + ", 2, length(h) - 2)"), F.lit(',"lyrics":'), layer("lyrics", _struct(LINE)), F.lit("}"))
    return x.withColumn("h", head).select(key, F.concat(F.lit('{"document":'), body, F.lit(f',"schema_version":"{SCHEMA}"}}')).alias("value"))
