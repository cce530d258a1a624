"""Documents of songs: layers put together, replaced, written as JSON and as Markdown, and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantus.operators.sheets import _fold
from cantus.operators.timeline import KEY

CHORD = "start double, end double, root string, quality string, bass string, label string, confidence double, source string"
WORD = "struct<text:string,start:double,end:double>"
LINE = f"text string, start double, end double, kind string, source string, words array<{WORD}>"
#: Fixed value: version of the envelope around a document.
SCHEMA = "1"


def struct_of(columns: str) -> str:
    return "struct<" + ",".join(c.replace(" ", ":", 1) for c in columns.split(", ")) + ">"


DOCUMENT = f"audio struct<path:string,duration:double>, chords array<{struct_of(CHORD)}>, lyrics array<{struct_of(LINE)}>, key struct<tonic:string,mode:string>, tempo struct<bpm:double>, raw map<string,string>"
ENVELOPE = f"schema_version string, document {struct_of(DOCUMENT)}"


def layer(rows: DataFrame, columns: str, out: str, key: str = KEY) -> DataFrame:
    """key and one array of a song's rows in the order of start and seq (seq alone where there is no start); columns that are missing are null."""
    names = [c.split(" ", 1) for c in columns.split(", ")]
    item = F.struct(*((F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in names))
    order = F.struct(F.col("start").isNull().alias("u"), "start", "seq", item.alias("e"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("x")).select(key, F.transform("x", lambda r: r["e"]).alias(out))


def assemble(songs: DataFrame, chords: DataFrame | None = None, lyrics: DataFrame | None = None, keys: DataFrame | None = None, tempos: DataFrame | None = None, raw: DataFrame | None = None, key: str = KEY) -> DataFrame:
    """key, document: one struct a song (path, duration) of its layers: chords, lyrics, key (tonic, mode), tempo (bpm), and raw texts by engine (engine, text).

    A layer that isn't given, or has no row of a song, is empty there; of an engine's texts the greatest stays.
    """
    x = songs.select(key, F.struct("path", F.col("duration").cast("double").alias("duration")).alias("audio"))
    empty = {"chords": f"array<{struct_of(CHORD)}>", "lyrics": f"array<{struct_of(LINE)}>", "raw": "map<string,string>"}
    parts = {
        "chords": chords is not None and layer(chords, CHORD, "chords", key), "lyrics": lyrics is not None and layer(lyrics, LINE, "lyrics", key),
        "key": keys is not None and keys.groupBy(key).agg(F.max(F.struct("tonic", "mode")).alias("key")), "tempo": tempos is not None and tempos.groupBy(key).agg(F.max(F.struct(F.col("bpm").cast("double").alias("bpm"))).alias("tempo")),
        "raw": raw is not None and raw.groupBy(key, "engine").agg(F.max("text").alias("t")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("engine", "t")))).alias("raw")),
    }
    kinds = {"key": "struct<tonic:string,mode:string>", "tempo": "struct<bpm:double>", **empty}
    for name, part in parts.items():
        x = x.join(part, key, "left") if part is not False else x.withColumn(name, F.lit(None).cast(kinds[name]))
        if name in empty:
            none = F.create_map().cast(kinds[name]) if name == "raw" else F.array().cast(kinds[name])
            x = x.withColumn(name, F.coalesce(name, none))
    return x.select(key, F.struct("audio", "chords", "lyrics", "key", "tempo", "raw").alias("document"))


def with_layers(documents: DataFrame, chords: DataFrame | None = None, lyrics: DataFrame | None = None, key: str = KEY) -> DataFrame:
    """Documents with the layers of the songs that are in ``chords`` or ``lyrics`` in place of their own."""
    for rows, columns, name in ((chords, CHORD, "chords"), (lyrics, LINE, "lyrics")):
        if rows is not None:
            documents = documents.join(layer(rows, columns, "_new", key), key, "left")
            documents = documents.withColumn("document", F.col("document").withField(name, F.coalesce("_new", F.col(f"document.{name}")))).drop("_new")
    return documents


def with_timed_lyrics(documents: DataFrame, lines: DataFrame, source: str, key: str = KEY) -> DataFrame:
    """Documents whose lyrics come from timed text files (seq, text, start, end) of some songs; the lines and raw say so."""
    given = lines.select(key).distinct().withColumn("_hit", F.lit(True))
    x = with_layers(documents, lyrics=lines.withColumn("source", F.lit(source)).withColumn("kind", F.lit("lyrics")), key=key).join(given, key, "left")
    noted = F.map_concat(F.map_filter(F.coalesce("document.raw", F.create_map().cast("map<string,string>")), lambda k, v: k != "lyrics_override"), F.create_map(F.lit("lyrics_override"), F.lit(source)))
    return x.withColumn("document", F.when(F.col("_hit"), F.col("document").withField("raw", noted)).otherwise(F.col("document"))).drop("_hit")


def to_json(documents: DataFrame, key: str = KEY) -> DataFrame:
    """key, value: the document in its envelope as JSON, fields in alphabetic order, nulls written."""
    d = lambda f: F.col(f"document.{f}")
    chord = lambda c: F.struct(*(c[n].alias(n) for n in sorted(x.split()[0] for x in CHORD.split(", "))))
    line = lambda c: F.struct(*(c[n].alias(n) for n in sorted(x.split()[0] for x in LINE.split(", "))))
    body = F.struct(F.struct(d("audio.duration").alias("duration"), d("audio.path").alias("path")).alias("audio"), F.transform(d("chords"), chord).alias("chords"), d("key").alias("key"), F.transform(d("lyrics"), line).alias("lyrics"), d("raw").alias("raw"), d("tempo").alias("tempo"))
    return documents.select(key, F.to_json(F.struct(body.alias("document"), F.lit(SCHEMA).alias("schema_version")), {"ignoreNullFields": "false"}).alias("value"))


def from_json(texts: DataFrame, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """Documents of JSON texts (key, value), and the rejected ones: no JSON, no document, a chord without start, a line without text. Other versions are read, unknown fields ignored."""
    x = texts.withColumn("e", F.from_json("value", ENVELOPE, {"mode": "PERMISSIVE"}))
    doc = F.col("e.document")
    error = (
        F.when(doc.isNull(), "document").when(F.exists(F.coalesce(doc["chords"], F.array().cast(f"array<{struct_of(CHORD)}>")), lambda c: c["start"].isNull()), "chord start")
        .when(F.exists(F.coalesce(doc["lyrics"], F.array().cast(f"array<{struct_of(LINE)}>")), lambda c: c["text"].isNull()), "line text")
    )
    x = x.withColumn("error", error)
    return x.filter("error is null").select(key, F.col("e.document").alias("document")), x.filter("error is not null").select(key, "error")


def hundredths(seconds: Column) -> Column:
    """Hundredths of a number from 0 on, rounded as C's printf does: by the number's exact binary value, ties to the even one.

    The fraction is split into halves whose products by 100 are exact, so that the sign of what is above a half hundredth is right.
    """
    whole = F.floor(seconds)
    high = F.floor((seconds - whole) * (1 << 26)) / (1 << 26)
    down = F.floor(high * 100)
    above = (high * 100 - down - 0.5) + (seconds - whole - high) * 100
    return whole * 100 + down + F.when((above > 0) | ((above == 0) & (down % 2 == 1)), 1).otherwise(0)


def clock(seconds: Column) -> Column:
    """MM:SS.ss, empty for null."""
    n = hundredths(seconds - F.floor(seconds / 60) * 60)
    return F.when(seconds.isNull(), "").otherwise(F.format_string("%02d:%02d.%02d", F.floor(seconds / 60), F.floor(n / 100), n % 100))


def markdown(documents: DataFrame, key: str = KEY) -> DataFrame:
    """key, sheet: a document as Markdown: title, facts, a table of chords and the lyrics; parts that are empty are left out."""
    d = lambda f: F.col(f"document.{f}")
    time = clock
    title = F.coalesce(F.regexp_extract(d("audio.path"), r"([^/]*)$", 1), F.lit("Unknown title"))
    key_label = F.concat_ws(" ", d("key.tonic"), d("key.mode"))
    facts = F.concat_ws(" · ", F.when(d("key.tonic").isNotNull(), F.concat(F.lit("key "), key_label)), F.concat(F.lit("tempo "), F.bround(d("tempo.bpm"), 0).cast("bigint").cast("string"), F.lit(" BPM")), F.when(d("audio.duration").isNotNull(), F.concat(F.lit("duration "), time(d("audio.duration")))))
    row = lambda c: F.concat(F.lit("| "), time(c["start"]), F.lit(" | "), time(c["end"]), F.lit(" | "), F.coalesce(c["label"], F.lit("")), F.lit(" |"))
    stamp = lambda c: time(c["start"])
    line = lambda c: F.when(c["kind"] == "instrumental", F.concat(F.lit("**[instrumental"), F.when(c["start"].isNotNull(), F.concat(F.lit(" "), stamp(c))).otherwise(""), F.lit("]**"))).when(c["start"].isNotNull(), F.concat(F.lit("`"), stamp(c), F.lit("` — "), _fold(c["text"]))).otherwise(_fold(c["text"]))
    chords = F.when(F.size(d("chords")) > 0, F.concat(F.lit("## Chords\n\n| start | end | chord |\n| ----- | --- | ----- |\n"), F.array_join(F.transform(d("chords"), row), "\n"), F.lit("\n")))
    lyrics = F.when(F.size(d("lyrics")) > 0, F.concat(F.lit("## Lyrics\n\n"), F.array_join(F.transform(d("lyrics"), line), "\n"), F.lit("\n")))
    head = F.concat(F.lit("# "), title, F.when(facts != "", F.concat(F.lit("\n\n* "), facts)).otherwise(""), F.lit("\n"))
    return documents.select(key, F.concat_ws("\n", head, chords, lyrics).alias("sheet"))
