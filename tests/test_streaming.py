"""Streams give what the batch operators give."""

from pathlib import Path

from pyspark.sql import functions as F

from cantus.operators import editing as ED
from cantus.operators import seams as W
from cantus.streaming import jobs as J

EVENT = "song_id bigint, idx bigint, seq bigint, start double, end double, label string, source string"


def test_seams_as_stream(spark, tmp_path):
    rows = []
    for song in range(3):
        for idx in range(6):
            for i in range(4):
                start = idx * 8.0 + i * 3.0
                end = None if (song, idx, i) == (2, 5, 3) else start + 3.0
                rows.append((song, idx, i, start, end, "CG"[(idx * 8 + i * 3) // 5 % 2], None if song == 1 else "s"))
    want = [tuple(r) for r in W.merge_windows(spark.createDataFrame(rows, EVENT)).select("song_id", F.col("seq").cast("bigint"), "start", "end", "label", "source").orderBy("song_id", "seq").collect()]
    for idx in range(6):
        spark.createDataFrame([r for r in rows if r[1] == idx], EVENT).coalesce(1).write.parquet(str(tmp_path / f"in/{idx}"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = [tuple(r) for r in J.latest(J.drain(J.seam_merge(stream), "update"), "song_id", "seq").orderBy("song_id", "seq").collect()]
    assert got == want


def test_window_summary_stream_is_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{i % 5}:00:00", "ab"[i % 2], float(i)) for i in range(20)] + [(None, "a", 1.0)]
    table = spark.createDataFrame(rows, "ts string, label string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    both = [J.window_summary(table, "2 hours", "1 hour"), J.latest(J.drain(J.window_summary(stream, "2 hours", "1 hour"), "update"), "start", "end", "label")]
    a, b = ([tuple(r) for r in x.select("start", "end", "label", "n", "total").orderBy("start", "label").collect()] for x in both)
    assert a == b and len(a) == 12


def test_edits_as_a_stream_equal_the_tape(spark, tmp_path):
    from cantus.operators import editing as ED
    from cantus.streaming import jobs

    kinds = ", ".join(f"`{k}` {t}" for k, t in ED.TYPES.items())
    schema = f"song_id bigint, seq bigint, kind string, {kinds}"
    row = lambda song, seq, **c: {"song_id": song, "seq": seq, **dict.fromkeys(ED.TYPES), **c}
    cmds = [[row(1, 0, kind="transpose", semitones=2), row(2, 0, kind="simplify")], [row(1, 1, kind="delete", start=0.0)], [row(1, 2, kind="undo")]]
    for i, part in enumerate(cmds):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    base = spark.createDataFrame([(s, 0, 0.0, 1.0, "C", "m7", None, "Cm7", 0.5, "e") for s in (1, 2, 3)], "song_id bigint, seq bigint, start double, end double, root string, quality string, bass string, label string, confidence double, source string")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = sorted((x.song_id, x.label) for x in jobs.newest(jobs.play_edits(stream, base)).collect())
    assert got == [(1, "Dm7"), (2, "Cm")]


def test_live_layers_equal_the_tape_after_each_batch(spark, tmp_path):
    """Random tapes with undo, redo and refused commands, in four batches."""
    import random

    from cantus.operators import editing as ED

    r, songs, batches = random.Random(5), range(12), 4
    base = [(s, i, float(i), i + 1.0, r.choice("CA"), r.choice(["major", "m7", "no_chord"]), None, "x", 0.5, "e") for s in songs for i in range(r.randint(1, 4))]
    base = spark.createDataFrame(base, "song_id bigint, seq bigint, start double, end double, root string, quality string, bass string, label string, confidence double, source string")
    schema = "song_id bigint, seq bigint, kind string, " + ", ".join(f"`{k}` {t}" for k, t in ED.TYPES.items())

    def command():
        kind = r.choice(["transpose", "simplify", "delete", "split", "undo", "undo", "redo", "set-label", "insert"])
        at = float(r.randrange(5))
        return {"kind": kind} | {"transpose": {"semitones": r.choice([1, 2, 12])}, "delete": {"start": at}, "split": {"start": at, "at": at + 0.5}, "set-label": {"start": at, "label": r.choice(["G7", "C/E"])}, "insert": {"at": at, "label": "Am", "end": at + 1}}.get(kind, {})

    rows = [[{"song_id": s, "seq": 10 * b + i, **dict.fromkeys(ED.TYPES), **command()} for s in songs if r.random() < 0.7 for i in range(r.randint(1, 3))] for b in range(batches)]
    for b, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{b}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    played = J.play_edits(stream, base).cache()
    seen = lambda df: sorted(str(tuple(x)) for x in df.select("song_id", "seq", "start", "end", "label", "source").collect())
    for b in range(batches):
        tape = spark.createDataFrame([c for part in rows[: b + 1] for c in part], schema)
        whole, _ = ED.effective_chords(base.join(tape.select("song_id").distinct(), "song_id", "left_semi"), tape)
        assert seen(J.newest(played.filter(f"batch <= {b}"))) == seen(whole)


def test_a_fed_stream_keeps_its_watermark(spark):
    """A row behind the watermark of an earlier part is dropped; the same row in the first part is not."""
    part = lambda *hours: spark.createDataFrame([(f"2024-01-01 {h:02}:10:00", "a", 1.0) for h in hours], "ts string, label string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = lambda *parts: sorted((x.start.hour, x.n) for x in J.latest(J.feed(parts, lambda s: J.window_summary(s, "1 hour", late="2 hours"), "update"), "start", "end", "label").collect())
    assert counts(part(1, 9), part(1, 8)) == [(1, 1), (8, 1), (9, 1)]
    assert counts(part(1, 1, 9), part(8)) == [(1, 2), (8, 1), (9, 1)]


def test_large_states_are_on_disk(spark):
    """The state store of edited layers is RocksDB, not the executors' heaps; the session's own settings are as before."""
    rows = spark.createDataFrame([(1, "base", 0, 0.0, "C", None), (1, "transpose", 0, None, None, 2)], "song_id bigint, kind string, seq bigint, start double, label string, semitones bigint")
    rows = rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in ED.TYPES.items() if c not in rows.columns), *(F.lit(None).cast(t).alias(c) for c, t in (c.split() for c in ED.CHORD_COLUMNS.split(", ")) if c not in (*rows.columns, *ED.TYPES)))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    out = J.feed([rows.filter("kind = 'base'"), rows.filter("kind <> 'base'")], J.live_layers, "update", on_disk=True)
    assert out.count() == 2 and spark.conf.get(store) == before
    folder = out.inputFiles()[0].removeprefix("file://").rsplit("/out/", 1)[0]
    assert list(Path(folder).glob("state/state/0/*/*.changelog")) and not list(Path(folder).glob("state/state/0/*/*.delta"))
