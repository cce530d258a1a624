"""Structured Streaming jobs over song timelines.

``window_summary`` also runs on tables, with the same result. ``seam_merge`` is the
stateful form of ``seams.merge_windows`` for songs whose windows arrive one after another.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cantus.operators.editing import CHORD_COLUMNS, CHORDS, TYPES, Session, chord_commands, plain_rows, relabelled
from cantus.operators.seams import SEAM_TOLERANCE
from cantus.operators.store import fresh
from cantus.operators.store import shared_dir
from cantus.operators.editing import TYPES, effective_chords
from cantus.sources.derived import read

MERGED = "song_id bigint, seq bigint, start double, end double, label string, source string"
#: Last window's number, what earlier ones covered, what all cover, and the event that can still grow.
COLUMNS = [c.split()[0] for c in CHORD_COLUMNS.split(", ")]
LAYER, COMMAND = COLUMNS[:-2], ["seq", "kind", *TYPES, "root", "quality", "keep", "refusal"]
#: Settings of a stream whose state is kept on the executors' disks, in bounded memory, and not in their heaps; changes alone are written after each batch.
ROCKS = "spark.sql.streaming.stateStore.rocksdb."
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{ROCKS}boundedMemoryUsage": "true", f"{ROCKS}maxMemoryUsageMB": "200", f"{ROCKS}changelogCheckpointing.enabled": "true",
}
STATE = "idx bigint, before double, reach double, seq bigint, start double, end double, label string, source string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; a pattern matches a file and a folder alike."""
    return spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def window_summary(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour", key: str = "label", time: str = "ts") -> DataFrame:
    """Events and the sum of value (null: none) of each window and key; tumbling without ``slide``. Events later than ``late`` go from a stream whose watermark has passed; rows without a time have no window."""
    w = F.window(time, length, slide or length)
    g = events.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def _merge_song(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    idx, before, reach, seq, start, end, label, source = state.get if state.exists else (-1, None, None, -1, None, None, None, None)
    rows = pd.concat(list(batches)).sort_values(["idx", "seq"])
    changed, fresh = {}, False
    for r in rows[["idx", "start", "end", "label", "source"]].itertuples(index=False):
        if r.idx < idx:
            continue  # a late window: later ones have gone on
        if r.idx > idx:
            idx, before, fresh = int(r.idx), reach, True
        r_end = None if pd.isna(r.end) else float(r.end)
        r_source = None if pd.isna(r.source) else r.source
        if before is not None and r.start < before:
            if r_end is None or r_end <= before:
                continue
        r_start = float(r.start) if before is None else max(float(r.start), before)
        if fresh and None not in (end, r_end) and (label, source) == (r.label, r_source) and end <= r_start <= end + SEAM_TOLERANCE:
            end = r_end
        else:
            seq, start, end, label, source = seq + 1, r_start, r_end, r.label, r_source
        fresh = False
        reach = reach if r_end is None else max(r_end, reach or 0.0)
        changed[seq] = (key[0], seq, start, end, label, source)
    state.update((idx, before, reach, seq, start, end, label, source))
    out = pd.DataFrame(list(changed.values()), columns=["song_id", "seq", "start", "end", "label", "source"])
    yield out.astype({"end": "float64", "start": "float64"})


def seam_merge(events: DataFrame) -> DataFrame:
    """One timeline per song from a stream of window events (song_id, idx, seq, start, end, label, source; seconds).

    State is one open event and what windows cover, whatever a song's length. Each batch emits the events it made or made
    longer: the last row of a (song_id, seq) is valid. A window arrives in order; a batch may end within one. Late windows are dropped.
    """
    x = events.select("song_id", "idx", "seq", "start", "end", "label", "source")
    return x.groupBy("song_id").applyInPandasWithState(_merge_song, MERGED, STATE, "update", GroupStateTimeout.NoTimeout)


def _play_song(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches))
    layer, cmds = (plain_rows(rows[rows["kind"].eq("base") == is_base]) for is_base in (True, False))
    session = Session.resumed(json.loads(zlib.decompress(state.get[0])), *CHORDS) if state.exists else Session([{c: x[c] for c in LAYER} for x in layer], *CHORDS)
    for c in cmds:
        session.run({k: c[k] for k in COMMAND})
    state.update((zlib.compress(json.dumps(session.state(), default=lambda v: v.item()).encode(), 1),))
    now = [[key[0], *(e.get(c) for c in COLUMNS), bool(cmds)] for e in session.events()] or [[key[0], *(None for _ in COLUMNS), bool(cmds)]]
    yield pd.DataFrame(now, columns=["song_id", *COLUMNS, "touched"], dtype=object)


def live_layers(stream: DataFrame) -> DataFrame:
    """Chord layers of the songs that each batch of a stream has rows of; ``touched`` if there are commands among them.

    The stream has song_id, seq and kind: rows of a song's layer (kind base, before its commands) and edit commands, with the fields of both. A song's state is
    its layer, what was done and undone, and why a command was refused: a batch costs what its commands cost, however long the tape is. An empty layer is one row without a start.
    """
    base = stream.filter("kind = 'base'").select("song_id", "kind", *LAYER)
    x = base.unionByName(chord_commands(stream.filter("kind <> 'base'"), "song_id"), allowMissingColumns=True)
    out = x.groupBy("song_id").applyInPandasWithState(_play_song, f"song_id bigint, {CHORD_COLUMNS}, touched boolean", "session binary", "update", GroupStateTimeout.NoTimeout)
    return out.withColumn("label", relabelled()).select("song_id", *LAYER, "touched")


def play_edits(commands: DataFrame, base: DataFrame) -> DataFrame:
    """Chord layers of the songs that a stream of edit commands touches, with ``batch``; see newest(). The layers of ``base`` (a table) are the first batch's first rows."""
    spark = base.sparkSession
    own = base.select("song_id", F.lit("base").alias("kind"), *LAYER)
    folder = fresh(spark, "layers")
    own.write.parquet(folder)
    fields = ["song_id", "seq", "kind", *TYPES]
    stream = commands.select(*fields).unionByName(spark.readStream.schema(own.schema).parquet(folder), allowMissingColumns=True)
    return drain(live_layers(stream), "update", on_disk=True).filter("touched").drop("touched")


def newest(layers: DataFrame, key: str = "song_id") -> DataFrame:
    """The layer of each song from the last batch that has it."""
    last = layers.groupBy(key).agg(F.max("batch").alias("batch"))
    return layers.join(last, [key, "batch"], "left_semi").drop("batch").filter("start is not null")


def _drain_to(folder: str, stream: DataFrame, mode: str, on_disk: bool = False) -> None:
    """Run a stream over all that is there. A batch that is run again replaces its own rows."""
    conf = stream.sparkSession.conf

    def keep(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={no}")

    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(keep)
    before = {k: conf.get(k, None) for k in ON_DISK} if on_disk else {}
    try:
        for k in before:
            conf.set(k, ON_DISK[k])
        query = writer.start()  # with the settings of now
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    query.awaitTermination()


def drain(stream: DataFrame, mode: str = "append", on_disk: bool = False) -> DataFrame:
    """Run a stream over all that is there and return what it emitted, with ``batch`` for the order. Results and checkpoint are in the shared folder; restarted batches replace their own rows. Large states want ``on_disk``."""
    folder = fresh(stream.sparkSession, "stream")
    _drain_to(folder, stream, mode, on_disk)
    return stream.sparkSession.read.parquet(f"{folder}/out")


def feed(parts: Iterable[DataFrame], job: Callable[[DataFrame], DataFrame], mode: str = "append", on_disk: bool = False) -> DataFrame:
    """What ``job`` emits, with ``batch``, where each part (a table; all have one schema) arrives when those before it have been worked on. State and watermark go on from part to part. Large states want ``on_disk``."""
    folder = None
    for k, part in enumerate(parts):
        spark = part.sparkSession
        folder = folder or fresh(spark, "feed")
        part.write.parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema(part.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        _drain_to(folder, job(stream), mode, on_disk)
    return spark.read.parquet(f"{folder}/out")


def latest(emitted: DataFrame, *key: str) -> DataFrame:
    """The last emitted row of each key."""
    rest = [c for c in emitted.columns if c not in key and c != "batch"]
    return emitted.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*key, "_r.*")
