"""Decoding of frames into a best path of states, in chunks.

The best path needs all frames of a song in order, but not in one task. A chunk of frames is a table of
states by states: what the best path from each state before it to each state at its end gains. Such tables are composed by
(max, +), which is associative, so a scan over the chunks (in groups, and groups of groups) gives the scores that each chunk starts from. With
them a chunk says from which state before it each of its last states came; these maps compose as well, in a scan from
the end, which gives the state that each chunk ends in. Then each chunk traces its own path. Scores are whole numbers of
units of 2**-30, so that sums are exact and the path is the same for every size of chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantus.operators.store import written
from cantus.operators.timeline import KEY

#: Units of a score of 1, frames of a chunk, and units or groups that one task of a scan composes.
UNITS, CHUNK, FAN = 1 << 30, 2_000, 64
NEVER = -(1 << 61)


def step(cur: np.ndarray, scores: np.ndarray, penalty: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One frame on: new scores of the states (last axis), which of them stayed, and the best state before, from which the others came. Staying wins ties, then the lowest state."""
    top = cur.argmax(-1)
    best = np.take_along_axis(cur, top[..., None], -1) - penalty
    stay = cur >= best
    return np.where(stay, cur, best) + scores, stay, top


def gain(scores: np.ndarray, penalty: int) -> np.ndarray:
    """States before the frames by states at their end: what the best path between the two gains."""
    n = scores.shape[1]
    cur = np.full((n, n), NEVER, np.int64)
    np.fill_diagonal(cur, 0)
    for row in scores:
        cur, _, _ = step(cur, row, penalty)
    return cur


def traced(scores: np.ndarray, entry: np.ndarray, penalty: int) -> tuple[np.ndarray, np.ndarray]:
    """For each frame and state the state before it on its best path, and the scores at the end; ``entry`` are those before the first frame."""
    cur, own = entry, np.arange(scores.shape[1])
    back = np.zeros(scores.shape, np.int32)
    for i, row in enumerate(scores):
        cur, stay, top = step(cur, row, penalty)
        back[i] = np.where(stay, own, top)
    return back, cur


def followed(back: np.ndarray, states: np.ndarray) -> np.ndarray:
    """States before the first frame on the paths that end in ``states``."""
    for row in back[::-1]:
        states = row[states]
    return states


def scan(units: DataFrame, most: int, start: list[int], combine: Callable, advance: Callable, key: str = KEY, fan: int = FAN) -> DataFrame:
    """key, idx, state: the state before each unit (key, idx from 0, unit) of a song, where the first one has ``start``.

    ``most`` is the highest idx. ``advance(state, unit)`` is the state after a unit; ``combine(a, b)`` is the unit that does what a and then b do. No task holds
    more than ``fan`` units: groups are combined, and groups of groups, until a song's fit one task; then states go down again.
    """
    song = units.schema[key].dataType.simpleString()

    def whole(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        units = iter(pdf.sort_values("idx")["unit"])
        out = next(units)
        for u in units:
            out = combine(out, u)
        return pd.DataFrame({key: [keys[0]], "idx": [keys[1]], "unit": [out]})

    def walk(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        state = np.array(start if pdf["state"].iloc[0] is None else pdf["state"].iloc[0], np.int64)
        states = []
        for u in pdf["unit"]:
            states.append(state)
            state = advance(state, u)
        return pd.DataFrame({key: pdf[key], "idx": pdf["idx"], "state": states})

    group = F.floor(F.col("idx") / fan)
    levels = [units]
    while most >= fan:
        levels.append(levels[-1].groupBy(key, group.alias("_g")).applyInPandas(whole, f"{key} {song}, idx bigint, unit array<bigint>"))
        most //= fan
    found = f"{key} {song}, idx bigint, state array<bigint>"
    out = levels[-1].withColumn("state", F.lit(None).cast("array<bigint>")).groupBy(key, F.lit(0).alias("_g")).applyInPandas(walk, found)
    for level in reversed(levels[:-1]):
        given = level.withColumn("_g", group).join(out.select(key, F.col("idx").alias("_g"), "state"), [key, "_g"])
        out = given.groupBy(key, "_g").applyInPandas(walk, found)
    return out


def _mapped(df: DataFrame, work: Callable[[pd.Series], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of ``work`` for each chunk."""
    names = [c.split()[0] for c in schema.split(", ")]

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame(work(row), columns=names)

    return df.mapInPandas(batches, schema)


def decode_frames(frames: DataFrame, penalty: float = 0.4, key: str = KEY, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Best state of each frame of a song, where a change of state costs ``penalty``: key, frame_no, state.

    ``frames`` has key, frame_no (whole numbers, each once) and scores (array, as long in all frames; not null). Staying wins ties, then the lowest
    state. A task holds ``chunk`` frame numbers of a song, or ``fan`` chunks' tables of states by states, and not a song. An empty table gives an empty one.
    """
    song, number = frames.schema[key].dataType.simpleString(), frames.schema["frame_no"].dataType.simpleString()
    cost = round(penalty * UNITS)
    units = F.transform("scores", lambda s: F.round(s * UNITS).cast("bigint"))
    x = frames.select(key, F.floor(F.col("frame_no") / chunk).alias("c"), F.struct("frame_no", units.alias("s")).alias("f"))
    x = x.groupBy(key, "c").agg(F.array_sort(F.collect_list("f")).alias("f"))
    me = Window.partitionBy(key)  # a row a chunk
    x = x.withColumn("idx", F.row_number().over(me.orderBy("c")).cast("bigint") - 1).withColumn("last", F.count("*").over(me) - 1)
    chunks = written(x.select(key, "idx", "last", F.col("f.frame_no").alias("frame_no"), F.col("f.s").alias("s")))
    width, most = chunks.agg(F.max(F.size(F.get("s", F.lit(0)))), F.max("last")).collect()[0]  # two numbers
    if width is None:
        return frames.select(key, "frame_no", F.lit(None).cast("int").alias("state"))
    begin = [0] * width
    matrix = lambda s: np.stack(list(s)).astype(np.int64)
    square = lambda u: np.asarray(u, np.int64).reshape(width, width)
    unit = f"{key} {song}, idx bigint, unit array<bigint>"

    # the last chunk's gain is followed by nothing: a unit that changes nothing stands for it
    still = np.where(np.eye(width, dtype=bool), 0, NEVER).ravel()
    plus = lambda a, b: (square(a)[:, :, None] + square(b)[None, :, :]).max(1).ravel()

    def came(r) -> list[tuple]:
        back, end = traced(matrix(r.s), np.asarray(r.state, np.int64), cost)
        states = followed(back, np.arange(width))
        # the song's path ends in the best state, wherever one looks from
        return [(getattr(r, key), r.last - r.idx, np.full(width, states[end.argmax()]) if r.idx == r.last else states)]

    def path(r) -> list[tuple]:
        back, end = traced(matrix(r.s), np.asarray(r.state, np.int64), cost)
        states = np.zeros(len(back), int)
        states[-1] = end.argmax() if r.idx == r.last else r.exit[0]
        for i in range(len(back) - 1, 0, -1):
            states[i - 1] = back[i, states[i]]
        return list(zip([getattr(r, key)] * len(back), r.frame_no, states, strict=True))

    if most:
        gains = _mapped(chunks, lambda r: [(getattr(r, key), r.idx, still if r.idx == r.last else gain(matrix(r.s), cost).ravel())], unit)
        entries = scan(written(gains), most, begin, plus, lambda v, u: (v[:, None] + square(u)).max(0), key, fan)
        begun = written(chunks.join(entries, [key, "idx"]))
        exits = scan(written(_mapped(begun, came, unit)), most, [0], lambda a, b: np.asarray(b)[np.asarray(a)], lambda v, u: np.asarray(u)[v], key, fan)
        ended = begun.withColumn("_back", F.col("last") - F.col("idx")).join(exits.select(key, F.col("idx").alias("_back"), F.col("state").alias("exit")), [key, "_back"])
    else:  # songs of one chunk begin and end by themselves
        ended = chunks.withColumn("state", F.array(*map(F.lit, begin))).withColumn("exit", F.array(F.lit(0)))
    return _mapped(ended, path, f"{key} {song}, frame_no {number}, state int")
