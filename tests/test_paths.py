"""Alignment in linear memory and decoding in chunks: the same paths as whole tables give."""

import random
import resource

import numpy as np
import pytest

from cantus.operators import aligning as A
from cantus.operators import decoding as DE


def whole_table(n, m, pairs, gap):
    """Scores of all places, traced from the end: a pair wins ties, then an element of the first side."""
    best = np.zeros((n + 1, m + 1), np.int64)
    best[:, 0], best[0] = -gap * np.arange(n + 1), -gap * np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i, j] = max(best[i - 1, j - 1] + pairs[i - 1, j - 1], best[i - 1, j] - gap, best[i, j - 1] - gap)
    i, j, out = n, m, []
    while i or j:
        if i and j and best[i, j] == best[i - 1, j - 1] + pairs[i - 1, j - 1]:
            i, j, move = i - 1, j - 1, A.PAIR
        elif i and best[i, j] == best[i - 1, j] - gap:
            i, move = i - 1, A.UP
        else:
            j, move = j - 1, A.LEFT
        out.append(move)
    return out[::-1]


def test_paths_equal_those_of_the_whole_table():
    r = np.random.default_rng(3)
    for _ in range(10_000):
        n, m = r.integers(0, 14, 2)
        pairs, gap = r.integers(-3, 3, (n, m)), int(r.integers(1, 3))
        got = A.trace(n, m, lambda i, lo, hi: pairs[i, lo:hi], gap, cells=int(r.integers(1, 30)))
        assert got.tolist() == whole_table(n, m, pairs, gap)


def test_long_sequences_take_little_memory():
    """Two of 12,000: a table of bytes would be 144 MB."""
    r = np.random.default_rng(4)
    a, b = r.integers(0, 25, (2, 12_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    i, j = A.paired(A.trace(len(a), len(b), lambda k, lo, hi: np.where(b[lo:hi] == a[k], 1, -1), 1, cells=1 << 16))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 40_000 and (np.diff(i) > 0).all() and (np.diff(j) > 0).all()


def test_costs_become_whole_numbers():
    assert A.whole_numbers(1.0, -0.5, 1.0) == [2, -1, 2] and A.whole_numbers(0.3, 0.7) == [3, 7]


def plain_path(scores, penalty):
    """All steps of one song after another, in whole units."""
    e, cost = np.round(np.array(scores) * DE.UNITS).astype(np.int64), round(penalty * DE.UNITS)
    cur, back = e[0], []
    for row in e[1:]:
        top = int(cur.argmax())
        stay = cur >= cur[top] - cost
        back.append(np.where(stay, np.arange(len(cur)), top))
        cur = np.where(stay, cur, cur[top] - cost) + row
    path = [int(cur.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize(("chunk", "fan"), [(7, 2), (50, 64), (1000, 64)])
def test_chunks_give_the_path_of_the_whole_song(spark, chunk, fan):
    """100 songs, many with ties; frame numbers have gaps, and one song has one frame."""
    r, rows, want = random.Random(8), [], {}
    for song in range(100):
        n = 1 if song == 0 else r.randint(2, 90)
        numbers = sorted(r.sample(range(200), n))
        scores = [[r.choice([0.0, 0.1, 0.5, 0.9, 1.0]) if song % 2 else r.random() for _ in range(5)] for _ in range(n)]
        rows += [(song, i, s) for i, s in zip(numbers, scores, strict=True)]
        want[song] = list(zip(numbers, plain_path(scores, 0.4), strict=True))
    r.shuffle(rows)
    frames = spark.createDataFrame(rows, "song_id bigint, frame_no bigint, scores array<double>").repartition(3)
    got = {}
    for x in DE.decode_frames(frames, chunk=chunk, fan=fan).orderBy("song_id", "frame_no").collect():
        got.setdefault(x.song_id, []).append((x.frame_no, x.state))
    assert got == want
    assert DE.decode_frames(frames.limit(0)).count() == 0
