"""Placement of chords and words, change points, chart alignment: small cases and brute force."""

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cantus.functions import words as W
from cantus.operators import placement as P

LINES = "song_id int, seq int, start double, end double"
EVENTS = LINES + ", label string"


def test_words_and_lines(spark):
    lines = spark.createDataFrame([(1, 0, 1.0, 3.0), (1, 1, 5.0, None)], LINES)
    words = spark.createDataFrame([(1, 0, 0, 1.0, 1.5), (1, 0, 1, 2.0, None), (1, 1, 0, 5.0, None), (1, 1, 1, 6.0, None), (1, 1, 2, None, None)], "song_id int, line int, seq int, start double, end double")
    probes = spark.createDataFrame([(1, t) for t in (0.5, 1.2, 1.7, 2.9, 3.0, 5.5, 9.0)], "song_id int, t double")
    got = {r.t: (r.line, r.word) for r in P.words_at(probes, lines, words).collect()}
    assert got == {0.5: (None, None), 1.2: (0, 0), 1.7: (0, None), 2.9: (0, 1), 3.0: (None, None), 5.5: (1, 0), 9.0: (1, 1)}


def test_owning_lines_and_gap_rows(spark):
    lines = spark.createDataFrame([(1, 7, 4.0, 6.0), (1, 8, 20.0, 30.0)], LINES)
    events = [(1, 0, 0.0, 1.0, "C"), (1, 1, 1.0, 5.0, "F"), (1, 2, 5.0, 7.0, "G")] + [(1, 3 + i, 7.0 + i, 8.0 + i, "Am") for i in range(10)] + [(2, 0, 0.0, 1.0, "C")]
    owned = P.owning_lines(spark.createDataFrame(events, EVENTS), lines)
    got = {(r.song_id, r.seq): (r.line, r.before) for r in owned.collect()}
    assert [got[1, i] for i in range(4)] == [(None, 0), (7, 0), (7, 1), (None, 1)] and got[2, 0] == (None, 0)
    rows = {(r.song_id, r.seq): r for r in P.gap_rows(owned.filter("line is null"), 1.0).collect()}
    assert rows[1, 3].row == 0 and rows[1, 10].row == 0 and rows[1, 11].row == 1
    assert (rows[1, 3].row_start, rows[1, 3].row_end, rows[1, 3].width) == (7.0, 15.0, 38)
    assert [rows[1, 3 + i].column for i in range(8)] == [round(i / 8 * 37) for i in range(8)]
    assert rows[1, 0].width == 24 and rows[1, 0].row_end == 1.0


def test_spread_words_keep_given_times(spark):
    rows = [(1, 0, "a b", 0.0, None, None), (1, 1, "c d", 2.0, 3.0, [("C", 2.1, 2.2), ("D", 2.3, 2.4)]), (1, 2, "e", 9.0, 1.0, [("e", 9.0, None)]), (1, 3, " ", 10.0, 11.0, None), (1, 4, "x", None, None, None)]
    df = spark.createDataFrame(rows, "song_id int, seq int, text string, start double, end double, words array<struct<text:string,start:double,end:double>>")
    got = sorted((r.line, r.word_no, r.text, round(r.start, 3), round(r.end, 3)) for r in P.spread_words(df).collect())
    assert got == [(0, 0, "a", 0.0, 1.0), (0, 1, "b", 1.0, 2.0), (1, 0, "C", 2.1, 2.2), (1, 1, "D", 2.3, 2.4), (2, 0, "e", 9.0, 10.0)]


def test_greedy_hits_are_the_most_possible():
    rng = random.Random(5)
    for _ in range(200):
        a, b = (sorted(rng.sample(range(12), rng.randint(0, 5))) for _ in range(2))
        best = max((sum(abs(x - y) <= 1 for x, y in zip(p, q)) for p in itertools.permutations(a) for q in itertools.combinations(b, min(len(a), len(b)))), default=0)
        assert P._hits(a, b, 1) == best


def test_change_points_of_an_empty_side(spark):
    a = spark.createDataFrame([(1, 0, 0.0, 1.0, "C"), (1, 1, 1.0, 2.0, "G"), (2, 0, 0.0, 1.0, "C")], EVENTS)
    b = spark.createDataFrame([(1, 0, 0.4, 1.2, "C")], EVENTS)
    got = {r.song_id: (r.change_precision, round(r.change_recall, 4)) for r in P.change_points(a, b, 0.5).collect()}
    assert got == {1: (1.0, 0.6667), 2: (0.0, 0.0)}
    full = {r.song_id: r for r in P.take_scores(a, b, 1.0, 0.5).collect()}
    assert full[1].reference_chords == 2 and full[2].hypothesis_segments == 0 and full[1].csr == 0.75 and full[2].csr_triads == 0


def test_alignment_is_cheapest_and_whole(spark):
    rng = random.Random(3)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(100):
        a, b = ([rng.choice("CFG") for _ in range(rng.randint(0, 6))] for _ in range(2))
        ops = P.edit_ops(a, b, 1.0, 1.0)
        assert sum(k != "match" for k, _, _ in ops) == distance(a, b)
        assert [i for _, i, _ in ops if i is not None] == list(range(len(a))) and [j for _, _, j in ops if j is not None] == list(range(len(b)))
    song = lambda labels, s: [(s, i, x) for i, x in enumerate(labels)]
    ref = spark.createDataFrame(song(["C", "Am7", "G7"], 1) + song(["F"], 2), "song_id int, seq int, label string")
    hyp = spark.createDataFrame(song(["Cmaj7", "Am", "F", "G"], 1), "song_id int, seq int, label string")
    ops = P.align_charts(ref, hyp).orderBy("song_id", "step").collect()
    assert [(r.kind, r.reference_label, r.hypothesis_label) for r in ops] == [("match", "C", "Cmaj7"), ("match", "Am7", "Am"), ("extra", None, "F"), ("match", "G7", "G"), ("missing", "F", None)]
    got = {r.song_id: (r.matches, r.extra, r.precision, r.recall) for r in P.chart_agreement(P.align_charts(ref, hyp)).collect()}
    assert got == {1: (3, 1, 0.75, 1.0), 2: (0, 0, 0.0, 0.0)}


def test_folding_and_fuzzy_words(spark):
    df = spark.createDataFrame([("Ça-va!",), ("ﬁn",), ("",), (None,)], "w string")
    assert [r[0] for r in df.select(W.folded("w")).collect()] == ["cava", "fin", "", None]
    assert df.select(W.normalize_transcript(F.col("w"))).first()[0] == "ça va"
    words = ["friend", "frend", "de", "da", "", None, "satisfacer", "satisfascer"]
    pairs = spark.createDataFrame(list(itertools.product(words, words)), "a string, b string")
    for r in W.same_word(pairs, "a", "b").collect():
        a, b = r.a or "", r.b or ""
        want = bool(a and b) and (a == b or (min(len(a), len(b)) >= 5 and SequenceMatcher(None, a, b).ratio() >= 0.8))
        assert r.same == want


@pytest.mark.parametrize("trim", [False, True])
def test_islands_match_as_the_whole_song_does(spark, trim):
    """Against the greedy matching of all points of a song; random points, many exactly ``window`` apart."""

    import numpy as np

    r, window, rows = random.Random(1), 3, {}
    for song in range(300):
        rows[song] = [sorted({r.randrange(0, r.choice([20, 60, 400])) for _ in range(r.randint(1, 12))}) for _ in range(2)]
    df = lambda side: spark.createDataFrame([(k, t, t, i) for k, x in rows.items() for i, t in enumerate(x[side])], "song_id bigint, start bigint, end bigint, seq bigint")
    got = {x.song_id: tuple(x)[1:] for x in P.change_points(df(0), df(1), window, None, trim).collect()}
    for k, x in rows.items():
        a, b = (np.array(p[1:-1] if trim else p) for p in x)
        n = P._hits(a, b, window)
        p, c = (n / len(y) if len(y) and n else 0.0 for y in (b, a))
        assert got[k] == pytest.approx((p, c, 2 * p * c / (p + c) if n else 0.0)), (k, a, b)
