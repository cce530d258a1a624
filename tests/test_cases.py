"""Case benchmark: families, alignment views, word times, filling and reports."""

import itertools
import random
import time

import numpy as np
import pytest

from cantus.operators import aligning as A
from cantus.operators import cases as CA
from cantus.operators import scoring as SC
from cantus.sources.corpus import CASES

LABELS = ["C", "Cm", "C7", "Am", "G", "N", "C/E", "Am7", "F#dim"]


def brute_align(ref, hyp, score, miss):
    """The recurrence cell by cell, and its traceback: pair first, then up."""
    n, m = len(ref), len(hyp)
    t = [[-(i + j) * 1.0 if not i or not j else 0.0 for j in range(m + 1)] for i in range(n + 1)]
    worth = lambda i, j: score(ref[i - 1], hyp[j - 1]) or miss
    for i, j in itertools.product(range(1, n + 1), range(1, m + 1)):
        t[i][j] = max(t[i - 1][j - 1] + worth(i, j), t[i - 1][j] - 1, t[i][j - 1] - 1)
    i, j, hits = n, m, 0
    while i and j:
        if t[i][j] == t[i - 1][j - 1] + worth(i, j):
            hits += score(ref[i - 1], hyp[j - 1]) > 0
            i, j = i - 1, j - 1
        elif t[i - 1][j] >= t[i][j - 1]:
            i -= 1
        else:
            j -= 1
    p, r = (hits / m if m else 0.0), (hits / n if n else 0.0)
    return 2 * p * r / (p + r) if p + r else (1.0 if not n and not m else 0.0)


def test_alignment_views_match_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.choices(LABELS, k=r.randint(0, 9)), r.choices(LABELS, k=r.randint(0, 9))) for i in range(40)] + [(90, [], []), (91, None, ["C"])]
    df = spark.createDataFrame(rows, "song_id bigint, ref array<string>, hyp array<string>")
    got = {x.song_id: x for x in SC.align_views(df).collect()}
    root = {"C": "C", "Cm": "C", "C7": "C", "Am": "A", "G": "G", "N": None, "C/E": "C", "Am7": "A", "F#dim": "F#"}
    quality = {"C": "major", "Cm": "minor", "C7": "7", "Am": "minor", "G": "major", "N": "no_chord", "C/E": "major", "Am7": "m7", "F#dim": "dim"}
    pairs = spark.createDataFrame([(a, b) for a in LABELS for b in LABELS], "ref_label string, hyp_label string")
    mirex = {(x.ref_label, x.hyp_label): x.score for x in SC.with_equality(pairs).collect()}
    for i, a, b in rows:
        a, b = a or [], b or []
        want = [
            brute_align(a, b, lambda x, y: float(x == y), -0.5), brute_align(a, b, lambda x, y: float(root[x] is not None and root[x] == root[y]), -0.5),
            brute_align(a, b, lambda x, y: float(quality[x] == quality[y]), -0.5), brute_align(a, b, lambda x, y: mirex[x, y], -1.0),
        ]
        assert [got[i].exact_f1, got[i].root_f1, got[i].quality_f1, got[i].mirex_f1] == pytest.approx(want), (i, a, b)


def test_word_times(spark):
    t = lambda *ws: [(w, float(s)) for w, s in ws]
    rows = [(1, t(("a", 0), ("b", 1), ("c", 2)), t(("a", 0.5), ("x", 1), ("c", 2.25))), (2, t(("a", 0)), t(("b", 0)))]
    df = spark.createDataFrame(rows, "song_id bigint, ref array<struct<text:string,start:double>>, hyp array<struct<text:string,start:double>>")
    got = {x.song_id: tuple(x)[1:] for x in SC.word_time_errors(df).collect()}
    assert got == {1: (0.375, 0.375, 2.0), 2: (None, None, 0.0)}


def test_same_pairs_are_those_of_the_traced_path():
    """Random words, of which some are as no other and some alike, with columns kept and made again; and two long sequences, which rows of numbers took over a minute for."""
    r = random.Random(5)
    for t in range(300):
        a, b = ([r.choice(["a", "b", "c", "d", None]) for _ in range(r.randint(0, 20))] for _ in range(2))
        alike = {x: r.sample("abcd", r.randint(0, 2)) for x in "abcd"} if t % 2 else {}
        same = lambda i, lo, hi: np.array([a[i] is not None and (a[i] == y or a[i] in alike.get(y, ())) for y in b[lo:hi]], bool)  # noqa: B023, E731
        want = SC.edit_pairs(len(a), len(b), same)
        assert A.same_pairs(a, b, alike) == A.same_pairs(a, b, alike, bits=20) == want
    long, began = [r.randrange(3000) for _ in range(30_000)], time.time()
    got = A.same_pairs(long, long[5:])
    assert got == [(i + 5, i) for i in range(len(long) - 5)] and time.time() - began < 30


def test_error_rates_match_brute_force(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(2)
    texts = [" ".join(r.choices(["la", "ñandú", "été", "word", "x"], k=r.randint(0, 8))) for _ in range(60)]
    df = spark.createDataFrame(list(zip(texts[::2], texts[1::2], strict=True)), "a string, b string")
    for x in df.select("a", "b", SC.word_error_rate(df["a"], df["b"]).alias("w"), SC.character_error_rate(df["a"], df["b"]).alias("c")).collect():
        ws = x.a.split()
        assert x.w == (pytest.approx(distance(ws, x.b.split()) / len(ws)) if ws else None)
        assert x.c == (pytest.approx(distance(x.a, x.b) / len(x.a)) if x.a else None)


def case(name, ref, hyp, **more):
    row = {"song": name, "engine": None, "engine_version": None, "model": None, "duration_seconds": 60.0, "processing_time_seconds": 6.0, "peak_memory_bytes": None, "audio": "x.wav", "reference": ref, "hypothesis": hyp}
    return {**row, **more, "name": name}


def side(**f):
    return {"lyrics_text": None, "lyrics_words": None, "chords": None, "chord_labels": None, "key": None, "tempo_bpm": None, **f}


def test_families_need_both_sides(spark):
    chords = [(0.0, 1.0, "C"), (1.0, 2.0, "G")]
    rows = [
        case("whole", side(lyrics_text="One, two", chords=chords, chord_labels=["C", "G"], key="C major", tempo_bpm=120.0), side(lyrics_text="one TWO three", chords=chords, chord_labels=["C", "G"], key="A minor", tempo_bpm=60.0)),
        case("found nothing", side(chords=chords, chord_labels=["C"], key="C major"), side(chords=[], chord_labels=[])),
        case("not declared", side(chords=chords, tempo_bpm=100.0), side(tempo_bpm=0.0)), case("empty reference", side(chords=[], chord_labels=[], lyrics_text="!"), side(chords=chords, chord_labels=["C"], lyrics_text="a")),
    ]
    df = spark.createDataFrame(rows, CASES + ", name string")
    got = {x.name: x for x in CA.score_cases(df).collect()}
    w = got["whole"]
    assert (w.lyrics_wer, w.chords_exact_f1, w.chords_segment_overlap, w.chords_change_detection_f1, w.chords_timing_error_median_seconds) == (0.5, 1.0, 1.0, 1.0, 0.0)
    assert (w.key_relation, w.key_weighted_score, w.key_exact, w.key_relative, w.tempo_interpretation, w.tempo_double_tempo_error, w.performance_real_time_factor) == ("relative", 0.3, 0.0, 1.0, "double", 0.0, 10.0)
    f = got["found nothing"]
    assert (f.chords_segment_overlap, f.chords_change_detection_recall, f.chords_exact_f1, f.chords_palette_f1, f.chords_timing_error_median_seconds, f.key_relation) == (0.0, 0.0, 0.0, 0.0, None, None)
    assert got["not declared"].chords_segment_overlap is None and got["not declared"].tempo_absolute_bpm_error is None
    assert got["empty reference"].chords_exact_f1 is None and got["empty reference"].lyrics_wer is None
    lines = [x.value for x in CA.markdown(CA.score_cases(df)).collect()]
    assert lines[0] == "# Benchmark" and any(x.startswith("| unknown | 4 |") for x in lines) and any(x.startswith("| whole | unknown | 60 | 0.5 |") for x in lines)


def test_long_chords_are_few_rows(spark):
    """Chords of ages: in buckets of a minute each would be more rows than an array holds."""
    chords = [(0.0, 1e12, "C"), (1e12, 2e12, "G"), (2e12, 2e12 + 1, "C")]
    df = spark.createDataFrame([case("long", side(chords=chords), side(chords=[(0.0, 5e11, "C"), (5e11, 2e12 + 1, "G")]))], CASES + ", name string")
    x = CA.chord_scores(df).collect()[0]
    assert x.chords_segment_overlap == pytest.approx(0.75) and x.chords_change_detection_precision == pytest.approx(2 / 3)


def test_a_report_computes_its_scores_once(spark):
    seen = spark.sparkContext.accumulator(0)
    df = CA.score_cases(spark.createDataFrame([case(str(i), side(key="C major"), side(key="C major")) for i in range(3)], CASES + ", name string"))

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    assert len(CA.markdown(df.mapInPandas(count, df.schema)).collect()) > 3 and seen.value == 3


def test_reports_and_filling(spark, tmp_path):
    df = spark.createDataFrame([case("a", side(key="C major"), side(key="G major")), case("b", side(), side(), audio=None)], CASES + ", name string")
    CA.write_reports(CA.score_cases(df), str(tmp_path))
    rows = spark.read.option("header", True).csv(f"{tmp_path}/benchmark.csv").collect()
    assert len(rows) == 2 and {x["song"] for x in rows} == {"a", "b"} and rows[0].asDict()["key.weighted_score"] in ("0.5", None)
    assert spark.read.json(f"{tmp_path}/benchmark.json").count() == 2
    out = spark.createDataFrame([("a", "e", "1", "chords", [(0.0, None, "C"), (1.0, None, "G")], None, 4.0, 2.0), ("b", "e", "1", "chords", [], None, 4.0, 2.0)], "name string, engine string, engine_version string, kind string, chords array<struct<start:double,end:double,label:string>>, key string, audio_seconds double, processing_time_seconds double")
    for c in ("tempo_bpm double", "lyrics_text string", "lyrics_words array<struct<text:string,start:double>>", "peak_memory_bytes bigint"):
        n, t = c.split(" ", 1)
        out = out.selectExpr("*", f"cast(null as {t}) as {n}")
    got = {x.name: x for x in CA.fill_hypotheses(df, out).collect()}
    assert [tuple(c) for c in got["a"].hypothesis.chords] == [(0.0, 1.0, "C"), (1.0, 4.0, "G")] and got["a"].hypothesis.key == "G major" and got["a"].engine == "e"
    assert (got["a"].duration_seconds, got["a"].processing_time_seconds) == (60.0, 2.0) and got["b"].engine is None and got["b"].hypothesis.chords is None


@pytest.mark.parametrize(("value", "text"), [(0.5, "0.5"), (1 / 3, "0.333333"), (1234567.0, "1.23457e+06"), (100.0, "100"), (0.0, "0"), (1e-5, "1e-05"), (123456.0, "123456"), (None, "")])
def test_numbers_in_reports(spark, value, text):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(CA.as_text("v", "double").alias("t")).collect()[0].t == text


def test_numbered_equals_one_window(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(3000)], "a int, b int")
    got = sorted(tuple(x) for x in SC.numbered(df, "a", "b").collect())
    assert [x[2] for x in got] == list(range(3000))
