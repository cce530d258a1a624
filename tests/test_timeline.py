"""Small hand cases of the timeline operators."""

import pytest
from pyspark.sql import functions as F

from cantus.functions import labels as L
from cantus.functions import scalars as S
from cantus.operators import decoding as DE
from cantus.operators import frames as FR
from cantus.operators import scoring as SC
from cantus.operators import timeline as TL

COLS = "song_id int, seq int, start double, end double, label string"


def table(spark, rows):
    return spark.createDataFrame(rows, COLS)


def values(spark, exprs, rows, schema):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def test_parse_and_render(spark):
    cases = ["C", "bb", "C#m7/E", "N.C.", "nc", "F#o", "CM7", "Cm7", "CMAJ7", "C13", "C/5", "H", "", "E♭m"]
    got = values(spark, [L.parse(F.col("x")).alias("p")], [(c,) for c in cases], "x string")
    parts = [(p[0].root, p[0].quality, p[0].bass) for p in got]
    assert parts == [
        ("C", "major", None), ("A#", "major", None), ("C#", "m7", "E"), (None, "unknown", None), (None, "no_chord", None), ("F#", "dim", None), ("C", "maj7", None),
        ("C", "m7", None), ("C", "maj7", None), ("C", "other", None), ("C", "other", None), (None, "unknown", None), (None, "unknown", None), ("D#", "minor", None),
    ]


def test_transpose_keeps_what_it_does_not_know(spark):
    rows = [("C#m7/E", 2), ("C13", 2), ("nc", 1), ("B", 1), ("zz", 3)]
    assert [r[0] for r in values(spark, [L.transpose(F.col("x"), F.col("n"))], rows, "x string, n int")] == ["D#m7/F#", "C13", "N", "C", "zz"]


def test_colon_labels(spark):
    rows = [("Bb:min7",), ("F#:7/5",), ("N",), ("Db",), ("C:maj/Eb",), ("",)]
    assert [r[0] for r in values(spark, [L.from_colon(F.col("x"))], rows, "x string")] == ["A#m7", "F#7/5", "N", "C#", "C/D#", "N"]


def test_pitch_classes_with_brackets(spark):
    rows = [("D(1,5)",), ("Cmin7(*5)",), ("Bdim7",), ("N",), ("C13",), ("Em/1",)]
    assert [sorted(r[0]) for r in values(spark, [L.pitch_classes(F.col("x"))], rows, "x string")] == [[2, 9], [0], [2, 5, 8, 11], [], [0, 2, 4, 7, 9, 10], [4, 7, 11]]


def test_equality_rules(spark):
    rows = [("C", "C"), ("C", "Am"), ("Cdim", "Cm"), ("N", "N"), ("N", "C"), ("C/E", "C/E"), ("C/E", "Em")]
    got = {(r.ref_label, r.hyp_label): r.score for r in L.with_equality(spark.createDataFrame(rows, "ref_label string, hyp_label string")).collect()}
    assert got == {("C", "C"): 1, ("C", "Am"): 0, ("Cdim", "Cm"): 1, ("N", "N"): 1, ("N", "C"): 0, ("C/E", "C/E"): 3, ("C/E", "Em"): 2}


def test_two_triad_views_differ(spark):
    rows = [("Am7",), ("Am",), ("D7/F#",), ("N",)]
    assert values(spark, [L.triad_scoring(F.col("x")), L.triad_chart(F.col("x"))], rows, "x string") == [("A", "Am"), ("Am", "Am"), ("D", "D"), ("N", "N")]


def test_spelling(spark):
    rows = [("A#m7/D#", "A#", "major"), ("C#", "C#", "minor"), ("N", "F", "major")]
    got = values(spark, [L.spell_label(F.col("x"), L.prefers_flats(F.col("t"), F.col("m"))), L.spell_key(F.col("t"), F.col("m"))], rows, "x string, t string, m string")
    assert got == [("Bbm7/Eb", "Bb major"), ("C#", "C# minor"), ("N", "F major")]


def test_times(spark):
    rows = [(3661.5,), (None,), (59.9996,)]
    assert [r[0] for r in values(spark, [S.format_timestamp(F.col("x"))], rows, "x double")] == ["01:01:01.500", "unknown", "00:01:00.000"]
    assert [r[0] for r in values(spark, [S.parse_timestamp(F.col("x"))], [("1:02.5",), ("a",), ("1:2:3",)], "x string")] == [62.5, None, 3723.0]


def test_key_relations(spark):
    rows = [("C major", "G major"), ("C major", "A minor"), ("A minor", "C major"), ("C major", "C minor"), ("C major", "unknown"), ("Db major", "C# major")]
    assert [r[0] for r in values(spark, [S.key_relation(F.col("a"), F.col("b"))], rows, "a string, b string")] == ["fifth", "relative", "relative", "parallel", "unknown", "exact"]


def test_last_started_and_last_covering_differ(spark):
    events = table(spark, [(1, 0, 0.0, 10.0, "C"), (1, 1, 2.0, 3.0, "D")])
    probes = spark.createDataFrame([(1, 7, 5.0), (1, 8, 2.0), (1, 9, 11.0)], "song_id int, probe_id int, t double")
    as_of = {r.probe_id: r.event.label if r.event else None for r in TL.as_of(probes, events).collect()}
    cover = {r.probe_id: r.label for r in TL.covering(probes, events, 4.0).collect()}
    assert as_of == {7: None, 8: "D", 9: None}
    assert cover == {7: "C", 8: "D", 9: None}


@pytest.mark.parametrize("width", [0.7, 3.0, 100.0])
def test_overlap_join_counts_a_pair_once(spark, width):
    a = table(spark, [(1, 0, 0.0, 5.0, "C"), (1, 1, 5.0, 9.0, "D"), (2, 0, 0.0, 1.0, "E")])
    b = table(spark, [(1, 0, 1.0, 6.0, "C"), (1, 1, 6.0, 20.0, "D")])
    got = sorted((r.l_seq, r.r_seq, r.overlap) for r in TL.overlap_join(a, b, width).collect())
    assert got == [(0, 0, 4.0), (1, 0, 1.0), (1, 1, 3.0)]


def test_short_segments_join_their_neighbours(spark):
    x = table(spark, [(1, 0, 0.0, 0.2, "A"), (1, 1, 0.2, 0.4, "B"), (1, 2, 0.4, 2.0, "C"), (1, 3, 2.0, 2.1, "D"), (1, 4, 2.1, 4.0, "C"), (2, 0, 0.0, 0.1, "A"), (2, 1, 0.1, 0.2, "B")])
    got = sorted((r.song_id, r.start, r.end, r.label) for r in TL.merge_short(x, 0.5).collect())
    assert got == [(1, 0.0, 4.0, "C"), (2, 0.0, 0.2, "B")]


def test_windows_end_where_nothing_is_added(spark):
    t = spark.createDataFrame([(1, 65.0), (2, 30.0), (3, 0.0)], "song_id int, duration double")
    got = sorted((r.song_id, r.idx, r.start, r.end) for r in TL.plan_windows(t, 30.0, 5.0).collect())
    assert got == [(1, 0, 0.0, 30.0), (1, 1, 25.0, 55.0), (1, 2, 50.0, 65.0), (2, 0, 0.0, 30.0)]
    with pytest.raises(ValueError):
        TL.plan_windows(t, 5.0, 5.0)


def test_alignment_and_errors(spark):
    assert SC.align(*SC.coded(["C", "D", "E"], ["C", "E"]))[:4] == (2.0, 1.0, 2 / 3, 0.8)
    assert SC.align(*SC.coded([], []))[1:4] == (1.0, 1.0, 1.0)
    rows = [("a b c", "a c"), ("a b", "a b c d"), ("", "a")]
    assert [r[0] for r in values(spark, [SC.word_error_rate(F.col("a"), F.col("b"))], rows, "a string, b string")] == [1 / 3, 1.0, None]


def test_decoding_stays_when_a_change_costs_more(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [0.4, 0.6]), (1, 2, [1.0, 0.0]), (1, 3, [0.0, 1.0]), (1, 4, [0.0, 1.0])]
    got = [r.state for r in DE.decode_frames(spark.createDataFrame(rows, "song_id int, frame_no int, scores array<double>")).orderBy("frame_no").collect()]
    assert got == [0, 0, 0, 1, 1]


def test_key_of_a_c_major_scale(spark):
    rows = [(1, 0, [1.0, 0.0, 0.5, 0.0, 0.8, 0.5, 0.0, 0.9, 0.0, 0.4, 0.0, 0.3]), (2, 0, [0.0] * 12)]
    got = {r.song_id: (r.tonic, r["mode"]) for r in FR.key_of(spark.createDataFrame(rows, "song_id int, frame_no int, chroma array<double>")).collect()}
    assert got == {1: ("C", "major"), 2: (None, None)}


def test_logistic_fit_finds_the_curve(spark):
    import math

    rows = [(m / 10, 10.0, 10.0 / (1 + math.exp(-(3 * m / 10 - 1)))) for m in range(-20, 21)]
    a, b, rounds = SC.fit_logistic(spark.createDataFrame(rows, "margin double, seconds double, correct_seconds double"))
    assert abs(a - 3) < 1e-6 and abs(b + 1) < 1e-6 and rounds < 30


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_buckets_change_no_as_of_join_and_no_end(spark, width):
    """A hot song with a third of the rows, ties, probes before all events, and buckets without events."""
    import random

    r = random.Random(width)
    song = lambda: 0 if r.random() < 0.33 else r.randrange(1, 30)
    events = spark.createDataFrame([(song(), i, r.randrange(0, 200), r.choice([None, 5]), f"e{i}") for i in range(900)], "song_id bigint, seq bigint, start bigint, length bigint, label string")
    events = events.withColumn("end", F.col("start") + F.col("length")).drop("length")
    probes = spark.createDataFrame([(song(), i, r.randrange(-20, 260)) for i in range(900)], "song_id bigint, probe_id bigint, t bigint")
    for cover in (True, False):
        a, b = (sorted((x.probe_id, x.event and x.event.label) for x in TL.as_of(probes, events, cover=cover, width=w).collect()) for w in (None, width))
        assert a == b
    closed = lambda w: sorted(tuple(x) for x in TL.close_intervals(events.withColumn("end", F.lit(None).cast("bigint")), F.lit(999), width=w).select("song_id", "seq", "end").collect())
    assert closed(None) == closed(width)


def test_reports_pool_to_what_one_pass_gives(spark):
    import random

    r = random.Random(3)
    rows = [(f"t{i % 17}", i % 2, 10.0, r.choice([0.0, 2.5, 10.0]), r.choice([None, 0.1, 0.35, 0.6, 0.95])) for i in range(300)]
    x = spark.createDataFrame(rows, "take string, view int, seconds double, correct_seconds double, confidence double")
    reports = SC.calibration_report(x, "take", "view")
    near = lambda a, b: [None if v is None else round(v, 9) for v in a] == [None if v is None else round(v, 9) for v in b]
    assert reports.count() == 34 and near(SC.pooled(reports).collect()[0], SC.calibration(x).collect()[0])
    by_view = {v["view"]: list(v)[1:] for v in SC.pooled(reports, "view", total=True).collect()}
    assert set(by_view) == {0, 1, None} and all(near(by_view[v], SC.calibration(x.filter(F.lit(v is None) | (F.col("view") == v))).collect()[0]) for v in by_view)
    assert SC.pooled(reports.limit(0), "view").count() == 0


def test_sides_name_the_view_of_the_reference(spark):
    ref = spark.createDataFrame([(1, "a", "C"), (1, "b", "G"), (2, "a", "F")], "song_id int, view string, label string")
    hyp = spark.createDataFrame([(1, "C"), (3, "D")], "song_id int, label string")
    assert sorted(map(tuple, SC.sides(ref, hyp, "song_id", view="a").collect())) == [(1, "C", "C"), (2, "F", None), (3, None, "D")]
    with pytest.raises(ValueError, match="view"):
        SC.sides(ref, hyp, "song_id")
