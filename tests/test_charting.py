"""Chart import, chords over lyrics and documents, on small songs."""

import random

import numpy as np
import pytest

from cantus.operators import charting as CH
from cantus.operators import chord_lines as CL
from cantus.operators import documents as DO
from cantus.operators import jobs as JO
from cantus.operators import placement as PL
from cantus.operators import scoring as SC

LINE = "song_id bigint, seq bigint, text string, start double, end double, words array<struct<text:string,start:double,end:double>>"
CHORD = "song_id bigint, seq bigint, start double, end double, label string"


def test_edit_ops_prefer_pairs_then_missing_ones():
    assert PL.edit_ops(["C", "G"], ["C", "A", "G"]) == [("match", 0, 0), ("extra", None, 1), ("match", 1, 2)]
    assert PL.edit_ops(["C"], ["G"]) == [("substitution", 0, 0)] and PL.edit_ops([], ["G"]) == [("extra", None, 0)] and PL.edit_ops(["C"], []) == [("missing", 0, None)]
    same = np.array([[True, False], [False, True]])
    assert SC.edit_pairs(2, 2, lambda i, lo, hi: same[i, lo:hi]) == [(0, 0), (1, 1)]


def test_words_of_a_chart_take_the_heard_times(spark):
    lines = spark.createDataFrame([(1, 0, "One twö three"), (1, 1, "satisfascer five")], "song_id bigint, line bigint, text string")
    heard = spark.createDataFrame([(1, 0, "one", 1.0, 1.5), (1, 1, "three", 3.0, 3.5), (1, 2, "satisfacer", 5.0, 5.5)], "song_id bigint, n bigint, text string, start double, end double")
    words = CH.chart_words(lines)
    pairs = CH.word_anchors(words, heard)
    assert sorted((x.n, x.heard) for x in pairs.collect()) == [(0, 0), (2, 1), (3, 2)]
    known = pairs.join(heard.selectExpr("song_id", "n as heard", "start as heard_start", "end as heard_end"), ["song_id", "heard"]).drop("heard")
    tracks = spark.createDataFrame([(1, 5.7)], "song_id bigint, duration double")
    got = {x.n: (round(x.start, 6), round(x.end, 6)) for x in CH.fill_word_times(words.join(known, ["song_id", "n"], "left"), tracks).collect()}
    # between two anchors: half of the gap; after the last one: its end and the median length, cut at the end of the track
    assert got == {0: (1.0, 1.5), 1: (2.25, 3.0), 2: (3.0, 3.5), 3: (5.0, 5.5), 4: (5.65, 5.7)}


def test_alike_words_lose_no_pair(spark):
    """Against the ratio of all pairs of words of a song."""
    from difflib import SequenceMatcher

    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdé", k=r.randint(4, 9)))
    songs = {}
    for k in range(60):
        left = [word() for _ in range(12)]
        change = lambda w: "".join(c for c in w if r.random() < 0.9) + r.choice(["", "", "s", "ab"])
        songs[k] = (left, [change(r.choice(left)) if r.random() < 0.7 else word() for _ in range(12)])
    rows = lambda side: spark.createDataFrame([(k, i, w) for k, x in songs.items() for i, w in enumerate(x[side])], "song_id bigint, n bigint, text string")
    got = {tuple(x) for x in CH.alike_words(rows(0), rows(1)).collect()}
    fold = {w: w.replace("é", "e") for x in songs.values() for side in x for w in side}
    want = {(k, u, v) for k, (a, b) in songs.items() for u in {fold[w] for w in a} for v in {fold[w] for w in b} if u != v and min(len(u), len(v)) >= 5 and SequenceMatcher(None, u, v).ratio() >= 0.8}
    assert got == want and len(want) > 50


def smoothed(spark, *words):
    df = spark.createDataFrame([(1, 0, i, "w", float(s), float(e)) for i, (s, e) in enumerate(words)], "song_id bigint, line bigint, word_no int, text string, start double, end double")
    return [(round(x.start, 6), round(x.end, 6)) for x in CH.smoothed(df).orderBy("word_no").collect()]


def test_smoothed_lines_spread_stacked_words(spark):
    # the last two words are as short as can be: with the one before they share what is left of the line
    assert smoothed(spark, (0, 0.5), (1, 1.5), (1.5, 3), (3, 3.05), (3, 3.05)) == [(0, 0.5), (1, 1.5), (1.5, 2.016667), (2.016667, 2.533333), (2.533333, 3.05)]
    # starts don't go back, a word without a length has a tenth of a second, and ends stop at the next start
    assert smoothed(spark, (1, 9), (0.5, 0.5), (3, 4)) == [(1, 1.05), (1, 1.1), (3, 4)]
    assert smoothed(spark, (-1, 2)) == [(0, 2)]


def spread(spark, at, first=None, last=None, duration=None):
    df = spark.createDataFrame([(1, i, t, first, last, duration) for i, t in enumerate(at)], "song_id bigint, seq bigint, at double, heard_start double, heard_end double, duration double")
    return [(round(x.start, 6), round(x.end, 6)) for x in CH.spread_chords(df).orderBy("seq").collect()]


def test_chords_are_spread_between_their_words(spark):
    assert [s for s, _ in spread(spark, [None, 4.0, None, 8.0, None], 2.0, None, 12.0)] == [2.0, 4.0, 6.0, 8.0, 10.0]
    assert spread(spark, [1.0, 1.0]) == [(1.0, 1.05), (1.05, 1.55)]
    # no running maximum: a start that is late enough for the one before it stays
    assert [s for s, _ in spread(spark, [1.0, 1.0, 1.06, 1.0, 5.0, 5.0])] == [1.0, 1.05, 1.06, 1.11, 5.0, 5.05]
    starts = [s for s, _ in spread(spark, [9.0, 12.0], duration=10.0)]
    assert starts == [7.4625, 9.95]
    assert spread(spark, [2.0, None, None], None, 8.0) == [(2.0, 4.0), (4.0, 6.0), (6.0, 8.0)]


def filled(spark, spans, duration=None):
    df = spark.createDataFrame([(1, i, *(s or (None, None)), duration) for i, s in enumerate(spans)], "song_id bigint, seq bigint, heard_from double, heard_to double, duration double")
    return [(round(x.start, 6), round(x.end, 6)) for x in CH.fill_chord_times(df).orderBy("seq").collect()]


def test_chords_without_words_follow_the_heard_ones(spark):
    assert filled(spark, [(1.0, 2.0), None, (4.0, 5.0), None], 7.0) == [(1.0, 2.0), (3.0, 4.0), (4.0, 5.0), (5.0, 7.0)]
    assert filled(spark, [None, None]) == []
    # the first span makes room at 0; the last one shares its own time where nothing says that the song is longer
    assert filled(spark, [None, (0.0, 2.0), None]) == [(0.0, 1.0), (1.0, 1.5), (1.5, 2.0)]
    # three between two spans: each starts a share of what is left later, and lasts the usual time
    assert filled(spark, [(0.0, 1.0), None, None, None, (9.0, 10.0)]) == [(0.0, 1.0), (3.0, 4.0), (5.666667, 6.666667), (7.833333, 8.833333), (9.0, 10.0)]
    # a gap of nothing
    assert filled(spark, [(0.0, 3.0), None, None, (2.0, 5.0)]) == [(0.0, 3.0), (3.0, 2.0), (2.0, 2.0), (2.0, 5.0)]


def test_import_of_a_chart(spark):
    lines = spark.createDataFrame([(1, 0, "hello my friend"), (2, 0, "nothing alike here")], "song_id bigint, line bigint, text string")
    chords = spark.createDataFrame([(1, 0, "C", 0, 0), (1, 1, "G7", 0, 2), (2, 0, "N", None, None), (2, 1, "Am", None, None)], "song_id bigint, seq bigint, label string, line bigint, word_no int")
    heard = spark.createDataFrame([(2, 0, 0.0, 2.0, "N"), (2, 1, 2.0, 4.0, "Am7")], CHORD)
    transcript = spark.createDataFrame([(1, 0, "hello my friend", 1.0, 4.0), (2, 0, "quite other words", 0.0, 3.0)], "song_id bigint, seq bigint, text string, start double, end double")
    tracks = spark.createDataFrame([(1, 6.0), (2, 5.0)], "song_id bigint, duration double")
    placed, sung, words = CH.import_chart(lines, chords, heard, transcript, tracks)
    got = sorted((x.song_id, x.start, x.end, x.label, x.quality) for x in placed.collect())
    assert got == [(1, 1.0, 3.0, "C", "major"), (1, 3.0, 6.0, "G7", "7"), (2, 0.0, 2.0, "N", "no_chord"), (2, 2.0, 4.0, "Am", "minor")]
    assert [(x.song_id, x.text, x.start, x.end) for x in sung.collect()] == [(1, "hello my friend", 1.0, 4.0)] and words.count() == 3


def test_chord_lines(spark):
    w = lambda *xs: [(t, s, None) for t, s in xs]
    lines = spark.createDataFrame([(1, 0, "la la home", 10.0, 14.0, w(("la", 10.0), ("la", 11.0), ("home", 12.0))), (1, 1, "abcdefghijk", 20.0, None, []), (1, 2, "untimed", None, None, [])], LINE)
    chords = spark.createDataFrame([(1, 0, 1.0, 3.0, "C"), (1, 1, 9.0, 10.5, "Eb"), (1, 2, 11.0, 12.0, "Am"), (1, 3, 11.5, 12.0, "G"), (1, 4, 15.0, None, "F"), (1, 5, 22.0, 24.0, "C")], CHORD)
    rows = [(x.text, x.chord_row, x.is_gap) for x in CL.sheet_rows(lines, chords).orderBy("pos").collect()]
    # the second la is at column 3; G would cover Am and moves right; the last line runs until the last chord ends
    assert rows == [("· · ·", "C", True), ("la la home", "Eb Am G", False), ("· · ·", "F", True), ("abcdefghijk", "     C", False), ("untimed", "", False)]


def test_documents(spark):
    songs = spark.createDataFrame([(1, "/a/song.wav", 65.5), (2, None, None)], "song_id bigint, path string, duration double")
    chords = spark.createDataFrame([(1, 1, 61.0, None, "G"), (1, 0, 0.0, 61.0, "C")], CHORD)
    lyrics = spark.createDataFrame([(1, 0, "hey\nyou", 3.0, None, "lyrics"), (1, 1, "x", None, None, "instrumental")], "song_id bigint, seq bigint, text string, start double, end double, kind string")
    keys = spark.createDataFrame([(1, "C", "major")], "song_id bigint, tonic string, mode string")
    docs = DO.assemble(songs, chords, lyrics, keys, raw=spark.createDataFrame([(1, "e", "t")], "song_id bigint, engine string, text string"))
    sheets = {x.song_id: x.sheet for x in DO.markdown(docs).collect()}
    assert sheets[2] == "# Unknown title\n"
    assert sheets[1] == "# song.wav\n\n* key C major · duration 01:05.50\n\n## Chords\n\n| start | end | chord |\n| ----- | --- | ----- |\n| 00:00.00 | 01:01.00 | C |\n| 01:01.00 |  | G |\n\n## Lyrics\n\n`00:03.00` — hey you\n**[instrumental]**\n"
    back, bad = DO.from_json(DO.to_json(docs).union(spark.createDataFrame([(7, "{"), (8, "{}")], "song_id bigint, value string")))
    assert sorted(x.song_id for x in bad.collect()) == [7, 8] and back.count() == 2
    assert back.filter("song_id = 1").collect()[0].document == docs.filter("song_id = 1").collect()[0].document
    new = DO.with_timed_lyrics(docs, spark.createDataFrame([(1, 0, "new", 0.0, None)], "song_id bigint, seq bigint, text string, start double, end double"), "file.lrc").filter("song_id = 1").collect()[0].document
    assert [x.text for x in new.lyrics] == ["new"] and new.raw == {"e": "t", "lyrics_override": "file.lrc"} and len(new.chords) == 2


def test_words_much_alike_are_those_of_the_ratio():
    from difflib import SequenceMatcher

    r = random.Random(6)
    words = ["".join(r.choices("abcd", k=r.randint(5, 12))) for _ in range(400)] + ["a" * 250, "ab" * 130]
    words += [w[:2] + r.choice("abcd") + w[3:] for w in words] + [w[1:] for w in words]
    pairs = [(r.choice(words), r.choice(words)) for _ in range(20_000)] + list(zip(words, words[402:], strict=False))
    want = [SequenceMatcher(None, u, v).ratio() >= CH.ALIKE for u, v in pairs]
    assert [CH.much_alike(u, v) for u, v in pairs] == want and 100 < sum(want) < len(want) / 2


def test_clock_rounds_as_printf(spark):
    r = random.Random(4)
    values = [k / 8 for k in range(500)] + [k / 200 for k in range(3000)] + [r.randrange(518_400_000) * 5000 * 1e-6 for _ in range(3000)] + [r.uniform(0, 1e6) for _ in range(1000)] + [59.995, 1e-12]
    df = spark.createDataFrame([(x,) for x in [*values, None]], "x double")
    want = ["%02d:%05.2f" % (x // 60, x - x // 60 * 60) for x in values]
    assert [x.t for x in df.select(DO.clock(df["x"]).alias("t")).collect()] == [*want, ""]


@pytest.mark.parametrize(("layer", "row", "error"), [("beats", (1.0, 0), "position"), ("beats", (-1.0, 1), "negative time"), ("beats", (1.0, 1), None)])
def test_validity(spark, layer, row, error):
    df = spark.createDataFrame([row], "time double, position_in_bar int")
    assert df.select(JO.validity(layer).alias("e")).collect()[0].e == error


def test_chords_of_frames_and_labels_of_layers(spark):
    c, g = ([float(i in on) for i in range(12)] for on in ((0, 4, 7), (2, 7, 11)))
    rows = [(1, i, c if i < 10 else g, 1.0, 2.0) for i in range(20)]
    f = spark.createDataFrame(rows, "song_id bigint, frame_no bigint, chroma array<double>, rms double, duration double")
    for penalty in (0.4, None):
        got = [(x.start, x.end, x.root, x.quality) for x in JO.chords_of_frames(f, 0.1, penalty=penalty).orderBy("seq").collect()]
        assert [(round(a, 6), round(b, 6), r, q) for a, b, r, q in got] == [(0.0, 1.0, "C", "major"), (1.0, 2.0, "G", "major")]
    songs = spark.createDataFrame([(1,), (2,)], "song_id bigint")
    ch = spark.createDataFrame([(1, 0.5, "b"), (1, None, "a")], "song_id bigint, confidence double, source string")
    ly = spark.createDataFrame([(1, ["x", "y"])], "song_id bigint, words array<string>")
    te = spark.createDataFrame([(1, 120.0, [60.0], "4/4")], "song_id bigint, bpm double, alternatives array<double>, meter string")
    got = {x.song_id: tuple(x)[1:] for x in JO.layer_labels(songs, ch, ly, te).collect()}
    assert got == {1: ("2 events from a, b", "0.50 average over 1 of 2 events (1 unknown)", "1 segment, 2 words", "120.0 BPM (also 60.0 BPM) in 4/4"), 2: ("none detected", None, None, None)}
