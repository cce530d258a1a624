"""Frame operators and the order of lines."""

from pyspark.sql import functions as F

from cantus.functions import scalars as S
from cantus.operators import frames as FR
from cantus.operators import timeline as TL


def test_gate_margins_and_order(spark):
    c = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    rows = [(1, i, c, 1.0 if i < 3 else (None if i == 3 else 0.0001)) for i in range(6)]
    x = FR.energy_gate(spark.createDataFrame(rows, "song_id int, frame_no bigint, chroma array<double>, rms double"), -40.0).withColumn("scores", FR.frame_scores(F.col("chroma"), False))
    assert [max(r.chroma) for r in x.orderBy("frame_no").collect()] == [1.0, 1.0, 1.0, 1.0, 0.0, 0.0]
    assert x.select(FR.best_state(F.col("scores"), 0.5).alias("l")).orderBy("frame_no").first().l == "C"
    seg = spark.createDataFrame([(1, 0, 0.0, 2.0, "C"), (1, 1, 2.0, 3.0, "C"), (2, 0, 0.0, 1.0, "N")], "song_id int, seq int, start double, end double, label string")
    got = {(r.song_id, r.seq): round(r.margin, 6) for r in FR.segment_margins(x, seg, 0.5).collect()}
    assert got[1, 0] == round(1 - 2 / 3, 6) and got[1, 1] < 0 and got[2, 0] == 0.0
    lines = spark.createDataFrame([(1, 0, None), (1, 1, 5.0), (1, 2, 1.0), (1, 3, None)], "song_id int, seq int, start double")
    assert [r.seq for r in TL.display_order(lines).orderBy("pos").collect()] == [2, 1, 0, 3]


def test_small_scalars(spark):
    r = spark.range(1).select(
        S.real_time_factor(F.lit(10.0), F.lit(2.0)).alias("a"), S.real_time_factor(F.lit(10.0), F.lit(0.0)).alias("b"), S.metrical_alternatives(F.lit(120.0)).alias("c"),
        S.compress_chroma(F.array(F.lit(4.0), F.lit(-1.0)), "sqrt").alias("d"), S.correct_fraction(F.lit(1.0), F.lit(0.0)).alias("e"), S.confidence_band(F.lit(None).cast("double")).alias("f"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (5.0, None, [60.0, 240.0], [2.0, 0.0], None, "unknown")
