import math

from loomgrid.streaming.positions import follow


def test_stream_agrees_with_batch(spark, tmp_path):
    steps = spark.createDataFrame([(1, 0, 10, 0.0, 0.0, 10.0, 0.0, 8.0, False, False, 0.0)], "car long, pos int, edge long, fx double, fz double, tx double, tz double, width double, bridge boolean, tunnel boolean, level double")
    cars = spark.createDataFrame([(1, 0.0, 1.0)], "car long, t double, speed double")
    spark.createDataFrame([(0.0,), (3.0,), (12.0,)], "elapsed double").write.json(f"{tmp_path}/ticks")
    seen = {}
    q = follow(spark.readStream.schema("elapsed double").json(f"{tmp_path}/ticks"), cars, steps, lambda places, n: seen.update({r.elapsed: (r.x, r.z) for r in places.collect()}))
    q.processAllAvailable()
    q.stop()
    assert seen[0.0] == (0.0, 0.0) and seen[3.0][0] == 3.0 and math.isclose(seen[12.0][0], 8.0)
    assert seen[3.0][1] < 0 < seen[12.0][1]
