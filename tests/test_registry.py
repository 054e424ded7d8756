import math

from barweave.plans.registry import shape_frame, shape_sql


def test_large_values_keep_their_size(spark):
    values = [0.1234567, -2.5, 9223372036855.5, 1.25e29, -4e20, 2.0**53, float("inf"), None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    shaped = [r.v for r in shape_frame(rows, "i:i v:d").orderBy("i").collect()]
    assert shaped[0] == 0.123457 and shaped[1] == -2.5 and shaped[2] == 9223372036855.5
    assert shaped[6] == math.inf and shaped[7] is None
    for got, given in zip(shaped[3:6], values[3:6]):
        assert abs(got - given) <= 1e-15 * abs(given)


def test_large_values_equal_their_sql(spark):
    import duckdb

    given = "SELECT * FROM (VALUES (0, 1.2541e29), (1, -9.3e16), (2, 92238 * 1e12), (3, 12345.678)) AS t(i, v)"
    frame = spark.sql(given.replace("1.2541e29", "1.2541e29D").replace("1e12", "1e12D").replace("-9.3e16", "-9.3e16D").replace("12345.678", "12345.678D"))
    mine = [tuple(r) for r in shape_frame(frame, "i:i v:d2").orderBy("i").collect()]
    other = duckdb.sql(shape_sql(given.replace("1.2541e29", "1.2541e29::DOUBLE").replace("12345.678", "12345.678::DOUBLE"), "i:i v:d2") + " ORDER BY i").fetchall()
    assert mine == other
