from pyspark.sql import functions as F

from cartlane.functions.numeric import mean_money, minutes_between, money, round2_ratio, round_half_up_ratio, round_money


def test_round2_ratio_half_up_and_null(spark):
    df = spark.createDataFrame([(1, 8), (201, 200), (0, 0), (-1, 8), (2, 3), (None, 5)], "n long, d long")
    got = [r[0] for r in df.select(round2_ratio(F.col("n"), F.col("d"))).collect()]
    # 0.125 -> 0.13, 1.005 -> 1.01 (exact half up, unlike binary round), /0 -> NULL,
    # -0.125 -> -0.12 (half toward +inf), 0.666.. -> 0.67
    assert got == [0.13, 1.01, None, -0.12, 0.67, None]


def test_round_half_up_ratio_scale(spark):
    df = spark.createDataFrame([(1001, 3)], "n long, d long")
    assert df.select(round_half_up_ratio(F.col("n"), F.col("d"), 10_000)).first()[0] == 3336667


def test_minutes(spark):
    df = spark.createDataFrame([(59_000_000, 120_000_000)], "a long, b long")
    # 00:00:59 -> 00:02:00 is one whole minute
    assert df.select(minutes_between(F.col("a"), F.col("b"))).first()[0] == 1


def test_money_keeps_every_digit_and_rounds_once(spark):
    df = spark.createDataFrame([(0.125,), (0.125,), (0.0000000004,)], "v double")
    total = df.agg(F.sum(money(F.col("v"))).cast("decimal(28,10)").alias("s"), F.count("v").alias("n"))
    r = total.select("s", round_money(F.col("s"), F.lit(2), 2), round_money(F.col("s"), F.lit(0), 2),
                     mean_money(F.col("s"), F.lit(2))).first()
    assert str(r[0]) == "0.2500000004" and r[1] == 13 and r[2] is None and str(r[3]).startswith("0.1250000002")
