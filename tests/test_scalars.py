from pyspark.sql import functions as F

from coursebeacon.functions import scalars as s
from coursebeacon.functions.learning_index import fallback_probability, learning_index


def one(spark, *columns, row="select 1 as x"):
    return spark.sql(row).select(*columns).first()


def test_week_index_floors_negative_offsets(spark):
    rows = spark.createDataFrame([(d,) for d in (-7, -1, 0, 132, 133, 140)], "date int")
    weeks = [r[0] for r in rows.select(s.week_index("date", F.lit(-7))).collect()]
    assert weeks == [0, 0, 1, 19, 20, 21]
    assert one(spark, s.week_index(F.lit(-10), F.lit(-7)))[0] == -1


def test_min_max_zero_range(spark):
    r = one(spark, s.min_max(F.lit(5.0), F.lit(5.0), F.lit(5.0)), s.min_max(F.lit(7.0), F.lit(5.0), F.lit(9.0)))
    assert tuple(r) == (0.0, 0.5)


def test_clamp_keeps_null(spark):
    r = one(spark, s.clamp(F.lit(None).cast("double"), 0, 1), s.clamp(F.lit(3.0), 0, 1), s.clamp(F.lit(-3.0), low=0))
    assert tuple(r) == (None, 1.0, 0.0)


def test_label_cut_inclusive_or_not(spark):
    assert tuple(one(spark, s.label_at(F.lit(0.5)), s.label_at(F.lit(0.5), inclusive=False))) == (1, 0)


def test_division_and_risk_defaults(spark):
    r = one(spark, s.ratio(F.lit(1), F.lit(0)), s.deviation_percent(F.lit(2.0), F.lit(0.0)),
            s.risk_of(F.lit(None).cast("double")), s.model_score(F.lit(None).cast("double"), F.lit(0.5)))
    assert tuple(r) == (None, None, 0.5, 0.2)


def test_nan_becomes_null_before_comparisons(spark):
    assert one(spark, s.null_if_nan(F.lit(float("nan"))))[0] is None


def test_hash_choice_is_stable_and_near_its_fraction(spark):
    ids = spark.range(20000).withColumn("k", F.concat(F.lit("u"), F.col("id").cast("string")))
    chosen = ids.filter(s.hash_below("k", 0.2, 42))
    n = chosen.count()
    assert abs(n / 20000 - 0.2) < 0.01
    again = ids.repartition(7).filter(s.hash_below("k", 0.2, 42))
    assert again.exceptAll(chosen).count() == 0 and again.count() == n


def test_round_half_even_and_lookup(spark):
    r = one(spark, s.round_half_even(F.lit(0.12345)), s.lookup(F.lit("b"), {"a": 1}, 9), s.lookup(F.lit("a"), {"a": 1}, 9))
    assert tuple(r) == (0.1234, 9, 1)


def test_index_is_unclamped_but_fallback_caps_clicks(spark):
    row = ("select 100D as mean_score, 1D as completion, 20 as n_submitted, 60000 as total_clicks, "
           "40 as active_weeks")
    index, p = one(spark, learning_index(), fallback_probability(), row=row)
    assert abs(index - 100 * (0.3 + 0.25 + 0.4 + 0.45 + 0.2)) < 1e-9
    share = 0.3 + 0.25 + 0.4 + 0.15 + 0.2
    assert abs(p - 1 / (1 + 2.718281828459045 ** (-3.5 * (share - 0.5)))) < 1e-12


def test_index_counts_missing_metrics_as_zero(spark):
    row = ("select cast(null as double) as mean_score, cast(null as double) as completion, 5 as n_submitted, "
           "cast(null as bigint) as total_clicks, 0 as active_weeks")
    assert abs(one(spark, learning_index(), row=row)[0] - 10.0) < 1e-9
