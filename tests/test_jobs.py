"""Whole jobs on the small test data: models, rebuild, plans, SQL counterparts."""

import os
import re

import duckdb
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from coursebeacon.catalog.entries import queries
from coursebeacon.catalog.oracle import statements
from coursebeacon.operators.features import feature_table
from coursebeacon.plans import train
from coursebeacon.plans.evaluate import evaluate_variants, weekly_metrics, weekly_scores
from coursebeacon.plans.prepare import prepare
from coursebeacon.plans.rebuild import published, rebuild
from coursebeacon.sources import relational
from coursebeacon.sources.models import load_model

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def prepared(spark, small):
    return prepare(relational.inputs(spark, small))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_models_beat_chance(prepared):
    for fit in (lambda t: train.train_boosting(t, maxIter=10), train.train_sequence, train.train_aggregate):
        _, score = fit(prepared.train)
        q = train.quality(score(prepared.test)).first()
        assert q["auc_roc"] > 0.5
    _, score = train.train_boosting(prepared.train, maxIter=3)
    weekly = weekly_metrics(prepared.test, model=score)
    assert weekly.count() == 20
    p = train.predict(prepared.test, score)
    assert p.columns == ["student_uid", "predicted_label", "prob_pass"] and p.count() == prepared.test.count()
    fit, held = train.validation_split(prepared.train)
    assert fit.count() + held.count() == prepared.train.count() and held.count() > 0


def test_tuning_scores_every_configuration(spark, prepared, tmp_path):
    estimator = LogisticRegression(labelCol="label", weightCol="class_weight")
    grid = ParamGridBuilder().addGrid(estimator.regParam, [0.0, 0.5]).build()
    impossible = {estimator.regParam: 0.0, estimator.weightCol: "no such column"}
    tuned = train.tune(prepared.train, estimator, [*grid, impossible])
    assert tuned.scores[2] is None and all(0 < s < 1 for s in tuned.scores[:2])
    assert tuned.score(prepared.test).filter("prob_pass is null").count() == 0
    train.write_tuned(tuned, prepared.test, f"{tmp_path}/model", f"{tmp_path}/predictions")
    assert spark.read.parquet(f"{tmp_path}/predictions").count() == prepared.test.count()
    with pytest.raises(Exception, match="no such column"):
        train.tune(prepared.train, estimator, [impossible])


def test_rebuild_writes_every_table(spark, small, tmp_path):
    paths = rebuild(spark, relational.inputs(spark, small), str(tmp_path),
                    train=lambda t: train.train_sequence(t, maxIter=5))
    assert spark.read.parquet(paths.predictions).count() == spark.read.parquet(paths.test).count()
    assert spark.read.parquet(paths.scaler).count() == 20
    assert published(spark, str(tmp_path)) == paths
    assert spark.read.parquet(paths.log).filter("run = 'rebuild'").count() == 20
    assert load_model(spark, paths.model).transform(train.with_sequence(spark.read.parquet(paths.test))).count() > 0


def test_working_tables_go_to_the_configured_folder(spark):
    from coursebeacon.session import checkpoint_root, work_path
    assert work_path(spark, "x").startswith(checkpoint_root(spark))


def test_plans(spark, small, prepared):
    features = feature_table(relational.inputs(spark, small))
    log = evaluate_variants(weekly_scores(prepared.test))
    for df in (features, log, queries()["explain_at_risk"](spark, small)):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
        assert "PythonUDF" not in plan and "EvalPython" not in plan and "InPandas" not in plan
    # the log is read with the columns the job needs
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", features._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert scans and all(len(s.split(",")) <= 6 for s in scans)
    # a lookup by key reaches the written table
    lookup = prepared.dataset.filter(F.col("student_uid") == "1_1_1995")
    assert "EqualTo(student_uid" in plan_of(lookup)
    # scores are combined before they are shuffled
    assert plan_of(log).index("partial_count") > 0


def test_every_query_has_a_counterpart():
    assert set(queries()) == set(statements())


QUICK = ["course_calendar", "weekly_clicks_strict", "feature_table", "feature_table_strict", "exact_split", "at_risk",
         "explain_at_risk", "index_quartiles", "variant_comparison", "scenario_holiday", "blend_search", "stream_alerts"]
SELECTED = sorted(statements()) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def sql(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", SELECTED)
def test_query_matches_sql(spark, small, sql, name):
    got = queries()[name](spark, small)
    rows = sorted((tuple(r[c] for c in sorted(got.columns)) for r in got.collect()), key=repr)
    result = sql.execute(statements()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(got.columns)
    order = [names.index(c) for c in sorted(names)]
    assert rows == sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
