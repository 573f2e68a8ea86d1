"""Fitted models on shared storage, in Spark ML's own format."""

from pyspark.ml.util import DefaultParamsReader


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark, path: str):
    """Load whatever kind of model was saved; the class is named in its metadata."""
    return DefaultParamsReader.loadParamsInstance(path, spark)
