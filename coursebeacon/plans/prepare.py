"""Raw tables -> features, scaler, train/test split."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursebeacon.operators.enrolments import real_labels
from coursebeacon.operators.features import Inputs, feature_table, model_dataset
from coursebeacon.operators.scaling import ClickScaler
from coursebeacon.operators.splitting import with_exact_split, with_split
from coursebeacon.schemas import MAX_WEEKS
from coursebeacon.session import staged


@dataclass(frozen=True)
class Prepared:
    dataset: DataFrame  # scaled weekly columns, metrics, label, split
    scaler: ClickScaler

    @property
    def train(self) -> DataFrame:
        return self.dataset.filter(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.dataset.filter(F.col("split") == "test")

    @property
    def real(self) -> DataFrame:
        return real_labels(self.test)


def prepare(
    inputs: Inputs,
    join_keys: str = "student",
    completion: str = "ratio",
    fit_on: str = "all",
    exact_split: bool = False,
    max_weeks: int = MAX_WEEKS,
) -> Prepared:
    """``fit_on="all"`` fits the scaler before the split, ``"train"`` on training rows only.

    The unscaled table is written once: scaler, training and evaluation read it, not the raw logs.
    """
    unscaled = model_dataset(feature_table(inputs, join_keys, completion, max_weeks))
    unscaled = staged(with_exact_split(unscaled) if exact_split else with_split(unscaled), "dataset")
    fit_rows = {"all": unscaled, "train": unscaled.filter(F.col("split") == "train")}[fit_on]
    scaler = ClickScaler.fit(fit_rows, max_weeks)
    return Prepared(scaler.transform(unscaled), scaler)
