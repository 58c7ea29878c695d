"""The data model: a sample x feature matrix as three DataFrames, and the scale its values are on."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALES = ("linear", "log2", "log10", "ln", "glog2", "zscore", "ratio")
LOG_SCALES = ("log2", "log10", "ln", "glog2", "zscore")
INFINITY = float("inf")


class Refusal(ValueError):
    """Input that an operator declines to work on; raised on the driver, before expensive work."""


class ScaleRefusal(Refusal):
    pass


@dataclass(frozen=True)
class Dataset:
    """values(sample_id, feature_id, value), samples(sample_id, sample_ord, ...), features(feature_id, feature_ord, ...).

    A null value is missing; on the linear scale 0 means "not detected". NaN never enters: loaders turn it into null.
    """

    values: DataFrame
    samples: DataFrame
    features: DataFrame
    scale: str = "linear"

    def __post_init__(self) -> None:
        if self.scale not in SCALES:
            raise ScaleRefusal(f"unknown scale {self.scale!r}; one of {', '.join(SCALES)}")

    def with_values(self, values: DataFrame, scale: str | None = None) -> Dataset:
        return dataclasses.replace(self, values=values.select("sample_id", "feature_id", "value"), scale=scale or self.scale)

    def keep_features(self, features: DataFrame) -> Dataset:
        """Only the features of this frame (feature_id)."""
        ids = features.select("feature_id").distinct()
        return dataclasses.replace(self, values=self.values.join(ids, "feature_id", "left_semi"), features=self.features.join(ids, "feature_id", "left_semi"))

    def keep_samples(self, condition: Column | str) -> Dataset:
        samples = self.samples.filter(condition)
        return dataclasses.replace(self, samples=samples, values=self.values.join(samples.select("sample_id"), "sample_id", "left_semi"))

    def dense(self) -> DataFrame:
        """Every cell of the matrix; those without a row are null."""
        cells = self.samples.select("sample_id").join(F.broadcast(self.features.select("feature_id")), how="cross")
        return cells.join(self.values, ["sample_id", "feature_id"], "left")


def finite(value: Column) -> Column:
    """False for null, NaN and infinities."""
    return F.coalesce(F.abs(value) < F.lit(INFINITY), F.lit(False))


def no_nan(value: Column) -> Column:
    return F.when(F.isnan(value), None).otherwise(value)


def detected(value: Column, min_intensity: float = 0.0) -> Column:
    return finite(value) & (value > min_intensity)


def require_scale(ds: Dataset, allowed: tuple[str, ...], what: str) -> None:
    if ds.scale not in allowed:
        raise ScaleRefusal(f"{what} needs one of the scales {', '.join(allowed)}; this data set is {ds.scale}")


def require_finite(ds: Dataset, what: str) -> None:
    bad = ds.values.filter(~finite(F.col("value"))).limit(1).count()
    if bad:
        raise Refusal(f"{what} needs finite values: resolve missing ones first")
