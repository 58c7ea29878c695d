"""Data sets and results on disk: Parquet frames beside a JSON manifest, and results under deterministic fingerprints."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import warnings
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import Dataset, Refusal

FORMAT = 1


class ResultSchemaWarning(UserWarning):
    """A stored result lacks fields that the class has by now; their defaults were taken."""


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def save_dataset(ds: Dataset, path: str) -> None:
    spark = ds.values.sparkSession
    for name in ("values", "samples", "features"):
        getattr(ds, name).write.mode("overwrite").parquet(f"{path}/{name}")
    counts = {"n_samples": ds.samples.count(), "n_features": ds.features.count()}
    _write_text(spark, f"{path}/manifest", json.dumps({"format": FORMAT, "scale": ds.scale} | counts))


def load_dataset(spark: SparkSession, path: str) -> Dataset:
    manifest = json.loads(_read_text(spark, f"{path}/manifest"))
    if manifest.get("format") != FORMAT:
        raise Refusal(f"{path}: unknown format {manifest.get('format')!r}")
    ds = Dataset(*[spark.read.parquet(f"{path}/{name}") for name in ("values", "samples", "features")], manifest["scale"])
    for name, key in (("samples", "n_samples"), ("features", "n_features")):
        if getattr(ds, name).count() != manifest[key]:
            raise Refusal(f"{path}: {name} do not match the manifest")
    if ds.values.join(ds.features, "feature_id", "left_anti").limit(1).count() or ds.values.join(ds.samples, "sample_id", "left_anti").limit(1).count():
        raise Refusal(f"{path}: values of unknown samples or features")
    return ds


def fingerprint(*, analysis: str, data_version: str, params: dict[str, Any], seed: int | None) -> str:
    """First 12 hex digits of the sha256 of the canonical JSON; the order of lists counts, that of keys does not."""
    body = {"analysis": analysis, "data_version": data_version, "params": params, "seed": seed}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def save_result(result: Any, path: str, spark: SparkSession) -> None:
    """A dataclass: its frames as Parquet, everything else as JSON."""
    if not dataclasses.is_dataclass(result):
        raise Refusal("only dataclass results are stored")
    plain, frames = {}, []
    for f in dataclasses.fields(result):
        v = getattr(result, f.name)
        if isinstance(v, DataFrame):
            v.write.mode("overwrite").parquet(f"{path}/{f.name}")
            frames.append(f.name)
        else:
            plain[f.name] = v
    _write_text(spark, f"{path}/manifest", json.dumps({"format": FORMAT, "type": type(result).__name__, "frames": frames, "plain": plain}))


def load_result(path: str, cls: type, spark: SparkSession) -> Any:
    manifest = json.loads(_read_text(spark, f"{path}/manifest"))
    if manifest["type"] != cls.__name__:
        raise Refusal(f"{path} holds a {manifest['type']}, not a {cls.__name__}")
    known = {f.name: f for f in dataclasses.fields(cls)}
    fields = {k: v for k, v in manifest["plain"].items() if k in known} | {k: spark.read.parquet(f"{path}/{k}") for k in manifest["frames"] if k in known}
    missing = [n for n in known if n not in fields]
    without = [n for n in missing if known[n].default is dataclasses.MISSING and known[n].default_factory is dataclasses.MISSING]
    if without:
        raise Refusal(f"{path} lacks {', '.join(without)}")
    if missing:
        warnings.warn(f"{path}: defaults for {', '.join(missing)}", ResultSchemaWarning, stacklevel=2)
    return cls(**fields)


def cached_path(root: str, analysis: str, key: str) -> str:
    return f"{root}/{analysis}/{key}"


def save_cached(result: Any, root: str, spark: SparkSession, *, analysis: str, data_version: str, params: dict[str, Any], seed: int | None, created: str | None = None) -> str:
    key = fingerprint(analysis=analysis, data_version=data_version, params=params, seed=seed)
    path = cached_path(root, analysis, key)
    save_result(result, path, spark)
    _write_text(spark, f"{path}/meta", json.dumps({"analysis": analysis, "data_version": data_version, "params": params, "seed": seed, "fingerprint": key, "created": created}))
    return key


def load_cached(root: str, cls: type, spark: SparkSession, *, analysis: str, data_version: str, params: dict[str, Any], seed: int | None) -> Any:
    return load_result(cached_path(root, analysis, fingerprint(analysis=analysis, data_version=data_version, params=params, seed=seed)), cls, spark)


def read_meta(root: str, spark: SparkSession, analysis: str, key: str) -> dict[str, Any]:
    return json.loads(_read_text(spark, f"{cached_path(root, analysis, key)}/meta"))


def content_stamp(df: DataFrame) -> str:
    """Order-independent hash of a frame's rows, to notice changed data."""
    return str(df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.sum("h"), F.count("*")).first())
