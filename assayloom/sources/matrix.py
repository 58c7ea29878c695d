"""Wide text tables (one row a feature, one column a sample) into a Dataset, with every check up front."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dataset import Dataset, Refusal

# Cell texts that count as missing by default.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Column names as written; duplicates are refused, as a reader would silently rename them."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise Refusal(f"{path} is empty")
    names = [n.strip().strip('"') for n in first[0][0].lstrip("﻿").rstrip("\r").split(sep)]
    twice = sorted(n for n, k in Counter(names).items() if k > 1)
    if twice:
        raise Refusal(f"{path}: repeated columns {', '.join(twice)}")
    return names


def read_text_table(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """All columns as text: identifiers such as 0001 stay what they are. `row_ord` keeps the order of the file."""
    names = header(spark, path, sep)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = spark.read.csv(path, sep=sep, header=True, schema=schema, enforceSchema=True, quote='"')
    return rows.withColumn("row_ord", F.monotonically_increasing_id())


def metadata(spark: SparkSession, path: str, join_key: str, sep: str = ",", numeric_columns: Sequence[str] = ()) -> DataFrame:
    rows = read_text_table(spark, path, sep)
    if join_key not in rows.columns:
        raise Refusal(f"{path}: no column {join_key}")
    if rows.groupBy(join_key).count().filter("count > 1").limit(1).count():
        raise Refusal(f"{path}: repeated values of {join_key}")
    for c in numeric_columns:
        bad = rows.filter(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as double) is null")).limit(1).count()
        if bad:
            raise Refusal(f"{path}: column {c} is not numeric")
        rows = rows.withColumn(c, F.col(c).cast("double"))
    return rows


def strip_suffix(name: Column, suffix: str | None) -> Column:
    if not suffix:
        return name
    return F.when(name.endswith(suffix), F.substring(name, 1, F.length(name) - len(suffix))).otherwise(name)


def latest_replicate(samples: DataFrame, group: str, rank: str) -> DataFrame:
    """One row per group: the highest rank, the later row among equals."""
    w = Window.partitionBy(group).orderBy(F.col(rank).desc(), F.col("row_ord").desc())
    return samples.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def ordered(samples: DataFrame, order_by: str | None) -> DataFrame:
    """sample_ord from 0: numeric if every value is a number, else by text; ties keep the file's order."""
    key = F.col("row_ord")
    if order_by is not None:
        words = samples.filter(F.col(order_by).isNotNull() & F.expr(f"try_cast(`{order_by}` as double) is null")).limit(1).count()
        key = F.col(order_by).cast("string") if words else F.col(order_by).cast("double")
    return samples.withColumn("sample_ord", (F.row_number().over(Window.orderBy(key.asc_nulls_last(), "row_ord")) - 1).cast("int")).drop("row_ord")


def load_wide(
    spark: SparkSession, data: str, samples: str, *, join_key: str, id_columns: Sequence[str] = ("protein",), feature_id_column: str | None = None,
    suffix: str | None = None, numeric_columns: Sequence[str] = (), collapse_replicates: tuple[str, str] | None = None, order_by: str | None = None,
    missing: str = "error", na_values: Sequence[str] = (), require_unique_features: bool = True, expected_n_samples: int | None = None,
    expected_n_features: int | None = None, data_sep: str = "\t", metadata_sep: str = ",", scale: str = "linear",
) -> Dataset:
    wide = read_text_table(spark, data, data_sep)
    return assemble(
        wide, metadata(spark, samples, join_key, metadata_sep, numeric_columns), join_key=join_key, id_columns=id_columns, feature_id_column=feature_id_column or id_columns[0],
        suffix=suffix, collapse_replicates=collapse_replicates, order_by=order_by, missing=missing, na_values=na_values,
        require_unique_features=require_unique_features, expected_n_samples=expected_n_samples, expected_n_features=expected_n_features, scale=scale,
    )


def assemble(
    wide: DataFrame, meta: DataFrame, *, join_key: str, id_columns: Sequence[str], feature_id_column: str, suffix: str | None, collapse_replicates: tuple[str, str] | None,
    order_by: str | None, missing: str, na_values: Sequence[str], require_unique_features: bool, expected_n_samples: int | None, expected_n_features: int | None, scale: str,
) -> Dataset:
    if missing not in ("error", "preserve"):
        raise Refusal("missing is 'error' or 'preserve'")
    absent = [c for c in id_columns if c not in wide.columns]
    if absent:
        raise Refusal(f"no id column {', '.join(absent)}")
    columns = [c for c in wide.columns if c not in id_columns and c != "row_ord"]
    if not columns:
        raise Refusal("no sample columns")
    tokens = [*NA_TOKENS, *na_values]
    for c in id_columns:
        if wide.filter(F.col(c).isNull() | F.trim(c).isin(tokens)).limit(1).count():
            raise Refusal(f"blank or missing identifiers in {c}")
    samples = meta.withColumn("sample_id", strip_suffix(F.col(join_key), suffix))
    if samples.filter("sample_id is null").limit(1).count():
        raise Refusal(f"blank {join_key}")
    if samples.groupBy("sample_id").count().filter("count > 1").limit(1).count():
        raise Refusal(f"values of {join_key} collide once the suffix is gone")
    if collapse_replicates:
        samples = latest_replicate(samples, *collapse_replicates)
    strip = lambda c: c[: -len(suffix)] if suffix and c.endswith(suffix) else c
    renamed = Counter(strip(c) for c in columns)
    if max(renamed.values()) > 1:
        raise Refusal("sample columns collide once the suffix is gone")
    # pairing both ways: the header and the metadata are small
    known = {r[0] for r in samples.select("sample_id").collect()}
    if lost := sorted(known - set(renamed)):
        raise Refusal(f"samples without a column: {', '.join(lost[:5])}")
    if not collapse_replicates and (extra := sorted(set(renamed) - known)):
        raise Refusal(f"columns without metadata: {', '.join(extra[:5])}")
    used = [c for c in columns if strip(c) in known]
    if require_unique_features and wide.groupBy(feature_id_column).count().filter("count > 1").limit(1).count():
        raise Refusal(f"repeated features in {feature_id_column}")
    features = wide.select(F.col(feature_id_column).alias("feature_id"), *[F.col(c) for c in id_columns if c != "feature_id"], "row_ord")
    features = features.withColumn("feature_ord", (F.row_number().over(Window.orderBy("row_ord")) - 1).cast("int")).drop("row_ord")
    long = wide.select(F.col(feature_id_column).alias("feature_id"), *used).unpivot(["feature_id"], used, "sample_id", "raw")
    long = long.withColumn("sample_id", strip_suffix(F.col("sample_id"), suffix)).withColumn("raw", F.trim("raw"))
    cell = F.when(F.col("raw").isin(tokens), None).otherwise(F.col("raw"))
    counts = long.select(cell.alias("c")).agg(F.count_if(F.expr("c is not null and try_cast(c as double) is null")).alias("text"), F.count_if(F.expr("c is null or isnan(try_cast(c as double))")).alias("none"), F.count("*").alias("n")).first()
    if not counts["n"]:
        raise Refusal("no feature rows")
    if counts["text"]:
        raise Refusal(f"{counts['text']} abundances are not numbers")
    if counts["none"] and missing == "error":
        raise Refusal(f"{counts['none']} abundances are missing")
    number = cell.cast("double")
    values = long.select("sample_id", "feature_id", F.when(F.isnan(number), None).otherwise(number).alias("value"))
    samples = ordered(samples, order_by)
    for what, frame, wanted in (("samples", samples, expected_n_samples), ("features", features, expected_n_features)):
        if wanted is not None and frame.count() != wanted:
            raise Refusal(f"expected {wanted} {what}, found {frame.count()}")
    return Dataset(values, samples, features, scale)


def best_charge(rows: DataFrame, values: Sequence[str], *, protein: str = "protein", sequence: str = "modifiedSequence", charge: str = "precursorCharge") -> DataFrame:
    """Precursors of one charge per sequence: the charge whose medians over rows average highest, the lowest by text among
    equals; values come from its first row, the accessions of all its rows are joined."""
    if rows.filter(F.expr(f"{charge} is not null and try_cast({charge} as int) is null")).limit(1).count():
        raise Refusal(f"{charge} is not an integer everywhere")
    numbers = [F.expr(f"try_cast(`{v}` as double)") for v in values]
    medians = rows.groupBy(sequence, charge).agg(*[F.median(n).alias(f"_m{i}") for i, n in enumerate(numbers)])
    means = F.expr(f"try_divide(aggregate(array({', '.join(f'_m{i}' for i in range(len(values)))}), 0D, (a, x) -> a + coalesce(x, 0D)), size(filter(array({', '.join(f'_m{i}' for i in range(len(values)))}), x -> x is not null)))")
    best = medians.withColumn("_s", means).withColumn("_n", F.row_number().over(Window.partitionBy(sequence).orderBy(F.col("_s").desc_nulls_last(), F.col(charge).cast("string"))))
    kept = rows.join(best.filter("_n = 1").select(sequence, charge), [sequence, charge])
    agree = kept.groupBy(sequence).agg(*[(F.count_distinct(F.coalesce(F.col(v), F.lit("\0")))).alias(f"_d{i}") for i, v in enumerate(values)])
    if agree.filter(" or ".join(f"_d{i} > 1" for i in range(len(values)))).limit(1).count():
        raise Refusal("rows of one precursor that several proteins share disagree")
    first = [F.min_by(F.col(v), "row_ord").alias(v) for v in values]
    return kept.groupBy(sequence).agg(F.array_join(F.array_sort(F.collect_set(protein)), ",").alias(protein), F.min_by(charge, "row_ord").cast("int").alias(charge), *first, F.min("row_ord").alias("row_ord"))


def load_precursors(spark: SparkSession, data: str, samples: str, *, join_key: str, protein_column: str = "protein", sequence_column: str = "modifiedSequence", charge_column: str = "precursorCharge", suffix: str | None = None, numeric_columns: Sequence[str] = (), order_by: str | None = None, missing: str = "error", data_sep: str = "\t", metadata_sep: str = ",", scale: str = "linear") -> Dataset:
    wide = read_text_table(spark, data, data_sep)
    ids = (protein_column, sequence_column, charge_column)
    absent = [c for c in ids if c not in wide.columns]
    if absent:
        raise Refusal(f"no id column {', '.join(absent)}")
    values = [c for c in wide.columns if c not in ids and c != "row_ord"]
    one = best_charge(wide, values, protein=protein_column, sequence=sequence_column, charge=charge_column)
    one = one.withColumn(charge_column, F.col(charge_column).cast("string"))
    return assemble(
        one, metadata(spark, samples, join_key, metadata_sep, numeric_columns), join_key=join_key, id_columns=ids, feature_id_column=sequence_column, suffix=suffix, collapse_replicates=None,
        order_by=order_by, missing=missing, na_values=(), require_unique_features=True, expected_n_samples=None, expected_n_features=None, scale=scale,
    )
