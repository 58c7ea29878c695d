"""Profiling and reconciliation of tables before analysis: one aggregate pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import Dataset

from ..dataset import finite

# Texts that other programs write for "missing".
TOOL_TOKENS = ("NA", "N/A", "NaN", "nan", "null", "NULL", "None", "#N/A", "Filtered", "-")


def columns(df: DataFrame) -> DataFrame:
    """Per column: type, rows, nulls, distinct values, least and greatest as text."""
    aggs = []
    for c, _ in df.dtypes:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}|nulls"), F.count_distinct(c).alias(f"{c}|distinct"), F.min(c).cast("string").alias(f"{c}|least"), F.max(c).cast("string").alias(f"{c}|most")]
    one = df.agg(F.count("*").alias("rows"), *aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("rows"), *[F.col(f"`{c}|{k}`").alias(k) for k in ("nulls", "distinct", "least", "most")]) for c, t in df.dtypes]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def allowed_values(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule (a null result breaks it)."""
    one = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    return one.unpivot([], list(rules), "rule", "broken")


def token_census(df: DataFrame, column: str) -> DataFrame:
    """Zeros, empty cells and each token for missing, counted apart, before any cast."""
    raw = F.col(column).cast("string")
    kind = F.when(raw.isNull(), "null").when(F.trim(raw) == "", "empty").when(F.trim(raw).isin(*TOOL_TOKENS), F.concat(F.lit("token "), F.trim(raw))).when(F.expr(f"try_cast(`{column}` as double)") == 0, "zero").when(F.expr(f"try_cast(`{column}` as double)").isNotNull(), "number").otherwise("text")
    return df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def distributions(df: DataFrame, names: list[str]) -> DataFrame:
    """Counts of every value of every named column: one unpivot, one aggregate."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in names])
    return text.unpivot([], names, "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def cohort_summary(df: DataFrame, group: str, numeric: str, other: str) -> DataFrame:
    """n, mean and SD of a number by group, by group and other, and over all: one rollup."""
    out = df.rollup(group, other).agg(F.count("*").alias("n"), F.avg(numeric).alias("mean"), F.stddev_samp(numeric).alias("sd"), F.grouping_id().alias("level"))
    return out.withColumn("level", F.col("level").cast("int"))


def unit_structure(df: DataFrame, unit: str, names: list[str]) -> DataFrame:
    """Columns that vary inside some unit, and the largest number of rows of a unit."""
    per = df.groupBy(unit).agg(F.count("*").alias("_n"), *[F.count_distinct(c).alias(c) for c in names])
    one = per.agg(F.max("_n").alias("rows"), *[(F.max(c) > 1).alias(c) for c in names])
    return one.unpivot(["rows"], names, "column", "varies")


def imbalance(df: DataFrame, group: str, ratio: float = 3.0, least: int = 10) -> DataFrame:
    """Sizes of the arms with flags: a ratio of sizes above `ratio`, an arm below `least`."""
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    return n.select(group, "n", (F.max("n").over(whole) > ratio * F.min("n").over(whole)).alias("unequal"), (F.col("n") < least).alias("small"))


def scale_evidence(values: DataFrame) -> DataFrame:
    """What tells a log scale from a linear one: range, quartiles, share of zeros. Reported, never guessed from."""
    v = F.when(finite(F.col("value")), F.col("value"))
    return values.agg(F.min(v).alias("least"), F.percentile(v, 0.25).alias("q25"), F.median(v).alias("median"), F.percentile(v, 0.75).alias("q75"), F.max(v).alias("most"), F.avg((F.col("value") == 0).cast("double")).alias("zeros"))


def reconciled(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("only_in", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("only_in", F.lit("right")))


def conserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that a step lost or invented (as a multiset)."""
    lost = before.exceptAll(after).withColumn("change", F.lit("lost"))
    return lost.unionByName(after.exceptAll(before).withColumn("change", F.lit("new")))


def identifier_damage(df: DataFrame, column: str) -> DataFrame:
    """Identifiers that a spreadsheet may have changed: dates, scientific notation, lost zeros among padded ones; groups,
    contaminants, decoys and repeats."""
    c = F.col(column)
    flags = {
        "date": c.rlike(r"(?i)^(\d{1,2}-(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)-\d{1,2})$"),
        "scientific": c.rlike(r"^\d+(\.\d+)?[eE][+-]?\d+$"), "padded": c.rlike(r"^0\d+$"), "bare_number": c.rlike(r"^[1-9]\d*$"),
        "contaminant": c.startswith("CON__"), "decoy": c.startswith("REV__"), "group": F.size(F.split(c, ";")) > 1,
    }
    one = df.agg(*[F.count_if(F.coalesce(f, F.lit(False))).alias(k) for k, f in flags.items()], (F.count(column) - F.count_distinct(column)).alias("repeated"))
    return one.unpivot([], [*flags, "repeated"], "kind", "n")


def concordance(df: DataFrame, signal: str, expected: str, most_flagged: float = 0.2) -> DataFrame:
    """A marker against an annotation (boolean): the signal is split at its widest gap; samples on the wrong side are
    flagged if they also lie in the other side's range; too many flags make the check inconclusive.
    """
    w = Window.partitionBy().orderBy(signal)
    gaps = df.filter(F.col(signal).isNotNull()).select(signal, (F.lead(signal).over(w) - F.col(signal)).alias("gap"))
    cut = gaps.filter("gap is not null").agg(F.max(F.struct("gap", F.col(signal).alias("at"))).alias("m")).select((F.col("m.at") + F.col("m.gap") / 2).alias("cut"))
    high = F.col(signal) > F.col("cut")
    each = df.join(F.broadcast(cut)).withColumn("flagged", F.coalesce(high != F.col(expected), F.lit(False)))
    share = F.avg(F.col("flagged").cast("double")).over(Window.partitionBy())
    outcome = F.when(F.col(signal).isNull() | F.col("cut").isNull(), "not checkable").when(share > most_flagged, "inconclusive").when(F.col("flagged"), "flagged").otherwise("concordant")
    return each.withColumn("outcome", outcome)


def control_samples(samples: DataFrame, listed: DataFrame, name: str = "sample_id", role: str | None = None, pattern: str = r"(?i)(^|[^a-z])(pool|qc|ctrl|control|blank|ref(erence)?)([^a-z]|$)") -> DataFrame:
    """Samples and listed controls with `control` (by name, or by role where there is one) and `state`: agreed, only by rule, only listed, not in the data.

    Both directions of the reconciliation come from one full join; samples that are neither are left out.
    """
    by_name = F.col(name).cast("string").rlike(pattern)
    rule = F.coalesce(by_name | (F.col(role).cast("string").rlike(pattern) if role else F.lit(False)), F.lit(False))
    ours = samples.select(F.col(name).alias("sample"), rule.alias("control")).distinct()
    theirs = listed.select(F.col(name).alias("sample"), F.lit(True).alias("listed")).distinct()
    both = ours.join(theirs, "sample", "full_outer")
    state = F.when(F.col("control").isNull(), "not in the data").when(F.col("control") & F.col("listed").isNotNull(), "agreed").when(F.col("control"), "only by rule").when(F.col("listed").isNotNull(), "only listed")
    return both.withColumn("state", state).filter("state is not null").select("sample", F.coalesce("control", F.lit(False)).alias("control"), "state")


def random_cells(ds: Dataset, raw: DataFrame, cells: int, seed: int = 0) -> DataFrame:
    """Of `cells` cells drawn by a hash of their keys: the value held and the source's text (raw: sample_id, feature_id, text), and whether they agree.

    The draw is the same in every run; a tie in the hash goes by the keys. Agreement is that of the text read as a number; a
    cell without text agrees with a missing value.
    """
    drawn = ds.values.withColumn("_h", F.xxhash64(F.lit(seed), "feature_id", "sample_id")).orderBy("_h", "feature_id", "sample_id").limit(cells)
    joined = drawn.join(raw.select("sample_id", "feature_id", "text"), ["sample_id", "feature_id"], "left")
    number = F.expr("try_cast(text as double)")
    return joined.select("sample_id", "feature_id", "value", "text", F.col("value").eqNullSafe(number).alias("agrees"))


def counts_match(ds: Dataset, raw: DataFrame) -> DataFrame:
    """Rows, samples and features of the data set and of the source (raw: sample_id, feature_id), side by side."""
    sums = lambda df, side: df.agg(F.count("*").alias("cells"), F.count_distinct("sample_id").alias("samples"), F.count_distinct("feature_id").alias("features")).withColumn("side", F.lit(side))
    both = sums(ds.values, "held").unionByName(sums(raw, "source"))
    tall = both.selectExpr("side", "stack(3, 'cells', cells, 'samples', samples, 'features', features) as (what, n)")
    return tall.groupBy("what").agg(F.max(F.when(F.col("side") == "held", F.col("n"))).alias("held"), F.max(F.when(F.col("side") == "source", F.col("n"))).alias("source")).withColumn("agrees", F.col("held") == F.col("source"))


def before_and_after(plain: DataFrame, corrected: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The same test on a matrix and on its corrected form: effects and q of both, and what became of each finding (feature, term)."""
    side = lambda df, s: df.select("feature", "term", F.col("effect").alias(f"effect_{s}"), F.col("q").alias(f"q_{s}"))
    both = side(plain, "plain").join(side(corrected, "corrected"), ["feature", "term"], "full_outer")
    was, now = F.coalesce(F.col("q_plain") <= alpha, F.lit(False)), F.coalesce(F.col("q_corrected") <= alpha, F.lit(False))
    turned = F.signum("effect_plain") * F.signum("effect_corrected") < 0
    return both.withColumn("outcome", F.when(was & now & turned, "turned").when(was & now, "kept").when(was, "lost").when(now, "gained").otherwise("never"))
