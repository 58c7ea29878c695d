"""Do groups or numbers go with a principal component? Rank tests and correlations, permuted with respect to units."""

from __future__ import annotations

import itertools
import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import Refusal
from ..functions.columns import average_rank
from ..functions.special import chi2_sf, t_two_sided
from .differential import mann_whitney

LEAST_RESOLUTION = 20


class ResolutionWarning(UserWarning):
    pass


def scheme(rows: list[dict], label: str, unit: str | None) -> str:
    """rows (no units), between (constant within units) or within."""
    if unit is None:
        return "rows"
    per: dict = {}
    for r in rows:
        per.setdefault(r[unit], set()).add(r[label])
    return "between" if all(len(v) == 1 for v in per.values()) else "within"


def orderings(labels: list) -> int:
    """Distinct arrangements of labels with repeats: an exact integer."""
    out = math.factorial(len(labels))
    for v in set(labels):
        out //= math.factorial(labels.count(v))
    return out


def distinct_arrangements(labels: list):
    """All of them, in lexicographic order of first appearance."""
    kinds = sorted(set(labels), key=labels.index)
    left = {k: labels.count(k) for k in kinds}

    def go(prefix: list):
        if len(prefix) == len(labels):
            yield tuple(prefix)
            return
        for k in kinds:
            if left[k]:
                left[k] -= 1
                yield from go([*prefix, k])
                left[k] += 1

    yield from go([])


def arrangements(rows: list[dict], label: str, unit: str | None, most: int = 9999, seed: int = 0) -> tuple[list[tuple], bool]:
    """Label vectors over rows: every distinct one if there are at most `most`, else that many seeded draws."""
    drawn, _, exact = arranged(rows, label, unit, most, seed)
    return list(drawn), exact


def arranged(rows: list[dict], label: str, unit: str | None, most: int, seed: int) -> tuple[Iterator[tuple], int, bool]:
    """The same one after the other, and how many they are: of many rows, one vector at a time is held."""
    how = scheme(rows, label, unit)
    values = [r[label] for r in rows]
    rng = np.random.default_rng(seed)
    names = [] if how == "rows" else list(dict.fromkeys(r[unit] for r in rows))
    members: dict = {u: [] for u in names}
    for i, r in enumerate(rows if names else ()):
        members[r[unit]].append(i)
    if how == "between":
        first = [values[members[u][0]] for u in names]
        total = orderings(first)
        draws = distinct_arrangements(first) if total <= most else (tuple(first[i] for i in rng.permutation(len(first))) for _ in range(most))
        place = {i: k for k, u in enumerate(names) for i in members[u]}
        return (tuple(d[place[i]] for i in range(len(rows))) for d in draws), min(total, most), total <= most
    blocks = [list(range(len(rows)))] if how == "rows" else [members[u] for u in names]
    total = math.prod(orderings([values[i] for i in b]) for b in blocks)

    def everyone() -> Iterator[tuple]:
        for combo in itertools.product(*[list(distinct_arrangements([values[i] for i in b])) for b in blocks]):
            v = list(values)
            for b, c in zip(blocks, combo):
                for i, x in zip(b, c):
                    v[i] = x
            yield tuple(v)

    def some() -> Iterator[tuple]:
        for _ in range(most):
            v = list(values)
            for b in blocks:
                for i, j in zip(b, rng.permutation(b)):
                    v[i] = values[j]
            yield tuple(v)

    return (everyone() if total <= most else some()), min(total, most), total <= most


def kruskal(scores: DataFrame, group: str, key: list[str]) -> DataFrame:
    """Tie-corrected H of each key (one aggregate over average ranks); null where there are fewer than two groups."""
    ranked = scores.withColumn("_r", average_rank("score", key))
    ties = scores.groupBy(*key, "score").agg(F.count("*").alias("t")).groupBy(*key).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("tie"))
    per = ranked.groupBy(*key, group).agg(F.sum("_r").alias("s"), F.count("*").alias("m")).groupBy(*key).agg(F.sum(F.col("s") ** 2 / F.col("m")).alias("ss"), F.sum("m").alias("n"), F.count("*").alias("groups"))
    h = (12 / (F.col("n") * (F.col("n") + 1)) * F.col("ss") - 3 * (F.col("n") + 1)) / F.nullif(1 - F.col("tie") / (F.pow("n", F.lit(3)) - F.col("n")), F.lit(0.0))
    return per.join(ties, key).select(*key, F.when(F.col("groups") > 1, h).alias("h"), "groups", "n")


def permuted_hits(ranked: pa.Table, observed: dict, rows: list[dict], drawn: Iterator[tuple]) -> dict:
    """Per component, how many of the drawn label vectors have an H of the observed one or more. A component's ranks and ties are
    the same under every labelling (ranked: component, sample_id, score, _r), so one labelling needs its rank sums only."""
    at = {r["sample_id"]: i for i, r in enumerate(rows)}
    place = np.array([at[v] for v in ranked.column("sample_id").to_pylist()], int)
    component, score, rank = (ranked.column(c).to_numpy() for c in ("component", "score", "_r"))
    parts, hits = {}, dict.fromkeys(observed, 0)
    for c in observed:
        mine = component == c
        n, ties = float(mine.sum()), np.unique(score[mine], return_counts=True)[1].astype(float)
        spread = 1 - (ties**3 - ties).sum() / (n**3 - n) if n > 1 else 0.0
        if spread and observed[c]["h"] is not None:
            parts[c] = (place[mine], rank[mine], n, spread, observed[c]["h"] - 1e-9 * abs(observed[c]["h"]))
    code: dict = {}
    for d in drawn:
        labels = np.array([code.setdefault(str(v), len(code)) for v in d], int)
        for c, (where, r, n, spread, bar) in parts.items():
            m = np.bincount(labels[where])
            s = np.bincount(labels[where], r)[m > 0]
            m = m[m > 0]
            h = (12 / (n * (n + 1)) * (s**2 / m).sum() - 3 * (n + 1)) / spread
            hits[c] += bool(len(m) > 1 and h >= bar)
    return hits


def group_tests(scores: DataFrame, samples: DataFrame, label: str, unit: str | None = None, n_permutations: int = 999, seed: int = 0) -> DataFrame:
    """Per component: H, its chi-square p (with two groups also U of the first and the Mann-Whitney p, else null), and the
    permutation p that respects units. A row a sample and component comes to the driver, and one labelling at a time is held."""
    spark = scores.sparkSession
    rows = [r.asDict() for r in samples.filter(F.col(label).isNotNull()).orderBy("sample_ord").select(F.col("sample_id").cast("string").alias("sample_id"), label, *([unit] if unit else [])).collect()]
    if len({r[label] for r in rows}) < 2:
        raise Refusal(f"{label} has a single level")
    s = scores.withColumn("sample_id", F.col("sample_id").cast("string"))
    real = spark.createDataFrame([(r["sample_id"], str(r[label])) for r in rows], "sample_id string, label string")
    told = s.join(F.broadcast(real), "sample_id")
    observed = {r["component"]: r for r in kruskal(told, "label", ["component"]).collect()}
    pairs = {r["component"]: (r["u"], r["p"]) for r in two_groups(told).collect()} if len({str(r[label]) for r in rows}) == 2 else {}
    drawn, n, exact = arranged(rows, label, unit, n_permutations, seed)
    if n <= LEAST_RESOLUTION:
        warnings.warn(f"only {n} arrangements: p cannot be small", ResolutionWarning, stacklevel=2)
    ranked = told.select("component", "sample_id", "score", average_rank("score", ["component"]).alias("_r")).toArrow()
    hits = permuted_hits(ranked, observed, rows, drawn)
    out = []
    for c, r in sorted(observed.items()):
        p = hits[c] / n if exact else (hits[c] + 1) / (n + 1)
        out.append((c, r["h"], chi2_sf(r["h"], r["groups"] - 1) if r["h"] is not None else None, float(p), n, exact, *pairs.get(c, (None, None))))
    return spark.createDataFrame(out, "component int, h double, p_chi2 double, p_permutation double, arrangements int, exact boolean, u double, p_mann_whitney double")


def two_groups(told: DataFrame) -> DataFrame:
    """component, u and p of the rank test between the two labels: a component's scores, one per sample, are one group."""

    def test(part: pd.DataFrame) -> pd.DataFrame:
        first = part["label"] == part["label"].min()
        u, p = mann_whitney(part.loc[first, "score"].to_numpy(float), part.loc[~first, "score"].to_numpy(float))[:2]
        return pd.DataFrame({"component": part["component"].iloc[:1], "u": [float(u)], "p": [float(p)]})

    return told.groupBy("component").applyInPandas(test, "component int, u double, p double")


def correlation_tests(scores: DataFrame, samples: DataFrame, column: str) -> DataFrame:
    """Per component: Pearson r with a number and its t-based p; null without spread."""
    joined = scores.join(F.broadcast(samples.select("sample_id", F.col(column).cast("double").alias("x"))), "sample_id").filter("x is not null")
    rows = joined.groupBy("component").agg(F.corr("score", "x").alias("r"), F.count("*").alias("n"), F.stddev_pop("score").alias("a"), F.stddev_pop("x").alias("b")).orderBy("component").collect()
    out = []
    for r in rows:
        if r["n"] < 3 or not r["a"] or not r["b"]:
            out.append((r["component"], None, None, r["n"]))
            continue
        t = r["r"] * math.sqrt((r["n"] - 2) / max(1e-300, 1 - r["r"] ** 2))
        out.append((r["component"], r["r"], float(t_two_sided(t, r["n"] - 2)), r["n"]))
    return scores.sparkSession.createDataFrame(out, "component int, r double, p double, n long")


def bootstrap_band(samples: DataFrame, scores: DataFrame, column: str, unit: str, component: int = 1, draws: int = 200, seed: int = 0) -> DataFrame:
    """2.5th and 97.5th percentile of the slope of score on a number, over resampled whole units."""
    spark = samples.sparkSession
    rows = scores.filter(F.col("component") == component).join(samples.select("sample_id", F.col(unit).cast("string").alias("u"), F.col(column).cast("double").alias("x")), "sample_id")
    units = sorted(r[0] for r in rows.select("u").distinct().collect())
    rng = np.random.default_rng(seed)
    picks = [(b, units[i]) for b in range(draws) for i in rng.integers(0, len(units), len(units))]
    drawn = spark.createDataFrame(picks, "boot int, u string").groupBy("boot", "u").agg(F.count("*").alias("w"))
    each = drawn.join(rows, "u")
    sums = each.groupBy("boot").agg(*[F.sum(F.col("w") * e).alias(n) for n, e in (("n", F.lit(1.0)), ("sx", F.col("x")), ("sy", F.col("score")), ("sxx", F.col("x") ** 2), ("sxy", F.col("x") * F.col("score")))])
    slope = sums.select(F.expr("try_divide(n * sxy - sx * sy, n * sxx - sx * sx)").alias("slope"))
    return slope.agg(F.percentile("slope", 0.025).alias("low"), F.percentile("slope", 0.975).alias("high"), F.count("slope").alias("draws"))
