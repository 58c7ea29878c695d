"""Products of all pairs of samples, summed over features in blocks.

A feature's cells travel once, as one row; a task multiplies its features as a matrix and sends on one n x n sum, so the
n^2 products of every feature never become rows. Sums of two tasks are added by sample. More than MOST samples are cut into
tiles instead: a sample's cells are one row, which goes to each pair of tiles with its own, and nothing else travels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 2048  # samples whose sums fit in a task: four matrices of them take 134 MB
BLOCK = 256  # features multiplied at once
TILES, LEAST_TILE, MOST_TILE = 16, 256, 4096  # so many tiles of samples, each of a size between these


def packed(values: DataFrame, order: DataFrame) -> DataFrame:
    """feature_id, at and x: the places (by order: sample_id, i) and values of each feature's cells."""
    rows = values.join(F.broadcast(order), "sample_id")
    return rows.groupBy("feature_id").agg(F.collect_list(F.struct("i", "value")).alias("c")).select("feature_id", F.col("c.i").alias("at"), F.col("c.value").alias("x"))


def summed(values: DataFrame, order: DataFrame, n: int, shared: bool) -> DataFrame:
    """i and, as arrays over the other samples: xy, the sum of products; with shared also n, x and xx, the number of
    features both samples have and the sums of this one's values and squares over these."""
    names = ("xy", "n", "x", "xx") if shared else ("xy",)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), n, n))
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x, m = np.zeros((part.num_rows, n)), np.zeros((part.num_rows, n))
                for k, (places, cells) in enumerate(zip(part.column("at"), part.column("x"))):
                    places = places.values.to_numpy()
                    x[k, places], m[k, places] = cells.values.to_numpy(), 1
                total[0] += x.T @ x
                if shared:
                    total[1] += m.T @ m
                    total[2] += x.T @ m
                    total[3] += (x * x).T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), *[pa.array([row.tobytes() for row in t], pa.binary()) for t in total]], names=["i", *names])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        sums = {k: [np.sum([np.frombuffer(r) for r in part[k]], axis=0)] for k in names}
        return pd.DataFrame({"i": part["i"].iloc[:1].to_numpy(), **sums})

    each = packed(values, order).select("at", "x").mapInArrow(products, "i long, " + ", ".join(f"{k} binary" for k in names))
    return each.groupBy("i").applyInPandas(add, "i long, " + ", ".join(f"{k} array<double>" for k in names))


def numbered(values: DataFrame, key: str, name: str) -> DataFrame:
    """Each value of key, and its place in their order from 0 as name."""
    return values.select(key).distinct().withColumn(name, F.row_number().over(Window.orderBy(key)) - 1)


def tiled(values: DataFrame, places: DataFrame) -> tuple[DataFrame, int]:
    """sample_id, i (its place in their order), t (its tile), at and x (places of its features, by places: feature_id, j, and
    their values): a row a sample with any value; and the number of tiles."""
    order = numbered(values, "sample_id", "i")
    n = order.count()
    size = min(MOST_TILE, max(LEAST_TILE, -(-n // TILES)))
    rows = values.join(F.broadcast(places), "feature_id").groupBy("sample_id").agg(F.collect_list(F.struct("j", "value")).alias("c"))
    rows = rows.join(order, "sample_id").select("sample_id", "i", F.floor(F.col("i") / size).cast("int").alias("t"), F.col("c.j").alias("at"), F.col("c.value").alias("x"))
    return rows, max(1, -(-n // size))


def meeting(rows: DataFrame, key: Column, tasks: int) -> DataFrame:
    """rows of tiled() for each key of an array, those of a key side by side and in order."""
    spread = rows.select(F.explode(key).alias("k"), "*").repartition(max(1, min(tasks, 1024)), "k")
    return spread.sortWithinPartitions("k", "i")


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each k, where they come side by side."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        k = b.column("k").to_numpy()
        edges = [0, *(np.nonzero(np.diff(k))[0] + 1).tolist(), len(k)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if held and hi > lo and held[0].column("k")[0].as_py() != k[lo]:
                yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def cells(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature place and value of each cell."""
    at, x = (rows.column(c).combine_chunks() for c in ("at", "x"))
    lengths = at.value_lengths().to_numpy()
    return np.repeat(np.arange(len(lengths)), lengths), at.flatten().to_numpy(), x.flatten().to_numpy()
