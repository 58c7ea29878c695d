"""Nearest neighbours by cosine from balanced posting lists.

Centroids come from spherical k-means on a bounded sample (SAMPLE vectors a list, by hash of the id); there is one for every
LIST_SIZE vectors, at most LISTS, so they fit in every task. Every vector is then indexed: a vector near a boundary goes to
several lists, up to REPLICAS whose distance is within BOUNDARY of its nearest. Long lists are dealt to chunks of CHUNK
vectors and popular ones to groups of CHUNK queries, so a hot vector or list never meets in one task. A query walks a
neighbour graph of the centroids from a fixed start, keeps of the READ nearest lists those whose distance is within PRUNE
times its nearest, and is compared with these lists' vectors; scores are exact cosines of the original vectors in
double precision. What is approximate is only which lists are read; READ does not grow with the table.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without id. A query is
compared with vectors of its own length, each length having an index of its own. Ties go to the smaller id; repeated rows
count once; of several vectors under one id the nearest counts; fewer candidates than k are all returned; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, tidy_shuffles, written

SAMPLE, LISTS, LIST_SIZE = 5, 16_384, 256
REPLICAS, BOUNDARY = 3, 1.2
PRUNE, READ = 1.3, 42
DEGREE, BEAM = 16, 8
CHUNK = 2048
ROUNDS = 8


def valid(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id and vector (array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(id_column).cast("long").alias("id"), v.alias("vector")).filter("id is not null and vector is not null")
    rows = rows.filter("forall(vector, x -> coalesce(abs(x) < double('Infinity'), false)) and exists(vector, x -> x != 0)")
    return rows.dropDuplicates(["id", "vector"])


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column, or one of raw doubles, as a matrix."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


class Lists:
    """Centroids, their neighbour graph, and the list sizes once they are known."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        distinct = np.unique(sample, axis=0)
        lists = max(1, min(lists, len(distinct)))
        self.centroid = distinct[rng.permutation(len(distinct))[:lists]].copy()
        for _ in range(ROUNDS):
            near = np.argmax(distinct @ self.centroid.T, axis=1)
            total = np.zeros_like(self.centroid)
            np.add.at(total, near, distinct)
            norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
            self.centroid = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), self.centroid)
        close = self.centroid @ self.centroid.T
        # nearest centroids, and a ring so that every list can be reached
        ring = (np.arange(lists)[:, None] + np.array([1, max(1, lists // 2)])) % lists
        self.graph = np.concatenate([np.argsort(-close, axis=1, kind="stable")[:, : DEGREE + 1], ring], axis=1)
        self.size = np.zeros(lists, np.int64)

    def homes(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and lists: each vector's nearest list and those near enough to it."""
        distance = np.sqrt(np.maximum(0, 2 - 2 * (u @ self.centroid.T)))
        k = min(REPLICAS, distance.shape[1])
        best = np.argpartition(distance, k - 1, axis=1)[:, :k]
        d = np.take_along_axis(distance, best, axis=1)
        row, col = np.nonzero(d <= BOUNDARY * d.min(axis=1, keepdims=True) + 1e-12)
        return row, best[row, col]

    def walk(self, q: np.ndarray, want: int) -> list[int]:
        """The `want` centroids nearest to q that a best-first walk over the graph meets, nearest first."""
        n = len(self.centroid)
        seen = np.zeros(n, bool)
        score = np.full(n, -np.inf)
        front = np.unique(np.linspace(0, n - 1, min(n, BEAM)).astype(int))
        opened = np.zeros(n, bool)
        while len(front):
            fresh = front[~seen[front]]
            seen[fresh] = True
            score[fresh] = self.centroid[fresh] @ q
            met = np.nonzero(seen)[0]
            keep = met[np.argsort(-score[met], kind="stable")[:want]]
            todo = keep[~opened[keep]][:BEAM]
            opened[todo] = True
            front = np.unique(self.graph[todo].ravel()) if len(todo) else todo
        return keep.tolist()

    def probes(self, q: np.ndarray, k: int) -> list[int]:
        n = len(self.centroid)
        order = self.walk(q, min(n, READ))
        distance = np.sqrt(np.maximum(0, 2 - 2 * (self.centroid[order] @ q)))
        keep = [c for c, d in zip(order, distance) if d <= PRUNE * distance[0] + 1e-12]
        held = self.size[keep].sum()
        for c in order[len(keep) :]:  # replicas and the query itself do not count twice: ask for plenty
            if held > REPLICAS * (k + 1) * 4:
                break
            keep.append(c)
            held += self.size[c]
        if held <= REPLICAS * (k + 1) * 4:
            keep = list(range(n))
        return keep


def _lists(rows: DataFrame) -> Lists:
    n = rows.count()
    lists = max(1, min(LISTS, n // LIST_SIZE))
    wanted = SAMPLE * max(lists, 1000)
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    some = rows.filter(h < int((1 << 30) * min(1.0, 1.5 * wanted / max(1, n))))  # so no task sends many
    drawn = some.orderBy(h, "id").limit(wanted).select("vector").toArrow()["vector"]
    return Lists(unit(matrix(drawn.combine_chunks())), lists)


def nearest(df: DataFrame, queries: str, k: int = 5, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for the rows that satisfy `queries`, the k nearest other rows found."""
    spark = df.sparkSession
    with tidy_shuffles(spark):
        every = written(valid(df, id_column, vector).withColumn("dim", F.size("vector")), "vectors")
        asked = every.withColumnRenamed("id", id_column).filter(queries).withColumnRenamed(id_column, "id")
        dims = sorted(r["dim"] for r in asked.select("dim").distinct().collect())
    found = spark.createDataFrame([], FOUND)
    for dim in dims:
        found = found.union(_found(every.filter(F.col("dim") == dim).drop("dim"), asked.filter(F.col("dim") == dim).drop("dim"), k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(best)).filter(f"rank <= {int(k)}")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


FOUND = "query_id long, vec_id long, score double"


def _found(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Of vectors and queries of one length: the k nearest of each list that a query reads."""
    spark = rows.sparkSession
    with tidy_shuffles(spark):
        lists = _lists(rows)

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = matrix(b.column(1)) if b.num_rows else np.zeros((0, 1))
                if not len(v):
                    continue
                row, home = lists.homes(unit(v))
                raw = [x.tobytes() for x in v]
                yield pa.RecordBatch.from_arrays([pa.array(home), b.column(0).take(pa.array(row)), pa.array(raw, pa.binary()).take(pa.array(row))], names=["list", "id", "raw"])

        posted = written(rows.mapInArrow(post, "list long, id long, raw binary"), "postings")
        # at most LISTS rows each
        sizes = {r["list"]: r["count"] for r in posted.groupBy("list").count().collect()}
        for c, n in sizes.items():
            lists.size[c] = n

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                v = matrix(b.column(1))
                probes = [lists.probes(q, k) for q in unit(v)]
                at = np.repeat(np.arange(len(v)), [len(p) for p in probes])
                raw = [x.tobytes() for x in v]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(probes).astype(np.int64)), b.column(0).take(pa.array(at)), pa.array(raw, pa.binary()).take(pa.array(at))], names=["list", "id", "raw"])

        tasks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        routed = written(asked.repartition(tasks).mapInArrow(route, "list long, id long, raw binary"), "routed")
        wanted = {r["list"]: r["count"] for r in routed.groupBy("list").count().collect()}
        grid = spark.createDataFrame([(int(c), -(-n // CHUNK), -(-wanted.get(c, 0) // CHUNK)) for c, n in sizes.items()], "list long, chunks long, groups long").filter("groups > 0")
        grid = F.broadcast(grid)
        base = posted.join(grid, "list").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks"))).withColumn("group", F.explode(F.expr("sequence(0L, groups - 1)"))).withColumn("asks", F.lit(0))
        asks = routed.join(grid, "list").withColumn("group", F.pmod(F.xxhash64("id"), F.col("groups"))).withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)"))).withColumn("asks", F.lit(1))
        columns = ["list", "chunk", "group", "asks", "id", "raw"]
        both = base.select(columns).union(asks.select(columns)).repartition(tasks, "list", "chunk", "group").sortWithinPartitions("list", "chunk", "group", "asks", "id")
        found = written(both.mapInArrow(lambda batches: _compare(batches, k), FOUND), "found")
        discard(posted)
        discard(routed)
    return found


def _compare(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by (list, chunk, group), vectors before queries: each query against the vectors of its cell."""
    cell, ids, vectors, done = None, [], [], None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(i).to_numpy() for i in range(4)], axis=1)
        cut = np.append(0, np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1)
        for a, z in zip(cut, np.append(cut[1:], len(key))):
            here, asks = tuple(key[a, :3]), key[a, 3]
            part_ids, part = b.column(4).slice(a, z - a).to_numpy(), matrix(b.column(5).slice(a, z - a))
            if here != cell:
                cell, ids, vectors, done = here, [], [], None
            if not asks:
                ids.append(part_ids)
                vectors.append(part)
                continue
            if not ids:
                continue
            if done is None:
                v = np.concatenate(vectors)
                done = np.concatenate(ids), v, np.sqrt((v * v).sum(axis=1)), unit(v)
            yield from _best(part_ids, part, *done, k)


def _best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, norm: np.ndarray, u: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    out: list[list] = [[], [], []]
    rough = unit(q) @ u.T
    for i, qid in enumerate(query_ids):
        s = np.where(ids == qid, -np.inf, rough[i])
        least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -2.0
        near = np.nonzero(s >= max(least, -2.0) - 1e-9)[0]
        exact = (v[near] * q[i]).sum(axis=1) / (norm[near] * np.sqrt((q[i] * q[i]).sum()))
        best = np.lexsort((ids[near], -exact))[:k]
        for column, values in zip(out, (np.full(len(best), qid), ids[near][best], exact[best])):
            column.append(values)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])
