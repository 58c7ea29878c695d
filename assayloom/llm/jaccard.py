"""Similarity join of whole texts on word-shingle sets: universe partition, pigeonhole, exact verification.

Two sets with Jaccard similarity t or more differ in at most H = (1-t)/(1+t) * (|A|+|B|) elements. Sets fall into
size bands; in a band, hashing deals the universe into m segments, m above H. Sets that differ in at most H elements
differ in at most H segments, so they agree in at least m - H; hence in any one order of (segment, content) their first
H+t share t of them. A set is indexed under that subset of its segments only. The order is the cost model: contents of
many elements come first, as they are the rarest, and empty segments, which cost most, come last. H+t is 9/20 of the set's
size, so a set must share about a fifth of its entries (`least_common`) with others to have any partner: documents that
merely share a passage drop out by counting. The smallest sets (where H is 1) use a single segment with its one-deletion
neighbourhood. A set whose partners may lie in the next band is indexed there too.

Equal sets are one class from the start, named by a 64-bit fingerprint, so copies never multiply. Segments that only one
class holds vanish. For the classes left, entries are allocated anew by exact cost, in the finest partition, one shingle a
segment: the H+1 shingles that the fewest classes have; shingles nobody else has drop out, and as two classes differ in
those of both, and in every bit in which their parity sketches differ, nearly all other pairs are refuted by counts alone. A class is first compared with the hub it shares most entries
with; classes linked so far are one component, and only pairs from different components of a common entry are compared
further, some hubs of each entry a round, until every such pair is linked or refuted. A pair is only wanted at the first
entry it shares: each entry carries the few that precede it in its class, and where two such lists overlap an earlier
shared entry exists, so the pair is passed over here and met there. Every comparison is exact, on the sorted 64-bit shingle numbers (two different shingles of a pair collide with a chance of 2^-64).

Defined cases: a null text is an empty one; a text without words has no shingle and links with nothing; texts of fewer
words than a shingle are one shingle of all their words; repeated rows and exact copies are one class and keep all their
rows; very long texts are read in stretches; rows without doc_id take part in links (a component's id is the least id
there is in it, null if there is none); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import SALTS, Powers, Words, give_back, mix, row_batches
from .common import discard, tidy_shuffles, written

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
BROADCAST_IDS = 1_000_000  # beyond it, texts are joined with the wanted ids by a shuffle
SKETCH = 8  # words of 64 bits
HUBS = 4  # hubs a segment in the first round; four times as many in each further one
BEFORE = 6  # entries before each one that it carries, to tell whether a pair has met already


def lows(top: int) -> np.ndarray:
    """Least size of each band."""
    out = [1, 6]
    while out[-1] <= top:
        out.append(out[-1] * 4)
    return np.array(out)


LOWS = lows(2**40)


def segments(band: np.ndarray) -> np.ndarray:
    """Segments of the universe in each band: above the greatest H of the band, and few of them empty."""
    return np.where(band == 0, 1, 4 * LOWS[band])


def largest_partner(n: np.ndarray) -> np.ndarray:
    return n * DENOMINATOR // NUMERATOR


def most_apart(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """H for sizes n and m."""
    return (n + m) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def indexed_under(n: np.ndarray) -> np.ndarray:
    """Entries of a set of size n: enough for pigeonhole with its largest partner, and 9/20 of its size at least."""
    return np.maximum(most_apart(n, largest_partner(n)) + 1, n * 9 // 20)


def least_common(n: np.ndarray) -> np.ndarray:
    """Entries that a set of size n shares with any partner, at least: min over partners m of entries(smaller) - H(n, m)."""
    small = -(-n * NUMERATOR // DENOMINATOR)
    down = indexed_under(small) - most_apart(n, small) - 1  # grows with m but for rounding
    up = indexed_under(n) - most_apart(n, largest_partner(n))
    return np.maximum(1, np.minimum(down, up))


class Sets:
    """Distinct shingles of each text of a batch: value (sorted within a text), first, size, fingerprint."""

    def __init__(self, texts: pa.Array, words: int = WORDS, powers: Powers | None = None):
        shingle, first = Words(texts, powers).shingles(words)
        parts = []
        for a, b in zip(first[:-1], first[1:]):
            part = np.sort(shingle[a:b])
            parts.append(part[np.append(True, part[1:] != part[:-1])] if len(part) > 1 else part)
        self.size = np.array([len(p) for p in parts], np.int64)
        self.value = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.scrambled = mix(self.value ^ SALTS[40])
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.scrambled, dtype=np.uint64)])
        self.total = total[self.first[1:]] - total[self.first[:-1]]
        self.fp = mix(self.total + self.size.astype(np.uint64) * SALTS[41]).view(np.int64)


def signatures(sets: Sets, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the chosen sets, the set of each, and its band."""
    out_sig, out_set, out_band = [], [], []
    size, band = sets.size[chosen], np.searchsorted(LOWS, sets.size[chosen], "right") - 1
    for i in chosen[(band == 0) & (size >= 3)]:  # smaller sets link with equal ones only
        part = sets.scrambled[sets.first[i] : sets.first[i + 1]]
        out_sig.append(mix(np.append(sets.total[i], sets.total[i] - part) ^ SALTS[42]))
        out_set.append(np.full(len(part) + 1, i))
        out_band.append(np.zeros(len(part) + 1, np.int64))
    partner = largest_partner(size)
    above = partner >= LOWS[band + 1]
    for which, bands in ((chosen[band > 0], band[band > 0]), (chosen[above], band[above] + 1)):
        if not len(which):
            continue
        n, m, take = sets.size[which], segments(bands), indexed_under(sets.size[which])
        owner = np.repeat(np.arange(len(which)), n)
        element = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(sets.first[which], n)
        value = sets.scrambled[element]
        base = np.cumsum(m) - m
        segment = (mix(value ^ SALTS[43]) % m[owner].astype(np.uint64)).astype(np.int64) + base[owner]
        held = np.bincount(segment, minlength=m.sum())
        order = np.argsort(segment)
        filled = np.nonzero(held)[0]
        total = np.zeros(m.sum(), np.uint64)
        total[filled] = np.add.reduceat(value[order], np.cumsum(held[filled]) - held[filled])
        whose = np.repeat(np.arange(len(which)), m)
        place = (np.arange(m.sum()) - base[whose] + bands[whose] * 1_000_003).astype(np.uint64)
        content = mix(total + place * SALTS[44])
        rank = (np.uint64(63) - np.minimum(held, 63).astype(np.uint64)) << np.uint64(58) | content >> np.uint64(6)
        # one sort of (text, rank): texts lie in order, so sorting each slice of segments is enough
        for k, (a, b) in enumerate(zip(base, base + m)):
            part = rank[a:b]
            t = take[k]
            out_sig.append(np.partition(part, t - 1)[:t] if t < len(part) else part)
            out_set.append(np.full(min(t, len(part)), which[k]))
            out_band.append(np.full(min(t, len(part)), bands[k]))
    if not out_sig:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_sig).view(np.int64), np.concatenate(out_set), np.concatenate(out_band)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def classes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and the fingerprint of the set (null where there is none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in row_batches(batches):
            s = Sets(b.column(1), words, powers)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.size), pa.array(s.fp, mask=s.size == 0)], names=["doc_id", "n_shingles", "fp"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, fp long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def indexed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """sig, fp, size and band: what each class is indexed under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = Powers(), set()  # exact copies within a task count once
        for b in row_batches(batches):
            s = Sets(b.column(1), words, powers)
            _, once = np.unique(s.fp, return_index=True)
            once = np.array([i for i in once.tolist() if s.size[i] and s.fp[i] not in seen], np.int64)
            seen.update(s.fp[once].tolist())
            sig, of, band = signatures(s, once)
            yield _batch(sig=sig, fp=s.fp[of], n=s.size[of], band=band)

    return _texts(docs).mapInArrow(run, "sig long, fp long, n long, band long")


def sets_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in row_batches(batches):
            s = Sets(b.column(1), words, powers)
            raw = [s.value[x:y].tobytes() for x, y in zip(s.first[:-1], s.first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(s.fp), pa.array(raw, pa.binary())], names=["fp", "elements"])

    return _texts(docs).mapInArrow(run, "fp long, elements binary")


def sketches_of(sets: DataFrame) -> DataFrame:
    """fp and SKETCH longs: the parity of how many elements fall on each bit. Each element in which two sets differ turns
    one bit over, so sets whose sketches differ in more than H bits do not link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = np.zeros((b.num_rows, SKETCH), np.uint64)
            for i, raw in enumerate(b.column(1)):
                at = mix(np.frombuffer(raw.as_buffer(), np.uint64) ^ SALTS[45]) % np.uint64(64 * SKETCH)
                odd = np.nonzero(np.bincount(at.astype(np.int64), minlength=64 * SKETCH) & 1)[0]
                np.bitwise_or.at(words[i], odd // 64, np.uint64(1) << (odd % 64).astype(np.uint64))
            yield _batch(fp=b.column(0).to_numpy(), **{f"k{j}": words[:, j].view(np.int64) for j in range(SKETCH)})

    return sets.select("fp", "elements").mapInArrow(run, "fp long, " + ", ".join(f"k{j} long" for j in range(SKETCH)))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = DENOMINATOR * common >= NUMERATOR * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
        give_back()

    # sets stay where they are unless a pair names them: while pairs are few they go to the sets, not the sets to them
    few = pairs.count() <= BROADCAST_IDS
    near = F.broadcast if few else lambda df: df
    left = sets.withColumnsRenamed({"fp": "a", "elements": "x"}).join(near(pairs), "a")
    right = sets.join(near(pairs.select(F.col("b").alias("fp")).distinct()), "fp", "left_semi").withColumnsRenamed({"fp": "b", "elements": "y"})
    return left.join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """node and root (least node reachable) of the nodes of links (a, b): minimum labels, with pointer jumping."""
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    edges = written(both, tag + "-edges")
    now = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), tag)
    while True:
        root = now.select(F.col("node").alias("b"), F.col("root").alias("r"))
        near = edges.join(root, "b").groupBy("a").agg(F.min("r").alias("near"))
        jump = now.join(now.select(F.col("node").alias("root"), F.col("root").alias("far")), "root")
        step = jump.join(near, jump["node"] == near["a"]).select("node", F.least("far", "near").alias("new"), "root")
        after = written(step.select("node", F.col("new").alias("root"), (F.col("new") < F.col("root")).alias("moved")), tag)
        discard(now)
        moved = after.filter("moved").limit(1).count()
        now = after
        if not moved:
            discard(edges)
            return now


def joined(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, class fingerprint and root (least fingerprint reachable by links; null where empty)."""
    spark = docs.sparkSession
    with tidy_shuffles(spark):
        members = written(classes(docs, words), "classes")
        by_sig = Window.partitionBy("sig")
        index = indexed(docs, words).withColumn("least", F.min("fp").over(by_sig)).withColumn("most", F.max("fp").over(by_sig))
        held = written(index.filter("least < most").select("sig", "fp", "n", "band"), "held")
        held = _counted(held)
        if not held.isEmpty():
            held = _allocated(docs, words, members, held)
        roots = None if held.isEmpty() else _rounds(docs, words, members, held)
    if roots is None:
        return members.withColumn("root", F.col("fp"))
    return members.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _shared(index: DataFrame) -> DataFrame:
    """The entries that two classes or more have."""
    return index.groupBy("sig").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least < most").select("sig")


def _counted(held: DataFrame) -> DataFrame:
    """held without the classes that share too little to have a partner, over again until hardly any more go."""
    rows = held.count()
    while rows:
        own = held.groupBy("fp", "n", "band").count()
        enough = own.filter(F.col("band").eqNullSafe(0) | (F.col("count") >= least_common_sql(F.col("n")))).select("fp", "band")
        left = held.join(enough, ["fp", "band"], "left_semi")
        after = written(left.join(_shared(left), "sig", "left_semi"), "held")
        discard(held)
        before, rows, held = rows, after.count(), after
        if rows > 0.8 * before:
            break
    return held


def elements(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """sig, fp, n: every shingle of every class, as the finest entries there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in row_batches(batches):
            s = Sets(b.column(1), words, powers)
            yield _batch(sig=s.value.view(np.int64), fp=np.repeat(s.fp, s.size), n=np.repeat(s.size, s.size))

    return _texts(docs).mapInArrow(run, "sig long, fp long, n long")


def _allocated(docs: DataFrame, words: int, members: DataFrame, held: DataFrame) -> DataFrame:
    """Entries by exact cost, for the classes left: of all their shingles, the H+1 that the fewest classes have.

    Shingles that nobody else has cannot find a partner and go. Two classes meet at their first common shingle, in the
    order of cost, if they link; what precedes it in either is not in the other. So each entry carries `own`, the number of
    its class's shingles before it, and a pair there differs in those of both.
    """
    some = written(held.select("fp").distinct().join(members, "fp").groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "some")
    full = _of_classes(elements(only(docs, some.select("doc_id").distinct(), True), words), some)
    by_sig, by_class = Window.partitionBy("sig"), Window.partitionBy("fp")
    alone = F.min("fp").over(by_sig) == F.max("fp").over(by_sig)
    full = full.withColumn("alone", alone).withColumn("cost", F.when(F.col("alone"), 1).otherwise(F.count("*").over(by_sig)))
    ranked = full.withColumn("at", F.dense_rank().over(by_class.orderBy("cost", "sig")).cast("long"))
    apart = F.floor((F.col("n") + F.floor(F.col("n") * DENOMINATOR / NUMERATOR)) * (DENOMINATOR - NUMERATOR) / (DENOMINATOR + NUMERATOR))
    kept = ranked.filter(~F.col("alone") & (F.col("at") <= apart + 1)).select("sig", "fp", "n", (F.col("at") - 1).alias("own")).distinct()
    before = F.collect_list("sig").over(by_class.orderBy("own").rowsBetween(-BEFORE, -1))
    out = written(kept.withColumn("before", before), "allocated")
    discard(held)
    discard(some)
    return out


def least_common_sql(n: Column) -> Column:
    """least_common as an expression."""
    small = F.ceil(n * NUMERATOR / DENOMINATOR).cast("long")
    large = F.floor(n * DENOMINATOR / NUMERATOR).cast("long")
    apart = lambda x, y: F.floor((x + y) * (DENOMINATOR - NUMERATOR) / (DENOMINATOR + NUMERATOR)).cast("long")
    under = lambda x: F.greatest(apart(x, F.floor(x * DENOMINATOR / NUMERATOR).cast("long")) + 1, F.floor(x * 9 / 20).cast("long"))
    return F.greatest(F.lit(1), F.least(under(small) - apart(n, small) - 1, under(n) - apart(n, large)))


def _rounds(docs: DataFrame, words: int, members: DataFrame, held: DataFrame) -> DataFrame:
    """Components of the classes in held: the hub of most common segments first, then hub by hub."""
    fits = f"least(n, hn) * {DENOMINATOR} >= greatest(n, hn) * {NUMERATOR} and own + hown <= floor((n + hn) * {DENOMINATOR - NUMERATOR} / {DENOMINATOR + NUMERATOR})"
    first = F.min(F.struct("own", "fp", "n")).alias("hub")
    best = (
        held.join(held.groupBy("sig").agg(first), "sig").select("fp", "n", "own", F.col("hub.fp").alias("hub"), F.col("hub.n").alias("hn"), F.col("hub.own").alias("hown"))
        .filter("fp != hub").filter(fits).groupBy("fp", "hub").count()
        .groupBy("fp").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("hub"))
    )
    sets = _wanted_sets(docs, words, members, held)
    sketches = written(sketches_of(sets), "sketches")
    turned = " + ".join(f"bit_count(k{j} ^ h{j})" for j in range(SKETCH))
    close = f"{turned} <= floor((n + hn) * {DENOMINATOR - NUMERATOR} / {DENOMINATOR + NUMERATOR})"
    pairs = written(best.select(F.col("fp").alias("a"), F.col("hub").alias("b")), "pairs")
    links = written(verified(pairs, sets), "links")
    roots = components(links, "roots")
    discard(pairs)
    discard(links)
    hubs, peeled, last = HUBS, 0, held
    while True:
        # segments that still join classes of different components
        now = held.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        # a pair's first shared entry stays open until the pair is compared or linked, so nothing is lost by passing over others
        open_ = now.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).filter(f"x < y and size > {peeled + 1}").select("sig")
        now = written(now.join(open_, "sig"), "open")
        discard(last)
        last = now
        if now.isEmpty():
            for done in (now, sets, sketches):
                discard(done)
            return roots
        order = F.row_number().over(_by_sig())
        ranked = now.withColumn("at", order).join(sketches, "fp")
        middle = ranked.filter((F.col("at") > peeled) & (F.col("at") <= peeled + hubs)).select("sig", F.col("fp").alias("hub"), F.col("n").alias("hn"), F.col("own").alias("hown"), F.col("root").alias("hroot"), F.col("at").alias("hat"), F.col("before").alias("hbefore"), *[F.col(f"k{j}").alias(f"h{j}") for j in range(SKETCH)])
        pairs = ranked.join(middle, "sig").filter("at > hat and root != hroot").filter(fits).filter("not arrays_overlap(before, hbefore)").filter(close)
        pairs = written(pairs.select(F.greatest("fp", "hub").alias("a"), F.least("fp", "hub").alias("b")).distinct(), "pairs")
        new = written(verified(pairs, sets), "links")
        discard(pairs)
        if not new.isEmpty():
            known = roots.select("node", "root")
            of = known.withColumnsRenamed({"node": "b", "root": "rb"})
            lifted = new.join(known.withColumnsRenamed({"node": "a", "root": "ra"}), "a", "left").join(of, "b", "left")
            ends = lifted.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
            ends = written(ends.filter("a != b"), "ends")
            parts = components(ends, "merged")
            merged = parts.withColumnRenamed("root", "to")
            old = known.join(merged.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            fresh = merged.join(known, "node", "left_anti").select("node", F.col("to").alias("root"))
            former, roots = roots, written(old.union(fresh), "roots")
            for done in (ends, parts, former):
                discard(done)
        discard(new)
        held = now.select("sig", "fp", "n", "own", "before")
        peeled += hubs
        hubs *= 4


def _by_sig():
    return Window.partitionBy("sig").orderBy("own", "fp")


def only(docs: DataFrame, ids: DataFrame, nulls: bool = False) -> DataFrame:
    """docs of these ids: by broadcast while the ids are few enough, else by a shuffle join; nulls: rows without id too."""
    some = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi").select(*docs.columns)
    return some.union(docs.filter("doc_id is null")) if nulls else some


def _of_classes(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows of the wanted classes: a document read for its id, or for want of one, may hold another class."""
    return rows.join(wanted.select("fp").distinct(), "fp", "left_semi").select(*rows.columns)


def _wanted_sets(docs: DataFrame, words: int, members: DataFrame, held: DataFrame) -> DataFrame:
    """Elements of the classes in held, each from one of its documents."""
    ids = written(members.join(held.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "wanted")
    sets = sets_of(only(docs, ids.select("doc_id").distinct(), True), words)
    out = written(_of_classes(sets, ids).groupBy("fp").agg(F.first("elements").alias("elements")), "sets")
    discard(ids)
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id reachable by links, itself included."""
    of = joined(docs, words)
    least = of.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return of.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, words: int = WORDS, nulls: bool = False) -> DataFrame:
    """docs without those that a smaller doc_id of their component stands for; of rows with one doc_id, one stays.

    Rows without doc_id go, unless `nulls`: then those without words stay, and of each component that holds no id at all,
    one row does.
    """
    of = written(joined(docs, words), "joined")
    least = of.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = of.join(least, "root", "left")
    kept = written(named.filter("doc_id = coalesce(component_id, doc_id)").groupBy("doc_id").count(), "kept")
    out = only(docs, kept.select("doc_id"))
    if not kept.filter("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id"])
    if not nulls or of.filter("doc_id is null").isEmpty():
        discard(of)
    else:
        lone = named.filter("doc_id is null and (root is null or component_id is null and fp = root)").select(F.col("fp").alias("_fp")).distinct()
        bare = _with_fp(docs.filter("doc_id is null"), words).join(lone, F.expr("fp_of_row <=> _fp")).drop("_fp")
        first = bare.filter("fp_of_row is not null").dropDuplicates(["fp_of_row"]).unionAll(bare.filter("fp_of_row is null"))
        out = out.unionAll(first.select("row.*"))
    return out


def _with_fp(docs: DataFrame, words: int) -> DataFrame:
    """row (all columns of docs) and fp_of_row: the fingerprint of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in row_batches(batches):
            s = Sets(b.column(0), words, powers)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(s.fp, mask=s.size == 0)], names=["row", "fp_of_row"])

    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, fp_of_row long")


# The same in SQL, by all shared shingles: for small tables.
ORACLE = r"""
with recursive w as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select r, doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from w),
e as (select r, unnest(s) g from s),
c as (select a.r x, b.r y, count(*) k from e a join e b using (g) where a.r < b.r group by all),
l as (select x, y from c join s a on a.r = x join s b on b.r = y where 100 * k >= 75 * (len(a.s) + len(b.s) - k)),
d as (select x, y from l union all select y, x from l),
t(r, z) as (select r, r from s union select t.r, d.y from t join d on d.x = t.z)
select s.doc_id, len(s.s)::bigint n_shingles, min(o.doc_id)::bigint component_id from s join t using (r) join s o on o.r = t.z group by s.r, s.doc_id, s.s
"""
