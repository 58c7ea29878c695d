r"""Mixing sources to target weights, in DataFrame expressions only.

1. Every source's words form one stream, cut into blocks of BLOCK words (the last may be shorter).
2. Targets: each source's share of `budget` times all words by weight, at most `repeat` times its own size, the excess
   shared again by weight (water-filling, in closed form over the sources sorted by cap over weight).
3. A source fills as many output slots as its target holds blocks. The slots of all sources take the places of the
   output by one pseudorandom permutation, so the source counts of an output shard are a draw without replacement:
   multinomial given that the totals over all shards are the targets, which independent draws would miss.
4. Slot j of a source takes block permutation(j) of the source, another permutation in each epoch (pass over the
   source), so a block is taken once an epoch and no word more than `repeat` times. The permutations are swap-or-not
   shuffles, which work on any range without a table.
5. Slots and the blocks that documents cover are joined by (source, block).

Positions in a source's stream come from two running sums, over buckets and inside a bucket, so a hot source is spread
over as many tasks as it has buckets. Only ids and sizes are shuffled.

`mixed_documents` returns the mix in its order: whole shards together, and in each the documents by the place of the
first block taken, so a reader of one file meets the sources as they were mixed.

Defined cases: a null text is an empty one; a text without words has taken 0; the null source is a source, last in
order; rows without doc_id are documents like others; repeated rows are documents of their own; very long texts are
dealt block by block; an empty table gives no rows; extra columns are ignored (and kept by `mixed_documents`, whatever
their names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK, SHARD, BUCKET, CHUNK, ROUNDS = 64, 4096, 512, 8192, 12
WEIGHTS, BUDGET, REPEAT = (5, 2, 1), 1.5, 2
SPACES = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text (null: 0), without building the words."""
    marked = F.regexp_replace(F.concat(F.lit("a "), F.coalesce(text, F.lit(""))), f"[{SPACES}]*+[^{SPACES}]++[{SPACES}]*+", "x")
    return F.length(marked).cast("long") - 1


def sized(docs: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, source, text number, size) and the number of such rows."""
    text = F.col("text").cast("string")
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("h"), word_count(text).alias("size"))
    return each.groupBy("doc_id", "source", "h", "size").agg(F.count("*").alias("rows"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeat: int = REPEAT) -> DataFrame:
    """Per source: its number s, source_size, target, blocks and slots; first: its first slot; slots_all."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    per = per.withColumn("s", F.row_number().over(by_name).cast("long"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("s") - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * float(repeat)
    by_ratio, whole = Window.orderBy(F.col("source_size") / F.col("weight"), "s"), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * budget - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    per = per.withColumn("target", F.least(cap, F.col("weight") * F.max("level").over(whole)))
    per = per.withColumn("blocks", F.ceil(F.col("source_size") / float(BLOCK)).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    per = per.withColumn("slots", F.least(slots, F.col("blocks") * repeat))
    first = F.coalesce(F.sum("slots").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("first", first).withColumn("slots_all", F.sum("slots").over(whole))
    return per.select("source", "s", "source_size", "target", "blocks", "slots", "first", "slots_all")


def permuted(value: str, n: str, key: str) -> Column:
    """A pseudorandom permutation (named by key) of value on 0..n-1: swap-or-not rounds, each its own inverse."""
    other = f"((pmod(xxhash64({key}, r), {n}) + {n} - x) % {n})"
    swap = f"xxhash64({key}, r + {ROUNDS}, greatest(x, {other})) & 1 = 1"
    return F.expr(f"aggregate(sequence(0, {ROUNDS - 1}), cast({value} as bigint), (x, r) -> case when {swap} then {other} else x end)")


def slots(per: DataFrame, seed: int = 1) -> DataFrame:
    """One row per output slot: shard, place in the output, source s, epoch and block."""
    tasks = max(8, int(per.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    some = per.filter("slots > 0").select("s", "blocks", "slots", "first", "slots_all")
    # two steps, so that no row holds an entry for each chunk of a large source
    wide = some.withColumn("wide", F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK * CHUNK}L)"))).repartition(tasks)
    chunks = wide.withColumn("chunk", F.explode(F.expr(f"sequence(wide * {CHUNK}L, least((slots - 1) div {CHUNK}L, (wide + 1) * {CHUNK}L - 1))"))).repartition(tasks)
    each = chunks.withColumn("j", F.explode(F.expr(f"sequence(chunk * {CHUNK}L, least(slots, (chunk + 1) * {CHUNK}L) - 1)")))
    each = each.withColumn("epoch", F.expr("j div blocks"))
    each = each.withColumn("block", permuted("j % blocks", "blocks", f"{seed}, s, epoch"))
    each = each.withColumn("place", permuted("first + j", "slots_all", f"{seed + 1}"))
    return each.select(F.expr(f"place div {SHARD}L").alias("shard"), "place", "s", "epoch", "block")


def placed(sizes: DataFrame, per: DataFrame) -> DataFrame:
    """Documents that have words, with their first word's position in their source's stream."""
    known = sizes.join(per.select("source", "s", "source_size", "target"), sizes["source"].eqNullSafe(per["source"])).drop(per["source"])
    buckets = max(1, -(-sizes.count() // BUCKET))
    each = known.filter("size > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)))
    held = each.groupBy("s", "bucket").agg(F.sum(F.col("size") * F.col("rows")).alias("held"))
    # buckets are summed by groups of BUCKET first, so a hot source's running sum is spread as well
    held = held.withColumn("lot", F.expr(f"bucket div {BUCKET}L"))
    sum_before = lambda *by: F.coalesce(F.sum("held").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lots = held.groupBy("s", "lot").agg(F.sum("held").alias("held")).withColumn("lots", sum_before("s", "lot")).select("s", "lot", "lots")
    held = held.withColumn("base", sum_before("s", "lot", "bucket")).join(lots, ["s", "lot"]).select("s", "bucket", (F.col("base") + F.col("lots")).alias("base"))
    inside = Window.partitionBy("s", "bucket").orderBy("doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("rows")).over(inside), F.lit(0)))
    each = each.join(held, ["s", "bucket"]).withColumn("copy", F.explode(F.expr("sequence(0L, rows - 1)")))
    return each.withColumn("start", F.expr("base + inside + copy * size")).select("doc_id", "source", "h", "size", "copy", "s", "source_size", "target", "start")


def covers(at: DataFrame) -> DataFrame:
    """One row per document and block of it: words lo to hi of the document."""
    each = at.withColumn("block", F.explode(F.expr(f"sequence(start div {BLOCK}L, (start + size - 1) div {BLOCK}L)")))
    lo, hi = F.greatest(F.lit(0), F.col("block") * BLOCK - F.col("start")), F.least(F.col("size"), (F.col("block") + 1) * BLOCK - F.col("start"))
    return each.withColumn("lo", lo).withColumn("hi", hi)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeat: int = REPEAT, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted), shards, first_shard."""
    sizes = written(sized(docs), "sized")
    per = written(targets(sizes, weights, budget, repeat), "sources")
    taken = slots(per, seed).groupBy("s", "block").agg(F.count("*").alias("times"), F.min("shard").alias("shard"))
    # both sides grow with the corpus; what explodes looks small to the planner, which must not broadcast it
    full = covers(placed(sizes, per)).join(taken.hint("merge"), ["s", "block"], "left")
    words = F.sum((F.col("hi") - F.col("lo")) * F.coalesce("times", F.lit(0)))
    out = full.groupBy("s", "start", "doc_id", "size", "source_size", "target").agg(words.alias("taken"), F.min("shard").alias("first_shard"))
    out = out.select("doc_id", "size", "source_size", "target", "taken", "first_shard")
    bare = sizes.filter("size = 0").withColumn("_", F.explode(F.expr("sequence(1L, rows)"))).alias("d")
    bare = bare.join(per.alias("p"), F.expr("d.source <=> p.source")).select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_shard"))
    return out.unionByName(bare)


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeat: int = REPEAT, seed: int = 1) -> DataFrame:
    """The mix as documents: for each epoch that takes words of a document, a row with these words, all other columns kept.

    A document taken whole keeps its text to the letter; of one taken in part, the taken words are joined by spaces.
    """
    sizes = written(sized(docs), "sized")
    per = written(targets(sizes, weights, budget, repeat), "sources")
    drawn = slots(per, seed).select("s", "block", "epoch", "place").hint("merge")
    full = covers(placed(sizes, per)).join(drawn, ["s", "block"])
    parts = full.groupBy("doc_id", "h", "size", "copy", "s", "epoch").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("parts"), F.sum(F.col("hi") - F.col("lo")).alias("words"), F.min("place").alias("place"))
    picked = parts.select(F.col("doc_id").alias("i"), F.col("h").alias("g"), F.col("s").alias("t"), "parts", F.expr("words = size").alias("whole"), "place")
    # all columns pass as one struct, so no name clashes
    once = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("source").cast("string").alias("from"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if not sizes.filter("rows > 1").isEmpty():
        once = once.dropDuplicates(["id", "from", "h"])
    named = per.select(F.col("source").alias("name"), "s")
    once = once.join(named, F.expr("from <=> name"))
    joined = once.join(picked.hint("merge"), F.expr("id <=> i and h <=> g and s = t"))
    some = F.expr(f"array_join(flatten(transform(array(regexp_extract_all(row.text, r'[^{SPACES}]+', 0)), w -> flatten(transform(parts, p -> slice(w, cast(p.lo + 1 as int), cast(p.hi - p.lo as int)))))), ' ')")
    out = joined.withColumn("words", F.when(F.col("whole"), F.col("row.text").cast("string")).otherwise(some)).withColumn("shard", F.expr(f"place div {SHARD}L"))
    out = out.select("row", "words", "shard", "place").repartition("shard").sortWithinPartitions("shard", "place")
    kind = dict(docs.dtypes)
    changed = {"text": F.col("words").cast(kind["text"]), "n_chars": F.length("words").cast(kind.get("n_chars", "long"))}
    return out.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])
