"""Katz backoff language model over words: distributed counts, exactly normalised backoff, recursive scores.

Level 1 is the Good-Turing discounted unigram; what discounting frees is the mass of the one unknown word. Level k gives
a word after k-1 others its discounted relative frequency if that n-gram was kept (count at least its level's cut-off),
else alpha(history) times level k-1. alpha is the mass that the kept n-grams of the history leave over the mass that
level k-1 leaves besides them, so every distribution sums to one. A history that would leave nothing keeps back
1/(count+1).

Texts are read once, into slices of bounded size: local vocabulary and word indices. Per level, a slice asks for its
distinct n-grams, with its training counts; requests travel as sorted arrays, one per slice and range of the key space,
so a frequent n-gram costs one entry a slice. The range's task adds the counts up and answers every slice that asked; for
each kept n-gram one slice, its owner, adds its discounted count to its history's sums, which travel the same way. Slices
then score their tokens from the answers, recursively. Nothing but sums over all ranges reaches the driver.

What needs no asking is not asked, exactly: from level 3 on, an n-gram whose history or whose last words occur only once in
training and nowhere else occurs only here, so its count is known; so are the sums of such a history. Below a history's
kept n-grams all words are kept ones too (cut-offs do not fall from level to level), and share the shorter history: their
lower mass is its scale over its count times a sum of discounted counts, so only such sums travel, never probabilities.

`tables` writes the model itself: n-grams with their counts and histories with their sums, partitioned by level and range.

Defined cases: a null text is an empty one: its only token is the end; repeated rows count and score as often as they
come; rows without id are scored, but not learnt from; very long texts are slices by themselves; an empty table gives no
rows; with nothing to learn from, the unknown word has all mass; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import SALTS, Powers, Words, mix, row_batches
from .common import SCRATCH, shared_dir, tidy_shuffles, written

ORDER, CUTS, K = 2, (1, 2, 2, 2, 2), 5
FOLDS, HELD = 7, 2
RANGE = 2_000_000  # tokens a range of the key space stands for: bounds a range's task
START, END = np.uint64(0x5BD1E995A3C59AC3), np.uint64(0x27D4EB2F165667C5)
OWNER = np.uint32(1 << 31)

SLICE_SCHEMA = "slice long, a binary, b binary, c binary, d binary, n long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def squeezed(a: np.ndarray, rising: bool = False) -> bytes:
    """An array as bytes: differences if it rises, byte by byte of all numbers, compressed."""
    if rising and len(a):
        a = np.append(a[:1], a[1:] - a[:-1])
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(a).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unsqueezed(raw: bytes, kind: type, rising: bool = False) -> np.ndarray:
    n, size = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    data = np.frombuffer(pa.decompress(raw[8:], n * size, codec="zstd", asbytes=True), np.uint8)
    a = np.ascontiguousarray(data.reshape(size, n).T).view(kind).ravel()
    return np.cumsum(a, dtype=kind) if rising else a


class Slice:
    """Tokens of a bounded number of texts."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, first: np.ndarray, words: np.ndarray, at: np.ndarray):
        self.ids, self.known, self.first, self.words, self.at = ids, known, first, words, at
        crc = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in ids.tolist()], np.int64)
        self.held = crc == HELD
        self.doc = np.repeat(np.arange(len(ids)), np.diff(first))
        self.learn = ((~self.held) & known)[self.doc]
        self.token = words[at]
        self.begins = np.zeros(len(at), bool)
        self.begins[first[:-1]] = True

    @classmethod
    def read(cls, column: pa.Array, texts: pa.Array, powers: Powers) -> Slice:
        w = Words(texts, powers)
        count = np.diff(w.first)
        first = w.first + np.arange(len(w.first))  # room for an end each
        token = np.full(first[-1], END, np.uint64)
        token[np.arange(len(w.number)) + np.repeat(np.arange(len(count)), count)] = w.number
        words, at, often = np.unique(token, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")  # frequent words get small indices, which compress
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        ids = column.cast(pa.int64())
        return cls(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), first, words[order], rank[at])

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        return squeezed(np.append(self.ids, self.known.astype(np.int64))), squeezed(self.first.astype(np.int64), True), squeezed(self.words), squeezed(self.at.astype(np.uint32))

    @classmethod
    def unpacked(cls, a: bytes, b: bytes, c: bytes, d: bytes) -> Slice:
        ids = unsqueezed(a, np.int64)
        half = len(ids) // 2
        return cls(ids[:half], ids[half:].astype(bool), unsqueezed(b, np.int64, True), unsqueezed(c, np.uint64), unsqueezed(d, np.uint32).astype(np.int64))

    def back(self, x: np.ndarray, steps: int) -> np.ndarray:
        """x of the token `steps` before each one; START before a text begins."""
        for _ in range(steps):
            y = np.empty_like(x)
            y[1:] = x[:-1]
            y[self.begins] = START
            x = y
        return x

    def history(self, level: int) -> np.ndarray:
        """Key of the level-1 tokens before each token."""
        if level == 2:
            return self.back(self.token, 1)
        acc = np.zeros(len(self.token), np.uint64)
        for j in range(1, level):
            acc += self.back(self.token, j) * SALTS[j]
        return mix(acc)

    def keys(self, level: int) -> np.ndarray:
        """Key of each token with its history."""
        return self.token if level == 1 else mix(self.history(level) * SALTS[30] + self.token * SALTS[31])


def parts_of(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """Range, begin and end of each range that sorted keys fall into."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    begin = np.nonzero(np.append(True, part[1:] != part[:-1]))[0] if len(part) else np.zeros(0, np.int64)
    return list(zip(part[begin].tolist(), begin.tolist(), np.append(begin[1:], len(part)).tolist()))


def slices(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, n, at = Powers(), 0, TaskContext.get().partitionId() << 32
        for b in row_batches(batches, rows=4_000, size=2_500_000):
            s = Slice.read(b.column(0), b.column(1), powers)
            yield pa.RecordBatch.from_pydict({"slice": pa.array([at + n])} | {k: pa.array([v], pa.binary()) for k, v in zip("abcd", s.packed())} | {"n": pa.array([len(s.at)])})
            n += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SLICE_SCHEMA)


REQUEST = "slice long, level int, part int, keys binary, x binary, y binary, z binary, n long"
ANSWER = "slice long, level int, part int, a binary, b binary, n array<long>"
FLAG = np.uint32(1 << 30)
FAINT = 1e-9  # stands for a mass whose scale is 1
SUMS = 2 + K + 1  # tokens, distinct n-grams, how many have count 1 to K+1


def _rows(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)], names=[n for n, _ in schema])


_binary, _long, _int = pa.binary(), pa.int64(), pa.int32()
_REQUEST = [("slice", _long), ("level", _int), ("part", _int), ("keys", _binary), ("x", _binary), ("y", _binary), ("z", _binary), ("n", _long)]
_ANSWER = [("slice", _long), ("level", _int), ("part", _int), ("a", _binary), ("b", _binary), ("n", pa.list_(_long))]


def coded(a: np.ndarray) -> bytes:
    """Numbers of which there are few different ones, as these and their indices."""
    values, at = np.unique(a, return_inverse=True)
    kind = np.uint16 if len(values) <= 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + len(values).to_bytes(8, "little") + values.tobytes() + squeezed(at.astype(kind))


def uncoded(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[1:9], "little")
    return np.frombuffer(raw, np.float64, n, 9)[unsqueezed(raw[9 + 8 * n :], np.uint16 if raw[0] == 2 else np.uint32)]


def _asked(slice_: int, level: int, bits: int, keys: np.ndarray, arrays: list[np.ndarray], alone: int) -> pa.RecordBatch:
    """Rows of a request, one for each range that has keys of it; the first carries how many n-grams are known to be alone."""
    rows = []
    for p, a, z in parts_of(keys, bits) or ([(0, 0, 0)] if alone else []):
        own = [coded(v[a:z]) if v.dtype == float else squeezed(v[a:z]) for v in arrays]
        rows.append((slice_, level, p, squeezed(keys[a:z], True), *own, *[b""] * (3 - len(own)), 0 if rows else alone))
    return _rows(_REQUEST, rows)


def _count_request(s: Slice, slice_: int, level: int, bits: int, asked: np.ndarray) -> pa.RecordBatch:
    """The distinct n-grams of the asked tokens, each with twice its training count, plus 1 if others have it as well."""
    keys, at = np.unique(s.keys(level)[asked], return_inverse=True)
    learnt = s.learn[asked]
    mine, other = (np.bincount(at, weights=w, minlength=len(keys)) for w in (learnt, ~learnt))
    x = (2 * mine + (other > 0)).astype(np.uint32)
    return _asked(slice_, level, bits, keys, [x], int((s.learn & ~asked).sum()))


def requests(table: DataFrame, level: int, bits: int) -> DataFrame:
    """Requests of levels 1 and 2, where everything is asked for, from the slices alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                s = Slice.unpacked(r["a"], r["b"], r["c"], r["d"])
                yield _count_request(s, r["slice"], level, bits, np.ones(len(s.at), bool))

    return table.mapInArrow(run, REQUEST)


def answers(asked: DataFrame, cuts: tuple[int, ...], model: bool = False) -> DataFrame:
    """Per slice, level and range: the total training count of each n-gram asked for, marked for the owner and for n-grams that
    others have too; of histories (level below 0), the sums over their n-grams. Rows of slice -1 carry the range's sums."""

    def counts(t: pa.Table, level: int, part: int, keys: list[np.ndarray]) -> list:
        flat = np.concatenate(keys)
        x = np.concatenate([unsqueezed(v, np.uint32) for v in t["x"].to_pylist()])
        uniq, first, at = np.unique(flat, return_index=True, return_inverse=True)
        total = np.bincount(at, weights=x >> 1, minlength=len(uniq)).astype(np.int64)
        other = np.bincount(at, weights=x & 1, minlength=len(uniq)) > 0
        reply = (np.minimum(total, FLAG - 1).astype(np.uint32) | np.where(other, FLAG, np.uint32(0)))[at]
        reply[first[total >= cuts[level - 1]]] |= OWNER
        sums = [int(total.sum()), int((total > 0).sum()), *[int((total == r).sum()) for r in range(1, K + 2)]]
        alone = sum(t["n"].to_pylist())
        rows = _split(t, level, part, keys, lambda a, z: (squeezed(reply[a:z]), b""))
        rows.append((-1, level, part, b"", b"", [v + alone * (i < 3) for i, v in enumerate(sums)]))
        return rows + ([(-2, level, part, squeezed(uniq[total > 0], True), squeezed(total[total > 0]), None)] if model else [])

    def histories(t: pa.Table, level: int, part: int, keys: list[np.ndarray]) -> list:
        uniq, at = np.unique(np.concatenate(keys), return_inverse=True)
        z = np.concatenate([unsqueezed(v, np.uint32) for v in t["z"].to_pylist()])
        x, y = (np.concatenate([uncoded(v) for v in t[k].to_pylist()]) for k in "xy")
        mass, below, count = (np.bincount(at, weights=v, minlength=len(uniq)) for v in (x, y, z >> 1))
        # who backs off nowhere only needs the scale; where discounts leave a count of 1 or more, that is 1 for any mass
        sure = (mass > 0) & (count - mass > 1 + 1e-9)
        back = (z & 1) > 0
        mine, lower = np.where(back | ~sure[at], mass[at], FAINT), np.where(back, below[at], 0.0)
        rows = _split(t, level, part, keys, lambda a, z: (coded(mine[a:z]), coded(lower[a:z])))
        return rows + ([(-2, level, part, squeezed(uniq, True), coded(mass), None)] if model else [])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("slice")  # sums of fractions come out the same in every run
        level, part = t["level"][0].as_py(), t["part"][0].as_py()
        keys = [unsqueezed(x, np.uint64, True) for x in t["keys"].to_pylist()]
        return pa.Table.from_batches([_rows(_ANSWER, (counts if level > 0 else histories)(t, level, part, keys))])

    return asked.groupBy("level", "part").applyInArrow(run, ANSWER)


def _split(t: pa.Table, level: int, part: int, keys: list[np.ndarray], reply) -> list[tuple]:
    bounds = np.append(0, np.cumsum([len(k) for k in keys])).tolist()
    return [(s, level, part, *reply(a, z), None) for s, a, z in zip(t["slice"].to_pylist(), bounds[:-1], bounds[1:]) if z > a]


def discounts(n: list[int]) -> np.ndarray:
    """d_0..d_K of Good-Turing as Katz has it, from the number of n-grams of count 1..K+1; absolute ones if those fail."""
    d = np.ones(K + 1)
    r = np.arange(1, K + 1)
    if min(n) > 0:
        a = (K + 1) * n[K] / n[0]
        star = (r + 1) * np.array(n[1:], float) / (r * np.array(n[:-1], float))
        if a < 1:
            d[1:] = (star - a) / (1 - a)
    if not ((d[1:] > 0) & (d[1:] < 1)).all():
        back = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d[1:] = (r - min(max(back, 0.1), 0.9)) / r
    return d


class Model:
    """What all levels need to know of the whole corpus; levels holds (cut-off, discounts)."""

    def __init__(self, sums: np.ndarray):
        self.tokens, self.types = int(sums[0]), int(sums[1])
        d = discounts(sums[2:].tolist())
        lost = sum((1 - d[r]) * r * int(sums[1 + r]) for r in range(1, K + 1))
        kept, least = (1 - lost / self.tokens if self.tokens else 0.0), 1 / (self.tokens + self.types + 1)
        self.scale = 1.0 if 1 - kept >= least else (1 - least) / kept
        self.unknown = 1 - kept * self.scale
        self.levels = [(1, d)]

    def unigram(self, c: np.ndarray) -> np.ndarray:
        d = self.levels[0][1]
        return np.where(c > 0, self.scale * d[np.where(c <= K, c, 0)] * c / max(1, self.tokens), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + 1 * (self.types + 1)))


def discounted(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return d[np.where(c <= K, c, 0)] * c


class Answers:
    """A slice with the answers it got so far. The arrays have an entry a token."""

    def __init__(self, own: pa.Table, t: pa.Table, model: Model, docs: int):
        rows = sorted(t.to_pylist(), key=lambda r: (r["level"], r["part"]))
        (mine,) = own.to_pylist()
        self.id, self.model, self.docs = mine["slice"], model, docs
        self.slice = Slice.unpacked(mine["a"], mine["b"], mine["c"], mine["d"])
        self.raw = lambda level, name, read: np.concatenate([read(r[name]) for r in rows if r["level"] == level] or [np.zeros(0)])
        self.known: dict = {}

    def before(self, x: np.ndarray, first) -> np.ndarray:
        """x of the token before each one; `first` where a text begins."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.slice.begins] = first
        return out

    def asked(self, level: int) -> np.ndarray:
        """Tokens whose n-gram is asked for: the others' are known to be here only."""
        if level <= 2:
            return np.ones(len(self.slice.at), bool)
        shared = self.counts(level - 1)[1]
        return shared & self.before(shared, self.docs > 0)

    def counts(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Training count of each token's n-gram; whether it occurs elsewhere too; the tokens that own theirs."""
        if level not in self.known:
            s, asked = self.slice, self.asked(level)
            cut = self.model.levels[level - 1][0]
            _, first, at = np.unique(s.keys(level)[asked], return_index=True, return_inverse=True)
            raw = self.raw(level, "a", lambda v: unsqueezed(v, np.uint32)).astype(np.uint32)
            total = (raw & (FLAG - np.uint32(1))).astype(np.int64)
            c, shared = s.learn.astype(np.int64), np.zeros(len(s.at), bool)
            c[asked] = total[at]
            shared[asked] = ((total > 1) | ((total == 1) & (raw & FLAG > 0)))[at]
            own = np.nonzero(asked)[0][first[raw & OWNER > 0]]
            alone = np.nonzero(s.learn & ~asked)[0] if cut <= 1 else own[:0]
            self.known[level] = c, shared, np.concatenate([own, alone])
        return self.known[level]

    def history_count(self, level: int) -> np.ndarray:
        """Training count of each token's history at this level."""
        return np.maximum(1, self.before(self.counts(level - 1)[0], self.docs))

    def history_asked(self, level: int) -> np.ndarray:
        return self.before(self.counts(level - 1)[1], self.docs > 0)

    def history_request(self, level: int, bits: int) -> pa.RecordBatch:
        """Of each history asked for: the discounted counts of the n-grams owned here, and those of their shorter ones."""
        asked, (c, _, own), lower = self.history_asked(level), self.counts(level), self.counts(level - 1)[0]
        keys, at = np.unique(self.slice.history(level)[asked], return_inverse=True)
        place = np.full(len(asked), -1)
        place[asked] = at
        own = own[asked[own]]
        cut, d = self.model.levels[level - 1]
        e = self.model.levels[level - 2][1]
        x, y, z = (np.bincount(place[own], weights=w[own], minlength=len(keys)) for w in (discounted(d, c), discounted(e, lower), c))
        back = np.bincount(at, weights=c[asked] < cut, minlength=len(keys)) > 0
        x, y = x.astype(float), y.astype(float)  # sums over nothing come as whole numbers
        return _asked(self.id, -level, bits, keys, [x, y, np.minimum(2 * z + back, 2.0**32 - 1 - (1 - back)).astype(np.uint32)], 0)

    def history_sums(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each token's history: the discounted counts of its kept n-grams, and those of their shorter ones (0: it keeps none)."""
        s, asked = self.slice, self.history_asked(level)
        cut, d = self.model.levels[level - 1]
        alone = s.learn & ~asked if cut <= 1 else np.zeros(len(asked), bool)  # its history's one n-gram is its own
        x = np.where(alone, d[1], 0.0)
        y = np.where(alone, discounted(self.model.levels[level - 2][1], self.counts(level - 1)[0]), 0.0)
        _, at = np.unique(s.history(level)[asked], return_inverse=True)
        x[asked], y[asked] = self.raw(-level, "a", uncoded)[at], self.raw(-level, "b", uncoded)[at]
        return x, y

    def probability(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each token at this level, by recursion to the lower ones; and what a discounted count counts for at this level."""
        m = self.model
        if level == 1:
            c = self.counts(1)[0]
            return m.unigram(c), np.full(len(c), m.scale / max(1, m.tokens))
        lower, unit = self.probability(level - 1)
        c, h = self.counts(level)[0], self.history_count(level)
        cut, d = m.levels[level - 1]
        x, y = self.history_sums(level)
        known, least = x > 0, 1 / (h + 1)
        scale = np.where(1 - x / h >= least, 1.0, (1 - least) * h / np.where(known, x, 1.0))
        alpha = np.where(known, (1 - scale * x / h) / (1 - unit * y), 1.0)
        return np.where((c >= cut) & known, scale * discounted(d, c) / h, alpha * lower), scale / h


def score(docs: DataFrame, order: int = ORDER, cuts: tuple[int, ...] = CUTS, tables: list | None = None) -> DataFrame:
    """Scores of all texts under the model of the training texts (crc32 of the id mod FOLDS other than HELD).

    tables: a list that gets the model's tables (level, part, keys, values), which then stay in the shared folder; else
    they are not written.
    """
    if any(a > b for a, b in zip(cuts, cuts[1:order])):
        raise ValueError("cut-offs must not fall from level to level")
    spark = docs.sparkSession
    with tidy_shuffles(spark):
        table = _bucketed(slices(docs), docs.rdd.getNumPartitions())
        total = table.agg(F.sum("n")).first()[0]
        if total is None:
            return spark.createDataFrame([], SCORES)
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
        learnt = texts.filter(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD)).count()
        bits = max(0, int(np.ceil(np.log2(max(1, total / RANGE)))))
        base = table.select("slice", "a", "b", "c", "d")
        got: list[DataFrame] = []
        model = None
        for level in range(1, order + 1):
            asked = requests(table, level, bits) if level <= 2 else _ask(_gathered(base, got), model, learnt, level, level - 1 if level > 2 else 0, bits)
            found = written(answers(asked, cuts, tables is not None), f"answers{level}")
            got.append(found.filter("slice >= 0"))
            if tables is not None:
                tables.append(found.filter("slice = -2").select("level", "part", F.col("a").alias("keys"), F.col("b").alias("values")))
            sums = found.filter(f"slice = -1 and level = {level}").agg(*[F.sum(F.element_at("n", i + 1)) for i in range(SUMS)]).first()
            sums = np.array([v or 0 for v in sums], np.int64)
            if level == 1:
                model = Model(sums)
            else:
                model.levels.append((cuts[level - 1], discounts(sums[2:].tolist())))
        if order > 1:
            last = written(answers(_ask(_gathered(base, got), model, learnt, 0, order, bits), cuts, tables is not None), "histories")
            got.append(last.filter("slice >= 0"))
            if tables is not None:
                tables.append(last.filter("slice = -2").select("level", "part", F.col("a").alias("keys"), F.col("b").alias("values")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a = Answers(left, right, model, learnt)
        s, c = a.slice, a.counts(1)[0]
        p = np.log10(a.probability(order)[0])
        per = lambda x: np.add.reduceat(x, s.first[:-1])  # noqa: E731  (every text has its end token)
        n = len(s.ids)
        columns = [pa.array(s.ids, mask=~s.known), pa.array(s.held, mask=~s.known), pa.array(np.diff(s.first)), pa.array(per((c > 0).astype(np.int64))), pa.array(np.full(n, model.tokens)), pa.array(per(model.base(c))), pa.array(per(p))]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _gathered(base, got).applyInArrow(run, SCORES)


def _ask(gathered: DataFrame, model: Model, docs: int, level: int, histories: int, bits: int) -> DataFrame:
    """From the slices and what they know: requests for the n-grams of a level, and for the histories of another (0: none)."""

    def run(s: pa.Table, t: pa.Table) -> pa.Table:
        a = Answers(s, t, model, docs)
        out = []
        if level:
            out.append(_count_request(a.slice, a.id, level, bits, a.asked(level)))
        if histories:
            out.append(a.history_request(histories, bits))
        return pa.Table.from_batches(out)

    return gathered.applyInArrow(run, REQUEST)


def _bucketed(rows: DataFrame, tasks: int) -> DataFrame:
    """rows as a table dealt by slice, so that only answers travel to the slices, not these to them."""
    spark = rows.sparkSession
    n = min(100_000, max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    name = f"slices_{uuid.uuid4().hex}"
    rows.repartition(n, "slice").write.bucketBy(n, "slice").option("path", f"{shared_dir(spark)}/{SCRATCH}/{name}").saveAsTable(name)
    return spark.table(name)


def _gathered(base: DataFrame, got: list[DataFrame]):
    """Slices beside what they know."""
    out = got[0].select("slice", "level", "part", "a", "b")
    for g in got[1:]:
        out = out.union(g.select("slice", "level", "part", "a", "b"))
    return base.groupBy("slice").cogroup(out.groupBy("slice"))
