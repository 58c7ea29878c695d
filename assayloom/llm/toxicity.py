"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels come with documents, so tokens are labelled first: over all labelled training documents, the presence of every
affix (the whole word, its first and its last bytes) is counted by label. Of the affixes of the toxic sample that are far
more frequent in toxic documents than in clean ones (by rates, whatever the class ratio; with less where none is), a smallest set
that covers the toxic documents of the sample is taken greedily, and marks its tokens in toxic documents: the token labels
are a learned list of affixes. On a bounded sample of training documents (SAMPLE of each label, by
hash of the id) the two-state field is then fitted to these token labels; its features are the hashed affixes of the
token and its neighbours' states. Forward-backward over every whole text gives each token's marginal; a document's score
is a logistic function of its largest log-odds and of the expected number of toxic tokens, fitted on the same sample.

Only the text is an input of a score. Defined cases: a null or empty text has the score of a text without toxic tokens;
repeated rows score alike, very long texts are scored whole, rows without doc_id are scored but not learnt from; a doc_id with several labels counts as toxic if one of them is; with no toxic label to learn
from all scores are 0; an empty table gives no rows; extra columns are ignored (and kept by `clean`).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import SALTS, Powers, Words, give_back, row_batches
from .common import crc_mod, discard, tidy_shuffles, written

SAMPLE = 600  # training documents of each label that the field is fitted on
FOLDS = 5
BROADCAST_ROWS = 2_000_000
BITS = 18  # affix weights: a table of 2^BITS, the size bound of the model
PREFIXES, SUFFIXES = (3, 4, 5, 6), (3, 4, 5)
SUPPORT, RATIO, LEAST_SHARE = 3, 20.0, 0.005
WEAKER = ((SUPPORT, RATIO), (1, RATIO), (1, 1.0), (1, 0.0))  # support and rate ratio: the first pair that any affix passes holds
STEPS, RATE, DECAY = 60, 0.5, 1e-4
CHAIN = 64
FAINT = 0.05


def affixes(w: Words) -> np.ndarray:
    """Hashes of each token's affixes, one row a kind; tokens shorter than an affix have 0 there."""
    n = w.ends - w.starts
    rows = [w.number]
    for k, size in enumerate(PREFIXES):
        rows.append(np.where(n > size, w.part(w.starts, np.minimum(w.starts + size, w.ends)) ^ SALTS[10 + k], 0))
    for k, size in enumerate(SUFFIXES):
        rows.append(np.where(n > size, w.part(np.maximum(w.ends - size, w.starts), w.ends) ^ SALTS[15 + k], 0))
    return np.stack(rows)


def slots(a: np.ndarray) -> np.ndarray:
    return np.where(a == 0, 0, a >> np.uint64(64 - BITS)).astype(np.int64)


KINDS = 1 + len(PREFIXES) + len(SUFFIXES)


def counts(labelled: DataFrame) -> DataFrame:
    """affix, toxic and clean: the training documents of each label that have it. Counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in row_batches(batches):
            w = Words(b.column(0), powers)
            toxic = np.asarray(b.column(1)).astype(bool)
            doc = np.repeat(np.arange(len(w)), np.diff(w.first))
            seen = []
            for row in affixes(w):
                order = np.lexsort((doc, row))
                r, d = row[order], doc[order]
                new = np.append(True, (r[1:] != r[:-1]) | (d[1:] != d[:-1])) if len(r) else np.zeros(0, bool)
                seen.append((r[new], toxic[d[new]]))
            key, bad = (np.concatenate(x) for x in zip(*seen))
            both, at = np.unique(key, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both.view(np.int64)), pa.array(np.bincount(at, weights=bad, minlength=len(both)).astype(np.int64)), pa.array(np.bincount(at, weights=~bad, minlength=len(both)).astype(np.int64))],
                names=["affix", "toxic", "clean"],
            )

    each = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "affix long, toxic long, clean long")
    return each.groupBy("affix").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter("affix != 0")


class Field:
    """Two-state chain: affix weights (of state 1 against 0), transition scores, and the document layer."""

    def __init__(self) -> None:
        self.weight = np.zeros(1 << BITS, np.float32)
        self.bias, self.turn, self.layer = -4.0, np.zeros((2, 2)), np.array([-8.0, 0.0, 0.0])
        self.trained = False

    def emissions(self, w: Words) -> np.ndarray:
        return self.bias + self.weight[slots(affixes(w))].sum(axis=0, dtype=np.float64)

    def marginals(self, score: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-odds of state 1 of each token, by forward and backward messages along each text."""
        ahead = messages(score, first[:-1], np.diff(first), self.turn)
        last = len(score) - first[1:][::-1]
        behind = messages(score[::-1], last, np.diff(first)[::-1], self.turn.T)[::-1]
        return score + ahead + behind


def messages(score: np.ndarray, starts: np.ndarray, lengths: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """For each token the log-odds that the tokens before it pass on; 0 at the start of a text.

    The step is odds' = f(score + odds) with f the two-by-two transition. Stretches of CHAIN tokens run side by side:
    first each stretch's map is composed as a two-by-two matrix, then the stretches are chained, then all are run.
    """
    n = len(score)
    if not n:
        return np.zeros(0)
    rows = -(-n // CHAIN)
    s = np.zeros(rows * CHAIN)
    s[:n] = np.clip(score, -40, 40)
    head = np.zeros(rows * CHAIN, bool)
    head[starts[lengths > 0]] = True
    e, h = np.exp(s).reshape(rows, CHAIN), head.reshape(rows, CHAIN)
    t = np.exp(turn)
    # columns of the map from (p0, p1) before a stretch to (q0, q1) after it
    m = np.zeros((rows, 2, 2))
    m[:, 0, 0] = m[:, 1, 1] = 1
    reset = np.zeros(rows, bool)
    for j in range(CHAIN):
        new = h[:, j]
        if new.any():
            m[new] = 0
            m[new, 0, :] = m[new, 1, :] = 1
            reset |= new
        m[:, 1, :] *= e[:, j, None]
        a, b = m[:, 0, :].copy(), m[:, 1, :].copy()
        m[:, 0, :] = a * t[0, 0] + b * t[1, 0]
        m[:, 1, :] = a * t[0, 1] + b * t[1, 1]
        m /= m.max(axis=(1, 2))[:, None, None]
    p = np.ones((rows, 2))
    now0, now1 = 1.0, 1.0
    flat = m.reshape(rows, 4).tolist()
    for i in range(rows):
        p[i] = now0, now1
        a, b, c, d = flat[i]
        now0, now1 = a * now0 + b * now1, c * now0 + d * now1
        z = now0 + now1
        now0, now1 = now0 / z, now1 / z
    out = np.zeros((rows, CHAIN))
    for j in range(CHAIN):
        p[h[:, j]] = 1
        p = np.maximum(p, 1e-300)
        out[:, j] = np.log(p[:, 1]) - np.log(p[:, 0])
        q = p[:, 1] * e[:, j]
        p = np.stack([p[:, 0] * t[0, 0] + q * t[1, 0], p[:, 0] * t[0, 1] + q * t[1, 1]], axis=1)
        p /= p.sum(axis=1, keepdims=True)
    return out.ravel()[:n]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def summary(odds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: 1, its largest log-odds (clipped), log of 1 + the expected number of toxic tokens (of marginal FAINT or more)."""
    n = len(first) - 1
    top, total = np.full(n, -12.0), np.zeros(n)
    some = np.nonzero(np.diff(first))[0]
    if len(some):
        clipped = np.clip(odds, -12, 12)
        top[some] = np.maximum.reduceat(clipped, first[some])
        p = sigmoid(odds)
        total[some] = np.add.reduceat(np.where(p >= FAINT, p, 0), first[some])
    return np.stack([np.ones(n), top, np.log1p(total)], axis=1)


def cover(a: np.ndarray, doc: np.ndarray, candidates: np.ndarray, n: int, single: bool = False) -> np.ndarray:
    """Greedily, the candidates that together occur in the most of n texts; each must add its share (single: one text)."""
    if not len(candidates):
        return candidates
    cells = []
    for row in a:  # a kind at a time keeps the arrays small
        at = np.minimum(np.searchsorted(candidates, row), len(candidates) - 1)
        real = candidates[at] == row
        cells.append(np.unique(at[real] * n + doc[real]))
    cells = np.unique(np.concatenate(cells))
    which, text = cells // n, cells % n
    least = 1 if single else max(SUPPORT, LEAST_SHARE * n)
    held = np.bincount(which, minlength=len(candidates))
    todo, taken = np.ones(n, bool), []
    while True:
        gain = np.bincount(which[todo[text]], minlength=len(candidates))
        gain[held < least] = 0
        best = int(np.lexsort((held, gain))[-1])
        if gain[best] < (1 if single else max(2, 0.2 * least)):
            return np.sort(candidates[taken])
        taken.append(best)
        todo[text[which == best]] = False


def train(texts: pa.Array, toxic: np.ndarray, marks: np.ndarray, clean_weight: float = 1.0) -> Field:
    """Field fitted to the sample; marks: sorted numbers of the affixes that may mark a token of a toxic text."""
    field = Field()
    if not toxic.any() or toxic.all() or not len(marks):
        return field
    w = Words(texts)
    a = affixes(w)
    doc = np.repeat(np.arange(len(w)), np.diff(w.first))
    bad = np.cumsum(toxic) - 1
    mine = a[:, toxic[doc]], bad[doc[toxic[doc]]]
    chosen = cover(*mine, marks, int(toxic.sum()))
    marks = chosen if len(chosen) else cover(*mine, marks, int(toxic.sum()), single=True)
    if not len(marks):
        return field
    marked = np.zeros(len(doc), bool)
    for row in a:
        at = np.minimum(np.searchsorted(marks, row), len(marks) - 1)
        marked |= marks[at] == row
    y = (marked & toxic[doc]).astype(float)
    # equal tokens in equal neighbourhoods repeat: the gradient of a word's weights needs its summed residual only
    uniq, row = np.unique(w.number, return_index=False, return_inverse=True)[0:2]
    where = np.zeros(len(uniq), np.int64)
    where[row] = np.arange(len(row))
    cells = slots(a[:, where])
    del a, doc
    square, bias_square = np.zeros(1 << BITS), 0.0
    weight, bias = np.zeros(1 << BITS), field.bias
    inner = np.ones(len(y), bool)
    inner[w.first[:-1][np.diff(w.first) > 0]] = False
    pairs = np.zeros((2, 2))
    now, before = y[1:][inner[1:]].astype(int), y[:-1][inner[1:]].astype(int)
    np.add.at(pairs, (before, now), 1)
    # transition scores: log of the observed turns over what independence gives, kept mild
    rate = (pairs.sum(axis=0) + 1) / (pairs.sum() + 2)
    field.turn = np.clip(np.log((pairs + 1) / (pairs.sum(axis=1, keepdims=True) + 2)) - np.log(rate)[None, :], -2, 2)
    field.turn -= field.turn[:, :1].mean()
    for _ in range(STEPS):
        field.weight, field.bias = weight.astype(np.float32), bias
        score = (bias + weight[cells].sum(axis=0))[row]
        p = sigmoid(field.marginals(score, w.first))
        left = np.bincount(row, weights=y - p, minlength=len(uniq))
        g = np.bincount(cells.ravel(), weights=np.tile(left, KINDS), minlength=1 << BITS) - DECAY * len(y) * weight / max(1, len(uniq))
        g[0] = 0
        square += g * g
        weight += RATE * g / np.sqrt(square + 1e-6)
        gb = float(left.sum())
        bias_square += gb * gb
        bias += RATE * gb / np.sqrt(bias_square + 1e-6)
    field.weight, field.bias = weight.astype(np.float32), bias
    x = summary(field.marginals((field.bias + weight[cells].sum(axis=0))[row], w.first), w.first)
    z, beta = toxic.astype(float), np.array([-2.0, 0.1, 0.1])
    v = np.where(toxic, 1.0, clean_weight)  # the sample holds as many toxic texts as clean ones, the corpus does not
    for _ in range(200):  # Newton steps with a ridge that keeps separable samples finite
        q = sigmoid(x @ beta)
        h = (x * (v * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3)
        step = np.linalg.solve(h, x.T @ (v * (z - q)) - 0.05 * beta)
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    field.layer, field.trained = beta, True
    return field


def fit(docs: DataFrame, labels: DataFrame, holdout: bool = True, sample: int = SAMPLE) -> Field:
    """Field learned from the labelled documents (those whose crc32(doc_id) mod FOLDS is not 0, if holdout)."""
    spark = docs.sparkSession
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    if holdout:
        marks = marks.filter(crc_mod("doc_id", FOLDS) != 0)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with tidy_shuffles(spark):
        marks = written(marks, "marks")
        # labels are few and small: they go to the texts, and only beyond BROADCAST_ROWS are both shuffled
        near = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks
        labelled = written(texts.join(near, "doc_id"), "labelled")
        seen = counts(labelled)
        totals = labelled.agg(F.sum("toxic"), F.count("*")).first()
        bad, good = int(totals[0] or 0), int(totals[1] - (totals[0] or 0))
        if not bad or not good:
            return Field()
        drawn = labelled.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
        # twice as many as wanted pass by their hash, so no task sends many texts; the first of these are the sample
        parts = []
        for t, n in ((1, bad), (0, good)):
            some = drawn.filter((F.col("toxic") == t) & (F.col("h") < int((1 << 30) * min(1.0, 2 * sample / n + 100 / n))))
            some = written(some.orderBy("h", "doc_id").limit(sample).select("text", "toxic"), "sample")
            parts.append(some)
        mine = counts(parts[0]).select("affix")
        for support, ratio in WEAKER:
            # only affixes of the bounded sample are kept, as a narrow table; the join to their counts is distributed
            telling = seen.filter(f"toxic >= {support} and toxic * {good}D > clean * {bad}D * {ratio}")
            telling = written(telling.join(mine, "affix", "left_semi").select("affix"), "telling")
            if not telling.isEmpty():
                break
            discard(telling)
        else:
            telling = None
        field = trained(*parts, telling, bad, good) if telling is not None else Field()
    for part in (*parts, *([telling] if telling is not None else []), labelled, marks):
        discard(part)
    return field


def trained(bad_rows: DataFrame, good_rows: DataFrame, telling: DataFrame, bad: int, good: int) -> Field:
    """The field of a sample, fitted in one task: the driver, whose memory all queries share, gets the fitted numbers only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        kind = np.concatenate([b.column(0).to_numpy() for b in got])
        order = np.argsort(kind, kind="stable")  # toxic texts, clean texts, affixes
        n, toxic = int((kind < 2).sum()), int((kind == 0).sum())
        texts = pa.chunked_array([b.column(1).cast(pa.large_string()) for b in got]).take(pa.array(order[:n])).combine_chunks()
        affix = np.concatenate([b.column(2).fill_null(0).to_numpy() for b in got])[order[n:]]
        del got
        ratio = (good / max(1, n - toxic)) / (bad / max(1, toxic))
        field = train(texts, np.arange(n) < toxic, np.sort(affix.view(np.uint64)), ratio)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(field))], pa.binary())], names=["field"])
        del field, texts
        give_back()

    rows = [part.select(F.lit(k).alias("kind"), "text", F.lit(None).cast("long").alias("affix")) for k, part in enumerate((bad_rows, good_rows))]
    rows.append(telling.select(F.lit(2).alias("kind"), F.lit(None).cast("string").alias("text"), "affix"))
    field = Field()
    vars(field).update(pickle.loads(rows[0].unionAll(rows[1]).unionAll(rows[2]).coalesce(1).mapInArrow(run, "field binary").first()["field"]))
    return field


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, toxic_tokens (marginal 1/2 or more) and spans (start and stop in bytes of each run of such tokens), a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in row_batches(batches):
            w = Words(b.column(1), powers)
            odds = field.marginals(field.emissions(w), w.first)
            score = sigmoid(summary(odds, w.first) @ field.layer) if field.trained else np.zeros(len(w))
            hit = np.append(0, np.cumsum(odds >= 0))
            per = hit[w.first[1:]] - hit[w.first[:-1]]
            spans: list[list] = [[] for _ in range(len(w))]
            on = np.nonzero(odds >= 0)[0] if field.trained else np.zeros(0, np.int64)
            of = np.searchsorted(w.first, on, "right") - 1
            opens = np.append(True, (np.diff(on) > 1) | (np.diff(of) > 0))[: len(on)]
            closes = np.append(opens[1:], True)[: len(on)]
            for i, j, doc in zip(on[opens], on[closes], of[opens]):
                spans[doc].append({"start": int(w.starts[i] - w.at[doc]), "stop": int(w.ends[j] - w.at[doc])})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(per), pa.array(spans, kind)], names=["doc_id", "score", "toxic_tokens", "spans"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double, toxic_tokens long, spans array<struct<start:long,stop:long>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_tokens and spans of every document."""
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", (crc_mod("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_tokens", "spans")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score 1/2 or more; whole rows pass through one Arrow stage."""
    field = fit(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in row_batches(batches):
            w = Words(b.column(at), powers)
            score = sigmoid(summary(field.marginals(field.emissions(w), w.first), w.first) @ field.layer) if field.trained else np.zeros(len(w))
            yield b.filter(pa.array(score < 0.5))

    return docs.mapInArrow(run, docs.schema)
