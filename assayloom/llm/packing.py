"""Packing documents into training sequences.

Every document is tokenised once and cut only where it overflows the window: all pieces but its last are whole
windows. The remainders are routed to context-size tiers by length. From the longest tier down, each tier is packed into
sequences of its own context size: the longest remainder left opens one, best fit of the tier fills it, and what gap is
left is filled from the next shorter tiers in turn, best fit first. Sequences are then dealt to step groups so that each group has the same number of
sequences and nearly the same attention cost; the tier of a row is the context size of its sequence.

Packing sees only lengths, in round-robin slices of bounded size, so no source, length or copy group can gather in
one task. Defined cases: a null text is an empty one; an empty one is the single end id; rows without doc_id are packed
like others; repeated rows are packed as often as they come; equal lengths are taken in the order of their rows; very long
texts are cut into whole windows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy_shuffles, written

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
END_ID = 1
SLICE = 20_000  # remainders packed by one task: bounds its memory and its time
STEP_SEQUENCES = 32
SPECIAL = "<|endoftext|>"

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long, tier int, step_group long"


def encoder(json_path: str, ranks_path: str):
    """Text to a numpy array of ids, as tokenizers gives them for json_path.

    The rank file of the same vocabulary runs three times as fast and gives the same ids; only texts that spell
    out a special token go to tokenizers itself, which reads it as that token.
    """
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact: list = []

    def encode(text: str) -> np.ndarray:
        if SPECIAL not in text:
            return fast.encode_to_numpy(text)
        if not exact:
            from tokenizers import Tokenizer

            exact.append(Tokenizer.from_file(json_path))
        return np.asarray(exact[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, paths: tuple[str, str] | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: whole windows, then the remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*(paths or default_paths()))
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    for column, v in zip(out, (doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def tier_of(lengths: np.ndarray, tiers: tuple[int, ...]) -> np.ndarray:
    """The least context size that holds each length (the largest for longer ones)."""
    return np.asarray(tiers)[np.minimum(np.searchsorted(tiers, lengths), len(tiers) - 1)]


def fill(lengths: np.ndarray, window: int = WINDOW, tiers: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each remainder, and the number of sequences; without tiers, the window is the only one.

    Tier by tier, longest first: the longest opens a sequence of the tier's size, best fit of its tier and then of the shorter ones fills it.
    """
    sizes = sorted({min(t, window) for t in tiers or ()} | {window})
    waiting: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1]:
        waiting.setdefault(int(lengths[i]), []).append(int(i))
    order = sorted(waiting)
    cuts = np.searchsorted(order, sizes, "right").tolist()
    left = [order[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]  # the lengths that wait in each tier
    sequence, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for own in reversed(range(len(sizes))):
        while left[own]:
            used = 0
            for tier in range(own, -1, -1):
                while left[tier]:
                    k = bisect.bisect_right(left[tier], sizes[own] - used) - 1
                    if k < 0:
                        break
                    size = left[tier][k]
                    i = waiting[size].pop()
                    if not waiting[size]:
                        left[tier].pop(k)
                    sequence[i], offset[i] = n, used
                    used += size
            n += 1
    return sequence, offset, n


def step_groups(cost: np.ndarray, size: int = STEP_SEQUENCES) -> np.ndarray:
    """Group of each sequence: dealt back and forth in order of cost, so groups cost about the same."""
    groups = max(1, -(-len(cost) // size))
    turn = np.arange(len(cost)) % (2 * groups)
    dealt = np.where(turn < groups, turn, 2 * groups - 1 - turn)
    out = np.empty(len(cost), np.int64)
    out[np.argsort(-cost, kind="stable")] = dealt
    return out


def pack(docs: DataFrame, paths: tuple[str, str] | None = None, window: int = WINDOW, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Pieces with their sequence, their place there, their tier and their step group."""
    spark = docs.sparkSession
    with tidy_shuffles(spark):
        cut = written(pieces(docs, paths, window, end_id), "pieces")
    slices = max(1, -(-cut.count() // SLICE))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows).sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        length = t["length"].to_numpy()
        whole = length == window
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        sequence[~whole], offset[~whole], n = fill(length[~whole], window, tiers)
        sequence[whole] = n + np.arange(whole.sum())
        cost = np.bincount(sequence, weights=length.astype(float) ** 2)
        group = step_groups(cost)[sequence]
        longest = np.zeros(len(cost), np.int64)
        np.maximum.at(longest, sequence, length)
        tier = tier_of(longest, tiers)[sequence]  # a sequence is opened by its longest piece
        base = TaskContext.get().partitionId() << 32  # round-robin slices are sorted first, so a rerun deals the same
        for name, v in (("sequence_id", base + sequence), ("offset", offset), ("tier", tier.astype(np.int32)), ("step_group", base + group)):
            t = t.append_column(name, pa.array(v))
        yield from t.combine_chunks().to_batches()

    return cut.repartition(slices).mapInArrow(place, PACKED_SCHEMA)
