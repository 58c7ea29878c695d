"""Cropped and edited copies in a column of images, by local descriptors.

Corners (least eigenvalue of the structure tensor, at several scales) get the orientation of their patch's intensity
centroid and BITS binary tests in the pattern turned by it. Two images are candidates if descriptors of theirs agree in
one of TABLES parts of the bits (Hamming tables: any two within TABLES - 1 bits do). A pair is a copy if CONSENSUS of its
nearest-descriptor matches agree on one scale, rotation and shift.

Images are binary grey maps (P5, 8 bit). Equal images are one class from the start, so copies never multiply. In a table
slot, classes are compared with a few hubs a round, four times as many in each further one; classes linked already are
one component and are not compared again; this ends when every slot holds one component or all its pairs are refuted.

Defined cases: null, unreadable and too small or flat images have no descriptors and are linked with nothing but equal
bytes (null with nothing); repeated rows are copies; rows without media_id are linked only by the bytes of a row with one;
very large images are described whole; of equally near descriptors the first counts; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import SALTS, Powers, Words, mix, row_batches
from .common import discard, tidy_shuffles, written
from .jaccard import components

BITS, TABLES = 256, 8
SCALES, CORNERS, RADIUS, TURNS = (1.0, 0.5), 16, 7, 32
AREA = 6  # a corner no weaker than any within so many pixels is kept, so their number grows with the image and crops keep theirs
NEAR, CONSENSUS = 48, 6
HUBS = 4
BROADCAST_PAIRS = 1_000_000
PIXELS, BLOCK = 1 << 20, 4096  # pixels of images and corners or matches worked on at once: bound the memory of a task, drop nothing

_rng = np.random.default_rng(41)
_tests = np.clip(_rng.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS + 2, RADIUS - 2)
_angle = np.arange(TURNS) * 2 * np.pi / TURNS
_turn = np.stack([np.stack([np.cos(_angle), -np.sin(_angle)], -1), np.stack([np.sin(_angle), np.cos(_angle)], -1)], -2)
PATTERN = np.rint(np.einsum("tij,bpj->tbpi", _turn, _tests)).astype(np.int64)
_y, _x = np.mgrid[-RADIUS + 2 : RADIUS - 1, -RADIUS + 2 : RADIUS - 1]
DISC = np.stack([_y, _x], -1).reshape(-1, 2)[(_y**2 + _x**2 <= (RADIUS - 2) ** 2).ravel()]

HEADER = re.compile(rb"^P5\s+(\d+)\s+(\d+)\s+(\d+)\s")


def decoded(raw: bytes | None) -> np.ndarray | None:
    m = HEADER.match(raw) if raw else None
    if not m:
        return None
    w, h = int(m[1]), int(m[2])
    if w * h == 0 or len(raw) - m.end() < w * h:
        return None
    return np.frombuffer(raw, np.uint8, w * h, m.end()).reshape(h, w)


def encoded(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def shrunk(a: np.ndarray, scale: float) -> np.ndarray:
    """Images (n, h, w) at a scale, by averaging four neighbours around each sampling point."""
    if scale == 1.0:
        return a
    h, w = int(a.shape[1] * scale), int(a.shape[2] * scale)
    y, x = np.minimum((np.arange(h) / scale).astype(int), a.shape[1] - 2), np.minimum((np.arange(w) / scale).astype(int), a.shape[2] - 2)
    return (a[:, y][:, :, x] + a[:, y + 1][:, :, x] + a[:, y][:, :, x + 1] + a[:, y + 1][:, :, x + 1]) / 4


def box(a: np.ndarray) -> np.ndarray:
    """Sum over 3 x 3, zero at the rim."""
    out = np.zeros_like(a)
    rows = a[:, :-2] + a[:, 1:-1] + a[:, 2:]
    out[:, 1:-1, 1:-1] = rows[:, :, :-2] + rows[:, :, 1:-1] + rows[:, :, 2:]
    return out


def corners(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Image, row and column of corners of images (n, h, w): the strongest of each AREA, and the `most` strongest of each image."""
    gx, gy = np.zeros_like(a), np.zeros_like(a)
    gx[:, :, 1:-1] = a[:, :, 2:] - a[:, :, :-2]
    gy[:, 1:-1] = a[:, 2:] - a[:, :-2]
    xx, yy, xy = box(gx * gx), box(gy * gy), box(gx * gy)
    strength = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    rim = RADIUS + 1
    s = strength[:, rim:-rim, rim:-rim]
    if s.size == 0:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    top = s.copy()
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            top = np.maximum(top, strength[:, rim + dy : strength.shape[1] - rim + dy, rim + dx : strength.shape[2] - rim + dx])
    peak = np.where((s >= top) & (s > 200.0), s, 0)
    wide = peak.copy()
    for axis in (1, 2):
        flat = wide.copy()
        for d in range(1, min(AREA, peak.shape[axis] - 1) + 1):
            low, high = [slice(None)] * 3, [slice(None)] * 3
            low[axis], high[axis] = slice(None, -d), slice(d, None)
            wide[tuple(low)] = np.maximum(wide[tuple(low)], flat[tuple(high)])
            wide[tuple(high)] = np.maximum(wide[tuple(high)], flat[tuple(low)])
    kept = (peak >= wide).reshape(len(a), -1)
    peak = peak.reshape(len(a), -1)
    k = min(most, peak.shape[1])
    np.put_along_axis(kept, np.argpartition(-peak, k - 1, axis=1)[:, :k], True, axis=1)
    image, at = np.nonzero(kept & (peak > 0))
    return image, at // s.shape[2] + rim, at % s.shape[2] + rim


def described(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For images (n, h, w) of one size: image, place (row, column, scale, angle) and bits (as 32 bytes) of each corner."""
    images, places, bits = [], [], []
    for scale in SCALES:
        level = shrunk(a.astype(np.float32), scale)
        if min(level.shape[1:]) < 2 * RADIUS + 3:
            continue
        image, y, x = corners(level, CORNERS if scale == 1.0 else CORNERS // 2)
        if not len(image):
            continue
        soft = box(level)
        for at in range(0, len(image), BLOCK):
            i, r, c = image[at : at + BLOCK], y[at : at + BLOCK], x[at : at + BLOCK]
            patch = soft[i[:, None], r[:, None] + DISC[:, 0], c[:, None] + DISC[:, 1]]
            angle = np.arctan2((patch * DISC[:, 0]).sum(1), (patch * DISC[:, 1]).sum(1))
            p = PATTERN[np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS]
            # the pattern is in (column, row) order, as the angle is measured from the column axis
            one = soft[i[:, None], r[:, None] + p[:, :, 0, 1], c[:, None] + p[:, :, 0, 0]]
            two = soft[i[:, None], r[:, None] + p[:, :, 1, 1], c[:, None] + p[:, :, 1, 0]]
            images.append(i)
            places.append(np.stack([r / scale, c / scale, np.full(len(r), 1 / scale), angle], 1))
            bits.append(np.packbits(one > two, axis=1))
    if not images:
        return np.zeros(0, np.int64), np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8)
    return np.concatenate(images), np.concatenate(places), np.concatenate(bits)


def features(media: DataFrame) -> DataFrame:
    """media_id, fp (number of the image's bytes, null for none), n_features, places and bits (packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            n = len(raw)
            count, place, bit = np.zeros(n, np.int64), [b""] * n, [b""] * n
            sizes: dict = {}
            for i, image in enumerate(map(decoded, raw)):
                if image is not None:
                    sizes.setdefault(image.shape, []).append((i, image))
            for group in sizes.values():
                step = max(1, min(256, PIXELS // group[0][1].size))
                for at in range(0, len(group), step):
                    part = group[at : at + step]
                    image, where, bits = described(np.stack([x for _, x in part]))
                    order = np.argsort(image, kind="stable")
                    cut = np.searchsorted(image[order], np.arange(len(part) + 1))
                    for k, (i, _) in enumerate(part):
                        rows = order[cut[k] : cut[k + 1]]
                        count[i], place[i], bit[i] = len(rows), where[rows].astype(np.float32).tobytes(), bits[rows].tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(count), pa.array(place, pa.binary()), pa.array(bit, pa.binary())], names=["media_id", "fp", "n_features", "places", "bits"])

    rows = media.select(F.col("media_id").cast("long").alias("media_id"), F.col("image").cast("binary").alias("image"))
    rows = rows.withColumn("fp", F.when(F.col("image").isNotNull(), F.xxhash64("image")))
    return rows.mapInArrow(run, "media_id long, fp long, n_features long, places binary, bits binary")


def parts(bits: bytes) -> np.ndarray:
    """A number for each table and descriptor."""
    words = np.frombuffer(bits, np.uint32).reshape(-1, TABLES, BITS // 32 // TABLES).astype(np.uint64)
    return mix((words * SALTS[50 : 50 + words.shape[2]]).sum(2, dtype=np.uint64) ^ SALTS[55 : 55 + TABLES])


def slots(one: DataFrame) -> DataFrame:
    """sig (table and bits) and fp of every descriptor and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            sigs = [np.unique(parts(x)) for x in b.column(1).to_pylist()]
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(fp, [len(x) for x in sigs]))], names=["sig", "fp"])

    return one.select("fp", "bits").mapInArrow(run, "sig long, fp long")


def consensus(pa_: np.ndarray, ba: np.ndarray, pb: np.ndarray, bb: np.ndarray) -> int:
    """Largest number of nearest-descriptor matches that agree on scale, rotation and shift; CONSENSUS or more ends the count."""
    if not len(pa_) or not len(pb):
        return 0
    step = max(1, BLOCK * 64 // len(bb))
    j, near = np.zeros(len(ba), np.int64), np.zeros(len(ba), bool)
    for at in range(0, len(ba), step):
        apart = np.bitwise_count(ba[at : at + step, None, :] ^ bb[None, :, :]).sum(2)
        j[at : at + step] = apart.argmin(1)
        near[at : at + step] = apart.min(1) <= NEAR
    i = np.nonzero(near)[0]
    j = j[i]
    if len(i) < CONSENSUS:
        return 0
    best = 0
    scale, turn = pb[j, 2] / pa_[i, 2], pb[j, 3] - pa_[i, 3]
    for s, t in zip(scale, turn):
        same = (np.abs(scale / s - 1) < 0.3) & (np.abs((turn - t + np.pi) % (2 * np.pi) - np.pi) < 0.35)
        if same.sum() <= best:
            continue
        c, d = np.cos(t) * s, np.sin(t) * s
        a, b = i[same], j[same]
        # where each matched corner of A falls in B, up to a shift; then how many share the shift
        moved = np.stack([pb[b, 1] - (c * pa_[a, 1] - d * pa_[a, 0]), pb[b, 0] - (d * pa_[a, 1] + c * pa_[a, 0])], 1)
        for at in range(0, len(moved), 512):
            close = (np.abs(moved[at : at + 512, None] - moved[None]) < 4.0).all(2)
            best = max(best, int(close.sum(1).max()))
            if best >= CONSENSUS:
                return best
    return best


def verified(pairs: DataFrame, one: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(2, 6)]
            keep = [consensus(np.frombuffer(p, np.float32).reshape(-1, 4), np.frombuffer(x, np.uint64).reshape(-1, 4), np.frombuffer(q, np.float32).reshape(-1, 4), np.frombuffer(y, np.uint64).reshape(-1, 4)) >= CONSENSUS for p, x, q, y in zip(*columns)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    if pairs.count() <= BROADCAST_PAIRS:  # then they go to the images, not all images to them
        ends = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
        pairs, one = F.broadcast(pairs), one.join(F.broadcast(ends), "fp", "left_semi")
    left, right = (one.select(F.col("fp").alias(k), F.col("places").alias(f"p{k}"), F.col("bits").alias(f"x{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "xa", "pb", "xb").mapInArrow(run, "a long, b long")


def copies(media: DataFrame) -> DataFrame:
    """media_id, n_features, component_id: the least media_id reachable by copies, itself included."""
    spark = media.sparkSession
    with tidy_shuffles(spark):
        seen = written(features(media), "features")
        # the first row of an image stands for all rows with its bytes
        first = seen.filter("n_features > 0").groupBy("fp").agg(F.min("media_id").alias("media_id"))
        every = seen.join(first, ["fp", "media_id"], "left_semi")
        by_sig = Window.partitionBy("sig")
        held = slots(every).withColumn("x", F.min("fp").over(by_sig)).withColumn("y", F.max("fp").over(by_sig)).filter("x < y").select("sig", "fp")
        held = written(held, "slots")
        one = written(every.join(held.select("fp").distinct(), "fp", "left_semi").select("fp", "places", "bits").dropDuplicates(["fp"]), "images")
        roots, links, peeled, hubs = None, None, 0, HUBS
        while True:
            now = held.withColumn("root", F.col("fp")) if roots is None else held.join(roots, held["fp"] == roots["node"], "left").select("sig", "fp", F.coalesce("root", "fp").alias("root"))
            size = F.count("*").over(by_sig)
            now = now.withColumn("lo", F.min("root").over(by_sig)).withColumn("hi", F.max("root").over(by_sig)).withColumn("size", size).filter(f"lo < hi and size > {peeled + 1}")
            now = written(now.select("sig", "fp", "root"), "open")
            if now.isEmpty():
                break
            ranked = now.withColumn("at", F.row_number().over(by_sig.orderBy("fp")))
            middle = ranked.filter(f"at > {peeled} and at <= {peeled + hubs}").select("sig", F.col("fp").alias("hub"), F.col("root").alias("hroot"), F.col("at").alias("hat"))
            pairs = ranked.join(middle, "sig").filter("at > hat and root <> hroot").select(F.greatest("fp", "hub").alias("a"), F.least("fp", "hub").alias("b")).distinct()
            pairs = written(pairs, "pairs")
            new = written(verified(pairs, one), "links")
            discard(pairs)
            links = new if links is None else written(links.union(new), "links")
            roots = components(links, "roots") if not links.isEmpty() else None
            discard(held)
            held = now.select("sig", "fp")
            held._scratch = now._scratch  # type: ignore[attr-defined]
            peeled, hubs = peeled + hubs, hubs * 4
    of = seen.withColumn("root", F.col("fp")) if roots is None else seen.join(roots, seen["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    least = of.filter("root is not null").groupBy("root").agg(F.min("media_id").alias("component_id"))
    return of.join(least, "root", "left").select("media_id", "n_features", F.coalesce("component_id", "media_id").alias("component_id"))


SHADE = np.uint64(0xD6E8FEB86659FD93)


def drawn(words: np.ndarray, every: int = 48, across: int = 4, cells: int = 5, pixels: int = 3) -> np.ndarray | None:
    """A picture of a text, given its words' numbers: tiles of random grey cells in reading order, `across` in a row.

    A tile stands for a run of words that ends at a word whose number `every` divides, about every so many words: all words
    take part, and an edit changes its own tile only. Short texts repeat their tiles to fill `across` rows.
    """
    if not len(words):
        return None
    ends = mix(words) % np.uint64(every) == 0
    first = np.append(0, np.nonzero(ends[:-1])[0] + 1)
    place = np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words))))
    key = mix(np.add.reduceat(mix(words + place.astype(np.uint64) * SALTS[60]), first))
    grey = (mix(key[:, None] + np.arange(cells * cells, dtype=np.uint64) * SHADE) >> np.uint64(56)).astype(np.uint8)
    down = max(across, -(-len(key) // across))
    tiles = grey[np.arange(down * across) % len(key)].reshape(down, across, cells, cells)
    return tiles.transpose(0, 2, 1, 3).reshape(down * cells, across * cells).repeat(pixels, 0).repeat(pixels, 1)


def page_images(pages: DataFrame) -> DataFrame:
    """A picture of each page, as the test tables hold none: its whole text as tiles, so pages that share passages share tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in row_batches(batches):
            w = Words(b.column(1), powers)
            pictures = [drawn(w.number[a:z]) for a, z in zip(w.first[:-1], w.first[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if p is None else encoded(p) for p in pictures], pa.binary())], names=["media_id", "image"])

    rows = pages.select(F.col("page_id").cast("long").alias("media_id"), F.col("html").cast("string").alias("text"))
    return rows.mapInArrow(run, "media_id long, image binary")
