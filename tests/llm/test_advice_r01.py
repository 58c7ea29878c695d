"""Cases of the first round's advice: each failed before its finding was settled."""

import collections
import math
import zlib

import numpy as np

from assayloom.llm import katz, media, packing, pii, queries, toxicity

# -- op3 --------------------------------------------------------------------------------------------------------


def boxes(seed, n=128):
    rng = np.random.default_rng(seed)
    c = np.full((n, n), 128, np.uint8)
    for _ in range(60 * n * n // 16384):
        y, x = rng.integers(0, n, 2)
        h, w = rng.integers(4, 30, 2)
        c[y : y + h, x : x + w] = rng.integers(0, 255)
    return c


def rescaled(c, k):
    at = (np.arange(int(len(c) * k)) + 0.5) / k - 0.5
    low = np.clip(np.floor(at).astype(int), 0, len(c) - 2)
    w = np.clip(at - low, 0, 1)
    rows = c[low] * (1 - w)[:, None] + c[low + 1] * w[:, None]
    return rows[:, low] * (1 - w) + rows[:, low + 1] * w


def told(c):
    _, place, bits = media.described(np.asarray(c).astype(np.uint8)[None])
    return place.astype(np.float32), bits


def agree(a, b):
    return media.consensus(a[0], a[1].view(np.uint64), b[0], b[1].view(np.uint64)) >= media.CONSENSUS


def meet(a, b):
    return len(np.intersect1d(media.parts(a[1].tobytes()), media.parts(b[1].tobytes()))) > 0


def test_media_tables_find_what_brute_force_finds():
    """Noise, blur and rescaling change bits of every descriptor: of the pairs that all-pairs consensus links, few may be missed."""
    rng, pairs = np.random.default_rng(0), []
    for s in range(30):
        c = boxes(s, 64).astype(float)
        blur = media.box(np.pad(c, 1, "edge")[None])[0][1:-1, 1:-1] / 9
        pairs += [(told(c), told(e)) for e in (np.clip(c + rng.normal(0, 2, c.shape), 0, 255), np.clip(c + rng.normal(0, 8, c.shape), 0, 255), blur, rescaled(c, 0.9))]
    true = [p for p in pairs if agree(*p)]
    assert len(true) > 100 and np.mean([meet(*p) for p in true]) >= 0.9


def test_media_crops_of_large_images_are_found():
    for s in range(3):
        c = boxes(900 + s, 512)
        whole = told(c)
        for y, x in ((40, 60), (200, 300), (410, 131), (333, 17)):
            crop = told(c[y : y + 80, x : x + 80])
            assert meet(whole, crop) and agree(whole, crop)


# -- op7 --------------------------------------------------------------------------------------------------------


def full_katz(rows, order):
    """Scores of the rows with every n-gram kept, those of count 1 too."""
    train = [[*t.split(), "</s>"] for d, t in rows if zlib.crc32(str(d).encode()) % katz.FOLDS != katz.HELD]
    gram = lambda w, i, k: tuple(w[j] if j >= 0 else "<s>" for j in range(i - k + 1, i + 1))
    counts = [collections.Counter(gram(w, i, k) for w in train for i in range(len(w))) for k in range(order + 1)]
    d = [katz.discounts([sum(c == r for c in n.values()) for r in range(1, 7)]) for n in counts]
    total, follow, history = sum(counts[1].values()), collections.defaultdict(list), collections.Counter()
    for k in range(2, order + 1):
        for g, c in counts[k].items():
            follow[g[:-1]].append((g[-1], c))
            history[g[:-1]] += c
    off = lambda k, c: float(d[k][c]) if c <= 5 else 1.0

    def p(g):
        k = len(g)
        if k == 1:
            kept = sum(off(1, c) * c for c in counts[1].values()) / total
            least = 1 / (total + len(counts[1]) + 1)
            s = 1.0 if 1 - kept >= least else (1 - least) / kept
            c = counts[1][g]
            return s * off(1, c) * c / total if c else 1 - kept * s
        seen, n = follow.get(g[:-1]), history[g[:-1]]
        if not seen:
            return p(g[1:])
        mass = sum(off(k, c) * c / n for _, c in seen)
        s = 1.0 if 1 - mass >= 1 / (n + 1) else (1 - 1 / (n + 1)) / mass
        if c := counts[k][g]:
            return s * off(k, c) * c / n
        return (1 - s * mass) / (1 - sum(p((*g[1:-1], w)) for w, _ in seen)) * p(g[1:])

    return {i: sum(math.log10(p(gram(w, j, order))) for j in range(len(w))) for i, w in ((i, [*t.split(), "</s>"]) for i, t in rows)}


def test_katz_query_keeps_trigrams_and_ngrams_seen_once(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 12) % 40)) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in queries.op7_katz(spark, str(tmp_path)).collect()}
    want = full_katz(rows, 3)
    assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()), atol=1e-7)


# -- op6 --------------------------------------------------------------------------------------------------------


def test_packing_fills_each_tier_in_its_own_context_size(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("abcdefgh"[int(x)] for x in rng.integers(0, 8, int(n)))) for i, n in enumerate(rng.integers(1, 1900, 300))]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = collections.defaultdict(list)
    for r in out:
        held[r["sequence_id"]].append(r)
    sizes = collections.Counter()
    for parts in held.values():
        (tier,) = {r["tier"] for r in parts}
        sizes[tier] += 1
        longest = max(r["length"] for r in parts)
        assert sum(r["length"] for r in parts) <= tier == min(t for t in packing.TIERS if t >= longest)
    assert sizes[2048] and sizes[1024]
    lengths = rng.integers(1, 257, 500)
    sequence, _, n = packing.fill(lengths, 2048, packing.TIERS)
    used = np.bincount(sequence, weights=lengths)
    assert used.max() <= 256 and 256 * n / lengths.sum() < 1.02


# -- op10 -------------------------------------------------------------------------------------------------------


def test_pii_proposes_the_parts_of_adjacent_numbers(spark):
    texts = ["see 7536784127813050 4845168114407329 now", "+1 (826) 555-4081 190.137.223.204", "at 10 . 20 . 30 . 40 or 1.2.3.4", "1 " * 3000]
    rows = pii.annotate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: {(pii.KINDS[c["kind"]], texts[r["doc_id"]][c["start"] : c["stop"]]) for c in r["candidates"]} for r in rows}
    assert {("card", "7536784127813050"), ("card", "4845168114407329")} <= got[0]
    assert ("phone", "+1 (826) 555-4081") in got[1] and ("ip", "190.137.223.204") in got[1]
    assert {("ip", "10 . 20 . 30 . 40"), ("ip", "1.2.3.4")} <= got[2]
    assert all(len(r["candidates"]) <= 3000 * 19 * 2 for r in rows)


# -- op5 --------------------------------------------------------------------------------------------------------


def test_toxicity_learns_a_word_that_a_few_clean_documents_quote(spark):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = [f"w{int(x)}" for x in rng.zipf(1.3, 30) % 3000]
        if bad or i % 97 == 1:  # quoted or mislabelled: more than 2 % of the toxic documents, a small share of the clean ones
            w[int(rng.integers(0, 30))] = "vileword"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert field.trained
    odds = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, field).collect()}
    assert np.mean([odds[i] >= 0.5 for i in range(0, 600, 6)]) > 0.9


def test_toxicity_trains_on_a_single_toxic_document(spark):
    rows = [(i, "plain words here") for i in range(1, 30)] + [(31, "vile words here")]
    field = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i == 31)) for i, _ in rows], "doc_id long, toxic int"), holdout=False)
    assert field.trained
