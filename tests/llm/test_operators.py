"""Each training-data operator against brute force, a round trip, or planted cases; and its defined edge cases."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayloom.llm import ann, bytewords, chat, jaccard, katz, licences, media, mixing, packing, pii, toxicity

WORD = r"[^\x20\x09-\x0D]+"
EDGE = [
    (1001, None, None, None), (1002, "", "a", None), (1003, " \n\t ", "a", "en"), (1004, "one", None, "en"), (1005, "one", "b", "en"),
    (1006, "a b c d", "b", None), (1007, "É é ñ \U0001f600 x y z w", "c", "fr"), (1008, "long " * 3000 + "end", "a", "en"), (1006, "a b c d", "b", None), (None, "no id here at all", "b", "en"),
]
SCHEMA = "doc_id long, text string, source string, lang string"


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def words(t):
    return re.findall(WORD, lower(t))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % vocabulary)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    rows = [(i, prose(rng, int(rng.integers(1, 120))), "abc"[i % 3] if i % 7 else None, "en") for i in range(120)]
    for k in range(40):  # near copies and copies
        w = rows[k][1].split()
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(0, len(w)))] = f"x{int(rng.integers(0, 1000))}"
        rows.append((200 + k, " ".join(w), "a", "de"))
    return rows + EDGE


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, SCHEMA).withColumn("n_chars", F.length("text").cast("long")).withColumn("size", F.lit("clash")).withColumn("sig", F.lit(1)).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- words ------------------------------------------------------------------------------------------------------


def test_words_are_those_of_the_pattern(texts):
    column = pa.array([t for _, t, _, _ in texts])
    w = bytewords.Words(column)
    seen: dict = {}
    for i, (_, t, _, _) in enumerate(texts):
        mine = w.number[w.first[i] : w.first[i + 1]]
        assert len(mine) == len(words(t))
        for a, b in zip(words(t), mine):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


# -- op1 --------------------------------------------------------------------------------------------------------


def test_mixing_meets_targets_and_caps(docs, texts):
    out = mixing.mix(docs).collect()
    assert sorted(((r["doc_id"], r["size"]) for r in out), key=str) == sorted(((i, len(words(t))) for i, t, _, _ in texts), key=str)
    sizes = collections.Counter()
    for _, t, s, _ in texts:
        sizes[s] += len(words(t))
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    fixed: dict = {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = 1.5 * sum(sizes.values()) - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            break
        fixed |= {s: 2.0 * sizes[s] for s in over}
    want = fixed | share
    assert {round(r["target"], 6) for r in out} == {round(v, 6) for v in want.values()}
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    taken = collections.Counter()
    for r in out:
        taken[round(r["target"], 6)] += r["taken"]
    for v in want.values():
        assert abs(taken[round(v, 6)] - v) <= 2 * mixing.BLOCK
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))


def test_mixing_permutation_is_one(spark):
    n = 1000
    p = spark.range(n).select(mixing.permuted("id", f"{n}L", "7L").alias("p")).collect()
    assert sorted(r["p"] for r in p) == list(range(n))
    assert [r["p"] for r in p] != list(range(n))


def test_mixed_documents_hold_the_taken_words(docs):
    taken = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(words(r["text"])) for r in out.collect()) >= taken - 4 * 2  # repeated rows share one identity
    assert mixing.mix(empty(docs.sparkSession)).count() == 0


# -- op2 --------------------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for _, t, _, _ in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            parent[find(j)] = find(i)
    least: dict = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, *_) in enumerate(rows))


def test_near_duplicates_equal_brute_force(docs, texts):
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect())
    assert got == brute_components(texts)
    assert jaccard.near_duplicates(empty(docs.sparkSession)).count() == 0


def test_near_duplicates_of_a_large_edited_family(spark):
    """Hot entries: many versions of one text, most of which link only along chains, and a passage all others share."""
    rng = np.random.default_rng(9)
    base, passage = prose(rng, 60, 5000).split(), prose(rng, 30, 5000)
    rows, now = [], base
    for i in range(90):
        source = now if i % 3 else base
        w = list(source)
        for _ in range(int(rng.integers(1, 4))):
            w[int(rng.integers(0, len(w)))] = f"e{int(rng.integers(0, 40))}"
        now = w
        rows.append((i, " ".join(w), "a", "en"))
    rows += [(500 + i, prose(rng, int(rng.integers(5, 60)), 5000) + " " + passage, "a", "en") for i in range(60)]
    rows += [(800 + i, " ".join(f"t{int(x)}" for x in rng.integers(0, 3, int(rng.integers(1, 12)))), "a", "en") for i in range(80)]
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute_components(rows)


def test_deduplicated_keeps_one_of_each(docs, texts):
    want = {c for (_, _, c) in brute_components(texts) if c is not None}
    kept = [r["doc_id"] for r in jaccard.deduplicated(docs).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == want


def test_least_common_agrees_with_its_expression(spark):
    n = np.arange(3, 5000)
    got = [r[0] for r in spark.range(3, 5000).orderBy("id").select(jaccard.least_common_sql(F.col("id"))).collect()]
    assert got == jaccard.least_common(n).tolist()


# -- op3 --------------------------------------------------------------------------------------------------------


def picture(seed, n=128):
    rng = np.random.default_rng(seed)
    c = np.full((n, n), 128, np.uint8)
    for _ in range(60):
        y, x = rng.integers(0, n, 2)
        h, w = rng.integers(4, 30, 2)
        c[y : y + h, x : x + w] = rng.integers(0, 255)
    return c


def test_media_copies_are_found(spark):
    rows = []
    for s in range(8):
        c = picture(s)
        rows += [(s, c), (100 + s, c[10:110, 14:120]), (200 + s, np.clip(c.astype(int) * 0.9 + 12, 0, 255)), (300 + s, np.rot90(c))]
    rows = [(i, media.encoded(np.asarray(c))) for i, c in rows]
    flat = media.encoded(np.full((40, 40), 7))
    rows += [(400, None), (401, b""), (402, b"P5 9 9 255\nshort"), (403, flat), (404, flat)]
    got = {r["media_id"]: r["component_id"] for r in media.copies(spark.createDataFrame(rows, "media_id long, image binary")).collect()}
    assert all(got[k + s] == s for k in (0, 100, 200, 300) for s in range(8))
    assert [got[k] for k in range(400, 405)] == [400, 401, 402, 403, 403]
    assert media.copies(spark.createDataFrame([], "media_id long, image binary")).count() == 0


# -- op4 --------------------------------------------------------------------------------------------------------


def test_preferences_split_at_the_common_prefix(spark):
    turn = "array<struct<turn:long,role:string,text:string>>"
    a = [(0, "user", "hi"), (1, "assistant", "x"), (2, "user", "more"), (3, "assistant", "yes")]
    b = [*a[:3], (3, "assistant", "noé"), (4, "user", "why")]
    rows = [(1, a, b), (2, a, a), (3, [], a), (4, a, [])]
    out = {r["id"]: r for r in chat.preferences(spark.createDataFrame(rows, f"id int, chosen {turn}, rejected {turn}")).collect()}
    render = lambda t: "".join(f"<|{r}|>\n{x}<|end|>\n" for _, r, x in t)
    assert out[1]["common"] == 3 and out[1]["prompt"] == render(a[:3])
    assert out[1]["prompt"] + out[1]["chosen_completion"] == render(a) and out[1]["prompt"] + out[1]["rejected_completion"] == render(b)
    assert [out[1]["rejected_completion"][m["start"] : m["stop"]] for m in out[1]["rejected_mask"]] == ["noé<|end|>"]
    assert (out[2]["chosen_completion"], out[2]["rejected_completion"], out[2]["chosen_mask"]) == ("", "", [])
    assert out[3]["prompt"] == "" and out[3]["rejected_completion"] == render(a) and out[4]["chosen_completion"] == render(a)


def test_chat_edge_cases(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (None, 0, "user", "lost"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a")]
    talks = {r["conv_id"]: r["turns"] for r in chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(talks) == {1, 2} and len(talks[2]) == 2 and talks[1][0]["text"] == ""
    assert chat.digest(chat.preferences(chat.swapped(chat.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))))).count() == 0


# -- op5 --------------------------------------------------------------------------------------------------------


def test_toxicity_learns_planted_words(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        w = prose(rng, int(rng.integers(10, 80)), 3000).split()
        if bad:
            for _ in range(int(rng.integers(1, 4))):
                w[int(rng.integers(0, len(w)))] = "Vile" + "abcde"[int(rng.integers(0, 5))] * 2 if i % 4 else "scorn!!"
        rows.append((i, " ".join(w), "a", "en"))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*rows, *EDGE], SCHEMA)
    out = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) + len(EDGE)
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 900 and r["held_out"]]
    assert {zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in held} == {0}
    right = [(r["predicted"] == 1) == (r["doc_id"] % 6 == 0) for r in held]
    assert np.mean(right) > 0.97
    spans = [rows[r["doc_id"]][1].encode()[s["start"] : s["stop"]].decode() for r in held for s in r["spans"]]
    assert spans and all(w.startswith(("Vile", "scorn")) for w in spans)
    assert all(r["predicted"] == 0 for r in out if r["doc_id"] is None or r["doc_id"] > 900)


def test_chain_messages_equal_plain_forward():
    rng = np.random.default_rng(1)
    lengths = np.array([0, 1, 5, 200, 3, 0, 70])
    first = np.append(0, np.cumsum(lengths))
    score, turn = rng.normal(0, 2, first[-1]), rng.normal(0, 1, (2, 2))
    got = toxicity.messages(score, first[:-1], lengths, turn)
    for a, n in zip(first, lengths):
        p = np.ones(2)
        for t in range(a, a + n):
            assert math.isclose(got[t], math.log(p[1] / p[0]), abs_tol=1e-9)
            q = p * np.array([1, math.exp(score[t])])
            p = q @ np.exp(turn)
            p /= p.sum()


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(spark.createDataFrame(EDGE, SCHEMA), none).collect()
    assert len(out) == len(EDGE) and {r["score"] for r in out} == {0.0}
    assert toxicity.toxicity(empty(spark), none).count() == 0


# -- op6 --------------------------------------------------------------------------------------------------------


def test_packing_round_trip(docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_paths()[0])
    extra = [(1, "special <|endoftext|> inside", "a", "en")]
    rows = packing.pack(docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(extra, SCHEMA).select("doc_id", "text"))).collect()
    want = collections.Counter()
    for d, t, _, _ in [*texts, *extra]:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 2048):
            want[d, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids)] += 1
    assert collections.Counter(tuple(r[:5]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack(empty(docs.sparkSession)).count() == 0


def test_fill_wastes_little():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 2048, 5000)
    sequence, offset, n = packing.fill(lengths)
    used = np.bincount(sequence, weights=lengths)
    assert used.max() <= 2048 and 2048 * n / lengths.sum() < 1.01
    groups = packing.step_groups(used**2)
    assert np.bincount(groups).max() - np.bincount(groups).min() <= 1


# -- op7 --------------------------------------------------------------------------------------------------------


def brute_katz(rows, order):
    start, end = ("<s>",), ("</s>",)
    train = [[*words(t), end] for d, t, *_ in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    grams = [None] + [collections.Counter() for _ in range(order)]
    for w in train:
        for i in range(len(w)):
            for k in range(1, order + 1):
                h = tuple(w[j] if j >= 0 else start for j in range(i - k + 1, i))
                grams[k][h, w[i]] += 1
    total, cuts = sum(grams[1].values()), (0, 1, 2, 2, 2)
    d = [None] + [katz.discounts([sum(c == r for c in grams[k].values()) for r in range(1, 7)]) for k in range(1, order + 1)]
    dis = lambda k, c: d[k][c] if c <= 5 else 1.0
    kept = sum(dis(1, c) * c for c in grams[1].values()) / total
    least = 1 / (total + len(grams[1]) + 1)
    scale1 = 1.0 if 1 - kept >= least else (1 - least) / kept
    followers = [None, None] + [collections.defaultdict(dict) for _ in range(2, order + 1)]
    hcount = [None, None] + [collections.Counter() for _ in range(2, order + 1)]
    for k in range(2, order + 1):
        for (h, w), c in grams[k].items():
            hcount[k][h] += c
            if c >= cuts[k]:
                followers[k][h][w] = c

    def p(k, h, w):
        if k == 1:
            c = grams[1][(), w]
            return scale1 * dis(1, c) * c / total if c else 1 - kept * scale1
        f = followers[k].get(h)
        if not f:
            return p(k - 1, h[1:], w)
        n = hcount[k][h]
        mass = sum(dis(k, c) * c / n for c in f.values())
        g = 1.0 if 1 - mass >= 1 / (n + 1) else (1 - 1 / (n + 1)) / mass
        if w in f:
            return g * dis(k, f[w]) * f[w] / n
        return (1 - g * mass) / (1 - sum(p(k - 1, h[1:], v) for v in f)) * p(k - 1, h[1:], w)

    out = []
    for doc, t, *_ in rows:
        w = [*words(t), end]
        s = sum(math.log10(p(order, tuple(w[j] if j >= 0 else start for j in range(i - order + 1, i)), w[i])) for i in range(len(w)))
        b = sum(math.log10((grams[1][(), x] + 1) / (total + len(grams[1]) + 1)) for x in w)
        out.append((doc, len(w), sum(grams[1][(), x] > 0 for x in w), total, b, s))
    vocabulary = [w for (_, w) in grams[1]] + ["\0unknown"]
    for h in list(followers[order])[:5]:
        assert math.isclose(sum(p(order, h, w) for w in vocabulary), 1, abs_tol=1e-9)
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_katz_equals_brute_force(docs, texts, order):
    key = lambda r: (str(r[0]), round(r[-1], 6))
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in katz.score(docs, order=order).collect()), key=key)
    want = sorted(brute_katz(texts, order), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], atol=1e-7)
    held = {r["doc_id"]: r["held_out"] for r in katz.score(docs).collect() if r["doc_id"] is not None}
    assert all(v == (zlib.crc32(str(k).encode()) % 7 == 2) for k, v in held.items())


def test_katz_with_nothing(spark):
    assert katz.score(empty(spark)).count() == 0
    out = katz.score(spark.createDataFrame([(None, "a b", "x", "en")], SCHEMA)).collect()
    assert out[0]["score"] == 0 and out[0]["train_tokens"] == 0


def test_squeezed_arrays_come_back():
    a = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64))
    assert (katz.unsqueezed(katz.squeezed(a, True), np.uint64, True) == a).all()
    assert len(katz.unsqueezed(katz.squeezed(np.zeros(0, np.uint32)), np.uint32)) == 0


# -- op8 --------------------------------------------------------------------------------------------------------


def brute_licence(text):
    best = (0, None)
    flat = lower(text)
    units = {*flat.split("\n"), *re.split(r"\n[^a-z0-9]*\n", re.sub(r"[^a-z0-9\n]+", " ", flat)), flat}
    found = {}
    for u in units:
        g = set(licences.bigrams(u))
        for name, t in licences.listed(licences.TEMPLATES):
            score = 2 * len(g & set(t)) / (len(g) + len(t)) if g else 0
            if score >= licences.THRESHOLD:
                k = " ".join(re.findall("[a-z0-9]+", u))
                found[k] = max(found.get(k, (0, "")), (score, name))
    for s, n in found.values():
        if s > best[0] or s == best[0] and n < best[1]:
            best = (s, n)
    return len(found), best[1]


def test_licences_equal_brute_force(spark):
    mit = licences.TEMPLATES["MIT"][1]
    rows = [
        "Released under the MIT License.", "x\nReleased under the  mit license\ny", mit, mit.replace("free of charge", "at no cost"), mit.replace(", to any person", ",\nto any person"), "para one\n\n" + mit.replace(" to ", "\nto ") + "\n\nend",
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0", "released under license", "license " * 500, None, "", "a", "no licence\nhere",
    ]
    out = {r["doc_id"]: (r["n_matches"], r["licence"]) for r in licences.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert out == {i: brute_licence(t or "") for i, t in enumerate(rows)}
    assert out[0] == (1, "MIT") and out[5][1] == "MIT"


# -- op9 --------------------------------------------------------------------------------------------------------


def test_ann_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 16))
    v[100:1100] = v[100]  # a third of all rows are one vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5050, [0.0] * 16), (5100, [math.nan] * 16), (5150, [None] * 16), (5200, [1.0]), (0, v[0].tolist()), (None, v[1].tolist())]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 50 = 0").collect()
    got = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 50))
    hits = 0
    for q, found in got.items():
        s = v @ v[q] / np.linalg.norm(v, axis=1) / np.linalg.norm(v[q])
        s[q] = -9
        best = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]
        hits += len({f for f, _ in found} & set(best.tolist()))
        assert all(abs(s[i] - x) < 1e-12 for i, x in found) and len(found) == 5
    assert hits / 300 >= 0.9
    assert [f for f, _ in got[100]] == [101, 102, 103, 104, 105]


def test_ann_with_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"]) for r in ann.nearest(few, "vec_id = 0").orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest(few.filter("vec_id > 5"), "vec_id = 0").count() == 0


# -- op10 -------------------------------------------------------------------------------------------------------


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def strict_spans(t):
    def good(k, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[k]

    return [f"{k}:{m.start()}:{m.end()}" for k in pii.KINDS for m in re.finditer(PLAIN[k], t or "") if good(k, m[0])]


PRIVATE = [
    None, "", "a@b.cd_x@e.fg a@b", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "é" * 10 + " +1 (555) 555-1234x 4111 1111 1111 1111", "4111111111111111 " * 300, "1" * 5000, "a" * 5000 + "@b.c",
    "a." * 3000 + "@x.y" + ".z" * 3000, "+1-555-555-1234" * 3 + " +", "12-" * 300, " +33 1 23 45 67 89\U0001f600 x@y.zz", "0000000000000000 x", "1.1.1.1 mail a.b@c.d.e, +49 (0) 30 1234567.",
]


def test_pii_base_spans_equal_the_plain_patterns(spark):
    docs = spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string")
    a = pii.annotate(docs)
    for r in pii.digest(pii.selected(a, pii.fit(a))).collect():
        want = strict_spans(PRIVATE[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        assert set(want) <= set(r["spans"].split(",")) or not want


def test_pii_carries_over_to_spans_without_the_cue(spark):
    rows = [(i, f"call me on {'+' if i % 60 else ''}1 (5{i % 90 + 10}) 555-{i % 9000 + 1000} today") for i in range(1200)]
    a = pii.annotate(spark.createDataFrame(rows, "doc_id long, text string"))
    out = {r["doc_id"]: r for r in pii.digest(pii.selected(a, pii.fit(a))).collect()}
    assert all(out[i]["spans"].startswith("phone:11:") or "phone:" in out[i]["spans"] for i in range(0, 1200, 60))
    assert all(out[i]["n_phone"] == (1 if i % 60 else 0) for i in range(1200))


def test_redaction_replaces_spans_only(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(PRIVATE)], "doc_id long, text string, extra int")
    out = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert out[0]["text"] is None and out[1]["text"] == "" and out[13]["text"] == "[IP] mail [EMAIL], [PHONE]."
    assert out[11]["text"] == " [PHONE]\U0001f600 [EMAIL]" and out[6]["text"] == PRIVATE[6]
    assert all(r["extra"] == i for i, r in out.items())


# -- the pipeline -----------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(4)
    rows = [(i, prose(rng, 40, 3000) + (" vileword" if i % 5 == 0 else ""), "ab"[i % 2], "en", 5) for i in range(300)]
    rows += [(1000 + i, rows[i][1], "a", "en", 5) for i in range(20)] + [(2000, "write to me@home.org now please", "b", "en", 5), (2001, None, None, None, None)]
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(d.columns == docs.columns for d in seen[1:-1])
    clean = {r["doc_id"] for r in seen[1].collect()}
    assert not any(i % 5 == 0 for i in clean if i < 300) and {i for i in range(300) if i % 5} <= clean
    one = {r["doc_id"] for r in seen[2].collect()}
    assert not any(1000 <= i < 1020 and (i - 1000) % 5 for i in one) and {i for i in range(300) if i % 5} <= one
    assert [r["text"] for r in seen[3].filter("doc_id = 2000").collect()] == ["write to [EMAIL] now please"]
    assert set(r["doc_id"] for r in seen[4].collect()) <= one and seen[5].count() >= seen[4].count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[5].count()
