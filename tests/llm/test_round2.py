"""Odd input, very long texts, clashing columns and methods that the second round mended."""

import collections
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assayloom.llm import ann, bytewords, chat, jaccard, katz, licences, media, mixing, packing, pii, toxicity

# -- words ------------------------------------------------------------------------------------------------------


def test_words_of_long_texts_are_the_same_in_stretches(monkeypatch):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abC dé \n"), int(n))) for n in rng.integers(0, 3000, 60)] + ["x" * 700, None, ""]
    whole = bytewords.Words(pa.array(texts))
    ends = lambda w: w.part(np.maximum(w.ends - 3, w.starts), w.ends)
    tails = ends(whole)
    for stretch in (512, 40):
        monkeypatch.setattr(bytewords, "STRETCH", stretch)
        w = bytewords.Words(pa.array(texts))
        assert (w.number == whole.number).all() and (ends(w) == tails).all()


# -- op2 --------------------------------------------------------------------------------------------------------


def chain():
    """Three texts, each near the next one only."""
    words = [f"c{i}" for i in range(60)]
    texts = []
    for k in range(3):
        w = list(words)
        w[10 : 10 + 4 * k] = [f"v{j}" for j in range(4 * k)]
        texts.append(" ".join(w))
    return texts


def linked(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return 100 * len(x & y) >= 75 * len(x | y)


def test_rows_without_id_link_others(spark):
    a, b, c = chain()
    assert linked(a, b) and linked(b, c) and not linked(a, c)
    rows = [(1, a), (None, b), (3, c), (None, "all alone here it is"), (None, "all alone here it is"), (None, None), (None, ""), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect())
    assert got == collections.Counter({(1, 1): 1, (3, 1): 1, (None, 1): 1, (None, None): 4, (7, 7): 1})
    assert sorted(r["doc_id"] for r in jaccard.deduplicated(docs).collect()) == [1, 7]
    kept = collections.Counter((r["doc_id"], r["text"]) for r in jaccard.deduplicated(docs.selectExpr("doc_id", "text", "1 as fp", "2 as row"), nulls=True).collect())
    assert kept == collections.Counter([(1, a), (7, ""), (None, "all alone here it is"), (None, None), (None, "")])


def test_pairs_are_met_at_their_first_common_entry(spark):
    """Families of versions around the threshold: every link is found though later shared entries are passed over."""
    rng = np.random.default_rng(12)
    rows = []
    for f in range(3):
        base = [f"f{f}w{i}" for i in range(70)]
        for k in range(40):
            w = list(base)
            for at in rng.choice(70, int(rng.integers(0, 5)), replace=False):
                w[at] = f"e{int(rng.integers(0, 6))}"
            rows.append((100 * f + k, " ".join(w)))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if linked(a, b):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i, _ in rows}


# -- clashing columns in the pipeline's stages ------------------------------------------------------------------

CLASHES = ("t", "base", "found", "candidates", "spans", "spans_", "pieces", "tops", "row", "parts", "whole", "words", "shard", "place", "_h", "_id", "_s", "_source", "id", "h", "from", "name", "i", "g", "s", "fp", "sig", "root")


def clashing(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    return docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


def test_stages_pass_clashing_columns(spark):
    rows = [(1, "mail me@home.org now", "a", 20), (2, None, None, None), (3, "", "b", 0), (None, "lost words here", "b", 15), (4, "one two three", "b", 13), (4, "one two three", "b", 13)]
    docs = clashing(spark, rows)
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = out.collect()
    assert sorted(str(r["text"]) for r in got) == sorted(["mail [EMAIL] now", "None", "", "lost words here", "one two three", "one two three"])
    assert all([r[c] for c in CLASHES] == list(range(len(CLASHES))) for r in got)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    assert got and all([r[c] for c in CLASHES] == list(range(len(CLASHES))) and r["n_chars"] == len(r["text"]) for r in got)
    assert any(r["doc_id"] is None for r in got)
    kept = jaccard.deduplicated(docs, nulls=True)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "None"]
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.clean(docs, no_labels).columns == docs.columns and toxicity.clean(docs, no_labels).count() == len(rows)


def test_redaction_merges_overlaps_in_long_texts(spark):
    unit = "write to a.b@c.de or 1.2.3.4, é \U0001f600 "
    texts = [unit * 2000, "x" * 10_000 + " a@b.cd " + "y" * 10_000, "a@b.cd"]
    out = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out[0] == "write to [EMAIL] or [IP], é \U0001f600 " * 2000
    assert out[1] == "x" * 10_000 + " [EMAIL] " + "y" * 10_000 and out[2] == "[EMAIL]"


def test_mixed_documents_come_in_mixed_order(spark):
    rows = [(i, " ".join(f"s{i % 3}w{i}x{k}" for k in range(64)), "abc"[i % 3]) for i in range(600)]
    out = [r["source"] for r in mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()]
    turns = sum(a != b for a, b in zip(out, out[1:]))
    assert turns > 0.4 * len(out)  # sources alternate, they do not come one after the other


# -- op9 --------------------------------------------------------------------------------------------------------


def test_ann_compares_vectors_of_one_length_and_counts_an_id_once(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, rng.normal(size=20).tolist()), (1050, v[50, :5].tolist()), (1051, v[50, :5].tolist()), (7, (v[0] * 3).tolist())]
    got = collections.defaultdict(list)
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", F.lit("x")), "vec_id % 50 = 0", k=3).collect()
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
    assert set(got) == {*range(0, 400, 50), 1050} and got[1050] == [1051]
    assert all(len(set(x)) == 3 for q, x in got.items() if q < 400) and got[0][0] == 7
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(50, 400, 50):
        s = u @ u[q]
        s[7] = max(s[7], u[0] @ u[q])
        s[q] = -9
        assert got[q] == np.argsort(-s)[:3].tolist()


# -- op4 --------------------------------------------------------------------------------------------------------


def test_masks_of_long_conversations(spark):
    turns = [(i, "user" if i % 2 else "assistant", "x" * (i % 7)) for i in range(300)]
    rows = [(1, turns, turns[:-1]), (2, [], [])]
    kind = "array<struct<turn:long,role:string,text:string>>"
    out = {r["id"]: r for r in chat.preferences(spark.createDataFrame(rows, f"id int, chosen {kind}, rejected {kind}").selectExpr("id", "chosen", "slice(rejected, 2, 400) rejected")).collect()}
    text, mask = out[1]["chosen_completion"], out[1]["chosen_mask"]
    assert out[1]["common"] == 0 and [text[m["start"] : m["stop"]] for m in mask] == ["x" * (i % 7) + "<|end|>" for i in range(0, 300, 2)]
    assert out[2]["prompt"] == "" and out[2]["chosen_mask"] == []


# -- edge cases of operators that read tables as they are -------------------------------------------------------


def test_clashing_names_and_odd_rows_elsewhere(spark):
    odd = [(1, "a b c d e f g", "a"), (None, None, None), (2, "", "b"), (1, "a b c d e f g", "a"), (3, "w " * 20_000, "c")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, source string").select("*", *[F.lit("x").alias(c) for c in ("length", "offset", "matches", "slice", "level", "part", "score", "n_shingles", "size", "rows")])
    assert packing.pack(docs).selectExpr("sum(length)", "count(distinct doc_id)").first()[1] == 3
    assert katz.score(docs).count() == len(odd) and licences.scan(docs).count() == len(odd)
    assert mixing.mix(docs).count() == len(odd) and jaccard.near_duplicates(docs).count() == len(odd)
    pictures = spark.createDataFrame([(1, None), (None, None), (2, media.encoded(np.random.default_rng(0).integers(0, 255, (40, 40))))], "media_id long, image binary").withColumn("fp", F.lit(1)).withColumn("bits", F.lit(2))
    assert media.copies(pictures).count() == 3
    talks = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "w " * 20_000)], "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("t", F.lit(2))
    assert chat.digest(chat.preferences(chat.swapped(chat.conversations(talks)))).count() == 1
