"""What the findings of the second round asked for, of the corpus operators."""

import os

import numpy as np

from assayloom.llm import toxicity


def _toxic_docs(spark, n=240):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words, 30)) + (" vilest" if i % 3 == 0 else "")) for i in range(n)]
    labels = [(i, int(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_field_is_fitted_outside_the_driver(spark, monkeypatch):  # F1
    driver, train = os.getpid(), toxicity.train

    def elsewhere(*a, **k):
        assert os.getpid() != driver, "the fit takes the driver's memory"
        return train(*a, **k)

    monkeypatch.setattr(toxicity, "train", elsewhere)
    docs, labels = _toxic_docs(spark)
    field = toxicity.fit(docs, labels)
    assert field.trained
    toxic = {r["doc_id"] for r in toxicity.scored(docs, field).collect() if r["score"] >= 0.5}
    assert toxic == {i for i in range(240) if i % 3 == 0}
