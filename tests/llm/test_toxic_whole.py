"""The toxicity classifier learns from all rows that may be learnt from: counts, clusters, thresholds and training by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.llm import toxicity as tox
from tests.llm.test_scores import labelled


def test_every_row_is_learnt_from(spark, monkeypatch):
    """A word that only rows beyond a sample hold has its evidence, whatever a sample's bounds are."""
    for name in ("SAMPLE_PER_CLASS", "SAMPLE_WORDS", "STRETCH"):
        monkeypatch.setattr(tox, name, 1)
    docs, labels = labelled(spark, 300)
    learnt = tox.labelled(docs.unionByName(docs.limit(50)), labels.unionByName(labels)).cache()
    assert learnt.count() == docs.join(labels, "doc_id").where(tox.training_share(F.col("doc_id"))).count()
    n, p, own = tox.word_counts(learnt)
    rows = learnt.collect()
    want = np.zeros((3, tox.BUCKETS))
    for r in rows:
        ids, _ = tox.features(next(tox.texts(tox.pa.array([r["text"]]))))
        for k in set(ids.ravel().tolist()):
            want[0, k] += 1
            want[1, k] += r["toxic"]
        for k in set(ids[:, 0].tolist()):
            want[2, k] += 1
    assert np.array_equal(n, want[0]) and np.array_equal(p, want[1]) and np.array_equal(own, want[2])
    got = tox.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.93


def test_shares_of_rows_learn_together(spark, monkeypatch):
    monkeypatch.setattr(tox, "SHARE_ROWS", 100)
    docs, labels = labelled(spark)
    got = tox.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.9


def test_clusters_of_a_table_are_those_of_its_texts(spark, tables):
    rows = tables["documents"].where("length(text) > 300").select("text").repartition(3)
    words = []
    for block in tox.texts(tox.pa.array([r["text"] for r in rows.collect()])):
        ids, offsets = tox.features(block)
        words += [ids[offsets[i] : offsets[i + 1], 0] for i in range(len(block))]
    want = tox.learn_clusters(words)
    got = tox.clusters_of(rows, want.words)
    assert got.weight.shape == want.weight.shape and np.allclose(got.weight, want.weight)
    assert tox.clusters_of(rows.where("false"), want.words).weight.shape == (len(want.words), 1)


@pytest.mark.parametrize("digits", [1, 9])
def test_cutoffs_by_trying_all(spark, digits):
    r = np.random.default_rng(3)
    rows = [(int(c), round(float(v + 2 * t), digits), int(t)) for c, v, t in zip(r.integers(0, 3, 600), r.normal(0, 1.5, 600), r.random(600) < 0.2)] + [(9, 1.0, 1), (9, 0.0, 0)]
    got = tox.cutoffs(spark.createDataFrame(rows, "cluster int, logit double, toxic int"))
    assert sorted(got) == [0, 1, 2]
    for c in got:
        own = [(v, t) for k, v, t in rows if k == c]
        levels = sorted({v for v, _ in own}, reverse=True)
        f1 = [2 * sum(t for v, t in own if v >= x) / (sum(v >= x for v, _ in own) + sum(t for _, t in own)) for x in levels]
        k = int(np.argmax(np.array(f1) >= max(f1) - 1e-12))
        assert got[c] == pytest.approx((levels[k] + levels[min(k + 1, len(levels) - 1)]) / 2)
