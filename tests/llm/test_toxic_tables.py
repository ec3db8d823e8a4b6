"""What the toxicity classifier learns of the tables' own labels, on rows it never learns from."""

import numpy as np
import pytest

from pointmill.llm import toxicity as tox


@pytest.fixture(scope="module")
def scored(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = tox.toxicity(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels.where("toxic IN (0, 1)"), "doc_id").where("held_out")
    return rows.select("score", "predicted", "toxic").toPandas()


def test_held_out_rows(scored):
    y, s = scored["toxic"].to_numpy(), scored["score"].to_numpy()
    pairs = s[y == 1][:, None] - s[y == 0][None]
    assert (pairs > 0).mean() + (pairs == 0).mean() / 2 > 0.93
    hit = scored["predicted"].to_numpy() == 1
    assert 2 * (hit & (y == 1)).sum() / (hit.sum() + y.sum()) > 0.75


def test_long_texts_are_sampled_all_over():
    ids = np.arange(3 * 30_000, dtype=np.int32).reshape(-1, 3)
    some = tox._some(ids)
    assert len(some) == tox.SAMPLE_WORDS and np.array_equal(some, tox._some(ids))
    assert len(np.unique(some[:, 0] // 9000)) == 10  # from every tenth of the text
    assert tox._some(ids[:2000]) is not ids and len(tox._some(ids[:2000])) == 2000


def test_evidence_by_counting():
    docs = [np.array([[1, 2, 3], [1, 4, 4]]), np.array([[1, 5, 6]]), np.array([[1, 5, 6]]), np.zeros((0, 3), int), np.array([[5, 5, 5]])]
    w = tox.evidence(docs, np.array([1.0, 0.0, 0.0, 0.0, 1.0]))
    assert w[1] == pytest.approx(np.log(2 / 4) - np.log(3 / 5)) and w[5] == pytest.approx(np.log(2 / 4) - np.log(3 / 5))
    assert w[2] == w[4] == 0 and np.count_nonzero(w) == 2
