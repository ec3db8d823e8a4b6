"""The filter audit against SQL and against filters applied one after another."""

from itertools import permutations

import numpy as np
import pytest

from pointmill.llm import filter_audit as fa

from .conftest import plain, prose


def applied(rows, labels):
    """Every order by brute force over the documents."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, lang in rows:
        t = t or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and t in least and i > least[t]}
        own = [x for x in labels if x[0] == i and i is not None]
        docs.append((lang or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, stay = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                only = sum(d[1][f] and sum(d[1].values()) == 1 for d in mine)
                lines.append((part, "".join(order), step, len(stay), len(gone), sum(d[1][f] for d in mine) - len(gone), only, sum(d[2] for d in gone), sum(d[3] for d in gone), f))
                left = stay
        out += [(*x[:-1], shapley[x[-1]]) for x in lines]
    return sorted(out, key=repr)


LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 1), (4, None, None), (4, 0, 0), (5, 1, None), (6, 0, 1), (None, 1, 1), (99, 1, 1)], LABELS)


def test_odd_rows(spark, odd, empty, labels):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    found = plain(fa.audit(odd.withColumnsRenamed({"source": "h1", "n_chars": "mask"}), labels))
    assert found == applied(rows, [tuple(x) for x in labels.collect()])
    assert len(found) == 600 * len({r[2] or "" for r in rows})
    assert fa.audit(empty, labels).collect() == []


def test_copies_in_many_parts_and_null_ids(spark, labels):
    text = prose(3, 210) + " A*B"
    rows = [(i, text, "en" if i % 3 else None) for i in range(40, 0, -1)] + [(None, text, "de"), (1, text, "de"), (1, text, "de"), (7, "X Y", ""), (3, "X Y", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert plain(fa.audit(docs, labels)) == applied(rows, [tuple(x) for x in labels.collect()])


def test_walk_by_sets():
    r = np.random.default_rng(3)
    masks, counts = r.integers(0, 32, 20), r.integers(0, 9, (20, 3))
    states = fa.walk(masks, counts)
    for chosen in range(32):
        assert states[chosen].tolist() == counts[masks & chosen == 0].sum(axis=0).tolist()
