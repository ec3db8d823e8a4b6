"""Fingerprints and block tables against plain Python."""

import hashlib
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pointmill.llm import fingerprints as fp

from .conftest import plain, prose


def chained(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed


def fingerprint(text):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]
    votes = [0] * 128
    for i in range(max(1, len(words) - 4)):
        own = words[i : i + 5]
        lo = chained(own)
        h = xxhash.xxh64_intdigest(struct.pack("<Q", lo), 42) << 64 | lo
        w = min(63, sum(map(len, own)))
        votes = [v + (w if h >> b & 1 else -w) for b, v in enumerate(votes)]
    return sum(1 << b for b, v in enumerate(votes) if v > 0)


def expected(rows, radius=fp.RADIUS):
    def place(r):  # null ids first, then by id; equal ids by their text's hash
        h = xxhash.xxh64_intdigest((r[1] or "").encode(), 42)
        return (r[0] is not None, r[0] or 0, h - (1 << 64) if h >> 63 else h)

    order = sorted({(i, t or "") for i, t in rows}, key=place)
    after = dict(zip(order, order[1:] + order[:1]))
    own = {r: fingerprint(r[1]) for r in order}
    count = Counter((i, t or "") for i, t in rows)
    out = []
    for r, n in count.items():
        t, k = r[1], len(r[1]) // 4
        edited = t[: len(t) - k] + after[r][1][:k]
        like = [1 - (own[r] ^ x).bit_count() / 128 for x in (fingerprint(edited), own[after[r]])]
        near = sum(m for s, m in count.items() if (own[s] ^ own[r]).bit_count() <= radius) - 1 if r[0] is not None and r[0] % 50 == 0 else None
        out += [(r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{own[r]:032x}", f"{fingerprint(edited):032x}", *like, near)] * n
    return sorted(out, key=repr)


def test_odd_rows_and_no_rows(spark, odd, empty):
    docs = odd.withColumnsRenamed({"lang": "k", "source": "h", "n_chars": "lo"})
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert plain(fp.fingerprints(docs)) == expected(rows)
    assert fp.fingerprints(empty).collect() == []
    one = spark.createDataFrame([(50, "a b c d e f g h")], "doc_id long, text string")
    assert plain(fp.fingerprints(one)) == expected([(50, "a b c d e f g h")])


def test_near_copies_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_A_PART", 20)
    monkeypatch.setattr(fp, "ROWS_A_BLOCK", 3)
    base = prose(9, 500).split()
    rows = []
    for i in range(90):
        words = list(base)
        words[i % 45] = f"other{i % 45}"
        rows.append((i * 25, " ".join(words)))
    rows += [(10_000 + i, prose(i, 60)) for i in range(60)] + [(50, rows[0][1])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = plain(fp.fingerprints(docs))
    assert found == expected(rows)
    assert max(r[-1] or 0 for r in found) > 10


def test_table(spark, tables):
    docs = tables["documents"].where("length(text) < 2000")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = plain(fp.fingerprints(docs))
    assert found == expected(rows)
    long = [r for r in found if r[1] > 400]
    assert np.mean([r[5] for r in long]) > 0.72 and np.mean([r[6] for r in long]) < 0.6


@pytest.mark.parametrize("radius,count", [(0, 10), (3, 1000), (3, 1 << 40), (7, 1000)])
def test_block_tables_lose_no_pair(radius, count):
    masks = [(lo % (1 << 64)) | (hi % (1 << 64)) << 64 for lo, hi in fp.block_masks(count, radius)]
    r = np.random.default_rng(radius)
    for _ in range(300):
        flipped = sum(1 << int(b) for b in r.choice(128, radius, replace=False))
        assert any(flipped & m == 0 for m in masks)


def test_near_counts_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_A_BLOCK", 4)
    r = np.random.default_rng(1)
    seeds = [(int(r.integers(-(1 << 62), 1 << 62)), int(r.integers(-(1 << 62), 1 << 62))) for _ in range(5)]
    prints = {}
    for k in range(120):
        lo, hi = seeds[k % 5]
        for b in r.choice(62, 2, replace=False):
            lo ^= 1 << int(b)
        prints[lo, hi] = int(r.integers(1, 4))
    frame = spark.createDataFrame([(lo, hi, n) for (lo, hi), n in prints.items()], "lo long, hi long, n long")
    asked = frame.where(F.col("lo") % 3 == 0).select("lo", "hi")
    got = {(x["lo"], x["hi"]): x["n_near"] for x in fp.near_counts(asked, frame).collect()}
    for (lo, hi), n in got.items():
        assert n == sum(m for (a, b), m in prints.items() if (((a ^ lo) % (1 << 64)).bit_count() + ((b ^ hi) % (1 << 64)).bit_count()) <= 3)
    assert len(got) == asked.count()
