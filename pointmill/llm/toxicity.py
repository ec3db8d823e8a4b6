"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of the embeddings of its hash and of the hashes of its first four and five bytes, so that
inflected forms share weight; embeddings start from the evidence of the rows' own texts. Filters of several widths slide over the words, each is max-pooled over the whole text,
and a logistic layer reads the pooled values. Everything is learnt from the whole texts of all labelled rows that may be learnt
from: three in four train, the fourth sets the thresholds, by language. Counts of words are sums over tasks. In each epoch
tasks go through shares of the rows, from one model, and what they arrive at is averaged; only models (2 MB, at most SHARES)
leave the tasks. Languages are learnt too, without their names: the most widespread words are mostly function words, and
texts cluster by which of these they use (spherical k-means, a round being one job over all texts). A text belongs to the
cluster that its own words are nearest to, never to what a column says. A score is the logit less its cluster's threshold,
so that 0.5 is the decision line everywhere; a cluster with few labels has the common threshold.

Null and empty texts have no words: they get the score of the bias alone. Very long texts are read whole. Repeated rows get
equal scores and count once in training, as do equal texts under one id. Of labels of one id the greatest counts. Other
columns are never read, whatever their names. Without usable labels (an empty table, or one class only) every score is the
share of toxic labels, or 0 if there are none. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import arrow_map, cut, table_in_shared_folder, training_share
from pointmill.llm.words import U64, Texts, mix, span_hashes, texts
from pointmill.ordered import carried

WIDTHS = (1, 2, 3)
#: Models of an epoch at most, and rows that one is trained on at least (all, if there are fewer).
SHARES, SHARE_ROWS = 64, 4096
#: For sample() and _some(), which the classifier itself doesn't use: rows of each class, words of a text in stretches.
SAMPLE_PER_CLASS, SAMPLE_WORDS, STRETCH = 3000, 2000, 50
BUCKETS = 1 << 16
#: Widespread words that languages are told by, and clusters of texts that use them alike, at most.
COMMON_WORDS, CLUSTERS = 400, 12


@dataclass
class Clusters:
    """Common words (as their embedding rows), sorted, and each cluster's weight of each."""

    words: np.ndarray
    weight: np.ndarray  # [word, cluster]

    def __call__(self, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The nearest cluster of each text; -1 for texts without a common word."""
        n, k = len(offsets) - 1, self.weight.shape[1]
        if not len(self.words):
            return np.full(n, -1)
        at = np.minimum(np.searchsorted(self.words, rows), len(self.words) - 1)
        hit = np.flatnonzero(self.words[at] == rows)
        owner = np.searchsorted(offsets, hit, side="right") - 1
        votes = np.stack([np.bincount(owner, weights=self.weight[at[hit], c], minlength=n) for c in range(k)], axis=1)
        return np.where(np.bincount(owner, minlength=n) > 0, votes.argmax(axis=1), -1)


#: What a pass over texts finds: a sum, and of all texts the least value with its row of common words.
Found = tuple[np.ndarray | float, float, bytes]


def _both(a: Found, b: Found) -> Found:
    return a[0] + b[0], *min(a[1:], b[1:])


def _least(values: np.ndarray, x: np.ndarray) -> Found:
    rows = [(float(values[i]), np.packbits(x[i] > 0).tobytes()) for i in np.flatnonzero(values == values.min())]
    return 0.0, *min(rows)


def _centres(over: Callable[[Callable[[np.ndarray], Found]], Found | None], width: int, rounds: int) -> np.ndarray:
    """Centres of texts by their common words (one row a text, 1 for each that it uses, at least 3). over puts a function's
    results for all blocks of rows together. Centres start as far apart as can be, from the largest on, and stop where a
    text is near some centre already; so there are as many as languages show."""
    counted = over(lambda x: (np.append(x.sum(axis=0), len(x)), 0.0, b""))
    if counted is None:
        return np.ones((1, width))
    idf = np.log((counted[0][-1] + 1) / (counted[0][:-1] + 1))

    def unit(x: np.ndarray) -> np.ndarray:
        x = x * idf
        return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))

    def row(bits: bytes) -> np.ndarray:
        return unit(np.unpackbits(np.frombuffer(bits, np.uint8), count=width)[None].astype(np.float64))

    mean = over(lambda x: (unit(x).sum(axis=0), 0.0, b""))[0]
    centres = row(over(lambda x: _least(-(unit(x) @ mean), x))[2])
    while len(centres) < CLUSTERS:
        _, near, bits = over(lambda x, c=centres: _least((unit(x) @ c.T).max(axis=1), x))
        if near > 0.15:
            break
        centres = np.vstack([centres, row(bits)])

    def sums(x: np.ndarray, c: np.ndarray) -> Found:
        own = (unit(x) @ c.T).argmax(axis=1)
        return np.eye(len(c))[own].T @ unit(x), 0.0, b""

    for _ in range(rounds):
        total = over(lambda x, c=centres: sums(x, c))[0]
        length = np.linalg.norm(total, axis=1, keepdims=True)
        moved = np.where(length > 0, total / np.maximum(1e-9, length), centres)
        if np.allclose(moved, centres, rtol=0, atol=1e-12):
            break
        centres = moved
    return centres


def _common(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.sort(seen[np.lexsort((seen, -n))][:COMMON_WORDS])


def _presence(words: np.ndarray, common: np.ndarray) -> np.ndarray:
    return np.isin(common, words)


def learn_clusters(texts_words: list[np.ndarray], rounds: int = 12) -> Clusters:
    """Clusters of a few texts (the embedding rows of their words) by the common words that they use."""
    present = [np.unique(w) for w in texts_words]
    words = _common(*np.unique(np.concatenate(present), return_counts=True)) if present else np.zeros(0, np.int32)
    if not len(words):
        return Clusters(words, np.zeros((0, 1)))
    x = np.array([_presence(own, words) for own in present], np.float64)
    x = x[x.sum(axis=1) >= 3]
    return Clusters(words, _centres(lambda f: f(x) if len(x) else None, len(words), rounds).T)


def clusters_of(rows: DataFrame, words: np.ndarray, rounds: int = 12) -> Clusters:
    """The same of all texts of a table, by jobs over their common words, which are kept as bits."""
    if not len(words):
        return Clusters(words, np.zeros((0, 1)))

    def bits(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for block in texts(batch.column("text")):
            ids, offsets = features(block)
            own = [_presence(ids[offsets[i] : offsets[i + 1], 0], words) for i in range(len(block))]
            out += [np.packbits(x).tobytes() for x in own if x.sum() >= 3]
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["bits"])

    used = cut(arrow_map(rows.select("text"), bits, "bits binary").coalesce(SHARES))  # at most 50 bytes a text

    def over(f: Callable[[np.ndarray], Found]) -> Found | None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    packed = np.frombuffer(b"".join(batch.column(0).slice(at, 1000).to_pylist()), np.uint8)
                    x = np.unpackbits(packed.reshape(-1, -(-len(words) // 8)), axis=1, count=len(words)).astype(np.float64)
                    found = f(x) if found is None else _both(found, f(x))
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["found"])

        parts = [pickle.loads(r["found"]) for r in used.mapInArrow(run, "found binary").collect()]  # at most SHARES
        return reduce(_both, parts) if parts else None

    return Clusters(words, _centres(over, len(words), rounds).T)


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    constant: float
    #: Logit above which a text counts as toxic, by cluster; the last is for texts of none of the common words.
    cutoffs: np.ndarray = field(default_factory=lambda: np.zeros(1))
    clusters: Clusters | None = None


_IS_LETTER = np.ones(256, bool)
_IS_LETTER[[*range(97, 123), *range(128, 256), 39]] = False


def features(block: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word (three a word, its own first) and offsets by text."""
    starts, ends, owner = block.spans(_IS_LETTER)
    whole = span_hashes(block.data, starts, ends)
    ids = np.empty((len(starts), 3), np.int32)
    for j, h in enumerate((whole, *(span_hashes(block.data, starts, np.minimum(ends, starts + k)) for k in (4, 5)))):
        ids[:, j] = ((h + U64(j * 0x1E3779B97F4A7C15)) >> U64(40)) % U64(BUCKETS)
    return ids, np.searchsorted(owner, np.arange(len(block) + 1))


def _inputs(ids: np.ndarray, offsets: np.ndarray, embedding: np.ndarray) -> list[np.ndarray]:
    """The words' vectors, and these moved by one and more words, zero where a text has ended."""
    x = embedding[ids[:, 0]]
    for j in range(1, ids.shape[1]):
        x += embedding[ids[:, j]]
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(x))
    moved = [x]
    for j in range(1, max(WIDTHS)):
        y = np.zeros_like(x)
        y[:-j] = x[j:]
        y[left <= j] = 0
        moved.append(y)
    return moved


def _pool(moved: list[np.ndarray], offsets: np.ndarray, model: Model) -> np.ndarray:
    full = np.diff(offsets) > 0
    pooled = []
    for w, filters, bias in zip(WIDTHS, model.filters, model.bias, strict=True):
        y = moved[0] @ filters[0]
        for j in range(1, w):
            y += moved[j] @ filters[j]
        best = np.zeros((len(full), y.shape[1]), np.float32)
        if full.any():
            best[full] = np.maximum(np.maximum.reduceat(y, offsets[:-1][full]) + bias, 0)
        pooled.append(best)
    return np.hstack(pooled)


def logits(ids: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    return _pool(_inputs(ids, offsets, model.embedding), offsets, model).astype(np.float64) @ model.out + model.constant


def _odds(n: np.ndarray, p: np.ndarray, toxic: float, other: float, least: int = 3) -> np.ndarray:
    return np.where(n >= least, np.log((p + 1) / (toxic + 2)) - np.log((n - p + 1) / (other + 2)), 0.0)


def evidence(docs: list[np.ndarray], labels: np.ndarray, least: int = 3) -> np.ndarray:
    """Smoothed log odds of the toxic class for each embedding row, by the texts that use it; 0 for rows of few texts."""
    used = [np.unique(x) for x in docs]
    n = np.bincount(np.concatenate(used), minlength=BUCKETS) if used else np.zeros(BUCKETS)
    p = np.bincount(np.concatenate(used), weights=np.repeat(labels, [len(u) for u in used]), minlength=BUCKETS) if used else n
    return _odds(n, p, labels.sum(), len(labels) - labels.sum(), least)


@dataclass
class Seen:
    """Sums of squared gradients: one an embedding row, one each of the other parameters."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    constant: float


def _start(weights: np.ndarray, dim: int, n_filters: int, rng: np.random.Generator) -> tuple[Model, Seen]:
    """The first coordinate of an embedding starts as its row's evidence, which the first filter of width 1 reads, so that a
    rare word that tells is found however few rows there are; the others start near zero, so that words never trained on
    hardly disturb a maximum."""
    m = Model(
        rng.normal(0, 0.02, (BUCKETS, dim)).astype(np.float32),
        [rng.normal(0, 0.4, (w, dim, n_filters)).astype(np.float32) for w in WIDTHS],
        [np.zeros(n_filters, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, n_filters * len(WIDTHS)),
        0.0,
    )
    m.embedding[:, 0] = weights / 3
    m.filters[0][0, :, 0] = np.eye(dim, dtype=np.float32)[0]
    m.out[0], m.constant = 3.0, -3.0
    return m, Seen(np.full(BUCKETS, 1e-2, np.float32), [np.full_like(f, 1e-2) for f in m.filters], [np.full_like(b, 1e-2) for b in m.bias], np.full_like(m.out, 1e-2), 1e-2)


def _steps(m: Model, seen: Seen, docs: list[np.ndarray], labels: np.ndarray, order: np.ndarray, batch: int = 48, rate: float = 0.01) -> None:
    """Adagrad on the log loss; the gradient of a max-pooled filter goes to the window that won, also where its value is just 0:
    a filter that reads nothing yet could never begin otherwise."""
    n_filters = m.filters[0].shape[2]
    for at in range(0, len(order), batch):
        pick = order[at : at + batch]
        ids = np.concatenate([docs[i] for i in pick])
        offsets = np.concatenate([[0], np.cumsum([len(docs[i]) for i in pick])])
        if not len(ids):
            continue
        moved = _inputs(ids, offsets, m.embedding)
        pooled = _pool(moved, offsets, m)
        p = 1 / (1 + np.exp(-np.clip(pooled @ m.out + m.constant, -30, 30)))
        d = (p - labels[pick]) / len(pick)
        d_pooled = np.outer(d, m.out).astype(np.float32)
        g_out, g_c = pooled.T @ d, d.sum()
        rows, grads = [], []
        for k, w in enumerate(WIDTHS):
            y = moved[0] @ m.filters[k][0]
            for j in range(1, w):
                y += moved[j] @ m.filters[k][j]
            full = (np.diff(offsets) > 0)[:, None]
            won = np.array([offsets[i] + y[offsets[i] : offsets[i + 1]].argmax(axis=0) if full[i, 0] else np.zeros(n_filters, int) for i in range(len(pick))])
            active = full & (y[won, np.arange(n_filters)] + m.bias[k] >= 0)
            own = d_pooled[:, k * n_filters : (k + 1) * n_filters] * active
            g_f = np.empty_like(m.filters[k])
            for j in range(w):
                g_f[j] = np.einsum("nfd,nf->df", moved[j][won], own)
                end = np.repeat(offsets[1:, None], n_filters, axis=1)
                inside = (won + j < end) & (own != 0)
                rows.append(ids[(won + j)[inside]])
                grads.append((own[:, :, None] * m.filters[k][j].T[None])[inside])
            seen.filters[k] += g_f**2
            m.filters[k] -= rate * g_f / np.sqrt(seen.filters[k])
            g_b = own.sum(axis=0)
            seen.bias[k] += g_b**2
            m.bias[k] -= rate * g_b / np.sqrt(seen.bias[k])
        row, grad = np.concatenate(rows), np.concatenate(grads)
        if len(row):
            row, grad = row.ravel(), np.repeat(grad, ids.shape[1], axis=0)
            own_rows, back = np.unique(row, return_inverse=True)
            g_e = np.zeros((len(own_rows), grad.shape[1]), np.float32)
            np.add.at(g_e, back, grad)
            seen.embedding[own_rows] += (g_e**2).mean(axis=1)
            m.embedding[own_rows] -= rate * g_e / np.sqrt(seen.embedding[own_rows])[:, None]
        seen.out += g_out**2
        m.out -= rate * g_out / np.sqrt(seen.out)
        seen.constant += g_c**2
        m.constant -= rate * g_c / np.sqrt(seen.constant)


def _epochs(rows: int) -> int:
    """Few rows get more epochs."""
    return int(np.clip(12_000 // max(1, rows), 2, 10))


def train(docs: list[np.ndarray], labels: np.ndarray, dim: int = 8, n_filters: int = 8, epochs: int | None = None, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Model:
    """A model of a few texts, as one task trains it."""
    rng = np.random.default_rng(seed)
    m, seen = _start(evidence(docs, labels), dim, n_filters, rng)
    for _ in range(epochs or _epochs(len(docs))):
        _steps(m, seen, docs, labels, rng.permutation(len(docs)), batch, rate)
    return m


def _dense(m: Model, seen: Seen) -> np.ndarray:
    """value, square of each parameter but the embeddings'."""
    return np.array([np.concatenate([*[f.ravel() for f in x.filters], *x.bias, x.out, [x.constant]]) for x in (m, seen)], np.float64).T


def _put(x: Model | Seen, dense: np.ndarray) -> None:
    at = 0
    for group in (x.filters, x.bias):
        for k, part in enumerate(group):
            group[k] = dense[at : at + part.size].reshape(part.shape).astype(np.float32)
            at += part.size
    x.out, x.constant = dense[at:-1].copy(), float(dense[-1])


def train_shares(rows: DataFrame, n: int, weights: np.ndarray, dim: int = 8, n_filters: int = 8, seed: int = 7) -> Model:
    """A model of all rows (text, toxic, key; n of them). In an epoch each share of the rows is gone through by one task, from the
    same model on; a parameter becomes the mean of those shares that moved it."""
    m, seen = _start(weights, dim, n_filters, np.random.default_rng(seed))
    shares = int(np.clip(n // SHARE_ROWS, 1, SHARES))
    dealt = rows.select("text", "toxic", "key").coalesce(shares).sortWithinPartitions("key", "text")
    for epoch in range(_epochs(n)):

        def go(batches: Iterator[pa.RecordBatch], m: Model = m, seen: Seen = seen, epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            was, rng, any_row = m.embedding.copy(), np.random.default_rng([seed, epoch]), False
            for batch in batches:
                y, at = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.float64), 0
                for block in texts(batch.column("text")):
                    ids, offsets = features(block)
                    docs = [ids[offsets[i] : offsets[i + 1]] for i in range(len(block))]
                    _steps(m, seen, docs, y[at : at + len(block)], rng.permutation(len(block)))
                    at, any_row = at + len(block), True
            if any_row:
                changed = np.flatnonzero((m.embedding != was).any(axis=1))
                dense = np.zeros((len(_dense(m, seen)), dim + 1))
                dense[:, :2] = _dense(m, seen)
                values = np.vstack([np.hstack([m.embedding[changed], seen.embedding[changed, None]]), dense])
                part = np.concatenate([changed, BUCKETS + np.arange(len(dense))]).astype(np.int32)
                for lo in range(0, len(part), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(part[lo : lo + 4096]), *[pa.array(v) for v in values[lo : lo + 4096].T]], names=["part", *names])

        names = [f"v{k}" for k in range(dim + 1)]
        found = dealt.mapInArrow(go, ", ".join(["part int", *[f"{v} double" for v in names]]))
        mean = found.groupBy("part").agg(*[F.avg(v).alias(v) for v in names]).toPandas().sort_values("part")  # a row a parameter row
        part, values = mean["part"].to_numpy(), mean[names].to_numpy()
        own = part < BUCKETS
        m.embedding[part[own]], seen.embedding[part[own]] = values[own, :dim], values[own, dim]
        _put(m, values[~own, 0])
        _put(seen, values[~own, 1])
    return m


def cutoffs(scored: DataFrame, least: int = 20) -> dict[int, float]:
    """The cutoff of best F1 of each cluster (cluster, logit, toxic), half-way between the logits it parts; none of a cluster
    with too few rows of either class. Rows are added up from the highest logit down, by ranges of logits."""
    each = scored.groupBy("cluster", "logit").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("f"), (-F.col("logit")).alias("at"))
    whole = each.groupBy("cluster").agg(F.sum("t").alias("p"), F.sum("f").alias("q")).where((F.col("p") >= least) & (F.col("q") >= least))
    passed = cut(carried(each, ["cluster"], "at", {"tp": ("sum", F.col("t")), "fp": ("sum", F.col("f"))}, 1 / 16).join(F.broadcast(whole), "cluster"))  # a cluster a row
    f1 = F.round(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p")), 12)
    best = passed.groupBy("cluster").agg(F.max_by("logit", F.struct(f1, "logit")).alias("best"))
    below = passed.join(F.broadcast(best), "cluster").groupBy("cluster", "best").agg(F.max(F.when(F.col("logit") < F.col("best"), F.col("logit"))).alias("next"))
    return {r["cluster"]: (r["best"] + (r["best"] if r["next"] is None else r["next"])) / 2 for r in below.collect()}


def _some(ids: np.ndarray) -> np.ndarray:
    """The words that training reads of a text: all, or SAMPLE_WORDS in stretches from all over it."""
    if len(ids) <= SAMPLE_WORDS:
        return ids
    starts = np.arange(0, len(ids), STRETCH)
    hashes = mix(np.add.reduceat(ids[:, 0].astype(U64), starts) + U64(len(ids)) + starts.astype(U64))
    picked = np.sort(np.argsort(hashes, kind="stable")[: SAMPLE_WORDS // STRETCH])
    return np.concatenate([ids[k * STRETCH : (k + 1) * STRETCH] for k in picked])


def word_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each embedding row: texts that use it, toxic ones among them, and texts in which it is a word's own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((3, BUCKETS), np.int64)
        for batch in batches:
            y, at = batch.column("toxic").to_numpy(zero_copy_only=False), 0
            for block in texts(batch.column("text")):
                ids, offsets = features(block)
                for i in range(len(block)):
                    own = ids[offsets[i] : offsets[i + 1]]
                    used = np.unique(own)
                    found[0, used] += 1
                    found[1, used] += int(y[at + i])
                    found[2, np.unique(own[:, 0])] += 1
                at += len(block)
        used = np.flatnonzero(found[0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(f[used]) for f in found]], names=["part", "n", "p", "own"])

    total = rows.select("text", "toxic").mapInArrow(count, "part int, n long, p long, own long").groupBy("part").agg(*[F.sum(c).alias(c) for c in ("n", "p", "own")]).toPandas()
    found = np.zeros((3, BUCKETS))
    found[:, total["part"].to_numpy(np.int64)] = total[["n", "p", "own"]].to_numpy().T
    return found[0], found[1], found[2]


def fit(learnt: DataFrame, calibration_share: int = 4) -> Model | float:
    """learnt: text, toxic, key, one row for each text that may be learnt from. One row in calibration_share, by key, sets the
    thresholds, the others train. A float (the score of every text) where a class is missing."""
    held = F.pmod("key", F.lit(calibration_share)) == 0
    known = {(r["toxic"], r["held"]): r["count"] for r in learnt.groupBy("toxic", held.alias("held")).count().collect()}  # four rows
    labels = {label for label, _ in known}
    if len(labels) < 2:
        return float(max(labels, default=0))
    rows, check = learnt.where(~held), learnt.where(held)
    toxic, other = known.get((1, False), 0), known.get((0, False), 0)
    n, p, own = word_counts(rows)
    model = train_shares(rows, toxic + other, _odds(n, p, toxic, other))
    seen = np.flatnonzero(own)
    model.clusters = clusters_of(rows, _common(seen, own[seen]).astype(np.int32))
    common = model.clusters.weight.shape[1]

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for block in texts(batch.column("text")):
            ids, offsets = features(block)
            found.append((model.clusters(ids[:, 0], offsets), logits(ids, offsets, model)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([c for c, _ in found]).astype(np.int32)), pa.array(np.concatenate([v for _, v in found])), batch.column("toxic").cast(pa.int32())], names=["cluster", "logit", "toxic"])

    scored = cut(arrow_map(check.select("text", "toxic"), score, "cluster int, logit double, toxic int"))  # narrow rows
    found = cutoffs(scored.where("cluster >= 0").unionByName(scored.withColumn("cluster", F.lit(common))))
    model.cutoffs = np.array([found.get(c, found.get(common, 0.0)) for c in range(common + 1)])
    return model


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic, key (a hash of id and text): all documents that may be learnt from and have a label. Rows equal in id and
    text are one; of labels of one id the greatest counts."""
    known = labels.where(training_share(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = documents.where(training_share(F.col("doc_id"))).select("doc_id", "text").join(known, "doc_id")
    return rows.withColumn("key", F.xxhash64("doc_id", "text")).groupBy("doc_id", "key").agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("text", "toxic", "key")


def sample(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """text, toxic, total, key: up to per_class labelled training documents of each class, in the order of a hash of id and
    text. Rows equal in both are one document, so the bound holds however often an id or a row repeats."""
    known = labels.where(training_share(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    keyed = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    each = cut(keyed.select("doc_id", "key").join(known, "doc_id").groupBy("key").agg(F.max("toxic").alias("toxic")))
    totals = {r["toxic"]: r["count"] for r in each.groupBy("toxic").count().collect()}  # two rows
    picked = None
    for label in (0, 1):
        part = each.where(F.col("toxic") == label).orderBy("key").limit(per_class).withColumn("total", F.lit(totals.get(label, 0)).cast("long"))
        picked = part if picked is None else picked.unionByName(part)
    found = keyed.select("key", "text").join(F.broadcast(cut(picked)), "key")  # at most 2 * per_class narrow rows
    return found.groupBy("key", "toxic", "total").agg(F.first("text").alias("text"))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and cluster (of the text's own words, -1: none) of each document."""
    model = fit(table_in_shared_folder(labelled(documents, labels), "toxicity"))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, clusters = [], []
        for block in texts(batch.column("text")):
            ids, offsets = features(block)
            if isinstance(model, float):
                out.append(np.full(len(block), np.log(max(model, 1e-6) / max(1 - model, 1e-6))))
                clusters.append(np.full(len(block), -1))
            else:
                clusters.append(model.clusters(ids[:, 0], offsets))
                out.append(logits(ids, offsets, model) - model.cutoffs[clusters[-1]])
        margin = np.concatenate(out)
        p = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(np.concatenate(clusters).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted", "cluster"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    held = documents.select("doc_id", F.coalesce(~training_share(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return arrow_map(held, score, f"doc_id {kind}, held_out boolean, score double, predicted int, cluster int")
