"""Quality classifier: a weak-label model over overlapping heuristic labellers, and a hashed linear scorer learnt from it.

1. Each labeller votes good, bad or abstains on each document.
2. Vote patterns are counted over the whole corpus (3^labellers patterns at most) and expectation-maximisation estimates
   the share of good documents and each labeller's accuracy; a pattern's posterior is the label of its documents.
3. A logistic scorer over hashed words and word shapes learns those posteriors from a bounded sample and scores every
   document. No given label is read.

Without labels the two classes are told apart by what is believed of them beforehand. These beliefs are stated, fixed and
not alike for the two classes, as a heuristic sees one kind of fault only and most bad documents show few faults:

- at the start a pattern is good with odds of its good votes to 2.5 times its bad votes;
- in every round, at most 3 in 10 of a labeller's votes on good documents are bad (it is right there more often than not),
  and at most 19 in 20 of its votes on bad documents are good (it sees at least one fault in twenty).

Null and empty texts have no words: their score is the scorer's bias, which is the prior of good documents; they are
kept if that prior is. Very long texts are read whole. A score equal to the bound is kept. Repeated rows get equal scores
and are one row of the sample. Null ids are ids like others. Other columns pass through whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import arrow_map, cut
from pointmill.llm.words import SPACES, U64, Texts, span_hashes, texts

#: Documents that the scorer is fitted on at most.
SAMPLE = 6000
#: Most bad votes that a labeller is believed to give good documents, and most good votes that it is believed to give bad ones.
BAD_ON_GOOD, GOOD_ON_BAD = 0.3, 0.95
BUCKETS = 1 << 15
#: Words added to a text's length where shares are taken, so that a few words alone don't decide.
SHORT = 8
BAD, GOOD, ABSTAIN = 0, 1, 2
LABELLERS = ("symbols", "capitals", "exclamations", "separators", "repeated_lines", "repeated_words", "stutter", "word_length", "function_words")
FUNCTION_WORDS = "the of and to in is for with as on are by der die das und ist ein zu von mit le la les et un que du de des el los las y una del en con por para se"


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[[*chars.encode()]] = 1
    return table


_SYMBOLS, _PIPES, _SHOUT = _class("#*$%&<>|{}[]\\^~=_"), _class("|"), _class("!")
_UPPER, _LOWER = np.zeros(256, np.int32), np.zeros(256, np.int32)
_UPPER[65:91] = 1
_LOWER[97:123] = 1
_LOWER[128:] = 1
_FUNCTION = np.sort(np.array([span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0] for w in FUNCTION_WORDS.split()], U64))
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _count(table: np.ndarray, block: Texts) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(table[block.data], dtype=np.int64)])[block.offsets])


def _vote(value: np.ndarray, known: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(known & bad, BAD, np.where(known & good, GOOD, ABSTAIN)).astype(np.int8)


def _repeated(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many keys each text has, and how many of them equal another one of the same text."""
    tagged = keys ^ (owner.astype(U64) * U64(0x9E3779B97F4A7C15))
    _, back, counts = np.unique(tagged, return_inverse=True, return_counts=True)
    return np.bincount(owner, minlength=n), np.bincount(owner, weights=(counts[back] > 1), minlength=n)


def votes(block: Texts) -> np.ndarray:
    """One column of votes for each labeller; block holds texts as they are (not lower-cased)."""
    n = len(block)
    starts, ends, owner = block.spans(SPACES)
    n_words = np.bincount(owner, minlength=n)
    chars = np.maximum(1, np.bincount(owner, weights=ends - starts, minlength=n))
    words = np.maximum(1, n_words)
    some, many = n_words >= 3, n_words >= 20
    upper, lower = _count(_UPPER, block), _count(_LOWER, block)
    capitals = upper / np.maximum(1, upper + lower)
    symbols, shouts, pipes = _count(_SYMBOLS, block) / chars, _count(_SHOUT, block) / words, _count(_PIPES, block) / words
    line_starts, line_ends, line_owner = block.spans(_LINE)
    lines, dup_lines = _repeated(span_hashes(block.data, line_starts, line_ends), line_owner, n)
    dup_lines = dup_lines / np.maximum(1, lines)
    low = block.data | np.where((block.data >= 65) & (block.data < 91), 32, 0).astype(np.uint8)
    hashed = span_hashes(low, starts, ends)
    runs = hashed[:-2] * U64(3) + hashed[1:-1] * U64(5) + hashed[2:] * U64(7) if len(hashed) > 2 else hashed[:0]
    same = owner[:-2] == owner[2:] if len(hashed) > 2 else np.zeros(0, bool)
    n_runs, dup_runs = _repeated(runs[same], owner[:-2][same] if len(hashed) > 2 else owner[:0], n)
    dup_runs = dup_runs / np.maximum(1, n_runs)
    again = np.zeros(len(hashed), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
    stutter = np.bincount(owner, weights=again, minlength=n) / words
    length = chars / words
    at = np.minimum(np.searchsorted(_FUNCTION, hashed), len(_FUNCTION) - 1)
    function = np.bincount(owner, weights=_FUNCTION[at] == hashed, minlength=n) / words
    return np.stack(
        [
            _vote(symbols, some, symbols > 0.05, symbols < 0.01),
            _vote(capitals, some, capitals > 0.45, capitals < 0.25),
            _vote(shouts, some, shouts > 0.15, shouts < 0.03),
            _vote(pipes, some, pipes > 0.15, pipes < 0.02),
            _vote(dup_lines, lines >= 4, dup_lines > 0.5, dup_lines < 0.2),
            _vote(dup_runs, n_words >= 60, dup_runs > 0.5, dup_runs < 0.2),
            _vote(stutter, some, stutter > 0.25, stutter < 0.08),
            _vote(length, many, (length > 14) | (length < 2.2), (length > 3) & (length < 10)),
            _vote(function, many, function < 0.02, function > 0.08),
        ],
        axis=1,
    )


def pattern(matrix: np.ndarray) -> np.ndarray:
    return matrix.astype(np.int64) @ (3 ** np.arange(matrix.shape[1]))


def unpattern(codes: np.ndarray, n: int = len(LABELLERS)) -> np.ndarray:
    return codes[:, None] // (3 ** np.arange(n)) % 3


def expectation_maximisation(matrix: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each row of votes, each labeller's P(vote | class) as [labeller, class, vote], share of good.

    The beliefs stated above fix which class is the good one."""
    good, bad = (matrix == GOOD).sum(axis=1), (matrix == BAD).sum(axis=1)
    q = (good + 1.5) / (good + 2.5 * bad + 2.0)  # one bad vote outweighs one good one, as most heuristics see one fault only
    chance = np.zeros((matrix.shape[1], 2, 3))
    prior = 0.5
    for _ in range(rounds):
        weight = np.stack([counts * (1 - q), counts * q])
        prior = float((weight[1].sum() + 1) / (counts.sum() + 2))
        for v in (BAD, GOOD, ABSTAIN):
            hit = matrix == v
            chance[:, :, v] = (weight @ hit).T + 0.5
        chance /= chance.sum(axis=2, keepdims=True)
        for c, v, limit in ((1, BAD, BAD_ON_GOOD), (0, GOOD, GOOD_ON_BAD)):
            other = BAD + GOOD - v
            own = chance[:, c, v] / (chance[:, c, v] + chance[:, c, other])
            both = chance[:, c, v] + chance[:, c, other]
            own = np.minimum(own, limit)
            chance[:, c, v], chance[:, c, other] = own * both, (1 - own) * both
        log = np.stack([np.log(1 - prior) + 0, np.log(prior) + 0])[:, None] + np.zeros((2, len(matrix)))
        for j in range(matrix.shape[1]):
            for c in (0, 1):
                # abstaining says how much text there is, not how good it is
                log[c] += np.where(matrix[:, j] == ABSTAIN, 0, np.log(chance[j, c, matrix[:, j]] / (1 - chance[j, c, ABSTAIN])))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - q).max(initial=0) < 1e-7:
            break
        q = new
    return q, chance, prior


def hashed(block: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word (first half of the buckets), of its shape and of whether it repeats the word before it (second
    half), and offsets by text."""
    starts, ends, owner = block.spans(SPACES)
    low = block.data | np.where((block.data >= 65) & (block.data < 91), 32, 0).astype(np.uint8)
    half = BUCKETS // 2
    words = (span_hashes(low, starts, ends) >> U64(45)) % U64(half)
    kinds = np.arange(256, dtype=np.uint8)
    kinds[65:91], kinds[97:123], kinds[128:], kinds[48:58] = 65, 97, 97, 48
    shape = kinds[block.data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shapes = (span_hashes(shape[keep], at[starts], at[ends]) >> U64(45)) % U64(half) + U64(half)
    again = np.zeros(len(words), U64)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    return np.stack([words, shapes, again + U64(half)], axis=1).astype(np.int32), np.searchsorted(owner, np.arange(len(block) + 1))


def fit_linear(docs: list[np.ndarray], target: np.ndarray, epochs: int = 30, rate: float = 0.5, decay: float = 1e-6, batch: int = 64, seed: int = 3) -> np.ndarray:
    """Weights by bucket, the bias last. A document's features are the shares of its words in each bucket, times ten."""
    rng, w = np.random.default_rng(seed), np.zeros(BUCKETS + 1)
    seen = np.full(BUCKETS + 1, 1e-3)
    prior = float(np.clip(target.mean(), 0.02, 0.98))
    w[-1] = np.log(prior / (1 - prior))
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            pick = [i for i in order[at : at + batch] if len(docs[i])]
            if not pick:
                continue
            ids = np.concatenate([docs[i].ravel() for i in pick])
            of = np.repeat(np.arange(len(pick)), [docs[i].size for i in pick])
            share = np.repeat([10 / (len(docs[i]) + SHORT) for i in pick], [docs[i].size for i in pick])
            z = np.bincount(of, weights=w[ids] * share, minlength=len(pick)) + w[-1]
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[pick]) / len(pick)
            g = np.bincount(ids, weights=d[of] * share, minlength=BUCKETS + 1)
            touched = np.flatnonzero(g)
            g[touched] += decay * w[touched]
            seen[touched] += g[touched] ** 2
            w[touched] -= rate * g[touched] / np.sqrt(seen[touched])
    return w


def linear_scores(ids: np.ndarray, offsets: np.ndarray, w: np.ndarray) -> np.ndarray:
    n = np.diff(offsets)
    total = np.diff(np.concatenate([[0.0], np.cumsum(w[ids].sum(axis=1))])[offsets])
    return 1 / (1 + np.exp(-np.clip(10 * total / (n + SHORT) + w[-1], -50, 50)))


def fit(documents: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The scorer's weights. Votes are counted over all documents; at most sample documents, in the order of a hash of
    their id and text, train the scorer. Rows equal in both are one, however often they repeat."""

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = np.concatenate([pattern(votes(b)) for b in texts(batch.column("text"), lower=False)])
        found, n = np.unique(codes, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["code", "n"])

    table = arrow_map(documents.select("text"), vote, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas().sort_values("code")
    if not len(table):
        return np.zeros(BUCKETS + 1)
    codes = table["code"].to_numpy()
    q, _, _ = expectation_maximisation(unpattern(codes), table["n"].to_numpy(np.float64))

    keyed = documents.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    picked = cut(keyed.select("key").distinct().orderBy("key").limit(sample))

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, codes = [], []
        for b in texts(batch.column("text"), lower=False):
            x, offsets = hashed(b)
            rows += [x[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(b))]
            codes.append(pattern(votes(b)))
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(np.concatenate(codes)), batch.column("key").cast(pa.int64())], names=["x", "code", "key"])

    # at most sample keys are broadcast, and as many rows come back
    once = keyed.join(F.broadcast(picked), "key").groupBy("key").agg(F.first("text").alias("text"))
    rows = arrow_map(once.select("text", "key"), features, "x binary, code long, key long").toPandas()
    rows = rows.sort_values(["key", "x"], kind="stable", ignore_index=True)
    if not len(rows):
        return np.zeros(BUCKETS + 1)
    target = q[np.searchsorted(codes, rows["code"].to_numpy())]
    return fit_linear([np.frombuffer(b, np.int32).reshape(-1, 3) for b in rows["x"]], target)


def _scores(batch: pa.RecordBatch, w: np.ndarray) -> np.ndarray:
    return np.concatenate([linear_scores(*hashed(b), w) for b in texts(batch.column("text"), lower=False)])


def quality(documents: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and kept of every document."""
    w = fit(documents, sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = _scores(batch, w)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(p >= least)], names=["doc_id", "score", "kept"])

    return arrow_map(documents.select("doc_id", "text"), run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double, kept boolean")


def keep_good(documents: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    w = fit(documents, sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_scores(batch, w) >= least))

    return arrow_map(documents, run, documents.schema)
