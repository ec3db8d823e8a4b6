"""Packing by minimum bin slack.

Documents are tokenized; whole windows are cut off their front, and what remains of each (its tail) is shorter than a
window. The tails are planned as a multiset of lengths, whose size doesn't depend on the corpus: for the longest tail left,
a bitset subset-sum dynamic programme over all lengths left finds the multiset that fills its window closest to the
capacity, the counts are backtracked, and that pattern is used as often as the counts allow. Where even the best pattern
leaves slack, the front of another tail fills it and the rest of that tail goes back to the multiset. The last tails, which
don't fill a window, make sequences whose lengths are powers of two, which need no padding.

Each tail is then numbered among those of its length, by counts of hashed groups, and the plan tells its place.

Null and empty texts are the end token alone. Repeated rows are documents of their own. An empty table gives no pieces.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointmill.llm.common import arrow_map, cut, table_in_shared_folder
from pointmill.llm.words import SPACES, U64, Texts, span_hashes, texts

WINDOW, END = 4096, 2
TOKENIZER = "word_bpe_49k.json"
#: Documents that are numbered together; their number grows with the corpus, not their size.
GROUP_ROWS = 50_000
#: Cut documents whose ids are broadcast; beyond it, they are joined by a shuffle.
BROADCAST_IDS = 200_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokens:
    """Token ids of texts by a tokenizer that parts words at white space, and ASCII punctuation from letters.

    Ids are looked up by the hash of a unit (a run that the tokenizer never joins to its neighbours); units not met before
    are encoded once. A word with an apostrophe, or with characters other than ASCII and the Latin letters up to U+024F,
    is one unit, as are all words where the tokenizer doesn't fold case."""

    KEPT = 1_000_000  # units, before they are forgotten
    AT_ONCE = 4096
    _kind = np.zeros(256, np.uint8)  # 0: space, 1: letter, 2: digit, 3: other
    _kind[:] = 1
    _kind[[*range(128)]] = 3
    _kind[[*range(48, 58)]] = 2
    _kind[[*range(65, 91), *range(97, 123)]] = 1
    _kind[[9, 10, 11, 12, 13, 32]] = 0
    _odd = np.zeros(256, bool)
    _odd[[39, 0xC2, *range(0xCA, 0x100)]] = True
    _odd[[*range(0, 9), *range(14, 32), 127]] = True

    def __init__(self, path: str):
        self.path = path
        self.tokenizer = None

    def __getstate__(self):
        return {"path": self.path, "tokenizer": None}

    def _open(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        suffix, vocabulary = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.last = None
        if suffix:
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.first, self.count, self.ids, self.filled = np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1 << 16, np.uint32), 0

    def _units(self, block: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, owner = block.spans(SPACES)
        data = block.data
        kind = self._kind[data].copy()
        sign = self._odd[data].copy()
        sign[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs for times and divided by
        sign[1:] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)  # the dotted capital I, whose lower case has a mark of its own
        sign[1:] |= (data[:-1] == 60) & (data[1:] == 124)  # may begin a special token
        odd = np.diff(np.concatenate([[0], np.cumsum(sign)])[np.stack([starts, ends])], axis=0)[0] > 0
        inside = np.zeros(len(data) + 1, np.int64)
        np.add.at(inside, starts[odd], 1)
        np.add.at(inside, ends[odd], -1)
        whole = np.cumsum(inside[:-1]) > 0
        edge = np.zeros(len(data), bool)
        edge[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & ~whole[1:]
        edge[starts] = True
        edge &= kind != 0
        s = np.flatnonzero(edge)
        word = np.searchsorted(starts, s, side="right") - 1
        e = np.minimum(np.append(s[1:], len(data)), ends[word])
        return s, e, owner[word], whole[s]

    def _learn(self, block: Texts, hashes: np.ndarray, s: np.ndarray, e: np.ndarray, odd: np.ndarray) -> None:
        fresh, at = np.unique(hashes, return_index=True)
        if len(self.known):
            place = np.minimum(np.searchsorted(self.known, fresh), len(self.known) - 1)
            new = self.known[place] != fresh
            fresh, at = fresh[new], at[new]
        if not len(fresh):
            return
        raw = block.data.tobytes()
        units = [raw[a:b].decode() for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)]
        counts, first = np.zeros(len(units), np.int32), np.zeros(len(units), np.int32)
        for own, encode in ((np.flatnonzero(~odd[at]), self._encode_plain), (np.flatnonzero(odd[at]), self._encode)):
            for lo in range(0, len(own), self.AT_ONCE):
                some = own[lo : lo + self.AT_ONCE]
                ids, n = encode([units[i] for i in some.tolist()])
                while self.filled + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
                self.ids[self.filled : self.filled + len(ids)] = ids
                counts[some], first[some] = n, self.filled + np.cumsum(n) - n
                self.filled += len(ids)
        place = np.searchsorted(self.known, fresh)
        self.known, self.first, self.count = np.insert(self.known, place, fresh), np.insert(self.first, place, first), np.insert(self.count, place, counts)

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units one after another, and how many each has."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int32)

    def _encode_plain(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of units that the tokenizer takes whole: where it marks the last token of a word, all go at once."""
        if self.last is not None:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids])
            if len(ends) == len(units):
                return ids, np.diff(ends, prepend=-1).astype(np.int32)
        return self._encode(units)

    def __call__(self, block: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each ended by END, and offsets by text."""
        if self.tokenizer is None:
            self._open()
        if len(self.known) > self.KEPT:
            self._forget()
        s, e, owner, odd = self._units(block)
        hashes = span_hashes(block.data, s, e)
        self._learn(block, hashes, s, e, odd)
        if not len(hashes):
            return np.full(len(block), END, np.uint32), np.arange(len(block) + 1)
        at = np.searchsorted(self.known, hashes)
        count = self.count[at]
        total = np.bincount(owner, weights=count, minlength=len(block)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(total + 1)])
        out = np.full(offsets[-1], END, np.uint32)
        start = np.cumsum(count) - count
        source = np.arange(int(count.sum())) - np.repeat(start, count) + np.repeat(self.first[at], count)
        out[np.arange(len(source)) + np.repeat(owner, count)] = self.ids[source]
        return out, offsets


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


@dataclass(frozen=True)
class Placed:
    """Tails number lo .. lo + n - 1 of those of one length: from start on, length ids go to sequence first + t // each at
    base + (t % each) * length, where t counts from t0."""

    origin: int
    lo: int
    n: int
    start: int
    length: int
    t0: int
    each: int
    first: int
    base: int


def fill(counts: dict[int, int], lengths: list[int], target: int) -> dict[int, int]:
    """How many of each length make the largest sum up to target: a bitset of the sums that can be made, one shift for each
    binary part of a count, and the way back through the bitsets. lengths: keys of counts, in order of preference."""
    reach, mask, steps = 1, (1 << (target + 1)) - 1, []
    for length in lengths:
        left = min(counts[length], target // length)
        part = 1
        while left > 0:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            left -= part
            part *= 2
        if reach >> target & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            at -= length * part
            used[length] = used.get(length, 0) + part
    return used


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[Placed], int]:
    """Places for histogram[length] tails of each length (under window), and the number of sequences."""
    lots = {length: deque([(length, 0, n, 0)]) for length, n in histogram.items() if n}
    counts = {length: n for length, n in histogram.items() if n}
    out: list[Placed] = []
    sequence = 0

    def take(length: int, n: int, each: int, base: int, piece: int) -> None:
        """Places n tails, each to a sequence; what is left of them beyond piece goes back."""
        t, rest = 0, []
        while t < n:
            origin, lo, size, start = lots[length].popleft()
            got = min(size, n - t)
            out.append(Placed(origin, lo, got, start, piece, t, each, sequence, base))
            if piece < length:
                rest.append((origin, lo, got, start + piece))
            if got < size:
                lots[length].appendleft((origin, lo + got, size - got, start))
            t += got
        counts[length] -= n
        if not counts[length]:
            del counts[length], lots[length]
        if rest:
            counts[length - piece] = counts.get(length - piece, 0) + n
            lots.setdefault(length - piece, deque()).extend(rest)

    while counts:
        left = sum(length * n for length, n in counts.items())
        size = window if left >= window else 1 << (left.bit_length() - 1)  # too little for a window: powers of two
        lengths = sorted(counts, reverse=True)
        largest = lengths[0]
        if largest > size:
            take(largest, 1, 1, 0, size)
            sequence += 1
            continue
        others = counts | {largest: counts[largest] - 1}
        used = fill(others, [x for x in lengths if x <= size - largest and others[x]], size - largest)
        used[largest] = used.get(largest, 0) + 1
        times = min(counts[length] // m for length, m in used.items())
        if size < window:
            times = 1
        slack = size - sum(length * m for length, m in used.items())
        donor = None
        if slack:  # as enough is left and no shorter tail is, there is a longer one: it gives its front
            donor, times = next((length, k) for length in lengths if length > slack and (k := min(times, counts[length] // (used.get(length, 0) + 1))))
        base = 0
        for length, m in used.items():
            take(length, times * m, m, base, length)
            base += length * m
        if donor:
            take(donor, times, 1, base, slack)
        sequence += times
    return out, sequence


class Places:
    """The plan, ready to be looked up by length and number."""

    def __init__(self, placed: list[Placed]):
        by: dict[int, list[Placed]] = {}
        for p in placed:
            by.setdefault(p.origin, []).append(p)
        self.by = {}
        for origin, own in by.items():
            edges = np.unique([x for p in own for x in (p.lo, p.lo + p.n)])
            inside: list[list[Placed]] = [[] for _ in edges]
            for p in own:
                for i in range(int(np.searchsorted(edges, p.lo)), int(np.searchsorted(edges, p.lo + p.n))):
                    inside[i].append(p)
            self.by[origin] = edges, [sorted(x, key=lambda p: p.start) for x in inside]

    def __call__(self, length: int, number: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of each piece of a tail."""
        edges, inside = self.by[length]
        out = []
        for p in inside[int(np.searchsorted(edges, number, side="right")) - 1]:
            t = p.t0 + number - p.lo
            out.append((p.start, p.length, p.first + t // p.each, p.base + t % p.each * p.length))
        return out


def _tokenized(documents: DataFrame, path: str) -> DataFrame:
    tokens = Tokens(path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, tail, crcs = [], [], []
        for block in texts(batch.column("text"), lower=False, block=1 << 19):
            ids, offsets = tokens(block)
            for i in range(len(block)):
                own = ids[offsets[i] : offsets[i + 1]]
                n.append(len(own))
                tail.append(len(own) % WINDOW)
                crcs.append([crc(own[k : k + WINDOW]) for k in range(0, len(own), WINDOW)])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(tail, pa.int32()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "doc_tokens", "tail", "crcs"])

    slim = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return arrow_map(slim, run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, text_hash long, doc_tokens long, tail int, crcs array<long>")


def _numbered(table: DataFrame) -> DataFrame:
    """Adds number (from 0 among the tails of one length) and full_number (of the first whole window among all)."""
    groups = max(1, -(-table.count() // GROUP_ROWS))
    rows = table.withColumns({"__group": F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("long"), "full": F.floor(F.col("doc_tokens") / WINDOW).cast("long")})
    tails = rows.groupBy("__group", "tail").agg(F.count(F.lit(1)).alias("n"))
    before = tails.withColumn("tails_before", F.sum("n").over(Window.partitionBy("tail").orderBy("__group")) - F.col("n")).drop("n")
    fulls = rows.groupBy("__group").agg(F.sum("full").alias("n"))
    full_before = fulls.withColumn("full_before", F.sum("n").over(Window.orderBy("__group")) - F.col("n")).drop("n")  # a row for each group
    own = Window.partitionBy("__group", "tail").orderBy("uid")
    running = Window.partitionBy("__group").orderBy("tail", "uid")
    return (
        rows.withColumns({"__in_tail": F.row_number().over(own) - 1, "__in_full": F.sum("full").over(running) - F.col("full")})
        .join(before, ["__group", "tail"])
        .join(full_before, "__group")
        .withColumns({"number": F.col("tails_before") + F.col("__in_tail"), "full_number": F.col("full_before") + F.col("__in_full")})
    )


def pack(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    path = path or tokenizer_path()
    kind = documents.schema["doc_id"].dataType.simpleString()
    table = table_in_shared_folder(_tokenized(documents, path).withColumn("uid", F.monotonically_increasing_id()), "tokens")
    histogram = {r["tail"]: r["n"] for r in table.where("tail > 0").groupBy("tail").agg(F.count(F.lit(1)).alias("n")).collect()}  # WINDOW - 1 rows at most
    placed, sequences = plan(dict(sorted(histogram.items())))
    places = table.sparkSession.sparkContext.broadcast(Places(placed))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, rows = [], []
        for i, (n, tail, crcs, number, full) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_tokens", "tail", "crcs", "number", "full_number")), strict=True)):
            for k in range(n // WINDOW):
                own.append(i)
                rows.append((k * WINDOW, WINDOW, crcs[k], n, sequences + full + k, 0))
            if tail:
                for start, length, sequence, offset in places.value(tail, number):
                    own.append(i)
                    rows.append((n - tail + start, length, crcs[-1] if length == tail else None, n, sequence, offset))
        mine = batch.take(pa.array(own))
        return pa.RecordBatch.from_arrays([mine.column("doc_id"), mine.column("text_hash"), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))], names=["doc_id", "text_hash", *names])

    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    numbered = _numbered(table).select("doc_id", "text_hash", "doc_tokens", "tail", "crcs", "number", "full_number")
    pieces = cut(arrow_map(numbered, run, f"doc_id {kind}, text_hash long, {', '.join(f'{n} long' for n in names)}"))
    parts = pieces.where("ids_crc32 IS NULL")

    # tails that were cut: their ids once more, for the checksums of the pieces
    parts = parts.withColumnsRenamed({"doc_id": "piece_id", "text_hash": "piece_hash"})
    ids = parts.select(F.col("piece_id").alias("cut_id"), F.col("piece_hash").alias("cut_hash")).distinct()
    if parts.count() <= BROADCAST_IDS:
        ids, parts = F.broadcast(ids), F.broadcast(parts)
    slim = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = slim.join(ids, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("text_hash") == F.col("cut_hash")), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    joined = found.join(parts, F.col("doc_id").eqNullSafe(F.col("piece_id")) & (F.col("text_hash") == F.col("piece_hash"))).select("doc_id", "text", *names)
    tokens = Tokens(path)

    def recheck(batch: pa.RecordBatch) -> pa.RecordBatch:
        crcs, start, length = [], batch.column("start").to_pylist(), batch.column("length").to_pylist()
        for block in texts(batch.column("text"), lower=False, block=1 << 19):
            ids, offsets = tokens(block)
            for i in range(len(block)):
                at = int(offsets[i]) + start[block.first + i]
                crcs.append(crc(ids[at : at + length[block.first + i]]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(crcs, pa.int64()) if n == "ids_crc32" else batch.column(n) for n in names)], names=["doc_id", *names])

    again = arrow_map(joined, recheck, f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}")
    return pieces.where("ids_crc32 IS NOT NULL").select("doc_id", *names).unionByName(again)
