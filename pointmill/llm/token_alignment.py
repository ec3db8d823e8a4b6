"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, by diagonal run skipping.

Each text, with a space before it, is encoded by A (byte-level) and by B (pieces). Byte offsets where a token of both ends cut
it into groups; a link is a pair of tokens whose byte ranges overlap. The aligner compares the two arrays of token ends at the
current shift between their indices, over stretches that double as long as they agree (so a one-to-one stretch of n tokens
takes log n comparisons); where they part, one irregular group is walked to its end and the shift is updated.

Neither tokenizer joins a token over the start of white space that follows a visible character, so texts fall into units
there (white space and what follows it). The units of a text are numbered by hash; those that a worker hasn't met before are
laid end to end, encoded, and aligned by one pass of the aligner; a text's groups are its units' groups one after another.

Work on Spark: one pass writes a row for each block of documents (their units, the units' links as places in the block's own
list of id pairs, and how often each pair stands there). The blocks' pairs are summed by pair, each block gets the counts of
its own pairs back, and sums them by document. Shuffled are pairs by block and blocks, never links; what is broadcast is one
row for each id of B.

Texts that are null or empty, or whose joined tokens of A or of B aren't the text with its space, have no tokens: zeros and
an empty string. Very long texts are read whole, in windows that end where a unit does. Repeated rows are documents of their
own, and count each. Among pairs of one B id that share the highest count, all are the best. Other columns are never read,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import ROWS_PER_BATCH, cut, table_in_shared_folder
from pointmill.llm.packing import tokenizer_path
from pointmill.llm.words import Texts, span_hashes, texts

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
WINDOW = 1 << 20
_MARK = "▁"


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the groups of two rising arrays of token ends with one last value: how many tokens of each lie before."""
    a, b = a.tolist(), b.tolist()
    i = j = 0
    n, m = len(a), len(b)
    cuts_a: list[int] = []
    cuts_b: list[int] = []
    while i < n:
        step = 1
        while i < n:  # at the shift j - i
            run = k = min(step, n - i, m - j)
            if a[i : i + k] != b[j : j + k]:
                run = 0
                while k - run > 1:  # the first run of them are equal, not the first k
                    mid = (run + k) // 2
                    if a[i + run : i + mid] == b[j + run : j + mid]:
                        run = mid
                    else:
                        k = mid
            if run:
                cuts_a.extend(range(i + 1, i + run + 1))
                cuts_b.extend(range(j + 1, j + run + 1))
                i, j = i + run, j + run
            if run < k:
                break
            step *= 2
        if i == n:
            break
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
        cuts_a.append(i)
        cuts_b.append(j)
    return np.array(cuts_a, np.int64), np.array(cuts_b, np.int64)


def _byte_levels() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(others)}


class Aligner:
    """Units met so far, with their tokens' groups and links; made anew in each Python worker."""

    KEPT, TOGETHER = 350_000, 512

    def __init__(self, path_a: str, path_b: str):
        self.paths, self.a = (path_a, path_b), None

    def __getstate__(self):
        return {"paths": self.paths, "a": None}

    def open(self) -> None:
        if self.a is not None:
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(self.paths[0])
        self.a.encode_special_tokens = True
        level = _byte_levels()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.bytes_a[k] = bytes(level[c] for c in entry) if all(c in level for c in entry) else entry.encode()
        self.b = SentencePieceProcessor(model_file=self.paths[1])
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(_MARK, " ").encode() for k, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id(_MARK)
        # white space that a unit may start with: no piece holds it after another character
        self.starts = np.zeros(256, bool)
        for c in " \n\t\x0b\x0c":
            inner = [p.lstrip(_MARK) if c == " " else p for p in pieces if len(p) > 1]
            self.starts[ord(c)] = not any((_MARK if c == " " else c) in p for p in inner)
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.text_a, self.text_b = [str(k) for k in range(len(self.bytes_a))], [str(k) for k in range(len(self.bytes_b))]
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.strings: list[bytes | None] = []  # None: its tokens aren't its bytes
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.first = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)  # A << 32 | B

    def windows(self, block: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Bytes, unit starts and ends, and the text of each unit; a text longer than WINDOW comes in several windows."""
        if len(block.data) <= 2 * WINDOW:
            starts = np.unique(np.concatenate([block.offsets[:-1], self._starts(block.data)]))
            starts = starts[starts < len(block.data)]
            yield block.data, starts, np.append(starts[1:], len(block.data)), np.searchsorted(block.offsets, starts, side="right") - 1
            return
        at, size = 0, WINDOW  # one text: texts() makes a long one a run of its own, others end at their offsets
        for k in range(len(block)):
            data = block.data[block.offsets[k] : block.offsets[k + 1]]
            at = 0
            while at < len(data):
                to = min(at + size, len(data))
                starts = self._starts(data[at:to])
                if to < len(data):
                    if not len(starts):
                        size *= 2
                        continue
                    to = at + int(starts[-1])
                    starts = starts[:-1]
                starts = np.concatenate([[0], starts])
                yield data[at:to], starts, np.append(starts[1:], to - at), np.full(len(starts), k)
                at, size = to, WINDOW

    def _starts(self, data: np.ndarray) -> np.ndarray:
        """Where a unit starts: white space after a visible character of ASCII or of the two-byte letters."""
        if len(data) < 2:
            return np.zeros(0, np.int64)
        visible = (data > 0x20) & (data < 0x7F)
        visible[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        return np.flatnonzero(self.starts[data[1:]] & visible[:-1]) + 1

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each unit; new ones are encoded and aligned first."""
        hashes, at, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        keys = hashes.tolist()
        fresh = [k for k, h in enumerate(keys) if h not in self.known]
        if fresh:
            raw = data.tobytes()
            self._learn([raw[s:e] for s, e in zip(starts[at[fresh]].tolist(), ends[at[fresh]].tolist(), strict=True)])
            first = len(self.known)
            self.known.update((keys[k], first + i) for i, k in enumerate(fresh))
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[back]

    def _encoded(self, units: list[bytes]) -> tuple[list[int], list[int]] | None:
        """Ids of A and of B of units that may stand one after another, or None if they aren't the units' bytes."""
        text = b"".join(units).decode()
        ids_a = self.a.encode(text, add_special_tokens=False).ids
        if text == " ":
            ids_b = [self.mark]
        else:
            ids_b = self.b.encode(text[1:] if text[0] == " " else text, num_threads=1)
            if text[0] != " " and ids_b[:1] == [self.mark]:
                ids_b = ids_b[1:]  # B writes a space before what it is given; this isn't the unit's
        raw = text.encode()
        return (ids_a, ids_b) if all(b"".join(map(of.__getitem__, ids)) == raw for of, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))) else None

    def _learn(self, units: list[bytes]) -> None:
        """Encodes units together where white space may follow each, in lots; the others by themselves."""
        lots: list[list[int]] = []
        lot: list[int] = []
        for i, u in enumerate(units):
            if 0x20 < u[-1] < 0x7F:
                lot.append(i)
                if len(lot) == self.TOGETHER:
                    lots.append(lot)
                    lot = []
            else:
                lots.append([i])
        lots.append(lot)
        own: list[int] = []
        ids_a: list[int] = []
        ids_b: list[int] = []
        while lots:
            lot = lots.pop()
            if not lot:
                continue
            if found := self._encoded([units[i] for i in lot]):
                own += lot
                ids_a += found[0]
                ids_b += found[1]
            elif len(lot) > 1:
                half = len(lot) // 2
                lots += [lot[:half], lot[half:]]
        sizes = np.zeros((len(units), 4), np.int64)
        first = np.zeros(len(units), np.int64)
        links = np.zeros(0, np.int64)
        strings: list[bytes | None] = [None] * len(units)
        if own:
            flat_a, flat_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
            ends_a, ends_b = np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b])
            edges = np.cumsum([len(units[i]) for i in own])
            cuts_a, cuts_b = align(ends_a, ends_b)
            spans = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
            spans = spans[np.append(spans[1:] != spans[:-1], True)]  # each span between two ends is a link
            links = flat_a[np.searchsorted(ends_a, spans)] << 32 | flat_b[np.searchsorted(ends_b, spans)]
            until = np.stack([np.searchsorted(e, edges, side="right") for e in (ends_a, ends_b, ends_a[cuts_a - 1], spans)], axis=1)
            sizes[own] = np.diff(until, axis=0, prepend=np.zeros((1, 4), np.int64))
            first[own] = len(self.links) + until[:, 3] - sizes[own, 3]
            groups, i, j = [], 0, 0
            word_a, word_b = self.text_a, self.text_b
            for p, q in zip(cuts_a.tolist(), cuts_b.tolist(), strict=True):
                if p == i + 1 and q == j + 1:
                    groups.append(f"{word_a[ids_a[i]]}|{word_b[ids_b[j]]}")
                else:
                    groups.append(",".join([word_a[k] for k in ids_a[i:p]]) + "|" + ",".join([word_b[k] for k in ids_b[j:q]]))
                i, j = p, q
            lo = 0
            for i, hi in zip(own, until[:, 2].tolist(), strict=True):
                strings[i] = ";".join(groups[lo:hi]).encode()
                lo = hi
        self.first = np.concatenate([self.first, first])
        self.links = np.concatenate([self.links, links])
        self.sizes = np.vstack([self.sizes, sizes])
        self.strings += strings


def _gathered(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (size[i] of them) for each i, one after another."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _packed(values: np.ndarray) -> bytes:
    """Values under 2^31, compressed, after their number."""
    return len(values).to_bytes(8, "little") + pa.compress(values.astype(np.int32).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], 4 * size, codec="zstd", asbytes=True), np.int32) if size else np.zeros(0, np.int32)


def _block(aligner: Aligner, column: pa.Array) -> dict[str, np.ndarray | list]:
    """What one block's row holds, beside its id and the documents' ids."""
    aligner.open()
    if len(aligner.known) > aligner.KEPT:
        aligner.forget()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    bad = pc.equal(column, "").to_numpy(zero_copy_only=False).copy()
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string()))
    digests = [hashlib.sha256() for _ in range(n)]
    begun = bad.copy()  # of the others, whether a group was written
    owners, numbers = [], []
    for run in texts(spaced, lower=False):
        for data, starts, ends, owner in aligner.windows(run):
            own = aligner.numbers(data, starts, ends)
            owner = owner + run.first
            edges = np.flatnonzero(np.diff(owner, prepend=-1))
            strings = [aligner.strings[k] for k in own.tolist()]
            for lo, hi in zip(edges.tolist(), np.append(edges[1:], len(own)).tolist(), strict=True):
                k = int(owner[lo])
                if bad[k]:
                    continue
                part = strings[lo:hi]
                if None in part:
                    bad[k] = True
                    continue
                if begun[k]:
                    digests[k].update(b";")
                begun[k] = True
                digests[k].update(b";".join(part))
            owners.append(owner)
            numbers.append(own)
    owner, number = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, numbers))
    owner, number = owner[~bad[owner]], number[~bad[owner]]
    sizes = np.stack([np.bincount(owner, weights=aligner.sizes[number, c], minlength=n) for c in range(4)], axis=1).astype(np.int64)
    mine, back, times = np.unique(number, return_inverse=True, return_counts=True)
    each = aligner.sizes[mine, 3]
    pairs, place = np.unique(aligner.links[_gathered(aligner.first[mine], each)], return_inverse=True)
    return {
        "n_a": sizes[:, 0],
        "n_b": sizes[:, 1],
        "n_groups": sizes[:, 2],
        "n_links": sizes[:, 3],
        "groups_sha256": ["" if b else d.hexdigest() for b, d in zip(bad.tolist(), digests, strict=True)],
        "doc_units": np.bincount(owner, minlength=n).astype(np.int64),
        "units": _packed(back),
        "unit_links": _packed(each),
        "links": _packed(place),
        "pair_a": (pairs >> 32).astype(np.int32),
        "pair_b": (pairs & 0xFFFFFFFF).astype(np.int32),
        "pair_n": np.bincount(place, weights=np.repeat(times, each), minlength=len(pairs)).astype(np.int64),
    }


_SUMS = ["n_a", "n_b", "n_groups", "n_links"]
_KINDS = dict.fromkeys([*_SUMS, "doc_units", "pair_n"], "array<long>") | {"groups_sha256": "array<string>"} | dict.fromkeys(["pair_a", "pair_b"], "array<int>") | dict.fromkeys(["units", "unit_links", "links"], "binary")


def _blocks(documents: DataFrame, text: str, aligner: Aligner) -> DataFrame:
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_BATCH):
                part = batch.slice(at, ROWS_PER_BATCH)
                row = {"block": made, "doc_ids": part.column(0)} | _block(aligner, part.column(1))
                made += 1
                columns = [pa.array([row["block"]], pa.int64())]
                for name in ("doc_ids", *_KINDS):
                    if isinstance(row[name], bytes):
                        columns.append(pa.array([row[name]], pa.binary()))
                        continue
                    values = row[name] if isinstance(row[name], pa.Array) else pa.array(row[name])
                    columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
                yield pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", *_KINDS])

    schema = f"block long, doc_ids array<{kind}>, " + ", ".join(f"{c} {t}" for c, t in _KINDS.items())
    return documents.select("doc_id", F.col(text)).mapInArrow(run, schema)


def _finished(blocks: DataFrame, kind: str) -> DataFrame:
    """The documents of blocks (with the found counts of their pairs) as rows."""
    names = [*_SUMS, "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in ("doc_ids", *_SUMS, "groups_sha256", "doc_units")}
                found = batch.column("found")[i].values
                place = found.field("i").to_numpy() if found is not None else np.zeros(0, np.int64)
                count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                if len(place):
                    count[place], best[place] = found.field("c").to_numpy(), found.field("best").to_numpy(zero_copy_only=False)
                units, unit_links, links = (_unpacked(batch.column(c)[i].as_py()) for c in ("units", "unit_links", "links"))

                def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
                    total = np.concatenate([[0], np.cumsum(values)])
                    ends = np.cumsum(sizes)
                    return total[ends] - total[ends - sizes]

                each, docs = unit_links.astype(np.int64), row["doc_units"].to_numpy()
                sums = {n: summed(summed(v[links], each)[units], docs) for n, v in (("n_best", best), ("count_sum", count))}
                yield pa.RecordBatch.from_arrays([row["doc_ids"], *(pa.array(sums[n], pa.int64()) if n in sums else row[n] for n in names)], names=["doc_id", *names])

    return blocks.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'long'}" for n in names))


def token_alignment(documents: DataFrame, text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document.

    n_best: links whose pair of ids is linked most often, over all documents, of the pairs with its B id. count_sum: the sum
    over links of how many links hold their pair of ids."""
    aligner = Aligner(path_a or tokenizer_path(TOKENIZER_A), path_b or tokenizer_path(TOKENIZER_B))
    blocks = table_in_shared_folder(_blocks(documents, text, aligner), "token-blocks")
    own = blocks.select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("i", "p")).select("block", "i", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n"))
    counts = cut(own.groupBy("a", "b").agg(F.sum("n").alias("c")))
    top = counts.groupBy("b").agg(F.max("c").alias("top"))  # a row for each id of B
    scored = counts.join(F.broadcast(top), "b").select("a", "b", "c", (F.col("c") == F.col("top")).alias("best"))
    found = own.join(scored, ["a", "b"]).groupBy("block").agg(F.collect_list(F.struct("i", "c", "best")).alias("found"))
    docs = blocks.select("block", "doc_ids", *_SUMS, "groups_sha256", "doc_units", "units", "unit_links", "links")
    return _finished(docs.join(found, "block", "left"), documents.schema["doc_id"].dataType.simpleString())
