"""Alignment of two tokenizers against whole texts encoded one by one."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pointmill.llm import token_alignment as ta
from pointmill.llm.packing import tokenizer_path

from .conftest import plain, prose


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(tokenizer_path(ta.TOKENIZER_A))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=tokenizer_path(ta.TOKENIZER_B))
    level = {}
    extra = 256
    for x in range(256):  # the public rule of byte-level vocabularies
        if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255:
            level[chr(x)] = x
        else:
            level[chr(extra)] = x
            extra += 1
    return a, b, level


def encoded(text, tokenizers):
    """(id, start, end) of the tokens of both; None if they aren't the text."""
    a, b, level = tokenizers
    if not text:
        return None
    want = (" " + text).encode()
    out = []
    for ids, of in ((a.encode(" " + text, add_special_tokens=False).ids, lambda k: bytes(level[c] for c in a.id_to_token(k))), (b.encode(text), lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode())):
        parts = [of(k) for k in ids]
        if b"".join(parts) != want:
            return None
        ends = np.cumsum([len(p) for p in parts]).tolist()
        out.append(list(zip(ids, [0, *ends], ends)))
    return out


def expected(rows, tokenizers):
    found = [(i, encoded(t, tokenizers)) for i, t in rows]
    links = []
    for _, both in found:
        own = []
        if both:
            a, b = both
            j = 0
            for x, s, e in a:
                while j and b[j - 1][2] > s:
                    j -= 1
                while j < len(b) and b[j][1] < e:
                    if b[j][2] > s:
                        own.append((x, b[j][0]))
                    j += 1
        links.append(own)
    count = Counter(p for own in links for p in own)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for (i, both), own in zip(found, links):
        if not both:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b = both
        common = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, lo = [], 0
        for hi in common:
            groups.append(",".join(str(k) for k, s, e in a if lo <= s and e <= hi) + "|" + ",".join(str(k) for k, s, e in b if lo <= s and e <= hi))
            lo = hi
        out.append((i, len(a), len(b), len(groups), len(own), sum(count[p] == top[p[1]] for p in own), sum(count[p] for p in own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = [
    None, "", " ", "  ", "\n", "\n\n", "a", " a", "  a  b ", "a\n", "a\n\n b", "a;\r\nb", "x\r\n\r\ny", "tab\tand\x0bmore\x0c end", "don't we'll I'M",
    "<|endoftext|> <s> </s> <0x41> <unk>", "東京 は　広い", "naïve café – “quoted” ﬁne", "🙂🙂 🙂", "a▁b", "a b c", "a   b", "\u0085x", "a\x1cb \x1f c", "\x00", "é x", "1234567 89,00", "}\n\t\treturn;\n",
    "ééé ÀÀ  ×÷", " \t \n mixed \t\n", "x" * 300, "word " * 50,
]


def test_texts_of_all_kinds(spark, tokenizers):
    rows = list(enumerate(ODD)) + [(5, "a"), (5, "a"), (None, "tail text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert plain(ta.token_alignment(docs)) == expected(rows, tokenizers)


def test_table_equals_whole_texts(spark, tables, tokenizers):
    docs = tables["documents"].where("length(text) < 3000")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert plain(ta.token_alignment(docs)) == expected(rows, tokenizers)


def test_odd_rows_and_no_rows(spark, odd, empty, tokenizers):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if (r["n_chars"] or 0) < 10_000]
    docs = odd.where("coalesce(n_chars, 0) < 10000").withColumnsRenamed({"lang": "block", "source": "units"})
    assert plain(ta.token_alignment(docs)) == expected(rows, tokenizers)
    assert ta.token_alignment(empty).collect() == []


def test_long_texts_in_windows(spark, monkeypatch):
    rows = [(1, prose(4, 4000)), (2, prose(5, 30)), (3, "z" * 9000 + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    whole = plain(ta.token_alignment(docs))

    class Narrow(ta.Aligner):
        def windows(self, block):
            ta.WINDOW = 700
            yield from super().windows(block)

    monkeypatch.setattr(ta, "Aligner", Narrow)
    assert plain(ta.token_alignment(docs)) == whole


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=40))
def test_aligner_by_sets(x, y):
    a, b = np.cumsum(x), np.cumsum(y)
    last = max(a[-1], b[-1])
    a, b = (np.append(v, last) if v[-1] < last else v for v in (a, b))
    cuts_a, cuts_b = ta.align(a, b)
    common = sorted(set(a.tolist()) & set(b.tolist()))
    assert a[cuts_a - 1].tolist() == common == b[cuts_b - 1].tolist()


def test_aligner_skips_long_stretches():
    a = np.arange(1, 100_001)
    b = np.delete(a, 50_000)
    cuts_a, cuts_b = ta.align(a, b)
    assert len(cuts_a) == 99_999 and cuts_a[-1] == 100_000 and cuts_b[-1] == 99_999
