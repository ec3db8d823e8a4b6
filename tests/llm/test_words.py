import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pointmill.llm.words import shingles, texts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té東", max_size=30)), min_size=1, max_size=8))
def test_words_hash_as_they_compare(column):
    seen = {}
    for block in texts(pa.array(column, pa.string()), block=16):
        hashes, offsets = block.words()
        for i in range(len(block)):
            words = [w for w in (column[block.first + i] or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
            own = hashes[offsets[i] : offsets[i + 1]].tolist()
            assert len(own) == len(words)
            for w, h in zip(words, own, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_words_and_blocks():
    a = "x" * 3_000_000
    hashes = []
    for block in texts(pa.array([a + " y", a + "z " + a, "y"])):
        hashes += block.words()[0].tolist()
    assert hashes[0] == hashes[3] and hashes[1] == hashes[4] and hashes[0] != hashes[2]


def test_shingles():
    (block,) = texts(pa.array(["a b c d e f", "a b", "", "b c d e f", "a b c d e"]))
    s, o = shingles(*block.words())
    assert (o[1:] - o[:-1]).tolist() == [2, 1, 0, 1, 1]
    assert s[0] == s[4] and s[1] == s[3] and len(set(s.tolist())) == 3
