import numpy as np
import pyarrow as pa
import pytest
import regex

from siftlake.llm.text import ALNUM, NONSPACE, Lookup, Words, distinct_sets, ragged, shingles, slices, utf8

FOLD = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


@pytest.mark.parametrize("inside, pattern", [(ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (NONSPACE, rb"[^\x20\x09-\x0D]+")])
def test_words_are_those_of_the_pattern(inside, pattern, texts):
    column = pa.array([t for _, t in texts])
    buf, offsets = utf8(column)
    w = Words(buf, offsets, inside)
    got = [[bytes(buf[w.start[i] : w.end[i]]).translate(FOLD) for i in range(w.first[d], w.first[d + 1])] for d in range(len(column))]
    want = [regex.findall(pattern, (t or "").encode().translate(FOLD)) for _, t in texts]
    assert got == want
    h = w.hashes()
    seen = {}
    for value, word in zip(h.tolist(), (x for d in want for x in d), strict=True):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_shingles():
    column = pa.array(["a b c d e f", "a b", None, "b c d e f", "A B", "a b c d e a b c d e"])
    w = Words(*utf8(column), NONSPACE)
    value, edge = distinct_sets(*shingles(w, w.hashes(), 5), len(column))
    assert np.diff(edge).tolist() == [2, 1, 0, 1, 1, 5]
    sets = [set(value[a:b].tolist()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    assert sets[3] < sets[0] and sets[1] == sets[4] and len(sets[0] & sets[5]) == 1


def test_lookup_and_ragged():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    table = Lookup(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert (Lookup(keys[:0]).find(keys) == -1).all()
    assert ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_slices_hold_whole_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c" * 5])], ["t"])
    assert [s.num_rows for s in slices(batch, "t", 20)] == [2, 1, 2]
