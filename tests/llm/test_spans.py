import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortkit.llm import spans

WORDS = st.lists(st.text("ab é\n\t🙂", max_size=12), max_size=6)


@settings(deadline=None)
@given(WORDS)
def test_runs_are_words(strings):
    data, offsets = spans.texts(pa.array(strings, pa.string()))
    starts, ends, first = spans.runs(~spans.SPACE[data], offsets)
    found = [
        [data[a:b].tobytes().decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)]
        for i, j in zip(first[:-1], first[1:], strict=True)
    ]
    assert found == [s.split() for s in strings]


@settings(deadline=None)
@given(WORDS)
def test_hash_depends_on_content_only(strings):
    data, offsets = spans.texts(pa.array(strings, pa.string()))
    starts, ends, _ = spans.runs(~spans.SPACE[data], offsets)
    by_word = {}
    for a, b, h in zip(starts, ends, spans.hashes(data, starts, ends), strict=True):
        assert by_word.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_hash_of_spans_beyond_a_block():
    data = np.frombuffer(b"x" * (spans.BLOCK + 5) + b" ab ab " + b"y" * spans.BLOCK, np.uint8)
    starts, ends, _ = spans.runs(~spans.SPACE[data], np.array([0, len(data)]))
    found = spans.hashes(data, starts, ends)
    assert len(set(found.tolist())) == 3 and found[1] == found[2]


def test_shingles_of_short_and_repeated_texts():
    words = np.array([1, 2, 3, 1, 2, 3, 1, 2, 9], np.uint64)
    sets = spans.shingles(words, np.array([0, 0, 8, 9]), 3)
    assert [len(s) for s in sets] == [0, 3, 1]
    assert len(spans.shingles(words[:0], np.array([0, 0]), 3)[0]) == 0


def test_slices_of_arrow_columns():
    column = pa.array(["a", "bc", "", "def"])[1:]
    data, offsets = spans.texts(column)
    assert data.tobytes() == b"bcdef" and offsets.tolist() == [0, 2, 2, 5]
    data, offsets = spans.texts(pa.array([], pa.string()))
    assert len(data) == 0 and offsets.tolist() == [0]
