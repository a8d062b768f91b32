import numpy as np
import pyarrow as pa

from graphloom.llm.words import WordHasher, checksum, slices, windows


def test_words_are_those_of_a_split(odd_rows):
    texts = [(t or "").encode() for _, t in odd_rows]
    words = [t.split() for t in texts]
    for piece in (4, 100, 1 << 20):
        found = WordHasher(piece)(texts)
        assert np.diff(found.first).tolist() == [len(w) for w in words]
        assert [found.buf[a:b] for a, b in zip(found.starts, found.ends)] == sum(words, [])
        number = dict(zip(sum(words, []), found.hashes.tolist()))
        assert found.hashes.tolist() == [number[w] for w in sum(words, [])]
        assert len(set(number.values())) == len(number)


def test_numbers_do_not_depend_on_the_piece(odd_rows):
    texts = [(t or "").encode() for _, t in odd_rows]
    assert (WordHasher(16)(texts).hashes == WordHasher()(texts).hashes).all()


def test_windows():
    found = WordHasher()([b"a b", b"", b"a b c d e f", None, b" b a", b"a  b"])
    runs, at, begin = windows(found.hashes, found.first, 5, short=True)
    assert at.tolist() == [0, 2, 3, 8, 10] and begin.tolist() == [0, 1, 1, 3, 3, 4, 5]
    assert runs[0] == runs[4] and len(set(runs.tolist())) == 4
    assert windows(found.hashes, found.first, 5, short=False)[1].tolist() == [2, 3]
    assert len(windows(np.zeros(0, np.uint64), np.zeros(1, np.int64), 5, short=True)[0]) == 0


def test_slices_cover_all_rows():
    texts = pa.array([b"x" * n for n in (1, 50, 3, 0, 200, 1)] + [None], pa.binary())
    parts = list(slices(texts, 60))
    assert sum((t for *_, t in parts), []) == texts.to_pylist()
    assert [(a, b) for a, b, _ in parts] == [(0, 4), (4, 5), (5, 7)]


def test_checksums_differ():
    a = np.arange(10, dtype=np.uint64)
    assert len({checksum(x) for x in (a, a[:9], a + np.uint64(1), a[::-1], a[:0])}) == 5
