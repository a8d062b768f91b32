import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from graphloom.llm import finite_state_counts as fsc
from graphloom.llm.finite_state_counts import BEGIN, END, MARK, NEXT, REST, TokenCounter, Transducer, chunk_starts, default_tokenizer, piece_marks, token_counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(default_tokenizer())


def lengths(library, texts):
    return [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]


BITS = [
    "'", "s", "t", "re", "ve", "'ll", "l", "d", "m", "'S", "e", "r", "v", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", " ", " ", "​", "　",
    "a", "É", "ß", "1", "٣", "Ⅷ", "²", "!", "…", "_", "日本", "🙂", "́", "\0", "x", "ing", "the", " of", "<|endoftext|>", "<|endoftext", "==", "--",
]


@pytest.mark.parametrize("seed", range(3))
def test_counts_are_those_of_the_library(library, counter, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["".join(rng.choice("abcdeft hion") for _ in range(rng.randrange(200))) for _ in range(500)]
    assert counter([t.encode() for t in texts]).tolist() == lengths(library, texts)


def test_runs_and_long_pieces(library, counter):
    texts = [c * n for c in ("a", " ", "\n", "=", "0", "'", "é", "ab") for n in (1, 2, 3, 15, 16, 17, 63, 64, 65, 129, 1000)]
    rng = random.Random(9)
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(20_000))]
    assert counter([t.encode() for t in texts]).tolist() == lengths(library, texts)


def test_every_token_and_every_pair_of_frequent_ones(library, counter):
    texts = [library.decode([i]) for i in range(50_257)]
    texts += [texts[a] + texts[b] for a in range(256, 500) for b in range(256, 400, 3)]
    assert counter([t.encode() for t in texts]).tolist() == lengths(library, texts)


def test_classes_are_those_of_the_library_for_all_code_points(library):
    # a probe of each code point between a letter, a digit and a mark
    classes = fsc.Classes(library.pre_tokenizer)
    for lo in (0, 0x2000, 0x1F300, 0x10FFFF - 2000):
        points = [p for p in range(lo, lo + 2000) if not 0xD800 <= p < 0xE000]
        text = "".join(f"a{chr(p)}1{chr(p)}!{chr(p)} " for p in points)
        begins = piece_marks(classes(np.frombuffer(text.encode("utf-32-le"), np.uint32)))
        assert np.flatnonzero(begins).tolist() == [span[0] for _, span in library.pre_tokenizer.pre_tokenize_str(text)]


def test_chunks_of_any_length_give_the_same_pieces():
    rng = np.random.default_rng(4)
    classes = rng.integers(0, REST, 3000).astype(np.uint8)
    state, marks = BEGIN, []
    for c in classes:
        marks.append(MARK[state, c])
        state = NEXT[state, c]
    want = [bool(m & 1) or bool(i + 1 < len(marks) and marks[i + 1] & 2) for i, m in enumerate(marks)]
    for chunk in (1, 2, 7, 64, 5000):
        assert piece_marks(classes, chunk).tolist() == want
    assert len(piece_marks(np.full(5, END, np.uint8))) == 5 and len(piece_marks(np.zeros(0, np.uint8))) == 0


def test_maps_compose_in_order():
    rng = np.random.default_rng(5)
    maps = rng.integers(0, 13, (37, 13)).astype(np.uint8)
    state, want = BEGIN, []
    for m in maps:
        want.append(state)
        state = m[state]
    assert chunk_starts(maps).tolist() == want


def test_states_are_dropped_and_made_again(library, counter):
    small = Transducer.__new__(Transducer)
    small.__dict__.update(counter.transducer.__dict__, most_states=40, room=1 << 16)
    small._reset()
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdeftion") for _ in range(rng.randrange(1, 300))) for _ in range(200)]
    codes = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    assert small.counts(codes, starts, ends).tolist() == lengths(library, texts)


def test_odd_rows(library, odd_docs, odd_rows, no_docs):
    got = sorted(tuple(r) for r in token_counts(odd_docs, limit=3).na.fill(0, ["doc_id"]).collect())
    texts = [t or "" for _, t in odd_rows]
    want = sorted((i or 0, len(t.encode()), n, n > 3) for (i, _), t, n in zip(odd_rows, texts, lengths(library, texts)))
    assert got == want
    assert token_counts(no_docs).count() == 0


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], lengths(library, [r.text or "" for r in rows])))
    assert {r.doc_id: r.n_tokens for r in token_counts(docs).collect()} == want
