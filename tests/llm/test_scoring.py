import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import backoff_automaton
from graphloom.llm.backoff_automaton import Automaton, Block, log_probabilities
from graphloom.llm.words import WordHasher
from tests.llm.conftest import prose


def brute(rows, order, mass):
    """(held_out, tokens, known, N, base, score) of each row, by the formula."""
    texts = []
    for i, t in rows:
        held = zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
        texts.append((held, (t or "").encode().lower().split() + ["end"]))
    counts, contexts = Counter(), Counter()
    for held, tokens in texts:
        if not held:
            padded = ["start"] * (order - 1) + tokens
            for k in range(len(tokens)):
                for n in range(1, order + 1):
                    gram = tuple(padded[k + order - n : k + order])
                    counts[gram] += 1
                    contexts[gram[:-1]] += 1
    total, distinct = contexts[()], sum(len(g) == 1 for g in counts)

    def p(gram):
        if len(gram) == 1:
            return (counts[gram] + 0.1) / (total + 0.1 * (distinct + 1))
        return (counts[gram] + mass * p(gram[1:])) / (contexts[gram[:-1]] + mass)

    out = []
    for held, tokens in texts:
        padded = ["start"] * (order - 1) + tokens
        base = math.fsum(math.log10(p((t,))) for t in tokens)
        score = math.fsum(math.log10(p(tuple(padded[k : k + order]))) for k in range(len(tokens)))
        out.append((held, len(tokens), sum(counts[(t,)] > 0 for t in tokens), total, round(base, 5), round(score, 5)))
    return out


def found(df):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in df.collect())


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_are_those_of_the_formula(spark, monkeypatch, order):
    monkeypatch.setattr(backoff_automaton, "SEGMENT", 7)  # most texts are read in several segments
    rng = random.Random(order)
    rows = [(i, prose(rng, rng.randrange(0, 40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted((str(i), *w) for (i, _), w in zip(rows, brute(rows, order, 7.0)))
    assert found(log_probabilities(docs, order, 7.0, block_tokens=100)) == want


def test_odd_rows(spark, odd_docs, odd_rows, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    want = sorted((str(i), *w) for (i, _), w in zip(odd_rows, brute(odd_rows, 2, 100.0)))
    assert found(log_probabilities(docs)) == want


def test_nothing_to_learn_from(spark, no_docs):
    assert log_probabilities(no_docs).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = log_probabilities(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_the_model_beats_its_root_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in log_probabilities(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_a_reader_follows_states_and_failure_arcs():
    """Order 3 by hand: after an unseen pair the reader fails to shorter contexts, and pays for each."""
    found = WordHasher()([b"a b c", b"a b d", b"x c"])
    lengths = np.array([3, 3, 2])
    block = Block([1, 2, 3], lengths, found.hashes, 3)
    model = Automaton(block, np.bincount(block.where.reshape(-1)), 8, 6, 1.0)
    word = {w: block.where[0][i] for i, w in enumerate("abcabdxc")}
    state = np.array([model.root - 1])  # a text's beginning
    state, paid = model.read(state, np.array([word["a"]]))
    assert 10 ** paid[0] > 0.5 and model.failure[state[0]] == block.where[0][0]
    state, _ = model.read(state, np.array([word["b"]]))
    assert state[0] == block.where[1][1]  # the pair a b
    after, paid = model.read(state, np.array([word["x"]]))
    fails = model.price[state[0]] + model.price[model.failure[state[0]]]  # a b, then b, then the root
    assert after[0] == word["x"] and paid[0] == pytest.approx(fails + model.at_root[word["x"]])
    after, paid = model.read(state, np.array([word["d"]]))
    assert after[0] == block.where[1][5] and paid[0] > fails
