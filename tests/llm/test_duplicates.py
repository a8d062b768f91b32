import random

import numpy as np
import pytest

from graphloom.llm import superminhash
from graphloom.llm.components import components
from graphloom.llm.superminhash import FRACTION, near_duplicates, signatures, without_near_duplicates
from graphloom.llm.words import U64, mix
from tests.llm.conftest import prose


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, percent):
    """component_id by doc_id; rows without a doc_id left out."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    least = {i: i for i, _ in sets}
    links = [(i, j) for i, a in sets for j, b in sets if a and b and 100 * len(a & b) >= percent * len(a | b)]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if least[j] < least[i]:
                least[i], changed = least[j], True
    return least


def literal_signature(elements, places):
    out = [2**32 - 1] * places
    for e in elements:
        order = list(range(places))
        for level in range(places):
            draw = int(mix(np.array([e], U64) + U64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64))[0])
            k = level + (((draw & 0x7FFFFFFF) * (places - level)) >> 31)
            order[level], order[k] = order[k], order[level]
            out[order[level]] = min(out[order[level]], level << FRACTION | draw >> (64 - FRACTION))
    return out


def test_signatures_are_those_of_the_literal_method():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n).astype(U64) for n in (1, 2, 7, 60, 300, 0, 33)]
    first = np.cumsum([0, *map(len, sets)])
    whole = signatures(np.concatenate(sets), first)
    assert (signatures(np.concatenate(sets), first, block=50) == whole).all()
    assert whole.tolist() == [literal_signature(s.tolist(), 128) for s in sets]


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(2)
    found = []
    for _ in range(100):
        base = rng.integers(0, 2**63, 540).astype(U64)
        s = signatures(np.concatenate([base[:500], base[40:]]), np.array([0, 500, 1000]))
        found.append((s[0] == s[1]).mean())
    assert abs(np.mean(found) - 460 / 540) < 0.01


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"edit{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_are_those_of_brute_force(spark, percent, monkeypatch):
    rng = random.Random(percent)
    rows = [(i, prose(rng, rng.randrange(1, 80))) for i in range(100, 160)]
    base = prose(rng, 100).split()
    rows += [(i, edited(rng, base, rng.randrange(0, 9))) for i in range(200, 280)]  # a family, many just below the threshold
    rows += [(300 + k, " ".join(base[k * 3 : 60 + k * 3])) for k in range(12)]  # a chain
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, percent)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, percent).collect()} == want
    # the same in many small blocks
    monkeypatch.setattr(superminhash, "MEMBERS", 8)
    monkeypatch.setattr(superminhash, "SPOKES", 5)
    monkeypatch.setattr(superminhash, "SHINGLES", 500)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, percent).collect()} == want


@pytest.mark.parametrize("n", [500, 4000])
def test_links_grow_with_a_family_not_with_its_square(spark, monkeypatch, n):
    rng = random.Random(n)
    base = prose(rng, 200).split()
    docs = spark.createDataFrame([(i, edited(rng, base, 1)) for i in range(n)], "doc_id long, text string")
    counted = []

    def counting(links):
        counted.append(links.count())
        return components(links)

    monkeypatch.setattr(superminhash, "components", counting)
    assert {r.component_id for r in near_duplicates(docs, 85).collect()} == {0}
    assert sum(counted) <= 12 * n


def test_the_longest_row_of_a_doc_id_stays(spark):
    rng = random.Random(1)
    text = prose(rng, 50)
    rows = [(4, None, "a"), (4, text, "b"), (4, text[:100], "c"), (4, "", "d"), (5, text, "e"), (None, text, "f"), (6, "other", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tmp_0 string")
    assert sorted(r.tmp_0 for r in without_near_duplicates(docs, 85).collect()) == ["b", "f", "g"]


def test_odd_rows(odd_docs, odd_rows):
    got = near_duplicates(odd_docs, 85).collect()
    assert len(got) == len(odd_rows)
    want = brute(odd_rows, 85)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id} == {i: len(shingles(t)) for i, t in odd_rows if i}


@pytest.mark.parametrize("empty", [None, "", " \n"])
def test_one_doc_id_with_a_text_and_without(spark, empty):
    rng = random.Random(8)
    words = prose(rng, 100).split()
    other = " ".join(words[:-1])
    # the rows without words are the last of their block, the only ones of a document, and of both documents
    rows = [(3, other), (9, " ".join(words)), (9, empty), (3, empty), (9, empty), (5, empty), (7, prose(rng, 90)), (7, empty)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles > 0, r.component_id) for r in near_duplicates(docs, 85).collect()}
    assert {(9, True, 3), (3, True, 3), (5, False, 5), (7, True, 7)} <= got and len(got) == 7
    assert sorted({r.doc_id for r in without_near_duplicates(docs, 85).collect()}) == [3, 5, 7]


def test_one_row_of_each_group_stays(odd_docs, no_docs):
    left = without_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in left.collect()), key=lambda i: (i is None, i))
    assert ids == [-4, 1, 2, 3, 4, 6, 7, 9, 11, 12, 13, None, None]
    assert without_near_duplicates(no_docs).count() == 0


def test_empty_table(no_docs):
    assert near_duplicates(no_docs).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert near_duplicates(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(4)
    chain = list(range(50))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(100, k) for k in range(101, 140)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(chain, 0), **dict.fromkeys(range(100, 140), 100), 300: 300, 301: 300}
