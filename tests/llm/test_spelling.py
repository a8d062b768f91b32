import random
import zlib
from collections import Counter

import pytest

from graphloom.llm.spelling_variants import spelling_variants, word_counts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def letter(c):
    return c.isascii() and c.isalpha() or "À" <= c <= "ÿ"


def brute_words(rows, length=5, occurrences=3):
    counts = Counter()
    for doc_id, text in rows:
        runs = "".join(c if letter(c) else " " for c in text or "").split(" ")
        for run in runs:
            run = run.translate(LOW)
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= length and n >= occurrences}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows, **sizes):
    words = brute_words(rows, **sizes)
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def found(docs, **sizes):
    return {tuple(r) for r in spelling_variants(docs, **sizes).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def corpus(seed):
    """Few letters, so that words are dense in neighbours; runs of equal letters, deep shared beginnings and endings."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    stems += ["prefixedly" + "".join(rng.choice("ab") for _ in range(4)) for _ in range(40)]
    stems += ["".join(rng.choice("ab") for _ in range(4)) + "endingsame" for _ in range(40)]
    stems += ["aaaaa", "aaaaaa", "aaaaaaa", "baaaaa", "aaaaab", "ÀÀÀÀÀ", "ààààà", "A×BCDE÷", "UPPERs"]
    return [(i if i % 7 else None, " ".join(rng.choice(stems) for _ in range(120)) + ". 12" + rng.choice(stems)) for i in range(60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_are_those_of_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert found(docs) == want
    assert max(r[4] for r in want) > 3 and any(r[1] for r in want)


def test_roots_follow_long_chains(spark):
    # every word is one letter from the next, and the next is three times as frequent
    chain = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg", "akjihg", "lkjihg"]
    rows = [(5, " ".join(w for k, w in enumerate(chain) for _ in range(3 ** (k + 1))))]
    rows = [(i, t) for i, t in rows if brute_words([(i, t)]).keys() == set(chain)] or [(6, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(docs)
    assert got == brute(rows)
    assert len({r[2] for r in got if r[1]}) == 1


def test_letters_are_lost_by_the_key(spark):
    rows = [(i, "Straße Ångström words") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r.n for r in word_counts(docs, 1, 1).collect()}
    assert got == brute_words(rows, 1, 1) and len(got) > 10


def test_odd_rows(odd_docs, odd_rows, no_docs):
    assert found(odd_docs) == brute(odd_rows)
    assert found(odd_docs, length=1, occurrences=1) == brute(odd_rows, length=1, occurrences=1)
    out = spelling_variants(no_docs)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0
