import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from graphloom.llm.template_decontamination import LITERAL, NAME, NUMBER, UNIT, WINDOW, canonical, contaminated, without_contaminated
from tests.llm.conftest import prose

ITEM = "A train leaves Boston at 9:30 and travels 120 miles at a steady speed of 40 mph while Alice waits 3 hours for it near the station in Boston."


def readings(text):
    """The two readings of a text, each a list of (kind, form): as names, and as literals where a word begins a sentence or line."""
    words = [(w, at) for at, line in enumerate(re.split(r"[\n\v\f\r]", text or "")) for w in line.encode().split() if w]
    names, plain = [], []
    begins, number, line = True, False, 0
    for word, at in words:
        low, kind, unit, ends = canonical(word.decode())
        if unit and number:
            kind = UNIT
        begins = begins or at > line
        names.append((kind, low))
        plain.append((LITERAL if begins and kind != NUMBER else kind, low))
        begins, number, line = ends, kind == NUMBER, at
    return names, plain


def windows(text, k):
    """What a window says, for each place: its kinds and literal words, or its words where it has too few literals."""
    out = defaultdict(set)
    for reading in readings(text):
        for at in range(len(reading) - k + 1):
            window = reading[at : at + k]
            if 2 * sum(kind == LITERAL for kind, _ in window) >= k:
                said = tuple((kind, form if kind == LITERAL else "") for kind, form in window)
                out[said].add((at, tuple((at + j, form) for j, (kind, form) in enumerate(window) if kind == NAME)))
            else:
                out[tuple(form for _, form in window)].add((at, ()))
    return out


def covered(met):
    """Places of the item on a diagonal, after every name is bound to the one that stands for it most often."""
    votes = Counter((x, y) for _, x, y in {p for _, pairs in met for p in pairs})
    name = {x: max((n, y == x, y) for (z, y), n in votes.items() if z == x)[2] for x, _ in votes}
    return {at for at, pairs in met if all(name[x] == y for _, x, y in pairs)}


def brute(docs, items):
    out = set()
    for item_id, item in items:
        n = len(readings(item)[0])
        k = min(WINDOW, n)
        if not k:
            continue
        of_item = windows(item, k)
        for doc_id, text in docs:
            diagonals = defaultdict(list)
            for said, places in windows(text, k).items():
                for (at, names), (there, others) in itertools.product(of_item.get(said, ()), places):
                    diagonals[there - at].append((at, [(place, x, y) for (place, x), (_, y) in zip(names, others)]))
            places = {at + j for met in diagonals.values() for at in covered(met) for j in range(k)}
            if places and 100 * len(places) >= 50 * n:
                out.add((doc_id, item_id, len(places)))
    return out


def test_kinds_of_words():
    kinds = {w: canonical(w)[1] for w in ("12", "$1,200.50", "9:30", "40%", "5kg", "5xyz", "Boston", "BOSTON", "I", "house", "(Alice,", "--")}
    assert kinds == {
        "12": NUMBER, "$1,200.50": NUMBER, "9:30": NUMBER, "40%": NUMBER, "5kg": NUMBER, "5xyz": LITERAL, "Boston": NAME, "BOSTON": LITERAL,
        "I": LITERAL, "house": LITERAL, "(Alice,": NAME, "--": LITERAL,
    }
    assert canonical("end.”")[3] and not canonical("mid,")[3] and canonical("miles")[2]


def changed(**values):
    text = ITEM
    for old, new in values.items():
        text = text.replace({"town": "Boston", "far": "120", "fast": "40", "who": "Alice"}[old], new)
    return text


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_reparameterised_items_are_found(spark, sent):
    rng = random.Random(5)
    pad = prose(rng, 30)
    docs = [
        (1, f"{pad} {ITEM} {pad}"),
        (2, f"{pad} {changed(town='Chicago', far='250', fast='55', who='Robert')} {pad}"),
        (3, ITEM.replace("Boston", "Chicago", 1) + " " + pad),  # one town in two slots
        (4, pad),
        (5, " ".join(ITEM.split()[:9])),
        (6, " ".join(ITEM.split()[:16]).upper()),
        (7, "very short item"),
    ]
    items = [(10, ITEM), (11, prose(rng, 40)), (12, "Very short item"), (13, ""), (14, None), (15, "1 2 3 4 5 6 7 8 9"), (10, ITEM)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.covered_words) for r in contaminated(d, i, sent=sent).collect()}
    assert got == brute(docs, items)
    found = {(a, b) for a, b, _ in got}
    assert {(1, 10), (2, 10), (3, 10), (7, 12)} <= found and not {a for a, _ in found} & {4, 5}


def found_in(spark, items, docs):
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return {(r.doc_id, r.item_id) for r in contaminated(d, i).collect()}


def test_values_that_coincide_or_part_ways(spark):
    pears = "Someone buys 2 apples and 2 pears at the market and then eats one of them on the way home."
    other = "The clerk of the town met Alice and then gave Alice the keys of a house near the old river."
    docs = [
        ITEM.replace("Boston", "Chicago", 1),  # one town in two slots
        ITEM.replace("40 mph", "3 mph"),
        pears.replace("2 apples and 2", "3 apples and 4"),
        other.replace("Alice", "Robert", 1).replace("Alice", "Mary"),  # the windows that hold both conflict
    ]
    assert found_in(spark, [ITEM, pears, other], docs) == {(0, 0), (1, 0), (2, 1), (3, 2)}


def test_copies_of_numbers_and_names_are_found(spark):
    items = ["1 2 3 4 5 6 7 8 9", "12 + 30 = 42", "the guests were Alice Robert Mary Peter Susan Laura Henry Walter Emma Oscar Paul Ruth"]
    docs = [f"{x} in the text, {item} and some more of it." for item in items for x in ("somewhere",)]
    docs += ["1 2 3 4 6 5 7 8 9 5", "12 + 31 = 43", items[2].replace("Mary", "Jane").replace("Laura", "Jane").replace("Oscar", "Jane")]
    assert found_in(spark, items, docs) == {(0, 0), (1, 1), (2, 2)}


def test_beginnings_of_sentences(spark):
    items = ["What is the capital of France?", "Calculate the sum of both numbers", "A train is late by how much"]
    docs = [
        "Sample questions\nWhat is the capital of France?",
        "- What is the capital of France?",
        "Sample What is the capital of France?",
        "Sample questions\nCalculate the sum of both numbers",
        "Task Calculate the sum of both numbers",
        "then calculate the sum of both numbers",
        "Questions: 1. A train is late by how much",
        "Rome is the capital of Italy, as they say",
    ]
    assert found_in(spark, items, docs) == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 2)}


def test_given_documents_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect() if len(r.text) < 3000]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()][:12]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.covered_words) for r in contaminated(d, i).collect()} == brute(docs, items)


def test_whole_passages_are_found(spark):
    path = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    held = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if i.text in d.text}
    assert held and held <= got
    assert without_contaminated(docs, items).count() == docs.count() - len({d for d, _ in got})


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    items = spark.createDataFrame([(1, odd_rows[6][1][:400], None), (None, None, None), (3, None, 2)], "item_id long, text string, window int")
    got = {(r.doc_id, r.item_id) for r in contaminated(odd_docs, items).collect()}
    assert got == {(7, 1), (8, 1)}
    left = without_contaminated(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == len(odd_rows) - 2
    assert contaminated(no_docs, items).count() == 0 and contaminated(odd_docs, items.where("false")).count() == 0
    assert without_contaminated(odd_docs, items.where("false")).count() == len(odd_rows)
