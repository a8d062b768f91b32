import hashlib
import random
import re

from graphloom.llm.anchored_pii import BASE_KINDS, KINDS, find, listed, luhn, personal_data, redact, without_personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def right(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if right(k, m[0])] for k, p in PATTERNS.items()}


def same(text):
    spans = find(text)
    assert {k: spans[k] for k in BASE_KINDS} == brute(text), text


def test_base_spans_on_given_documents(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        same(r.text)


def test_base_spans_on_random_texts():
    rng = random.Random(1)
    for letters in ("0123456789. -", "a@.b+1 ", "+1234567890 ().-", "@é1.-+ aZ%_", "0.9"):
        for _ in range(4000):
            same("".join(rng.choice(letters) for _ in range(rng.randrange(50))))
    same("1." * 5000 + "9" * 6000 + " a@" * 3000)


def test_added_kinds():
    text = 'é IBAN: DE89 3704 0044 0532 0130 00, see http://x.example.com/a?b. Account number: 123456789; token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    spans = find(text)
    assert [text[a:b] for kind in KINDS[4:] for a, b in spans[kind]] == [
        "x.example.com/a?b".join(["http://", ""]),
        "DE89 3704 0044 0532 0130 00",
        "123456789",
        "04dbebab91ab85687d33eeaaf9ac699e1188f962",
    ]
    assert not find("IBAN DE88 3704 0044 0532 0130 00 accounting for tokens of broken secrets http://localhost")["account"]


def test_redacted_texts_hold_nothing():
    text = "Mail a.b@c.de, +1 (017) 555-7713, 97.51.17.173 and 4111 1111 1111 1111."
    assert redact(text) == "Mail [EMAIL], [PHONE], [IP] and [CARD]."
    assert redact("") == "" and redact("nothing here, 12 of 3") == "nothing here, 12 of 3"
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = personal_data(odd_docs).collect()
    want = sorted((str(i), listed(find(t), KINDS), hashlib.sha256(listed(brute(t), BASE_KINDS).encode()).hexdigest()) for i, t in odd_rows)
    assert sorted((str(r.doc_id), r.spans, r.base_sha256) for r in got) == want
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got if r.doc_id == -4] == [(1, 1, 1, 1)]
    assert personal_data(no_docs).count() == 0


def test_redaction_keeps_rows_and_columns(odd_docs, odd_rows, no_docs):
    done = without_personal_data(odd_docs)
    assert [(f.name, f.dataType) for f in done.schema] == [(f.name, f.dataType) for f in odd_docs.schema]
    got = sorted((str(r.doc_id), str(r.text), str(r.n_chars)) for r in done.collect())
    assert got == sorted((str(i), str(t and redact(t)), str(t if t is None else len(redact(t)))) for i, t in odd_rows)
    assert without_personal_data(no_docs).count() == 0
