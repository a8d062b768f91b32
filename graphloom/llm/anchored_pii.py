"""Personal data found from anchors.

An Aho-Corasick automaton runs once over a text and reports at-signs, plus signs, digits, schemes of web addresses and the
cue words before accounts and secrets. At each anchor a small parser reads the characters around it, sets the span's
ends and checks it. A parser does not look at characters that an earlier span of its kind has taken, so spans of a kind
never overlap and are the leftmost ones.

Kinds, in the order in which spans are listed:

email    local part, at-sign and a domain of two labels or more
ip       four numbers of at most 255 between dots
card     13 to 19 digits with single blanks or hyphens, right by the Luhn sum
phone    plus sign and 9 to 15 digits
address  http, https or ftp address with a host that has a dot
account  IBAN that is right modulo 97, or 6 to 17 digits, after its cue word
secret   16 or more key characters after a cue such as ``token =``

Offsets count code points; ends are exclusive. Null texts count as empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.llm.tables import fresh, in_arrow, small_batches
from graphloom.llm.words import worker_state

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account", "secret")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PARTS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile(r"[0-9]+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WEB = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?(?:[/?#][^\s<>\"'`]*)?")
_IBAN = re.compile(r"[\s:#=]{0,4}([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?)(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\s{0,2}(?:number|no\.?|nr\.?|id))?[\s:#=]{1,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")
_SECRET = re.compile(r"[\"']?\s{0,2}[:=]\s{0,2}[\"']?([A-Za-z0-9_+/.=-]{16,})")
#: fixed values: what the automaton looks for, in lower case
ANCHORS = {"@": "email", "+": "phone", **dict.fromkeys("0123456789", "digit")}
SCHEMES = ("http://", "https://", "ftp://")
CUES = {"iban": "iban", "account": "account", "acct": "account", **dict.fromkeys(("token", "api_key", "apikey", "api key", "secret", "password", "passwd"), "secret")}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2])) + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def _iban(text: str) -> bool:
    code = text.replace(" ", "").upper()
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    state = worker_state("pii")
    if "automaton" not in state:
        found = ahocorasick.Automaton()
        for word, kind in {**ANCHORS, **dict.fromkeys(SCHEMES, "address"), **CUES}.items():
            found.add_word(word, (kind, len(word)))
        found.make_automaton()
        state["automaton"] = found
    return state["automaton"]


def find(text: str | None) -> dict[str, list[Span]]:
    """The spans of each kind, in order."""
    spans: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    text = text or ""
    lower = text.encode().lower().decode()  # A-Z only, so that offsets stay
    taken = dict.fromkeys(KINDS, 0)

    def take(kind: str, start: int, end: int, good: bool) -> None:
        if good:
            spans[kind].append((start, end))
        taken[kind] = max(taken[kind], end)

    for last, (anchor, size) in automaton().iter(lower):
        at, after = last + 1 - size, last + 1
        if anchor == "digit":
            if at >= taken["card"]:
                run = _DIGITS.match(text, at)
                digits = _NOT_DIGIT.sub("", run[0])
                take("card", at, run.end(), 13 <= len(digits) <= 19 and luhn(digits))
            if at >= taken["ip"]:
                chain = _PARTS.match(text, at)
                parts = list(_PART.finditer(text, at, chain.end()))
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    take("ip", four[0].start(), four[3].end(), all(int(p[0].lstrip("0")[:4] or 0) <= 255 for p in four))
                taken["ip"] = chain.end()
        elif anchor == "email":
            start = at
            while start > taken["email"] and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, after)
            if start < at and domain:
                take("email", start, domain.end(), True)
        elif anchor == "phone":
            number = _PHONE.match(text, at) if at >= taken["phone"] else None
            if number:
                take("phone", at, number.end(), 9 <= len(_NOT_DIGIT.sub("", number[0])) <= 15)
        elif anchor == "address":
            web = _WEB.match(text, after) if at >= taken["address"] else None
            if web:
                take("address", at, after + len(web[0].rstrip(".,;:!?)]}")), True)
        elif not (at and lower[at - 1].isalnum()):
            pattern, kind = {"iban": (_IBAN, "account"), "account": (_ACCOUNT, "account"), "secret": (_SECRET, "secret")}[anchor]
            value = pattern.match(text, after)
            if value and value.start(1) >= taken[kind]:
                good = anchor != "iban" or _iban(value[1])
                take(kind, *value.span(1), good)
    return spans


def listed(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in spans[kind])


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, a count for each kind, base_sha256, spans) of each row of ``docs(doc_id, text)``; other columns are not read.

    ``spans`` lists ``kind:start:end`` by kind, then start; ``base_sha256`` is the digest of that list for the first four kinds.
    """
    counts = [f"n_{kind}" for kind in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
            found = [find(t) for t in batch["text"].to_pylist()]
            base = [hashlib.sha256(listed(f, BASE_KINDS).encode()).hexdigest() for f in found]
            columns = [pa.array([len(f[kind]) for f in found], pa.int64()) for kind in KINDS]
            texts = [pa.array(base, pa.string()), pa.array([listed(f, KINDS) for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns, *texts], ["doc_id", *counts, "base_sha256", "spans"])

    kind_of_id = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind_of_id}," + ",".join(f"{c} long" for c in counts) + ",base_sha256 string,spans string"
    return in_arrow(docs.select("doc_id", "text"), run, schema)


def redact(text: str) -> str:
    """``text`` with ``[KIND]`` in place of each span; of overlapping spans the one that starts first, then the longer, names the place."""
    spans = sorted((a, -b, kind) for kind, found in find(text).items() for a, b in found)
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


@F.arrow_udf(StringType())
def _redacted(texts: pa.Array) -> pa.Array:
    return pa.array([t and redact(t) for t in texts.to_pylist()], pa.string())


def without_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with redacted texts; n_chars, where there is one, is counted anew. Null texts stay null."""
    name = fresh(docs)
    small_batches(docs.sparkSession)
    done = docs.withColumn(name, _redacted.asNondeterministic()("text"))
    length = F.length(name).cast(dict(docs.dtypes).get("n_chars", "long"))
    return done.select(*[F.col(name).alias(c) if c == "text" else length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
