"""Documents that hold benchmark items, also with other numbers, names or units in them.

Every word becomes a literal or a typed placeholder: numbers, units after a number, and capitalised words other than
function words. At the beginning of a sentence, a line or a list's entry, a capitalised word may be a name or not; windows that
hold one are taken in both readings, of which that as a name does not depend on the words before. Runs of eight such tokens, the template windows, are hashed and joined between documents and items. Windows
that meet on one diagonal (document position less item position) are aligned. There, each name of the item is bound to the
name that stands for it at most places, itself if there are as many; windows with another name for it are left out, the
others count. Numbers and units are parameters of their own, which may coincide or differ. An item is found in a document
when the windows that count cover at least half of the item's words.

Windows with fewer literals than half their length say too little as templates and are joined by the words themselves, so
copies of tables and lists of names are found, but no loose matches; an item of fewer than eight words has one window,
itself. Windows of documents go to the join only if the items have the same hash; for that
the items' hashes are sent to the tasks when there are at most ``SENT`` of them, and otherwise all windows are joined.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tables import cut, fresh, in_arrow, small, utf8
from graphloom.llm.words import U64, WordHasher, mix, slices, worker_state

WINDOW = 8
COVER_PERCENT = 50
SENT = 2_000_000  # hashes of the items' windows, 16 MB
BROADCAST_ROWS = 200_000
CACHED_WORDS = 150_000

LITERAL, NUMBER, NAME, UNIT = range(4)
#: fixed values: units as they follow a number
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr ms hz khz mhz ghz kb mb gb tb w kw v a c f k "
    "meter meters metre metres mile miles inch inches foot feet gram grams kilogram kilograms pound pounds liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years percent degrees dollars euros cents".split()
)
#: begin sentences more often than they are names
FUNCTION_WORDS = frozenset(
    "a an the this that these those what which who whom whose when where why how if in on at of for from to by with and or but as is are was "
    "were do does did can could should would has have had it its he she they we you i his her their our your there here not no".split()
)
_MARKS = "\"'`.,;:!?()[]{}<>«»“”‘’*_~|/\\-–—&%$#€£"
_NUMBER = re.compile(r"[+-]?[0-9]+(?:[.,:/][0-9]+)*([A-Za-z]*)")
_ENDS = re.compile(r"[.!?:][\"'”’»)\]!?.]*$|^\(?(?:[0-9]{1,3}|[A-Za-z])[)\]]$|^[^\w\s]+$")  # the last two: marks of lists


def canonical(word: str) -> tuple[str, int, bool, bool]:
    """(literal form, kind inside a sentence, a unit's name, ends a sentence or marks an entry) of a word."""
    core = word.strip(_MARKS) or word
    low = core.lower()
    ends = _ENDS.search(word) is not None
    number = _NUMBER.fullmatch(core)
    if number and (not number[1] or number[1].lower() in UNITS):
        return low, NUMBER, False, ends
    if core[0].isupper() and any(map(str.islower, core[1:])) and low not in FUNCTION_WORDS:
        return low, NAME, low in UNITS, ends
    return low, LITERAL, low in UNITS, ends


class Templates:
    """Canonical keys of the words of texts."""

    def __init__(self):
        self.hasher = WordHasher()
        self.known = worker_state("templates")

    def _canonical(self, raw: bytes) -> tuple[bytes, int]:
        low, kind, unit, ends = canonical(raw.decode())
        return b"".join(low.encode().split()) or raw, kind | unit << 2 | ends << 3

    def __call__(self, texts: list[bytes | None]):
        """(kinds, whether a sentence begins, literal keys, first, literal form of a word) of all words."""
        found = self.hasher(texts)
        _, index, inverse = np.unique(found.hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        forms = []
        for a, b in zip(found.starts[index].tolist(), found.ends[index].tolist()):
            raw = found.buf[a:b]
            form = self.known.get(raw)
            if form is None:
                form = self.known[raw] = self._canonical(raw)
            forms.append(form)
        low = [f[0] for f in forms]
        codes = np.fromiter((f[1] for f in forms), np.uint8, len(forms))[inverse]
        literal = self.hasher([b"\n".join(low)]).hashes[inverse]
        kinds = codes & 3
        begins = np.zeros(len(codes), bool)
        begins[1:] = codes[:-1] & 8 > 0
        text = np.frombuffer(found.buf, np.uint8)
        lines = np.cumsum((text >= 10) & (text <= 13))
        begins[1:] |= lines[found.starts[1:]] > lines[found.ends[:-1] - 1]
        begins[found.first[:-1][found.first[:-1] < len(codes)]] = True
        unit = np.zeros(len(codes), bool)
        unit[1:] = (codes[1:] & 4 > 0) & (kinds[:-1] == NUMBER)
        unit[found.first[:-1][found.first[:-1] < len(codes)]] = False
        kinds[unit] = UNIT
        return kinds, begins, literal, found.first, lambda i: low[inverse[i]].decode()


def _runs(kinds: np.ndarray, literal: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first word of the windows of ``k`` words inside a text, and whether they have enough literals. Other hashes are of the words."""
    n = len(kinds)
    if n < k:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, bool)
    keys = np.where(kinds == LITERAL, literal, mix(kinds.astype(U64)))
    out = np.full(n - k + 1, mix(np.array([k], U64))[0])
    literals = np.zeros(n - k + 1, np.int8)
    for step in range(k):
        out = out * U64(0x9E3779B97F4A7C15) + keys[step : n - k + 1 + step]
        literals += kinds[step : n - k + 1 + step] == LITERAL
    room = np.repeat(first[1:], np.diff(first))[: n - k + 1] - np.arange(n - k + 1)
    loose = literals * 2 >= k
    poor = np.flatnonzero(~loose)
    exact = np.full(len(poor), mix(np.array([k + 0x100], U64))[0])
    for step in range(k):
        exact = exact * U64(0x9E3779B97F4A7C15) + literal[poor + step]
    out[poor] = exact
    at = np.flatnonzero(room >= k)
    return mix(out[at]), at, loose[at]


SCHEMA = "id long, pos int, size int, words int, window long, slots array<string>"


def template_windows(rows: DataFrame, id_column: str, sizes: list[int] | None, wanted: np.ndarray | None = None) -> DataFrame:
    """The template windows of each text: its id, first word, size, the text's number of words, hash and slots.

    A slot is its place in the window, its kind and its value. Windows that are joined by their words have none.

    ``sizes`` are the window sizes, None for the one of an item: eight or its own length. ``wanted`` are sorted hashes
    to which the windows are confined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        if wanted is not None:
            table = np.zeros(1 << 20, bool)
            table[(wanted & U64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            ids = batch[0].to_pylist()
            for lo, hi, texts in slices(batch[1]):
                names, begins, literal, first, form = templates(texts)
                plain = np.where(begins & (names != NUMBER), LITERAL, names)
                differ = np.concatenate([[0], np.cumsum(plain != names)])
                counts = np.diff(first)
                text_of = np.repeat(np.arange(hi - lo), counts)
                present = sizes if sizes is not None else sorted({min(WINDOW, int(c)) for c in counts if c})
                for k, kinds in [(k, kinds) for k in present for kinds in (names, plain)]:
                    window, at, loose = _runs(kinds, literal, first, k)
                    if kinds is plain:
                        other = differ[at + k] > differ[at]
                        window, at, loose = window[other], at[other], loose[other]
                    if sizes is None and k < WINDOW:
                        window, at, loose = (x[counts[text_of[at]] == k] for x in (window, at, loose))
                    if wanted is not None:
                        maybe = table[(window & U64((1 << 20) - 1)).astype(np.int64)]
                        window, at, loose = window[maybe], at[maybe], loose[maybe]
                        there = np.isin(window, wanted)
                        window, at, loose = window[there], at[there], loose[there]
                    if not len(at):
                        continue
                    owner = text_of[at]
                    slots = [[f"{i - a}{kinds[i]}{form(i)}" for i in range(a, a + k) if kinds[i] != LITERAL] if t and kinds[a : a + k].any() else [] for a, t in zip(at.tolist(), loose.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[lo + i] for i in owner.tolist()], pa.int64()),
                            pa.array(at - first[owner], pa.int32()),
                            pa.array(np.full(len(at), k), pa.int32()),
                            pa.array(counts[owner], pa.int32()),
                            pa.array(window.view(np.int64)),
                            pa.array(slots, pa.list_(pa.string())),
                        ],
                        ["id", "pos", "size", "words", "window", "slots"],
                    )

    return in_arrow(rows.select(F.col(id_column).cast("long").alias("id"), utf8()), run, SCHEMA)


def bound(windows: list[dict]) -> tuple[list[int], int]:
    """Item places that the windows of a diagonal cover without conflicting names, and the number of their pairs of values."""
    pairs = [[(w["item_pos"] + int(a[0]), a[1:], b[1:]) for a, b in zip(w["item_slots"], w["slots"])] for w in windows]
    votes = Counter((a, b) for _, a, b in {p for ps in pairs for p in ps if p[1][0] == str(NAME)})
    name = {a: b for (a, b), _ in sorted(votes.items(), key=lambda v: (v[1], v[0][0] == v[0][1], v[0]))}
    places, values = set(), set()
    for w, ps in zip(windows, pairs):
        if all(name.get(a, b) == b for _, a, b in ps):
            places.update(range(w["item_pos"], w["item_pos"] + w["size"]))
            values.update((a, b) for _, a, b in ps)
    return sorted(places), len(values)


def _bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [bound(windows) for windows in batch["windows"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["item_id"], batch["item_words"], pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.int32())],
            ["doc_id", "item_id", "item_words", "places", "n_slots"],
        )


def contaminated(docs: DataFrame, benchmark: DataFrame, cover_percent: int = COVER_PERCENT, sent: int = SENT) -> DataFrame:
    """(doc_id, item_id, covered_words, item_words, n_slots) of each item of ``benchmark(item_id, text)`` that a document holds.

    Null texts count as empty, and an empty text has no windows. Rows of one doc_id (a null one included) count as one
    document, rows of one item_id with one text as one item. Other columns are not read.
    """
    items = cut(template_windows(benchmark, "item_id", None).distinct(), "items")
    hashes = items.select("window").distinct()
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most eight numbers
    wanted = None
    if hashes.limit(sent + 1).count() <= sent:
        wanted = np.sort(np.array([r[0] for r in hashes.toLocalIterator()], np.int64).view(U64))
    found = template_windows(docs, "doc_id", sizes, wanted)
    there = small(
        items.select("window", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("words").alias("item_words"), F.col("slots").alias("item_slots")),
        BROADCAST_ROWS,
    )
    met = found.join(there, "window").withColumn("diagonal", F.col("pos") - F.col("item_pos"))
    # a diagonal has few windows for each place of the item
    lines = met.groupBy("id", "item_id", "item_words", "diagonal").agg(F.collect_set(F.struct("item_pos", "size", "item_slots", "slots")).alias("windows"))
    lines = in_arrow(lines.drop("diagonal"), _bound, "doc_id long, item_id long, item_words int, places array<int>, n_slots int")
    out = lines.groupBy("doc_id", "item_id", "item_words").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("covered_words"), F.max("n_slots").alias("n_slots")
    )
    enough = F.col("covered_words") * 100 >= F.col("item_words") * cover_percent
    return out.where(enough).select("doc_id", "item_id", "covered_words", "item_words", "n_slots")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with the columns they came with."""
    name = fresh(docs)
    ids = cut(contaminated(docs, benchmark).select(F.col("doc_id").alias(name)).distinct(), "leaks")
    ids = small(ids, 1_000_000)
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids[name]), "left_anti")
