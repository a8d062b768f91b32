"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary and scores are those of a SentencePiece BPE model with byte pieces. A text is cut into units, a run of
blanks with what follows it or a line feed, across which no piece of such a model reaches. In a unit, the candidate merges
of neighbours wait in an agenda, best score first, then leftmost. Each candidate that comes up is skipped for good
if a hash keyed with seed, document, the unit's place in the text, unit, place and piece falls below the dropout rate. So one
seed gives one result, another seed, document or occurrence another segmentation, rate 0 that of the library; all of them
decode to the same text.

Equal units are merged without dropout once in a slice of the input. An occurrence whose draws skip none of those merges
has their result; only the others are segmented each by itself. A character without a piece, and the character that stands for a blank inside pieces, become byte pieces, which
keeps decoding lossless. An empty or null text has no ids; ids of a null text decode to the empty text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.llm.tables import fresh, in_arrow, utf8
from graphloom.llm.words import U64, WordHasher, mix, slices, worker_state

RATE, SEED = 0.1, 20
BLANK = "▁"
NONE = np.iinfo(np.int32).max  # rank of a pair that is no candidate
UNIT_CHARS = 64  # longer units are segmented one by one


def default_model() -> str:
    from public_tokenizers import path

    return path("piece_bpe_32k.model")


class Model:
    """Pieces, byte pieces and the pairs of symbols that make a piece. A symbol is a piece's id, or -1 less a character without one."""

    def __init__(self, file: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=file)
        n = library.get_piece_size()
        byte_id = [-1] * 256
        self.output: list[bytes] = [b""] * n
        ids: dict[str, int] = {}
        for i in range(n):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                byte_id[int(piece[3:5], 16)] = i
                self.output[i] = bytes([int(piece[3:5], 16)])
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                ids[piece] = i
                self.output[i] = piece.replace(BLANK, " ").encode()
        if min(byte_id) < 0 or any("\n" in p or BLANK in p.lstrip(BLANK) for p in ids):
            raise ValueError("the model needs byte pieces, and blanks only at the beginning of pieces")
        self.byte_id = np.array(byte_id, np.int32)
        self.symbol = -1 - np.arange(0x110000, dtype=np.int32)  # of a character
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.symbol[0x20] = self.symbol[ord(BLANK)]
        self.symbol[ord(BLANK)] = -1 - ord(BLANK)
        own = {c: int(self.symbol[0x20 if c == BLANK else ord(c)]) for p in ids for c in p}
        scores = sorted({-library.get_score(i) for i in ids.values()})
        place = {score: r for r, score in enumerate(scores)}
        pairs = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                a = ids.get(left, own[left] if cut == 1 else None)
                b = ids.get(right, own[right] if len(right) == 1 else None)
                if a is not None and b is not None:
                    pairs[(a + 0x200000) << 32 | (b + 0x200000)] = (place[-library.get_score(i)], i)
        self.pair = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in self.pair.tolist()], np.int32)
        self.pair_piece = np.array([pairs[k][1] for k in self.pair.tolist()], np.int32)

    def candidates(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the merge of each left symbol with the right one."""
        key = (left.astype(np.int64) + 0x200000) << 32 | (right.astype(np.int64) + 0x200000)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        there = self.pair[at] == key
        return np.where(there, self.pair_rank[at], NONE), np.where(there, self.pair_piece[at], 0)

    def merge(self, symbols: np.ndarray, keys: np.ndarray, rate: float, path: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of units of one length after all merges, unit by unit, and how many each unit has.

        ``symbols`` has a row for each unit, ``keys`` the units' 64-bit numbers. All units take the first of their agendas at once.
        Rows, places and pieces of the merges are added to ``path``.
        """
        n, length = symbols.shape
        below = U64(int(rate * (1 << 24)))
        final = symbols.copy()
        starts = np.ones((n, length), bool)
        unit = np.arange(n)
        symbols, following = symbols.copy(), np.tile(np.arange(1, length + 1), (n, 1))
        before = following - 2
        rank, piece = self.candidates(symbols[:, :-1], symbols[:, 1:])
        rank = np.concatenate([rank, np.full((n, 1), NONE, np.int32)], 1)
        piece = np.concatenate([piece, np.zeros((n, 1), np.int32)], 1)
        while len(unit):
            rows = np.arange(len(unit))
            at = rank.argmin(1)
            going = rank[rows, at] < NONE
            if 2 * going.sum() < len(unit):  # the others are done
                symbols, following, before, rank, piece, unit = (x[going] for x in (symbols, following, before, rank, piece, unit))
                continue
            rows, at = rows[going], at[going]
            into = piece[rows, at]
            rank[rows, at] = NONE
            if below:
                merged = ~skipped(keys[unit[rows]], at, into, rate)
                rows, at, into = rows[merged], at[merged], into[merged]
            if path is not None:
                path.append((unit[rows], at, into))
            right = following[rows, at]
            symbols[rows, at] = into
            final[unit[rows], at] = into
            starts[unit[rows], right] = False
            rank[rows, right] = NONE
            after = following[rows, right]
            following[rows, at] = after
            some = after < length
            r, a, b = rows[some], at[some], after[some]
            before[r, b] = a
            rank[r, a], piece[r, a] = self.candidates(symbols[r, a], symbols[r, b])
            left = before[rows, at]
            some = left >= 0
            r, a, b = rows[some], left[some], at[some]
            rank[r, a], piece[r, a] = self.candidates(symbols[r, a], symbols[r, b])
        return final[starts], starts.sum(1)

    def segment(self, symbols: list[int], key: int, rate: float) -> list[int]:
        """The same for one unit of any length, by a heap."""
        below = int(rate * (1 << 24))
        n = len(symbols)
        size = [1] * n  # characters of the part that begins here, 0 inside a part
        before = list(range(-1, n - 1))  # where the part to the left begins
        rank, piece = (x.tolist() for x in self.candidates(np.array(symbols[:-1], np.int32), np.array(symbols[1:], np.int32)))
        agenda = [(r, i, 2, p) for i, (r, p) in enumerate(zip(rank, piece)) if r < NONE]
        heapq.heapify(agenda)

        def offer(a: int, b: int) -> None:
            r, p = self.candidates(np.array([symbols[a]], np.int32), np.array([symbols[b]], np.int32))
            if r[0] < NONE:
                heapq.heappush(agenda, (int(r[0]), a, size[a] + size[b], int(p[0])))

        while agenda:
            _, at, both, into = heapq.heappop(agenda)
            own = size[at]
            right = at + own
            if not own or right >= n or own + size[right] != both:
                continue  # one of the two has been merged since
            if below:
                draw = mix(np.array([(key + at * 0x9E3779B97F4A7C15 + into * 0xD6E8FEB86659FD93) % (1 << 64)], U64))
                if draw[0] >> U64(40) < U64(below):
                    continue
            symbols[at], size[at], size[right] = into, both, 0
            after = at + both
            if after < n:
                before[after] = at
                offer(at, after)
            if before[at] >= 0:
                offer(before[at], at)
        return [p for p, s in zip(symbols, size) if s]

    def ids(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the symbols of units of ``counts`` symbols, with byte pieces for characters without a piece, and the units' sizes."""
        if not len(symbols) or symbols.min() >= 0:
            return symbols, counts
        odd, inverse = np.unique(np.minimum(symbols, 0), return_inverse=True)
        codes = [chr(-1 - s).encode() if s < 0 else b"" for s in odd.tolist()]
        size = np.fromiter((len(c) or 1 for c in codes), np.int64, len(odd))
        out, begin = spread(np.frombuffer(b"".join(c or b"\0" for c in codes), np.uint8), size, inverse)
        out = self.byte_id[out]
        out[begin[:-1][symbols >= 0]] = symbols[symbols >= 0]
        edges = np.concatenate([[0], np.cumsum(counts)])
        return out, np.diff(begin[edges])


def skipped(keys: np.ndarray, at: np.ndarray, into: np.ndarray, rate: float) -> np.ndarray:
    """Whether the merges at the given places into the given pieces are left out in the units of these keys."""
    draw = mix(keys + at.astype(U64) * U64(0x9E3779B97F4A7C15) + into.astype(U64) * U64(0xD6E8FEB86659FD93))
    return draw >> U64(40) < U64(int(rate * (1 << 24)))


def model(file: str) -> Model:
    """The model, read once by a worker."""
    state = worker_state("sentencepiece models")
    if file not in state:
        state[file] = Model(file)
    return state[file]


class Encoder:
    """``variants`` confines the documents to so many keys; None: each document has its own."""

    def __init__(self, file: str, rate: float, seed: int, variants: int | None = None):
        self.model, self.rate, self.variants = model(file), rate, variants
        self.seed = mix(np.array([seed], U64))[0]
        self.hasher = WordHasher()

    def variant_of(self, ids: np.ndarray) -> np.ndarray:
        own = mix(mix(ids.astype(np.int64).view(U64)) + self.seed)
        return own % U64(self.variants) if self.variants else own

    def __call__(self, texts: list[bytes | None], variant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        buf = b"".join(b" " + t if t else b"" for t in texts)
        codes = np.frombuffer(buf, np.uint8)
        length = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        text_first = np.concatenate([[0], np.cumsum(length)])
        begins = np.zeros(len(codes) + 1, bool)
        blank, line = codes == 32, codes == 10
        begins[:-1] = line
        begins[1:] |= line
        begins[1:-1] |= blank[1:] & ~blank[:-1]
        begins[text_first] = True
        edges = np.flatnonzero(begins)
        starts, ends = edges[:-1], edges[1:]
        first = np.searchsorted(starts, text_first)
        numbers = self.hasher.numbers(codes, starts, ends)
        units = np.diff(first)
        place = (np.arange(len(starts)) - np.repeat(first[:-1], units)).astype(U64)
        own = np.repeat(mix(variant + U64(1)), units)
        keys = mix(numbers + mix(own + place * U64(0x9E3779B97F4A7C15))) + self.seed

        symbols = self.model.symbol[np.frombuffer(buf.decode().encode("utf-32-le"), np.uint32)]
        character = np.concatenate([[0], np.cumsum((codes & 0xC0) != 0x80)])
        starts, length = character[starts], character[ends] - character[starts]
        _, index, inverse = np.unique(numbers, return_index=True, return_inverse=True)
        path = []
        pool, size = self._units(symbols, starts[index], length[index], keys[index], 0.0, path)
        if self.rate:
            own = np.flatnonzero(self._differ(path, len(index), inverse, keys) | (length > UNIT_CHARS))
            more, more_size = self._units(symbols, starts[own], length[own], keys[own], self.rate)
            inverse[own] = len(size) + np.arange(len(own))
            pool, size = np.concatenate([pool, more]), np.concatenate([size, more_size])
        ids, begin = spread(pool, size, inverse)
        return ids, begin[first]

    def _differ(self, path: list, n: int, inverse: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Whether the draws of an occurrence skip one of the merges of its unit, of which there are ``n``."""
        unit, at, into = (np.concatenate(x) for x in zip(*path)) if path else np.zeros((3, 0), np.int64)
        order = np.argsort(unit, kind="stable")
        steps = np.bincount(unit, minlength=n)
        step, _ = spread(order, steps, inverse)
        owner = np.repeat(np.arange(len(inverse)), steps[inverse])
        out = np.zeros(len(inverse), bool)
        out[owner[skipped(keys[owner], at[step], into[step], self.rate)]] = True
        return out

    def _units(
        self, symbols: np.ndarray, starts: np.ndarray, length: np.ndarray, keys: np.ndarray, rate: float, path: list | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given units, one after another, and how many each has. Merges of units of up to 64 symbols are added to ``path``."""
        order = np.argsort(length, kind="stable")
        ordered = length[order]
        parts, counts, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while at < len(order):
            n = int(ordered[at])
            to = int(np.searchsorted(ordered, n, "right")) if n <= UNIT_CHARS else at + 1
            rows = order[at:to]
            if n <= UNIT_CHARS:
                steps = [] if path is not None else None
                part, count = self.model.merge(symbols[starts[rows][:, None] + np.arange(n)], keys[rows], rate, steps)
                if path is not None:
                    path += [(rows[unit], place, into) for unit, place, into in steps]
            else:
                begin = int(starts[rows[0]])
                one = self.model.segment(symbols[begin : begin + n].tolist(), int(keys[rows[0]]), rate)
                part, count = np.array(one, np.int32), np.array([len(one)])
            parts.append(part)
            counts.append(count)
            at = to
        by_length, size = self.model.ids(np.concatenate(parts), np.concatenate(counts))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return spread(by_length, size, back)[0], size[back]


def spread(pool: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen entries of a pool of entries of the given sizes, one after another, and where each begins."""
    offset = np.concatenate([[0], np.cumsum(size)])[:-1]
    each = size[chosen]
    begin = np.concatenate([[0], np.cumsum(each)])
    return pool[np.repeat(offset[chosen] - begin[:-1], each) + np.arange(begin[-1])], begin


class Decoder:
    def __init__(self, file: str):
        output = model(file).output
        self.size = np.fromiter(map(len, output), np.int64, len(output))
        self.pool = np.frombuffer(b"".join(output), np.uint8)

    def __call__(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """Texts of the ids that begin at ``first``."""
        out, begin = spread(self.pool, self.size, ids)
        data = out.tobytes()
        edges = begin[first].tolist()
        return [data[a + 1 : b] for a, b in zip(edges[:-1], edges[1:])]


def encode(docs: DataFrame, file: str | None = None, rate: float = RATE, seed: int = SEED, variants: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, lossless) of each row of ``docs(doc_id, text)``; other columns are not read.

    ``lossless`` tells whether the ids decode to the text. A row without a doc_id has the draws of doc_id 0.
    """
    file = file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(file, rate, seed, variants), Decoder(file)
        for batch in batches:
            doc_ids = batch["doc_id"]
            variant = encoder.variant_of(doc_ids.fill_null(0).to_numpy(zero_copy_only=False))
            for lo, hi, texts in slices(batch["text"]):
                ids, first = encoder(texts, variant[lo:hi])
                same = [a == (b or b"") for a, b in zip(decoder(ids, first), texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(lo, hi - lo),
                        pa.array(np.diff(first)),
                        pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)),
                        pa.array(same, pa.bool_()),
                    ],
                    ["doc_id", "n_tokens", "ids", "lossless"],
                )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8())
    return in_arrow(picked, run, "doc_id long, n_tokens long, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, file: str | None = None, column: str = "ids") -> DataFrame:
    """``encoded`` with a column ``text`` in place of the ids."""
    file = file or default_model()

    @F.arrow_udf(StringType())
    def texts(lists: pa.Array) -> pa.Array:
        lists = lists.fill_null([]) if lists.null_count else lists
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        return pa.array([t.decode() for t in Decoder(file)(ids, first)], pa.string())

    name = fresh(encoded)
    done = encoded.withColumn(name, texts(column)).drop(column)
    return done.drop("text").withColumnRenamed(name, "text")
