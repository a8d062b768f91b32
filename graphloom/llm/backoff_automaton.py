"""Log-probabilities of texts under a weighted backoff automaton of word n-grams.

Tokens are the words of a text, lower-cased in A-Z, and one end. The states are the contexts seen in training and a root.
With c the training counts, h a context and h' the same without its first word, the arc of word w leaves state h with

    P(w | h) = (c(h w) + MASS * P(w | h')) / (c(h) + MASS),   at the root (c(w) + 0.1) / (N + 0.1 * (V + 1))

if c(h w) > 0. Where there is no such arc, the failure arc to h' is taken at the price MASS / (c(h) + MASS). Reading a text
from left to right, the automaton is in the state of the words last read and adds the logarithms on its way.

Counts of a large corpus fit in no task, so the automaton is spread out. Documents are read in blocks of some hundred thousand
tokens. A block sends its distinct n-grams and their training counts to the parts of the key space, one row for each part that it has
any of; a part adds up and answers with the total counts. From these the block builds the part of the automaton that its own texts can
reach: arrays of states, failure arcs and arcs. All its texts are then read at once, a token a step, each with the state that it is in.
A text of more than ``SEGMENT`` tokens is read in segments; one that does not begin a text starts at the root, ``order - 1`` tokens early, after
which it is in the state that a reader of the whole text is in, because a state holds no more words than that.
So a frequent n-gram costs a part one entry a block, and nothing is broadcast.

The blocks are formed twice from the input, once for what they ask and once for the texts. The input must come in the same
order both times, as tables do; if it does not, an error is raised.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.groups import runs_of_rows
from graphloom.llm.tables import cut, in_arrow, partitions, utf8
from graphloom.llm.words import U64, WordHasher, checksum, mix, slices

ORDER = 2
MASS = 100.0
FOLDS = 10  # one of them is held out
BLOCK_TOKENS = 400_000
PART_BYTES = 8 << 20  # of text to a part of the key space
SEGMENT = 512  # tokens of a text that one reader reads
START, END = U64(0x5354415254), U64(0x454E44)  # in place of a word's number
BASE = U64(0x9E3779B97F4A7C15)


def held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    """A row without a doc_id is held out."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second bytes and so on, which compresses well for small numbers."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


class Block:
    """Tokens of some documents, and the keys of their n-grams; the lowest two bits of a key are its order less one."""

    def __init__(self, doc_ids: list[int | None], lengths: np.ndarray, tokens: np.ndarray, order: int):
        self.doc_ids, self.lengths, self.tokens = doc_ids, lengths, tokens
        self.first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        gram, levels = mix(tokens), []
        for level in range(order):
            if level:
                gram = mix(self.shifted(gram, START + U64(level)) * BASE + tokens)
            levels.append(gram & ~U64(3) | U64(level))
        self.keys, where = np.unique(np.concatenate(levels), return_inverse=True)
        self.where = where.reshape(order, len(tokens))

    def shifted(self, values: np.ndarray, at_start) -> np.ndarray:
        """Each token's value is that of the token before it."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = at_start
        return out

    def training_counts(self) -> np.ndarray:
        trains = np.repeat([not held_out(i) for i in self.doc_ids], self.lengths)
        return np.bincount(self.where[:, trains].reshape(-1), minlength=len(self.keys)).astype(np.uint32)


class Automaton:
    """The states and arcs that a block can reach, from the total counts of its keys.

    The states are the block's n-grams, which are contexts, then those of a text's beginning, and last the root.
    """

    def __init__(self, block: Block, totals: np.ndarray, n_tokens: int, n_words: int, mass: float):
        self.block, self.order = block, len(block.where)
        grams, top, count = len(totals), self.order - 1, totals.astype(np.float64)
        self.root, self.words = grams + top, block.where[0]
        level = (block.keys & U64(3)).astype(np.int64)
        # a place where each n-gram stands
        place = np.empty(grams, np.int64)
        for k in range(self.order):
            place[block.where[k]] = np.arange(len(block.tokens))
        shorter = block.where[np.maximum(level - 1, 0), place]
        begins = np.zeros(len(block.tokens), bool)
        begins[block.first] = True
        before = block.where[np.maximum(level - 1, 0), np.maximum(place - 1, 0)]
        source = np.where(level == 0, self.root, np.where(begins[place], grams + level - 1, before))
        # texts of the training set, which is how often a beginning was seen
        texts = count[self.words[block.first + block.lengths - 1][0]] if len(block.first) else 0.0
        size = np.concatenate([count, np.full(top, texts), [0.0]])
        self.failure = np.concatenate([np.where(level == 0, self.root, shorter), [self.root] * min(top, 1), grams + np.arange(max(top - 1, 0)), [self.root]]).astype(np.int64)
        self.price = np.log10(mass / (size + mass))
        weight = np.log10((count + 0.1) / (n_tokens + 0.1 * (n_words + 1)))
        self.at_root = weight.copy()
        for k in range(1, self.order):
            of = np.flatnonzero((level == k) & (count > 0))
            weight[of] = np.log10((count[of] + mass * 10.0 ** weight[shorter[of]]) / (size[source[of]] + mass))
        # after an arc, the automaton is in the longest context that it has for the words read
        to = np.where(level < top, np.arange(grams), shorter if top else self.root)
        to = np.where(count > 0, to, self.root)
        arcs = np.flatnonzero((count > 0) | (level == 0))
        key = source[arcs] * np.int64(grams) + self.words[place[arcs]]
        order = np.argsort(key)
        self.key, arcs = key[order], arcs[order]
        self.weight, self.to = weight[arcs], to[arcs]
        self.count = count

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a word, and the logarithms on the way: failure arcs until there is an arc, and that."""
        after, paid = np.empty_like(state), np.zeros(len(state))
        waiting = np.arange(len(state))
        while len(waiting):
            key = state[waiting] * np.int64(len(self.count)) + word[waiting]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            there = self.key[at] == key
            done, at = waiting[there], at[there]
            paid[done] += self.weight[at]
            after[done] = self.to[at]
            waiting = waiting[~there]
            paid[waiting] += self.price[state[waiting]]
            state = state.copy()
            state[waiting] = self.failure[state[waiting]]
        return after, paid

    def walk(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each document: known tokens, log10 probability at the root only, and log10 probability on the way through the states."""
        block = self.block
        if not len(block.first):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        pieces = -(-block.lengths // SEGMENT)
        of = np.repeat(np.arange(len(pieces)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = block.first[of] + nth * SEGMENT
        end = np.minimum(begin + SEGMENT, block.first[of] + block.lengths[of])
        early = np.where(nth == 0, begin, np.maximum(begin - (self.order - 1), block.first[of]))
        state = np.where(early == block.first[of], self.root - (self.order > 1), self.root)
        longest = np.argsort(early - end, kind="stable")
        begin, end, early, state = (x[longest] for x in (begin, end, early, state))
        weight = np.zeros(len(block.tokens))
        length = end - early
        for step in range(int(length.max())):
            live = int(np.searchsorted(-length, -step, "left"))
            at = early[:live] + step
            state[:live], paid = self.read(state[:live], self.words[at])
            own = at >= begin[:live]
            weight[at[own]] = paid[own]

        def by_document(x: np.ndarray, kind: type) -> np.ndarray:
            return np.add.reduceat(x.astype(kind), block.first)

        known, root = self.count[self.words] > 0, self.at_root[self.words]
        return by_document(known, np.int64), by_document(root, np.longdouble).astype(float), by_document(weight, np.longdouble).astype(float)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list, np.ndarray, np.ndarray]]:
    """Name, doc_ids, lengths and tokens of blocks of documents, in the order of the rows."""
    hasher, task, made = WordHasher(), TaskContext.get().partitionId(), 0
    ids: list = []
    lengths: list[np.ndarray] = []
    tokens: list[np.ndarray] = []

    def close():
        nonlocal made, ids, lengths, tokens
        all_tokens = np.concatenate(tokens)
        name = f"{task}-{made}-{checksum(all_tokens[:: max(1, len(all_tokens) // 1000)]).hex()}"
        out = name, ids, np.concatenate(lengths), all_tokens
        made, ids, lengths, tokens = made + 1, [], [], []
        return out

    for batch in batches:
        doc_ids = batch["doc_id"].to_pylist()
        for lo, hi, texts in slices(batch["text"]):
            found = hasher([t and t.lower() for t in texts])
            ids += doc_ids[lo:hi]
            lengths.append(np.diff(found.first) + 1)
            tokens.append(np.insert(found.hashes, found.first[1:], END))
            if sum(map(len, tokens)) >= size:
                yield close()
    if ids:
        yield close()


ASKED = "block string, part int, keys binary, counts binary"


def _ask(order: int, size: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, lengths, tokens in _blocks(batches, size):
            block = Block(ids, lengths, tokens, order)
            counts = block.training_counts()
            edges = np.searchsorted(block.keys, _edges(parts))
            out = [(part, block.keys[a:b], counts[a:b]) for part, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
            for lo in range(0, len(out), 64):  # few rows at a time, as they are large
                some = out[lo : lo + 64]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(some)),
                        pa.array([part for part, _, _ in some], pa.int32()),
                        pa.array([planes(np.diff(k, prepend=U64(0))) for _, k, _ in some], pa.binary()),
                        pa.array([planes(c) for _, _, c in some], pa.binary()),
                    ],
                    ["block", "part", "keys", "counts"],
                )

    return run


def _edges(parts: int) -> np.ndarray:
    """Least keys of the parts; the last part ends with the largest key."""
    step = (1 << 64) // parts
    return np.array([*(i * step for i in range(parts)), (1 << 64) - 1], U64)


ANSWERED = "block string, part int, totals binary, n_tokens long, n_words long"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in runs_of_rows(batches, ["part"]):
        keys = [np.cumsum(from_planes(k, U64), dtype=U64) for k in rows["keys"].to_pylist()]
        counts = [from_planes(c, np.uint32) for c in rows["counts"].to_pylist()]
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(where, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.uint64)
        words = totals[(distinct & U64(3)) == 0]
        edges = np.cumsum([0, *map(len, keys)])
        n = len(keys)
        yield pa.RecordBatch.from_arrays(
            [
                rows["block"].combine_chunks(),
                rows["part"].combine_chunks(),
                pa.array([planes(totals[where[a:b]]) for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
                pa.array([int(words.sum())] + [0] * (n - 1), pa.int64()),
                pa.array([int((words > 0).sum())] + [0] * (n - 1), pa.int64()),
            ],
            ["block", "part", "totals", "n_tokens", "n_words"],
        )


TEXTS = "block string, part int, totals binary, doc_ids array<long>, lengths array<int>, words binary, tokens binary"


def _texts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, lengths, tokens in _blocks(batches, size):
            words, where = np.unique(tokens, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name]),
                    pa.array([-1], pa.int32()),
                    pa.array([None], pa.binary()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int32())),
                    pa.array([planes(np.diff(words, prepend=U64(0)))], pa.binary()),
                    pa.array([planes(where.astype(np.uint32))], pa.binary()),
                ],
                ["block", "part", "totals", "doc_ids", "lengths", "words", "tokens"],
            )

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(order: int, mass: float, n_tokens: int, n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of_rows(batches, ["block"]):
            row = rows.slice(0, 1).to_pylist()[0]
            if row["part"] != -1 or rows["part"].to_pylist().count(-1) != 1:
                raise RuntimeError("the documents came in another order the second time; write them as a table first")
            words = np.cumsum(from_planes(row["words"], U64), dtype=U64)
            tokens = words[from_planes(row["tokens"], np.uint32)]
            block = Block(row["doc_ids"], np.array(row["lengths"], np.int64), tokens, order)
            totals = np.concatenate([from_planes(t, U64) for t in rows["totals"].to_pylist()[1:]] or [np.zeros(0, U64)])
            if len(totals) != len(block.keys):
                raise RuntimeError("the documents came in another order the second time; write them as a table first")
            known, base, score = Automaton(block, totals, n_tokens, n_words, mass).walk()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.doc_ids, pa.int64()),
                    pa.array([held_out(i) for i in block.doc_ids], pa.bool_()),
                    pa.array(block.lengths),
                    pa.array(known),
                    pa.array(np.full(len(known), n_tokens), pa.int64()),
                    pa.array(base),
                    pa.array(score),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def log_probabilities(docs: DataFrame, order: int = ORDER, mass: float = MASS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs(doc_id, text)``.

    ``order`` is 1 to 4. ``base_score`` is the log10 probability at the root only, ``score`` that of the automaton. Null texts
    count as empty and have the end as their one token; rows of one doc_id are documents of their own. Other columns are
    not read.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark), -(-size // PART_BYTES))
    asked = in_arrow(picked, _ask(order, block_tokens, parts), ASKED)
    answers = cut(asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_answer, ANSWERED), "ngrams")
    n_tokens, n_words = answers.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    texts = picked.mapInArrow(_texts(block_tokens), TEXTS)
    rows = texts.unionByName(answers.select("block", "part", "totals"), allowMissingColumns=True)
    met = rows.repartition(partitions(spark), "block").sortWithinPartitions("block", "part")
    return met.mapInArrow(_score(order, mass, n_tokens, n_words), SCORED)
