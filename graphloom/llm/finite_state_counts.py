"""Numbers of tokens of texts under a byte-level BPE vocabulary, by finite-state transducers.

**Pieces.** Such a tokenizer first cuts a text into pieces: contractions, words, numbers, other marks, white space, each
with a space before it. ``NEXT`` and ``MARK`` are that rule as a deterministic transducer over classes of characters: MARK tells for
a state and a class whether a piece begins at this character, or one character before. A buffer of texts is cut into
chunks of equal length; all chunks step at once, each from all states, which gives a map of states for every chunk. The maps
are composed by a parallel prefix scan, which gives each chunk the state in which it really begins, and a second run
emits the marks.

**Tokens.** The last token of the encoding of a prefix is the one token that ends there and may follow the last token of the
prefix before it, because an encoding is a valid one just where all its neighbouring tokens are. What the future needs
of the past is therefore: for every start from which a token could still go on, the trie node reached, the last token
there, and the number of tokens there relative to here. Such a set is a state; a byte leads to one next state, and the
transition carries the change of the number of tokens, which is below zero where a token closes over several.
States are made when they first occur and kept for the worker's life; beyond ``MOST_STATES`` all but those in use are
dropped and made again when needed. Distinct pieces of a slice of text step at once, one byte a step.

Strings of special tokens inside a text are one token each and cut the text, as the library does it by default. Null and
empty texts have no tokens. Bytes that are no UTF-8 count as U+FFFD. Pieces of a slice are told apart by 64-bit hashes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tables import in_arrow, utf8
from graphloom.llm.words import WordHasher, slices, worker_state

LIMIT = 512
MOST_STATES = 400_000
CHUNK = 512
FREE = 1 << 62  # no rank
BIAS = 1 << 19  # of the number of tokens relative to here

# ---- pieces

#: classes of characters; END stands between texts, REST fills the last chunk
SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, STMD, R, V, L, E, END, REST = range(13)
#: states: before the first character, inside letters, numbers, marks, after a quote that begins a piece, after that and
#: r, v or l, after a contraction, in white space of one or more characters that ends in a space or not
BEGIN, IN_LETTERS, IN_NUMBER, IN_OTHER, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, CLOSED, ONE_SPACE, ONE_WHITE, SPACES, WHITES = range(13)
HERE, BEFORE = 1, 2

LETTERS = (LETTER, STMD, R, V, L, E)


def _transition(state: int, c: int) -> tuple[int, int]:
    """The next state, and where pieces begin."""
    if c == REST:
        return state, 0
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):
        if c == (L if state == QUOTED_L else E):
            return CLOSED, 0
        following, mark = _transition(IN_LETTERS, c)
        return following, mark | BEFORE  # no contraction, so its letter began a piece
    if c == END:
        return BEGIN, HERE
    blank = {ONE_SPACE: 1, SPACES: 2, ONE_WHITE: 1, WHITES: 2}.get(state, 0)
    if c in (SPACE, WHITE):
        if blank:
            return (SPACES if c == SPACE else WHITES), 0
        return (ONE_SPACE if c == SPACE else ONE_WHITE), HERE
    after_space = state in (ONE_SPACE, SPACES)
    mark = BEFORE if blank == 2 else 0  # the last of several leaves the run
    inside = IN_LETTERS if c in LETTERS else IN_NUMBER if c == NUMBER else IN_OTHER
    if after_space:
        return inside, mark
    if state == QUOTED:
        if c == STMD:
            return CLOSED, 0
        if c in (R, V, L):
            return {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[c], 0
    if inside == IN_OTHER and state in (IN_OTHER, QUOTED):
        return IN_OTHER, 0
    if inside == state:
        return state, 0
    return (QUOTED if c == QUOTE else inside), mark | HERE


NEXT = np.array([[_transition(s, c)[0] for c in range(13)] for s in range(13)], np.uint8)
MARK = np.array([[_transition(s, c)[1] for c in range(13)] for s in range(13)], np.uint8)


def chunk_starts(maps: np.ndarray) -> np.ndarray:
    """The state in which each chunk begins, from the chunks' maps, by a parallel prefix scan of compositions."""
    done = maps.copy()
    step = 1
    while step < len(done):
        done[step:] = np.take_along_axis(done[step:], done[:-step], axis=1)
        step *= 2
    return np.concatenate([np.array([BEGIN], np.uint8), done[:-1, BEGIN]])


def piece_marks(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a piece begins at each character."""
    n = len(classes)
    count = max(1, -(-n // chunk))
    padded = np.full(count * chunk, REST, np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(count, chunk).T)
    states = len(NEXT)
    following, marks = NEXT.reshape(-1), MARK.reshape(-1)
    maps = np.tile(np.arange(states, dtype=np.uint8), (count, 1))
    for row in steps:
        maps = following[maps.astype(np.intp) * states + row[:, None]]
        if maps.shape[1] > 1 and (maps == maps[:, :1]).all():
            maps = np.ascontiguousarray(maps[:, :1])  # each chunk has forgotten how it began
    state = chunk_starts(np.broadcast_to(maps, (count, states)))
    out = np.empty_like(steps)
    for t, row in enumerate(steps):
        at = state.astype(np.intp) * states + row
        out[t] = marks[at]
        state = following[at]
    flat = np.ascontiguousarray(out.T).reshape(-1)[:n]
    begins = (flat & HERE).astype(bool)
    begins[:-1] |= flat[1:] & BEFORE != 0
    return begins


class Classes:
    """Classes of code points; a block of them is asked from the tokenizer's own rule when it first occurs."""

    def __init__(self, pre_tokenizer):
        self.rule = pre_tokenizer
        self.of = np.full(0x110000, 255, np.uint8)
        self.known = np.zeros(0x1100, bool)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        seen = np.zeros(0x1100, bool)
        seen[points >> 8] = True
        for block in np.flatnonzero(seen & ~self.known):
            for p in range(block << 8, (block + 1) << 8):
                self.of[p] = self._ask(p)
            self.known[block] = True
        return self.of[points]

    def _ask(self, p: int) -> int:
        if 0xD800 <= p < 0xE000:
            return OTHER
        c = chr(p)
        named = {" ": SPACE, "'": QUOTE, "r": R, "v": V, "l": L, "e": E}
        if c in named or c in "stmd":
            return named.get(c, STMD)
        for kind, like in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self.rule.pre_tokenize_str(like + c)) == 1:
                return kind
        return WHITE


# ---- tokens


def byte_of_letter() -> dict[str, int]:
    """The bytes behind the letters of a byte-level vocabulary: printable ones stand for themselves, the others follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Transducer:
    """Counts tokens of byte strings. ``vocabulary`` maps tokens to ids, ``merges`` are pairs of tokens in order of rank."""

    def __init__(self, vocabulary: dict[str, int], merges: list, most_states: int = MOST_STATES, room: int = 1 << 20):
        self.most_states, self.room = most_states, room
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, whole = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.rank[x, y] = r
            self.halves.setdefault(whole, (x, y, r))
        letters = byte_of_letter()
        self.child: dict[int, int] = {}
        self.token: dict[int, int] = {}
        self.inner: set[int] = {0}
        nodes = 1
        for text, t in vocabulary.items():
            if any(c not in letters for c in text):
                continue
            node = 0
            for c in text:
                key = node << 8 | letters[c]
                self.inner.add(node)
                if key not in self.child:
                    self.child[key] = nodes
                    nodes += 1
                node = self.child[key]
            self.token[node] = t
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.whole: dict[int, bool] = {}
        self._reset()

    def _edge(self, t: int, side: int) -> list[tuple[int, int]]:
        """Tokens at the right (1) or left (0) edge of ``t`` while it is being made, and the rank of the merge that ends each."""
        memo = self.right if side else self.left
        if t not in memo:
            out, at, end = [], t, FREE
            while True:
                out.append((at, end))
                if at not in self.halves:
                    break
                end, at = self.halves[at][2], self.halves[at][side]
            memo[t] = out
        return memo[t]

    def _apart(self, a: int, b: int, below: int = FREE) -> bool:
        """Whether no merge of a rank under ``below`` joins an edge of ``a`` with one of ``b`` while both are there."""
        for x, until_x in self._edge(a, 1):
            for y, until_y in self._edge(b, 0):
                r = self.rank.get((x, y))
                if r is not None and r < min(until_x, below) and r <= until_y:
                    return False
        return True

    def _is_made(self, t: int) -> bool:
        """Whether the bytes of ``t`` are encoded as ``t``."""
        if t not in self.whole:
            if t not in self.halves:
                self.whole[t] = True
            else:
                a, b, r = self.halves[t]
                self.whole[t] = self._is_made(a) and self._is_made(b) and self._apart(a, b, r)
        return self.whole[t]

    def _fits(self, before: int, t: int) -> bool:
        return self._is_made(t) and (before < 0 or self._apart(before, t))

    def _reset(self) -> None:
        self.sets: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.keys = np.full(self.room, -1, np.int64)
        self.to = np.zeros(self.room, np.int32)
        self.change = np.zeros(self.room, np.int32)
        self.used = 0
        self.start = self._state((BIAS,))

    def _state(self, members: tuple) -> int:
        n = self.number.setdefault(members, len(self.sets))
        if n == len(self.sets):
            self.sets.append(members)
        return n

    def _step(self, members: tuple, byte: int) -> tuple[tuple, int]:
        """The members after a byte, and the change of the number of tokens.

        A member is one integer of a trie node, the last token there plus one, and the tokens there relative to here.
        """
        moved, change, last = [], None, -1
        for member in members:  # earliest start first
            to = self.child.get((member >> 40) << 8 | byte)
            if to is None:
                continue
            if change is None and to in self.token and self._fits((member >> 20 & 0xFFFFF) - 1, self.token[to]):
                change, last = (member & 0xFFFFF) - BIAS + 1, self.token[to]
            if to in self.inner:
                moved.append(to << 40 | member & 0xFFFFFFFFFF)
        if change is None:
            raise ValueError("the vocabulary does not hold every byte")
        return (*[m - change for m in moved], last + 1 << 20 | BIAS), change

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands in the table, or the free place where it would."""
        mask = self.room - 1
        at = ((keys * np.int64(0x9E3779B97F4A7C15 - (1 << 64))) >> np.int64(24)) & mask
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            found = self.keys[at[open_]]
            open_ = open_[(found != keys[open_]) & (found != -1)]
        return at

    def _make(self, keys: np.ndarray) -> None:
        for key in keys.tolist():
            members, change = self._step(self.sets[key >> 8], key & 255)
            at = (key * 0x9E3779B97F4A7C15 >> 24) & (self.room - 1)
            while self.keys[at] != -1:
                at = (at + 1) & (self.room - 1)
            self.keys[at], self.to[at], self.change[at] = key, self._state(members), change
            self.used += 1

    def counts(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of tokens of the pieces ``codes[starts[i]:ends[i]]``."""
        order = np.argsort(starts - ends, kind="stable")  # longest first
        begin, length = starts[order], (ends - starts)[order]
        total = np.zeros(len(order), np.int64)
        state = np.full(len(order), self.start, np.int64)
        live = len(order)
        t = 0
        while live and (live := int(np.searchsorted(-length[:live], -t, "left"))):
            keys = state[:live] << 8 | codes[begin[:live] + t]
            at = self._slots(keys)
            missing = np.unique(keys[self.keys[at] != keys])
            for lo in range(0, len(missing), 10_000):
                if self.used + 10_000 > self.room // 2 or len(self.sets) > self.most_states:
                    keys, missing, lo = self._forget(state[:live], codes[begin[:live] + t]), None, 0
                    break
                self._make(missing[lo : lo + 10_000])
            if missing is None:
                state[:live] = keys >> 8
                continue  # the same byte again, from the states' new numbers
            if len(missing):
                at = self._slots(keys)
            total[:live] += self.change[at]
            state[:live] = self.to[at]
            t += 1
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out

    def _forget(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Drops all states but those in use; their new keys."""
        kept, index = np.unique(state, return_inverse=True)
        members = [self.sets[s] for s in kept.tolist()]
        self._reset()
        self.most_states = max(self.most_states, 2 * len(kept))
        return np.array([self._state(m) for m in members], np.int64)[index] << 8 | byte


class TokenCounter:
    """Numbers of tokens of texts, from the tokenizer's file."""

    def __init__(self, file: str):
        state = worker_state("token counts")
        if file not in state:
            from tokenizers import Tokenizer

            with open(file, encoding="utf-8") as f:
                described = json.load(f)
            special = [t["content"] for t in described["added_tokens"]]
            cut_at = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
            model = described["model"]
            state[file] = Transducer(model["vocab"], model["merges"]), Classes(Tokenizer.from_file(file).pre_tokenizer), cut_at
        self.transducer, self.classes, self.special = state[file]
        self.hasher = WordHasher()

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        parts, owner = [], []
        extra = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            whole = (text or b"").decode("utf-8", "replace")
            found = self.special.split(whole) if self.special else [whole]
            parts += found
            owner += [i] * len(found)
            extra[i] = len(found) - 1
        joined = "\n".join(parts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        codes = np.frombuffer(joined.encode(), np.uint8)
        stop = np.cumsum([len(p) + 1 for p in parts]) - 1  # the characters between texts
        classes = self.classes(points)
        classes[stop] = END
        at = np.flatnonzero(piece_marks(classes))
        if not len(at):
            return extra
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offset = np.concatenate([[0], np.cumsum(width)])
        starts, ends = offset[at], offset[np.append(at[1:], len(points))]
        real = classes[at] != END
        at, starts, ends = at[real], starts[real], ends[real]
        if not len(at):
            return extra
        _, index, inverse = np.unique(self.hasher.numbers(codes, starts, ends), return_index=True, return_inverse=True)
        tokens = self.transducer.counts(codes, starts[index], ends[index])[inverse]
        of = np.array(owner)[np.searchsorted(stop, at)]
        return extra + np.bincount(of, tokens, len(texts)).astype(np.int64)


def default_tokenizer() -> str:
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, file: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs(doc_id, text)``. Other columns are not read."""
    file = file or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(file)
        for batch in batches:
            for lo, hi, texts in slices(batch["text"]):
                tokens = counter(texts)
                size = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
                columns = [batch["doc_id"].slice(lo, hi - lo), pa.array(size), pa.array(tokens), pa.array(tokens > limit)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8())
    return in_arrow(picked, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
