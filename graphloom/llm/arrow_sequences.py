"""Token ids of documents in Arrow files of equal-length sequences and masks.

The ids of all documents, in ascending doc_id order and each document's followed by the end id, are one stream that is cut
into shards at document boundaries. A shard is two Arrow IPC files, whose record batches can be mapped into memory and
read in any order without a copy:

``sequences-NNNNN.arrow``  ids: fixed_size_list<uint16 or uint32>[length], mask: fixed_size_list<bool>[length]. The shard's
                           ids in order; where the last sequence has no ids left, it has zeros, and the mask is false.
``index-NNNNN.arrow``      doc_id, start in the shard and number of ids of each document.

Ids are 16 bits wide when the vocabulary allows it. Files are written under a name of their own and then renamed, so a
task that runs again replaces its files by equal ones. A null or empty text has the end id only; rows without a doc_id
come first; rows of one doc_id are documents of their own, next to each other.

This tokenizer drops white space, so the ids of a text are those of its words, special tokens that stand in a text
included; and it cuts words between letters and marks, so the ids of letters with marks around them are those of the marks and
of the letters, in lower case. The last id of such a part, and no other, stands for a piece with a word's end. Ids of words and parts are kept for the worker's next texts; when there
are ``CACHED``, those that were not used lately go.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.merge_dropout import spread
from graphloom.llm.tables import cut, in_arrow, partitions, utf8
from graphloom.llm.words import WordHasher, give_back, slices, worker_state
from graphloom.scratch import new_path

LENGTH, END_ID = 2048, 1
LONG = 64  # bytes of the longest part that is kept
BATCH = 256  # sequences in a record batch
SHARD_BYTES = 64 << 20  # of text
CACHED = 200_000  # words and parts, of 200 bytes or so with their ids
#: marks, letters to U+00FF and marks; without the quote, which may begin a contraction
_MARKS, _LETTERS = rb"[!-&(-/:-@\[-`{-~]", rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
SIMPLE = re.compile(rb"(%b*)(%b)(%b*)" % (_MARKS, _LETTERS, _MARKS))
TOGETHER = 100  # parts in a call of the tokenizer
AT_ONCE = 8 << 20  # bytes of text whose distinct words are looked up together


def default_tokenizer() -> str:
    from public_tokenizers import path

    return path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        state = worker_state("tokenizers")
        if file not in state:
            tokenizer = Tokenizer.from_file(file)
            suffix = tokenizer.model.end_of_word_suffix
            closes = None  # whether an id ends a piece, where the vocabulary tells
            if suffix:
                closes = np.zeros(tokenizer.get_vocab_size(), bool)
                closes[[i for t, i in tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
            state[file] = tokenizer, closes, {}, {}
            give_back()
        self.state, self.file, self.tokenizer = state, file, state[file][0]
        self.hasher = WordHasher()
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        found = self.hasher(texts)
        _, index, inverse = np.unique(found.hashes, return_index=True, return_inverse=True)
        out = self._ids([found.buf[a:b] for a, b in zip(found.starts[index].tolist(), found.ends[index].tolist())])
        size = np.fromiter(map(len, out), np.int64, len(out)) // np.dtype(self.kind).itemsize
        ids, begin = spread(np.frombuffer(b"".join(out), self.kind), size, inverse)
        return ids, begin[found.first]

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words. Of two generations of known words, those that are used again move to the younger."""
        _, closes, young, old = self.state[self.file]
        out = list(map(young.get, words))
        plain, odd, absent = {}, {}, []
        for i, ids in enumerate(out):
            if ids is not None:
                continue
            word = words[i]
            ids = old.get(word)
            if ids is not None:
                out[i] = young[word] = ids
                continue
            parts = _parts(word) if closes is not None else None
            absent.append((i, parts))
            if parts is None:
                odd[word] = None
            else:
                for p in parts:
                    plain[p] = young.get(p) or old.get(p)
        for made, encode in ((plain, self._encode_closed), (odd, self._encode)):
            some = [p for p, ids in made.items() if ids is None]
            for lo in range(0, len(some), TOGETHER):
                made |= encode(some[lo : lo + TOGETHER])
        for i, parts in absent:
            word = words[i]
            out[i] = odd[word] if parts is None else plain[parts[0]] if len(parts) == 1 else b"".join([plain[p] for p in parts])
            if len(word) <= LONG:
                young[word] = out[i]
        young |= {p: ids for p, ids in plain.items() if len(p) <= LONG}
        if len(young) > CACHED // 2:
            self.state[self.file] = self.tokenizer, closes, {}, young
        return out

    def _encode_closed(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct parts of one kind of characters, each of which ends where an id with a word's end does."""
        closes = self.state[self.file][1]
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, self.kind)
        edges = [0, *(np.flatnonzero(closes[ids]) + 1).tolist()]
        if len(edges) != len(words) + 1:
            return self._encode(words)
        return {w: ids[a:b].tobytes() for w, a, b in zip(words, edges[:-1], edges[1:])}

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words, as one text, for a call has a price of its own; a token belongs to the word where it begins."""
        texts = [w.decode() for w in words]
        encoded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ends = np.cumsum([len(t) + 1 for t in texts])
        begin = np.fromiter((o[0] for o in encoded.offsets), np.int64, len(encoded))
        edges = np.searchsorted(np.searchsorted(ends, begin, "right"), np.arange(len(words) + 1)).tolist()
        ids = np.array(encoded.ids, self.kind)
        return {w: ids[a:b].tobytes() for w, a, b in zip(words, edges[:-1], edges[1:])}


def _parts(word: bytes) -> tuple[bytes, ...] | None:
    """Parts of a word whose ids make up the word's, or None for a word that has to be encoded whole."""
    if word.isalpha():  # ASCII letters
        return (word.lower(),)
    simple = SIMPLE.fullmatch(word)
    if simple is None or b"<|" in word:
        return None
    before, letters, after = simple.groups()
    return tuple(p for p in (before, letters.lower(), after) if p)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, list]]:
    """doc_ids and texts of about ``most`` bytes of text; a longer text ends its run."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for lo, hi, some in slices(batch["text"]):
            ids.append(batch["doc_id"].slice(lo, hi - lo))
            texts += some
            held += sum(len(t) for t in some if t)
            if held >= most:
                yield pa.concat_arrays(ids), texts
                ids, texts, held = [], [], 0
    if texts:
        yield pa.concat_arrays(ids), texts


def schema(kind: type, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    def __init__(self, folder: str, shard: int, kind: type, length: int):
        self.files, root = fs.FileSystem.from_uri(folder)
        self.files.create_dir(root)
        own = f"{TaskContext.get().taskAttemptId()}.tmp" if TaskContext.get() else "tmp"
        self.final = [f"{root}/{name}-{shard:05d}.arrow" for name in ("sequences", "index")]
        self.paths = [f"{f}.{own}" for f in self.final]
        self.sinks = [self.files.open_output_stream(p) for p in self.paths]
        self.schema, self.length, self.kind = schema(kind, length), length, kind
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sequences, self.index = (pa.ipc.new_file(sink, s) for sink, s in zip(self.sinks, (self.schema, index)))
        self.rest, self.written = np.zeros(0, kind), 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, first: np.ndarray) -> None:
        starts = pa.array(first[:-1] + self.written)
        self.index.write_batch(pa.record_batch([doc_ids, starts, pa.array(np.diff(first))], schema=self.index_schema()))
        self.written += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // self.length
        at = 0
        while whole - at >= BATCH:
            self._write(self.rest[at * self.length : (at + BATCH) * self.length])
            at += BATCH
        self.rest = self.rest[at * self.length :]

    @staticmethod
    def index_schema() -> pa.Schema:
        return pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])

    def _write(self, ids: np.ndarray) -> None:
        room = -len(ids) % self.length
        mask = np.concatenate([np.ones(len(ids), bool), np.zeros(room, bool)])
        ids = np.concatenate([ids, np.zeros(room, self.kind)])
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.sequences.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if len(self.rest):
            self._write(self.rest)
        for writer in (self.sequences, self.index, *self.sinks):
            writer.close()
        for made, name in zip(self.paths, self.final):
            self.files.move(made, name)


class Shard:
    """One shard read back, with its sequences by number."""

    def __init__(self, folder: str, shard: int):
        files, root = fs.FileSystem.from_uri(folder)

        def reader(name: str):
            path = f"{root}/{name}-{shard:05d}.arrow"
            local = isinstance(files, fs.LocalFileSystem)
            return pa.ipc.open_file(pa.memory_map(path) if local else files.open_input_file(path))

        self.sequences, self.index = reader("sequences"), reader("index")
        self.length = self.sequences.schema.field("ids").type.list_size

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of a sequence; all batches but the last have the same number of sequences."""
        batch = self.sequences.get_batch(i // BATCH)
        return tuple(batch[c][i % BATCH].values.to_numpy(zero_copy_only=c == "ids") for c in ("ids", "mask"))

    def __len__(self) -> int:
        n = self.sequences.num_record_batches
        return (n - 1) * BATCH + self.sequences.get_batch(n - 1).num_rows if n else 0

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, start, number of ids, CRC-32 of the ids as unsigned 32-bit numbers) of each document, in one pass."""
        batch, base, flat = -1, 0, np.zeros(0, np.uint32)
        for k in range(self.index.num_record_batches):
            rows = self.index.get_batch(k)
            for doc_id, start, n in zip(*(rows[c].to_pylist() for c in ("doc_id", "start", "n_tokens"))):
                crc, at = 0, start
                while at < start + n:
                    while at >= base + len(flat):
                        base, batch = base + len(flat), batch + 1
                        part = self.sequences.get_batch(batch)
                        ids = part["ids"].flatten().to_numpy()
                        flat = ids[part["mask"].flatten().to_numpy(zero_copy_only=False)].astype(np.uint32)
                    to = min(start + n, base + len(flat))
                    crc = zlib.crc32(flat[at - base : to - base], crc)
                    at = to
                yield doc_id, start, n, crc


def write_sequences(docs: DataFrame, folder: str, file: str | None = None, length: int = LENGTH) -> DataFrame:
    """Writes the shards of ``docs(doc_id, text)`` to ``folder``; (shard, n_docs, n_tokens) of each. Other columns are not read."""
    file = file or default_tokenizer()
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(partitions(spark), -(-size // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(file)
        writer, n_docs, shard = None, 0, TaskContext.get().partitionId()
        for doc_ids, texts in _gathered(batches, AT_ONCE):
            ids, first = tokenizer(texts)
            ids = np.insert(ids, first[1:], END_ID)
            first = first + np.arange(len(first))
            writer = writer or ShardWriter(folder, shard, tokenizer.kind, length)
            writer.add(doc_ids, ids, first)
            n_docs += len(texts)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [n_docs], "n_tokens": [writer.written]})

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8())
    # rows of one doc_id, or of none, may fill several shards
    keyed = picked.withColumn("tie", F.xxhash64("text"))
    placed = keyed.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    return cut(in_arrow(placed, run, "shard int, n_docs long, n_tokens long"), "shards")


def read_sequences(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files; ``start`` counts the ids of all documents before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before in zip(batch["shard"].to_pylist(), batch["before"].to_pylist()):
                rows = list(Shard(folder, shard).documents())
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                columns[1] = pa.array(columns[1].to_numpy() + before)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row a shard, so that the running sum is small
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = shards.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.repartition(partitions(shards.sparkSession), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents of files just written below ``spark.checkpoint.dir``, as read back from them."""
    folder = new_path(spark, "sequences")
    if "://" not in folder:
        folder = folder if folder.startswith("file:") else f"file://{os.path.abspath(folder)}"
    return read_sequences(write_sequences(docs, folder), folder)
