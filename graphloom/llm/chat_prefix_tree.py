"""Conversations as token trees: turns that conversations share from their beginning on are emitted once.

A turn is formatted as ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Inside role and text a backslash is doubled and ``<|`` becomes
``<\\|``, so no control string is left there, and a line feed in a role becomes ``\\n``; ``unescape`` undoes all that. The two
control strings are ids of their own above the vocabulary of the byte-level tokenizer.

A node of the tree is a turn after all turns before it, told by a digest of both. Nodes are written in depth-first order: a node's
path has eight bytes of the digest of each turn whose predecessor has several successors, so turns that follow each other without
a branch have one path, and the order of path and step is that order. No tree is ever held in one place, and what a turn carries
grows with the branches on its way, not with the turns. Each node has

start, n_tokens        its place in the stream of all nodes' ids
position               the position id of its first token, the number of tokens on the way from the root
ancestors              the intervals of the stream that its tokens attend to beside those before them in the node; ancestors
                       that follow each other in the stream are one interval
subtree_end            where the intervals of its descendants end
loss_from, loss_to     the part of its ids under the loss mask: the text of an assistant's turn

Null roles and texts count as empty. The turns of a conversation are its rows by turn, then role and text; rows that are
repeated are turns of their own. Rows without a conv_id form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.tables import cut, forget, partitions, small
from graphloom.llm.words import worker_state

START, END = "<|im_start|>", "<|im_end|>"
START_ID, END_ID = 50257, 50258
LOSS_ROLE = "assistant"
BROADCAST_ROWS = 1_000_000
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def default_tokenizer() -> str:
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


class TurnCodec:
    """Ids of a turn and back."""

    def __init__(self, file: str):
        state = worker_state("chat tokenizers")
        if file not in state:
            from tokenizers import Tokenizer

            state[file] = Tokenizer.from_file(file)
            state[file].encode_special_tokens = True  # their strings in a text are text
        self.tokenizer = state[file]
        self.line = self._ids("\n")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Ids, and where those of the text begin and end."""
        head = [START_ID, *self._ids(escape_role(role) + "\n")]
        body = self._ids(escape(text))
        return [*head, *body, END_ID, *self.line], len(head), len(head) + len(body)

    def decode(self, ids: list[int]) -> str:
        """The formatted string of a turn or a part of it."""
        out, run = [], []
        for i in [*ids, END_ID]:
            if i in (START_ID, END_ID):
                out += [self.tokenizer.decode(run, skip_special_tokens=False), START if i == START_ID else END]
                run = []
            else:
                run.append(i)
        return "".join(out[:-1])


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (formatted.startswith(START) and formatted.endswith(END + "\n")):
        raise ValueError("not a formatted turn")
    role, _, text = formatted[len(START) : -len(END) - 1].partition("\n")
    return unescape(role), unescape(text)


CHAIN = "conv_id long, step long, node binary, parent binary, role string, text string"
PATH = "node binary, path binary"
WAY = "node binary, position long, ancestors array<struct<start:long,end:long>>"


def chains(conversations: DataFrame) -> DataFrame:
    """(conv_id, step, node, parent, role, text) of every turn; node tells the turn and all before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, step, node = object(), 0, b""
        for batch in batches:
            out = []
            for conv_id, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text"))):
                if conv_id != conv:
                    conv, step, node = conv_id, -1, b""
                turn = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
                parent, node, step = node, hashlib.sha256(node + turn).digest()[:16], step + 1
                out.append((step, node, parent))
            steps, nodes, parents = zip(*out) if out else ((), (), ())
            columns = [batch["conv_id"], pa.array(steps, pa.int64()), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), batch["role"], batch["text"]]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "step", "node", "parent", "role", "text"])

    picked = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    )
    placed = picked.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.select("conv_id", "role", "text").mapInArrow(run, CHAIN)


def _in_order(rows: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the turns of each conversation in order, as a stream."""
    placed = rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "step")
    return placed.mapInArrow(run, schema)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, path = object(), b""
    for batch in batches:
        out = []
        for conv_id, node, is_branch in zip(*(batch[c].to_pylist() for c in ("conv_id", "node", "is_branch"))):
            if conv_id != conv:
                conv, path = conv_id, b""
            if is_branch:
                path += node[:8]
            out.append(path)
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(out, pa.binary())], ["node", "path"])


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, position, spans = object(), 0, []
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        positions, ancestors = [], []
        for conv_id, start, end in zip(*(batch[c].to_pylist() for c in ("conv_id", "start", "end"))):
            if conv_id != conv:
                conv, position, spans = conv_id, 0, []
            positions.append(position)
            ancestors.append(spans)
            position += end - start
            joins = spans and spans[-1]["end"] == start
            spans = [*spans[:-1], {"start": spans[-1]["start"], "end": end}] if joins else [*spans, {"start": start, "end": end}]
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(positions, pa.int64()), pa.array(ancestors, kind)], ["node", "position", "ancestors"])


def _encode(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, start = TurnCodec(file), TaskContext.get().partitionId(), 0
        for batch in batches:
            coded = [codec.encode(r, t) for r, t in zip(batch["role"].to_pylist(), batch["text"].to_pylist())]
            loss = [a if r == LOSS_ROLE else 0 for r, (_, a, _) in zip(batch["role"].to_pylist(), coded)]
            to = [b if r == LOSS_ROLE else 0 for r, (_, _, b) in zip(batch["role"].to_pylist(), coded)]
            starts = []
            for ids, _, _ in coded:
                starts.append(start)
                start += len(ids)
            columns = [
                batch["node"],
                pa.array([part] * len(coded), pa.int32()),
                pa.array(starts, pa.int64()),
                pa.array([len(ids) for ids, _, _ in coded], pa.int64()),
                pa.array([ids for ids, _, _ in coded], pa.list_(pa.int32())),
                pa.array(loss, pa.int32()),
                pa.array(to, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["node", "part", "local", "n_tokens", "ids", "loss_from", "loss_to"])

    return run


def build_forest(conversations: DataFrame, file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes of all conversations(conv_id, turn, role, text), and the (conv_id, step, node) that lead through them; both written."""
    spark = conversations.sparkSession
    turns = cut(chains(conversations), "turns")
    several = turns.groupBy("parent", "node").agg(F.lit(1).alias("one")).groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = small(cut(several.select("parent", F.lit(True).alias("is_branch")), "branches"), BROADCAST_ROWS)
    flagged = turns.select("conv_id", "step", "node", "parent").join(several, "parent", "left")
    paths = _in_order(flagged.select("conv_id", "step", "node", F.coalesce("is_branch", F.lit(False)).alias("is_branch")), _paths, PATH)
    distinct = turns.groupBy("node").agg(*[F.min(c).alias(c) for c in ("step", "role", "text")]).join(paths.groupBy("node").agg(F.min("path").alias("path")), "node")
    ordered = distinct.repartitionByRange(partitions(spark), "path", "step").sortWithinPartitions("path", "step").select("node", "role", "text")
    coded = cut(ordered.mapInArrow(_encode(file or default_tokenizer()), "node binary, part int, local long, n_tokens long, ids array<int>, loss_from int, loss_to int"), "coded")
    # one row a part
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = coded.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = coded.join(F.broadcast(offsets), "part").withColumn("start", F.col("local") + F.col("before")).drop("part", "local", "before")
    spans = placed.select("node", "start", (F.col("start") + F.col("n_tokens")).alias("end"))
    steps = cut(turns.select("conv_id", "step", "node").join(spans, "node"), "steps")
    # all conversations through a node agree on its way from the root
    ways = _in_order(steps.select("conv_id", "step", "node", "start", "end"), _ways, WAY).groupBy("node").agg(F.min(F.struct("position", "ancestors")).alias("way"))
    leaves = cut(steps.groupBy("conv_id").agg(F.max("end").alias("leaf_end")), "leaves").withColumnRenamed("conv_id", "of")
    ends = steps.join(leaves, steps["conv_id"].eqNullSafe(leaves["of"])).groupBy("node").agg(F.max("leaf_end").alias("subtree_end"))
    facts = ways.join(ends, "node")
    nodes = placed.join(facts.select("node", "way.position", "way.ancestors", "subtree_end"), "node")
    nodes = cut(nodes.select("node", "start", "n_tokens", "position", "ancestors", "subtree_end", "loss_from", "loss_to", "ids"), "nodes")
    routes = cut(turns.select("conv_id", "step", "node"), "routes")
    forget(turns, coded, steps)
    return nodes, routes


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_conversations(nodes: DataFrame, routes: DataFrame, file: str | None = None) -> DataFrame:
    """Digests of the conversations as they are read back from the nodes along their routes."""
    file = file or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TurnCodec(file)
        current, turns, loss = object(), None, None
        counts = [0, 0, 0]
        out: list[tuple] = []

        def close() -> None:
            if turns is not None:
                out.append((current, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))

        def made() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [c.split()[0] for c in READ.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("conv_id", "ids", "loss_from", "loss_to"))):
                conv_id, ids, a, b = row
                if conv_id != current:
                    close()
                    current, turns, loss, counts = conv_id, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                formatted = codec.decode(ids)
                role, text = parse_turn(formatted)
                under = unescape(codec.decode(ids[a:b]))
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(under.encode())
                counts = [counts[0] + 1, counts[1] + len(under), counts[2] + len(formatted)]
            if len(out) >= 1000:
                yield made()
                out = []
        close()
        if out:
            yield made()

    met = routes.join(nodes.select("node", "ids", "loss_from", "loss_to"), "node")
    placed = met.repartition(partitions(nodes.sparkSession), "conv_id").sortWithinPartitions("conv_id", "step")
    return placed.select("conv_id", "ids", "loss_from", "loss_to").mapInArrow(run, READ)
