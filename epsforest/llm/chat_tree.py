"""Chat formatting as prefix trees: turns that conversations share are emitted once.

Conversations are ordered by the path of their turns' chained hashes, so those that share initial turns stand together. A
stream over that order emits each new turn once, depth-first, with

* ``start``: where its characters begin in the pack, ``position``: the position id of its first character, which counts
  along the conversation, not along the pack (the turn's characters have consecutive positions from there),
* ``attends``: the intervals of the pack that it may attend to besides itself: its ancestors, adjacent ones merged,
* ``loss_from``, ``loss_to``: the characters of the segment under the loss mask (an assistant's text).

A leaf row marks where each conversation ends. Packs are closed at PACK characters between two conversations; the next
pack repeats the turns that are still shared, so each pack stands alone. Memory is one path of turns.

The template marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and texts ``\\`` becomes ``\\\\`` and ``<|``
becomes ``<\\|``, in roles a line feed becomes ``\\n``; so no text has a control string, and all is reversible.

Skew: the order is dealt by ranges of (path, conversation), which splits a hot first turn or a hot conversation's copies
at deeper turns and at ids. One conversation's turns are read in order by one task, as a stream.

Defined results: turns come by (turn, role, text). A null role or text is empty. Rows with a null conv_id are one
conversation. Repeated rows are repeated turns. Only ``role == 'assistant'`` is under the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsforest.runtime import cut

BEGIN, FINISH = "<|im_start|>", "<|im_end|>\n"
PACK, ROWS = 1 << 20, 2000
SCHEMA = "pack long, seq long, node int, parent int, depth int, start long, position long, attends array<struct<lo:long,hi:long>>, segment string, loss_from int, loss_to int, conv_id long, leaf boolean"
ARROW = pa.schema([
    ("pack", pa.int64()), ("seq", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("start", pa.int64()), ("position", pa.int64()),
    ("attends", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), ("segment", pa.string()), ("loss_from", pa.int32()), ("loss_to", pa.int32()), ("conv_id", pa.int64()), ("leaf", pa.bool_()),
])


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends in it."""
    head = BEGIN + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + FINISH, len(head), len(head) + len(body)


def parse(formatted: str) -> tuple[str, str]:
    head, _, body = formatted.removeprefix(BEGIN).removesuffix(FINISH).partition("\n")
    return unescape(head), unescape(body)


def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, path) of conversations whose rows come together in order: 8 bytes of the chained hash for each turn."""
    now, chain, path = None, b"", bytearray()
    for batch in batches:
        ids, out = [], []
        for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if now != (conv,):
                if now:
                    ids.append(now[0])
                    out.append(bytes(path))
                now, chain, path = (conv,), b"", bytearray()
            chain = hashlib.blake2b(b"%d:%s%s" % (len(role), role.encode(), text.encode()), key=chain, digest_size=16).digest()
            path += chain[:8]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["conv_id", "path"])
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([bytes(path)], pa.binary())], ["conv_id", "path"])


class Packer:
    """Emits nodes and leaves of one stream of ordered conversations."""

    def __init__(self, first_pack: int, size: int) -> None:
        self.pack, self.size, self.rows = first_pack - 1, size, []
        self.now: tuple | None = None
        self._open()

    def _open(self) -> None:
        self.pack += 1
        self.seq = self.nodes = self.chars = 0
        self.stack: list[dict] = []

    def _row(self, **x) -> None:
        self.rows.append({"pack": self.pack, "seq": self.seq, "conv_id": None, "leaf": False} | x)
        self.seq += 1

    def end(self) -> None:
        if self.now:
            top = self.stack[self.depth - 1]
            self._row(node=top["node"], parent=None, depth=self.depth, start=None, position=None, attends=None, segment=None, loss_from=None, loss_to=None, conv_id=self.now[1], leaf=True)
            if self.chars >= self.size:
                self._open()

    def turn(self, rank: int, conv: int | None, role: str, text: str) -> None:
        if self.now != (rank, conv):
            self.end()
            self.now, self.depth = (rank, conv), 0
        d = self.depth
        self.depth += 1
        if d < len(self.stack) and self.stack[d]["turn"] == (role, text):
            return
        del self.stack[d:]
        above = self.stack[-1] if d else None
        body, lo, hi = segment(role, text)
        attends = list(above["attends"]) if above else []
        if above:
            own = (above["start"], above["start"] + above["length"])
            attends = [*attends[:-1], (attends[-1][0], own[1])] if attends and attends[-1][1] == own[0] else [*attends, own]
        node = {"turn": (role, text), "node": self.nodes, "start": self.chars, "length": len(body), "position": above["position"] + above["length"] if above else 0, "attends": attends}
        self.stack.append(node)
        loss = role == "assistant"
        self._row(
            node=self.nodes, parent=above["node"] if above else None, depth=d + 1, start=self.chars, position=node["position"], attends=[{"lo": a, "hi": b} for a, b in attends],
            segment=body, loss_from=lo if loss else None, loss_to=hi if loss else None,
        )
        self.nodes += 1
        self.chars += len(body)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_pylist(rows, schema=ARROW)


def packer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Packer(TaskContext.get().partitionId() << 32, size)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                for rank, conv, role, text in zip(*(batch.column(k).slice(lo, ROWS).to_pylist() for k in range(4)), strict=True):
                    p.turn(rank, conv, role, text)
                yield p.take()
        p.end()
        yield p.take()

    return run


def pack_conversations(conversations: DataFrame, size: int = PACK) -> DataFrame:
    """The packs of ``conversations`` (conv_id, turn, role, text), rows as in SCHEMA."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    order = ["turn", "role", "text"]
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    found = ordered.select("conv_id", "role", "text").mapInArrow(paths, "conv_id long, path binary")
    ranked = found.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select(F.col("conv_id").alias("_c"), F.monotonically_increasing_id().alias("rank"))
    ranked = cut(ranked, "ranks")  # fixed, whatever is computed again later
    dealt = turns.join(ranked, turns["conv_id"].eqNullSafe(F.col("_c"))).repartitionByRange("rank").sortWithinPartitions("rank", *order)
    return dealt.select("rank", "conv_id", "role", "text").mapInArrow(packer(size), SCHEMA)


def read_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of packs whose rows come together in order. Hash states are kept along the path, so shared turns are hashed once."""
    stack: list[tuple] = []
    now = None
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        pack, depth, body, lo, hi, conv, leaf = (batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("pack", "depth", "segment", "loss_from", "loss_to", "conv_id", "leaf"))
        for i in range(batch.num_rows):
            if now != pack[i]:
                now, stack = pack[i], []
            if leaf[i]:
                turns, loss, loss_chars, chars = stack[depth[i] - 1]
                for k, v in zip(out, (conv[i], depth[i], turns.hexdigest(), loss_chars, loss.hexdigest(), chars), strict=True):
                    out[k].append(v)
                continue
            del stack[depth[i] - 1 :]
            turns, loss, loss_chars, chars = stack[-1] if stack else (hashlib.sha256(), hashlib.sha256(), 0, 0)
            turns, loss = turns.copy(), loss.copy()
            role, text = parse(body[i])
            turns.update(f"{role}\n{text}\n".encode())
            if lo[i] is not None:
                masked = unescape(body[i][lo[i] : hi[i]])
                loss.update(masked.encode())
                loss_chars += len(masked)
            stack.append((turns, loss, loss_chars, chars + len(body[i])))
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))


def read_back(packs: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from packs alone."""
    ordered = packs.repartition("pack").sortWithinPartitions("pack", "seq")
    return ordered.mapInArrow(read_packs, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
