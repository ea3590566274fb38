"""Reply trees formatted as conversations.

Root-to-leaf paths come from iterative self-joins by pointer doubling: round k joins
each node's 2**k-th ancestor with that ancestor's own, so a tree of depth d takes
log2(d) rounds. Branches are ranked by the summed score of their path, and the nodes
of each chosen path are listed by joining with the rounds' tables once each. Every round
is written and read again, so no plan holds more than one round's join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .io import cut

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_ESC = re.compile(r"<(\\*)\|")
_UNESC = re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    r"""Put a backslash into every "<|" (and one more into "<\|", ...), so no control string is left."""
    return _ESC.sub(lambda m: "<" + m[1] + "\\|", text)


def unescape(text: str) -> str:
    return _UNESC.sub(lambda m: "<" + m[1] + "|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string and the code-point spans under the loss mask (assistant texts)."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{CLOSE}\n")
        at += len(out[-1])
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError(f"no turn starts at {at}")
        line, end = text.index("\n", at), text.index(CLOSE + "\n", at)
        turns.append((_unrole(text[at + len(OPEN) : line]), unescape(text[line + 1 : end])))
        at = end + len(CLOSE) + 1
    return turns


def reply_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """conv_id, leaf, back, node_id for the best branches of each tree (None: of all branches).

    messages(conv_id, node_id, parent_id, score): a node whose parent is null or absent is
    a root. Branches are ranked by path score, then by length, then by the smaller leaf
    id. A null score counts 0; a null conv_id is a conversation; rows with a null node_id
    aren't nodes; of repeated (conv_id, node_id) the row with the smallest parent and
    score counts; nodes on a cycle have no root and lie on no path. An empty table gives no rows.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv")
    nodes = messages.where("node_id is not null").select(key, "conv_id", F.col("node_id").alias("node"), F.struct(F.col("parent_id").alias("parent"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).alias("x"))
    nodes = nodes.groupBy("conv", "conv_id", "node").agg(F.min("x").alias("x")).select("conv", "conv_id", "node", "x.parent", "x.score")
    there = nodes.select("conv", F.col("node").alias("parent"), F.lit(True).alias("there"))
    first = nodes.join(there, ["conv", "parent"], "left").select("conv", "conv_id", "node", F.when(F.col("there"), F.col("parent")).alias("up"), "score", F.lit(1).cast("long").alias("steps"))
    start = cut(first)
    n = start.count()
    done, active = start.where("up is null"), start.where("up is not null")
    rounds = []
    # Only nodes that haven't reached their root go on; after log2(n) rounds those left lie on cycles.
    while active.limit(1).count() and (1 << len(rounds)) <= n:
        rounds.append(active)
        b = active.unionByName(done).select("conv", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("steps").alias("steps2"))
        nxt = cut(active.join(b, ["conv", "up"]).select("conv", "conv_id", "node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), (F.col("steps") + F.col("steps2")).alias("steps")))
        done, active = done.unionByName(nxt.where("up is null")), nxt.where("up is not null")
    inner = start.where("up is not null").select("conv", F.col("up").alias("node")).distinct()
    leaves = cut(done.join(inner, ["conv", "node"], "left_anti"))
    if branches is not None:
        best = Window.partitionBy("conv").orderBy(F.desc("score"), F.desc("steps"), "node")
        leaves = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    paths = cut(leaves.select("conv", "conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back")))
    for k, jump in enumerate(rounds):
        more = paths.join(jump.select("conv", "node", "up"), ["conv", "node"])
        more = cut(more.select("conv", "conv_id", "leaf", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back")))
        paths = paths.unionByName(more)
    return paths.select("conv", "conv_id", "leaf", "back", F.col("node").alias("node_id"))


def format_conversations(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """conv_id, leaf, formatted text and loss spans, one row per chosen branch.

    messages(conv_id, node_id, parent_id, score, role, text) as in reply_paths; null texts
    and roles are empty. A conversation is one row of output, so its turns meet in one task:
    that task's memory is bounded by the longest conversation, which one string must hold.
    Very long texts are kept whole; other columns are dropped, whatever their names; repeated
    rows of a node count once; no rows give no rows.
    """
    paths = reply_paths(messages, branches)
    said = messages.where("node_id is not null").groupBy(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv"), "node_id").agg(F.min(F.struct(F.col("parent_id"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("x"))
    turns = paths.join(said, ["conv", "node_id"]).groupBy("conv", "conv_id", "leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), F.col("x.role").alias("role"), F.col("x.text").alias("text")))).alias("turns"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [render([(t["role"], t["text"]) for t in row]) for row in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in done], pa.string()), pa.array([[{"start": s, "end": e} for s, e in x[1]] for x in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["conv_id", "leaf", "formatted", "loss_spans"])

    return turns.select("conv_id", "leaf", "turns").mapInArrow(write, "conv_id long, leaf long, formatted string, loss_spans array<struct<start:long,end:long>>")


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Conversations of plain turns as trees: rows by turn (then role and text), each replying to the one before.

    Null turns come first; repeated rows are turns of their own; a null conv_id is a
    conversation; other columns are dropped; an empty table gives no rows. The rows of one
    conversation are numbered in one task, which sorts on disk where they are many.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", F.row_number().over(order).cast("long").alias("node_id")).select("*", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), F.lit(0.0).alias("score"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings say when read back: turns, loss text and lengths as counts and hashes.

    One row per row of formatted(conv_id, formatted, loss_spans), in which conv_id may be
    null; strings are read whole; other columns are dropped; no rows give no rows.
    """
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column(1).to_pylist(), b.column(2).to_pylist()
            turns = [parse(t) for t in texts]
            loss = ["".join(unescape(t[s["start"] : s["end"]]) for s in ss) for t, ss in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in turns], pa.int64()), pa.array([sha("".join(f"{r}\n{t}\n" for r, t in x)) for x in turns]), pa.array([len(x) for x in loss], pa.int64()), pa.array([sha(x) for x in loss]), pa.array([len(t) for t in texts], pa.int64())],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
