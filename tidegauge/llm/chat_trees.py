"""Reply trees as conversations.

Self-joins that double the distance to the ancestor list every root-to-leaf path; branches are
ranked by the sum of their scores; each chosen path becomes one conversation in a template that
marks turns, with a loss mask over what the assistant says.
"""
from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Window, functions as F

from tidegauge.session import persist_plan

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
UNNAMED = -(1 << 63)             # tree of the rows without a conv_id
PAIRS = {"\\\\": "\\", "\\|": "|", "\\n": "\n"}
TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + "\n", re.S)


def escape(text):
    """Text in which no control string can occur."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role):
    return escape(role).replace("\n", "\\n")


def unescape(text):
    return re.sub(r"\\[\\|n]", lambda m: PAIRS[m[0]], text)


def render(roles, texts):
    """The conversation and the ranges of its code points under the loss mask."""
    out, at, mask = [], 0, []
    for role, text in zip(roles, texts):
        head, body = OPEN + escape_role(role) + "\n", escape(text)
        if role == LEARNED:
            mask.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + CLOSE + "\n")
        at += len(out[-1])
    return "".join(out), mask


def parse(formatted):
    """Turns of a rendered conversation: pairs of role and text."""
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(formatted)]


def best_paths(nodes, top=1):
    """The best ``top`` root-to-leaf paths of every tree (all, if None): tree, leaf, rank, node, depth.

    ``nodes``: tree, node, parent, score. A parent that is null or missing makes a root; nodes
    that no root leads to are in no path. Scores add up, null as 0; ties go to the smaller leaf.
    """
    nodes = persist_plan(nodes.where("tree is not null and node is not null").groupBy("tree", "node").agg(
        F.min("parent").alias("parent"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score")))
    known = nodes.select("tree", F.col("node").alias("parent"))
    up = nodes.join(known, ["tree", "parent"]).where("parent <> node").select("tree", "node", "parent")
    up = persist_plan(up)
    inner = up.select("tree", F.col("parent").alias("node")).distinct()
    paths = nodes.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up"))
    roots = nodes.join(up, ["tree", "node"], "left_anti").select("tree", "node")
    deepest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    reach, hop = 1, up
    while reach < 2 * deepest and hop.limit(1).count():
        further = paths.join(hop, ["tree", "node"]).select("tree", "leaf", F.col("parent").alias("node"), (F.col("up") + reach).alias("up"))
        paths = persist_plan(paths.unionByName(further))
        hop = persist_plan(hop.join(hop.select("tree", F.col("node").alias("parent"), F.col("parent").alias("next")), ["tree", "parent"])
                           .select("tree", "node", F.col("next").alias("parent")))
        reach *= 2
    ends = paths.join(roots, ["tree", "node"], "left_semi").groupBy("tree", "leaf").agg(F.max("up").alias("length"))
    paths = persist_plan(paths.join(ends, ["tree", "leaf"]).where("up <= length").join(nodes.select("tree", "node", "score"), ["tree", "node"]))
    order = Window.partitionBy("tree").orderBy(F.col("total").desc(), "leaf")
    ranked = paths.groupBy("tree", "leaf").agg(F.sum("score").alias("total")).withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return paths.join(ranked, ["tree", "leaf"]).select("tree", "leaf", "rank", "node", (F.col("length") - F.col("up")).alias("depth"))


def _render(batches):
    for batch in batches:
        texts, masks = [], []
        for turns in batch.column("turns").to_pylist():
            text, mask = render([t["role"] for t in turns], [t["text"] for t in turns])
            texts.append(text)
            masks.append([{"from": a, "to": b} for a, b in mask])
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("tree", "leaf", "rank")), pa.array(texts, pa.string()), pa.array(masks, kind)],
                                         ["tree", "leaf", "rank", "formatted", "mask"])


def format_trees(nodes, top=1):
    """One conversation for each chosen path: tree, leaf, rank, formatted, mask.

    ``nodes``: tree, node, parent, score, role, text; other columns are ignored. Null roles and
    texts count as empty; of rows with the same node the least role and text stay. Only a path,
    never a whole tree, is gathered in one row. An empty table gives an empty result.
    """
    words = nodes.groupBy("tree", "node").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("said"))
    paths = best_paths(nodes.select("tree", "node", "parent", "score"), top).join(words, ["tree", "node"])
    turn = F.struct("depth", F.col("said.role").alias("role"), F.col("said.text").alias("text"))
    rows = paths.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return rows.mapInArrow(_render, "tree long, leaf long, rank int, formatted string, mask array<struct<from: long, to: long>>")


def _digest(batches):
    for batch in batches:
        rows = []
        for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("mask").to_pylist()):
            turns = parse(text)
            learned = "".join(unescape(text[m["from"]:m["to"]]) for m in mask)
            rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned),
                         hashlib.sha256(learned.encode()).hexdigest(), len(text)))
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("tree"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                         ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted):
    """What is read back from each conversation: digests of its turns and of its masked text."""
    found = formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return found.withColumn("conv_id", F.nullif("conv_id", F.lit(UNNAMED)))


def as_chains(conversations):
    """Conversations by turn as trees of one branch; turns of the same number go by role and text.

    Rows without a conv_id are one conversation, named UNNAMED as a tree; ``digests`` gives it
    its null back. Rows that repeat a turn all stay. Other columns are ignored.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    named = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(UNNAMED)).alias("tree"), "turn", "role", "text")
    rows = named.select("tree", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
                       F.lit(0.0).alias("score"), "role", "text")
