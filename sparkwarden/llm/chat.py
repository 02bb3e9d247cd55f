"""Chat formatting of reply trees.

A tree is rows of (tree, node, parent, role, text, score). Depths and branch scores come from self-joins with pointer
doubling: each round joins every node with the ancestor that it has reached so far, so a path of length n takes
log2(n) rounds, not n. Branches (root-to-leaf paths) are ranked by their summed score, and the rows of the chosen ones
are listed by walking the stored jumps down from the largest: every ancestor of a leaf is met exactly once.

The template marks a turn as "### role: text</turn>". A backslash before "###", "</turn>" or a backslash makes it
plain text, so a formatted conversation is read back exactly, whatever its texts hold.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwarden.llm.common import tidy, written

#: Levels of jumps that one plan walks down.
LEVELS = 4

OPEN, CLOSE = "### ", "</turn>"
_SPECIAL = re.compile(r"\\|###|</turn>|:")
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def escape(text: str, colon: bool = False) -> str:
    return _SPECIAL.sub(lambda m: m.group() if m.group() == ":" and not colon else "\\" + m.group(), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and the spans of the assistant's words in it (the loss mask)."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, True)}: ", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        piece = f"{head}{body}{CLOSE}\n"
        out.append(piece)
        at += len(piece)
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn. Anything but whole turns is an error."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    return turns


def branches(tree: DataFrame, best: int = 1) -> DataFrame:
    """(tree, branch, position, node) of the `best` highest-scored root-to-leaf paths of each tree, position from 0 at the root.

    tree: columns tree, node, parent (null: a root), score (null: 0), one row a node. Rows with a null node, and nodes
    whose parent is missing, count as absent and as roots. Of equal scores the smaller leaf comes first. Cycles have
    no root and give nothing.
    """
    base = tree.where(F.col("node").isNotNull()).select(F.struct("tree").alias("tree"), "node", "parent", "score")  # a struct equals its like, null inside or not
    base = base.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max(F.coalesce("score", F.lit(0.0))).alias("own"))
    base = written(base, "tree-nodes")
    known = base.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    linked = base.join(known, ["tree", "parent"], "left")
    up = F.when(F.col("there"), F.col("parent"))
    now = written(linked.select("tree", "node", up.alias("up"), F.col("own").alias("total"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("fresh")), "tree-jump")
    ended, jumps = [], []
    for _ in range(max(1, base.count()).bit_length() + 1):  # what is still open then hangs on a cycle
        tidy(base)  # the driver keeps nothing of past rounds
        done, open_ = now.where("up is null"), now.where("up is not null")
        ended.append(done.where("fresh").drop("fresh"))
        if open_.isEmpty():
            break
        jumps.append(open_.select("tree", "node", "up"))
        far = now.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("steps").alias("further"))
        joined = open_.join(far, ["tree", "up"])  # nodes that have reached their root are joined no more
        joined = joined.select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("steps") + F.col("further")).alias("steps"), F.lit(True).alias("fresh"))
        kept = done.withColumn("fresh", F.lit(False)).join(open_.select("tree").distinct(), "tree", "left_semi")  # trees without an open node are left behind
        now = written(joined.unionByName(kept), "tree-jump")
    done = reduce(DataFrame.unionByName, ended)
    inner = base.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = done.join(inner, ["tree", "node"], "left_anti")
    order = [F.desc("total"), F.col("node")]
    deal = F.pmod(F.xxhash64("node"), F.lit(64))  # a tree of very many leaves is ranked in parts first
    first = leaves.withColumn("place", F.row_number().over(Window.partitionBy("tree", deal).orderBy(*order))).where(F.col("place") <= best)
    chosen = first.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(*order))).where(F.col("branch") <= best)
    rows = chosen.select("tree", "branch", "node", (F.col("steps") - 1).alias("position"))
    for k in reversed(range(len(jumps))):
        here, there = F.struct("node", "position"), F.struct(F.col("up").alias("node"), (F.col("position") - F.lit(1 << k)).alias("position"))
        rows = rows.join(jumps[k], ["tree", "node"], "left").select("tree", "branch", F.explode(F.array(here, there)).alias("step"))
        rows = rows.where("step.node is not null").select("tree", "branch", "step.node", "step.position")
        if k and k % LEVELS == 0:
            rows = written(rows, "tree-paths")
            tidy(rows)
    return rows.select("tree.tree", "branch", "position", "node")


_DDL = "formatted string, mask array<struct<start:int,end:int>>, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_NAMES = ["formatted", "mask", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_MASK = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _format(batches):
    for b in batches:
        out = []
        for turns in b.column(1).to_pylist():
            formatted, mask = format_turns([(t["role"] or "", t["text"] or "") for t in turns])
            back = read_back(formatted)
            said = "".join(f"{role}\n{text}\n" for role, text in back)
            loss = "".join(unescape(formatted[s:e]) for s, e in mask)
            out.append((formatted, [{"start": s, "end": e} for s, e in mask], len(back), _sha(said), len(loss), _sha(loss), len(formatted)))
        kinds = [pa.string(), _MASK, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        cols = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["key", *_NAMES])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def format_trees(nodes: DataFrame, best: int = 1) -> DataFrame:
    """One formatted conversation per tree and chosen branch: tree, branch, formatted, mask, and what read_back() finds.

    nodes: tree, node, parent, role, text, score. Null roles and texts are empty; a conversation holds its own turns
    and no others, so a task holds one conversation at a time.
    """
    paths = branches(nodes, best).withColumn("tree", F.struct("tree"))
    said = nodes.where(F.col("node").isNotNull()).withColumn("tree", F.struct("tree")).groupBy("tree", "node").agg(F.min(F.struct("role", "text")).alias("turn"))
    turns = paths.join(said, ["tree", "node"]).select("tree", "branch", F.struct("position", "turn.role", "turn.text").alias("turn"))
    whole = turns.groupBy("tree", "branch").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    keyed = whole.select(F.struct("tree.tree", "branch").alias("key"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    kind = nodes.schema["tree"].dataType.simpleString()
    return keyed.mapInArrow(_format, f"key struct<tree:{kind},branch:int>, {_DDL}").select("key.tree", "key.branch", *_NAMES)


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees of one branch: each turn answers the one before it.

    Turns that repeat are told apart by role and text; exact repeats are turns of their own. A null turn comes first.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return numbered.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
