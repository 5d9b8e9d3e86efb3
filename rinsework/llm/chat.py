"""Chat formatting of reply trees.

Messages form trees: a message replies to a parent in the same tree. Branches (root-to-leaf paths) are enumerated by
pointer doubling: self-joins over jumps of 1, 2, 4, … replies, so that a thread of a million replies takes twenty joins.
Each leaf ends with the length and total score of its path; branches are ranked by mean score, and the messages of each
chosen path are found by walking the stored jumps back. Joins carry numbers; texts are joined once, for chosen paths.

Marks: user ``[INST] … [/INST]``, assistant ``<s>…</s>``, system ``<<SYS>>…<</SYS>>``, any other role
``<|role|>…<|end|>``. Inside texts a backslash precedes ``\\``, ``[`` and ``<`` (and ``|`` in role names), so no mark can
appear there, and dropping it restores the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinsework.session import Staging

MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("<|", "|>", "<|end|>")
_TURN = re.compile(
    r"\[INST\] (?P<user>(?:[^\\\[]|\\.)*?) \[/INST\]|<<SYS>>(?P<system>(?:[^\\<]|\\.)*)<</SYS>>"
    r"|<s>(?P<assistant>(?:[^\\<]|\\.)*)</s>|<\|(?P<role>(?:[^\\|]|\\.)*)\|>(?P<other>(?:[^\\<]|\\.)*)<\|end\|>",
    re.DOTALL,
)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[<])", r"\\$1")


def formatted_turn(role: Column, text: Column) -> Column:
    """A message with its marks."""
    name = F.regexp_replace(role, r"([\\\[<|])", r"\\$1")
    turn = F.concat(F.lit(OTHER[0]), name, F.lit(OTHER[1]), escaped(text), F.lit(OTHER[2]))
    for known, (before, after) in MARKS.items():
        turn = F.when(role == known, F.concat(F.lit(before), escaped(text), F.lit(after))).otherwise(turn)
    return turn


def turns_of(conversation: str) -> list[tuple[str, str]]:
    """The roles and texts that a formatted conversation was made from."""
    found, at = [], 0
    while at < len(conversation):
        m = _TURN.match(conversation, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        kind = m.lastgroup
        role = _ESCAPE.sub(r"\1", m["role"]) if kind == "other" else kind
        found.append((role, _ESCAPE.sub(r"\1", m[kind])))
        at = m.end()
    return found


def branches(messages: DataFrame, staging: Staging, top: int = 1) -> DataFrame:
    """``(tree, leaf, node, place)``: the messages of the ``top`` best branches of each tree, ``place`` from 0 at the root.

    ``messages (tree, node, parent, score)``: ``node`` is unique within its tree, ``parent`` is null at a root; a parent
    that doesn't exist makes a root too. Branches rank by mean score (null counts as 0), then by longer path, then by
    smaller leaf. A null tree is a tree. Nodes of a cycle have no root and are in no branch.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    here = nodes["tree"].eqNullSafe(known["_t"]) & (nodes["parent"] == known["_n"])
    # a jump table holds, for each node, the ancestor so many replies above, and the sum of scores passed on the way
    first = nodes.join(known, here, "left").select("tree", "node", F.col("_n").alias("up"), "score", F.lit(1).cast("long").alias("steps"))
    jumps, settled, left = [staging.write(first, "jump-0")], [], None
    while True:
        state = jumps[-1]
        waiting = state.where("up IS NOT NULL")
        count = waiting.count()
        if not count or count == left:  # what still points up is on a cycle, or hangs from one
            settled.append(state)
            break
        left = count
        # trees whose nodes have all arrived take no part in later rounds, which only the longest threads need
        live = waiting.select(F.col("tree").alias("_t")).distinct().withColumn("live", F.lit(True))
        marked = state.join(live, state["tree"].eqNullSafe(live["_t"]), "left").drop("_t")
        marked = staging.write(marked, f"marked-{len(jumps)}")
        settled.append(marked.where("live IS NULL").drop("live"))
        active = marked.where("live").drop("live")
        near, arrived = active.where("up IS NOT NULL"), active.where("up IS NULL")
        far = active.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"),
                            F.col("score").alias("_s"), F.col("steps").alias("_k"))
        met = near.join(far, near["tree"].eqNullSafe(far["_t"]) & (near["up"] == far["_n"])).select(
            "tree", "node", F.col("_up").alias("up"), (F.col("score") + F.col("_s")).alias("score"),
            (F.col("steps") + F.col("_k")).alias("steps"))
        jumps.append(staging.write(met.union(arrived), f"jump-{len(jumps)}"))
    rooted = reduce(DataFrame.union, settled).where("up IS NULL")
    parents = nodes.where("parent IS NOT NULL").select(F.col("tree").alias("_t"), F.col("parent").alias("_n")).distinct()
    leaves = rooted.join(parents, rooted["tree"].eqNullSafe(parents["_t"]) & (rooted["node"] == parents["_n"]), "left_anti")
    rank = Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("steps")), F.desc("steps"), "node")
    chosen = leaves.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= top)
    found = chosen.select("tree", F.col("node").alias("leaf"), "node", (F.col("steps") - 1).alias("place"))
    for k in range(len(jumps) - 1, -1, -1):
        jump = jumps[k].where("up IS NOT NULL").select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "up")
        further = found.join(jump, found["tree"].eqNullSafe(jump["_t"]) & (found["node"] == jump["_n"])).select(
            "tree", "leaf", F.col("up").alias("node"), (F.col("place") - 2**k).alias("place"))
        found = staging.write(found.union(further), f"path-{k}")
    return found


def conversations(messages: DataFrame, staging: Staging, top: int = 1) -> DataFrame:
    """``(tree, leaf, formatted, loss_spans)`` for the best branches of each tree.

    ``messages (tree, node, parent, role, text, score)`` as :func:`branches` takes them; null roles and texts are empty.
    ``loss_spans`` are the ranges of code points of ``formatted`` that hold assistants' (escaped) texts, end exclusive.
    """
    texts = messages.select(F.col("tree").alias("_t"), F.col("node").alias("_n"),
                            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    path = branches(messages, staging, top)
    full = path.join(texts, path["tree"].eqNullSafe(texts["_t"]) & (path["node"] == texts["_n"]))
    turns = full.select("tree", "leaf", "place", formatted_turn(F.col("role"), F.col("text")).alias("turn"), (F.col("role") == "assistant").alias("trained"))
    upto = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("upto", F.sum(F.length("turn")).over(upto))
    rows = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("place", "turn", "trained", "upto"))).alias("t"))
    before, after = (len(x) for x in MARKS["assistant"])
    spans = F.expr(
        "transform(filter(t, x -> x.trained), x -> "
        f"struct(cast(x.upto - length(x.turn) + {before} AS int) AS start, cast(x.upto - {after} AS int) AS end))")
    return rows.select("tree", "leaf", F.array_join("t.turn", "").alias("formatted"), spans.alias("loss_spans"))


def chains(rows: DataFrame) -> DataFrame:
    """Conversations given as turns, as trees: every turn replies to the one before.

    Turns of one number are ordered by role and text, nulls first.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return placed.select(F.col("conv_id").cast("long").alias("tree"), "node",
                         F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for formatted, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            turns = turns_of(formatted)
            loss = "".join(_ESCAPE.sub(r"\1", formatted[s["start"] : s["end"]]) for s in spans)
            digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{r}\n{t}\n" for r, t in turns), loss)]
            out.append((len(turns), digest[0], len(loss), digest[1], len(formatted)))
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[n for n, _ in _DIGESTS])


_DIGESTS = (("conv_id", "long"), ("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"),
            ("loss_sha256", "string"), ("formatted_chars", "long"))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations ``(tree, formatted, loss_spans)``, read back from their text alone.

    A null tree stays null, and large numbers of trees stay exact beside it; equal rows are digested each; an empty table gives
    an empty result; a text that isn't formatted raises ``ValueError``. Other columns aren't read.
    """
    return formatted.select(F.col("tree").cast("long").alias("tree"), "formatted", "loss_spans").mapInArrow(
        _read_back, ", ".join(f"{n} {k}" for n, k in _DIGESTS))
