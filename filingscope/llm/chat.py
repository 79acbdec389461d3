"""Reply trees as training conversations: paths by iterative self-joins, branches ranked, each path one text.

Everything here is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filingscope.llm.store import save

#: Marks of the template.  A turn is TURN role \n text END; no escaped text holds a mark.
TURN, END, ROLE_BREAK = "<|turn|>", "<|end|>\n", "<|nl|>"
#: Control strings of common chat templates, as what follows their first bracket; a backslash put there disarms them.
CONTROL = r"(?:(?<=<)(?=\||/?s>|</?SYS>>|unk>|pad>|bos>|eos>|(?:start|end)_of_turn>)|(?<=\[)(?=/?INST\]))"
_ESCAPED = CONTROL.replace("(?=", r"\\(?=")


def escape(text: Column) -> Column:
    """Backslashes doubled, one more inside every control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _ESCAPED, ""), F.lit("\\\\"), F.lit("\\"))


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Ancestors 1, 2, 4, .. steps up of each node, and each node's totals up to its root.

    Each self-join doubles the steps, so a path of any length takes logarithmically many.
    """
    state = save(nodes.select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("gain"), F.lit(1).cast("long").alias("depth")), "climb")
    closed, climbing = state.filter("up IS NULL"), state.filter("up IS NOT NULL")
    steps, left = [], climbing.count()
    while left:  # nodes that have reached their root join no more
        steps.append(climbing.select("tree", "node", "up"))
        o = closed.unionByName(climbing).select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("gain").alias("gain2"), F.col("depth").alias("depth2"))
        state = save(climbing.join(o, ["tree", "up"]).select(
            "tree", "node", F.col("up2").alias("up"), (F.col("gain") + F.col("gain2")).alias("gain"), (F.col("depth") + F.col("depth2")).alias("depth")), "climb")
        closed, climbing = closed.unionByName(state.filter("up IS NULL")), state.filter("up IS NOT NULL")
        before, left = left, climbing.count()
        if before == left:  # only nodes on or below a cycle are left; they have no root
            break
    return steps, closed


def branches(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, above): the nodes of the ``keep`` best root-to-leaf paths of each tree.

    ``messages`` has tree, node, parent, score; node is unique in its tree.  A branch's score is the mean of its
    messages' scores, ties go to the smallest leaf.  A parent that isn't there makes a root.  Nodes on or below a cycle
    are on no path.  ``above`` counts the messages between a node and the leaf.
    """
    known = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    nodes = save(messages.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("there"), F.col("parent")).alias("parent"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), "nodes")
    steps, totals = _climb(nodes)
    inner = nodes.filter("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves = totals.join(inner, ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("gain") / F.col("depth")), "node"))
    paths = leaves.withColumn("rank", rank).filter(F.col("rank") <= keep).select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("above"))
    for k, step in enumerate(steps):
        paths = save(paths, "paths")
        up = paths.join(step, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        paths = paths.unionByName(up)
    return paths


def format_paths(paths: DataFrame, messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per path: tree, leaf, rank, formatted, spans.

    ``spans`` are (start, length) in code points, from 0, of the escaped texts of ``learn`` turns: the loss mask.
    A null role or text is empty.
    """
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    shown = F.replace(escape(role), F.lit("\n"), F.lit(ROLE_BREAK))
    turns = messages.select("tree", "node", F.concat(F.lit(TURN), shown, F.lit("\n")).alias("head"), text.alias("body"), (role == learn).alias("learnt"))
    turns = paths.join(turns, ["tree", "node"]).withColumn("segment", F.concat("head", "body", F.lit(END)))
    path = Window.partitionBy("tree", "leaf").orderBy(F.desc("above"))
    start = F.sum(F.length("segment")).over(path) - F.length("segment") + F.length("head")
    placed = turns.select("tree", "leaf", "rank", "above", "segment", "learnt", start.alias("start"), F.length("body").alias("length"))
    rows = placed.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("above")).alias("at"), "segment", "learnt", "start", "length"))).alias("turns"))
    return rows.select(
        "tree", "leaf", "rank", F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("spans"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    ends = F.split(formatted, r"<\|end\|>\n")
    line = lambda t: F.locate("\n", t)
    return F.transform(F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))), lambda t: F.struct(
        unescape(F.replace(F.substring(t, F.lit(len(TURN) + 1), line(t) - len(TURN) - 1), F.lit(ROLE_BREAK), F.lit("\n"))).alias("role"),
        unescape(F.substring(t, line(t) + 1, F.length(t))).alias("text")))


def chains(rows: DataFrame) -> DataFrame:
    """Rows of flat conversations (conv_id, turn, role, text) as trees without branches.

    A turn answers the one before it; rows with the same turn follow each other by role and text.  Null ids are one
    conversation.
    """
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    return rows.select("conv_id", "turn", "role", "text").withColumn("node", at).select(
        "conv_id", tree.alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, spans of each conversation in ``rows`` (conv_id, turn, role, text), as a written table."""
    messages = save(chains(rows), "messages")
    out = format_paths(branches(messages), messages)
    return save(out.select(F.when(F.col("tree") != "", F.col("tree")).cast("long").alias("conv_id"), "formatted", "spans"), "formatted")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from the formatted texts and masks."""
    turns = F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    loss = F.array_join(learnt, "")
    return formatted.select(
        "conv_id", F.size(parse(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
