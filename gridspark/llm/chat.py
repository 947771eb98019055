"""Reply trees to conversations, with DataFrame operations only.

A forest of messages (tree, node, parent, role, text, score) becomes one conversation per chosen
root-to-leaf path. Paths are found by iterative self-joins that double the distance to the known
ancestor: a thread of d replies needs log2(d) joins, and each join is keyed by message, so a tree
that holds a third of all messages spreads over all tasks. Branches are ranked by the sum of their
messages' scores before any path is listed; only chosen paths are spelled out.

Defined results: a null text or role is empty, a null score 0; a message whose parent is missing,
null or itself starts a thread; messages on a cycle have no root and are left out; of rows with the
same tree and node the smallest (parent, role, text) stands; a null tree is a tree of its own;
branches of one score rank by node. An empty table gives no conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridspark.llm.common import table
from gridspark.session import materialize

# The template. Opening marks carry the role; closing marks end a turn.
OPEN = {"user": "[INST]", "system": "[SYS]", "assistant": "[OUT]"}
CLOSE = {"user": "[/INST]", "system": "[/SYS]", "assistant": "</s>"}
OTHER_OPEN, ROLE_END, OTHER_CLOSE = "[ROLE]", "[/ROLE]", "[/TURN]"
BEGIN = "<s>"
_NAMES = r"/?(?:INST\]|SYS\]|OUT\]|ROLE\]|TURN\]|s>)"
_ESCAPE = rf"([\[<])(\\*)({_NAMES})"
_UNESCAPE = rf"([\[<])\\(\\*)({_NAMES})"
_CLOSES = r"\[/INST\]|\[/SYS\]|</s>|\[/TURN\]"
_OPENS = r"^(?:\[INST\]|\[SYS\]|\[OUT\]|\[ROLE\])"


def escape(text: Column) -> Column:
    r"""Texts without control strings: each gets one more ``\`` after its bracket, so it reverses."""
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


# ---------------------------------------------------------------- trees


def _links(messages: DataFrame) -> DataFrame:
    """One row per node: tree key, node, parent inside the tree or null, role, text, score."""
    tree = F.coalesce(F.concat(F.lit("t"), F.col("tree").cast("string")), F.lit("null"))
    rows = messages.where(F.col("node").isNotNull()).select(
        tree.alias("key"),
        F.col("tree"),
        F.col("node").cast("long").alias("node"),
        F.when(F.col("parent") != F.col("node"), F.col("parent").cast("long")).alias("parent"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    one = rows.groupBy("key", "node").agg(
        F.first("tree").alias("tree"), F.min(F.struct("parent", "role", "text", "score")).alias("m")
    )
    rows = materialize(one.select("key", "tree", "node", "m.*"), "chat-nodes")
    known = rows.select("key", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    rows = rows.join(known, ["key", "parent"], "left")
    parent = F.when(F.col("_known"), F.col("parent"))
    return materialize(
        rows.select("key", "tree", "node", parent.alias("parent"), "role", "text", "score"),
        "chat-links",
    )


def _climb(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Root and total score of every node's path to it, and the ancestors 1, 2, 4, ... steps up."""
    # With nothing further up, root is the path's root.
    state = links.select("key", "node", F.col("parent").alias("up"), F.col("node").alias("root"), F.col("score").alias("total"))
    jumps, limit = [], 0
    while True:
        active = state.where("up IS NOT NULL")
        n = active.count()
        if not jumps:
            limit = max(1, n).bit_length() + 1  # no path is longer than the number of messages
        if n == 0 or len(jumps) >= limit:
            break
        jumps.append(active.select("key", "node", "up"))
        above = state.select(
            "key", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"), F.col("total").alias("total2")
        )
        moved = active.join(above, ["key", "up"]).select(
            "key", "node", F.col("up2").alias("up"), F.col("root2").alias("root"), (F.col("total") + F.col("total2")).alias("total")
        )
        state = materialize(state.where("up IS NULL").unionByName(moved), "chat-climb")
    return state.where("up IS NULL").select("key", "node", "root", "total"), jumps


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` best root-to-leaf paths of every root: one row per message on a path.

    Columns: tree, leaf, branch (rank from 1), branch_score, position (from 0 at the root), role,
    text.
    """
    links = _links(messages)
    totals, jumps = _climb(links)
    inner = links.where("parent IS NOT NULL").select("key", F.col("parent").alias("node")).distinct()
    leaves = totals.join(inner, ["key", "node"], "left_anti")
    order = Window.partitionBy("key", "root").orderBy(F.col("total").desc(), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= branches)
    path = chosen.select("key", F.col("node").alias("leaf"), "branch", "total", "node", F.lit(0).cast("long").alias("above"))
    for k in reversed(range(len(jumps))):
        higher = path.join(jumps[k], ["key", "node"]).select(
            "key", "leaf", "branch", "total", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above")
        )
        path = materialize(path.unionByName(higher), "chat-paths")
    depth = Window.partitionBy("key", "leaf")
    rows = path.withColumn("position", F.max("above").over(depth) - F.col("above")).drop("above")
    return rows.join(links.select("key", "tree", "node", "role", "text"), ["key", "node"]).select(
        "tree", "key", "leaf", "branch", F.col("total").alias("branch_score"), "position", "role", "text"
    )


# ---------------------------------------------------------------- template


def format_paths(paths: DataFrame) -> DataFrame:
    """One formatted conversation per path, with the spans of text a model should learn.

    Columns: tree, leaf, branch, branch_score, n_turns, formatted, loss_spans (array of start and
    end in code points, the escaped texts of assistant turns).
    """
    role = F.col("role")
    opening = F.lit("")
    closing = F.lit(OTHER_CLOSE)
    opening = F.concat(F.lit(OTHER_OPEN), escape(role), F.lit(ROLE_END))
    for name in OPEN:
        opening = F.when(role == name, F.lit(OPEN[name])).otherwise(opening)
        closing = F.when(role == name, F.lit(CLOSE[name])).otherwise(closing)
    turns = paths.select(
        "key", "tree", "leaf", "branch", "branch_score", "position",
        opening.alias("opening"), escape(F.col("text")).alias("body"), closing.alias("closing"),
        (role == "assistant").alias("loss"),
    )
    turns = turns.withColumn("piece", F.concat("opening", "body", "closing"))
    so_far = Window.partitionBy("key", "leaf").orderBy("position")
    end = F.lit(len(BEGIN)) + F.sum(F.length("piece").cast("long")).over(so_far)
    turns = turns.withColumn("stop", end - F.length("closing")).withColumn(
        "span", F.struct((F.col("stop") - F.length("body")).alias("start"), F.col("stop").alias("end"))
    )
    grouped = turns.groupBy("key", "leaf").agg(
        F.first("tree").alias("tree"),
        F.first("branch").alias("branch"),
        F.first("branch_score").alias("branch_score"),
        F.count(F.lit(1)).alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("position", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("loss"), F.col("span")))).alias("loss_spans"),
    )
    text = F.concat(F.lit(BEGIN), F.array_join(F.col("pieces.piece"), ""))
    return grouped.select("tree", "leaf", "branch", "branch_score", "n_turns", text.alias("formatted"), "loss_spans")


def parse_formatted(formatted: DataFrame) -> DataFrame:
    """The turns of formatted conversations: ``formatted``'s keys, turn, role, text, loss.

    ``loss`` tells whether the text is one of ``loss_spans``.
    """
    body = F.substring("formatted", len(BEGIN) + 1, 2**31 - 1)
    pieces = F.split(body, _CLOSES, -1)
    ends = F.regexp_extract_all("formatted", F.lit(f"({_CLOSES})"), 1)
    rows = formatted.select(
        F.xxhash64("tree", "leaf").alias("_id"), "tree", "leaf", "loss_spans",
        F.posexplode(F.arrays_zip(pieces.alias("piece"), ends.alias("mark"))).alias("turn", "z"),
    ).where("z.mark IS NOT NULL")
    piece = F.col("z.piece")
    # A raw opening mark can't occur inside a text, so the first mark of a piece is its own.
    other = piece.startswith(OTHER_OPEN)
    mark_length = F.when(other, F.instr(piece, ROLE_END) - 1 + len(ROLE_END)).otherwise(
        F.length(F.regexp_extract(piece, _OPENS, 0))
    )
    role = unescape(F.substring(piece, F.lit(len(OTHER_OPEN) + 1), mark_length - len(OTHER_OPEN) - len(ROLE_END)))
    for name in OPEN:
        role = F.when(piece.startswith(OPEN[name]), F.lit(name)).otherwise(role)
    so_far = Window.partitionBy("tree", "leaf").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("z.piece").cast("long") + F.length("z.mark")).over(so_far), F.lit(0))
    rows = rows.select(
        "*", role.alias("role"), mark_length.alias("_mark"), (before + len(BEGIN)).alias("_at")
    )
    start = F.col("_at") + F.col("_mark")
    raw = F.substring(piece, F.col("_mark") + 1, F.length(piece))
    rows = rows.select(
        "tree", "leaf", "turn", "role", unescape(raw).alias("text"), start.alias("start"), (start + F.length(raw)).alias("end"),
    )
    spans = formatted.select("tree", "leaf", F.explode("loss_spans").alias("s")).select(
        "tree", "leaf", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.lit(True).alias("loss")
    )
    keys = ("tree", "leaf", "start", "end")
    on = [rows[k].eqNullSafe(spans[k]) for k in keys]
    return rows.join(spans, on, "left").select(
        *[rows[k] for k in ("tree", "leaf", "turn", "role", "text", "start", "end")],
        F.coalesce("loss", F.lit(False)).alias("loss"),
    )


# ---------------------------------------------------------------- query

PROBE = "</s>[INST] ok [/INST]"


def threads(conversations: DataFrame) -> DataFrame:
    """Conversations as trees: each turn replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    rows = conversations.select("conv_id", "turn", "role", "text", node.alias("node"))
    return rows.select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role", "text", F.lit(0.0).alias("score"),
    )


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back from the formatted texts."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string"
    )
    done = materialize(format_paths(best_paths(threads(given.unionByName(probe)))), "chat-formatted")
    turns = parse_formatted(done)
    parts = turns.groupBy("tree").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("t")))).alias("all"),
        F.sort_array(F.collect_list(F.when(F.col("loss"), F.struct("turn", F.col("text").alias("t"))))).alias("learn"),
    )
    lengths = done.select(F.col("tree").alias("_tree"), F.length("formatted").cast("long").alias("formatted_chars"))
    loss = F.array_join(F.col("learn.t"), "")
    out = parts.join(lengths, F.col("tree").eqNullSafe(F.col("_tree")))
    return out.select(
        F.col("tree").alias("conv_id"),
        "n_turns",
        F.sha2(F.array_join(F.col("all.t"), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
