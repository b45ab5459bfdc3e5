"""Chat formatting of reply trees.

Messages name their parent. Iterative self-joins double what is known of a message's ancestors: after k rounds a message
knows the ancestor 2**k above it and the sum of scores up to there, so trees as deep as d take log2(d) rounds. Leaves are
ranked within their tree by their branch's score; from each chosen leaf the same jumps, taken from the longest to the
shortest, enumerate its branch, twice as many messages a round, and the branch becomes one conversation.

The template writes a turn as

    ### role :
    text
    </turn>

Control strings inside texts and roles, and the escape sign itself, get a backslash before them: reversible, as every
backslash in an escaped text escapes the sign after it. No escaped text holds a line end followed by </turn>, nor an
escaped role a blank followed by a colon. The loss mask has the spans of assistant texts, in code points.

Defined cases. Null role or text: empty. Null score: 0. Null tree: a tree of its own. A message whose parent is null or
absent is a root. Messages of a ring have no root, so lie on no root-to-leaf path and appear in none. Messages that repeat
(tree, message): the first by (parent, role, text) stands for them; messages without an id of their own are told apart by
conversations_of(), where each row is a message. Equal scores: the smaller leaf id first. An empty table gives an empty
table. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

OPEN, ROLE_END, CLOSE = "### ", " :\n", "\n</turn>\n"
LEARNT_ROLE = "assistant"


def escaped(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in ("###", "</turn>"):
        text = F.replace(text, F.lit(control), F.lit("\\" + control))
    return text


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\:"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def template(turns: Column) -> Column:
    """turns: array of struct(role, text). A struct of the formatted text and the loss mask's spans [start, end)."""
    pieces = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(OPEN), escaped_role(t["role"]), F.lit(ROLE_END)).alias("head"), escaped(t["text"]).alias("body"),
        F.coalesce(t["role"] == LEARNT_ROLE, F.lit(False)).alias("learnt"),
    ))
    formatted = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def add(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(CLOSE)).alias("at"), F.when(p["learnt"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.struct(formatted.alias("formatted"), F.aggregate(pieces, start, add)["spans"].alias("loss_spans"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct(role, text)."""
    # the last part is what follows the last turn: nothing
    parts = F.filter(F.split(formatted, r"\n</turn>\n", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.instr(p, ROLE_END)
        role = F.substring(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(p, at + len(ROLE_END), F.length(p))).alias("text"))

    return F.transform(parts, turn)


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def branches(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """tree, leaf, score, rank, pos (0 at the root), message: the best `top` root-to-leaf paths of each tree (all: None).

    messages: tree, message, parent, score; (tree, message) is unique.
    """
    ids = messages.select("tree", "message", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    here = ids.select(F.col("tree").alias("_t"), F.col("message").alias("_m"))
    linked = ids.join(here, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_m")), "left")
    ids = linked.select("tree", "message", F.col("_m").alias("up"), "score")
    # jumps[k]: up is the ancestor 2**k above; sum and depth cover the messages from here to below it
    jumps = [cut(ids.withColumn("sum", F.col("score")).withColumn("depth", F.lit(1)).drop("score"))]
    rounds = (jumps[0].count() + 1).bit_length()
    while len(jumps) <= rounds and jumps[-1].where("up is not null").limit(1).count():
        last = jumps[-1]
        above = last.select(F.col("tree").alias("_t"), F.col("message").alias("_m"), F.col("up").alias("_up"), F.col("sum").alias("_sum"), F.col("depth").alias("_depth"))
        # messages that have met their root are done
        further = last.where("up is not null").join(above, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("up") == F.col("_m"))).select(
            "tree", "message", F.col("_up").alias("up"), (F.col("sum") + F.col("_sum")).alias("sum"), (F.col("depth") + F.col("_depth")).alias("depth"),
        )
        jumps.append(cut(further.unionByName(last.where("up is null").select(*further.columns))))
    parents = jumps[0].where("up is not null").select(F.col("tree").alias("_t"), F.col("up").alias("_m"))
    leaves = jumps[-1].where("up is null").join(parents, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("message") == F.col("_m")), "left_anti")
    leaves = leaves.select("tree", F.col("message").alias("leaf"), F.col("sum").alias("score"), "depth")
    order = Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf")
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    walk = cut(ranked.withColumn("message", F.col("leaf")).withColumn("pos", F.col("depth") - 1).drop("depth"))
    for k in reversed(range(len(jumps) - 1)):
        step = jumps[k].where("up is not null").select(F.col("tree").alias("_t"), F.col("message").alias("_m"), "up")
        more = walk.join(step, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("message") == F.col("_m")))
        more = more.select("tree", "leaf", "score", "rank", F.col("up").alias("message"), (F.col("pos") - (1 << k)).alias("pos"))
        walk = cut(walk.unionByName(more))  # else the plan doubles each time
    return walk


def format_trees(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """tree, leaf, rank, score, n_turns, formatted, loss_spans: each chosen branch as one conversation.

    messages: tree, message, parent, score, role, text.
    """
    first = messages.groupBy("tree", "message").agg(F.min(F.struct(
        F.col("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("_m"))
    first = first.where("message is not null").select("tree", "message", "_m.*")
    paths = branches(first, top)
    says = first.select(F.col("tree").alias("_t"), F.col("message").alias("_m"), "role", "text")
    said = paths.join(says, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("message") == F.col("_m")))
    turns = F.sort_array(F.collect_list(F.struct("pos", "role", "text")))
    grouped = said.groupBy("tree", "leaf", "rank", "score").agg(turns.alias("_turns"))
    made = grouped.withColumn("_made", template(F.col("_turns")))
    return made.select("tree", "leaf", "rank", "score", F.size("_turns").cast("long").alias("n_turns"), "_made.formatted", "_made.loss_spans")


def conversations_of(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages, each answering the row before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("message"), "role", "text").select(
        "tree", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"
    )


def read_back(made: DataFrame) -> DataFrame:
    """Of format_trees()' output, read from formatted and loss_spans alone: conv_id, n_turns and digests of the turns and
    of the text under the loss mask."""
    read = made.select(
        F.col("tree").alias("conv_id"), parsed(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
