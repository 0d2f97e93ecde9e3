"""Reply trees and chat formatting, by DataFrame operations only.

Messages with parents form trees. Self-joins with doubling (a message's ancestor 1, 2, 4, ... replies up) find the roots and,
from every leaf, its path; so a thread of n replies takes log n joins. A tree's branches are ranked by the sum of their
messages' scores, and each chosen path is written as one conversation with a loss mask.

Template: `<|role|>text</s>` for each turn. Inside texts and roles, a control string (`<|`, `|>`, `</s>`, `[INST]`,
`[/INST]`) gets a backslash after its first character, and one that already has backslashes gets one more; so no control
string is left inside a text, and taking one away restores it. The loss mask is a list of [start, end) code point ranges.

Cases: null text and null role are empty. A parent that is missing makes its message a root; messages on a cycle have no path
from a root and take no part. A null tree is a tree of its own. Rows that repeat a turn stand in the order (role, text).
Ties in score go to the smaller leaf. An empty table gives an empty result. One conversation is one row of the result, so its
turns meet in one task; nothing else does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import cut

#: Where an escape goes, before what follows it in a control string.
ESCAPE = r"(<)(\\*)(?=\||/s>)|(\|)(\\*)(?=>)|(\[)(\\*)(?=/?INST\])"
UNESCAPE = r"(<)\\(\\*)(?=\||/s>)|(\|)\\(\\*)(?=>)|(\[)\\(\\*)(?=/?INST\])"
END = "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit(r"$1$3$5\\$2$4$6"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE), F.lit("$1$3$5$2$4$6"))


def ancestors(links: DataFrame) -> list[DataFrame]:
    """For (tree, id, parent): tables (tree, id, up), the k-th with the message 2^k replies above, as far as there is one."""
    steps, count = [], None
    up = links.filter(F.col("parent").isNotNull()).select("tree", "id", F.col("parent").alias("up"))
    while True:
        up = cut(up)
        n = up.count()
        if n == 0 or n == count:  # n stays only when what is left runs in cycles
            return steps
        steps.append(up)
        count = n
        above = up.select("tree", F.col("id").alias("up"), F.col("up").alias("next"))
        up = up.join(above, ["tree", "up"]).select("tree", "id", F.col("next").alias("up"))


def paths(links: DataFrame) -> DataFrame:
    """(tree, leaf, id, above): every message on the path from a root to each leaf; above counts replies up from the leaf."""
    present = links.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there"))
    links = cut(links.join(present, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("there"), F.col("parent")).alias("parent")))
    steps = ancestors(links)
    inner = links.filter("parent is not null").select("tree", F.col("parent").alias("id")).distinct()
    rows = links.join(inner, ["tree", "id"], "left_anti").select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("above"))
    for k in reversed(range(len(steps))):
        more = rows.join(steps[k], ["tree", "id"]).select("tree", "leaf", F.col("up").alias("id"), (F.col("above") + 2**k).alias("above"))
        rows = cut(rows.unionByName(more))  # else the plan doubles too
    return rows


def conversations(messages: DataFrame, branches: int | None = 1, links: DataFrame | None = None) -> DataFrame:
    """The `branches` best paths of each tree (None: all) as conversations.

    messages: tree, id, parent, role, text, score. Result: tree, leaf, rank, branch_score, formatted, loss_mask.
    links: the same tree, id, parent where they can be had without moving texts (`chain_links`)."""
    messages = messages.select("tree", "id", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    on_path = paths(messages.select("tree", "id", "parent") if links is None else links)
    scored = on_path.join(messages.select("tree", "id", "score"), ["tree", "id"]).groupBy("tree", "leaf").agg(F.sum("score").alias("branch_score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf"))
    chosen = scored.withColumn("rank", rank)
    if branches is not None:
        chosen = chosen.filter(F.col("rank") <= branches)
    turn = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>")).alias("head")
    parts = messages.select("tree", "id", "role", turn, escape(F.col("text")).alias("body"))
    told = on_path.join(chosen, ["tree", "leaf"]).join(parts, ["tree", "id"])
    turns = told.groupBy("tree", "leaf", "rank", "branch_score").agg(F.sort_array(F.collect_list(F.struct((-F.col("above")).alias("at"), "role", "head", "body"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(acc, t):
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        own = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["mask"], own)).otherwise(acc["mask"]).alias("mask"))

    mask = F.aggregate("turns", start, step, lambda acc: acc["mask"])
    return turns.select("tree", "leaf", "rank", "branch_score", formatted.alias("formatted"), mask.alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, unescaped."""
    parts = F.split(formatted, END)
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda p: F.struct(unescape(F.regexp_extract(p, r"(?s)^<\|(.*?)\|>", 1)).alias("role"), unescape(F.regexp_replace(p, r"(?s)^<\|.*?\|>", "")).alias("text")),
    )


def read_loss(formatted: Column, mask: Column) -> Column:
    """The texts under a loss mask, unescaped and joined."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["end"] - m["start"]))), "")


def _tree(tree_col: str) -> Column:
    return F.coalesce(F.col(tree_col).cast("string"), F.lit("")).alias("tree")


def chain_links(table: DataFrame, tree_col="conv_id") -> DataFrame:
    """(tree, id, parent) of `chain`, from the number of rows of each tree alone."""
    counts = table.groupBy(_tree(tree_col)).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select("tree", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("id"))
    return rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"))


def chain(table: DataFrame, tree_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """A table of linear conversations as reply trees: each row answers the one before it."""
    rows = table.select(_tree(tree_col), F.col(turn_col).alias("t"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("id", F.row_number().over(Window.partitionBy("tree").orderBy("t", "role", "text")).cast("long"))
    return rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.length("text").alias("score"))
