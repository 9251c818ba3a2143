"""Chat formatting: reply trees, branches ranked by score, one conversation for each chosen path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, unstash

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """text without `<|`; reversible, see unescape."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def branches(messages: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """(tree, leaf, node, back) of the chosen root-to-leaf paths of messages (tree, node, parent, score); back is the distance from the leaf.

    Iterated self-joins: pointers to the parent are doubled until none reaches further, then each leaf's path is filled
    in from the farthest pointers down, every ancestor once. Rounds grow with the logarithm of the depth, rows with the
    lengths of the paths. A tree's branches rank by the mean score of their messages (null: 0), ties by smaller leaf;
    the first per_tree are taken (all, if None). Of rows that repeat (tree, node) the least by parent (null first) and score
    counts; rows with a null node are left out. A parent that is missing makes a root; messages that never reach one, as
    their parents form a cycle, are in no path. tree may be null. An empty table gives an empty one.
    """
    same = lambda a, b, k: F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")) & (F.col(f"{a}.{k}") == F.col(f"{b}.node"))
    least = F.min(F.struct("parent", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("m")
    base = stash(messages.filter("node is not null").groupBy("tree", "node").agg(least).select("tree", "node", "m.*"))
    most = base.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    up = base.filter("parent is not null").alias("a").join(base.select("tree", "node").alias("b"), same("a", "b", "parent"), "left_semi").select("tree", "node", F.col("parent").alias("to"))
    jumps = [stash(up)]
    while 1 << (len(jumps) - 1) <= most and not jumps[-1].isEmpty():
        last = jumps[-1]
        jumps.append(stash(last.alias("a").join(last.alias("b"), same("a", "b", "to")).select("a.tree", "a.node", F.col("b.to").alias("to"))))
    # A pointer farther than a tree has messages goes round a cycle.
    endless = jumps[-1].select("tree", "node")
    inner = jumps[0].select("tree", F.col("to").alias("node"))
    leaves = base.alias("a").join(inner.alias("b"), same("a", "b", "node"), "left_anti").select("tree", "node")
    paths = leaves.alias("a").join(endless.alias("b"), same("a", "b", "node"), "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    for k in range(len(jumps) - 2, -1, -1):
        both = paths.alias("a").join(jumps[k].alias("b"), same("a", "b", "node"), "left").select("a.tree", "a.leaf", F.col("a.node"), "a.back", "b.to")
        steps = F.array(F.struct("node", "back"), F.struct(F.col("to").alias("node"), (F.col("back") + 2**k).alias("back")))
        paths = both.select("tree", "leaf", F.explode(steps).alias("s")).select("tree", "leaf", "s.*").filter("node is not null")
    if per_tree is None:
        return paths
    paths = stash(paths)
    scores = paths.alias("a").join(base.alias("b"), same("a", "b", "node")).groupBy("a.tree", "a.leaf").agg(F.avg("b.score").alias("score"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    best = scores.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_tree).select("tree", "leaf")
    unstash(*jumps[1:])
    return paths.alias("a").join(best.alias("b"), F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.leaf") == F.col("b.leaf")), "left_semi")


def linear(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages of conversations without branches: each turn answers the one before.

    Turns that tie go by role and text, nulls first; equal rows follow each other. A null conversation is one like others.
    """
    order = Window.partitionBy(conv).orderBy(turn, "role", "text")
    rows = conversations.select(F.col(conv).alias("tree"), F.row_number().over(order).cast("long").alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def format_chats(messages: DataFrame, per_tree: int | None = 1, learn: str = "assistant") -> DataFrame:
    """One row for each chosen path of messages (tree, node, parent, score, role, text): tree, leaf, formatted, mask.

    Each turn is START role newline text END. Control strings inside roles and texts are escaped so that they can be read
    back. mask holds, in order, where each text of the role `learn` starts in `formatted` (from 1) and its length. Null
    roles and texts count as empty; of rows that repeat (tree, node) the least counts; an empty table gives an empty one. A path is one row: its turns meet in one task, no other rows do.
    """
    whole = F.struct("parent", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stash(messages.filter("node is not null").groupBy("tree", "node").agg(F.min(whole).alias("m")).select("tree", "node", "m.*"))
    paths = branches(rows, per_tree)
    full = paths.alias("a").join(rows.alias("b"), F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.node") == F.col("b.node"))).select("a.tree", "a.leaf", "a.back", "b.role", "b.text")
    turn = F.struct((-F.col("back")).alias("at"), escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == learn).alias("loss"))
    chats = full.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(part(F.concat(F.lit(START), t["role"], F.lit("\n")), F.lit(False)), part(t["text"], t["loss"]), part(F.lit(END), F.lit(False)))))
    chats = chats.select("tree", "leaf", segments.alias("segments"))
    chats = chats.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    # Segments as (start, length, loss), and of these the ones to learn from.
    start = F.struct(F.lit(1).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)").alias("mask"))

    def step(done: Column, s: Column) -> Column:
        n = F.length(s["text"]).cast("long")
        one = F.array(F.struct(done["at"].alias("start"), n.alias("length")))
        return F.struct((done["at"] + n).alias("at"), F.when(s["loss"], F.concat(done["mask"], one)).otherwise(done["mask"]).alias("mask"))

    return chats.select("tree", "leaf", "formatted", F.aggregate("segments", start, step, lambda done: done["mask"]).alias("mask"))


def masked(formatted: Column, mask: Column) -> Column:
    """The texts under a mask, unescaped, one behind the other."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"].cast("int"), m["length"].cast("int")))), "")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, array<struct<role, text>>."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.greatest(F.size(F.split(formatted, r"<\|im_start\|>")) - 1, F.lit(0)))

    def read(part: Column) -> Column:
        head = F.instr(part, "\n")
        body = F.substring(part, head + 1, F.length(part) - head - len(END))
        return F.struct(unescape_role(F.substring(part, F.lit(1), head - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, read)
