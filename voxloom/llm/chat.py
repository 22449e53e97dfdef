"""Chat formatting of reply trees, with DataFrame operations only.

Ancestors are found by self-joins of a jump table that doubles its stride, so a path of
length n takes log2(n) joins. Branches are ranked by the sum of their messages' scores,
the chosen leaves' paths are unrolled with the same tables, and each path is formatted
as one conversation with a loss mask over the assistant's texts.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside texts ``<``, any
backslashes and ``|`` get one backslash more, so no text holds a control string and the
escape is undone by taking one away; roles escape line ends in the same manner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

START, END = "<|im_start|>", "<|im_end|>\n"
_NULL = "\x00"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, r"<(\\*)([|n])", r"<\\$1$2"), F.lit("\n"), F.lit("<n"))


def unescape_role(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("<n"), F.lit("\n")), r"<\\(\\*)([|n])", r"<$1$2")


def reply_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(t, leaf, n, pos): the messages of each tree's ``top`` best branches, pos 0 at the root.

    ``nodes``: t, n, p (null at a root) and score. A parent that is not there makes its
    child a root; a null score counts 0; equal sums rank by leaf. Messages on a cycle, or
    below one, lie on no path from a root and are left out.
    """
    base = nodes.select("t", "n", "p", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("s"))
    known = base.select(F.col("t"), F.col("n").alias("p"))
    jumps, step = [], materialize(base.where("p is not null").join(known, ["t", "p"], "left_semi").select("t", "n", F.col("p").alias("a"), "s"), "chat-jump")
    most = base.groupBy("t").count().agg(F.max("count")).first()[0] or 0
    while step.limit(1).count():
        if 1 << len(jumps) >= max(2, most):  # no path is so long: what is left runs in circles
            base = base.join(step.select("t", "n"), ["t", "n"], "left_anti")
            break
        jumps.append(step)
        up = step.select("t", F.col("n").alias("a"), F.col("a").alias("b"), F.col("s").alias("s2"))
        step = materialize(step.join(up, ["t", "a"]).select("t", "n", F.col("b").alias("a"), (F.col("s") + F.col("s2")).alias("s")), "chat-jump")
    parents = base.where("p is not null").select("t", F.col("p").alias("n")).distinct()
    cur = base.join(parents, ["t", "n"], "left_anti").select("t", F.col("n").alias("leaf"), "n", F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("depth"))
    for k in range(len(jumps) - 1, -1, -1):
        j = jumps[k].select("t", "n", F.col("a").alias("to"), F.col("s").alias("more"))
        cur = cur.join(j, ["t", "n"], "left").select("t", "leaf", F.coalesce("to", "n").alias("n"), (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum"), (F.col("depth") + F.when(F.col("to").isNotNull(), F.lit(1 << k)).otherwise(F.lit(0))).alias("depth"))
    cur = cur.join(base.select("t", "n", "s"), ["t", "n"]).select("t", "leaf", (F.col("sum") + F.col("s")).alias("sum"), "depth")
    if top == 1:
        best = cur.groupBy("t").agg(F.min(F.struct((-F.col("sum")).alias("o"), "leaf", "depth")).alias("b")).select("t", "b.leaf", "b.depth")
    else:
        w = Window.partitionBy("t").orderBy(F.desc("sum"), "leaf")
        best = cur.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("t", "leaf", "depth")
    path = materialize(best, "chat-leaves").select("t", "leaf", F.col("leaf").alias("n"), F.col("depth").alias("pos"))
    for k, j in enumerate(jumps):
        on = path.join(j.select("t", "n", "a"), ["t", "n"]).select("t", "leaf", F.col("a").alias("n"), (F.col("pos") - (1 << k)).alias("pos"))
        path = materialize(path.union(on), "chat-path")
    return path


def format_paths(turns: DataFrame) -> DataFrame:
    """(t, leaf, n_turns, formatted, loss): loss holds (start, length) in code points of formatted.

    ``turns``: t, leaf, pos, role, text. Null roles and texts are empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    e = turns.select("t", "leaf", "pos", escape_role(role).alias("er"), escape(text).alias("et"), (role == "assistant").alias("bot"))
    e = e.select("t", "leaf", "pos", "bot", F.concat(F.lit(START), "er", F.lit("\n"), "et", F.lit(END)).alias("piece"), (F.length("er") + len(START) + 1).cast("long").alias("head"), F.length("et").cast("long").alias("size"))
    w = Window.partitionBy("t", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("at", F.coalesce(F.sum(F.length("piece").cast("long")).over(w), F.lit(0)) + F.col("head"))
    g = e.groupBy("t", "leaf").agg(F.array_sort(F.collect_list(F.struct("pos", "piece", "bot", "at", "size"))).alias("x"))
    return g.select(
        "t", "leaf", F.size("x").cast("long").alias("n_turns"), F.array_join(F.transform("x", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("x", lambda x: x["bot"]), lambda x: F.struct(x["at"].alias("start"), x["size"].alias("length"))).alias("loss"),
    )


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    split = F.split(formatted, r"<\|im_start\|>")
    pieces = F.slice(split, F.lit(2), F.size(split) - 1)
    one = lambda x: F.struct(
        unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
        unescape(F.replace(F.regexp_replace(x, r"^[^\n]*\n", ""), F.lit(END), F.lit(""))).alias("text"),
    )
    return F.transform(pieces, one)


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def format_trees(messages: DataFrame, tree: str, node: str, parent: str, score: str, role: str = "role", text: str = "text", top: int = 1) -> DataFrame:
    """One formatted conversation per chosen branch of each reply tree: t, leaf, n_turns, formatted, loss.

    Rows without a node are left out; rows without a tree form one tree; of rows that
    share tree and node the smallest (parent, score, role, text) counts. t is the tree's
    id as a string.
    """
    m = messages.where(F.col(node).isNotNull()).select(F.coalesce(F.col(tree).cast("string"), F.lit(_NULL)).alias("t"), F.col(node).alias("n"), F.struct(F.col(parent).alias("p"), F.col(score).alias("score"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")).alias("v"))
    one = materialize(m.groupBy("t", "n").agg(F.min("v").alias("v")).select("t", "n", "v.*"), "chat-nodes")
    path = reply_paths(one.select("t", "n", "p", "score"), top)
    out = format_paths(path.join(one.select("t", "n", "role", "text"), ["t", "n"]))
    return out.withColumn("t", F.nullif("t", F.lit(_NULL)))


def conversation_digest(rows: DataFrame) -> DataFrame:
    """Digests, read back from the output, of (conv_id, turn, role, text) rows formatted by conversation.

    A conversation's rows in the order of turn (null first), role and text are a chain,
    each the reply to the row before; equal rows are turns of their own. Null roles and
    texts are empty; rows without conv_id form one conversation.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(_NULL))
    w = Window.partitionBy("t").orderBy("turn", "role", "text")
    one = rows.select(key.alias("t"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    one = materialize(one.withColumn("n", F.row_number().over(w).cast("long")).select("t", "n", "role", "text"), "chat-nodes")
    path = reply_paths(one.select("t", "n", F.when(F.col("n") > 1, F.col("n") - 1).alias("p"), F.lit(0.0).alias("score")))
    out = format_paths(path.join(one, ["t", "n"]))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    out = out.select("t", "formatted", parse(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss")).alias("masked"))
    return out.select(
        F.nullif("t", F.lit(_NULL)).cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
