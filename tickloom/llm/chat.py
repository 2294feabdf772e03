"""Reply trees to training conversations, with DataFrame functions only.

Messages name their parent. Iterated self-joins double the step to an ancestor, so a chain of n messages takes
log2(n) of them, and enumerate the root-to-leaf path of every leaf. Branches of a tree are ranked by score,
and each chosen path is written as one text.

The template, per turn: ``### <role>:`` newline, the text, ``</turn>`` newline. In roles and texts a backslash is doubled,
``###`` becomes ``\\###`` and ``</turn>`` becomes ``<\\/turn>``, and in roles a new line gets a backslash too, so the marks occur only as marks and reading
back removes one backslash before any character.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import stored

OPEN, MIDDLE, CLOSE = "### ", ":\n", "</turn>\n"


def escape(text: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ("###", "\\###"), ("</turn>", "<\\/turn>")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _meet(left: DataFrame, right: DataFrame, id: str, how: str = "inner") -> DataFrame:
    """Join on tree_id, where null equals null, and an id of the tree; both named once."""
    right = right.withColumnsRenamed({"tree_id": "_tree", id: "_id"})
    return left.join(right, F.col("tree_id").eqNullSafe(F.col("_tree")) & (F.col(id) == F.col("_id")), how).drop("_tree", "_id")


def paths(messages: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, msg_id, up): a row for each message of each root-to-leaf path, ``up`` steps above the leaf.

    ``messages`` has tree_id, msg_id, parent_id (null, or an id that does not exist: a root). Ids are unique in a tree;
    a message without one has no path. Messages with a null tree_id are a tree like any other.
    Table k of the self-joins names the ancestor 2 ** k steps above; each step of a path is reached once, by the
    binary digits of its distance, so the rows joined are those of the result. A branch below a cycle has no root and no path.
    """
    ids = messages.select("tree_id", "msg_id", "parent_id")
    known = ids.select("tree_id", F.col("msg_id").alias("parent_id")).distinct()
    jumps = [stored(_meet(ids, known, "parent_id").select("tree_id", "msg_id", F.col("parent_id").alias("above")))]
    many = ids.count()
    while not jumps[-1].isEmpty() and 1 << (len(jumps) - 1) <= many:
        far = jumps[-1].withColumnRenamed("above", "next").withColumnRenamed("msg_id", "above")
        jumps.append(stored(_meet(jumps[-1], far, "above").select("tree_id", "msg_id", F.col("next").alias("above"))))
    parents = jumps[0].select("tree_id", F.col("above").alias("msg_id")).distinct()
    endless = jumps[-1].select("tree_id", "msg_id")
    leaves = _meet(_meet(ids, parents, "msg_id", "left_anti"), endless, "msg_id", "left_anti")
    rows = leaves.select("tree_id", F.col("msg_id").alias("leaf_id"), "msg_id", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(jumps) - 1)):
        rows = stored(rows)
        rows = rows.union(_meet(rows, jumps[k], "msg_id").select(
            "tree_id", "leaf_id", F.col("above").alias("msg_id"), F.col("up") + (1 << k)))
    return rows


def conversations(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree_id, leaf_id, score, n_turns, formatted, loss_spans, and with ``best`` rank) for each chosen path.

    ``messages``: tree_id, msg_id, parent_id, role, text, score. Null roles and texts are empty, null scores 0.
    Branches of a tree rank by mean score of their messages, ties to the smaller leaf_id; ``best`` keeps that
    many of each tree, None all. A null tree_id is a tree of its own and comes out as null.
    loss_spans are (start, length) in code points of the formatted text: the escaped text of each
    assistant turn. Other columns are ignored.
    """
    steps = paths(messages).withColumn("place", -F.col("up"))
    said = messages.select("tree_id", "msg_id", F.coalesce("role", F.lit("")).alias("role"),
                           F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit(MIDDLE))
    body = escape(F.col("text"))
    turns = _meet(steps, said, "msg_id").select(
        "tree_id", "leaf_id", "score", F.struct(
            "place", F.concat(head, body, F.lit(CLOSE)).alias("turn"), (F.col("role") == "assistant").alias("loss"),
            F.char_length(head).alias("head"), F.char_length(body).alias("body")).alias("t"))
    whole = turns.groupBy("tree_id", "leaf_id").agg(F.avg("score").alias("score"),
                                                    F.array_sort(F.collect_list("t")).alias("t"))
    empty = F.lit(None).cast("array<struct<start:int,length:int>>")
    seen = F.aggregate(
        "t", F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array().cast("array<struct<start:int,length:int>>")).alias("spans")),
        lambda acc, t: F.struct(
            (acc.at + t["head"] + t["body"] + len(CLOSE)).alias("at"),
            F.when(t["loss"], F.concat(acc.spans, F.array(F.struct((acc.at + t["head"]).alias("start"), t["body"].alias("length")))))
            .otherwise(acc.spans).alias("spans")))
    out = whole.select("tree_id", "leaf_id", "score", F.size("t").cast("long").alias("n_turns"),
                       F.array_join(F.transform("t", lambda t: t["turn"]), "").alias("formatted"), seen["spans"].alias("loss_spans"))
    if best is not None:
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf_id")))
        out = out.where(F.col("rank") <= best)
    return out


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text, unescaped."""
    marked = F.split(formatted, CLOSE)
    turns = F.slice(marked, 1, F.size(marked) - 1)
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"),
        unescape(F.substr(t, F.length(F.substring_index(t, MIDDLE, 1)) + F.lit(len(MIDDLE) + 1))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
