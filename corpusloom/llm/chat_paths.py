"""Reply trees as conversations: root-to-leaf paths, ranked by score, one formatted text per chosen path.

Paths are found by self-joins that double their reach. ``jump[k]`` gives a message's ancestor 2^k replies up, made by
joining ``jump[k-1]`` with itself; then, from the widest jump down, every message already on a leaf's path adds the one
that far above it. A tree 2^k deep takes 2k joins, and the rows are those of the paths themselves.

The template is ``<s>[INST]role[/INST]text</s>`` per turn. A control string inside a role or text gets a backslash after
its first character, and one that has backslashes there gets one more, so reading back removes one and loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import settle

OPEN, CLOSE, HEAD, BODY = "<s>", "</s>", "[INST]", "[/INST]"
#: First character, backslashes, rest of a control string.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _plain(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def leaf_paths(messages: DataFrame) -> DataFrame:
    """``(tree, leaf, node, up)`` for every message on the path of every leaf; ``up`` counts replies above the leaf.

    ``messages`` has (tree, node, parent), tree and node not null, node unique in its tree. A parent that is null or not in the tree makes a root.
    Replies in a circle have neither root nor leaf, hence no path.
    """
    nodes = messages.select("tree", "node")
    known = nodes.withColumnRenamed("node", "parent").withColumn("known", F.lit(True))
    linked = messages.select("tree", "node", "parent").join(known, ["tree", "parent"], "left")
    jump = settle(linked.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("to")))
    parents = jump.where("to is not null").select("tree", F.col("to").alias("node")).distinct()
    leaves = nodes.join(parents, ["tree", "node"], "left_anti")
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps = [jump.where("to is not null")]
    while not jumps[-1].isEmpty() and 1 << (len(jumps) - 1) <= largest:
        far = jumps[-1]
        onward = far.select("tree", F.col("node").alias("to"), F.col("to").alias("far"))
        jumps.append(settle(far.join(onward, ["tree", "to"]).select("tree", "node", F.col("far").alias("to"))))
    paths = settle(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up")))
    for k in reversed(range(len(jumps))):
        if jumps[k].isEmpty():
            continue
        above = paths.join(jumps[k], ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), F.expr(f"up + {1 << k}").alias("up"))
        paths = settle(paths.unionByName(above))
    return paths


def rank_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """``(tree, leaf, place)``: place 1 is the path that follows the best-scored reply at every branch.

    Replies to one message rank by score, highest first, null last, then by node. Paths compare by these ranks from the
    root on.
    """
    siblings = Window.partitionBy("tree", "parent").orderBy(F.desc_nulls_last("score"), "node")
    ranks = messages.select("tree", "node", F.row_number().over(siblings).alias("rank"))
    along = paths.join(ranks, ["tree", "node"]).groupBy("tree", "leaf").agg(
        F.sort_array(F.collect_list(F.struct("up", "rank")), asc=False).alias("steps"))
    key = F.transform("steps", lambda s: s["rank"])
    return along.select("tree", "leaf", F.row_number().over(Window.partitionBy("tree").orderBy(key, "leaf")).alias("place"))


def format_paths(messages: DataFrame, best: int = 1, trained_role: str = "assistant") -> DataFrame:
    """The ``best`` paths of each tree: ``(tree, leaf, place, formatted, mask)``.

    ``messages`` has (tree, node, parent, score, role, text), node unique in its tree; null role or text is empty. ``mask``
    holds (start, length) in characters of ``formatted``, counted from 0, of each escaped text of the trained role.
    A path is one record; texts are joined only to the chosen ones. A null tree is a tree like others; a null node is no message.
    """
    # inside a struct, a null tree equals itself in joins
    messages = messages.where(F.col("node").isNotNull()).withColumn("tree", F.struct(F.col("tree").alias("of")))
    paths = leaf_paths(messages)
    chosen = rank_paths(messages, paths).where(F.col("place") <= best)
    texts = messages.select("tree", "node", escape(_plain("role")).alias("role"), escape(_plain("text")).alias("text"))
    turns = paths.join(chosen, ["tree", "leaf"]).join(texts, ["tree", "node"])
    head = F.concat(F.lit(OPEN + HEAD), "role", F.lit(BODY))
    turn = F.struct((-F.col("up")).alias("at"), F.length(head).alias("head"), F.length("text").alias("chars"),
                    (F.col("role") == trained_role).alias("trained"), F.concat(head, "text", F.lit(CLOSE)).alias("piece"))
    record = turns.groupBy("tree", "leaf", "place").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        span = F.struct((acc["at"] + t["head"]).alias("start"), t["chars"].alias("length"))
        return F.struct((acc["at"] + t["head"] + t["chars"] + len(CLOSE)).alias("at"),
                        F.when(t["trained"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return record.select(
        F.col("tree.of").alias("tree"), "leaf", "place",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.aggregate("turns", start, step, lambda a: a["spans"]).alias("mask"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p.startswith(OPEN))

    def turn(p: Column) -> Column:
        parts = F.split(F.substring(p, len(OPEN + HEAD) + 1, F.length(p)), r"\[/INST\]", 2)
        return F.struct(unescape(parts[0]).alias("role"), unescape(parts[1]).alias("text"))

    return F.transform(pieces, turn)


def chain_messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as messages: each answers the one before. Rows of one turn follow by role, then text; none is lost.

    All rows with a null conversation id are one conversation with that id. An empty table gives no messages.
    """
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    node = F.row_number().over(order)
    return rows.select("tree", node.alias("node"), F.nullif(node - 1, F.lit(0)).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from the formatted text and its loss mask."""
    turns = read_back(F.col("formatted"))
    spelled = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join(F.transform("mask", lambda m: unescape(F.substring("formatted", m["start"] + 1, m["length"]))), "")
    return formatted.select(
        F.col("tree").alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
