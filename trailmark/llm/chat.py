"""Chat formatting of reply trees, on DataFrame functions alone.

Messages point to the message they answer. Iterative self-joins with doubled strides find each
message's depth and the score of the path that leads to it, so a tree of depth d takes log2(d)
rounds. Of each tree the branches, from root to leaf, are ranked by score; the chosen ones are
enumerated by the same strides and each is formatted as one conversation.

The template is

    <|im_start|>role\\ntext<|im_end|>\\n

for each turn. Inside roles and texts a backslash is doubled and `<|` becomes `<\\|`, so a control
string can only come from the template, and reading a backslash and what follows it as the latter
gives the text back. Line ends in roles are written `<|line|>`. The loss mask lists the spans of the
assistant's texts as turn, first code point within the rendered turn, and length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|line|>"
LEARNED = "assistant"
MOST_ROUNDS = 40


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def strides(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Levels k = 0, 1, ... of (tree, id, up), the 2**k-th ancestors of the messages that have one, and
    (tree, id, score), the sum of scores on each message's path from the root, itself included.

    messages has tree, id, parent, score. A message leaves the rounds when it has passed the root, so
    few deep trees don't keep the many shallow ones going. A cycle is an error.
    """
    now = materialize(messages.select("tree", "id", F.col("parent").alias("up"), "score"), "stride")
    levels, scores = [], now.filter("up is null").select("tree", "id", "score")
    at_root = scores.select("tree", F.col("id").alias("up"), F.col("score").alias("score2"), F.lit(None).cast("long").alias("up2"))
    while True:
        now = now.filter("up is not null")
        if not now.limit(1).count():
            return levels, scores
        if len(levels) > MOST_ROUNDS:
            raise ValueError("the parents form a cycle")
        levels.append(now.select("tree", "id", "up"))
        ahead = now.select("tree", F.col("id").alias("up"), F.col("score").alias("score2"), F.col("up").alias("up2")).unionByName(at_root)
        now = materialize(now.join(ahead, ["tree", "up"]).select("tree", "id", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score")), "stride")
        over = now.filter("up is null").select("tree", "id", "score")
        scores = scores.unionByName(over)
        at_root = at_root.unionByName(over.select("tree", F.col("id").alias("up"), F.col("score").alias("score2"), F.lit(None).cast("long").alias("up2")))


def branches(messages: DataFrame, scores: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank): each tree's leaves in the order of their path's score, highest first, ties
    to the smaller id; the first `best` of them, or all."""
    answered = messages.filter(F.col("parent").isNotNull()).select("tree", F.col("parent").alias("id"))
    leaves = scores.join(answered, ["tree", "id"], "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.lit(True) if best is None else F.col("rank") <= best).select("tree", F.col("id").alias("leaf"), "rank")


def paths(chosen: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, leaf, rank, id, up_by): the messages on each chosen branch and how far above the leaf."""
    on = chosen.select("tree", "leaf", "rank", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("up_by"))
    for k in range(len(levels) - 1, -1, -1):
        above = on.join(levels[k], ["tree", "id"]).select("tree", "leaf", "rank", F.col("up").alias("id"), (F.col("up_by") + 2**k).alias("up_by"))
        on = materialize(on.unionByName(above), "paths")
    return on


def render(turns: DataFrame) -> DataFrame:
    """(conv, place, role, text) to a row per conv: turns, an array of the rendered turns by place;
    formatted, their concatenation; loss, an array of the spans (turn, start, length) to be learned.

    Null roles and texts count as empty. A conversation is one string, so it has to fit into a row.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    turn = F.struct("place", F.concat(head, body, F.lit(END + "\n")).alias("s"), F.char_length(head).alias("start"), F.char_length(body).alias("length"), (F.coalesce("role", F.lit("")) == LEARNED).alias("learned"))
    convs = turns.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    spans = F.transform("t", lambda x, i: F.struct(i.alias("turn"), x["start"].alias("start"), x["length"].alias("length"), x["learned"].alias("learned")))
    loss = F.transform(F.filter(spans, lambda x: x["learned"]), lambda x: F.struct(x["turn"].alias("turn"), x["start"].alias("start"), x["length"].alias("length")))
    return convs.select("conv", F.transform("t", lambda x: x["s"]).alias("turns"), loss.alias("loss")).withColumn("formatted", F.array_join("turns", ""))


def format_trees(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """messages (tree, id, parent, role, text, score) to (tree, leaf, rank, turns, loss, formatted).

    tree and id aren't null; ids are unique in their tree; a parent that isn't there makes a root of
    its child. Null scores count as 0. An empty table gives an empty one; other columns are ignored.
    """
    own = messages.select("tree", "id", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    there = own.select("tree", F.col("id").alias("parent"), F.lit(True).alias("__there"))
    own = own.join(there, ["tree", "parent"], "left").withColumn("parent", F.when(F.col("__there"), F.col("parent"))).drop("__there")
    own = materialize(own, "messages")
    levels, scores = strides(own)
    on = paths(branches(own, scores, best), levels)
    conv = F.struct("tree", "leaf", "rank").alias("conv")
    turns = on.join(own, ["tree", "id"]).select(conv, (-F.col("up_by")).alias("place"), "role", "text")
    return render(turns).select("conv.*", "turns", "loss", "formatted")


def threads(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of conversations that are kept as numbered turns: each answers the one before.

    Ties of turn are ordered by role and text; null turns come first; a null conversation id is a
    conversation of its own. Gives tree (a string), conv_id, id, parent, role, text and score.
    """
    order = Window.partitionBy(F.col(f"`{conv}`")).orderBy(F.col(f"`{turn}`").asc_nulls_first(), F.col(f"`{role}`"), F.col(f"`{text}`"))
    key = F.coalesce(F.col(f"`{conv}`").cast("string"), F.lit("null"))
    number = F.row_number().over(order).cast("long")
    out = rows.select(key.alias("tree"), F.col(f"`{conv}`").alias("conv_id"), number.alias("id"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    return out.withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1)).withColumn("score", F.lit(0.0))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted and loss, parsed: n_turns, dialogue (role, \\n, text, \\n for each turn), learned (the
    texts under the mask, joined), both unescaped."""
    pieces = F.split("formatted", END.replace("|", r"\|") + "\n", -1)
    head = START.replace("|", r"\|")
    part = lambda x, k: F.regexp_extract(x, rf"(?s)\A{head}([^\n]*)\n(.*)\z", k)
    said = F.transform(F.slice("__p", 1, F.size("__p") - 1), lambda x: F.concat(unescape_role(part(x, 1)), F.lit("\n"), unescape(part(x, 2)), F.lit("\n")))
    under = F.transform("loss", lambda s: unescape(F.substring(F.element_at("__p", s["turn"] + 1), s["start"] + 1, s["length"])))
    return formatted.withColumn("__p", pieces).withColumn("n_turns", (F.size("__p") - 1).cast("long")).withColumn("dialogue", F.array_join(said, "")).withColumn("learned", F.array_join(under, "")).drop("__p")
