"""Reply trees to conversations: paths by iterative self-joins, the best branch of each tree, one formatted text a path.

A tree is cut into segments: chains without a fork. Messages find the head of their segment by pointer doubling, so a long
chain takes a few joins and not one for each message; then the forks above each leaf are walked, one join a level.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelspark.llm.common import discard, materialize

#: What frames a turn: before and after the text of a user, of an assistant, and of any other role.
USER, ASSISTANT = ("<s>[INST] ", " [/INST]"), ("<|answer|>", "</s>")
ROLE, TURN_END = ("[ROLE]", "[/ROLE]"), "[/TURN]"
#: Every control string, as first character and rest; a backslash between the two takes its meaning away.
CONTROL = r"(<|\[)(/?s>|/?INST\]|\|answer\|>|/?ROLE\]|/TURN\])"
TURN = r"(?s)<s>\[INST\] .*? \[/INST\]|<\|answer\|>.*?</s>|\[ROLE\].*?\[/ROLE\].*?\[/TURN\]"


def escape(text: Column) -> Column:
    """Control strings inside a text lose their meaning; unescape() gives the text back."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1\\\\$2")


def unescape(text: Column) -> Column:
    """A doubled backslash is one, a single one is none."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def best_paths(messages: DataFrame) -> DataFrame:
    """(tree, id, parent, score) -> (tree, id, depth): the messages of each tree's best root-to-leaf path, the root's depth 0.

    Branches are ranked by the sum of their messages' scores (null: 0), ties by the smaller leaf id. A message whose parent
    is null or missing is a root; of several roots in a tree, the best path of all is taken. Messages on a cycle have no
    root and are on no path. (tree, id) must be unique; neither may be null.
    """
    nodes = materialize(messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), "chat-nodes")
    known = nodes.select("tree", F.col("id").alias("parent"), F.lit(True).alias("known"))
    children = nodes.where("parent is not null").groupBy("tree", "parent").agg(F.count("*").alias("children"))
    linked = nodes.join(known, ["tree", "parent"], "left").join(children, ["tree", "parent"], "left")
    is_head = F.col("known").isNull() | (F.col("children") > 1)
    state = linked.select("tree", "id", "score", F.when(F.col("known"), F.col("parent")).alias("parent"), is_head.alias("head"), F.when(is_head, F.col("id")).otherwise(F.col("parent")).alias("to"), F.when(is_head, 0).otherwise(1).cast("long").alias("hops"))
    state = materialize(state, "chat-heads")
    size = state.count()
    made = [nodes, state]
    jumps = 1
    while True:
        ahead = state.select("tree", F.col("id").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"), F.col("head").alias("there"))
        left = state.where(~F.col("head")).join(ahead, ["tree", "to"]).where(~F.col("there"))
        if jumps > size or left.isEmpty():
            break
        for _ in range(2):
            ahead = state.select("tree", F.col("id").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
            state = state.join(ahead, ["tree", "to"]).select("tree", "id", "score", "parent", "head", F.col("next").alias("to"), (F.col("hops") + F.col("more")).alias("hops"))
        state = materialize(state, "chat-heads")
        made.append(state)
        jumps *= 4
    heads = state.where("head")
    settled = state.join(heads.select("tree", F.col("id").alias("to")), ["tree", "to"], "left_semi")
    sums = settled.groupBy("tree", F.col("to").alias("segment")).agg(F.sum("score").alias("score"), F.max("hops").alias("last"))
    above = heads.where("parent is not null").select("tree", F.col("id").alias("segment"), "parent").join(settled.select("tree", F.col("id").alias("parent"), F.col("to").alias("up")), ["tree", "parent"]).select("tree", "segment", "up")
    segments = materialize(sums.join(above, ["tree", "segment"], "left"), "chat-segments")
    inner = segments.select("tree", F.col("up").alias("segment")).where("segment is not null").distinct()
    walk = segments.join(inner, ["tree", "segment"], "left_anti").select("tree", F.col("segment").alias("leaf"), "segment", "up", "score", F.col("last"))
    walk = materialize(walk, "chat-walk")
    steps = [walk]
    while not walk.where("up is not null").isEmpty():
        up = segments.select("tree", F.col("segment").alias("up"), F.col("up").alias("next"), F.col("score").alias("up_score"), F.col("last").alias("up_last"))
        walk = walk.where("up is not null").join(up, ["tree", "up"]).select("tree", "leaf", F.col("up").alias("segment"), F.col("next").alias("up"), F.col("up_score").alias("score"), F.col("up_last").alias("last"))
        walk = materialize(walk, "chat-walk")
        steps.append(walk)
    path = steps[0].withColumn("level", F.lit(0))
    for level, step in enumerate(steps[1:], 1):
        path = path.unionByName(step.withColumn("level", F.lit(level)))
    rooted = path.groupBy("tree", "leaf").agg(F.sum("score").alias("total"), F.max(F.col("up").isNull()).alias("rooted")).where("rooted")
    best = rooted.groupBy("tree").agg(F.min_by("leaf", F.struct(-F.col("total"), "leaf")).alias("leaf"))
    chosen = path.join(best, ["tree", "leaf"])
    # Levels count from the leaf; the messages above a segment are those of its higher levels.
    before = F.sum(F.col("last") + 1).over(W.partitionBy("tree").orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, -1))
    placed = chosen.select("tree", "segment", F.coalesce(before, F.lit(0)).alias("before"))
    out = settled.join(placed.withColumnRenamed("segment", "to"), ["tree", "to"]).select("tree", "id", (F.col("before") + F.col("hops")).alias("depth"))
    out = materialize(out, "chat-paths")
    for x in (*made, segments, *steps):
        discard(x)
    return out


def format_turns(turns: DataFrame) -> DataFrame:
    """(tree, depth, role, text) -> (tree, n_turns, formatted, loss_spans): one text a tree, and the places of the assistants' texts in it.

    Places are code points, end exclusive. Null roles and texts are empty.
    """
    text, role = escape(F.coalesce("text", F.lit(""))), F.coalesce("role", F.lit(""))
    is_user, is_assistant = role == "user", role == "assistant"
    before = F.when(is_user, USER[0]).when(is_assistant, ASSISTANT[0]).otherwise(F.concat(F.lit(ROLE[0]), escape(role), F.lit(ROLE[1])))
    after = F.when(is_user, USER[1]).when(is_assistant, ASSISTANT[1]).otherwise(TURN_END)
    rows = turns.select("tree", "depth", is_assistant.alias("loss"), before.alias("before"), text.alias("escaped"), after.alias("after"))
    size = F.length("before") + F.length("escaped") + F.length("after")
    order = W.partitionBy("tree").orderBy("depth")
    start = F.coalesce(F.sum(size).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.length("before")
    rows = rows.select("tree", "depth", "loss", F.concat("before", "escaped", "after").alias("turn"), start.alias("start"), (start + F.length("escaped")).alias("end"))
    each = rows.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("depth", "turn", "loss", "start", "end"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return each.select("tree", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted text holds, unescaped."""

    def turn(t: Column) -> Column:
        inside = lambda a, b: unescape(F.substring(t, F.lit(len(a) + 1), F.length(t) - len(a) - len(b)))
        other = F.struct(unescape(F.regexp_extract(t, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)).alias("role"), unescape(F.regexp_extract(t, r"(?s)^\[ROLE\].*?\[/ROLE\](.*)\[/TURN\]$", 1)).alias("text"))
        user = F.struct(F.lit("user").alias("role"), inside(*USER).alias("text"))
        assistant = F.struct(F.lit("assistant").alias("role"), inside(*ASSISTANT).alias("text"))
        return F.when(t.startswith(USER[0]), user).when(t.startswith(ASSISTANT[0]), assistant).otherwise(other)

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), turn)


def under_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")


def format_conversations(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: its key, n_turns, formatted, loss_spans.

    A conversation's rows, by turn (ties by role, then text; nulls first), are a tree without forks: each row answers the
    one before. Repeated rows are turns of their own; a null key is a conversation. Other columns play no part.
    """
    key = F.coalesce(F.col(conversation).cast("string"), F.lit("")).alias("tree")
    order = W.partitionBy("tree").orderBy("turn", "role", "text")
    numbered = rows.select(key, F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).withColumn("id", F.row_number().over(order).cast("long"))
    numbered = materialize(numbered.select("tree", "conv", "id", "role", "text"), "chat-rows")
    paths = best_paths(numbered.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score")))
    done = format_turns(paths.join(numbered.select("tree", "id", "role", "text"), ["tree", "id"]))
    names = numbered.where("id = 1").select("tree", "conv")
    out = materialize(done.join(names, "tree").select(F.col("conv").alias(conversation), "n_turns", "formatted", "loss_spans"), "chat-out")
    discard(numbered)
    discard(paths)
    return out
