"""Reply trees to conversations: paths by self-joins, branches by score, one text a path.

A message names its parent; a tree's root has none.  Pointer doubling joins the messages
with themselves: after round k each one knows its ancestor 2^k above, and the sum of scores
and the number of messages up to it, so a tree of depth d takes log2(d) rounds and each
round's table is as long as the messages.  Leaves are ranked within their tree by mean score
along the path (ties: the smaller leaf), the best ``top`` are chosen, and the same tables,
joined from the longest stride down, list every message of a chosen path exactly once.

Template.  ``<|im_start|>role\\ntext<|im_end|>\\n`` for each message.  Inside roles and texts a
backslash is put after each ``<`` that a ``|`` follows, directly or behind other
backslashes, so no control string can arise there and taking one backslash away gives the
text back; in a role, backslashes and line ends are written ``\\\\`` and ``\\n`` before that.
``loss`` lists (start, length) in code points of the texts of ``assistant`` messages.

Defined results: null roles and texts are empty, null scores 0; a parent that does not exist
makes a root; messages on a parent cycle, or above which there is one, lead to no root and
are on no path; repeated node ids are an input error that ``thread_turns`` can't make; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracetrim.llm.common import pick
from tracetrim.session import shared_table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(c: Column) -> Column:
    plain = unescape(c)
    parts = F.transform(F.split(plain, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def thread_turns(conversations: DataFrame) -> DataFrame:
    """(tree, node, parent, role, text, score) of conversations by turn: each row answers the one before it.
    Rows of one turn go by role, then text; a null turn comes last."""
    c = pick(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c, _ = shared_table(c.withColumn("node", F.monotonically_increasing_id()), "messages")
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_last(), "role", "h", "node")
    narrow = c.select("tree", "turn", "role", F.xxhash64("text").alias("h"), "node")
    parents = narrow.select("node", F.lag("node").over(order).alias("parent"))
    return c.join(parents, "node").select("tree", "node", "parent", "role", "text", F.lit(0.0).alias("score"))


def _strides(nodes: DataFrame, most_rounds: int = 62) -> tuple[list[DataFrame], DataFrame]:
    """Tables (node, up): the ancestor 1, 2, 4, ... above; and (node, total, depth) for nodes below a root."""
    known = nodes.select(F.col("node").alias("p"))
    state = (nodes.join(known, F.col("parent") == F.col("p"), "left")
             .select("node", F.col("p").alias("up"), F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("depth")))
    state, _ = shared_table(state, "stride")
    tables, n = [], nodes.count()
    while True:
        open_ = state.where("up IS NOT NULL").count()
        if not open_ or 2 ** len(tables) > n or len(tables) > most_rounds:
            break
        tables.append(state.select("node", "up").where("up IS NOT NULL"))
        above = state.select(F.col("node").alias("a"), F.col("up").alias("a_up"), F.col("total").alias("a_total"), F.col("depth").alias("a_depth"))
        # messages that have reached their root stay as they are: a few long threads don't make all go on
        climbed = (state.where("up IS NOT NULL").join(above, F.col("up") == F.col("a"))
                   .select("node", F.col("a_up").alias("up"), (F.col("total") + F.col("a_total")).alias("total"), (F.col("depth") + F.col("a_depth")).alias("depth")))
        state, _ = shared_table(state.where("up IS NULL").union(climbed), "stride")
    return tables, state.where("up IS NULL").select("node", "total", "depth")


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(leaf, tree, rank, score, place, node): the messages of each tree's ``top`` best paths; place 1 is the root."""
    nodes = messages.select("tree", "node", "parent", "score")
    tables, reached = _strides(nodes)
    inner = nodes.select(F.col("parent").alias("node")).where("parent IS NOT NULL").distinct()
    leaves = nodes.select("tree", "node").join(inner, "node", "left_anti").join(reached, "node")
    leaves = leaves.withColumn("score", F.col("total") / F.col("depth"))
    best = Window.partitionBy("tree").orderBy(F.col("score").desc(), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    paths = chosen.select(F.col("node").alias("leaf"), "tree", "rank", "score", F.col("depth").alias("place"), "node")
    for k in range(len(tables) - 1, -1, -1):
        up = paths.join(tables[k], "node").select("leaf", "tree", "rank", "score", (F.col("place") - 2 ** k).alias("place"), F.col("up").alias("node"))
        paths = paths.union(up)
        paths, _ = shared_table(paths, "paths")
    return paths


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, leaf, rank, score, n_turns, formatted, loss): each path as one text with its loss mask."""
    turns = (paths.join(messages.select("node", "role", "text"), "node")
             .select("tree", "leaf", "rank", "score", F.struct("place", escape_role(F.coalesce("role", F.lit(""))).alias("role"),
                     escape(F.coalesce("text", F.lit(""))).alias("text"), (F.coalesce("role", F.lit("")) == "assistant").alias("learnt")).alias("t")))
    whole = turns.groupBy("tree", "leaf", "rank", "score").agg(F.sort_array(F.collect_list("t")).alias("t"))
    head = lambda t: F.length(t["role"]) + len(OPEN) + 1
    whole = whole.withColumn("at", F.aggregate("t", F.array(F.lit(0)), lambda a, t: F.concat(
        a, F.array(F.element_at(a, -1) + head(t) + F.length(t["text"]) + len(CLOSE)))))
    spans = F.filter(F.transform("t", lambda t, i: F.struct((F.get("at", i) + head(t)).alias("start"), F.length(t["text"]).alias("length"), t["learnt"].alias("learnt"))),
                     lambda s: s["learnt"])
    return whole.select("tree", "leaf", "rank", "score", F.size("t").cast("long").alias("n_turns"),
                        F.array_join(F.transform("t", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "").alias("formatted"),
                        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss"))


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` best conversations of each reply tree of (tree, node, parent, role, text, score)."""
    return format_paths(messages, best_paths(messages, top))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``learnt`` (texts under the loss mask), read from ``formatted`` and ``loss``."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda p: p != "")
    body = F.transform(pieces, lambda p: F.substring(p, len(OPEN) + 1, 1 << 30))
    turns = F.transform(body, lambda b: F.struct(unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
                                                 unescape(F.substring(b, F.instr(b, "\n") + 1, F.lit(1 << 30))).alias("text")))
    learnt = F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"])))
    return formatted.withColumn("turns", turns).withColumn("learnt", learnt)
