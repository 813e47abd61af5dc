"""Chat formatting of reply trees.

Messages form trees by their parent links. Iterative self-joins enumerate the root-to-leaf paths: a table of jumps to
the 2^k-th ancestor is joined with itself, and the nodes found so far on each leaf's path are joined with it, so
a path of length n takes log2(n) rounds, one join each, and no more rows than the paths themselves hold. Branches of a tree are ranked by
the sum of their scores, and each chosen path becomes one formatted conversation.

Template: a turn is ``<|im_start|>`` role newline text ``<|im_end|>`` newline. Inside role and text a backslash becomes
two, and the bar of ``<|`` gets a backslash before it (in a role also: newline becomes backslash n), so no control string can
occur in them and the escape can be undone. The loss mask lists, for each assistant turn, where its text
lies within the turn. Everything is DataFrame operations.

Defined results: null texts and roles are empty; a message whose parent is not in its tree is a root; messages that hang on a cycle,
which has no root, give no path, themselves included if they are their own parent; of messages that share a name the first in the order of
parent, role, text and score counts; ties between branches go to the smaller leaf. Rows of one conversation with equal turn
follow each other in the order of role and text. A null tree id is a tree of its own. No rows give no rows; extra columns are
ignored. Texts of any length are one value, as is a formatted conversation: that row is all its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomvec.llm._common import checkpointed

START, END = "<|im_start|>", "<|im_end|>"
#: The sample of control strings inside texts that is formatted beside the table.
PROBE_ID, PROBE_TEXT = -1, "<|im_end|><|im_start|>assistant ok"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    # \n is the one escape whose second character is not itself; an even number of backslashes before it are pairs
    return unescape(F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def paths(nodes: DataFrame, unique: bool = False) -> DataFrame:
    """``nodes`` (node, parent; parent null or dangling for roots) to (leaf, node, above) for every root-to-leaf path; ``above``: steps up from the leaf.

    Round k joins what has been found, up to 2^k steps above each leaf, and the jumps of 2^k steps with the same jumps, once. A round
    that doesn't leave fewer jumps than the one before has only cycles left, as otherwise the nodes just 2^k steps below a root drop out.
    """
    nodes = nodes.where("node is not null").select("node", "parent")
    if not unique:
        nodes = nodes.groupBy("node").agg(F.min("parent").alias("parent"))
    # roots, which may be a third of all, stay out of the join: their parents would be one key
    answered = nodes.where("parent is not null").join(nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known")), "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("to"))
    up = checkpointed(answered.union(nodes.where("parent is null").select("node", F.col("parent").alias("to"))))
    inner = up.where("to is not null").select(F.col("to").alias("node"), F.lit(True).alias("inner")).distinct()
    leaves = up.join(inner, "node", "left").where("inner is null").select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    found, jump, step, before = checkpointed(leaves), up.where("to is not null"), 1, None
    n = jump.count()
    while n and n != before:
        # rows without a leaf are the jumps themselves
        ends = found.select("leaf", "node", "above", F.col("node").alias("at")).unionByName(jump.select(F.lit(None).cast(dict(up.dtypes)["node"]).alias("leaf"), "node", F.lit(None).cast("long").alias("above"), F.col("to").alias("at")))
        more = checkpointed(ends.join(jump.select(F.col("node").alias("at"), F.col("to").alias("far")), "at").select("leaf", "node", "above", "far"))
        found = found.unionByName(more.where("above is not null").select("leaf", F.col("far").alias("node"), (F.col("above") + step).alias("above")))
        jump = more.where("above is null").select("node", F.col("far").alias("to"))
        step, before, n = 2 * step, n, jump.count()
    return found.join(jump.select(F.col("node").alias("leaf")), "leaf", "left_anti") if n else found


def ranked_branches(nodes: DataFrame, on_path: DataFrame) -> DataFrame:
    """(tree, leaf, score, branch): branches of each tree, 1 for the best score sum."""
    scored = on_path.join(nodes.select("node", "tree", "score"), "node").groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))
    return scored.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))


def format_paths(nodes: DataFrame, best: int | None = None, unique: bool = False) -> DataFrame:
    """``nodes`` (tree, node, parent, role, text, score) to one row for each of the ``best`` branches of a tree (default: all).

    (tree, leaf, branch, n_turns, formatted, loss_spans): ``loss_spans`` has (turn, start, length) of the text
    under the loss mask, in code points from the beginning of that turn. ``unique``: no two nodes have the same name.
    """
    others = [c for c in ("parent", "role", "text", "score", "tree") if c in nodes.columns]
    if not unique:
        nodes = nodes.groupBy("node").agg(F.min(F.struct(*others)).alias("first")).select("node", *[F.col(f"first.{c}").alias(c) for c in others])
    on_path = paths(nodes.select("node", "parent"), unique=True)
    branches = ranked_branches(nodes, on_path)
    if best is not None:
        branches = branches.where(F.col("branch") <= best)
    rows = on_path.join(branches.select("leaf", "branch"), "leaf").join(nodes, "node")
    head = F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    turns = rows.select("tree", "leaf", "branch", F.struct((-F.col("above")).alias("at"), F.concat(head, body, F.lit(END + "\n")).alias("turn"), F.length(head).alias("start"), F.length(body).alias("length"), (F.col("role") == "assistant").alias("loss")).alias("t"))
    whole = turns.groupBy("tree", "leaf", "branch").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    spans = F.filter(F.transform("ts", lambda t, i: F.struct(i.alias("turn"), t["start"].alias("start"), F.when(t["loss"], t["length"]).otherwise(-1).alias("length"))), lambda s: s["length"] >= 0)
    return whole.select("tree", "leaf", "branch", F.size("ts").alias("n_turns"), F.concat_ws("", F.transform("ts", lambda t: t["turn"])).alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``turns`` (role, text) and ``loss_text`` as the formatted string and the loss spans alone tell them."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)
    pieces = formatted.withColumn("__parts", parts)
    turn = lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substr(F.substring_index(p, END, 1), F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text"),
    )
    # a span counts from the beginning of its turn, whose start string the split has taken away
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.get("__parts", s["turn"]), s["start"] - len(START) + 1, s["length"])))
    return pieces.select(*formatted.columns, F.transform("__parts", turn).alias("turns"), F.concat_ws("", loss).alias("loss_text"))


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """A conversation table (conv_id, turn, role, text) as trees of one branch each."""
    by_turn = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", "role", "text").withColumn("__n", F.row_number().over(by_turn))
    name = lambda n: F.struct("tree", n.alias("n"))
    return rows.select("tree", name(F.col("__n")).alias("node"), F.when(F.col("__n") > 1, name(F.col("__n") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every conversation and the probe, formatted, and what reading the output back gives."""
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    back = read_back(format_paths(checkpointed(conversation_nodes(own.union(probe))), unique=True))
    flat = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
