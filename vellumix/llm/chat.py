"""Chat formatting of reply trees; DataFrame functions only.

Method. Messages name their parent. Root-to-leaf paths are enumerated by iterative self-joins: paths start at the
leaves, and each round joins every node reached so far with the jump table (node, ancestor ``step`` levels up) while
the table is joined with itself, so a path of n messages takes log2(n) rounds and its rows are listed once. Each round
is checkpointed in the shared folder. The branches of a tree are ranked by the mean score of their messages, then
length, then leaf, and the best ``top`` of them are formatted, one conversation each. Only chosen paths are joined
with their texts.

Template: each turn is ``<|turn:ROLE|>\\n``, the text, ``<|end|>\\n``. Inside texts and roles ``&``, ``<`` and ``[`` (and
``|`` in roles) become character references, so that no control string of this template, nor ``</s>`` or ``[INST]``, can
come from a text, and reading back is exact. The loss mask is an array of (start, end) over the formatted string, in
code points: the assistant texts.

Defined cases: null texts and roles are empty; a null score counts 0; a null tree id is a tree of its own; a message
whose parent is missing starts a path; rows repeated with one node id are one node, the first by role and text; in
conversations, rows go by turn, then role, then text, and repeated rows are turns of their own; a cycle is an error;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import prepare, read

HEAD, MID, END = "<|turn:", "|>\n", "<|end|>\n"
#: Fixed order: the ampersand first when escaping, last when reading back.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
ROLE_ESCAPES = (*ESCAPES, ("|", "&#124;"))
#: Longest path; a longer one is taken for a cycle.
DEPTH = 1 << 20


def escape(text: Column, table: tuple = ESCAPES) -> Column:
    for a, b in table:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column, table: tuple = ESCAPES) -> Column:
    for a, b in reversed(table):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def paths(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """tree, leaf, node, up (levels above the leaf) of every root-to-leaf path; nodes: tree, node (unique in it), parent."""
    prepare(nodes.sparkSession)
    nodes = nodes.select("tree", "node", "parent").checkpoint()
    parents = nodes.select("tree", F.col("parent").alias("node")).where("node is not null").distinct()
    reached = nodes.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    known = nodes.select("tree", F.col("node").alias("parent"))
    jumps = nodes.where("parent is not null").join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("above")).checkpoint()
    step = 1
    while not jumps.isEmpty():
        if step > depth:
            raise ValueError("a path is longer than the depth allowed, or the messages form a cycle")
        further = reached.join(jumps, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + step).alias("up"))
        reached = reached.union(further).checkpoint()
        second = jumps.select("tree", F.col("node").alias("above"), F.col("above").alias("next"))
        jumps = jumps.join(second, ["tree", "above"]).select("tree", "node", F.col("next").alias("above")).checkpoint()
        step *= 2
    return reached


def rank_paths(reached: DataFrame, scores: DataFrame, top: int | None = 1) -> DataFrame:
    """tree, leaf, path_rank, path_score, path_length of the best branches of each tree; scores: tree, node, score."""
    per = reached.join(scores, ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("path_score"), F.count("*").alias("path_length"))
    order = Window.partitionBy("tree").orderBy(F.desc("path_score"), F.desc("path_length"), "leaf")
    ranked = per.withColumn("path_rank", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("path_rank") <= top)


def render(turns: Column) -> Column:
    """(formatted, loss_spans) of an array of (role, text)."""
    pieces = F.transform(turns, lambda t: F.struct(F.concat(F.lit(HEAD), escape(t["role"], ROLE_ESCAPES), F.lit(MID)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    spans = "array<struct<start:int,end:int>>"

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"))).cast(spans)
        return F.struct((end + len(END)).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    loss = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans")), step, lambda acc: acc["spans"])
    text = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return F.struct(text.alias("formatted"), loss.alias("loss_spans"))


def format_trees(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """tree_id, leaf, path_rank, path_score, n_turns, formatted, loss_spans of each chosen branch.

    messages: tree_id, node_id, parent_id, role, text, score.
    """
    prepare(messages.sparkSession)
    tree = F.coalesce(F.concat(F.lit("t"), F.col("tree_id").cast("string")), F.lit("null"))
    clean = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "tree_id", F.col("parent_id").alias("parent"), F.col("score").cast("double").alias("score"))
    rows = messages.where("node_id is not null").groupBy(tree.alias("tree"), F.col("node_id").alias("node")).agg(F.min(clean).alias("m")).select("tree", "node", "m.*").checkpoint()
    reached = paths(rows)
    chosen = rank_paths(reached, rows.select("tree", "node", "score"), top)
    texts = reached.join(chosen, ["tree", "leaf"]).join(rows.select("tree", "node", "tree_id", "role", "text"), ["tree", "node"])
    turns = texts.groupBy("tree", "leaf").agg(
        *(F.first(c).alias(c) for c in ("tree_id", "path_rank", "path_score")),
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("up"), "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
    )
    return turns.select("tree_id", "leaf", "path_rank", "path_score", F.size("turns").cast("long").alias("n_turns"), render(F.col("turns")).alias("r")).select("tree_id", "leaf", "path_rank", "path_score", "n_turns", "r.*")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and loss_text, both read from formatted and loss_spans."""
    text = F.col("formatted")
    pieces = F.filter(F.split(text, r"<\|end\|>\n", -1), lambda x: x != "")
    at = lambda x: F.instr(x, MID)
    turns = F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.substring(x, len(HEAD) + 1, at(x) - len(HEAD) - 1), ROLE_ESCAPES).alias("role"),
            unescape(F.substring(x, at(x) + len(MID), F.length(x))).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(text, s["start"] + 1, s["end"] - s["start"]))), "")
    return formatted.withColumn("turns", turns).withColumn("loss_text", loss)


def from_conversations(rows: DataFrame) -> DataFrame:
    """Messages of conversations (conv_id, turn, role, text): each turn replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.withColumn("node_id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    return numbered.select(F.col("conv_id").alias("tree_id"), "node_id", parent.alias("parent_id"), "role", "text", F.lit(None).cast("double").alias("score"))


CONTROL = "</s>[INST] ok [/INST]"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    out = read_back(format_trees(from_conversations(rows.union(extra))))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-7, 0, 'user', '{CONTROL}'), (-7, 1, 'assistant', '{CONTROL}'))
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '|', '&#124;')) + {len(HEAD) + len(MID) + len(END)})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
