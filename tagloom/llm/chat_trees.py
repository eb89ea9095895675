"""Chat formatting of reply trees, with DataFrame functions only.

Nodes know their parents. Self-joins that double the distance they jump carry every node to its root in as many
rounds as the depth has binary digits; the rounds add up scores, so each leaf gets the score of its branch. Branches are
ranked in their tree by score (then by leaf), the chosen leaves walk the stored jumps back to list their paths, and each
path becomes one conversation. Only ids and scores take part in the rounds; texts are joined once, at the end.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. Control strings inside texts and roles get a backslash
after their first character, backslashes are doubled, and a newline inside a role gets one before it: undoing is one pass that drops
a backslash and keeps the character after it. `loss_spans` are the places of the assistant's texts in the formatted text.

Edge cases: null text or role counts as empty; a parent that does not exist makes its child a root; nodes on a cycle
reach no root and are left out; rows without a node id are left out, too; a null tree id is a tree of its own. Rows of one
(tree, node) are one node before any join, with the least parent and the highest score of its rows: each row is a turn of
its own, in the order of role and text, so branches do not multiply. Texts of any length are formatted whole; no rows give no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.llm.common import materialize, table

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
LEARNT_ROLE = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (tree, node, up) whose `up` is 1, 2, 4 ... steps above, and (tree, node, total) for nodes that reach a root.

    Only nodes that have not reached a root take part in a round, so the rounds that a deep tree needs are its own.
    """
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    parents = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    step = nodes.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")), "left").select("tree", "node", F.col("p").alias("up"), F.col("score").alias("total"))
    step, tables, reach = materialize(step, "jump"), [], 1
    done = step.where("up is null")
    while step.where("up is not null").limit(1).count() and reach <= most:
        active = step.where("up is not null")
        tables.append(active)
        above = done.unionByName(active).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("total").alias("total2"))
        step = materialize(
            active.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))).select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total")), "jump")
        done = done.unionByName(step.where("up is null"))
        reach *= 2
    return tables, done


def paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, height) of the `top` best branches of each tree; height counts from the leaf.

    nodes: tree, node, parent (null at a root), score (double).
    """
    tables, reached = _jumps(nodes)
    inner = nodes.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p"))
    leaves = reached.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))).where(F.col("rank") <= top)
    out = ranked.select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("height"))
    for k in reversed(range(len(tables))):
        up = tables[k].where("up is not null").select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        far = out.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("height") + 2**k).alias("height"))
        out = materialize(out.unionByName(far), "path")
    return out


def format_trees(turns: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans) of the chosen branches.

    turns: tree, node, parent, score, role, text.
    """
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    nodes = turns.where("node is not null").groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max(score).alias("score"))
    chosen = paths(materialize(nodes, "nodes"), top)
    own = turns.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    rows = chosen.join(own, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select(
        "tree", "leaf", "rank", F.struct(
            (-F.col("height")).alias("at"), F.concat(F.lit(START), role, F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"),
            (F.coalesce("role", F.lit("")) == LEARNT_ROLE).alias("learnt")).alias("turn"))
    grouped = rows.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        spans = F.when(t["learnt"], F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct((end + len(END) + 1).alias("at"), spans.alias("spans"))

    return grouped.select(
        "tree", "leaf", "rank",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "").alias("formatted"),
        F.aggregate("turns", start, add, lambda acc: acc["spans"]).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    pattern = r"^((?:[^\\\n]++|\\[\s\S])*+)\n([\s\S]*)\z"
    parts = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(t: Column) -> Column:
        t = F.substring(t, F.lit(len(START) + 1), F.length(t))
        return F.struct(unescape(F.regexp_extract(t, pattern, 1)).alias("role"), unescape(F.regexp_extract(t, pattern, 2)).alias("text"))

    return F.transform(turns, turn)


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """Conversations as trees without branches: each turn replies to the one before (turn, then role, then text)."""
    w = Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(w).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every conversation, and one that says control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_trees(conversation_turns(rows)).withColumn("turns", read_back(F.col("formatted")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.withColumn("loss", loss).select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def _sql_escape(x: str) -> str:
    x = rf"replace(coalesce({x}, ''), '\', '\\')"
    for c in CONTROL:
        x = rf"replace({x}, '{c}', '{c[0]}\{c[1:]}')"
    return x


SQL = rf"""
WITH c AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, {len(START) + len(END) + 2}
        + length(replace({_sql_escape('role')}, chr(10), '\' || chr(10))) + length({_sql_escape('text')}) AS n,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, c.role NULLS FIRST, c.text NULLS FIRST) AS k
    FROM c),
g AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS said,
        coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = '{LEARNT_ROLE}'), '') AS loss, sum(n) AS formatted_chars
    FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""
