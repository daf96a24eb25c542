"""Chat formatting of reply trees, in DataFrame functions only.

Messages form trees: (conv_id, node, parent, role, text, score). A branch is the path from a
root to a leaf. Jump pointers are built by self-joins that double their reach each round, so a
tree of depth d takes log2(d) rounds; the same joins sum the scores along each branch. The
best branches of a conversation are chosen by mean score, then their paths are
enumerated by joining the jump tables from the longest down: each ancestor is met once.

A turn is ``<s>role[INST]text[/INST]``, or with ``</s>`` at its end if it is the assistant's
and thus under the loss mask. A control string in a role or text gets a backslash after its
first character, one more if it has some already; taking one away restores the text.

Defined results: null roles and texts are empty; rows of a conversation are ordered by turn
(nulls first), then role and text; a null conv_id is a conversation; repeated rows are turns;
an empty table gives no rows; other columns are ignored. A conversation is one output row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from missive.llm.common import prepare, table

#: Control strings, each possibly with backslashes after its first character.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, r"$1\\$2$3")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED, "$1$2$3")


def chains(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> messages of one reply each: node and parent by order of turn."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_id")  # joins need a key that is not null
    return rows.select(key, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).cast("long").alias("node")).withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)})


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """conv_id, branch (1 is best), depth, node: the nodes of each conversation's best branches.

    messages: conv_id (not null), node (unique in conv_id), parent (null at roots), score.
    """
    prepare(messages.sparkSession)
    nodes = messages.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")).checkpoint()
    # 2**k steps up; total and steps are over the nodes passed, the node itself first
    jump = nodes.select("conv_id", "node", F.col("parent").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("steps"))
    tables, done = [], jump.where("up is null")
    jump = jump.where("up is not null")
    while jump.limit(1).count():
        tables.append(jump.select("conv_id", "node", "up"))
        if len(tables) > 40:
            raise ValueError("parents form a cycle")
        # those that are at their root need no more joins, but others step on them
        above = jump.unionByName(done).select("conv_id", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("steps").alias("steps2"))
        moved = jump.join(above, ["conv_id", "up"], "left").select("conv_id", "node", F.col("up2").alias("up"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps")).checkpoint()
        done, jump = done.unionByName(moved.where("up is null")), moved.where("up is not null")
    parents = nodes.where("parent is not null").select("conv_id", F.col("parent").alias("node")).distinct()
    leaves = done.join(parents, ["conv_id", "node"], "left_anti").withColumn("mean", F.col("total") / F.col("steps"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("mean"), F.desc("steps"), "node"))
    paths = leaves.withColumn("branch", rank).where(F.col("branch") <= branches).select("conv_id", "branch", F.col("node"), F.col("steps").alias("depth"))
    for k, ups in reversed(list(enumerate(tables))):
        reach = 1 << k
        paths = paths.union(paths.join(ups, ["conv_id", "node"]).select("conv_id", "branch", F.col("up").alias("node"), (F.col("depth") - reach).alias("depth"))).checkpoint()
    return paths


def turn_text(role: Column, text: Column) -> Column:
    end = F.when(role == "assistant", F.lit("</s>")).otherwise(F.lit("[/INST]"))
    return F.concat(F.lit("<s>"), escaped(role), F.lit("[INST]"), escaped(text), end)


def formatted(messages: DataFrame, branches: int = 1) -> DataFrame:
    """conv_id, branch, text: each chosen path as one conversation."""
    paths = best_paths(messages, branches)
    turns = paths.join(messages.select("conv_id", "node", "role", "text"), ["conv_id", "node"])
    turns = turns.groupBy("conv_id", "branch").agg(F.array_sort(F.collect_list(F.struct("depth", turn_text(F.col("role"), F.col("text")).alias("t")))).alias("turns"))
    return turns.select("conv_id", "branch", F.array_join(F.col("turns.t"), "").alias("text"))


def read_back(conversations: DataFrame) -> DataFrame:
    """conversations with turns: array of (role, text, loss), parsed from text and unescaped."""
    parts = F.slice(F.split("text", "<s>", -1), F.lit(2), F.greatest(F.lit(0), F.size(F.split("text", "<s>", -1)) - 1))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "[INST]", 1)
        loss = part.endswith("</s>")
        body = F.substr(part, F.length(role) + F.lit(7), F.length(part) - F.length(role) - F.lit(6) - F.when(loss, F.lit(4)).otherwise(F.lit(7)))
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"), loss.alias("loss"))

    return conversations.withColumn("turns", F.transform(parts, turn))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = read_back(formatted(chains(rows)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return read.select(F.expr("try_cast(conv_id AS bigint)").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"))


OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(3 + 6 + CASE WHEN role = 'assistant' THEN 4 ELSE 7 END
    + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
