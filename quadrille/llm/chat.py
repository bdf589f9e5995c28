"""Chat formatting after cumulative snapshots have been collapsed.

A log that stores a conversation after every turn holds many prefixes of the same conversation. Each conversation's
turns are put in order once, and a rolling hash identifies every turn prefix: the number of its turns and two running sums
of 60 bits each of SHA-256 over (place, role, text), so that the work is linear in turns. A conversation whose own hash is
among the proper prefixes of another is removed by an anti-join; of conversations with equal turns the smallest conv_id
stays. Only the maximal conversations are rendered. The anti-join moves hashes, not texts.

Defined results: a null role or text counts as the empty string and equals it; turns are ordered by turn (null first),
then role, then text; a repeated row (same conversation, turn, role and text) counts once; rows without conv_id are
left out, as they belong to no conversation; an empty table gives no rows; very long conversations are rendered whole;
columns other than conv_id, turn, role and text are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm import text as T
from quadrille.shared import cut

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal (conversations with the same turns) and rendered for each maximal conversation."""
    t = T.keyed(turns, {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"}).where("conv_id IS NOT NULL")
    t = t.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = F.row_number().over(order) == 1
    for c in ("turn", "role", "text"):
        fresh |= ~F.col(c).eqNullSafe(F.lag(c).over(order))
    t = t.withColumn("fresh", fresh).where("fresh").withColumn("place", F.row_number().over(order))
    # Lengths stand before the strings, so that no two turns give the same bytes.
    turn = F.concat(F.col("place").cast("string"), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", F.length("text").cast("string"), F.lit(":"), "text")
    t = t.withColumn("sha", F.sha2(turn.cast("binary"), 256)).withColumn("last", F.lead("place").over(order).isNull())
    lane = lambda at: F.sum(F.conv(F.substring("sha", at, 15), 16, 10).cast("decimal(20,0)")).over(so_far)
    t = cut(t.withColumns({"a": lane(1), "b": lane(16)}).drop("fresh", "sha"))
    hashes = ["place", "a", "b"]
    own = t.where("last").groupBy(*hashes).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    keep = own.join(t.where("NOT last").select(*hashes).distinct(), hashes, "left_anti").select("conv_id", F.col("place").cast("bigint").alias("n_turns"), "n_equal")
    line = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE + "\n"))
    lines = t.join(keep, "conv_id").groupBy("conv_id", "n_turns", "n_equal").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    return lines.select("conv_id", "n_turns", "n_equal", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))


def op5_chat_snapshots(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER w AS i, sha256(concat(length(role), ':', role, length(text), ':', text)) AS h FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT conv_id, i, string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY i) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n FROM n),
own AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_equal, any_value(n) AS n_turns FROM p WHERE i = n GROUP BY prefix),
kept AS (SELECT * FROM own WHERE prefix NOT IN (SELECT prefix FROM p WHERE i < n))
SELECT k.conv_id, k.n_turns, k.n_equal, string_agg('{OPEN}' || n.role || chr(10) || n.text || '{CLOSE}' || chr(10), '' ORDER BY n.i) AS rendered
FROM kept k JOIN n USING (conv_id) GROUP BY ALL
"""
