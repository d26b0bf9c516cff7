"""Chat formatting by perspective rotation: each participant of a dialogue becomes the assistant once.

For every participant the dialogue is rendered with that speaker as assistant and all others as named users; the mask
holds the spans that are to be learned, the assistant's words and end marks. Long dialogues are rendered in parts of
PART_TURNS turns, so no task holds a whole one of unbounded length; parts of a dialogue join by concatenation.
Everything is DataFrame code. Equal rows are counted before the shuffle and rendered as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import at_most, join_counted, staged, table

#: Marks of the rendered text.
BEGIN, END = "<|im_start|>", "<|im_end|>"
PART_TURNS = 64
PART_MESSAGES = 4096
#: Roles that set the scene and take no part.
NOT_SPEAKERS = ("system",)


def _escaped(name: str) -> str:
    """SQL for a name with all but A-Z, a-z, 0-9 and _.~- as %XX, so different names stay different."""
    return f"replace(replace(replace(url_encode({name}), '+', '%20'), '%7E', '~'), '*', '%2A')"


def _numbered(messages: DataFrame) -> DataFrame:
    """messages with `before`, the number of messages ahead of each in its part. Ranges of the order are numbered one by one
    and then moved up by the sizes of the ranges ahead, so no task holds a whole part."""
    order = [F.col("key"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("body")]
    ranged = messages.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = staged(ranged.withColumn("nth", F.monotonically_increasing_id()).withColumn("range", F.spark_partition_id()), "ranges")
    ahead = W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranged.groupBy("key", "range").agg(F.sum("copies").alias("n")).select("key", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("past"))
    here = W.partitionBy("key", "range").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    own = ranged.withColumn("inside", F.coalesce(F.sum("copies").over(here), F.lit(0)))
    return own.join(ranges, ["key", "range"]).withColumn("before", F.col("past") + F.col("inside")).select(*messages.columns, "before")


def rotate_perspectives(conversations: DataFrame, part_turns: int = PART_TURNS, part_messages: int = PART_MESSAGES, not_speakers=NOT_SPEAKERS) -> DataFrame:
    """conversations (conv_id, turn, role, text) to one row for each dialogue, participant and part.

    Columns: conv_id, perspective, part, sub, n_messages, n_learned, text, mask (array of start, end in code points of text).
    Messages go by turn (null last), role and text. Participants are the roles but for `not_speakers`, which are rendered
    under their own name and never learned; a dialogue without a participant has no row. Null or empty role: "unknown".
    Null text: empty. A null conv_id is a dialogue of its own. A repeated row is a message again. Marks inside a message
    are broken up by a space. Should one part have over part_messages messages (many rows of equal turn), it goes on, in the
    same order, in pieces of so many messages with sub from 0 on. Other columns are ignored. Empty in, empty out.
    """
    role = F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("unknown"))
    body = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |"))
    counted = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), body.alias("body")).groupBy("conv_id", "turn", "role", "body").agg(F.count("*").alias("copies"))
    # narrow rows, read three times: sizes of parts, participants, messages
    messages = staged(counted.withColumn("part", F.floor(F.col("turn") / part_turns)), "messages")
    safe = lambda a, b: a.eqNullSafe(b)

    sizes = messages.groupBy("conv_id", "part").agg(F.sum("copies").alias("n"))
    key = F.xxhash64("conv_id", F.col("conv_id").isNull(), "part", F.col("part").isNull()).alias("key")
    large = staged(sizes.where(F.col("n") > part_messages).select(key, F.lit(True).alias("crowded")), "large")
    marked = join_counted(messages.select("*", key), large, ["key"], "left", rows=50_000)
    alone = marked.where("crowded is null").withColumn("before", F.lit(0).cast("long"))
    dealt = alone if at_most(large, 0) else alone.unionByName(_numbered(marked.where("crowded")))
    dealt = dealt.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    dealt = dealt.withColumn("sub", F.when(F.col("crowded"), F.floor((F.col("before") + F.col("copy") - 1) / part_messages)).otherwise(F.lit(0).cast("long")))
    order = F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "body", "copy")
    parts = dealt.groupBy("conv_id", "part", "sub").agg(F.array_sort(F.collect_list(order)).alias("messages"))
    speakers = messages.where(~F.col("role").isin(*not_speakers)).select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct()
    rotated = parts.join(speakers, safe(parts.conv_id, speakers.of)).drop("of")

    head = f"""concat('{BEGIN}', case when m.role = perspective then 'assistant' when array_contains(array({', '.join(f"'{x}'" for x in not_speakers) or "''"}), m.role) then m.role
               else concat('user name=', {_escaped('m.role')}) end, '\\n')"""
    rendered = rotated.withColumn("pieces", F.expr(f"transform(messages, m -> named_struct('own', m.role = perspective, 'head', {head}, 'said', concat(m.body, '{END}')))"))
    mask = """aggregate(pieces, named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int>>)),
      (a, x) -> named_struct('at', a.at + length(x.head) + length(x.said) + 1,
        'out', if(x.own, concat(a.out, array(named_struct('start', a.at + length(x.head), 'end', a.at + length(x.head) + length(x.said)))), a.out)), a -> a.out)"""
    return rendered.select(
        "conv_id",
        "perspective",
        "part",
        "sub",
        F.size("pieces").alias("n_messages"),
        F.size(F.filter("pieces", lambda x: x["own"])).alias("n_learned"),
        F.concat_ws("", F.transform("pieces", lambda x: F.concat(x["head"], x["said"], F.lit("\n")))).alias("text"),
        F.expr(mask).alias("mask"),
    )


def op5_rotate_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.concat_ws(",", F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))))
    return made.withColumn("mask", spans)


OP5_SQL = f"""
WITH m AS (
  SELECT conv_id, turn::BIGINT turn, coalesce(nullif(role, ''), 'unknown') role, replace(coalesce(text, ''), '<|', '< |') body,
         floor(turn / {PART_TURNS})::BIGINT part, row_number() OVER () rid FROM conversations),
n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS LAST, role, body, rid) - 1) // {PART_MESSAGES} sub FROM m),
speakers AS (SELECT DISTINCT conv_id, role perspective FROM m WHERE role NOT IN ({", ".join(f"'{x}'" for x in NOT_SPEAKERS)})),
r AS (
  SELECT n.conv_id, perspective, part, sub, turn, role, body, rid, role = perspective own,
         '{BEGIN}' || CASE WHEN role = perspective THEN 'assistant' WHEN role IN ({", ".join(f"'{x}'" for x in NOT_SPEAKERS)}) THEN role
           ELSE 'user name=' || replace(url_encode(role), '+', '%20') END || chr(10) head, body || '{END}' said
  FROM n JOIN speakers s ON n.conv_id IS NOT DISTINCT FROM s.conv_id),
w AS (
  SELECT *, coalesce(sum(length(head) + length(said) + 1) OVER (PARTITION BY conv_id, perspective, part, sub ORDER BY turn NULLS LAST, role, body, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT beg FROM r)
SELECT conv_id, perspective, part, sub::BIGINT sub, count(*)::INT n_messages, (count(*) FILTER (own))::INT n_learned,
       string_agg(head || said || chr(10), '' ORDER BY turn NULLS LAST, role, body, rid) AS text,
       coalesce(string_agg((beg + length(head)) || ':' || (beg + length(head) + length(said)), ',' ORDER BY beg) FILTER (own), '') mask
FROM w GROUP BY conv_id, perspective, part, sub
"""
