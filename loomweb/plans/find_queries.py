"""Queries of the block filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import find
from .base import query, read
TERMS = ["the", "of", "in"]


def _threads(spark, sf_dir) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return turns.select("conv_id", F.array_join(F.transform("x", lambda t: t["text"]), "\n\n").alias("thread"))


FIND = """with th as (select conv_id, string_agg(text, chr(10) || chr(10) order by turn) as thread from conversations group by 1),
b as (select conv_id, unnest(string_split(thread, chr(10) || chr(10))) as raw, generate_subscripts(string_split(thread, chr(10) || chr(10)), 1) as place0 from th),
b2 as (select conv_id, place0, trim(raw) as block, lower(trim(raw)) as low from b where trim(raw) <> ''),
b3 as (select conv_id, place0, block, low, (contains(low, 'the')::int + contains(low, 'of')::int + contains(low, 'in')::int) as hits,
 (length(low) - length(replace(low, 'the', ''))) // 3 + (length(low) - length(replace(low, 'of', ''))) // 2 + (length(low) - length(replace(low, 'in', ''))) // 2 as said from b2),
r as (select *, row_number() over (partition by conv_id order by hits desc, said desc, place0) as place, max(hits) over (partition by conv_id) as best from b3 where hits > 0),
k as (select conv_id, best, string_agg(block, chr(10) || chr(10) order by place0) as txt from r where (best = 3 and hits = 3) or (best < 3 and place <= 5) group by 1, 2)
"""


@query(FIND + "select th.conv_id, case when k.best = 3 then 'all' when k.best > 0 then 'partial' else 'none' end as match_mode from th left join k using (conv_id)")
def conv_find_mode(spark, sf_dir):
    return find.find_blocks(_threads(spark, sf_dir), F.col("thread"), TERMS).select("conv_id", "match_mode")


@query(FIND + "select th.conv_id, coalesce(k.txt, '') as filtered_text from th left join k using (conv_id)")
def conv_find_blocks(spark, sf_dir):
    return find.find_blocks(_threads(spark, sf_dir), F.col("thread"), TERMS).select("conv_id", "filtered_text")


@query("select conv_id, turn, case when turn = 0 then 0 else row_number() over (partition by conv_id, turn = 0 order by length(text) desc, turn) end as place from conversations")
def conv_op_vs_replies_rank(spark, sf_dir):
    from pyspark.sql import Window

    own = Window.partitionBy("conv_id", F.col("turn") == 0).orderBy(F.desc(F.length("text")), "turn")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") == 0, 0).otherwise(F.row_number().over(own)).cast("bigint").alias("place"))
