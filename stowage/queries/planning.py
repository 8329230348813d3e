"""Queries of the transfer plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage.functions.values import default_block_size
from stowage.operators import predicates, projections
from stowage.operators.reconcile import chunks_left
from stowage.plans import parts as p
from stowage.queries.registry import query
from stowage.sources.tables import SRC_SQL, TRANSFERS_SQL, source_inventory, table, transfers


@query("P5", "A3", "K6", sql=f"with {SRC_SQL} select container, entity_type, count(*) as n, cast(sum(size) as bigint) as bytes from src where entity_type in ('File', 'Folder') group by all")
def planned_transfers(spark, sf):
    plan = projections.to_transfers(source_inventory(spark, sf), predicates.entity_policy())
    return plan.groupBy("container", "entity_type").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("K1", "W6", "A3", sql=f"""with {SRC_SQL}, n as (select container as job_id, count(*) as n from src group by 1)
select job_id, cast(i as integer) as part_num, least(16, n - i * 16) as rows, i = (n - 1) // 16 as is_final from n, range(0, 100000) t(i) where i * 16 < n""")
def plan_parts(spark, sf):
    rows = source_inventory(spark, sf).withColumnRenamed("container", "job_id")
    cut = p.in_parts(rows, "relative_path", ["relative_path"], part_rows=16)
    return cut.groupBy("job_id", "part_num", "is_final").agg(F.count("*").alias("rows"))


@query("K2", sql=f"""with {SRC_SQL}, k as (select container as job_id, doc_id % 3 = 0 as late from src), n as (select job_id, count(*) filter (not late) as early, count(*) filter (late) as late from k group by 1)
select job_id, (early + 15) // 16 as early_parts, (late + 15) // 16 as late_parts, early, late from n""")
def plan_parts_with_links(spark, sf):
    rows = source_inventory(spark, sf).withColumnRenamed("container", "job_id")
    late = F.col("doc_id") % 3 == 0
    rows = rows.withColumn("entity_type", F.when(late, "Hardlink").otherwise(F.col("entity_type"))).withColumn("target_hardlink", F.when(late, "t"))
    cut = p.in_parts(rows, "relative_path", ["relative_path"], part_rows=16, hardlinks_last=True)
    one = cut.groupBy("job_id").agg(
        F.countDistinct(F.when(F.col("part_class") == 0, F.col("part_num"))).alias("early_parts"), F.countDistinct(F.when(F.col("part_class") == 1, F.col("part_num"))).alias("late_parts"),
        F.count_if(F.col("part_class") == 0).alias("early"), F.count_if(F.col("part_class") == 1).alias("late"),
    )
    return one


@query("E1", "E2", "N5", sql=f"""with {TRANSFERS_SQL}, t as (select job_id, line, part_key, size, count(*) as c from transfers group by all)
select job_id, cast(sum(case when size > 8388608 then (size + 8388607) // 8388608 else 1 end * c) as bigint) as chunks, cast(sum(size * c) as bigint) as bytes from t group by job_id""")
def plan_chunks(spark, sf):
    cut = p.chunks(transfers(spark, sf).select("job_id", "size"))
    return cut.groupBy("job_id").agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes"))


@query("J14", "W5", sql=f"""with {TRANSFERS_SQL} select job_id, count(*) as left_over from (select distinct job_id, part_key, size from transfers where size > 8388608), range(0, 100) t(i)
where i * 8388608 < size and i % 2 = 1 group by job_id""")
def chunks_left_on_resume(spark, sf):
    rows = transfers(spark, sf).where("size > 8388608").select("job_id", "part_key", "size").distinct()
    files = rows.withColumn("block", default_block_size(F.col("size")))
    done = p.chunks(rows).where("chunk % 2 = 0").select("job_id", "part_key", "size", "offset", "length")
    return chunks_left(files, done, "job_id", "part_key", "size").groupBy("job_id").agg(F.count("*").alias("left_over"))


@query("K5", sql="select o_orderkey as job_id, o_orderkey || '--' || lpad(cast(o_orderkey % 7 as varchar), 5, '0') || '.steV21' as file, cast(o_orderkey % 7 as integer) as part_num from orders")
def plan_file_names(spark, sf):
    named = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), p.plan_file_name(F.col("o_orderkey"), (F.col("o_orderkey") % 7).cast("int")).alias("file"))
    return named.select("job_id", "file", p.parsed_plan_name(F.col("file"))["part_num"].alias("part_num"))


@query("K10", "Z14", sql="select o_orderkey as job_id, 'delete' as action from orders where o_orderkey not in (1, 7)")
def history_cleaning(spark, sf):
    return p.history_to_delete(table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id")), keep=["1", "7"])


@query("T8", "T9", sql=f"with {TRANSFERS_SQL} select case when status <= -1 then 5 else status end as status, case when status <= -1 then 0 else 9 end as error_code, count(*) as n from transfers group by all")
def resumed_transfers(spark, sf):
    return p.resumed(transfers(spark, sf).withColumn("error_code", F.lit(9))).groupBy("status", "error_code").agg(F.count("*").alias("n"))


@query("K3", "O5", sql=f"with {SRC_SQL} select container as job_id, count(*) as n, cast(count(*) as bigint) as places from src group by 1")
def shuffled_parts(spark, sf):
    rows = source_inventory(spark, sf).withColumnRenamed("container", "job_id")
    mixed = p.in_random_order(p.in_parts(rows, "relative_path", ["relative_path"]), 7)
    return mixed.groupBy("job_id").agg(F.count("*").alias("n"), F.countDistinct("part_num", "place").alias("places"))
