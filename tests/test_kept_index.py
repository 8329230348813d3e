from pyspark.sql import functions as F

from stowage.operators import reconcile as r
from stowage.operators.kept_index import KeptIndex
from stowage.sources import scans


def listing(spark, *rows):
    return spark.createDataFrame([("c", path, "File", size, at) for path, size, at in rows], "container string, relative_path string, entity_type string, size long, at string").withColumn("last_modified", F.col("at").cast("timestamp_ntz")).withColumn("md5", F.lit(None).cast("string")).drop("at")


def test_an_index_is_merged_and_joined_without_a_shuffle_of_it(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    index = KeptIndex(spark, str(tmp_path / "index"), buckets=4)
    index.store(listing(spark, ("a", 1, "2024-01-01"), ("a", 2, "2024-01-02"), ("b", 1, "2024-01-01"), ("gone", 1, "2024-01-01")))
    changes = listing(spark, ("b", 9, "2024-01-03"), ("b", 8, "2024-01-02"), ("new", 7, "2024-01-01"), ("gone", 1, "2024-01-01"), ("never", 1, "2024-01-01"))
    index.merge(changes.withColumn("deleted", F.col("relative_path").isin("gone", "never")))
    again = KeptIndex(spark, str(tmp_path / "index"), buckets=4)
    spark.sql(f"drop table {again._table(1)}")
    again.attach(1)
    assert sorted((x.relative_path, x["size"]) for x in again.rows.collect()) == [("a", 2), ("b", 9), ("new", 7)]
    plan = r.sync_plan(listing(spark, ("a", 1, "2024-02-01"), ("x", 1, "2024-01-01")), again.rows, unique=True)
    assert sorted((x.relative_path, x.action) for x in plan.collect()) == [("a", "transfer"), ("b", "delete"), ("new", "delete"), ("x", "transfer")]
    text = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scan = text[: text.index("Bucketed: true")]
    branch = text[text.index("SortMergeJoin") :]
    assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in branch and "FileScan" in scan
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_prefixes_of_like_size(spark):
    paths = [f"deep/and/hot/{i:05d}/x" for i in range(3000)] + [f"cold{i}" for i in range(40)] + ["same"] * 3 + [None]
    rows = spark.createDataFrame([("c" if i % 9 else None, p) for i, p in enumerate(paths)], "container string, relative_path string")
    pieces = scans.even_prefixes(rows, 20).collect()
    assert sum(x.n for x in pieces) == len(paths)
    sizes = {}
    for x in pieces:
        sizes[x.piece] = sizes.get(x.piece, 0) + x.n
    assert max(sizes.values()) < 2 * sum(sizes.values()) / len(sizes) and 15 <= len(sizes) <= 20
