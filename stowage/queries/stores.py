"""Queries of what is written and read back: live folders, stored plans, logs, sidecars, and the client's calls."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from stowage.client import Client
from stowage.functions import paths as pa
from stowage.functions import values as v
from stowage.plans import parts as p
from stowage.queries.registry import query
from stowage.schemas import label_of
from stowage.session import scratch
from stowage.sources import scans
from stowage.sources.folders import folder_listing
from stowage.sources.tables import CHUNKS_SQL, SRC_SQL, chunk_log, source_inventory, table


def _folder_of_names(spark, sf) -> str:
    """A folder for each nation with one file of its suppliers' names, a line each, in a mounted folder."""
    path = scratch(spark, "names")
    names = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.trim("s_name").alias("value"))
    names.repartition("nation").sortWithinPartitions("nation").write.partitionBy("nation").text(path)
    return path.removeprefix("file://")


_NAMES_SQL = "select 'nation=' || s_nationkey as folder, cast(1 as bigint) as files, cast(sum(strlen(trim(s_name)) + 1) as bigint) as bytes from supplier"


@query("S2", "S26", "G4", sql=f"{_NAMES_SQL} group by all")
def scan_local_folder(spark, sf):
    rows = scans.local_files(spark, _folder_of_names(spark, sf)).where("entity_type = 'File' and name like 'part%'")
    return rows.groupBy(F.substring_index("relative_path", "/", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("S2", "S3", "S26", "G2", "G4", sql="""select 'nation=' || s_nationkey as folder, cast(1 as bigint) as files, cast(sum(strlen(trim(s_name)) + 1) as bigint) as bytes from supplier where s_nationkey % 3 <> 1 group by all
union all select 'twice/key=' || n_nationkey, 1, cast(strlen(n_name) + 1 as bigint) from nation""")
def scan_linked_folder(spark, sf):
    """The suppliers' names by nation below one deep branch, with links across it, and the nations' outside, to which two links lead.

    Each folder is listed once. The prefixes and the names are told to the reader, which opens no other folder.
    """
    top, out = scratch(spark, "linked").removeprefix("file://"), scratch(spark, "outside").removeprefix("file://")
    names = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.trim("s_name").alias("value"))
    for part, below in (("nation % 3 = 0", "deep/down/there"), ("nation % 3 = 2", "deep/down/here"), ("nation % 3 = 1", "other")):
        names.where(part).repartition("nation").write.partitionBy("nation").text(f"{top}/{below}")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    nations.repartition("key").write.partitionBy("key").text(out)
    for link, target in (("deep/down/here/across", f"{top}/deep/down/there"), ("deep/up", top), ("deep/zwice", out), ("deep/twice", out)):
        os.symlink(target, f"{top}/{link}")
    rows = folder_listing(spark, top, "relative_path like 'deep/%' and name like 'part%' and entity_type = 'File'", follow_symlinks=True)
    parts = F.split("relative_path", "/")
    folder = F.when(parts[1] == "down", parts[3]).otherwise(F.concat_ws("/", parts[1], parts[2]))
    return rows.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("S4", sql=f"{_NAMES_SQL} where starts_with(cast(s_nationkey as varchar), '1') group by all")
def scan_local_glob(spark, sf):
    rows = scans.local_files(spark, _folder_of_names(spark, sf) + "/nation=1*/part*").where("entity_type = 'File'")
    return rows.groupBy(F.substring_index("relative_path", "/", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("S22", sql="select o_orderkey, o_orderkey % 3 = 0 and o_orderkey % 2 = 0 as is_old from orders")
def json_lists(spark, sf):
    """Lists by their first two lines: an opening brace counts where a key follows."""
    k = F.col("o_orderkey")
    first = F.when(k % 3 == 0, " {").otherwise(F.concat(F.lit("dir/"), k.cast("string")))
    second = F.when(k % 2 == 0, '  "Files": [').otherwise("{}")
    return table(spark, sf, "orders").select("o_orderkey", scans.is_json_list(first, second).alias("is_old"))


_STORED = "p as (select case when doc_id % 3 = 0 then 'ab-1' else 'cd-2' end as job_id, entity_type, size from src where entity_type in ('File', 'Folder'))"


def _client(spark, sf) -> Client:
    """Two jobs' plans, stored."""
    client, rows = Client(spark, scratch(spark, "plans")), source_inventory(spark, sf)
    client.store(client.copy(rows.where("doc_id % 3 = 0"), "ab-1", part_rows=50))
    client.store(client.copy(rows.where("doc_id % 3 <> 0"), "cd-2", part_rows=50))
    return client


@query("K4", "S23", sql=f"with {SRC_SQL}, {_STORED} select job_id, count(*) as n, cast(sum(size) as bigint) as bytes, cast((count(*) + 49) // 50 as bigint) as parts from p where job_id = 'cd-2' group by 1")
def stored_plan(spark, sf):
    """A job's plan, written and read by its prefix: only its folder is opened."""
    plans = spark.read.parquet(_client(spark, sf).plans)
    return scans.plan_scan(plans, "cd").groupBy("job_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.countDistinct("part_num").alias("parts"))


@query("G6", "G8", sql=f"""with {SRC_SQL}, {_STORED} select 'list' as call, job_id, count(*) as n from p group by 2
union all select 'resume', job_id, count(*) from p where job_id = 'ab-1' group by 2 union all select 'transfers', job_id, count(*) from p where job_id = 'cd-2' group by 2
union all values ('clean', 'cd-2', 1), ('remove', 'ab-1', 1)""")
def client_calls(spark, sf):
    """What the library's calls give for two stored jobs."""
    c = _client(spark, sf)
    told = [
        c.list_jobs().select(F.lit("list").alias("call"), "job_id", F.col("total").alias("n")),
        c.resume("ab-1").groupBy("job_id").agg(F.count("*").alias("n")).select(F.lit("resume").alias("call"), "job_id", "n"),
        c.job_transfers("cd-2", "NotStarted").groupBy("job_id").agg(F.count("*").alias("n")).select(F.lit("transfers").alias("call"), "job_id", "n"),
        c.clean(keep=["ab-1"]).select(F.lit("clean").alias("call"), "job_id", F.lit(1).cast("long").alias("n")),
        c.remove("ab-1").select(F.lit("remove").alias("call"), "job_id", F.lit(1).cast("long").alias("n")),
    ]
    out = told[0]
    for t in told[1:]:
        out = out.unionByName(t)
    return out


@query("G6", "G7", sql=f"with {SRC_SQL} select container, entity_type, count(*) as n from src group by all")
def client_events(spark, sf):
    """A handler that is called with each stage's counts; what it was told comes back as rows."""
    told: list[dict] = []
    client = Client(spark, on_progress=told.append)
    client.counted(source_inventory(spark, sf), "container", "entity_type")
    return spark.createDataFrame([(x["container"], x["entity_type"], x["n"]) for x in told], "container string, entity_type string, n long")


@query("K8", sql=f"with {CHUNKS_SQL} select state, count(*) as n, count(distinct name) as names, min(ts) as first from chunks group by 1")
def chunk_log_file(spark, sf):
    path = scratch(spark, "chunk-log")
    p.write_chunk_log(chunk_log(spark, sf), path)
    log = spark.read.option("header", True).csv(path)
    return log.groupBy(F.col("State").alias("state")).agg(F.count("*").alias("n"), F.countDistinct("Name").alias("names"), F.min(F.col("StateStartTime").cast("timestamp_ntz")).alias("first"))


@query("K11", "S27", sql=f"with {SRC_SQL} select relative_path, md5 as hash, last_modified as hash_lmt from src where md5 is not null")
def hash_sidecar_file(spark, sf):
    path = scratch(spark, "hashes")
    p.write_hashes(source_inventory(spark, sf), path)
    return scans.hash_sidecar(spark.read.parquet(path)).select("relative_path", "hash", "hash_lmt")


@query("K12", sql=f"with {SRC_SQL} select count(*) as rows, cast(sum(size) as bigint) as bytes from src")
def measured_plan(spark, sf):
    seen = p.measure(source_inventory(spark, sf), F.sum("size").alias("bytes"))
    return spark.createDataFrame([(seen["rows"], seen["bytes"])], "rows long, bytes long")


@query("C10", sql=r"""select page_id, 'https://h.example/c/' || page_id || case when page_id % 3 = 0 then '?z=1&a=b%20c' else '?%2A=~&SIG=REDACTED&a=b+c&z=' || page_id || '#end' end as url from pages""")
def redacted_urls(spark, sf):
    """Queries with a signature are written anew, sorted by bytes; the others stay."""
    n = F.col("page_id").cast("string")
    query_ = F.when(F.col("page_id") % 3 == 0, "?z=1&a=b%20c").otherwise(F.concat(F.lit("?z="), n, F.lit("&SIG=x%2B/y&a=b%20c&&SIG=again&%2a=%7E&bad=%zz#end")))
    return table(spark, sf, "pages").select("page_id", pa.redacted_url(F.concat(F.lit("https://h.example/c/"), n, query_)).alias("url"))


@query("C3", sql="select p_partkey, case when p_partkey % 2 = 0 then chr(92) else '/' end as sep, '/' as plain from part")
def separators(spark, sf):
    k = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("a\\"), k)).otherwise(F.concat(F.lit("a/"), k))
    return table(spark, sf, "part").select("p_partkey", pa.separator(path, windows=True).alias("sep"), pa.separator(path).alias("plain"))


@query("Z17", sql="""select o_orderkey, case when o_orderkey % 3 = 1 and o_orderkey % 2 = 1 then 'the source share has NFS protocol enabled' when o_orderkey % 3 = 2 and o_orderkey % 2 = 0 then 'the source share has SMB protocol enabled'
  when o_orderkey % 5 = 4 then 'the destination share has SMB protocol enabled' end as clash from orders""")
def protocols(spark, sf):
    k = F.col("o_orderkey")
    source = F.when(k % 3 == 1, "File").when(k % 3 == 2, "FileNFS").otherwise("Blob")
    destination = F.when(k % 5 == 4, label_of("location", F.lit(10))).otherwise("Local")
    return table(spark, sf, "orders").select("o_orderkey", v.protocol_clash(source, destination, F.when(k % 2 == 1, "nfs"), F.lit(None).cast("string")).alias("clash"))
