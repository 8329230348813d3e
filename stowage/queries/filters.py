"""Queries of the predicates over the source inventory."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.operators import patterns
from stowage.operators import predicates as p
from stowage.queries.registry import query
from stowage.sources.tables import SRC_SQL, TRANSFERS_SQL, jobs, source_inventory, table, transfers

_KEYS = ("container", "relative_path", "entity_type")
_OUT = "container, relative_path, entity_type"


def _kept(spark, sf, condition):
    return source_inventory(spark, sf).where(condition).select(*_KEYS)


_FILE = "(entity_type not in ('File', 'Hardlink') or {})"


@query("F1", "F2", "F7", sql=f"with {SRC_SQL} select {_OUT} from src where {_FILE.format(r'''(regexp_matches(name, '^1[^/]*\.txt$') or regexp_matches(name, '^[^/]7\.txt$'))''')}")
def filter_include_pattern(spark, sf):
    return _kept(spark, sf, p.files_only(p.include_pattern(["1*.txt", "?7.txt", "[bad"])))


@query("F5", sql=f"with {SRC_SQL} select {_OUT} from src where {_FILE.format(r'''not regexp_matches(name, '^[0-4][^/]*$')''')}")
def filter_exclude_pattern(spark, sf):
    return _kept(spark, sf, p.files_only(p.exclude_pattern(["[0-4]*", "a[", "none"])))


@query("F6", sql=f"with {SRC_SQL} select {_OUT} from src where not starts_with(relative_path, 'en/1') and not starts_with(relative_path, 'de')")
def filter_exclude_path(spark, sf):
    return _kept(spark, sf, p.exclude_path(["en/1", "de"]))


_MANY_SQL = """{src}, globs as (select cast(o_orderkey as varchar) as k from orders where o_orderkey % 3 = 0), prefixes as (select 'en/' || p_partkey as p from part where p_partkey % 7 = 1)
select {out} from src where (entity_type not in ('File', 'Hardlink') or (length(name) >= 6 and right(name, 4) = '.txt' and left(name, length(name) - 5) in (select k from globs)))
  and not exists (select 1 from prefixes where starts_with(relative_path, p))"""


@query("F5", "F6", "F7", sql=_MANY_SQL.format(src=f"with {SRC_SQL}", out=_OUT))
def filter_many_patterns(spark, sf):
    """Globs of a third of all orders and prefixes of a seventh of all parts, however many: both lists stay tables."""
    globs = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.col("o_orderkey").cast("string"), F.lit("?.txt")).alias("pattern"))
    prefixes = table(spark, sf, "part").where("p_partkey % 7 = 1").select(F.concat(F.lit("en/"), F.col("p_partkey").cast("string")).alias("pattern"))
    rows = patterns.marked(source_inventory(spark, sf).select(*_KEYS, "name"), "name", "wanted", globs=globs)
    rows = patterns.marked(rows, "relative_path", "unwanted", prefixes=prefixes)
    return rows.where(p.files_only(F.col("wanted")) & ~F.col("unwanted")).select(*_KEYS)


@query("F6", sql=f"with {SRC_SQL} select {_OUT} from src where not (relative_path = 'en/1' or starts_with(relative_path, 'en/1/')) and not (relative_path = 'de' or starts_with(relative_path, 'de/'))")
def filter_exclude_path_components(spark, sf):
    return _kept(spark, sf, p.exclude_path(["en/1", "de"], whole_components=True))


@query("F8", sql=f"with {SRC_SQL} select {_OUT} from src where {_FILE.format(r'''(regexp_matches(relative_path, '[05]\.txt') or regexp_matches(relative_path, '^fr/.*3'))''')}")
def filter_include_regex(spark, sf):
    return _kept(spark, sf, p.files_only(p.include_regex([r"[05]\.txt", "^fr/.*3", "(unclosed"])))


@query("F8", sql=f"with {SRC_SQL} select {_OUT} from src where {_FILE.format(r'''not regexp_matches(relative_path, '2\.txt$')''')}")
def filter_exclude_regex_in_order(spark, sf):
    """The patterns after the broken one are not looked at."""
    return _kept(spark, sf, p.files_only(p.exclude_regex([r"2\.txt$", "(unclosed", "^en"])))


@query("F9", "F10", sql=f"with {SRC_SQL} select {_OUT} from src where last_modified >= timestamp '2024-01-01 03:00:00' and last_modified <= timestamp '2024-01-01 09:30:00'")
def filter_dates(spark, sf):
    return _kept(spark, sf, p.include_after("2024-01-01 03:00:00") & p.include_before("2024-01-01 09:30:00"))


@query("F4", "F19", "F24", sql=f"with {SRC_SQL} select {_OUT} from src where regexp_matches(container, '^src1[^/]*$') and container not in ('src11', 'src12') and container not in ('$blobchangefeed', '$logs')")
def filter_containers(spark, sf):
    return _kept(spark, sf, p.container_matches("src1*") & p.exclude_values(["src11", "src12"], "container") & ~p.is_system_container())


@query("F3", sql="select part_key, blob_type from (select p_partkey as part_key, case p_partkey % 4 when 0 then 'BlockBlob' when 1 then 'PageBlob' when 2 then 'AppendBlob' end as blob_type from part) where blob_type is null or blob_type not in ('PageBlob', 'AppendBlob')")
def filter_blob_types(spark, sf):
    k = F.col("p_partkey") % 4
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("part_key"), F.when(k == 0, "BlockBlob").when(k == 1, "PageBlob").when(k == 2, "AppendBlob").alias("blob_type"))
    return rows.where(p.exclude_values(["PageBlob", "AppendBlob"], "blob_type"))


@query("F11", sql="select doc_id from documents where doc_id % 3 = 0 and (doc_id % 2 = 0 or doc_id % 5 = 0)")
def filter_permanent_delete(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", (F.col("doc_id") % 3 == 0).alias("is_deleted"), F.when(F.col("doc_id") % 2 == 0, "s").alias("snapshot_id"), F.when(F.col("doc_id") % 5 == 0, "v").alias("version_id")
    )
    return d.where(p.permanently_deletable()).select("doc_id")


@query("F12", "Z12", sql="select part_key from (select p_partkey as part_key, cast(p_partkey % 64 as integer) as a from part) where (a & 3) <> 0 and (a & 32) = 0")
def filter_attributes(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("part_key"), (F.col("p_partkey") % 64).cast("int").alias("attributes"))
    return rows.where(p.attributes("R;H", True) & p.attributes("A", False)).select("part_key")


@query("F13", "F14", sql=f"with {SRC_SQL} select {_OUT} from src where entity_type in ('File', 'Folder')")
def filter_entity_policy(spark, sf):
    return _kept(spark, sf, p.entity_policy(folders="all_except_root", symlinks="skip"))


@query("F15", "F18", "G1", sql=f"""with {SRC_SQL} select {_OUT} from src where {_FILE.format("last_modified <= timestamp '2024-01-01 12:00:00'")}
  and {_FILE.format(r"regexp_matches(name, '^[^/]*\.txt$')")} and {_FILE.format(r"not regexp_matches(name, '^9[^/]*$')")} and not starts_with(relative_path, 'es/') and {_FILE.format(r"not regexp_matches(relative_path, '11')")}""")
def filter_conjunction(spark, sf):
    f = p.Filters(before="2024-01-01 12:00:00", include=["*.txt"], exclude=["9*"], exclude_paths=["es/"], exclude_regexes=["11"])
    return _kept(spark, sf, f.column())


@query("F16", "F17", sql=f"with {SRC_SQL} select {_OUT} from src where {_FILE.format(r'''regexp_matches(name, '^2[^/]*$')''')} and not starts_with(relative_path, 'fr')")
def filter_remove_and_set_properties(spark, sf):
    a = p.remove_filters(include=["2*"], exclude_paths=["fr"], include_attributes="R")
    b = p.set_properties_filters(include=["2*"], exclude_paths=["fr"], before="1990-01-01 00:00:00")
    return _kept(spark, sf, a.column() & b.column())


@query("G2", sql=f"with {SRC_SQL} select {_OUT} from src where starts_with(relative_path, 'en/1') and {_FILE.format(r'''regexp_matches(relative_path, '^en/1[^/]*$')''')}")
def filter_pushed_prefix(spark, sf):
    """The pattern's literal start goes to the scan beside the pattern itself."""
    f = p.Filters(include=["en/1*"], recursive=False)
    assert f.pushdown_prefix() == "en/1"
    return _kept(spark, sf, F.col("relative_path").startswith(f.pushdown_prefix()) & p.files_only(p.include_pattern(f.include, "relative_path")))


@query("F20", sql=f"with {SRC_SQL} select container, relative_path || case when doc_id % 3 = 0 then '.' when doc_id % 3 = 1 then './x' else '' end as relative_path from src where doc_id % 3 < 2")
def filter_invalid_names(spark, sf):
    tail = F.when(F.col("doc_id") % 3 == 0, ".").when(F.col("doc_id") % 3 == 1, "./x").otherwise("")
    rows = source_inventory(spark, sf).select("container", F.concat("relative_path", tail).alias("relative_path"))
    return rows.where(p.invalid_name())


@query("F21", sql="select doc_id, case when doc_id % 4 = 0 then true when doc_id % 4 = 1 then doc_id % 8 = 1 else false end as is_folder from documents")
def filter_folder_stubs(spark, sf):
    k = F.col("doc_id")
    meta = (
        F.when(k % 4 == 0, F.create_map(F.lit("hdi_isfolder"), F.lit("TRUE")))
        .when(k % 4 == 1, F.create_map(F.lit("Hdi_isfolder"), F.when(k % 8 == 1, "true").otherwise("false")))
        .when(k % 4 == 2, F.create_map(F.lit("hdi_isfolder"), F.lit(None).cast("string"), F.lit("Hdi_isfolder"), F.lit("true")))
        .otherwise(F.create_map(F.lit("other"), F.lit("true")))
    )
    return table(spark, sf, "documents").select("doc_id", p.is_folder_stub(meta).alias("is_folder"))


@query("F22", sql=f"with {TRANSFERS_SQL} select status, count(*) as n, count(*) filter (status in (-1, -2, -5)) as n_failed from transfers where status <= -1 group by status")
def filter_transfer_status(spark, sf):
    rows = transfers(spark, sf).where(p.with_status("Failed"))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count_if(p.failed_only()).alias("n_failed"))


@query("F23", "O1", sql="select o_orderkey as job_id, o_orderdate as start_time, row_number() over (order by o_orderdate desc, o_orderkey) as place from orders where o_orderpriority = '1-URGENT'")
def jobs_by_start(spark, sf):
    """Newest first. The place comes from ranks within days, so no task sorts all jobs."""
    rows = jobs(spark, sf).where(F.col("command") == "1-URGENT").withColumn("day", F.to_date("start_time"))
    days = rows.groupBy("day").agg(F.count("*").alias("n"))
    later = days.select("day", (F.sum("n").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    own = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("start_time"), "job_id"))
    return rows.withColumn("own", own).join(later, "day").select("job_id", "start_time", (F.coalesce("before", F.lit(0)) + F.col("own")).cast("long").alias("place"))


@query("F26", "A22", sql="select lower(left(s_name, 4)) || n_name as destination_key, count(*) as writers from (select s_name, lower(n_name) as n_name from supplier join nation on s_nationkey = n_nationkey) group by 1 having count(*) > 1")
def filter_collisions(spark, sf):
    """Suppliers copied to a file named by their nation, in either case: most collide."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    nation = F.when(F.col("s_suppkey") % 2 == 0, F.upper("n_name")).otherwise(F.lower("n_name"))
    return p.collisions(s.select(F.concat(F.left("s_name", F.lit(4)), nation).alias("destination")))


@query("F25", sql=f"with {SRC_SQL} select distinct md5 from src where md5 is not null and md5 not in (select md5 from src where doc_id < 50 and md5 is not null)")
def filter_unseen(spark, sf):
    rows = source_inventory(spark, sf).where(F.col("md5").isNotNull())
    seen = rows.where("doc_id < 50").select("md5")
    return rows.select("md5").distinct().join(seen, "md5", "left_anti")
