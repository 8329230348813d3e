"""Paths, URLs and names as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROOT_MARK = "\x00"
#: Characters that a file share can't hold, with their escapes.
UNSAFE = {"<": "%3C", ">": "%3E", "\\": "%5C", "/": "%2F", ":": "%3A", '"': "%22", "|": "%7C", "?": "%3F", "*": "%2A"}


def full_path(root: Column, child: Column) -> Column:
    """One slash between root and child; the root mark asks for the root with a slash at its end."""
    bare = F.regexp_replace(root, "/$", "")
    return F.when(child == ROOT_MARK, F.concat(bare, F.lit("/"))).when(child == "", root).when(root == "", child).otherwise(F.concat(bare, F.lit("/"), F.regexp_replace(child, "^/", "")))


def full_path_with_query(root: Column, child: Column, query: Column) -> Column:
    """C2."""
    p = full_path(root, child)
    return F.when(F.coalesce(query, F.lit("")) == "", p).otherwise(F.concat(p, F.lit("?"), query))


def before_wildcard(path: Column) -> Column:
    """C4: the whole path without a ``*``, else what stands before it, up to the last slash."""
    literal = F.regexp_replace(F.substring_index(path, "*", 1), "/+", "/")
    return F.when(~path.contains("*"), path).otherwise(F.regexp_extract(literal, "^(.*/)?[^/]*$", 1))


def clean_path(path: Column) -> Column:
    """Single slashes, no ``.``, ``..`` folded away; a leading double slash stays, nothing is ``.``."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")

    def step(done: Column, p: Column) -> Column:
        up = p == ".."
        can_drop = (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("")), done), -1) != "..")
        return F.when(up & can_drop, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(up & rooted, done).otherwise(F.concat(done, F.array(p)))

    joined = F.array_join(F.aggregate(parts, empty, step), "/")
    out = F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", ".").otherwise(joined))
    return F.when(path.startswith("//"), F.concat(F.lit("/"), out)).otherwise(out)


def starts_with(s: Column, prefix: Column) -> Column:
    """Whatever the case."""
    return F.lower(s).startswith(F.lower(prefix))


def escape_unsafe(path: Column) -> Column:
    """C7, towards a file share: the unsafe characters of each segment."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: reduce(lambda c, u: F.replace(c, F.lit(u[0]), F.lit(u[1])), UNSAFE.items(), p)), "/")


def unescape_unsafe(path: Column) -> Column:
    """C7, from a file share: upper-case escapes only."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: reduce(lambda c, u: F.replace(c, F.lit(u[1]), F.lit(u[0])), UNSAFE.items(), p)), "/")


def escape_segments(path: Column) -> Column:
    """C7, for URLs: percent escapes in each segment; ``$ & + : = @`` and the unreserved characters stay."""

    def one(p: Column) -> Column:
        c = F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))
        for ch, code in (("*", "%2A"),):
            c = F.replace(c, F.lit(ch), F.lit(code))
        for code, ch in (("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3A", ":"), ("%3D", "="), ("%40", "@"), ("%7E", "~")):
            c = F.replace(c, F.lit(code), F.lit(ch))
        return c

    return F.array_join(F.transform(F.split(path, "/"), one), "/")


def strip_compression(path: Column, encoding: Column) -> Column:
    """C8."""
    e = F.lower(encoding)
    return F.when(e == "gzip", F.regexp_replace(path, r"(?i)\.(gz|gzip)$", "")).when(e == "deflate", F.regexp_replace(path, r"(?i)\.zz$", "")).otherwise(path)


def plus_decoded(url: Column) -> Column:
    """A plus in the path is a space, one in the query is not."""
    head, query = F.substring_index(url, "?", 1), F.regexp_extract(url, r"(\?.*)$", 1)
    return F.concat(F.replace(head, F.lit("+"), F.lit("%20")), query)


def redact_query(url: Column) -> Column:
    """Values of signature parameters."""
    return F.regexp_replace(url, r"(?i)([?&](?:sig|x-amz-signature|x-amz-credential)=)[^&#]*", "$1REDACTED")


#: The query parameters whose values are secrets.
SECRET_PARAMETERS = ("sig", "x-amz-signature", "x-amz-credential")


def _query_encoded(text: Column) -> Column:
    """As in a form, but ``*`` is escaped and ``~`` isn't."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def redacted_url(url: Column) -> Column:
    """A URL with a secret parameter gets its query written anew: pairs decoded, sorted by name, a secret once and REDACTED. Others, and local paths, stay as they are."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pair = lambda p, i: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("name"), i.alias("place"), F.try_url_decode(F.when(p.contains("="), F.regexp_extract(p, "=(.*)$", 1)).otherwise("")).alias("value"))
    pairs = F.filter(F.transform(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.contains(";")), pair), lambda p: p["name"].isNotNull() & p["value"].isNotNull())
    secret = lambda p: F.lower(p["name"]).isin(*SECRET_PARAMETERS)
    once = F.filter(pairs, lambda p, i: ~secret(p) | (F.array_position(F.transform(pairs, lambda q: q["name"]), p["name"]) == i + 1))
    written = F.array_join(F.transform(F.array_sort(once), lambda p: F.concat(_query_encoded(p["name"]), F.lit("="), F.when(secret(p), "REDACTED").otherwise(_query_encoded(p["value"])))), "&")
    has_host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1) != ""
    return F.when(has_host & F.exists(pairs, secret), F.concat(F.substring_index(url, "?", 1), F.lit("?"), written, F.regexp_extract(url, "(#.*)$", 1))).otherwise(url)


def separator(path: Column, windows: bool = False) -> Column:
    """A backslash only for Windows paths that hold one; one with both is an error."""
    if not windows:
        return F.lit("/")
    back = path.contains("\\")
    return F.when(back & path.contains("/"), F.raise_error(F.lit("a path has both separators"))).when(back, "\\").otherwise("/")


def redact_text(message: Column) -> Column:
    """C11: what follows sig, signature, token or credential and a colon or equals sign."""
    return F.regexp_replace(message, r"(?i)((?:sig|signature|token|credential)[ \t]*[:=][ \t]*)([^& ,;\t\n\r]+)", "$1-REDACTED-")


def url_parts(url: Column) -> Column:
    """Struct of scheme, host, container, object, query of a path-style URL."""
    path = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*/?([^?#]*)", 1)
    return F.struct(
        F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)).alias("scheme"),
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.substring_index(path, "/", 1).alias("container"),
        F.when(path.contains("/"), F.regexp_extract(path, r"^[^/]*/(.*)$", 1)).otherwise("").alias("object"),
        F.regexp_extract(url, r"\?([^#]*)", 1).alias("query"),
    )


def s3_parts(url: Column) -> Column:
    """Bucket, key, region of path-style and virtual-host-style URLs."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^https?://[^/?#]*/?([^?#]*)", 1)
    virtual = F.regexp_extract(host, r"^(.+)\.s3[.-]", 1)
    region = F.regexp_extract(host, r"(?:^|\.)s3[.-](?:dualstack\.)?([a-z0-9-]*)\.?amazonaws\.com", 1)
    return F.struct(
        F.when(virtual != "", virtual).otherwise(F.substring_index(path, "/", 1)).alias("bucket"),
        F.when(virtual != "", path).otherwise(F.regexp_extract(path, r"^[^/]*/(.*)$", 1)).alias("key"),
        region.alias("region"),
    )


def split_resource(raw: Column) -> Column:
    """What stands before the query and the query itself."""
    return F.struct(F.substring_index(raw, "?", 1).alias("resource"), F.regexp_extract(raw, r"\?(.*)$", 1).alias("token"))


def location(arg: Column) -> Column:
    """The kind of place an argument names, by its host."""
    host = F.lower(F.regexp_extract(arg, r"(?i)^https?://([^/?#]+)", 1))
    return (
        F.when(arg == "pipe", "Pipe")
        .when(host == "", "Local")
        .when(host.contains(".blob"), "Blob")
        .when(host.contains(".file"), "File")
        .when(host.contains(".dfs"), "BlobFS")
        .when(host.contains("benchmark.invalid"), "Benchmark")
        .when(host.rlike(r"^\d+\.\d+\.\d+\.\d+"), "Unknown")
        .when(host.rlike(r"(^|\.)s3[.-]([a-z0-9.-]*\.)?amazonaws\.com$|(^|\.)s3\.amazonaws\.com$"), "S3")
        .when(host.contains("storage.cloud.google.com"), "GCP")
        .otherwise("Unknown")
    )


def level(url: Column, kind: Column) -> Column:
    """C17, C20: Service, Container or Object; local places are Object, folders when they end in a slash are Container."""
    p = url_parts(url)
    remote = F.when((p["container"] == "") | p["container"].contains("*"), "Service").when(p["object"] == "", "Container").otherwise("Object")
    return F.when(kind.isin("Local", "Pipe"), F.when(url.endswith("/"), "Container").otherwise("Object")).otherwise(remote)


def without_trailing_wildcard(url: Column) -> Column:
    """A final ``/*`` goes; after a double slash only the star does."""
    return F.regexp_replace(F.regexp_replace(url, r"//\*(\?|$)", "//$1"), r"/\*(\?|$)", "$1")


def resolved_bucket(name: Column, underscores: bool = False) -> Column:
    """Periods (and underscores) become hyphens, and a run of n > 1 hyphens becomes -n-."""
    plain = F.translate(name, "._", "--") if underscores else F.replace(name, F.lit("."), F.lit("-"))
    runs = F.regexp_extract_all(plain, F.lit("(-+|[^-]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.startswith("--"), F.concat(F.lit("-"), F.length(r).cast("string"), F.lit("-"))).otherwise(r)), "")


def needs_resolving(name: Column, underscores: bool = False) -> Column:
    return name.contains(".") | name.contains("--") | (name.contains("_") if underscores else F.lit(False))


def resolve_buckets(buckets: DataFrame, underscores: bool = False, longest: int = 63) -> DataFrame:
    """bucket, resolved: distinct names; a name that is taken gets -2, -3, ...; NULL where it would be too long.

    Originals come first, then the others by name, so the outcome doesn't depend on the order of listing. Suffixes are
    ranks within a resolved name; those that would hit an original name skip it.
    """
    names = buckets.select("bucket").distinct()
    todo = names.where(needs_resolving(F.col("bucket"), underscores)).withColumn("base", resolved_bucket(F.col("bucket"), underscores))
    taken = names.select(F.col("bucket").alias("t"))
    stem = F.regexp_extract("t", r"^(.*)-(\d{1,3})$", 1)
    suffix = F.regexp_extract("t", r"^(.*)-(\d{1,3})$", 2)
    blocked = taken.where(suffix != "").select(stem.alias("base"), suffix.cast("int").alias("k")).where("k >= 2").groupBy("base").agg(F.sort_array(F.collect_set("k")).alias("skip"))
    first = todo.join(taken, F.col("base") == F.col("t"), "left").withColumn("from", F.when(F.col("t").isNotNull(), 2).otherwise(1)).drop("t")
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("base").orderBy("bucket")) + F.col("from") - 1).join(blocked, "base", "left")
    skips = F.aggregate(F.coalesce("skip", F.array().cast("array<int>")), F.col("r"), lambda r, k: F.when((k <= r) & (r >= 2), r + 1).otherwise(r))
    named = ranked.withColumn("n", skips).select("bucket", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))).alias("resolved"))
    kept = names.where(~needs_resolving(F.col("bucket"), underscores)).select("bucket", F.col("bucket").alias("resolved"))
    return kept.unionByName(named).select("bucket", F.when(F.length("resolved") <= longest, F.col("resolved")).alias("resolved"))


def blob_type(name: Column, default: str = "BlockBlob") -> Column:
    """C23."""
    return F.when(F.lower(name).rlike(r"\.(vhd|vhdx)$"), "PageBlob").otherwise(default)


#: Content types by extension.
CONTENT_TYPES = {".css": "text/css", ".gif": "image/gif", ".htm": "text/html", ".html": "text/html", ".jpeg": "image/jpeg", ".jpg": "image/jpeg", ".js": "application/javascript", ".json": "application/json", ".pdf": "application/pdf", ".png": "image/png", ".svg": "image/svg+xml", ".txt": "text/plain", ".xml": "text/xml"}


def content_type(name: Column) -> Column:
    """By extension; NULL where only the content could tell."""
    pairs = [F.lit(x) for p in CONTENT_TYPES.items() for x in p]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1)))


def block_id(prefix: Column, index: Column) -> Column:
    """C25."""
    return F.base64(F.concat(prefix, F.lpad(index.cast("string"), 5, "0")))
