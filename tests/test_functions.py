import pytest
from pyspark.sql import functions as F

from stowage.functions import paths as pa
from stowage.functions import values as v
from stowage.schemas import INVENTORY, cleaned, code_of, domain, label_of


@pytest.fixture(scope="module")
def of(spark):
    one = spark.range(1)

    def value(column):
        return one.select(column.alias("x")).first()["x"]

    return value


@pytest.mark.parametrize("size,text", [(50, "50.00 B"), (125, "125.00 B"), (1152, "1.12 KiB"), (1024, "1.00 KiB"), (1023, "1023.00 B"), (0, "0.00 B"), (1536 * 1024, "1.50 MiB"), (2**60, "1.00 EiB"), (9_223_372_036_854_775_807, "8.00 EiB"), (1157, "1.13 KiB")])
def test_human_size(of, size, text):
    assert of(v.human_size(F.lit(size).cast("long"))) == text


@pytest.mark.parametrize("text,size", [("123K", 123 * 1024), ("456m", 456 * 1024**2), ("789G", 789 * 1024**3), ("123", None), ("123 K", None), ("", None)])
def test_parse_size(of, text, size):
    assert of(v.parse_size(F.lit(text))) == size


@pytest.mark.parametrize("size,block", [(0, 8 << 20), (50_000 * (8 << 20) - 1, 8 << 20), (50_000 * (8 << 20), 16 << 20), (50_000 * (512 << 20), 512 << 20), (50_000 * (600 << 20) + 1, (600 << 20) + 1), (10**15, 4_000 << 20)])
def test_default_block_size(of, size, block):
    assert of(v.default_block_size(F.lit(size).cast("long"))) == block


@pytest.mark.parametrize("size,n", [(0, 1), (8, 1), (9, 2), (16, 2), (17, 3)])
def test_chunk_count(of, size, n):
    assert of(v.chunk_count(F.lit(size).cast("long"), F.lit(8), F.lit(8))) == n


@pytest.mark.parametrize("bucket,out", [("bucket.name.1", "bucket-name-1"), ("bucket--name", "bucket-2-name"), ("b---n.x", "b-3-n-x"), ("plain", "plain")])
def test_bucket_rule(of, bucket, out):
    assert of(pa.resolved_bucket(F.lit(bucket))) == out


def test_bucket_collisions(spark):
    names = ["a.b", "a-b", "a-b-2", "x.y", "x_y", "long." + "n" * 70]
    got = {r.bucket: r.resolved for r in pa.resolve_buckets(spark.createDataFrame([(n,) for n in names], "bucket string")).collect()}
    assert got == {"a.b": "a-b-3", "a-b": "a-b", "a-b-2": "a-b-2", "x.y": "x-y", "x_y": "x_y", names[-1]: None}
    under = {r.bucket: r.resolved for r in pa.resolve_buckets(spark.createDataFrame([("x.y",), ("x_y",)], "bucket string"), underscores=True).collect()}
    assert under == {"x.y": "x-y", "x_y": "x-y-2"}


@pytest.mark.parametrize("path,out", [("a//b/./c", "a/b/c"), ("/../a", "/a"), ("a/../..", ".."), ("", "."), ("//h/x", "//h/x"), ("a/..", "."), ("/", "/")])
def test_clean_path(of, path, out):
    assert of(pa.clean_path(F.lit(path))) == out


@pytest.mark.parametrize("path,out", [("/a/b*c", "/a/"), ("a*", ""), ("/a/b", "/a/b"), ("/a//b/*/c", "/a/b/")])
def test_before_wildcard(of, path, out):
    assert of(pa.before_wildcard(F.lit(path))) == out


def test_full_path(of):
    full = lambda r, c: of(pa.full_path(F.lit(r), F.lit(c)))
    assert (full("r/", "c"), full("r", "/c"), full("r", ""), full("", "c"), full("r", "\x00")) == ("r/c", "r/c", "r", "c", "r/")


@pytest.mark.parametrize("text,out", [("a=b;c=d", {"a": "b", "c": "d"}), (r"a\;b=c\=d", {"a;b": "c=d"}), ("a=b=c", {"a": "b=c"}), ("a;b=c", None), ("", {}), ("a=1;a=2", {"a": "2"}), ("k", {"k": ""}), (r"a=b\;c=d", {"a": "b;c=d"})])
def test_parse_metadata(of, text, out):
    assert of(v.parse_metadata(F.lit(text))) == out


def test_metadata_round_trip(of):
    m = F.create_map(F.lit("a;b"), F.lit("c=d\\"), F.lit("x"), F.lit("y"))
    assert of(v.parse_metadata(v.format_metadata(m))) == {"a;b": "c=d\\", "x": "y"}
    assert of(v.format_metadata(F.create_map().cast("map<string,string>"))) == "clear"


def test_keys(of):
    m = F.create_map(F.lit("1-bad"), F.lit("v"), F.lit("ok"), F.lit("w"))
    assert of(v.resolved_keys(m)) == {"ok": "w", "rename_1_bad": "v", "rename_key_1_bad": "1-bad"}
    assert of(v.resolved_keys(F.create_map(F.lit("a-b"), F.lit("1"), F.lit("rename_a_b"), F.lit("2")))) is None
    assert of(v.retained(m)) == {"ok": "w"} and of(v.excluded(m)) == {"1-bad": "v"} and of(v.valid_key(F.lit("")))
    assert of(v.read_key(F.create_map(F.lit("Key"), F.lit("1")), "key")) == "1" and of(v.read_key(F.create_map(F.lit("KEY"), F.lit("1")), "key")) is None


def test_tags(of):
    assert of(v.parse_tags(F.lit("a=1&b=2"))) == {"a": "1", "b": "2"} and of(v.parse_tags(F.lit("Clear"))) == {} and of(v.parse_tags(F.lit(""))) is None and of(v.parse_tags(F.lit("a"))) == {"a": None}
    assert not of(v.valid_tags(F.create_map(F.lit(""), F.lit("x")))) and not of(v.valid_tags(F.create_map(F.lit("k"), F.lit("x" * 257))))


def test_retry_rules_merge(of):
    m = lambda **k: F.create_map(*[F.lit(x) for p in k.items() for x in p])
    star = {"*": True}
    base = F.create_map(F.lit("*"), F.lit(True), F.lit("A"), F.lit(False))
    assert of(v.merged_retry(base, m(A=True, B=False))) == {"*": True, "B": False}
    assert of(v.merged_retry(base, F.create_map(F.lit("*"), F.lit(False)))) == {"*": False}
    assert of(v.merged_retry(F.lit(None).cast("map<string,boolean>"), m(B=True))) == {"B": True} and star


@pytest.mark.parametrize("a,b,out", [("10.1.0", "10.2.0", -1), ("10.10.0", "10.9.9", 1), ("10.1.0-preview", "10.1.0", -1), ("10.1.0-preview", "10.1.0-beta", 0), ("1.0.0", "1.0.0", 0)])
def test_versions(of, a, b, out):
    assert of(v.compare_versions(F.lit(a), F.lit(b))) == out


@pytest.mark.parametrize("n,slot", [(0, 0), (1, 0), (2, 1), (3, 2), (4, 2), (5, 3), (2**40, 40), (2**40 + 1, 41)])
def test_slots(of, n, slot):
    assert of(v.size_slot(F.lit(n).cast("long"))) == slot


@pytest.mark.parametrize("text", ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.1234567Z", "2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05", "2024-01-02T03:04", "2024-01-02"])
def test_iso_dates(of, text):
    assert of(v.parse_iso(F.lit(text))) is not None


@pytest.mark.parametrize("text", ["2024-13-01", "01/02/2024", "2024-01-02 03:04", "x"])
def test_bad_dates(of, text):
    assert of(v.parse_iso(F.lit(text))) is None


def test_redaction(of):
    assert of(pa.redact_query(F.lit("https://h/c?sv=1&SIG=ab&X-Amz-Signature=q#f"))) == "https://h/c?sv=1&SIG=REDACTED&X-Amz-Signature=REDACTED#f"
    assert of(pa.redact_text(F.lit("sig=abc&x=1 Token : zz; fine"))) == "sig=-REDACTED-&x=1 Token : -REDACTED-; fine"


def test_urls(of):
    p = of(pa.s3_parts(F.lit("https://bkt.s3.us-west-2.amazonaws.com/a/b.txt")))
    assert (p.bucket, p.key, p.region) == ("bkt", "a/b.txt", "us-west-2")
    p = of(pa.s3_parts(F.lit("https://s3.amazonaws.com/bkt/a")))
    assert (p.bucket, p.key, p.region) == ("bkt", "a", "")
    assert of(pa.location(F.lit("https://b.s3.amazonaws.com/x"))) == "S3" and of(pa.location(F.lit("/x"))) == "Local" and of(pa.location(F.lit("https://a.dfs.example.net/x"))) == "BlobFS"
    assert of(pa.without_trailing_wildcard(F.lit("https://h/c/*"))) == "https://h/c" and of(pa.without_trailing_wildcard(F.lit("https://h/c//*"))) == "https://h/c//"


def test_compression_names(of):
    s = lambda p, e: of(pa.strip_compression(F.lit(p), F.lit(e)))
    assert (s("a.GZ", "gzip"), s("a.gzip", "GZIP"), s("a.zz", "deflate"), s("a.gz", "br"), s("a.gz", None)) == ("a", "a", "a", "a.gz", "a.gz")


def test_enumerations(spark, of):
    assert of(code_of("transfer_status", F.lit("SKIPPEDentityalreadyexists"))) == -3 and of(code_of("location", F.lit("nowhere"))) is None
    assert of(label_of("job_status", F.lit(7))) == "CompletedWithErrorsAndSkipped" and domain(spark, "entity_type").count() == 6


def test_sentinels_become_null(spark):
    raw = spark.createDataFrame([("a", "Folder", 7, "", "0001-01-01 00:00:00")], "relative_path string, entity_type string, size long, md5 string, last_modified string")
    row = cleaned(raw.withColumn("last_modified", F.col("last_modified").cast("timestamp_ntz"))).first()
    assert row.size == 0 or row["size"] == 0
    assert row.md5 is None and row.last_modified is None and row.name == "" and len(row) == len(INVENTORY.fields)
