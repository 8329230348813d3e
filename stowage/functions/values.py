"""D, N, X, M, B, U and Z: dates, sizes, hashes, metadata maps, flags and comparisons as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1024 * 1024
#: Limits of block storage.
MAX_BLOCKS, DEFAULT_BLOCK, BLOCK_THRESHOLD, MAX_BLOCK, MAX_PUT = 50_000, 8 * MIB, 256 * MIB, 4_000 * MIB, 5_000 * MIB
#: The accepted forms of a time, from the fullest to the barest.
ISO_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd")


def parse_iso(s: Column) -> Column:
    """A moment; without a zone, in the session's. NULL if no form fits."""
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in ISO_FORMATS])


def format_utc(ts: Column) -> Column:
    """D2."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def bookmark(start: Column, seconds: int = 5) -> Column:
    """D3: from when the next incremental run looks."""
    return start - F.make_dt_interval(secs=F.lit(seconds))


def version_time(version: Column) -> Column:
    """D4."""
    return F.try_to_timestamp(version, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSSX"))


def human_size(size: Column, base: int = 1024, largest: str | None = None) -> Column:
    """Two decimals, ties to even as the exact binary value rounds, by integer arithmetic alone.

    Scaled by 100 the remainder is exact: size * 100 = q * unit + r, and half a unit decides. largest: the unit that
    takes all greater sizes, EiB or EB if not given.
    """
    names = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB") if base == 1024 else ("B", "KB", "MB", "GB", "TB", "PB", "EB")
    names = names[: names.index(largest) + 1] if largest else names
    ladder = None
    for i in range(len(names)):
        unit = base**i
        hundred = size.cast("decimal(38,0)") * F.lit(100).cast("decimal(10,0)")
        r = hundred % F.lit(unit).cast("decimal(38,0)")
        q = ((hundred - r) / F.lit(unit).cast("decimal(38,0)")).cast("decimal(38,0)")
        up = (r * 2 > unit) | ((r * 2 == unit) & (q % 2 == 1))
        n = (q + F.when(up, 1).otherwise(0)).cast("long")
        text = F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"), F.lit(" " + names[i]))
        ladder = text if ladder is None else F.when(size >= unit, text).otherwise(ladder)
    return ladder


def parse_size(text: Column) -> Column:
    """Digits and one of k, m, g; NULL for anything else."""
    n, unit = F.regexp_extract(text, r"^(\d+)([kKmMgG])$", 1), F.lower(F.regexp_extract(text, r"^(\d+)([kKmMgG])$", 2))
    scale = F.when(unit == "k", 1024).when(unit == "m", MIB).when(unit == "g", 1024 * MIB)
    return F.when(n != "", n.try_cast("long") * scale)


def block_size_in_bytes(mib: Column) -> Column:
    """Whole bytes; NULL for negative sizes and for fractions beyond the tolerance."""
    exact = mib * MIB
    return F.when((mib >= 0) & (F.abs(exact - F.round(exact)) < 0.001), F.round(exact).cast("long"))


def _divided_up(a: Column, b: Column) -> Column:
    """The quotient of whole numbers, rounded up; a double would lose the last digits of large ones."""
    return F.call_function("div", a, b) + F.when(a % b > 0, 1).otherwise(0)


def default_block_size(size: Column) -> Column:
    """8 MiB, doubled while the blocks would be too many; beyond the threshold the size divided by the most blocks."""
    block, steps = DEFAULT_BLOCK, []
    while block <= BLOCK_THRESHOLD:
        steps.append((block, F.lit(block).cast("long")))
        block *= 2
    last = _divided_up(size, F.lit(MAX_BLOCKS))
    chosen = F.when(size < MAX_BLOCKS * block, F.lit(block).cast("long")).otherwise(last)
    for b, value in reversed(steps):
        chosen = F.when(size < MAX_BLOCKS * b, value).otherwise(chosen)
    return F.least(chosen, F.lit(MAX_BLOCK).cast("long"))


def chunk_count(size: Column, chunk: Column, put: Column) -> Column:
    """One where a single put does, which an empty object takes too; else the chunks, the last one short."""
    return F.when((size > 0) & (size > put), _divided_up(size, chunk)).otherwise(1).cast("long")


def chunk_problem(size: Column, chunk: Column, put: Column) -> Column:
    """What is wrong with the parameters, or NULL."""
    return (
        F.when(chunk <= 0, "block size must be positive")
        .when(chunk > MAX_BLOCK, "block size too large")
        .when(put > MAX_PUT, "single put too large")
        .when(chunk_count(size, chunk, put) > MAX_BLOCKS, "too many blocks")
    )


def fixed(x: Column, places: int) -> Column:
    """N8."""
    return F.round(x, places)


def megabits(bytes_: Column, seconds: Column) -> Column:
    """N9; NULL where no time has passed."""
    return F.when(seconds > 0, bytes_ * 8 / 1_000_000.0 / seconds)


def md5_check(actual: Column, expected: Column, option: Column) -> Column:
    """Ok, warn or fail under NoCheck, LogOnly, FailIfDifferent, FailIfDifferentOrMissing."""
    missing = F.coalesce(expected, F.lit("")) == ""
    different = ~missing & ~actual.eqNullSafe(expected)
    return (
        F.when(option == "NoCheck", "ok")
        .when(missing, F.when(option == "FailIfDifferentOrMissing", "fail").otherwise("ok"))
        .when(different, F.when(option == "LogOnly", "warn").otherwise("fail"))
        .otherwise("ok")
    )


def transfer_check(planned_size: Column, size: Column, planned_lmt: Column, lmt: Column) -> Column:
    """X3."""
    return F.when(~planned_lmt.eqNullSafe(lmt), "source changed").when(planned_size != size, "length differs")


def same_object(src: Column, dst: Column) -> Column:
    """Host and path equal, and no snapshot or version in the source."""
    bare = lambda u: F.regexp_replace(F.lower(F.substring_index(u, "?", 1)), "/+$", "")
    return (bare(src) == bare(dst)) & ~F.lower(src).rlike(r"[?&](snapshot|sharesnapshot|versionid)=")


# A metadata text is k=v;k=v; a backslash takes the next character literally.
_PAIR = r"((?:[^\\=;]|\\.)*)=((?:[^\\;]|\\.)*)"


def parse_metadata(text: Column) -> Column:
    """M1: NULL where a part has no equals sign before its semicolon."""
    plain = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    # a part that is followed by a semicolon needs a key; one at the end without an equals sign is a key without a value
    parts = F.regexp_extract_all(F.concat(text, F.lit(";")), F.lit(r"((?:[^\\;]|\\.)*);"), 1)
    n = F.size(parts)
    closed = F.slice(parts, 1, F.greatest(n - 1, F.lit(0)))
    broken = F.exists(closed, lambda p: ~p.rlike(rf"^{_PAIR}$"))
    usable = F.filter(parts, lambda p: F.length(p) > 0)
    entry = lambda p: F.struct(plain(F.regexp_extract(p, r"^((?:[^\\=;]|\\.)*)", 1)).alias("k"), plain(F.regexp_extract(p, r"^(?:[^\\=;]|\\.)*=(.*)$", 1)).alias("v"))
    pairs = F.filter(F.transform(usable, entry), lambda e: e["k"] != "")
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["k"]), F.create_map(e["k"], e["v"])))
    return F.when(broken, None).otherwise(last)


def format_metadata(m: Column) -> Column:
    """M2: sorted by key; an empty map is ``clear``."""
    esc = lambda c: F.regexp_replace(c, r"([\\=;])", r"\\$1")
    entries = F.array_sort(F.map_entries(m))
    return F.when(F.size(m) == 0, "clear").otherwise(F.array_join(F.transform(entries, lambda e: F.concat(esc(e["key"]), F.lit("="), esc(F.coalesce(e["value"], F.lit(""))))), ";"))


def valid_key(k: Column) -> Column:
    """M3."""
    return (k == "") | k.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")


def retained(m: Column) -> Column:
    """M4."""
    return F.map_filter(m, lambda k, v: valid_key(k))


def excluded(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~valid_key(k))


def resolved_keys(m: Column) -> Column:
    """M5: an invalid key's value goes under rename_<key>, the key itself under rename_key_<key>; NULL if those are taken."""
    safe = lambda k: F.regexp_replace(k, r"[^0-9A-Za-z_]", "_")
    pair = F.struct
    renamed = F.flatten(
        F.transform(
            F.map_entries(excluded(m)),
            lambda e: F.array(pair(F.concat(F.lit("rename_"), safe(e["key"])).alias("key"), e["value"].alias("value")), pair(F.concat(F.lit("rename_key_"), safe(e["key"])).alias("key"), e["key"].alias("value"))),
        )
    )
    keys = F.concat(F.map_keys(m), F.transform(renamed, lambda e: e["key"]))
    clash = F.size(F.array_distinct(keys)) < F.size(keys)
    return F.when(~clash, F.map_from_entries(F.concat(F.map_entries(retained(m)), renamed)))


def capital(k: Column) -> Column:
    return F.concat(F.upper(F.substring(k, 1, 1)), F.substring(k, 2, 2_000_000))


def read_key(m: Column, k: str) -> Column:
    """M6: under the exact key, else under the one with a capital first letter."""
    return F.when(F.map_contains_key(m, k), F.try_element_at(m, F.lit(k))).otherwise(F.try_element_at(m, capital(F.lit(k))))


def add_key(m: Column, k: str, v: Column) -> Column:
    """M6: only where neither form of the key is there."""
    present = F.map_contains_key(m, k) | F.map_contains_key(m, k[:1].upper() + k[1:])
    return F.when(present, m).otherwise(F.map_concat(m, F.create_map(F.lit(k), v)))


def parse_tags(text: Column) -> Column:
    """M7: empty text is NULL, ``clear`` an empty map, a part without an equals sign a NULL value."""
    entries = F.transform(F.split(text, "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.get(F.split(p, "="), F.lit(1)).alias("value")))
    none = F.create_map().cast("map<string,string>")
    last = F.aggregate(entries, none, lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))
    return F.when(F.lower(text) == "clear", none).when(text != "", last)


def format_tags(m: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "&")


def valid_tags(m: Column) -> Column:
    """M8: at most ten, keys of 1 to 128 characters, values of at most 256, of letters, digits, space and ``+ - . / : = _``."""
    text = r"^[A-Za-z0-9 +\-./:=_]*$"
    return (F.size(m) <= 10) & F.forall(F.map_entries(m), lambda e: F.length(e["key"]).between(1, 128) & (F.length(F.coalesce(e["value"], F.lit(""))) <= 256) & e["key"].rlike(text) & F.coalesce(e["value"], F.lit("")).rlike(text))


def valid_metadata(m: Column) -> Column:
    """M9: keys of letters, digits and underscores."""
    return F.forall(F.map_keys(m), lambda k: k.rlike(r"^[A-Za-z0-9_]*$"))


#: Metadata keys of file-system properties.
POSIX_KEYS = {"owner": "posix_owner", "group": "posix_group", "mode": "permissions", "modtime": "modtime"}


def with_posix(m: Column, **values: Column) -> Column:
    """Properties written as metadata, NULLs left out."""
    added = F.map_filter(F.create_map(*[x for name, v in values.items() for x in (F.lit(POSIX_KEYS[name]), v.cast("string"))]), lambda k, v: v.isNotNull())
    return F.map_concat(without_posix(m), added)


def read_posix(m: Column) -> Column:
    return F.struct(*[F.try_element_at(m, F.lit(k)).try_cast("long").alias(name) for name, k in POSIX_KEYS.items()])


def without_posix(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*POSIX_KEYS.values()))


def map_json(m: Column) -> Column:
    """Keys in order, so that equal maps have equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))), {"ignoreNullFields": "false"})


def parse_retry(spec: Column) -> Column:
    """``408; 503: CodeA, CodeB; -500`` as status -> (code -> retry); ``*`` is every other code."""
    parts = F.filter(F.transform(F.split(spec, ";"), lambda p: F.trim(p)), lambda p: p != "")

    def entry(p: Column) -> Column:
        status = F.trim(F.substring_index(p, ":", 1)).cast("int")
        yes = status > 0
        codes = F.filter(F.transform(F.split(F.when(p.contains(":"), F.regexp_extract(p, ":(.*)$", 1)).otherwise(""), ","), lambda c: F.trim(c)), lambda c: c != "")
        none = F.size(codes) == 0
        listed = F.map_from_entries(F.transform(F.array_distinct(codes), lambda c: F.struct(c, yes)))
        return F.struct(F.abs(status).alias("status"), F.when(none, F.create_map(F.lit("*"), yes)).otherwise(F.map_concat(listed, F.create_map(F.lit("*"), ~yes))).alias("codes"))

    return F.transform(parts, entry)


def merged_retry(original: Column, delta: Column) -> Column:
    """No original gives the delta; a delta of ``*`` alone replaces; else each code of the delta that agrees with the
    original's ``*`` goes, the others are written."""
    star = F.try_element_at(original, F.lit("*"))
    codes = F.map_filter(delta, lambda k, v: k != "*")
    kept = F.map_filter(original, lambda k, v: ~F.array_contains(F.map_keys(codes), k))
    written = F.map_filter(codes, lambda k, v: ~v.eqNullSafe(star))
    return F.when(original.isNull() | (F.size(original) == 0), delta).when(F.size(codes) == 0, delta).otherwise(F.map_concat(kept, written))


def has_flag(flags: Column, bit: int) -> Column:
    """B1."""
    return flags.bitwiseAND(bit) != 0


def pack_pair(a: Column, b: Column) -> Column:
    """B2: two small enumerations in one number."""
    return F.shiftleft(a.cast("int"), 8).bitwiseOR(b.cast("int"))


def unpack_pair(x: Column) -> Column:
    return F.struct(F.shiftright(x, 8).alias("from"), x.bitwiseAND(255).alias("to"))


REMOTE = ("Blob", "File", "BlobFS", "S3", "GCP", "FileNFS")


def direction(src: Column, dst: Column) -> Column:
    """Upload, download, service to service, delete or properties, by the two places."""
    return F.when(dst == "Unknown", "Delete").when(dst == "None", "SetProperties").when(src.isin(*REMOTE) & dst.isin(*REMOTE), "S2S").when(dst.isin(*REMOTE), "Upload").when(src.isin(*REMOTE), "Download").otherwise("Unsupported")


def tier_allowed(tier: Column, kind: Column, sku: Column) -> Column:
    """A page tier needs a premium account, a block tier a standard one that isn't of the first kind."""
    page = tier.rlike("^P[0-9]+$")
    return F.when(page, sku.startswith("Premium")).otherwise(~sku.startswith("Premium") & (kind != "Storage"))


def tags_need_call(tags: Column, limit: int = 2000) -> Column:
    """Whether the tags are too long for a header."""
    return F.aggregate(F.map_entries(tags), F.lit(0), lambda n, e: n + F.length(e["key"]) + F.length(e["value"]) + 2) > limit


def slow_threshold(mean: Column, near_end: Column, backoff: Column) -> Column:
    """Z9."""
    return mean * F.when(near_end, 3).otherwise(10) * backoff


def size_slot(n: Column) -> Column:
    """Exponent of the least power of two that holds n, exactly: the bit length of n - 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by numbers, then a preview is older than its release; two different previews tie."""
    nums = lambda v: F.transform(F.split(F.substring_index(v, "-", 1), r"\."), lambda p: p.cast("long"))
    x, y = nums(a), nums(b)
    pa, pb = a.contains("-"), b.contains("-")
    return F.when(x < y, -1).when(x > y, 1).when(pa & ~pb, -1).when(pb & ~pa, 1).otherwise(0)


def nfs_class(kind: Column, links: Column) -> Column:
    """Symlink, regular, hardlink, directory or special."""
    return F.when(kind == "l", "symlink").when(kind == "d", "directory").when((kind == "f") & (links > 1), "hardlink").when(kind == "f", "regular").otherwise("special")


def acl_key(entries: Column, owner: Column, group: Column) -> Column:
    """Equal for access lists that differ in order only. entries: array of struct(type, flags, rights, sid), flags and rights two letters a code."""
    codes = lambda s: F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(s, F.lit("(..)"), 1))), "")
    one = F.array_sort(F.transform(entries, lambda e: F.concat_ws(";", e["type"], codes(e["flags"]), codes(e["rights"]), e["sid"])))
    return F.concat_ws("|", owner, group, F.array_join(one, ","))


def protocol_clash(source: Column, destination: Column, source_protocol: Column, destination_protocol: Column) -> Column:
    """Why a transfer between these locations can't be, NULL where it can: a share whose protocol isn't the location's. An unknown protocol is SMB."""

    def clash(place: Column, protocol: Column, side: str) -> Column:
        actual = F.coalesce(F.upper(protocol), F.lit("SMB"))
        named = F.when(place == "File", "SMB").when(place == "FileNFS", "NFS")
        return F.when(named.isNotNull() & (actual != named), F.concat(F.lit(f"the {side} share has "), actual, F.lit(" protocol enabled")))

    return F.coalesce(clash(source, source_protocol, "source"), clash(destination, destination_protocol, "destination"))
