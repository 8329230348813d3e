"""Row predicates as Columns. Everything here is total: a NULL input never makes a predicate NULL."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.operators.patterns import MANY, matches_any

_SPECIAL = set(".^$+{}|()\\[]*?")
#: Constructs that one of the three regular-expression dialects in play lacks.
_UNSHARED = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|[*+?}]\+|\(\?\(|\\[GZ]")


def glob_to_regex(pattern: str) -> str | None:
    """A shell pattern as an anchored regular expression; None if malformed. ``*`` and ``?`` stop at ``/``."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "\\":
            if i == len(pattern):
                return None
            out += re.escape(pattern[i]) if pattern[i] in _SPECIAL else pattern[i]
            i += 1
        elif ch == "[":
            found = _class(pattern, i)
            if found is None:
                return None
            out, i = out + found[0], found[1]
        else:
            out += "\\" + ch if ch in _SPECIAL else ch
    return f"^(?s:{out})$"


def _class(pattern: str, i: int) -> tuple[str, int] | None:
    """A bracket expression from after its bracket: (regex, place after it)."""
    negated = i < len(pattern) and pattern[i] == "^"
    i += negated
    parts: list[str] = []
    while True:
        if i >= len(pattern):
            return None
        if pattern[i] == "]" and parts:
            break
        ends = []
        for _ in range(2):
            if i >= len(pattern) or pattern[i] in "-]":
                return None
            if pattern[i] == "\\":
                i += 1
                if i >= len(pattern):
                    return None
            ends.append(pattern[i])
            i += 1
            if not (i < len(pattern) and pattern[i] == "-"):
                break
            if len(ends) == 1:
                i += 1
        parts.append("-".join("\\" + c if c in "\\]^-[&" else c for c in ends))
    return f"[{'^' if negated else ''}{''.join(parts)}]", i + 1


def shared_regex(pattern: str) -> bool:
    """Whether a pattern compiles and stays within what all dialects share."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return not _UNSHARED.search(pattern)


def any_of(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def all_of(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def true(c: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(c, F.lit(False))


def files_only(p: Column, entity: str = "entity_type") -> Column:
    """a predicate for files passes every row that is neither a file nor a hard link."""
    return ~F.coalesce(F.col(entity), F.lit("File")).isin("File", "Hardlink") | p


def include_pattern(patterns: list[str], name: str = "name") -> Column:
    """the name matches one of the globs. Malformed ones are ignored; with none at all, everything passes. Many are walked together."""
    if not patterns:
        return F.lit(True)
    if len(patterns) >= MANY:
        return matches_any(name, patterns)
    return any_of(true(F.col(name).rlike(r)) for r in map(glob_to_regex, patterns) if r is not None)


def exclude_pattern(patterns: list[str], name: str = "name") -> Column:
    """the name matches none of the globs; a malformed one excludes nothing."""
    if len(patterns) >= MANY:
        return ~matches_any(name, patterns)
    return ~any_of(true(F.col(name).rlike(r)) for r in map(glob_to_regex, patterns) if r is not None)


def exclude_path(prefixes: list[str], path: str = "relative_path", whole_components: bool = False) -> Column:
    """the path begins with none of the strings. ``sub`` also excludes ``subway/x`` unless whole components are asked for."""
    if len(prefixes) >= MANY and not whole_components:
        return ~matches_any(path, prefixes=prefixes)
    starts = (true(F.col(path).startswith(p)) for p in prefixes)
    if whole_components:
        starts = (true((F.col(path) == p.rstrip("/")) | F.col(path).startswith(p.rstrip("/") + "/")) for p in prefixes)
    return ~any_of(starts)


def include_regex(patterns: list[str], path: str = "relative_path") -> Column:
    """F8: some pattern is found in the path. Patterns that don't compile are skipped; no pattern passes everything."""
    if not patterns:
        return F.lit(True)
    return any_of(true(F.col(path).rlike(p)) for p in patterns if shared_regex(p))


def exclude_regex(patterns: list[str], path: str = "relative_path") -> Column:
    """F8: no pattern is found in the path. From the first one that doesn't compile on, the rest is not looked at."""
    usable = []
    for p in patterns:
        if not shared_regex(p):
            break
        usable.append(p)
    return ~any_of(true(F.col(path).rlike(p)) for p in usable)


def include_after(moment: str, column: str = "last_modified") -> Column:
    """F9. An unknown time is an error of the scan."""
    return F.when(F.col(column).isNull(), F.raise_error(F.lit("unknown last-modified time"))).otherwise(F.col(column) >= F.lit(moment).cast("timestamp_ntz"))


def include_before(moment: str, column: str = "last_modified") -> Column:
    """F10."""
    return F.when(F.col(column).isNull(), F.raise_error(F.lit("unknown last-modified time"))).otherwise(F.col(column) <= F.lit(moment).cast("timestamp_ntz"))


def exclude_values(values: Iterable[str], column: str) -> Column:
    """blob types or containers that are left out. NULL stays."""
    return ~true(F.col(column).isin(*values))


def permanently_deletable(deleted: str = "is_deleted", snapshot: str = "snapshot_id", version: str = "version_id") -> Column:
    """deleted softly, and a snapshot or a version."""
    return true(F.col(deleted)) & (F.col(snapshot).isNotNull() | F.col(version).isNotNull())


#: Attribute letters and their bits.
ATTRIBUTE_BITS = {"R": 1, "H": 2, "S": 4, "A": 32, "N": 128, "T": 256, "C": 2048, "O": 4096, "I": 8192, "E": 16384}


def attributes(letters: str, include: bool, column: str = "attributes") -> Column:
    """any of the attributes is set (include) or none is (exclude)."""
    mask = reduce(lambda m, c: m | ATTRIBUTE_BITS[c.strip().upper()], filter(str.strip, letters.split(";")), 0)
    hit = F.coalesce(F.col(column), F.lit(0)).bitwiseAND(mask) != 0
    return hit if include else ~hit


def entity_policy(folders: str = "all", symlinks: str = "skip", hardlinks: str = "follow", entity: str = "entity_type", path: str = "relative_path") -> Column:
    """F13, F14. folders: all, all_except_root, none; symlinks: preserve or skip/follow; hardlinks: follow, preserve or skip."""
    kind = F.col(entity)
    folder = {"all": F.lit(True), "all_except_root": F.coalesce(F.col(path), F.lit("")) != "", "none": F.lit(False)}[folders]
    return (
        F.when(kind.isin("File", "FileProperties"), True)
        .when(kind == "Folder", folder)
        .when(kind == "Symlink", F.lit(symlinks == "preserve"))
        .when(kind == "Hardlink", F.lit(hardlinks in ("follow", "preserve")))
        .otherwise(False)
    )


def container_matches(pattern: str, column: str = "container") -> Column:
    """F19. A malformed pattern matches nothing."""
    r = glob_to_regex(pattern)
    return F.lit(False) if r is None else true(F.col(column).rlike(r))


def invalid_name(column: str = "relative_path") -> Column:
    """names that a target without trailing dots can't hold."""
    return true(F.col(column).endswith(".") | F.col(column).contains("./"))


def is_folder_stub(metadata: Column) -> Column:
    """the folder mark under its exact key, else with a capital. A present but NULL exact key hides the other."""
    value = F.when(F.map_contains_key(metadata, "hdi_isfolder"), metadata["hdi_isfolder"]).otherwise(F.try_element_at(metadata, F.lit("Hdi_isfolder")))
    return true(F.lower(value) == "true")


def with_status(wanted: str, status: str = "status") -> Column:
    """All, Failed (every number of -1 and less, so skipped and cancelled too) or one status by name."""
    from stowage.schemas import code_of

    if wanted.lower() == "all":
        return F.lit(True)
    return F.col(status) <= -1 if wanted.lower() == "failed" else F.col(status) == code_of("transfer_status", F.lit(wanted))


def failed_only(status: str = "status") -> Column:
    """Failures without skips and cancellations."""
    return F.col(status).isin(-1, -2, -5)





def is_system_container(column: str = "container") -> Column:
    """by the decoded name; one that can't be decoded is none."""
    return true(F.try_url_decode(F.col(column)).isin("$blobchangefeed", "$logs"))


def collisions(plan: DataFrame, key: str = "destination", ignore_case: bool = True) -> DataFrame:
    """destinations that more than one row of a plan would write, with how many."""
    c = F.lower(F.col(key)) if ignore_case else F.col(key)
    return plan.groupBy(c.alias("destination_key")).agg(F.count("*").alias("writers")).where("writers > 1")


@dataclass
class Filters:
    """The options of a scan. ``column()`` conjoins them in the fixed order."""

    before: str | None = None
    after: str | None = None
    include: list[str] = field(default_factory=list)
    include_attributes: str = ""
    exclude: list[str] = field(default_factory=list)
    exclude_paths: list[str] = field(default_factory=list)
    exclude_attributes: str = ""
    include_regexes: list[str] = field(default_factory=list)
    exclude_regexes: list[str] = field(default_factory=list)
    exclude_blob_types: list[str] = field(default_factory=list)
    recursive: bool = True

    def column(self) -> Column:
        parts: list[Column] = []
        if self.before:
            parts.append(files_only(include_before(self.before)))
        if self.after:
            parts.append(files_only(include_after(self.after)))
        if self.include:
            parts.append(files_only(include_pattern(self.include)))
        if self.include_attributes:
            parts.append(files_only(attributes(self.include_attributes, True)))
        if self.exclude:
            parts.append(files_only(exclude_pattern(self.exclude)))
        if self.exclude_paths:
            parts.append(exclude_path(self.exclude_paths))
        if self.exclude_attributes:
            parts.append(files_only(attributes(self.exclude_attributes, False)))
        if self.include_regexes:
            parts.append(files_only(include_regex(self.include_regexes)))
        if self.exclude_regexes:
            parts.append(files_only(exclude_regex(self.exclude_regexes)))
        if self.exclude_blob_types:
            parts.append(files_only(exclude_values(self.exclude_blob_types, "blob_type")))
        pushed = self.pushdown_prefix()
        return all_of([F.col("relative_path").startswith(pushed)] * bool(pushed) + parts)

    def pushdown_prefix(self) -> str:
        """The literal start of the only include pattern, if it has no wildcard but ``*`` and the scan isn't recursive."""
        if len(self.include) != 1 or self.recursive or re.search(r"[?\[\\]", self.include[0]):
            return ""
        return self.include[0].split("*")[0]

    def folder_option(self, preserve: bool = True, strip_root: bool = False) -> str:
        """any filter for files turns folders off."""
        files = self.before or self.after or self.include or self.exclude or self.include_attributes or self.exclude_attributes or self.include_regexes or self.exclude_regexes or self.exclude_blob_types
        return "none" if files or not preserve else "all_except_root" if strip_root else "all"


def remove_filters(**options) -> Filters:
    """F16: a removal knows no attributes and no blob types."""
    return Filters(**{k: v for k, v in options.items() if k not in ("include_attributes", "exclude_attributes", "exclude_blob_types")})


def set_properties_filters(**options) -> Filters:
    """setting properties knows names and paths only."""
    return Filters(**{k: v for k, v in options.items() if k in ("include", "exclude", "exclude_paths")})
