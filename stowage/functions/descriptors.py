"""Security descriptor text: parsed, written and compared. Sections owner, group and two lists of entries."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_LIST = "struct<flags:string,entries:array<array<string>>>"
DESCRIPTOR = f"struct<owner:string,grp:string,dacl:{_LIST},sacl:{_LIST}>"
_ARROW_LIST = pa.struct([("flags", pa.string()), ("entries", pa.list_(pa.list_(pa.string())))])
_ARROW = pa.struct([("owner", pa.string()), ("grp", pa.string()), ("dacl", _ARROW_LIST), ("sacl", _ARROW_LIST)])
#: What a descriptor's text falls into: quoted strings, brackets, section marks at the top level, separators, all else.
_PIECES = re.compile(r'"(?:[^"\\]|\\.)*"|[OGDS]:|[();]|[^"();OGDS]+|[OGDS]', re.S)
#: Flags that a list can have by itself: fixed values.
_FLAGS = re.compile(r"(?:P|AR|AI|NO_ACCESS_CONTROL)*")
#: Sections in the usual order, without quotes, and entries without brackets inside: what nearly all texts are.
_PLAIN = re.compile("".join([r'(?:O:([^"();:]*?))?(?:G:([^"();:]*?))?', *(rf'(?:{x}:((?:P|AR|AI|NO_ACCESS_CONTROL)*)((?:\([^"()]*\))*))?' for x in "DS")]), re.S)


def _plain(text: str) -> dict | None:
    """What ``parsed`` gives, at one match; None where the text isn't plain."""
    m = _PLAIN.fullmatch(text)
    if m is None:
        return None
    owner, group, *lists = m.groups()
    own = []
    for flags, entries in (lists[:2], lists[2:]):
        split = [e.split(";") for e in entries[1:-1].split(")(")] if entries else []
        if any(len(e) not in (6, 7) for e in split):
            return None
        own.append(None if flags is None else {"flags": flags, "entries": split})
    return {"owner": owner and owner.strip(), "grp": group and group.strip(), "dacl": own[0], "sacl": own[1]}


def parsed(text: str | None) -> dict | None:
    """One descriptor; None where it is none: an unknown section, a bracket or quote left open, an entry outside of a list or of other than six or seven fields."""
    if text is None:
        return None
    return _plain(text) or _any(text)


def _any(text: str) -> dict | None:
    parts: dict[str, str] = {}
    lists: dict[str, list[list[str]]] = {"D": [], "S": []}
    section, depth, end = "", 0, 0
    for m in _PIECES.finditer(text):
        piece, end = m.group(), m.end() if m.start() == end else -1
        if end < 0:
            return None
        if not depth and len(piece) == 2 and piece[1] == ":" and piece[0] in "OGDS" and piece[0] not in parts:
            section = piece[0]
            parts[section] = ""
        elif piece == "(" and not depth:
            if section not in lists:
                return None
            depth = 1
            lists[section].append([""])
        elif depth == 1 and piece == ";":
            lists[section][-1].append("")
        elif depth == 1 and piece == ")":
            depth = 0
        elif depth:
            depth += (piece == "(") - (piece == ")")
            lists[section][-1][-1] += piece
        elif not section or piece == ")" or (lists.get(section) and piece.strip()):
            return None
        else:
            parts[section] += piece
    if depth or end != len(text) or any(len(e) not in (6, 7) for own in lists.values() for e in own):
        return None
    if any(not _FLAGS.fullmatch(parts.get(x, "").strip().upper()) for x in lists):
        return None
    own = lambda x: {"flags": parts[x].strip(), "entries": lists[x]} if x in parts else None
    return {"owner": parts["O"].strip() if "O" in parts else None, "grp": parts["G"].strip() if "G" in parts else None, "dacl": own("D"), "sacl": own("S")}


def parse_descriptor(text: Column) -> Column:
    """owner, grp, dacl and sacl (flags, entries of six or seven fields); NULL where the text is no descriptor. Texts that repeat in a batch are parsed once."""

    @F.arrow_udf(DESCRIPTOR)
    def run(texts: pa.Array) -> pa.Array:
        listed = texts.to_pylist()
        known = {t: parsed(t) for t in set(listed)}
        return pa.array([known[t] for t in listed], _ARROW)

    d = run(text)
    return F.when(F.coalesce(d["owner"], d["grp"], d["dacl"]["flags"], d["sacl"]["flags"]).isNotNull(), d)


def format_descriptor(d: Column, sids: dict[str, str] | None = None) -> Column:
    """The text again; sids: names of accounts that are written as others, as well-known two-letter ones by their full id."""
    named = F.create_map(*[F.lit(x) for pair in (sids or {}).items() for x in pair]) if sids else None
    sid = lambda s: s if named is None else F.coalesce(F.try_element_at(named, s), s)
    fields = lambda e: F.transform(e, lambda f, i: F.when(i == 5, sid(f)).otherwise(f))
    entries = lambda x: F.array_join(F.transform(x["entries"], lambda e: F.concat(F.lit("("), F.array_join(fields(e), ";"), F.lit(")"))), "")
    part = lambda mark, value: F.when(value.isNotNull(), F.concat(F.lit(mark), value)).otherwise("")
    return F.when(d.isNotNull(), F.concat(part("O:", sid(d["owner"])), part("G:", sid(d["grp"])), part("D:", F.concat(d["dacl"]["flags"], entries(d["dacl"]))), part("S:", F.concat(d["sacl"]["flags"], entries(d["sacl"])))))


def _codes(flags: Column) -> Column:
    """Two-letter codes in one order; a lone P is set apart. None or two, as most are, take no list."""
    up = F.upper(F.trim(flags))
    plain = F.regexp_replace(up, "NO_ACCESS_CONTROL$", "")
    lone = F.char_length(plain) % 2 == 1
    pairs = F.regexp_extract_all(F.when(lone, F.regexp_replace(plain, "^([^P]*)P", "$1")).otherwise(plain), F.lit("(..)"), 1)
    general = F.concat(F.when(lone, "P:").otherwise(""), F.array_join(F.sort_array(pairs), ""))
    one, two = F.substring(up, 1, 2), F.substring(up, 3, 2)
    return F.when(up == "", "").when(up.rlike(r"\A[A-Z]{4}\z"), F.when(one <= two, up).otherwise(F.concat(two, one))).otherwise(general)


def comparable(d: Column) -> Column:
    """Equal for descriptors that differ in the order of entries and codes only. An absent list is an empty one."""
    entry = lambda e: F.transform(e, lambda f, i: F.when((i == 1) | (i == 2), _codes(f)).otherwise(f))
    own = lambda x: F.struct(F.coalesce(_codes(x["flags"]), F.lit("")).alias("flags"), F.coalesce(F.sort_array(F.transform(x["entries"], entry)), F.array().cast("array<array<string>>")).alias("entries"))
    return F.when(d.isNotNull(), F.struct(F.coalesce(d["owner"], F.lit("")).alias("owner"), F.coalesce(d["grp"], F.lit("")).alias("grp"), own(d["dacl"]).alias("dacl"), own(d["sacl"]).alias("sacl")))
