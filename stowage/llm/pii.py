"""Personal data: fixed base patterns, then bootstrapped contextual extraction.

Base spans are the leftmost non-overlapping matches of four patterns; a match that fails its check is dropped. Each
base match is a seed entity, and so is a secret in a published format. Seeds induce lexical patterns from their line:
the two words before them, the words on both sides, the word and punctuation right before them (``token = "``), and for
secrets that punctuation with the value's shape in place of words. Strings that only look like an identifier (an
unprefixed phone number, an address written with "at" and "dot", a value after ``=`` or ``:``) are unknown instances of the
patterns they stand in; plain words or numbers in a value's place count against its patterns. Spark scores the
pattern-instance graph in rounds: a pattern's confidence is the share of its instances' scores, where an unknown one
weighs UNKNOWN against it; an unknown instance's score is the noisy-or of its patterns. Instances over the threshold join
the spans wherever they stand, with or without context; in the next round they vouch for further patterns.

Defined results: a null text is empty; rows with the same doc_id, also a null one, are each reported by themselves; offsets are
code points, end exclusive; a discovered span never overlaps a base span; an empty table gives no rows; the caller's
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import small_batches, staged

#: The kinds in their order of listing.
KINDS = ("email", "ip", "card", "phone")
#: The base kinds and what only the method finds.
ALL_KINDS = (*KINDS, "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match never ends before a digit, so a search can resume only at the start of a run of digits.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:\x20?[0-9]|-[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = {
    "ip": re.compile(r"\b[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){4,7}\b"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{1,7}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
}
_AT = re.compile(r" at | ?\(at\) ?| ?\[at\] ?|@")
_LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?: dot | ?\(dot\) ?| ?\[dot\] ?|\.)[A-Za-z]{2,24}\b")
#: Published formats of access keys, and long hexadecimal strings.
_KEY = re.compile(r"(?<![0-9A-Za-z_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|[0-9a-f]{32,64})(?![0-9A-Za-z_])")
#: What stands after an assignment.
_VALUE = re.compile(r"""[=:]\x20?["']?([A-Za-z0-9+/_.-]+)""")
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
MIN_SEEDS, SMOOTHING, THRESHOLD, ROUNDS = 4, 1.0, 0.7, 3
#: What an unknown instance weighs against a pattern, where a seed weighs 1 for it.
UNKNOWN = 0.25
#: Characters of a value from which it can be a secret, and from which its shape is that of a long one.
VALUE_CHARS, LONG_VALUE = 8, 16


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @, leftwards to the last match at most: the same matches as the pattern's, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 * (d > "4")) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    found = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 40 and 16 <= len(digits := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    return found


def _before(text: str, line: int, start: int) -> tuple[list[str], str]:
    """The last two words of text[line:start], lower case, and what stands after them."""
    reach = 128
    while True:
        low = max(line, start - reach)
        words = list(_WORD.finditer(text, low, start))
        if low > line and words and words[0].start() == low:
            words = words[1:]  # it may be cut
        if len(words) >= 2 or low == line:
            rest = text[words[-1].end() if words else low : start]
            return [w.group().lower() for w in words[-2:]], "".join(rest.split())
        reach *= 4


def shape(value: str) -> str:
    """The generalised form of a value: its alphabet, and whether it is long."""
    size = "long" if len(value) >= LONG_VALUE else "short"
    if not _LETTER.search(value):
        return f"digits {size}"
    kind = "word" if not _DIGIT.search(value) else "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", value) else "upper" if value.isupper() else "mixed"
    return f"{kind} {size}"


def patterns_of(text: str, kind: str, start: int, stop: int) -> list[str]:
    """The lexical patterns that an identifier at this place stands in."""
    words, glue = _before(text, text.rfind("\n", 0, start) + 1, start)
    end = text.find("\n", stop)
    after = _WORD.search(text, stop, len(text) if end < 0 else end)
    found = []
    if len(words) == 2:
        found.append("before " + " ".join(words))
    if words and after:
        found.append(f"between {words[-1]} {after.group().lower()}")
    if words and glue:
        found.append(f"after {words[-1]}{glue}")
    if kind == "secret" and glue:
        found.append(f"slot {glue[:1]} {shape(text[start:stop])}")
    return found


def _loose_emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL and m.start() - start < 64:
            start -= 1
        right = _LOOSE_DOMAIN.match(text, m.end()) if start < m.start() else None
        if right:
            yield start, right.end()
            done = right.end()


def _candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
    """(kind, start, stop, label): label 1 for seeds, 0 for unknown instances, -1 for what can't be an identifier in a value's place."""
    found = {(k, s, e): 1 for k, s, e in base}

    def add(kind: str, start: int, stop: int, label: int) -> None:
        if not any(s < stop and start < e for _, s, e in base):
            found[kind, start, stop] = max(label, found.get((kind, start, stop), -1))

    if "@" in text or " at " in text or "(at)" in text or "[at]" in text:
        for s, e in _loose_emails(text):
            add("email", s, e, 0)
    if _DIGIT.search(text):
        for kind, loose in _LOOSE.items():
            for m in loose.finditer(text):
                add(kind, *m.span(), 0)
        for m in _KEY.finditer(text):
            if _LETTER.search(m.group()) and _DIGIT.search(m.group()):
                add("secret", *m.span(), 1)
    for m in _VALUE.finditer(text):
        value = m.group(1).rstrip(".")
        could = len(value) >= VALUE_CHARS and _LETTER.search(value) and _DIGIT.search(value)
        if value:
            add("secret", m.start(1), m.start(1) + len(value), 0 if could else -1)
    return [(*k, label) for k, label in found.items()]


def _name(kind: str, entity: str) -> str:
    """128 bits of the whole entity, white space and case aside."""
    return blake2b(f"{kind} {''.join(entity.split()).lower()}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        spans, found = [], []
        for text in batch["text"]:
            base = base_spans(text) if text else []
            spans.append([{"kind": KINDS.index(k), "start": s, "stop": e} for k, s, e in base])
            found.append([{"kind": ALL_KINDS.index(k), "entity": _name(k, text[s:e]), "label": label, "start": s, "stop": e, "patterns": patterns_of(text, k, s, e)} for k, s, e, label in (_candidates(text, base) if text else [])])
        yield pd.DataFrame({"doc_id": batch["doc_id"], "row": batch["row"], "base": spans, "found": found})


_SPAN = "struct<kind:int,start:int,stop:int>"
_SCANNED = f"doc_id long, row long, base array<{_SPAN}>, found array<struct<kind:int,entity:string,label:int,start:int,stop:int,patterns:array<string>>>"


def score_graph(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, entity, score of the unknown instances over the threshold. edges: kind, pattern, entity, label.

    All joins are shuffles of distinct pairs: nothing that grows with the corpus is broadcast.
    """
    links = staged(edges.groupBy("kind", "pattern", "entity").agg(F.max("label").alias("label")), "pii-links")
    scores = links.groupBy("kind", "entity").agg(F.max("label").alias("label")).withColumn("score", (F.col("label") == 1).cast("double"))
    for i in range(rounds):
        scores = staged(scores, f"pii-scores-{i}")
        weight = F.when(F.col("s.label") < 0, 1.0).when(F.col("score") < THRESHOLD, UNKNOWN).otherwise(0.0)
        patterns = (
            links.drop("label")
            .join(scores.alias("s").hint("merge"), ["kind", "entity"])
            .groupBy("kind", "pattern")
            .agg(F.sum(F.when(F.col("score") >= THRESHOLD, F.col("score")).otherwise(0.0)).alias("mass"), F.sum(weight).alias("against"))
            .where(F.col("mass") >= MIN_SEEDS)
            .select("kind", "pattern", (F.col("mass") / (F.col("mass") + F.col("against") + SMOOTHING)).alias("confidence"))
            .where(F.col("confidence") >= 0.5)
        )
        vouched = (
            links.where("label = 0")
            .join(staged(patterns, f"pii-patterns-{i}").hint("merge"), ["kind", "pattern"])
            .groupBy("kind", "entity")
            .agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("new"))
        )
        new = F.when(F.col("label") == 0, F.coalesce("new", F.lit(0.0))).otherwise(F.col("score"))
        scores = scores.join(vouched.hint("merge"), ["kind", "entity"], "left").select("kind", "entity", "label", new.alias("score"))
    return staged(scores, "pii-scores").where((F.col("label") == 0) & (F.col("score") >= THRESHOLD)).select("kind", "entity", "score")


def find_pii(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, base, spans and learned for every row: arrays of (kind number, start, stop) by kind, then start.

    spans holds base, the seeds (keys in known formats) and what was learned: instances that no pattern of ours knows and the graph has confirmed.
    """
    small_batches(docs)
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    scanned = staged(rows.mapInPandas(_scan, _SCANNED), "pii-scan")
    every = scanned.where(F.size("found") > 0).select("row", F.explode("found").alias("e")).select("row", "e.*")
    edges = every.select("kind", F.explode("patterns").alias("pattern"), "entity", "label")
    confirmed = score_graph(edges, rounds)
    span = F.struct("kind", "start", "stop")
    learned = every.where("label = 0").join(confirmed.select("kind", "entity").hint("merge"), ["kind", "entity"]).select("row", span.alias("span"))
    extra = learned.groupBy("row").agg(F.collect_set("span").alias("extra"))
    none = F.array().cast(f"array<{_SPAN}>")
    keys = F.transform(F.filter("found", lambda e: (e["label"] == 1) & (e["kind"] >= len(KINDS))), lambda e: F.struct(e["kind"].alias("kind"), e["start"].alias("start"), e["stop"].alias("stop")))
    spans = F.array_sort(F.array_distinct(F.concat("base", keys, F.coalesce("extra", none))))
    return scanned.join(extra.hint("merge"), "row", "left").select("doc_id", "base", spans.alias("spans"), F.array_sort(F.coalesce("extra", none)).alias("learned"))


def number_of(kind: str, spans: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == ALL_KINDS.index(kind))).cast("long")


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
