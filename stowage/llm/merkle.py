"""Merkle-tree fingerprints of documents.

Levels: the root over sections, a section over its paragraphs (lines), a paragraph over its pieces: sentences, of which
those over PIECE code points are cut where the four code points before say so, so that an insertion moves no other cut.
Sections are parted by blank lines. Every node's hash covers the
hashes of its children, so equal roots mean equal texts, and a comparison descends only where hashes differ; the
pieces it ends at locate the edits. The likeness of two trees is the share of their text that lies under equal nodes:
2 * shared / (length of one + length of the other), 1 for equal roots.

Defined results: a null text is empty; an empty text has a root of its own and likeness 1 with itself, 0 with any
other; the next document goes by doc_id, nulls first, null ones by a hash of the text, ties by text, and the last one's next is the first, so a single document is its own
next; rows with the same doc_id are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import small_batches

#: Sentences up to this length are one piece; cuts of longer ones are LEAST code points apart at least.
PIECE, LEAST = 96, 16
_SENTENCES = re.compile(r"[^.!?]+(?:[.!?]+\s*)?|[.!?]+\s*")
_BLANK = re.compile(r"(\n[ \t]*\n\s*)")
_WIDTH = 12


def _hash(data: bytes) -> bytes:
    return blake2b(data, digest_size=_WIDTH).digest()


def pieces_of(line: str) -> list[str]:
    """Sentences; in a long one a cut follows every place whose last four code points hash to one value of 32."""
    found = []
    for sentence in _SENTENCES.findall(line):
        if len(sentence) <= PIECE:
            found.append(sentence)
            continue
        codes = np.frombuffer(sentence.encode("utf-32-le", "surrogatepass"), np.uint32)
        h = codes[3:] * np.uint32(0x9E3779B1) + codes[2:-1] * np.uint32(0x85EBCA77) + codes[1:-2] * np.uint32(0xC2B2AE3D) + codes[:-3] * np.uint32(0x27D4EB2F)
        at = 0
        for cut in (np.flatnonzero((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(27) == 0) + 4).tolist():
            if cut - at >= LEAST:
                found.append(sentence[at:cut])
                at = cut
        if at < len(sentence):
            found.append(sentence[at:])
    return found


class Tree:
    """sections: (hash, paragraphs); paragraphs: (hash, pieces); pieces: (hash, length). ``root`` is a hex string."""

    __slots__ = ("n", "root", "sections")

    def __init__(self, text: str):
        self.n = len(text)
        self.sections: list[tuple[bytes, list]] = []
        for section in _BLANK.split(text):
            paragraphs = []
            for line in section.split("\n"):
                pieces = [(_hash(p.encode("utf-8", "surrogatepass")), len(p)) for p in pieces_of(line)]
                paragraphs.append((_hash(b"p" + b"".join(h for h, _ in pieces)), pieces))
            self.sections.append((_hash(b"s" + b"".join(h for h, _ in paragraphs)), paragraphs))
        self.root = sha256(b"r" + b"".join(h for h, _ in self.sections)).hexdigest()


def differing(a: Tree, b: Tree) -> tuple[list, list]:
    """The pieces under branches that have no equal in the other tree, of a and of b."""

    def unequal(x: list, y: list) -> tuple[list, list]:
        have_x, have_y = Counter(h for h, _ in x), Counter(h for h, _ in y)
        return _left(x, have_y), _left(y, have_x)

    if a.root == b.root:
        return [], []
    x, y = unequal(a.sections, b.sections)
    x, y = unequal([p for _, kids in x for p in kids], [p for _, kids in y for p in kids])
    return unequal([p for _, kids in x for p in kids], [p for _, kids in y for p in kids])


def _left(nodes: list, other: Counter) -> list:
    """The nodes beyond those that the other side can pair off."""
    left = []
    other = Counter(other)
    for node in nodes:
        if other[node[0]] > 0:
            other[node[0]] -= 1
        else:
            left.append(node)
    return left


def likeness(a: Tree, b: Tree) -> float:
    if a.root == b.root:
        return 1.0
    only_a, only_b = differing(a, b)
    seen_a = a.n - sum(n for _, n in only_a) - _breaks(a)
    seen_b = b.n - sum(n for _, n in only_b) - _breaks(b)
    total = a.n - _breaks(a) + b.n - _breaks(b)
    return max(0.0, min(1.0, (seen_a + seen_b) / total)) if total else 0.0


def _breaks(t: Tree) -> int:
    """Line breaks stand between paragraphs, under no piece."""
    return sum(len(kids) - 1 for _, kids in t.sections)


def first_difference(a: Tree, b: Tree) -> tuple[int, int] | None:
    """(section, paragraph) where the second tree first departs from the first; None for equal trees."""
    if a.root == b.root:
        return None
    for i, (s, t) in enumerate(zip(a.sections, b.sections, strict=False)):
        if s[0] != t[0]:
            for j, (p, q) in enumerate(zip(s[1], t[1], strict=False)):
                if p[0] != q[0]:
                    return i, j
            return i, min(len(s[1]), len(t[1]))
    return min(len(a.sections), len(b.sections)), 0


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by bucket, own rows before the one row borrowed from the next bucket."""
    bucket, last, tree = None, None, None
    for batch in batches:
        out = []
        for b, borrowed, doc_id, text in zip(batch["bucket"], batch["borrowed"], batch["doc_id"], batch["text"], strict=True):
            here = Tree(text)
            if last is not None and b == bucket:
                changed = edited(last[1], text)
                other = Tree(changed)
                where = first_difference(tree, other)
                out.append(
                    (last[0], len(last[1]), sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), tree.root, other.root,
                     likeness(tree, other), likeness(tree, here), len(tree.sections), where[0] if where else None, where[1] if where else None)
                )
            bucket, last, tree = (b, (doc_id, text), here) if not borrowed else (None, None, None)
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _RESULT.split(", ")])
        frame["doc_id"] = pd.array(frame["doc_id"], dtype="Int64")
        for c in ("edit_section", "edit_paragraph"):
            frame[c] = pd.array(frame[c], dtype="Int32")
        yield frame


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, n_sections int, edit_section int, edit_paragraph int"
)


def _ranges(docs: DataFrame) -> int:
    return 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Deals the rows into ranges of doc_id, rows without one into ranges of their text's hash; each range also borrows the first row of the next one that has any.

    Columns bucket, borrowed, doc_id, h, text, one shuffle of the texts. What the driver sees is a few numbers a range.
    """
    spark = docs.sparkSession
    buckets = buckets or _ranges(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    seen = rows.agg(F.percentile_approx("doc_id", shares, 20 * buckets).alias("cuts"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.count("*").alias("n")).first()
    cuts = sorted({float(c) for c in seen["cuts"] or []}) if buckets > 1 else []
    for_nulls = -(-buckets * seen["nulls"] // max(1, seen["n"]))
    if cuts:
        rows = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="doc_id", outputCol="range", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("range", F.lit(0))
    h = F.when(F.col("doc_id").isNull(), F.shiftrightunsigned(F.xxhash64("text"), 33)).otherwise(0)
    number = F.when(F.col("doc_id").isNull(), F.floor(F.col("h") * for_nulls / 2**31)).otherwise(F.col("range") + for_nulls).cast("int")
    dealt = rows.withColumn("h", h).select(number.alias("bucket"), "doc_id", "h", "text")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")
    firsts = dealt.select("bucket", "doc_id", "h").groupBy("bucket").agg(F.min(place).alias("low")).orderBy("bucket").select("bucket", "low.doc_id", "low.h").collect()
    if not firsts:
        return dealt.withColumn("borrowed", F.lit(False)).select("bucket", "borrowed", "doc_id", "h", "text")
    # The first range's row goes to the last, which wraps round.
    lenders = [(r["bucket"], r["doc_id"], r["h"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]
    low = spark.createDataFrame(lenders, "bucket int, low long, low_h long, lender int")
    heads = (
        dealt.join(F.broadcast(low), "bucket")
        .where(F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("h") == F.col("low_h")))
        .groupBy("lender", "bucket")
        .agg(F.min(F.struct("doc_id", "h", "text")).alias("head"))
        .select(F.col("lender").alias("bucket"), F.lit(True).alias("borrowed"), "head.*")
    )
    return dealt.select("bucket", F.lit(False).alias("borrowed"), "doc_id", "h", "text").unionByName(heads)


def fingerprint_documents(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row a document: its root, the edited text's root, both likenesses, and where the edit starts."""
    small_batches(docs)
    buckets = buckets or _ranges(docs)
    ordered = with_next(docs, buckets).repartitionById(buckets, F.col("bucket") % buckets).sortWithinPartitions("bucket", "borrowed", F.col("doc_id").asc_nulls_first(), "h", "text")
    return ordered.mapInPandas(_pairs, _RESULT)
