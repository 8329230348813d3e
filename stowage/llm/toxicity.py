"""Toxicity scores from a learned lexicon, found exactly or misspelled, weighed by its context.

Fit: a bounded sample of labelled rows (``sample_rows``) gives terms, whole words and word stems, whose documents are
far more often toxic than chance; a greedy cover keeps the few that explain the sample. Score: the lexicon is a trie,
and the Levenshtein automata of all its terms, stems as prefixes, are intersected with it into one automaton, made
deterministic as words arrive, so a word costs one step a letter and ends at the first letter that no term can match. Each
hit looks at the words around it: a hit inside quotation marks counts half, one that a reporting verb announces too doesn't
count. Words that clean sample documents use are no misspellings; what a misspelling of a term counts is learned from
the near words that toxic and clean sample documents hold (``_credits``), and a text's best one counts. A small
ridge-logistic model turns the weighted hits into the score.

Defined results: null and empty texts score as texts without hits; a null doc_id isn't held out; labels without a
document or with null values are ignored, several labels of a document count as toxic if one is; no training rows
leave an empty lexicon and one low score for all; texts are scored whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import small_batches, staged

SAMPLE_ROWS = 12_000
THRESHOLD = 0.7
STEM_LENGTHS = (4, 5, 6)
#: Toxic documents that a word, or a stem, must stand in to enter the lexicon by itself.
WORD_DOCS, STEM_DOCS = 4, 6
CACHE_WORDS = 300_000
WORD = re.compile(r"\w+(?:[*$@]+\w+)*")
#: Words that announce somebody else's words, in the corpus's four languages.
REPORTING = frozenset(
    "said says say wrote writes called calls quoted quote quotes reported claimed told asked word words term "
    "dit écrit appelle cite cité terme mot sagte schrieb nannte zitiert zitat wort dijo escribió llamó cita palabra".split()
)
#: Opening and closing quotation marks.
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}
WINDOW, QUOTE_REACH = 6, 200
#: Prior weights of the ridge model: bias, hits, quoted hits. Without evidence they stand.
PRIOR = np.array([-3.0, 5.0, 0.3])
#: What a misspelled hit counts of an exact one, at most.
MISSPELLED = 0.85
#: Misspellings that are expected of a term before any is seen: by itself, and for each toxic document that it stands in.
EXPECTED, EXPECTED_SHARE = 1.0, 0.25
RIDGE = 0.5
#: Letters from which a word of the lexicon is found with two misspellings.
LONG_WORD = 9


class FuzzyLexicon:
    """Levenshtein automata of distance 1, of one more for words of LONG_WORD letters, intersected with the trie of all terms, determinised lazily.

    A state is a set of (trie node, edits so far); state 0 is dead. A term that ends in a hyphen is a stem: words that
    start like it match.
    """

    def __init__(self, terms: list[str], distance: int = 1):
        self.distance = distance
        self.reach: list[int] = [distance]  # most edits of the terms below each node
        self.ends: dict[int, list[str]] = defaultdict(list)
        self.accepted: dict[int, tuple[frozenset, frozenset]] = {}
        self.children: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        for term in terms:
            node, most = 0, self.most(term)
            self.reach[0] = max(self.reach[0], most)
            for ch in term.removesuffix("-"):
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.final.append(False)
                    self.reach.append(0)
                node = self.children[node][ch]
                self.reach[node] = max(self.reach[node], most)
            self.final[node] = True
            self.ends[node].append(term)
        self.letters = {ch for node in self.children for ch in node}
        self.number: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.steps: list[dict[str, int]] = [{}]
        self.start = self._state({0: 0})

    def most(self, term: str) -> int:
        return self.distance + (term[-1:] != "-" and len(term) >= LONG_WORD)

    def _state(self, best: dict[int, int]) -> int:
        """Adds what is reached by leaving letters of a term out, and numbers the set."""
        todo = list(best.items())
        while todo:
            node, edits = todo.pop()
            if edits < self.reach[node]:
                for child in self.children[node].values():
                    if edits < self.reach[child] and best.get(child, 99) > edits + 1:
                        best[child] = edits + 1
                        todo.append((child, edits + 1))
        key = frozenset(best.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
        return self.number[key]

    def _step(self, state: int, ch: str) -> int:
        best: dict[int, int] = {}
        for node, edits in self.sets[state]:
            moves = [(node, edits + 1)] + [(child, edits + (letter != ch)) for letter, child in self.children[node].items()]
            for to, cost in moves:
                if cost <= self.reach[to] and best.get(to, 99) > cost:
                    best[to] = cost
        found = self._state(best)
        self.steps[state][ch] = found
        return found

    def edits(self, word: str) -> int | None:
        """The least edits to a term, None beyond the distance."""
        state = self.start
        for ch in word:
            if ch not in self.letters:
                ch = ""
            after = self.steps[state].get(ch)
            state = self._step(state, ch) if after is None else after
            if not state:
                return None
        return min((e for node, e in self.sets[state] if any(e <= self.most(t) for t in self.ends.get(node, ()))), default=None)

    def _ended(self, state: int) -> tuple[frozenset, frozenset]:
        """The stems and the words that end in a state."""
        if state not in self.accepted:
            terms = [t for node, e in self.sets[state] if self.final[node] for t in self.ends[node] if e <= self.most(t)]
            self.accepted[state] = frozenset(t for t in terms if t[-1] == "-"), frozenset(t for t in terms if t[-1] != "-")
        return self.accepted[state]

    def near(self, word: str) -> frozenset[str]:
        """The words within the distance, and the stems within it of a start of the word that is no shorter than they are."""
        state, stems = self.start, set()
        for n, ch in enumerate(word, 1):
            if ch not in self.letters:
                ch = ""
            after = self.steps[state].get(ch)
            state = self._step(state, ch) if after is None else after
            if not state:
                return frozenset(stems)
            stems.update(t for t in self._ended(state)[0] if len(word) >= len(t) - 1)
        return self._ended(state)[1] | stems


class _Hits(dict):
    """word -> 0 no hit, 1 exact word or stem, between them a misspelling's credit. Remembers what it has seen, up to CACHE_WORDS.

    An ordinary word is no misspelling.
    """

    def __init__(self, words: frozenset[str], stems: frozenset[str], ordinary: frozenset[str], credits: dict[str, float]):
        super().__init__()
        self.words, self.stems, self.ordinary, self.credits = words, stems, ordinary, credits
        self.lengths = sorted({len(s) for s in stems})
        self.fuzzy = FuzzyLexicon([*sorted(words), *(f"{s}-" for s in sorted(stems))])

    def exact(self, word: str) -> bool:
        return word in self.words or any(word[:n] in self.stems for n in self.lengths if len(word) > n)

    def __missing__(self, word: str) -> float:
        if self.exact(word):
            hit = 1.0
        else:
            near = self.fuzzy.near(word) if word not in self.ordinary else ()
            hit = max((self.credits.get(t, MISSPELLED) for t in near), default=0.0)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = hit
        return hit


def quotation(text: str, start: int, end: int, before: list[str]) -> float:
    """0 for plain use, 1 for reported speech: half for quotation marks around the hit, half for a reporting word before it."""
    line = text.rfind("\n", 0, start) + 1
    stop = text.find("\n", end)
    left, right = text[max(line, start - QUOTE_REACH) : start], text[end : min(len(text) if stop < 0 else stop, end + QUOTE_REACH)]
    inside = False
    for opening, closing in QUOTES.items():
        if opening == closing:
            inside |= text.count(opening, line, start) % 2 == 1 and opening in left and closing in right
        else:
            inside |= left.rfind(opening) > left.rfind(closing) and closing in right
    return 0.5 * inside + 0.5 * (inside and not REPORTING.isdisjoint(before))


class ToxicityModel:
    """words, stems: the lexicon. ordinary: words that clean documents use, however near to a term they are. credits: what a misspelling of a term counts, MISSPELLED unless given; a stem's key ends in a hyphen."""

    def __init__(self, words: Iterable[str], stems: Iterable[str], weights: np.ndarray, ordinary: Iterable[str] = (), credits: dict[str, float] | None = None):
        self.words, self.stems, self.ordinary, self.weights = frozenset(words), frozenset(stems), frozenset(ordinary), weights
        self.credits = credits or {}
        self._hits: _Hits | None = None

    def __getstate__(self) -> dict:
        return {"words": self.words, "stems": self.stems, "ordinary": self.ordinary, "weights": self.weights, "credits": self.credits, "_hits": None}

    def hits(self) -> _Hits:
        if self._hits is None:
            self._hits = _Hits(self.words, self.stems, self.ordinary, self.credits)
        return self._hits

    def features(self, text: str | None) -> tuple[float, float]:
        """Weights of hits, the best misspelled one among them, and of quoted hits."""
        low = (text or "").lower()
        words = WORD.findall(low)
        hits = list(map(self.hits().__getitem__, words))
        if not any(hits):
            return 0.0, 0.0
        sums, best = [0.0, 0.0], (0.0, 0.0)
        for i, m in enumerate(WORD.finditer(low)):
            if hits[i]:
                quoted = quotation(low, m.start(), m.end(), words[max(0, i - WINDOW) : i])
                if hits[i] == 1:
                    sums[0] += 1 - quoted
                    sums[1] += quoted
                else:
                    best = max(best, ((1 - quoted) * hits[i], quoted * hits[i]))
        return sums[0] + best[0], sums[1] + best[1]

    def scores(self, texts: pd.Series) -> np.ndarray:
        return _logistic(_design(np.array([self.features(x) for x in texts], dtype=float).reshape(-1, 2)) @ self.weights)


def _design(hits: np.ndarray) -> np.ndarray:
    """One hit is most of the evidence; more hits add little."""
    return np.column_stack([np.ones(len(hits)), np.minimum(hits, 1) + 0.1 * np.log1p(np.maximum(hits - 1, 0))])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _ridge_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = PRIOR.copy()
    for _ in range(30):
        p = _logistic(x @ w)
        slope = x.T @ (p - y) + RIDGE * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _terms(text: str | None) -> set[str]:
    """Words, and stems marked by a final hyphen."""
    words = set(WORD.findall((text or "").lower()))
    found = {w for w in words if len(w) > 2}
    for n in STEM_LENGTHS:
        found.update(w[:n] + "-" for w in words if len(w) > n)
    return found


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            counts[int(toxic)].update(_terms(text))
    if counts[1]:  # terms without a toxic document here still count where another partition has one
        yield pd.DataFrame([(t, n, counts[1][t]) for t, n in (counts[0] + counts[1]).items()], columns=["term", "n", "toxic"])
    elif counts[0]:
        yield pd.DataFrame([(t, n, 0) for t, n in counts[0].items()], columns=["term", "n", "toxic"])


def _signatures(text: str | None) -> list[int]:
    """Two names that near copies share: the least hashes of the words, under two hash functions."""
    words = {w.encode() for w in WORD.findall((text or "").lower())}
    least = [sorted(zlib.crc32(w, seed) for w in words)[:3] for seed in (1, 2)]
    return [zlib.crc32(repr(x).encode()) * 2 + i for i, x in enumerate(least)]


def _apart(rows: list[tuple[int, list[str], list[int]]]) -> list[tuple[int, list[str]]]:
    """One row of each family of near copies, so that a family's own words don't pass for a pattern."""
    seen: set[int] = set()
    out = []
    for toxic, terms, names in sorted(rows):
        if seen.isdisjoint(names):
            out.append((toxic, terms))
        seen.update(names)
    return out


def _lexicon(rows: list[tuple[int, list[str]]]) -> list[str]:
    """Terms that stand in several toxic documents and next to no clean one, then what the greedy cover adds."""
    toxic, clean = Counter(), Counter()
    for label, terms in rows:
        (toxic if label else clean).update(terms)
    strong = [t for t, n in toxic.items() if n >= (STEM_DOCS if t[-1] == "-" else WORD_DOCS) and 20 * clean[t] <= n]
    strong.sort(key=lambda t: (-toxic[t], t))
    return list(dict.fromkeys(_cover(rows) + strong))


def _cover(rows: list[tuple[int, list[str]]]) -> list[str]:
    """Greedy: the term with the most toxic documents not yet covered, less three for each clean one; stops below three."""
    clean: Counter = Counter()
    where: dict[str, set[int]] = defaultdict(set)
    for i, (toxic, terms) in enumerate(rows):
        for t in terms:
            if toxic:
                where[t].add(i)
            else:
                clean[t] += 1
    chosen: list[str] = []
    while where:
        best = max(where, key=lambda t: (len(where[t]) - 3 * clean[t], -len(t), t))
        if len(where[best]) - 3 * clean[best] < 3:
            break
        chosen.append(best)
        gone = where.pop(best)
        where = {t: left for t, docs in where.items() if (left := docs - gone)}
    return chosen


def _credits(terms: list[str], support: Counter, near: list[tuple[str, int, int]], fuzzy: FuzzyLexicon) -> dict[str, float]:
    """What a near word that no clean sample document uses counts, for each term: the share of misspellings among such words.

    near: (word, its clean documents, its toxic ones). Words that one clean document uses tell how many new ones further
    clean documents bring (Good and Turing); words of toxic documents alone are seen misspellings.
    """
    new: Counter = Counter()
    seen: Counter = Counter()
    for word, clean, toxic in near:
        if clean <= 1:
            (new if clean else seen).update(dict.fromkeys(fuzzy.near(word), 1 if clean else toxic))
    likely = {t: EXPECTED + EXPECTED_SHARE * support[t] + seen[t] for t in terms}
    return {t: MISSPELLED * likely[t] / (likely[t] + new[t]) for t in terms}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learns from at most about ``sample_rows`` labelled rows that aren't held out, chosen by a hash of their id.

    What comes to the driver is bounded by the terms of ``sample_rows`` rows, whatever the size of the corpus.
    """
    small_batches(docs)
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    share = min(1.0, sample_rows / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic").dropDuplicates(["text", "toxic"])
    sample = staged(sample, "toxicity-sample")
    base = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, toxic = base["n"] or 0, base["toxic"] or 0
    if not toxic or toxic == n:
        return ToxicityModel([], [], PRIOR)
    rate = toxic / n
    share_toxic = F.col("toxic") / F.col("n")
    surprise = 2 * F.col("toxic") * F.log(share_toxic / rate)
    candidates = (
        sample.mapInPandas(_count_terms, "term string, n long, toxic long")
        .groupBy("term")
        .agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        .where((F.col("toxic") >= 3) & (share_toxic >= max(0.75, 3 * rate if rate < 0.25 else 0.75)))
        .select("term", surprise.alias("surprise"))
        .where(F.col("surprise") >= 10)
    )
    wanted = frozenset(r["term"] for r in candidates.collect())

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"].astype(int), "terms": [sorted(_terms(x) & wanted) for x in batch["text"]], "names": [_signatures(x) for x in batch["text"]]})

    rows = sample.mapInPandas(hits, "toxic int, terms array<string>, names array<long>").where(F.size("terms") > 0).collect()
    apart = _apart([(r["toxic"], r["terms"], r["names"]) for r in rows])
    chosen_terms = _lexicon(apart)
    support = Counter(t for toxic, terms in apart if toxic for t in terms)
    lexicon = [t for t in chosen_terms if t[-1] != "-"], [t[:-1] for t in chosen_terms if t[-1] == "-"]
    first = ToxicityModel(*lexicon, PRIOR)

    def near_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits, found = first.hits(), Counter()
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                found.update((w, int(toxic)) for w in set(WORD.findall((text or "").lower())) if 0 < hits[w] < 1)
            yield pd.DataFrame([(w, n * (1 - toxic), n * toxic) for (w, toxic), n in found.items()], columns=["word", "clean", "toxic"])

    near = sample.mapInPandas(near_words, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()
    credits = _credits(chosen_terms, support, [(r["word"], r["clean"], r["toxic"]) for r in near], first.hits().fuzzy)
    model = ToxicityModel(*lexicon, PRIOR, (r["word"] for r in near if r["clean"]), credits)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(*model.features(x), int(t)) for x, t in zip(batch["text"], batch["toxic"], strict=True)], columns=["a", "b", "toxic"])

    seen = sample.mapInPandas(features, "a double, b double, toxic int").toPandas()
    x = _design(seen[["a", "b"]].to_numpy())
    model.weights = _ridge_logistic(x, seen["toxic"].to_numpy(float))
    return model


def toxicity_score(model: ToxicityModel):
    """A column function: text -> score from 0 to 1."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.scores(batch))

    return score


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""
    return docs.where(toxicity_score(model)(F.col("text")) < threshold)
