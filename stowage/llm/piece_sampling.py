"""SentencePiece encoding with distinct sampled segmentations, and decoding.

A text becomes the model's own form (a dummy space in front, spaces as U+2581) and is cut into units, only where no
piece of the vocabulary can lie across the cut: before the spaces of a word, and around letters that stand in no longer
piece. Units are as long as they come. Over each unit lies the lattice of the vocabulary's pieces; a piece weighs
exp(score / temperature), a character outside the vocabulary is its UTF-8 bytes' pieces. A segmentation of the text is
a path through all units' lattices, and its probability the product of theirs.

Samples are the Gumbel top k without replacement. The search is A* over sets of paths: a set's priority is the largest
perturbed log-probability in it, exact by the lattice's log-partition function, so the best set can always be split
without being listed. Splitting follows one path to its end and leaves, at every unit, the set of paths that depart
there, whose priority is a Gumbel variable truncated at its parent's. The k best sets' paths are distinct samples; the next
priority is the threshold kappa, and a sample's inclusion probability is 1 - exp(-exp(log p - kappa)).

All random numbers are hashes of the row's key, the sample and the unit, so a row's samples depend on nothing else.

Decoding joins the pieces' bytes, drops the dummy space and reads U+2581 as a space; ``sample_segmentations`` decodes
every sample and returns the digest, ``decode_segmentations`` returns the texts.

Defined results: null and empty texts have one empty segmentation with probability 1; a text with fewer than k
segmentations (of more than 1e-12 of the whole) gives all it has (kappa is then minus infinity, inclusion probability 1); rows with equal keys and texts
give equal samples; a null key counts as 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.bitmap import mixed
from stowage.llm.common import small_batches

TEMPERATURE = 4_000.0
SAMPLES = 2
#: Code points of the texts that share their units' lattices, and of those that are searched at a time; a longer text is by itself.
TOGETHER, CHUNK = 2_000_000, 300_000
#: Letters whose edges stand in a table; the others are searched.
DENSE = 64
SPACE = "▁"
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def public_model() -> str:
    """The public model that the environment offers. Any SentencePiece model's path can take its place."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Pieces:
    """A model's vocabulary. Pieces of no use in a lattice (control, unknown, unused) are left out, bytes stand apart."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        self.text = [self.model.id_to_piece(i) for i in range(n)]
        self.score = np.array([self.model.get_score(i) for i in range(n)])
        self.byte = [i for i in range(n) if self.model.is_byte(i)]
        special = {i for i in range(n) if self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)} | set(self.byte)
        self.ids = {p: i for i, p in enumerate(self.text) if i not in special}
        self.low = float(min((s for i, s in enumerate(self.score) if i not in special and s > -1e8), default=0.0))
        self.trie = Trie(self.ids)
        # Letters outside longer pieces are units of their own, several at a time: a cut there parts no piece.
        inside = re.escape("".join(sorted({ch for p in self.ids if len(p) > 1 for ch in p if ch != SPACE}))) or "\\0"
        spaced = any(SPACE in p[1:] and p.strip(SPACE) and SPACE in p.lstrip(SPACE) for p in self.ids)  # a piece over several words
        self.units = re.compile("(?s).+") if spaced else re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|[^{inside}{SPACE}]{{1,16}}")
        raw = [bytes([self.byte.index(i)]) if i in special and i in self.byte else b"" if i in special else p.replace(SPACE, " ").encode() for i, p in enumerate(self.text)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_length = np.array([len(r) for r in raw], np.int32)
        self.raw_start = (np.cumsum(self.raw_length) - self.raw_length).astype(np.int32)
        self.score = np.maximum(self.score, self.low)  # runs of spaces have a score that says never

    def decode(self, ids) -> str:
        """The text of any segmentation, sampled or not."""
        return self.model.decode([int(i) for i in ids])

    def decode_rows(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts, in UTF-8, of many segmentations that lie one after another: their pieces' bytes without the dummy space in front."""
        length = self.raw_length[ids]
        ends = np.cumsum(length, dtype=np.int64)
        kind = np.int32 if not len(ends) or ends[-1] < 2**31 else np.int64
        at = np.repeat(self.raw_start[ids] - (ends - length).astype(kind), length)
        at += np.arange(len(at), dtype=kind)
        whole = self.raw[at].tobytes()
        cuts = np.r_[0, ends][np.r_[0, np.cumsum(counts)]].tolist()
        return [whole[lo + (whole[lo : lo + 1] == b" ") : hi] if hi > lo else b"" for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, text: str | None) -> list[int]:
        """The model's own segmentation."""
        return self.model.encode(text or "", num_threads=1)


@cache
def vocabulary(path: str) -> Pieces:
    """Read once by each Python worker."""
    return Pieces(path)


def units_of(text: str, units: re.Pattern = _UNITS) -> list[str]:
    return units.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Trie:
    """The vocabulary's pieces as a trie that many texts walk at once: an edge is found by its state and letter in a sorted array."""

    def __init__(self, ids: dict[str, int]):
        often = Counter(ch for p in ids for ch in p)
        letters = sorted(often, key=lambda ch: (-often[ch], ch))
        self.letters = len(letters) + 1
        self.letter = np.full(0x110000, len(letters), np.int32)  # any other
        self.letter[[ord(ch) for ch in letters]] = np.arange(len(letters))
        number = {ch: i for i, ch in enumerate(letters)}
        edges: dict[int, int] = {}
        piece = [-1]
        for p, k in ids.items():
            state = 0
            for ch in p:
                key = state * self.letters + number[ch]
                state = edges.setdefault(key, len(piece))
                if state == len(piece):
                    piece.append(-1)
            piece[state] = k
        self.keys = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in self.keys.tolist()], np.int32)
        self.piece = np.array(piece, np.int32)
        self.dense = np.zeros((len(piece), DENSE), np.int32)  # 0, the root, is no edge's end
        common = self.keys % self.letters < DENSE
        self.dense[self.keys[common] // self.letters, self.keys[common] % self.letters] = self.to[common]

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states that edges lead to, 0 where there is none."""
        out = self.dense[state, np.minimum(letter, DENSE - 1)]
        rare = np.flatnonzero(letter >= DENSE)
        if len(rare):
            key = state[rare].astype(np.int64) * self.letters + letter[rare]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[rare] = np.where(self.keys[edge] == key, self.to[edge], 0)
        return out

    def pieces_from(self, codes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all pieces in the text, none past its unit's end ``last``; by start, then end."""
        letter = self.letter[codes]
        at, state, depth = np.arange(len(codes), dtype=np.int32), np.zeros(len(codes), np.int32), 0
        starts, ends, found = [], [], []
        while len(at):
            state = self.step(state, letter[at + depth])
            ok = state > 0
            at, state, depth = at[ok], state[ok], depth + 1
            piece = self.piece[state]
            is_piece = piece >= 0
            starts.append(at[is_piece])
            ends.append(at[is_piece] + depth)
            found.append(piece[is_piece])
            if depth == 1:  # a letter outside the vocabulary goes by its bytes
                alone = np.ones(len(codes), bool)
                alone[starts[0]] = False
                other = np.flatnonzero(alone).astype(np.int32)
                starts.append(other)
                ends.append(other + 1)
                found.append(-1 - codes[other].astype(np.int32))
            going = at + depth < last[at]
            at, state = at[going], state[going]
        if not starts:
            return (np.empty(0, np.int32),) * 3
        start = np.concatenate(starts)
        order = np.argsort(start, kind="stable")
        return start[order], np.concatenate(ends)[order], np.concatenate(found)[order]


class Lattices:
    """The lattices of a list of distinct units. Node (u, i) is position i of unit u; arcs lie by node, each with its choice probability."""

    def __init__(self, units: list[str], pieces: Pieces, temperature: float):
        self.length = np.fromiter(map(len, units), np.int32, len(units))
        ends = np.cumsum(self.length)
        of = np.repeat(np.arange(len(units), dtype=np.int32), self.length)
        self.base = ends - self.length + np.arange(len(units))  # a unit has a node more than letters
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        start, end, self.piece = pieces.trie.pieces_from(codes, ends[of])
        own = of[start]
        node, self.end = start + own, end + own
        nodes = int(ends[-1]) + len(units) if len(units) else 0
        self.first = np.zeros(nodes + 1, np.int64)
        np.cumsum(np.bincount(node, minlength=nodes), out=self.first[1:])
        longest = int(self.length.max(initial=0))
        left = (ends[own] - start).astype(np.int8 if longest < 128 else np.int16 if longest < 32768 else np.int32)  # letters from an arc's start to its unit's end: nodes near the end come first
        del start, own
        scores = pieces.score[np.maximum(self.piece, 0)]
        scores[self.piece < 0] = 4 * pieces.low
        scores /= temperature
        beta = np.full(nodes, -np.inf)
        beta[self.base + self.length] = 0.0
        order = np.argsort(left, kind="stable").astype(np.int32)
        cuts = np.r_[0, np.cumsum(np.bincount(left, minlength=1))]
        del left
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                at = order[lo:hi]
                value, here = scores[at] + beta[self.end[at]], node[at]
                firsts = np.flatnonzero(np.diff(here, prepend=-1))
                beta[here[firsts]] = np.logaddexp.reduceat(value, firsts)
        del order
        scores += beta[self.end]
        scores -= beta[node]
        self.log_choice = scores
        self.upto = np.cumsum(np.exp(scores))
        self.upto -= np.r_[0.0, self.upto][self.first[node]]
        self.upto[self.first[1:][np.diff(self.first) > 0] - 1] = np.inf  # a node's last arc takes what is left

    def walk(self, unit: np.ndarray, seed: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One random path for each occurrence, from its unit's start or another node: its log-probability, and the (occurrence, arc) pairs, each one's in order of steps."""
        log_p = np.zeros(len(unit))
        live, node, stop = np.arange(len(unit)), self.base[unit] if start is None else start, self.base[unit] + self.length[unit]
        if start is not None:
            going = node < stop
            live, node, stop = live[going], node[going], stop[going]
        who, arcs, steps, step = [], [], np.zeros(len(unit), np.int32), 0
        while len(live):
            u = uniform(seed[live] + np.uint64(step * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            arc = self.first[node].copy()
            more = np.flatnonzero(self.upto[arc] < u)
            while len(more):
                arc[more] += 1
                more = more[self.upto[arc[more]] < u[more]]
            log_p[live] += self.log_choice[arc]
            who.append(live)
            arcs.append(arc)
            steps[live] = step + 1
            node = self.end[arc]
            going = node < stop
            live, node, stop = live[going], node[going], stop[going]
            step += 1
        begin = np.cumsum(steps, dtype=np.int64) - steps  # an occurrence's arcs lie together, its step n at n
        arcs_ = np.empty(int(steps.sum()), np.int64)
        for n, (w, a) in enumerate(zip(who, arcs, strict=True)):
            arcs_[begin[w] + n] = a
        return log_p, np.repeat(np.arange(len(unit)), steps), arcs_

    def departure(self, unit: int, taken: list[tuple[tuple[int, ...], float]], seed: np.uint64) -> tuple[list[int], float, int]:
        """The start of a random path of one unit that is none of those taken, up to where it has left them all: arcs, log-probability, node.

        At each node an arc weighs what its paths weigh less the taken ones.
        """
        node, stop, log_p, path = int(self.base[unit]), int(self.base[unit] + self.length[unit]), 0.0, []
        while node < stop and taken:
            first, last = int(self.first[node]), int(self.first[node + 1])
            mass = np.exp(self.log_choice[first:last])
            whole = mass.copy()
            for p, q in taken:
                mass[p[len(path)] - first] -= math.exp(q - log_p)
            mass[mass <= 1e-12 * whole] = 0.0
            u = uniform(np.array([(int(seed) + len(path) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0]
            upto = np.cumsum(mass)
            pick = int(np.searchsorted(upto, u * upto[-1], side="right")) if upto[-1] > 0 else int(whole.argmax())
            a = first + min(pick, last - first - 1)
            taken = [t for t in taken if t[0][len(path)] == a]
            path.append(a)
            log_p, node = log_p + float(self.log_choice[a]), int(self.end[a])
        return path, log_p, node


def uniform(x: np.ndarray) -> np.ndarray:
    """From hashes to (0, 1)."""
    x = mixed(x)
    x >>= np.uint64(11)
    out = x.astype(np.float64)
    out += 0.5
    out *= 2.0**-53
    return out


def truncated_gumbel(mu: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel variable at mu, known to be at most bound."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(mu), -np.inf, mu - np.log(np.exp(np.minimum(mu - bound, 700)) - np.log(u)))


def _log1mexp(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(x)) for x <= 0; minus infinity where rounding leaves nothing."""
    x = np.minimum(x, 0)
    with np.errstate(divide="ignore"):
        out = np.where(x > -0.693, np.log(-np.expm1(x)), np.log1p(-np.exp(x)))
    return np.where(x > -1e-12, -np.inf, out)


class _Search:
    """The search for a chunk of texts at once: each round pops every text's best set and follows one path of it to the end."""

    def __init__(self, lattices: Lattices, unit: np.ndarray, starts: np.ndarray, keys: np.ndarray):
        self.lat, self.unit, self.starts = lattices, unit, starts
        self.lengths = np.diff(np.r_[starts, len(unit)])
        self.doc = np.repeat(np.arange(len(starts)), self.lengths)
        self.place = np.arange(len(unit)) - starts[self.doc]
        self.key = mixed(keys.view(np.uint64) + np.uint64(0x5851F42D4C957F2D))
        self.bound = -np.log(-np.log(uniform(self.key)))  # the whole set's maximum: log mass 0
        self.leaves: list[dict] = []

    def _seeds(self, occurrence: np.ndarray, salt: int) -> np.ndarray:
        return mixed(self.key[self.doc[occurrence]] + mixed(self.place[occurrence].astype(np.uint64) * np.uint64(1024) + np.uint64(salt)))

    def _prefix(self, log_p: np.ndarray) -> np.ndarray:
        """Sum of log_p over a text's units before each unit."""
        total = np.cumsum(log_p)
        before = total - log_p
        return before - before[self.starts[self.doc]]

    def first(self) -> None:
        every = np.arange(len(self.unit))
        log_p, who, arcs = self.lat.walk(self.unit, self._seeds(every, 0))
        self._add(log_p, who, arcs, np.zeros(len(self.starts), np.int64), self.bound, np.ones(len(self.starts), bool))

    def _add(self, log_p, who, arcs, since, value, alive) -> None:
        """A path for each text that is alive, new from unit ``since``; opens the sets that depart from it there or later."""
        n = len(self.leaves)
        before = self._prefix(log_p)
        mu = before + _log1mexp(log_p)
        own = (self.place >= since[self.doc]) & alive[self.doc]
        u = uniform(self._seeds(np.arange(len(self.unit)), 512 + n))
        queue = np.where(own, truncated_gumbel(mu, value[self.doc], u), -np.inf)
        self.leaves.append({"log_p": log_p, "who": who, "arcs": arcs, "value": np.where(alive, value, -np.inf), "queue": queue, "alive": alive, "gone": {}})

    def _best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the best open set: its leaf, its occurrence, its priority."""
        docs = len(self.starts)
        leaf, at, top = np.zeros(docs, np.int64), self.starts.copy(), np.full(docs, -np.inf)
        for i, x in enumerate(self.leaves):
            best = np.maximum.reduceat(x["queue"], self.starts)
            hit = np.flatnonzero(x["queue"] == best[self.doc])
            where = np.full(docs, -1, np.int64)
            where[self.doc[hit[::-1]]] = hit[::-1]
            better = best > top
            leaf[better], at[better], top[better] = i, where[better], best[better]
        return leaf, at, top

    def next(self) -> None:
        leaf, at, top = self._best()
        alive = np.isfinite(top)
        n = len(self.leaves)
        log_p = np.zeros(len(self.unit))
        fixed_who, fixed_arcs = [], []
        for i, x in enumerate(self.leaves):  # the path up to the departure
            keep = (alive & (leaf == i))[self.doc] & (np.arange(len(self.unit)) < at[self.doc])
            log_p[keep] = x["log_p"][keep]
            pick = keep[x["who"]]
            fixed_who.append(x["who"][pick])
            fixed_arcs.append(x["arcs"][pick])
        turn = at[alive]  # one occurrence a text: any path but those already taken there
        taken = []
        for d, o in zip(np.flatnonzero(alive), turn.tolist(), strict=True):
            x = self.leaves[leaf[d]]
            lo, hi = np.searchsorted(x["who"], [o, o + 1])
            taken.append(x["gone"].get(o) or [(tuple(x["arcs"][lo:hi].tolist()), float(x["log_p"][o]))])
        begun = [self.lat.departure(self.unit[o], old, x) for o, old, x in zip(turn, taken, self._seeds(turn, n), strict=True)]
        rest_p, rest_w, rest_a = self.lat.walk(self.unit[turn], self._seeds(turn, 256 + n), np.array([node for _, _, node in begun], np.int64))
        cut = np.searchsorted(rest_w, np.arange(len(turn) + 1)).tolist()
        others = [((*path, *rest_a[cut[i] : cut[i + 1]].tolist()), p + float(rest_p[i])) for i, (path, p, _) in enumerate(begun)]
        got_p = np.array([p for _, p in others])
        got_w = np.repeat(np.arange(len(turn)), [len(a) for a, _ in others]) if others else np.empty(0, np.int64)
        got_a = np.array([a for path, _ in others for a in path], np.int64)
        log_p[turn] = got_p
        fresh = np.flatnonzero(alive[self.doc] & (np.arange(len(self.unit)) > at[self.doc]))
        p, w, a = self.lat.walk(self.unit[fresh], self._seeds(fresh, n))
        log_p[fresh] = p
        who, arcs = np.concatenate([*fixed_who, turn[got_w], fresh[w]]), np.concatenate([*fixed_arcs, got_a, a])
        order = np.argsort(who, kind="stable")
        self._add(log_p, who[order], arcs[order], at - self.starts + 1, top, alive)
        before = self._prefix(log_p)
        for d, old, new in zip(np.flatnonzero(alive), taken, others, strict=True):  # what is left of the popped set
            o, seen = at[d], [*old, new]
            rest = _log1mexp(np.array([np.logaddexp.reduce([q for _, q in seen])]))
            u = uniform(self._seeds(np.array([o]), 768 + n))
            self.leaves[leaf[d]]["gone"][int(o)] = seen
            self.leaves[leaf[d]]["queue"][o] = truncated_gumbel(before[o] + rest, top[d : d + 1], u)[0]


def sample_texts(texts: list[str], keys: np.ndarray, pieces: Pieces, k: int, temperature: float = TEMPERATURE, chunk: int = CHUNK) -> Iterator[dict]:
    """For each of k samples and each chunk of texts: sample, row (text number), log_p, value, kappa, and the pieces' ids with each row's number of them.

    Equal units of all texts share a lattice; the search goes chunk by chunk.
    """
    split = [units_of(t, pieces.units) for t in texts]
    every = list(chain.from_iterable(split))
    unit, distinct = pd.factorize(np.array(every, dtype=object)) if every else (np.empty(0, np.int64), [])
    lattices = Lattices(list(distinct), pieces, temperature) if every else None
    units = np.array([len(s) for s in split], np.int64)
    before, sizes = np.r_[0, np.cumsum(units)], np.cumsum([len(t) for t in texts])
    del split, every, distinct
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + chunk)))
        for s in _sample_chunk(units[lo:hi], unit[before[lo] : before[hi]].astype(np.int64), keys[lo:hi], lattices, pieces, k):
            s["row"] += lo
            yield s
        lo = hi


def _sample_chunk(units: np.ndarray, unit: np.ndarray, keys: np.ndarray, lattices: Lattices | None, pieces: Pieces, k: int) -> Iterator[dict]:
    """units: how many each text has; unit: them all, by number."""
    full, empty = np.flatnonzero(units), np.flatnonzero(units == 0)
    search = None
    if len(full):
        search = _Search(lattices, unit, np.cumsum(units[full]) - units[full], keys[full])
        search.first()
        for _ in range(k - 1):
            search.next()
        kappa = search._best()[2]
    for n in range(k):
        rows, log_p, value, cap, counts, ids = [], [], [], [], [], []
        if n == 0 and len(empty):
            rows.append(empty)
            log_p.append(np.zeros(len(empty)))
            value.append(-np.log(-np.log(uniform(mixed(keys[empty].view(np.uint64) + np.uint64(0x5851F42D4C957F2D))))))
            cap.append(np.full(len(empty), -np.inf))
            counts.append(np.zeros(len(empty), np.int64))
        if search is not None:
            leaf = search.leaves[n]
            own = np.flatnonzero(leaf["alive"])
            rows.append(full[own])
            log_p.append(np.add.reduceat(leaf["log_p"], search.starts)[own])
            value.append(leaf["value"][own])
            cap.append(kappa[own])
            piece = search.lat.piece[leaf["arcs"]]
            doc = search.doc[leaf["who"]]
            if (piece < 0).any():
                piece, doc = _with_bytes(piece, doc, pieces)
            counts.append(np.bincount(doc, minlength=len(full))[own])
            ids.append(piece)
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        yield {"sample": n, "row": join(rows, np.int64), "log_p": join(log_p, float), "value": join(value, float), "kappa": join(cap, float), "counts": join(counts, np.int64), "ids": join(ids, np.int64)}


def _with_bytes(piece: np.ndarray, doc: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Characters outside the vocabulary as the pieces of their bytes."""
    at = np.flatnonzero(piece < 0)
    raw = [chr(-1 - p).encode("utf-8", "surrogatepass") for p in piece[at].tolist()]
    times = np.ones(len(piece), np.int64)
    times[at] = [len(r) for r in raw]
    out, where = np.repeat(piece, times), np.repeat(np.arange(len(piece)), times)
    out[piece[where] < 0] = [pieces.byte[b] for r in raw for b in r] if pieces.byte else 0
    return out, np.repeat(doc, times)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion_log_prob", pa.float64()), ("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())])
_DDL = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion_log_prob double, ids array<int>, decoded_sha256 string"


def log_inclusion(log_p: np.ndarray, kappa: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(log_p - kappa))), which for a long text is log_p - kappa."""
    x = log_p - kappa
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return np.where(np.isposinf(x), 0.0, np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 700))))))


def sample_segmentations(docs: DataFrame, model: str | None = None, k: int = SAMPLES, temperature: float = TEMPERATURE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, sample, n_pieces, log_prob, perturbed, inclusion_log_prob, ids, decoded_sha256, and the kept columns: up to k distinct segmentations of every whole text.

    model: path of a SentencePiece model that every executor can read. decoded_sha256: of the sample's decoded text in UTF-8.
    """
    small_batches(docs)
    path = model or public_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = None
        for batch in batches:
            pieces = pieces or vocabulary(path)
            ids, column = batch.column("doc_id"), batch.column("text")
            keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < len(column):
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + TOGETHER)))
                for s in sample_texts(column.slice(lo, hi - lo).to_pylist(), keys[lo:hi], pieces, k, temperature):
                    offsets = pa.array(np.r_[0, np.cumsum(s["counts"])].astype(np.int32))
                    chosen = pa.array(s["row"])
                    kept = [batch.column(c).slice(lo, hi - lo).take(chosen) for c in keep]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(lo, hi - lo).take(chosen), pa.array(np.full(len(s["row"]), s["sample"], np.int32)), pa.array(s["counts"]), pa.array(s["log_p"]), pa.array(s["value"]),
                         pa.array(log_inclusion(s["log_p"], s["kappa"])), pa.ListArray.from_arrays(offsets, pa.array(s["ids"].astype(np.int32))),
                         pa.array([sha256(x).hexdigest() for x in pieces.decode_rows(s["ids"], s["counts"])], pa.string()), *kept],
                        schema=pa.schema([*_SCHEMA, *[batch.schema.field(c) for c in keep]]),
                    )
                lo = hi

    ddl = ", ".join([_DDL, *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]])
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep).mapInArrow(run, ddl)


def decode_segmentations(samples: DataFrame, model: str | None = None, column: str = "ids") -> DataFrame:
    """The rows with one column more, ``decoded``: the text of each row's pieces; null where the pieces are null, U+FFFD where their bytes are no UTF-8."""
    path = model or public_model()

    @F.pandas_udf("string")
    def decoded(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = vocabulary(path)
        for batch in ids:
            known = batch.notna()
            counts = batch[known].map(len).to_numpy(np.int64)
            flat = np.concatenate([np.empty(0, np.int64), *batch[known]]).astype(np.int64)
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            out[known] = [x.decode("utf-8", "replace") for x in pieces.decode_rows(flat, counts)]
            yield out

    return samples.withColumn("decoded", decoded(F.col(column)))
