"""Fragmentation of genes for assembly, and fixing of coding sequences for synthesis. Both work on whole arrays of codes, sequence by sequence."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.kernels import turned

# --- Overhang fidelity ------------------------------------------------------------------------------------------------

#: The words of four letters, in the order of the letters A, T, G, C; their codes are their places.
WORDS = ["".join(w) for w in product("ATGC", repeat=4)]
CODE = {w: i for i, w in enumerate(WORDS)}
_OTHER = np.array([CODE[turned(w)] for w in WORDS])
_OWN_OTHER = _OTHER == np.arange(256)


class Fidelity:
    """Counts of ligations of each overhang (row) with each partner (column), a right partner standing under the overhang's own name."""

    def __init__(self, counts: dict[tuple[str, str], float]):
        self.counts = np.zeros((256, 256))
        for (x, y), n in counts.items():
            if x in CODE and y in CODE:
                self.counts[CODE[x], CODE[y]] = n
        # A partner may come on either strand.
        self.either = self.counts + self.counts[:, _OTHER]
        self.right = np.diag(self.counts).copy()

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """All ligations of each of the 256 overhangs with those given."""
        return self.either[:, codes].sum(axis=1)

    def share(self, codes: np.ndarray) -> float:
        """Share of right ligations if all these overhangs are in one reaction: the product of each one's."""
        total, right = self.sums(codes)[codes], self.right[codes]
        off = total != right
        return float(np.prod(np.divide(right, total, out=np.zeros(len(codes)), where=total > 0)[off]))

    def shares_with_one_more(self, codes: np.ndarray) -> np.ndarray:
        """For each of the 256 overhangs, the share of the set that it would make with those given."""
        every = np.arange(256)
        own = self.sums(codes) + self.either[every, every]
        totals = np.vstack([self.sums(codes)[codes][:, None] + self.either[codes], own])
        rights = np.vstack([np.repeat(self.right[codes][:, None], 256, axis=1), self.right])
        parts = np.where(totals == rights, 1.0, np.divide(rights, totals, out=np.zeros(totals.shape), where=totals > 0))
        return parts.prod(axis=0)


def read_fidelity(path: str) -> Fidelity:
    """Counts of observed ligations, which are published as tables and given by path.

    Either a JSON list of [overhang, partner, count], or a text table, separated by commas or tabs: a line with an empty cell and the partners, then a line for
    each overhang. Partners in such a table are written as what is ligated, so that a right one is the overhang's other strand.
    """
    with open(path) as f:
        text = f.read()
    if text.lstrip().startswith("["):
        return Fidelity({(x, y): float(n) for x, y, n in json.loads(text)})
    rows = [re.split("[,\\t]", x) for x in text.splitlines() if x.strip()]
    partners = [x.strip() for x in rows[0][1:]]
    return Fidelity({(r[0].strip(), turned(p)): float(n) for r in rows[1:] for p, n in zip(partners, r[1:]) if n.strip()})


def ideal_fidelity(right: int = 1000, near: int = 2) -> Fidelity:
    """A rule for trying things out, in place of measurements: right partners ligate ``right`` times, those that differ in one letter ``near`` times.

    Shares worked out from it are no predictions. For those give a measured table to read_fidelity().
    """
    off = sum((np.array([w[i] for w in WORDS])[:, None] != np.array([w[i] for w in WORDS])[None, :]).astype(int) for i in range(4))
    out = Fidelity({})
    counts = np.where(off == 0, right, np.where(off == 1, near, 0)).astype(float)
    counts[_OWN_OTHER] = 0
    out.counts = counts
    out.either, out.right = counts + counts[:, _OTHER], np.diag(counts).copy()
    return out


def _codes(overhangs: list[str]) -> np.ndarray:
    return np.array([CODE[x] for x in overhangs if x in CODE], int)


def set_efficiency(overhangs: list[str], fidelity: Fidelity) -> float:
    """Share of right ligations if all the overhangs are in one reaction."""
    return fidelity.share(_codes(overhangs))


def next_overhangs(current: list[str], fidelity: Fidelity) -> list[tuple[str, float]]:
    """Overhangs that may be added, not palindromic nor there already on either strand, with the mean share of the sets that either strand of it makes."""
    have = _codes(current)
    free = ~_OWN_OTHER
    free[have] = free[_OTHER[have]] = False
    shares = fidelity.shares_with_one_more(have)
    return [(WORDS[i], float((shares[i] + shares[_OTHER[i]]) / 2)) for i in np.flatnonzero(free)]


def next_overhang(current: list[str], fidelity: Fidelity) -> str:
    """The first of the most efficient ones; '' if none is of use."""
    best = max(next_overhangs(current, fidelity), key=lambda x: x[1], default=("", 0.0))
    return best[0] if best[1] > 0 else ""


def _word_codes(s: str) -> np.ndarray:
    """The code of the four letters that begin at each place, -1 where one is none of A, T, G, C."""
    digit = np.full(256, -1)
    digit[[ord(c) for c in "ATGC"]] = range(4)
    d = digit[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
    if len(d) < 4:
        return np.zeros(0, int)
    four = np.lib.stride_tricks.sliding_window_view(d, 4)
    return np.where((four < 0).any(axis=1), -1, four @ np.array([64, 16, 4, 1]))


def fragment(sequence: str, least: int, most: int, fidelity: Fidelity, exclude: list[str] | None = None, include: list[str] | None = None) -> tuple[list[str], float, str | None]:
    """Pieces that overlap by four letters, the share of right ligations of their overhangs, and an error.

    From the left, each cut is the most efficient one that leaves a piece of allowed size, of equals the one with the longest piece. Where less than
    two pieces are left the allowed sizes shrink, so that no rest is too small; they stay so.
    """
    s = sequence.upper()
    words = _word_codes(s)
    used = [s[:4], s[-4:], *(exclude or [])]
    codes = _codes(used)
    barred = _OWN_OTHER.copy()
    if include:
        wanted = _codes(include)
        barred[:] = True
        barred[wanted] = barred[_OTHER[wanted]] = False
        barred |= _OWN_OTHER
    barred[codes] = barred[_OTHER[codes]] = True
    at, pieces = 0, []
    while len(s) - at >= most:
        if least > most or least < 12:
            return [], 0.0, "sizes out of order" if least > most else "least size below 12"
        if len(s) - at < 2 * most:
            narrow = min(most, (len(s) - at + most - least) // 2)
            least, most = narrow - (most - least), narrow
        ends = np.arange(at + most, at + max(least, 4) - 1, -1)  # the longest piece first
        here = words[ends - 4]
        shares = np.where((here >= 0) & ~barred[here], fidelity.shares_with_one_more(codes)[here], 0.0) if len(here) else np.zeros(0)
        if not len(shares) or shares.max() <= 0:
            return [], 0.0, "no place to cut"
        k = int(shares.argmax())
        end, code = int(ends[k]), int(here[k])
        pieces.append(s[at:end])
        codes = np.append(codes, code)
        barred[[code, _OTHER[code]]] = True
        at = end - 4
    return [*pieces, s[at:]], fidelity.share(codes), None


def fragments(seq: Column, least: int, most: int, fidelity: Fidelity, exclude: list[str] | None = None, include: list[str] | None = None) -> Column:
    """Struct of fragments, efficiency and error for each sequence; null in, null out."""

    @F.pandas_udf("fragments array<string>, efficiency double, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        got = [(None, None, None) if x is None else fragment(x, least, most, fidelity, exclude, include) for x in s]
        return pd.DataFrame(got, columns=["fragments", "efficiency", "error"])

    return run(seq)


# --- Fixing -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Suggestion:
    """Codons start to end (inclusive) need ``quantity`` changes, towards 'GC' or 'AT' or any ('NA')."""

    start: int
    end: int
    bias: str
    quantity: int
    reason: str


Finder = Callable[[str], list[Suggestion]]


def remove_sequences(words: list[str], reason: str) -> Finder:
    """Wherever one of the words stands, on either strand."""
    either = re.compile("|".join(re.escape(w) for w in dict.fromkeys(w for x in words for w in (x, turned(x)))))
    each = [re.compile(re.escape(w)) for w in dict.fromkeys(w for x in words for w in (x, turned(x)))]

    def find(s: str) -> list[Suggestion]:
        if not words or not either.search(s):
            return []
        return [Suggestion(m.start() // 3, m.end() // 3 - 1, "NA", 1, reason) for w in each for m in w.finditer(s)]

    return find


def remove_repeats(size: int) -> Finder:
    """Wherever a word of that size, or its other strand, has stood before. A hit skips on to the next codon."""

    def find(s: str) -> list[Suggestion]:
        first: dict[str, int] = {}
        out, skip = [], -1
        for at in range(len(s) - size):
            if at < skip:
                continue
            w = s[at : at + size]
            key = min(w, turned(w))
            if key in first:
                inside = at % 3
                out.append(Suggestion(at // 3, (at + size) // 3 - (inside > 0), "NA", 1, "repeat"))
                skip = at + inside + 1
            first.setdefault(key, at)
        return out

    return find


def bound_gc(high: float, low: float) -> Finder:
    def find(s: str) -> list[Suggestion]:
        n = len(s)
        gc = sum(map(s.count, "GCgc")) / n if n else (high + low) / 2
        for bias, excess in (("AT", gc - high), ("GC", low - gc)):
            if excess > 0:
                return [Suggestion(0, n // 3 - 1, bias, int(excess * n) + 1, "gc high" if bias == "AT" else "gc low")]
        return []

    return find


Change = tuple[int, int, str, str, str]  # position, step, from, to, reason


class CodonChoice:
    """A codon table as arrays: weights, which codons mean the same, and which of those are richer or poorer in G and C."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        self.triplets = [t for _, t, _ in rows]
        self.place = {t: i for i, t in enumerate(self.triplets)}
        letters = np.array([a for a, _, _ in rows])
        weights = np.array([w for _, _, w in rows], float)
        same = letters[:, None] == letters[None, :]
        totals = same @ weights
        self.sound = len(self.place) == 64 and bool((totals > 0).all())
        self.weight = np.divide(weights, totals, out=np.zeros(len(rows)), where=totals > 0)
        strong = np.array([sum(t.count(c) for c in "GC") for t in self.triplets])
        others = same & ~np.eye(len(rows), dtype=bool)
        more = strong[None, :] > strong[:, None]
        self.options = {"NA": others, "GC": others & more, "AT": others & (strong[None, :] < strong[:, None])}


def fix_cds(sequence: str, rows: list[tuple[str, str, int]], finders: list[Finder]) -> tuple[str, list[Change], str | None]:
    """The coding sequence without what the finders object to, the changes made, and an error.

    The state is a matrix of codon places by codons that each place has had. What a suggestion may choose from are the synonyms of its bias not yet
    had; each place puts forward its heaviest, and the heaviest of those are taken. As no codon comes back to its place, it ends.
    rows: letter, triplet, weight of a codon table.
    """
    table = CodonChoice(rows)
    if len(sequence) % 3:
        return "", [], "not a whole number of codons"
    if not table.sound:
        return "", [], "incomplete codon table"
    now = [sequence[i : i + 3] for i in range(0, len(sequence), 3)]
    current = np.array([table.place.get(t, -1) for t in now], int)
    had = np.zeros((len(now), 64), bool)
    had[np.flatnonzero(current >= 0), current[current >= 0]] = True
    changes: list[Change] = []
    step = 0
    while found := [x for f in finders for x in f("".join(now))]:
        for s in found:
            if s.bias not in table.options:
                return "".join(now), [], f"unknown bias {s.bias}"
            places = np.arange(max(0, s.start), min(s.end, len(now) - 1) + 1)
            places = places[current[places] >= 0]
            scores = np.where(table.options[s.bias][current[places]] & ~had[places], table.weight, -1.0)
            best = scores.argmax(axis=1) if len(places) else np.zeros(0, int)
            top = scores[np.arange(len(places)), best]
            order = np.argsort(-top, kind="stable")[: int((top >= 0).sum())]
            if len(order) < s.quantity:
                return "".join(now), [], f"{s.quantity} changes needed, {len(order)} possible"
            for k in order[: s.quantity]:
                at, to = int(places[k]), int(best[k])
                changes.append((at, step, now[at], table.triplets[to], s.reason))
                now[at], current[at], had[at, to] = table.triplets[to], to, True
        step += 1
    return "".join(now), sorted(changes, key=lambda c: (c[1], c[0])), None


def usual_finders(words: list[str]) -> list[Finder]:
    """Homopolymers, the given words, repeats of 18 letters, and a GC content outside of 20 to 80 percent."""
    return [remove_sequences(["AAAAAAAA", "GGGGGGGG"], "homopolymer"), remove_sequences(words, "unwanted word"), remove_repeats(18), bound_gc(0.80, 0.20)]


def fixed_cds(seq: Column, rows: list[tuple[str, str, int]], finders: list[Finder]) -> Column:
    """Struct of fixed, changes and error for each coding sequence, upper-cased; null in, null out."""

    @F.pandas_udf("fixed string, changes array<struct<position:int,step:int,codon_from:string,codon_to:string,reason:string>>, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in s:
            text, changes, error = (None, None, None) if x is None else fix_cds(x.upper(), rows, finders)
            names = ("position", "step", "codon_from", "codon_to", "reason")
            out.append((text, None if changes is None else [dict(zip(names, c)) for c in changes], error))
        return pd.DataFrame(out, columns=["fixed", "changes", "error"])

    return run(seq)
