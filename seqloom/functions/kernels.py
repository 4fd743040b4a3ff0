"""Arrow kernels for what is sequential within one record: hashing, rotation, sketching, alignment, suffix order."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.sequence import DNA_CODES, DNA_COMPLEMENTS

_SWAP = str.maketrans(DNA_CODES, DNA_COMPLEMENTS)


def turned(s: str) -> str:
    """Reverse complement."""
    return s.translate(_SWAP)[::-1]


# --- BLAKE3, many texts at once ---------------------------------------------------------------------------------------

# Fixed values of the published function.
_IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
_ORDER = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
_MIX = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values (8, n) from the old, message words (16, n) and a column of parameters for each."""
    n = cv.shape[1]
    low = counter.astype(np.uint64)
    v = list(cv) + [np.full(n, x, np.uint32) for x in _IV[:4]] + [(low & np.uint64(0xFFFFFFFF)).astype(np.uint32), (low >> np.uint64(32)).astype(np.uint32), size.astype(np.uint32), flags.astype(np.uint32)]
    words = list(range(16))
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_MIX):
            for word, (r, s) in ((words[2 * k], (16, 12)), (words[2 * k + 1], (8, 7))):
                v[a] = v[a] + v[b] + block[word]
                v[d] = _rotate(v[d] ^ v[a], r)
                v[c] = v[c] + v[d]
                v[b] = _rotate(v[b] ^ v[c], s)
        words = [words[i] for i in _ORDER]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)])


def blake3_hex(texts: list[bytes]) -> list[str]:
    """256-bit digests. All chunks of all texts go through the compression side by side, then the trees level by level."""
    if not texts:
        return []
    chunks = [max(1, -(-len(t) // 1024)) for t in texts]
    owner = np.repeat(np.arange(len(texts)), chunks)
    counter = np.concatenate([np.arange(c) for c in chunks])
    alone = np.array(chunks)[owner] == 1
    sizes = np.array([len(t) for t in texts])[owner] - counter * 1024
    sizes = np.minimum(sizes, 1024)
    data = np.zeros((len(owner), 1024), np.uint8)
    row = 0
    for t, c in zip(texts, chunks):
        flat = data[row : row + c].reshape(-1)
        flat[: len(t)] = np.frombuffer(t, np.uint8)
        row += c
    words = np.ascontiguousarray(data).view("<u4").reshape(len(owner), 16, 16).astype(np.uint32)
    blocks = np.maximum(1, -(-sizes // 64))
    cv = np.repeat(_IV[:, None], len(owner), axis=1)
    for b in range(int(blocks.max())):
        live = np.flatnonzero(blocks > b)
        last = blocks[live] == b + 1
        flags = (_START if b == 0 else 0) + last * (_END + alone[live] * _ROOT)
        size = np.where(last, sizes[live] - b * 64, 64)
        cv[:, live] = _compress(cv[:, live], words[live, b].T, counter[live], size, flags)
    nodes, of = cv, owner
    while True:
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        many = np.diff(np.r_[first, len(of)])
        if many.max() == 1:
            break
        place = np.arange(len(of)) - np.repeat(first, many)
        total = np.repeat(many, many)
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < total))
        root = total[left] == 2
        parents = _compress(np.repeat(_IV[:, None], len(left), axis=1), np.concatenate([nodes[:, left], nodes[:, left + 1]]), np.zeros(len(left)), np.full(len(left), 64), _PARENT + root * _ROOT)
        nodes = nodes.copy()
        nodes[:, left] = parents
        keep = place % 2 == 0
        nodes, of = nodes[:, keep], of[keep]
    out = np.ascontiguousarray(nodes.T.astype("<u4")).view(np.uint8).reshape(len(texts), 32)
    return [r.tobytes().hex() for r in out]


# --- Canonical rotation and identity ----------------------------------------------------------------------------------


def least_rotation(s: str) -> int:
    """Where the least rotation of a text begins: two candidates race, the loser skips what it has lost."""
    n, i, j, k = len(s), 0, 1, 0
    while i < n and j < n and k < n:
        a, b = s[(i + k) % n], s[(j + k) % n]
        if a == b:
            k += 1
            continue
        if a > b:
            i += k + 1
        else:
            j += k + 1
        if i == j:
            j += 1
        k = 0
    return min(i, j)


def rotate(s: str) -> str:
    at = least_rotation(s) if s else 0
    return s[at:] + s[:at]


# Letter of the kind in an identity, and the letters of its sequences.
_TYPES = {"DNA": ("D", set("ATUGCYRSWKMBDHVNZ")), "RNA": ("R", set("ATUGCYRSWKMBDHVNZ")), "PROTEIN": ("P", set("ACDEFGHIKLMNPQRSTVWYUO*BXZ"))}


def canonical(s: str | None, kind: str, circular: bool, double: bool) -> str | None:
    """The text whose digest identifies a molecule; null if a letter is foreign to the kind or a protein is to be double."""
    if s is None or kind not in _TYPES or (kind == "PROTEIN" and double):
        return None
    s = s.upper()
    if not _TYPES[kind][1].issuperset(s):
        return None
    if kind == "RNA":
        s = s.replace("U", "T")
    if circular:
        return min(rotate(s), rotate(turned(s))) if double else rotate(s)
    return min(s, turned(s)) if double else s


def seqhash(seq: Column, kind: str = "DNA", circular: bool | Column = False, double: bool | Column = False) -> Column:
    """Identity of a molecule whatever its rotation or strand: ``v1_`` with letters for kind, shape and strands, and a digest."""
    flag = lambda x: F.lit(x) if isinstance(x, bool) else x

    @F.pandas_udf("string")
    def run(s: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        texts = [canonical(x, kind, bool(a), bool(b)) for x, a, b in zip(s, c, d)]
        ok = [i for i, t in enumerate(texts) if t is not None]
        out: list = [None] * len(texts)
        for i, h in zip(ok, blake3_hex([texts[i].encode() for i in ok])):
            out[i] = f"v1_{_TYPES[kind][0]}{'C' if c[i] else 'L'}{'D' if d[i] else 'S'}_{h}"
        return pd.Series(out, dtype=object)

    return run(seq, flag(circular), flag(double))


def canonical_rotation(seq: Column, double: bool = False) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else min(rotate(x), rotate(turned(x))) if double else rotate(x))

    return run(seq)


# --- Sketches ---------------------------------------------------------------------------------------------------------


def murmur3(windows: np.ndarray) -> np.ndarray:
    """32-bit MurmurHash3, seed 0, of each row of bytes."""
    n, k = windows.shape
    h = np.zeros(n, np.uint32)
    c1, c2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
    left = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    w = windows.astype(np.uint32)
    for a in range(0, k - k % 4, 4):
        x = w[:, a] | w[:, a + 1] << np.uint32(8) | w[:, a + 2] << np.uint32(16) | w[:, a + 3] << np.uint32(24)
        h = left(h ^ (left(x * c1, 15) * c2), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    if k % 4:
        x = np.zeros(n, np.uint32)
        for i in range(k % 4):
            x |= w[:, k - k % 4 + i] << np.uint32(8 * i)
        h ^= left(x * c1, 15) * c2
    h ^= np.uint32(k)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return h ^ (h >> np.uint32(16))


def sketch_of(s: str, k: int, size: int) -> list[int]:
    """The least hashes of a text's k-mers (all but the last one), sorted; zeroes fill up what is missing, as sketches of fixed size have it."""
    raw = np.frombuffer(s.encode(), np.uint8)
    n = len(raw) - k
    if n <= 0:
        return [0] * size
    h = murmur3(np.lib.stride_tricks.sliding_window_view(raw, k)[:n])
    if n < size:
        return h.astype(np.int64).tolist() + [0] * (size - n)
    return np.sort(np.partition(h, size - 1)[:size]).astype(np.int64).tolist()


def mash_sketch(seq: Column, k: int, size: int) -> Column:
    @F.pandas_udf("array<long>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else sketch_of(x, k, size))

    return run(seq)


# --- Alignment --------------------------------------------------------------------------------------------------------


class Scoring:
    """Scores of letter pairs and a linear gap penalty (a negative number)."""

    def __init__(self, gap: int = -1, match: int = 1, mismatch: int = -1, alphabet: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ-", table: dict[tuple[str, str], int] | None = None):
        self.gap, self.index = gap, np.full(256, -1)
        self.index[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        self.scores = np.where(np.eye(len(alphabet), dtype=bool), match, mismatch)
        for (a, b), x in (table or {}).items():
            self.scores[alphabet.index(a), alphabet.index(b)] = x

    def places(self, s: str) -> np.ndarray | None:
        """The place of every letter in the alphabet; None if one is foreign."""
        try:
            x = self.index[np.frombuffer(s.encode("latin-1"), np.uint8)]
        except UnicodeEncodeError:
            return None
        return None if (x < 0).any() else x


#: Cells of a matrix that are kept at once. Of larger ones some rows are kept, and those between two of them worked out again on the way back.
KEPT_CELLS = 1 << 22


def align(a: str, b: str, scoring: Scoring, local: bool, kept_cells: int = KEPT_CELLS) -> tuple[int, str, str] | None:
    """Score and the two gapped texts. Rows of the matrix are computed whole: a running maximum carries gaps along a row.

    Of equal ways the diagonal goes before a gap in b, that before a gap in a. A global alignment ends where either text
    is used up; what is left of the other is not shown. Memory grows with one text's length times the root of the other's.
    """
    x, y = scoring.places(a), scoring.places(b)
    if x is None or y is None:
        return None
    n, m, gap = len(a), len(b), scoring.gap
    against = scoring.scores[:, y] if len(scoring.scores) else np.zeros((0, m), np.int64)
    ramp = gap * np.arange(m + 1)

    def row(i: int, above: np.ndarray) -> np.ndarray:
        best = np.empty(m + 1, np.int64)
        best[0] = 0 if local else gap * i
        np.maximum(above[:-1] + against[x[i - 1]], above[1:] + gap, out=best[1:])
        if local:
            np.maximum(best, 0, out=best)
        return np.maximum.accumulate(best - ramp) + ramp

    every = 1 if (n + 1) * (m + 1) <= kept_cells else max(1, int(n**0.5))
    h = np.zeros(m + 1, np.int64) if local else ramp.copy()
    kept, top, where = {0: h}, 0, (0, 0)
    for i in range(1, n + 1):
        h = row(i, h)
        if i % every == 0:
            kept[i] = h
        if local and h.max() > top:
            top, where = int(h.max()), (i, int(h.argmax()))
    i, j = where if local else (n, m)
    score = top if local else int(h[m])
    block: dict[int, np.ndarray] = {}

    def of(i: int) -> np.ndarray:
        """Row i, from the rows that are kept."""
        if every == 1:
            return kept[i]
        if i not in block:
            low = (i - 1) // every * every if i else 0
            block.clear()
            block[low] = kept[low]
            for k in range(low + 1, min(n, low + every) + 1):
                block[k] = row(k, block[k - 1])
        return block[i]

    one, two = [], []
    while i > 0 and j > 0:
        here, above = of(i), of(i - 1) if i - 1 in block or every == 1 else None
        if above is None:  # the row above belongs to the stretch before
            above, here = kept[i - 1] if i - 1 in kept else of(i - 1), here
        if local and here[j] <= 0:
            break
        if here[j] == above[j - 1] + against[x[i - 1], j - 1]:
            i, j = i - 1, j - 1
            one.append(a[i])
            two.append(b[j])
        elif here[j] == above[j] + gap:
            i -= 1
            one.append(a[i])
            two.append("-")
        else:
            j -= 1
            one.append("-")
            two.append(b[j])
    return score, "".join(reversed(one)), "".join(reversed(two))


def alignment(a: Column, b: Column, scoring: Scoring | None = None, local: bool = False) -> Column:
    """Struct of score, aligned_a and aligned_b; null where a text is null or has a letter without a score."""
    scoring = scoring or Scoring()

    @F.pandas_udf("score long, aligned_a string, aligned_b string")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        got = [None if p is None or q is None else align(p, q, scoring, local) for p, q in zip(x, y)]
        return pd.DataFrame([g or (None, None, None) for g in got], columns=["score", "aligned_a", "aligned_b"]).astype({"score": "Int64"})

    return run(a, b)


# Scores of the published nucleotide matrix, rows and columns in the order of its letters.
NUC_4_LETTERS = "-ACGT"
NUC_4_ROWS = [[0, 0, 0, 0, 0], [0, 5, -4, -4, -4], [0, -4, 5, -4, -4], [0, -4, -4, 5, -4], [0, -4, -4, -4, 5]]


def scoring_of(pairs: Iterable[tuple[str, str, int]], gap: int = -1) -> Scoring:
    """Scoring by a substitution matrix given as (letter, letter, score), such as the rows of read_matrix(). A pair without a score has the least of all."""
    pairs = list(pairs)
    letters = "".join(dict.fromkeys(x for a, b, _ in pairs for x in (a, b)))
    least = min((s for *_, s in pairs), default=0)
    return Scoring(gap, least, least, letters, {(a, b): int(s) for a, b, s in pairs})


def nuc_4(gap: int = -1) -> Scoring:
    return scoring_of(((x, y, NUC_4_ROWS[i][j]) for i, x in enumerate(NUC_4_LETTERS) for j, y in enumerate(NUC_4_LETTERS)), gap)


# --- Full text --------------------------------------------------------------------------------------------------------


def suffix_order(s: str) -> np.ndarray:
    """Starts of the sorted suffixes of s with an end mark that sorts first, by doubling."""
    rank = np.r_[np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.int64) + 1, 0]
    n, k = len(rank), 1
    while True:
        second = np.r_[rank[k:], np.full(min(k, n), -1)][:n]
        order = np.lexsort((second, rank))
        new = np.r_[0, np.cumsum((rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1]))]
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


def burrows_wheeler(s: str) -> str:
    padded = s + "$"
    return "".join(padded[i - 1] for i in suffix_order(s))


def bwt(seq: Column) -> Column:
    """Burrows-Wheeler transform with '$' as the end mark; null for empty texts and those that hold a '$'."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if not x or "$" in x else burrows_wheeler(x))

    return run(seq)


def suffix_array(seq: Column) -> Column:
    """Starts of the sorted suffixes, the end mark's first: the index kept beside a record that is searched again and again."""

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if not x or "$" in x else suffix_order(x).tolist())

    return run(seq)


def locate_in(seq: Column, index: Column, pattern: str) -> Column:
    """Positions of a pattern by binary search in a suffix array, in the order of the suffixes."""

    @F.pandas_udf("array<int>")
    def run(s: pd.Series, idx: pd.Series) -> pd.Series:
        def search(x, a):
            if x is None or a is None or not pattern:
                return None
            lo, hi = 0, len(a)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if x[a[mid] : a[mid] + len(pattern)] < pattern else (lo, mid)
            out = []
            while lo < len(a) and x[a[lo] : a[lo] + len(pattern)] == pattern:
                out.append(int(a[lo]))
                lo += 1
            return out

        return pd.Series([search(x, a) for x, a in zip(s, idx)], dtype=object)

    return run(seq, index)


#: Places between two rows of counts, and between two suffixes whose start is kept, of an FM index.
FM_COUNTS, FM_STARTS = 128, 32


def fm_of(s: str) -> dict:
    """The index of a text that counts and finds patterns without the text: its transform, its letters with the number of letters before each in order, their
    counts at every FM_COUNTS places, and every FM_STARTS-th start with the place in order that has it."""
    order = suffix_order(s)
    data = np.frombuffer(("\0" + s).encode("utf-32-le"), np.uint32)  # the end mark is less than any letter
    last = data[order]  # the letter before each suffix; the mark before the whole text
    letters, codes = np.unique(last, return_inverse=True)
    before = np.searchsorted(np.sort(last), letters)
    hits = codes[:, None] == np.arange(len(letters))[None, :]
    counts = np.vstack([np.zeros(len(letters), np.int64), np.cumsum(hits, axis=0)])[::FM_COUNTS]
    kept = np.flatnonzero(order % FM_STARTS == 0)
    return {
        "bwt": "".join(map(chr, last.tolist())), "letters": "".join(map(chr, letters.tolist())), "before": before.tolist(), "counts": counts.ravel().tolist(), "places": kept.tolist(), "starts": order[kept].tolist(),
    }


class FMIndex:
    """Search in what fm_of() made."""

    def __init__(self, x: dict):
        self.bwt, self.letters, self.before = x["bwt"], x["letters"], list(x["before"])
        self.counts = np.asarray(x["counts"]).reshape(-1, len(self.letters))
        self.starts = dict(zip(x["places"], x["starts"]))

    def rank(self, letter: int, at: int) -> int:
        """How often a letter occurs in the transform before a place."""
        row = at // FM_COUNTS
        return int(self.counts[row, letter]) + self.bwt.count(self.letters[letter], row * FM_COUNTS, at)

    def range(self, pattern: str) -> tuple[int, int]:
        """The places in order of the suffixes that begin with a pattern, found from its last letter to its first."""
        low, high = 0, len(self.bwt)
        for c in reversed(pattern):
            k = self.letters.find(c)
            if k < 0 or c == "\0":
                return 0, 0
            low, high = (self.before[k] + self.rank(k, x) for x in (low, high))
            if low >= high:
                return 0, 0
        return low, high

    def start(self, at: int) -> int:
        """The start of the suffix at a place in order: steps back through the text to one that is kept."""
        steps = 0
        while at not in self.starts:
            k = self.letters.index(self.bwt[at])
            at = self.before[k] + self.rank(k, at)
            steps += 1
        return self.starts[at] + steps


_FM = "bwt string, letters string, before array<int>, counts array<int>, places array<int>, starts array<int>"


def fm_index(seq: Column) -> Column:
    """Struct of an FM index, to be kept in the place of a record; null for empty texts."""

    @F.pandas_udf(_FM)
    def run(s: pd.Series) -> pd.DataFrame:
        names = ["bwt", "letters", "before", "counts", "places", "starts"]
        got = [fm_of(x) if x else dict.fromkeys(names) for x in s]
        return pd.DataFrame({n: [g[n] for g in got] for n in names})

    return run(seq)


def _fm_search(index: Column, kind: str, of) -> Column:
    @F.pandas_udf(kind)
    def run(x: pd.DataFrame) -> pd.Series:
        return pd.Series([None if r["bwt"] is None else of(FMIndex(r)) for r in x.to_dict("records")], dtype=object)

    return run(index)


def fm_count(index: Column, pattern: str) -> Column:
    """Occurrences of a pattern by an FM index alone, overlapping ones too; null for an empty pattern."""
    return _fm_search(index, "int", lambda f: f.range(pattern)[1] - f.range(pattern)[0]) if pattern else F.lit(None).cast("int")


def fm_locate(index: Column, pattern: str) -> Column:
    """0-based positions of a pattern by an FM index alone, ascending."""
    return _fm_search(index, "array<int>", lambda f: sorted(f.start(i) for i in range(*f.range(pattern)))) if pattern else F.lit(None).cast("array<int>")


def mash_similarity(a: Column, b: Column) -> Column:
    """Hashes that two sorted sketches share, repeats counted, over the size of the smaller; 1 minus it is the distance."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q):
            if p is None or q is None or not len(p) or not len(q):
                return None
            (u, m), (v, n) = (np.unique(np.asarray(z), return_counts=True) for z in (p, q))
            both, i, j = np.intersect1d(u, v, return_indices=True)
            return float(np.minimum(m[i], n[j]).sum()) / min(len(p), len(q))

        return pd.Series([one(p, q) for p, q in zip(x, y)], dtype=float)

    return run(a, b)
