"""Column expressions over sequences. All run inside the JVM; null in, null out.

Sequences are ASCII. Where a letter has no meaning for a function the result is null in strict mode (the default).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The complements of the IUPAC codes.
DNA_CODES, DNA_COMPLEMENTS = "ABCDGHKMNRSTVWYabcdghkmnrstvwy", "TVGHCDMKNYSABWRtvghcdmknysabwr"
RNA_CODES, RNA_COMPLEMENTS = "ABCDGHKMNRSUVWXYabcdghkmnrsuvwxy", "UVGHCDMKNYSABWXRuvghcdmknysabwxr"
# The bases that each IUPAC code stands for, in the order of expansion.
IUPAC = {
    "G": "G", "A": "A", "T": "T", "C": "C", "R": "GA", "Y": "TC", "M": "AC", "K": "GT", "S": "GC", "W": "AT",
    "H": "ACT", "B": "GTC", "V": "GCA", "D": "GAT", "N": "GATC",
}
# Enthalpy and entropy of neighbouring bases in tenths (SantaLucia 1998). Pairs that read alike on the other strand share a row.
NEAREST_NEIGHBOURS = [
    (("AA", "TT"), -76, -213), (("AT",), -72, -204), (("TA",), -72, -213), (("CA", "TG"), -85, -227), (("GT", "AC"), -84, -224),
    (("CT", "AG"), -78, -210), (("GA", "TC"), -82, -222), (("CG",), -106, -272), (("GC",), -98, -244), (("GG", "CC"), -80, -199),
]
INITIATION, SYMMETRY, TERMINAL_AT = (2, -57), (0, -14), (22, 69)
GAS_CONSTANT, KELVIN = 1.9872, 273.15

ALPHABETS = {"DNA": list("ACGT"), "RNA": list("ACGU"), "protein": list("ACDEFGHIKLMNPQRSTVWY")}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def only(seq: Column, letters: str) -> Column:
    return seq.rlike(rf"\A[{letters}]*\z")


def reverse(seq: Column | str) -> Column:
    return F.reverse(_col(seq))


def _complement(seq: Column, codes: str, to: str, strict: bool) -> Column:
    swapped = F.translate(seq, codes, to)
    if strict:
        return F.when(only(seq, codes), swapped)
    return F.translate(F.regexp_replace(seq, f"[^{codes}]", "\u0000"), codes, to)


def complement(seq: Column | str, strict: bool = True) -> Column:
    """IUPAC complement that keeps the case. A letter without one gives null, or a NUL in its place if not strict."""
    return _complement(_col(seq), DNA_CODES, DNA_COMPLEMENTS, strict)


def reverse_complement(seq: Column | str, strict: bool = True) -> Column:
    return F.reverse(complement(seq, strict))


def complement_rna(seq: Column | str, strict: bool = True) -> Column:
    return _complement(_col(seq), RNA_CODES, RNA_COMPLEMENTS, strict)


def reverse_complement_rna(seq: Column | str, strict: bool = True) -> Column:
    return F.reverse(complement_rna(seq, strict))


def complement_base(base: Column | str, rna: bool = False) -> Column:
    """The complement of a single letter, a blank where there is none."""
    done = (complement_rna if rna else complement)(base)
    return F.when(_col(base).isNotNull(), F.coalesce(done, F.lit(" ")))


def is_palindromic(seq: Column | str) -> Column:
    """Whether a sequence equals its reverse complement."""
    return F.coalesce(_col(seq) == reverse_complement(seq), F.when(_col(seq).isNotNull(), F.lit(False)))


def gc_content(seq: Column | str) -> Column:
    """Share of G and C in either case; null for an empty sequence."""
    s = _col(seq)
    return F.try_divide(F.regexp_count(s, F.lit("[GCgc]")), F.length(s))


def is_dna(seq: Column | str) -> Column:
    return only(_col(seq), "ACGT")


def is_rna(seq: Column | str) -> Column:
    return only(_col(seq), "ACGU")


def encode(symbol: Column | str, symbols: list[str]) -> Column:
    """Code of a symbol of an alphabet, or of a code given as text; null if it has none."""
    s = _col(symbol)
    code = F.array_position(F.array(*map(F.lit, symbols)), s) - 1
    number = s.try_cast("int")
    return F.when(code >= 0, code).when((number >= 0) & (number < len(symbols)), number.cast("long"))


def decode(code: Column | str, symbols: list[str]) -> Column:
    """Symbol of a code; null out of range."""
    return F.get(F.array(*map(F.lit, symbols)), _col(code).cast("int"))


def extend(symbols: list[str], more: list[str]) -> list[str]:
    """An alphabet with further symbols at its end; a symbol it has already keeps its code."""
    return [*symbols, *(s for s in dict.fromkeys(more) if s not in symbols)]


def iupac_variants(seq: Column | str) -> Column:
    """All sequences an ambiguous one stands for, the last position changing fastest; null if a letter is no code."""
    s = F.upper(_col(seq))
    bases = F.create_map(*(x for k, v in IUPAC.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    grow = lambda acc, c: F.flatten(F.transform(acc, lambda p: F.transform(bases[c], lambda b: F.concat(p, b))))
    return F.when(only(s, "".join(IUPAC)) & (s != ""), F.aggregate(F.split(s, ""), F.array(F.lit("")), grow))


def kmers(seq: Column | str, k: int, last: bool = False) -> Column:
    """All substrings of k letters but the final one, as sketches and repeat finders count them; with ``last`` that one too."""
    s = _col(seq)
    n = F.length(s) - k + (1 if last else 0)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, F.lit(k)))).when(s.isNotNull(), F.array().cast("array<string>"))


def canonical_kmers(seq: Column | str, k: int, last: bool = False) -> Column:
    """The same, each as the lesser of itself and its reverse complement."""
    return F.transform(kmers(seq, k, last), lambda x: F.least(x, F.reverse(F.translate(x, DNA_CODES, DNA_COMPLEMENTS))))


def kmer_rows(df: DataFrame, seq: str, k: int, keep: list[str] | None = None, last: bool = False, canonical: bool = False) -> DataFrame:
    """A row for each k-mer: the columns to keep and ``kmer``. The same words as kmers(), but generated row by row in compiled code."""
    keep = keep or []
    n = F.length(seq) - k + (1 if last else 0)
    at = df.where(n > 0).select(*keep, F.col(seq).alias("__seq"), F.explode(F.sequence(F.lit(1), n)).alias("__i"))
    word = F.substring("__seq", F.col("__i"), F.lit(k))
    out = at.select(*keep, word.alias("kmer"))
    return out.withColumn("kmer", F.least("kmer", F.reverse(F.translate("kmer", DNA_CODES, DNA_COMPLEMENTS)))) if canonical else out


def marmur_doty(seq: Column | str) -> Column:
    """Melting temperature of a very short sequence: two degrees for A or T, four for G or C, less seven."""
    s = _col(seq)
    return (2 * F.regexp_count(s, F.lit("[ATat]")) + 4 * F.regexp_count(s, F.lit("[GCgc]")) - 7).cast("double")


def santa_lucia(seq: Column | str, primer: float, salt: float, magnesium: float = 0.0) -> Column:
    """Struct of melting_temp (Celsius), dh (kcal/mol), ds (cal/mol K) by nearest neighbours; null for an empty sequence.

    Neighbours are counted by what the text loses without them, and summed as whole tenths: exact, and linear in the length.
    """
    s = F.upper(_col(seq))
    own = s == F.reverse(F.translate(s, DNA_CODES, DNA_COMPLEMENTS))
    at = s.rlike("[AT]\\z")

    def count(pair: str) -> Column:
        lost = F.length(s) - F.length(F.replace(s, F.lit(pair[0] if pair[0] == pair[1] else pair), F.lit("")))
        # Equal letters overlap: a run of n has n - 1 pairs.
        return lost - F.regexp_count(s, F.lit(pair[0] + "+")) if pair[0] == pair[1] else (lost / 2).cast("int")

    counts = [(sum((count(x) for x in p[1:]), count(p[0])), h, e) for p, h, e in NEAREST_NEIGHBOURS]

    def tenths(i: int) -> Column:
        total = F.lit(INITIATION[i]) + F.when(own, SYMMETRY[i]).otherwise(0) + F.when(at, TERMINAL_AT[i]).otherwise(0)
        for c in counts:
            total = total + c[0] * c[i + 1]
        return total / 10.0

    dh = tenths(0)
    ds = tenths(1) + 0.368 * (F.length(s) - 1) * F.log(F.lit(salt + 140 * magnesium))
    tm = dh * 1000 / (ds + GAS_CONSTANT * F.log(F.lit(primer) / F.when(own, 1.0).otherwise(4.0))) - KELVIN
    return F.when(F.length(s) > 0, F.struct(tm.alias("melting_temp"), dh.alias("dh"), ds.alias("ds")))


def melting_temp(seq: Column | str) -> Column:
    """Melting temperature at 500 nM primer and 50 mM sodium."""
    return santa_lucia(seq, 500e-9, 50e-3)["melting_temp"]


def translate_dna(seq: Column | str, codons: dict[str, str]) -> Column:
    """Protein of a coding sequence: triplets without a meaning give nothing, one or two letters at the end are ignored. Null if empty."""
    table = F.create_map(*(F.lit(x) for pair in codons.items() for x in pair))
    triplets = F.regexp_extract_all(F.upper(_col(seq)), F.lit("(?s)..."), F.lit(0))
    return F.when(F.length(_col(seq)) > 0, F.array_join(F.transform(triplets, lambda c: table[c]), ""))


def triplets(seq: Column | str) -> Column:
    """The codons in frame, upper-cased."""
    return F.regexp_extract_all(F.upper(_col(seq)), F.lit("(?s)..."), F.lit(0))


def count_overlapping(seq: Column | str, pattern: str) -> Column:
    """Occurrences of a pattern, overlapping ones too; null for an empty pattern."""
    return F.regexp_count(_col(seq), F.lit(rf"(?=\Q{pattern}\E)")) if pattern else F.lit(None).cast("int")


def locate_all(seq: Column | str, pattern: str) -> Column:
    """0-based positions of a pattern, overlapping ones too, ascending."""
    s = _col(seq)
    if not pattern:
        return F.lit(None).cast("array<int>")
    # What stands between two matches of a look-ahead has the length of their distance.
    parts = F.split(s, rf"(?=\Q{pattern}\E)", -1)
    sums = F.transform(parts, lambda p, i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda acc, x: acc + F.length(x)))
    return F.filter(sums, lambda at: F.substring(s, at + 1, F.lit(len(pattern))) == pattern)


def extract(seq: Column | str, start: int, end: int) -> Column:
    """Letters from start to before end, 0-based; null if out of range."""
    s = _col(seq)
    return F.when((F.lit(start) >= 0) & (F.lit(start) < end) & (F.length(s) >= end), F.substring(s, start + 1, end - start))


def feature_sequence(parent: Column | str, segments: Column | str, complement_all: Column | str, start: str = "seg_start", end: str = "seg_end") -> Column:
    """Sequence of a feature: its segments in order, each turned if marked so, joined and turned if the whole is."""
    p = _col(parent)
    turn = lambda x: F.reverse(F.translate(x, DNA_CODES, DNA_COMPLEMENTS))
    part = lambda g: F.substring(p, g[start].cast("int") + 1, F.greatest(F.lit(0), (g[end] - g[start]).cast("int")))
    joined = F.array_join(F.transform(_col(segments), lambda g: F.when(g["complement"], turn(part(g))).otherwise(part(g))), "")
    return F.when(_col(complement_all), turn(joined)).otherwise(joined)


def random_sequence(length: Column | int, seed: Column | int, alphabet: str = "ACTG") -> Column:
    """Letters drawn evenly from an alphabet, the same for the same seed."""
    n = F.lit(length) if isinstance(length, int) else length
    s = F.lit(seed) if isinstance(seed, int) else seed
    pick = lambda i: F.substring(F.lit(alphabet), F.pmod(F.xxhash64(s, i), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), pick), "")).otherwise("")


def random_protein(length: Column | int, seed: Column | int) -> Column:
    """A protein that begins with M and ends with a stop; null below three letters."""
    n = F.lit(length) if isinstance(length, int) else length
    inner = random_sequence(n - 2, seed, "ACDEFGHIKLMNPQRSTVWY")
    return F.when(n > 2, F.concat(F.lit("M"), inner, F.lit("*")))


def gc_fix_suggestion(seq: Column | str, upper: float, lower: float) -> Column:
    """What is to be done about the GC content: struct of bias ('AT' or 'GC') and quantity of edits; null if it is within bounds."""
    gc, n = gc_content(seq), F.length(_col(seq))
    say = lambda bias, off: F.struct(F.lit(bias).alias("bias"), (F.floor(off * n) + 1).cast("int").alias("quantity"))
    return F.when(gc > upper, say("AT", gc - upper)).when(gc < lower, say("GC", lower - gc))
