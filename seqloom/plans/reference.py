"""Queries of the sequence operators over whole tables, and the SQL that says the same.

Sequences are the letters of fasta.sequence (and of features.sequence for coding regions), whole. Only what can't be done with them, the expansion of
ambiguous letters, takes words derived from the keys of supplier.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import kernels as K
from seqloom.functions import sequence as S
from seqloom.functions.genetic_code import DIFFERENT, STANDARD, genetic_code
from seqloom.functions.letters import letters
from seqloom.operators import codons as C
from seqloom.operators import primers as P
from seqloom.operators import synthesis as Y
from seqloom.operators.cloning import ENZYMES, digest_parts, golden_gate
from seqloom.operators.features import location
from seqloom.operators.fold import fold
from seqloom.operators.rejects import parse_lines, valid_rows
from seqloom.plans.problems import PILEUP_LINES
from seqloom.session import spread, table
from seqloom.sources.writers import fasta_text, fastq_text, pileup_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_SEQ = "with s as (select fasta_id id, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) seq from fasta where regexp_matches(sequence, '[A-Za-z]')) "
_DNA = "with s as (select * from (select fasta_id id, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) seq from fasta) where regexp_full_match(seq, '[ACGT]+')) "
_OLIGO = "with s as (select s_suppkey id, translate(md5(cast(s_suppkey as varchar)), '0123456789abcdef', 'ACGTACGTACGTACGT') seq from supplier) "
_CDS = "with s as (select * from (select feature_id id, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) seq from features where feature_type = 'CDS') where seq <> '' and length(seq) % 3 = 0) "


def sequences(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "fasta").select(F.col("fasta_id").alias("id"), "sequence")).select("id", letters(F.col("sequence")).alias("seq")).where("seq != ''")


def dna(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d).where(S.is_dna("seq"))


def coding(spark: SparkSession, d: str) -> DataFrame:
    f = spread(table(spark, d, "features").where("feature_type = 'CDS' and sequence is not null").select("feature_id", "feature_type", "sequence"))
    f = f.select(F.col("feature_id").alias("id"), "feature_type", letters(F.col("sequence")).alias("sequence"))
    return C.coding_regions(f).select("id", F.col("sequence").alias("seq"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def scalar(name: str, of: Callable[[Column], Column], source=sequences, sql: str | None = None, base: str = _SEQ) -> None:
    """A query that projects one expression over a table's sequences."""
    QUERIES[name] = lambda spark, d: source(spark, d).select("id", of(F.col("seq")).alias("value"))
    if sql:
        ORACLE[name] = f"{base}select id, {sql} as value from s"


_IUPAC = f"[{S.DNA_CODES}]*"
_COMP = f"translate(seq, '{S.DNA_CODES}', '{S.DNA_COMPLEMENTS}')"
_RNA = f"translate(replace(seq, 'T', 'U'), '{S.RNA_CODES}', '{S.RNA_COMPLEMENTS}')"
_RNA_OK = f"regexp_full_match(replace(seq, 'T', 'U'), '[{S.RNA_CODES}]*')"
_OK = f"regexp_full_match(seq, '{_IUPAC}')"
as_rna = lambda s: F.translate(s, "T", "U")

scalar("reverse", S.reverse, sql="reverse(seq)")
scalar("complement", S.complement, sql=f"case when {_OK} then {_COMP} end")
scalar("reverse_complement", S.reverse_complement, sql=f"case when {_OK} then reverse({_COMP}) end")
scalar("complement_rna", lambda s: S.complement_rna(as_rna(s)), sql=f"case when {_RNA_OK} then {_RNA} end")
scalar("reverse_complement_rna", lambda s: S.reverse_complement_rna(as_rna(s)), sql=f"case when {_RNA_OK} then reverse({_RNA}) end")
_each = lambda s, f: F.array_join(F.transform(F.split(s, ""), f), "")
_LACKING = {k: "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in codes) for k, codes in (("DNA", S.DNA_CODES), ("RNA", S.RNA_CODES))}
scalar("complement_base", lambda s: _each(s, lambda c: S.complement_base(c)), sql=f"translate(seq, '{S.DNA_CODES}{_LACKING['DNA']}', '{S.DNA_COMPLEMENTS}{' ' * len(_LACKING['DNA'])}')")
scalar("complement_base_rna", lambda s: _each(as_rna(s), lambda c: S.complement_base(c, rna=True)), sql=f"translate(replace(seq, 'T', 'U'), '{S.RNA_CODES}{_LACKING['RNA']}', '{S.RNA_COMPLEMENTS}{' ' * len(_LACKING['RNA'])}')")
scalar("is_palindromic", S.is_palindromic, sql=f"case when {_OK} then seq = reverse({_COMP}) else false end")
scalar("gc_content", lambda s: F.round(S.gc_content(s), 9), sql="round(len(regexp_extract_all(seq, '[GC]')) / length(seq)::double, 9)")
scalar("is_dna", S.is_dna, sql="regexp_full_match(seq, '[ACGT]*')")
scalar("is_rna", lambda s: S.is_rna(as_rna(s)), sql="regexp_full_match(replace(seq, 'T', 'U'), '[ACGU]*')")
scalar("alphabet_encode", lambda s: _each(s, lambda c: F.coalesce(S.encode(c, S.extend(S.ALPHABETS["DNA"], ["N"])).cast("string"), F.lit("-"))), sql="regexp_replace(translate(seq, 'ACGTN', '01234'), '[A-Z]', '-', 'g')")
scalar("alphabet_decode", lambda s: _each(s, lambda c: F.coalesce(S.decode(S.encode(c, S.ALPHABETS["DNA"]), S.ALPHABETS["DNA"]), F.lit("-"))), sql="regexp_replace(seq, '[^ACGT]', '-', 'g')")
scalar("marmur_doty", S.marmur_doty, sql="2.0::double * len(regexp_extract_all(seq, '[AT]')) + 4 * len(regexp_extract_all(seq, '[GC]')) - 7")


def _tenths(seq: str, i: int) -> str:
    cases = " ".join(f"when '{p}' then {x[i]}" for pairs, *x in S.NEAREST_NEIGHBOURS for p in pairs)
    return f"coalesce(list_sum(list_transform(range(1, length({seq})), lambda i: case substr({seq}, i, 2) {cases} else 0 end)), 0)"


def _own(seq: str) -> str:
    return f"{seq} = reverse(translate({seq}, '{S.DNA_CODES}', '{S.DNA_COMPLEMENTS}'))"


def _thermo(seq: str, primer: float, salt: float) -> tuple[str, str, str]:
    start = [f"({S.INITIATION[i]} + case when {_own(seq)} then {S.SYMMETRY[i]} else 0 end + case when right({seq}, 1) in ('A', 'T') then {S.TERMINAL_AT[i]} else 0 end + {_tenths(seq, i)}) / 10.0::double" for i in (0, 1)]
    ds = f"({start[1]} + 0.368 * (length({seq}) - 1) * ln({salt}::double))"
    return f"({start[0]}) * 1000 / ({ds} + {S.GAS_CONSTANT} * ln({primer}::double / case when {_own(seq)} then 1.0 else 4.0 end)) - {S.KELVIN}", f"({start[0]})", ds


QUERIES["santa_lucia"] = lambda spark, d: sequences(spark, d).withColumn("t", S.santa_lucia("seq", 0.1e-6, 0.35)).select("id", *(F.round(f"t.{x}", 5).alias(x) for x in ("melting_temp", "dh", "ds")))
ORACLE["santa_lucia"] = _SEQ + "select id, round({}, 5) melting_temp, round({}, 5) dh, round({}, 5) ds from s".format(*_thermo("seq", 0.1e-6, 0.35))
scalar("melting_temp", lambda s: F.round(S.melting_temp(s), 5), sql=f"round({_thermo('seq', 500e-9, 50e-3)[0]}, 5)")
scalar("count_pattern", lambda s: S.count_overlapping(s, "AA"), sql="len(list_filter(range(1, length(seq)), lambda i: substr(seq, i, 2) = 'AA'))")
_PLACES = "array_to_string(list_transform(list_filter(range(1, length(seq) + 1), lambda i: substr(seq, i, {1}) = '{0}'), lambda i: i - 1), ',')"
scalar("locate_pattern", lambda s: F.array_join(S.locate_all(s, "CACA").cast("array<string>"), ","), sql=_PLACES.format("CACA", 4))
scalar("extract", lambda s: S.extract(s, 100, 130), sql="case when length(seq) >= 130 then substr(seq, 101, 30) end")
scalar("sequence_length", F.length, sql="cast(length(seq) as integer)")
# Sorting rotations takes SQL the square of the length: DNA without ambiguous letters is short enough. The queries of all sequences have no SQL.
scalar("burrows_wheeler", K.bwt, dna, "array_to_string(list_transform(list_sort(list_transform(range(1, length(seq) + 2), lambda i: substr(seq || '$', i) || substr(seq, 1, i - 1))), lambda r: right(r, 1)), '')", _DNA)
scalar("burrows_wheeler_all", K.bwt)
scalar("suffix_array_locate", lambda s: F.array_join(F.array_sort(K.locate_in(s, K.suffix_array(s), "GT")).cast("array<string>"), ","), sql=_PLACES.format("GT", 2))
scalar("fm_count", lambda s: K.fm_count(K.fm_index(s), "AC"), sql="len(list_filter(range(1, length(seq)), lambda i: substr(seq, i, 2) = 'AC'))::integer")
scalar("fm_locate", lambda s: F.array_join(K.fm_locate(K.fm_index(s), "ACAG").cast("array<string>"), ","), sql=_PLACES.format("ACAG", 4))
_ROT = "list_min(list_transform(range(1, length({0}) + 1), lambda i: substr({0}, i) || substr({0}, 1, i - 1)))"
scalar("canonical_rotation", K.canonical_rotation, dna, _ROT.format("seq"), _DNA)
scalar("canonical_rotation_all", K.canonical_rotation)
scalar("canonical_circular", lambda s: F.md5(K.canonical_rotation(s, double=True)), dna, f"md5(least({_ROT.format('seq')}, {_ROT.format(f'reverse({_COMP})')}))", _DNA)
scalar("seqhash", lambda s: K.seqhash(s, "DNA", False, True), dna)
scalar("seqhash_circular", lambda s: K.seqhash(s, "DNA", True, True), dna)
scalar("mash_sketch", lambda s: K.mash_sketch(s, 17, 50))
_AA = "substr('{}', 16 * (strpos('TCAG', substr(seq, 3 * i + 1, 1)) - 1) + 4 * (strpos('TCAG', substr(seq, 3 * i + 2, 1)) - 1) + strpos('TCAG', substr(seq, 3 * i + 3, 1)), 1)"
for _n in (1, 11, 2):
    _code = genetic_code(_n)
    scalar(f"translate_table_{_n}", lambda s, c=_code: S.translate_dna(s, c), dna, f"array_to_string(list_transform(range(0, length(seq) // 3), lambda i: {_AA.format(''.join(_code.values()))}), '')", _DNA)
assert "".join(genetic_code(1).values()) == STANDARD


def translate_all_tables(spark, d):
    """Every DNA sequence by every genetic code."""
    s = dna(spark, d)
    said = F.array(*(F.struct(F.lit(n).alias("number"), F.md5(F.coalesce(S.translate_dna("seq", genetic_code(n)), F.lit(""))).alias("digest")) for n in DIFFERENT))
    return s.select("id", F.explode(said).alias("x")).select("id", "x.*")


QUERIES["translate_all_tables"] = translate_all_tables
_TABLES = ", ".join(f"({n}, '{''.join(genetic_code(n).values())}')" for n in DIFFERENT)
ORACLE["translate_all_tables"] = _DNA + f", c(number, code) as (values {_TABLES}) select id, number, md5(array_to_string(list_transform(range(0, length(seq) // 3), lambda i: {_AA.replace(chr(39) + '{}' + chr(39), 'code')}), '')) digest from s, c"
scalar("gc_fix_suggestion", lambda s: F.to_json(S.gc_fix_suggestion(s, 0.52, 0.48)), dna)
ORACLE["gc_fix_suggestion"] = _DNA + ", g as (select *, len(regexp_extract_all(seq, '[GC]')) / length(seq)::double gc from s) select id, case when gc > 0.52 then '{\"bias\":\"AT\",\"quantity\":' || cast(floor((gc - 0.52) * length(seq)) + 1 as integer) || '}' when gc < 0.48 then '{\"bias\":\"GC\",\"quantity\":' || cast(floor((0.48 - gc) * length(seq)) + 1 as integer) || '}' end as value from g"


@query()
def fold_dna(spark, d):
    """All DNA sequences whole, whatever their length: spread finely, as a long one takes as long as thousands of others."""
    rows = dna(spark, d).repartition(4 * spark.sparkContext.defaultParallelism)
    return rows.select("id", F.to_json(fold(F.col("seq"), 37.0, longest=None)).alias("value"))


@query(_OLIGO.replace("'ACGTACGTACGTACGT') seq", "'ACGTRYMKSWHBVDNA') whole") + ", c(code, bases) as (values " + ", ".join(f"('{k}', '{v}')" for k, v in S.IUPAC.items()) + """),
  b as (select id, substr(whole, 1, 6) seq from s),
  r as (with recursive r(id, seq, n, place, variant) as (select id, seq, 0, 0::bigint, '' from b
    union all select id, seq, n + 1, place * length(bases) + j - 1, variant || substr(bases, cast(j as integer), 1) from r join c on code = substr(seq, n + 1, 1), unnest(range(1, length(bases) + 1)) u(j) where n < 6)
    select * from r)
  select id, cast(place as integer) place, variant from r where n = 6""")
def iupac_variants(spark, d):
    """Six-letter ambiguous primers, derived from the keys of supplier, expanded."""
    six = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.substring(F.translate(F.md5(F.col("s_suppkey").cast("string")), "0123456789abcdef", "ACGTRYMKSWHBVDNA"), 1, 6).alias("seq"))
    return six.select("id", F.posexplode(S.iupac_variants("seq")).alias("place", "variant"))


_KMERS = _DNA + ", k as (select id, substr(seq, cast(i as integer), {0}) kmer from s, unnest(range(1, length(seq) - {0} + 1)) u(i)) "


@query(_KMERS.format(6) + "select kmer, count(*) n from k group by kmer")
def kmer_counts(spark, d):
    return S.kmer_rows(dna(spark, d), "seq", 6).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query(_KMERS.format(6) + f"select least(kmer, reverse(translate(kmer, '{S.DNA_CODES}', '{S.DNA_COMPLEMENTS}'))) kmer, count(*) n from k group by 1")
def canonical_kmer_counts(spark, d):
    return S.kmer_rows(dna(spark, d), "seq", 6, canonical=True).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query(_KMERS.format(10) + f", c as (select id, least(kmer, reverse(translate(kmer, '{S.DNA_CODES}', '{S.DNA_COMPLEMENTS}'))) kmer, count(*) n from k group by all) select id, kmer, n from c where n > 1")
def repeated_kmers(spark, d):
    """Ten-letter words that a sequence holds more than once on either strand."""
    words = S.kmer_rows(dna(spark, d), "seq", 10, ["id"], canonical=True)
    return words.groupBy("id", "kmer").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


_FREQ = ", f as (select substr(seq, cast(3 * i + 1 as integer), 3) triplet, count(*) n from s, unnest(range(0, length(seq) // 3)) u(i) group by 1) "
_DIM = ", dim as (select substr('TCAG', cast(a as integer), 1) || substr('TCAG', cast(b as integer), 1) || substr('TCAG', cast(c as integer), 1) triplet, substr('" + STANDARD + "', cast(16 * (a - 1) + 4 * (b - 1) + c as integer), 1) letter from range(1, 5) x(a), range(1, 5) y(b), range(1, 5) z(c)) "
_WEIGHTS = ", w as (select letter, triplet, coalesce(n, 0) weight from dim left join f using (triplet)) "


@query(_CDS + _FREQ + "select * from f")
def codon_frequency(spark, d):
    return C.codon_frequency(coding(spark, d), F.col("seq"))


@query(_CDS + _FREQ + _DIM + _WEIGHTS + "select * from w")
def codon_weights(spark, d):
    return C.weigh(C.codon_dim(spark), codon_frequency(spark, d))


@query(_CDS + "select substr(seq, 1, 3) start_codon, count(*) n from s group by 1")
def start_codon_counts(spark, d):
    return C.start_counts(coding(spark, d), F.col("seq"))


@query(_CDS + "select id, seq from s")
def coding_regions(spark, d):
    return coding(spark, d)


def _dna_weights(spark, d):
    return C.weigh(C.codon_dim(spark), C.codon_frequency(dna(spark, d), F.col("seq")))


_TWO = _CDS + _FREQ + _DIM + _WEIGHTS + ", s2 as (select * from (select upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) seq from fasta) where regexp_full_match(seq, '[ACGT]+')), f2 as (select substr(seq, cast(3 * i + 1 as integer), 3) triplet, count(*) n from s2, unnest(range(0, length(seq) // 3)) u(i) group by 1), w2 as (select letter, triplet, coalesce(n, 0) weight from dim left join f2 using (triplet)) "


@query(_TWO + "select w.letter, w.triplet, w.weight + w2.weight weight from w join w2 using (triplet)")
def add_codon_tables(spark, d):
    return C.add_tables(codon_weights(spark, d), _dna_weights(spark, d))


@query(_TWO + """, p as (select w.letter, w.triplet, cast(floor(w.weight::double / nullif(sum(w.weight) over (partition by w.letter), 0) * 10000) as integer) p1,
    cast(floor(w2.weight::double / nullif(sum(w2.weight) over (partition by w.letter), 0) * 10000) as integer) p2 from w join w2 using (letter, triplet))
  select letter, triplet, case when p1 < 1000 or p2 < 1000 then 0 else cast(floor((p1 + p2) / 2.0) as integer) end weight from p""")
def compromise_codon_tables(spark, d):
    return C.compromise(codon_weights(spark, d), _dna_weights(spark, d), 0.1)


@query(_CDS + _FREQ + _DIM + _WEIGHTS + """, t as (select *, sum(weight) over (partition by letter) total from w), k as (select letter, triplet, weight from t where weight > 0.1 * total)
  select letter, triplet, round((sum(weight) over (partition by letter order by triplet) - weight)::double / sum(weight) over (partition by letter), 9) low,
    round((sum(weight) over (partition by letter order by triplet))::double / sum(weight) over (partition by letter), 9) high from k""")
def codon_cdf(spark, d):
    return C.codon_cdf(codon_weights(spark, d))


@query(_SEQ + "select id, seq protein, 3 * length(seq) n_bases from s where regexp_full_match(seq, '[ACDEFGHIKLMNPQRSTVWY]+') and not regexp_full_match(seq, '[ACGT]+')")
def optimize_codons(spark, d):
    """Proteins written as DNA, and what the DNA says."""
    rows = C.table_rows(_dna_weights(spark, d))
    p = sequences(spark, d).where(F.col("seq").rlike("^[ACDEFGHIKLMNPQRSTVWY]+$") & ~S.is_dna("seq"))
    return p.withColumn("cds", C.optimize(F.col("seq"), rows, 7)).select("id", S.translate_dna("cds", genetic_code(1)).alias("protein"), F.length("cds").alias("n_bases"))


@query(_CDS + _FREQ + _DIM + _WEIGHTS + ", n as (select substr(seq, 1, 3) triplet, count(*) n_starts from s group by 1) "
       "select letter, w.triplet, weight, w.triplet in ('TTG', 'CTG', 'ATG') is_start, letter = '*' is_stop, coalesce(n_starts, 0) n_starts, (select count(*) from s) gene_count from w left join n on n.triplet = w.triplet")  # fmt: skip
def genome_codon_table(spark, d):
    f = spread(table(spark, d, "features").where("feature_type = 'CDS' and sequence is not null").select("feature_type", "sequence"))
    return C.genome_table(spark, f.select("feature_type", letters(F.col("sequence")).alias("sequence")))


@query("with f as (select feature_id, complement, upper(regexp_replace(g.sequence, '[^A-Za-z]', '', 'g')) p, segments from features x join genbank g using (record_id) where g.sequence is not null and len(segments) > 0), "
       f"j as (select feature_id, complement, array_to_string(list_transform(segments, lambda g: case when g.complement then reverse(translate(substr(p, g.seg_start + 1, greatest(0, g.seg_end - g.seg_start)), '{S.DNA_CODES}', '{S.DNA_COMPLEMENTS}')) else substr(p, g.seg_start + 1, greatest(0, g.seg_end - g.seg_start)) end), '') s from f) "
       f"select feature_id, md5(case when complement then reverse(translate(s, '{S.DNA_CODES}', '{S.DNA_COMPLEMENTS}')) else s end) digest from j")  # fmt: skip
def feature_sequences(spark, d):
    """Features of GenBank records cut from their record's letters."""
    g = table(spark, d, "genbank").where("sequence is not null").select("record_id", letters(F.col("sequence")).alias("p"))
    f = table(spark, d, "features").where(F.size("segments") > 0).select("feature_id", "record_id", "segments", F.col("complement").alias("turned"))
    return f.join(g, "record_id").select("feature_id", F.md5(S.feature_sequence("p", "segments", F.coalesce("turned", F.lit(False)))).alias("digest"))


# Nearly all primers are short: longer ones are looked for where none of 60 letters or less was found.
_TEMP = _thermo("x", 500e-9, 50e-3)[0]
_DESIGN = _DNA + f""", ends as (select id, 'forward' side, seq from s union all select id, 'reverse', reverse({_COMP}) from s),
  m1 as (select id, side, min_by(x, k) x from (select id, side, k, substr(seq, 1, cast(k as integer)) x from ends, unnest(range(15, 61)) u(k) where k <= length(seq)) where {_TEMP} >= 55.0 group by id, side),
  rest as (select * from ends anti join m1 using (id, side) where length(seq) > 60),
  m2 as (select id, side, min_by(x, k) x from (select id, side, k, substr(seq, 1, cast(k as integer)) x from rest, unnest(range(61, length(seq) + 1)) u(k)) where {_TEMP} >= 55.0 group by id, side),
  m as (select * from m1 union all select * from m2)
  select s.id, a.x forward, b.x reverse from s left join m a on a.id = s.id and a.side = 'forward' left join m b on b.id = s.id and b.side = 'reverse'"""


@query(_DESIGN)
def design_primers(spark, d):
    return dna(spark, d).withColumn("p", P.design_primers(F.col("seq"), 55.0)).select("id", "p.forward", "p.reverse")


@query(_DESIGN.replace("a.x forward, b.x reverse", "'TTATAGGTCTCATACT' || a.x forward, 'TATATGGTCTCTTCAT' || b.x reverse"))
def design_primers_overhangs(spark, d):
    return dna(spark, d).withColumn("p", P.design_primers(F.col("seq"), 55.0, "TTATAGGTCTCATACT", "ATGAAGAGACCATATA")).select("id", "p.forward", "p.reverse")


def _pairs_sql(circular: bool) -> str:
    """Sites of each sequence's own primers, paired: the first reverse one before the next forward one, the last forward one with all that follow."""
    temp = _thermo("x", 500e-9, 50e-3)[0]
    around = """ union all select id, pos, rpos from (select f.id, f.pos, r.rpos, f.first from f join r on r.id = f.id and r.rpos < f.first where f.nxt is null and not exists (select 1 from r q where q.id = f.id and q.rpos > f.pos))""" if circular else ""
    return "with made as (" + _DESIGN + """), pr as (select m.id, s.seq, side, p from (select id, 'forward' side, forward p from made where forward is not null and reverse is not null union all select id, 'reverse', reverse from made where forward is not null and reverse is not null) m
    join (""" + _DNA + """ select * from s) s on s.id = m.id),
  tk as (select id, seq, side, p, k, right(p, cast(k as integer)) x from pr, unnest(range(7, length(p) + 1)) u(k)),
  k0 as (select id, seq, side, p, min(k) k0 from tk where """ + temp + """ >= 55.0 group by all),
  bind as (select id, seq, side, p, right(p, cast(k0 - 1 as integer)) e from k0 where k0 > 7),
  fs as (select id, side, p, e, i - 1 pos from bind, unnest(range(1, length(seq) - length(e) + 2)) u(i) where substr(seq, cast(i as integer), length(e)) = e),
  rs as (select id, side, p, i - 1 rpos from (select *, reverse(translate(e, 'ACGT', 'TGCA')) b from bind), unnest(range(1, length(seq) - length(e) + 2)) u(i) where substr(seq, cast(i as integer), length(e)) = b),
  f as (select id, pos, lead(pos) over (partition by id order by pos) nxt, min(pos) over (partition by id) as first from (select distinct id, pos from fs)), r as (select distinct id, rpos from rs),
  near as (select f.id, f.pos, r.rpos, f.nxt, row_number() over (partition by f.id, f.pos order by r.rpos) rn from f join r on f.id = r.id and f.pos < r.rpos and (f.nxt is null or r.rpos < f.nxt)),
  pair as (select id, pos, rpos from near where nxt is null or rn = 1""" + around + """),
  product as (select id, pos, rpos, fs.side a, rs.side b, left(fs.p, length(fs.p) - length(fs.e)) || case when rpos > pos then substr(seq, cast(pos + 1 as integer), cast(rpos - pos as integer)) else substr(seq, cast(pos + 1 as integer)) || substr(seq, 1, cast(rpos as integer)) end
    || reverse(translate(rs.p, 'ACGT', 'TGCA')) x from pair join fs using (id, pos) join rs using (id, rpos) join (select distinct id, seq from pr) using (id))
  select id, count(x) n, coalesce(md5(string_agg(x, '|' order by pos, rpos, a, b)), md5('')) products from (select distinct id from pr) left join product using (id) group by id"""


def _with_own_primers(spark, d) -> DataFrame:
    own = dna(spark, d).withColumn("p", P.design_primers(F.col("seq"), 55.0)).where("p.forward is not null and p.reverse is not null")
    return own.withColumn("primers", F.array("p.forward", "p.reverse"))


def _product_digests(made: DataFrame) -> DataFrame:
    return made.select("id", F.size("products").cast("bigint").alias("n"), F.md5(F.array_join("products", "|")).alias("products"))


@query(_pairs_sql(False))
def pcr_pairs(spark, d):
    """Every sequence amplified with its own primers."""
    return _product_digests(P.pcr(_with_own_primers(spark, d), "id", "seq", "primers", 55.0, check=False))


@query(_pairs_sql(True))
def pcr_pairs_circular(spark, d):
    return _product_digests(P.pcr(_with_own_primers(spark, d), "id", "seq", "primers", 55.0, circular=True, check=False))


@query()
def pcr_products(spark, d):
    """The same with the look for concatemers."""
    return P.pcr(_with_own_primers(spark, d), "id", "seq", "primers", 55.0)


@query()
def pcr_circular(spark, d):
    return P.pcr(_with_own_primers(spark, d), "id", "seq", "primers", 55.0, circular=True)


def _digest_sql(site: str, back: str, skip: int, circular: bool, directional: bool) -> str:
    """Cuts in order, and the pieces between neighbours; single cuts are cases of their own."""
    k, m = 4, len(site)
    both = "seq || seq" if circular else "seq"
    trim = "" if circular else f" where r > 1 or pos + {skip + k} <= length(whole)"
    kept = "strand = 0 and nstrand = 1 and " if directional else ""
    rest = "" if directional else (
        f""" union all select id, 1, substr(seq, cast(pos + {k + 1} as integer)) || substr(seq, 1, cast(pos as integer)), substr(whole, cast(pos + 1 as integer), {k}), substr(whole, cast(pos + 1 as integer), {k}) from p where many = 2 and k = 1""" if circular else
        f""" union all select id, 1, case when strand = 0 then substr(whole, cast(pos + {k + 1} as integer)) else substr(whole, 1, cast(pos - {k} as integer)) end, case when strand = 0 then substr(whole, cast(pos + 1 as integer), {k}) else '' end,
      case when strand = 0 then '' else substr(whole, cast(pos - {k - 1} as integer), {k}) end from p where many = 1
    union all select id, 2, case when strand = 0 then substr(whole, 1, cast(pos as integer)) else substr(whole, cast(pos + 1 as integer)) end, case when strand = 0 then '' else substr(whole, cast(pos - {k - 1} as integer), {k}) end,
      case when strand = 0 then substr(whole, cast(pos + 1 as integer), {k}) else '' end from p where many = 1""")  # fmt: skip
    single = "" if directional else f" and many <> {2 if circular else 1}"
    return _DNA + f""", w as (select id, seq, {both} as whole from s), sites as (select id, seq, whole, i - 1 + {m + skip} pos, 0 strand from w, unnest(range(1, length(whole) - {m - 2})) u(i) where substr(whole, cast(i as integer), {m}) = '{site}'
    union all select id, seq, whole, i - 1 - {skip}, 1 from w, unnest(range(1, length(whole) - {m - 2})) u(i) where substr(whole, cast(i as integer), {m}) = '{back}'),
  t as (select * from (select *, row_number() over (partition by id, strand order by pos desc) r from sites){trim}),
  p as (select *, lead(pos) over w nxt, lead(strand) over w nstrand, row_number() over w k, count(*) over (partition by id) many from t window w as (partition by id order by pos, strand)),
  f as (select id, k, case when pos >= 0 then substr(whole, cast(pos + 1 as integer), cast(nxt - pos as integer)) else '' end x from p where nxt is not null and {kept}(k = 1 or pos - {m + skip} <= length(seq)){single}),
  g as (select id, k, substr(x, {k + 1}, length(x) - {2 * k}) fragment, substr(x, 1, {k}) forward, right(x, {k}) reverse from f where length(x) > 8{rest})
  select id, cast(row_number() over (partition by id order by k) as integer) fragment_no, fragment, forward, reverse from g"""


@query(_digest_sql("GGTCTC", "GAGACC", 1, False, True))
def digest_directional(spark, d):
    return digest_parts(dna(spark, d), "id", "seq", ENZYMES["BsaI"])


@query(_digest_sql("GAAGAC", "GTCTTC", 2, False, False))
def digest_all(spark, d):
    return digest_parts(dna(spark, d), "id", "seq", ENZYMES["BbsI"], directional=False)


@query(_digest_sql("GCGATG", "CATCGC", 10, True, True))
def digest_circular(spark, d):
    return digest_parts(dna(spark, d), "id", "seq", ENZYMES["BtgZI"], circular=True)


@query(_digest_sql("GGTCTC", "GAGACC", 1, True, False))
def digest_circular_all(spark, d):
    return digest_parts(dna(spark, d), "id", "seq", ENZYMES["BsaI"], circular=True, directional=False)


_FREE = "replace(replace(seq, 'GGTCTC', 'GGTCTA'), 'GAGACC', 'GAGACA')"
_THIRDS = ["substr(seq, 1, length(seq) // 3)", "substr(seq, length(seq) // 3 + 1, length(seq) // 3)", "substr(seq, 2 * (length(seq) // 3) + 1)"]


@query(_DNA + f", p as (select id, {_FREE} seq from s) select id reaction, 1 n_constructs, 0 n_loops, md5('AATGAA' || {_THIRDS[0]} || 'AACGAGAA' || {_THIRDS[1]} || 'AATACTAA' || {_THIRDS[2]} || 'AA') construct from p")
def golden_gate_reactions(spark, d):
    """Each sequence, rid of the enzyme's sites, as three parts whose ends make a ring."""
    ends = ["AATG", "CGAG", "TACT", "AATG"]
    free = F.replace(F.replace("seq", F.lit("GGTCTC"), F.lit("GGTCTA")), F.lit("GAGACC"), F.lit("GAGACA"))
    third = F.floor(F.length("seq") / 3).cast("int")
    cut = [F.substring("seq", F.lit(1), third), F.substring("seq", third + 1, third), F.substring("seq", 2 * third + 1, F.length("seq"))]
    part = lambda i: F.struct(F.lit(i).alias("part_no"), F.concat(F.lit(f"TTGGTCTCA{ends[i]}AA"), cut[i], F.lit(f"AA{ends[i + 1]}TGAGACCAA")).alias("sequence"))
    parts = dna(spark, d).select("id", free.alias("seq")).select(F.col("id").alias("reaction"), F.explode(F.array(part(0), part(1), part(2))).alias("p")).select("reaction", "p.*", F.lit(False).alias("circular"))
    made = golden_gate(parts, "reaction", "sequence", "circular", ENZYMES["BsaI"], "part_no")
    return made.select("reaction", F.size("constructs").alias("n_constructs"), F.size("loops").alias("n_loops"), F.md5(F.get("constructs", F.lit(0))).alias("construct"))


def _neighbours(spark, d):
    """Whole sequences beside those of the next id."""
    o = dna(spark, d)
    return o.join(o.select((F.col("id") - 1).alias("id"), F.col("seq").alias("other")), "id")


@query()
def needleman_wunsch(spark, d):
    return _neighbours(spark, d).withColumn("a", K.alignment(F.col("seq"), F.col("other"))).select("id", "a.*")


@query()
def smith_waterman(spark, d):
    return _neighbours(spark, d).withColumn("a", K.alignment(F.col("seq"), F.col("other"), K.nuc_4(), local=True)).select("id", "a.*")


@query()
def mash_distance(spark, d):
    s = sequences(spark, d)
    near = s.join(s.select((F.col("id") - 1).alias("id"), F.col("seq").alias("other")), "id")
    sim = K.mash_similarity(K.mash_sketch(F.col("seq"), 5, 10), K.mash_sketch(F.col("other"), 5, 10))
    return near.select("id", (1 - sim).alias("distance"))


@query()
def de_bruijn_barcodes(spark, d):
    sets = {"plain": P.barcodes(20, 6), "gc": P.barcodes_gc(20, 6, 0.25, 0.75), "banned": P.barcodes(20, 6, ["GGTCTC", "GAAGAC"])}
    return spark.createDataFrame([(k, i, b) for k, v in sets.items() for i, b in enumerate(v)], "kind string, place int, barcode string")


_COUNT = "case when {0} = reverse(translate({0}, 'ACGT', 'TGCA')) then 0 when {0} = {1} then 1000 when hamming({0}, {1}) = 1 then 2 else 0 end"


@query(_DNA + ", o as (select id, j, substr(seq, cast(j as integer), 4) x from s, unnest(range(1, length(seq) - 2, 100)) u(j)), "
       f"t as (select a.id, a.j, a.x, sum({_COUNT.format('a.x', 'b.x')} + " + _COUNT.format("a.x", "reverse(translate(b.x, 'ACGT', 'TGCA'))") + f") total, any_value({_COUNT.format('a.x', 'a.x')}) good from o a join o b using (id) group by a.id, a.j, a.x) select id, round(product(case when total = good then 1.0 else good / total::double end), 9) as value from t group by id")
def set_efficiency(spark, d):
    """Fidelity of every hundredth word of a sequence as overhangs of one reaction, by the rule that stands in for measurements."""
    counts = Y.ideal_fidelity()

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: round(Y.set_efficiency([x[i : i + 4] for i in range(0, len(x) - 3, 100)], counts), 9))

    return dna(spark, d).where(F.length("seq") > 3).select("id", run("seq").alias("value"))


@query()
def next_overhangs(spark, d):
    rows = Y.next_overhangs(["ATAA", "AATG"], Y.ideal_fidelity())
    return spark.createDataFrame([(w, x, w == Y.next_overhang(["ATAA", "AATG"], Y.ideal_fidelity())) for w, x in rows], "overhang string, efficiency double, best boolean")


@query()
def fragment_sequences(spark, d):
    counts = Y.ideal_fidelity()
    cut = dna(spark, d).withColumn("f", Y.fragments(F.col("seq"), 90, 110, counts))
    return cut.select("id", F.size("f.fragments").alias("n_fragments"), F.array_join("f.fragments", "|").alias("fragments"), F.round("f.efficiency", 9).alias("efficiency"), "f.error")


@query(_DNA + "select id, md5(seq) digest, true fits from s")
def fragments_joined(spark, d):
    """Fragments put together again, each without the four letters it shares with the one before, and whether all keep to the largest size."""
    cut = dna(spark, d).withColumn("f", Y.fragments(F.col("seq"), 90, 110, Y.ideal_fidelity())).select("id", "f.*")
    joined = F.array_join(F.transform("fragments", lambda x, i: F.substring(x, F.when(i == 0, 1).otherwise(5), F.length(x))), "")
    return cut.select("id", F.coalesce(F.md5(F.when(F.col("error").isNull(), joined)), F.col("error")).alias("digest"), F.forall("fragments", lambda x: F.length(x) <= 110).alias("fits"))


@query()
def fix_coding_sequences(spark, d):
    rows = C.table_rows(_dna_weights(spark, d))
    finders = Y.usual_finders(["GAAGAC", "GGTCTC", "GCGATG"])
    return coding(spark, d).withColumn("f", Y.fixed_cds(F.col("seq"), rows, finders)).select("id", "f.fixed", F.size("f.changes").alias("n_changes"), "f.error")


@query(_CDS + f"select id, md5(array_to_string(list_transform(range(0, length(seq) // 3), lambda i: {_AA.format(STANDARD)}), '')) protein, length(seq)::integer n from s")
def fixed_proteins(spark, d):
    """What the fixed coding sequences say, which must be what they said before."""
    fixed = fix_coding_sequences(spark, d)
    return fixed.select("id", F.md5(S.translate_dna("fixed", genetic_code(1))).alias("protein"), F.length("fixed").alias("n"))


@query(_CDS + "select id, cast((i - 1) // 3 as integer) codon_start, cast((i + 5) // 3 - 1 as integer) codon_end, site from s, unnest(range(1, length(seq) - 4)) u(i), (values ('GGTCTC'), ('GAGACC'), ('GAAGAC'), ('GTCTTC')) v(site) where substr(seq, cast(i as integer), 6) = site")
def remove_sequence_suggestions(spark, d):
    """Codons that hold sites of two enzymes, on either strand."""
    finders = {x: Y.remove_sequences([x], "site") for x in ("GGTCTC", "GAAGAC")}
    both = {x: (x, K.turned(x)) for x in finders}

    @F.pandas_udf("array<struct<codon_start:int,codon_end:int,site:string>>")
    def run(s: pd.Series) -> pd.Series:
        def of(text):
            found = [(x, g) for x, f in finders.items() for g in f(text)]
            # Which strand a suggestion is of: the finder lists those of the word first.
            many = {x: len(re.findall(x, text)) for x in finders}
            seen = dict.fromkeys(finders, 0)
            out = []
            for x, g in found:
                out.append({"codon_start": g.start, "codon_end": g.end, "site": both[x][seen[x] >= many[x]]})
                seen[x] += 1
            return out

        return s.map(of)

    return coding(spark, d).select("id", F.explode(run("seq")).alias("x")).select("id", "x.*")


@query("select read_row_id id, md5('@' || identifier || coalesce(array_to_string(list_transform(list_sort(map_entries(optionals)), lambda e: ' ' || e.key || '=' || e.value), ''), '') || chr(10) || sequence || chr(10) || '+' || chr(10) || quality) digest from fastq")
def fastq_records(spark, d):
    t = table(spark, d, "fastq")
    return t.select(F.col("read_row_id").alias("id"), F.md5(fastq_text(F.col("identifier"), F.col("optionals"), F.col("sequence"), F.col("quality"))).alias("digest"))


@query(_SEQ + "select id, md5('>' || id || chr(10) || array_to_string(list_transform(range(0, (length(seq) + 79) // 80), lambda i: substr(seq, 80 * i + 1, 80)), chr(10)) || chr(10)) digest from s")
def fasta_records(spark, d):
    return sequences(spark, d).select("id", F.md5(fasta_text(F.col("id").cast("string"), F.col("seq"))).alias("digest"))


@query(PILEUP_LINES + "select line_id, md5(c[1] || chr(9) || c[2]::bigint || chr(9) || c[3] || chr(9) || c[4]::bigint || chr(9) || c[5] || chr(9) || c[6]) digest from valid")
def pileup_records(spark, d):
    """Valid pileup lines written anew."""
    return valid_rows(parse_lines(table(spark, d, "pileup_lines"), "pileup")).select("line_id", F.md5(pileup_text()).alias("digest"))


@query()
def random_sequences(spark, d):
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return t.select("id", S.random_sequence(50, F.col("id")).alias("dna"), S.random_sequence(50, F.col("id"), "ACUG").alias("rna"), S.random_protein(30, F.col("id")).alias("protein"))


@query("""select feature_id, segments[1].seg_start first_start, segments[-1].seg_end last_end, len(segments) n_segments, complement turned, five_prime_partial, three_prime_partial
  from features where gbk_location_string is not null and len(segments) > 0""")
def parse_locations(spark, d):
    """Location strings read anew."""
    f = table(spark, d, "features").where("gbk_location_string is not null and size(segments) > 0").select("feature_id", location(F.col("gbk_location_string")).alias("x"))
    ends = [F.element_at("x.segments", 1)["seg_start"].alias("first_start"), F.element_at("x.segments", -1)["seg_end"].alias("last_end")]
    return f.select("feature_id", *ends, F.size("x.segments").alias("n_segments"), F.col("x.complement").alias("turned"), "x.five_prime_partial", "x.three_prime_partial")
