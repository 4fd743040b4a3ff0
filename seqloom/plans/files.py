"""Queries that write each format to files in the shared folder and read them back, and the SQL that says what the tables hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.genetic_code import STANDARD
from seqloom.functions.letters import letters
from seqloom.operators.codons import codon_dim
from seqloom.operators.features import add_features
from seqloom.operators.rejects import valid_rows
from seqloom.plans.problems import GFF_LINES, PILEUP_LINES
from seqloom.session import own_folder, spread, table
from seqloom.sources import readers as R
from seqloom.sources import writers as W
from seqloom.sources.genbank import REFERENCE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _sorted_map(m: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")


@query("select fasta_id::varchar as \"name\", length(seq)::integer n, md5(seq) digest from (select fasta_id, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) seq from fasta) where seq <> ''")
def fasta_files(spark, d):
    t = table(spark, d, "fasta").select(F.col("fasta_id").cast("string").alias("name"), letters(F.col("sequence")).alias("seq")).where("seq != ''")
    path = own_folder(spark)
    W.write_lines(t.select(W.fasta_text(F.col("name"), F.col("seq"))), path)
    return R.read_fasta(spark, path).select("name", F.length("sequence").alias("n"), F.md5("sequence").alias("digest"))


_READS = "identifier not like '% %' and sequence is not null and sequence <> '' and quality is not null and quality <> ''"


@query(f"""select identifier, md5(sequence) seq, md5(quality) qual, coalesce(array_to_string(list_transform(list_sort(map_entries(optionals)), lambda e: e.key || '=' || e.value), ' '), '') opt, null::varchar as "error"
  from fastq where {_READS}""")
def fastq_files(spark, d):
    t = table(spark, d, "fastq").where(_READS)
    path = own_folder(spark)
    W.write_lines(t.select(W.fastq_text(F.col("identifier"), F.col("optionals"), F.col("sequence"), F.col("quality"))), path)
    return R.read_fastq(spark, path, split_bytes=1 << 20).select("identifier", F.md5("sequence").alias("seq"), F.md5("quality").alias("qual"), _sorted_map(F.col("optionals")).alias("opt"), "error")


@query(PILEUP_LINES + "select c[1] sequence_name, c[2]::bigint as position, c[4]::bigint read_count, md5(c[5]) reads, md5(c[6]) qual from valid")
def pileup_files(spark, d):
    path = own_folder(spark)
    W.write_lines(table(spark, d, "pileup_lines").where("line is not null").select("line"), path)
    rows = valid_rows(R.read_pileup(spark, path))
    return rows.select("sequence_name", "position", "read_count", F.md5(F.array_join("read_results", "")).alias("reads"), F.md5("quality").alias("qual"))


@query(GFF_LINES + "select c[1] seqid, c[3] feature_type, c[4]::bigint - 1 start_pos, c[5]::bigint end_pos, c[7] strand from good")
def gff_files(spark, d):
    """Feature lines and what is amiss among them, read from files."""
    path = own_folder(spark)
    W.write_lines(table(spark, d, "gff_lines").where("line is not null").select("line"), path)
    return R.read_gff(spark, path)["features"].select("seqid", "feature_type", "start_pos", "end_pos", "strand")


@query(GFF_LINES + ", s as (select fasta_id, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) seq from fasta) "
       "select 'feature' part, c[1] || ' ' || (c[4]::bigint - 1) || ' ' || c[5]::bigint as \"text\", count(*) n from good where not regexp_matches(array_to_string(c, ''), '[\\x00-\\x08\\x0b-\\x1f]') group by all "
       "union all select 'sequence', md5(seq), count(*) from s where seq <> '' group by all union all select 'region', fasta_id || ' 1 ' || length(seq), 1 from s where seq <> '' union all select 'version', '3', 1")  # fmt: skip
def gff_whole_files(spark, d):
    """Features, regions and sequences written as one GFF3 text, and read again."""
    lines = own_folder(spark)
    W.write_lines(table(spark, d, "gff_lines").where("line is not null").select("line"), lines)
    seqs = table(spark, d, "fasta").select(F.col("fasta_id").cast("string").alias("name"), letters(F.col("sequence")).alias("sequence")).where("sequence != ''")
    regions = seqs.select("name", F.lit(1).cast("bigint").alias("region_start"), F.length("sequence").cast("bigint").alias("region_end"))
    path = own_folder(spark)
    W.write_gff(R.read_gff(spark, lines)["features"], regions, seqs, path)
    again = R.read_gff(spark, path)
    parts = {
        "feature": again["features"].select(F.concat_ws(" ", "seqid", F.col("start_pos").cast("string"), F.col("end_pos").cast("string")).alias("text")),
        "sequence": again["sequences"].select(F.md5("sequence").alias("text")),
        "region": again["regions"].select(F.concat_ws(" ", "name", F.col("region_start").cast("string"), F.col("region_end").cast("string")).alias("text")),
        "version": again["versions"].select(F.col("version").alias("text")),
    }
    out = None
    for part, rows in parts.items():
        one = rows.groupBy("text").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "text", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""select read_row_id::varchar read_id, 0::bigint read_group, 8192.0::double digitisation, list_sum(list_transform(string_split(quality, ''), lambda c: ascii(c)))::bigint total, length(quality)::integer n, 'whole' end_reason, null::varchar as "error"
  from fastq where quality is not null and quality <> ''""")
def slow5_files(spark, d):
    """Reads whose signal is the quality's character codes."""
    q = table(spark, d, "fastq").where("quality is not null and quality != ''").select(F.col("read_row_id").cast("string").alias("read_id"), "quality")
    signal = F.transform(F.split("quality", ""), lambda c: F.ascii(c).cast("smallint"))
    reads = q.select(
        "read_id", F.lit(0).cast("bigint").alias("read_group"), F.lit(8192.0).alias("digitisation"), F.lit(6.5).alias("offset"), F.lit(1467.6).alias("range"), F.lit(4000.0).alias("sampling_rate"),
        F.length("quality").cast("decimal(20,0)").alias("len_raw_signal"), signal.alias("raw_signal"), F.lit("whole").alias("end_reason"),
    )
    headers = spark.createDataFrame([(0, "0.2.0", {"asic_id": "1"}, {"cut": 0, "whole": 1})], "read_group_id bigint, slow5_version string, attributes map<string,string>, end_reasons map<string,int>")
    path = own_folder(spark)
    W.write_slow5(headers, reads, path)  # a header stands at the head of one file
    _, again = R.read_slow5(spark, path)
    total = F.aggregate("raw_signal", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return again.select("read_id", "read_group", "digitisation", total.alias("total"), F.col("len_raw_signal").cast("int").alias("n"), "end_reason", "error")


@query("""select feature_id::varchar as "name", start_pos, end_pos, len(segments)::integer n_segments, array_to_string(list_transform(case when coalesce(complement, false) then list_reverse(segments) else segments end,
    lambda g: g.seg_start || '-' || g.seg_end || case when coalesce(g.complement, false) <> coalesce(complement, false) then '-' else '+' end), ',') reading from features where len(segments) > 0""")
def native_json_files(spark, d):
    """A document for each feature, its segments as sub-locations, and in what order and on which strand they are read."""
    f = table(spark, d, "features").where(F.size("segments") > 0)
    inner = F.transform("segments", lambda g: F.struct(g["seg_start"].alias("start"), g["seg_end"].alias("end"), g["complement"].alias("complement")))
    where = F.struct(F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "complement", F.col("joined").alias("join"), inner.alias("sub_locations"))
    feature = F.struct(F.col("feature_id").cast("string").alias("name"), F.col("feature_type").alias("type"), where.alias("location"), F.create_map(F.lit("k"), F.lit("v")).alias("tags"))
    doc = F.to_json(F.struct(F.struct(F.lit("m").alias("name")).alias("meta"), F.array(feature).alias("features"), F.lit("").alias("sequence")))
    first = R.native_rows(f.select(doc.alias("value")))
    path = own_folder(spark)
    W.write_lines(W.native_json_text(first, pretty=False), path)
    x = R.read_native_json(spark, path, lines=True).select(F.get("features", F.lit(0)).alias("f"))
    # A place alone is its own innermost one.
    reading = F.array_join(F.transform("f.location.segments", lambda g: F.concat(g["start"].cast("string"), F.lit("-"), g["end"].cast("string"), F.when(g["complement"], "-").otherwise("+"))), ",")
    return x.select("f.name", F.col("f.location.start").alias("start_pos"), F.col("f.location.end").alias("end_pos"), F.size("f.location.segments").alias("n_segments"), reading.alias("reading"))


_DIM = "select substr('TCAG', cast(a as integer), 1) || substr('TCAG', cast(b as integer), 1) || substr('TCAG', cast(c as integer), 1) triplet, substr('" + STANDARD + "', cast(16 * (a - 1) + 4 * (b - 1) + c as integer), 1) letter from range(1, 5) x(a), range(1, 5) y(b), range(1, 5) z(c)"


@query(f"with dim as ({_DIM}) select letter, triplet, 1::bigint weight, triplet in ('TTG', 'CTG', 'ATT', 'ATC', 'ATA', 'ATG', 'GTG') is_start, letter = '*' is_stop from dim")
def codon_json_files(spark, d):
    path = own_folder(spark)
    W.write_lines(W.codon_json(codon_dim(spark, 11)), path)
    return R.read_codon_json(spark, path)


@query("select fasta_id::varchar accession, length(seq)::integer length, md5(seq) digest, date '2009-06-16' created from (select fasta_id, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) seq from fasta) where seq <> ''")
def uniprot_files(spark, d):
    t = table(spark, d, "fasta").select(F.col("fasta_id").cast("string").alias("id"), letters(F.col("sequence")).alias("seq")).where("seq != ''")
    entry = F.concat(F.lit('<entry dataset="x" created="2009-06-16" version="2"><accession>'), "id", F.lit('</accession><name>n</name><sequence length="'), F.length("seq").cast("string"), F.lit('">'), "seq", F.lit("</sequence></entry>"))
    path = own_folder(spark)
    mark = lambda x: spark.createDataFrame([(x,)], "value string").coalesce(1)
    W.write_lines(mark("<uniprot>").union(t.select(entry)).union(mark("</uniprot>")), path, single_file=True)  # one document
    return R.read_uniprot(spark, path).select(F.get("accession", F.lit(0)).alias("accession"), F.col("sequence._length").alias("length"), F.md5("sequence._VALUE").alias("digest"), F.col("_created").alias("created"))


_PLAIN = "regexp_replace(trim({0}), '\\s+', ' ', 'g')"


@query(f"""with refs as (select record_id, count(*) n_refs, md5(string_agg(coalesce(nullif({_PLAIN.format('authors')}, ''), '') || '|' || coalesce(nullif({_PLAIN.format('consortium')}, ''), ''), chr(10) order by ref_no, ref_id)) refs from genbank_refs group by record_id),
  f as (select record_id, count(*) n_features, md5(string_agg(feature_type || ' ' || gbk_location_string || ' ' || len(segments), chr(10) order by feature_idx, feature_id)) features from features where gbk_location_string is not null and len(segments) > 0 and feature_type is not null group by record_id)
  select g.record_id, md5(coalesce(regexp_replace(sequence, '[^A-Za-z]', '', 'g'), '')) digest, coalesce(len(taxonomy), 0) n_taxa, locus.circular circular, coalesce(n_refs, 0) n_refs, refs.refs, coalesce(n_features, 0) n_features, f.features
  from genbank g left join refs using (record_id) left join f using (record_id)""")
def genbank_files(spark, d):
    """Records with their references and features written as flat files and read again."""
    keys = ("authors", "title", "journal", "pub_med", "remark", "bases_range", "consortium")
    refs = table(spark, d, "genbank_refs").groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_no", "ref_id", F.struct(*keys).alias("r")))), lambda x: x["r"]).alias("refs"))
    own = F.struct("feature_idx", "feature_id", F.struct("feature_type", "gbk_location_string", "complement", "joined", "five_prime_partial", "three_prime_partial", "start_pos", "end_pos", "segments").alias("f"))
    f = table(spark, d, "features").where("gbk_location_string is not null and size(segments) > 0 and feature_type is not null").groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["f"].withField("attributes", F.create_map().cast("map<string,string>"))).alias("features"))
    t = spread(table(spark, d, "genbank")).join(refs, "record_id", "left").join(f, "record_id", "left")
    none = F.array().cast(f"array<{REFERENCE}>")
    whole = t.select(
        "locus", "definition", "accession", F.col("record_id").alias("version"), "keywords", F.col("organism").alias("source"), "organism", "taxonomy", F.coalesce("refs", none).alias("refs"), "base_count", "other",
        F.coalesce(F.regexp_replace("sequence", "[^A-Za-z]+", ""), F.lit("")).alias("sequence"), "features", F.lit(None).cast("string").alias("error"),
    )
    path = own_folder(spark)
    W.write_lines(W.genbank_text(whole), path)
    again = R.read_genbank(spark, path)
    plain = lambda c: F.coalesce(F.regexp_replace(F.trim(c), r"\s+", " "), F.lit(""))
    said = F.array_join(F.transform("refs", lambda r: F.concat(plain(r["authors"]), F.lit("|"), plain(r["consortium"]))), "\n")
    lines = F.array_join(F.transform("features", lambda x: F.concat_ws(" ", x["feature_type"], x["gbk_location_string"], F.size(x["segments"]).cast("string"))), "\n")
    return again.select(
        F.col("version").alias("record_id"), F.md5("sequence").alias("digest"), F.size("taxonomy").alias("n_taxa"), F.col("locus.circular").alias("circular"), F.size("refs").cast("bigint").alias("n_refs"), F.when(F.size("refs") > 0, F.md5(said)).alias("refs"),
        F.size("features").cast("bigint").alias("n_features"), F.when(F.size("features") > 0, F.md5(lines)).alias("features"),
    )


@query("select record_id, count(*) + count(*) filter (feature_type = 'CDS') n, max(feature_idx) + count(*) filter (feature_type = 'CDS') as last from features where record_id is not null and feature_idx is not null group by record_id")
def added_features(spark, d):
    """Every coding feature added to its record once more, under the next free index."""
    f = table(spark, d, "features").where("record_id is not null and feature_idx is not null").select("record_id", "feature_idx", "feature_type")
    both = add_features(f, f.where("feature_type = 'CDS'"))
    return both.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.max("feature_idx").cast("bigint").alias("last"))
