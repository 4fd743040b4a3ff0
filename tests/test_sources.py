import gzip
import json

import pytest
from pyspark.sql import functions as F

from seqloom.sources import readers as R
from seqloom.sources import writers as W
from seqloom.sources.genbank import build_record, location_string, parse_location, parse_record
from seqloom.streaming.streams import run_available, stream_fasta, stream_lines


def put(path, text, packed=False):
    with gzip.open(path, "wt") if packed else open(path, "w") as f:
        f.write(text)
    return str(path)


def test_fasta(spark, tmp_path):
    p = put(tmp_path / "a.fasta", ";note\n>one | x\r\nGAT\r\n;inner\nTACA\n\n>two\n>three\nAC\nGT")
    assert [tuple(r) for r in R.read_fasta(spark, p).collect()] == [("one | x", "GATTACA"), ("two", ""), ("three", "ACGT")]
    g = put(tmp_path / "a.fasta.gz", ">z\nAC\n", True)
    assert [tuple(r) for r in R.read_fasta(spark, g).collect()] == [("z", "AC")]
    assert {(r.name, r.error) for r in R.read_fasta(spark, p, max_line=6).collect()} == {("one | x", "line longer than 6"), ("two", None), ("three", None)}
    assert R.read_fasta(spark, put(tmp_path / "e.fasta", "")).count() == 0 and R.read_fasta(spark, p, 1).count() == 1


def test_fasta_grammar():
    assert R.parse_fasta(">h\nGATTACA\nCATGAT")[0] == [] and R.parse_fasta(">h\nGATTACA\nCATGAT\n")[0] == [("h", "GATTACACATGAT")]
    assert R.parse_fasta(">h\nGATTACA\nCATGAT", strict_end=False)[0] == [("h", "GATTACACATGAT")]
    assert R.parse_fasta(">0\nGAT\n>1\nCAC\n", byte_limit=1) == ([("0", "GAT")], 7) and R.parse_fasta(">0\nGAT\n>1\nCAC\n", byte_limit=100)[1] == 14
    with pytest.raises(ValueError):
        R.parse_fasta(">h\nGATTACA\n", max_line=3)


def test_fasta_round_trip(spark, tmp_path):
    rows = [("a", "ACGT" * 40), ("b", "A"), ("c", "G" * 80)]
    df = spark.createDataFrame(rows, "name string, sequence string").repartition(2)
    W.write_lines(df.select(W.fasta_text(F.col("name"), F.col("sequence"))), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in R.read_fasta(spark, str(tmp_path / "out")).collect()) == rows
    text = df.where("name = 'a'").select(W.fasta_text(F.col("name"), F.col("sequence")).alias("t")).first().t
    assert [len(x) for x in text.split("\n")] == [2, 80, 80, 0]


def fastq(n):
    return "".join(f"@r{i} runid=x{i} ch=1\nACGT{'ACGT' * (i % 5)}\n+\n@#$%{'+@#I' * (i % 5)}\n" for i in range(n))


def test_fastq_ranges(spark, tmp_path):
    p = put(tmp_path / "a.fastq", fastq(200))
    for size in (None, 50, 997):
        got = R.read_fastq(spark, p, split_bytes=size).collect()
        assert sorted(r.identifier for r in got) == sorted(f"r{i}" for i in range(200)) and not any(r.error for r in got)
        assert all(len(r.sequence) == len(r.quality) and r.optionals["ch"] == "1" for r in got)
    g = put(tmp_path / "a.fastq.gz", fastq(3), True)
    assert R.read_fastq(spark, g).count() == 3 and R.read_fastq(spark, p, 5).count() == 5
    assert R.read_fastq(spark, put(tmp_path / "e.fastq", "")).count() == 0
    assert R.read_fastq(spark, f"file://{tmp_path}/a.fast*").count() == 203 and R.read_fastq(spark, str(tmp_path)).count() == 203
    (tmp_path / "cut.fastq").write_text("@r1\nAC\n+\nII\n@r2\nAC\n+")
    assert [(r.identifier, r.error) for r in R.read_fastq(spark, str(tmp_path / "cut.fastq")).collect()] == [("r1", None), ("r2", "empty quality")]


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_fastq_blocks(block):
    """Every record once, wherever ranges and blocks end."""
    import io

    text = fastq(60).encode()
    for size in (11, 100, 1000):
        got = []
        for start in range(0, len(text), size):
            f = io.BytesIO(text)
            at = max(0, start - 1)
            f.seek(at)
            for b in R.fastq_batches(f, at, min(len(text), start + size), start == 0, block):
                got += b.column("identifier").to_pylist()
        assert got == [f"r{i}" for i in range(60)]


@pytest.mark.parametrize("text,error", [("r\nA\n+\nI\n", "no '@'"), ("@r\nA\n-\nI\n", "no '+'"), ("@r\n\n+\nI\n", "empty sequence"), ("@r\nA\n+\n\n", "empty quality"), ("@r\nA\n+\n", "empty quality"), ("@r x\nA\n+\nI\n", "optional without '='")])
def test_fastq_faults(text, error):
    lines = (text.split("\n") + [""] * 4)[:4]
    assert R.fastq_row(*lines)[4] == error


def test_fastq_round_trip(spark, tmp_path):
    df = R.read_fastq(spark, put(tmp_path / "a.fastq", fastq(20)))
    W.write_lines(df.select(W.fastq_text(F.col("identifier"), F.col("optionals"), F.col("sequence"), F.col("quality"))), str(tmp_path / "out"))
    again = R.read_fastq(spark, str(tmp_path / "out" / "*.txt"))
    key = lambda d: sorted((r.identifier, tuple(sorted(r.optionals.items())), r.sequence, r.quality) for r in d.collect())
    assert key(df) == key(again)


RECORD = '''LOCUS       TEST01                    24 bp    DNA     circular BCT 22-OCT-2019
DEFINITION  A made up record that goes on
            over two lines.
ACCESSION   TEST01
VERSION     TEST01.1
KEYWORDS    .
SOURCE      Made up
  ORGANISM  Made upus
            Bacteria; Nowhere;
            Something.
REFERENCE   1  (bases 1 to 24)
  AUTHORS   Doe,J. and
            Roe,R.
  TITLE     Title
  JOURNAL   Unpublished
   PUBMED   12345
COMMENT     Free text.
FEATURES             Location/Qualifiers
     source          1..24
                     /organism="Made upus"
     CDS             complement(join(1..3,
                     7..9))
                     /note="first and
                     related = yes"
                     /pseudo
     gene            <5..>10
BASE COUNT       6 a      6 c
ORIGIN
        1 aaccggttaa ccggttaacc ggtt
//
'''


def test_genbank(spark, tmp_path):
    p = put(tmp_path / "a.gb", RECORD + RECORD.replace("TEST01", "TEST02") + "\n")
    df = R.read_genbank(spark, p).cache()
    rows = df.collect()
    assert [r.version for r in rows] == ["TEST01.1", "TEST02.1"] and R.read_genbank(spark, p, 1).count() == 1
    r = rows[0]
    assert r.error is None and r.locus.circular and r.locus.modification_date == "22-OCT-2019" and r.locus.genbank_division == "BCT" and r.locus.sequence_length == "24" and r.locus.molecule_type == "DNA"
    assert r.definition == "A made up record that goes on over two lines." and r.organism == "Made upus" and r.taxonomy == ["Bacteria", "Nowhere", "Something"]
    assert r.refs[0].authors == "Doe,J. and Roe,R." and r.refs[0].pub_med == "12345" and r.refs[0].bases_range == "(bases 1 to 24)" and r.other["COMMENT"] == "Free text."
    assert r.sequence == "aaccggttaaccggttaaccggtt" and [(b.base, b.base_n) for b in r.base_count] == [("a", 6), ("c", 6)]
    assert [f.feature_type for f in r.features] == ["source", "CDS", "gene"] and r.features[1].attributes == {"note": "first andrelated = yes", "pseudo": ""} and r.features[1].complement
    f = R.genbank_features(df)
    assert f.where("record_id = 'TEST02.1'").count() == 3
    again = [parse_record(x.value) for x in W.genbank_text(df).collect()]
    assert [a["sequence"] for a in again] == [r.sequence for r in rows] and again[0]["features"][1]["attributes"] == r.features[1].attributes and again[0]["refs"][0]["authors"] == r.refs[0].authors
    assert again[0]["locus"]["circular"] and again[0]["locus"]["sequence_length"] == "24" and again[0]["taxonomy"] == r.taxonomy
    assert parse_record("nothing") is None and parse_record(RECORD.replace("1..24\n", "one..24\n"))["error"]
    assert build_record({"sequence": None}).endswith("//\n")


@pytest.mark.parametrize("text,segments,whole", [
    ("5..10", [(4, 10, False)], False), ("7", [(6, 7, False)], False), ("7^8", [(7, 7, False)], False), ("complement(5..10)", [(4, 10, False)], True), ("join(1..2,5..6)", [(0, 2, False), (4, 6, False)], False),
    ("complement(join(1..2,5..6))", [(0, 2, False), (4, 6, False)], True), ("join(complement(5..6),1..2)", [(4, 6, True), (0, 2, False)], False), ("join(complement(join(1..2,5..6)),8..9)", [(4, 6, True), (0, 2, True), (7, 9, False)], False), ("order(<1..2,5..>6)", [(0, 2, False), (4, 6, False)], False),
])
def test_locations(text, segments, whole):
    x = parse_location(text)
    assert [(s["seg_start"], s["seg_end"], s["complement"]) for s in x["segments"]] == segments and x["complement"] is whole
    again = parse_location(location_string(x))
    assert again["segments"] == x["segments"] and again["complement"] is whole and again["five_prime_partial"] == x["five_prime_partial"]


@pytest.mark.parametrize("text", ["", "join(1..2", "one-of(1,2)", "J00194.1:100..202", "1..2)", "complement()"])
def test_bad_locations(text):
    with pytest.raises(ValueError):
        parse_location(text)


GFF = "##gff-version 3\n##sequence-region chr1 1 60\nchr1\tx\tgene\t1\t9\t.\t+\t.\tID=a;note=b\nchr1\t.\tCDS\t4\t9\t1.5\t-\t0\tID=c\n##FASTA\n>chr1\nACGT\nACGT\n>chr2\nGG\n"


def test_gff(spark, tmp_path):
    got = R.read_gff(spark, put(tmp_path / "a.gff", GFF))
    rows = got["features"].orderBy("start_pos").collect()
    assert [(r.seqid, r.start_pos, r.end_pos, r.attributes) for r in rows] == [("chr1", 0, 9, {"ID": "a", "note": "b"}), ("chr1", 3, 9, {"ID": "c"})]
    assert [tuple(r) for r in got["regions"].drop("file_name").collect()] == [("chr1", 1, 60)]
    assert sorted(tuple(r) for r in got["sequences"].collect()) == [("chr1", "ACGTACGT"), ("chr2", "GG")]
    assert sorted(r[0] for r in got["features"].select(W.gff_text()).collect()) == sorted(x for x in GFF.split("\n") if "\t" in x and "." != x[0])
    assert got["rejects"].count() == 0 and got["versions"].first().version == "3"
    W.write_gff(got["features"], got["regions"], got["sequences"], str(tmp_path / "out"))
    text = "".join(r.value + "\n" for r in spark.read.text(str(tmp_path / "out")).collect())
    assert text.startswith("##gff-version 3\n##sequence-region chr1 1 60\nchr1\t") and "###\n##FASTA\n>chr1\nACGTACGT\n>chr2\nGG\n" in text
    again = R.read_gff(spark, str(tmp_path / "out"))
    key = lambda d: sorted((r.seqid, r.start_pos, r.end_pos, r.phase, tuple(sorted(r.attributes.items()))) for r in d["features"].collect())
    assert key(again) == key(got)
    bad = R.read_gff(spark, put(tmp_path / "b.gff", GFF.replace("\t4\t9", "\t4\tx") + "chrX\t1\n"))
    assert {(r.reason, r.line[:4]) for r in bad["rejects"].collect()} == {("end not an integer", "chr1"), ("not 9 columns", "chrX")} and bad["features"].count() == 1


def test_pileup(spark, tmp_path):
    text = "s\t1\tA\t2\t.+2ac,$\tII\ns\tx\tA\t1\t.\tI\n"
    from seqloom.operators.rejects import rejects, valid_rows

    parsed = R.read_pileup(spark, put(tmp_path / "a.pileup", text))
    assert [r[0] for r in valid_rows(parsed).select(W.pileup_text()).collect()] == [text.split("\n")[0]]
    assert [r.reason for r in rejects(parsed).collect()] == ["position not an integer from 1"]


SLOW5 = "#slow5_version\t0.2.0\n#num_read_groups\t2\n@asic_id\t420\t421\n@flow\t.\tF2\n" + "#char*\tuint32_t\tdouble\tdouble\tdouble\tdouble\tuint64_t\tint16_t*\tenum{unknown,partial}\n" + "#read_id\tread_group\tdigitisation\toffset\trange\tsampling_rate\tlen_raw_signal\traw_signal\tend_reason\nr0\t0\t8192\t6\t1467.6\t4000\t3\t430,472,-1\t1\nr1\t1\tx\t6\t1467.6\t4000\t3\t430,99999\t.\n"


def test_slow5(spark, tmp_path):
    headers, reads = R.read_slow5(spark, put(tmp_path / "a.slow5", SLOW5))
    h = sorted(headers.drop("file_name").collect())
    reads = reads.drop("file_name")
    assert len(h) == 2 and h[0].attributes["asic_id"] == "420" and h[1].attributes == {"asic_id": "421", "flow": "F2"} and h[0].end_reasons == {"unknown": 0, "partial": 1}
    a, b = reads.orderBy("read_id").collect()
    assert a.raw_signal == [430, 472, -1] and a.end_reason == "partial" and a.error is None and b.error == "bad digitisation" and b.digitisation is None
    head, lines = W.slow5_text(headers, reads.where("error is null"))
    text = "\n".join([*head, *(r.value for r in lines.collect())]) + "\n"
    again = R.read_slow5(spark, put(tmp_path / "b.slow5", text))
    assert sorted(again[0].drop("file_name").collect()) == h and [tuple(x) for x in again[1].drop("file_name").collect()] == [tuple(a)]
    # Two files, each with columns of its own; and written whole.
    put(tmp_path / "two" / "x.slow5", SLOW5) if (tmp_path / "two").mkdir() is None else None
    put(tmp_path / "two" / "y.slow5", "#slow5_version\t1.0.0\n#num_read_groups\t1\n@asic_id\t7\n#char*\tdouble\tuint32_t\n#read_id\toffset\tread_group\nq\t2.5\t0\nbad\t1\n")
    heads, rows = R.read_slow5(spark, str(tmp_path / "two"))
    assert sorted((r.slow5_version, r.read_group_id) for r in heads.collect()) == [("0.2.0", 0), ("0.2.0", 1), ("1.0.0", 0)]
    assert {(r.read_id, r.offset, r.read_group, r.error) for r in rows.collect()} == {("r0", 6.0, 0, None), ("r1", 6.0, 1, "bad digitisation"), ("q", 2.5, 0, None), ("bad", 1.0, None, "wrong number of columns")}
    W.write_slow5(headers, reads.where("error is null"), str(tmp_path / "out"))
    assert [tuple(x) for x in R.read_slow5(spark, str(tmp_path / "out"))[1].drop("file_name").collect()] == [tuple(a)]


REBASE = """
REBASE version 104                                              type2.104

 REBASE codes for commercial sources of enzymes

                K        Takara Bio Inc. (6/18)
                N        New England Biolabs (3/21)

<1>AaaI
<2>XmaIII,BseX3I
<3>C^GGCCG
<4>
<5>Acetobacter aceti
<6>M. Fukaya
<7>
<8>Tagami, H., Unpublished.
More text.

<1>AarI
<2>
<3>CACCTGC(4/8)
<4>
<5>Arthrobacter
<6>A. Janulaitis
<7>KN
<8>Ref.
"""


def test_rebase(spark, tmp_path):
    rows = {r.name: r for r in R.read_rebase(spark, put(tmp_path / "rebase.txt", REBASE)).collect()}
    assert set(rows) == {"AaaI", "AarI"} and rows["AarI"].recognition_sequence == "CACCTGC(4/8)" and rows["AarI"].commercial_availability == ["Takara Bio Inc.", "New England Biolabs"]
    assert rows["AaaI"].isoschizomers == ["XmaIII", "BseX3I"] and rows["AaaI"].commercial_availability == [] and rows["AaaI"].references == "Tagami, H., Unpublished. More text."


def test_uniprot_and_json(spark, tmp_path):
    xml = '<uniprot><entry dataset="Swiss-Prot" created="2009-06-16" version="3"><accession>O55723</accession><accession>P1</accession><name>X</name><sequence length="4" mass="1">MGCK</sequence></entry></uniprot>'
    r = R.read_uniprot(spark, put(tmp_path / "u.xml.gz", xml, True)).first()
    assert r.accession == ["O55723", "P1"] and r.sequence._VALUE == "MGCK" and r._dataset == "Swiss-Prot"
    doc = '{"meta": {"name": "n"}, "features": [{"name": "f", "type": "CDS", "location": {"start": 0, "end": 3}, "tags": {"a": "b"}}], "sequence": "CATCAT"}'
    assert r._created.isoformat() == "2009-06-16" and r._version == 3 and r.sequence._length == 4 and R.read_uniprot(spark, str(tmp_path / "u.xml.gz"), typed=False).first().accession == ["O55723", "P1"]
    df = R.read_native_json(spark, put(tmp_path / "p.json", doc))
    assert df.first().sequence == "CATCAT" and df.first().features[0].tags == {"a": "b"} and df.first().meta.name == "n"
    deep = {"start": 0, "end": 9, "complement": True, "sub_locations": [{"start": 0, "end": 2}, {"start": 3, "end": 9, "complement": True, "sub_locations": [{"start": 3, "end": 4, "five_prime_partial": True}, {"start": 6, "end": 9}]}]}
    own = {"meta": {"name": "n", "odd": [1]}, "features": [{"name": "f", "location": deep, "tags": {}}], "sequence": "ACGTACGTAC"}
    rows = R.native_rows(spark.createDataFrame([(json.dumps(own),), ("[1]",), ("{",), (None,)], "value string")).cache()
    first = rows.where("error is null").first()
    assert [(g.path, g.start, g.end, g.complement) for g in first.features[0].location.segments] == [([1, 0], 3, 4, False), ([1, 1], 6, 9, False), ([0], 0, 2, True)]
    assert rows.where("error is not null").count() == 2 and json.loads(W.native_json_text(rows.where("error is null"), False).first().value) == {**own, "meta": {"name": "n", "odd": "[1]"}}
    assert spark.range(1).select(R.int_list(F.lit(" 1 2\n3 x"))).first()[0] == [1, 2, 3, None]


def test_codon_json(spark, tmp_path):
    from seqloom.operators.codons import codon_dim

    dim = codon_dim(spark, 11)
    text = W.codon_json(dim).first().value
    again = R.read_codon_json(spark, put(tmp_path / "c.json", text))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, dim.collect()))
    m = R.read_matrix(spark, put(tmp_path / "m.txt", "# x\n   A  C\nA  5 -4\nC -4  5\n"))
    assert sorted(map(tuple, m.collect())) == [("A", "A", 5), ("A", "C", -4), ("C", "A", -4), ("C", "C", 5)]
    assert W.enzyme_map_json(spark.createDataFrame([("BsaI", "GGTCTC"), ("BbsI", "GAAGAC"), (None, "A")], "name string, site string")).first().value == '{"BbsI":{"name":"BbsI","site":"GAAGAC"},"BsaI":{"name":"BsaI","site":"GGTCTC"}}'
    assert '"name":"BsaI"' in W.enzyme_json(spark.createDataFrame([("BsaI", "GGTCTC")], "name string, site string")).first().value


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.fasta", ">a\nAC\n>b\nGT\n")
    seen = []
    for _ in range(2):
        run_available(stream_fasta(spark, str(tmp_path / "in")), lambda df, i: seen.extend(map(tuple, df.collect())), str(tmp_path / "check")).awaitTermination(60)
        put(tmp_path / "in" / "b.fasta", ">c\nG\n")
    assert sorted(seen) == [("a", "AC"), ("b", "GT"), ("c", "G")]
    (tmp_path / "gff").mkdir()
    put(tmp_path / "gff" / "a.gff", GFF.split("##FASTA")[0])
    got = []
    run_available(stream_lines(spark, str(tmp_path / "gff"), "gff"), lambda df, i: got.extend(df.collect()), str(tmp_path / "check2")).awaitTermination(60)
    assert len(got) == 2 and all(r.reason is None for r in got)
