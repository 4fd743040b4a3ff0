import re

import pyarrow as pa
import pytest

from seqloom.operators.rejects import parse_gff, parse_lines, parse_pileup, rejects, tokenize_reads, valid_rows


def plain_pileup(line):
    """A character-by-character reading of the format, for comparison."""
    if line is None:
        return False
    line = line[:-1] if line.endswith("\r") else line
    f = line.split("\t")
    if len(f) != 6:
        return False
    name, pos, ref, count, reads, quality = f
    if not re.fullmatch(r"[A-Za-z0-9_.|:\-]+", name) or not re.fullmatch(r"[0-9]+", pos) or int(pos) < 1 or not re.fullmatch("[ACGTNacgtn]", ref) or not re.fullmatch("[0-9]+", count):
        return False
    i = n = 0
    bases = "ACGTNacgtn"
    while i < len(reads):
        if reads[i] in "+-":
            j = i + 1
            while j < len(reads) and reads[j] in "0123456789":
                j += 1
            if n == 0 or j == i + 1:
                return False
            k = int(reads[i + 1 : j])
            if k < 1 or len(reads[j : j + k]) < k or any(c not in bases for c in reads[j : j + k]):
                return False
            i = j + k
            continue
        if reads[i] == "^":
            if i + 1 >= len(reads) or not "!" <= reads[i + 1] <= "~":
                return False
            i += 2
        if i >= len(reads) or reads[i] not in ".,*" + bases:
            return False
        i += 1
        n += 1
        if i < len(reads) and reads[i] == "$":
            i += 1
    return n == int(count) == len(quality) and all("!" <= c <= "~" for c in quality)


def plain_gff(line):
    """True valid, False invalid, None no row."""
    if line is None:
        return False
    line = line[:-1] if line.endswith("\r") else line
    if not line.strip() or line.startswith("#"):
        return None
    f = line.split("\t")
    if len(f) != 9 or not f[0] or not f[2]:
        return False
    if not re.fullmatch("[0-9]+", f[3]) or not re.fullmatch("[0-9]+", f[4]) or not 1 <= int(f[3]) <= int(f[4]):
        return False
    if f[5] != "." and not re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?", f[5]):
        return False
    if f[6] not in ("+", "-", ".", "?") or not (f[7] in ("0", "1", "2") or f[7] == "." and f[2] != "CDS"):
        return False
    if f[8] == ".":
        return True
    if re.search("%(?![0-9A-Fa-f]{2})", f[8]):
        return False
    item = r'[^"=;]*[^"=;\s][^"=;]*=(?:[^";]*|"[^"]*")'
    return re.fullmatch(rf"{item}(?:;{item})*;?", f[8]) is not None


PILEUP = [
    ("s\t1\tA\t2\t.,\tII", True), ("s\t1\tA\t2\t.,\tII\r", True), ("s\t1\tA\t2\t.,\tII\r\r", False), ("s\t0\tA\t2\t.,\tII", False), ("s\t1\tX\t2\t.,\tII", False),
    ("s\t1\tA\t2\t.+2ac,\tII", True), ("s\t1\tA\t2\t.+3ac,\tII", False), ("s\t1\tA\t2\t+1a.,\tII", False), ("s\t1\tA\t2\t.+0,\tII", False), ("s\t1\tA\t1\t.+12ACGTACGTACGT\tI", True),
    ("s\t1\tA\t2\t.+1aa\tII", True), ("s\t1\tA\t1\t^^.$\tI", True), ("s\t1\tA\t1\t^.\tI", False), ("s\t1\tA\t1\t.$$\tI", False), ("s\t1\tA\t1\t.\t ", False), ("s\t1\tA\t0\t\t", True),
    ("", False), (None, False), ('s\t1\tA\t1\t.\t"', True), ("s s\t1\tA\t1\t.\tI", False), ("s\t1\tA\t1\t.\tI\t", False), ("s\t+1\tA\t1\t.\tI", False), ("s\t1\tA\t1\té\tI", False), ("s\t1\tA\t2\t.-1A-2CC,\tII", True),
    ("s\t0000000000000000007\tA\t2\t.,\tII", True), ("s\t9223372036854775807\tA\t1\t.\tI", True), ("s\t123456789012345678901234567890\tA\t1\t.\tI", True), ("s\t00000000000000000000\tA\t1\t.\tI", False),
    ("s\t1\tA\t0000000000000000000001\t.\tI", True), ("s\t1\tA\t99999999999999999999\t.\tI", False), ("s\t1\tA\t1\t.+0000000000000000000002AC\tI", True),
]
GFF = [
    ("s\t.\tgene\t1\t2\t.\t+\t.\tID=a", True), ("s\t.\tCDS\t1\t2\t.\t+\t.\tID=a", False), ("s\t.\tCDS\t1\t2\t.\t+\t0\tID=a;", True), ("s\t.\tgene\t1\t2\t.\t+\t.\tID=a;;b=c", False),
    ('s\t.\tgene\t1\t2\t.\t+\t.\tID="a;b";c=', True), ('s\t.\tgene\t1\t2\t.\t+\t.\tID="a;b', False), ('s\t.\tgene\t1\t2\t.\t+\t.\tID=a"b"', False), ('s\t.\tgene\t1\t2\t.\t+\t.\t"ID"=a', False),
    ("s\t.\tgene\t1\t2\t.\t+\t.\tID=a%2", False), ("s\t.\tgene\t1\t2\t.\t+\t.\tID=a%", False), ("s\t.\tgene\t1\t2\t.\t+\t.\tID=a%2fx", True), ("s\t.\tgene\t1\t2\t.\t+\t.\t", False), ("s\t.\tgene\t1\t2\t.\t+\t.\t;", False),
    ("s\t.\tgene\t1\t2\t.\t+\t.\t.", True), ("s\t.\tgene\t3\t2\t.\t+\t.\t.", False), ("s\t.\tgene\t0\t2\t.\t+\t.\t.", False), ("s\t.\tgene\t1\t2\t-1.5\t+\t3\t.", False), ("s\t.\tgene\t1\t2\t1.2.3\t+\t.\t.", False),
    ("s\t.\tgene\t1\t2\t.\t\t.\t.", False), ("#x", None), ("  \r", None), ("", None), ("\t.\tgene\t1\t2\t.\t+\t.\t.", False), ("s\t.\t\t1\t2\t.\t+\t.\t.", False), ("s\t.\tgene\t1\t2\t.\t+\t.\t =x", False), ("s\t.\tgene\t1\t2\t.\t+\t.\ta=b=c", True),
    ('s\t.\tgene\t1\t2\t.\t+\t.\ta="', False), ('s\t.\tgene\t1\t2\t.\t+\t.\ta=""', True), ("s\t.\tgene\t1\t2\t.\t+\t.\tab", False), (None, False), ("s\t.\tgene\t1\t2\t.\t+\t.\té=ü", True),
    ("s\t.\tgene\t0000000000000000000003\t4\t.\t+\t.\t.", True), ("s\t.\tgene\t5\t0000000000000000000003\t.\t+\t.\t.", False), ("s\t.\tgene\t9223372036854775807\t9223372036854775808\t.\t+\t.\t.", True),
    ("s\t.\tgene\t9223372036854775809\t9223372036854775808\t.\t+\t.\t.", False), ("s\t.\tgene\t9223372036854775808\t7\t.\t+\t.\t.", False), ("s\t.\tgene\t1\t2\t.\t+\t.\ta=1;b=2;a=3;", True), ("s\t.\tgene\t1\t2\t.\t+\t.\ta=1;\r", True),
]


@pytest.mark.parametrize("parse,plain,cases", [(parse_pileup, plain_pileup, PILEUP), (parse_gff, plain_gff, GFF)])
def test_cases(parse, plain, cases):
    lines = [x for x, _ in cases]
    verdicts, skip, rows = parse(pa.array(lines, pa.string()))
    for (line, want), code, out in zip(cases, verdicts.code, skip):
        assert plain(line) is want, line
        assert (None if out else bool(code == 0)) is want, (line, verdicts.reasons[code])
    assert len(rows) == sum(want is True for _, want in cases)
    assert list(parse(pa.array(lines, pa.string()), False)[0].code) == list(verdicts.code)


@pytest.mark.parametrize("fmt,plain", [("pileup", plain_pileup), ("gff", plain_gff)])
def test_tables_against_plain_reading(spark, fmt, plain):
    df = spark.read.parquet(f"/root/testdata/sf0.01/{fmt}_lines.parquet")
    parsed = parse_lines(df, fmt).cache()
    got = {r[0] for r in rejects(parsed).collect()}
    good = {r[0] for r in valid_rows(parsed).collect()}
    rows = df.select("line_id", "line").collect()
    assert got == {r.line_id for r in rows if plain(r.line) is False} and got
    assert good == {r.line_id for r in rows if plain(r.line) is True}
    assert all(r.reason and not r.row for r in parsed.where("reason is not null").collect())


def test_offsets_of_sliced_batches():
    lines = pa.array([x for x, _ in PILEUP], pa.string())
    for at in range(len(lines)):
        assert list(parse_pileup(lines.slice(at))[0].code) == list(parse_pileup(lines)[0].code[at:])
        assert parse_pileup(lines.slice(at))[2].to_pylist() == parse_pileup(lines)[2].to_pylist()[-len(parse_pileup(lines.slice(at))[2]) or len(lines) :]


def test_values_and_odd_tables(spark):
    df = spark.createDataFrame([(1, 's\t.\tgene\t1\t2\t1.5\t+\t.\tID="a;b";n=x=y', 0, 0), (1, None, 1, 1), (None, "#", 2, 2)], "line_id long, line string, reason int, row int")
    got = valid_rows(parse_lines(df, "gff")).collect()
    assert len(got) == 1 and got[0].attributes == {"ID": "a;b", "n": "x=y"} and got[0].score == 1.5 and got[0].phase is None
    assert [(r.line_id, r.reason) for r in rejects(parse_lines(df, "gff")).collect()] == [(1, "no line")]
    assert parse_lines(df.limit(0), "gff").count() == 0 and parse_lines(df.limit(0), "pileup").count() == 0
    long = spark.createDataFrame([(1, "s\t1\tA\t200000\t" + "." * 200000 + "\t" + "I" * 200000)], "line_id long, line string")
    assert valid_rows(parse_lines(long, "pileup")).first().read_count == 200000


def test_reads():
    assert tokenize_reads(b"^I.$+12ACGTACGTACGT,")[0] == [b"^I.$", b"+12ACGTACGTACGT", b","]


def test_numbers_of_any_size(spark):
    lines = ["s\t0000000000000000007\tA\t1\t.\tI", "s\t9223372036854775807\tA\t1\t.\tI", "s\t09223372036854775808\tA\t1\t.\tI"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    got = valid_rows(parse_lines(df, "pileup")).orderBy("line_id").collect()
    assert [(r.position, r.wide) for r in got] == [(7, None), (2**63 - 1, None), (None, {"position": "9223372036854775808"})]
    gff = spark.createDataFrame([(1, "s\t.\tgene\t4\t99999999999999999999\t.\t+\t.\tb=2;a=1;b=3")], "line_id long, line string")
    (r,) = valid_rows(parse_lines(gff, "gff")).collect()
    assert (r.start_pos, r.end_pos, r.wide, r.attributes) == (4, None, {"end_pos": "99999999999999999999"}, {"a": "1", "b": "3"})
    assert rejects(parse_lines(gff, "gff", typed=False)).count() == 0 and "row" not in parse_lines(gff, "gff", typed=False).columns
