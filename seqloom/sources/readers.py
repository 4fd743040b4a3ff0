"""Readers of sequence formats. Each returns a DataFrame; files may be compressed, and paths may be folders or patterns.

Records are split by Spark's text source wherever the format has a mark between them, so large files are read in parallel;
a record's own grammar is then a projection or an Arrow kernel over single records.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seqloom.operators.rejects import parse_lines, valid_rows
from seqloom.sources.genbank import RECORD_FIELDS, RECORD_SCHEMA, parse_record


def _fasta_columns(chunks: DataFrame) -> DataFrame:
    # What stands before a file's first '>' is no record: blank lines and comments.
    body = F.regexp_replace(F.col("value"), r"\A\s*>", "")
    lines = F.split(body, "\n", -1)
    kept = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~x.startswith(";"))
    return chunks.where(F.col("value").rlike(r"(?m)^[ \t]*[^; \t\r\n]")).select(F.regexp_replace(F.get(lines, F.lit(0)), r"\s+$", "").alias("name"), F.regexp_replace(F.array_join(kept, ""), r"\r", "").alias("sequence"))


def read_fasta(spark: SparkSession, path: str, max_records: int | None = None, max_line: int | None = None) -> DataFrame:
    """name, sequence. Lines that start with ';' and blank lines are left out; a last record without a line end is kept.

    max_line: adds ``error``, set for records with a longer line. Nothing but JVM expressions; a file splits at the '>' of its records.
    """
    chunks = spark.read.option("lineSep", "\n>").text(path)
    out = _fasta_columns(chunks)
    if max_line is not None:
        long = F.exists(F.split(F.regexp_replace("value", r"\A\s*>", ""), "\n", -1), lambda x: F.length(x) > max_line)
        out = _fasta_columns(chunks.where(~long)).withColumn("error", F.lit(None).cast("string")).unionByName(_fasta_columns(chunks.where(long)).withColumn("error", F.lit(f"line longer than {max_line}")))
    return out if max_records is None else out.limit(max_records)


def parse_fasta(text: str, strict_end: bool = True, max_line: int | None = None, byte_limit: int | None = None) -> tuple[list[tuple[str, str]], int]:
    """Records of a text, and the bytes that were read. By the strict grammar a record whose last line has no end is dropped.

    byte_limit: no record is begun once so many bytes are read. A line longer than max_line raises.
    """
    out: list[tuple[str, str]] = []
    name, seq, used = None, [], 0
    for line in text.splitlines(keepends=True):
        if line.startswith(">") and name is not None:
            out.append((name, "".join(seq)))
            name, seq = None, []
            if byte_limit is not None and used >= byte_limit:
                return out, used
        used += len(line.encode())
        bare = line.rstrip("\n")
        if max_line is not None and len(bare) > max_line:
            raise ValueError(f"line longer than {max_line}")
        if line.startswith(">"):
            name = bare[1:]
        elif bare and not bare.startswith(";"):
            seq.append(bare)
            if strict_end and not line.endswith("\n"):
                name = None
    return out + ([(name, "".join(seq))] if name is not None and (seq or not strict_end) else []), used


class _Range(InputPartition):
    def __init__(self, uri: str, start: int, end: int):
        self.uri, self.start, self.end = uri, start, end


class _FastqReader(DataSourceReader):
    """Files of any file system that Arrow can open by a URI (local, HDFS, S3, GCS and others), read in ranges of bytes, in Arrow batches."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Range]:
        import fnmatch
        import os

        from pyarrow import fs as afs

        size = int(self.options.get("splitbytes", 64 << 20))
        given = self.options["path"]
        uri = given if re.match(r"[a-z0-9+]+://", given) else "file://" + os.path.abspath(given.removeprefix("file:"))
        # A pattern in the last part of the path is matched among the folder's files.
        folder, _, last = uri.rpartition("/")
        pattern = last if any(c in last for c in "*?[") else None
        system, path = afs.FileSystem.from_uri(folder if pattern else uri)
        info = system.get_file_info(path)
        files = [info] if info.type == afs.FileType.File else system.get_file_info(afs.FileSelector(path, allow_not_found=True))
        scheme = uri.split("://")[0] + "://"
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.type != afs.FileType.File or f.base_name[:1] in "._" or pattern and not fnmatch.fnmatch(f.base_name, pattern):
                continue
            where = scheme + (f.path if f.path.startswith("/") or scheme != "file://" else "/" + f.path)
            out += [_Range(where, 0, -1)] if f.base_name.endswith(".gz") else [_Range(where, a, min(f.size, a + size)) for a in range(0, max(f.size, 1), size)]
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as afs

        system, path = afs.FileSystem.from_uri(part.uri)
        if part.end < 0:
            with system.open_input_stream(path, compression="gzip") as f:
                yield from fastq_batches(f, 0, -1, True)
        else:
            with system.open_input_file(path) as f:
                f.seek(max(0, part.start - 1))
                yield from fastq_batches(f, max(0, part.start - 1), part.end, part.start == 0)


def fastq_batches(f, at: int, end: int, first: bool, block: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Records of four lines that begin before ``end`` (-1: all), from a file that stands at ``at``; the last is read beyond it.

    Not ``first``: the range begins amid a record. A record begins at a line with '@' whose second next begins with '+': a quality line may
    begin with '@' too, but two lines on stands a sequence. Lines are split by Arrow, columns are slices of the lines.
    """
    rest, synced, done = b"", first, False
    skip_line = not first
    while not done:
        data = f.read(block)
        done = not data
        text = rest + data
        if skip_line:  # the line in which the range begins belongs to the one before
            cut = text.find(b"\n")
            if cut < 0 and not done:
                rest = text
                continue
            at, text, skip_line = at + cut + 1, text[cut + 1 :] if cut >= 0 else b"", False
        lines = text.split(b"\n")
        tail = lines.pop()
        if done and tail:
            lines.append(tail)
            tail = b""
        if not synced:
            if len(lines) < 8 and not done:
                rest = text
                continue
            start = next((i for i in range(min(8, len(lines) - 2)) if lines[i][:1] == b"@" and lines[i + 2][:1] == b"+"), None)
            if start is None:
                return
            at += sum(len(x) + 1 for x in lines[:start])
            lines, synced = lines[start:], True
        whole = len(lines) - len(lines) % 4
        if done and len(lines) > whole:
            lines += [b""] * (whole + 4 - len(lines))
            whole += 4
        if end >= 0 and whole:
            sizes = np.cumsum([0] + [len(x) + 1 for x in lines[:whole]])[:-1:4]
            kept = int(np.searchsorted(sizes, end - at))
            if kept * 4 < whole:
                lines, whole, done, tail = lines[: kept * 4], kept * 4, True, b""
        if whole:
            yield _fastq_batch([lines[k:whole:4] for k in range(4)])
        at += sum(len(x) + 1 for x in lines[:whole])
        rest = b"\n".join([*lines[whole:], tail])


_FASTQ_NAMES = ["identifier", "optionals", "sequence", "quality", "error"]


def _fastq_batch(columns: list[list[bytes]]) -> pa.RecordBatch:
    rows = [fastq_row(*(x.rstrip(b"\r").decode("utf-8", "replace") for x in r)) for r in zip(*columns)]
    kinds = [pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.string()]
    cols = list(zip(*rows))
    cols[1] = [list(x.items()) for x in cols[1]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_FASTQ_NAMES)


def fastq_row(head: str, seq: str, plus: str, quality: str) -> tuple:
    """identifier, optionals, sequence, quality, error."""
    error = "no '@'" if not head.startswith("@") else "no '+'" if not plus.startswith("+") else "empty sequence" if not seq else "empty quality" if not quality else None
    words = head[1:].split(" ")
    optional = dict(w.split("=", 1) for w in words[1:] if "=" in w)
    if error is None and any(w and "=" not in w for w in words[1:]):
        error = "optional without '='"
    return words[0], optional, seq, quality, error


class FastqSource(DataSource):
    """``spark.read.format("fastq").load(path)``: strict records of four lines; files are read in ranges of ``splitBytes``.

    path: a file, a folder, or a pattern of files in one, on any file system that Arrow knows by its URI.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "identifier string, optionals map<string,string>, sequence string, quality string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _FastqReader({k.lower(): v for k, v in dict(self.options).items()})


def read_fastq(spark: SparkSession, path: str, max_records: int | None = None, split_bytes: int | None = None) -> DataFrame:
    """identifier, optionals, sequence, quality, error (null for sound records)."""
    spark.dataSource.register(FastqSource)
    r = spark.read.format("fastq")
    out = (r.option("splitBytes", split_bytes) if split_bytes else r).load(path)
    return out if max_records is None else out.limit(max_records)


def read_records(chunks: DataFrame) -> DataFrame:
    """Rows of GenBank records, one text (``value``) each; texts without a record give none."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for t in f["value"] if t and (r := parse_record(t)) is not None]
            yield pd.DataFrame([[r.get(n) for n in RECORD_FIELDS] for r in rows], columns=RECORD_FIELDS)

    return chunks.select("value").mapInPandas(kernel, RECORD_SCHEMA)


def read_genbank(spark: SparkSession, path: str, max_records: int | None = None) -> DataFrame:
    """A row for each record, meta data, sequence and features (array), with an error where something didn't parse."""
    out = read_records(spark.read.option("lineSep", "\n//").text(path).where(F.col("value").contains("LOCUS")))
    return out if max_records is None else out.limit(max_records)


def genbank_features(records: DataFrame, key: str = "version") -> DataFrame:
    """A row for each feature, linked to its record by ``record_id``."""
    return records.select(F.col(key).alias("record_id"), F.posexplode("features").alias("feature_idx", "f")).select("record_id", "feature_idx", "f.*")


def read_gff(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """features (0-based starts), rejects (reason, line), regions (name, region_start, region_end), versions and sequences (FASTA part, name and sequence).

    All but the sequences have ``file_name``. What follows ##FASTA is no feature line and no reject, and the same holds for comments and blank lines.
    """
    at_file = F.col("_metadata.file_path").alias("file_name")
    lines = spark.read.text(path).select(at_file, F.col("value").alias("line"))
    # A file's part before its sequences, in one go where files are whole: sequence lines have no tab.
    parsed = parse_lines(lines.where(~F.col("line").rlike(r"\A(?:#|>|[A-Za-z*-]*\s*\z)")), "gff", "file_name")
    words = F.split(F.regexp_replace(F.trim("line"), r"\s+", " "), " ")
    at = lines.where(F.col("line").startswith("##sequence-region"))
    tail = spark.read.option("lineSep", "\n>").text(path).select("value").where(~F.col("value").startswith("##gff") & ~F.col("value").contains("\t"))
    return {
        "features": valid_rows(parsed).withColumn("start_pos", F.col("start_pos") - 1),
        "rejects": parsed.where("reason is not null").select("file_name", "reason", "line"),
        "regions": at.select("file_name", F.get(words, F.lit(1)).alias("name"), F.get(words, F.lit(2)).try_cast("bigint").alias("region_start"), F.get(words, F.lit(3)).try_cast("bigint").alias("region_end")),
        "versions": lines.where(F.col("line").startswith("##gff-version")).select("file_name", F.get(words, F.lit(1)).alias("version")),
        "sequences": _fasta_columns(tail),
    }


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    """The parse of every line, by ``file_name``: see seqloom.operators.rejects for valid rows and rejects."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_name"), F.col("value").alias("line")).where("line != ''")
    return parse_lines(lines, "pileup", "file_name")


# Columns of a slow5 read that every file has, and those it may have, with their types.
SLOW5_TYPES = {
    "read_id": "string", "read_group": "bigint", "digitisation": "double", "offset": "double", "range": "double", "sampling_rate": "double",
    "len_raw_signal": "decimal(20,0)", "raw_signal": "array<smallint>", "channel_number": "string", "median_before": "double", "read_number": "int",
    "start_mux": "smallint", "start_time": "decimal(20,0)", "end_reason": "string",
}


def read_slow5(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Headers (read_group_id, slow5_version, attributes, end_reasons) and reads, both with ``file_name``. Each file's own column line names its columns.

    A value that doesn't fit its type, or a column that is not known, leaves ``error`` in its row; '.' stands for no value.
    Headers, a few dozen lines a file, are gathered by file and joined to the reads; the driver sees none.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_name"), "value")
    is_head = F.substring("value", 1, 1).isin("#", "@")
    head = lines.where(is_head).groupBy("file_name").agg(F.collect_list("value").alias("h"))
    rows = F.transform("h", lambda x: F.split(F.substring(x, 2, 1 << 30), "\t", -1))
    named = lambda key: F.try_element_at(F.filter("rows", lambda r: F.get(r, F.lit(0)) == key), F.lit(1))
    types = F.try_element_at(F.filter("rows", lambda r: F.get(r, F.lit(0)).startswith("char*") & (F.size(r) > 1)), F.lit(1))
    enum = F.regexp_extract(F.array_join(F.coalesce("types", F.array().cast("array<string>")), " "), r"enum\{([^}]*)\}", 1)
    usual = F.array(*map(F.lit, SLOW5_TYPES))
    head = head.select("file_name", "h", rows.alias("rows")).withColumn("types", types).select(
        "file_name", F.coalesce(F.get(named("slow5_version"), F.lit(1)), F.lit("")).alias("slow5_version"),
        F.coalesce(F.get(named("num_read_groups"), F.lit(1)).try_cast("int"), F.lit(1)).alias("groups"),
        F.coalesce(named("read_id"), usual).alias("columns"), F.filter(F.split(enum, ","), lambda x: x != "").alias("reasons"),
        F.transform(F.filter("h", lambda x: x.startswith("@")), lambda x: F.split(F.substring(x, 2, 1 << 30), "\t", -1)).alias("own"),
    )
    own = F.filter("own", lambda r: F.get(r, F.col("read_group_id").cast("int") + 1).isNotNull())
    headers = head.where("groups > 0").withColumn("read_group_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups").cast("bigint") - 1))).select(
        "file_name", "read_group_id", "slow5_version", F.map_from_entries(F.transform(own, lambda r: F.struct(F.get(r, F.lit(0)), F.get(r, F.col("read_group_id").cast("int") + 1)))).alias("attributes"),
        F.map_from_entries(F.transform("reasons", lambda r, i: F.struct(r, i))).alias("end_reasons"),
    )
    read = lines.where(~is_head & (F.col("value") != "")).join(head.select("file_name", "columns", "reasons"), "file_name", "left").withColumn("columns", F.coalesce("columns", usual))
    read = read.withColumn("cells", F.split("value", "\t", -1))
    out, bad = [], [F.when(F.size("cells") != F.size("columns"), F.lit("wrong number of columns"))]
    bad.append(F.when(F.exists("columns", lambda c: ~c.isin(*SLOW5_TYPES)), F.concat(F.lit("unknown column "), F.try_element_at(F.filter("columns", lambda c: ~c.isin(*SLOW5_TYPES)), F.lit(1)))))
    for c, kind in SLOW5_TYPES.items():
        place = F.array_position("columns", c)
        cell = F.when(place > 0, F.nullif(F.get("cells", (place - 1).cast("int")), F.lit(".")))
        if c == "raw_signal":
            value: Column = F.transform(F.split(cell, ","), lambda x: x.try_cast("smallint"))
            wrong = F.exists(value, lambda x: x.isNull())
        elif c == "end_reason":
            value = F.when(F.size("reasons") > 0, F.get("reasons", cell.try_cast("int"))).otherwise(cell)
            wrong = cell.isNotNull() & value.isNull()
        else:
            value = cell.try_cast(kind)
            wrong = cell.isNotNull() & value.isNull()
        out.append(value.alias(c))
        bad.append(F.when(wrong, F.lit(f"bad {c}")))
    return headers, read.select("file_name", *out, F.coalesce(*bad).alias("error"))


def read_rebase(spark: SparkSession, path: str) -> DataFrame:
    """Enzymes of a REBASE list in numbered fields, with the suppliers' names in place of their letters. The last enzyme counts too."""
    chunks = spark.read.option("lineSep", "\n<1>").text(path)
    field = lambda n: F.trim(F.regexp_extract("value", rf"\n<{n}>([^\n]*)", 1))
    dim = chunks.where(F.col("value").contains("REBASE")).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^[ \t]+[A-Z][ \t]{2,}[^\n]+$"), F.lit(0))).alias("l"))
    dim = dim.select(F.substring(F.trim("l"), 1, 1).alias("code"), F.regexp_replace(F.trim(F.substring(F.trim("l"), 2, 1000)), r"\s*\(\d+/\d+\)$", "").alias("supplier"))
    known = F.broadcast(dim.groupBy().agg(F.map_from_entries(F.collect_set(F.struct("code", "supplier"))).alias("suppliers")))  # one row: at most 26 letters
    rows = chunks.where(F.col("value").contains("\n<2>") & ~F.col("value").contains("REBASE version")).crossJoin(known)
    letters = F.filter(F.split(field(7), ""), lambda c: c != "")
    return rows.select(
        F.trim(F.regexp_replace(F.element_at(F.split("value", "\n"), 1), "^<1>", "")).alias("name"),
        F.filter(F.split(field(2), ","), lambda x: x != "").alias("isoschizomers"), field(3).alias("recognition_sequence"), field(4).alias("methylation_site"),
        field(5).alias("microorganism"), field(6).alias("source"), F.transform(letters, lambda c: F.coalesce(F.col("suppliers")[c], c)).alias("commercial_availability"),
        F.trim(F.regexp_replace(F.regexp_extract("value", r"(?s)\n<8>(.*)", 1), r"\s*\n\s*", " ")).alias("references"),
    )


_EVIDENCED = "struct<_VALUE:string,_evidence:string>"
_NAMES = f"array<struct<fullName:{_EVIDENCED},shortName:array<{_EVIDENCED}>,ecNumber:array<{_EVIDENCED}>>>"
_DB_REFERENCE = "array<struct<_type:string,_id:string,_evidence:string,molecule:struct<_id:string,_VALUE:string>,property:array<struct<_type:string,_value:string>>>>"
#: The parts of a UniProt entry with their types; lists of numbers stay text (see int_list), dates and counts are typed.
UNIPROT = (
    f"_dataset string, _created date, _modified date, _version int, accession array<string>, name array<string>, protein struct<recommendedName:{_NAMES[6:-1]},alternativeName:{_NAMES},submittedName:{_NAMES}>, "
    f"gene array<struct<name:array<struct<_VALUE:string,_type:string>>>>, organism struct<name:array<struct<_VALUE:string,_type:string>>,dbReference:{_DB_REFERENCE},lineage:struct<taxon:array<string>>>, "
    f"organismHost array<struct<name:array<struct<_VALUE:string,_type:string>>,dbReference:{_DB_REFERENCE}>>, "
    f"reference array<struct<_key:string,citation:struct<_type:string,_date:string,_name:string,_volume:string,_first:string,_last:string,title:string,authorList:struct<person:array<struct<_name:string>>,consortium:array<struct<_name:string>>>,dbReference:{_DB_REFERENCE}>,scope:array<string>>>, "
    f"comment array<struct<_type:string,text:array<{_EVIDENCED}>>>, dbReference {_DB_REFERENCE}, proteinExistence struct<_type:string>, keyword array<struct<_id:string,_VALUE:string>>, "
    "feature array<struct<_type:string,_id:string,_description:string,location:struct<begin:struct<_position:int,_status:string>,end:struct<_position:int,_status:string>,position:struct<_position:int>>>>, "
    "evidence array<struct<_key:int,_type:string>>, sequence struct<_VALUE:string,_length:int,_mass:int,_checksum:string,_modified:date,_version:int,_precursor:boolean,_fragment:string>, _corrupt_record string"
)


def read_uniprot(spark: SparkSession, path: str, typed: bool = True) -> DataFrame:
    """A row for each entry of UniProt XML, in the types of UNIPROT; what doesn't fit is in ``_corrupt_record``. Not typed: all there is, as inferred."""
    r = spark.read.format("xml").option("rowTag", "entry").option("mode", "PERMISSIVE").option("dateFormat", "yyyy-MM-dd")
    return (r.schema(UNIPROT) if typed else r).load(path)


def int_list(text: Column) -> Column:
    """Whole numbers of a text separated by blanks."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), lambda x: x.try_cast("int"))


_SEGMENTS = "array<struct<path:array<int>,start:bigint,end:bigint,complement:boolean>>"
_LOCATION = f"struct<start:bigint,end:bigint,complement:boolean,join:boolean,five_prime_partial:boolean,three_prime_partial:boolean,sub_locations:string,segments:{_SEGMENTS}>"
#: A record of native JSON. sub_locations is their own JSON, to any depth; segments are the innermost ones in the order in which they are read, each with its strand.
NATIVE_JSON = (
    "meta struct<name:string,hash:string,description:string,url:string,created_by:string,created_with:string,created_on:string,schema:string,other:map<string,string>>, "
    f"features array<struct<name:string,hash:string,type:string,description:string,location:{_LOCATION},tags:map<string,string>,sequence:string>>, sequence string, error string"
)
_META = ("name", "hash", "description", "url", "created_by", "created_with", "created_on", "schema")


def json_segments(location: dict) -> list[dict]:
    """The innermost locations in reading order: turning a location turns those within and their order."""
    out: list[dict] = []
    stack = [(location, (), False)]
    while stack:
        x, path, turned = stack.pop()
        here = turned != bool(x.get("complement"))
        inner = [s for s in x.get("sub_locations") or [] if isinstance(s, dict)]
        if not inner:
            out.append({"path": list(path), "start": x.get("start"), "end": x.get("end"), "complement": here})
        # The last pushed is read first.
        stack += [(s, (*path, i), here) for i, s in (list(enumerate(inner)) if here else list(enumerate(inner))[::-1])]
    return out


def native_record(text: str) -> dict:
    """A document as a row of NATIVE_JSON."""
    try:
        doc = json.loads(text)
        if not isinstance(doc, dict):
            raise ValueError("not an object")
        meta = doc.get("meta") if isinstance(doc.get("meta"), dict) else {}
        plain = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
        features = []
        for f in doc.get("features") or []:
            where = f.get("location") or {}
            place = {k: where.get(k) for k in ("start", "end", "complement", "join", "five_prime_partial", "three_prime_partial")}
            place |= {"sub_locations": json.dumps(where["sub_locations"]) if where.get("sub_locations") else None, "segments": json_segments(where)}
            features.append({k: plain(f.get(k)) for k in ("name", "hash", "type", "description", "sequence")} | {"location": place, "tags": [(k, plain(v)) for k, v in (f.get("tags") or {}).items()]})
        known = {k: plain(meta.get(k)) for k in _META} | {"other": [(k, plain(v)) for k, v in meta.items() if k not in _META]}
        return {"meta": known, "features": features, "sequence": plain(doc.get("sequence")), "error": None}
    except (ValueError, AttributeError, TypeError, RecursionError) as e:
        return {"meta": None, "features": None, "sequence": None, "error": f"{type(e).__name__}: {e}"}


def native_rows(documents: DataFrame) -> DataFrame:
    """Rows of NATIVE_JSON, one for each text (``value``); what doesn't parse leaves ``error``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(NATIVE_JSON))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([native_record(t) for t in b.column(0).to_pylist() if t and t.strip()], schema=arrow)

    return documents.select("value").mapInArrow(kernel, NATIVE_JSON)


def read_native_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A row for each file, or for each line: meta, features, sequence, error."""
    return native_rows(spark.read.text(path, wholetext=not lines))


def read_codon_json(spark: SparkSession, path: str) -> DataFrame:
    """Long form of codon tables: letter, triplet, weight, is_start, is_stop."""
    schema = "start_codons array<string>, stop_codons array<string>, amino_acids array<struct<letter:string,codons:array<struct<triplet:string,weight:bigint>>>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    flat = doc.select("start_codons", "stop_codons", F.explode("amino_acids").alias("a")).select("*", F.explode("a.codons").alias("c"))
    return flat.select("a.letter", "c.triplet", "c.weight", F.array_contains("start_codons", F.col("c.triplet")).alias("is_start"), F.array_contains("stop_codons", F.col("c.triplet")).alias("is_stop"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """a, b, score of a substitution matrix in the usual text form: a line of letters, then a line of scores for each letter."""
    lines = spark.read.text(path, wholetext=True)

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for text in f["value"]:
                rows = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
                yield pd.DataFrame([(r[0], b, int(v)) for r in rows[1:] for b, v in zip(rows[0], r[1:])], columns=["a", "b", "score"])

    return lines.mapInPandas(kernel, "a string, b string, score int")
