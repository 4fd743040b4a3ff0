"""Writers: each format's text as a column, and folders of such text. Text is built row by row, so writing needs no shuffle."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.sources.genbank import build_record


def _wrapped(seq: Column, width: int) -> Column:
    return F.array_join(F.regexp_extract_all(seq, F.lit(rf".{{1,{width}}}"), F.lit(0)), "\n")


def fasta_text(name: Column, seq: Column, width: int = 80) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), _wrapped(seq, width), F.lit("\n"))


def fastq_text(identifier: Column, optionals: Column, seq: Column, quality: Column) -> Column:
    """Optionals come sorted by key."""
    pairs = F.transform(F.array_sort(F.map_entries(F.coalesce(optionals, F.create_map().cast("map<string,string>")))), lambda e: F.concat(F.lit(" "), e["key"], F.lit("="), e["value"]))
    return F.concat(F.lit("@"), identifier, F.array_join(pairs, ""), F.lit("\n"), seq, F.lit("\n+\n"), quality)


def pileup_text(row: str = "") -> Column:
    c = lambda n: F.col(f"{row}{n}")
    return F.concat_ws("\t", c("sequence_name"), F.coalesce(c("position").cast("string"), c("wide")["position"]), c("reference_base"), c("read_count").cast("string"), F.array_join(c("read_results"), ""), c("quality"))


def gff_text() -> Column:
    """A feature line: starts become 1-based, attributes come sorted by key, and what is missing gets its default."""
    or_dot = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("."))
    attributes = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), F.when(e["value"].contains(";"), F.concat(F.lit('"'), e["value"], F.lit('"'))).otherwise(e["value"]))), ";")
    return F.concat_ws(
        "\t", F.coalesce("seqid", F.lit("unknown")), F.coalesce(F.nullif("origin", F.lit("")), F.lit("feature")), F.coalesce(F.nullif("feature_type", F.lit("")), F.lit("unknown")),
        F.coalesce((F.col("start_pos") + 1).cast("string"), F.col("wide")["start_pos"]), F.coalesce(F.col("end_pos").cast("string"), F.col("wide")["end_pos"]), or_dot(F.col("score")), or_dot(F.col("strand")), or_dot(F.col("phase")), F.coalesce(F.nullif(attributes, F.lit("")), F.lit(".")),
    )


def gff_lines(features: DataFrame, regions: DataFrame, sequences: DataFrame, version: str = "3") -> DataFrame:
    """``value`` and its place (``section``, ``name``, ``at``) of whole GFF3 text: version, regions, feature lines, the end mark, sequences.

    Of the form that read_gff() gives. Sorted by the place it is a file; write_gff() does that.
    """
    place = lambda section, name=None, at=None: [F.lit(section).alias("section"), (F.lit("") if name is None else name).alias("name"), (F.lit(0) if at is None else at).cast("long").alias("at")]
    spark = features.sparkSession
    fixed = spark.createDataFrame([(0, "", 0, f"##gff-version {version}"), (3, "", 0, "###"), (4, "", 0, "##FASTA")], "section int, name string, at long, value string")
    spot = regions.select(*place(1, F.col("name")), F.concat_ws(" ", F.lit("##sequence-region"), "name", F.col("region_start").cast("string"), F.col("region_end").cast("string")).alias("value"))
    rows = features.select(*place(2, F.coalesce("seqid", F.lit("unknown")), F.col("start_pos")), gff_text().alias("value"))
    tail = sequences.select(*place(5, F.col("name")), fasta_text(F.col("name"), F.col("sequence"), 70).alias("value")).withColumn("value", F.regexp_replace("value", "\n\\z", ""))
    return fixed.unionByName(spot).unionByName(rows).unionByName(tail)


def write_gff(features: DataFrame, regions: DataFrame, sequences: DataFrame, path: str, version: str = "3", single_file: bool = True) -> None:
    """Whole GFF3 text in order; in parts that follow each other by name unless it is to be a single file."""
    lines = gff_lines(features, regions, sequences, version).orderBy("section", "name", "at", "value").select("value")
    write_lines(lines, path, single_file)


def genbank_text(records: DataFrame) -> DataFrame:
    """``value``: the text of each record of read_genbank()'s form."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def plain(x):
            if isinstance(x, dict):
                return {k: plain(v) for k, v in x.items()}
            if hasattr(x, "asDict"):
                return plain(x.asDict(True))
            return [plain(v) for v in x] if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray" else x

        for f in frames:
            rows = f.to_dict("records")
            for r in rows:
                for k in ("other",):
                    r[k] = dict(r[k]) if r.get(k) is not None else {}
                r["features"] = [{**plain(x), "attributes": dict(x["attributes"] or {})} for x in (r.get("features") if r.get("features") is not None else [])]
                for k in ("locus", "taxonomy", "refs", "base_count"):
                    r[k] = plain(r[k]) if r.get(k) is not None else None
            yield pd.DataFrame({"value": [build_record(r) for r in rows]})

    return records.mapInPandas(kernel, "value string")


def slow5_text(headers: DataFrame, reads: DataFrame) -> tuple[list[str], DataFrame]:
    """Header lines, attributes sorted and '.' where a group has none, and the reads' lines."""
    groups = sorted(headers.collect(), key=lambda r: r.read_group_id)  # a file has a handful of read groups
    keys = sorted({k for g in groups for k in g.attributes})
    reasons = sorted(groups[0].end_reasons.items(), key=lambda x: x[1]) if groups and groups[0].end_reasons else []
    cols = [c for c in reads.columns if c not in ("error", "file_name")]
    kinds = {
        "read_id": "char*", "read_group": "uint32_t", "digitisation": "double", "offset": "double", "range": "double", "sampling_rate": "double", "len_raw_signal": "uint64_t",
        "raw_signal": "int16_t*", "channel_number": "char*", "median_before": "double", "read_number": "int32_t", "start_mux": "uint8_t", "start_time": "uint64_t",
        "end_reason": "enum{" + ",".join(k for k, _ in reasons) + "}",
    }
    head = [f"#slow5_version\t{groups[0].slow5_version if groups else ''}", f"#num_read_groups\t{len(groups)}"]
    head += ["@" + "\t".join([k, *(g.attributes.get(k, ".") for g in groups)]) for k in keys]
    head += ["#" + "\t".join(kinds[c] for c in cols), "#" + "\t".join(cols)]
    number = F.create_map(*(x for k, i in reasons for x in (F.lit(k), F.lit(str(i))))) if reasons else None

    def cell(c: str) -> Column:
        if c == "raw_signal":
            return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
        if c == "end_reason" and number is not None:
            return number[F.col(c)]
        text = F.col(c).cast("string")
        return F.regexp_replace(text, r"\.0$", "") if dict(reads.dtypes)[c] == "double" else text

    return head, reads.select(F.concat_ws("\t", *(F.coalesce(cell(c), F.lit(".")) for c in cols)).alias("value"))


def write_slow5(headers: DataFrame, reads: DataFrame, path: str, single_file: bool = True) -> None:
    """A slow5 file of one header's read groups and its reads: the header stands in the first part, parts follow each other by name."""
    head, lines = slow5_text(headers, reads)
    first = headers.sparkSession.createDataFrame([(x,) for x in head], "value string").coalesce(1)
    write_lines(first.union(lines), path, single_file)


def codon_json(table: DataFrame) -> DataFrame:
    """``value``: one document of a codon table in long form, letters and triplets sorted."""
    codon = F.struct("triplet", "weight")
    letters = table.groupBy("letter").agg(F.array_sort(F.collect_list(codon)).alias("codons"))
    flags = table.agg(F.array_sort(F.collect_set(F.when(F.col("is_start"), F.col("triplet")))).alias("start_codons"), F.array_sort(F.collect_set(F.when(F.col("is_stop"), F.col("triplet")))).alias("stop_codons"))
    whole = letters.agg(F.array_sort(F.collect_list(F.struct("letter", "codons"))).alias("amino_acids"))
    return flags.crossJoin(whole).select(F.to_json(F.struct("start_codons", "stop_codons", "amino_acids")).alias("value"))


def enzyme_json(enzymes: DataFrame) -> DataFrame:
    """``value``: each enzyme as a JSON object."""
    return enzymes.select(F.to_json(F.struct("*")).alias("value"))


def enzyme_map_json(enzymes: DataFrame, name: str = "name") -> DataFrame:
    """``value``: one document, a map from each enzyme's name to the enzyme. A list of enzymes has some thousand of them."""
    entry = F.struct(F.col(name).alias("key"), F.struct("*").alias("value"))
    return enzymes.where(F.col(name).isNotNull()).dropDuplicates([name]).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))


def native_json_text(records: DataFrame, pretty: bool = True) -> DataFrame:
    """``value``: each record of read_native_json()'s form as a document, sub-locations to any depth."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def document(r: dict) -> str:
            meta = dict(r["meta"] or {})
            meta |= dict(meta.pop("other", None) or [])
            features = []
            for f in r["features"] or []:
                where = {k: v for k, v in (f["location"] or {}).items() if k != "segments" and v is not None}
                if "sub_locations" in where:
                    where["sub_locations"] = json.loads(where["sub_locations"])
                features.append({**f, "location": where, "tags": dict(f["tags"] or [])})
            plain = lambda d: {k: v for k, v in d.items() if v is not None}
            return json.dumps({"meta": plain(meta), "features": [plain(f) for f in features], "sequence": r["sequence"]}, indent=1 if pretty else None, ensure_ascii=False)

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([document(r) for r in b.to_pylist()], pa.string())], names=["value"])

    return records.select("meta", "features", "sequence").mapInArrow(kernel, "value string")


def write_lines(lines: DataFrame, path: str, single_file: bool = False, sep: str = "\n", mode: str = "errorifexists") -> None:
    """A folder of text; one file only if asked for, as all of it then passes one task."""
    (lines.coalesce(1) if single_file else lines).write.mode(mode).option("lineSep", sep).text(path)
