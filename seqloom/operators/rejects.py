"""Typed loading of raw pileup and GFF3 lines, with a reason for every line that does not parse.

Structural indexing: the lines of an Arrow batch are looked at as one run of bytes. numpy masks mark the tabs, line ends
and quotes; the running parity of the quotes tells which separators lie inside quoted values; cumulated counts at the line
offsets give each line's columns. Column counts, type checks, numbers and attributes are all worked out on whole batches, and
typed columns are cut from the same bytes. Only the read results of a pileup line, whose indels carry their own length, are scanned
line by line.

Bad rows are data, not errors: each gets the first reason that holds and keeps its raw line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAB, CR, QUOTE, SEMICOLON, EQUALS, PERCENT = b"\t"[0], b"\r"[0], b'"'[0], b";"[0], b"="[0], b"%"[0]

#: Whole numbers have no largest value in either format. One beyond BIGINT is null in its own column and stands, by the column's name, as digits here.
WIDE = T.StructField("wide", T.MapType(T.StringType(), T.StringType()))
PILEUP_FIELDS = T.StructType([
    T.StructField("sequence_name", T.StringType()), T.StructField("position", T.LongType()), T.StructField("reference_base", T.StringType()),
    T.StructField("read_count", T.LongType()), T.StructField("read_results", T.ArrayType(T.StringType())), T.StructField("quality", T.StringType()), WIDE,
])
GFF_FIELDS = T.StructType([
    T.StructField("seqid", T.StringType()), T.StructField("origin", T.StringType()), T.StructField("feature_type", T.StringType()),
    T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("strand", T.StringType()), T.StructField("phase", T.IntegerType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType())), WIDE,
])

_READ = re.compile(rb"(?:\^[!-~])?[.,*ACGTNacgtn]\$?")
_READS = re.compile(rb"(?:(?:\^[!-~])?[.,*ACGTNacgtn]\$?)+")
_INDEL = re.compile(rb"[+-]([0-9]+)")
_BASES = re.compile(rb"[ACGTNacgtn]*")
_SCORE = re.compile(rb"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")


class Lines:
    """The structural index of a batch of lines: bytes, offsets without the carriage return at the end, and columns."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        self.n = len(column)
        self.null = np.asarray(column.is_null())
        offsets = np.frombuffer(column.buffers()[1], np.int64, self.n + 1, column.offset * 8)
        data = column.buffers()[2]
        base, stop = (int(offsets[0]), int(offsets[-1])) if self.n else (0, 0)
        self.bytes = np.frombuffer(data, np.uint8)[base:stop] if data is not None and stop > base else np.zeros(0, np.uint8)
        self.start = offsets[:-1] - base
        self.end = offsets[1:] - base
        last = self.at(self.end - 1, self.end > self.start)
        self.end = self.end - ((last == CR) & (self.end > self.start))
        tabs = np.flatnonzero(self.bytes == TAB)
        self.first_tab = np.searchsorted(tabs, self.start)
        self.tabs = tabs
        self.columns = np.searchsorted(tabs, self.end) - self.first_tab + 1
        self.raw = self.bytes.tobytes()

    def at(self, where: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """The byte at each position, 0 where not ok."""
        out = np.zeros(len(where), np.uint8)
        if len(self.bytes):
            out[ok] = self.bytes[where[ok]]
        return out

    def bounds(self, k: int, of: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of column k of lines with exactly ``of`` columns; empty for the others."""
        fits = self.columns == of
        a, b = self.start.copy(), self.start.copy()
        rows = np.flatnonzero(fits)
        if k:
            a[rows] = self.tabs[self.first_tab[rows] + k - 1] + 1
        b[rows] = self.tabs[self.first_tab[rows] + k] if k < of - 1 else self.end[rows]
        return a, b

    @staticmethod
    def sums(mask: np.ndarray) -> np.ndarray:
        """Running counts of what a mask marks; their difference counts it between two offsets."""
        out = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=out[1:])
        return out

    def only(self, allowed: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether every byte between a and b is an allowed one."""
        table = np.ones(256, bool)
        table[np.frombuffer(allowed, np.uint8)] = False
        other = self.sums(table[self.bytes])
        return other[b] == other[a]

    def numbers(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the digits between a and b, and which of them are beyond BIGINT. Leading zeros don't count."""
        significant = np.append(np.flatnonzero(self.bytes != ord("0")), len(self.bytes))
        a = np.minimum(significant[np.searchsorted(significant, a)], b)
        size = b - a
        value = np.zeros(len(a), np.uint64)
        for j in range(19):  # nineteen digits fit 64 bits without a sign
            more = size > j
            value[more] = value[more] * np.uint64(10) + (self.bytes[a[more] + j] - np.uint8(48)).astype(np.uint64)
        wide = (size > 19) | (value > np.uint64(2**63 - 1))
        return np.where(wide, np.uint64(2**63 - 1), value).astype(np.int64), wide

    def text(self, a: int, b: int) -> bytes:
        return self.raw[a:b]

    def cut(self, a: np.ndarray, b: np.ndarray) -> pa.Array:
        """The texts between a and b."""
        sizes = b - a
        offsets = np.zeros(len(a) + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        where = np.repeat(a - offsets[:-1], sizes) + np.arange(offsets[-1])
        return pa.Array.from_buffers(pa.large_string(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.bytes[where]))]).cast(pa.string())


_DIGITS = b"0123456789"
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_BLANK = b" \t\r\n\v\f"


class Verdicts:
    """The first reason that holds for each line; 0 for none."""

    def __init__(self, n: int):
        self.code, self.reasons = np.zeros(n, np.int32), [None]

    def reject(self, bad: np.ndarray, reason: str) -> None:
        self.reasons.append(reason)
        self.code[bad & (self.code == 0)] = len(self.reasons) - 1

    @property
    def alive(self) -> np.ndarray:
        return self.code == 0


def _wide(ls: Lines, rows: np.ndarray, fields: list[tuple[str, tuple, np.ndarray]]) -> pa.Array:
    """Digits of the numbers beyond BIGINT by column name; null for rows without one."""
    out: list = [None] * len(rows)
    for name, (a, b), wide in fields:
        for k in np.flatnonzero(wide[rows]):
            out[k] = {**(out[k] or {}), name: ls.text(a[rows[k]], b[rows[k]]).decode().lstrip("0")}
    return pa.array([None if x is None else list(x.items()) for x in out], pa.map_(pa.string(), pa.string()))


def tokenize_reads(value: bytes) -> tuple[list[bytes] | None, int]:
    """The reads and indels of a pileup's read results and the number of reads; None if they don't tokenize."""
    out: list[bytes] = []
    at = reads = 0
    while at < len(value):
        if m := _READS.match(value, at):
            some = _READ.findall(value, at, m.end())
            out += some
            reads += len(some)
            at = m.end()
        elif reads and (m := _INDEL.match(value, at)):
            digits = m[1].lstrip(b"0")
            length = int(digits) if 0 < len(digits) < 19 else len(value) + 1
            bases = _BASES.match(value, m.end())
            if bases.end() - bases.start() < length:
                return None, reads
            out.append(value[at : m.end() + length])
            at = m.end() + length
        else:
            return None, reads
    return out, reads


def parse_pileup(column: pa.Array, typed: bool = True) -> tuple[Verdicts, np.ndarray, pa.StructArray | None]:
    """Verdicts, which lines are no rows at all (never, for pileup), and the typed rows of the valid lines in order."""
    ls = Lines(column)
    v = Verdicts(ls.n)
    v.reject(ls.null, "no line")
    v.reject(ls.columns != 6, "not 6 columns")
    at = [ls.bounds(k, 6) for k in range(6)]
    long = [b - a for a, b in at]
    v.reject((long[0] == 0) | ~ls.only(_LETTERS + _DIGITS + b"_.|:-", *at[0]), "bad sequence name")
    v.reject(~ls.only(_DIGITS, *at[1]) | ls.only(b"0", *at[1]), "position not an integer from 1")  # an empty text holds nothing but zeros
    v.reject((long[2] != 1) | ~ls.only(b"ACGTNacgtn", *at[2]), "bad reference base")
    v.reject(~ls.only(_DIGITS, *at[3]) | (long[3] == 0), "read count not an integer")
    alive = v.alive
    counts, many = np.zeros(ls.n, np.int64), np.zeros(ls.n, bool)
    counts[alive], many[alive] = ls.numbers(at[3][0][alive], at[3][1][alive])
    reads: dict[int, list[bytes]] = {}
    bad, off = np.zeros(ls.n, bool), np.zeros(ls.n, bool)
    for i, a, b, count in zip(np.flatnonzero(alive).tolist(), at[4][0][alive].tolist(), at[4][1][alive].tolist(), counts[alive].tolist()):
        tokens, n = tokenize_reads(ls.raw[a:b])
        bad[i], off[i] = tokens is None, n != count
        if typed and tokens is not None:
            reads[i] = tokens
    v.reject(bad, "bad read results")
    v.reject(off | many, "reads don't number the read count")
    v.reject(~ls.only(bytes(range(33, 127)), *at[5]), "bad quality character")
    v.reject(long[5] != counts, "qualities don't number the read count")
    if not typed:
        return v, np.zeros(ls.n, bool), None
    ok = np.flatnonzero(v.alive)
    cut = lambda k: ls.cut(at[k][0][ok], at[k][1][ok])
    position, wide = np.zeros(ls.n, np.int64), np.zeros(ls.n, bool)
    position[ok], wide[ok] = ls.numbers(at[1][0][ok], at[1][1][ok])
    tokens = pa.array([[x.decode() for x in reads[i]] for i in ok.tolist()], pa.list_(pa.string()))
    columns = [cut(0), pa.array(position[ok], mask=wide[ok]), cut(2), pa.array(counts[ok]), tokens, cut(5), _wide(ls, ok, [("position", at[1], wide)])]
    return v, np.zeros(ls.n, bool), pa.StructArray.from_arrays(columns, names=PILEUP_FIELDS.fieldNames())


class Attributes:
    """The items of the attribute columns of some lines: bounds, place of the first '=', and the line each belongs to."""

    def __init__(self, ls: Lines, a: np.ndarray, b: np.ndarray, rows: np.ndarray):
        self.ls = ls
        self.quotes = ls.sums(ls.bytes == QUOTE)
        # The parity of the quotes since the column's start tells separators from quoted ones.
        semis = np.flatnonzero(ls.bytes == SEMICOLON)
        row = np.searchsorted(ls.start, semis, "right") - 1
        mine = np.zeros(ls.n + 1, bool)
        mine[rows] = True
        semis, row = (x[mine[row] & (semis >= a[row]) & (semis < b[row])] for x in (semis, row))
        free = (self.quotes[semis] - self.quotes[a[row]]) % 2 == 0
        semis, row = semis[free], row[free]
        many = np.bincount(row, minlength=ls.n)[rows] + 1
        ends = np.cumsum(many)
        self.row = np.repeat(rows, many)
        first, last = np.zeros(len(self.row), bool), np.zeros(len(self.row), bool)
        first[ends - many] = last[ends - 1] = True
        self.start, self.end = np.zeros(len(self.row), np.int64), np.zeros(len(self.row), np.int64)
        self.start[first], self.start[~first] = a[rows], semis + 1
        self.end[last], self.end[~last] = b[rows], semis
        keep = ~(last & ~first & (self.start == self.end))  # one separator at the very end
        self.row, self.start, self.end = self.row[keep], self.start[keep], self.end[keep]
        equals = np.append(np.flatnonzero(ls.bytes == EQUALS), len(ls.bytes))
        self.equal = equals[np.searchsorted(equals, self.start)]
        self.lacks = self.equal >= self.end
        self.equal = np.minimum(self.equal, self.end)
        self.value = np.minimum(self.equal + 1, self.end)
        some = self.end - self.value > 1
        self.quoted = some & (ls.at(self.value, some) == QUOTE) & (ls.at(self.end - 1, some) == QUOTE)

    def bad(self) -> np.ndarray:
        """Which items break the rules."""
        ls, q = self.ls, self.quotes
        inner = q[self.end] - q[self.value] - 2 * self.quoted
        return self.lacks | ls.only(_BLANK, self.start, self.equal) | (q[self.equal] != q[self.start]) | (inner > 0)

    def maps(self, rows: np.ndarray) -> pa.Array:
        """The attributes of each line as a map; of equal keys the last counts."""
        here = np.isin(self.row, rows)
        inset = self.quoted[here].astype(np.int64)
        f = pd.DataFrame({
            "row": self.row[here], "key": self.ls.cut(self.start[here], self.equal[here]).to_pandas(), "value": self.ls.cut(self.value[here] + inset, self.end[here] - inset).to_pandas(),
        }).drop_duplicates(["row", "key"], keep="last")
        offsets = np.searchsorted(f["row"].to_numpy(), np.append(rows, self.ls.n))
        return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(f["key"], pa.string()), pa.array(f["value"], pa.string()))


def parse_gff(column: pa.Array, typed: bool = True) -> tuple[Verdicts, np.ndarray, pa.StructArray | None]:
    """Verdicts, which lines are no rows at all (blank ones and comments), and the typed rows of the valid lines in order."""
    ls = Lines(column)
    filled = ls.end > ls.start
    skip = ls.only(_BLANK, ls.start, ls.end) | (ls.at(ls.start, filled) == b"#"[0])
    skip &= ~ls.null
    v = Verdicts(ls.n)
    v.reject(ls.null, "no line")
    v.reject((ls.columns != 9) & ~skip, "not 9 columns")
    at = [ls.bounds(k, 9) for k in range(9)]
    long = [b - a for a, b in at]
    v.reject((long[0] == 0) & ~skip, "no seqid")
    v.reject((long[2] == 0) & ~skip, "no type")
    for k, name in ((3, "start"), (4, "end")):
        v.reject((~ls.only(_DIGITS, *at[k]) | (long[k] == 0)) & ~skip, f"{name} not an integer")
    alive = v.alive & ~skip
    start, end = np.zeros(ls.n, np.int64), np.zeros(ls.n, np.int64)
    wide_start, wide_end = np.zeros(ls.n, bool), np.zeros(ls.n, bool)
    start[alive], wide_start[alive] = ls.numbers(at[3][0][alive], at[3][1][alive])
    end[alive], wide_end[alive] = ls.numbers(at[4][0][alive], at[4][1][alive])
    turned = end < start
    for i in np.flatnonzero(wide_start & wide_end):  # neither fits 64 bits
        turned[i] = int(ls.text(at[4][0][i], at[4][1][i])) < int(ls.text(at[3][0][i], at[3][1][i]))
    turned |= wide_start & ~wide_end
    v.reject(alive & (start < 1), "start below 1")
    v.reject(alive & turned, "end before start")
    dot = lambda k: (long[k] == 1) & (ls.at(at[k][0], long[k] == 1) == b"."[0])
    no_score = dot(5)
    score = no_score.copy()
    for i in np.flatnonzero(alive & ~no_score):
        score[i] = _SCORE.fullmatch(ls.raw, at[5][0][i], at[5][1][i]) is not None
    v.reject(~score & ~skip, "score not a number")
    v.reject(((long[6] != 1) | ~ls.only(b"+-.?", *at[6])) & ~skip, "bad strand")
    kind, three = at[2][0], long[2] == 3
    cds = three & (ls.at(kind, three) == b"C"[0]) & (ls.at(kind + 1, three) == b"D"[0]) & (ls.at(kind + 2, three) == b"S"[0])
    no_phase = dot(7)
    v.reject(~((long[7] == 1) & ls.only(b"012", *at[7])) & ~(no_phase & ~cds) & ~skip, "bad phase")

    a, b = at[8]
    hexes = np.zeros(256, bool)
    hexes[np.frombuffer(b"0123456789abcdefABCDEF", np.uint8)] = True
    ish = np.concatenate([hexes[ls.bytes], [False, False]])
    broken = ls.sums((ls.bytes == PERCENT) & ~(ish[1 : len(ls.bytes) + 1] & ish[2 : len(ls.bytes) + 2]))
    quotes = ls.sums(ls.bytes == QUOTE)
    v.reject((quotes[b] - quotes[a]) % 2 == 1, "unbalanced quotes")
    # An escape must end within its own column too.
    late = np.zeros(ls.n, bool)
    for back in (1, 2):
        late |= ls.at(b - back, long[8] >= back) == PERCENT
    v.reject((broken[b] > broken[a]) | late, "bad escape in attributes")
    none = dot(8)
    items = Attributes(ls, a, b, np.flatnonzero(v.alive & ~skip & ~none))
    bad = np.zeros(ls.n, bool)
    bad[items.row[items.bad()]] = True
    v.reject(bad, "bad attributes")
    v.code[skip] = 0
    if not typed:
        return v, skip, None
    ok = np.flatnonzero(v.alive & ~skip)
    cut = lambda k: ls.cut(at[k][0][ok], at[k][1][ok])
    scores = [None if n else float(ls.text(x, y)) for n, x, y in zip(no_score[ok].tolist(), at[5][0][ok].tolist(), at[5][1][ok].tolist())]
    phases = np.where(no_phase[ok], 0, ls.at(at[7][0][ok], long[7][ok] == 1).astype(np.int32) - 48).astype(np.int32)
    columns = [
        cut(0), cut(1), cut(2), pa.array(start[ok], mask=wide_start[ok]), pa.array(end[ok], mask=wide_end[ok]), pa.array(scores, pa.float64()), cut(6), pa.array(phases, mask=no_phase[ok]),
        items.maps(ok), _wide(ls, ok, [("start_pos", at[3], wide_start), ("end_pos", at[4], wide_end)]),
    ]
    return v, skip, pa.StructArray.from_arrays(columns, names=GFF_FIELDS.fieldNames())


_FORMATS = {"pileup": (parse_pileup, PILEUP_FIELDS), "gff": (parse_gff, GFF_FIELDS)}


def parse_lines(df: DataFrame, fmt: str, id_col: str = "line_id", line_col: str = "line", *, typed: bool = True) -> DataFrame:
    """Every line of df parsed once: ``id_col``, ``row`` (typed struct, null for rejects), ``reason`` and ``line`` (both null for valid rows).

    fmt is 'pileup' or 'gff'. Lines that are no rows (blank or comment lines of GFF) are left out. A null line is a reject
    ('no line'), a null id is kept. Repeated lines are parsed each. Whole numbers may have any number of digits: one beyond
    BIGINT is null in its column and stands as digits in ``wide``. An empty table gives no rows. Only the two named columns are
    read. The pass is narrow: no shuffle. typed: without it no typed rows are built, for those who want the rejects only.
    """
    parse, fields = _FORMATS[fmt]
    rows = [T.StructField("row", fields)] if typed else []
    schema = T.StructType([T.StructField("__id", df.schema[id_col].dataType), *rows, T.StructField("reason", T.StringType()), T.StructField("line", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            verdicts, skip, row = parse(b.column(1), typed)
            keep = np.flatnonzero(~skip)
            codes = verdicts.code[keep]
            bad = codes > 0
            cols = [b.column(0).take(pa.array(keep)).cast(arrow.field(0).type)]
            if typed:
                place = np.cumsum(~bad) - 1
                cols.append(row.take(pa.array(place, mask=bad)).cast(arrow.field(1).type))
            cols.append(pa.array(verdicts.reasons, pa.string()).take(pa.array(codes)))
            cols.append(b.column(1).take(pa.array(keep, mask=~bad)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    out = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{line_col}`").cast("string").alias("__line")).mapInArrow(kernel, schema)
    return out.withColumnRenamed("__id", id_col)


def valid_rows(parsed: DataFrame) -> DataFrame:
    """The typed rows of parse_lines()."""
    return parsed.where("reason is null").select(parsed.columns[0], "row.*")


def rejects(parsed: DataFrame) -> DataFrame:
    """The lines that do not parse, each with its reason."""
    return parsed.where("reason is not null").select(parsed.columns[0], "reason", "line")
