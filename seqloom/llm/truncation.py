"""Texts that were cut off before their end, and how often each source cuts.

Two detectors, each with its own verdict:

* Limits. Per source and column, histograms of the lengths of distinct texts, in characters and in bytes. A limit stands out as a spike:
  far more texts of just that length than of the lengths around it. A text of a spike length without terminal punctuation
  is cut, unless it ends in just one of the closing forms below.
* Transfers. A cut in transfer leaves any length, and no histogram shows it. What shows it is the end: texts of a corpus close in few forms
  (a formula, a signature, a date line), and one whose last block has none of them, or comes after a block that breaks off, was cut.

Nothing is known beforehand of languages or closings: all forms are counted over the corpus. A form is a block without its names
and numbers. Closing forms end a share of the texts off the limits. Running page lines, which are no end, are the
forms of lines that stand several times in one text with their number going up by one. Off the limits a form may also be
recognised by a near one, as scanners misread letters.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import cut_lineage, release

#: A closing form ends at least this share of all texts and a page line stands in as many, and in so many of them.
FORM_SHARE, FORM_LEAST = 0.0003, 3
#: A spike: so many distinct texts of one length, and so many times the mean of the lengths around it.
SPIKE_LEAST, SPIKE_TIMES, SPIKE_AROUND = 5, 8.0, 40
#: Lines at the end of a text that are looked at; forms of longer lines are kept as a digest, which can be equal but not near.
TAIL_LINES, LONG_FORM = 8, 100
#: Near forms differ in one letter of so many and end alike.
NEAR_EVERY = 10
TERMINAL = tuple('.!?"»”)]')
_NUMBER = re.compile(r"\d+")
#: A line by its last number: what is before and after it.
_NUMBERED_LINE = re.compile(rf"^(?=[^\n]{{1,{2 * LONG_FORM}}}$)([^\n]*?(?<!\d))(\d+)([^\d\n]*)$", re.M)


def line_form(line: str) -> str:
    """A line without its names, numbers and dates: 'N' for words that begin with a capital and what joins them, '9' for numbers."""
    out: list[str] = []
    for w in line.split():
        core = w.strip('.,;:()[]«»"“”—–-!?¶…')
        digits = sum(c.isdigit() for c in core)
        if not core:
            kind = w
        elif digits and 2 * digits >= sum(c.isalnum() for c in core):
            kind = "9"
        elif core[0].isupper() or core[0].isdigit():
            kind = "N"
        else:
            kind = w.lower()
        if kind in ("N", "9") and out and out[-1] == kind:
            continue
        if kind == "N" and len(out) > 1 and out[-2] == "N" and len(out[-1]) < 4 and out[-1].isalpha():
            out.pop()
            continue
        out.append(kind)
        if kind == "9":  # a date: two numbers with a few words between them
            for back in (2, 3, 4):
                if len(out) > back and out[-1 - back] == "9":
                    del out[-back:]
                    break
    return " ".join(out)


def kept_form(line: str) -> str:
    """The form of a line; of a long one, a digest of the line."""
    form = line_form(line) if len(line) <= 2 * LONG_FORM else line
    return form if len(form) <= LONG_FORM else "#" + hashlib.md5(form.encode()).hexdigest()[:16]


def running_forms(text: str) -> set[str]:
    """Forms of the lines of at most twice LONG_FORM letters that stand more than once with their last number going up by one."""
    seen: dict[tuple[str, str], int] = {}
    out = set()
    for m in _NUMBERED_LINE.finditer(text):
        before, last, after = m[1].lstrip(), int(m[2][-18:]), m[3].rstrip()
        if not before and not after:
            continue
        key = (_NUMBER.sub("#", before), after)
        if seen.get(key) == last - 1:
            out.add(kept_form(m[0].strip()))
        seen[key] = last
    return out


def tail(text: str) -> list[tuple[str, bool, bool]]:
    """The last lines, the last first: form, whether a blank line stands before it, whether it ends with terminal punctuation."""
    out: list[tuple[str, bool, bool]] = []
    end = len(text)
    blank = False
    while end > 0 and len(out) < TAIL_LINES:
        at = text.rfind("\n", 0, end) + 1
        line = text[at:end].strip()
        end = at - 1
        if not line:
            blank = True
            continue
        if blank and out:
            out[-1] = (out[-1][0], True, out[-1][2])
        blank = False
        out.append((kept_form(line), False, line.endswith(TERMINAL)))
    return out


def near(a: str, b: str) -> int:
    """Edits between two forms."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def is_near(form: str, known) -> bool:
    """Whether a known form differs in few letters and ends alike."""
    return any(form[-2:] == k[-2:] and abs(len(form) - len(k)) <= len(k) // NEAR_EVERY and near(form, k) <= len(k) // NEAR_EVERY for k in known if len(k) >= NEAR_EVERY and k[0] != "#")


def last_block(lines, page: frozenset[str]) -> tuple[str | None, bool]:
    """The form of the last block without page lines, and whether what comes before it ends like a sentence. None if it goes on beyond the tail."""
    paged = [f in page or is_near(f, page) for f, _, _ in lines]
    i = 0
    while i < len(lines) and paged[i]:
        i += 1
    block: list[str] = []
    while i < len(lines):
        if not paged[i]:
            block.append(lines[i][0])
        i += 1
        if lines[i - 1][1] and block:
            break
    else:
        if len(lines) >= TAIL_LINES:
            return None, True
    while i < len(lines) and paged[i]:
        i += 1
    return " | ".join(reversed(block)), i >= len(lines) or bool(lines[i][2])


def _ends(df: DataFrame, id_col: str, texts: list[str], source: str) -> DataFrame:
    """A row for each text, and rows of the page lines of each batch (``form``, ``n``) beside them."""
    values = F.explode(F.array(*(F.struct(F.lit(t).alias("column"), F.col(f"`{t}`").alias("text")) for t in texts))).alias("v")
    base = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source}`").cast("string").alias("source"), values).select("id", "source", "v.*").where("text is not null and text != ''")
    kind = base.schema["id"].dataType.simpleString()
    sized = base.select("id", "source", "column", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("digest"), "text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = pa.struct([("form", pa.string()), ("gap", pa.bool_()), ("sound", pa.bool_())])
        for b in batches:
            pages: Counter[str] = Counter()
            tails, ends = [], []
            for t in b.column("text").to_pylist():
                pages.update(running_forms(t))
                tails.append([{"form": x, "gap": y, "sound": z} for x, y, z in tail(t)])
                ends.append(t.rstrip().endswith(TERMINAL))
            n, more = b.num_rows, len(pages)
            cols = [pa.concat_arrays([c, pa.nulls(more, c.type)]) for c in b.columns[:-1]]
            cols += [pa.array(ends + [None] * more, pa.bool_()), pa.array(tails + [None] * more, pa.list_(line)), pa.array([None] * n + list(pages), pa.string()), pa.array([None] * n + list(pages.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "source", "column", "chars", "bytes", "digest", "terminal", "tail", "form", "n"])

    return sized.mapInArrow(kernel, f"id {kind}, source string, column string, chars int, bytes int, digest long, terminal boolean, tail array<struct<form:string,gap:boolean,sound:boolean>>, form string, n long")


def length_spikes(ends: DataFrame) -> DataFrame:
    """``column``, ``source``, ``unit``, ``size``, ``n``: lengths that far more distinct texts have than the lengths around them."""
    unit = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("u")
    once = ends.select("column", F.coalesce("source", F.lit("")).alias("source"), "chars", "bytes", "digest").distinct()
    hist = once.select("column", "source", unit).groupBy("column", "source", "u.unit", "u.size").agg(F.count(F.lit(1)).alias("n"))
    around = Window.partitionBy("column", "source", "unit").orderBy("size").rangeBetween(-SPIKE_AROUND, SPIKE_AROUND)
    rest = (F.sum("n").over(around) - F.col("n")) / (2.0 * SPIKE_AROUND)
    return hist.withColumn("around", rest).where((F.col("n") >= SPIKE_LEAST) & (F.col("n") > SPIKE_TIMES * F.col("around"))).drop("around")


def find_truncated(df: DataFrame, id_col: str = "doc_id", text: str | list[str] = "text", source: str = "source") -> DataFrame:
    """Every text with its verdict: ``id_col``, ``column``, ``source``, ``chars``, ``bytes``, ``limit_chars``, ``limit_bytes`` (whether it has a spike length), ``cut``, ``reason``.

    reason is 'chars' or 'bytes' for a text that the limits tell to be cut, 'transfer' for one that its end tells, null if it is whole.
    text: one column or several, each judged by its own spikes. Null and empty texts are left out; a null source is a source of its
    own; repeated rows get a verdict each but count once in the spikes. An empty table gives no rows. Only the named columns are
    read. Forms and spikes are counted over all texts. What the driver and the tasks are told are the page and closing
    forms: at most 1 / FORM_SHARE of closing ones.
    """
    both = cut_lineage(_ends(df, id_col, [text] if isinstance(text, str) else text, source))
    ends = both.where("chars is not null").drop("form", "n")
    least = max(FORM_LEAST, FORM_SHARE * ends.count())
    page = frozenset(r.form for r in both.where("chars is null").groupBy("form").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect())
    spikes = cut_lineage(length_spikes(ends))

    kind = ends.schema["id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [last_block([(x["form"], x["gap"], x["sound"]) for x in t], page) for t in b.column("tail").to_pylist()]
            cols = [*b.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "source", "column", "chars", "bytes", "terminal", "form", "sound"])

    out = ends.drop("digest").mapInArrow(blocks, f"id {kind}, source string, column string, chars int, bytes int, terminal boolean, form string, sound boolean").withColumn("key", F.coalesce("source", F.lit("")))
    for unit in ("chars", "bytes"):
        these = spikes.where(F.col("unit") == unit).select("column", F.col("source").alias("key"), F.col("size").alias(unit), F.lit(True).alias(f"limit_{unit}"))
        out = out.join(these, ["column", "key", unit], "left").withColumn(f"limit_{unit}", F.coalesce(f"limit_{unit}", F.lit(False)))
    judged = cut_lineage(out.drop("key"))
    release(both, spikes)
    at_limit = F.col("limit_chars") | F.col("limit_bytes")
    closing = frozenset(r.form for r in judged.where(~at_limit & F.col("form").isNotNull()).groupBy("form").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect())
    exact: Column = F.coalesce(F.col("form").isin(*closing), F.lit(False)) if closing else F.lit(False)

    @F.pandas_udf("boolean")
    def closes_nearly(forms: pd.Series) -> pd.Series:
        return pd.Series([f is not None and is_near(f, closing) for f in forms], dtype=bool)

    # Few forms are not known: only those are looked at one by one.
    unknown = judged.where(~exact & ~at_limit).select("form").distinct()
    nearly = unknown.where(closes_nearly("form")).select("form", F.lit(True).alias("nearly"))
    ended = (exact | F.coalesce("nearly", F.lit(False))) & F.col("sound")
    by_limit = at_limit & ~F.col("terminal") & ~(exact & F.col("sound"))
    by_end = ~F.when(at_limit, exact & F.col("sound")).otherwise(ended)
    cut = F.when(at_limit & ~F.col("terminal"), by_limit).otherwise(by_end)
    reason = F.when(by_limit & F.col("limit_chars"), "chars").when(by_limit, "bytes").when(cut, "transfer")
    return judged.join(nearly, "form", "left").select(F.col("id").alias(id_col), "column", "source", "chars", "bytes", "limit_chars", "limit_bytes", cut.alias("cut"), reason.alias("reason"))


def truncation_rates(found: DataFrame) -> DataFrame:
    """``source``, ``n_docs``, ``n_cut``, ``n_at_limit`` (told by the limits), ``n_transfer`` (told by the end), ``rate`` of find_truncated()'s result."""
    return found.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if("cut").alias("n_cut"), F.count_if(F.col("reason").isin("chars", "bytes")).alias("n_at_limit"), F.count_if(F.col("reason") == "transfer").alias("n_transfer"),
        F.round(F.count_if("cut") / F.count(F.lit(1)), 6).alias("rate"),
    )
