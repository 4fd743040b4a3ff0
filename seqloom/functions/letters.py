"""Column expressions that strip layout from sequences and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letters(sequence: Column) -> Column:
    """The characters A-Z and a-z of a sequence, upper-cased, with everything else dropped. Null stays null."""
    return F.upper(F.regexp_replace(sequence, "[^A-Za-z]+", ""))


def name_fields(name: Column) -> Column:
    """A FASTA name as the sorted list of its fields, each reduced to ASCII letters and digits, upper-cased. Empty fields count."""
    return F.array_join(F.array_sort(F.transform(F.split(name, r"\|", -1), lambda x: F.upper(F.regexp_replace(x, "[^A-Za-z0-9]+", "")))), "|")
