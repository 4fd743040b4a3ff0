"""SQL names for the expressions: temporary functions whose bodies are SQL, so that Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from seqloom.functions.sequence import DNA_CODES, DNA_COMPLEMENTS, RNA_CODES, RNA_COMPLEMENTS

_TURN = "translate(s, '{}', '{}')"
_DNA, _RNA = _TURN.format(DNA_CODES, DNA_COMPLEMENTS), _TURN.format(RNA_CODES, RNA_COMPLEMENTS)
SQL_FUNCTIONS = {
    "seq_complement": ("string", f"if(s rlike '^[{DNA_CODES}]*$', {_DNA}, null)"),
    "seq_reverse_complement": ("string", f"if(s rlike '^[{DNA_CODES}]*$', reverse({_DNA}), null)"),
    "seq_complement_rna": ("string", f"if(s rlike '^[{RNA_CODES}]*$', {_RNA}, null)"),
    "seq_reverse_complement_rna": ("string", f"if(s rlike '^[{RNA_CODES}]*$', reverse({_RNA}), null)"),
    "seq_gc_content": ("double", "try_divide(regexp_count(s, '[GCgc]'), length(s))"),
    "seq_is_dna": ("boolean", "s rlike '^[ACGT]*$'"),
    "seq_is_rna": ("boolean", "s rlike '^[ACGU]*$'"),
    "seq_is_palindromic": ("boolean", f"s = reverse({_DNA})"),
    "seq_marmur_doty": ("double", "cast(2 * regexp_count(s, '[ATat]') + 4 * regexp_count(s, '[GCgc]') - 7 as double)"),
    "seq_letters": ("string", "upper(regexp_replace(s, '[^A-Za-z]+', ''))"),
}


def register_all(spark: SparkSession) -> list[str]:
    """Defines the functions in the session; their names."""
    for name, (kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}(s string) returns {kind} return {body}")
    return list(SQL_FUNCTIONS)
