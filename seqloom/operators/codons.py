"""Codon statistics and optimisation. A codon table is a DataFrame of letter, triplet, weight."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.genetic_code import genetic_code, start_codons, stop_codons
from seqloom.functions.sequence import triplets

LEAST_SHARE = 0.10


def codon_dim(spark: SparkSession, number: int = 1) -> DataFrame:
    """letter, triplet, weight (1), is_start, is_stop: 64 rows."""
    starts, stops = set(start_codons(number)), set(stop_codons(number))
    rows = [(a, t, 1, t in starts, t in stops) for t, a in genetic_code(number).items()]
    return spark.createDataFrame(rows, "letter string, triplet string, weight long, is_start boolean, is_stop boolean")


def coding_regions(features: DataFrame, type_col: str = "feature_type", seq: str = "sequence") -> DataFrame:
    """Features of type CDS whose sequence is a whole number of codons."""
    return features.where((F.col(type_col) == "CDS") & (F.length(seq) % 3 == 0) & (F.length(seq) > 0))


def codon_frequency(df: DataFrame, seq: Column, by: list[str] | None = None) -> DataFrame:
    """Codons of all sequences in frame, counted: [by..,] triplet, n. One pass with partial counts before the shuffle."""
    by = by or []
    return df.select(*by, F.explode(triplets(seq)).alias("triplet")).groupBy(*by, "triplet").agg(F.count(F.lit(1)).alias("n"))


def weigh(dim: DataFrame, frequency: DataFrame) -> DataFrame:
    """The table with the counted frequencies as weights, 0 for codons that do not occur."""
    return dim.join(F.broadcast(frequency.where(F.col("triplet").rlike("^[ACGT]{3}$"))), "triplet", "left").select("letter", "triplet", F.coalesce("n", F.lit(0)).cast("long").alias("weight"))


def start_counts(df: DataFrame, seq: Column) -> DataFrame:
    """First three letters of the sequences as written, counted."""
    return df.where(F.length(seq) >= 3).groupBy(F.substring(seq, 1, 3).alias("start_codon")).agg(F.count(F.lit(1)).alias("n"))


def genome_table(spark: SparkSession, features: DataFrame, number: int = 1, type_col: str = "feature_type", seq: str = "sequence") -> DataFrame:
    """The codon table of a genome's features: letter, triplet, weight (how often it is used), is_start and is_stop by the genetic code ``number``,
    n_starts (genes that begin with it) and gene_count (coding regions). One pass over the features counts codons, starts and genes alike.
    """
    genes = coding_regions(features, type_col, seq).select(triplets(F.col(seq)).alias("t"))
    words = genes.select(F.posexplode("t").alias("i", "triplet")).groupBy("triplet").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("i") == 0).alias("n_starts"))
    # A gene has one first codon, whatever its letters: the starts of all triplets, standard or not, number the genes.
    whole = words.agg(F.coalesce(F.sum("n_starts"), F.lit(0)).alias("gene_count"))
    table = codon_dim(spark, number).drop("weight").join(words, "triplet", "left").crossJoin(F.broadcast(whole))  # one row
    return table.select("letter", "triplet", F.coalesce("n", F.lit(0)).cast("long").alias("weight"), "is_start", "is_stop", F.coalesce("n_starts", F.lit(0)).cast("long").alias("n_starts"), "gene_count")


def add_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Weights of two tables summed by triplet; the letters are the first one's."""
    return a.join(b.select("triplet", F.col("weight").alias("w2")), "triplet").select("letter", "triplet", (F.col("weight") + F.col("w2")).alias("weight"))


def compromise(a: DataFrame, b: DataFrame, cut_off: float) -> DataFrame:
    """Mean of two tables' shares in 10,000 within a letter, each cut to whole numbers; 0 where either is below the cut-off."""
    if not 0 <= cut_off <= 1:
        raise ValueError("the cut-off must be from 0 to 1")
    letter = Window.partitionBy("letter")
    j = a.select("letter", "triplet", F.col("weight").alias("w1")).join(b.select("letter", "triplet", F.col("weight").alias("w2")), ["letter", "triplet"])
    share = lambda w: F.floor(F.try_divide(F.col(w).cast("double"), F.sum(w).over(letter)) * 10000).cast("int")
    s = j.select("letter", "triplet", share("w1").alias("p1"), share("w2").alias("p2"))
    low = int(10000 * cut_off)
    return s.select("letter", "triplet", F.when((F.col("p1") < low) | (F.col("p2") < low), 0).otherwise(F.floor((F.col("p1") + F.col("p2")) / 2)).cast("int").alias("weight"))


def codon_cdf(table: DataFrame) -> DataFrame:
    """Codons of more than a tenth of their letter's weight with the cumulated share of those kept: letter, triplet, low, high."""
    letter = Window.partitionBy("letter")
    kept = table.withColumn("total", F.sum("weight").over(letter)).where(F.col("weight") > LEAST_SHARE * F.col("total"))
    run = F.sum("weight").over(letter.orderBy("triplet").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return kept.select("letter", "triplet", F.round((run - F.col("weight")) / F.sum("weight").over(letter), 9).alias("low"), F.round(run / F.sum("weight").over(letter), 9).alias("high"))


def table_rows(table: DataFrame) -> list[tuple[str, str, int]]:
    """A codon table's rows (64 or fewer) for use in a kernel."""
    return sorted((r.letter, r.triplet, int(r.weight)) for r in table.collect())


def optimize(protein: Column, rows: list[tuple[str, str, int]], seed: int = 0, row_seed: Column | None = None) -> Column:
    """DNA for a protein, each codon drawn by weight among those of more than a tenth share; null for an unknown or unweighted letter."""
    choices: dict[str, tuple[list[str], np.ndarray]] = {}
    for letter in {r[0] for r in rows}:
        own = [(t, w) for a, t, w in rows if a == letter]
        total = sum(w for _, w in own)
        kept = [(t, w) for t, w in own if w > LEAST_SHARE * total]
        if kept:
            choices[letter] = ([t for t, _ in kept], np.cumsum([w for _, w in kept]) / sum(w for _, w in kept))

    @F.pandas_udf("string")
    def run(p: pd.Series, s: pd.Series) -> pd.Series:
        def one(text, own):
            if not text or any(c not in choices for c in text.upper()):
                return None
            draws = np.random.default_rng([seed & 0xFFFFFFFF, int(own) & 0xFFFFFFFF]).random(len(text))
            return "".join(choices[c][0][int(np.searchsorted(choices[c][1], x, "right"))] for c, x in zip(text.upper(), draws))

        return pd.Series([one(a, b) for a, b in zip(p, s)], dtype=object)

    return run(protein, F.xxhash64(protein) if row_seed is None else row_seed)
