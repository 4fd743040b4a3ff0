"""Features of records: parsing of locations, sequences, and appending."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.sequence import feature_sequence
from seqloom.sources.genbank import SEGMENT, parse_location

LOCATION = f"struct<complement:boolean,joined:boolean,five_prime_partial:boolean,three_prime_partial:boolean,start_pos:bigint,end_pos:bigint,segments:{SEGMENT},error:string>"


def location(text: Column) -> Column:
    """A location string as a struct of flags, outer bounds and segments; what doesn't parse leaves only ``error``. Null stays null."""
    names = ["complement", "joined", "five_prime_partial", "three_prime_partial", "start_pos", "end_pos", "segments", "error"]

    @F.pandas_udf(LOCATION)
    def run(s: pd.Series) -> pd.DataFrame:
        def one(x):
            if x is None:
                return [None] * len(names)
            try:
                got = parse_location(x)
            except (ValueError, RecursionError) as e:
                return [None] * (len(names) - 1) + [str(e)]
            return [got.get(n) for n in names]

        return pd.DataFrame([one(x) for x in s], columns=names)

    return run(text)


def with_sequences(features: DataFrame, records: DataFrame, key: str = "record_id", parent: str = "sequence") -> DataFrame:
    """Features with ``feature_sequence``, cut from their record's sequence; features of records that are not there are left out."""
    p = records.select(key, F.col(parent).alias("__parent"))
    turned = F.coalesce(features["complement"], F.lit(False))
    return features.withColumn("__turned", turned).join(p, key).withColumn("feature_sequence", feature_sequence("__parent", "segments", "__turned")).drop("__parent", "__turned")


def add_features(features: DataFrame, new: DataFrame, key: str = "record_id", index: str = "feature_idx") -> DataFrame:
    """Appends features to their records: each gets the next free index of its record, in the order of its own index."""
    last = features.groupBy(key).agg((F.max(index) + 1).alias("__next"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(index)) - 1
    numbered = new.withColumn("__place", place).join(last, key, "left").withColumn(index, (F.coalesce("__next", F.lit(0)) + F.col("__place")).cast("int")).drop("__next", "__place")
    return features.unionByName(numbered, allowMissingColumns=True)
