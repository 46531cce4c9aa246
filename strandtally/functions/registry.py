"""Functions for SQL texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandtally.functions.hashing import mix64

CANONICAL = "least({x}, translate(reverse({x}), 'ACGT', 'TGCA'))"


def _mixed(x: pd.Series) -> pd.Series:
    filled = x.fillna(0).astype("int64").to_numpy()
    return pd.Series(mix64(filled.view("uint64")).view("int64")).astype("Int64").mask(x.isna().to_numpy())


def register(spark: SparkSession) -> None:
    """Temporary functions of the session.

    reverse_complement(text), canonical(text), kmer_code(text) (up to 31 bases in upper case), mix64(bigint), and the table function
    kmers(sequence, k) -> (kmer_index, kmer): the canonical k-mer of each window, null where it isn't ACGT alone.  All but mix64 are SQL of their own, which
    Catalyst sees through; null in, null out (kmers: no rows).
    """
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION reverse_complement(x STRING) RETURNS STRING RETURN translate(reverse(x), 'ACGT', 'TGCA')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION canonical(x STRING) RETURNS STRING RETURN CASE WHEN x IS NOT NULL THEN {CANONICAL.format(x='x')} END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kmer_code(x STRING) RETURNS BIGINT RETURN CAST(conv(translate(x, 'ACGT', '0123'), 4, 10) AS BIGINT)")
    window = "substr(upper(sequence), i + 1, k)"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION kmers(sequence STRING, k INT) RETURNS TABLE (kmer_index BIGINT, kmer STRING) RETURN "
        f"SELECT CAST(i AS BIGINT), CASE WHEN {window} RLIKE '^[ACGT]+$' THEN {CANONICAL.format(x=window)} END "
        "FROM (SELECT explode(CASE WHEN length(sequence) >= k THEN sequence(0, length(sequence) - k) ELSE array() END) AS i)"
    )
    spark.udf.register("mix64", F.pandas_udf(_mixed, "long"))
