"""SQL functions, samples by a limit, caps and warnings."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandtally import ConfigError, SketchConfig
from strandtally.functions import registry
from strandtally.functions.hashing import mix64, with_mix64
from strandtally.operators import kmers, spectrum
from strandtally.plans.index import IndexBuilder, SketchIndex

UNIT = SketchConfig(k=9, m=5, s=7, n_hashes=3, counter_slots_exponent=16, block_slots_exponent=6)


def reads(spark, *sequences):
    return spark.createDataFrame(list(enumerate(sequences)), "record_id long, sequence string")


def dna(n, seed):
    return "".join(np.random.default_rng(seed).choice(list("ACGTN"), n, p=[0.245] * 4 + [0.02]))


def test_functions_in_sql(spark):
    registry.register(spark)
    reads(spark, "ACGTNACGTTT", "acgta", "AC", None).createOrReplaceTempView("own_reads")
    found = spark.sql("SELECT record_id, kmer_index, kmer, kmer_code(kmer) AS code, mix64(kmer_code(kmer)) AS mixed FROM own_reads, LATERAL kmers(sequence, 4)")
    rows = {(r["record_id"], r["kmer_index"]): r for r in found.collect()}
    want = {r[:2]: r[2] for r in kmers.windows(reads(spark, "ACGTNACGTTT", "acgta", "AC", None), 4).collect()}
    assert {key: r["code"] for key, r in rows.items()} == want and None in want.values()
    assert all(r["mixed"] == (None if r["code"] is None else int(mix64(np.array([r["code"]], np.uint64)).view(np.int64)[0])) for r in rows.values())
    one = spark.sql("SELECT canonical('TTTT') AS a, reverse_complement('AACG') AS b, canonical(NULL) AS c, mix64(-1) AS d").first()
    assert tuple(one)[:3] == ("AAAA", "CGTT", None) and one["d"] == int(mix64(np.array([-1], np.int64).view(np.uint64)).view(np.int64)[0])


def by_columns(reads, k, size, seed):
    """The sample stated with columns."""
    rows = with_mix64(kmers.windows(reads, k).where("kmer is not null").withColumn("_seed", F.col("record_id") + F.lit(seed)), "_seed", "_mix")
    rows = with_mix64(rows.withColumn("_mix", F.col("_mix").bitwiseXOR(F.col("kmer_index"))), "_mix", "_mix")
    return rows.withColumn("_mix", F.shiftrightunsigned("_mix", 1)).orderBy("_mix", "record_id", "kmer_index").limit(size).drop("_mix", "_seed")


@pytest.mark.parametrize("size", [1, 50, 1000, 10_000, 10**9])
def test_sample_by_limit_equals_the_sorted_one(spark, size):
    own = reads(spark, *[dna(900, i) for i in range(12)], "", "N" * 30).repartition(3)
    found = sorted(tuple(r) for r in kmers.sampled_windows(own, 9, size, seed=5).collect())
    assert found == sorted(tuple(r) for r in by_columns(own, 9, min(size, 20_000), 5).collect())
    limit, total = kmers.sample_limit(own, 9, size, 5)
    assert len(found) == min(size, total)
    # what reaches the task that ranks
    passed = kmers.per_scan(own, 9, "n long", lambda ids, s: [np.array([(kmers._coarse(kmers.sample_ranks(ids, s, 5)[1]) <= limit).sum()])]).agg(F.sum("n")).first()[0]
    assert len(found) <= passed < 2 * size + 64
    assert kmers.sampled_windows(own.where("false"), 9, size).count() == 0


def test_sample_figures_and_warning(spark):
    own = reads(spark, *[dna(200, i) for i in range(4)])
    builder = IndexBuilder(spark, UNIT)
    builder.add(own)
    index = builder.into_index()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        found, figures = index.sampled(own, 100)
    assert figures == {"total_inserted_kmers": index.inserted_kmers, "sampled_kmers": 100} and found.agg(F.sum("sampled_kmers")).first()[0] == 100
    with pytest.warns(UserWarning, match="k-mers were indexed"):
        index.sampled(own.where("record_id < 2"), 100)
    with pytest.raises(ValueError, match="positive"):
        index.sampled(own, 0)
    assert spectrum.sampled_spectrum(index.estimates(own.where("false")), 0).count() == 0


def test_counters_saturate_at_a_cap_of_ones_own(spark):
    capped = SketchConfig(k=9, m=5, s=7, n_hashes=3, counter_slots_exponent=16, block_slots_exponent=6, counter_cap=7)
    index = SketchIndex.build(spark, reads(spark, *["ACGT" * 7] * 3), capped)
    assert {r["cnt"] for r in index.counters.collect()} == {7} and {r["estimate"] for r in index.estimates(reads(spark, "ACGT" * 7)).collect()} == {7}
    for cap in (0, 1 << 16):
        with pytest.raises(ConfigError, match="counter_cap"):
            SketchConfig(counter_cap=cap)


def test_even_widths_warn():
    with pytest.warns(UserWarning, match="too low"):
        SketchConfig(k=9, m=4, s=6)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        SketchConfig(k=9, m=5, s=6)
        SketchConfig()
