"""Reads asked for their own k-mers: the same answers as by way of an index or of a row for each window, in bounded memory."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandtally import SketchConfig
from strandtally.operators import abundance as ab
from strandtally.operators import kernel, kmers, own, packing
from strandtally.plans import queries
from strandtally.plans.index import SketchIndex

SHAPES = [
    SketchConfig(k=9, m=5, s=7, n_hashes=3, counter_slots_exponent=16, block_slots_exponent=6),
    SketchConfig(k=31, m=21, s=25, n_hashes=4, counter_bits=8, counter_slots_exponent=20, block_slots_exponent=5, counter_cap=5),
    SketchConfig(k=15, m=9, s=11, n_hashes=2, counter_slots_exponent=14, block_slots_exponent=9, segmentation="value", counter_bits=32),
]


def text(n, seed, letters="ACGTN"):
    r = random.Random(seed)
    return "".join(r.choice(letters) for _ in range(n))


def some_reads(spark):
    sequences = [text(400, 7), "NNN", "ACGT" * 20, None, text(60, 8, "ACGT"), text(50, 8, "ACGT"), "A" * 300, "", "acgtnACGT" * 9]
    return spark.createDataFrame(list(zip([5, 6, None, 7, None, 5, 8, 9, -3], sequences, strict=True)), "record_id long, sequence string").repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def documents(spark, path):
    texts = ["".join(random.Random(i).choices("abcdefghijklmnop ,.é", k=300)) for i in range(30)] * 2
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_portions_of_a_large_part_are_bounded():
    """Before, up to 32 MB of packed records (some 20 million s-mers) were opened at once."""
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 40), pa.array([bytes(1 << 20)] * 40, pa.binary())], names=["part", "records"])
    found = list(packing.whole_parts(iter([batch])))
    assert sum(r.num_rows for _, held in found for r in held) == 40
    assert max(sum(r.nbytes for r in held) for _, held in found) < 8 << 20
    small = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([b"x"] * 9, pa.binary())], names=["part", "records"])
    assert [sum(r.num_rows for r in held) for _, held in packing.whole_parts(iter([small]), parts_at_once=4)] == [4, 4, 1]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize(("piece", "portion", "held"), [(1 << 21, 1 << 20, 1 << 20), (10, 2, 50)])
def test_estimates_equal_those_of_an_index(spark, monkeypatch, shape, piece, portion, held):
    """With small portions most cells are kept in a file before they are answered."""
    monkeypatch.setattr(kernel, "PIECE_WINDOWS", piece)
    monkeypatch.setattr(own, "PORTION", portion)
    monkeypatch.setattr(own, "HELD", held)
    reads = some_reads(spark)
    index = SketchIndex.build(spark, reads, shape)
    assert rows(own.estimates(reads, shape)) == rows(index.estimates(reads))
    assert rows(own.spectrum(reads, shape)) == rows(index.spectrum(reads))
    assert rows(own.report(reads, shape)) == rows(index.report(reads))
    assert rows(own.windows(reads, shape)) == rows(index.abundances(reads))


@pytest.mark.parametrize(("piece", "portion", "held"), [(1 << 21, 1 << 20, 1 << 21), (10, 2, 50)])
def test_summaries_equal_those_of_windows(spark, monkeypatch, piece, portion, held):
    monkeypatch.setattr(kernel, "PIECE_WINDOWS", piece)
    monkeypatch.setattr(own, "PORTION", portion)
    monkeypatch.setattr(own, "HELD", held)
    monkeypatch.setattr(own, "HELD_ANSWERS", held)
    reads = some_reads(spark)
    for shape in SHAPES[:2]:
        index = SketchIndex.build(spark, reads, shape)
        assert rows(own.summaries(reads, shape)) == rows(ab.sequence_summary(reads, index.abundances(reads)))
        counts = kmers.kmer_counts(reads, shape.k).select("kmer", F.col("n").alias("estimate"))
        assert rows(own.exact_summaries(reads, shape.k)) == rows(ab.sequence_summary(reads, ab.abundance_windows(reads, counts, shape.k)))


def test_looked_up_slots_are_those_of_the_chain():
    c = queries.CONFIG
    forward = np.random.default_rng(1).integers(0, 4**c.s, 500).astype(np.uint64)
    found = own._listed(c.s, c.n_hashes, c.block_slots)[forward.view(np.int64)]
    want = kernel.chains(np.minimum(forward, kernel.reverse_complement(forward, c.s)), c)
    assert [[int(x) >> 8 * i & 255 for i in range(c.n_hashes)] for x in found] == want.tolist()


def test_kmer_estimates_exchange_super_kmers_once(spark, tmp_path):
    """Before, an index was built, exchanged and joined, with a 64th of all k-mers held by a task."""
    text = plan(queries.QUERIES["kmer_estimates"](spark, documents(spark, tmp_path)))
    assert text.count("Exchange") == 1 and text.count("MapInArrow") == 2 and "Join" not in text and "Window" not in text, text


def test_sequence_summary_sends_windows_back_packed(spark, tmp_path):
    """Before, a row for each read and abundance was aggregated by Spark, whose maps and buffers held 2.6 GB of an executor."""
    text = plan(queries.QUERIES["sequence_summary"](spark, documents(spark, tmp_path)))
    assert "percentile" not in text and "ObjectHashAggregate" not in text and text.count("MapInArrow") == 3, text


def test_sketch_spectrum_is_tallied_where_cells_are_answered(spark, tmp_path):
    """Before, an index was joined and a row for each k-mer went through Spark's aggregate."""
    text = plan(queries.QUERIES["sketch_spectrum"](spark, documents(spark, tmp_path)))
    assert "Join" not in text and "Window" not in text and text.count("MapInArrow") == 2 and "kmer#" not in text, text


def test_query_report_reads_documents_once(spark, tmp_path):
    """Before, they were scanned for the index, for the probes and for the number of windows."""
    text = plan(queries.QUERIES["query_report"](spark, documents(spark, tmp_path)))
    assert text.count("Scan parquet") == 1 and "Join" not in text, text


def test_exact_summary_exchanges_no_row_for_each_window(spark, tmp_path):
    """Before, all windows were exchanged to be joined with their counts, and again by read."""
    df = queries.QUERIES["exact_summary"](spark, documents(spark, tmp_path))
    assert len(df.collect()) == 60
    text = df._jdf.queryExecution().executedPlan().toString().split("== Final Plan ==")[-1].split("== Initial Plan ==")[0]
    assert "kmer_index" not in text and "kmer#" not in text, text


def test_abundance_windows_scan_documents_once(spark, tmp_path):
    """Before, they were scanned for the index, for the probes and for the windows that aren't ACGT alone."""
    text = plan(queries.QUERIES["kmer_abundance_windows"](spark, documents(spark, tmp_path)))
    assert text.count("Scan parquet") == 1 and "Join" not in text and "Union" not in text, text
