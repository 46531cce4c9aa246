from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandtally import ConfigError, SketchConfig
from strandtally.config import IndexFormatError
from strandtally.functions import dna
from strandtally.functions.hashing import mix64, with_mix64
from strandtally.operators import kmers, spectrum
from strandtally.plans.index import IndexBuilder, SketchIndex
from strandtally.sources import sinks
from strandtally.sources.fastx import read_fastx

UNIT = SketchConfig(k=9, m=5, s=7, n_hashes=3, counter_slots_exponent=16, block_slots_exponent=6)
REP28 = "ACGT" * 7
OTHER = "TGCATGCAACGTACGTTGCATGCAACGT"


def reads(spark, *sequences):
    return spark.createDataFrame(list(enumerate(sequences)), "record_id long, sequence string")


def canonical_counts(sequences, k):
    out = Counter()
    for s in sequences:
        for i in range(len(s) - k + 1):
            w = s[i : i + k].upper()
            if set(w) <= set("ACGT"):
                out[min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))] += 1
    return out


def code(w):
    return int(w.translate(str.maketrans("ACGT", "0123")), 4)


def test_mix64_has_its_published_values(spark):
    assert [hex(int(x)) for x in mix64(np.array([0, 1], np.uint64))] == ["0xe220a8397b1dcdaf", "0x910a2dec89025cc1"]
    values = [0, 1, 2, 3**39, 2**62 + 12345, -1]
    rows = with_mix64(spark.createDataFrame([(v,) for v in values], "x long"), "x", "y").collect()
    want = mix64(np.array(values, np.int64).view(np.uint64)).view(np.int64)
    assert [r["y"] for r in rows] == want.tolist()


@pytest.mark.parametrize(
    ("sequences", "k", "want"),
    [
        (["ACGT" * 5], 9, [(6, 2)]),
        (["ACGT" * 5] * 2, 9, [(12, 2)]),
        ([REP28], 9, [(10, 2)]),
        (["ACGTTGCATGTCAGTACGATCGTACGTTAGC"], 11, [(1, 19), (2, 1)]),
        (["TGCATGCAACGTACGTTGCATGCAACGTACGT"], 13, [(2, 4), (3, 4)]),
        ([REP28, OTHER], 9, [(2, 4), (3, 4), (10, 2)]),
        (["T" * 28, "C" * 28], 9, [(20, 2)]),
        (["ACGTACNNACGTAC"], 5, [(2, 2)]),
    ],
)
def test_exact_spectra(spark, sequences, k, want):
    found = spectrum.spectrum(kmers.kmer_counts(reads(spark, *sequences), k), "n").collect()
    assert [tuple(r) for r in found] == want


def test_windows_mark_what_is_not_acgt(spark):
    rows = kmers.windows(reads(spark, "ACGTACNNacgtac", "ACG", "", None), 5).orderBy("record_id", "kmer_index").collect()
    assert len(rows) == 10
    assert [r["kmer_index"] for r in rows if r["kmer"] is not None] == [0, 1, 8, 9]
    runs = kmers.valid_runs(reads(spark, "ACGTACNNacgtac", "NN", ""), 5).collect()
    assert [(r["run_start"], r["run"]) for r in runs] == [(0, "ACGTAC"), (8, "ACGTAC")]


def test_text_of_codes(spark):
    texts = ["A" * 31, "T" * 31, "GATTACA" * 4 + "CCC"]
    rows = spark.createDataFrame([(t, code(t)) for t in texts], "t string, c long").select("t", dna.kmer_text(F.col("c"), 31).alias("back")).collect()
    assert all(r["t"] == r["back"] for r in rows)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 40_000])
def test_runs_of_long_sequences(spark, n):
    import re

    rng = np.random.default_rng(n)
    text = "".join("ACgT"[: 1 + i % 4] * (1 + i % 3) + "N" * int(x) for i, x in enumerate(rng.integers(1, 4, n)))
    found = [(r["run_start"], r["run"]) for r in kmers.valid_runs(reads(spark, text), 5).collect()]
    assert found == [(m.start(), m[0].upper()) for m in re.finditer("[ACGTacgt]+", text) if len(m[0]) >= 5]


@pytest.mark.parametrize(("k", "m", "s"), [(9, 5, 7), (9, 5, 9), (11, 5, 8), (13, 7, 9)])
@pytest.mark.parametrize("bits", [8, 16, 32])
def test_estimates_never_fall_below_counts(spark, k, m, s, bits):
    config = SketchConfig(k=k, m=m, s=s, n_hashes=3, counter_bits=bits, counter_slots_exponent=16, block_slots_exponent=6)
    rng = np.random.default_rng(k + s)
    texts = [REP28, OTHER, "".join(rng.choice(list("ACGTN"), 300, p=[0.24] * 4 + [0.04]))]
    own = reads(spark, *texts)
    found = {r["kmer"]: r for r in SketchIndex.build(spark, own, config).estimates(own).collect()}
    exact = canonical_counts(texts, k)
    assert {code(w) for w in exact} == set(found)
    for w, n in exact.items():
        assert found[code(w)]["n"] == n
        assert found[code(w)]["estimate"] >= min(n, config.counter_max)


def test_saturation_and_strands(spark):
    many = reads(spark, *[REP28] * 300)
    for bits, least in ((8, 255), (16, 256)):
        config = SketchConfig(k=9, m=5, s=7, n_hashes=3, counter_bits=bits, counter_slots_exponent=16, block_slots_exponent=6)
        top = SketchIndex.build(spark, many, config).estimates(reads(spark, REP28)).agg(F.min("estimate")).first()[0]
        assert top == 255 if bits == 8 else top >= least
    back = OTHER[::-1].translate(str.maketrans("ACGT", "TGCA"))
    index = SketchIndex.build(spark, reads(spark, OTHER), UNIT)
    one, two = ([r["abundance"] for r in index.abundances(reads(spark, x)).orderBy("kmer_index").collect()] for x in (OTHER, back))
    assert one == two[::-1]


def test_build_in_parts_equals_build_at_once(spark, tmp_path):
    builder = IndexBuilder(spark, UNIT)
    assert builder.add_sequence(REP28) == 20
    report = builder.add(reads(spark, OTHER, "ACG"))
    assert (report["records_processed"], report["records_indexed"], report["inserted_kmers"]) == (2, 1, 20)
    parts = builder.into_index()
    whole = SketchIndex.build(spark, reads(spark, REP28, OTHER), UNIT)
    rows = lambda x: sorted(tuple(r) for r in x.counters.collect())
    assert rows(parts) == rows(whole)
    parts.save(f"{tmp_path}/index")
    again = SketchIndex.load(spark, f"{tmp_path}/index")
    assert rows(again) == rows(parts) and again.inserted_kmers == 40 and again.config == UNIT
    histogram = {r["counter_value"]: r["counters"] for r in again.counter_histogram().collect()}
    assert sum(histogram.values()) == UNIT.counter_slots and 0 in histogram
    assert [r["estimated_count"] for r in again.filter_only_spectrum(8).collect()] == list(range(1, 9))
    with pytest.raises(IndexFormatError):
        SketchIndex.load(spark, f"{tmp_path}/none")


def test_reports(spark):
    own = reads(spark, "ACGTACNNACGTAC", "ACG")
    config = SketchConfig(k=5, m=3, s=5, n_hashes=2, counter_slots_exponent=12, block_slots_exponent=5)
    index = SketchIndex.build(spark, own, config)
    rows = {r["record_id"]: r for r in index.summaries(own).collect()}
    assert (rows[0]["total_windows"], rows[0]["valid_kmers"], rows[1]["total_windows"], rows[1]["mean_abundance"]) == (10, 4, 0, None)
    report = index.report(own).first()
    assert (report["records_processed"], report["total_windows"], report["valid_kmers"], report["positive_estimates"]) == (2, 10, 4, 4)
    empty = index.report(reads(spark)).first()
    assert (empty["records_processed"], empty["total_windows"], empty["valid_kmers"]) == (0, 0, 0)
    sample = index.sampled_spectrum(own, 2).collect()
    assert sum(r["sampled_kmers"] for r in sample) == 2


def test_deconvolution():
    assert np.allclose(spectrum.deconvolve([(0, 100), (1, 20), (2, 5)], 2, 3), [12.5, 1.875, 0])
    assert spectrum.deconvolve([(0, 5)], 2, 0) == [] and spectrum.deconvolve([], 2, 2) == [0, 0] and spectrum.deconvolve([(1, 5)], 2, 2) == []
    assert spectrum.filter_only([(1, 3), (2, 1)], 2, 2, 8) == [(1, 6), (2, 2)]
    assert spectrum.count_hint([(0, 10)], 2) == 1


@pytest.mark.parametrize("change", [{"k": 0}, {"k": 10}, {"k": 33}, {"m": 0}, {"m": 33}, {"s": 0}, {"s": 33}, {"n_hashes": 0}, {"block_slots_exponent": 30}, {"threads": 0}, {"queue": 0}, {"counter_bits": 12}])
def test_bad_configurations(change):
    with pytest.raises(ConfigError):
        SketchConfig(**change)


def test_fasta_fastq_and_sinks(spark, tmp_path):
    fasta = tmp_path / "a.fa"
    fasta.write_text(">one x\r\nACGT\r\nacgt\r\n> two\nNNN\n>three>x\n\n>\nAC\n")
    rows = [tuple(r) for r in read_fastx(spark, str(fasta)).orderBy("record_id").collect()]
    assert rows == [(0, "one", "ACGTacgt"), (1, "record_2", "NNN"), (2, "three>x", ""), (3, "record_4", "AC")]
    fastq = tmp_path / "a.fq"
    fastq.write_text("@r1 d\nACGT\n+\n@>>>\n@r2\nTTTT\n+\nIIII\n")
    assert [tuple(r)[1:] for r in read_fastx(spark, str(fastq)).orderBy("record_id").collect()] == [("r1", "ACGT"), ("r2", "TTTT")]
    sinks.write_spectrum(spark.createDataFrame([(2, 5), (1, 3)], "estimated_count long, kmers long"), f"{tmp_path}/out")
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == "estimated_count\tkmers\n1\t3\n2\t5\n"
    sinks.write_csv(spark.createDataFrame([('a,"b', None)], "sequence string, abundance long"), f"{tmp_path}/csv", single=True)
    assert next((tmp_path / "csv").glob("part-*")).read_text() == 'sequence,abundance\n"a,""b",\n'


def test_segments_do_not_depend_on_batches(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ACGT"), n)) for n in (5, 40, 200, 9, 8)]
    own = reads(spark, *texts)
    one = sorted(tuple(r) for r in kmers.super_kmers(own.coalesce(1), UNIT).collect())
    many = sorted(tuple(r) for r in kmers.super_kmers(own.repartition(5), UNIT).collect())
    assert one == many
    assert sum(r[2] for r in one) == sum(max(0, len(t) - 8) for t in texts)
    assert all(n >= 1 for *_, n, _ in one) and len({r[:2] for r in one}) == len(one)
