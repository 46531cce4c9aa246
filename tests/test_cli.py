import csv
import glob
import re

import pytest

from strandtally import SketchConfig, cli
from strandtally.operators import kmers
from strandtally.plans.index import SketchIndex
from strandtally.sources.fastx import read_fastx

SHAPE = ["-k", "9", "-m", "5", "-s", "7", "--n-hashes", "3", "--counter-slots-exponent", "16", "--block-slots-exponent", "6"]
# all its windows differ, and the sketch is exact on it
TEXT = "GATTACAGGCTTAACCGTGATCCTGAAC"


@pytest.fixture()
def files(spark, tmp_path):
    reads, asked = tmp_path / "reads.fa", tmp_path / "asked.fa"
    reads.write_text(f">t,1\n{TEXT}\n>c\nNN{TEXT[:14]}\n{TEXT[14:]}NACG\n")
    asked.write_text(f">a\n{TEXT[:10]}N\n>none\nACGTGCATCAT\n>short\nACG\n")
    return str(reads), str(asked), tmp_path


def rows(path, sep=","):
    found = []
    for name in sorted(glob.glob(f"{path}/part-*")):
        with open(name, newline="") as f:
            part = list(csv.reader(f, delimiter=sep))
        found += part if not found else part[1:]
    return found


def inserted(spark, path):
    """s-mers inserted: each super-k-mer of n windows has n + k - s."""
    config = SketchConfig(k=9, m=5, s=7)
    return sum(r["n_windows"] + 2 for r in kmers.super_kmers(read_fastx(spark, path), config).collect())


def figures(text):
    return dict(re.findall(r"([A-Za-z0-9_]+): ([^\t\n]+)", text.strip().splitlines()[-1]))


def test_spectrum(spark, files, capfd):
    reads, asked, at = files
    smers = str(inserted(spark, reads))
    cli.main(["spectrum", reads, *SHAPE, "--spectrum-out", f"{at}/s"])
    assert rows(f"{at}/s", "\t") == [["estimated_count", "kmers"], ["2", "20"]]
    got = figures(capfd.readouterr().err)
    want = {"chunks": "2", "indexed_kmers": "40", "queried_kmers": "40", "inserted_smers": smers, "distinct_keys": "20", "counter_bits": "16", "counter_slots": "65536", "blocks": "1024"}
    assert {k: got[k] for k in want} == want and {"build_s", "query_s", "spectrum_s", "total_s"} <= set(got)
    cli.main(["spectrum", reads, *SHAPE, "--query-input", asked, "--stream-query-only"])
    out = capfd.readouterr()
    got = figures(out.err)
    assert out.out == ""
    assert (got["queried_kmers"], got["positive_estimates"], got["estimate_checksum"]) == ("5", "2", "4")
    cli.main(["spectrum", reads, *SHAPE, "--query-input", asked])
    assert capfd.readouterr().out.splitlines() == ["estimated_count\tkmers", "0\t3", "2\t2"]


def test_index_and_its_modes(spark, files, capfd):
    reads, asked, at = files
    cli.main(["build-index", reads, f"{at}/index", *SHAPE])
    assert figures(capfd.readouterr().err)["inserted_kmers"] == "40"
    assert SketchIndex.load(spark, f"{at}/index").inserted_kmers == 40
    fast = [["sequence", "length", "total_windows", "valid_kmers", "mean_abundance", "median_abundance"], ["a", "11", "3", "2", "2.000000", "2.000000"], ["none", "11", "3", "3", "0.000000", "0.000000"], ["short", "3", "0", "0", "", ""]]
    slow = [["sequence", "kmer_index", "abundance"], ["a", "0", "2"], ["a", "1", "2"], ["a", "2", ""], *[["none", str(i), "0"] for i in range(3)]]
    report = [["records_processed", "total_windows", "valid_kmers", "positive_estimates", "estimate_checksum"], ["3", "6", "5", "2", "4"]]
    for mode, want in (("fast", fast), ("slow", slow), ("report", report)):
        cli.main(["query-index", f"{at}/index", asked, "-o", f"{at}/{mode}", "--mode", mode])
        assert rows(f"{at}/{mode}") == want
    for mode, want in (("fast", fast), ("slow", slow)):
        cli.main(["query-abundance", reads, asked, "-o", f"{at}/both-{mode}", "--mode", mode, *SHAPE])
        assert rows(f"{at}/both-{mode}") == want
    cli.main(["query-index", f"{at}/index", reads, "-o", f"{at}/names"])
    assert [r[0] for r in rows(f"{at}/names")] == ["sequence", "t,1", "c"]


def test_filter_and_sampled_spectra(spark, files):
    reads, _, at = files
    cli.main(["filter-spectrum", reads, "-o", f"{at}/f", "--counter-histogram", f"{at}/h", "--max-abundance", "30", "--kmer-count-hint", "100", *SHAPE])
    found = rows(f"{at}/f")
    assert found[0] == ["estimated_count", "estimated_kmers", "method", "kmer_count_hint"] and len(found) == 31
    assert abs(sum(int(r[1]) for r in found[1:]) - 100) <= 1 and {r[3] for r in found[1:]} == {"100"}
    histogram = {int(v): int(n) for v, n in rows(f"{at}/h")[1:]}
    assert sum(histogram.values()) == 1 << 16 and sum(v * n for v, n in histogram.items()) == 3 * inserted(spark, reads)
    # every counter in use holds 2 or more, so below that nothing is found and the hint is its least
    cli.main(["filter-spectrum", reads, "-o", f"{at}/g", "--max-abundance", "1", *SHAPE])
    assert {r[3] for r in rows(f"{at}/g")[1:]} == {"1"}
    cli.main(["sampled-spectrum", reads, "-o", f"{at}/p", "--sample-size", "10", *SHAPE])
    assert rows(f"{at}/p") == [["estimated_count", "sampled_kmers", "linear_scaled_windows", "estimated_distinct_kmers"], ["2", "10", "40", "20"]]


def test_null_ids_stay_null(spark):
    own = spark.createDataFrame([(None, "T" * 10), (3, "C" * 9)], "record_id long, sequence string")
    index = SketchIndex.build(spark, own, SketchConfig(k=9, m=5, s=7, n_hashes=3, counter_slots_exponent=16, block_slots_exponent=6))
    assert {r["record_id"] for r in index.abundances(own).collect()} == {None, 3}
    assert {r["record_id"]: r["valid_kmers"] for r in index.summaries(own).collect()} == {None: 2, 3: 1}


def test_file_that_is_neither_kind(spark, tmp_path):
    (tmp_path / "x").write_text("ACGT\n")
    with pytest.raises(ValueError, match="neither"):
        read_fastx(spark, str(tmp_path / "x"))
