"""Split-aware FASTA and FASTQ, the record visitor, index logs, stored indexes and compaction."""

import gzip
import json
import shutil

import numpy as np
import pytest

from strandtally import SketchConfig
from strandtally.config import IndexFormatError, parse_counter_bits
from strandtally.operators import sketch
from strandtally.plans.index import IndexBuilder, SketchIndex
from strandtally.plans.log import IndexLog
from strandtally.sources import fastx, files
from strandtally.streaming import ingest

UNIT = SketchConfig(k=9, m=5, s=7, n_hashes=3, counter_slots_exponent=16, block_slots_exponent=6)
REP28, OTHER = "ACGT" * 7, "TGCATGCAACGTACGTTGCATGCAACGT"


def reads(spark, *sequences):
    return spark.createDataFrame(list(enumerate(sequences)), "record_id long, sequence string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def fasta_text(n, seed):
    rng = np.random.default_rng(seed)
    out, want = [], []
    for i in range(n):
        header = ["", f"r{i} more", f" lead {i}", f"x>{i}", ">"][int(rng.integers(0, 5))]
        body = "".join(rng.choice(list("ACGTN"), int(rng.integers(0, 90))))
        width = int(rng.integers(1, 40))
        end = "\r\n" if i % 3 == 0 else "\n"
        lines = [body[j : j + width] for j in range(0, len(body), width)] + [""] * int(rng.integers(0, 2))
        out.append(f">{header}{end}" + "".join(x + end for x in lines))
        name = header.split()[0] if header[:1].strip() else f"record_{i + 1}"
        want.append((name, body))
    return "".join(out), want


def fastq_text(n, seed, multi):
    """Qualities that look like headers, separators or bases."""
    rng = np.random.default_rng(seed)
    out, want = [], []
    for i in range(n):
        body = "".join(rng.choice(list("ACGTN"), int(rng.integers(1, 60))))
        quality = "".join(rng.choice(list("@+>IA#"), len(body)))
        if multi:
            cut = int(rng.integers(1, len(body) + 1))
            parts = [x for x in (body[:cut], body[cut:]) if x]
            at = int(rng.integers(1, len(body) + 1))
            marks = [x for x in (quality[:at], quality[at:]) if x]
        else:
            parts, marks = [body], [quality]
        header = "" if i % 11 == 5 else f"q{i} d"
        out.append("\n".join([f"@{header}", *parts, "+" + (header if i % 2 else ""), *marks]) + "\n")
        want.append((f"q{i}" if header else f"record_{i + 1}", body))
    return "".join(out), want


@pytest.mark.parametrize("split", [64 << 20, 4000, 137, 61])
def test_fasta_for_any_split(spark, tmp_path, split):
    text, want = fasta_text(150, 1)
    (tmp_path / "a.fa").write_bytes(text.encode())
    if split < 100:  # splits by the reader alone: Spark would start a task for each
        reader = fastx.FastxReader(str(tmp_path / "a.fa"), split)
        got = [x for p in reader.partitions() for b in reader.read(p) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    else:
        got = [tuple(r) for r in fastx.records(spark, str(tmp_path / "a.fa"), split).collect()]
    assert [g[1:] for g in got] == want
    assert [g[0] for g in got] == sorted({g[0] for g in got})
    whole = [tuple(r) for r in fastx.records(spark, str(tmp_path / "a.fa")).collect()]
    assert got == whole


@pytest.mark.parametrize("multi", [False, True])
@pytest.mark.parametrize("seed", [2, 3])
@pytest.mark.parametrize("split", [1 << 20, 500, 97, 31])
def test_fastq_for_any_split(tmp_path, split, seed, multi):
    text, want = fastq_text(120, seed, multi)
    (tmp_path / "a.fq").write_text(text)
    reader = fastx.FastxReader(str(tmp_path / "a.fq"), split)
    got = [x for p in reader.partitions() for b in reader.read(p) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert [g[1:] for g in got] == want
    assert [g[0] for g in got] == sorted({g[0] for g in got})


def test_fastq_is_read_without_shuffle_or_job(spark, tmp_path):
    text, want = fastq_text(60, 4, True)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.fq").write_text(text)
    (tmp_path / "d" / "2.fa.gz").write_bytes(gzip.compress(b">z\nAC\nGT\n"))
    (tmp_path / "d" / "3.fa").write_text("")
    (tmp_path / "d" / "_SUCCESS").write_text("no data")
    df = fastx.records(spark, str(tmp_path / "d"), 700)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[1:] for r in df.collect()] == [*want, ("z", "ACGT")]
    numbered = fastx.read_fastx(spark, str(tmp_path / "d")).orderBy("record_id").collect()
    assert [r["record_id"] for r in numbered] == list(range(61)) and [tuple(r)[1:] for r in numbered] == [*want, ("z", "ACGT")]
    as_text = fastx.read_text_fastx(spark, str(tmp_path / "d" / "2.fa.gz"))
    assert [tuple(r) for r in as_text.collect()] == [(0, "z", "ACGT")]


def test_visitor_is_in_order_and_stops(spark, tmp_path):
    (tmp_path / "a.fa").write_text("".join(f">s{i}\n{'ACGT' * 5}\n" for i in range(200)))
    seen = []
    assert fastx.for_each_record(spark, str(tmp_path / "a.fa"), lambda name, sequence: seen.append((name, len(sequence))), split_bytes=300) == 200
    assert seen == [(f"s{i}", 20) for i in range(200)]
    seen.clear()

    def visit(name, sequence):
        seen.append(name)
        if name == "s7":
            raise RuntimeError("enough")

    with pytest.raises(RuntimeError, match="enough"):
        fastx.for_each_record(spark, str(tmp_path / "a.fa"), visit, split_bytes=300)
    assert seen == [f"s{i}" for i in range(8)]
    # a bad record stops it too, after what stands before
    (tmp_path / "b.fq").write_text("@a\nAC\n+\nII\nnothing\n@b\nAC\n+\nII\n")
    seen.clear()
    with pytest.raises(Exception, match="no FASTQ record"):
        fastx.for_each_record(spark, str(tmp_path / "b.fq"), lambda name, sequence: seen.append(name))
    assert seen in ([], ["a"])
    with pytest.raises(FileNotFoundError):
        fastx.for_each_record(spark, str(tmp_path / "none.fq"), visit)


def test_log_is_added_to_and_a_failed_addition_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/log"
    builder = IndexBuilder(spark, UNIT, path)
    builder.add(reads(spark, REP28))
    first = builder.into_index()
    before = sorted(files.names(spark, path))

    def broken(batches):
        yield from batches
        raise RuntimeError("lost")

    bad = reads(spark, OTHER).union(reads(spark, OTHER).mapInArrow(broken, "record_id long, sequence string"))
    with pytest.raises(Exception, match="lost"):
        builder.add(bad)
    assert sorted(files.names(spark, path)) == before and builder.inserted_kmers == 20
    # a driver that is lost before it publishes leaves a folder that no manifest names
    sketch.increments(reads(spark, OTHER), UNIT).write.parquet(f"{path}/addition-lost")
    assert rows(IndexBuilder.open(spark, path).into_index().counters) == rows(first.counters)
    again = IndexBuilder.open(spark, path)
    assert again.config == UNIT and again.add(reads(spark, OTHER, "ACG"))["records_processed"] == 2
    assert (builder.inserted_kmers, builder.inserted_smers) == (40, again.inserted_smers)
    both = again.into_index()
    assert rows(both.counters) == rows(SketchIndex.build(spark, reads(spark, REP28, OTHER), UNIT).counters) and both.inserted_kmers == 40
    # an index is frozen: later additions don't change it
    assert rows(first.counters) == rows(SketchIndex.build(spark, reads(spark, REP28), UNIT).counters)
    with pytest.raises(FileExistsError):
        IndexLog.create(spark, path, UNIT)
    # of two additions to the same state one is refused
    state = again.log.state()
    IndexLog._publish(spark, path, state["number"] + 1, {**state, "additions": []})
    with pytest.raises(FileExistsError):
        IndexLog._publish(spark, path, state["number"] + 1, state)
    again.drop()
    assert files.names(spark, path) == []
    with pytest.raises(IndexFormatError):
        IndexBuilder.open(spark, path)


def test_builder_settings(spark):
    builder = IndexBuilder(spark, UNIT)
    builder.set_threads(3)
    assert builder.threads == 3
    builder.clear_threads()
    assert builder.threads == SketchConfig().threads
    with pytest.raises(ValueError, match="thread"):
        builder.set_threads(0)
    empty = builder.into_index()
    assert empty.counters.count() == 0 and empty.estimates(reads(spark, REP28)).where("estimate <> 0").count() == 0
    assert [parse_counter_bits(x) for x in ("8", "16", "32")] == [8, 16, 32]
    for x in ("7", "", "08", "x"):
        with pytest.raises(ValueError, match="8, 16 or 32"):
            parse_counter_bits(x)


def test_index_rejections(spark, tmp_path):
    good = f"{tmp_path}/good"
    SketchIndex.build(spark, reads(spark, REP28, OTHER), UNIT).save(good)
    assert SketchIndex.load(spark, good).config == UNIT
    meta = json.loads((tmp_path / "good" / "meta.json").read_text())

    def changed(name, text=None, counters=None):
        at = tmp_path / name
        shutil.copytree(good, at)
        for crc in at.glob(".meta.json*.crc"):
            crc.unlink()
        if text is not None:
            (at / "meta.json").write_text(text)
        if counters is not None:
            shutil.rmtree(at / "counters")
            counters.write.parquet(f"{at}/counters")
        return str(at)

    own = SketchIndex.load(spark, good).packed
    short = own.selectExpr("part", "substring(counters, 1, 10) AS counters")
    bad = {
        "bytes": changed("bytes", "not an index"),
        "number": changed("number", "5"),
        "format": changed("format", json.dumps(meta | {"format": "x"})),
        "version": changed("version", json.dumps(meta | {"version": 1})),
        "no_config": changed("no_config", json.dumps({k: v for k, v in meta.items() if k != "config"})),
        "even": changed("even", json.dumps(meta | {"config": meta["config"] | {"k": 10}})),
        "unknown": changed("unknown", json.dumps(meta | {"config": meta["config"] | {"q": 1}})),
        "layout": changed("layout", json.dumps(meta | {"config": meta["config"] | {"counter_bits": 8}})),
        "slots": changed("slots", json.dumps(meta | {"config": meta["config"] | {"counter_slots_exponent": 8}})),
        "columns": changed("columns", counters=spark.range(3).selectExpr("id AS part")),
        "none": f"{tmp_path}/none",
    }
    for name, path in bad.items():
        with pytest.raises(IndexFormatError):
            SketchIndex.load(spark, path)
            raise AssertionError(name)
    for name, counters in (("short", short), ("part", own.selectExpr("part + 64 AS part", "counters")), ("twice", own.union(own)), ("null", own.selectExpr("cast(NULL AS int) AS part", "counters"))):
        # files without bucket numbers in their names can't be read as buckets
        at = tmp_path / f"c_{name}"
        SketchIndex(spark, UNIT, counters).save(str(at))
        with pytest.raises(IndexFormatError):
            SketchIndex.load(spark, str(at))


def test_histogram_is_bounded(spark):
    wide = SketchConfig(k=9, m=5, s=7, n_hashes=3, counter_bits=32, counter_slots_exponent=16, block_slots_exponent=6)
    index = SketchIndex.build(spark, reads(spark, *[REP28] * 9, OTHER), wide)
    whole = {r["counter_value"]: r["counters"] for r in index.counter_histogram().collect()}
    some = {r["counter_value"]: r["counters"] for r in index.counter_histogram(3).collect()}
    assert max(whole) > 4 and set(some) <= set(range(5)) and sum(some.values()) == sum(whole.values()) == wide.counter_slots
    assert some[4] == sum(n for v, n in whole.items() if v > 3) and all(some[v] == whole[v] for v in some if v < 4)


def test_compaction_is_read_and_replays_do_not_count_twice(spark, tmp_path):
    path = f"{tmp_path}/s"
    batches = [reads(spark, REP28), reads(spark, OTHER, "ACG"), reads(spark), reads(spark, REP28, REP28)]
    for n, batch in enumerate(batches):
        ingest.add_batch(batch, n, path, UNIT)
    whole = rows(SketchIndex.build(spark, reads(spark, REP28, OTHER, REP28, REP28), UNIT).counters)
    figures = ingest.ingested_totals(spark, path).first()
    assert rows(ingest.ingested(spark, path, UNIT)) == whole and figures["records_processed"] == 5
    ingest.compact(spark, path, 1, UNIT, delete=False)
    assert rows(ingest.ingested(spark, path, UNIT)) == whole  # though the batches still lie there
    ingest.add_batch(batches[1], 1, path, UNIT)  # a replay of a batch that is compacted
    ingest.add_batch(batches[3], 3, path, UNIT)  # and of one that isn't
    assert rows(ingest.ingested(spark, path, UNIT)) == whole
    ingest.compact(spark, path, 2, UNIT)
    assert files.names(spark, f"{path}/compacted") == ["upto=2"] and files.names(spark, f"{path}/batches") == ["batch_id=3"]
    assert rows(ingest.ingested(spark, path, UNIT)) == whole and ingest.ingested_totals(spark, path).first() == figures
    ingest.add_batch(reads(spark, OTHER), 4, path, UNIT)
    assert rows(ingest.ingested(spark, path, UNIT)) == rows(SketchIndex.build(spark, reads(spark, REP28, OTHER, REP28, REP28, OTHER), UNIT).counters)
    assert ingest.ingested(spark, f"{tmp_path}/none", UNIT).count() == 0
    # sums are kept beyond the width of a counter
    small = SketchConfig(k=9, m=5, s=7, n_hashes=3, counter_bits=8, counter_slots_exponent=16, block_slots_exponent=6)
    ingest.add_batch(reads(spark, *[REP28] * 20), 0, f"{path}2", small)
    ingest.compact(spark, f"{path}2", 0, small)
    ingest.add_batch(reads(spark, *[REP28] * 20), 1, f"{path}2", small)
    assert rows(ingest.ingested(spark, f"{path}2", small)) == rows(SketchIndex.build(spark, reads(spark, *[REP28] * 40), small).counters)
