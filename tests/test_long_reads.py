"""Reads that are cut, super-k-mers that are packed, and probes that meet packed counters."""

import resource

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandtally import SketchConfig
from strandtally.functions.hashing import mix64
from strandtally.operators import abundance as ab
from strandtally.operators import kernel, kmers, packing, sketch
from strandtally.plans.index import SketchIndex

BASES = "ACGT"
SHAPES = [
    SketchConfig(k=9, m=5, s=7, n_hashes=3, counter_slots_exponent=16, block_slots_exponent=6),
    SketchConfig(k=31, m=21, s=25, n_hashes=4, counter_slots_exponent=14, block_slots_exponent=7),
    SketchConfig(k=31, m=1, s=3, n_hashes=2, counter_bits=8, counter_slots_exponent=12, block_slots_exponent=11),
    SketchConfig(k=15, m=15, s=15, n_hashes=1, counter_bits=32, counter_slots_exponent=23, block_slots_exponent=0),
    SketchConfig(k=9, m=5, s=7, n_hashes=3, counter_slots_exponent=16, block_slots_exponent=6, segmentation="value"),
]


def reads(spark, *sequences, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(sequences)), sequences, strict=True)), "record_id long, sequence string")


def text(n, seed, letters="ACGT" * 12 + "Nacgt"):
    return "".join(np.random.default_rng(seed).choice(list(letters), n))


def code(w):
    return int(w.translate(str.maketrans("ACGT", "0123")), 4)


def canon(w):
    return min(code(w), code(w[::-1].translate(str.maketrans("ACGT", "TGCA"))))


def model(sequences, c):
    """Counters, figures, and the estimate of each window, by dictionaries, read by read."""
    mix = lambda x: int(mix64(np.array([x], np.uint64))[0])
    slots = lambda x: [h & (c.block_slots - 1) for h in chain(x)]

    def chain(x):
        for _ in range(c.n_hashes):
            x = mix(x)
            yield x

    memo = {}

    def slots_of(w):
        if w not in memo:
            memo[w] = slots(canon(w))
        return memo[w]

    hashes = {}

    def hash_of(w):
        if w not in hashes:
            hashes[w] = mix(canon(w))
        return hashes[w]

    def minimizer(w):
        h = [hash_of(w[j : j + c.m]) for j in range(c.k - c.m + 1)]
        at = [j for j, x in enumerate(h) if x == min(h)]
        own = code(w) <= code(w[::-1].translate(str.maketrans("ACGT", "TGCA")))
        return at[0] if own else at[-1], min(h)

    counters, supers, figures = {}, [], dict.fromkeys(sketch.TOTALS, 0)
    for r, t in enumerate(sequences):
        t = (t or "").upper()
        figures["records_processed"] += 1
        last, n = None, 0
        for i in range(len(t) - c.k + 1):
            w = t[i : i + c.k]
            if set(w) - set(BASES):
                last = None
                continue
            place, h = minimizer(w)
            mark = h if c.segmentation == "value" else i + place
            new = last != mark
            figures["chunks"] += last is None
            last = mark
            n += 1
            block = h & (c.blocks - 1)
            if new:
                supers.append([r, i, 0, block])
            supers[-1][2] += 1
            for j in range(c.k - c.s + 1) if new else [c.k - c.s]:
                figures["inserted_smers"] += 1
                for x in slots_of(w[j : j + c.s]):
                    counters[block, x] = counters.get((block, x), 0) + 1
        figures["inserted_kmers"] += n
        figures["records_indexed"] += n > 0
    figures["super_kmers"] = len(supers)
    counters = {k: min(v, c.counter_max) for k, v in counters.items()}

    def estimate(w):
        block = minimizer(w)[1] & (c.blocks - 1)
        return min(counters.get((block, x), 0) for j in range(c.k - c.s + 1) for x in slots_of(w[j : j + c.s]))

    windows = []
    for r, t in enumerate(sequences):
        t = (t or "").upper()
        for i in range(len(t) - c.k + 1):
            w = t[i : i + c.k]
            windows.append((r, i, None if set(w) - set(BASES) else estimate(w)))
    return counters, supers, figures, windows


@pytest.mark.parametrize("shape", range(len(SHAPES)))
@pytest.mark.parametrize("piece", [1 << 21, 40, 3])
def test_cut_reads_equal_whole_ones(spark, monkeypatch, shape, piece):
    monkeypatch.setattr(kernel, "PIECE_WINDOWS", piece)
    c = SHAPES[shape]
    sequences = [text(300, 1), "", None, "A" * 90, "ACGT" * 30, text(7, 2), text(120, 3, "ACGT"), "N" * 50 + text(60, 4) + "N", text(40, 5, "ACGT")]
    own = reads(spark, *sequences).coalesce(1)
    counters, supers, figures, windows = model(sequences, c)
    index = SketchIndex.build(spark, own, c)
    assert {(r["block"], r["slot"]): r["cnt"] for r in index.counters.collect()} == counters
    assert sorted(list(r) for r in kmers.super_kmers(own, c).collect()) == sorted(supers)
    assert sketch.inserted_totals(own, c).first().asDict() == figures == sketch.totals(sketch.increments(own, c)).first().asDict()
    assert sorted(((r[0], r[1]) for r in kmers.windows(own, c.k).collect())) == [w[:2] for w in windows]
    found = sorted((tuple(r) for r in index.abundances(own).collect()), key=lambda r: r[:2])
    assert found == windows
    exact = {}
    for t in sequences:
        for i in range(len(t or "") - c.k + 1):
            w = t[i : i + c.k].upper()
            if not set(w) - set(BASES):
                exact[canon(w)] = exact.get(canon(w), 0) + 1
    assert {r["kmer"]: r["n"] for r in kmers.kmer_counts(own, c.k).collect()} == exact
    best = {}
    for r, i, v in windows:
        if v is not None:
            best[canon(sequences[r][i : i + c.k].upper())] = v
    assert {r["kmer"]: (r["n"], r["estimate"]) for r in index.estimates(own).collect()} == {w: (exact[w], v) for w, v in best.items()}


@pytest.mark.parametrize("piece", [1 << 21, 10])
def test_summaries_equal_those_of_the_windows(spark, monkeypatch, piece):
    monkeypatch.setattr(kernel, "PIECE_WINDOWS", piece)
    sequences = [text(200, 7), "NNN", "ACGT" * 20, None, text(30, 8, "ACGT"), text(50, 8, "ACGT")]
    own = reads(spark, *sequences, ids=[5, 6, None, 7, None, 5]).repartition(3)
    index = SketchIndex.build(spark, own, SHAPES[0])
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(index.summaries(own)) == rows(ab.sequence_summary(own, index.abundances(own)))


@pytest.mark.parametrize("width", [1, 2, 5, 16, 31, 32])
def test_packed_records_come_back(width):
    k = max(width, 9)
    layout = packing.Layout(k, max(1, k - 4), 300)
    base = np.frombuffer(text(4000, 11, "ACGT").encode(), np.uint8)
    scan = kernel.Scan(base, np.array([0, 1500, 1502, 4000]), k)
    first, size, hashes = packing.cut(scan, layout.m)
    records = packing.Records(layout)
    part, block = (hashes % np.uint64(7)).astype(np.int32), (hashes % np.uint64(300)).astype(np.int64)
    records.add(part, block, size, packing.lanes(scan, first, size, layout))
    records.add(part, block, size, packing.lanes(scan, first, size, layout))
    parts, blobs, counts = records.rows()
    n = np.frombuffer(b"".join(counts.to_pylist()), np.uint32)
    opened = packing.Opened(np.frombuffer(b"".join(blobs.to_pylist()), np.uint8), layout)
    assert parts.tolist() == sorted(set(part.tolist())) and n.sum() == 2 * len(first) and len(n) < 2 * len(first)
    assert set(zip(opened.size.tolist(), opened.block.tolist(), strict=True)) == set(zip(size.tolist(), block.tolist(), strict=True))
    found, record, _ = opened.codes(width)
    got = {}
    for key, x in zip(found.tolist(), n[record].tolist(), strict=True):
        got[key] = got.get(key, 0) + x
    want = {}
    for a, b in zip(first, size, strict=True):
        own = base[scan.at[a] : scan.at[a] + b + k - 1].tobytes().decode()
        for i in range(len(own) - width + 1):
            want[canon(own[i : i + width])] = want.get(canon(own[i : i + width]), 0) + 2
    assert got == want


def test_parts_that_arrive_in_portions_are_counted_whole(spark, monkeypatch):
    """A few bytes at a time, from several tasks: one part's rows in many portions."""
    whole = packing.whole_parts
    monkeypatch.setattr(kmers, "whole_parts", lambda batches: whole(batches, 16))
    monkeypatch.setattr(sketch, "whole_parts", lambda batches: whole(batches, 16))
    sequences = [text(200, 20 + i, "ACGT") for i in range(6)] + ["A" * 100] * 4
    own = reads(spark, *sequences).repartition(5)
    exact = {}
    for t in sequences:
        for i in range(len(t) - 8):
            exact[canon(t[i : i + 9])] = exact.get(canon(t[i : i + 9]), 0) + 1
    assert {r["kmer"]: r["n"] for r in kmers.kmer_counts(own, 9).collect()} == exact
    found = {r["kmer"]: r for r in SketchIndex.build(spark, own, SHAPES[0]).estimates(own).collect()}
    assert {w: r["n"] for w, r in found.items()} == exact and all(found[w]["estimate"] >= n for w, n in exact.items())


def test_rows_of_a_part_stay_together():
    rng = np.random.default_rng(3)
    parts = np.sort(rng.integers(0, 9, 200))
    blobs = [bytes([i % 251]) * int(rng.integers(1, 30)) for i in range(200)]
    rows = pa.RecordBatch.from_arrays([pa.array(parts), pa.array(blobs, pa.binary())], names=["part", "records"])
    cuts = sorted({0, 200, *rng.integers(0, 200, 9).tolist()})
    got, open_parts, done = [], set(), set()
    for whole, some in packing.whole_parts((rows.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)), 40):
        own = [x for r in some for x in r.column(0).to_pylist()]
        assert not set(own) & done
        got += [x for r in some for x in r.column(1).to_pylist()]
        open_parts |= set(own)
        if whole:
            done, open_parts = done | open_parts, set()
    assert got == blobs and not open_parts


def test_long_read_in_bounded_memory(spark):
    """50 million bases: Python holds pieces, never the read's arrays."""
    own = spark.range(1, numPartitions=1).select(F.lit(1).cast("long").alias("record_id"), F.expr("repeat('ACGTTGCATGTCAGTACGATCGTACGTTAGCAGGCTTAACC', cast(1250000 + id as int))").alias("sequence"))
    c = SHAPES[1]

    def peak(batches):
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        n = 0
        for batch in batches:
            for _, _, scan in kernel.scans(batch, c.k):
                kernel.inserted(scan, c)
                n += int(scan.valid.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024])], names=["n", "mb"])

    row = kernel.pieces(own, c.k).mapInArrow(peak, "n long, mb long").first()
    assert row["n"] == 1250000 * 41 - c.k + 1
    assert row["mb"] < 1500
    figures = sketch.inserted_totals(own, c).first()
    assert (figures["records_processed"], figures["records_indexed"], figures["chunks"]) == (1, 1, 1)
    assert figures["inserted_kmers"] == row["n"]


def test_probes_are_exchanged_once_and_a_stored_index_not_at_all(spark, tmp_path):
    own = reads(spark, *[text(300, 30 + i) for i in range(5)])
    index = SketchIndex.build(spark, own, SHAPES[0])
    index.save(f"{tmp_path}/i")
    again = SketchIndex.load(spark, f"{tmp_path}/i")
    plan = again.estimates(own)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1, plan
    assert "Bucketed: true" in plan
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    assert rows(again.estimates(own)) == rows(index.estimates(own))
    assert rows(again.abundances(own.where("record_id < 3"))) == rows(index.abundances(own.where("record_id < 3")))


def test_repeated_reads_are_summed_before_they_move(spark):
    """Of a group of copies each task sends every super-k-mer once, with a count."""
    one = text(200, 40, "ACGT")
    own = reads(spark, *[one] * 600, *[text(200, 50 + i, "ACGT") for i in range(5)]).repartition(4)
    c = SHAPES[0]
    size = sketch.sketch_layout(c).size
    alone = sketch.probes(reads(spark, one), c).agg(F.sum(F.octet_length("records"))).first()[0] // size
    rest = sketch.probes(own.where("record_id >= 600").coalesce(1), c).agg(F.sum(F.octet_length("records"))).first()[0] // size
    sent = sketch.probes(own, c).agg(F.sum(F.octet_length("records"))).first()[0] // size
    assert sent <= 4 * (alone + rest)
    found = SketchIndex.build(spark, own, c).estimates(own)
    assert found.agg(F.sum("n")).first()[0] == 605 * 192 and found.where("estimate < n").count() == 0


def test_parts_that_an_index_lacks_have_no_counts(spark):
    few = reads(spark, text(30, 60, "ACGT"))
    many = reads(spark, *[text(2000, 70 + i, "ACGT") for i in range(3)])
    index = SketchIndex.build(spark, few, SHAPES[0])
    known = {(r["block"], r["slot"]) for r in index.counters.collect()}
    found = index.estimates(many).collect()
    assert len(known) < 150 and len(found) > 5000 and sum(r["estimate"] == 0 for r in found) > 0.9 * len(found)
    assert all(r["estimate"] > 0 for r in index.estimates(few).collect())
