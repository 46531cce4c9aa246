"""Command line: build, query, spectrum and their variants.

python -m strandtally.cli spectrum reads.fa --spectrum-out out
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandtally.config import SketchConfig, parse_counter_bits
from strandtally.operators import sketch, spectrum
from strandtally.plans.index import IndexBuilder, SketchIndex
from strandtally.sources import sinks
from strandtally.sources.fastx import read_fastx


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandtally")
    commands = top.add_subparsers(dest="command", required=True)
    shape = argparse.ArgumentParser(add_help=False)
    d = SketchConfig()
    for flag, name, default in (("-k", "k", d.k), ("-m", "m", d.m), ("-s", "s", d.s), ("--n-hashes", "n_hashes", d.n_hashes), ("--counter-slots-exponent", "counter_slots_exponent", d.counter_slots_exponent), ("--block-slots-exponent", "block_slots_exponent", d.block_slots_exponent), ("--threads", "threads", d.threads), ("--queue", "queue", d.queue)):
        shape.add_argument(flag, dest=name, type=int, default=default)
    shape.add_argument("--counter-bits", type=parse_counter_bits, default=d.counter_bits)
    one = commands.add_parser("spectrum", parents=[shape])
    one.add_argument("input")
    one.add_argument("--query-input")
    one.add_argument("--stream-query-only", action="store_true")
    one.add_argument("--spectrum-out")
    build = commands.add_parser("build-index", parents=[shape])
    build.add_argument("input")
    build.add_argument("output")
    query = commands.add_parser("query-index")
    query.add_argument("index")
    query.add_argument("query")
    query.add_argument("-o", "--output", required=True)
    query.add_argument("--mode", choices=("report", "fast", "slow"), default="fast")
    both = commands.add_parser("query-abundance", parents=[shape])
    both.add_argument("index")
    both.add_argument("query")
    both.add_argument("-o", "--output", required=True)
    both.add_argument("--mode", choices=("fast", "slow"), default="fast")
    keyless = commands.add_parser("filter-spectrum", parents=[shape])
    keyless.add_argument("input")
    keyless.add_argument("-o", "--output", required=True)
    keyless.add_argument("--counter-histogram")
    keyless.add_argument("--max-abundance", type=int, default=255)
    keyless.add_argument("--kmer-count-hint", type=int)
    sampled = commands.add_parser("sampled-spectrum", parents=[shape])
    sampled.add_argument("input")
    sampled.add_argument("-o", "--output", required=True)
    sampled.add_argument("--sample-size", type=int, default=1_000_000)
    sampled.add_argument("--seed", type=int, default=1)
    return top


def config_of(a: argparse.Namespace) -> SketchConfig:
    return SketchConfig(a.k, a.m, a.s, a.n_hashes, a.counter_bits, a.counter_slots_exponent, a.block_slots_exponent, a.threads, a.queue)


def answer(index: SketchIndex, spark: SparkSession, a: argparse.Namespace) -> None:
    reads = read_fastx(spark, a.query)
    if a.mode == "report":
        sinks.write_csv(index.report(reads), a.output, single=True)
    elif a.mode == "fast":
        sinks.write_csv(sinks.fast_rows(index.summaries(reads), reads), a.output)
    else:
        sinks.write_csv(sinks.slow_rows(index.abundances(reads), reads), a.output)


def run_spectrum(index: SketchIndex, reads: DataFrame, asked: DataFrame, a: argparse.Namespace) -> None:
    """The spectrum (unless only stream figures are asked for) and a line of figures, each part timed as it is made."""
    times = [time.time()]
    built = sketch.inserted_totals(reads, index.config).first()
    index.packed.count()
    times.append(time.time())
    # at most a row for each abundance
    found = spectrum.spectrum_totals(index.estimates(asked)).persist()
    v, n = F.col("estimated_count"), F.col("windows")
    sums = found.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("long") for x in (n, F.when(v > 0, n), (v * n).cast("decimal(38,0)"), F.col("kmers"))]).first()
    times.append(time.time())
    if not a.stream_query_only:
        sinks.write_spectrum(found, a.spectrum_out)
    times.append(time.time())
    found.unpersist()
    row = {"chunks": built["chunks"], "indexed_kmers": built["inserted_kmers"], "queried_kmers": sums[0], "positive_estimates": sums[1], "inserted_smers": built["inserted_smers"]}
    row |= {"estimate_checksum": sums[2]} if a.stream_query_only else {"distinct_keys": sums[3]}
    row |= {"counter_bits": index.config.counter_bits, "counter_slots": index.config.counter_slots, "blocks": index.config.blocks}
    spent = dict(zip(("build_s", "query_s", "spectrum_s"), [y - x for x, y in zip(times, times[1:], strict=False)], strict=True)) | {"total_s": times[-1] - times[0]}
    if a.stream_query_only:
        del spent["spectrum_s"]
    sinks.metrics_line(row | {k: f"{x:.3f}" for k, x in spent.items()})


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("strandtally").getOrCreate()
    if a.command == "build-index":
        builder = IndexBuilder(spark, config_of(a))
        report = builder.add_file(a.input)
        builder.into_index().save(a.output)
        sinks.metrics_line(report)
    elif a.command == "query-index":
        answer(SketchIndex.load(spark, a.index), spark, a)
    elif a.command == "query-abundance":
        answer(SketchIndex.build(spark, read_fastx(spark, a.index), config_of(a)), spark, a)
    else:
        reads = read_fastx(spark, a.input)
        index = SketchIndex.build(spark, reads, config_of(a))
        index.packed = index.packed.persist()
        if a.command == "filter-spectrum":
            if a.counter_histogram:
                sinks.write_csv(index.counter_histogram(), a.counter_histogram, single=True)
            print("warning: spectra from the counters alone follow a model; they don't replace spectra of k-mers", file=sys.stderr)
            sinks.write_csv(index.filter_only_spectrum(a.max_abundance, a.kmer_count_hint), a.output, single=True)
        elif a.command == "sampled-spectrum":
            index.inserted_kmers = sketch.inserted_totals(reads, index.config).first()["inserted_kmers"]
            began = time.time()
            found, figures = index.sampled(reads, a.sample_size, a.seed)
            # at most a row for each abundance
            found = found.persist()
            queried = found.agg(F.coalesce(F.sum("sampled_kmers"), F.lit(0))).first()[0]
            sinks.write_csv(found, a.output, single=True)
            found.unpersist()
            sinks.metrics_line(figures | {"queried_kmers": queried, "invalid_queries": figures["sampled_kmers"] - queried, "query_s": f"{time.time() - began:.3f}"})
        else:
            asked = read_fastx(spark, a.query_input) if a.query_input else reads
            run_spectrum(index, reads, asked, a)
        index.packed.unpersist()
    return 0


if __name__ == "__main__":
    sys.exit(main())
