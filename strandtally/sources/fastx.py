"""FASTA and FASTQ: a data source whose splits find record starts by themselves, and a reader through Spark's text files.

    spark.dataSource.register(FastxSource)
    spark.read.format("fastx").load(path)      # record_id, name, sequence

A split reads the records that begin in it, to their ends, so files of any size are read in parallel without a shuffle or a
count before.  It opens what pyarrow's file systems open (local files, s3, gs, hdfs); other stores are read through Spark's
text reader, which has to shuffle FASTQ.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandtally.functions.dna import record_name

SCHEMA = "record_id long, name string, sequence string"
BLOCK = 1 << 20
SPLIT_BYTES = 64 << 20
#: a record's id is its file's number, shifted, plus the offset of its first byte
FILE_SHIFT = 40
BATCH_BYTES = 8 << 20
KNOWN_SCHEMES = ("file", "s3", "gs", "gcs", "hdfs")
#: bases and gaps as sequence lines have them; quality lines often don't consist of these alone
_BASES = re.compile(rb"[A-Za-z*.\-]*\Z")
#: records that have to follow each other from what is taken for a record's start
CHAIN = 4


class Lines:
    """Lines of a file from an offset on, with their offsets; a bounded part of the file is held."""

    def __init__(self, file: pa.NativeFile, start: int = 0, seekable: bool = True):
        self.file, self.at = file, start
        if seekable:
            file.seek(start)
        self.held = b""
        self.ended = False

    def next(self) -> tuple[int, bytes, bool] | None:
        """(offset, line without its end, whether it ends with a line break); None at the end."""
        parts = [self.held]
        cut = self.held.find(b"\n")
        while cut < 0 and not self.ended:
            block = self.file.read(BLOCK)
            self.ended = not block
            cut = block.find(b"\n")
            parts.append(block)
            if cut >= 0:
                cut += sum(map(len, parts[:-1]))
        data = b"".join(parts) if len(parts) > 1 else self.held
        if not data:
            return None
        line = data if cut < 0 else data[:cut]
        self.held = b"" if cut < 0 else data[cut + 1 :]
        offset, whole = self.at, cut >= 0
        self.at += len(line) + whole
        return offset, line.rstrip(b"\r"), whole

    def __iter__(self) -> Iterator[tuple[int, bytes, bool]]:
        while (line := self.next()) is not None:
            yield line


def fasta_records(lines: Iterator[tuple[int, bytes, bool]], end: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, header, sequence) of the records whose header begins before the end; blanks in sequences are dropped."""
    at, header, body = -1, b"", []
    for offset, line, _ in lines:
        if line.startswith(b">"):
            if at >= 0:
                yield at, header, b"".join(body)
            at = -1
            if offset >= end:
                return
            at, header, body = offset, line[1:], []
        elif at >= 0:
            body.append(line.translate(None, b" \t\r\v\f"))
    if at >= 0:
        yield at, header, b"".join(body)


def fastq_record(first: tuple[int, bytes, bool], more: Callable[[], tuple[int, bytes, bool] | None], strict: bool = False) -> tuple[int, bytes, bytes] | None:
    """(offset, header, sequence) of the record whose header line is given, its quality read to its end; None if it isn't one, or (unless strict) if the file ends before its quality."""
    body = []
    while True:
        line = more()
        if line is None:
            return None if strict or not body else (first[0], first[1][1:], b"".join(body))
        if line[1].startswith(b"+"):
            break
        if strict and not _BASES.match(line[1]):
            return None
        body.append(line[1].translate(None, b" \t\r\v\f"))
    sequence = b"".join(body)
    left, some = len(sequence), False
    while left > 0 or not some:
        line = more()
        if line is None:
            return None if strict and left > 0 else (first[0], first[1][1:], sequence)
        left, some = left - len(line[1]), True
    return None if strict and left < 0 else (first[0], first[1][1:], sequence)


def fastq_records(lines: Lines, end: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, header, sequence) of the records that begin before the end, from a record's start on."""
    while (line := lines.next()) is not None and line[0] < end:
        if not line[1].startswith(b"@"):
            if line[1]:
                raise ValueError(f"no FASTQ record at byte {line[0]}")
            continue
        found = fastq_record(line, lines.next)
        if found:
            yield found


def fastq_start(open_at: Callable[[int], Lines], start: int, end: int) -> int:
    """Where the first record at or after an offset begins; end if none does before that.

    A line that begins with @ may be one of qualities.  It is taken for a header if CHAIN records (or all to the file's end) follow from it: lines of
    bases, a line that begins with +, and as many qualities as bases, up to a line that begins with @.
    """
    if start == 0:
        return 0
    lines = open_at(start - 1)
    lines.next()  # what is left of the line before
    while (line := lines.next()) is not None and line[0] < end:
        if not line[1].startswith(b"@"):
            continue
        again = open_at(line[0])
        good, head = 0, again.next()
        while good < CHAIN and head is not None:
            if not head[1].startswith(b"@") or fastq_record(head, again.next, strict=True) is None:
                break
            good += 1
            head = again.next()
            while head is not None and not head[1]:
                head = again.next()
        if good == CHAIN or head is None and good:
            return line[0]
    return end


class Split(InputPartition):
    def __init__(self, number: int, uri: str, start: int, end: int):
        self.number, self.uri, self.start, self.end = number, uri, start, end


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9]+:", uri) else (pafs.LocalFileSystem(), uri)


def compressed(path: str) -> bool:
    return path.endswith((".gz", ".bz2", ".zst"))


class FastxReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Split]:
        store, path = opened(self.path)
        info = store.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [x for x in store.get_file_info(pafs.FileSelector(path, recursive=True)) if x.is_file and not x.base_name.startswith((".", "_"))]
        out = []
        for number, x in enumerate(sorted(found, key=lambda x: x.path)):
            # a compressed file is one split
            size = max(x.size, 1) if compressed(x.path) else self.split
            out += [Split(number, x.path, at, min(at + size, x.size)) for at in range(0, max(x.size, 1), size)]
        return out

    def open_at(self, uri: str, offset: int) -> Lines:
        store, _ = opened(self.path)
        if compressed(uri):
            return Lines(store.open_input_stream(uri, compression="detect"), 0, seekable=False)
        return Lines(store.open_input_file(uri), offset)

    def kind(self, uri: str) -> bytes | None:
        """> or @, by the file's first line that isn't blank; None if there is none."""
        kind = next((line[1].strip()[:1] for line in self.open_at(uri, 0) if line[1].strip()), None)
        if kind not in (b">", b"@", None):
            raise ValueError("neither FASTA nor FASTQ")
        return kind

    def check(self) -> None:
        """Looks at the first file, so that a wrong path or format is told at once."""
        for part in self.partitions()[:1]:
            self.kind(part.uri)

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        end = 1 << 62 if compressed(part.uri) else part.end
        kind = self.kind(part.uri)
        if kind is None:
            return

        def open_at(offset: int) -> Lines:
            return self.open_at(part.uri, offset)

        if kind == b">":
            lines = open_at(max(part.start - 1, 0))
            if part.start:
                lines.next()  # what is left of the line before
            rows = fasta_records(lines, end)
        else:
            start = fastq_start(open_at, part.start, end)
            rows = fastq_records(open_at(start), end) if start < end else iter(())
        ordinal: int | None = 0 if part.start == 0 else None  # records of the file before the next one, where that is known
        ids, names, sequences, size = [], [], [], 0
        for offset, header, sequence in rows:
            name = (re.match(rb"\S+", header) or [b""])[0].decode(errors="replace")
            if not name:
                if ordinal is None:  # blank headers are rare: only for these are the records before counted
                    lines = open_at(0)
                    ordinal = sum(1 for _ in (fasta_records(lines, offset) if kind == b">" else fastq_records(lines, offset)))
                name = f"record_{ordinal + 1}"
            ordinal = None if ordinal is None else ordinal + 1
            ids.append((part.number << FILE_SHIFT) + offset)
            names.append(name)
            sequences.append(sequence.decode(errors="replace"))
            size += len(sequence) + 64
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(sequences, pa.string())], names=["record_id", "name", "sequence"])
                ids, names, sequences, size = [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(sequences, pa.string())], names=["record_id", "name", "sequence"])


class FastxSource(DataSource):
    """Options: path (a file, or a folder whose files are read in order of their names), split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return FastxReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


def records(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """reads(record_id, name, sequence) in the order of the file: ids are ascending and the same for any size of splits, but not consecutive."""
    scheme = re.match(r"([a-z0-9]+):", path)
    if scheme and scheme[1] not in KNOWN_SCHEMES or "*" in path:
        return read_text_fastx(spark, path)
    spark.dataSource.register(FastxSource)
    FastxReader(path, split_bytes).check()
    return spark.read.format("fastx").option("split_bytes", split_bytes).load(path)


def for_each_record(spark: SparkSession, path: str, visit: Callable[[str, str], None], split_bytes: int = SPLIT_BYTES) -> int:
    """Calls visit(name, sequence) on the driver for each record in the order of the file, one split at a time; returns how many there were.

    The first error that visit raises ends it: it is raised again, and splits after the present one are not read.
    """
    n = 0
    for row in records(spark, path, split_bytes).select("name", "sequence").toLocalIterator():
        visit(row["name"], row["sequence"])
        n += 1
    return n


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with 0-based numbers in file order: the offset of each partition, from a row for each, plus the place in it."""
    marked = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))  # a row for each partition
    return marked.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_start")


def read_fastx(spark: SparkSession, path: str) -> DataFrame:
    """records() with ids from 0 on, for which they are counted first."""
    return _numbered(records(spark, path).drop("record_id"), "record_id").select("record_id", "name", "sequence")


def read_text_fasta(spark: SparkSession, path: str) -> DataFrame:
    """reads(record_id, name, sequence) in file order; line ends and \\r are dropped."""
    rows = spark.read.option("lineSep", "\n>").text(path).where(F.regexp_replace("value", r"[\r\n]", "") != "")
    rows = _numbered(rows.withColumn("value", F.regexp_replace("value", "^>", "")), "record_id")
    header = F.regexp_replace(F.substring_index("value", "\n", 1), r"\r$", "")
    body = F.when(F.contains(F.col("value"), F.lit("\n")), F.expr("substr(value, instr(value, '\n') + 1)")).otherwise(F.lit(""))
    return rows.select("record_id", record_name(header, F.col("record_id") + 1).alias("name"), F.regexp_replace(body, r"\s", "").alias("sequence"))


def read_text_fastq(spark: SparkSession, path: str) -> DataFrame:
    """reads(record_id, name, sequence) of four-line records; qualities are ignored."""
    lines = _numbered(spark.read.text(path), "line").withColumn("value", F.regexp_replace("value", r"\r$", ""))
    part = F.col("line") % 4
    found = lines.where(part < 2).groupBy(F.floor(F.col("line") / 4).alias("record_id")).agg(F.max(F.when(part == 0, F.col("value"))).alias("header"), F.max(F.when(part == 1, F.col("value"))).alias("sequence"))
    named = found.where("header <> ''")
    return named.select("record_id", record_name(F.expr("substr(header, 2)"), F.col("record_id") + 1).alias("name"), F.trim(F.coalesce("sequence", F.lit(""))).alias("sequence"))


def read_text_fastx(spark: SparkSession, path: str) -> DataFrame:
    """FASTA or FASTQ, by the first character, through Spark's text reader."""
    first = spark.read.text(path).where("value <> ''").head(1)
    if not first:
        return spark.createDataFrame([], SCHEMA)
    kind = first[0]["value"][0]
    if kind == ">":
        return read_text_fasta(spark, path)
    if kind == "@":
        return read_text_fastq(spark, path)
    raise ValueError("neither FASTA nor FASTQ")


def chunks(reads: DataFrame, k: int) -> DataFrame:
    """(record_id, run_start, run): what is left of the reads when all but runs of k valid bases or more are skipped."""
    from strandtally.operators.kmers import valid_runs

    return valid_runs(reads, k)


def reads_of_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """reads(record_id, sequence) from ordinary text."""
    from strandtally.functions.dna import text_as_dna

    return df.select(F.col(id_col).cast("long").alias("record_id"), text_as_dna(F.coalesce(F.col(text_col), F.lit(""))).alias("sequence"))
