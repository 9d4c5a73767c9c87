"""Indexed files: each record is filed under an index string; a manifest names the byte ranges of every index entry."""

from __future__ import annotations

import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from ..operators.pairjoin import pair_join

MANIFEST = "index string, path string, segments array<struct<off:bigint,len:bigint>>"


def text_manifest(rows: DataFrame, index: Column, value: Column, file: Column, order: list[Column]) -> DataFrame:
    """(index, path, off, len) that an indexed text file of these rows would have: values and newlines one after another in
    each file. A null value still takes its newline; a row whose index and value are both null takes nothing."""
    slim = rows.select(file.alias("path"), index.alias("index"), value.cast("string").alias("v"), F.struct(*order).alias("o")).filter("index is not null or v is not null")
    size = F.octet_length(F.coalesce("v", F.lit(""))) + 1
    before = Window.partitionBy("path").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    return slim.select("index", "path", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("bigint").alias("off"), size.cast("bigint").alias("len"))


def _codec(name: str | None) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    """(pack, unpack) of one record."""
    if name is None:
        return bytes, bytes
    if name == "zlib":
        return zlib.compress, zlib.decompress
    if name == "zstd":
        return zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
    raise ValueError(f"codec {name!r}")


def write_indexed(rows: DataFrame, index: str, value: str, path: str, newline: bool = True, codec: str | None = None, flush: int = 65536) -> DataFrame:
    """Write the values of each partition into one file (text with newlines, or raw bytes) under `path`; the manifest
    (index, path, segments) with every index entry's byte ranges, also kept as Parquet in path/_manifest. With a codec (zlib, zstd) every
    record is packed by itself, so a byte range can still be read alone. Entries leave a task as they come, `flush` at a time."""
    slim = rows.select(F.col(index).cast("string").alias("index"), F.col(value).alias("value"))
    tail = b"\n" if newline else b""
    _codec(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = pafs.FileSystem.from_uri(path)
        fs.create_dir(inner, recursive=True)
        task, pack = TaskContext.get(), _codec(codec)[0]
        name = f"part-{task.partitionId():05d}"
        own = f"{inner}/{name}.{task.taskAttemptId()}"
        entries, at = [], 0

        def listed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in entries], pa.string()), pa.array([f"{path}/{name}"] * len(entries), pa.string()), pa.array([e[1] for e in entries], pa.int64()), pa.array([e[2] for e in entries], pa.int64())], ["index", "path", "off", "len"])

        with fs.open_output_stream(own) as out:
            for batch in batches:
                for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if k is None and v is None:
                        continue
                    data = pack((v.encode() if isinstance(v, str) else v or b"") + tail)
                    out.write(data)
                    entries.append((k, at, len(data)))
                    at += len(data)
                    if len(entries) >= flush:
                        yield listed()
                        entries.clear()
        fs.move(own, f"{inner}/{name}")
        yield listed()

    slim.mapInArrow(run, "index string, path string, off bigint, len bigint").write.parquet(f"{path}/_manifest")
    return read_manifest(rows.sparkSession, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(index, path, segments), the byte ranges of each index entry in file order."""
    rows = spark.read.parquet(f"{path}/_manifest")
    return rows.groupBy("index", "path").agg(F.array_sort(F.collect_list(F.struct("off", "len"))).alias("segments"))


def file_index(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Each file as one index entry, its name, with one segment, the whole file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("index"), "path", F.array(F.struct(F.lit(0).cast("bigint").alias("off"), F.col("length").alias("len"))).alias("segments"))


def read_segments(manifest: DataFrame, codec: str | None = None) -> DataFrame:
    """(index, path, off, data, ms): the bytes of every segment, unpacked, and the time that reading it took. A batch is passed on for
    each index entry, so memory holds one entry's segments."""
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _codec(codec)[1]
        for batch in batches:
            for index, path, segments in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, inner = pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                out: list[list] = [[] for _ in kinds]
                with fs.open_input_file(inner) as f:
                    for s in segments:
                        began = time.perf_counter()
                        data = f.read_at(s["len"], s["off"])
                        took = 1000 * (time.perf_counter() - began)
                        for column, x in zip(out, (index, path, s["off"], unpack(data), took), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["index", "path", "off", "data", "ms"])

    return manifest.select("index", "path", "segments").mapInArrow(run, "index string, path string, off bigint, data binary, ms double")


def bandwidth(read: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, segments, bytes, ms, mb_per_s) of read_segments: sums over all readers, and the average bandwidth of one."""
    sums = read.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("segments"), F.sum(F.octet_length("data")).alias("bytes"), F.sum("ms").alias("ms"))
    return sums.withColumn("mb_per_s", F.try_divide(F.col("bytes") / 1e6, F.col("ms") / 1000))


def plan_pairs(left: DataFrame, right: DataFrame | None = None, on: Callable[[DataFrame, DataFrame], Column] | None = None, mode: str = "bipartite") -> DataFrame:
    """The pairs of index entries of two manifests that a predicate accepts, planned from the manifests alone, without reading data:
    (l_index, l_path, l_segments, l_bytes, r_*), one row a task. `half`: pairs of one manifest, earlier index first."""
    size = F.aggregate("segments", F.lit(0).cast("bigint"), lambda a, s: a + s["len"])
    sized = [None if m is None else m.select("index", "path", "segments", size.alias("bytes")) for m in (left, right)]
    return pair_join(sized[0], sized[1], on, mode, order="index")


def block_meets(a: DataFrame, b: DataFrame) -> Column:
    """A matrix block `edge TAB row TAB col` meets the vector block `node TAB col`. Index strings of another arity, of another first word, or
    whose numbers cannot be read meet nothing."""
    x, y = F.split(a["l_index"], "\t", -1), F.split(b["r_index"], "\t", -1)
    col, block = F.try_element_at(x, F.lit(3)).try_cast("int"), F.try_element_at(y, F.lit(2)).try_cast("int")
    whole = (F.size(x) == 3) & (x[0] == "edge") & (F.size(y) == 2) & (y[0] == "node") & F.try_element_at(x, F.lit(2)).try_cast("int").isNotNull()
    return F.coalesce(whole & (col == block), F.lit(False))


#: Fixed values of the binary index form: marks before an entry, after it, and before each of its byte ranges.
ENTRY_MARK, RANGE_MARK = b"#IDX#", b"#SEG#"


def _vint(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length integer: one byte from -112 on is the value; lower ones say how many bytes follow."""
    first = int.from_bytes(data[at : at + 1], "big", signed=True)
    if first >= -112:
        return first, at + 1
    n, flip = (-112 - first, 0) if first >= -120 else (-120 - first, -1)
    return int.from_bytes(data[at + 1 : at + 1 + n], "big") ^ flip, at + 1 + n


def parse_index(data: bytes) -> list[tuple[str, list[tuple[int, int]]]]:
    """Entries (index, byte ranges) of a binary index file. A wrong mark is an error; an entry cut off at the end is dropped."""
    out, at = [], 0
    while at + len(ENTRY_MARK) <= len(data):
        if data[at : at + 5] != ENTRY_MARK:
            raise ValueError(f"no entry at byte {at}")
        size, at = _vint(data, at + 5)
        index, at, ranges = data[at : at + size].decode(), at + size, []
        while data[at : at + 5] == RANGE_MARK and at + 21 <= len(data):
            ranges.append((int.from_bytes(data[at + 5 : at + 13], "big"), int.from_bytes(data[at + 13 : at + 21], "big")))
            at += 21
        if at + 5 > len(data) or data[at : at + 5] == RANGE_MARK:
            break
        if data[at : at + 5] != ENTRY_MARK:
            raise ValueError(f"neither a range nor an end at byte {at}")
        out.append((index, ranges))
        at += 5
    return out


def read_index_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(index, path, segments) from binary index files beside their data files, named by the suffix."""
    return scan_index_files(spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path), suffix)


def scan_index_files(files: DataFrame, suffix: str) -> DataFrame:
    """(index, path, segments) of binary index files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, p.removesuffix(suffix), [{"off": o, "len": n} for o, n in r]) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, r in parse_index(c)]
            kind = pa.list_(pa.struct([("off", pa.int64()), ("len", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], kind)], ["index", "path", "segments"])

    return files.select("path", "content").mapInArrow(run, MANIFEST)


class IndexedSource(DataSource):
    """spark.read.format("indexed").load(folder): (index, off, value) of files written by write_indexed or by
    df.write.format("indexed").mode("append").save(folder), where df has columns index and value. With the option
    filters=true, which needs spark.sql.python.filterPushdown.enabled, equality on the index spares the reading of other records."""

    @classmethod
    def name(cls) -> str:
        return "indexed"

    def schema(self) -> str:
        return "index string, off bigint, value binary"

    def reader(self, schema) -> DataSourceReader:
        kind = _FilteredReader if self.options.get("filters", "false").lower() == "true" else _IndexedReader
        return kind(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("indexed files are appended")
        return _IndexedWriter(self.options["path"])


class _IndexedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.wanted: set[str] | None = None

    def partitions(self) -> list[InputPartition]:
        fs, inner = pafs.FileSystem.from_uri(self.path)
        files = fs.get_file_info(pafs.FileSelector(f"{inner}/_manifest"))
        return [InputPartition(f.path) for f in sorted(files, key=lambda f: f.path) if f.path.endswith(".parquet")]

    def read(self, partition: InputPartition):
        import pyarrow.parquet as pq

        fs, _ = pafs.FileSystem.from_uri(self.path)
        rows = [r for r in pq.read_table(partition.value, filesystem=fs).to_pylist() if self.wanted is None or r["index"] in self.wanted]
        for path in sorted({r["path"] for r in rows}):
            with fs.open_input_file(pafs.FileSystem.from_uri(path)[1]) as f:
                for r in rows:
                    if r["path"] == path:
                        yield r["index"], r["off"], f.read_at(r["len"], r["off"])


class _FilteredReader(_IndexedReader):
    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("index",):
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _IndexedWriter(DataSourceWriter):
    """A task writes a data file and its part of the manifest under a name of its own; the commit moves the manifests of the tasks that count
    into place, so what other attempts have written is never read."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> _Written:
        import pyarrow.parquet as pq

        fs, inner = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{inner}/_manifest", recursive=True)
        name = f"part-{uuid.uuid4().hex}"
        kind = pa.schema([("index", pa.string()), ("path", pa.string()), ("off", pa.int64()), ("len", pa.int64())])
        entries, at = [], 0
        with fs.open_output_stream(f"{inner}/{name}") as out, fs.open_output_stream(f"{inner}/_manifest/{name}.tmp") as sink, pq.ParquetWriter(sink, kind) as listed:
            for row in iterator:
                data = bytes(row["value"] or b"")
                out.write(data)
                entries.append({"index": row["index"], "path": f"{self.path}/{name}", "off": at, "len": len(data)})
                at += len(data)
                if len(entries) >= 65536:
                    listed.write_table(pa.Table.from_pylist(entries, kind))
                    entries.clear()
            listed.write_table(pa.Table.from_pylist(entries, kind))
        return _Written(name)

    def commit(self, messages) -> None:
        fs, inner = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                fs.move(f"{inner}/_manifest/{m.name}.tmp", f"{inner}/_manifest/{m.name}.parquet")

    def abort(self, messages) -> None:
        fs, inner = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{inner}/{m.name}")
                fs.delete_file(f"{inner}/_manifest/{m.name}.tmp")
