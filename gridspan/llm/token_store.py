"""Token ids as binary files with a shared zstandard dictionary.

A dictionary is trained on serialized id arrays of a bounded sample; each document is compressed by itself with it. Documents
are ranged by id, and each range is one file, in id order:

    magic | dictionary hash (32 bytes) | frames ... | index | offset of the index (8 bytes) | number of documents (8 bytes) | magic

The index has, for each document: id (8 bytes, signed), offset of its frame (8), number of ids (8), crc32 of its ids (4), and 1 where
it has no id (1). Ids are little-endian unsigned 32-bit integers. One short document is read by its index entry and one frame
alone; a whole file is read in ranges of many frames.

Files go to a folder that all executors share, through pyarrow's filesystems; each is written under a name of its own and then
moved into place, so a task that runs again replaces its file by the same bytes."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from codecs import charmap_decode
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Remembered, bounded_batches, new_path, running_start, written

MAGIC = b"GSIDS001"
ENTRY = np.dtype([("id", "<i8"), ("offset", "<u8"), ("n", "<u8"), ("crc", "<u4"), ("none", "u1")])
TAIL = struct.Struct("<QQ8s")
#: Bytes of text that go to a file.
FILE_BYTES = 128 << 20


#: Composed letters of ASCII, Latin-1 and Latin Extended-A whose lower case is one letter, and their lower case.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: Those letters and visible ASCII: text that normalization only lower-cases, and whose classes are the same in every Unicode version.
_PLAIN = re.compile(f"[!-~{_LETTERS}]+").fullmatch
#: The model's pre-tokens of such text.
_PRE_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+").findall


class WordTokenizer(Remembered):
    """Ids by the tokenizers library for a model that lower-cases composed text, splits it into runs of letters, digits or marks
    and never lets a pre-token hold white space: the pieces between white space are encoded one by one and remembered, as bytes.
    keep: bytes of memory for them."""

    def __init__(self, model: str, keep: int = 128 << 20):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(keep)
        self.model = Tokenizer.from_str(model)
        self.word = self.model.model.tokenize
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        #: The character for each byte that the model's merges are written in, as far as plain text has it.
        chars = {b: c for x in map(chr, range(0x21, 0x180)) for b, c in zip(x.encode(), spell(x)[0][0], strict=True)}
        self.chars = "".join(chars.get(b, "\ufffe") for b in range(256))

    def find(self, piece: bytes) -> bytes:
        """The pre-tokens of plain text only need lower-casing, and each goes straight to the library's model; a piece of several
        is put together from them. Any other piece, or one that may hold a special token, goes through the whole chain."""
        if piece.isalpha():
            low = piece.lower()
            if low != piece:
                return self[low]
            ids = [t.id for t in self.word(low.decode())]
        elif _PLAIN(text := piece.decode("utf-8", "replace")) and b"<|" not in piece:
            found = _PRE_TOKENS(text.lower())
            if len(found) > 1:
                return b"".join([self[x.encode()] for x in found])
            low = found[0].encode()
            if low != piece:
                return self[low]
            ids = [t.id for t in self.word(charmap_decode(low, "strict", self.chars)[0])]
        else:
            ids = self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None, piece: int = 1 << 20) -> Iterator[bytes]:
        from .simhash import word_pieces

        for words in word_pieces((text or "").encode("utf-8", "surrogatepass"), piece):
            yield b"".join(map(self.__getitem__, words))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(model: str) -> WordTokenizer:
    key = hashlib.sha256(model.encode()).hexdigest()
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = WordTokenizer(model)
    return _tokenizers[key]


def train_dictionary(docs: DataFrame, encode: Callable[[], Callable[[str | None], Iterator[bytes]]], end_id: int, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 1024, sample_bytes: int = 16384, size: int = 65536) -> bytes:
    """A zstandard dictionary from the first sample_bytes of the ids of sample_docs documents, chosen by the hash of their id, one for
    each id: both are bounds on what reaches the driver. Empty if there are too few samples to train on."""
    chosen = docs.select(F.col(id_col).alias("id")).filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encode()
        for batch in batches:
            got = []
            for x in batch.column(1):
                kept = b""
                for raw in own(x.as_py()):
                    kept += raw[: sample_bytes - len(kept)]
                    if len(kept) >= sample_bytes:
                        break
                got.append(kept + struct.pack("<I", end_id))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["id", "raw"])

    kind = rows.schema["id"].dataType.simpleString()
    one = rows.mapInArrow(run, f"id {kind}, raw binary").groupBy("id").agg(F.min("raw").alias("raw"))
    samples = [bytes(r["raw"]) for r in sorted(one.collect(), key=lambda r: r["id"])]
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_file(path: str, documents: Iterator[tuple[int | None, bytes]], dictionary: bytes, level: int = 3) -> int:
    """A file of documents (id or None, ids as bytes), in the order given; the number of documents."""
    fs, inner = pafs.FileSystem.from_uri(path)
    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=False, write_content_size=True)
    own, entries = f"{inner}.{uuid.uuid4().hex}", []
    with fs.open_output_stream(own) as out:
        out.write(MAGIC + hashlib.sha256(dictionary).digest())
        at = len(MAGIC) + 32
        for key, raw in documents:
            frame = packer.compress(raw)
            entries.append((key or 0, at, len(raw) // 4, zlib.crc32(raw), key is None))
            out.write(frame)
            at += len(frame)
        out.write(np.array(entries, ENTRY).tobytes() + TAIL.pack(at, len(entries), MAGIC))
    fs.move(own, inner)
    return len(entries)


class Reader:
    """A file read by its index: entries, and any single document."""

    def __init__(self, path: str, dictionary: bytes):
        fs, inner = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        at, n, magic = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC or self.file.read_at(len(MAGIC) + 32, 0) != MAGIC + hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path}: not a file of this format, or of another dictionary")
        self.entries = np.frombuffer(self.file.read_at(n * ENTRY.itemsize, at), ENTRY)
        self.ends = np.append(self.entries["offset"][1:], np.uint64(at)) if n else np.empty(0, np.uint64)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> bytes:
        start = int(self.entries["offset"][k])
        return self.unpacker.decompress(self.file.read_at(int(self.ends[k]) - start, start))

    def scan(self, block: int = 4 << 20) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """All documents in order, as (entries, ids of each), about `block` bytes of the file at a time."""
        starts, ends = self.entries["offset"].astype(np.int64), self.ends.astype(np.int64)
        k = 0
        while k < len(starts):
            stop = max(k + 1, int(np.searchsorted(ends, starts[k] + block, "right")))
            raw = self.file.read_at(int(ends[stop - 1] - starts[k]), int(starts[k]))
            yield self.entries[k:stop], [self.unpacker.decompress(raw[a:b]) for a, b in zip((starts[k:stop] - starts[k]).tolist(), (ends[k:stop] - starts[k]).tolist(), strict=True)]
            k = stop

    def close(self) -> None:
        self.file.close()


def write_store(docs: DataFrame, model: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> tuple[DataFrame, bytes]:
    """Encode every whole text, append end_id, and write the files; (file int, path, n_docs) for each, and the dictionary,
    which is also written beside them, named by its hash. Files are numbered in ascending id order; there are as many as the session
    has shuffle partitions, or more, so that none has more than about FILE_BYTES of text.

    Null texts are empty (only the end id). Null ids come first. Repeated ids stay, ordered by a hash of their text, and may lie
    in several files; rows of equal id and text lie in one. The ids of a very long text are joined in its worker's memory, four
    bytes each. Other columns are not read. An empty table gives no documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or new_path(spark, "tokens")
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    if files is None:
        size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    held = spark.sparkContext.broadcast(model)
    dictionary = train_dictionary(docs, lambda: tokenizer(held.value).encode, end_id, id_col, text_col)
    fs, inner = pafs.FileSystem.from_uri(path)
    fs.create_dir(inner, recursive=True)
    with fs.open_output_stream(f"{inner}/dictionary-{hashlib.sha256(dictionary).hexdigest()}") as out:
        out.write(dictionary)
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = slim.repartitionByRange(files, *order).sortWithinPartitions(*order)
    shared = spark.sparkContext.broadcast(dictionary)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(held.value)

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for key, text in zip(batch.column(0), batch.column(1), strict=True):
                    yield key.as_py(), b"".join([*own.encode(text.as_py()), end])

        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        name = f"{path}/part-{number:06d}.ids"
        n = write_file(name, documents(), shared.value)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([name]), pa.array([n], pa.int64())], ["file", "path", "n_docs"])

    manifest = written(ranged.mapInArrow(run, "file int, path string, n_docs bigint"), "manifest")
    return manifest, dictionary


def read_store(manifest: DataFrame, dictionary: bytes, check: bool = True) -> DataFrame:
    """(id, start, n_tokens, crc32) for every document, read back from the files: its ids are decompressed, counted and
    checked against the index. start: ids of all documents before it, in file order."""
    shared = manifest.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path in zip(batch.column(0), batch.column(1), strict=True):
                reader, within = Reader(path.as_py(), shared.value), 0
                for entries, documents in reader.scan():
                    size, crc = np.array([len(x) // 4 for x in documents], np.int64), np.array([zlib.crc32(x) for x in documents], np.int64)
                    if check and ((entries["n"] != size).any() or (entries["crc"] != crc).any()):
                        raise ValueError(f"{path}: documents differ from the index")
                    at = within + np.cumsum(size) - size
                    within += int(size.sum())
                    ids = pa.array(entries["id"].astype(np.int64), mask=entries["none"].astype(bool))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), number.as_py(), np.int32)), ids, pa.array(at), pa.array(size), pa.array(crc)], ["file", "id", "within", "n_tokens", "crc32"])
                reader.close()

    spread = manifest.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file")
    found = written(spread.select("file", "path").mapInArrow(run, "file int, id bigint, within bigint, n_tokens bigint, crc32 bigint"), "read_back")
    starts = running_start(found.groupBy("file").agg(F.sum("n_tokens").alias("n")), "file", "n", "base").select("file", "base")
    out = found.join(starts, "file")
    return out.select("id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "crc32")
