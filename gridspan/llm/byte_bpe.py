"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary (hash and displace: every bucket of keys has a displacement that sends its
keys to free slots) finds a whole pre-token's id; the slot's key is compared, so a stranger never passes. Tier 2: a pre-token
that is no vocabulary entry is merged over a linked list of its bytes, the next merge taken from a heap of (rank, position).

Texts are cut at single spaces between non-space characters, where no match of the pattern can reach over, and the
encodings of these pieces are kept in a memory per worker, bounded in bytes, since most pieces come again."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Remembered, bounded_batches

#: The characters of the Unicode property White_Space.
WHITE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + f"{chr(0x2000)}-{chr(0x200A)}"
_SPLIT = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")
_ODD = re.compile(f"[{WHITE}] | [{WHITE}]")
_PIECE = 1 << 20


class PerfectHash:
    """Minimal perfect hash over byte strings: n keys, n slots."""

    def __init__(self, keys: list[bytes], seed: int = 0):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 4)
        while True:
            self.seed = seed
            h = np.array([xxhash.xxh3_64_intdigest(k, seed) for k in keys], np.uint64)
            place = self._place(h)
            if place is not None:
                break
            seed += 1
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        for i, at in enumerate(place.tolist()):
            self.keys[at] = keys[i]
            self.values[at] = i
        self.shift = self.shift.tolist()

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
        d = d.astype(np.uint64)
        return ((low + d * high + d * d) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(self.n)

    def _place(self, h: np.ndarray) -> np.ndarray | None:
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        start = np.concatenate(([0], np.cumsum(size)))
        self.shift = np.zeros(self.buckets, np.int64)
        taken, place = np.zeros(self.n, bool), np.zeros(self.n, np.int64)
        tries = np.arange(1, 513)
        for b in np.argsort(-size, kind="stable").tolist():
            rows = order[start[b] : start[b + 1]]
            if not len(rows):
                break
            for base in range(0, 1 << 22, 512):
                d = tries + base
                slots = self._slots(h[rows][None, :], d[:, None]).astype(np.int64)
                free = ~taken[slots].any(axis=1)
                if len(rows) > 1:
                    ordered = np.sort(slots, axis=1)
                    free &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                hit = np.flatnonzero(free)
                if len(hit):
                    self.shift[b] = d[hit[0]]
                    place[rows] = slots[hit[0]]
                    taken[slots[hit[0]]] = True
                    break
            else:
                return None
        return place

    def find(self, key: bytes) -> int:
        """The key's index, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        d = self.shift[h % self.buckets]
        at = ((((h & 0xFFFFFFFF) + d * (h >> 32) + d * d) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 20) % self.n
        return self.values[at] if self.keys[at] == key else -1


def _ranges(chars: list[str]) -> str:
    """Characters as the inside of a character class."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@functools.cache
def odd_characters(kind: str) -> tuple[str, str]:
    """Characters that the regex module has in a class and tiktoken's own expressions have not, and the other way round: the two know
    different versions of Unicode. The library is asked once, by a vocabulary of single bytes and a pattern of the class alone."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    theirs, ours = set(bytes(probe.encode_ordinary(every)).decode()), set(regex.findall(kind, every))
    return _ranges([*(ours - theirs)]), _ranges([*(theirs - ours)])


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary, and the pattern that splits text before merging. `pattern` may hold \\s, \\S, \\p{L}, \\p{N}
    and [^\\s\\p{L}\\p{N}]. `odd` finds the characters that need `exact`, the pattern with the library's classes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        other = r"[^\s\p{L}\p{N}]"
        self.pattern = pattern.replace(other, rf"[^{WHITE}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        minus, plus = ("".join(x) for x in zip(*map(odd_characters, (r"\p{L}", r"\p{N}")), strict=True))
        self.odd = f"[{minus}{plus}]" if minus or plus else ""
        exact = pattern.replace(other, "\0")
        for kind in (r"\p{L}", r"\p{N}"):
            less, more = odd_characters(kind)
            exact = exact.replace(kind, f"(?:{f'(?![{less}])' if less else ''}{kind}{f'|[{more}]' if more else ''})")
        put = f"(?:{f'(?![{plus}])' if plus else ''}[^{WHITE}\\p{{L}}\\p{{N}}]{f'|[{minus}]' if minus else ''})"
        self.exact = exact.replace("\0", put).replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        self.words = list(ranks)
        self.ids = list(ranks.values())
        self.hash = PerfectHash(self.words)
        self.digest = hashlib.sha256(b"\0".join(self.words) + repr(self.ids).encode() + self.exact.encode()).hexdigest()

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """From a rank file: a base64 token and its rank on each line. Read on the driver; executors get the object."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}, pattern)


class Codec(Remembered):
    """A worker's encoder and decoder; as a dict, the encodings of pieces. keep: bytes of memory for them."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 160 << 20):
        super().__init__(keep)
        v = vocabulary
        self.vocabulary = v
        self.ranks = dict(zip(v.words, v.ids, strict=True))
        self.token = dict(zip(v.ids, v.words, strict=True))
        self.plain, self.exact = regex.compile(v.pattern).findall, regex.compile(v.exact).findall
        self.odd = re.compile(v.odd).search if v.odd else lambda _: None

    def find_all(self, piece: str) -> list[str]:
        return self.plain(piece) if piece.isascii() or not self.odd(piece) else self.exact(piece)

    def find(self, piece: str) -> bytes:
        words = self.find_all(piece)
        return self._word(piece) if len(words) == 1 else b"".join([self[w] for w in words])

    def _word(self, word: str) -> bytes:
        data = word.encode("utf-8", "surrogatepass")
        at = self.vocabulary.hash.find(data)
        ids = [self.vocabulary.ids[at]] if at >= 0 else self.merge(data)
        return pack(f"<{len(ids)}I", *ids)

    def merge(self, word: bytes) -> list[int]:
        """Tier 2: the pair of the lowest rank, leftmost first, until no neighbours form an entry."""
        ranks, n = self.ranks, len(word)
        get, bits = ranks.get, n.bit_length()
        mask, two = (1 << bits) - 1, 2 * bits
        end = [*range(1, n + 1), 0]  # where the piece that starts here ends; 0: none starts here
        prev = list(range(-1, n))
        heap = [r << two | i << bits | i + 2 for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, stop = top >> bits & mask, top & mask
            j = end[i]
            if not j or end[j] != stop:
                continue
            end[j], end[i] = 0, stop
            if stop < n:
                prev[stop] = i
                if (r := get(word[i : end[stop]])) is not None:
                    heappush(heap, r << two | i << bits | end[stop])
            if (p := prev[i]) >= 0 and (r := get(word[p:stop])) is not None:
                heappush(heap, r << two | p << bits | stop)
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def _pieces(self, text: str) -> list[str]:
        parts = _SPLIT.split(text) if _ODD.search(text) or text[:1] == " " else text.split(" ")
        return parts[:1] + [" " + p for p in parts[1:]]

    def encode(self, text: str | None) -> Iterator[bytes]:
        """The ids of a text as little-endian unsigned 32-bit integers, in pieces of about a million characters. A stretch without a single
        space between other characters is one piece, however long; its memory is in proportion to it."""
        text = text or ""
        at = 0
        while at < len(text):
            cut = _SPLIT.search(text, at + _PIECE) if at + _PIECE < len(text) else None
            stop = cut.start() if cut else len(text)
            parts = self._pieces(text[at:stop]) if at == 0 else [" " + p for p in self._parts_after(text[at:stop])]
            at = stop
            yield b"".join(map(self.__getitem__, parts))

    @staticmethod
    def _parts_after(text: str) -> list[str]:
        """Pieces of a text that starts with the single space at which it was cut."""
        return _SPLIT.split(text[1:])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, int], Codec] = {}


def codec(vocabulary: Vocabulary, keep: int = 160 << 20) -> Codec:
    """The worker's codec of a vocabulary; it lives on between tasks."""
    key = (vocabulary.digest, keep)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary, keep)
    return _codecs[key]


def encoded(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, and with with_ids: ids, array of int) for every row.

    Both digests are taken from the ids: of the ids as little-endian unsigned 32-bit integers, and of the bytes they decode
    to. Null texts are empty: no ids. Repeated rows give repeated results; other columns are not read. Texts are encoded in
    pieces of about a million characters, cut at single spaces; a text without any is one piece. An empty table gives an empty
    result."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                n, one, two, ids = [], [], [], []
                for x in part.column(1):
                    a, b, size, kept = hashlib.sha256(), hashlib.sha256(), 0, []
                    for raw in own.encode(x.as_py()):
                        size += len(raw) // 4
                        a.update(raw)
                        b.update(own.decode(raw))
                        if with_ids:
                            kept.append(raw)
                    n.append(size)
                    one.append(a.hexdigest())
                    two.append(b.hexdigest())
                    if with_ids:
                        ids.append(np.frombuffer(b"".join(kept), "<u4").astype(np.int32))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return slim.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decoded(ids: DataFrame, vocabulary: Vocabulary, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes) from arrays of ids; null arrays decode to nothing. An id outside the vocabulary is an error."""
    slim = ids.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = slim.schema["id"].dataType.simpleString()
    shared = ids.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            got = [b"".join(map(own.token.__getitem__, x.as_py() or [])) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["id", "bytes"])

    return slim.mapInArrow(run, f"id {kind}, bytes binary")
