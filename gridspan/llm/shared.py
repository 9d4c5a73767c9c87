"""Helpers that several operators use: written tables in the cluster's shared folder, joins that can be split, prefix sums."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from ..operators.keys import join_on, running_start
from ..session import new_path, shared_dir, table, written

__all__ = ["Remembered", "bounded_batches", "byte_size", "join_on", "new_path", "running_start", "shared_dir", "table", "written"]


#: Bytes of an Arrow batch of whole texts.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES, if they are larger: by default a batch of texts may hold 64 MB, several
    times over in the executor's off-heap buffers and in its Python worker. The setting is read when a query runs, which may be
    long after the operator has returned, so it stays."""
    if byte_size(spark.conf.get(_BATCH_KEY)) > BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def byte_size(setting: str) -> int:
    """Bytes of a setting such as 4194304, 4194304b, 64m or 1GB."""
    m = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)(?:i?b)?\s*", setting.lower())
    if not m:
        raise ValueError(f"not a size: {setting!r}")
    return int(m[1]) << 10 * " kmgtp".index(m[2] or " ")


class Remembered(dict):
    """Values of pieces of text, computed by `find` where they are not remembered. `keep` bounds the memory in bytes, over two
    generations of half as many each; pieces of more than LONGEST units are never remembered."""

    LONGEST = 256
    #: Bytes of an entry besides its key and value.
    ENTRY = 200

    def __init__(self, keep: int):
        super().__init__()
        self.half = self.room = keep // 2
        self.old: dict = {}

    def find(self, piece):
        raise NotImplementedError

    def __missing__(self, piece):
        known = self.old.get(piece)
        if known is None:
            known = self.find(piece)
        if len(piece) <= self.LONGEST:
            cost = self.ENTRY + len(piece) + len(known)
            if cost > self.room:
                self.old = self.copy()
                self.clear()
                self.room = self.half
            self.room -= cost
            self[piece] = known
        return known
