"""Quality classifier: attention-based multiple-instance learning with gated attention.

A document is a bag of passages of `PASSAGE` words. Each passage is described by the shares of its characters, the shape and
repetition of its words and hashed words, and encoded as h = tanh(x W + b). Attention weights are the softmax over the document's passages of
w . (tanh(h V) * sigmoid(h U)); the document is sum(a h), and its score sigmoid(z o + c). All of W, V, U, w, o are learned from
document labels alone (Adam, gradients by hand), on the driver, from the passages of at most `sample_docs` labelled documents;
every document is then scored in full. Nothing is shuffled for scoring."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

PASSAGE = 64
HASHED = 64
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.full(256, 5, np.int64)  # 5: bytes of characters beyond ASCII
_CLASS[:128] = 4  # control characters
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
for _i, _c in enumerate(_MARKS):
    _CLASS[_c] = 6 + _i
_CLASSES = 6 + len(_MARKS)
_SPACE = _CLASS == 3
N_FEATURES = _CLASSES + 8 + HASHED
_WEIGHT = np.random.default_rng(97).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_STEP = 1 << 18


def passages(data: bytes) -> np.ndarray:
    """Features of the passages of a text without NULs or with: (number of passages, N_FEATURES). No words: one row of zeros."""
    rows, at = [], 0
    while at < len(data):
        cut = at + _STEP
        while cut < len(data) and not _SPACE[data[cut]]:
            cut += 1
        rows.append(_passages(np.frombuffer(data[at:cut], np.uint8)))
        at = cut
    rows = [r for r in rows if len(r)]
    return np.vstack(rows) if rows else np.zeros((1, N_FEATURES), np.float32)


def _passages(b: np.ndarray) -> np.ndarray:
    space = _SPACE[b]
    first = ~space
    first[1:] &= space[:-1]
    start = np.flatnonzero(first)
    n = len(start)
    if not n:
        return np.zeros((0, N_FEATURES), np.float32)
    last = ~space
    last[:-1] &= space[1:]
    end = np.flatnonzero(last) + 1
    size = end - start
    k = -(-n // PASSAGE)
    head = start[::PASSAGE]
    bound = np.append(head, len(b))
    owner = np.repeat(np.arange(k), np.diff(bound))
    inside = b[head[0] :]
    counts = np.bincount(owner * _CLASSES + _CLASS[inside], minlength=k * _CLASSES).reshape(k, _CLASSES).astype(np.float64)
    length = np.diff(bound).astype(np.float64)
    words = np.diff(np.append(np.arange(0, n, PASSAGE), n)).astype(np.float64)
    # A word's hash: its bytes, each times a weight of its place.
    word = np.cumsum(first) - 1
    keep = ~space
    w = word[keep]
    place = (np.flatnonzero(keep) - start[w]) & 63
    code = np.add.reduceat((b[keep].astype(np.uint64) + np.uint64(1)) * _WEIGHT[place], np.searchsorted(w, np.arange(n)))
    code ^= code >> np.uint64(29)
    part = np.arange(n) // PASSAGE
    order = np.lexsort((code, part))
    again = np.zeros(n, bool)
    again[1:] = (code[order][1:] == code[order][:-1]) & (part[order][1:] == part[order][:-1])
    repeated = np.bincount(part[order], again[order], minlength=k)
    shift = np.zeros(n, bool)
    shift[1:] = (code[1:] == code[:-1]) & (part[1:] == part[:-1])
    row = np.zeros((k, N_FEATURES), np.float64)
    row[:, :_CLASSES] = np.sqrt(counts / length[:, None])
    mean = np.bincount(part, size, minlength=k) / words
    capital = _CLASS[b[start]] == 1
    tail = _CLASS[b[end - 1]]
    extra = row[:, _CLASSES : _CLASSES + 8]
    extra[:, 0] = np.log1p(mean)
    extra[:, 1] = np.sqrt(np.maximum(np.bincount(part, size.astype(np.float64) ** 2, minlength=k) / words - mean**2, 0)) / 8
    extra[:, 2] = repeated / words
    extra[:, 3] = np.bincount(part, shift, minlength=k) / words
    extra[:, 4] = np.bincount(part, capital, minlength=k) / words
    extra[:, 5] = np.bincount(part, tail >= 6, minlength=k) / words
    extra[:, 6] = np.bincount(part, size == 1, minlength=k) / words
    extra[:, 7] = words / PASSAGE
    bucket = (code % np.uint64(HASHED)).astype(np.int64)
    row[:, _CLASSES + 8 :] = np.sqrt(np.bincount(part * HASHED + bucket, minlength=k * HASHED).reshape(k, HASHED) / words[:, None])
    return row.astype(np.float32)


@dataclass
class Model:
    """Parameters; `prior` alone decides if there was nothing to learn from."""

    params: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def scores(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """x: passages of documents, one after another; sizes: passages in each."""
        if not self.params:
            return np.full(len(sizes), self.prior)
        p = _forward(self.params, (x - self.mean) / self.scale, sizes)[-1]
        return np.clip(p, 0.0, 1.0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(m: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray):
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    h = np.tanh(x @ m["W"] + m["b"])
    t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    e = (t * g) @ m["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), sizes))
    a = e / np.repeat(np.add.reduceat(e, at), sizes)
    z = np.add.reduceat(a[:, None] * h, at)
    return at, h, t, g, a, z, _sigmoid(z @ m["o"] + m["c"][0])


def _gradients(m: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    at, h, t, g, a, z, p = _forward(m, x, sizes)
    d = weight * (p - y)
    dz = d[:, None] * m["o"]
    rows = np.repeat(dz, sizes, axis=0)
    da = (rows * h).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, at), sizes))
    dt, dg = de[:, None] * m["w"] * g * (1 - t**2), de[:, None] * m["w"] * t * g * (1 - g)
    dh = (a[:, None] * rows + dt @ m["V"].T + dg @ m["U"].T) * (1 - h**2)
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "o": z.T @ d, "c": np.array([d.sum()])}


def fit(bags: list[np.ndarray], y: np.ndarray, hidden: int = 16, gate: int = 8, epochs: int = 60, batch: int = 128, rate: float = 0.01, decay: float = 0.03, seed: int = 3) -> Model:
    """Learn from bags of passages and labels 0 or 1; classes weigh alike up to a square root."""
    prior = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or y.min() == y.max():
        return Model({}, np.zeros(N_FEATURES), np.ones(N_FEATURES), prior)
    everything = np.vstack(bags).astype(np.float64)
    mean, scale = everything.mean(axis=0), everything.std(axis=0) + 0.02
    bags = [(b - mean) / scale for b in bags]
    rng = np.random.default_rng(seed)
    m = {"W": rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gate)), "U": rng.normal(0, hidden**-0.5, (hidden, gate)), "w": rng.normal(0, gate**-0.5, gate), "o": rng.normal(0, hidden**-0.5, hidden), "c": np.zeros(1)}
    share = np.array([1 - prior, prior])
    weight = (0.5 / share) ** 0.5
    weight = weight[y.astype(int)]
    one, two = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    count = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            x, sizes = np.vstack([bags[k] for k in part]), np.array([len(bags[k]) for k in part])
            grad = _gradients(m, x, sizes, y[part], weight[part] / len(part))
            count += 1
            for k, g in grad.items():
                if k not in ("b", "c"):
                    g = g + decay * m[k] / len(order) * batch
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                m[k] = m[k] - lr * (one[k] / (1 - 0.9**count)) / (np.sqrt(two[k] / (1 - 0.999**count)) + 1e-8)
    return Model(m, mean, scale, prior)


def held_out(id_col: str | Column, of: int = 4, rest: int = 2) -> Column:
    """Rows never learned from: crc32 of the id as text, mod 4, is 2. A null id is held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % F.lit(of) == F.lit(rest), F.lit(True))


def _bags(texts: DataFrame) -> DataFrame:
    """(id, text) -> (id, x binary): the features of all passages."""
    bounded_batches(texts.sparkSession)
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [passages((x.as_py() or "").encode("utf-8", "surrogatepass")).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["id", "x"])

    return texts.mapInArrow(run, f"id {kind}, x binary")


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000, sample_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 3) -> Model:
    """Learn from labelled documents that are not held out: at most sample_docs, half of them of either label where there are enough, in
    the order of a hash of their id, and at most sample_bytes of text in all, documents that would exceed it being passed over.
    These two bound what reaches the driver. Of several rows of an id one counts, that of the least text. Labels other than 0 and
    1 are ignored; an id labelled twice takes the lower. Null texts have one empty passage. Without labels every score is 0.5."""
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    order = F.xxhash64(F.lit(seed).cast("long"), "id")
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    half = sample_docs // 2
    low = min(counts.get(0, 0), max(half, sample_docs - counts.get(1, 0)))
    ranked = [[(r["id"], r["y"]) for r in usable.filter(F.col("y") == y).orderBy(order, "id").limit(n).collect()] for y, n in ((0, low), (1, sample_docs - low))]
    known = dict(x for part in ranked for x in part)
    if not known:
        return fit([], np.empty(0))

    def of(ids: list) -> DataFrame:
        picked = docs.sparkSession.createDataFrame([(i,) for i in ids], usable.select("id").schema)
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        return texts.join(F.broadcast(picked), "id", "left_semi").groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    size = {r["id"]: r["n"] for r in of([*known]).select("id", F.octet_length("text").alias("n")).collect()}
    chosen, left = [], sample_bytes
    for k in range(max(map(len, ranked))):
        for i in (part[k][0] for part in ranked if k < len(part)):
            if i in size and size[i] <= left:
                chosen.append(i)
                left -= size[i]
    if not chosen:
        return fit([], np.empty(0))
    rows = sorted((r["id"], bytes(r["x"])) for r in _bags(of(chosen)).collect())
    bags = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for _, x in rows]
    return fit(bags, np.array([known[k] for k, _ in rows], np.float64), seed=seed)


def _with_score(slim: DataFrame, model: Model, kept: str) -> DataFrame:
    """(kept, text) -> (kept, score)."""
    bounded_batches(slim.sparkSession)
    shared = slim.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                bags = [passages((x.as_py() or "").encode("utf-8", "surrogatepass")) for x in part.column(1)]
                s = shared.value.scores(np.vstack(bags).astype(np.float64), np.array([len(x) for x in bags]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], [kept, "score"])

    return slim.mapInArrow(run, f"{kept} {slim.schema[kept].dataType.simpleString()}, score double")


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) for every row.

    Null and empty texts have one empty passage. Repeated rows get equal scores. Only the text is an input of the score; other
    columns are not read. The passages of the texts of an Arrow batch (4 MB, or one longer text) are in memory together, at about
    three times their size. An empty table gives an empty result."""
    out = _with_score(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), model, "id")
    return out.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose score is threshold or more, unchanged, whatever their columns are named; as scored() for the rest."""
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = _with_score(slim, model, "row").filter(F.col("score") >= threshold)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
