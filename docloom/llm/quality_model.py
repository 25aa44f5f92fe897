"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a text: for each hashed word (A-Z lower-cased) log2(1 + count), all scaled to
unit length; statistics of its structure (shares of upper-case letters, digits, symbols,
line ends, distinct words and the like); and, as metadata, its length. The score is the
logistic of w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2), which is
linear in the number of features.

The model is fitted on a bounded sample: of the labelled rows given, the ``max_rows`` with
the smallest hash of their id. It has (BUCKETS + STATS) * (1 + FACTORS) weights, whatever
the corpus, and is broadcast at that size.

Defined results: null and empty texts have no words and zero statistics and still get a
score; without any labelled row, as in an empty table, every score is 0.5; a score of 0.5 is
predicted as 1; whole texts are read, however long; repeated rows get equal scores. Of rows
with one id the model takes one label (the least) and one text (that of the least hash); null
ids, null labels and other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import textvec
from docloom.llm.common import utf8_buffer

BUCKETS, FACTORS = 1 << 16, 8
#: Labelled rows that a model is fitted on at most.
MAX_ROWS = 8000

_KINDS = ("upper", "digit", "symbol", "pipe", "exclaim", "point", "newline", "space", "other")
_KIND = np.full(256, 9, np.uint8)
_KIND[ord("A") : ord("Z") + 1] = 0
_KIND[ord("0") : ord("9") + 1] = 1
_KIND[list(b"#*$%&<>@^~_=+\\/{}[]")] = 2
_KIND[ord("|")] = 3
_KIND[list(b"!?")] = 4
_KIND[list(b".,;:'\"-()")] = 5
_KIND[ord("\n")] = 6
_KIND[list(b" \t\r\v\f")] = 7
_KIND[0x80:] = 8
_KIND[list(range(0x20))] = 8
_KIND[list(b"\n\t\r\v\f")] = [6, 7, 7, 7, 7]
STATS = len(_KINDS) + 5


@dataclass
class FactorisationMachine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, feature: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of sparse features; at: n + 1 offsets."""
        y = self.w0 + _sums(self.w[feature] * value, at)
        vx = self.v[feature] * value[:, None]
        y += 0.5 * (np.square(_sums(vx, at)).sum(1) - _sums(np.square(vx).sum(1), at))
        return 1 / (1 + np.exp(-np.clip(y, -30, 30)))


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows of each range; a range may be empty."""
    out = np.zeros((len(at) - 1, *x.shape[1:]), np.float64)
    full = at[1:] > at[:-1]
    if full.any():
        out[full] = np.add.reduceat(x, at[:-1][full], axis=0)
    return out


def features_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, offsets) of each text; texts are worked on in blocks of a few MB."""
    got = [_block(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in textvec.blocks(offsets, textvec.BLOCK)]
    if not got:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64)
    sizes = np.concatenate([np.diff(x[2]) for x in got])
    return np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]), np.concatenate([[0], np.cumsum(sizes)])


def _block(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    words, at = textvec.words_of(raw, offsets, fold=True)
    n_words = np.diff(at)
    doc = np.repeat(np.arange(n), n_words)
    key, count = np.unique(doc * BUCKETS + (words >> np.uint64(48)).astype(np.int64), return_counts=True)
    doc, feature, value = key // BUCKETS, key % BUCKETS, np.log2(1.0 + count)
    norm = np.sqrt(np.bincount(doc, value * value, n))
    value /= norm[doc]
    size = np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(n), size) * 16 + _KIND[raw], minlength=16 * n).reshape(n, 16)[:, : len(_KINDS)]
    some, many = np.maximum(size, 1), np.maximum(n_words, 1)
    distinct, top = np.bincount(doc, minlength=n), np.zeros(n)
    np.maximum.at(top, doc, count)
    stats = np.stack([*np.sqrt(kinds / some[:, None]).T, distinct / many, top / many, size / many / 16, np.log2(1.0 + n_words) / 16, np.log2(1.0 + size) / 16], 1) * (size > 0)[:, None]
    each = np.diff(np.searchsorted(doc, np.arange(n + 1)))
    ends = np.cumsum(each + STATS)
    out_f, out_v = np.empty(ends[-1] if n else 0, np.int64), np.empty(ends[-1] if n else 0)
    place = np.arange(len(doc)) + doc * STATS
    out_f[place], out_v[place] = feature, value
    place = (ends[:, None] - STATS + np.arange(STATS)).ravel()
    out_f[place], out_v[place] = np.tile(BUCKETS + np.arange(STATS), n), stats.ravel()
    return out_f, out_v, np.concatenate([[0], ends])


def fit(feature: np.ndarray, value: np.ndarray, at: np.ndarray, label: np.ndarray, epochs: int = 12, rate: float = 0.08, decay: float = 2e-5, seed: int = 7) -> FactorisationMachine:
    """Logistic loss by Adagrad over mini-batches, in a fixed order."""
    rng, size = np.random.default_rng(seed), BUCKETS + STATS
    model = FactorisationMachine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)))
    if not len(label):
        model.v[:] = 0
        return model
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    model.w0 = float(np.log(share / (1 - share)))
    g0, gw, gv = 1e-6, np.full(size, 1e-6), np.full((size, FACTORS), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for rows in np.array_split(order, max(1, len(label) // 128)):
            n = at[rows + 1] - at[rows]
            flat = np.repeat(at[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            f, x, ends = feature[flat], value[flat], np.concatenate([[0], np.cumsum(n)])
            used, f = np.unique(f, return_inverse=True)
            small = FactorisationMachine(model.w0, model.w[used], model.v[used])
            vx = small.v[f] * x[:, None]
            total = _sums(vx, ends)
            error = small.score(f, x, ends) - label[rows]
            each = np.repeat(error, n) / len(rows)
            d0 = error.mean()
            dw = np.bincount(f, each * x, len(used)) + decay * small.w
            inner = (np.repeat(total, n, axis=0) - vx) * (each * x)[:, None]
            dv = np.stack([np.bincount(f, inner[:, j], len(used)) for j in range(FACTORS)], 1) + decay * small.v
            g0 += d0 * d0
            gw[used] += dw * dw
            gv[used] += dv * dv
            model.w0 -= rate * d0 / np.sqrt(g0)
            model.w[used] -= rate * dw / np.sqrt(gw[used])
            model.v[used] -= rate * dv / np.sqrt(gv[used])
    return model


def train(labelled: DataFrame, texts: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int = MAX_ROWS) -> FactorisationMachine:
    """A model of label_col (0 or 1) of ``labelled`` from the texts of the same id."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    sample = spark.createDataFrame(rows.orderBy(F.xxhash64("id"), "id").limit(max_rows).toArrow(), rows.schema)  # max_rows rows at most

    def counted(batches):
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                f, x, at = features_of(*utf8_buffer(part.column(1)))
                f, x = f.astype(np.int32), x.astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([f[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()), pa.array([x[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["id", "label", "f", "x"])

    found = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    found = found.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("id", "text", "label")
    got = found.mapInArrow(counted, found.select("id", "label", F.lit(b"").alias("f"), F.lit(b"").alias("x")).schema).toArrow().sort_by("id")  # a row for each sampled id
    f, x = [np.frombuffer(b.as_py(), np.int32) for b in got["f"]], [np.frombuffer(b.as_py(), np.float32) for b in got["x"]]
    at = np.concatenate([[0], np.cumsum([len(b) for b in f], dtype=np.int64)]).astype(np.int64)
    empty = np.zeros(0)
    return fit(np.concatenate([empty.astype(np.int64), *f]), np.concatenate([empty, *x]), at, got["label"].to_numpy().astype(np.float64))


def score(text: Column | str, model: FactorisationMachine, spark) -> Column:
    """The probability of label 1 of a text column."""
    sent = spark.sparkContext.broadcast(FactorisationMachine(model.w0, model.w.astype(np.float32), model.v.astype(np.float32)))

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        raw, at = utf8_buffer(text)
        out = [np.zeros(0)]
        for a, b in textvec.blocks(at, textvec.BLOCK):
            out.append(sent.value.score(*_block(raw[at[a] : at[b]], at[a : b + 1] - at[a])))
        return pa.array(np.concatenate(out), pa.float64())

    return run(text)
