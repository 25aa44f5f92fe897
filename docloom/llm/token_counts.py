"""Token counts of whole texts without making their ids.

Each task turns its documents into pre-token frequencies. A pre-token that is itself a
vocabulary entry is one token and is summed at once: this departs from a join of all
pre-tokens, but the vocabulary is a table of fixed size that each task holds, and its
entries are most of a text. The others become one row per pre-token and block of documents, with the
frequencies of the block's documents packed into it. These rows are exchanged by
pre-token; there each distinct pre-token is merged once and its count joins all its rows.
The products, summed by document within the task, are exchanged by block and added up.

A pre-token that many documents of a block hold is salted by block, so that no task gets
all rows of a common one; it is then merged once for each salt.

Defined results: a null or empty text has 0 tokens; repeated rows are each counted, and ids
may be null; special strings count one token; whole texts are counted, however long; an empty
table gives an empty table; extra columns are kept, but output columns replace input columns
of the same name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.bpe import byte_bpe
from docloom.llm.common import fresh, trim_memory, utf8_buffer

#: Documents (at most 65536) and bytes of text whose frequencies share one row per pre-token.
BLOCK_DOCS, BLOCK_BYTES = 8192, 32 << 20
#: A pre-token in more than this share of a block's documents is salted.
COMMON, SALTS = 1 / 16, 4096
#: Blocks whose sums a task holds at once.
HELD = 256

_PAIR = np.dtype([("doc", "<u2"), ("n", "<u2")])
_SUM = np.dtype([("doc", "<u2"), ("n", "<u4")])


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def _salt(block: int) -> int:
    """1 to SALTS; a block's number is that of its first row, whose low bits are alike in all partitions."""
    return 1 + ((block * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 32) % SALTS


def _frequencies(path: str):
    """Rows of documents (piece null, doc set) and rows of pre-tokens (pairs set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        known = {t.decode() for t in bpe.ranks if _is_text(t)}
        base, docs, packed, size = None, 0, {}, 0
        held, before = Counter(), 0  # documents with each common pre-token, and documents, of the blocks so far

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal before
            n = len(packed)
            before += docs
            salt = []
            for piece, v in packed.items():  # a pre-token is salted by its share of all that the task has read
                if len(v) > 2 * COMMON * docs or piece in held:
                    held[piece] += len(v) // 2
                salt.append(_salt(base) if held.get(piece, 0) > COMMON * before else 0)
            for piece in [x for x, c in held.items() if c <= COMMON * before]:
                del held[piece]
            pairs = pa.array([np.array(v, np.uint16).tobytes() for v in packed.values()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(packed, pa.string()), pa.array(salt, pa.int32()), pa.array(np.full(n, base or 0), pa.int64()), pairs, pa.nulls(n, kind)], ["piece", "salt", "block", "pairs", "doc"])

        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                texts, at, sums, sizes, blocks = part.column(1).to_pylist(), [], [], [], []
                if base is None:
                    base = part.column(0)[0].as_py()
                for k, text in enumerate(texts):
                    text, now = text or "", 0
                    for stretch, special in bpe.parts(text):
                        if special is not None:
                            now += 1
                            continue
                        for piece, n in Counter(bpe.pieces(stretch)).items():
                            if piece in known:
                                now += n
                                continue
                            to = packed.setdefault(piece, [])
                            while n > 0:
                                to += (docs + k, min(n, 65535))
                                n -= 65535
                    at.append(docs + k)
                    sums.append(now)
                    sizes.append(len(text.encode()))
                docs, size = docs + len(part), size + sum(sizes)
                doc = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(sums, pa.int64()), pa.array(sizes, pa.int64()), part.column(2)], ["at", "known", "n_bytes", "rest"])
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.array([_salt(base)] * n, pa.int32()), pa.array([base] * n, pa.int64()), pa.nulls(n, pa.binary()), doc], ["piece", "salt", "block", "pairs", "doc"])
                if docs + 256 > BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield flush(doc.type)
                    base, docs, packed, size = None, 0, {}, 0
        if packed:
            yield flush(doc.type)
        packed = {}
        trim_memory()

    return run


def _products(path: str):
    """Over rows sorted by pre-token: documents as they are, and (block, sums by document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        last, n = None, 0
        slots: dict[int, int] = {}
        sums = np.zeros((HELD, BLOCK_DOCS), np.int64)

        def flush(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            blocks, data = [], []
            for block, slot in slots.items():
                some = np.flatnonzero(sums[slot])
                out = np.empty(len(some), _SUM)
                out["doc"] = some
                left = sums[slot, some]
                while left.any():  # a sum beyond 32 bits takes several rows
                    out["n"] = np.minimum(left, 0xFFFFFFFF)
                    left = left - out["n"]
                    blocks.append(block)
                    data.append(out.tobytes())
            slots.clear()
            sums[:] = 0
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(data, pa.binary()), pa.nulls(len(blocks), kind)], ["block", "sums", "doc"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(4).type
            docs = batch.filter(batch.column(0).is_null())
            if len(docs):
                yield pa.RecordBatch.from_arrays([docs.column(2), pa.nulls(len(docs), pa.binary()), docs.column(4)], ["block", "sums", "doc"])
            batch = batch.filter(batch.column(0).is_valid())
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                counts = []
                for piece in part.column(0).to_pylist():
                    if piece != last:
                        last, n = piece, bpe.count_piece(piece)
                    counts.append(n)
                raw, at = utf8_buffer(part.column(3))
                pairs = np.frombuffer(raw.tobytes(), _PAIR)
                sizes = np.diff(at) // _PAIR.itemsize
                block = part.column(2).to_numpy()
                for own in np.unique(block):
                    if own not in slots:
                        if len(slots) == HELD:
                            yield from flush(kind)
                        slots[int(own)] = len(slots)
                    rows = block == own
                    pick = np.repeat(rows, sizes)
                    np.add.at(sums[slots[int(own)]], pairs["doc"][pick], np.repeat(np.array(counts, np.int64)[rows], sizes[rows]) * pairs["n"][pick])
        if kind is not None:
            yield from flush(kind)
        trim_memory()

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by block, its sums first: documents with their counts."""
    now, total = None, np.zeros(BLOCK_DOCS, np.int64)
    for batch in batches:
        block = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if block[i] != now:
                now = block[i]
                total[:] = 0
            part = batch.slice(i, j - i)
            for data in part.column(1).drop_null():
                got = np.frombuffer(data.as_buffer(), _SUM)
                total[got["doc"]] += got["n"]
            docs = part.column(2).drop_null()
            if len(docs):
                n = total[docs.field("at").to_numpy()] + docs.field("known").to_numpy()
                yield pa.RecordBatch.from_arrays([docs.field("rest"), docs.field("n_bytes"), pa.array(n, pa.int64())], ["rest", "n_bytes", "n"])


def count_tokens(df: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """df (without its text) with out_col, the number of tokens of each whole text, and n_bytes, its UTF-8 length."""
    others = [c for c in df.columns if c not in (text_col, out_col, "n_bytes")]
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"), F.struct(*others, F.lit(0).alias(fresh(others, "none")[0])).alias("rest"))
    rest = rows.schema["rest"].dataType
    doc = T.StructType().add("at", "integer").add("known", "long").add("n_bytes", "long").add("rest", rest)
    freq = rows.mapInArrow(_frequencies(path), T.StructType().add("piece", "string").add("salt", "integer").add("block", "long").add("pairs", "binary").add("doc", doc))
    sorted_ = freq.repartition("piece", "salt").sortWithinPartitions("piece", "block")
    parts = sorted_.mapInArrow(_products(path), T.StructType().add("block", "long").add("sums", "binary").add("doc", doc))
    ordered = parts.repartition("block").sortWithinPartitions("block", F.col("sums").isNull())
    out = ordered.mapInArrow(_totals, T.StructType().add("rest", rest).add("n_bytes", "long").add("n", "long"))
    return out.select(*[F.col("rest")[c].alias(c) for c in others], "n_bytes", F.col("n").alias(out_col))
