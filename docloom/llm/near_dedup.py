"""Near-duplicate documents by MinHash, banding and sequential Bayesian verification.

A document's set is its distinct runs of ``size`` words (A-Z lower-cased); a document of
fewer words has its whole word sequence as its one element; one without words has none.
Documents are linked if the Jaccard similarity of their sets is at least ``percent`` / 100.

1. One pass makes each document's set size, set fingerprint and signature of BANDS * ROWS
   minimum hashes. Documents of equal sets are one class and go on as one row.
2. Rows that agree on a band are members of a bucket, whose head is its least row. Members
   are compared with heads only, and the links found are contracted into components.
3. A bucket whose members still lie in several components is open. Rows of open buckets are
   compared beyond their heads where they share one of their rarest shingles (by the number of
   such rows that hold it): two sets that reach the threshold must share one among as many as
   their sizes allow to differ. Rows made of the same few passages share them too, so each row
   brings a sketch, one bit of each signature value, and a pair is made only if its sketches
   agree as two of the threshold do except with probability MISS. So neither a large group of copies
   nor common passages make all pairs.
4. Every comparison is a star: a head, and the rows it is compared with, in groups of STAR.
   Signatures travel first: a task compares them batch by batch and drops a pair once the
   posterior probability that its similarity reaches the threshold is below MISS. The texts
   of the survivors follow, and the link is confirmed on their full sets.
5. Connected components of all links give each document its component.

At similarity 0.85 a pair shares no band with probability (1 - 0.85**8)**48 = 2e-7.
Elements are compared as 64-bit hashes: two sets of n elements share one by chance
with probability n**2 / 2**64, which moves a similarity by 1 / n.

Defined results: null texts and texts without words are alone in their component; a null
id takes part by its text and gets the component's least id; repeated rows are in one
component, and of the rows of its least id the first is kept; ties between heads go to the
least row; whole texts are read, however long; an empty table gives an empty table; extra
columns are not carried by near_duplicates and are unchanged by keep_one, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import textvec
from docloom.llm.common import Scratch, fresh, trim_memory, utf8_buffer
from docloom.llm.components import connected_components

BANDS, ROWS = 48, 8
#: Signature values compared at once, and the probability at which a pair is given up.
BATCH, MISS = 32, 1e-7
#: Rows that are compared with one copy of a head, and ratio of set sizes that share a key of a rare shingle.
STAR, RATIO = 64, 1.04
#: Row numbers that are broadcast; beyond, both sides are exchanged.
MOST_ROWS = 1 << 20

_HASHES = BANDS * ROWS
_FACTORS = (textvec.mix(np.arange(1, _HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signatures(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[text, hash] minimum of each hash over a text's shingles, its low 16 bits."""
    n = len(at) - 1
    out = np.zeros((n, _HASHES), np.uint16)
    full = np.flatnonzero(at[1:] > at[:-1])
    for part in _runs(at, full):
        lo, hi = at[part[0]], at[part[-1] + 1]
        first = at[part] - lo
        low = shingles[lo:hi].astype(np.uint32)
        high = (shingles[lo:hi] >> np.uint64(32)).astype(np.uint32)
        x = np.empty_like(low)
        for j in range(_HASHES):  # the j-th hash of an element: low half * odd factor + high half
            np.multiply(low, _FACTORS[j], out=x)
            x += high
            out[part, j] = np.minimum.reduceat(x, first)
    return out


def _runs(at: np.ndarray, rows: np.ndarray, size: int = 1 << 15) -> Iterator[np.ndarray]:
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(at[rows], at[rows[a]] + size)))
        yield rows[a:b]
        a = b


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8_buffer(batch.column(1))
            for a, b in textvec.blocks(offsets, textvec.BLOCK):
                words, at = textvec.words_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], fold=True)
                shingles, at = textvec.shingles_of(words, at, size)
                sig = signatures(shingles, at)
                prints = np.array([np.frombuffer(hashlib.blake2b(shingles[i:j].tobytes(), digest_size=16).digest(), np.int64) for i, j in zip(at, at[1:], strict=False)], np.int64).reshape(-1, 2)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(3), pa.array(np.diff(at), pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([s.tobytes() for s in sig], pa.binary())], ["row", "text", "id", "rest", "n", "f1", "f2", "sig"])

    return run


@lru_cache(maxsize=8)
def least_matches(percent: int) -> tuple[int, ...]:
    """For 1, 2, .. batches compared: the least number of matches with which a pair is kept.

    With a uniform prior, the similarity after m matches of k is Beta(m + 1, k - m + 1).
    """
    grid = (np.arange(20000) + 0.5) / 20000
    out = []
    for k in range(BATCH, _HASHES + 1, BATCH):
        m = np.arange(k + 1)[:, None]
        log = m * np.log(grid) + (k - m) * np.log1p(-grid)
        density = np.exp(log - log.max(1, keepdims=True))
        above = density[:, grid >= percent / 100].sum(1) / density.sum(1)
        out.append(int(np.argmax(above >= MISS)))
    return tuple(out)


def _stars(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches sorted into stars, and the place of each row's head; a slice cut from its head gets it in front."""
    head: pa.RecordBatch | None = None
    for batch in batches:
        sizes = batch.column(4).to_numpy()
        ends, at = np.cumsum(sizes), 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
            part, at = batch.slice(at, end - at), end
            if part.column(2)[0].as_py():
                part = pa.Table.from_batches([head, part]).combine_chunks().to_batches()[0]
            place = np.maximum.accumulate(np.where(part.column(2).to_numpy(zero_copy_only=False), -1, np.arange(len(part))))
            head = part.slice(int(place[-1]), 1)
            yield part, place


def _pairs(part: pa.RecordBatch, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([part.column(1).take(pa.array(a)), part.column(1).take(pa.array(b))], ["head", "row"])


def _similar(percent: int):
    """Of stars of signatures: (head, row) that may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, place in _stars(batches, 4 << 20):
            sig = np.frombuffer(utf8_buffer(part.column(3))[0], np.uint16).reshape(-1, _HASHES)
            n = part.column(5).to_numpy()
            b = np.flatnonzero(place < np.arange(len(place)))
            a = place[b]
            fits = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
            a, b = a[fits], b[fits]
            matches = np.zeros(len(a), np.int32)
            for k, least in enumerate(least_matches(percent)):
                cut = slice(k * BATCH, (k + 1) * BATCH)
                matches += (sig[a, cut] == sig[b, cut]).sum(1, dtype=np.int32)
                keep = matches >= least
                a, b, matches = a[keep], b[keep], matches[keep]
            yield _pairs(part, a, b)
        trim_memory()

    return run


def _linked(size: int, percent: int):
    """Of stars of texts: (head, row) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, place in _stars(batches, textvec.BLOCK):
            words, at = textvec.words_of(*utf8_buffer(part.column(3)), fold=True)
            sets, at = textvec.shingles_of(words, at, size)
            a, b = [], []
            for i, h in enumerate(place.tolist()):
                if i != h and _reaches(sets[at[h] : at[h + 1]], sets[at[i] : at[i + 1]], percent):
                    a.append(h)
                    b.append(i)
            yield _pairs(part, np.array(a, np.int64), np.array(b, np.int64))
        trim_memory()

    return run


def _reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have a similarity of percent / 100."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _small(table: DataFrame, rows: int) -> DataFrame:
    """table, to be broadcast if it has at most so many rows."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def _dealt(pairs: DataFrame, table: DataFrame, payload: Column, scratch: Scratch, *more: str) -> DataFrame:
    """Stars of pairs (head, row): head, row, member, payload, its bytes, and more columns of table; heads come first."""
    counts = pairs.groupBy("head").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    members = pairs.join(counts, "head").select("row", "head", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("member"))
    heads = counts.select(F.col("head").alias("row"), "head", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"))
    roles = scratch.write(members.unionByName(heads), "roles")
    wanted = table.select("row", payload.alias("payload"), *more).join(_small(roles.select("row").distinct(), MOST_ROWS), "row", "left_semi")
    stars = roles.join(wanted, "row").repartition("head", "salt").sortWithinPartitions("head", "salt", "member")
    return stars.select("head", "row", "member", "payload", F.octet_length("payload").cast("bigint").alias("bytes"), *more)


def _links(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, size: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (head, row) that are linked, as (a, b)."""
    like = scratch.write(_dealt(pairs, sigs, F.col("sig"), scratch, "n").mapInArrow(_similar(percent), "head bigint, row bigint"), "like")
    return scratch.write(_dealt(like, sets, F.col("text"), scratch).mapInArrow(_linked(size, percent), "head bigint, row bigint").select(F.col("head").alias("a"), F.col("row").alias("b")), name)


def _with_root(rows: DataFrame, roots: DataFrame, row: str, name: str) -> DataFrame:
    """rows with the component of a column; a row without links is its own."""
    return rows.join(roots.select(F.col("node").alias(row), F.col("root").alias(name)), row, "left").withColumn(name, F.coalesce(name, row))


def _connect(members: DataFrame, sigs: DataFrame, sets: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """(node, root) of every row that is linked to another."""
    given = (sigs, sets, size, percent, scratch)
    stars = scratch.write(members.where("row <> head").select("head", "row").distinct(), "stars")
    links = _links(stars, *given, "links-1")
    roots = connected_components(links, scratch, "roots-1")
    apart = _with_root(_with_root(stars, roots, "head", "c1"), roots, "row", "c2").where("c1 <> c2").select("head", "row")
    open_keys = members.join(scratch.write(apart, "apart"), ["head", "row"], "left_semi").select("key").distinct()
    rows = scratch.write(_with_root(members.join(open_keys, "key", "left_semi").select("row").distinct(), roots, "row", "comp"), "open")
    if rows.isEmpty():
        return roots
    pairs = scratch.write(_rare_pairs(rows, sigs, sets, size, percent, scratch), "rare-pairs")
    more = _links(pairs, *given, "links-2").unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return connected_components(more, scratch, "roots-2")


def _shingled(size: int):
    """(row, comp, n, shingle) of (row, comp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8_buffer(batch.column(2))
            for a, b in textvec.blocks(offsets, textvec.BLOCK):
                words, at = textvec.words_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], fold=True)
                shingles, at = textvec.shingles_of(words, at, size)
                n = np.diff(at)
                row, comp = (np.repeat(batch.column(i).slice(a, b - a).to_numpy(), n) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(comp), pa.array(np.repeat(n, n)), pa.array(shingles.view(np.int64))], ["row", "comp", "n", "shingle"])
        trim_memory()

    return run


@F.arrow_udf(T.StructType([T.StructField(f"s{k}", T.LongType()) for k in range(_HASHES // 64)]))
def _sketch(sig: pa.Array) -> pa.Array:
    bits = np.packbits(np.frombuffer(utf8_buffer(sig)[0], np.uint16).reshape(-1, _HASHES) & 1, axis=1).view(np.int64)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(bits[:, k])) for k in range(bits.shape[1])], [f"s{k}" for k in range(bits.shape[1])])


@lru_cache(maxsize=8)
def least_agreement(percent: int) -> int:
    """Bits of two sketches that agree at least, except with probability MISS, at the threshold: each does if the minimum is the same, and else every other time."""
    p, below = (1 + percent / 100) / 2, 0.0
    for k in range(_HASHES + 1):
        below += math.exp(math.lgamma(_HASHES + 1) - math.lgamma(k + 1) - math.lgamma(_HASHES - k + 1) + k * math.log(p) + (_HASHES - k) * math.log1p(-p)) if p < 1 else float(k == _HASHES)
        if below > MISS:
            return k
    return _HASHES


def _rare_pairs(rows: DataFrame, sigs: DataFrame, sets: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (head, row) of different components among rows (row, comp) that may reach the threshold by their rarest shingles and their sketches.

    If sets of m <= n elements reach it, they share at least ``least`` = percent (m + n) / (100 + percent)
    elements, so the first shared one in any order of shingles is among the first m - least + 1 of the
    one and n - least + 1 of the other, and the elements from there on must be enough for ``least``.
    """
    texts = sets.join(_small(rows, MOST_ROWS), "row").select("row", "comp", "text")
    shingles = scratch.write(texts.mapInArrow(_shingled(size), "row bigint, comp bigint, n bigint, shingle bigint"), "shingles")
    held = shingles.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    ranked = shingles.join(held, "shingle").groupBy("row", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("found"))  # the shingles of one text
    n, alone = F.col("n"), F.col("n") - F.size("found")  # shingles that no other row holds come first
    entries = ranked.select("row", "comp", "n", alone.alias("alone"), F.posexplode(F.slice("found", 1, F.greatest(F.floor(n * (100 - percent) / 100) + 1 - alone, F.lit(0)).cast("int"))).alias("i", "x"))
    sketches = sigs.select("row", _sketch("sig").alias("sketch"))
    entries = scratch.write(entries.select("row", "comp", "n", (F.col("alone") + F.col("i") + 1).alias("at"), "x.shingle").join(sketches, "row"), "entries")
    least = lambda m: F.ceil(percent * (m + n) / (100 + percent) - 1e-9)
    kind = lambda m: F.floor(F.log(m) / float(np.log(RATIO)) - 1e-9)
    # The smaller set stands under its own size class, the larger one under all that its place allows.
    one = entries.where(F.col("at") <= n - least(n) + 1).select("shingle", kind(n).alias("kind"), F.col("row").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("m"), F.col("at").alias("at_a"), F.col("sketch").alias("sketch_a"))
    two = entries.select("shingle", "row", "comp", "n", "at", "sketch", F.explode(F.sequence(kind(n * percent / 100), kind(n))).alias("kind"))
    two = two.where(F.col("at") <= n - least(F.floor(F.pow(F.lit(RATIO), F.col("kind")))) + 1)
    fits = (F.col("ca") != F.col("comp")) & (F.col("m") <= n) & (100 * F.col("m") >= percent * n) & (1 + F.least(F.col("m") - F.col("at_a"), n - F.col("at")) >= least(F.col("m")))
    differ = sum((F.bit_count(F.col(f"sketch.s{k}").bitwiseXOR(F.col(f"sketch_a.s{k}"))) for k in range(_HASHES // 64)), F.lit(0))
    return two.join(one, ["shingle", "kind"]).where(fits & (differ <= _HASHES - least_agreement(percent))).select(F.least("a", "row").alias("head"), F.greatest("a", "row").alias("row")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 85) -> DataFrame:
    """One row per row of df: row (its number), id, n_shingles, component_id, root (number of the
    component) and kept (whether the id is the component's)."""
    with Scratch(df.sparkSession, "near") as scratch:
        scratch.kept.add("out")
        return _find(df, id_col, text_col, size, percent, (), scratch)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 85) -> DataFrame:
    """The rows of df without near-duplicates: of each component the row of the least id, the first such if it is repeated."""
    with Scratch(df.sparkSession, "near") as scratch:
        scratch.kept |= {"sets", "gone"}
        others = tuple(c for c in df.columns if c not in (id_col, text_col))
        found = _find(df, id_col, text_col, size, percent, others, scratch)
        stay = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("row").alias("row")).select("row")
        gone = _small(scratch.write(found.select("row").join(stay, "row", "left_anti"), "gone"), MOST_ROWS)
        sets = scratch.read("sets", _sets_like(_numbered(df, id_col, text_col, others)))
        column = {id_col: F.col("id"), text_col: F.col("text").cast(df.schema[text_col].dataType)}
        return sets.join(gone, "row", "left_anti").select(*[column.get(c, F.col("rest")[c]).alias(c) for c in df.columns])


def _numbered(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"), F.struct(F.lit(0).alias(fresh(list(carry), "none")[0]), *carry).alias("rest"))


def _sets_like(numbered: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return numbered.select("row", "text", "id", "rest", zero.alias("n"), zero.alias("f1"), zero.alias("f2"), F.lit(b"").alias("sig"))


def _find(df: DataFrame, id_col: str, text_col: str, size: int, percent: int, carry: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """As near_duplicates; the table sets, with texts and carried columns by row, is left in scratch."""
    numbered = _numbered(df, id_col, text_col, carry)
    sets = scratch.write(numbered.mapInArrow(_sets(size), _sets_like(numbered).schema), "sets")
    classes = scratch.write(sets.where("n > 0").groupBy("f1", "f2").agg(F.min("row").alias("rep"), F.min("id").alias("least"), F.min("n").alias("n"), F.count("*").alias("copies")), "classes")
    # Sets of n elements can be similar without being equal only if n / (n + 1) reaches the threshold.
    reps = classes.where(F.col("n") * (100 - percent) >= percent).select(F.col("rep").alias("row"))
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * 2 * ROWS + 1, F.lit(2 * ROWS)))))
    buckets = sets.select("row", "sig").join(reps, "row", "left_semi").select("row", band.alias("key"))
    heads = buckets.groupBy("key").agg(F.min("row").alias("head"), F.count("*").alias("c")).where("c > 1").select("key", "head")
    members = scratch.write(buckets.join(heads, "key").select("key", "row", "head"), "members")
    sigs = scratch.write(sets.select("row", "n", "sig").join(_small(members.select("row").distinct(), MOST_ROWS), "row", "left_semi"), "sigs")
    roots = _connect(members, sigs, sets.select("row", "text"), size, percent, scratch)
    # The class of a row, then the least id and row of all classes of its component.
    linked = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("f1", "f2", "rep", "least", F.coalesce("root", "rep").alias("root"), "copies", F.col("root").isNotNull().alias("many"))
    of_root = linked.where("many").groupBy("root").agg(F.min("least").alias("root_least"))
    known = linked.where("copies > 1 or many").join(of_root, "root", "left").select("f1", "f2", F.when(F.col("many"), F.col("root_least")).otherwise(F.col("least")).alias("component_id"), "root")
    rows = sets.select("row", "id", "n", "f1", "f2")
    out = rows.join(known, ["f1", "f2"], "left").select("row", F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("id")).alias("component_id"), F.when(F.col("n") > 0, F.coalesce("root", "row")).otherwise(F.col("row")).alias("root"))
    return scratch.write(out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))), "out")
