"""Near and semantic duplicates: SimHash with a Hamming index, a funnel of three stages, merging by priority, figures within documents."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import seams
from docloom.functions.groups import BLOCK, blocked, runs
from docloom.plans.retrieval import SCALE, _matrix, _unit
from docloom.store import batches_of
from docloom.store import cut as placed
from docloom.store import written as cut

#: Values that share a key of the Hamming index and are paired; beyond, the key is made finer.
PAIRED = 64
#: Rows whose words are numbered at once, and by how much the candidates of a text that are compared grow from round to round.
ROWS, GROWTH = 256, 4


# -- SimHash

@F.arrow_udf(T.LongType())
def _simhash(words: pa.Array) -> pa.Array:
    out = []
    for at in range(0, len(words), ROWS):
        part = words.slice(at, ROWS)
        coded = part.flatten().dictionary_encode()  # a word's digest is made once for all these rows
        digests = b"".join([hashlib.md5(w.encode()).digest()[:8] for w in coded.dictionary.to_pylist()])
        signs = 2 * np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).astype(np.int8) - 1
        codes, begin = coded.indices.to_numpy(zero_copy_only=False), 0
        for n in pc.fill_null(pc.list_value_length(part), 0).to_pylist():
            more = signs[codes[begin : begin + n]].sum(0, dtype=np.int32) > 0
            out.append(int(np.packbits(more).view(">i8")[0]) if n else None)
            begin += n
    return pa.array(out, pa.int64())


def simhash(words: Column) -> Column:
    """64 bits of an array of words: a bit is set if, by their number, more words have it set in the first half of their MD5
    than not. Null without words."""
    return _simhash(words)


def simhash_rows(rows: DataFrame, words: Column, *keep: str | Column) -> DataFrame:
    """rows' columns of keep, with bits, the SimHash of words. Values are made here, once: a filter on bits in the same plan would make
    them a second time."""
    with batches_of(rows.sparkSession, ROWS):
        return cut(rows.select(*keep, simhash(words).alias("bits")))


def hamming_masks(within: int, bits: int = 64) -> list[list[tuple[int, int]]]:
    """Levels of (mask, number of its parent's mask): of values ``within`` bits of each other some mask of each level shows equal bits.

    The first level cuts the bits into twice as many blocks as may differ and takes half of them; each
    further level cuts what a mask leaves open into one block more than may differ and adds one of them.
    """
    def cut_up(places: list[int], n: int) -> list[list[int]]:
        return [x.tolist() for x in np.array_split(np.array(places), n) if len(x)]

    mask = lambda places: sum(1 << p for p in places)
    blocks = cut_up(list(range(bits)), 2 * within or 1)
    chosen = [sorted(sum(some, [])) for some in combinations(blocks, within)] if within else [list(range(bits))]
    levels, parents = [[(mask(x), 0) for x in chosen]], chosen
    while len(levels) < 3 and within:
        finer = [(sorted([*own, *more]), k) for k, own in enumerate(parents) for more in cut_up([p for p in range(bits) if p not in own], within + 1)]
        levels.append([(mask(x), k) for x, k in finer])
        parents = [x for x, _ in finer]
    return levels


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hamming_pairs(rows: DataFrame, item_id: str, bits: str, within: int = 3) -> DataFrame:
    """(a, b, distance): pairs of distinct values of bits within so many bits, by the least id of each value; a < b as ids.

    Every pair is found: values are keyed by the bits under each mask, and pairs meet under a key. A key of
    more than PAIRED values is replaced by finer ones, so no key makes a table of all pairs. Rows of equal
    bits count once; null bits and ids are left out. Keys are many times the values, which Spark does not foresee; where the values
    look small it would broadcast the keys through the driver, so the joins are told to sort.
    """
    values = cut(rows.where(F.col(item_id).isNotNull() & F.col(bits).isNotNull()).groupBy(F.col(bits).alias("bits")).agg(F.min(item_id).alias("id")))
    levels, keyed, open_ = hamming_masks(within), [], values.withColumn("parent", F.lit(-1))
    for depth, level in enumerate(levels):
        masks = F.array(*[F.lit(_signed(m)).cast("bigint") for m, _ in level])
        if depth == 0:
            number = F.explode(F.sequence(F.lit(0), F.lit(len(level) - 1)))
        else:
            first = [next(k for k, (_, parent) in enumerate(level) if parent == p) for p in range(len(levels[depth - 1]))]
            number = F.explode(F.sequence(F.get(F.array(*map(F.lit, first)), F.col("parent")), F.get(F.array(*map(F.lit, [*first[1:], len(level)])), F.col("parent")) - 1))
        own = open_.select("bits", "id", number.alias("mask")).withColumn("key", F.col("bits").bitwiseAND(F.get(masks, F.col("mask"))))
        if depth == len(levels) - 1:
            keyed.append(own.withColumn("level", F.lit(depth)))
            break
        counts = own.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        own = cut(own.join(counts.hint("merge"), ["mask", "key"]))
        keyed.append(own.where(F.col("n") <= PAIRED).drop("n").withColumn("level", F.lit(depth)))
        open_ = own.where(F.col("n") > PAIRED).select("bits", "id", F.col("mask").alias("parent"))
        if open_.isEmpty():
            break
    both = keyed[0]
    for more in keyed[1:]:
        both = both.unionByName(more)
    a, b = both.select("level", "mask", "key", F.col("bits").alias("x"), F.col("id").alias("i")), both.select("level", "mask", "key", F.col("bits").alias("y"), F.col("id").alias("j"))
    distance = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    near = a.join(b.hint("merge"), ["level", "mask", "key"]).where((F.col("i") < F.col("j")) & (distance <= within))
    return near.select(F.col("i").alias("a"), F.col("j").alias("b"), distance.alias("distance")).distinct()


@F.arrow_udf(T.StructType([T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType()))]))
def _counted(words: pa.Array) -> pa.Array:
    """The distinct words of each text and how often each stands there."""
    kind, done = pa.struct([("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))]), []
    for at in range(0, len(words), ROWS):
        part = words.slice(at, ROWS)
        coded, sizes = part.flatten().dictionary_encode(), pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
        many = max(1, len(coded.dictionary))
        keys, counts = np.unique(np.repeat(np.arange(len(part), dtype=np.int64), sizes) * many + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        ends = pa.array(np.searchsorted(keys, np.arange(len(part) + 1, dtype=np.int64) * many), pa.int32())
        lists = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(keys % many))), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32()))
        done.append(pa.StructArray.from_arrays(lists, fields=list(kind)))
    return pa.concat_arrays(done) if done else pa.array([], kind)


@F.arrow_udf(T.DoubleType())
def _cosine(left: pa.Array, right: pa.Array) -> pa.Array:
    out = []
    for at in range(0, len(left), ROWS):
        (a, x), (b, y) = ([side.slice(at, ROWS).field(k) for k in (0, 1)] for side in (left, right))
        coded = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        counts = pa.concat_arrays([x.flatten(), y.flatten()]).to_numpy(zero_copy_only=False).astype(np.int64)
        found = np.zeros(max(1, len(coded.dictionary)), np.int64)  # the left text's counts, by code
        i, j = 0, len(a.flatten())
        for n, m in zip(pc.list_value_length(a).to_pylist(), pc.list_value_length(b).to_pylist(), strict=True):
            nx, ny = counts[i : i + n], counts[j : j + m]
            found[codes[i : i + n]] = nx
            out.append(float(found[codes[j : j + m]] @ ny) / (float(nx @ nx) ** 0.5 * float(ny @ ny) ** 0.5))
            found[codes[i : i + n]] = 0
            i, j = i + n, j + m
    return pa.array(out, pa.float64())


def _word_lists(pairs: DataFrame, docs: DataFrame, item_id: str, words: Callable[[], Column]) -> DataFrame:
    """(item_id, w): the words of each text of pairs that has any, with their counts; rows of one id are one text."""
    ids = pairs.select(F.col("a").alias(item_id)).union(pairs.select("b")).distinct()
    lists = docs.join(ids, item_id, "left_semi").select(item_id, words().alias("w")).where(F.size("w") > 0)
    return cut(lists.groupBy(item_id).agg(F.flatten(F.collect_list("w")).alias("w")).select(item_id, _counted("w").alias("w")))


def _cosines(pairs: DataFrame, lists: DataFrame, item_id: str) -> DataFrame:
    one = lambda to: lists.select(F.col(item_id).alias(to), F.col("w").alias(f"w_{to}"))
    met = pairs.join(one("a"), "a").join(one("b"), "b")
    return met.withColumn("cosine", F.round(_cosine("w_a", "w_b"), SCALE)).drop("w_a", "w_b")


def term_cosine(pairs: DataFrame, docs: DataFrame, item_id: str, words: Callable[[], Column]) -> DataFrame:
    """pairs (a, b, ..) with cosine, rounded, of the word counts of both; only texts of pairs are read into words. A pair with
    a text without words is left out."""
    return _cosines(pairs, _word_lists(pairs, docs, item_id, words), item_id)


def first_close(pairs: DataFrame, docs: DataFrame, item_id: str, words: Callable[[], Column], least: float) -> DataFrame:
    """(b, near): of each b of pairs (a, b) the least a whose cosine, as by term_cosine, is at least ``least``.

    Candidates are compared in order, a few at first and more from round to round, of those b alone that none was found for: of
    n copies with small changes, which make n * n pairs, nearly each is compared with the first one only.
    """
    place = F.row_number().over(Window.partitionBy("b").orderBy("a"))
    left, upto, out = cut(pairs.select("a", "b").distinct().withColumn("place", place)), 1, None
    with batches_of(docs.sparkSession, ROWS):
        lists = _word_lists(pairs, docs, item_id, words)
        while not left.isEmpty():
            own = left.where(F.col("place") <= upto).select("a", "b")
            found = cut(_cosines(own, lists, item_id).where(F.col("cosine") >= least).groupBy("b").agg(F.min("a").alias("near")))
            out = found if out is None else out.unionByName(found)
            left = cut(left.where(F.col("place") > upto).join(found, "b", "left_anti"))
            upto *= GROWTH
    return pairs.select("b", F.col("a").alias("near")).limit(0) if out is None else out


def funnel(docs: DataFrame, item_id: str, text: str, within: int = 3, least: float = 0.9) -> DataFrame:
    """(item_id, stage, of): exact copies by SHA-256, then candidates by SimHash, then those by the cosine of word counts.

    ``exact``: of is the least id of the text. ``similar``: of is the least lesser id among first copies whose SimHash is within
    so many bits and whose cosine is at least ``least``. Else ``unique``, of null. Candidates are first copies only, and only
    texts of close values are compared. Values shared by several texts are compared in full with the first of their value. A
    null text is unique. Digests and SimHash values are made where the texts are read, which are not exchanged for them.
    """
    words = lambda: seams.tokens(F.col(text))
    digest = F.sha2(F.col(text).cast("binary"), 256)
    rows = simhash_rows(docs.where(F.col(item_id).isNotNull()), words(), item_id, digest.alias("digest"))
    firsts = rows.where("digest is not null").groupBy("digest").agg(F.min(item_id).alias("first"))
    coded = cut(rows.join(firsts.select(F.col("first").alias(item_id)), item_id, "left_semi").select(item_id, "bits"))
    same = coded.where("bits is not null").groupBy("bits").agg(F.min(item_id).alias("head")).hint("merge")  # nearly as many as the texts
    heads = coded.join(same, "bits").where(F.col(item_id) != F.col("head")).select(F.col("head").alias("a"), F.col(item_id).alias("b"))
    # Of values close to each other all texts are candidates, each against the first of the other value.
    close = cut(hamming_pairs(coded, item_id, "bits", within))
    texts = coded.join(same, "bits").select(F.col(item_id).alias("i"), "head")
    one = close.join(texts.withColumnRenamed("head", "a"), "a").select(F.col("b").alias("x"), F.col("i").alias("y"))
    two = close.join(texts.withColumnRenamed("head", "b"), "b").select(F.col("a").alias("x"), F.col("i").alias("y"))
    pairs = cut(heads.unionByName(one.unionByName(two).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct())
    linked = first_close(pairs, docs, item_id, words, least).withColumnRenamed("b", item_id)
    out = rows.select(item_id, "digest").join(firsts, "digest", "left").join(linked, item_id, "left")
    exact = F.col("first") < F.col(item_id)
    stage = F.when(exact, "exact").when(F.col("near").isNotNull(), "similar").otherwise("unique")
    return out.select(item_id, stage.alias("stage"), F.when(exact, F.col("first")).otherwise(F.col("near")).alias("of"))


# -- semantic duplicates

def close_pairs(items: DataFrame, item_id: str, by: str, vector: str, least: float, block: int = BLOCK) -> DataFrame:
    """(by, a, b, similarity): pairs of items of equal ``by`` whose cosine, rounded, is at least ``least``; a < b.

    Vectors of a group are multiplied in matrix blocks; only close pairs leave a task.
    """
    kinds = {c: items.schema[c].dataType.simpleString() for c in (item_id, by)}
    rows = items.where(F.col(item_id).isNotNull() & F.col(by).isNotNull() & F.col(vector).isNotNull()).select(by, F.col(item_id).alias("__id"), F.col(vector).cast("array<double>").alias("__v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 3):
            for mine, theirs, scores in _products(group, least):
                ids = group.column("__id").combine_chunks()
                yield pa.RecordBatch.from_arrays([group.column(0).combine_chunks().take(pa.array(mine)), ids.take(pa.array(mine)), ids.take(pa.array(theirs)), pa.array(scores)], [by, "a", "b", "similarity"])

    return blocked(rows, by, "__id", block).mapInArrow(run, f"`{by}` {kinds[by]}, a {kinds[item_id]}, b {kinds[item_id]}, similarity double")


def _products(group: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (lesser id, greater id) and similarities of the pairs of a block of at least ``least``; stripes bound the memory."""
    ids = group.column("__id").to_numpy(zero_copy_only=False)
    vectors, left = _unit(_matrix(group.column("__v"))), group.column("left").to_numpy(zero_copy_only=False)
    same = group.column("lo")[0] == group.column("hi")[0]
    right = np.arange(len(ids)) if same else np.flatnonzero(~left)
    mine = np.arange(len(ids)) if same else np.flatnonzero(left)
    for i in range(0, len(mine), 256):
        part = mine[i : i + 256]
        scores = np.round(vectors[part] @ vectors[right].T, SCALE) + 0.0
        wanted = (scores >= least) & (ids[part][:, None] < ids[right][None, :] if same else ids[part][:, None] != ids[right][None, :])
        x, y = np.nonzero(wanted)
        a, b = part[x], right[y]
        yield np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a), scores[x, y]


def semantic_duplicates(items: DataFrame, item_id: str, by: str, vector: str, length: str, manual: str, merge: float = 0.95, related: float = 0.88, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((item_id, merged_into), (a, b, similarity)): what each item of a document (``by``) is merged into, null if it
    stays, and pairs of staying items that are related.

    Items are taken by priority: written by hand before the others, longer before shorter, then by id. An item that a
    staying one of higher priority resembles by ``merge`` or more is merged into the first such; one written by
    hand always stays. Staying items of a similarity from ``related`` up to ``merge`` are related. This is not
    a matter of components: what a merged item resembles may stay. It is settled in rounds, each of which decides every item
    whose better neighbours are decided. Items of equal vectors are one class, of which the first by
    priority is compared; the others are merged into it, or into what it is merged into, unless written by hand.
    """
    prio = F.struct((~F.coalesce(F.col(manual), F.lit(False))).alias("auto"), (-F.coalesce(F.col(length), F.lit(0))).alias("shorter"), F.col(item_id).alias("id"))
    rows = cut(items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("id"), F.col(by).alias("doc"), F.col(vector).alias("v"), prio.alias("prio"), F.md5(F.to_json(F.struct(vector)).cast("binary")).alias("print")))
    classes = cut(rows.where("doc is not null and v is not null").groupBy("doc", "print").agg(F.min("prio").alias("prio"), F.min_by("v", "prio").alias("v")).select(F.col("prio.id").alias("id"), "doc", "print", "prio", "v"))
    pairs = cut(close_pairs(classes, "id", "doc", "v", related, block))
    of = classes.select("id", "prio")
    edges = pairs.where(F.col("similarity") >= merge).join(of.select(F.col("id").alias("a"), F.col("prio").alias("pa")), "a").join(of.select(F.col("id").alias("b"), F.col("prio").alias("pb")), "b")
    edges = cut(edges.select(F.greatest("pa", "pb").alias("low"), F.least("pa", "pb").alias("high")))
    undecided = edges.where("low.auto").select("low").distinct()
    decided = cut(classes.select("prio").join(undecided, F.col("prio") == F.col("low"), "left_anti").select("prio", F.lit(True).alias("stays")))
    while not undecided.isEmpty():
        near = edges.join(undecided, "low", "left_semi").join(decided, F.col("high") == F.col("prio"), "left")
        found = near.groupBy("low").agg(F.coalesce(F.bool_or("stays"), F.lit(False)).alias("gone"), F.count_if(F.col("stays").isNull()).alias("open")).where("gone or open = 0")
        found = cut(found.select(F.col("low").alias("prio"), (~F.col("gone")).alias("stays")))
        decided = cut(decided.unionByName(found))
        undecided = cut(undecided.join(found, F.col("low") == F.col("prio"), "left_anti"))
    stay = decided.where("stays").select("prio")
    best = edges.join(stay, F.col("high") == F.col("prio"), "left_semi").groupBy("low").agg(F.min("high").alias("best"))
    target = classes.join(best, F.col("prio") == F.col("low"), "left").select("doc", "print", F.col("prio").alias("first"), F.coalesce("best", "prio").alias("best"))
    members = rows.join(target, ["doc", "print"], "left")
    merged = F.when(F.col("prio.auto") & F.col("best").isNotNull() & (F.col("best.id") != F.col("id")), F.col("best.id"))
    left = stay.select(F.col("prio.id").alias("id"))
    kept = pairs.where(F.col("similarity") < merge).join(left.withColumnRenamed("id", "a"), "a", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi")
    return members.select(F.col("id").alias(item_id), merged.alias("merged_into")), kept.select("a", "b", "similarity")


# -- figures within documents

_FIGURES = "pairs bigint, mean double, median double, std double, min double, max double, ge_95 bigint, ge_90 bigint, ge_80 bigint, ge_70 bigint"


def within_summary(items: DataFrame, item_id: str, by: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(by, pairs, mean, median, std, min, max, ge_95, ge_90, ge_80, ge_70) of the cosines, rounded, of all pairs of each group.

    A group of one block is finished in the task that multiplies it. Blocks of a larger one give counts by value, of which 6 digits allow
    two million at most; they are added up by value, and the middle ones are found by running sums. Nothing of a group
    comes to the driver. A group of fewer than two items has no row.
    """
    kind = items.schema[by].dataType.simpleString()
    rows = items.where(F.col(item_id).isNotNull() & F.col(by).isNotNull() & F.col(vector).isNotNull()).select(by, F.col(item_id).alias("__id"), F.col(vector).cast("array<double>").alias("__v"))
    met = placed(blocked(rows, by, "__id", block))  # a block stays in one partition

    def scores_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for group in runs(batches, 3):
            found = np.concatenate([s for *_, s in _products(group, -2.0)])
            if len(found):
                yield group.column(0)[0], found

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, s in scores_of(batches):
            figures = [len(s), s.mean(), np.median(s), s.std(), s.min(), s.max(), *[int((s >= x).sum()) for x in (0.95, 0.9, 0.8, 0.7)]]
            yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], key.type), *[pa.array([x]) for x in figures]], [by, "pairs", "mean", "median", "std", "min", "max", "ge_95", "ge_90", "ge_80", "ge_70"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, s in scores_of(batches):
            values, n = np.unique(s, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(values), key.type), pa.array(values), pa.array(n, pa.int64())], [by, "s", "n"])

    small = met.where("not several").sortWithinPartitions(by, "lo", "hi").mapInArrow(whole, f"`{by}` {kind}, {_FIGURES}")
    values = met.where("several").repartition(by, "lo", "hi").sortWithinPartitions(by, "lo", "hi").mapInArrow(counted, f"`{by}` {kind}, s double, n bigint")
    values = cut(values.groupBy(by, "s").agg(F.sum("n").alias("n")))
    mean = F.sum(F.col("s") * F.col("n")) / F.sum("n")
    at_least = [F.sum(F.when(F.col("s") >= x, F.col("n")).otherwise(0)).alias(f"ge_{int(100 * x)}") for x in (0.95, 0.9, 0.8, 0.7)]
    large = values.groupBy(by).agg(F.sum("n").alias("pairs"), mean.alias("mean"), F.sqrt(F.greatest(F.sum(F.col("s") * F.col("s") * F.col("n")) / F.sum("n") - mean * mean, F.lit(0.0))).alias("std"), F.min("s").alias("min"), F.max("s").alias("max"), *at_least)
    upto = values.withColumn("upto", F.expr(f"sum(n) OVER (PARTITION BY `{by}` ORDER BY s)")).join(large.select(by, "pairs"), by)
    middle = lambda x: F.min(F.when(F.col("upto") >= x, F.col("s")))
    median = upto.groupBy(by).agg(((middle(F.floor((F.col("pairs") + 1) / 2)) + middle(F.floor(F.col("pairs") / 2) + 1)) / 2).alias("median"))
    out = small.unionByName(large.join(median, by))
    return out.withColumns({c: F.round(c, SCALE) for c in ("mean", "median", "std")})
