"""Benchmark decontamination by greedy string tiling.

Texts are read as tokens: runs of letters and digits, lower-cased. Where a document and a
benchmark item share a seed (a window of SEED tokens, found by its hash), the item is tiled:
again and again the longest run of tokens that both have and that no earlier tile covers, in
either, is marked, down to runs of SEED tokens. Runs of a length are found by Karp-Rabin
hashes of all windows that are still free, and confirmed token by token; the length is found
by bisection, as a run of some length holds runs of all lesser ones. The item leaks if its
marked tokens are at least ``coverage`` of all its tokens, so passages whose sentences were
reordered are caught as well as verbatim ones. Pairs whose shared seeds cannot cover that
much of the item are not tiled. An item of fewer than SEED tokens is one seed: it leaks where
all its tokens stand in a row.

Items are taken in blocks of about ``block_tokens`` tokens. A block's seeds and tokens are
broadcast, used for one scan of the documents whose result is written (or passed on, if there
is one block), and released before the next block is made; so the driver and the workers
hold one block, whatever the benchmark's size. Documents are never shuffled.

Defined results: null or empty texts, items without tokens and an empty benchmark leak nothing;
repeated documents or items give a row each, and ids may be null; runs of equal length are
marked in the order of their places in the document, then in the item; whole texts are read,
however long, and a token is compared whole; an empty table gives an empty table; find_leaks
carries no extra columns, without_leaks keeps all, whatever their names.
"""

from __future__ import annotations

import hashlib
import unicodedata
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import textvec
from docloom.llm.common import Scratch, fresh, trim_memory

SEED, COVERAGE = 4, 0.5
#: Tokens of the items of a block, about; a token takes 16 bytes where a block is held.
BLOCK_TOKENS = 1 << 20
#: Characters of documents worked on at once, and pairs of seeds and items.
CHARS, PAIRS = 1 << 18, 1 << 20


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """Code point -> a random value for its lower case if it is a letter, mark or digit, else 0."""
    low = np.zeros(0x110000, np.uint64)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LNM":
            s = chr(c).lower()
            low[c] = ord(s[0])
    out = textvec.mix(low + np.uint64(1))
    out[low == 0] = 0
    return out


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every token, tokens before each text and in all)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    value = _alphabet()[np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4")]
    if not len(value):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    word = value != 0
    first = np.zeros(len(value) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | first[1:]
    end[:-1] &= ~word[1:] | first[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = textvec._powers(CHARS)
    out = np.empty(len(s), np.uint64)
    a = 0
    while a < len(s):  # stretches that the table of powers covers
        if e[a] - s[a] > CHARS:
            out[a] = int.from_bytes(hashlib.blake2b(value[s[a] : e[a]].tobytes(), digest_size=8).digest(), "little")
            a += 1
            continue
        b = max(a + 1, int(np.searchsorted(e, s[a] + CHARS, "right")))
        lo, hi = s[a], e[b - 1]
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(value[lo:hi] * up[: hi - lo], out=run[1:])
        out[a:b] = textvec.mix((run[e[a:b] - lo] - run[s[a:b] - lo]) * down[s[a:b] - lo] + (e[a:b] - s[a:b]).astype(np.uint64))
        a = b
    return out, np.searchsorted(s, offsets)


class Rolling:
    """Karp-Rabin hashes of the windows of a run of tokens: one pass, then any window from two of its sums."""

    def __init__(self, tokens: np.ndarray):
        self.size = len(tokens)
        up, self.down = textvec._powers(self.size)
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(tokens * up[: self.size], out=self.sums[1:])

    def windows(self, n: int) -> np.ndarray:
        """Hash of the n tokens from each place on."""
        if self.size < n:
            return np.zeros(0, np.uint64)
        return textvec.mix((self.sums[n:] - self.sums[: self.size - n + 1]) * self.down[: self.size - n + 1])


def _free(used: np.ndarray, n: int) -> np.ndarray:
    """Places from which n tokens are unused."""
    before = np.concatenate([[0], np.cumsum(used)])
    return np.flatnonzero(before[n:] == before[: max(len(before) - n, 0)])


def tile(doc: np.ndarray, item: np.ndarray, seed: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, length): longest first, no token of either used twice.

    Takes memory in proportion to the tokens, however often they repeat.
    """
    if len(doc) < seed or len(item) < seed:
        return []
    there = Rolling(item)
    hit = np.isin(Rolling(doc).windows(seed), there.windows(seed))
    # Tokens of the doc within seeds of the item stay; others are used up, and all but one of a row of them left out.
    near = np.zeros(len(doc), bool)
    for j in range(seed):
        near[j : j + len(hit)] |= hit
    keep = near.copy()
    keep[1:] |= near[:-1]
    place = np.flatnonzero(keep)
    used_doc, used_item, out = ~near[place], np.zeros(len(item), bool), []
    own = doc[place]
    here, most = Rolling(own), min(len(own), len(item))

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Free windows of the doc that are in the item, and the item's free windows: places and hashes."""
        a, b = _free(used_doc, n), _free(used_item, n)
        x, y = here.windows(n)[a], there.windows(n)[b]
        both = np.isin(x, y)
        return a[both], x[both], b, y

    while most >= seed:
        low, high = seed - 1, most  # there are runs of low tokens, and none of more than high
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
        if low < seed:
            break
        a, x, b, y = common(low)
        free: dict[int, list[int]] = {}
        for q, h in zip(b[::-1].tolist(), y[::-1].tolist(), strict=True):
            free.setdefault(h, []).append(q)
        end = 0
        for p, h in zip(a.tolist(), x.tolist(), strict=True):
            places = free.get(h)
            if p < end or not places:
                continue
            while places and used_item[places[-1] : places[-1] + low].any():
                places.pop()  # what is used stays used
            if places and np.array_equal(own[p : p + low], item[places[-1] : places[-1] + low]):
                q, end = places.pop(), p + low
                used_doc[p:end] = used_item[q : q + low] = True
                out.append((int(place[p]), q, low))
        most = low - 1
    return out


class Items:
    """A block of benchmark items: tokens, and for each length of seeds a sorted table of them."""

    def __init__(self, texts: list[str]):
        tokens, at = tokens_of(texts)
        self.items = [tokens[i:j] for i, j in zip(at, at[1:], strict=False)]
        self.tables = {}
        for n in sorted({min(SEED, len(t)) for t in self.items} - {0}):
            mine = [i for i, t in enumerate(self.items) if min(SEED, len(t)) == n]
            seeds = [Rolling(self.items[i]).windows(n) for i in mine]
            values, number = np.unique(np.concatenate(seeds), return_inverse=True)
            owner = np.repeat(np.array(mine), [len(x) for x in seeds])
            # Of each seed, the items that hold it and how often.
            held, times = np.unique(np.stack([number, owner], 1), axis=0, return_counts=True)
            first = np.searchsorted(held[:, 0], np.arange(len(values) + 1))
            bits = np.zeros(1 << 22, bool)  # whether any seed starts with these bits
            bits[(values >> np.uint64(42)).astype(np.int64)] = True
            self.tables[n] = values, first, held[:, 1], times, bits, dict(zip(mine, np.split(number, np.cumsum([len(x) for x in seeds])[:-1]), strict=True))

    def leaks(self, texts: list[str], coverage: float) -> list[tuple[int, int, int, int]]:
        """(text, item, marked tokens, tiles) of the items that leak into the texts."""
        tokens, at = tokens_of(texts)
        rolling, out = Rolling(tokens), []
        for n, (values, first, items, times, bits, numbers) in self.tables.items():
            h = rolling.windows(n)
            place = np.flatnonzero(bits[(h >> np.uint64(42)).astype(np.int64)])
            seed = np.minimum(np.searchsorted(values, h[place]), len(values) - 1)
            doc = np.searchsorted(at, place, "right") - 1
            real = (values[seed] == h[place]) & (place + n <= at[doc + 1])
            found = np.unique(doc[real] * len(values) + seed[real])  # seeds of each text, once
            doc, seed = found // len(values), found % len(values)
            for d, i in self._candidates(n, doc, seed, first, items, times, coverage):
                own = seed[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
                item, shared = self.items[i], np.flatnonzero(np.isin(numbers[i], own))
                if np.minimum(np.diff(np.append(shared, shared[-1] + n)), n).sum() < coverage * len(item):
                    continue
                tiles = tile(tokens[at[d] : at[d + 1]], item, n)
                marked = sum(t[2] for t in tiles)
                if marked and marked >= coverage * len(item):
                    out.append((d, i, marked, len(tiles)))
        return sorted(out)

    def _candidates(self, n: int, doc: np.ndarray, seed: np.ndarray, first: np.ndarray, items: np.ndarray, times: np.ndarray, coverage: float) -> list[tuple[int, int]]:
        """(text, item) whose shared seeds may cover enough of the item; PAIRS seeds of items at once."""
        size = np.array([len(t) for t in self.items])
        each = first[seed + 1] - first[seed]
        ends = np.cumsum(each)
        out, a = [], 0
        while a < len(doc):  # whole texts at a time
            b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right"))
            b = max(int(np.searchsorted(doc, doc[min(b, len(doc) - 1)])) if b < len(doc) else len(doc), int(np.searchsorted(doc, doc[a], "right")))
            part = each[a:b]
            at = np.repeat(first[seed[a:b]] - np.concatenate([[0], np.cumsum(part)[:-1]]), part) + np.arange(part.sum())
            pair, which = np.unique(np.repeat(doc[a:b], part) * len(size) + items[at], return_inverse=True)
            shared = np.bincount(which, times[at], len(pair)) if len(pair) else np.zeros(0)
            fits = shared * n >= coverage * size[pair % len(size)]
            out += [(int(x) // len(size), int(x) % len(size)) for x in pair[fits]]
            a = b
        return out


def _finder(sent, kind: str, item: pa.DataType, coverage: float):
    @F.arrow_udf(f"array<struct<item: {kind}, n_tokens: bigint, n_matched: bigint, coverage: double, n_tiles: bigint>>")
    def found(text: pa.Array) -> pa.Array:
        names, block = sent.value
        rows: list[list[dict]] = []
        held, size = [], 0
        for i in range(len(text)):
            t = text[i].as_py() or ""
            held.append(t)
            size += len(t)
            if size >= CHARS or i == len(text) - 1:
                got: list[list[dict]] = [[] for _ in held]
                for d, k, marked, tiles in block.leaks(held, coverage):
                    n = len(block.items[k])
                    got[d].append({"item": names[k], "n_tokens": n, "n_matched": marked, "coverage": marked / n, "n_tiles": tiles})
                rows += got
                held, size = [], 0
        trim_memory()
        return pa.array(rows, pa.list_(pa.struct([("item", item), ("n_tokens", pa.int64()), ("n_matched", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64())])))

    return found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_tokens: int):
    """Number of blocks, type of an item id, and a function that broadcasts a block and gives its finder."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // (4 * block_tokens)))
    kind = items.schema["item"].dataType.simpleString()

    def block(number: int, coverage: float):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number).orderBy("item", "text").toArrow()  # about block_tokens tokens
        sent = spark.sparkContext.broadcast((own.column("item").to_pylist(), Items(own.column("text").to_pylist())))
        return sent, _finder(sent, kind, own.schema.field("item").type, coverage)

    return blocks, block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id, item id, n_tokens, n_matched, coverage, n_tiles): a row per document and item that leaks into it."""
    blocks, block = _blocks(benchmark, item_col, item_text_col, block_tokens)
    with Scratch(benchmark.sparkSession, "leaks") as scratch:
        found = []
        for number in range(blocks):
            sent, leaks = block(number, coverage)
            rows = docs.select(F.col(id_col).alias("id"), leaks(F.col(text_col).cast("string")).alias("leaks")).select(F.col("id").alias(id_col), F.inline("leaks")).withColumnRenamed("item", item_col)
            if blocks > 1:
                rows = scratch.write(rows, f"found-{number}", keep=True)
                sent.destroy()
            found.append(rows)
        return reduce(DataFrame.unionByName, found)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of docs that no item leaks into."""
    blocks, block = _blocks(benchmark, item_col, item_text_col, block_tokens)
    name = fresh(docs.columns, "leaks")[0]
    with Scratch(benchmark.sparkSession, "clean") as scratch:
        for number in range(blocks):
            sent, leaks = block(number, coverage)
            docs = docs.withColumn(name, leaks(F.col(text_col).cast("string"))).where(F.size(name) == 0).drop(name)
            if blocks > 1:
                docs = scratch.write(docs, f"clean-{number}", keep=number == blocks - 1)
                sent.destroy()
                if number:
                    scratch.drop(f"clean-{number - 1}")
        return docs
