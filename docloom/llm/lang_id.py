"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of order ORDER over lower-cased letters and spaces (any run of
other characters is one space). The n-grams of all models stand as 64-bit hashes in one
sorted array, beside it each language's interpolated log-probability of the n-gram's last
character and its back-off weight as a context; the first bits of a hash index the array.
A text's language is the one of the lowest cross-entropy per character.

Models are fitted on a bounded sample: for each language, rows picked by the hash of their
id and text at a rate that expects ``max_chars`` characters at most, and its first LEAST_ROWS rows by
that hash in any case; of a text of more than max_chars / LEAST_ROWS characters a stretch is
taken. The table has a column for each language; beyond WIDE languages the characters of
each go down with their number squared, which bounds the table. A language's model is built
in a task of its own, the table in one task, and both are written to the shared folder; the
driver only passes the finished arrays on to the broadcast.

A fifth of the rows, of two or more at least one, is held back to calibrate the score and
the rejection: a text is rejected if its cross-entropy lies further above its language's
usual one than twice a high quantile of that language's calibration texts, by a margin that
allows for its length. A few odd texts with a language's label do not move these figures.

Defined results: a null or empty text or one without letters is ``und`` with score 0 and
rejected; so is every text if there is nothing to learn from, as in an empty table; ties go
to the first language in order; whole texts are read, however long; repeated rows get equal
results and count once in the sample, which goes by id and text together; rows with a null id, text or
language are judged like others (a null language is not learned); other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, trim_memory

ORDER = 5
#: Expected characters that the model of one language is fitted on at most.
MAX_CHARS = 3_000_000
#: Languages up to which each has max_chars characters.
WIDE = 8
#: Rows of a language that are sampled whatever their length.
LEAST_ROWS = 10
#: Least variance, in bits squared, that texts of one language are taken to have among them.
LEAST_SPREAD = 0.06
#: Deviations that a text may have in any case.
LEAST_REACH = 8.0
#: Characters scored at once.
BLOCK = 1 << 17

_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """Code point -> code point of its lower case if it is a letter, else of a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters_of(text: str) -> np.ndarray:
    """The text as a model reads it: lower-case letters, single spaces, a space at either end."""
    codes = _alphabet()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    space = codes == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    codes = codes[keep]
    if len(codes) and codes[0] == 32:
        codes = codes[1:]
    if not len(codes):
        return codes
    return codes if codes[-1] == 32 else np.append(codes, np.uint32(32))


def _hash(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n codes that end at each place from n - 1 on."""
    h = np.full(len(codes) - n + 1, n, np.uint64)
    for j in range(n):
        h = h * _BASE + codes[j : len(codes) - n + 1 + j].astype(np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


@dataclass
class LanguageModels:
    langs: list[str]
    keys: np.ndarray  # sorted hashes of n-grams of order 1 to ORDER, and of the empty context
    logp: np.ndarray  # [key, lang] log2 P(last character | the others)
    back: np.ndarray  # [key, lang] log2 of the weight that a longer n-gram's context leaves to shorter ones
    start: np.ndarray  # first key of each value of the hash's first bits
    shift: int
    unseen: np.ndarray  # [lang] log2 P of a character in no model
    limits: np.ndarray = None  # [lang, 3]: usual cross-entropy, its variance between texts, and per character
    reach: np.ndarray = None  # [lang] deviations that a text of it may have
    heat: float = 1.0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash in keys, or -1."""
        top = (h >> np.uint64(self.shift)).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        out = np.full(len(h), -1, np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            i = at[left]
            hit = self.keys[i] == h[left]
            out[left[hit]] = i[hit]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """[place, lang] log2-probabilities of the characters from ORDER - 1 on."""
        total = np.zeros((len(codes) - ORDER + 1, len(self.langs)), np.float32)
        todo = np.arange(len(total))
        for n in range(ORDER, 0, -1):
            if n == ORDER:
                h = _hash(codes, n)
            else:
                h = _hash_at(codes, todo + ORDER - n, n)
            at = self.find(h)
            hit = at >= 0
            total[todo[hit]] += self.logp[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                return total
            if n > 1:
                context = self.find(_hash_at(codes, todo + ORDER - n, n - 1))
                known = context >= 0
                total[todo[known]] += self.back[context[known]]
        total[todo] += self.unseen
        return total

    def entropies(self, codes: np.ndarray) -> tuple[np.ndarray, int]:
        """(bits per character in each language, characters)."""
        n, total = len(codes), np.zeros(len(self.langs))
        if not n:
            return total, 0
        codes = np.concatenate([np.full(ORDER - 1, 32, np.uint32), codes])
        for i in range(0, n, BLOCK):
            total += self.logs(codes[i : i + BLOCK + ORDER - 1]).sum(0, dtype=np.float64)
        return -total / n, n

    def batch(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """entropies of many texts; short ones share a pass."""
        out, size = np.zeros((len(docs), len(self.langs))), np.array([len(d) for d in docs], np.int64)
        group: list[int] = []

        def flush() -> None:
            if group:
                pad = np.full(ORDER - 1, 32, np.uint32)
                logs = self.logs(np.concatenate([x for i in group for x in (pad, docs[i])]))
                ends = np.cumsum(size[group] + ORDER - 1) - (ORDER - 1)
                first = ends - size[group]
                for i, a, b in zip(group, first, ends, strict=True):
                    out[i] = -logs[a:b].sum(0, dtype=np.float64) / size[i]
                group.clear()

        held, most = 0, max(BLOCK // max(1, len(self.langs) // 4), 4096)
        for i, n in enumerate(size):
            if n > most:
                out[i] = self.entropies(docs[i])[0]
            elif n:
                if held + n > most:
                    flush()
                    held = 0
                group.append(i)
                held += n
        flush()
        return out, size

    def judge(self, bits: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, rejected) of each text; -1 without letters."""
        best = bits.argmin(1)
        low = bits[np.arange(len(bits)), best]
        gap = (bits - low[:, None]) * (self.heat * np.sqrt(np.maximum(size, 1)))[:, None]
        score = 1 / np.exp2(-np.clip(gap, 0, 60)).sum(1)
        usual, between, each = self.limits[best].T
        rejected = low > usual + self.reach[best] * np.sqrt(between + each / np.maximum(size, 1))
        none = size == 0
        return np.where(none, -1, best), np.where(none, 0.0, score), rejected | none


def _hash_at(codes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(first), n, np.uint64)
    for j in range(n):
        h = h * _BASE + codes[first + j].astype(np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def build(counts: dict[str, Counter]) -> LanguageModels:
    """Models of each language's counts of ORDER-grams (strings of ORDER characters)."""
    return _build({lang: _levels(_codes("".join(c)), np.array(list(c.values()), np.float64)) for lang, c in counts.items()})


def _codes(grams: str) -> np.ndarray:
    """[gram, place] code points of ORDER-grams in a row."""
    return np.frombuffer(grams.encode("utf-32-le"), "<u4").reshape(-1, ORDER)


@dataclass
class _Level:
    """The n-grams of one language for one n, in the order of their hashes, and their contexts in that of theirs."""

    codes: np.ndarray
    keys: np.ndarray
    prob: np.ndarray
    contexts: np.ndarray
    share: np.ndarray


def _part(codes: np.ndarray, first: int, n: int) -> np.ndarray:
    """Hash of the n codes from place first on of each row."""
    return _hash_at(codes.ravel(), np.arange(len(codes)) * codes.shape[1] + first, n)


def _lookup(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each hash is in keys, its value there)."""
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[at] == h, values[at]


def _levels(codes: np.ndarray, counts: np.ndarray) -> tuple[dict[int, _Level], float]:
    """What _kneser_ney gives, as sorted arrays: (levels by n, P of an unseen character)."""
    counted = {}
    for n in range(ORDER, 0, -1):  # below the top: in how many contexts an n-gram continues
        keys, first, which = np.unique(_part(codes, 0, n), return_index=True, return_inverse=True)
        counts, codes = np.bincount(which, counts), codes[first]
        counted[n] = codes, keys, counts
        codes, counts = codes[:, 1:], np.ones(len(codes))
    floor = 1.0 / (len(counted[1][1]) + 64)
    levels: dict[int, _Level] = {}
    for n in range(1, ORDER + 1):
        codes, keys, counts = counted.pop(n)
        once, twice = int((counts == 1).sum()), int((counts == 2).sum())
        off = once / (once + 2 * twice) if once and twice else 0.5
        contexts, which = np.unique(_part(codes, 0, n - 1), return_inverse=True)
        total = np.bincount(which, counts)
        share = off * np.bincount(which) / total
        lower = _lookup(levels[n - 1].keys, levels[n - 1].prob, _part(codes, 1, n - 1))[1] if n > 1 else floor
        levels[n] = _Level(codes, keys, (counts - off) / total[which] + share[which] * lower, contexts, share)
    return levels, levels[1].share[0] * floor


def _build(levels_of: dict[str, tuple[dict[int, _Level], float]]) -> LanguageModels:
    """Models of the levels of each language."""
    langs = sorted(levels_of)
    tables = [levels_of[lang] for lang in langs]
    union = {}  # of each n, the n-grams of all languages
    for n in range(1, ORDER + 1) if langs else ():
        keys, first = np.unique(np.concatenate([t[n].keys for t, _ in tables]), return_index=True)
        union[n] = keys, np.concatenate([t[n].codes for t, _ in tables])[first]
    size = sum(len(keys) for keys, _ in union.values())
    logp, back = np.zeros((size, len(langs)), np.float32), np.zeros((size, len(langs)), np.float32)
    for j, (levels, floor) in enumerate(tables):
        at, lower = 0, None
        for n, (keys, codes) in union.items():
            known, p = _lookup(levels[n].keys, levels[n].prob, keys)
            if n == 1:
                other = floor
            else:
                left, share = _lookup(levels[n].contexts, levels[n].share, _part(codes, 0, n - 1))
                other = np.where(left, share, 1.0) * _lookup(union[n - 1][0], lower, _part(codes, 1, n - 1))[1]
            lower = np.where(known, p, other)
            logp[at : at + len(keys), j] = np.log2(lower)
            if n < ORDER:
                left, share = _lookup(levels[n + 1].contexts, levels[n + 1].share, keys)
                back[at : at + len(keys), j] = np.log2(np.where(left, share, 1.0))
            at += len(keys)
    keys = np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in union.values()]])
    order = np.argsort(keys)
    unseen = np.log2(np.array([floor for _, floor in tables])).astype(np.float32)
    return _indexed(langs, keys[order], logp[order], back[order], unseen)


def _indexed(langs: list[str], keys: np.ndarray, logp: np.ndarray, back: np.ndarray, unseen: np.ndarray) -> LanguageModels:
    bits = max(1, min(22, int(np.ceil(np.log2(max(len(keys), 2)))) + 1))
    start = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return LanguageModels(langs, keys, logp, back, start, 64 - bits, unseen, np.tile([0.0, 1.0, 1.0], (len(langs), 1)), np.full(len(langs), LEAST_REACH))


def _kneser_ney(top: Counter) -> tuple[dict[str, float], dict[str, float], float]:
    """(P of each n-gram's last character, weight that each context leaves, P of an unseen character); _levels is held to it."""
    levels = {ORDER: top}
    for n in range(ORDER - 1, 0, -1):  # below the top: in how many contexts an n-gram continues
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    floor = 1.0 / (len(levels[1]) + 64)
    prob: dict[str, float] = {}
    weight: dict[str, float] = {}
    for n in range(1, ORDER + 1):
        level = levels[n]
        by_count = Counter(level.values())
        once, twice = by_count.get(1, 0), by_count.get(2, 0)
        off = once / (once + 2 * twice) if once and twice else 0.5
        total, kinds = Counter(), Counter()
        for g, c in level.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        share = {h: off * kinds[h] / total[h] for h in total}
        for g, c in level.items():
            lower = prob.get(g[1:], floor) if n > 1 else floor
            prob[g] = (c - off) / total[g[:-1]] + share[g[:-1]] * lower
        if n > 1:
            weight |= share
        else:
            floor = share.get("", 1.0) * floor
    return prob, weight, floor


def _fitted(texts: pa.Table) -> pa.Table:
    """A row for each level of the model of one language."""
    pad, parts, ends, at = np.full(ORDER - 1, 32, np.uint32), [], [], 0
    for chunk in texts.column("text").chunks:
        for text in chunk:
            codes = letters_of(text.as_py() or "")
            if len(codes):
                parts += [pad, codes]
                at += len(codes) + ORDER - 1
                ends.append(at)
    if not parts:
        return pa.Table.from_pydict({name: [] for name in _LEVEL.names}, _LEVEL)
    flat = np.concatenate(parts)
    h = _hash(flat, ORDER)
    inside = np.ones(len(h), bool)
    for end in ends[:-1]:  # windows that run into the next text
        inside[end - ORDER + 1 : end] = False
    place = np.flatnonzero(inside)
    _, first, counts = np.unique(h[place], return_index=True, return_counts=True)
    levels, floor = _levels(flat[place[first][:, None] + np.arange(ORDER)], counts.astype(np.float64))
    lang = texts.column("lang")[0].as_py()
    rows = [{"lang": lang, "n": n, "floor": floor} | {k: np.ascontiguousarray(getattr(x, k)).tobytes() for k in ("codes", "keys", "prob", "contexts", "share")} for n, x in levels.items()]
    trim_memory()
    return pa.Table.from_pylist(rows, _LEVEL)


_LEVEL = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("floor", pa.float64()), *[(k, pa.binary()) for k in ("codes", "keys", "prob", "contexts", "share")]])


def _level_of(row: dict) -> _Level:
    return _Level(np.frombuffer(row["codes"], np.uint32).reshape(-1, row["n"]), np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["prob"], np.float64), np.frombuffer(row["contexts"], np.uint64), np.frombuffer(row["share"], np.float64))


def _tabled(batches):
    """The table of all languages, in pieces: (name of the array, number of the piece, its bytes)."""
    levels_of: dict[str, tuple[dict[int, _Level], float]] = {}
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            levels_of.setdefault(row["lang"], ({}, row["floor"]))[0][row["n"]] = _level_of(row)
    models = _build({lang: (dict(sorted(levels.items())), floor) for lang, (levels, floor) in levels_of.items()})
    for name in ("keys", "logp", "back", "unseen"):
        data = np.ascontiguousarray(getattr(models, name)).tobytes()
        for seq, at in enumerate(range(0, max(len(data), 1), 4 << 20)):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([seq], pa.int32()), pa.array([data[at : at + (4 << 20)]], pa.binary())], ["name", "seq", "data"])
    del models, levels_of
    trim_memory()


def _loaded(pieces: pa.Table, langs: list[str]) -> LanguageModels:
    data = {name: b"".join(x for _, x in sorted((r["seq"], r["data"]) for r in pieces.filter(pc.equal(pieces["name"], name)).to_pylist())) for name in ("keys", "logp", "back", "unseen")}
    return _indexed(langs, np.frombuffer(data["keys"], np.uint64), *(np.frombuffer(data[k], np.float32).reshape(-1, len(langs)) for k in ("logp", "back")), np.frombuffer(data["unseen"], np.float32))


def _sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, max_chars: int) -> DataFrame | None:
    """(text, lang, pick) of the rows that models are made from; None if there are none."""
    rows = df.where(F.col(text_col).cast("string").rlike(r"\p{L}") & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col).cast("string")), F.lit(1 << 30)).alias("pick"))
    most = max(1, max_chars // LEAST_ROWS)
    stats: dict[str, list] = {}
    for r in rows.groupBy("lang", F.pmod("pick", F.lit(64)).alias("part")).agg(F.sum(F.least(F.length("text"), F.lit(most))).alias("chars"), F.count("*").alias("rows"), F.min("pick").alias("first")).collect():  # 64 rows a language
        stats.setdefault(r["lang"], []).append(r)
    if not stats:
        return None
    below, max_chars = {}, max_chars if len(stats) <= WIDE else max(1, max_chars * WIDE * WIDE // len(stats) ** 2)
    for lang, parts in stats.items():
        first = sorted(r["first"] for r in parts)[:LEAST_ROWS][-1] + 1
        few = sum(r["rows"] for r in parts) <= LEAST_ROWS
        below[lang] = 1 << 30 if few else max(first, int((1 << 30) * min(1.0, max_chars / sum(r["chars"] for r in parts))))
    limit = F.create_map(*[x for lang, n in sorted(below.items()) for x in (F.lit(lang), F.lit(n))])
    spare = F.length("text") - most
    text = F.when(spare > 0, F.substring("text", F.pmod("pick", F.greatest(spare, F.lit(0)) + 1).cast("int") + 1, F.lit(most))).otherwise(F.col("text"))
    return rows.where(F.col("pick") < limit[F.col("lang")]).dropDuplicates(["lang", "pick"]).select(text.alias("text"), "lang", "pick")


def _held(sample: DataFrame) -> DataFrame:
    """sample with held: a fifth of its rows, of two or more of a language at least one and not all."""
    held = F.col("pick") % 5 == 4
    moved = []
    for r in sample.groupBy("lang").agg(F.count_if(held).alias("held"), F.count("*").alias("rows"), F.min("pick").alias("low"), F.max("pick").alias("high")).collect():  # a row per language
        if r["held"] == r["rows"]:
            moved.append((r["lang"], r["low"], False))
        elif not r["held"] and r["low"] < r["high"]:
            moved.append((r["lang"], r["high"], True))
    for kind in (True, False):
        own = [x for lang, pick, to in moved if to is kind for x in (F.lit(lang), F.lit(pick).cast("bigint"))]
        if own:
            held = F.when(F.create_map(*own)[F.col("lang")] == F.col("pick"), F.lit(kind)).otherwise(held)
    return sample.withColumn("held", held)


def train(df: DataFrame, id_col: str, text_col: str, lang_col: str, max_chars: int = MAX_CHARS) -> LanguageModels:
    """Models of the languages of df, fitted and calibrated on a bounded sample of its rows."""
    spark = df.sparkSession
    sample = _sample(df, id_col, text_col, lang_col, max_chars)
    if sample is None:
        return build({})

    with Scratch(spark, "lang") as scratch:
        sample = _held(scratch.write(sample, "sample"))
        levels = sample.where("not held").select("lang", "text").groupBy("lang").applyInArrow(_fitted, "lang string, n int, floor double, codes binary, keys binary, prob binary, contexts binary, share binary")
        levels = scratch.write(levels, "levels")
        langs = sorted(r["lang"] for r in levels.select("lang").distinct().collect())  # a row per language
        if not langs:
            return build({})
        pieces = scratch.write(levels.repartition(1).mapInArrow(_tabled, "name string, seq int, data binary"), "table")
        models = _loaded(pieces.toArrow(), langs)  # of the size that WIDE and max_chars bound
        sent = spark.sparkContext.broadcast(models)
        held = sample.where("held").select("lang", _bits(F.col("text"), sent).alias("got")).select("lang", "got.bits", "got.size", "got.spread").toArrow()
        sent.destroy()
        calibrate(models, held)
        return models


def _bits(text: Column, sent) -> Column:
    @F.arrow_udf("struct<bits: array<double>, size: bigint, spread: double>")
    def run(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            codes = letters_of(t or "")
            bits, n = sent.value.entropies(codes)
            spread = float(sent.value.logs(np.concatenate([np.full(ORDER - 1, 32, np.uint32), codes[:BLOCK]])).var(0)[bits.argmin()]) if n else 0.0
            out.append({"bits": bits.tolist(), "size": n, "spread": spread})
        return pa.array(out, pa.struct([("bits", pa.list_(pa.float64())), ("size", pa.int64()), ("spread", pa.float64())]))

    return run(text)


def calibrate(models: LanguageModels, held: pa.Table) -> None:
    """Sets the score's heat and each language's limit from texts that were not fitted on."""
    held = held.filter(pc.greater(held["size"], 0))
    if not len(held):
        return
    bits, size = np.array(held["bits"].to_pylist()), held["size"].to_numpy().astype(np.float64)
    best = bits.argmin(1)
    low, spread = bits[np.arange(len(bits)), best], held["spread"].to_numpy()
    for j in range(len(models.langs)):
        own = best == j
        pick = own if own.sum() >= 8 else np.ones(len(best), bool)
        pick = pick & (low <= np.quantile(low[pick], 0.98))
        usual, each = float(np.average(low[pick], weights=size[pick])), max(float(spread[pick].mean()), 1e-3)
        between = max(float(np.average(np.square(low[pick] - usual), weights=np.sqrt(size[pick]))), LEAST_SPREAD)
        models.limits[j] = usual, between, each
        if own.any():
            models.reach[j] = max(LEAST_REACH, 2 * float(np.quantile((low[own] - usual) / np.sqrt(between + each / size[own]), 0.98)))
    truth = np.array([models.langs.index(x) if x in models.langs else -1 for x in held["lang"].to_pylist()])
    losses = []
    for heat in (0.25, 0.5, 1.0, 2.0, 4.0):
        models.heat = heat
        gap = (bits - low[:, None]) * (heat * np.sqrt(size))[:, None]
        p = np.exp2(-np.clip(gap, 0, 60))
        p = (p / p.sum(1, keepdims=True))[np.arange(len(bits)), truth]
        losses.append((-np.log(np.maximum(p, 1e-6))[truth >= 0].mean() if (truth >= 0).any() else 0.0, heat))
    models.heat = min(losses)[1]


def identify(text: Column | str, models: LanguageModels, spark) -> Column:
    """struct<lang_pred, score, bits, rejected> of a text column."""
    sent = spark.sparkContext.broadcast(models)  # of the size that max_chars and WIDE bound

    @F.arrow_udf("struct<lang_pred: string, score: double, bits: double, rejected: boolean>")
    def run(text: pa.Array) -> pa.Array:
        m = sent.value
        lang, score, bits, rejected = [], [], [], []
        for i in range(0, len(text), 256):
            docs = [letters_of(t or "") for t in text.slice(i, 256).to_pylist()]
            if not m.langs:
                lang += ["und"] * len(docs)
                score += [0.0] * len(docs)
                bits += [None] * len(docs)
                rejected += [True] * len(docs)
                continue
            got, size = m.batch(docs)
            best, s, r = m.judge(got, size)
            lang += [m.langs[j] if j >= 0 else "und" for j in best]
            score += s.tolist()
            bits += [float(b[j]) if j >= 0 else None for b, j in zip(got, best, strict=True)]
            rejected += r.tolist()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "bits", "rejected"])

    return run(text)
