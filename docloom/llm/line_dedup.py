"""Line deduplication by a segment-partition edit join, in built-in functions only.

Of all lines of all documents, in the order of (id, text hash, line number), a line that is
not blank is removed if an earlier one equals it (white space at its ends aside), and one of
at least NEAR_CHARS characters also if an earlier one is within ``max_edits`` edits of it.
With ``min_chars``, lines of fewer characters stay and all others are compared both ways.

1. Each distinct line is cut into max_edits + 1 segments. Two lines within max_edits edits
   share a segment at places that their lengths limit, so a line is entered under its own
   segments and under the substrings that can match segments of equal or smaller lengths.
2. Only keys that two different lines share go on. Lines under a key of few lines are
   paired. What the two share at either end is cut off, which does not change their distance,
   and the bit-parallel edit distance of the rest, over a band of 2 max_edits + 1 diagonals,
   decides.
3. Under a key of more than HOT lines no pairs are made (for one edit): as the lines agree
   on the key's segment, their edit lies in the rest, which is cut into PARTS holes, and
   lines are entered again under all but one hole. Where that is still hot, they are
   entered under every single place of the hole: then all lines of a key are within one
   edit of each other and the earliest stands for all. For more edits, lines under hot keys
   are entered again under all but max_edits of WIDE * max_edits pieces, with every shift
   that the edits between can cause, and are paired there.

A line is known by two 64-bit hashes wherever it is removed; keys of one alone only choose
what is compared.

Defined results: null texts stay null; empty texts stay empty; rows of equal id and text
count as one document and keep or lose the same lines; ids may be null and come first;
equal lines of one document go by their line number; a line may be as long as its text;
an empty table gives an empty table; extra columns are kept, whatever their names, but for
n_lines, n_exact and n_near, which are replaced; documents may be left with an empty text.
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, fresh

#: Least characters of a line that is compared by edits; shorter ones are compared for equality.
NEAR_CHARS, MAX_EDITS = 40, 1
#: Lines under a key beyond which no pairs are made, and holes that such lines are cut into.
HOT, PARTS = 16, 16
#: For more than one edit: pieces, for each edit, that lines under such a key are cut into.
WIDE = 4
#: Hashes of lines that are broadcast; beyond, both sides are exchanged.
MOST_LINES = 1 << 16

_BLANK = " \t\r\x0b\x0c"


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance of two strings if it is at most ``most`` (at most 30), else a greater number.

    Columns of the dynamic programme are bit vectors over the band of diagonals -most .. most;
    bit k of a vector belongs to diagonal k - most. Characters beyond either end match nothing.
    A column's least value is at least that of its last row less its upward steps; once that
    exceeds ``most``, so does the distance, and the remaining columns are passed over.
    """
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    width = 2 * most + 1
    mask = (1 << width) - 1
    chars = lambda x: F.split(x, "")
    lit = lambda x: F.lit(x).cast("bigint")
    s, t = chars(short), chars(long)
    n, m = F.length(short), F.length(long)

    def step(state: Column, j: Column) -> Column:
        # j: place in the longer string, from 0; row of bit k in the shorter one: j + k - most.
        match = F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), lit(0), lambda acc, k: F.when((j + k - most >= 0) & (j + k - most < state["n"]) & (F.get(state["s"], j + k - most) == F.get(state["t"], j)), acc.bitwiseOR(F.call_function("shiftleft", lit(1), k))).otherwise(acc))
        vp, vn = state["vp"], state["vn"]
        d0 = ((match.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(match).bitwiseOR(vn).bitwiseAND(lit(mask))
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(lit(mask)))
        hn = d0.bitwiseAND(vp)
        down = F.shiftright(d0, 1)
        bit = F.call_function("shiftleft", lit(1), F.greatest(F.lit(0), state["n"] - 1 - j + most))  # the last row's place once the band reaches it
        inside = j + most < state["n"]
        score = F.when(inside, state["score"] + F.when(d0.bitwiseAND(lit(1 << (width - 1))) == 0, 1).otherwise(0)).otherwise(state["score"] + F.when(hp.bitwiseAND(bit) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(bit) != 0, 1).otherwise(0))
        upward = hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(lit(mask)))
        over = score - F.bit_count(upward) > most
        return F.when(state["over"], state).otherwise(F.struct(state["s"].alias("s"), state["t"].alias("t"), state["n"].alias("n"), upward.alias("vp"), down.bitwiseAND(hp).alias("vn"), score.alias("score"), over.alias("over")))

    first = F.struct(s.alias("s"), t.alias("t"), n.alias("n"), lit(mask & ~((1 << most) - 1)).alias("vp"), lit(0).alias("vn"), F.least(F.lit(most), n).alias("score"), F.lit(False).alias("over"))
    run = F.aggregate(F.sequence(F.lit(0), m - 1), first, step, lambda x: F.when(x["over"], F.lit(most + 1)).otherwise(x["score"]))
    return F.when(m - n > most, F.lit(most + 1)).when(n <= 0, m).otherwise(run)


def _places(edits: int) -> list[tuple[int, int, int]]:
    """(less, seg, shift): which substring of a line can be which segment of a line that is ``less`` characters shorter."""
    parts = edits + 1
    return [(less, seg, shift) for less in range(edits + 1) for seg in range(1, parts + 1) for shift in range(max(1 - seg, less - (parts - seg)), min(seg - 1, less + parts - seg) + 1)]


def _key(line: Column, length: Column, edits: int, less: int, seg: int, shift: int) -> Column:
    parts = edits + 1
    base = length - less
    size = F.call_function("div", base, F.lit(parts)).cast("int")
    span = size if seg < parts else base - size * (parts - 1)  # the last segment takes the rest
    at = size * (seg - 1) + shift
    key = F.xxhash64(base, F.lit(seg), F.substring(line, at + 1, span))
    return F.when((at >= 0) & (at + span <= length), key) if shift else key


def _lines(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, t, pos, line, n) of every line that takes part; n is its length."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select("id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    # A line of fewer bytes has fewer characters; most have nothing to trim.
    ragged = F.lit(False)
    for blank in _BLANK:
        ragged = ragged | F.col("raw").startswith(blank) | F.col("raw").endswith(blank)
    rows = rows.where(F.octet_length("raw") >= min_chars).select("id", "t", "pos", F.when(ragged, F.btrim("raw", F.lit(_BLANK))).otherwise(F.col("raw")).alias("line"))
    return rows.select("id", "t", "pos", "line", F.length("line").alias("n")).where(F.col("n") >= min_chars)


def _place() -> Column:
    return F.struct("id", "t", "pos")


def _small(table: DataFrame, rows: int) -> DataFrame:
    """table, to be broadcast if it has at most so many rows."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def _near(lines: DataFrame, narrow: DataFrame, edits: int, scratch: Scratch) -> DataFrame:
    """(g, g2): lines that have an earlier line within ``edits`` edits, other than themselves."""
    places = _places(edits)
    listed = F.array(*[F.struct(F.col(f"k{i}").alias("k"), (F.col("n") - less).alias("base"), F.lit(seg).alias("seg")) for i, (less, seg, _) in enumerate(places)])
    keys = narrow.select("g", F.inline(listed)).where("k is not null")
    shared = keys.groupBy("k").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a <> b").select("k")
    members = scratch.write(keys.join(shared, "k").select("k", "base", "seg", "g").distinct(), "members")
    wanted = _small(members.select("g").distinct(), MOST_LINES)
    texts = lines.select("line", F.xxhash64("line").alias("g"), _second("line").alias("g2")).join(wanted, "g", "left_semi").groupBy("g", "g2").agg(F.min("line").alias("line"))
    order = narrow.select("g", "g2", "id", "t", "pos").join(wanted, "g", "left_semi").groupBy("g", "g2").agg(F.min(_place()).alias("first"))
    texts = scratch.write(texts.join(order, ["g", "g2"]), "texts")
    sizes = members.groupBy("k").count()
    cold = members.join(sizes.where(F.col("count") <= HOT).select("k"), "k")
    found = _verified(cold, texts, "k", edits)
    hot = members.join(sizes.where(F.col("count") > HOT).select("k"), "k")
    if hot.isEmpty():
        return found
    if edits > 1:
        again = scratch.write(_pieced(texts.join(hot.select("g").distinct(), "g", "left_semi"), edits), "again")
        shared = again.groupBy("k").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a <> b").select("k")
        return found.unionByName(_verified(again.join(shared, "k"), texts, "k", edits)).distinct()
    half = F.call_function("div", F.col("base"), F.lit(2)).cast("int")
    begin, end = F.when(F.col("seg") == 1, half).otherwise(F.lit(0)), F.when(F.col("seg") == 1, F.col("base")).otherwise(half)
    edge = lambda j: (F.col("begin") + F.floor((F.col("end") - F.col("begin")) * j / PARTS)).cast("int")
    hole = F.explode(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda j: F.struct(edge(j).alias("s"), edge(j + 1).alias("e"))))
    holed = hot.withColumns({"begin": begin, "end": end}).select("k", "base", "g", hole.alias("h")).select("k", "base", "g", "h.s", "h.e").where("s < e").join(texts, "g")
    holed = scratch.write(holed.select("base", "g", "s", "e", "line", "first", F.xxhash64("k", "s", "e", _left(F.col("s")), _right(F.col("base") - F.col("e"))).alias("k2"), "g2"), "holed")
    sizes = holed.groupBy("k2").agg(F.countDistinct("g").alias("n"))
    few = holed.join(sizes.where((F.col("n") > 1) & (F.col("n") <= HOT)).select("k2"), "k2").select("k2", "g").distinct()
    many = holed.join(sizes.where(F.col("n") > HOT).select("k2"), "k2")
    one = F.struct
    kinds = F.concat(
        F.when(F.length("line") == F.col("base"), F.transform(F.sequence(F.col("s"), F.col("e") - 1), lambda a: one(F.lit(1).alias("kind"), a.alias("a"), (F.col("base") - a - 1).alias("tail")))).otherwise(F.array().cast("array<struct<kind:int,a:int,tail:int>>")),
        F.transform(F.sequence(F.col("s"), F.col("e")), lambda a: one(F.lit(2).alias("kind"), a.alias("a"), (F.col("base") - a).alias("tail"))),
    )
    single = many.select("base", "g", "g2", "line", "first", F.inline(kinds)).select("g", "g2", "first", F.xxhash64("base", "kind", "a", _left(F.col("a")), _right(F.col("tail"))).alias("k3")).distinct()
    earliest = single.groupBy("k3").agg(F.min("first").alias("least"), F.count("*").alias("n")).where("n > 1")
    stood = single.join(earliest, "k3").where("first > least").select("g", "g2")
    return found.unionByName(_verified(few, texts, "k2", edits)).unionByName(stood).distinct()


def _second(line: str) -> Column:
    return F.xxhash64(F.lit(1), line)


def _pieced(texts: DataFrame, edits: int) -> DataFrame:
    """(k, g): each line under all but ``edits`` of its pieces, for every shift of the runs of pieces between.

    The holes may take ``edits`` edits in all, so shifts change by as much in all.
    """
    pieces, rows = WIDE * edits, []
    for less in range(edits + 1):
        for middle in product(range(-edits, edits + 1), repeat=edits - 1):
            shifts = (0, *middle, less)
            if sum(abs(x - y) for x, y in zip(shifts, shifts[1:], strict=False)) <= edits:
                rows += [F.struct(F.lit(less).alias("less"), F.array(*map(F.lit, holes)).alias("holes"), F.array(*map(F.lit, shifts)).alias("shifts")) for holes in combinations(range(pieces), edits)]
    base = F.length("line") - F.col("less")
    edge = lambda piece: F.floor(base * piece / pieces).cast("int")
    begin = lambda r: F.when(r == 0, F.lit(0)).otherwise(edge(F.get("holes", r - 1) + 1))
    end = lambda r: F.when(r == edits, base).otherwise(edge(F.get("holes", r)))
    runs = F.sequence(F.lit(0), F.lit(edits))
    fits = F.forall(runs, lambda r: (begin(r) + F.get("shifts", r) >= 0) & (end(r) + F.get("shifts", r) <= F.length("line")))
    parts = F.transform(runs, lambda r: F.substring(F.col("line"), begin(r) + F.get("shifts", r) + 1, F.greatest(end(r) - begin(r), F.lit(0))))
    return texts.select("g", "line", F.inline(F.array(*rows))).where(fits).select(F.xxhash64(base, "holes", parts).alias("k"), "g").distinct()


def _left(n: Column) -> Column:
    return F.substring(F.col("line"), F.lit(1), n)


def _right(n: Column) -> Column:
    return F.when(n > 0, F.substring(F.col("line"), -n, n)).otherwise("")


def _common(a: Column, b: Column, part) -> Column:
    """Characters that two strings share at one end, by bisection; part(x, n) is the first or last n characters of x."""
    n = F.least(F.length(a), F.length(b))

    def step(state: Column, _: Column) -> Column:
        middle = F.call_function("div", state["lo"] + state["hi"] + 1, F.lit(2)).cast("int")
        same = part(a, middle) == part(b, middle)
        return F.struct(F.when(same, middle).otherwise(state["lo"]).alias("lo"), F.when(same, state["hi"]).otherwise(middle - 1).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), step, lambda x: x["lo"])


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: the optimiser does not put their expressions into later filters."""
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _verified(members: DataFrame, texts: DataFrame, key: str, edits: int) -> DataFrame:
    """(g, g2): the later lines of the pairs that share a key and are within ``edits`` edits.

    What two lines share at either end does not change their distance and is cut off first.
    """
    one, two = members.select(key, F.col("g").alias("a")), members.select(key, F.col("g").alias("b"))
    pairs = one.join(two, key).where("a < b").select("a", "b").distinct()
    side = lambda x: texts.select(F.col("g").alias(x), F.col("g2").alias(f"{x}2"), F.col("line").alias(f"l{x}"), F.col("first").alias(f"f{x}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.where(F.abs(F.length("la") - F.length("lb")) <= edits)
    pairs = _computed(pairs, p=_common(F.col("la"), F.col("lb"), lambda x, n: F.substring(x, F.lit(1), n)))
    rest = lambda c: F.substring(F.col(c), F.col("p") + 1, F.length(c))
    pairs = _computed(pairs, la=rest("la"), lb=rest("lb"))
    pairs = _computed(pairs, p=_common(F.col("la"), F.col("lb"), lambda x, n: F.when(n > 0, F.substring(x, -n, n)).otherwise("")))
    head = lambda c: F.substring(F.col(c), F.lit(1), F.length(c) - F.col("p"))
    pairs = _computed(pairs, la=head("la"), lb=head("lb"))
    near = pairs.where(edit_distance(F.col("la"), F.col("lb"), edits) <= edits)
    later = F.col("fa") < F.col("fb")
    return near.select(F.when(later, F.col("b")).otherwise(F.col("a")).alias("g"), F.when(later, F.col("b2")).otherwise(F.col("a2")).alias("g2")).distinct()


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int | None = None, max_edits: int = MAX_EDITS) -> DataFrame:
    """df with text_col without the removed lines, and n_lines, n_exact and n_near: its lines, and those removed as equal or similar."""
    with Scratch(df.sparkSession, "lines") as scratch:
        lines = _lines(df, id_col, text_col, 1 if min_chars is None else min_chars)
        long = F.col("n") >= (NEAR_CHARS if min_chars is None else min_chars)
        keys = {f"k{i}": F.when(long, _key(F.col("line"), F.col("n"), max_edits, *place)) for i, place in enumerate(_places(max_edits))}
        hashed = lines.withColumns({"g": F.xxhash64("line"), "g2": _second("line")} | keys)
        narrow = scratch.write(hashed.drop("line"), "narrow", compression="lz4_raw")
        near = scratch.write(_near(lines, narrow, max_edits, scratch), "near")
        places = narrow.select("id", "t", "pos", "g", "g2")
        firsts = places.groupBy("g", "g2").agg(F.min(_place()).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
        firsts = _small(scratch.write(firsts, "firsts"), MOST_LINES)
        exact = places.join(firsts, ["g", "g2"]).where(_place() > F.col("first")).select("id", "t", "pos", F.lit(True).alias("exact"))
        similar = places.join(_small(near, MOST_LINES), ["g", "g2"], "left_semi").select("id", "t", "pos", F.lit(False).alias("exact"))
        # Rows of one id and text give the same places again.
        gone = exact.unionByName(similar).groupBy("id", "t", "pos").agg(F.bool_or("exact").alias("exact"))
        names = [text_col, *df.columns]
        h, own_id, own_t, dropped, near_n, kept_text = fresh(names, "h", "own_id", "own_t", "dropped", "near_n", "kept_text")
        drops = gone.groupBy("id", "t").agg(F.collect_list("pos").alias(dropped), F.count_if(~F.col("exact")).alias(near_n))  # the lines of one text
        drops = scratch.write(drops.withColumnsRenamed({"id": own_id, "t": own_t}), "drops", keep=True)
        for name in [n for n in scratch.paths if n != "drops"]:
            scratch.drop(name)
        text = F.col(text_col).cast("string")
        out = df.withColumn(h, F.xxhash64(text)).join(drops, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(h) == F.col(own_t)), "left")
        split = F.split(text, "\n", -1)
        left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(dropped))
        kept = F.when(F.col(dropped).isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n"))
        gone = F.coalesce(F.size(dropped), F.lit(0)).cast("bigint")
        near_count = F.coalesce(near_n, F.lit(0)).cast("bigint")
        lines_of = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1
        counts = {"n_lines": F.coalesce(lines_of, F.lit(0)).cast("bigint"), "n_exact": F.when(F.col(dropped).isNull(), F.lit(0)).otherwise(gone - near_count).cast("bigint"), "n_near": near_count}
        out = out.withColumn(kept_text, kept).withColumns(counts).drop(h, own_id, own_t, dropped, near_n)
        names = [*df.columns, *[c for c in counts if c not in df.columns]]
        return _computed(out.drop(text_col), **{text_col: F.col(kept_text)}).select(*names)
