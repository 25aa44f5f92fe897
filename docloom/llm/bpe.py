"""Byte-level BPE encoding and decoding of whole texts by tree concatenation.

The ids are those of the ``tokenizers`` library for the same vocabulary file. Merges
run on a rank table built from that file. Text that the file's pre-tokeniser leaves
unsplit over a long stretch is halved down to leaves, the leaves are encoded on their
own (for very long documents in different tasks), and neighbours are joined: a window
around the join is encoded again and grown until its outer tokens equal the tokens that
both sides already had there. A sequence whose neighbouring tokens are each a valid
encoding of their joined bytes is the encoding of the whole, so the result is exact.

A stretch that the pre-tokeniser splits needs no tree: its pre-tokens are encoded one by one,
as nothing merges across them. So a text of up to SPREAD characters is encoded where it is
read, and only its pre-tokens of over LEAF / 4 characters go through the tree, in one task;
the pieces of a longer text, and the leaves of its long pre-tokens, are encoded in parallel.
The ids are the same either way.

Defined results: a null text is the empty text; empty texts have no ids; repeated rows and
rows with null ids are encoded each; an empty table gives an empty table; extra columns are
kept, whatever their names, but an output column replaces an input column of the same name.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, fresh

#: Bytes of a leaf of the tree; an unsplit stretch of more characters is halved.
LEAF = 4096
#: Characters of a document beyond which its pieces are encoded in different tasks.
SPREAD = 1 << 18


class ByteBpe:
    """A byte-level BPE vocabulary file of the tokenizers library, as ranks."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take blanks or stand apart are not handled")
        self.library = Tokenizer.from_file(path)
        chars = byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(chars[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        order = [ranks[bytes(chars[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if order != sorted(set(order)):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        self.pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.core = tiktoken.Encoding("file", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        self.ranks = ranks
        self.bytes_of = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for token, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes_of[i] = token
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._split = regex.compile(self.pattern)
        self._long = regex.compile(rf"\S{{{LEAF},}}|\s{{{LEAF},}}")
        self._same: set[str] = {chr(i) for i in range(128)}
        self._other: set[str] = set()

    # -- splitting

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """The text between special strings, and their ids; special strings end what stands before."""
        if self.at_special is None or not self.at_special.search(text):
            return [(text, None)]
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += [(text[at : m.start()], None), ("", self.special[m[0]])]
            at = m.end()
        return [*out, (text[at:], None)]

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a part, as the library splits them."""
        chars = set(text)
        if not chars <= self._same:
            for c in chars - self._same - self._other:  # Unicode tables of two libraries may differ
                probe = f"a{c}a {c}1{c}.{c}  {c}"
                same = [a for _, a in self.library.pre_tokenizer.pre_tokenize_str(probe)] == [m.span() for m in self._split.finditer(probe)]
                (self._same if same else self._other).add(c)
            if not chars.isdisjoint(self._other):
                return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self._split.findall(text)

    # -- encoding

    def encode(self, text: str) -> np.ndarray:
        got = []
        for part, special in self.parts(text):
            if special is not None:
                got.append(np.array([special], np.uint32))
            elif len(part) <= LEAF or not self._long.search(part):
                got.append(self.core.encode_to_numpy(part, disallowed_special=()))
            else:
                got += [self.encode_piece(p.encode()) if len(p) > LEAF // 4 else np.asarray(self._piece(p.encode()), np.uint32) for p in self.pieces(part)]
        return got[0] if len(got) == 1 else np.concatenate(got) if got else np.zeros(0, np.uint32)

    def _piece(self, data: bytes) -> list[int]:
        return self.core._encode_single_piece(data) if data else []

    def encode_piece(self, data: bytes, leaf: int = LEAF) -> np.ndarray:
        """One unsplit stretch: its halves, joined."""
        if len(data) <= leaf:
            return np.asarray(self._piece(data), np.uint32)
        middle = len(data) // 2
        return self.join(self.encode_piece(data[:middle], leaf), self.encode_piece(data[middle:], leaf))

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of two neighbouring stretches of one unsplit stretch."""
        width = 4
        while len(left) and len(right):
            a, b = left[-width:], right[:width]
            new = np.asarray(self._piece(b"".join([self.bytes_of[i] for i in [*a.tolist(), *b.tolist()]])), np.uint32)
            if (len(a) == len(left) or new[0] == a[0]) and (len(b) == len(right) or new[-1] == b[-1]):
                return np.concatenate([left[: len(left) - len(a)], new, right[len(b) :]])
            width *= 2
        return left if len(left) else right

    def join_all(self, runs: list[np.ndarray]) -> np.ndarray:
        while len(runs) > 1:
            runs = [self.join(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
        return runs[0] if runs else np.zeros(0, np.uint32)

    # -- decoding

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")

    # -- counting

    def count_piece(self, piece: str) -> int:
        data = piece.encode()
        return 1 if data in self.ranks else len(self.encode_piece(data))


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def byte_of_char() -> dict[str, int]:
    """Byte-level files write each byte as a printable character: itself if printable in Latin-1, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _encode_udf(path: str):
    @F.arrow_udf("binary")
    def encode(text: pa.Array) -> pa.Array:
        bpe = byte_bpe(path)
        return pa.array([bpe.encode(t or "").astype("<u4", copy=False).tobytes() for t in _strings(text)], pa.binary())

    return encode


def _strings(array: pa.Array):
    for i in range(0, len(array), 256):  # not all of a batch as Python objects at once
        yield from array.slice(i, 256).to_pylist()


def decode_ids(ids: Column | str, path: str) -> Column:
    """The text of a binary column of ids (little-endian unsigned 32-bit); null of null."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        bpe = byte_bpe(path)
        return pa.array([None if x is None else bpe.decode(np.frombuffer(x, "<u4")) for x in _strings(ids)], pa.string())

    return decode(ids)


def encode_documents(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", spread: int = SPREAD) -> DataFrame:
    """Adds ids_col: the ids of each whole text as little-endian unsigned 32-bit integers.

    Texts of up to ``spread`` characters are encoded where they are read. Longer ones are
    cut before white space that follows other characters (never inside a pre-token);
    pre-tokens that are themselves long are cut into leaves. Their pieces are dealt out,
    encoded, brought together by document and joined as a tree.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    short = df.where(F.length(text) <= spread).withColumn(ids_col, _encode_udf(path)(text))
    long = _spread(df.where(F.length(text) > spread), path, text_col, ids_col, spread)
    return short.unionByName(long.select(*short.columns))


def _spread(df: DataFrame, path: str, text_col: str, ids_col: str, spread: int) -> DataFrame:
    df = df.drop(ids_col)
    row, runs_col = fresh([*df.columns, ids_col], "row", "runs")
    with Scratch(df.sparkSession, "bpe") as scratch:
        scratch.kept.add("long")
        rows = scratch.write(df.withColumn(row, F.monotonically_increasing_id()), "long")
    if rows.isEmpty():
        return rows.drop(row).withColumn(ids_col, F.lit(None).cast("binary"))
    size = max(spread // 16, LEAF)

    @F.arrow_udf("array<struct<seq: int, joins: boolean, raw: boolean, data: binary>>")
    def cut(text: pa.Array) -> pa.Array:
        bpe = byte_bpe(path)
        return pa.array([cut_text(bpe, t, size) for t in _strings(text)], pa.list_(pa.struct([("seq", pa.int32()), ("joins", pa.bool_()), ("raw", pa.bool_()), ("data", pa.binary())])))

    @F.arrow_udf("binary")
    def encode(raw: pa.Array, data: pa.Array) -> pa.Array:
        bpe = byte_bpe(path)
        return pa.array([(bpe.encode_piece(d) if r else bpe.encode(d.decode())).astype("<u4", copy=False).tobytes() for r, d in zip(raw.to_pylist(), _strings(data), strict=True)], pa.binary())

    @F.arrow_udf("binary")
    def joined(runs: pa.Array) -> pa.Array:
        bpe = byte_bpe(path)
        out = []
        for doc in runs:
            groups: list[list[np.ndarray]] = []
            for x in doc.as_py():
                ids = np.frombuffer(x["ids"], "<u4")
                if x["joins"]:
                    groups[-1].append(ids)
                else:
                    groups.append([ids])
            out.append(np.concatenate([bpe.join_all(g) for g in groups]).astype("<u4", copy=False).tobytes())
        return pa.array(out, pa.binary())

    pieces = rows.select(row, F.inline(cut(F.col(text_col)))).repartition(row, "seq")
    runs = pieces.select(row, F.struct("seq", "joins", encode("raw", "data").alias("ids")).alias(runs_col)).groupBy(row).agg(F.array_sort(F.collect_list(runs_col)).alias(runs_col))  # the pieces of one text
    return rows.join(runs, row).withColumn(ids_col, joined(runs_col)).drop(row, runs_col)


def cut_text(bpe: ByteBpe, text: str, size: int) -> list[dict]:
    """Pieces of a long text: ordinary stretches, and leaves of pre-tokens of over ``size`` characters."""
    out: list[dict] = []

    def add(data: bytes, raw: bool, joins: bool = False) -> None:
        out.append({"seq": len(out), "joins": joins, "raw": raw, "data": data})

    edge = regex.compile(r"(?<=\S)(?=\s)")
    for part, special in bpe.parts(text):
        if special is not None:
            add(bpe.bytes_of[special], False)
            continue
        at = 0
        while at < len(part):
            end = len(part)
            if len(part) - at > size:
                m = edge.search(part, at + size)
                end = m.start() if m else len(part)
            stretch = part[at:end]
            if len(stretch) <= 2 * size:
                add(stretch.encode(), False)
            else:
                for piece in bpe.pieces(stretch):
                    data = piece.encode()
                    for i in range(0, len(data), size):
                        add(data[i : i + size], True, joins=i > 0)
            at = end
    return out or [{"seq": 0, "joins": False, "raw": False, "data": b""}]
