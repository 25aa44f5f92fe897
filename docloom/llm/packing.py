"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each task encodes its documents, ends each with an end id, and cuts off whole windows, which
are sequences of their own. The rest of each document, in pieces of at most PIECE ids, is
gathered until GROUP windows' worth (less SLACK ids a window) are there, the last document
being cut where it is reached, and the last FINE ids a window finely, which evens out what the larger pieces leave. A group is then differenced: every piece begins as a partial
partition of as many windows as the group needs, all empty but one; the two partial
partitions of the largest imbalance are merged, the fullest windows of one with the emptiest
of the other, until one is left, whose windows are near equal. If one of them exceeds the
capacity, the window count rises by one and the group is differenced again.

Nothing is exchanged, and a task holds the pieces of one group and one document. A window of
whole or joined pieces is at most ``capacity`` ids long; the padding is about SLACK ids a window, and
less than a window more for the last group of a task.

The ids are those of the ``tokenizers`` library for a file whose words are encoded apart: its
normaliser composes characters (NFC), joins white space and lower-cases, its
pre-tokeniser keeps what a pattern matches. The words of a text whose characters all pass through
these steps here as they do in the library are looked up, each distinct word being merged once
by ranks made from the file; texts with other characters or special strings, and very long words, go
through the library.

Defined results: a null text is empty and gives the end id alone; each row is packed, repeated or
with a null id; texts are encoded whole, of any length; ties of imbalance are taken in order of
arrival, so the same partitions give the same rows; an empty table gives no pieces; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.bpe import byte_of_char
from docloom.llm.common import trim_memory

#: Windows of a group, ids of a piece at most, ids left free in a window on average, and ids of the pieces that end a group.
GROUP, PIECE, SLACK, FINE = 32, 1024, 32, 32
#: Distinct words that a task remembers; characters of a text that are split at once.
WORDS, STRETCH = 1 << 19, 1 << 20
#: Characters from which the library encodes a single word.
LONG = 1024


class _Words(dict):
    """The ids of a word as bytes."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS:
            self.clear()
        self[word] = got = np.array(self.encode(word), "<u4").tobytes()
        return got


class WordBpe:
    """A vocabulary file of the tokenizers library whose words are encoded apart."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.split = self.core = None
        if steps == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"]:
            self.core = self._ranked(spec)
            self.split = self.core and regex.compile(split["pattern"]["Regex"])
        self.words = _Words(self._word)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self._same: set[str] = set()
        self._other: set[str] = set()

    @staticmethod
    def _ranked(spec: dict):
        """The merges as ranks of byte strings, the end of a word being the byte FF, which UTF-8 never holds; None if they can't be written so."""
        import tiktoken

        model, chars, end = spec["model"], byte_of_char(), spec["model"]["end_of_word_suffix"]
        special = {t["content"] for t in spec["added_tokens"]}
        plain = {token: i for token, i in model["vocab"].items() if token not in special}
        ranks = {bytes(chars[c] for c in token.removesuffix(end)) + b"\xff" * token.endswith(end): i for token, i in plain.items()} if end else {}
        order = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        singles = [i for token, i in ranks.items() if len(token.removesuffix(b"\xff")) <= 1]
        if model.get("dropout") or model.get("ignore_merges") or len(ranks) < len(plain) or order != sorted(set(order)) or order and max(singles) > order[0]:
            return None
        return tiktoken.Encoding("file", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})

    def _word(self, word: str) -> list[int]:
        if len(word) > LONG:
            return self.library.encode(word, add_special_tokens=False).ids
        return self.core._encode_single_piece(word.encode() + b"\xff")

    def _known(self, chars: set[str]) -> bool:
        """Whether each character alone and between others gives the same words here and in the library; below U+0300 and in general punctuation none composes with another."""
        for c in chars - self._same - self._other:
            probe = f"a{c}a {c}1{c}.{c}  {c}"
            same = c < "\u0300" or "\u2010" <= c <= "\u205e"
            if same:
                normal = self.library.normalizer.normalize_str(probe)
                same = self.split.findall(probe.lower()) == [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]
            (self._same if same else self._other).add(c)
        return chars.isdisjoint(self._other)

    def encode(self, text: str) -> bytes:
        """The ids, little-endian unsigned 32-bit."""
        if self.split is None or not self._known(set(text)) or self.special.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out, at = [], 0
        while at < len(text):
            end = min(at + STRETCH, len(text))
            while end < len(text) and not text[end].isspace():  # words do not span white space
                end += 1
            out.append(b"".join(map(self.words.__getitem__, self.split.findall(text[at:end].lower()))))
            at = end
        return b"".join(out)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Places of the sizes, dealt to so many windows of near-equal sums."""
    heap: list[tuple] = []
    for k, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[-1] = size
        heap.append((-size, k, sums, [None] * (windows - 1) + [k]))
    heapq.heapify(heap)
    for step in range(len(sizes), 2 * len(sizes) - 1):
        (_, _, a, of_a), (_, _, b, of_b) = heapq.heappop(heap), heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(sums, kind="stable")
        sums = sums[order] - sums[order[0]]  # only differences count from here on
        both = [y if x is None else x if y is None else (x, y) for x, y in zip(of_a, reversed(of_b), strict=True)]
        heapq.heappush(heap, (-int(sums[-1]), step, sums, [both[i] for i in order.tolist()]))
    out = []
    for tree in heap[0][3] if heap else []:
        own, left = [], [tree]
        while left:
            x = left.pop()
            if isinstance(x, tuple):
                left += x
            elif x is not None:
                own.append(x)
        out.append(sorted(own))
    return out


def deal(sizes: list[int], capacity: int, slack: int = 0) -> list[list[int]]:
    """Windows of at most capacity; their count begins at what the sum needs and rises until all fit."""
    windows = max(1, -(-sum(sizes) // max(1, capacity - slack)))
    while True:
        dealt = difference(sizes, windows)
        if max((sum(sizes[i] for i in w) for w in dealt), default=0) <= capacity:
            return [w for w in dealt if w]
        windows += 1


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int | None = 2) -> DataFrame:
    """The pieces of all documents: id_col, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    sequence_id is the number of the task's partition, times 2 ** 33, and a count.
    """
    kind = df.schema[id_col].dataType
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    piece, slack, fine = min(PIECE, max(1, capacity // 4)), min(SLACK, capacity // 8), min(FINE, max(1, capacity // 8))
    names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, number = word_bpe(path), TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        waiting: list[tuple] = []  # pieces of the group: id, start, length, ids of the document, ids
        full, ids_type = GROUP * (capacity - slack), None
        gathered = held = 0

        def sequence(parts: list[tuple]) -> None:
            nonlocal number, held
            at = 0
            for doc, start, length, whole, ids in parts:
                rows.append((doc, start, length, whole, number, at, ids))
                at += length
            held += at
            number += 1

        def close() -> None:
            nonlocal gathered
            for window in deal([x[2] for x in waiting], capacity, slack):
                sequence([waiting[i] for i in window])
            waiting.clear()
            gathered = 0

        def out() -> pa.RecordBatch:
            nonlocal held
            kinds = (ids_type, *[pa.int64()] * 5, pa.binary())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            held = 0
            return batch

        for batch in batches:
            ids_type = batch.column(0).type
            for at in range(0, len(batch), 64):  # not all of a batch as Python objects at once
                for doc, text in zip(*(batch.column(i).slice(at, 64).to_pylist() for i in (0, 1)), strict=True):
                    ids = bpe.encode(text or "") + end
                    whole, start = len(ids) // 4, 0
                    while start < whole:
                        length = min(whole - start, capacity)
                        if length < capacity:
                            length = min(length, piece if gathered < full - GROUP * fine else fine, full - gathered)
                        part = (doc, start, length, whole, ids[4 * start : 4 * (start + length)])
                        start += length
                        if length == capacity:
                            sequence([part])
                            continue
                        waiting.append(part)
                        gathered += length
                        if gathered == full:
                            close()
                    if held >= 1 << 20:
                        yield out()
        if waiting:
            close()
        if rows:
            yield out()
        trim_memory()

    schema = f"`{id_col}` {kind.simpleString()}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    return df.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(pieces, schema)
