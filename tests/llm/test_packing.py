"""Packing: ids by the tokenizers library, each in one piece, windows within capacity and nearly full."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from docloom.llm import packing
from docloom.llm.queries import op12_packing, vocabulary

PATH = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    got = Tokenizer.from_file(PATH)
    got.no_truncation()
    got.no_padding()
    return got


def check(rows, texts, library, capacity, end=(2,)):
    """rows: (doc_id, start, length, doc_tokens, sequence_id, offset, crc32 of the ids)."""
    pieces, windows = defaultdict(list), defaultdict(list)
    for doc, start, length, whole, seq, offset, crc in rows:
        pieces[doc].append((start, length, whole, crc))
        windows[seq].append((offset, length))
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids, at = np.array([*library.encode(text or "", add_special_tokens=False).ids, *end], "<u4"), 0
        for start, length, whole, crc in sorted(pieces[doc]):
            assert (start, whole) == (at, len(ids)) and length > 0 and zlib.crc32(ids[start : start + length].tobytes()) == crc
            at += length
        assert at == len(ids)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sum(n for parts in windows.values() for _, n in parts) / (capacity * len(windows))


def test_query(spark, sf001, library):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()}
    rows = op12_packing(spark, sf001).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32").collect()
    assert check([tuple(r) for r in rows], texts, library, 4096) > 0.97


ODD = [None, "", "   \n", "<|endoftext|> and <|startoftext|>x", "ÉCOLE École İstanbul ΣΑΣ ςσ", "한국어 漢字 का é ﬁ", "x" * 5000, "don't 'S we'll 12345", "a\x00b\xa0c d​e", "😀😀 ‘q’ – … ™", "ŸŸ ÿ ñandú 'T", "word " * 9000]


@pytest.mark.parametrize("capacity", [64, 512])
def test_odd_texts(spark, library, capacity):
    texts = dict(enumerate(ODD)) | {i + 100: f"hello {i} world " * (i % 70) for i in range(300)}
    df = spark.createDataFrame([(i, t, 1, "x", None) for i, t in texts.items()], "doc_id int, text string, start int, ids string, Offset int").repartition(3)
    rows = packing.pack(df, PATH, capacity=capacity)
    assert rows.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    assert check([(*r[:6], zlib.crc32(r[6])) for r in rows.collect()], texts, library, capacity) > 0.85


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "one two"), (None, "one two"), ("a", None)], "name string, body string").coalesce(1)
    rows = packing.pack(df, PATH, "name", "body", capacity=8).collect()
    assert sum(r["length"] for r in rows) == 7 and {r["name"] for r in rows} == {None, "a"} and len({r["sequence_id"] for r in rows}) == 1
    assert packing.pack(df.limit(0), PATH, "name", "body").count() == 0
    assert packing.pack(df.where("name = 'a'"), PATH, "name", "body", end_id=None).count() == 0


def test_words_against_the_library(library):
    """Every token of the file that is a word, random words, and texts of odd characters."""
    bpe, rng = packing.WordBpe(PATH), random.Random(1)
    assert bpe.core is not None
    words = [w.removesuffix("</w>") for w in library.get_vocab() if w.endswith("</w>") and w.removesuffix("</w>").isascii()]
    words += ["".join(rng.choice("abcdeghilmnorstuéèñßçüöä'") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for text in [*(" ".join(words[i : i + 50]) for i in range(0, len(words), 50)), *("".join(rng.choice("aB é\n'sßÿ1…–!") for _ in range(60)) for _ in range(300)), *(x for x in ODD if x)]:
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_difference():
    assert [sorted(x) for x in packing.difference([], 3)] == []
    rng = random.Random(2)
    for _ in range(30):
        sizes, windows = [rng.randint(1, 300) for _ in range(rng.randint(1, 200))], rng.randint(1, 20)
        dealt = packing.difference(sizes, windows)
        assert len(dealt) == windows and sorted(i for w in dealt for i in w) == list(range(len(sizes)))
    sizes = [rng.randint(1, 300) for _ in range(400)]
    sums = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 16)]
    assert max(sums) - min(sums) <= 4


def test_the_window_count_rises():
    assert len(packing.deal([60, 60, 60], 100)) == 3  # two windows hold 180, but no two pieces fit into one
    assert len(packing.deal([50, 50, 50, 50], 100)) == 2
    assert packing.deal([7], 7) == [[0]]
