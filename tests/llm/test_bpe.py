import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import bpe
from docloom.llm.queries import vocabulary
from docloom.llm.token_counts import _is_text, count_tokens

PATH = vocabulary()
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["", None, "a", " ", "\n\n  x  ", "Hello world, it's 12 o'clock<|endoftext|>  again", "é中文 ñandú x y ﷽", "a" * 30000, "ab" * 9000 + " x " + "\t" * 9000 + "z", "x " * 9000, "'s" * 5000, "<|endoftext|><|endoftext|>", "힣\U0001f600" * 3000]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_encoded_as_the_library_does(text):
    ids = bpe.byte_bpe(PATH).encode(text)
    assert ids.tolist() == ids_of(text)
    assert bpe.byte_bpe(PATH).decode(ids) == LIBRARY.decode(ids_of(text), skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abeinrst", min_size=1, max_size=200), st.integers(1, 16))
def test_tree_of_any_leaf_size_gives_the_whole_encoding(text, leaf):
    own = bpe.byte_bpe(PATH)
    data = text.encode()
    assert own.encode_piece(data, leaf).tolist() == own._piece(data)


@settings(max_examples=100, deadline=None)
@given(st.text(min_size=1, max_size=80))
def test_pieces_are_those_of_the_library(text):
    assert bpe.byte_bpe(PATH).pieces(text) == [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]


@pytest.mark.parametrize("spread", [1 << 20, 2000])
def test_documents_long_or_short(spark, spread):
    rows = [(i, t, "old") for i, t in enumerate(TEXTS)] + [(None, "x y", None), (3, " ", "old")]
    rows = [(*r, "r", "w", "q") for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, runs string, row string, seq string")  # a clashing column is replaced
    got = bpe.encode_documents(df, PATH, spread=spread).withColumn("back", bpe.decode_ids(F.col("ids"), PATH)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.runs, r.row, r.seq) == ("r", "w", "q")
        assert np.frombuffer(r.ids, "<u4").tolist() == ids_of(r.text)
        assert r.back == (r.text or "")


def test_token_counts(spark):
    random.seed(4)
    words = ["".join(random.choice("aeionrst") for _ in range(random.randint(1, 14))) for _ in range(300)]
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(random.choices(words, k=60)), None) for i in range(700)] + [(None, "repeated rows", "k")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_bytes) for r in count_tokens(df, PATH).collect())
    assert got == sorted((str(i), len(ids_of(t)), len((t or "").encode())) for i, t, _ in rows)


def test_vocabulary_entries_that_are_pretokens_are_one_token():
    own = bpe.byte_bpe(PATH)
    known = [t.decode() for t in own.ranks if _is_text(t)]
    known = [t for t in known if t and own.pieces(t) == [t]]
    assert len(known) > 40000 and all(len(x.ids) == 1 for x in LIBRARY.encode_batch(known, add_special_tokens=False))


def test_blocks_of_all_partitions_are_salted_apart():
    from docloom.llm import token_counts

    salts = {token_counts._salt(p << 33) for p in range(1000)}
    assert len(salts) > 800 and 0 not in salts


def test_frequencies_beyond_16_bits(spark):
    df = spark.createDataFrame([(1, " qzxv" * 70000)], "doc_id long, text string")
    assert count_tokens(df, PATH).first().n_tokens == 70000 * len(ids_of(" qzxv"))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(df, PATH).count() == 0 and count_tokens(df, PATH).count() == 0


def test_query_matches_the_library(spark, sf001):
    from docloom.llm.queries import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    for r in queries()["op6_bpe"](spark, sf001).collect():
        ids = ids_of(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in queries()["op10_token_counts"](spark, sf001).collect():
        assert r.n_tokens == len(ids_of(texts[r.doc_id])) and r.over_limit == (r.n_tokens > 512)


def test_query_over_long_unsplit_stretches(spark, tmp_path):
    """Stretches of a million letters within prose, runs of emoji and blanks, special strings: by the tree, in one task and in many."""
    from docloom.llm.queries import queries

    random.seed(8)
    letters = "".join(random.choices("aeiourstlné", k=1_000_000))
    prose = "Some ordinary words, 12 of them, stand here. " * 40
    texts = [prose + letters + " " + prose, letters[:30_000] + "<|endoftext|>" + letters[:5_000], "\U0001f600" * 20_000 + prose, " " * 50_000 + "x" + "\n" * 20_000, "=" * 70_000, prose, "", None]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    own = bpe.byte_bpe(PATH)
    tree = [i for i, t in enumerate(texts) if t and any(len(p) > bpe.LEAF for part, special in own.parts(t) if special is None for p in own.pieces(part))]
    spread = [i for i, t in enumerate(texts) if t and len(t) > bpe.SPREAD]
    print("rows by the tree:", tree, "of which in many tasks:", spread)
    assert tree == [0, 1, 2, 3, 4] and spread == [0]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries()["op6_bpe"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = ids_of(t)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), i
