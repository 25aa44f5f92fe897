import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import decontamination, lang_id
from docloom.llm.queries import vocabulary
from tests.llm.test_decontamination import naive
from tests.llm.test_lines import lev
from tests.llm.test_near_dedup import brute as components


def test_each_stage_and_the_whole(spark, sf001):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in C.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, sf001).collect(), before.schema)
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in docs.collect()} == {c for _, _, c in components(rows)}
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    whole = C.run(spark, sf001)
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in docs.collect()}


def test_odd_documents_pass_every_stage(spark, sf001):
    import corpus_pipeline as C

    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, n_lines string, ids string, id string"
    long = "the quick brown fox jumps over the lazy dog and runs away from the angry farmer\n" * 3000
    rows = [(1, None, "en", None, None), (None, "a b c", None, "s", 5), (2, "", None, None, 0), (3, long, "en", "s", len(long)), (3, long, "en", "s", len(long)), (4, "the fox and the dog and the farmer", "en", "s", 3), (5, "x" * 100000, "en", "s", 1)]
    odd = spark.createDataFrame([(*r, "x", "y", None, "z") for r in rows], schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in C.STAGES[:-1]:
            after = stage(spark, docs, sf001)
            assert after.columns == odd.columns
            assert {(r.row, r.n_lines, r.ids, r.id) for r in after.collect()} <= {("x", "y", None, "z")}
            after = spark.createDataFrame(after.collect(), odd.schema)
            assert after.count() <= docs.count()
        last = C.STAGES[-1][1](spark, docs, sf001).collect()
        assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last))) == sorted(map(str, (encoded(r.doc_id, r.text) for r in docs.collect())))


LIBRARY = Tokenizer.from_file(vocabulary())


def encoded(doc_id, text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def kept_languages(spark, rows):
    """Rows whose text some language's dictionary model accepts, by plain recursion; limits are those of the trained models."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = lang_id.train(df, "doc_id", "text", "lang")
    sample = lang_id._held(lang_id._sample(df, "doc_id", "text", "lang", lang_id.MAX_CHARS)).where("not held").collect()
    plain = lambda t: "".join(chr(c) for c in lang_id.letters_of(t or ""))
    tables = {}
    for lang in models.langs:
        counts = Counter()
        for r in sample:
            if r.lang == lang:
                padded = "    " + plain(r.text)
                counts.update(padded[i : i + 5] for i in range(len(padded) - 4))
        tables[lang] = lang_id._kneser_ney(counts)

    def bits(text, lang):
        prob, weight, floor = tables[lang]

        def p(g):
            return prob[g] if g in prob else floor if len(g) == 1 else weight.get(g[:-1], 1.0) * p(g[1:])

        padded = "    " + text
        return -sum(np.log2(p(padded[i : i + 5])) for i in range(len(text))) / max(len(text), 1)

    texts = [plain(t) for _, t, _ in rows]
    _, _, rejected = models.judge(np.array([[bits(t, lang) for lang in models.langs] for t in texts]), np.array([len(t) for t in texts]))
    return [r for r, gone in zip(rows, rejected, strict=True) if not gone]


def without_lines(spark, rows):
    order = {(r.i, r.t): r.h for r in spark.createDataFrame([(i, t) for i, t, _ in rows], "i long, t string").select("i", "t", F.xxhash64("t").alias("h")).collect()}
    seen, out = [], {}
    for i, t in sorted(order, key=lambda k: (k[0], order[k])):
        left = []
        for line in t.split("\n"):
            bare = line.strip(" \t\r\x0b\x0c")
            gone = bool(bare) and any(x == bare or min(len(x), len(bare)) >= 40 and abs(len(x) - len(bare)) <= 1 and lev(x, bare) <= 1 for x in seen)
            seen += [bare] if bare else []
            left += [] if gone else [line]
        out[i, t] = "\n".join(left)
    kept = [(i, out[i, t], lang, out[i, t] == t) for i, t, lang in rows]
    return [(i, t, lang) for i, t, lang, same in kept if same or t.strip()]


def test_rows_are_those_of_a_brute_force_version(spark, tmp_path):
    import corpus_pipeline as C

    random.seed(12)
    words = {"en": "the quick brown fox and lazy dog of a man with some old books", "de": "der schnelle braune fuchs und faule hund mit einem alten buch"}
    say = lambda lang, n: " ".join(random.choice(words[lang].split()) for _ in range(n))
    rows = [(i, "\n".join(say(lang, random.randint(9, 16)) for _ in range(random.randint(1, 4))), lang) for i, lang in enumerate(random.choices(["en", "de"], k=60))]
    items = [(k, say("en", 14)) for k in range(3)]
    common = say("en", 12)
    rows += [(100, rows[4][1], "en"), (101, rows[5][1] + " dog", "en"), (102, rows[6][1].replace("e", "ee", 1), "de"), (103, say("en", 20) + " " + items[0][1], "en"), (104, f"{say('de', 12)}\n{items[1][1][20:]} {items[1][1][:20]}", "en")]
    rows += [(110 + k, f"{common}\n{say('en', 11)}", "en") for k in range(4)] + [(120, "漢字" * 200, None), (121, None, "en"), (122, "12 34", "de"), (123, f"{common[:-1]}", "en"), (4, rows[4][1], rows[4][2])]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = without_lines(spark, kept_languages(spark, rows))
    found, seen = components([(i, t) for i, t, _ in left]), set()
    one = []
    for (i, t, _), (_, n, c) in zip(left, found, strict=True):
        if i == c and (not n or c not in seen):
            seen.add(c)
            one.append((i, t))
    hashes = lambda t: decontamination.tokens_of([t])[0].tolist()
    clean = [(i, t) for i, t in one if not any(naive(hashes(t), hashes(x), decontamination.SEED) >= 0.5 * len(hashes(x)) for _, x in items)]
    got = C.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(encoded(i, t) for i, t in clean)
    assert 0 < len(clean) < len(one) < len(left) < len(rows)
