import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import lang_id, quality_model
from docloom.llm.queries import queries


def test_kneser_ney_is_a_distribution():
    from collections import Counter

    text = "    the cat and the hat and that bat "
    counts = Counter(text[i : i + 5] for i in range(len(text) - 4))
    prob, weight, floor = lang_id._kneser_ney(counts)
    letters = {g[-1] for g in counts}
    for context in {g[:-1] for g in counts}:
        seen = sum(prob[g] for g in counts if g[:-1] == context)
        assert seen <= 1 + 1e-9

    def p(g):
        return prob[g] if g in prob else floor if len(g) == 1 else weight.get(g[:-1], 1.0) * p(g[1:])

    # all characters, and the 64 that stand for unseen ones
    for context in ("at t", "hat ", "zzzz"):
        assert sum(p(context + c) for c in letters) + 64 * p(context + "\u9999") == pytest.approx(1)


def test_table_agrees_with_recursion():
    from collections import Counter

    sample = {"xx": "abra cadabra abra ", "yy": "lorem ipsum dolor "}
    counts = {k: Counter(("    " + v)[i : i + 5] for i in range(len(v))) for k, v in sample.items()}
    models = lang_id.build(counts)
    text = "abra lorem qq dolora"
    codes = lang_id.letters_of(text)
    bits, n = models.entropies(codes)
    for j, lang in enumerate(models.langs):
        prob, weight, floor = lang_id._kneser_ney(counts[lang])

        def p(g):
            return prob[g] if g in prob else floor if len(g) == 1 else weight.get(g[:-1], 1.0) * p(g[1:])

        padded = "    " + text + " "
        want = -sum(np.log2(p(padded[i : i + 5])) for i in range(len(text) + 1)) / n
        assert bits[j] == pytest.approx(want, rel=1e-5)
    many, size = models.batch([codes, lang_id.letters_of(""), codes])
    assert np.allclose(many[0], bits) and np.allclose(many[2], bits) and size.tolist() == [n, 0, n]


def test_held_out_accuracy(spark, sf001):
    rows = queries()["op3_lang_id"](spark, sf001).toPandas()
    truth = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "lang").toPandas()
    both = rows.merge(truth, on="doc_id")
    assert (both[both.held_out].lang_pred == both[both.held_out].lang).mean() > 0.97
    assert both.score.between(0, 1).all() and len(rows) == len(truth)


def test_language_edge_cases(spark):
    random.seed(1)
    say = lambda words: " ".join(random.choice(words.split()) for _ in range(40))
    rows = [(i, say("the quick brown fox and the lazy dog of a man"), "en") for i in range(40)] + [(100 + i, say("der schnelle braune fuchs und der faule hund"), "de") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = lang_id.train(df, "doc_id", "text", "lang")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the dog and the fox"), (5, "漢字" * 400), (None, "der hund " * 20000)], "doc_id long, text string")
    got = {r.doc_id: r.got for r in odd.select("doc_id", lang_id.identify("text", models, spark).alias("got")).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1, 2, 3))
    assert got[4].lang_pred == "en" and got[None].lang_pred == "de" and got[5].rejected and not got[4].rejected
    none = lang_id.train(df.limit(0), "doc_id", "text", "lang")
    assert {r.got.lang_pred for r in odd.select(lang_id.identify("text", none, spark).alias("got")).collect()} == {"und"}


def test_ties_between_languages_go_to_the_first(spark):
    rows = [(i, "the same words for all of us", lang) for i in range(20) for lang in ("bb", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = lang_id.train(df, "doc_id", "text", "lang")
    got = spark.createDataFrame([("the same words",)] * 2, "text string").select(lang_id.identify("text", models, spark).alias("g")).collect()
    assert [(r.g.lang_pred, r.g.score) for r in got] == [("aa", 0.5)] * 2


def test_an_odd_calibration_text_does_not_let_others_pass(spark):
    random.seed(9)
    say = lambda words, n: " ".join(random.choice(words.split()) for _ in range(n))
    rows = [(i, say("the quick brown fox and the lazy dog of a man", 40), "en") for i in range(300)]
    odd = [(1000 + i, say("zxq vwk jjq qzz xkk", 30), "en") for i in range(3)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    for extra in (df, df.where("doc_id < 1000")):
        models = lang_id.train(extra, "doc_id", "text", "lang")
        got = spark.createDataFrame([("bcd fgh jkl mnp rst vwx " * 8,), ("the lazy fox and a man of the quick dog",)], "text string").select(lang_id.identify("text", models, spark).alias("g")).collect()
        assert [r.g.rejected for r in got] == [True, False]


def test_a_language_of_few_long_texts_is_learned(spark):
    say = lambda words, n: " ".join(random.choice(words.split()) for _ in range(n))
    random.seed(2)
    for first in range(0, 40, 10):  # at a rate of 0.03, none of ten whole rows is likely to be picked
        rows = [(first + i, say("the quick brown fox and the lazy dog", 7000), "en") for i in range(10)] + [(first + 100 + i, say("der schnelle braune fuchs", 20), "de") for i in range(2)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        sample = lang_id._held(lang_id._sample(df, "doc_id", "text", "lang", 10000)).groupBy("lang").agg(F.sum(F.length("text")).alias("n"), F.count_if(F.col("held")).alias("held"), F.count_if(~F.col("held")).alias("fit")).collect()
        assert {r.lang for r in sample} == {"en", "de"} and all(r.held and r.fit and r.n <= 10000 for r in sample)
    assert lang_id.train(df, "doc_id", "text", "lang", max_chars=10000).langs == ["de", "en"]


def test_rows_of_one_id_stay_within_the_bound(spark):
    """Null ids, one id for all rows, rows repeated whole: the sample is no larger than with ids of their own."""
    text = lambda i: f"{'abcdefghij'[i % 10]} the quick brown fox {'xyzw'[i % 4] * (i % 37)} " * 5
    for ids in (lambda i: None, lambda i: 7, lambda i: i):
        rows = [(ids(i), text(i) + "q" * (i // 1000), "en") for i in range(3000)]
        sample = lang_id._sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 20000)
        n, chars = sample.agg(F.count("*"), F.sum(F.length("text"))).first()
        assert 10 <= n and chars <= 30000
    same = spark.createDataFrame([(None, "the quick brown fox", "en")] * 2000, "doc_id long, text string, lang string")
    assert lang_id._sample(same, "doc_id", "text", "lang", 4000).count() == 1


def test_query_against_brute_force(spark, tmp_path):
    """op3_lang_id over a small table: each text's language by dictionaries of n-grams and plain recursion."""
    from collections import Counter

    random.seed(5)
    say = lambda words, n: " ".join(random.choice(words.split()) for _ in range(n))
    kinds = {"en": "the quick brown fox and the lazy dog of a man", "de": "der schnelle braune fuchs und der faule hund", "fr": "le renard brun rapide et le chien paresseux"}
    rows = [(i, say(kinds[lang], random.randint(1, 60)), lang) for i, lang in enumerate(random.choices([*kinds], k=150))]
    rows += [rows[3], rows[3], (151, None, "en"), (152, "1 2 !", "de"), (None, say(kinds["de"], 30), "de"), (153, say(kinds["fr"], 30), None), (154, "", "fr"), (155, say(kinds["en"], 5000), None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, bits string, got string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.lang_pred) for r in queries()["op3_lang_id"](spark, str(tmp_path)).collect())
    import zlib

    seen = df.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    sample = lang_id._held(lang_id._sample(seen, "doc_id", "text", "lang", lang_id.MAX_CHARS)).where("not held").collect()
    plain = lambda t: "".join(chr(c) for c in lang_id.letters_of(t or ""))
    models = {}
    for lang in kinds:
        counts = Counter()
        for r in sample:
            if r.lang == lang:
                padded = "    " + plain(r.text)
                counts.update(padded[i : i + 5] for i in range(len(padded) - 4))
        models[lang] = lang_id._kneser_ney(counts)

    def bits(text, lang):
        prob, weight, floor = models[lang]

        def p(g):
            return prob[g] if g in prob else floor if len(g) == 1 else weight.get(g[:-1], 1.0) * p(g[1:])

        padded = "    " + text
        return -sum(np.log2(p(padded[i : i + 5])) for i in range(len(text)))

    want = [(str(i), min(sorted(kinds), key=lambda lang, t=plain(t): bits(t, lang)) if plain(t) else "und") for i, t, _ in rows]
    assert got == sorted(want)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in queries()["op3_lang_id"](spark, str(tmp_path)).where("held_out is not null").collect())


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = quality_model.FactorisationMachine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    f, x, at = np.array([0, 3, 8, 1]), np.array([0.5, 1.0, -2.0, 1.5]), np.array([0, 3, 3, 4])
    want = []
    for a, b in zip(at, at[1:], strict=False):
        y = 0.3 + (m.w[f[a:b]] * x[a:b]).sum()
        y += sum((m.v[f[i]] @ m.v[f[j]]) * x[i] * x[j] for i in range(a, b) for j in range(i + 1, b))
        want.append(1 / (1 + np.exp(-y)))
    assert np.allclose(m.score(f, x, at), want)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries()["op7_quality_model"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = rows[rows.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert ((rows.score >= 0.5) == (rows.predicted == 1)).all()


def test_quality_query_against_brute_force(spark, tmp_path):
    """op7_quality_model over a small table: features by plain counting, all pairs of them by their products."""
    import math
    import re
    from collections import Counter

    from docloom.llm import textvec

    random.seed(8)
    texts = [" ".join(random.choices(("Fine prose words here", "## 12 | x !! $", "a b\nc, d.")[i % 3].split(" "), k=random.randint(1, 30))) for i in range(60)] + ["", None, "one", "é É é"]
    rows = [(i, t, "x", 1.5) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1.5), (None, "null id", "y", None)]
    spark.createDataFrame(rows, "doc_id long, text string, id string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0, 0) for i in range(40)] + [(3, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    seen = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    m = quality_model.train(seen, spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", "text", "quality")

    def brute(text):
        raw = (text or "").encode()
        fold = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
        words = Counter(re.findall(rb"[^\x20\x09-\x0D]+", fold))
        buckets = Counter()
        for w, n in words.items():
            data = np.frombuffer(w, np.uint8)
            buckets[int(textvec.words_of(data, np.array([0, len(data)]))[0][0] >> np.uint64(48))] += n
        x = {b: math.log2(1 + n) for b, n in buckets.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        x = {b: v / norm for b, v in x.items()}
        n, k = max(len(raw), 1), max(sum(words.values()), 1)
        if raw:
            kinds = [math.sqrt(sum(quality_model._KIND[c] == j for c in raw) / n) for j in range(9)]
            stats = [*kinds, len(buckets) / k, max(buckets.values(), default=0) / k, len(raw) / k / 16, math.log2(1 + sum(words.values())) / 16, math.log2(1 + len(raw)) / 16]
            x |= {quality_model.BUCKETS + j: v for j, v in enumerate(stats)}
        y = m.w0 + sum(m.w[i] * v for i, v in x.items())
        f = sorted(x)
        y += sum(float(m.v[a] @ m.v[b]) * x[a] * x[b] for i, a in enumerate(f) for b in f[i + 1 :])
        return 1 / (1 + math.exp(-y))

    got = queries()["op7_quality_model"](spark, str(tmp_path)).collect()
    want = Counter()
    for i, t, *_ in rows:
        want[str(i), round(brute(t), 4)] += 1
    assert len(got) == len(rows)
    for r in got:
        near = [k for k in want if k[0] == str(r.doc_id) and abs(k[1] - r.score) < 2e-4 and want[k]]
        assert near, (r, [k for k in want if k[0] == str(r.doc_id)])
        want[near[0]] -= 1


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, quality int")
    texts = spark.createDataFrame([(1, "good words here"), (2, "## || ##"), (3, None), (4, ""), (5, "w" * 300000)], "doc_id long, text string").withColumns({"id": F.lit("x"), "label": F.lit("y"), "f": F.lit(1)})
    for known in (labels, labels.limit(0)):
        model = quality_model.train(known, texts, "doc_id", "text", "quality")
        got = [r.s for r in texts.select(quality_model.score("text", model, spark).alias("s")).collect()]
        assert len(got) == 5 and all(0 <= s <= 1 for s in got)
    assert got == [0.5] * 5
