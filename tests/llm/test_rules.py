import re
import unicodedata
from collections import Counter

from docloom.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    letters = sum(unicodedata.category(c)[0] == "L" for c in text)
    bullets = sum(x.lstrip(" \t\n\x0b\x0c\r")[0] in "-*•" for x in lines)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(hit), letters, bullets


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_bullets")
TEXTS = ["", None, "one", "a b", "a b c", "a b c a b c", "a a a a", "x y z x y\nx y z\nx y z\n\n \n \nq", "é é é | <b> &   w\x0bw\x0cw", "the cat " * 400, " ".join(f"w{i % 700}" for i in range(3000)), "z" * 50000, "- a\n* b\n• c\n" * 30, "1 2 3 4 " * 20, "a b\nc d\n" * 60, "w " * 300000]


def test_measures(spark):
    df = spark.createDataFrame([(t, "old") for t in TEXTS], "text string, n_lines string")
    for r in Q.measure(df, "text", COLUMNS).collect():
        assert tuple(r[c] for c in COLUMNS) == brute(r.text), r.text and r.text[:40]


def test_places_beyond_the_packed_bits(spark, monkeypatch):
    monkeypatch.setattr(Q, "_INDEX_BITS", 3)
    for r in Q.measure(spark.createDataFrame([(t,) for t in TEXTS[:9]], "text string"), "text", COLUMNS).collect():
        assert tuple(r[c] for c in COLUMNS) == brute(r.text)


def verdict(text):
    n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letters, n_bullets = brute(text)
    bad = n_words < 50 or 100 * n_repeat_words > 50 * n_words or 100 * n_symbols > 10 * n_words or word_chars < 2 * n_words or word_chars > 20 * n_words
    return not (bad or 100 * n_dup_lines > 50 * n_lines or 100 * n_letters < 50 * word_chars or 100 * n_bullets > 90 * n_lines)


def test_verdict_does_not_depend_on_the_order(spark):
    rows = [*enumerate(TEXTS), (0, TEXTS[0]), (None, TEXTS[9]), (99, " ".join(f"word{i}" for i in range(400)))]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, kept string, rejected_by string, words string")
    want = sorted(((i, verdict(t)) for i, t in rows), key=str)
    for order in (None, list(Q.RULES), list(reversed(Q.RULES))):
        got = Q.apply_rules(df, order=order)
        assert sorted(((r.doc_id, r.kept) for r in got.collect()), key=str) == want
        assert got.columns[:2] == ["doc_id", "text"] and {r.words for r in got.collect()} == {"z"}
    none = Q.apply_rules(df, rules=()).collect()
    assert all(r.kept for r in none)


def test_rejected_rows_are_not_measured_further(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    few, letters, words = (next(r for r in Q.RULES if r.name == n) for n in ("few_words", "few_letters", "repeated_words"))
    one, two = (Q.apply_rules(df, order=order).collect() for order in ([few, words, letters], [letters, words, few]))
    assert all((r.n_repeat_words is None) == (r.rejected_by == "few_words") for r in one)
    assert all((r.n_letters is None) == (r.rejected_by in ("few_words", "repeated_words")) for r in one)
    assert all(r.n_letters is not None for r in two) and any(r.n_repeat_words is None for r in two)
    assert [r.kept for r in one] == [r.kept for r in two]
    told = Q.apply_rules(df, order=[few, words], always=("n_repeat_words",)).collect()
    assert all(r.n_repeat_words == brute(r.text)[5] for r in told)


def test_equal_high_bits_are_told_apart(spark, monkeypatch):
    """With all but a few bits of a hash given to places, different windows often share the rest."""
    monkeypatch.setattr(Q, "_INDEX_BITS", 58)
    texts = [" ".join("ab"[i * i * 7 % 11 % 2] + str(i % k) for i in range(300)) for k in range(3, 40)]
    for r in Q.measure(spark.createDataFrame([(t,) for t in texts], "text string"), "text", ("n_repeat_words",)).collect():
        assert r.n_repeat_words == brute(r.text)[5]


def test_plan_orders_by_rejection_per_cost(spark):
    plan = Q.plan_cascade(spark.createDataFrame([(t,) for t in TEXTS * 20], "text string"), "text")
    rates = [share / cost for _, cost, share in plan]
    assert rates == sorted(rates, reverse=True) and {r.name for r, _, _ in plan} == {r.name for r in Q.RULES}


def test_empty_table(spark):
    assert Q.apply_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0
