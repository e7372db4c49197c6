import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import text as tx


def evaluate(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    return [r.v for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


CASES = {
    "links": (tx.extract_urls, {
        "see (http://a.b/c?x=1), HTTPS://d.e/f; <http://g.h> [http://i.j/k] http://a.b/c?x=1.":
            ["http://a.b/c?x=1", "HTTPS://d.e/f", "http://g.h", "http://i.j/k"],
        "ftp://a.b http:/c https://": [],
        "": [],
    }),
    "words": (tx.word_tokens, {
        "Café ÜBER x_1 café . a": ["café", "über", "x_1", "a"],
        "don't": ["don", "t"],
        "": [],
    }),
    "numbers": (tx.number_tokens, {
        "12.5 and 1.5 and 1.5a and 007 x12 3 44 5_6 44": ["12", "5", "1.5", "1", "007", "3", "44"],
        "10.20.30": ["10", "20", "30"],
        "none": [],
    }),
    "lines": (tx.lines, {"a\x0bb\x0cc\x1cd e\x85f\r\n g \n\nh": ["a", "b", "c", "d e", "f", "g", "h"], " \n ": [], "": []}),
    "answers": (tx.clean_answer, {
        "I. As an AI language model, I can not\ntell. Yes.  Two": "I. Yes. Two",
        "AS AN AI LANGUAGE MODEL no stop": "",
        "\t x \x01\x02  y ": "x y",
    }),
    "kept": (lambda c: tx.kept_tokens(c, ("and", "see")), {"See x and a Dog AND été": ["dog", "été"], "": []}),
    "pairs": (lambda c: tx.with_bigrams(tx.kept_tokens(c, ("of",))), {"gene of mice": ["gene", "mice", "gene mice"], "one": ["one"], "": []}),
    "missing": (tx.null_missing, {"NA": None, "n/a": None, "": None, "na": "na", "<NA>": None, "x": "x"}),
    "heads": (lambda c: tx.head(c, 4), {"abc�def": "abcd"}),
    "keywords": (tx.has_keyword, {"A GENE here": True, "nothing": False, "eternal": True}),
}


@pytest.mark.parametrize("name", CASES)
def test_by_hand(spark, name):
    expression, cases = CASES[name]
    assert evaluate(spark, list(cases), expression) == list(cases.values())


ALPHABET = st.sampled_from(list("ab1290._-:/ ()[]<>'\",;\n\r\t\x0b\x1c\x1féÜß٣") + ["http://", "HTTPS://", "As an AI language model"])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(ALPHABET, max_size=30).map("".join), min_size=1, max_size=20))
def test_properties_on_random_text(spark, texts):
    links = evaluate(spark, texts, tx.extract_urls)
    for text, found in zip(texts, links, strict=True):
        places = [text.index(url) for url in found]
        assert len(set(found)) == len(found) and all(not set(url) & set(" \t\n'\"<>)]") for url in found)
        assert all(url.lower().startswith("http") and not url.endswith((".", ",", ";", ":")) or url.endswith("//") for url in found) or places
    cleaned = evaluate(spark, texts, tx.clean_answer)
    assert all(t == t.strip() and "  " not in t and "\n" not in t for t in cleaned)
    for found in evaluate(spark, texts, tx.lines):
        assert all(line and line == line.strip() and "\n" not in line for line in found)
    for found in evaluate(spark, texts, tx.word_tokens):
        assert len(set(found)) == len(found) and all(w == w.lower() for w in found)


def test_substrings_find_every_number(spark):
    got = evaluate(spark, ["a1234b 5.67", "no"], lambda c: tx.substrings(tx.digit_runs(c), [1, 3]))
    assert sorted(got[0]) == sorted(["1", "2", "3", "4", "123", "234", "5", ".", "6", "7", "5.6", ".67"]) and got[1] == []
