import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caselens.functions import parsers, stats, text, vectors


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()[0]


OUTPUTS = [
    ("", None, None),
    (None, None, None),
    (r"\boxed{ B } then \boxed{C}", "C", "B"),
    (r"\boxed{b}", None, None),
    ("ANSWER: C or D", "C", "C"),
    ("A 45-year-old ... so D", "D", "D"),
    ("I understand", None, None),
    ("ANSWER: A. ANSWER: B then C", "B", "B"),
    ("Aé B", "B", "B"),
    ("answers range from A through J", None, None),
]


def test_official_and_boxed(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(OUTPUTS)], "i int, t string")
    got = {r.i: (r.o, r.b) for r in df.select("i", parsers.parse_official(F.col("t")).alias("o"), parsers.parse_boxed(F.col("t")).alias("b")).collect()}
    assert got == {i: (o, b) for i, (_, o, b) in enumerate(OUTPUTS)}


@pytest.mark.parametrize(
    ("output", "strict", "lenient"),
    [
        ("ANSWER: (c)", "C", None),
        ("The best answer is D, not E", "D", "D"),
        ("Hence the answer is B", "B", "B"),
        ("(H) is correct. But A?", "H", "H"),
        ("J is the right answer", "J", "J"),
        ("C. tumour of the lung: CORRECT", "C", "C"),
        ("some text\nE", "E", "E"),
        ("F)\nlong text here\nno letter", "F", "F"),
        ("we choose C, not C.", None, "C"),
        ("line one\r\n(B)\r\n", "B", "B"),
        ("", None, None),
        (None, None, None),
    ],
)
def test_strict_and_lenient(spark, output, strict, lenient):
    assert one(spark, parsers.parse_strict(F.col("t")), t=output) == strict
    assert one(spark, parsers.parse_lenient(F.col("t")), t=output) == lenient


def test_wilson_and_mcnemar(spark):
    df = spark.createDataFrame([(0, 0), (447, 2000), (69, 203), (203, 203)], "k long, n long")
    p, lo, hi = stats.wilson(F.col("k"), F.col("n"))
    got = [tuple(round(x, 4) for x in r) for r in df.select(p, lo, hi).collect()]
    assert got == [(0, 0, 0), (0.2235, 0.2058, 0.2423), (0.3399, 0.2783, 0.4075), (1.0, round(1 / (1 + 1.96**2 / 203), 4), 1.0)]
    chi, pv = stats.mcnemar(F.col("b"), F.col("c"))
    rows = spark.createDataFrame([(0, 0), (5, 5), (13, 27), (1000, 10)], "b long, c long").select(chi, pv).collect()
    assert [tuple(round(x, 4) for x in r) for r in rows[:3]] == [(0, 1), (0.1, 0.7518), (4.225, 0.0398)]
    assert 0 <= rows[3][1] < 1e-12


def test_erfc_is_close(spark):
    xs = [i / 50 for i in range(301)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.erfc(F.col("x")).alias("y")).collect()
    assert max(abs(r.y - math.erfc(r.x)) for r in got) < 2e-7


def plain_holm(p):
    order, out, top = sorted(range(len(p)), key=lambda i: p[i]), [0.0] * len(p), 0.0
    for rank, i in enumerate(order):
        top = max(top, min(1.0, p[i] * (len(p) - rank)))
        out[i] = top
    return out


def test_holm(spark):
    rng = random.Random(1)
    rows = [(f, i, rng.random() ** 3) for f in range(6) for i in range(rng.randint(1, 9))]
    got = stats.with_holm(spark.createDataFrame(rows, "f int, i int, p double"), "p", ["i"], ["f"]).collect()
    for f in range(6):
        mine = sorted((r.i, r.p_holm) for r in got if r.f == f)
        assert [x for _, x in mine] == pytest.approx(plain_holm([p for g, _, p in rows if g == f]))


def plain_normalise(s):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", (s or "").lower())).strip()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aB é_-,.\n\t 中9'", max_size=24), min_size=1, max_size=30))
def test_normalise_like_python(spark, texts):
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.normalise(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: plain_normalise(t) for i, t in enumerate(texts)}


def test_token_set_ratio(spark):
    r = text.token_set_ratio(text.concept_tokens(F.col("a")), text.concept_tokens(F.col("b")))
    assert one(spark, r, a="renal cell cancer", b="cancer") == 100
    assert one(spark, r, a="", b="x") == 0
    assert one(spark, r, a="of", b="cancer") == 0
    assert one(spark, r, a="one two three", b="two three four five") == 66
    assert one(spark, text.is_substring(F.col("a"), F.col("b")), a="Renal-Cell", b="a renal cell tumour") is True
    assert one(spark, text.is_substring(F.col("a"), F.col("b")), a="", b="x") is False


def test_vectors_and_hashes(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [4.0, 3.0, 2.0, 1.0])], "a array<double>, b array<double>")
    r = df.select(vectors.dot(F.col("a"), F.col("b")), vectors.average_hash(F.col("a")), vectors.difference_hash(F.col("b"), 2), vectors.is_finite(F.col("a"))).first()
    assert list(r) == [20.0, "0011", "11", True]
    bits = "01" * 31 + "11"
    r = spark.createDataFrame([(bits, "0" * 64)], "a string, b string").select(vectors.bits_to_long(F.col("a")).alias("x"), vectors.hamming(vectors.bits_to_long(F.col("a")), vectors.bits_to_long(F.col("b"))).alias("h")).first()
    assert r.x == sum(1 << i for i, b in enumerate(bits) if b == "1") - (1 << 64) and r.h == 33
    m = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[0.5, 0.2], [0.1, 0.9]])], "q array<array<double>>, d array<array<double>>")
    assert m.select(vectors.max_sim(F.col("q"), F.col("d"))).first()[0] == pytest.approx(1.4)
    nan = spark.createDataFrame([([1.0, float("nan")],), ([1.0, float("-inf")],)], "a array<double>")
    assert [x[0] for x in nan.select(vectors.is_finite(F.col("a"))).collect()] == [False, False]
