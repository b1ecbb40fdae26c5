import random

import pytest

from caselens.llm import splitting as S


def check(text, most, overlap):
    spans = S.split_text(text, most, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for a, b in spans:
        assert b - a <= most and (b > a or not text)
    for (_, b), (c, _) in zip(spans, spans[1:]):
        assert b - c == overlap
    joined = text[: spans[0][1]] + "".join(text[b0:b1] for (_, b0), (_, b1) in zip(spans, spans[1:]))
    assert joined == text
    return spans


def test_round_trip_of_any_text():
    rng = random.Random(0)
    for _ in range(400):
        text = "".join(rng.choice(["word ", "Sentence end. ", "\n\n", "\r\n", "x" * rng.randint(1, 90), "é́", " ", ", "]) for _ in range(rng.randint(0, 60)))
        most = rng.randint(5, 80)
        check(text, most, rng.randint(0, most - 1))


def test_natural_boundaries():
    text = " ".join(["A plain sentence of some words."] * 200)
    for a, b in check(text, 300, 40)[:-1]:
        assert text[b - 2 : b] == ". "
    paragraphs = "\n\n".join(["One line of text here, and more of it."] * 60)
    assert all(paragraphs[b - 2 : b] == "\n\n" for _, b in check(paragraphs, 200, 0)[:-1])
    words = "word " * 500
    assert all(words[b - 1] == " " for _, b in check(words, 101, 10)[:-1])


def test_least_number_of_balanced_pieces():
    spans = check("word " * 400, 1000, 0)
    assert len(spans) == 2 and abs((spans[0][1] - spans[0][0]) - 1000) <= 10


def test_unbroken_runs():
    text = "short words " * 30 + "x" * 900 + " tail words" * 30
    spans = check(text, 200, 20)
    assert all(text[b - 1] == " " or "x" in text[b - 1 : b + 1] for _, b in spans[:-1])
    assert S.longest_run(text) == 900 and S.longest_run("") == 0 and S.longest_run(" \t\r\n") == 0


def least_by_search(text, most, overlap):
    """Pieces of a shortest way from cut to cut, none inside a run where a boundary is in reach."""
    n, stride = len(text), most - overlap
    ends = {x for level in S._Places(text).by_strength for x in level if overlap < x < n}
    reached, pieces = {overlap}, 1
    while not any(n - at <= stride for at in reached):
        after = set()
        for at in reached:
            span = range(at + 1, min(at + stride, n - 1) + 1)
            after |= ({x for x in span if x in ends} or set(span))
        reached, pieces = after, pieces + 1
    return pieces


def test_least_pieces_and_no_needless_cut_against_search():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "Some end. ", "\n\n", "x" * rng.randint(1, 60), " ", ", "]) for _ in range(rng.randint(1, 40)))
        most = rng.randint(6, 60)
        overlap = rng.randint(0, most - 2)
        spans = check(text, most, overlap)
        assert len(spans) == (least_by_search(text, most, overlap) if len(text) > most else 1)
        ends = {x for level in S._Places(text).by_strength for x in level}
        for (_, at), (_, b) in zip([(0, overlap), *spans], spans[:-1]):
            assert b in ends or not any(x in ends for x in range(at + 1, min(at + most - overlap, len(text) - 1) + 1))


def test_a_limit_that_most_words_nearly_fill():
    rng = random.Random(6)
    for _ in range(200):
        check(" ".join("x" * rng.randint(60, 99) for _ in range(rng.randint(2, 60))), 100, 10)
    check(" ".join("x" * rng.randint(60, 99) for _ in range(20_000)), 100, 10)


def test_no_cut_before_a_mark_or_within_crlf():
    text = "é" * 100
    assert all(text[b : b + 1] != "́" for _, b in check(text, 33, 0)[:-1])


def test_tables(spark):
    rows = [("a", 0, "w " * 40, "z"), ("a", 0, "w " * 40, "z"), ("b", None, None, "z"), ("c", 1, "", "z"), (None, 2, "x" * 30, "z"), ("d", 0, "x" * 10, "z")]
    df = spark.createDataFrame(rows, "k string, n_chars int, text string, piece_no string")
    got = S.split_oversized(df, ["k", "n_chars"], "text", 20, 5).collect()
    assert len(got[0]) == 9 and sum(r.k == "d" for r in got) == 1 and not any(r.k == "b" for r in got)
    assert {(r.k, r.kind) for r in S.oversized_items(S.split_oversized(df, ["k"], "text", 20, 5, with_text=False), ["k"], 20).collect()} == {("a", "oversized"), (None, "oversized"), (None, "unbroken")}
    assert S.split_oversized(df.limit(0), ["k"], "text", 20, 5).count() == 0
    with pytest.raises(ValueError):
        S.split_oversized(df, ["k"], "text", 20, 20)
