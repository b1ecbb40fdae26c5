import random

import numpy as np
import pyarrow as pa

from caselens.llm import leaks, postings

RNG = random.Random(2)
WORDS = [a + b for a in ("bar", "lom", "mit", "tav", "ren") for b in ("dan", "nor", "tix", "7")] + ["the", "of"]


def lists(spark, rows, terms):
    df = spark.createDataFrame(rows, "d long, t string, term string, places int")
    table = postings.build_index(df, "d", "t").toArrow()
    number = {t: i for i, t in enumerate([*terms, postings.NUMBERS])}
    kept = pa.compute.is_in(table.column("term"), value_set=pa.array([postings.DOCUMENTS, *number]))
    out = {}
    for seg in postings.segments(iter(table.filter(kept).to_batches(max_chunksize=3)), number):
        docs = seg.docs.to_pylist()
        for t, i in number.items():
            for g in seg.place[seg.first[i] : seg.first[i] + seg.size[i]].tolist():
                d = int(np.searchsorted(seg.starts, g, "right")) - 1
                out.setdefault((docs[d], t), []).append(g - int(seg.starts[d]))
    return out, table


def test_numbers_packed_and_unpacked():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2_097_151, 2_097_152, 2**31 - 1])
    data, size = postings.packed(values)
    assert postings.unpacked(data).tolist() == values.tolist() and size.tolist() == [1, 1, 1, 2, 2, 3, 3, 4, 5]
    assert not len(postings.unpacked(postings.packed(values[:0])[0]))


def test_every_place_of_every_term(spark, monkeypatch):
    monkeypatch.setattr(postings, "SEGMENT_DOCS", 7)
    monkeypatch.setattr(postings, "SEGMENT_CHARS", 900)
    rows = [(i, " ".join(RNG.choice(WORDS) for _ in range(RNG.choice([0, 1, 30, 200]))), "x", 1) for i in range(60)] + [(60, None, "x", 1), (61, "", "x", 1), (62, " \n", "x", 1), (0, "bar7 the", "x", 1)]
    got, table = lists(spark, rows, WORDS)
    want = {}
    for d, t, _, _ in rows:
        for p, w in enumerate((t or "").split()):
            want.setdefault((d, w), []).append(p)
            if "7" in w:
                want.setdefault((d, postings.NUMBERS), []).append(p)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(n for t, n in zip(table.column("term").to_pylist(), table.column("n").to_pylist()) if t == postings.DOCUMENTS) == len(rows) - 1
    assert postings.build_index(spark.createDataFrame([], "d long, t string"), "d", "t").count() == 0


def test_one_index_serves_two_searches(spark):
    texts = [" ".join(RNG.sample([f"{a}{b}{k}" for a in ("bar", "lom", "mit", "tav") for b in ("dan", "nor", "tix") for k in "aeiou"], 40)) for _ in range(6)]
    docs = spark.createDataFrame([(i, "it was so " + t) for i, t in enumerate(texts)], "doc_id long, text string")
    index = postings.build_index(docs, "doc_id", "text").cache()
    for half in (texts[:3], texts[3:]):
        held = spark.createDataFrame(list(enumerate(half)), "item_id long, item_text string")
        got = {(r.item_id, r.doc_id) for r in leaks.find_leaks(docs, held, index=index).collect()}
        assert got == {(i, texts.index(t)) for i, t in enumerate(half)}
