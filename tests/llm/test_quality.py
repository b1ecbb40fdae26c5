import numpy as np

from caselens.llm import quality as Q
from caselens.llm.holdout import ANCHORS, CALIBRATION, HOLDOUT, MEASURED


def test_statistics():
    s = dict(zip(Q.STATS, Q.text_stats("The patient was seen.\n- 12 mg\nand more")))
    assert (s["n_words"], s["n_lines"], s["n_chars"], s["bullet_lines"]) == (9, 3, 38, 1 / 3)
    assert s["end_punct_lines"] == 1 / 3 and s["common_share"] == 4 / 9 and s["number_word_share"] == 1 / 9
    for text in (None, "", " \n\t"):
        assert sum(Q.text_stats(text)[1:]) == 0
    assert all(np.isfinite(Q.text_stats("x" * 100_000))) and all(np.isfinite(Q.text_stats("\x00� ́")))


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((1500, 5))
    y = ((x[:, 1] > 0.6) ^ (x[:, 3] < 0.3)).astype(float)
    model = Q.fit_trees(x[:1000], y[:1000])
    assert ((model.margin(x[1000:]) > 0) == y[1000:]).mean() > 0.95


def test_holdout_and_tables(spark):
    prose = ["The patient was seen again and was well, with no sign of the disease that had been found before.", "He was sent home on the third day and has been well since then, as far as we know."]
    junk = ["a. zinc.\nb. copper.\nc. renal cyst.\nd. urea.\ne. fever.", "0f3a 9b2c 77de 01aa 5c3f 9b2c 77de 01aa", "item\tvalue\nzinc\t1.2\ncopper\t3.4\nurea\t5.6"]
    rows = [(i, t, "z") for i, t in enumerate((prose + junk) * 40)] + [(900, None, "z"), (901, "", "z"), (902, " ", "z"), (None, prose[0], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, p_junk string")
    model = Q.train_quality(df)
    got = {r.doc_id: r.p_junk for r in Q.quality_stats(df, model=model).collect()}
    assert all((got[i] >= 0.5) == (i % 5 >= 2) for i in range(200)) and got[None] < 0.5 and got[900] is None and got[901] is None and got[902] is None
    assert not {t for _, t in CALIBRATION} & {t for _, t in ANCHORS + MEASURED} and not {t for _, t in ANCHORS} & {t for _, t in MEASURED} and len(HOLDOUT) == 48
    # texts of the corpus that are hand-checked, and copies without number, change nothing
    known = spark.createDataFrame([(2000 + i, t, "z") for i, (_, t) in enumerate(CALIBRATION + MEASURED)] + [(3000, prose[0], "z")] * 50, df.schema)
    again = Q.train_quality(df.unionByName(known).where("doc_id <> 3000 or doc_id is null"))
    assert np.array_equal(again.leaf, model.leaf)
    assert Q.quality_stats(df.limit(0), model=model).count() == 0
    only_prose = Q.train_quality(df.where("doc_id % 5 < 2"))
    assert Q.quality_stats(df, model=only_prose).where("p_junk >= 0.5").count() == 120
