import random

from caselens.llm.leaks import find_leaks

RNG = random.Random(4)
WORDS = [f"{a}{b}{c}" for a in ("bar", "lo", "mi", "ta", "ren", "vos", "kel", "du", "fin", "gra", "ste", "pol") for b in ("dan", "nor", "tix", "pel", "ram", "sun", "gor", "vit", "zen", "hul") for c in ("", "a", "is", "um")]
FILL = "the patient was seen again and nothing more was found on that day in the ward".split()


def sentence(n):
    return " ".join([RNG.choice(WORDS).capitalize(), *[RNG.choice(WORDS + FILL[:4]) for _ in range(n - 1)]]) + "."


ITEMS = [(i, " ".join(sentence(12) for _ in range(5)) + f" Value {i}{i}.{i}5 was 3{i} mg/dL. What is the most likely diagnosis in this patient?") for i in range(1, 13)]


def around(text):
    return " ".join(RNG.choice(FILL) for _ in range(60)) + ". " + text + " " + " ".join(RNG.choice(FILL) for _ in range(40))


def words(i):
    return ITEMS[i - 1][1].split()


def test_leaks(spark):
    w = words(1)
    fullwidth = str.maketrans("0123456789abc", "０１２３４５６７８９ａｂｃ")
    changed = [x if k % 9 else "other" for k, x in enumerate(words(2)[:45], 1)]
    sentences = [s + "." for s in ITEMS[2][1].split(". ")[:5]]
    docs = {
        10: (around(" ".join(w[:60])), 1), 11: (around(" ".join(w[5:25])).upper(), 1), 12: (around(" ".join(changed)), 2), 13: (around(" ".join(reversed(sentences))), 3),
        14: (around(" ".join(words(4)[3:40]).translate(fullwidth)), 4), 15: (around("​".join(" ".join(words(5)[:40]))), 5), 16: (around(" ".join(words(6)[:15]) + "\n\nPage 3 of 9\n\n" + " ".join(words(6)[15:30])), 6),
        17: (around("&nbsp;".join(words(7)[:30])), 7), 18: (around(" ".join(words(8)[:30]).replace("a", "а").replace("e", "е")), 8),
        30: (around(" ".join(w[:9])), None), 31: (around("What is the most likely diagnosis in this patient?"), None), 32: (around(""), None), 33: (None, None), 34: ("", None), 35: (around(" ".join(RNG.sample(WORDS, 60))), None),
        36: ("word " * 200_000 + " ".join(words(9)[:40]) + " word" * 100_000, 9),
    }
    df = spark.createDataFrame([(d, t, 5) for d, (t, _) in docs.items()] + [(10, docs[10][0], 5)], "doc_id long, text string, item_id int")
    held = spark.createDataFrame([(i, t, None) for i, t in ITEMS] + [(90, None, "x"), (91, "  ", "x")], "item_id long, item_text string, doc_id string")
    rows = find_leaks(df, held).collect()
    got = sorted((r.doc_id, r.item_id) for r in rows)
    phrase = {r.doc_id: r.longest_phrase for r in rows}
    assert (phrase[10], phrase[11], phrase[12], phrase[16]) == (60, 20, 8, 15)
    want = sorted([(d, i) for d, (_, i) in docs.items() if i] + [(10, 1)])
    assert (set(got) - set(want), set(want) - set(got), len(got)) == (set(), set(), len(want))
    assert find_leaks(df.limit(0), held).count() == 0 and find_leaks(df, held.limit(0)).count() == 0


def test_items_that_say_the_same(spark):
    part = [w if k % 9 else "other" for k, w in enumerate(words(2)[:40], 1)]
    df = spark.createDataFrame([(1, around(" ".join(part)))], "doc_id long, text string")
    held = spark.createDataFrame([*ITEMS, (40, ITEMS[1][1]), (41, ITEMS[1][1].upper())], "item_id long, item_text string")
    assert sorted(r.item_id for r in find_leaks(df, held).collect()) == [2, 40, 41]


def test_one_item(spark):
    df = spark.createDataFrame([(1, around(ITEMS[0][1])), (2, around(""))], "doc_id long, text string")
    held = spark.createDataFrame(ITEMS[:1], "item_id long, item_text string")
    assert [(r.item_id, r.doc_id) for r in find_leaks(df, held).collect()] == [(1, 1)]
