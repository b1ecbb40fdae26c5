import random

from caselens.llm.leaks import find_leaks

RNG = random.Random(8)
LISTS = [[f"{a}{b}{k}" for a in ("bar", "lom", "mit", "tav", "ren", "vos") for b in ("dan", "nor", "tix", "pel", "ram")] for k in ("a", "e", "i", "o", "u", "y")]
FRAME = "The {} clinic admits a {} from {} whose {} began at home after some {} was stored close to the {} under the stairs."
OTHER = [f"zu{a}{b}" for a in "bcdfg" for b in "klmnp"]


def make():
    return FRAME.format(*map(RNG.choice, LISTS))


ITEMS = [(i, f"{make()} {make()} Which of these is due?") for i in range(1, 121)]


def test_single_words_changed(spark):
    docs, want = [], set()
    for size in (18, 20, 22, 25):
        for n in (1, 2, 3):
            for _ in range(5):
                i, text = RNG.choice(ITEMS)
                part = text.split()[: 2 * len(FRAME.split())]
                start = RNG.randrange(len(FRAME.split()) - size + 1) if size < len(FRAME.split()) else 0
                part = part[start : start + size]
                for k in RNG.sample(range(1, size - 1), n):
                    part[k] = RNG.choice(OTHER)
                docs.append((len(docs), "it was seen then. " + " ".join(part) + " and nothing more."))
                want.add((i, len(docs) - 1))
    altered = len(docs)
    docs += [(altered + k, "it was seen then. " + make() + " and nothing more.") for k in range(60)]
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, item_text string"))
    got = {(r.item_id, r.doc_id) for r in found.collect()}
    # a stretch that keeps too few of its own words can't be told
    assert len(got & want) >= 0.75 * len(want), (len(got & want), len(want))
    # other questions of the same make
    assert not {x for x in got if x[1] >= altered}


#: Twenty makes of sentences, of which an item has five, and the words that may stand at each of a make's seven places.
FILLERS = [[RNG.choice(LISTS) for _ in range(7)] for _ in range(20)]
MAKES = [" ".join("{}" if k in (2, 3, 6, 7, 12, 13, 16) else f"{RNG.choice('bcdfgklm')}{RNG.choice(['ane', 'ote', 'ill', 'ush', 'erk'])}{k}{m % 7}" for k in range(19)) + "." for m in range(20)]


def question():
    return " ".join(MAKES[m].format(*map(RNG.choice, FILLERS[m])) for m in RNG.sample(range(20), 5))


QUESTIONS = [(i, question()) for i in range(1, 201)]


def test_each_class_of_changes(spark):
    """Runs with every 9th or 6th word changed, of which at least 18 are left, among sister questions that are no leaks."""
    docs, want = [(k, "it was seen then. " + question() + " and nothing more.") for k in range(150)], {}
    classes = [(20, 9), (25, 9), (30, 9), (40, 9), (25, 6), (30, 6), (40, 6), (18, 0), (24, 0)]
    for size, every in classes:
        for _ in range(50):
            i, text = RNG.choice(QUESTIONS)
            words = text.split()
            start = RNG.randrange(len(words) - size + 1)
            part = words[start : start + size]
            if every:
                first = RNG.choice([f for f in range(every) if size - len(range(f, size, every)) >= 18])
                part = [RNG.choice(OTHER) if k % every == first else w for k, w in enumerate(part)]
            want[i, len(docs)] = (size, every)
            docs.append((len(docs), "it was seen then. " + " ".join(part) + " and nothing more."))
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(QUESTIONS, "item_id long, item_text string"))
    got = {(r.item_id, r.doc_id) for r in found.collect()}
    for c in classes:
        share = sum(x in got for x, y in want.items() if y == c) / 50
        assert share >= (0.9 if c[1] else 1.0), (c, share)
    assert len(got - set(want)) <= 0.01 * len(want), got - set(want)
