import base64
import os
import random

import pytest

from caselens.llm import tokenizer as T
from caselens.llm.registry import VOCABULARY as PATH

pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


def plain_merge(piece, ranks):
    parts = [bytes([b]) for b in piece]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_segment_tree_against_brute_force():
    ranks = T.load_ranks(PATH)
    rng = random.Random(0)
    for n in [0, 1, 2, 3, 7, 8, 9, 31, 64, 65, 300]:
        for alphabet in (b"ab", b"the rain", bytes(range(256))):
            piece = bytes(rng.choice(alphabet) for _ in range(n))
            assert T.merge_piece(piece, ranks) == plain_merge(piece, ranks)


def test_texts_against_the_public_library():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng, own = random.Random(1), T._Stretches(T.load_ranks(PATH))
    texts = ["<|endoftext|>", "a  b", " ", "\n\n x", "it's 'S don't", "x" * 3000, "½²Ⅷ٣ 中文 𝒳𝓎", "a\x1cb \x85c　d "]
    texts += ["".join(rng.choice("ab \n\t é1½​\x1c\U0001d7d8中'.s") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    assert T.encode_texts(texts, own).to_pylist() == [lib.encode_ordinary(t) for t in texts]
    assert T.encode_texts(texts, own).to_pylist() == [lib.encode_ordinary(t) for t in texts]


def test_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " ", "x"), (4, "hello world", "x"), (4, "hello world", "x"), (None, "a", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in T.encode_documents(df, PATH).collect()), key=str)
    assert got == sorted([(1, []), (2, []), (3, [220]), (4, [31373, 995]), (4, [31373, 995]), (None, [64])], key=str)
    assert T.encode_documents(df.limit(0), PATH).count() == 0


def test_a_memory_that_overflows_changes_nothing(monkeypatch):
    ranks = T.load_ranks(PATH)
    texts = [f"word{i} and {i * 7}" for i in range(200)]
    want = T.encode_texts(texts, T._Stretches(ranks)).to_pylist()
    monkeypatch.setattr(T, "CACHE_PIECES", 5)
    assert T.encode_texts(texts, T._Stretches(ranks)).to_pylist() == want
