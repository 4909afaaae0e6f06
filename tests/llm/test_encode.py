import random

import pytest

from quire.llm import encode as E

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(E.default_path())
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_like_the_public_library(exact):
    bpe = E.vocabulary(E.default_path())
    rng = random.Random(2)
    texts = ["", " ", "\n\n  x", "a" * 3000, " " * 700, "<|endoftext|> a", "Žltý kôň, 12,5 kg — «ёж»", "日本語 テスト", "it's we'll I'd", "\x00\x01", "😀👨‍👩‍👧"]
    texts += ["".join(rng.choice("abcdeth in") for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    texts += ["".join(rng.choice("абвоен éř́") for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    for t in texts:
        assert bpe.encode(t) == exact(t)


def test_rows(spark, exact):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "hello world", "x"), (4, "hello world", "x"), (5, "ab " * 40_000, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in E.encode(d).collect())
    assert got == [(1, exact("hello world")), (2, []), (3, []), (4, exact("hello world")), (4, exact("hello world")), (5, exact("ab " * 40_000))]
    assert E.encode(d.limit(0)).count() == 0
    n = {r["doc_id"]: r["n_tokens"] for r in E.token_counts(d).collect()}
    assert n == {k: len(v) for k, v in got}
