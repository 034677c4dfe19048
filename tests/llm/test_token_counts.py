"""Token counts against the library on whole texts, also where windows are hard to splice."""

import random

import pytest

from oligoweave.llm import token_counts as T

tokenizer = T.load_tokenizer()
SMALL = dict(window=120, overlap=60)


def whole(text):
    return len(tokenizer.encode(text or "", add_special_tokens=False))


def check(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = T.token_counts(df, **sizes).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    want = [(i, len((t or "").encode()), whole(t), whole(t) > T.LIMIT) for i, t in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def mixed(rng, n):
    parts = ["word", " ", "  ", "\n", " \n ", "it's", "'re", "<|endoftext|>", "<|endo", "ftext|>", "日本語", "é", "1234", "...", "　", "x" * 40, "🎉", "\t", "don't we'll"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_mixed_texts(spark):
    rng = random.Random(5)
    check(spark, [(i, mixed(rng, rng.choice([1, 30, 60, 200, 900]))) for i in range(120)], **SMALL)


def test_windows_widen_where_no_place_is_common(spark):
    """Pre-tokens, and runs of spaces, that are far longer than overlaps and windows."""
    rows = [
        (0, "a" * 1000), (1, "b " * 50 + "x" * 700 + " c" * 300), (2, " " * 900), (3, " " * 500 + "y" + "\n" * 500),
        (4, "<|endoftext|>" * 100), (5, "日" * 500 + "。" * 400), (6, "7" * 333 + "q w " * 200 + "z" * 555), (7, "'" * 800),
    ]
    check(spark, rows, **SMALL)


def test_every_start_of_a_window(spark):
    """A special token, a contraction and spaces at each place around a cut."""
    rows = [(i, "ab " * 20 + "c" * i + x + " tail of it" * 30) for i, x in enumerate(["<|endoftext|>", "   <|endoftext|>  ", "we'll"] * 30)]
    check(spark, rows, **SMALL)


def test_long_text_at_the_sizes_of_the_query(spark):
    rng = random.Random(9)
    check(spark, [(1, mixed(rng, 60_000)), (2, "k" * 70_000), (3, "short one")])


def test_nulls_repeats_and_other_columns(spark):
    rows = [(None, "a b"), (None, None), (1, ""), (1, ""), (2, "x " * 400), (2, "x " * 400)]
    check(spark, rows, **SMALL)
    df = spark.createDataFrame([(1, "a b c", 5, "r")], "doc_id long, text string, n_tokens int, row_id string")
    assert [tuple(r) for r in T.token_counts(df).collect()] == [(1, 5, 3, False)]


def test_empty_table(spark):
    got = T.token_counts(spark.createDataFrame([], "doc_id long, text string"))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.collect() == []


def test_limit_is_exclusive(spark):
    df = spark.createDataFrame([(1, " a" * 512), (2, " a" * 513)], "doc_id long, text string")
    assert {r.doc_id: r.over_limit for r in T.token_counts(df).collect()} == {1: False, 2: True}


def test_overlap_beyond_the_margin_is_required(spark):
    with pytest.raises(ValueError, match="overlap"):
        T.token_counts(spark.createDataFrame([], "doc_id long, text string"), overlap=T.MARGIN)


def test_splice_counts_each_token_once():
    text = "some words and more of them, " * 40
    parts = list(T.cut_windows(text, 300, 100))
    assert parts[0][300:] == parts[1][:100] and parts[-1] == text[(len(parts) - 1) * 300 :]
