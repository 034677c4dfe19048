"""Runs of words against a brute force over all periods."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from oligoweave.llm import queries
from oligoweave.llm import word_runs as W

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        start = None
        for i, x in enumerate(same):
            if x and start is None:
                start = i
            elif not x and start is not None:
                if i - start >= q and i - start + q >= least:
                    out.add((start, i + q - start, q))
                start = None
    # the smallest period only
    shortest = {}
    for s, length, q in out:
        shortest[s, length] = min(q, shortest.get((s, length), q))
    primitive = [(s, length, q) for s, length, q in out if shortest[s, length] == q]
    return sorted(primitive, key=lambda r: (r[0], r[2]))


def texts(rng):
    for size in (0, 1, 2, 3, 12, 40, 90):
        for letters in (1, 2, 3, 12):
            yield [rng.choice("abcdefghijkl"[:letters]) for _ in range(size)]
    for _ in range(60):
        words = [rng.choice("abcdefgh") for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(1, 4)):
            unit = [rng.choice("abcd") for _ in range(rng.randrange(1, 9))]
            words += unit * rng.randrange(2, 6) + unit[: rng.randrange(len(unit))] + [rng.choice("abxyz") for _ in range(rng.randrange(3))]
        yield words
    a, b = ["a"], ["b"]
    for _ in range(9):  # the words of Fibonacci hold many runs
        a, b = b, b + a
    yield b
    yield ["a"] * 200
    yield (["a", "b"] * 9 + ["c"]) * 7


def test_runs_equal_brute_force():
    rng = random.Random(3)
    all_texts = list(texts(rng))
    for least in (2, 5, 12):
        together = W.word_runs(all_texts, least)
        for words, found in zip(all_texts, together, strict=True):
            assert found == brute(words, least), (least, words)
            assert W.word_runs([words], least)[0] == found


def test_suffix_array_and_lcp():
    rng = random.Random(4)
    for n in (0, 1, 5, 60):
        symbols = [rng.randrange(3) for _ in range(n)] + [9]
        sa, isa, lcp = W.suffix_array(np.array(symbols))
        want = sorted(range(n + 1), key=lambda i: symbols[i:])
        assert sa.tolist() == want and all(sa[isa[i]] == i for i in range(n + 1))
        for k in range(1, n + 1):
            x, y = symbols[want[k - 1] :], symbols[want[k] :]
            assert lcp[k] == next(m for m in range(n + 2) if x[: m + 1] != y[: m + 1])


def test_covered_words_lie_in_repeated_stretches():
    rng = random.Random(6)
    for core in (1, 3, 6):
        symbols = [rng.randrange(4) for _ in range(120)]
        grams = [tuple(symbols[i : i + core]) for i in range(121 - core)]
        want = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(core)}
        assert set(np.flatnonzero(W.covered(np.array(symbols), core)).tolist()) == want


def test_every_interval_but_its_largest_child():
    """Walked places of an LCP interval are all of it but one largest child."""
    symbols = np.array([0, 1, 0, 1, 0, 0, 1, 0, 1, 0, 0, 1, 7])
    _, _, lcp = W.suffix_array(symbols)
    walked = {}
    for columns in W.small_children(lcp):
        for a, b, low, high, d in zip(*(x.tolist() for x in columns), strict=True):
            walked.setdefault((low, high, d), []).append((a, b))
    for (low, high, d), children in walked.items():
        assert min(lcp[low + 1 : high + 1]) == d
        left = high - low + 1 - sum(b - a for a, b in children)
        assert left >= max(b - a for a, b in children)


def expected(doc_id, text):
    words = SPLIT.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *top, None if not runs else 1000 * top[1] // top[2],
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    signs = [" ", "  ", "\n", "\t", "\x0b", "\r\n"]
    rows = [(i, "".join(w + rng.choice(signs) for w in words)) for i, words in enumerate(texts(rng))]
    rows += [(100, None), (None, "a " * 30), (None, None), (101, ""), (102, "é\xa0b \x1c c " * 9), (0, "a b " * 20), (0, "a b " * 20)]
    rows += [(i, "one two three four five six seven eight nine ten " * 3) for i in range(200, 260)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, words string, n int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    key = lambda r: (r[0] is not None, r[0] or 0, r[-1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert W.run_digests(W.find_runs(W.with_planted_runs(none))).collect() == []


def test_long_texts_take_about_linear_time():
    rng = random.Random(1)
    unit = [rng.randrange(50) for _ in range(700)]
    for words in (["a"] * 200_000, unit * 300, [rng.randrange(3) for _ in range(200_000)]):
        start = time.time()
        W.word_runs([words])
        assert time.time() - start < 20


def test_least_is_two():
    with pytest.raises(ValueError, match="two words"):
        W.find_runs(None, least=1)
