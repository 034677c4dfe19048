"""Fingerprints and the walk over descending ids against brute force."""

import hashlib
import random

import pytest

from oligoweave.llm import fingerprints as fp


def brute(rows):
    """rows: (id, text) without null ids."""
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    out = []
    for i, (doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        changed = fp.edit(text, after).encode()
        own, edited = fp.digest(text.encode()), fp.digest(changed)
        out.append((doc, len(text), hashlib.sha256(changed).hexdigest(), own, edited, fp.likeness(own, edited), fp.likeness(own, fp.digest(after.encode()))))
    return sorted(out)


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_neighbours(spark, n):
    rng = random.Random(n)
    ids = rng.sample(range(-(10**12), 10**12), n - n // 3) + [5] * (n // 3)
    rows = [(i, "".join(rng.choice("abé漢 \n") for _ in range(rng.randrange(40))) if rng.random() < 0.9 else None) for i in ids]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, range string").repartition(3)
    got = sorted(tuple(r) for r in fp.edited_neighbours(df).collect())
    assert got == brute([(i, t or "") for i, t in rows])


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, None), (1, "one two"), (1, "one two")], "doc_id long, text string")
    got = fp.edited_neighbours(df).collect()
    assert len(got) == 4
    assert sum(r.near_next is None for r in got) == 2
    assert [r.near_next for r in got if r.doc_id == 1] == [1.0, 1.0]
    assert fp.edited_neighbours(df.where("doc_id is null")).count() == 2
    assert fp.edited_neighbours(df.limit(0)).count() == 0
    assert fp.fingerprints(df).count() == 4


def test_likeness_follows_the_edit():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(400))
    other = " ".join(rng.choice(words) for _ in range(400))
    own = fp.digest(text.encode())
    small = fp.likeness(own, fp.digest(text.replace("a", "b", 3).encode()))
    half = fp.likeness(own, fp.digest(fp.edit(text, other).encode()))
    none = fp.likeness(own, fp.digest(other.encode()))
    assert 1 > small > half > none >= 0
    assert fp.digest(b"") != fp.digest(b"abcdef" * 50)
    assert len(fp.digest(b"")) == len(own)
    assert fp.likeness(own, own) == 1


def test_compare(spark):
    a, b = fp.digest(b"one two three"), fp.digest(b"one two four")
    got = fp.compare(spark.createDataFrame([(a, b), (a, None)], "a string, b string"), "a", "b").collect()
    assert [r.likeness for r in got] == [fp.likeness(a, b), None]
