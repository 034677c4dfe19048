"""Shingles, prefix trees and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from oligoweave.llm import ngram_join
from oligoweave.llm.graph import components
from oligoweave.llm.shingles import Shingler, sets_of


def brute_set(text, k=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k=5):
    sets = [brute_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return sorted(((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def make(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Wé", "漢"]
    lines = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.55:
            own = (rng.choice(texts) or "").split(" ")
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(3)
            texts.append(" ".join(own))
        elif kind < 0.7:
            texts.append("\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 6))))
        elif kind < 0.75:
            texts.append(rng.choice([None, "", " \t\n", "one", "One", "a b c d", "A b c d", "a b c d e"]))
        else:
            texts.append(rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randrange(1, 90))))
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, texts, strict=True))


def test_shingles_equal_brute_force():
    texts = [t or "" for _, t in make(1, 150)] + ["", "x" * 5000, "a " * 3000]
    array = pa.array(["skipped", *texts])[1:]
    values, sizes, keys = sets_of(array, Shingler())
    assert sizes.tolist() == [len(brute_set(t)) for t in texts]
    named, at = {}, 0
    for text, n in zip(texts, sizes, strict=True):
        named.setdefault(brute_set(text), set()).add(frozenset(values[at : at + n].tolist()))
        at += n
    assert all(len(v) == 1 for v in named.values()) and len({next(iter(v)) for v in named.values()}) == len(named)
    assert len({tuple(k) for k in keys}) == len(named)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("apart", [False, True])
def test_trie_connects_what_all_pairs_connect(seed, apart):
    rng = random.Random(seed)
    for _ in range(300):
        pool = range(rng.choice([6, 12, 30]))
        sets = []
        for i in range(rng.randrange(2, 12)):
            s = sorted(rng.sample(pool, rng.randrange(1, len(pool))))
            sets.append((len(s) + rng.randrange(2), np.array(s), rng.choice([i, 100]), rng.randrange(2)))
        pairs = {
            (i, j) for i, (n, a, _, p) in enumerate(sets) for j, (m, b, _, q) in enumerate(sets)
            if i < j and 7 * len(set(a) & set(b)) >= 3 * (n + m) and not (apart and p == q)
        }
        found = ngram_join.trie_links(sets, apart)
        assert {tuple(sorted(x)) for x in found} <= pairs

        def groups(links):
            parent = {s[2]: s[2] for s in sets}

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for i, j in links:
                parent[root(sets[i][2])] = root(sets[j][2])
            return {frozenset(x for x in parent if root(x) == r) for r in map(root, parent)}

        assert groups(found) == groups(pairs)


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "SIDE", 3)
    rows = make(seed, 160)
    rows += [(None, rows[3][1]), (None, "only this null id has this text"), rows[5], (rows[6][0], "another text of an id that is there already")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, set_id int").repartition(4)
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_large_pieces_are_taken_by_shingle(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SIDE", 2)
    monkeypatch.setattr(ngram_join, "PARTS", 1)
    rows = make(7, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in ngram_join.near_duplicates(df).collect()), key=str) == brute(rows)


def test_components_on_one_shingle_do_not_meet_in_pairs(spark, monkeypatch):
    """400 sets with 95 shingles in common are not similar, 40 with 110 and up to 12 of their own are."""
    made, write = [], ngram_join.cut_lineage

    def counted(df):
        out = write(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "cut_lineage", counted)
    sets = [(1000 + i, 120, list(range(95))) for i in range(400)] + [(i, 110 + i % 13, list(range(110))) for i in range(40)]
    prefixes = [(0, i, n, i, 7 * (len(tokens) + 1) > 6 * n) for i, n, tokens in sets]
    groups = ngram_join._meeting(spark.createDataFrame(prefixes, "token long, set_id long, n long, component long, small boolean"))
    links = ngram_join._across(groups, spark.createDataFrame(sets, "set_id long, n long, tokens array<long>")).collect()
    assert len(links) == 39 and {x for link in links for x in (link.a, link.b)} == set(range(40))
    assert max(made) <= 2 * len(sets)


def test_one_of_each(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(4, text), (2, text.upper()), (3, text + " eleven"), (9, "other words"), (9, "other words"), (None, text), (5, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept_id string")
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["2", "5", "9", "None"]
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_graph_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(150)]
    edges += [(7, 7), (9999, 9999)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
