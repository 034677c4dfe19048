"""The corpus pipeline on small tables, stage by stage and as a whole."""

import random
import re
from collections import defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from oligoweave.llm import secrets

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    sets = {"aa": ["the", "tion", "ing", "er", "an"], "bb": ["sch", "ung", "keit", "er", "ein"]}
    rows = []
    for lang, syllables in sets.items():
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
        for _ in range(60):
            text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(20, 40))) for _ in range(3))
            rows.append((text, lang, f"s{rng.randrange(9)}"))
    base = rows[0][0]
    words = base.replace("\n", " ").split(" ")
    rows.append((base, "aa", "s1"))  # an exact copy: all its lines go
    rows.append((" ".join(words), "aa", "s1"))  # the same words on one line: a similar document
    rows.append(("123 456", "aa", "s1"))  # no letter
    rows.append((None, "aa", "s1"))
    rows.append((rows[1][0] + "\nthe key is token = 'Zk4tQ9sWm1Xv7Lp2Hd8Rj5'", "aa", "s2"))
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, lang, source, len(t or "")) for i, (t, lang, source) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, docs


def test_stages(spark, folder):
    path, docs = folder
    frame, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, path)
        assert frame.columns == columns
        kept[name] = {r.doc_id: r.text for r in frame.collect()}
        assert all(r.n_chars == len(r.text) for r in frame.collect())
    clean = {d[0]: d[1] for d in docs[:120]}
    assert {k: v for k, v in kept["language ID"].items() if k < 120} == clean
    assert 122 not in kept["language ID"] and 123 not in kept["language ID"]
    assert 120 not in kept["line dedup"] and kept["line dedup"][124] == "the key is token = 'Zk4tQ9sWm1Xv7Lp2Hd8Rj5'"
    assert 121 in kept["line dedup"] and 121 not in kept["n-gram Jaccard join"]
    assert kept["secret scans"][124] == f"the key is token = '{secrets.MASK}'"
    assert {k: v for k, v in kept["secret scans"].items() if k < 120} == clean


def test_whole_run_packs_what_was_kept(spark, folder):
    path, docs = folder
    got = entry.queries()["pipeline"](spark, path).collect()
    tokenizer = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lengths, places = defaultdict(int), defaultdict(list)
    for r in got:
        lengths[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    texts = {d[0]: d[1] for d in docs[:120]} | {124: f"the key is token = '{secrets.MASK}'"}
    assert lengths == {k: len(tokenizer.encode(v, add_special_tokens=False).ids) + 1 for k, v in texts.items()}
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_registered_queries_cover_every_operator():
    names = [m[1] for q in entry.queries() if (m := re.match(r"op(\d+)_", q))]
    assert sorted(map(int, names)) == list(range(1, 11))
