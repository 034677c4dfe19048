"""Encoding, packing and sharding against libraries and brute force."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from oligoweave.llm import byte_bpe, packing, sharding
from oligoweave.llm.chunks import ChunkValues, plain_spacing

P = pytest.importorskip("public_tokenizers")

ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n b", "a \n b", "don't they'll", "x y  z", "tab\t tab", "naïve ça",
    "漢字 かな", "\U0001f600 \U0001f469‍\U0001f4bb", "1234 5678,90", "<|endoftext|> a<|endoftext|>b", "a" * 3000, "ab" * 2000, "é" * 1500,
    "!?" * 900 + " end", "\x1c \x1d\x85 x", "word, word. (word) word\nword word",
]


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, x, "extra", i) for i, x in enumerate(ODD)] + [(None, "null id", "", 1), (3, " ", "", 2), (3, " ", "", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, length int").repartition(3)


def test_rank_bitmap_gives_the_least():
    rng, marks, held = random.Random(1), byte_bpe.RankBitmap(50_257), set()
    for _ in range(3000):
        x = rng.randrange(50_257)
        (marks.remove if x in held else marks.add)(x)
        held ^= {x}
        assert marks.first() == min(held, default=-1)


def test_pieces_equal_the_library(library):
    bpe = byte_bpe.ByteBpe.from_file(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(2)
    texts = [x or "" for x in ODD] + ["".join(rng.choice("abt he\n'é1.ß ") for _ in range(rng.randrange(300))) for _ in range(200)]
    for text in texts:
        ids = bpe.encode(text)
        assert ids == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_pattern_cuts_every_character_as_the_library(library):
    bpe = byte_bpe.ByteBpe.from_file(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for c in [*range(0x20, 0x3000), *range(0xA000, 0xABFF), *range(0x1F600, 0x1F650)]:
        text = f"x{chr(c)}1{chr(c)} {chr(c)}  {chr(c)}\n"
        assert bpe.encode(text) == library.encode_ordinary(text), hex(c)


def test_chunks_put_together_give_the_text():
    memory = ChunkValues(lambda chunks: list(chunks), lambda text: [text], limit=50)
    for text in [x or "" for x in ODD] * 2:
        assert "".join(next(memory.of([text]))) == text
    assert plain_spacing("a b\nc") and not plain_spacing("a  b") and not plain_spacing("a\tb")


def test_digests(spark, docs, library):
    got = sorted(tuple(r) for r in byte_bpe.encode_digests(docs.where("doc_id is not null")).collect())
    want = []
    for doc, text, *_ in docs.where("doc_id is not null").collect():
        ids = library.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert byte_bpe.encode_digests(docs).where("doc_id is null").count() == 1
    assert byte_bpe.encode_digests(docs.limit(0)).count() == 0
    back = byte_bpe.decode_ids(byte_bpe.encode_ids(docs.where("doc_id = 19"))).first()
    assert bytes(back.bytes) == ("a" * 3000).encode()


def test_cut_points():
    assert packing.cut_points(1, 4) == [0, 1]
    assert packing.cut_points(4, 4) == [0, 4]
    assert packing.cut_points(9, 4) == [0, 1, 5, 9]


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_is_valid_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 1024])
    counts = Counter(min(capacity, int(rng.expovariate(3 / capacity)) + 1) for _ in range(3000))
    fill, ranks = defaultdict(list), defaultdict(list)
    for length, first, n, sequence, per, offset in packing.plan_runs(counts, capacity):
        for j in range(n):
            fill[sequence + j // per].append((offset + j % per * length, length))
        ranks[length] += range(first, first + n)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(k * n for k, n in counts.items())
    assert len(fill) <= -(-total // capacity) * 1.05 + 2


def test_packed_documents(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    got = packing.pack_documents(docs).collect()
    want = Counter()
    for doc, text, *_ in docs.collect():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        points = packing.cut_points(len(ids), 1024)
        for i, (a, b) in enumerate(zip(points, points[1:], strict=False)):
            want[doc, i, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for places in _by(got, "sequence_id").values():
        at = 0
        for r in sorted(places, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack_documents(docs.limit(0)).count() == 0


def _by(rows, name):
    out = defaultdict(list)
    for r in rows:
        out[r[name]].append(r)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 17, 100, 1001])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    got = spark.range(n).select(sharding.permuted(F.col("id"), F.lit(n).cast("long"), 5).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))


def test_walks_that_leave_the_count_come_back(spark):
    """A rectangle much larger than the count: nearly every row walks."""
    from pyspark.sql import functions as F

    left, right = F.lit(9).cast("long"), F.lit(11).cast("long")
    got = spark.range(99).select(sharding.feistel(F.col("id"), left, right, 3).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(99))


def test_shards(spark, docs):
    shards = sharding.shard_documents(docs, shards=5).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in shards) == want
    sizes = []
    for rows in _by(shards, "shard").values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        sizes.append(len(rows))
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    again = sharding.shard_documents(docs.repartition(7), shards=5).collect()
    assert sorted(map(str, shards)) == sorted(map(str, again))
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = spark.createDataFrame([(1, "a")] * 50 + [(2, "b")] * 3, "doc_id long, text string")
    got = sharding.shard_documents(rows, shards=4).collect()
    assert sorted(r.place for r in got) == list(range(53))
