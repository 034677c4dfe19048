"""Byte-level BPE encoding and decoding with a rank queue.

The pre-tokens of a block of texts stand in one linked list of tokens, bytes at first.
Every adjacent pair of a pre-token that can merge stands in the bucket of its merge rank;
a bitmap of three levels marks the buckets that hold something, so the lowest rank is
found by three find-first-set steps. A bucket is merged as a whole, left to right, which
re-files the pairs beside each merge; entries of pairs that are gone are skipped when they
come up. The cost of a pre-token grows with its length alone, also where it is a whole
text, and pre-tokens do not meet, so it does not matter how many share a queue.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from oligoweave.llm.chunks import ChunkValues, text_blocks
from oligoweave.llm.common import rows_of, text_or_empty, tokenizer_file

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
RANK_FILE = "byte_bpe_50k.tiktoken"
#: Characters of texts whose new pre-tokens share a queue.
BLOCK = 6_000_000


class RankBitmap:
    """A set of small numbers that gives its least one in three steps."""

    def __init__(self, size: int):
        self._low = [0] * ((size >> 6) + 1)
        self._mid = [0] * ((size >> 12) + 1)
        self._top = 0

    def add(self, x: int) -> None:
        self._low[x >> 6] |= 1 << (x & 63)
        self._mid[x >> 12] |= 1 << (x >> 6 & 63)
        self._top |= 1 << (x >> 12)

    def remove(self, x: int) -> None:
        self._low[x >> 6] &= ~(1 << (x & 63))
        if not self._low[x >> 6]:
            self._mid[x >> 12] &= ~(1 << (x >> 6 & 63))
            if not self._mid[x >> 12]:
                self._top &= ~(1 << (x >> 12))

    def first(self) -> int:
        """The least member, or -1."""
        if not self._top:
            return -1
        top = (self._top & -self._top).bit_length() - 1
        word = self._mid[top]
        mid = top << 6 | (word & -word).bit_length() - 1
        word = self._low[mid]
        return mid << 6 | (word & -word).bit_length() - 1


class ByteBpe:
    """Ids of pre-tokens by merge rank, and bytes of ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self._bytes = np.array([ranks[bytes([x])] for x in range(256)], np.int64)
        pairs = {
            (ranks[token[:i]] << 32) + ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self._pairs = np.array(sorted(pairs), np.int64)
        self._merged = np.array([pairs[x] for x in self._pairs.tolist()], np.int64)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def pre_tokens(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of tokens, -1 where they do not merge."""
        wanted = (left << 32) + right
        at = np.minimum(np.searchsorted(self._pairs, wanted), len(self._pairs) - 1)
        return np.where(self._pairs[at] == wanted, self._merged[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens: a whole token by itself, else the merges of least rank, leftmost first."""
        out = [[whole] if (whole := self.ranks.get(x)) is not None else [] for x in pieces]
        split = [i for i, x in enumerate(pieces) if x and not out[i]]
        if split:
            for i, ids in zip(split, self._queue([pieces[i] for i in split]), strict=True):
                out[i] = ids
        return out

    def _queue(self, pieces: list[bytes]) -> Iterator[list[int]]:
        token = self._bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(token)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(lengths) - lengths
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[starts + lengths - 1] = -1
        before[starts] = -1
        alive = np.ones(n, bool)
        pair = np.full(n, -1)
        buckets: dict[int, list[np.ndarray]] = {}
        marks = RankBitmap(len(self.tokens) + 256)

        def file(at: np.ndarray) -> None:
            """Work out the ranks of the pairs at these places and put them into their buckets."""
            follower = after[at]
            rank = np.where(follower >= 0, self._rank(token[at], token[follower]), -1)
            pair[at] = rank
            at, rank = at[rank >= 0], rank[rank >= 0]
            if len(at):
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
                cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                ranks = rank[np.concatenate([[0], cuts])].tolist()
                bounds = [0, *cuts.tolist(), len(at)]
                for i, r in enumerate(ranks):
                    held = buckets.get(r)
                    if held is None:
                        buckets[r] = [at[bounds[i] : bounds[i + 1]]]
                        marks.add(r)
                    else:
                        held.append(at[bounds[i] : bounds[i + 1]])

        file(np.arange(n))
        while (rank := marks.first()) >= 0:
            held = buckets.pop(rank)
            marks.remove(rank)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:  # of pairs that overlap in a row, every second one is left to merge
                nth = np.arange(len(at))
                free = np.ones(len(at), bool)
                free[1:] = after[at[:-1]] != at[1:]
                if not free.all():
                    at = at[(nth - np.maximum.accumulate(np.where(free, nth, 0))) % 2 == 0]
            gone = after[at]
            follower = after[gone]
            alive[gone] = False
            pair[gone] = -1
            token[at] = rank
            after[at] = follower
            on = follower >= 0
            before[follower[on]] = at[on]
            left = before[at]
            file(np.unique(np.concatenate([at, left[left >= 0]])))
        ids = token[alive].tolist()
        ends = np.cumsum(np.add.reduceat(alive.astype(np.int64), starts)).tolist()
        for a, b in zip([0, *ends], ends, strict=False):
            yield ids[a:b]

    def encode(self, text: str) -> list[int]:
        return [x for ids in self.encode_pieces([piece.encode() for piece in self.pre_tokens(text)]) for x in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str = RANK_FILE) -> DataFrame:
    """The ids of each text: doc_id, ids array<int>. Null text: no ids; repeated rows: one result each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(rank_file)
        for batch in batches:
            ids = [bpe.encode(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = rows_of(df, doc_id=id_col, text=text_col).withColumn("text", text_or_empty())
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", rank_file: str = RANK_FILE) -> DataFrame:
    """The bytes of each list of ids: doc_id, bytes binary. Null ids: no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(rank_file)
        for batch in batches:
            found = [bpe.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "bytes"])

    return rows_of(df, doc_id=id_col, ids=ids_col).mapInArrow(run, "doc_id long, bytes binary")


def encode_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str = RANK_FILE) -> DataFrame:
    """Encode every whole text, decode the ids, and return digests of both.

    One row per row of `df`: doc_id, n_tokens, ids_sha256 (decimal ids joined by a space),
    decoded_sha256 (bytes that the ids decode to). Null and empty texts have no tokens;
    repeated rows give equal rows; a null id stays null; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(rank_file)
        pieces: dict[str, tuple] = {}
        written = {x: str(x) for x in bpe.tokens}

        def values(chunks: list[str]) -> list[tuple]:
            if len(pieces) > 300_000:
                pieces.clear()
            split = [bpe.pre_tokens(chunk) for chunk in chunks]
            new = sorted({piece for parts in split for piece in parts if piece not in pieces})
            for piece, ids in zip(new, bpe.encode_pieces([x.encode() for x in new]), strict=True):
                pieces[piece] = len(ids), " ".join([written[x] for x in ids]), bpe.decode(ids)
            out = []
            for parts in split:
                if len(parts) == 1:
                    out.append(pieces[parts[0]])
                else:
                    found = [pieces[x] for x in parts]
                    out.append((sum(x[0] for x in found), " ".join([x[1] for x in found]), b"".join([x[2] for x in found])))
            return out

        memory = ChunkValues(values, bpe.pre_tokens)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n, ids_sha, bytes_sha = [], [], []
            for block in text_blocks(texts, BLOCK):
                for found in memory.of([texts[i] for i in block]):
                    n.append(sum(x[0] for x in found))
                    ids_sha.append(hashlib.sha256(" ".join(x[1] for x in found if x[0]).encode()).hexdigest())
                    bytes_sha.append(hashlib.sha256(b"".join(x[2] for x in found)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = rows_of(df, doc_id=id_col, text=text_col).withColumn("text", text_or_empty())
    return rows.mapInArrow(run, ENCODED)


def _loaded(rank_file: str) -> ByteBpe:
    import public_tokenizers

    return ByteBpe.from_file(tokenizer_file(rank_file), public_tokenizers.PATTERN)
