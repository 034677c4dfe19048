"""Best-fit packing of tokenized documents into sequences of bounded length.

Pieces over a third of the capacity pair at most twice per sequence, largest first with
the largest partner that fits; smaller pieces then go, largest first, into the tightest
gap that takes them. Pieces of one length are interchangeable, so the packing is worked
out on the counts of the lengths alone (as many rows as the capacity, whatever the
input) and comes back as runs: which ranks of a length go to which sequences. Spark
counts the lengths, numbers the pieces of each length in salted groups and looks the
runs up, so no task holds a length, however many pieces share it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oligoweave.llm.chunks import ChunkValues, text_blocks
from oligoweave.llm.common import rows_of, text_or_empty, tokenizer_file
from oligoweave.session import cut_lineage

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
SALTS = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def cut_points(n: int, capacity: int) -> list[int]:
    """Where a document of n tokens is cut: whole pieces at the end, the rest in front."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n + 1, capacity)]


def tokenized_pieces(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    vocabulary: str = VOCABULARY,
    keep_ids: bool = False,
) -> DataFrame:
    """Tokenize whole texts, add the end id, cut what is longer than the capacity.

    One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids
    (little-endian unsigned 32-bit numbers as binary). Null text counts as empty: one
    piece with the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file(vocabulary))
        tokenizer.encode_special_tokens = True
        pre_tokenizer = tokenizer.pre_tokenizer

        mark = tokenizer.encode("\r", add_special_tokens=False).ids

        def ids(chunks: list[str]) -> list[bytes]:
            """Words after a space go to the tokenizer many at a time, with a sign between them that they do not hold."""
            joined = [i for i, x in enumerate(chunks) if len(mark) == 1 and x[:1] == " " and "\r" not in x and not x[1:2].isspace() and x[1:] and not x[-1].isspace()]
            out: list[bytes] = [b""] * len(chunks)
            lines = ["\r".join([chunks[i] for i in joined[a : a + 40]]) for a in range(0, len(joined), 40)]
            place = iter(joined)
            for found in tokenizer.encode_batch_fast(lines, add_special_tokens=False):
                line = np.array(found.ids, "<u4")
                blob, cuts = line.tobytes(), (4 * np.flatnonzero(line == mark[0])).tolist()
                for a, b in zip([0, *(x + 4 for x in cuts)], [*cuts, len(blob)], strict=True):
                    out[next(place)] = blob[a:b]
            alone = sorted(set(range(len(chunks))) - set(joined))
            for i, found in zip(alone, tokenizer.encode_batch_fast([chunks[i] for i in alone], add_special_tokens=False), strict=True):
                out[i] = np.array(found.ids, "<u4").tobytes()
            return out

        def split(text: str) -> list[str]:
            ends = [span[1] for _, span in pre_tokenizer.pre_tokenize_str(text)]
            return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]

        memory, end = ChunkValues(ids, split), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts, docs = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            for block in text_blocks(texts):
                for at, found in zip(block, memory.of([texts[i] for i in block]), strict=True):
                    blob = b"".join([*found, end])
                    points = cut_points(len(blob) // 4, capacity)
                    for piece, (a, b) in enumerate(zip(points, points[1:], strict=False)):
                        part = blob[4 * a : 4 * b]
                        for column, x in zip(out, (docs[at], piece, a, b - a, zlib.crc32(part), part if keep_ids else None), strict=True):
                            column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + keep_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=False)], names)

    rows = rows_of(df, doc_id=id_col, text=text_col).withColumn("text", text_or_empty())
    return rows.mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pack `counts` pieces of each length; the result has a bounded number of runs.

    A run (length, first_rank, n, first_sequence, per_sequence, offset) puts n pieces of
    that length, from that rank on, per_sequence to a sequence, from that offset on.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    taken = dict.fromkeys(left, 0)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    runs, opened = [], 0

    def put(length: int, n: int, first: int, per: int, offset: int) -> None:
        runs.append((length, taken[length], n, first, per, offset))
        taken[length] += n
        left[length] -= n

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for length in large:
        for partner in [k for k in large if k <= length and k + length <= capacity]:
            n = min(left[length], left[partner]) if partner != length else left[length] // 2
            if n:
                put(length, n, opened, 1, 0)
                put(partner, n, opened, 1, length)
                gaps[capacity - length - partner].append((opened, n))
                opened += n
        if n := left[length]:
            put(length, n, opened, 1, 0)
            gaps[capacity - length].append((opened, n))
            opened += n
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        gap = length
        while left[length]:
            while gap < capacity and not gaps[gap]:
                gap += 1
            per = gap // length
            if gap == capacity and not gaps[gap]:
                n = -(-left[length] // per)
                gaps[gap].append((opened, n))
                opened += n
            first, n = gaps[gap].pop()
            full = min(n, left[length] // per)
            if full:
                put(length, full * per, first, per, capacity - gap)
                gaps[gap - per * length].append((first, full))
            if full < n and (rest := left[length]) and rest < per:
                put(length, rest, first + full, rest, capacity - gap)
                gaps[gap - rest * length].append((first + full, 1))
                full += 1
            if full < n:
                gaps[gap].append((first + full, n - full))
    return runs


def ranked_within(df: DataFrame, group: str, ties: list[str], salts: int = SALTS) -> DataFrame:
    """A number from 0 within each group, given out in salted parts of it; adds `rank`."""
    rows = df.withColumn("salt", F.pmod(F.xxhash64(*ties), F.lit(salts)).cast("int")).repartition(group, "salt")
    counts = rows.groupBy(group, "salt").agg(F.count("*").alias("in_part"))
    before = Window.partitionBy(group).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "salt", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("part_start"))
    own = Window.partitionBy(group, "salt").orderBy(*ties)
    return (
        rows.withColumn("own_rank", F.row_number().over(own) - 1)
        .join(starts, [group, "salt"])
        .withColumn("rank", F.col("part_start") + F.col("own_rank"))
        .drop("salt", "part_start", "own_rank")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32): adds sequence_id and offset.

    Lengths must be 1 to `capacity`. Equal rows get places of their own; an empty table
    gives no rows. The pieces are written with a number each, so whatever makes them runs
    once, also when executors are lost.
    """
    pieces = cut_lineage(pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("row_id")))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= k <= capacity for k in counts):
        raise ValueError(f"lengths must be 1 to {capacity}: {min(counts)} to {max(counts)}")
    runs = np.array(sorted(plan_runs(counts, capacity)), np.int64).reshape(-1, 6)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = 1 << 48
        keys = runs[:, 0] * shift + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            run = runs[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            nth = rank - run[:, 1]
            sequence, offset = run[:, 3] + nth // run[:, 4], run[:, 5] + nth % run[:, 4] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked_within(pieces, "length", ["row_id"]).drop("row_id").mapInArrow(place, PLACED)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenize and pack whole documents.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null
    and empty texts are one piece with the end id; repeated rows are packed each; null ids
    stay null; an empty table gives no rows.
    """
    return pack(tokenized_pieces(df, id_col, text_col, capacity), capacity)
