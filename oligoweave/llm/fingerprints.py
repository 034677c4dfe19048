"""Document fingerprints: quartile digests of hashed byte triplets, with a bounded likeness.

Every three bytes in a row are hashed into one of 256 buckets; the digest holds, for each
bucket, the quartile of its count, and the length of the text on a log scale. Two digests
differ by the sum of the quartile steps between their buckets and by their lengths; the
likeness is 1 for equal digests and 0 from the difference on that unrelated quartiles
have on average.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oligoweave.llm.common import rows_of, text_or_empty

BUCKETS = 256
#: Mean step between two unrelated quartiles is 1.25; a difference of so much a bucket counts as no likeness.
UNRELATED = 1.25 * BUCKETS
LENGTH_BASE = 1.1
EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def _tables() -> np.ndarray:
    """Three fixed permutations of the byte values, by a multiplicative rule."""
    order = np.arange(BUCKETS, dtype=np.uint64)
    keys = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
    return np.stack([np.argsort((order + np.uint64(1)) * key % np.uint64(1_000_003), kind="stable") for key in keys]).astype(np.uint8)


TABLES = _tables()


def digest(data: bytes) -> str:
    """Two hex digits for the length, then two bits a bucket as hex digits."""
    b = np.frombuffer(data, np.uint8)
    length = min(255, round(math.log(len(data) + 1, LENGTH_BASE)))
    if len(b) < 3:
        return f"{length:02x}" + "0" * (BUCKETS // 2)
    hashed = TABLES[0][b[:-2]] ^ TABLES[1][b[1:-1]] ^ TABLES[2][b[2:]]
    counts = np.bincount(hashed, minlength=BUCKETS)
    cuts = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > cuts).sum(1).astype(np.uint8).reshape(-1, 4)
    return f"{length:02x}" + (codes << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8).tobytes().hex()


def _codes(text: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(text[2:]), np.uint8)
    return (packed[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel().astype(np.int16)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, down to 0."""
    if a == b:
        return 1.0
    difference = int(np.abs(_codes(a) - _codes(b)).sum()) + abs(int(a[:2], 16) - int(b[:2], 16))
    return max(0.0, 1.0 - difference / UNRELATED)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of each whole text. Null text counts as empty; repeated rows give equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            columns = [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([digest(x.encode()) for x in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "fingerprint"])

    rows = rows_of(df, doc_id=id_col, text=text_col).withColumn("text", text_or_empty())
    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def compare(pairs: DataFrame, left: str, right: str, name: str = "likeness") -> DataFrame:
    """Add the likeness of two fingerprint columns; null where either is null."""
    @F.pandas_udf("double")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return pairs.withColumn(name, like(left, right))


def edit(text: str, after: str) -> str:
    """The last half of the text (rounded down) replaced by as much of the next text as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def edited_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text, its edited text, and the next document's, by descending id.

    Returns one row per row of `df`, as EDITED. Null text counts as empty. After the last
    document comes the first; a lone document follows itself. Repeated ids follow each
    other by text. A null id has no place in the order: its row has no edited text and
    no likeness (nulls). An empty table gives no rows.

    Texts move once: to the range of ids they belong to. The upper end of a range is an id
    of the table, and the rows of that id also go to the range above, whose last document
    they follow.
    """
    rows = rows_of(df, doc_id=id_col, text=text_col).withColumn("text", text_or_empty())
    ranged = _by_range(rows).repartition("range").sortWithinPartitions("range", "halo", F.col("doc_id").desc_nulls_last(), "text")
    return ranged.select("range", "halo", "doc_id", "text").mapInArrow(_walk, EDITED)


def _by_range(rows: DataFrame) -> DataFrame:
    """Add `range` and `halo`; a few ranges per shuffle partition, cut at ids of the table."""
    wanted = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*(F.lit(i / wanted) for i in range(1, wanted)))
    ends = rows.agg(F.max("doc_id").alias("top"), F.percentile_approx("doc_id", shares, F.lit(20 * wanted)).alias("cuts")).first()
    tops = sorted({*(ends.cuts or []), ends.top} - {None})
    n, step = max(1, len(tops)), max(1, math.isqrt(len(tops)))
    spread = F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    if not tops:
        return rows.select("doc_id", "text", spread.alias("range"), F.lit(False).alias("halo"))
    every = F.array(*(F.lit(x).cast("long") for x in tops))
    blocks = F.array(*(F.lit(x).cast("long") for x in tops[step - 1 :: step]))

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda x: x < F.col("doc_id")))

    block = below(blocks) * step
    at = F.when(F.col("doc_id").isNull(), spread).otherwise(block + below(F.slice(every, block + 1, F.lit(step))))
    own = F.struct(F.col("at").alias("range"), F.lit(False).alias("halo"))
    also = F.struct(F.pmod(F.col("at") + 1, F.lit(n)).alias("range"), F.lit(True).alias("halo"))
    is_top = F.element_at(every, F.col("at") + 1) == F.col("doc_id")
    placed = rows.withColumn("at", at).withColumn("places", F.when(is_top, F.array(own, also)).otherwise(F.array(own)))
    return placed.select("doc_id", "text", F.inline("places"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole ranges in order, the halo last: a row ends when the one after it comes."""
    schema = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    last = None
    for batch in batches:
        out: list[tuple] = []
        for at, halo, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            mark = digest(text.encode())
            if doc is None:
                out.append((None, len(text), None, mark, None, None, None))
                continue
            if last and last[0] == at:
                _, before, own_text, own_mark = last
                changed = edit(own_text, text).encode()
                edited_mark = digest(changed)
                out.append(
                    (before, len(own_text), hashlib.sha256(changed).hexdigest(), own_mark, edited_mark, likeness(own_mark, edited_mark), likeness(own_mark, mark))
                )
            last = None if halo else (at, doc, text, mark)
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], schema)
