"""Token counts of whole texts; very long texts are encoded as overlapping windows that are spliced.

A text up to WINDOW characters is one window. A longer one is cut into windows that run
OVERLAP characters into the next one; Spark deals the windows to tasks, which encode
them with offsets. The pre-tokenizer reads from left to right and never looks back, so
once two neighbours both start a pre-token at one place, they agree from there on. Such a
place is proven for the left window too if it lies MARGIN characters before its end: no
special token and no contraction that is cut off there reaches back to it, and of a run of
spaces only the start can. The counts are spliced at the last such place of an overlap.
Where an overlap has none (a pre-token without end, say), it widens to the whole of the
next window: the two become one, which is encoded anew, until every overlap has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oligoweave.llm.chunks import ChunkValues, text_blocks
from oligoweave.llm.common import rows_of, text_or_empty, tokenizer_file
from oligoweave.session import cut_lineage

VOCABULARY = "byte_bpe_50k.json"
#: Characters that a window advances by, and those that it has in common with the next one.
WINDOW, OVERLAP = 16_384, 256
#: Beyond the longest special token, and all that a pre-token can change when more text follows.
MARGIN = 32
LIMIT = 512
COUNTED = "row_id long, doc_id long, n_bytes long, n_tokens long, window_no int, text string"
PLACES = "row_id long, window_no int, n long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>"


def load_tokenizer(vocabulary: str = VOCABULARY):
    """The library's tokenizer as it comes: strings of special tokens are these tokens, nothing is cut or padded."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file(vocabulary))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def starts_between(encoding, first: int, last: int) -> tuple[list[int], list[int]]:
    """Character places from `first` to `last` where a pre-token starts, and the tokens before each."""
    places, before = [], []
    n = len(encoding)
    at = encoding.char_to_token(first) if first else 0
    while at is not None and at < n:
        start = encoding.token_to_chars(at)[0]
        if start > last:
            break
        if start >= first and (at == 0 or encoding.token_to_word(at) != encoding.token_to_word(at - 1)):
            places.append(start)
            before.append(at)
        at += 1
    return places, before


def cut_windows(text: str, window: int, overlap: int) -> Iterator[str]:
    """Windows at every `window` characters, each with the `overlap` characters after it; the last reaches the end."""
    for start in range(0, len(text), window):
        yield text[start : start + window + overlap]
        if start + window + overlap >= len(text):
            break


def counted_or_cut(rows: DataFrame, vocabulary: str, window: int, overlap: int) -> DataFrame:
    """Per text (row_id, doc_id, text) a row with its count, or with none and a row for each of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(vocabulary)
        memory = ChunkValues(lambda chunks: [len(x) for x in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)], lambda text: [text])
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys, docs = batch.column("row_id").to_pylist(), batch.column("doc_id").to_pylist()
            short = [i for i, x in enumerate(texts) if len(x) <= window + overlap]
            counts: list[int | None] = [None] * len(texts)
            for block in text_blocks([texts[i] for i in short]):
                at = [short[i] for i in block]
                for i, found in zip(at, memory.of([texts[i] for i in at]), strict=True):
                    counts[i] = sum(found)
            sizes = [len(x.encode()) for x in texts]
            none = [None] * len(texts)
            yield _record((keys, docs, sizes, counts, none, none), COUNTED)
            for i, n in enumerate(counts):
                if n is None:
                    for no, part in enumerate(cut_windows(texts[i], window, overlap)):
                        yield _record(([keys[i]], [docs[i]], [sizes[i]], [None], [no], [part]), COUNTED)

    return rows.mapInArrow(run, COUNTED)


def _record(columns: tuple[list, ...], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[kind]) for x, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def encode_windows(windows: DataFrame, vocabulary: str, overlap: int) -> DataFrame:
    """Windows (row_id, window_no, text) dealt over tasks and encoded: their counts and the places they may be spliced at.

    Places count from the start of the window (head) and from the start of the overlap with
    the next one (tail), so they are the same numbers on either side of an overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(vocabulary)
        for batch in batches:
            for key, no, text in zip(*(batch.column(x).to_pylist() for x in ("row_id", "window_no", "text")), strict=True):
                found = tokenizer.encode(text, add_special_tokens=False)
                head, head_n = starts_between(found, 0, overlap)
                start = max(0, len(text) - overlap)
                tail, tail_n = starts_between(found, start, len(text) - MARGIN)
                yield _record(([key], [no], [len(found)], [head], [head_n], [[x - start for x in tail]], [tail_n]), PLACES)

    tasks = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return windows.select("row_id", "window_no", "text").repartition(tasks, "row_id", "window_no").mapInArrow(run, PLACES)


def splice(places: DataFrame) -> DataFrame:
    """Neighbouring windows (row_id, window_no, the left one) with `extra`, the tokens that both count; null where they share no place."""
    left = places.select("row_id", "window_no", "n", "tail", "tail_n")
    right = places.select("row_id", (F.col("window_no") - 1).alias("window_no"), "head", "head_n")
    common = F.array_max(F.array_intersect("tail", "head"))
    before = lambda where, n: F.get(n, (F.array_position(where, F.col("common")) - 1).cast("int"))
    return (
        left.join(right, ["row_id", "window_no"])
        .withColumn("common", common)
        .select("row_id", "window_no", (F.col("n") - before("tail", F.col("tail_n")) + before("head", F.col("head_n"))).alias("extra"))
    )


def widened(windows: DataFrame, failed: DataFrame, overlap: int) -> DataFrame:
    """The windows of texts with failed overlaps (row_id, window_no), those on both sides of one joined, numbered anew."""
    stuck = failed.select("row_id", (F.col("window_no") + 1).alias("window_no"), F.lit(0).alias("starts"))
    own = windows.join(failed.select("row_id").distinct(), "row_id", "left_semi")
    marked = own.join(stuck, ["row_id", "window_no"], "left").withColumn("starts", F.coalesce("starts", F.lit(1)))
    order = Window.partitionBy("row_id").orderBy("window_no")
    # a window after a failed overlap goes on with the one before it; one text's windows are all that a group holds
    grouped = marked.withColumn("joined", (F.sum("starts").over(order) - 1).cast("int"))
    part = F.when(F.col("starts") == 1, F.col("text")).otherwise(F.expr(f"substring(text, {overlap + 1})"))
    parts = grouped.groupBy("row_id", F.col("joined").alias("window_no")).agg(F.sort_array(F.collect_list(F.struct("window_no", part.alias("part")))).alias("parts"))
    return parts.select("row_id", "window_no", F.array_join(F.col("parts.part"), "").alias("text"))


def spliced_counts(windows: DataFrame, vocabulary: str = VOCABULARY, overlap: int = OVERLAP) -> DataFrame:
    """row_id, n_tokens of the texts of windows (row_id, window_no, text).

    A round ends with tables of the texts that are done and of the windows that are not;
    every round has fewer windows, and a text that has become one window is done.
    """
    spark, done = windows.sparkSession, None
    while True:
        places = cut_lineage(encode_windows(windows, vocabulary, overlap))
        pairs = cut_lineage(splice(places))
        failed = pairs.where("extra is null")
        open_texts = failed.select("row_id").distinct()
        parts = places.select("row_id", "n").union(pairs.select("row_id", -F.col("extra"))).join(open_texts, "row_id", "left_anti")
        counts = parts.groupBy("row_id").agg(F.sum("n").alias("n_tokens"))
        done = counts if done is None else done.union(counts)
        if failed.isEmpty():
            return done
        windows = cut_lineage(widened(windows, failed, overlap))


def token_counts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
    vocabulary: str = VOCABULARY,
    window: int = WINDOW,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Per row of `df`: doc_id, n_bytes (UTF-8), n_tokens as the tokenizers library counts the whole text, over_limit.

    A null text is empty and has no tokens; repeated rows are counted each; null ids stay
    null; an empty table gives no rows; other columns are left out. No text is cut short.
    """
    if not MARGIN < overlap <= window:
        raise ValueError("an overlap must be longer than the margin and no longer than a window")
    rows = rows_of(df, doc_id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("row_id"), "doc_id", text_or_empty().alias("text"))
    counted = cut_lineage(counted_or_cut(rows, vocabulary, window, overlap))
    texts = counted.where("window_no is null")
    found = spliced_counts(counted.where("window_no is not null"), vocabulary, overlap).withColumnRenamed("n_tokens", "spliced")
    long = texts.where("n_tokens is null").drop("n_tokens").join(found, "row_id").withColumnRenamed("spliced", "n_tokens")
    columns = ["doc_id", "n_bytes", "n_tokens"]
    return texts.where("n_tokens is not null").select(*columns).union(long.select(*columns)).withColumn("over_limit", F.col("n_tokens") > limit)
