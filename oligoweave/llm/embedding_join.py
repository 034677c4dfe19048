"""Embedding near-dedup: an epsilon grid order join.

Vectors of unit length are linked where their cosine is at least a threshold, that is,
where they lie within epsilon of each other. They are turned onto their principal
directions (found on a bounded sample), sorted by the grid cells of the leading ones, and
cut into intervals of the sorted sequence. Intervals are joined recursively: two of them
are left where the boxes around their vectors are further than epsilon apart, else their
halves are joined, down to small blocks whose cosines are worked out as one matrix
product. Spark descends the tree of intervals level by level and gives each pair of lowest
intervals to a task; the task goes on inside them.

Equal vectors are one vector with a count, and a task returns numbers of links and a
spanning forest of what it found linked, so a group of copies is never expanded into pairs.
How much is skipped depends on the data: vectors without any structure are near each other
in few leading directions, and then most pairs of blocks have to be multiplied.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oligoweave.llm.common import rows_of
from oligoweave.llm.graph import components
from oligoweave.session import cut_lineage

COSINE = 0.9
#: Vectors the principal directions are found on, at most; directions that are kept for order and boxes.
SAMPLE, LEADING = 4096, 16
#: Cells per epsilon, vectors of a lowest interval and of a block inside it, intervals at the top.
FINENESS, INTERVAL, BLOCK, TOP = 2, 8192, 256, 32


def _usable(wide: bool):
    """Rows with the vector as bytes and a key of its direction; unusable vectors have none."""
    kind = np.float64 if wide else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, size = [], []
            for x in batch.column("embedding").to_pylist():
                v = np.array(x, kind) if x and None not in x else np.empty(0, kind)
                ok = len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())
                data.append((v + 0.0).tobytes() if ok else None)
                size.append(len(v) if ok else 0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(size, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "size", "data"])

    return run


def unit_vectors(data: list[bytes], wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled to a largest component of 1, and their lengths, in double precision."""
    x = np.frombuffer(b"".join(data), np.float64 if wide else np.float32).reshape(len(data), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, np.sqrt(np.einsum("ij,ij->i", x, x))


def principal_directions(distinct: DataFrame, wide: bool) -> dict[int, np.ndarray]:
    """The leading directions by number of components, from the first vectors by a hash."""
    first = distinct.select("size", "data", F.xxhash64("data").alias("h")).orderBy("h", "data").limit(SAMPLE).collect()
    out = {}
    for size in sorted({r["size"] for r in first}):
        x, length = unit_vectors([bytes(r["data"]) for r in first if r["size"] == size], wide)
        x = x / length[:, None]
        out[size] = np.linalg.eigh(np.cov(x.T, bias=True).reshape(size, size))[1][:, ::-1][:, :LEADING]
    return out


def _placed(turn: dict[int, np.ndarray], epsilon: float, wide: bool):
    """Adds the leading coordinates and grid cells; sizes outside the sample keep their own first components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy(zero_copy_only=False)
            data = batch.column("data").to_pylist()
            y = np.zeros((len(size), LEADING))
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                x, length = unit_vectors([data[i] for i in at], wide)
                x = x / length[:, None]
                y[at, : min(n, LEADING)] = x @ turn[n] if n in turn else x[:, :LEADING]
            cells = np.floor(y / (epsilon / FINENESS)).astype(np.int32)
            offsets = pa.array(np.arange(0, y.size + 1, LEADING, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("uid", "copies", "size", "data")),
                    pa.ListArray.from_arrays(offsets, pa.array(y.ravel())),
                    pa.ListArray.from_arrays(offsets, pa.array(cells.ravel())),
                ],
                ["uid", "copies", "size", "data", "y", "cells"],
            )

    return run


def _near(pairs: DataFrame, boxes: DataFrame, epsilon: float) -> DataFrame:
    """Of pairs (i, j) of intervals those whose boxes (k, lo, hi) are not provably apart."""
    one = boxes.select(F.col("k").alias("i"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    two = boxes.select(F.col("k").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    gaps = F.zip_with(
        F.arrays_zip("lo1", "hi1"),
        F.arrays_zip("lo2", "hi2"),
        lambda a, b: F.greatest(a["lo1"] - b["hi2"], b["lo2"] - a["hi1"], F.lit(0.0)),
    )
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    return pairs.join(one, "i").join(two, "j").where(apart <= epsilon * epsilon * (1 + 1e-9)).select("i", "j")


def interval_pairs(boxes: DataFrame, n_intervals: int, epsilon: float) -> DataFrame:
    """Pairs i <= j of lowest intervals (boxes: k, lo, hi) that may hold close vectors, found from the top of the tree."""
    levels = [boxes]
    while n_intervals > TOP * 2 ** (len(levels) - 1):
        up = levels[-1].select(F.floor(F.col("k") / 2).alias("k"), "lo", "hi")
        levels.append(
            cut_lineage(
                up.groupBy("k").agg(
                    F.array(*(F.min(F.get("lo", F.lit(d))) for d in range(LEADING))).alias("lo"),
                    F.array(*(F.max(F.get("hi", F.lit(d))) for d in range(LEADING))).alias("hi"),
                )
            )
        )
    top = -(-n_intervals // 2 ** (len(levels) - 1))
    spark = boxes.sparkSession
    pairs = spark.range(top).select(F.col("id").alias("i"), F.explode(F.sequence("id", F.lit(top - 1).cast("long"))).alias("j"))
    pairs = _near(pairs, levels[-1], epsilon)
    for level in reversed(levels[:-1]):
        halves = pairs.select(F.explode(F.array(F.col("i") * 2, F.col("i") * 2 + 1)).alias("i"), "j")
        halves = halves.select("i", F.explode(F.array(F.col("j") * 2, F.col("j") * 2 + 1)).alias("j")).where("i <= j")
        pairs = cut_lineage(_near(halves, level, epsilon))
    return pairs


class _Forest:
    """Which vectors of a task are connected; keeps a link where it connects something new."""

    def __init__(self, n: int):
        self.parent, self.links = list(range(n)), []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def add(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[x] = y
            self.links.append((a, b))


def join_intervals(x: np.ndarray, length: np.ndarray, y: np.ndarray, left: tuple[int, int], right: tuple[int, int], cosine: float, found) -> None:
    """Join two intervals of the sorted rows (one with itself if they are the same); calls found(i, j) with the positions of links."""
    epsilon = math.sqrt(2 - 2 * cosine)
    unit = (x / length[:, None]).astype(np.float32)
    boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        if span not in boxes:
            part = y[span[0] : span[1]]
            boxes[span] = part.min(axis=0), part.max(axis=0)
        return boxes[span]

    waiting = [(left, right)]
    while waiting:
        a, b = waiting.pop()
        if a[0] == a[1] or b[0] == b[1]:
            continue
        (lo1, hi1), (lo2, hi2) = box(a), box(b)
        gap = np.maximum(np.maximum(lo1 - hi2, lo2 - hi1), 0)
        if gap @ gap > epsilon * epsilon * (1 + 1e-9):
            continue
        if max(a[1] - a[0], b[1] - b[0]) > BLOCK:
            halves = [[(s, (s + e) // 2), ((s + e) // 2, e)] if e - s > BLOCK else [(s, e)] for s, e in (a, b)]
            waiting += [(p, q) for p in halves[0] for q in halves[1] if a != b or p <= q]
            continue
        i, j = np.nonzero(unit[a[0] : a[1]] @ unit[b[0] : b[1]].T >= cosine - 1e-4)
        i, j = i + a[0], j + b[0]
        if a == b:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 100_000):
            p, q = i[at : at + 100_000], j[at : at + 100_000]
            ok = np.einsum("ij,ij->i", x[p], x[q]) / (length[p] * length[q]) >= cosine
            if ok.any():
                found(p[ok], q[ok])


def _joined(cosine: float, wide: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        same = bool(rows["i"].iloc[0] == rows["j"].iloc[0])
        uid, copies, side = (rows[c].to_numpy() for c in ("uid", "copies", "side"))
        counts, forest = np.zeros(len(rows), np.int64), _Forest(len(rows))
        for size in sorted(rows["size"].unique()):
            at = np.flatnonzero(rows["size"].to_numpy() == size)
            x, length = unit_vectors(rows["data"].iloc[at].tolist(), wide)
            y = np.stack(rows["y"].iloc[at].to_numpy())

            def found(i: np.ndarray, j: np.ndarray, at: np.ndarray = at) -> None:
                i, j = at[i], at[j]
                np.add.at(counts, i, copies[j])
                np.add.at(counts, j, copies[i])
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    forest.add(a, b)

            cut = len(at) if same else int((side[at] == 0).sum())
            spans = ((0, cut), (0, cut)) if same else ((0, cut), (cut, len(at)))
            join_intervals(x, length, y, *spans, cosine, found)
        some = np.flatnonzero(counts)
        links = np.array(forest.links, np.int64).reshape(-1, 2)
        return pd.DataFrame(
            {
                "a": np.concatenate([uid[some], uid[links[:, 0]]]),
                "b": np.concatenate([uid[some], uid[links[:, 1]]]),
                "n": np.concatenate([counts[some], np.zeros(len(links), np.int64)]),
            }
        )

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Per row of `df`: vec_id, n_links, component_id, kept.

    n_links counts the other rows linked directly, component_id is the least id reachable by
    links, itself included, kept whether it is the row's own. A vector that is null, empty,
    zero, or holds a null or a number that is not finite links with nothing, and vectors
    link only with those of as many components. Rows repeated under one id are vectors of
    their own; a null id is never the least, and a component of null ids has none (and is
    kept). An empty table gives no rows. A NaN link cannot arise: unusable vectors are set
    aside first.
    """
    element = df.schema[vector_col].dataType
    wide = not (isinstance(element, T.ArrayType) and isinstance(element.elementType, T.FloatType))
    epsilon = math.sqrt(2 - 2 * cosine)
    rows = rows_of(df, vec_id=id_col, embedding=vector_col).mapInArrow(_usable(wide), "vec_id long, size int, data binary")
    rows = cut_lineage(rows.select("*", F.monotonically_increasing_id().alias("row_id"), F.sha2("data", 256).alias("key")))
    distinct = rows.where("size > 0").groupBy("key", "size").agg(
        F.min("row_id").alias("uid"), F.count("*").alias("copies"), F.first("data").alias("data")
    )
    distinct = cut_lineage(distinct)
    turn = principal_directions(distinct, wide)
    placed = distinct.select("uid", "copies", "size", "data").mapInArrow(
        _placed(turn, epsilon, wide), "uid long, copies long, size int, data binary, y array<double>, cells array<int>"
    )
    placed = cut_lineage(placed.orderBy("size", "cells", "uid").withColumn("at", F.monotonically_increasing_id()))
    parts = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    order = Window.orderBy("part")
    starts = parts.select("part", "first", (F.sum("n").over(order) - F.col("n")).alias("start"))
    ranked = placed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(starts), "part")
    ranked = ranked.select("uid", "copies", "size", "data", "y", (F.col("at") - F.col("first") + F.col("start")).alias("rank"))
    ranked = ranked.withColumn("k", F.floor(F.col("rank") / INTERVAL))
    boxes = cut_lineage(
        ranked.groupBy("k").agg(
            F.array(*(F.min(F.get("y", F.lit(d))) for d in range(LEADING))).alias("lo"),
            F.array(*(F.max(F.get("y", F.lit(d))) for d in range(LEADING))).alias("hi"),
        )
    )
    pairs = cut_lineage(interval_pairs(boxes, boxes.count(), epsilon))
    sides = pairs.select("i", "j", F.col("i").alias("k"), F.lit(0).alias("side")).union(
        pairs.where("i < j").select("i", "j", F.col("j").alias("k"), F.lit(1).alias("side"))
    )
    tasks = ranked.join(sides, "k").select("i", "j", "side", "rank", "uid", "copies", "size", "data", "y")
    found = cut_lineage(tasks.groupBy("i", "j").applyInPandas(_joined(cosine, wide), "a long, b long, n long"))
    links = found.groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("links"))
    near = components(found.select("a", "b")).select(F.col("node").alias("uid"), "component")
    known = distinct.select("key", "size", "uid", "copies").join(links, "uid", "left").join(near, "uid", "left")
    full = rows.select("vec_id", "key", "size").join(known, ["key", "size"], "left").select(
        "vec_id", F.coalesce("component", "uid").alias("group"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links")
    )
    least = full.where(F.col("group").isNotNull()).groupBy("group").agg(F.min("vec_id").alias("least"))
    named = full.join(least, "group", "left").withColumn("component_id", F.when(F.col("group").isNull(), F.col("vec_id")).otherwise(F.col("least")))
    return named.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
