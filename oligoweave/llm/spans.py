"""Writing spans of texts as strings, and joining spans that Spark decides on to their documents."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<nth:int, kind:string, start:long, end:long>"


def written(spans: list[tuple[int, str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for _, kind, start, end in spans)


class Covered:
    """Places that spans take up; asking whether a span meets one takes a search, however many there are."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self._starts = [a for a, _ in spans]
        self._reach = list(accumulate((b for _, b in spans), max))

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self._starts, end)
        return before > 0 and self._reach[before - 1] > start


def sha256_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def written_column(spans: Column) -> Column:
    """The same for an array of spans, in its order."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def with_added(found: DataFrame, added: DataFrame, order: list[str]) -> DataFrame:
    """Merge added spans (row_id and the fields of SPAN) into the array `spans` of each row, sorted by `order`."""
    more = added.groupBy("row_id").agg(F.collect_list(F.struct("nth", "kind", "start", "end")).alias("more"))
    both = F.concat("spans", F.coalesce("more", F.array().cast(f"array<{SPAN}>")))
    key = [*order, *(x for x in ("nth", "kind", "start", "end") if x not in order)]
    keyed = F.array_sort(F.transform(both, lambda s: F.struct(*(s[x].alias(x) for x in key))))
    return found.join(more, "row_id", "left").withColumn("spans", keyed).drop("more")
