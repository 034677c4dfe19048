"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Emails, addresses, card and phone numbers are found by their form; they are the seeds. The
words around an occurrence are its contexts. Spark keeps the graph of contexts and values
over the whole corpus: a context is as good as the share of its values that are known, a
value as good as its contexts together, and a few rounds let good contexts vouch for values
of no known form. Values that reach the threshold become spans of kind `id`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oligoweave.llm.common import rows_of, text_or_empty
from oligoweave.llm.spans import Covered, sha256_of, with_added, written, written_column
from oligoweave.session import cut_lineage

ROUNDS = 3
#: Known values that a context needs, the share of its values that must be known, and the score that makes a value known.
LEAST_KNOWN, LEAST_SHARE, LEAST_SCORE = 3, 0.7, 0.7
#: Digits that a value of no known form has at least.
LEAST_DIGITS = 4

KINDS = ("email", "ip", "card", "phone", "id")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A start inside a run of digits fails as the start of the run does, so only the latter is tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOOSE = re.compile(r"(?<![A-Za-z0-9._/-])(?=[A-Za-z._/-]*[0-9])[A-Za-z0-9._/-]+")
WORD = re.compile(r"[^\W\d_]+")

OCCURRENCE = "struct<nth:int, kind:string, start:long, end:long, value:binary, contexts:array<string>>"
FOUND = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "spans array<struct<nth:int, kind:string, start:long, end:long>>, occurrences array<" + OCCURRENCE + ">"
)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for x in digits[-2::-2]:
        total += (2 * int(x)) % 10 + int(x) // 5
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from the @ signs: the run of local characters before one, the domain after."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            out.append((start, free))
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return out


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, str, int, int]]:
    out = [(0, "email", *x) for x in emails(text)]
    if DIGIT.search(text):
        out += [(1, "ip", *m.span()) for m in IP.finditer(text) if all(map(small_part, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, "card", *m.span()))
        if "+" in text:
            out += [(3, "phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def loose_values(text: str, base: list[tuple]) -> list[tuple[int, str, int, int]]:
    """Values with digits outside the base spans."""
    if not DIGIT.search(text):
        return []
    out, covered = [], Covered([(x[2], x[3]) for x in base])
    for m in LOOSE.finditer(text):
        value = m[0].rstrip("._/-")
        start = m.start() + len(value) - len(value.lstrip("._/-"))
        end = m.start() + len(value)
        if len(DIGIT.findall(value)) >= LEAST_DIGITS and not covered.meets(start, end):
            out.append((4, "id", start, end))
    return out


def words_before(text: str, start: int, n: int) -> list[str]:
    """The last n words before a place, whole ones however long they are."""
    size = 80
    while True:
        words = WORD.findall(text[max(0, start - size) : start].lower())
        if len(words) > n or size >= start:
            return words[-n:]
        size *= 4


def words_after(text: str, end: int, n: int) -> list[str]:
    """The first n words after a place, whole ones however long they are."""
    size = 40
    while True:
        words = WORD.findall(text[end : end + size].lower())
        if len(words) > n or end + size >= len(text):
            return words[:n]
        size *= 4


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: the two words before it, the word before and the word after."""
    before, after = words_before(text, start, 2), words_after(text, end, 1)
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["nth", "kind", "start", "end", "value", "contexts"]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string())]
    span_kind = pa.list_(pa.struct(list(zip(names[:4], kinds[:4], strict=True))))
    occurrence_kind = pa.list_(pa.struct(list(zip(names, kinds, strict=True))))
    for batch in batches:
        counts, shas, spans, places = [], [], [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            counts.append(tuple(sum(x[0] == k for x in base) for k in range(4)))
            shas.append(sha256_of(written(base)))
            spans.append([dict(zip(names, x, strict=False)) for x in base])
            own = []
            for x in [*base, *loose_values(text, base)]:
                value = hashlib.sha256(text[x[2] : x[3]].encode()).digest()[:16]
                own.append(dict(zip(names, (*x, value, contexts(text, x[2], x[3])), strict=True)))
            places.append(own)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)),
                pa.array(shas, pa.string()),
                pa.array(spans, span_kind),
                pa.array(places, occurrence_kind),
            ],
            ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "occurrences"],
        )


def bootstrap(
    edges: DataFrame, rounds: int = ROUNDS, least_known: int = LEAST_KNOWN, least_share: float = LEAST_SHARE, least_score: float = LEAST_SCORE
) -> DataFrame:
    """Values (value, score) that contexts vouch for; edges: context, value, seed (whether the value's form is known).

    A context scores the share of its values that are known, if enough of them are; a value
    scores one minus the product of what its contexts leave open. Each round is a written
    table; sums combine before they shuffle, and only good contexts are joined back.
    """
    known = edges.groupBy("value").agg(F.max("seed").alias("seed")).where("seed").select("value", F.lit(1.0).alias("score"))
    seeds = known
    for _ in range(rounds):
        scored = edges.join(known, "value", "left")
        good = (
            scored.groupBy("context")
            .agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("known"), F.count("*").alias("n"))
            .where((F.col("known") >= least_known) & (F.col("known") >= least_share * F.col("n")))
            .select("context", (F.col("known") / (F.col("n") + 1)).alias("share"))
        )
        found = (
            edges.join(good, "context")
            .groupBy("value")
            .agg((1 - F.exp(F.sum(F.log1p(-F.col("share"))))).alias("score"))
            .where(F.col("score") >= least_score)
            .join(seeds, "value", "left_anti")
        )
        known = cut_lineage(seeds.unionByName(found))
    return known.join(seeds, "value", "left_anti")


def personal_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per row of `df`: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id, n_spans (of all kinds).

    `spans` holds the base spans and the discovered ones, by kind and start. Null text counts
    as empty; repeated rows give equal rows; null ids stay null. What was found is a written
    table; the texts are read once and not shuffled.
    """
    rows = rows_of(df, doc_id=id_col, text=text_col).withColumn("text", text_or_empty())
    found = cut_lineage(rows.mapInArrow(_scan, FOUND).withColumn("row_id", F.monotonically_increasing_id()))
    places = found.select("row_id", F.inline("occurrences"))
    edges = cut_lineage(
        places.select(F.explode("contexts").alias("context"), "value", (F.col("kind") != "id").alias("seed"))
        .groupBy("context", "value")
        .agg(F.max("seed").alias("seed"))
    )
    new = bootstrap(edges, rounds)
    added = places.where("kind = 'id'").join(new.select("value"), "value", "left_semi").select("row_id", "nth", "kind", "start", "end")
    full = with_added(found.drop("occurrences"), added, ["nth", "start"])
    n_id = F.size(F.filter("spans", lambda s: s["kind"] == "id")).cast("long").alias("n_id")
    return full.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", written_column(F.col("spans")).alias("spans"), n_id,
        F.size("spans").cast("long").alias("n_spans"),
    )
