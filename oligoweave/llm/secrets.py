"""Secret scans with corpus-wide ownership.

Each whole text is searched for credentials: assignments, access keys, long hex numbers,
and loose tokens that mix letters and digits like a generated key. The values are hashed,
and Spark counts, over all documents, in how many repositories and of how many owners each
value stands. A value of many owners or in many repositories is an example that people copy;
one of few owners and repositories that looks generated is a live credential. Loose tokens
become spans only if they are live. Owners are the `source` of a document, repositories the
distinct texts, so copies of a document are one repository.
"""

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oligoweave.llm.common import free_names, rows_of, text_or_empty
from oligoweave.llm.spans import Covered, sha256_of, with_added, written, written_column
from oligoweave.session import cut_lineage

#: More owners than this make a value an example.
MOST_OWNERS = 3
#: So do more repositories than this, also of one owner.
MOST_REPOSITORIES = 10
#: Bits a character that a live-looking value has at least.
LEAST_BITS = 2.5

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LOOSE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your[_-]?|xxxx|1234567|abcdef", re.IGNORECASE)

CANDIDATE = "struct<nth:int, kind:string, start:long, end:long, from:long, to:long, value:binary, likely:boolean>"
FOUND = (
    "doc_id long, text_key long, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, "
    "spans array<struct<nth:int, kind:string, start:long, end:long>>, candidates array<" + CANDIDATE + ">"
)


def bits(value: str) -> float:
    """Entropy of the characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str) -> bool:
    return bits(value) >= LEAST_BITS and not PLACEHOLDER.search(value)


def base_spans(text: str) -> list[tuple[int, str, int, int, int, int]]:
    """(number of the kind, kind, start, end, start and end of the value), by start and kind.

    A hex or access match is a whole run of its characters, so the least length can stand
    in the pattern: a run that is too short fails at each of its starts.
    """
    out, low = [], text.lower()
    if any(x in low for x in WORDS):
        out += [(0, "assign", *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(1, "access", *m.span(), *m.span()) for m in ACCESS.finditer(text)]
    out += [(2, "hex", *m.span(), *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[2], x[0]))


def loose_tokens(text: str, base: list[tuple]) -> list[tuple[int, str, int, int, int, int]]:
    """Runs of key characters outside the base spans, with small and capital letters and digits."""
    out, covered = [], Covered([(x[2], x[3]) for x in base])
    for m in LOOSE.finditer(text):
        a, b = m.span()
        value = m[0]
        mixed = any(c.isdigit() for c in value) and any("a" <= c <= "z" for c in value) and any("A" <= c <= "Z" for c in value)
        if mixed and not covered.meets(a, b):
            out.append((3, "token", a, b, a, b))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["nth", "kind", "start", "end", "from", "to", "value", "likely"]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    span_kind = pa.list_(pa.struct(list(zip(names[:4], kinds[:4], strict=True))))
    candidate_kind = pa.list_(pa.struct(list(zip(names, kinds, strict=True))))
    for batch in batches:
        counts, shas, spans, candidates = [], [], [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            counts.append(tuple(sum(x[0] == k for x in base) for k in range(3)))
            shas.append(sha256_of(written([x[:4] for x in base])))
            spans.append([dict(zip(names, x[:4], strict=False)) for x in base])
            own = []
            for x in [*base, *loose_tokens(text, base)]:
                value = text[x[4] : x[5]]
                own.append(dict(zip(names, (*x, hashlib.sha256(value.encode()).digest()[:16], looks_live(value)), strict=True)))
            candidates.append(own)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(x) for x in ("doc_id", "text_key", "owner")),
                *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)),
                pa.array(shas, pa.string()),
                pa.array(spans, span_kind),
                pa.array(candidates, candidate_kind),
            ],
            ["doc_id", "text_key", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "candidates"],
        )


def ownership(uses: DataFrame) -> DataFrame:
    """value, n_uses, n_repositories, n_owners from uses (value, owner, repository).

    Each level adds up before it shuffles; a value that stands everywhere is one row per
    task, then one row per owner.
    """
    by_repository = uses.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("value", "owner").agg(F.sum("n").alias("n"))
    owners = by_owner.groupBy("value").agg(F.sum("n").alias("n_uses"), F.count("*").alias("n_owners"))
    repositories = uses.select("value", "repository").distinct().groupBy("value").agg(F.count("*").alias("n_repositories"))
    return owners.join(repositories, "value").select("value", "n_uses", "n_repositories", "n_owners")


def scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", most_owners: int = MOST_OWNERS,
    most_repositories: int = MOST_REPOSITORIES,
) -> tuple[DataFrame, DataFrame]:
    """Two frames: documents, and the judged candidates of each document.

    Documents, one per row of `df`: row_id, doc_id, text_key, n_assign, n_access, n_hex,
    base_sha256, spans (base spans). Candidates: row_id, doc_id, text_key, the span (nth,
    kind, start, end), the value's place (from, to), n_uses, n_repositories, n_owners,
    live. Null text counts as empty, a null owner is an owner; rows of one text are uses of
    one repository. Only what was found is written and shuffled,
    not the texts.
    """
    rows = rows_of(df, doc_id=id_col, text=text_col, owner=owner_col).withColumn("text", text_or_empty())
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "owner", "text")
    found = cut_lineage(rows.mapInArrow(_scan, FOUND).withColumn("row_id", F.monotonically_increasing_id()))
    uses = found.select("row_id", "doc_id", "text_key", "owner", F.inline("candidates"))
    seen = ownership(uses.select("value", "owner", F.col("text_key").alias("repository")))
    few = seen.where((F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories))
    judged = uses.join(few, "value", "left").withColumn("live", F.col("likely") & F.col("n_owners").isNotNull()).drop("value", "owner", "likely")
    return found.drop("owner", "candidates"), judged


def secret_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", most_owners: int = MOST_OWNERS,
    most_repositories: int = MOST_REPOSITORIES,
) -> DataFrame:
    """Per row of `df`: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    `spans` holds the base spans and the live loose tokens, by start and kind; n_live and
    n_copied count the candidates that look live and those of more owners or repositories than a secret has.
    """
    found, judged = scan(df, id_col, text_col, owner_col, most_owners, most_repositories)
    counts = judged.groupBy("row_id").agg(
        F.count_if("live").alias("n_live"), F.count_if(F.col("n_owners").isNull()).alias("n_copied")
    )
    added = judged.where("live and kind = 'token'").select("row_id", "nth", "kind", "start", "end")
    full = with_added(found, added, ["start", "nth"]).join(counts, "row_id", "left")
    return full.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", written_column(F.col("spans")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


MASK = "[SECRET]"


def masked(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", most_owners: int = MOST_OWNERS,
    most_repositories: int = MOST_REPOSITORIES,
) -> DataFrame:
    """`df` with each live value of its texts replaced by a mask; other rows and columns as they are."""
    _, judged = scan(df, id_col, text_col, owner_col, most_owners, most_repositories)
    live_doc, live_key, live_places, key = free_names(df, "live_doc", "live_key", "live_places", "live_text_key")
    places = (
        judged.where("live")
        .groupBy("doc_id", "text_key")
        .agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("places"))
        .select(F.col("doc_id").alias(live_doc), F.col("text_key").alias(live_key), F.col("places").alias(live_places))
    )

    @F.pandas_udf("string")
    def mask(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, found, strict=True):
            if text is None or not len(spans):
                out.append(text)
                continue
            parts, at = [], 0
            for span in spans:
                if span["from"] >= at:
                    parts += [text[at : span["from"]], MASK]
                    at = span["to"]
                else:
                    at = max(at, span["to"])
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype="object")

    keyed = df.withColumn(key, F.xxhash64(text_or_empty(text_col)))
    same = F.col(id_col).eqNullSafe(F.col(live_doc)) & (F.col(key) == F.col(live_key))
    joined = keyed.join(places, same, "left")
    text = F.when(F.col(live_places).isNotNull(), mask(F.col(text_col), F.coalesce(live_places, F.array().cast("array<struct<from:bigint,to:bigint>>"))))
    return joined.withColumn(text_col, F.coalesce(text, F.col(text_col))).select(*df.columns)
