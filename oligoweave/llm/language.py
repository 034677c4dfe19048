"""Language identification by character models with interpolated Kneser-Ney smoothing.

For each language a model of the characters of words (order 5, between a start and an end
mark) is learnt from a bounded sample of labelled documents. The models are kept together
in sorted arrays of n-gram hashes with one column of log probabilities per language, so a
lookup serves all languages. A text gets the language of least cross-entropy per
character, and is rejected where even that is far above what the language's own documents
reach.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oligoweave.llm.common import rows_of

ORDER = 5
#: Documents learnt from per language at most, the first by a hash of their id; one in CALIBRATION only sets the rejection.
DOCS_PER_LANGUAGE = 1000
CALIBRATION = 5
#: Rejected beyond so many times the distance that this share of calibration documents keeps.
KEPT_SHARE, SLACK = 0.999, 1.5
#: Nats a character above the language's middle that are never a reason to reject, so that a few odd words are not.
LEAST_REACH = 0.75
UNKNOWN = "und"
START, END = "\x02", "\x03"
WORD = re.compile(r"[^\W\d_]+")
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased (a run may hold a number sign without digits, such as a fraction)."""
    return WORD.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for word in words for c in word)


def _spread(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit numbers."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def window_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For k = 0 .. ORDER: the hash of the k characters that end at each position."""
    out = [np.zeros(len(codes), np.uint64)]
    mixed = _spread(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for k in range(1, ORDER + 1):
        moved = np.zeros_like(mixed)
        moved[k - 1 :] = mixed[: max(0, len(mixed) - k + 1)]
        out.append(_spread(out[-1] + moved * np.uint64(2 * k + 0x632BE59BD9B4E019)))
    return out


def gram_hashes(grams: list[str], k: int) -> np.ndarray:
    if not grams:
        return np.empty(0, np.uint64)
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
    return window_hashes(codes)[k][k - 1 :: k] if k else np.zeros(len(grams), np.uint64)


@dataclass
class Models:
    """Per order: sorted n-gram hashes with log probabilities, sorted history hashes with log back-off weights, a column per language."""

    languages: list[str]
    grams: list[np.ndarray]
    log_p: list[np.ndarray]
    histories: list[np.ndarray]
    back_off: list[np.ndarray]
    log_floor: np.ndarray
    mean: np.ndarray
    reach: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word and its end, a row per word and a column per language."""
        padded = [START + word + END for word in words]
        codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, padded), np.int64, len(padded))
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.arange(len(codes))
        room = np.minimum(at - first + 1, ORDER)
        hashes = window_hashes(codes)
        total = np.zeros((len(codes), len(self.languages)))
        open_ = np.flatnonzero(room > 1)
        for k in range(ORDER, 0, -1):
            here = open_[room[open_] >= k]
            keys, wanted = self.grams[k], hashes[k][here]
            slot = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
            hit = keys[slot] == wanted if len(keys) else np.zeros(len(here), bool)
            total[here[hit]] += self.log_p[k][slot[hit]]
            missed = here[~hit]
            if k > 1 and len(self.histories[k]) and len(missed):
                before = hashes[k - 1][missed - 1]
                slot = np.minimum(np.searchsorted(self.histories[k], before), len(self.histories[k]) - 1)
                known = self.histories[k][slot] == before
                total[missed[known]] += self.back_off[k][slot[known]]
            elif k == 1:
                total[missed] += self.log_floor
            open_ = np.concatenate([open_[room[open_] < k], missed]) if k > 1 else missed
        return np.add.reduceat(total, np.cumsum(lengths) - lengths) if len(words) else total


class Scorer:
    """Cross-entropies of texts, with the scores of words remembered (the memory is emptied when full)."""

    def __init__(self, models: Models, limit: int = 300_000):
        self.models, self._limit = models, limit
        self._at: dict[str, int] = {}
        self._scores = np.empty((0, len(models.languages)))

    def of(self, texts: list[list[str]]) -> list[tuple[np.ndarray, int]]:
        """Per list of words: cross-entropy per character for each language, and the characters."""
        counted = [Counter(words) for words in texts]
        if len(self._at) > self._limit:
            self._at, self._scores = {}, self._scores[:0]
        new = sorted({w for c in counted for w in c if w not in self._at})
        if new:
            self._at.update(zip(new, range(len(self._at), len(self._at) + len(new)), strict=True))
            self._scores = np.concatenate([self._scores, *(self.models.word_scores(new[i : i + 20_000]) for i in range(0, len(new), 20_000))])
        out = []
        for c in counted:
            times = np.fromiter(c.values(), float, len(c))
            rows = self._scores[np.fromiter(map(self._at.__getitem__, c), np.int64, len(c))]
            n = sum(len(w) * k + k for w, k in c.items())
            out.append((-(times @ rows) / max(n, 1), n))
        return out


def held_out(id_col: str) -> Column:
    """Documents that nothing is learnt from; a null id is not one of them, and not learnt from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _sample(rows: DataFrame, docs_per_language: int) -> DataFrame:
    """lang, text, calibrate of a bounded sample: the first documents of each language by a hash of the id.

    The hash that the last of them has is found on ids alone; only texts up to it are read.
    """
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    keyed = usable.withColumn("key", F.xxhash64("doc_id", F.lit("language")))
    first = Window.partitionBy("lang").orderBy("key")
    cuts = (
        keyed.select("lang", "key")
        .withColumn("nth", F.row_number().over(first))
        .where(F.col("nth") <= docs_per_language)
        .groupBy("lang")
        .agg(F.max("key").alias("last"))
    )
    kept = keyed.join(cuts, "lang").where(F.col("key") <= F.col("last"))
    return kept.select("lang", "text", (F.pmod(F.col("key"), F.lit(CALIBRATION)) == 0).alias("calibrate"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for word, n in Counter(words_of(text)).items():
                counts[lang, word] += n
        grams: Counter = Counter()
        for (lang, word), n in counts.items():
            padded = START + word + END
            for end in range(2, len(padded) + 1):
                for start in range(max(0, end - ORDER), end):
                    grams[lang, padded[start:end]] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in grams], pa.string()), pa.array([k[1] for k in grams], pa.string()), pa.array(grams.values(), pa.int64())],
            ["lang", "gram", "n"],
        )


def build(counts: pd.DataFrame) -> Models:
    """Models from the counts of all n-grams: lang, gram, n."""
    languages = sorted(counts["lang"].unique())
    wide = counts.pivot_table(index="gram", columns="lang", values="n", aggfunc="sum", fill_value=0).reindex(columns=languages)
    lengths = wide.index.str.len()
    raw = {k: wide[lengths == k] for k in range(1, ORDER + 1)}
    grams, log_p = [np.empty(0, np.uint64)], [np.empty((0, len(languages)))]
    histories, back_off = [np.empty(0, np.uint64)] * 2, [np.empty((0, len(languages)))] * 2
    alphabet = len(raw[1]) + 1
    lower, log_floor = None, None
    for k in range(1, ORDER + 1):
        own = raw[k].astype(float)
        if k < ORDER:
            longer = raw[k + 1] > 0
            continued = longer.groupby(longer.index.str[1:]).sum().reindex(own.index, fill_value=0).astype(float)
            own = own.where(np.repeat(np.asarray(own.index.str.startswith(START), bool)[:, None], len(languages), 1), continued)
        ones, twos = (own == 1).sum(), (own == 2).sum()
        discount = (ones / (ones + 2 * twos).clip(lower=1)).clip(lower=0.1, upper=0.95).to_numpy()
        groups = own.groupby(own.index.str[:-1])
        sums, types = groups.sum(), (own > 0).groupby(own.index.str[:-1]).sum()
        weight = (discount * types / sums.where(sums > 0)).fillna(1.0)
        before = own.index.str[:-1]
        total = sums.loc[before].to_numpy()
        rest = np.full(own.shape, 1 / alphabet) if lower is None else lower.loc[own.index.str[1:]].to_numpy()
        if lower is None:
            log_floor = np.log(weight.to_numpy()[0] / alphabet)
        seen = np.divide(np.maximum(own.to_numpy() - discount, 0), total, out=np.zeros(own.shape), where=total > 0)
        lower = pd.DataFrame(seen + weight.loc[before].to_numpy() * rest, index=own.index, columns=languages)
        keys = gram_hashes(list(own.index), k)
        order = np.argsort(keys)
        grams.append(keys[order])
        log_p.append(np.log(lower.to_numpy()[order]))
        if k > 1:
            keys = gram_hashes(list(weight.index), k - 1)
            order = np.argsort(keys)
            histories.append(keys[order])
            back_off.append(np.log(weight.to_numpy()[order]))
    none = np.zeros(len(languages))
    return Models(languages, grams, log_p, histories, back_off, log_floor, none, none + np.inf)


def stretch(n: np.ndarray) -> np.ndarray:
    """How much further from the mean a text of n characters may lie."""
    return 1 + 10 / np.sqrt(np.maximum(n, 1))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> Models | None:
    """Models and their rejection limits from a bounded sample of labelled rows; None where no row is labelled.

    What comes to the driver are n-gram counts and calibration figures of the sample, so it
    is bounded by `docs_per_language`.
    """
    sample = _sample(rows_of(df, doc_id=id_col, text=text_col, lang=lang_col), docs_per_language)
    counts = sample.where("not calibrate").select("lang", "text").mapInArrow(_count, "lang string, gram string, n long")
    found = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    if found.empty:
        return None
    models = build(found)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models)
        place = {lang: i for i, lang in enumerate(models.languages)}
        for batch in batches:
            langs, words = batch.column("lang").to_pylist(), [words_of(x) for x in batch.column("text").to_pylist()]
            got = [(lang, x[0][place[lang]], x[1]) for lang, x in zip(langs, scorer.of(words), strict=True) if x[1] and lang in place]
            columns = zip(*got, strict=True) if got else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.float64(), pa.int64()), strict=True)], ["lang", "ce", "n"])

    figures = sample.where("calibrate").select("lang", "text").mapInArrow(measure, "lang string, ce double, n long").toArrow().to_pandas()
    for i, lang in enumerate(models.languages):
        own = figures[figures["lang"] == lang]
        if len(own):
            models.mean[i] = own["ce"].median()
            far = (own["ce"] - models.mean[i]).to_numpy() / stretch(own["n"].to_numpy())
            models.reach[i] = max(SLACK * float(np.quantile(far, KEPT_SHARE)), LEAST_REACH)
    return models


def predict(df: DataFrame, models: Models | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `df`: doc_id, held_out, lang_pred, score, cross_entropy (nats a character), rejected.

    A null text or one without a letter is `und`, score 0, rejected. Without models every row
    is. Ties go to the first language by name. `rejected` marks texts beyond the calibrated
    limit of their language; they still name it. Repeated rows give equal rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models) if models else None
        for batch in batches:
            texts, out = batch.column("text").to_pylist(), []
            for at in range(0, len(texts), 500):
                words = [words_of(x or "") for x in texts[at : at + 500]]
                known = [bool(scorer) and has_letter(x) for x in words]
                got = iter(scorer.of([x for x, ok in zip(words, known, strict=True) if ok]) if scorer else [])
                out += [_verdict(models, *next(got)) if ok else (UNKNOWN, 0.0, None, True) for ok in known]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))],
                ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    rows = rows_of(df, doc_id=id_col, text=text_col).select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(run, PREDICTED)


def _verdict(models: Models, entropy: np.ndarray, n: int) -> tuple[str, float, float, bool]:
    best = int(np.argmin(entropy))
    score = 1 / np.exp(-(entropy - entropy[best]) * min(n, 60)).sum()
    limit = models.mean[best] + models.reach[best] * float(stretch(np.array(n)))
    return models.languages[best], float(score), float(entropy[best]), bool(entropy[best] > limit)


def accepted(df: DataFrame, models: Models | None, text_col: str = "text") -> DataFrame:
    """The rows of `df` that no model rejects, columns as they are."""

    @F.pandas_udf("boolean")
    def keeps(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(models) if models else None
        for texts in batches:
            kept = []
            for at in range(0, len(texts), 500):
                words = [words_of(x or "") for x in texts[at : at + 500]]
                for x in words if scorer else []:
                    kept.append(has_letter(x) and not _verdict(models, *scorer.of([x])[0])[3])
                kept += [] if scorer else [False] * len(words)
            yield pd.Series(kept, dtype="bool")

    return df.where(keeps(F.col(text_col)))
