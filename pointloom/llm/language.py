"""Operator 6: languages of a text as a mixture, inferred by expectation-maximisation.

Each language has a distribution over character trigrams, counted over all texts to learn from. A text is taken as
drawn from a mixture of these; EM finds the languages' proportions. The set of languages
grows from the best one, by the first candidate, steepest gain first, whose likelihood pays for the penalty of one more
language (BIC), until none does. However small a share, the penalty alone decides.

Trigrams fall into a fixed number of buckets, so the model's size is languages x BUCKETS, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.common import id_bucket, in_small_batches, table

BUCKETS = 1 << 16
#: EM ends once no proportion changes by more than EM_CLOSE in a step, or after EM_STEPS.
EM_STEPS, EM_CLOSE = 500, 1e-5
#: Weight of a bucket's share over all languages in each language's share, in trigrams.
PRIOR = 2000.0
#: BIC counts independent observations; trigrams of one word overlap, so about one in three counts.
OVERLAP = 3.0
UNDETERMINED = "und"


def trigram_buckets(text: str) -> np.ndarray:
    """Bucket of each trigram of the lower-cased text, in which each run of other than letters is one space; empty without letters."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    small = codes < len(_LETTER)
    letter = np.where(small, _LETTER[np.where(small, codes, 0)], True)
    if not small.all():  # beyond the table: ask Python, once for each distinct character
        far, where = np.unique(codes[~small], return_inverse=True)
        letter[~small] = np.array([chr(c).isalpha() for c in far])[where]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.where(letter, codes, np.uint32(32))
    codes = codes[np.r_[True, letter[1:] | letter[:-1]]].astype(np.uint64)
    h = codes[:-2] * np.uint64(0x9E3779B185EBCA87) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)


_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    shares: np.ndarray  # buckets x languages

    def fit(self, n: np.ndarray, p: np.ndarray, chosen: list[int]) -> tuple[np.ndarray, float]:
        """Proportions of the chosen languages and the log-likelihood."""
        p, total = p[:, chosen], n.sum()
        share = np.full(len(chosen), 1 / len(chosen))
        for _ in range(EM_STEPS if len(chosen) > 1 else 0):
            mix = p * share
            before, share = share, (n / mix.sum(1)) @ mix / total
            if np.abs(share - before).max() < EM_CLOSE:
                break
        return share, float(n @ np.log(p @ share))

    def infer(self, text: str | None) -> dict[str, float]:
        """Language to its proportion, for the set of least penalised likelihood; empty for a text without letters."""
        buckets = trigram_buckets(text) if text else ()
        if not len(buckets) or not self.languages:
            return {}
        if len(buckets) < 500:
            which, n = np.unique(buckets, return_counts=True)
        else:
            which = (n := np.bincount(buckets)).nonzero()[0]
            n = n[which]
        p, n = self.shares[which], n / OVERLAP
        alone = n @ np.log(p)
        chosen = [int(alone.argmax())]
        share, best = np.ones(1), float(alone[chosen[0]])
        penalty = 0.5 * np.log(n.sum() + 1) + 1
        grown = True
        while grown:
            # The likelihood is concave in a new language's proportion: it gains no more than its slope at 0.
            slope = (n / (p[:, chosen] @ share)) @ p - n.sum()
            slope[chosen] = -np.inf
            grown = False
            for k in (int(k) for k in np.argsort(-slope, kind="stable") if slope[k] > penalty):
                more, value = self.fit(n, p, [*chosen, k])
                if grown := value - penalty > best:
                    chosen, share, best = [*chosen, k], more, value
                    break
        return {self.languages[k]: float(s) for k, s in zip(chosen, share, strict=True)}


def train_language_model(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts trigrams over every row that has a text and a language. One language's count of one bucket is one row at
    most, so what reaches the driver is bounded by languages x BUCKETS."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, words in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                found = trigram_buckets(words)
                if language not in by:
                    by[language] = np.zeros(BUCKETS, np.int64)
                by[language] += np.bincount(found, minlength=BUCKETS)
        for language, n in by.items():
            which = n.nonzero()[0]
            yield pa.record_batch([pa.array([language] * len(which), pa.string()), pa.array(which), pa.array(n[which])], ["lang", "bucket", "n"])

    rows = (
        in_small_batches(docs).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
        .select(F.col(lang).cast("string"), text)
        .mapInArrow(counts, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = tuple(sorted(rows["lang"].unique()))
    n = np.zeros((BUCKETS, len(languages)))
    n[rows["bucket"], rows["lang"].map({x: k for k, x in enumerate(languages)})] = rows["n"]
    together = (n / np.maximum(n.sum(0), 1)).mean(1) if languages else np.zeros(BUCKETS)
    together = 0.99 * together + 0.01 / BUCKETS
    return Model(languages, ((n + PRIOR * together[:, None]) / (n.sum(0) + PRIOR)).astype(np.float64))


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType()))])


def predict_languages(docs: DataFrame, model: Model, text: str = "text", column: str = "language") -> DataFrame:
    """docs with a column, in place of one of that name: (lang_pred, score, mixture).

    lang_pred is the language of the largest proportion in the chosen set, score its proportion (ties: first by name);
    mixture has every chosen language. A null text, or one without a letter, is `und` with score 0 and an empty
    mixture; so is every text if there was nothing to learn from. Other columns are kept.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def infer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("mixture", pa.map_(pa.string(), pa.float64()))])
        for texts in batches:
            rows = []
            for x in texts:
                mixture = sent.value.infer(x.as_py())
                top = min(mixture, key=lambda k: (-mixture[k], k), default=UNDETERMINED)
                rows.append({"lang_pred": top, "score": min(1.0, mixture.get(top, 0.0)), "mixture": list(mixture.items())})
            yield pa.array(rows, kind)

    infer.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return in_small_batches(docs).withColumn(column, F.arrow_udf(infer, PREDICTED)(F.col(text)))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = id_bucket("doc_id", 4) == 2
    model = train_language_model(docs.where(~held))
    found = predict_languages(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held.alias("held_out"), "language.lang_pred", "language.score", F.array_join(F.array_sort(F.map_keys("language.mixture")), ",").alias("languages")
    )
