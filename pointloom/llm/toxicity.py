"""Operator 2: toxicity by two class-conditional Kneser-Ney models over words.

Each class has a bigram model. What is discounted from the class's counts goes to a bigram model of both classes'
counts, what is taken there to the class's lower order, and what is taken from this to the lower order that both
classes share. As Kneser and Ney ask, the lower orders count in how many contexts a word occurs, not how often. The
shared bigrams have the discount n1 / (n1 + 2 n2); a class's discount depends on the count, as in modified Kneser-Ney,
but is larger: it keeps KEPT n^3 / (n^2 + DISCOUNT^2) of n occurrences. So a rare expression says little about a class, but
something, and has its own counts in the shared models. A text's evidence is the difference of its two log-likelihoods a
word; a logistic curve, fitted on labelled rows that the models have not seen, turns it into a score.

The models learn from labelled rows of each class in the order of their id hashes, `LABELLED` of them at most and until
they have `LABELLED_BYTES` of text, and from all words and pairs of words in these. So the table of what each expression
adds to a text's evidence has a bound, and is sent to the tasks, in slices of which the driver holds one at a time.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.common import cut, id_bucket, table

LABELLED = 20_000
#: A class's texts to learn from are no more once they have so many bytes; an expression takes two at least.
LABELLED_BYTES = 1 << 23
#: Of an expression that occurs so often in the smaller class, that keeps half of what it keeps of frequent ones; for the
#: other it is as many times more as that class is larger.
DISCOUNT = 10.0
#: No more than this part of a count stays undiscounted: most of each model is shared, so what many rare expressions
#: happen to do in one class does not outweigh the few that tell.
KEPT = 0.01
#: About so many entries of the table pass the driver at once.
SLICE = 1 << 18
#: So many words, or one text's, are looked up at once.
AT_ONCE = 1 << 16
START = np.uint64(0)
HELD_OUT, CALIBRATING = (0,), (1,)
FOLDS = 5
WORD = re.compile(r"\w+")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def word_hashes(text: str | None, known: _Hashes) -> np.ndarray:
    words = WORD.findall((text or "").lower())
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


#: Kinds of the table's entries: a word itself, what a word leaves to the words after it, and a pair of words.
WORD_ENTRY, CONTEXT_ENTRY, PAIR_ENTRY = 0, 1, 2


def entry_keys(kind: int, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit hashes of the entries (kind, v, w)."""
    x = v * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(kind * 0xD1B54A32D192ED03 % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Model:
    """A text's log-likelihood ratio is a sum over its words, the words before them, and its pairs."""

    slices: tuple[Broadcast, ...]  # (keys, values) of the entries, sorted, one slice of keys after the other
    unknown: float  # what every word adds, known or not
    slope: float = 1.0
    threshold: float = 0.0

    def evidence(self, found: list[np.ndarray]) -> np.ndarray:
        """Of each text's word hashes, what all together add: per word, and 0 without words."""
        n = np.array([len(x) for x in found], np.int64)
        out = np.where(n > 0, self.unknown, 0.0)
        if n.any():  # else there is nothing to put together
            w = np.concatenate(found)
            v = np.r_[START, w[:-1]]
            v[(np.cumsum(n) - n)[n > 0]] = START
            none = np.zeros(len(w), np.uint64)
            added = sum(self._values(key) for key in (entry_keys(WORD_ENTRY, none, w), entry_keys(CONTEXT_ENTRY, v, none), entry_keys(PAIR_ENTRY, v, w)))
            out += np.bincount(np.repeat(np.arange(len(n)), n), added, len(n)) / np.maximum(n, 1)
        return out

    def _values(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key))
        of = (key >> np.uint64(64 - SLICE_BITS)).astype(np.int64) * len(self.slices) >> SLICE_BITS
        for k, sent in enumerate(self.slices):
            keys, values = sent.value
            if len(keys) and len(here := np.nonzero(of == k)[0]):
                at = np.minimum(np.searchsorted(keys, key[here]), len(keys) - 1)
                out[here] = np.where(keys[at] == key[here], values[at], 0.0)
        return out


#: Slices are ranges of the keys' first bits, of which there are so many.
SLICE_BITS = 16


def _sent(entries: DataFrame) -> tuple[Broadcast, ...]:
    """The table entries (key, value), at rest, sent to the tasks in slices."""
    slices = 1 << max(0, math.ceil(math.log2(max(entries.count(), 1) / SLICE)))
    of = F.shiftrightunsigned("key", 64 - SLICE_BITS) * slices
    out = []
    for k in range(slices):
        got = entries.where(F.shiftright(of, SLICE_BITS) == k).toPandas()
        keys, values = got["key"].to_numpy(np.int64).view(np.uint64), got["value"].to_numpy(np.float32)
        order = np.argsort(keys)
        out.append(entries.sparkSession.sparkContext.broadcast((keys[order], values[order])))
    return tuple(out)


def _counted(rows: DataFrame) -> DataFrame:
    """rows (text, toxic) to (v, w, n0, n1): how often word v is followed by w in texts of either class; START before all."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            found = [word_hashes(text, known) for text in batch[0].to_pylist()]
            pair = np.zeros(sum(map(len, found)), [("v", np.int64), ("w", np.int64)])
            if not len(pair):
                continue
            pair["w"] = np.concatenate(found).view(np.int64)
            pair["v"] = np.concatenate([np.r_[START, x[:-1]] for x in found if len(x)]).view(np.int64)
            toxic = np.repeat(batch[1].to_numpy(), [len(x) for x in found])
            yield pa.record_batch([pa.array(x) for x in (pair["v"], pair["w"], (toxic == 0).astype(np.int64), (toxic == 1).astype(np.int64))], ["v", "w", "n0", "n1"])

    return rows.select("text", F.col("toxic").cast("int")).mapInArrow(task, "v long, w long, n0 long, n1 long").groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _discounts(counts: DataFrame, *columns: str) -> list[float]:
    """Of each column the discount that Ney, Essen and Kneser estimate: n1 / (n1 + 2 n2), n1 and n2 expressions occurring once and twice."""
    found = counts.agg(*(F.count_if(F.col(c) == k) for c in columns for k in (1, 2))).first()
    return [found[2 * i] / (found[2 * i] + 2 * found[2 * i + 1]) if found[2 * i] and found[2 * i + 1] else 0.75 for i in range(len(columns))]


def train_models(rows: DataFrame, discount: float = DISCOUNT) -> Model:
    """The two models from rows (text, toxic 0 or 1), of all words and pairs of words in them."""
    pairs = cut(_counted(rows).withColumn("n", F.col("n0") + F.col("n1")))
    over = lambda n, d: F.greatest(F.col(n) - d, F.lit(0.0))
    part = lambda a, b: F.when((F.col(b) > 0) & (F.col(a) > 0), F.col(a) / F.col(b)).otherwise(0.0)


    def own(x: str, n: list[float]) -> list[Column]:
        """What each class keeps of its counts x0 and x1, of n in all: KEPT of large ones, ever less of rare ones, never nothing."""
        half = [discount * max(n[c], 1) / max(min(n), 1) for c in (0, 1)]
        return [KEPT * F.pow(f"{x}{c}", F.lit(3.0)) / (F.pow(f"{x}{c}", F.lit(2.0)) + half[c] ** 2) for c in (0, 1)]

    totals = [float(x or 0) for x in pairs.agg(F.sum("n0"), F.sum("n1")).first()]
    (d,) = _discounts(pairs, "n")
    pairs = pairs.withColumns(dict(zip(("o0", "o1"), own("n", totals), strict=True)) | {"o": over("n", d)})
    first = pairs.groupBy("v").agg(*(F.sum(x).alias(f"v_{x}") for x in ("n0", "n1", "n", "o0", "o1", "o")))
    rest = {f"rest{c}": 1 - part(f"v_o{c}", f"v_n{c}") for c in (0, 1)}
    first = cut(first.withColumns(rest).withColumn("left", 1 - part("v_o", "v_n")).withColumn("context", F.log(F.col("rest1") / F.col("rest0"))))

    # In how many contexts a word occurs, not how often.
    second = cut(pairs.groupBy("w").agg(F.count_if(F.col("n0") > 0).alias("c0"), F.count_if(F.col("n1") > 0).alias("c1"), F.count("*").alias("c")))
    contexts = [float(x or 0) for x in second.agg(F.sum("c0"), F.sum("c1")).first()]
    second = second.withColumns(dict(zip(("q0", "q1"), own("c", contexts), strict=True)))
    sums = {k: float(x or 0) for k, x in second.agg(*(F.sum(x).alias(x) for x in ("c0", "c1", "c", "q0", "q1"))).first().asDict().items()}
    lower = lambda c: F.col(f"q{c}") / max(sums[f"c{c}"], 1) + shared[c] * F.col("c") / (sums["c"] + 1)
    shared = [1 - sums[f"q{c}"] / max(sums[f"c{c}"], 1) for c in (0, 1)]
    unknown = float(np.log(shared[1] / shared[0]))
    second = cut(second.select("w", lower(0).alias("p0"), lower(1).alias("p1")).withColumn("word", F.log(F.col("p1") / F.col("p0"))))

    p = [part(f"o{c}", f"v_n{c}") + F.col(f"rest{c}") * (part("o", "v_n") + F.col("left") * F.col(f"p{c}")) for c in (0, 1)]
    both = pairs.join(first, "v").join(second, "w").select("v", "w", (F.log(p[1] / p[0]) - F.col("context") - F.col("word")).alias("value"))
    kinds = [second.select(F.lit(0).cast("long").alias("v"), "w", (F.col("word") - unknown).alias("value")), first.select("v", F.lit(0).cast("long").alias("w"), F.col("context").alias("value")), both]

    def keyed(kind: int) -> DataFrame:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v, w = (batch[i].to_numpy().view(np.uint64) for i in (0, 1))
                yield pa.record_batch([pa.array(entry_keys(kind, v, w).view(np.int64)), batch[2]], ["key", "value"])

        return kinds[kind].where("value <> 0").mapInArrow(task, "key long, value double")

    entries = cut(keyed(WORD_ENTRY).union(keyed(CONTEXT_ENTRY)).union(keyed(PAIR_ENTRY)))
    return Model(_sent(entries), unknown)


def with_evidence(docs: DataFrame, model: Model, name: str, column: str) -> DataFrame:
    """docs with a column `name`, in place of one of that name: of each text, the model's evidence (toxic less ordinary
    log-likelihood a word; 0 without words) or score."""

    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = _Hashes()
        for texts in batches:
            out, some, words = [np.empty(0)], [], 0
            for text in texts:
                some.append(word_hashes(text.as_py(), hashes))
                words += len(some[-1])
                if words > AT_ONCE:
                    out.append(model.evidence(some))
                    some, words = [], 0
            yield pa.array(np.concatenate([*out, model.evidence(some)]), pa.float64())

    measure.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = F.arrow_udf(measure, "double")(F.col("text"))
    if column == "score":
        found = 1 / (1 + F.exp(-F.least(F.greatest(model.slope * (found - model.threshold), F.lit(-30.0)), F.lit(30.0))))
    return docs.withColumn(name, found)


def calibrated(model: Model, evidence: np.ndarray, toxic: np.ndarray) -> Model:
    """Logistic regression by Newton's method, both classes weighing the same, with a small ridge on the slope."""
    if len(np.unique(toxic)) < 2:
        return model
    weight = np.where(toxic == 1, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
    middle, spread = evidence.mean(), evidence.std() + 1e-9
    x = np.c_[(evidence - middle) / spread, np.ones(len(evidence))]
    b, ridge = np.zeros(2), np.diag([1e-3, 1e-6]) * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (toxic - p)) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    if b[0] <= 0:
        return model
    return replace(model, slope=float(b[0] / spread), threshold=float(middle - spread * b[1] / b[0]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, labelled_bytes: int = LABELLED_BYTES) -> Model:
    """Learns from labels of rows in all folds but the held out one. Of several labels of one id the largest counts;
    null ids and labels are left out. Rows of docs that share an id are learnt from together. Without labels of both
    classes every text has evidence, but the threshold stays 0."""
    fold = id_bucket("doc_id", FOLDS)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~fold.isin(*HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("calibrating", fold.isin(*CALIBRATING))
    parts = [
        known.where((F.col("toxic") == c) & (F.col("calibrating") == part)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
        for c in (0, 1)
        for part in (False, True)
    ]
    chosen = cut(functools.reduce(DataFrame.union, parts))  # at most 4 * labelled ids
    rows = docs.select("doc_id", "text")
    sizes = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "calibrating").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    before = Window.partitionBy("toxic", "calibrating").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # at most `labelled`
    sizes = sizes.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    chosen = cut(sizes.where(F.col("calibrating") | (F.col("before") < labelled_bytes)).select("doc_id", "toxic", "calibrating"))
    rows = rows.join(F.broadcast(chosen), "doc_id")
    model = train_models(rows.where("not calibrating"))
    seen = with_evidence(rows.where("calibrating"), model, "evidence", "evidence").select("toxic", "evidence").toPandas()
    return calibrated(model, seen["evidence"].to_numpy(), seen["toxic"].to_numpy())


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs with toxicity (0 to 1), in place of a column of that name. A text without words, or null, has no evidence
    either way: the score of evidence 0. Rows all stay, repeated ones too; equal texts have equal scores."""
    return with_evidence(docs, model, "toxicity", "score")


def op2_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    found = score_toxicity(docs, model)
    return found.select("doc_id", id_bucket("doc_id", FOLDS).isin(*HELD_OUT).alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))
