"""Operator 4: SpotSigs fingerprints. Common words are anchors; the next content words after one make a chain, a
signature of the place. A text's fingerprint is the set of its chains, so headers and lists, which have few common
words, hardly count. Sets are compared by Jaccard, pruned by their lengths first: sets whose lengths differ by more
than the threshold allows are never looked at.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import cut, partitions, table

CHAIN = 3
THRESHOLD = 0.75
# Common words of English, German, French and Spanish, the anchors.
ANCHORS = frozenset(
    """a an and are as at be but by for from had has have he her his in is it its of on or she that the their they this
    to was were which will with you aber als am auch auf aus bei das dem den der des die ein eine einem einen einer er
    es für hat ich im ist mit nach nicht noch sich sie sind so um und von war wie wird zu zum zur au aux avec ce cette
    dans de du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses
    son sur un une vous al como con del el ella ellos era esta este ha hay lo los las más me mi muy no nos para pero
    por se si sin sobre su sus también y ya""".split()
)
WORD = re.compile(r"\w+")


class Fingerprinter:
    """Sorted distinct 32-bit hashes of a text's chains; of all its words, or failing these of the whole text, where
    there is no chain, so that only an equal text is alike."""

    def __init__(self, chain: int = CHAIN) -> None:
        self.chain, self.known = chain, {}

    def hashes(self, words: list[str]) -> np.ndarray:
        """Of each word; 0 for an anchor."""
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = 0 if w in ANCHORS else xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) | 1
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str) -> np.ndarray:
        h = self.hashes(WORD.findall(text.lower()))
        content = np.nonzero(h)[0]
        anchors = np.nonzero(h == 0)[0]
        first = np.searchsorted(content, anchors)  # of the content words, the next after each anchor
        first = np.unique(first[first + self.chain <= len(content)])
        if not len(first):
            return np.array([xxhash.xxh3_64_intdigest(h.tobytes() if len(h) else text.encode("utf-8", "surrogatepass"), 9) & 0xFFFFFFFF], np.uint32)
        out = np.zeros(len(first), np.uint64)
        for k in range(self.chain):
            out = (out ^ h[content[first + k]]) * np.uint64(0x9E3779B185EBCA87)
            out ^= out >> np.uint64(29)
        return np.unique((out >> np.uint64(32)).astype(np.uint32))


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Of two sorted sets. 0 without a look at them if their lengths alone keep it below `least`."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return 0.0
    if not large:
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def encoded(signatures: np.ndarray) -> str:
    """How many, and all of them in base 64, little-endian."""
    return f"{len(signatures)}:{base64.b64encode(signatures.astype('<u4').tobytes()).decode()}"


def with_fingerprints(docs: DataFrame, text: str = "text", chain: int = CHAIN) -> DataFrame:
    """docs with `signatures`, array of long, in place of a column of that name: the fingerprint's set; a null text is empty,
    and a text of any length is read whole."""

    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = Fingerprinter(chain)
        for texts in batches:
            yield pa.array([of(x.as_py() or "").astype(np.int64) for x in texts], pa.list_(pa.int64()))

    measure.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("signatures", F.arrow_udf(measure, "array<bigint>")(F.col(text)))


def _length_part(n: Column, threshold: float) -> Column:
    """Parts of geometrically growing lengths: similar sets are in one, or in neighbouring ones."""
    return F.floor(F.log(n) / -math.log(threshold)).cast("int")


def similar_fingerprints(docs: DataFrame, id_column: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """a, b, likeness for pairs of classes of equal fingerprints with Jaccard >= threshold, each class named by its
    smallest id.

    Sets are partitioned by length. A set's rarest len - ceil(threshold * len) + 1 signatures must hold one that any
    partner has among its own; pairs that meet in one, in the same or a neighbouring partition, and whose lengths allow
    it, are compared. Ids must not be null.
    """
    sets = with_fingerprints(docs.select(id_column, "text")).groupBy("signatures").agg(F.min(id_column).alias("id"))
    sets = cut(sets.where("id is not null").withColumn("n", F.size("signatures")))
    entries = sets.select("id", "n", F.explode("signatures").alias("signature"))
    shared = entries.groupBy("signature").agg(F.count("*").alias("df"))
    ordered = entries.join(shared, "signature").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "signature"))).alias("s"))
    prefix = F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))
    rare = ordered.select("id", "n", _length_part(F.col("n"), threshold).alias("part"), F.explode(prefix).alias("s")).where("s.df > 1")
    rare = rare.select("id", "n", "part", "s.signature")
    here = rare.withColumn("meet", F.explode(F.array("part", F.col("part") + 1)))  # each with its own part, and that of the next shorter
    there = rare.withColumn("meet", F.col("part"))
    x, y = here.alias("x"), there.alias("y")
    longer = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    on = (F.col("x.signature") == F.col("y.signature")) & (F.col("x.meet") == F.col("y.meet")) & longer & (F.col("x.n") >= F.col("y.n") * threshold)
    pairs = x.join(y, on).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    side = lambda name: sets.select(F.col("id").alias(name), F.col("signatures").alias(f"s_{name}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    found = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("likeness", both / (F.size("s_a") + F.size("s_b") - both))
    return found.where(F.col("likeness") >= threshold).select("a", "b", "likeness")


def followed(docs: DataFrame) -> DataFrame:
    """Rows (part, head, doc_id, text), part being a range of ids and head whether the row only ends the range above it.

    Within a part, in descending order of id, text and head, every row's successor is the next row; the last row of a
    part is a copy of the first of the next part (of the very first, for the last part), and has no successor.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    bounds = docs.where("doc_id is not null").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.001) if n > 1 else []
    edges = sorted({int(x) for x in bounds})  # fewer than the partitions
    part = F.coalesce(-F.expr(f"cast(array_size(filter(array({','.join(f'{e}L' for e in edges)}), e -> e < doc_id)) as int)") if edges else F.lit(0), F.lit(1))
    rows = docs.select(part.alias("part"), "doc_id", "text")  # parts in ascending order have ids in descending order, nulls last
    top = rows.groupBy("part").agg(F.max("doc_id").alias("top"))
    heads = [(r["part"], r["top"]) for r in top.orderBy("part").collect()]  # one row a part
    ends = {p: heads[i - 1][0] for i, (p, _) in enumerate(heads)}  # the part that the head of p ends
    sent = spark.createDataFrame([(p, t, ends[p]) for p, t in heads], "p int, top long, above int") if heads else spark.createDataFrame([], "p int, top long, above int")
    joined = rows.join(F.broadcast(sent), F.col("part") == F.col("p"))
    twice = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(F.struct("part", F.lit(False).alias("head")), F.struct(F.col("above").alias("part"), F.lit(True).alias("head"))))
    return joined.select(F.explode(F.coalesce(twice, F.array(F.struct("part", F.lit(False).alias("head"))))).alias("at"), "doc_id", "text").select("at.part", "at.head", "doc_id", "text")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_successors(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, whose second half is the start of the next document's, and
    their likeness; see op4's contract. Rows with the same id follow each other by their texts, null ids come last; rows
    that repeat have a row each. Null texts are empty, and empty texts have the fingerprint of no words. A single document
    is followed by itself; an empty table gives an empty result. A task holds a batch and one text before it. Columns
    other than doc_id and text are not read."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Fingerprinter()
        last: tuple[int, int | None, str, np.ndarray] | None = None
        for batch in batches:
            out = []
            for part, head, doc, text in zip(batch["part"], batch["head"], batch["doc_id"], batch["text"], strict=True):
                text = text or ""
                own = of(text)
                if last is not None and last[0] == part:
                    _, before, old, signs = last
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    changed = of(edited)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((before, len(old), digest, encoded(signs), encoded(changed), jaccard(signs, changed), jaccard(signs, own)))
                last = None if head else (part, None if pd.isna(doc) else int(doc), text, own)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"doc_id": "Int64"})

    dealt = followed(docs).repartition(partitions(docs.sparkSession), "part")
    return dealt.sortWithinPartitions("part", "head", F.desc_nulls_last("doc_id"), F.desc_nulls_last("text")).mapInPandas(walk, OUT)


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_successors(table(spark, sf_dir, "documents"))
