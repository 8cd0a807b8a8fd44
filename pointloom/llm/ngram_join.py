"""Operator 5: documents that share most of their word n-grams, joined by adaptive multi-match prefixes.

Two sets of n-grams with a Jaccard of at least t overlap in ceil(t * n) n-grams at least, n being the size of either.
In one order of all n-grams, their first l common ones therefore lie within the first n - ceil(t * n) + l of each.
Every set picks its own l: a longer prefix reads more postings, but a pair is only verified once it shares
min(l of one, l of the other) prefix n-grams. The order puts n-grams of crowded hash buckets last, by counts over all
documents in a fixed number of buckets: any one order is exact, and this one keeps common passages out of prefixes.

So that groups of copies never become all their pairs, equal sets are one entity; each entity is first verified against
the most central entities that it shares a prefix n-gram with, and the links found make components. The join then looks
only for pairs between different components, through n-grams that more than one component has in a prefix. Links
inside a component could not change it.

Only prefixes are shuffled for all documents; whole sets only for those whose prefix meets another.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.common import cut, in_small_batches, maybe_in, table
from pointloom.llm.graph import connected_components
from pointloom.llm.shingles import WORDS, Shingler, set_keys

PERCENT = 75
#: Multi-match prefixes go up to this many common n-grams, or to this part of a set, if that is more.
MOST_MATCHES, MOST_PART = 8, 16
#: An entity asks for one of these numbers, or for the most.
FEW_MATCHES = (1, 2, 4)
#: Verifying a pair costs as much as reading so many postings.
VERIFY_COST = 8
BUCKET_BITS = 17
COUNTED_AT_ONCE = 1 << 20


def _least(n: Column, percent: int) -> Column:
    """How many n-grams a set of n must share with any partner."""
    return F.ceil(n * percent / 100).cast("int")


def _most(n: Column) -> Column:
    """How many common n-grams a set's longest prefix asks for."""
    return F.greatest(F.lit(MOST_MATCHES), F.floor(n / MOST_PART).cast("int"))


def _sizes_and_buckets(docs: DataFrame, id_column: str, words: int) -> DataFrame:
    """(id, n, k1, k2) of every row, two hashes of its whole set naming an entity; and for each task one row of only `counts`, its n-grams by bucket."""
    kind = docs.schema[id_column].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts, schema = Shingler(words), np.zeros(1 << BUCKET_BITS, np.int64), None
        some: list[np.ndarray] = []
        for batch in batches:
            ids, sets = batch[0], [shingles(text.as_py()) for text in batch[1]]
            sizes, keys = [len(s) for s in sets], [set_keys(s) for s in sets]
            for s in sets:
                some.append((s >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
            if sum(map(len, some)) > COUNTED_AT_ONCE:  # a count passes over all buckets, so few are made
                counts += np.bincount(np.concatenate(some), minlength=len(counts))
                some = []
            k1, k2 = ([k[i] for k in keys] for i in (0, 1))
            schema = pa.schema([("id", ids.type), ("n", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("counts", pa.list_(pa.int64()))])
            yield pa.record_batch([ids, pa.array(sizes, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.nulls(len(ids), pa.list_(pa.int64()))], schema=schema)
        if schema is not None:
            counts += np.bincount(np.concatenate(some or [np.empty(0, np.int32)]), minlength=len(counts))
            yield pa.record_batch([pa.nulls(1, f.type) for f in list(schema)[:4]] + [pa.array([counts], pa.list_(pa.int64()))], schema=schema)

    return in_small_batches(docs).select(id_column, F.col("text").cast("binary")).mapInArrow(task, f"id {kind}, n int, k1 long, k2 long, counts array<long>")


def _ordered(found: np.ndarray, crowd: np.ndarray, percent: int) -> np.ndarray:
    """The longest prefix of a sorted set that may be asked for; crowd has the buckets' ranks, in 16 bits, which sort in linear time."""
    least = -(-len(found) * percent // 100)
    order = np.argsort(crowd[(found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], kind="stable")
    return found[order[: len(found) - least + max(MOST_MATCHES, len(found) // MOST_PART)]]


def _prefix_grams(docs: DataFrame, crowd, words: int, percent: int) -> DataFrame:
    """(k1, gram) for every n-gram of every row's longest prefix."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            keys, grams = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for text in batch[0]:
                if len(found := shingles(text.as_py())):
                    grams.append(_ordered(found, crowd.value, percent))
                    keys.append(np.full(len(grams[-1]), set_keys(found)[0], np.int64))
            yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(grams).view(np.int64))], ["k1", "gram"])

    return in_small_batches(docs).select(F.col("text").cast("binary")).mapInArrow(task, "k1 long, gram long")


def _whole_sets(docs: DataFrame, crowd, words: int, percent: int) -> DataFrame:
    """k1, k2, n, the longest prefix in order and the whole set of each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, longs = Shingler(words), pa.list_(pa.int64())
        for batch in batches:
            sets = [found for text in batch[0] if len(found := shingles(text.as_py()))]
            keys = [set_keys(s) for s in sets]
            yield pa.record_batch(
                [
                    *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([_ordered(s, crowd.value, percent).view(np.int64) for s in sets], longs),
                    pa.array([s.view(np.int64) for s in sets], longs),
                ],
                ["k1", "k2", "n", "prefix", "grams"],
            )

    return in_small_batches(docs).select(F.col("text").cast("binary")).mapInArrow(task, "k1 long, k2 long, n int, prefix array<long>, grams array<long>")


def _entities(docs: DataFrame, id_column: str, sets: DataFrame, crowd, words: int, percent: int) -> DataFrame:
    """Entities that may have a partner: id, k1, k2, n, prefix, grams. A partner shares as many n-grams
    of the longest prefix as that asks for, or all those it must share, if they are fewer."""
    prefix = cut(_prefix_grams(docs, crowd, words, percent))
    shared = prefix.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    met = prefix.join(shared.select("gram"), "gram").groupBy("k1").agg(F.count("*").alias("met"))
    wanted = sets.join(met, "k1").where(F.col("met") >= F.least(_most(F.col("n")), _least(F.col("n"), percent)))
    low = cut(wanted.select(F.col("low")).distinct())
    texts = maybe_in(docs, id_column, low).join(low, F.col(id_column).eqNullSafe(F.col("low")), "left_semi")
    return cut(_whole_sets(texts, crowd, words, percent).withColumn("id", F.monotonically_increasing_id()))  # numbered once, at rest


def _prefixes(entities: DataFrame, percent: int) -> DataFrame:
    """gram, at (its place), id, n, central, matches: each entity's prefix at its cheapest number of matches, without n-grams of its own."""
    spare = F.col("n") - _least(F.col("n"), percent)
    grams = entities.select("id", "n", spare.alias("spare"), F.posexplode("prefix").alias("at", "gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    own = cut(grams.join(shared, "gram"))
    choices = {f"c{k}": m for k, m in enumerate([*map(F.lit, FEW_MATCHES), _most(F.col("n"))])}
    read = [F.sum(F.when(F.col("at") < F.col("spare") + m, F.col("df")).otherwise(0)).alias(c) for c, m in choices.items()]
    sums = own.groupBy("id", "n").agg(*read, F.sum("df").alias("all"))
    cheapest = F.least(*(F.struct((F.col(c) * (1 + VERIFY_COST / m)).alias("cost"), m.cast("int").alias("m")) for c, m in choices.items()))["m"]
    chosen = sums.select("id", (F.col("all") / F.col("n")).cast("float").alias("central"), F.least(cheapest, _least(F.col("n"), percent)).alias("matches"))
    return own.join(chosen, "id").where(F.col("at") < F.col("spare") + F.col("matches")).select("gram", "at", "id", "n", "central", "matches")


def _verified(pairs: DataFrame, entities: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    of = lambda x: entities.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("grams").alias(f"g_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("both", F.size(F.array_intersect("g_a", "g_b")))
    return both.where(F.col("both") * 100 >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _may_meet(a: str, b: str, percent: int) -> Column:
    """Whether a shared n-gram counts for a pair: the sizes allow enough similarity, and it stands within both prefixes
    for the overlap that these two sizes ask for, which is more than each set asks for alone."""
    c = lambda side, name: F.col(f"{side}.{name}")
    n, m, asked = c(a, "n"), c(b, "n"), F.least(c(a, "matches"), c(b, "matches"))
    overlap = F.ceil((n + m) * percent / (100 + percent))
    within = (c(a, "at") < n - overlap + asked) & (c(b, "at") < m - overlap + asked)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & within


def _links_to_central(prefixes: DataFrame, entities: DataFrame, percent: int) -> DataFrame:
    """Each entity with the two of the centres of its prefix n-grams that it shares most of them with, verified."""
    centre = prefixes.groupBy("gram").agg(F.max(F.struct("central", "id", "n", "at", "matches")).alias("c"), F.count("*").alias("k")).where("k > 1")
    seen = prefixes.alias("p").join(centre, "gram").where((F.col("id") != F.col("c.id")) & _may_meet("p", "c", percent))
    counted = seen.groupBy("id", F.col("c.id").alias("b")).agg(F.count("*").alias("k"))
    two = counted.groupBy("id").agg(F.max(F.struct("k", "b")).alias("x"), F.min(F.struct(-F.col("k"), F.col("b"))).alias("y"))
    pairs = two.select(F.col("id").alias("a"), F.explode(F.array_distinct(F.array("x.b", "y.b"))).alias("b"))
    return _verified(pairs, entities, percent)


def _with_a_chance(own: DataFrame, percent: int) -> DataFrame:
    """The rows of `own` that can meet one of another component, and `main`, a component of many of their n-gram's rows.
    For each n-gram, the smallest size and the fewest and most matches of all its rows bound those of any partner. An
    entity stays if, for some number of matches a partner may have, enough of its places are open to such a partner;
    what goes may leave others without a chance, so this is done twice."""
    return _open_places(_open_places(own, percent), percent)


def _open_places(own: DataFrame, percent: int) -> DataFrame:
    columns = [c for c in own.columns if c != "main"]
    facts = own.groupBy("gram").agg(
        F.min("c").alias("x"), F.max("c").alias("y"), F.max(F.struct("central", "c"))["c"].alias("main"),
        F.min("n").alias("small"), F.min("matches").alias("fewest"), F.max("matches").alias("most"),
    )
    near = own.drop("main").join(facts.where("x != y").drop("x", "y"), "gram")
    overlap = F.ceil((F.col("n") + F.greatest("small", _least(F.col("n"), percent))) * percent / (100 + percent))
    room = F.col("n") - overlap - F.col("at")  # the place is within the prefix for more matches than -room
    near = near.withColumn("room", room).where(F.col("room") + F.least("matches", "most") > 0)
    near = cut(near.select(*columns, "main", "fewest", "room"))
    steps = range(1, MOST_MATCHES + 1)  # a partner asks for so many, or for more than all these
    open_to = lambda t: F.sum(F.when((F.col("fewest") <= t) & (F.col("room") + F.least("matches", F.lit(t)) > 0), 1).otherwise(0))
    enough = [open_to(t) >= F.least(F.first("matches"), F.lit(t)) for t in steps]
    more = F.count("*") >= F.least(F.first("matches"), F.lit(MOST_MATCHES + 1))
    live = near.groupBy("id").agg(functools.reduce(Column.__or__, enough, more).alias("live")).where("live").select("id")
    return near.join(live, "id").select(*columns, "main")


def _links_between(prefixes: DataFrame, labels: DataFrame, entities: DataFrame, percent: int) -> DataFrame:
    """All similar pairs between entities of different components. One of a pair is outside its n-gram's main component.

    Of the n-grams that a pair must share, at most `half` are among the half most frequent ones of the entity with fewer
    places: these need not be looked at, if the others are asked for so many matches less."""
    own = prefixes.join(labels, prefixes["id"] == labels["v"], "left").select("gram", "at", "id", "n", "matches", "central", F.coalesce("c", "id").alias("c"))
    own = _with_a_chance(own, percent)
    own = own.join(own.groupBy("gram").agg(F.count("*").alias("df")), "gram")
    of = Window.partitionBy("id")
    own = cut(own.withColumns({"rank": F.row_number().over(of.orderBy(F.desc("df"), "gram")), "places": F.count("*").over(of)}))
    outside = own.where("c != main")
    a, b = outside.alias("a"), own.join(outside.select("gram").distinct(), "gram", "left_semi").alias("b")
    once = (F.col("b.c") == F.col("b.main")) | (F.col("a.id") < F.col("b.id"))
    asked = F.least("a.matches", "b.matches")
    half = F.floor(asked / 2).cast("int")
    rank = F.when(F.struct("a.places", "a.id") < F.struct("b.places", "b.id"), F.col("a.rank")).otherwise(F.col("b.rank"))
    met = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.c") != F.col("b.c")) & once & _may_meet("a", "b", percent) & (rank > half))
    met = met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), (asked - half).alias("need"))
    counted = met.groupBy("a", "b").agg(F.count("*").alias("k"), F.first("need").alias("need"))
    return _verified(counted.where("k >= need").select("a", "b"), entities, percent)


def similar_components(docs: DataFrame, id_column: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id_column, n_shingles, component_id for every row of docs (columns id_column and text; others are not looked at).

    Rows are linked when 100 * intersection >= percent * union of their n-gram sets; component_id is the smallest id
    reached by links, the row's own included. Rows without words or text have n_shingles 0 and are linked with nothing.
    Rows that repeat, even with one id, are rows of one set; a null id is never the smallest unless there is no other.
    """
    docs = docs.select(id_column, "text")
    first = cut(_sizes_and_buckets(docs, id_column, words))
    meta = first.where("counts is null").select(F.col("id").alias(id_column), "n", "k1", "k2")
    sums = first.where("counts is not null").select(F.posexplode("counts").alias("bucket", "c")).groupBy("bucket").agg(F.sum("c").alias("c"))
    crowd = np.zeros(1 << BUCKET_BITS, np.int64)
    for row in sums.toPandas().itertuples():  # as many rows as there are buckets
        crowd[row.bucket] = row.c
    rank = np.empty(1 << BUCKET_BITS, np.int64)
    rank[np.argsort(crowd, kind="stable")] = np.arange(1 << BUCKET_BITS)
    sent = docs.sparkSession.sparkContext.broadcast((rank >> (BUCKET_BITS - 16)).astype(np.uint16))
    sets = meta.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(id_column).alias("low"))
    entities = _entities(docs, id_column, sets, sent, words, percent)
    prefixes = cut(_prefixes(entities, percent))
    central = cut(_links_to_central(prefixes, entities, percent))
    between = _links_between(prefixes, connected_components(central), entities, percent)
    labels = connected_components(central.union(between))
    named = entities.select("id", "k1", "k2").join(labels, F.col("id") == F.col("v")).groupBy("k1", "k2").agg(F.min("c").alias("c"))
    joined = cut(sets.join(named, ["k1", "k2"], "left"))
    lowest = joined.where("c is not null").groupBy("c").agg(F.min("low").alias("lowest"))
    component = joined.join(lowest, "c", "left").select("k1", "k2", F.coalesce("lowest", "low").alias("component_id"))
    out = meta.where("n > 0").join(component, ["k1", "k2"]).select(id_column, F.col("n").cast("long").alias("n_shingles"), "component_id")
    return out.union(meta.where("n = 0").select(id_column, F.lit(0).cast("long"), id_column))


def one_of_each_component(docs: DataFrame, id_column: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without rows whose component has a smaller id; all columns of the others stay as they are.

    Rows that share an id stay or go together, but of those with the same text, one stays.
    """
    found = cut(similar_components(docs, id_column, words, percent))
    by_id = found.groupBy(F.col(id_column).alias("_ng_id")).agg(F.max(F.col(id_column).eqNullSafe(F.col("component_id"))).alias("first"), F.count("*").alias("rows"))
    moot = cut(by_id.where("not first or rows > 1").select("_ng_id", "first"))
    ids = moot.select("_ng_id")
    kept = maybe_in(docs, id_column, ids).join(moot.where("not first"), F.col(id_column).eqNullSafe(F.col("_ng_id")), "left_anti")
    return kept.dropDuplicates([id_column, "text"]).unionByName(maybe_in(docs, id_column, ids, maybe=False))


def op5_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH RECURSIVE lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), worded AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM lowered
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM worded
), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN lowest USING (doc_id)
"""
