"""Queries over the test tables, each with the SQL that gives the same rows.

Points are the rows of `embeddings`: id = vec_id, vector = embedding in double precision, and a payload made of the label.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pointloom.config import Distance, HnswConfig, OptimizerConfig, PayloadSchema, ScalarQuantizationConfig
from pointloom.functions import quantize
from pointloom.functions.distance import normalized
from pointloom.operators import hnsw, payload_index, search, versions
from pointloom.operators.filters import Filter, HasId, Match, Range, compile_filter, compile_typed
from pointloom.plans import strategy
from pointloom.sources.collection import Collection, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


PAYLOAD = """concat('{"label":', label, ',"tags":[', label, ',', vec_id % 5, '],"reviews":[{"user":"u', vec_id % 3, '","score":', label,
 '},{"user":"v","score":', vec_id % 7, '}]', case vec_id % 3 when 0 then ',"opt":null' when 1 then '' else concat(',"opt":', vec_id % 4) end, '}')"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label", F.expr(PAYLOAD).alias("json"))


def asked(p: DataFrame, vec_id: int = 7) -> DataFrame:
    return p.where(F.col("id") == vec_id).select(F.col("vector").alias("q"))


def by_label(p: DataFrame) -> tuple[DataFrame, dict[str, payload_index.Indexed]]:
    """p with the two columns of an integer index of the label."""
    value, other = payload_index.stored(F.parse_json("json"), "label", PayloadSchema.INTEGER)
    return p.withColumns({"by_label": value, "other_label": other}), {"label": payload_index.Indexed("by_label", "other_label", PayloadSchema.INTEGER)}


def keep(condition) -> Column:
    return compile_filter(condition, F.parse_json("json"), F.lit(""))


def shown(found: DataFrame, *more: str) -> DataFrame:
    return found.select("id", F.round("score", 6).alias("score"), *more)


P = "WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT v AS q FROM p WHERE id = 7)"
DOT = "list_inner_product(v, q)"


def top(where: str = "true", k: int = 10, s: str = DOT, more: str = "") -> str:
    return f"{P} SELECT id, round(s, 6) AS score{more} FROM (SELECT *, {s} AS s FROM p, q WHERE {where}) ORDER BY s DESC, id LIMIT {k}"


@query(top())
def knn_dot_top10(spark, d):
    p = points(spark, d)
    return shown(search.top_k(p, asked(p), 10))


@query(top(s="list_inner_product(v, q) / sqrt(list_inner_product(v, v)) / sqrt(list_inner_product(q, q))"))
def knn_cosine_top10(spark, d):
    p = points(spark, d)
    return shown(search.top_k(p.withColumn("vector", normalized("vector")), asked(p), 10, Distance.COSINE))


@query(top(s="0.0 - list_sum(list_transform(list_zip(v, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"))
def knn_euclid_top10(spark, d):
    p = points(spark, d)
    return shown(search.top_k(p, asked(p), 10, Distance.EUCLID))


@query(top())
def knn_strict_top10(spark, d):
    p = points(spark, d)
    return shown(search.top_k(p, asked(p), 10, strict=True))


@query(top("list_inner_product(v, q) >= 0.2", 50))
def knn_threshold(spark, d):
    p = points(spark, d)
    return shown(search.top_k(p, asked(p), 50, threshold=0.2))


@query(top(more=", label"))
def knn_projection(spark, d):
    p = points(spark, d)
    return shown(search.top_k(p, asked(p), 10), "label")


@query(top(s="CAST(label AS DOUBLE)", k=25))
def knn_tie_break(spark, d):
    p = points(spark, d).withColumn("vector", F.array(F.col("label").cast("double")))
    return shown(search.top_k(p, spark.sql("SELECT array(1.0D) AS q"), 25))


@query(top("label = 3"))
def knn_filter_match(spark, d):
    p = points(spark, d)
    return shown(search.top_k(p, asked(p), 10, where=keep(Match("label", 3))))


@query(top("label >= 2 AND label < 7"))
def knn_filter_range(spark, d):
    p = points(spark, d)
    return shown(search.top_k(p, asked(p), 10, where=keep(Range("label", gte=2, lt=7))))


@query(top("(label >= 2) AND NOT (label = 5) AND (label = 3 OR (label >= 6 AND NOT id % 5 = 1))"))
def knn_filter_bool_tree(spark, d):
    p = points(spark, d)
    nested = Filter(must=[Range("label", gte=6)], must_not=[Filter(must=[Match("rest", 1)])])
    tree = Filter(must=[Range("label", gte=2)], must_not=[Match("label", 5)], should=[Match("label", 3), nested])
    p = p.withColumn("json", F.expr("concat('{\"label\":', label, ',\"rest\":', id % 5, '}')"))
    return shown(search.top_k(p, asked(p), 10, where=keep(tree)))


@query(top("id IN (3, 5, 8, 13, 21, 34)"))
def knn_filter_has_id(spark, d):
    p = points(spark, d)
    from pointloom import ids

    return shown(search.top_k(p, asked(p), 10, where=compile_filter(HasId([3, 5, 8, 13, 21, 34]), None, ids.key_of_integers(F.col("id")))))


@query(top("label = 4"))
def knn_filter_then_exact(spark, d):
    p = points(spark, d)
    p, index = by_label(p)
    condition = Match("label", 4)
    return shown(search.top_k(p, asked(p), 10, where=payload_index.candidates(condition, index) & keep(condition)))


@query("SELECT event_type, count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) = 42 GROUP BY event_type")
def events_match_json_k(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.where(compile_filter(Match("k", 42), F.parse_json("props"), F.lit(""))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) BETWEEN 50 AND 69 GROUP BY event_type")
def events_range_json_k(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.where(compile_filter(Range("k", gte=50, lt=70), F.parse_json("props"), F.lit(""))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) <> 7 GROUP BY event_type")
def events_must_not_missing_path(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    f = Filter(must_not=[Match("no.such.path", 1), Match("k", 7)])
    return e.where(compile_filter(f, F.parse_json("props"), F.lit(""))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT vec_id AS id FROM embeddings WHERE label = 2 OR vec_id % 5 = 2")
def payload_array_any(spark, d):
    return points(spark, d).where(keep(Match("tags", 2))).select("id")


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 = 1 AND (label >= 6 OR vec_id % 7 >= 6)")
def payload_nested_array_objects(spark, d):
    return points(spark, d).where(keep(Filter(must=[Match("reviews.user", "u1"), Range("reviews.score", gte=6)]))).select("id")


@query("SELECT vec_id AS id, vec_id % 3 = 0 AS is_null, vec_id % 3 = 2 AND vec_id % 4 = 1 AS is_one FROM embeddings")
def payload_null_vs_missing(spark, d):
    return points(spark, d).select("id", keep(Match("opt", None)).alias("is_null"), keep(Match("opt", 1)).alias("is_one"))


@query("WITH w AS (SELECT unnest([9, 3, 9, 100000000, 4]) AS id, unnest([0, 1, 2, 3, 4]) AS pos) SELECT pos, id, label FROM w JOIN embeddings ON vec_id = id")
def retrieve_ordered_dups(spark, d):
    wanted = spark.createDataFrame(list(enumerate([9, 3, 9, 100000000, 4])), "pos int, id long")
    return search.retrieve(points(spark, d), wanted).select("pos", "id", "label")


#: Three batches: all points; every third with its label plus 10, twice in the batch; then every seventh deleted.
VERSIONS = """
WITH rows AS (
  SELECT vec_id AS id, label AS value, 1 AS version, 0 AS ordinal, false AS deleted, vec_id % 4 AS segment FROM embeddings
  UNION ALL SELECT vec_id, label + 10, 2, 0, false, 4 FROM embeddings WHERE vec_id % 3 = 0
  UNION ALL SELECT vec_id, label + 100, 2, 1, false, 4 FROM embeddings WHERE vec_id % 3 = 0
  UNION ALL SELECT vec_id, 0, 3, 0, true, 5 FROM embeddings WHERE vec_id % 7 = 0
), latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, ordinal) AS r FROM rows) WHERE r = 1)
"""


def history(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select("id", "label", "vector")
    part = lambda where, value, version, ordinal, deleted, segment: p.where(where).select(
        "id", F.expr(value).cast("int").alias("value"), F.lit(version).alias("version"), F.lit(ordinal).alias("ordinal"), F.lit(deleted).alias("deleted"), F.expr(segment).cast("int").alias("segment"), "vector"
    )
    first = part("true", "label", 1, 0, False, "id % 4").union(part("id % 3 = 0", "label + 10", 2, 0, False, "4"))
    return first.union(part("id % 3 = 0", "label + 100", 2, 1, False, "4")).union(part("id % 7 = 0", "0", 3, 0, True, "5"))


@query(VERSIONS + "SELECT id, value, version FROM latest WHERE NOT deleted")
def latest_versions(spark, d):
    return versions.live(history(spark, d)).select("id", "value", "version")


@query(VERSIONS + "SELECT id, value FROM latest WHERE version = 2")
def batch_first_wins(spark, d):
    return versions.latest(history(spark, d)).where("version = 2").select("id", "value")


@query(VERSIONS + "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(value) AS BIGINT) AS total FROM latest WHERE NOT deleted")
def count_live(spark, d):
    return versions.live(history(spark, d)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(VERSIONS + "SELECT segment, count(*) FILTER (NOT deleted) AS live_points, count(*) FILTER (deleted) AS deleted_points FROM rows GROUP BY segment")
def segment_stats(spark, d):
    return versions.segment_statistics(history(spark, d), "segment")


@query(top("id % 7 <> 0"))
def delete_overlay_search(spark, d):
    p = points(spark, d)
    return shown(search.top_k(versions.live(history(spark, d)), asked(p), 10))


@query(f"{P}, w AS (SELECT id, CASE WHEN id % 3 = 0 THEN list_transform(v, lambda x: x * 0.01) ELSE v END AS v FROM p) SELECT id, round(s, 6) AS score FROM (SELECT id, {DOT} AS s FROM w, q) ORDER BY s DESC, id LIMIT 10")
def stale_scores_hidden(spark, d):
    p = points(spark, d).select("id", "vector")
    old = p.select("id", F.transform("vector", lambda x: x).alias("vector"), F.lit(1).alias("version"), F.lit(0).alias("ordinal"), F.lit(False).alias("deleted"))
    new = p.where("id % 3 = 0").select("id", F.transform("vector", lambda x: x * 0.01), F.lit(2), F.lit(0), F.lit(False))
    return shown(search.top_k(versions.live(old.union(new)), asked(p), 10))


@query(VERSIONS + "SELECT id, value, version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, ordinal) AS k FROM rows WHERE version <= 2) WHERE k = 1 AND NOT deleted UNION ALL SELECT id, value, version FROM rows WHERE version > 2")
def late_write_preserved(spark, d):
    return versions.compacted(history(spark, d), 2).select("id", "value", "version")


@query(VERSIONS + "SELECT id, value, version FROM rows WHERE version > 1")
def oplog_replay_after_boundary(spark, d):
    return versions.newer_than(history(spark, d), 1).select("id", "value", "version")


def fields(found: DataFrame, payload: str = "payload") -> DataFrame:
    of = lambda k, t: F.try_variant_get(payload, f"$.{k}", t).alias(k)
    return found.select("id", of("label", "int"), of("a", "string"), F.to_json(F.map_keys(F.col(payload).cast("map<string,variant>"))).alias("keys"))


@query("""SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN NULL ELSE label END AS label, CASE WHEN vec_id % 2 = 0 THEN 'new' END AS a,
CASE WHEN vec_id % 2 = 0 THEN '["a"]' ELSE '["b","label"]' END AS keys FROM embeddings""")
def payload_replace(spark, d):
    c = Collection.create(spark, own_path(spark), dimension=64, distance=Distance.DOT)
    p = points(spark, d)
    c.upsert(p.select("id", "vector", F.expr("concat('{\"b\":1,\"label\":', label, '}')").alias("payload")))
    c.replace_payload(p.where("id % 2 = 0").select("id"), '{"a":"new"}')
    return fields(c.points())


@query("""SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN -1 ELSE label END AS label, CASE WHEN vec_id % 2 = 0 THEN 'new' END AS a,
CASE WHEN vec_id % 2 = 0 THEN '["a","b","label"]' ELSE '["b","label"]' END AS keys FROM embeddings""")
def payload_merge(spark, d):
    p = points(spark, d).withColumn("payload", F.parse_json(F.expr("concat('{\"b\":1,\"label\":', label, '}')")))
    change = versions.merged(F.col("payload"), F.parse_json(F.lit('{"a":"new","label":-1}')))
    return fields(p.withColumn("payload", F.when(F.col("id") % 2 == 0, change).otherwise(F.col("payload"))))


@query("""SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN NULL ELSE label END AS label, CAST(NULL AS VARCHAR) AS a,
CASE WHEN vec_id % 2 = 0 THEN '["b"]' ELSE '["b","label"]' END AS keys FROM embeddings""")
def payload_delete_keys(spark, d):
    p = points(spark, d).withColumn("payload", F.parse_json(F.expr("concat('{\"b\":1,\"label\":', label, '}')")))
    return fields(p.withColumn("payload", F.when(F.col("id") % 2 == 0, versions.without_keys(F.col("payload"), ["label", "none"])).otherwise(F.col("payload"))))


@query("WITH e AS (SELECT vec_id, unnest(list_distinct([label, vec_id % 5])) AS value FROM embeddings) SELECT CAST(value AS BIGINT) AS value, count(*) AS points, min(vec_id) AS low_id, max(vec_id) AS high_id FROM e GROUP BY value")
def inverted_index_postings(spark, d):
    p = points(spark, d).withColumn("tags", payload_index.extract(F.parse_json("json"), "tags", PayloadSchema.INTEGER))
    return payload_index.postings(p, "tags").withColumn("value", F.col("value").cast("long"))


@query("""SELECT 'exact' AS kind, n AS minimum, n AS expected, n AS maximum, true AS exact FROM (SELECT count(*) AS n FROM embeddings WHERE label >= 3 AND label <> 5)
UNION ALL SELECT 'unknown', 0, n // 2, n, false FROM (SELECT count(*) AS n FROM embeddings)""")
def cardinality_estimate(spark, d):
    p, index = by_label(points(spark, d))
    known = payload_index.cardinality(p, Filter(must=[Range("label", gte=3)], must_not=[Match("label", 5)]), index)
    unknown = payload_index.cardinality(p, Match("opt", 1), index)
    return known.select(F.lit("exact").alias("kind"), "*").union(unknown.select(F.lit("unknown"), "*"))


FACTS = """SELECT label AS segment_id, count(*) AS total_points, CASE WHEN label % 3 = 0 THEN NULL ELSE count(*) // (label + 1) END AS filtered_maximum,
label % 4 <> 1 AS has_hnsw, label % 5 = 2 AS has_quantization, label = 8 AS exact_requested FROM embeddings GROUP BY label"""


@query(f"""SELECT segment_id, CASE WHEN exact_requested OR total_points <= 30 OR NOT has_hnsw THEN 'exact_full_scan'
WHEN filtered_maximum IS NOT NULL AND filtered_maximum <= 30 THEN 'filter_then_exact' WHEN has_quantization THEN 'quantized_hnsw_rescore'
WHEN filtered_maximum IS NOT NULL THEN 'filtered_hnsw' ELSE 'hnsw' END AS strategy FROM ({FACTS})""")
def planner_decisions(spark, d):
    spark.read.parquet(f"{d}/embeddings.parquet").createOrReplaceTempView("_pl_embeddings")
    facts = spark.sql(FACTS.replace("FROM embeddings", "FROM _pl_embeddings").replace("//", "div"))
    return facts.select("segment_id", strategy.search_strategy(30).alias("strategy"))


@query("""WITH f AS (SELECT 's' || label AS id, count(*) FILTER (vec_id % 3 <> 0) AS alive, count(*) FILTER (vec_id % 3 = 0) AS gone FROM embeddings GROUP BY label)
SELECT 'vacuum' AS kind, id AS segments FROM (SELECT id FROM f WHERE gone / (gone + alive) >= 0.2 ORDER BY gone / (gone + alive) DESC, id LIMIT 1)""")
def optimizer_policy(spark, d):
    p = points(spark, d).select(F.concat(F.lit("s"), "label").alias("segment_id"), (F.col("id") % 3 == 0).alias("deleted"))
    return strategy.maintenance(versions.segment_statistics(p).withColumn("indexed", F.lit(True)), OptimizerConfig())


RANGES = "r AS (SELECT i, min(v[i]) AS low, (max(v[i]) - min(v[i])) / 255 AS scale FROM p, range(1, 65) t(i) GROUP BY i)"
CODES = "least(127.0, greatest(-128.0, round_even((x - low) / scale, 0) - 128))"


@query(f"{P}, {RANGES} SELECT CAST(i - 1 AS INTEGER) AS dim, round(low, 9) AS low, round(scale, 9) AS scale FROM r")
def quantizer_fit(spark, d):
    found = quantize.fit(points(spark, d)).select(F.posexplode(F.arrays_zip("minima", "scales")).alias("dim", "x"))
    return found.select("dim", F.round("x.minima", 9).alias("low"), F.round("x.scales", 9).alias("scale"))


@query(f"{P}, {RANGES} SELECT id, CAST(sum(c) AS BIGINT) AS total, CAST(min(c) AS BIGINT) AS low, CAST(max(c) AS BIGINT) AS high FROM (SELECT id, {CODES} AS c FROM (SELECT id, r.i, v[r.i] AS x, low, scale FROM p, r)) GROUP BY id")
def quantizer_codes(spark, d):
    p = points(spark, d)
    codes = p.crossJoin(F.broadcast(quantize.fit(p))).select("id", quantize.encode(F.col("vector"), F.col("minima"), F.col("scales")).alias("c"))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda x, y: x + y)
    return codes.select("id", total.alias("total"), F.array_min("c").cast("long").alias("low"), F.array_max("c").cast("long").alias("high"))


@query(f"{P}, {RANGES} SELECT round(max(abs(x - (low + ({CODES} + 128) * scale))), 9) AS worst, round(max(scale) / 2, 9) AS bound FROM (SELECT v[r.i] AS x, low, scale FROM p, r)")
def quantizer_roundtrip_error(spark, d):
    p = points(spark, d)
    both = p.crossJoin(F.broadcast(quantize.fit(p)))
    back = quantize.decode(quantize.encode(F.col("vector"), F.col("minima"), F.col("scales")), F.col("minima"), F.col("scales"))
    off = both.select(F.array_max(F.zip_with("vector", back, lambda x, y: F.abs(x - y))).alias("off"), quantize.error_bound(F.col("scales")).alias("bound"))
    return off.agg(F.round(F.max("off"), 9).alias("worst"), F.round(F.max("bound"), 9).alias("bound"))


RESCORED = f"""{P}, {RANGES}, c AS (SELECT id, r.i, low + ({CODES} + 128) * scale AS x FROM (SELECT id, r.i, v[r.i] AS x, low, scale FROM p, r) JOIN r USING (i, low, scale)),
near AS (SELECT a.id FROM c a JOIN c b ON a.i = b.i AND b.id = 7 GROUP BY a.id ORDER BY sum(a.x * b.x) DESC, a.id LIMIT 40)"""


@query(f"{RESCORED} SELECT id, round(s, 6) AS score FROM (SELECT p.id, {DOT} AS s FROM p JOIN near USING (id), q) ORDER BY s DESC, id LIMIT 10")
def quantized_rescore_top10(spark, d):
    p = points(spark, d)
    return shown(search.quantized_top_k(p, asked(p), 10))


@query(f"{RESCORED}, a AS (SELECT p.id FROM p JOIN near USING (id), q ORDER BY {DOT} DESC, p.id LIMIT 10), b AS (SELECT id FROM p, q ORDER BY {DOT} DESC, id LIMIT 10) SELECT count(*) / 10 AS recall FROM a JOIN b USING (id)")
def recall_at_k(spark, d):
    p = points(spark, d)
    exact, about = search.top_k(p, asked(p), 10), search.quantized_top_k(p, asked(p), 10)
    return exact.select("id").intersect(about.select("id")).agg((F.count("*") / 10).alias("recall"))


@query(f"{P.split(', q AS')[0]} SELECT query_id, rank, id, round(s, 6) AS score FROM (SELECT a.id AS query_id, b.id, list_inner_product(a.v, b.v) AS s, CAST(row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.v, b.v) DESC, b.id) AS INTEGER) AS rank FROM p a JOIN p b ON a.id <> b.id WHERE a.id % 50 = 0) WHERE rank <= 5")
def batch_knn(spark, d):
    p = points(spark, d)
    found = search.batch_top_k(p, p.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q")), 5)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def graph_of(p: DataFrame, config: HnswConfig | None = None) -> DataFrame:
    """The points' graph as a table at rest in the shared folder."""
    graph, path = hnsw.build(p, config=config), own_path(p.sparkSession)
    graph.write.parquet(path)
    return p.sparkSession.read.schema(graph.schema).parquet(path)


def one_query(p: DataFrame) -> DataFrame:
    return asked(p).select(F.lit(7).cast("long").alias("query_id"), "q")


@query(top())
def hnsw_ef_full_equals_exact(spark, d):
    p = points(spark, d)
    graph = graph_of(p, HnswConfig(m=8, ef_construct=32))
    return shown(hnsw.search(graph, one_query(p), 10, ef=1 << 30))


@query(top("label = 3"))
def filtered_hnsw_ef_full(spark, d):
    p = points(spark, d)
    graph = graph_of(p, HnswConfig(m=8, ef_construct=32))
    return shown(hnsw.search(graph, one_query(p), 10, ef=1 << 30, allowed=p.where(keep(Match("label", 3)))))


@query("SELECT count(*) AS found, true AS near FROM (SELECT 1 FROM embeddings LIMIT 10)")
def hnsw_default_ef(spark, d):
    """How many points the default search finds, and whether nine in ten of them are among the exact nearest."""
    p = points(spark, d)
    about = hnsw.search(graph_of(p), one_query(p), 10).select("id")
    exact = search.top_k(p, asked(p), 10).select("id", F.lit(1).alias("hit"))
    return about.join(exact, "id", "left").agg(F.count("*").alias("found"), (F.count("hit") >= 0.9 * F.count("*")).alias("near"))


@query(top("label = 3 AND id % 32 = 1"))
def hnsw_filtered_widens(spark, d):
    """Fewer points than asked for are allowed: the walk widens until it has found all of them."""
    p = points(spark, d)
    few = p.where(keep(Match("label", 3)) & (F.col("id") % 32 == 1))
    return shown(hnsw.search(graph_of(p, HnswConfig(m=8, ef_construct=32)), one_query(p), 10, ef=16, allowed=few))


@query("SELECT true AS enough")
def hnsw_recall(spark, d):
    """Whether the default search finds nine in ten of the exact ten nearest, over all points divisible by 50."""
    p = points(spark, d)
    q = p.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    exact = search.batch_top_k(p, q, 10).select("query_id", "id")
    about = hnsw.search(graph_of(p), q, 11).where("id <> query_id").select("query_id", "id").withColumn("hit", F.lit(1))
    return exact.join(about, ["query_id", "id"], "left").agg((F.count("hit") / F.count("*") >= 0.9).alias("enough"))


def own_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/pointloom-collection-{uuid.uuid4().hex}"


def stored(spark: SparkSession, d: str) -> Collection:
    """The history above as a collection in the shared folder: two upserts and a deletion."""
    c = Collection.create(spark, own_path(spark), dimension=64, distance=Distance.DOT)
    p = points(spark, d)
    payload = lambda add: F.expr(f"concat('{{\"value\":', label + {add}, '}}')").alias("payload")
    c.upsert(p.select("id", "vector", payload(0)))
    c.upsert(p.where("id % 3 = 0").select("id", "vector", payload(10)))
    c.delete(p.where("id % 7 = 0").select("id"))
    return c


def held(c: Collection) -> DataFrame:
    return c.points().select("id", F.try_variant_get("payload", "$.value", "int").alias("value"), "version")


@query(VERSIONS + "SELECT id, value, CAST(version AS BIGINT) AS version FROM latest WHERE NOT deleted")
def recovery_reopen(spark, d):
    return held(Collection.open(spark, stored(spark, d).path))


@query(VERSIONS + "SELECT id, value, CAST(version AS BIGINT) AS version FROM latest WHERE NOT deleted")
def compaction_result(spark, d):
    c = stored(spark, d)
    c.optimize()
    return held(c)


@query(VERSIONS + "SELECT id, value, CAST(version AS BIGINT) AS version FROM latest WHERE NOT deleted")
def snapshot_roundtrip(spark, d):
    c = stored(spark, d)
    return held(Collection.restore(spark, c.create_snapshot(f"{c.path}-snapshot"), f"{c.path}-restored"))


@query(top("label = 3 AND id % 7 <> 0"))
def collection_search(spark, d):
    c, p = stored(spark, d), points(spark, d)
    c.merge_payload(p.where("label = 3").select("id"), '{"three":true}')
    return c.search(asked(p), 10, Match("three", True)).select("id", F.round("score", 6).alias("score"))


def indexed(spark: SparkSession, d: str) -> Collection:
    """All points in one batch, with an index of the label, and one in five again in a second batch, under another label."""
    c = Collection.create(spark, own_path(spark), dimension=64, distance=Distance.DOT)
    c.create_payload_index("label", PayloadSchema.INTEGER)
    p = points(spark, d)
    c.upsert(p.select("id", "vector", F.col("json").alias("payload")))
    c.upsert(p.where("id % 5 = 0").select("id", "vector", F.expr("concat('{\"label\":', (label + 1) % 10, '}')").alias("payload")))
    return c


NOW = "CASE WHEN id % 5 = 0 THEN (label + 1) % 10 ELSE label END"


@query(top(f"{NOW} = 3"))
def search_indexed(spark, d):
    """Reads the row groups that may have the label, by an index stored with each batch."""
    return indexed(spark, d).search(asked(points(spark, d)), 10, Match("label", 3)).select("id", F.round("score", 6).alias("score"))


@query(top(f"{NOW} >= 6 AND {NOW} < 8 AND NOT {NOW} = 7 OR {NOW} = 2"))
def search_indexed_range(spark, d):
    tree = Filter(should=[Filter(must=[Range("label", gte=5.5, lt=8)], must_not=[Match("label", 7.0)]), Match("label", 2)])
    return indexed(spark, d).search(asked(points(spark, d)), 10, tree).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH p AS (SELECT vec_id AS id, label, vec_id % 5 AS t FROM embeddings)
SELECT count(*) FILTER ({NOW} = 3) AS let_through, count(*) FILTER (label = 3 AND id % 5 <> 0 AND (label = 3 OR t = 3) AND id % 3 = 1) AS scored FROM p""")
def search_facts(spark, d):
    """What a filtered search had to look at: points that the index let through, and those of them that were scored."""
    facts = Observation("search_facts")
    tree = Filter(must=[Match("label", 3), Match("tags", 3), Match("reviews.user", "u1")])
    indexed(spark, d).search(asked(points(spark, d)), 10, tree, facts=facts).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(facts.get["let_through"], facts.get["scored"])], "let_through long, scored long")


@query(f"{RESCORED} SELECT id, round(s, 6) AS score FROM (SELECT p.id, {DOT} AS s FROM p JOIN near USING (id), q) ORDER BY s DESC, id LIMIT 10")
def search_quantized_stored(spark, d):
    """Codes and their ranges stored with the batch: the first phase reads no vectors, the second those of 40 ids."""
    c = Collection.create(spark, own_path(spark), dimension=64, distance=Distance.DOT, quantization=ScalarQuantizationConfig(4))
    p = points(spark, d)
    c.upsert(p.select("id", "vector", F.col("json").alias("payload")))
    return c.search(asked(p), 10).select("id", F.round("score", 6).alias("score"))


@query(ORACLE_SQL["batch_knn"])
def knn_join_blocked(spark, d):
    p = points(spark, d)
    found = search.knn_join(p, p.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q")), 5, block_rows=512)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(VERSIONS + "SELECT id, value, version FROM latest WHERE NOT deleted")
def latest_by_delta(spark, d):
    """The first version at rest, later ones as changes to it: only these are shuffled."""
    path = own_path(spark)
    rows = history(spark, d)
    rows.where("version = 1").write.parquet(path)
    return versions.latest_by_delta(spark.read.schema(rows.schema).parquet(path), rows.where("version > 1")).where("NOT deleted").select("id", "value", "version")


@query("""SELECT 'label' AS path, count(*) AS leaves, 0 AS strings, count(*) AS integers, 0 AS nulls, true AS homogeneous FROM embeddings
UNION ALL SELECT 'reviews.user', 2 * count(*), 2 * count(*), 0, 0, true FROM embeddings
UNION ALL SELECT 'tags', 2 * count(*), 0, 2 * count(*), 0, true FROM embeddings
UNION ALL SELECT 'opt', count(*) FILTER (vec_id % 3 <> 1), 0, count(*) FILTER (vec_id % 3 = 2), count(*) FILTER (vec_id % 3 = 0), false FROM embeddings""")
def payload_type_profile(spark, d):
    found = payload_index.type_profile(points(spark, d).withColumn("payload", F.parse_json("json")), "payload", ["label", "tags", "reviews.user", "opt"])
    return found.select("path", "leaves", "strings", "integers", "nulls", "homogeneous")


@query(top("id % 3 <> 0 AND (label >= 4 OR id % 7 >= 4) AND label <> 8 AND (label > 4 OR (label BETWEEN 2 AND 4 AND id % 3 = 2))"))
def knn_filter_struct(spark, d):
    """The payload as nested columns at rest: filters read those that they name, and go down to Parquet."""
    path = own_path(spark)
    kind = "struct<label:int,tags:array<int>,reviews:array<struct<user:string,score:int>>,opt:int>"
    points(spark, d).select("id", "vector", F.from_json("json", kind).alias("payload")).write.parquet(path)
    p = spark.read.parquet(path)
    same = Filter(should=[Range("label", gt=4), *(Filter(must=[Match("label", k), Match("tags", k), Range("opt", gte=0)]) for k in range(2, 5))])
    tree = Filter(must=[Filter(should=[Match("reviews.user", "u1"), Match("reviews.user", "u2")]), Filter(should=[Range("label", gte=6), Range("reviews.score", gt=3.5)]), same], must_not=[Match("label", 8)])
    return shown(search.top_k(p, asked(p), 10, where=compile_typed(tree, F.col("payload"), p.schema["payload"].dataType, F.lit(""))))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 6 = 0 THEN -1 ELSE label END AS value FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 6 = 0")
def operations_in_order(spark, d):
    """One micro-batch that inserts all points, deletes a third and inserts half of these again; then the same once more."""
    c, p = Collection.create(spark, own_path(spark), dimension=64, distance=Distance.DOT), points(spark, d)
    part = lambda where, seq, kind, value: p.where(where).select(F.expr(seq).alias("seq"), F.lit(kind).alias("kind"), "id", "vector", F.expr(f"concat('{{\"value\":', {value}, '}}')").alias("payload"))
    batch = part("true", "id", "upsert", "label").union(part("id % 3 = 0", "1000000 + id", "delete", "0")).union(part("id % 6 = 0", "2000000 + id", "upsert", "-1"))
    for _ in range(2):
        c.apply(batch, source="operations_in_order", epoch=0)
    return held(c).where("version = 1").select("id", "value")
