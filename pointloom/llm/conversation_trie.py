"""Operator 11: the prefix trie of conversations.

A node of the trie is a sequence of first turns, known by a 128-bit key: the exclusive or of hashes of (place, role,
text) over its turns, which running aggregates give. Every part of the rows is combined to a partial table of nodes, and
these tables are merged by key, in rounds, so that no node gathers a row from every conversation in one task.

The rollup from the leaves up needs no round a level. A node belongs to its smallest member. A conversation m owns the
nodes of its path below some depth, and shares those above with smaller ones; what its turns there save goes to every
node of the path that has the turn in its subtree, and so does its leaf if it owns one. One more merge by key sums both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.common import cut, partitions, table
from pointloom.llm.sequences import dealt_in_order, segments, sha256_of_ids

#: A conversation begins with as many turns of its hundred's first one as a hash of its id, below SHARED, tells.
HUNDRED = 100
SHARED = 6
KEY = ["depth", "x1", "x2"]
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # fixed value: of no bytes


def _marks(place: Column, c1: Column, c2: Column) -> tuple[Column, Column]:
    """Two hashes of what stands at a place."""
    return F.xxhash64(place.cast("long"), c1, c2), F.xxhash64(c2, place.cast("long"), c1)


def _xor(x: Column, y: Column) -> Column:
    return x.bitwiseXOR(y)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, two hashes of role and text, and the text's code points. Null roles and texts are empty; rows
    without conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("c1"), F.xxhash64(F.lit(1), text, role).alias("c2"), F.length(text).cast("long").alias("chars")
    )


def shared_turns() -> Column:
    return (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")


def prefix_rows(dealt: DataFrame, order: list[str], shared: Column | None = None) -> DataFrame:
    """One row for each conversation and depth, 0 included: key (depth, x1, x2), the parent's p1, p2, the last turn's
    chars, pre (chars of all turns so far), part, whether the conversation ends there.

    With `shared`, a count of turns, SHARED - 1 at most, conversations are rebuilt first: so many first turns of
    conversation conv_id - conv_id % HUNDRED, or as many as it has, and then their own after as many of these.
    """
    ranked = Window.partitionBy("conv_id").orderBy(*order)
    base = (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("base")
    first = dealt.where(F.col("conv_id") % HUNDRED == 0).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") < SHARED)
    bases = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("rank", "c1", "c2", "chars"))).alias("items"))  # SHARED - 1 turns at most
    found = segments(dealt, "conv_id").withColumn("h", F.lit(0) if shared is None else shared).withColumn("base", base)
    found = found.join(bases, "base", "left").withColumn("items", F.slice(F.coalesce("items", F.array().cast(bases.schema["items"].dataType)), F.lit(1), F.col("h")))
    xor_of = lambda items, which: F.aggregate(items, F.lit(0).cast("long"), lambda x, i: _xor(x, _marks(i["rank"], i["c1"], i["c2"])[which]))
    sum_of = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda x, i: x + i["chars"])
    segs = cut(found.select("part", "conv_id", "before", "n", "h", "items", F.size("items").alias("b"), *(xor_of(F.col("items"), k).alias(f"b{k + 1}") for k in (0, 1)), sum_of(F.col("items")).alias("bpre"), (F.size("items") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length"), (F.col("total") > F.col("n")).alias("spans")))

    inside = Window.partitionBy("part", "conv_id").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.join(segs.drop("items"), ["part", "conv_id"]).withColumn("rank", F.col("before") + F.row_number().over(inside)).where(F.col("rank") > F.col("h"))
    own = own.withColumn("depth", (F.col("rank") - F.col("h") + F.col("b")).cast("long"))
    own = own.withColumns(dict(zip(("t1", "t2"), _marks(F.col("depth"), F.col("c1"), F.col("c2")), strict=True)))
    own = own.withColumns({"l1": F.bit_xor("t1").over(running), "l2": F.bit_xor("t2").over(running), "lpre": F.sum("chars").over(running)})
    # Of sequences in several parts, what the parts before have: two rows a part at most.
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.where("spans").groupBy("part", "conv_id").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"), F.sum("chars").alias("s3"))
    carry = sums.select("part", "conv_id", F.bit_xor("s1").over(earlier).alias("k1"), F.bit_xor("s2").over(earlier).alias("k2"), F.sum("s3").over(earlier).alias("k3"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    own = own.join(F.broadcast(carry), ["part", "conv_id"], "left").withColumns({f"x{k}": _xor(_xor(F.col(f"l{k}"), zero(f"k{k}")), F.col(f"b{k}")) for k in (1, 2)})
    of_own = own.select("part", "conv_id", *KEY, *(_xor(F.col(f"x{k}"), F.col(f"t{k}")).alias(f"p{k}") for k in (1, 2)), "chars", (F.col("lpre") + zero("k3") + F.col("bpre")).alias("pre"), (F.col("depth") == F.col("length")).alias("ends"))

    heads = segs.where("before = 0").select("*", F.explode(F.sequence(F.lit(0), F.col("b"))).alias("at"))
    upto, last = F.slice("items", F.lit(1), F.col("at")), F.try_element_at("items", F.when(F.col("at") > 0, F.col("at")))
    heads = heads.withColumns({"x1": xor_of(upto, 0), "x2": xor_of(upto, 1), "pre": sum_of(upto), "t": last})
    mark = _marks(F.col("t.rank"), F.col("t.c1"), F.col("t.c2"))
    of_heads = heads.select("part", "conv_id", F.col("at").cast("long").alias("depth"), "x1", "x2", *(_xor(F.col(f"x{k + 1}"), F.when(F.col("at") > 0, mark[k])).alias(f"p{k + 1}") for k in (0, 1)), zero("t.chars").alias("chars"), "pre", (F.col("at") == F.col("length")).alias("ends"))
    return cut(of_own.unionByName(of_heads))


def _merged(rows: DataFrame, **columns: tuple) -> DataFrame:
    """The rows of each node merged: the parts' tables by groups of parts, then these groups' by key. columns: name to
    (function, expression), of functions that may be applied again to what they give."""
    groups = max(1, int(partitions(rows.sparkSession) ** 0.5))
    local = rows.groupBy(*KEY, (F.col("part") % groups).alias("group")).agg(*(f(e).alias(name) for name, (f, e) in columns.items()))
    return local.groupBy(*KEY).agg(*(f(name).alias(name) for name, (f, _) in columns.items()))


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of `prefix_rows`: see `op11_conversation_trie` for the columns."""
    spark = rows.sparkSession
    same = F.max  # of values that are equal for all rows of a node
    nodes = cut(_merged(rows, n_convs=(F.sum, F.lit(1).cast("long")), conv_id=(F.min, F.col("conv_id")), chars=(same, F.col("chars")), pre=(same, F.col("pre")), p1=(same, F.col("p1")), p2=(same, F.col("p2"))))
    up = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
    nodes = cut(nodes.join(up.groupBy(*KEY).agg(F.count("*").alias("n_children")), KEY, "left").fillna(0, ["n_children"]))

    # Parents of so many children that a task would notice are few, so they go to all tasks; the others are shuffled.
    crowd = max(1000, nodes.count() // partitions(spark))  # at most as many parents as there are partitions
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    back = ["depth", "p1", "p2"]
    child = nodes.join(F.broadcast(parents.where(F.col("n_children") > crowd).select(*back, F.col("parent_conv_id").alias("hot"))), back, "left")
    plain = child.where("hot IS NULL").join(parents.where(F.col("n_children") <= crowd).drop("n_children"), back, "left")
    child = plain.drop("hot").unionByName(child.where("hot IS NOT NULL").withColumnRenamed("hot", "parent_conv_id"))

    # Of each conversation: chars of the turns that it shares with smaller ones, and whether it owns a leaf.
    owners = nodes.groupBy("conv_id").agg(F.min_by(F.col("pre") - F.col("chars"), "depth").alias("q"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    segs = rows.groupBy("part", "conv_id").agg(F.max("pre").alias("upto")).withColumn("all", F.max("upto").over(Window.partitionBy("conv_id")))
    worth = segs.join(owners, "conv_id", "left").select("part", "conv_id", F.coalesce("q", "all").alias("q"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    charged = rows.join(worth, ["part", "conv_id"])
    sums = _merged(charged, saved_tokens=(F.sum, F.greatest(F.lit(0), F.col("q") - F.col("pre") + F.col("chars"))), n_leaves=(F.sum, F.col("leaf")))

    ends = sha256_of_ids(rows.where("ends"), KEY, "conv_id").withColumnRenamed("sha256", "ends_sha256")
    found = child.join(sums, KEY).join(ends, KEY, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def trie_of(conversations: DataFrame, shared: Column | None = None) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text), rebuilt if `shared` is given (see `prefix_rows`).

    Turns are ordered by turn, nulls first, then by hashes of role and text; repeated rows count as turns. Null roles and
    texts are empty. Rows without conv_id take no part. An empty table has no conversation, and so no node. Texts are
    hashed where they stand, whole, and never shuffled; other columns are not looked at.
    """
    order = ["turn", "c1", "c2"]
    return conversation_trie(prefix_rows(dealt_in_order(turns_of(conversations), ["conv_id", *order]), order, shared))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie_of(table(spark, sf_dir, "conversations"), shared_turns())


_CRC32 = """list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
 lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))"""
#: The same by whole prefixes: a node is a list of turns, and is summed over all of its ancestors one by one.
OP11_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, xor({_CRC32}, 4294967295) % 6 AS h FROM t),
b AS (SELECT c.conv_id, t.role, t.text, 0 AS own, t.k FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.k <= c.h
 UNION ALL SELECT c.conv_id, t.role, t.text, 1, t.k FROM c JOIN t USING (conv_id) WHERE t.k > c.h),
s AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY own, k) AS turns FROM b GROUP BY conv_id UNION ALL SELECT conv_id, [] FROM c WHERE conv_id NOT IN (SELECT conv_id FROM b)),
r AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM s),
p AS (SELECT conv_id, depth, turns[1:depth] AS node, len(turns) = depth AS ends, CASE WHEN depth > 0 THEN length(turns[depth].text) ELSE 0 END AS chars FROM r),
n AS (SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, max(chars) AS chars, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ids FROM p GROUP BY node),
kids AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(kids.n_children, 0) AS n_children FROM n LEFT JOIN kids USING (node)),
up AS (SELECT p.node, sum((m.n_convs - 1) * m.chars) AS saved_tokens, count(*) FILTER (m.n_children = 0) AS n_leaves FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.node)
SELECT m.conv_id, m.depth, parent.conv_id AS parent_conv_id, m.n_convs, m.n_children, up.n_leaves, CAST(up.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(m.ids, '')) AS ends_sha256
FROM m JOIN up USING (node) LEFT JOIN n parent ON m.depth > 0 AND parent.node = m.node[1:m.depth - 1]"""
