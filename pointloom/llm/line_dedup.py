"""Operator 3: lines that repeat an earlier line, up to one edit, by a join of deletion neighbourhoods.

Lines are sequences of units: of words between ASCII white space, or, if there are fewer than four words, of characters.
An edit puts in, takes out or changes one unit, and is allowed if it is no more than a quarter of either line, that is,
from four units on; shorter lines are compared for equality. Two lines are
within one edit if and only if they agree after one unit at one place is deleted from both (a change), or from the
longer only. So every line emits a hashed key for each of its deletions, and one for itself; lines meet in equal keys,
and the units of those that meet are compared. The keys hold the place of a change, and say which side is shorter, so
that each key needs only the earliest line of either side: no group's pairs are ever made.

A line within one edit of another shares all units left or right of its middle with it. Only lines that share such a
half emit their deletions; others have no partner. Hashes of deletions come from running XORs, in time proportional to
the line's length.

All of this is DataFrame functions.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.common import cut, maybe_in, partitions, table

#: One edit in so many units is allowed, so lines of fewer are only compared for equality.
LEAST_UNITS = 4


def _lines(docs: DataFrame, id_column: str) -> DataFrame:
    """id, line_no (from 0) and units of every line that has a word; characters are marked by a tab, which no word holds."""
    text = functools.reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(" ")), "\t\v\f\r", F.col("text"))
    lines = docs.select(F.col(id_column).alias("id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    found = lines.where(F.trim("line") != "").select("id", "line_no", F.array_remove(F.split("line", " "), "").alias("words"))
    characters = F.transform(F.split(F.array_join("words", " "), ""), lambda c: F.concat(F.lit("\t"), c))
    return found.select("id", "line_no", F.when(F.size("words") >= LEAST_UNITS, F.col("words")).otherwise(characters).alias("units"))


def _keyed(docs: DataFrame, id_column: str) -> DataFrame:
    """_lines with n, and k1 and k2, two hashes of all units."""
    return _lines(docs, id_column).withColumns({"n": F.size("units"), "k1": F.xxhash64("units"), "k2": F.xxhash64(F.lit(1), "units")})


def _halves() -> Column:
    """Keys of a line's left and right part: as the shorter, or equally long, line of a pair, and as the longer one."""
    n, keys = F.size("units"), []
    for shorter in (n, n - 1):
        left = F.floor(shorter / 2).cast("int")
        keys.append(F.xxhash64(F.lit("left"), shorter, F.slice("units", F.lit(1), left)))
        keys.append(F.xxhash64(F.lit("right"), shorter, F.slice("units", n - (shorter - left) + 1, shorter - left)))
    return F.array(*keys)


def _may_have_partner(distinct: DataFrame) -> DataFrame:
    """k1, k2 and first of lines that share a half with another."""
    halves = distinct.where(F.col("halves").isNotNull()).select("k1", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("lines")).where("lines > 1").select("half")
    return distinct.select("k1", "k2", "first").join(halves.join(shared, "half").select("k1").distinct(), "k1")


def _deletions(lines: DataFrame) -> DataFrame:
    """key, role, and the line's me (first place, k1, k2), for all variants of the lines (me, units)."""
    unit = lines.select("me", F.size("units").alias("n"), F.posexplode("units").alias("at", "unit"))
    unit = unit.withColumns({"stay": F.xxhash64("unit", "at"), "move": F.xxhash64("unit", F.col("at") - 1)})
    line = Window.partitionBy("me")
    upto = line.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Units before the deleted one stay where they are, those after it move up by one.
    sums = unit.select(
        "me", "n", "at",
        F.bit_xor("stay").over(upto).bitwiseXOR(F.col("stay")).bitwiseXOR(F.bit_xor("move").over(line)).bitwiseXOR(F.bit_xor("move").over(upto)).alias("rest"),
        F.bit_xor("stay").over(line).alias("all"),
    )
    variant = lambda role, *of: F.struct(F.lit(role).alias("role"), F.xxhash64(F.lit(role == "change"), *of).alias("key"))
    itself = F.when(F.col("at") == 0, variant("shorter", "all", "n"))
    found = F.array(variant("change", "rest", "n", "at"), variant("longer", "rest", F.col("n") - 1), itself)
    return sums.select("me", F.explode(F.array_compact(found)).alias("v")).select("me", "v.role", "v.key")


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two sequences of units are at most one unit apart."""
    differ = lambda x, y: F.zip_with(x, y, lambda p, q: p != q)
    changed = F.size(F.filter(differ(a, b), lambda d: d)) <= 1

    def longer(x: Column, y: Column) -> Column:
        """x is y with one unit more, at the first place where they differ."""
        at = F.array_position(differ(F.slice(x, F.lit(1), F.size(y)), y), True)
        at = F.when(at == 0, F.size(x)).otherwise(at).cast("int")
        return F.concat(F.slice(x, F.lit(1), at - 1), F.slice(x, at + 1, F.size(x))) == y

    size = F.size(a) - F.size(b)
    return F.when(size == 0, changed).when(size == 1, longer(a, b)).when(size == -1, longer(b, a)).otherwise(False)


def _near_earlier(distinct: DataFrame, docs: DataFrame, id_column: str) -> DataFrame:
    """k1, k2, near: the earliest line before it that a line is one edit from."""
    wanted = cut(_may_have_partner(distinct))
    # The units of these lines, from the documents where they stand first.
    home = cut(wanted.select(F.col("first.id").alias("home")).distinct())
    homes = maybe_in(docs, id_column, home).join(home, F.col(id_column).eqNullSafe(F.col("home")), "left_semi")
    found = maybe_in(_keyed(homes, id_column), "k1", wanted.select("k1")).dropDuplicates(["k1", "k2"]).select("k1", "k2", "units")
    lines = cut(found.join(wanted, ["k1", "k2"]).select(F.struct("first", "k1", "k2").alias("me"), "units"))
    variants = cut(_deletions(lines))
    side = lambda *roles: F.min(F.when(F.col("role").isin(*roles), F.col("me")))
    met = variants.groupBy("key").agg(side("shorter", "change").alias("short"), side("longer").alias("long"), F.count("*").alias("k")).where("k > 1").drop("k")
    partner = F.when(F.col("role") == "shorter", F.col("long")).otherwise(F.col("short"))
    earlier = variants.join(met, "key").select("me", partner.alias("partner")).where(F.col("partner.first") < F.col("me.first"))
    pairs = earlier.groupBy("me").agg(F.min("partner").alias("partner"))
    both = pairs.join(lines, "me").join(lines.select(F.col("me").alias("partner"), F.col("units").alias("other")), "partner")
    return both.where(_one_edit(F.col("units"), F.col("other"))).select("me.k1", "me.k2", F.col("partner.first").alias("near"))


def repeated_lines(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id_column, line_no, of_id, of_line_no for every line that repeats an earlier one.

    Earlier means a smaller (id, line_no), ids that are null first. A line repeats the earliest line of the same units;
    if it is that one itself and has LEAST_UNITS units, the earliest line before it at one edit from it, which may be a
    repeated line in turn. Lines without a word, and null or empty texts, have no part in this. Rows that repeat with
    the same id are the same lines, and repeat nothing. Only id_column and text of docs are read.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs.select(id_column, "text"), id_column)
    halves = F.when(F.size("units") >= LEAST_UNITS, _halves())
    distinct = cut(
        keyed.select("id", "line_no", "k1", "k2", halves.alias("halves"))
        .groupBy("k1", "k2")
        .agg(F.min(F.struct("id", "line_no")).alias("first"), F.first("halves").alias("halves"), F.count("*").alias("lines"))
    )
    near = _near_earlier(distinct, docs.select(id_column, "text"), id_column)
    verdict = distinct.select("k1", "k2", "first", "lines").join(near, ["k1", "k2"], "left").where("lines > 1 or near is not null")
    # A line with more places than `share` has its verdict in as many parts as hold it; there are few such lines.
    share = max(1, (distinct.agg(F.sum("lines")).first()[0] or 0) // (4 * partitions(spark)))
    parts = F.ceil(F.col("lines") / share).cast("int")
    hot = F.broadcast(distinct.where(F.col("lines") > share).select("k1", "k2", parts.alias("parts")))  # 4 a partition at most
    this = F.struct("id", "line_no")
    dealt = keyed.select("id", "line_no", "k1", "k2").join(hot, ["k1", "k2"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id", "line_no"), F.col("parts")), F.lit(0)).cast("int"))
    all_lines = dealt.join(verdict.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))), ["k1", "k2", "part"])
    found = all_lines.withColumn("of", F.when(F.col("first") < this, F.coalesce("near", "first")).otherwise(F.col("near"))).where("of is not null")
    return found.select(F.col("id").alias(id_column), "line_no", F.col("of.id").alias("of_id"), F.col("of.line_no").alias("of_line_no"))


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """docs without the lines that repeated_lines finds, n_chars (if there) following; rows left without a word go,
    unless they had none before. Other columns stay as they are."""
    gone = repeated_lines(docs, id_column).distinct().groupBy(id_column).agg(F.collect_list("line_no").alias("_ld_gone"))
    gone = cut(gone.select(F.col(id_column).alias("_ld_id"), "_ld_gone"))
    ids = gone.select("_ld_id")
    both = maybe_in(docs, id_column, ids).join(gone, F.col(id_column).eqNullSafe(F.col("_ld_id")), "left")
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), F.array_contains("_ld_gone", i).alias("gone")))
    text = F.array_join(F.transform(F.filter(marked, lambda m: ~m["gone"]), lambda m: m["x"]), "\n")
    out = both.withColumn("_ld_text", F.when(F.col("_ld_gone").isNull(), F.col("text")).otherwise(text))
    out = out.where(F.col("_ld_gone").isNull() | F.col("_ld_text").rlike("[^\\x20\\x09-\\x0D]"))
    changed = {"text": F.col("_ld_text").alias("text")}
    if "n_chars" in docs.columns:
        n = F.when(F.col("_ld_gone").isNull(), F.col("n_chars")).otherwise(F.length("_ld_text"))
        changed["n_chars"] = n.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    out = out.select(*(changed.get(c, F.col(c)) for c in docs.columns))
    return out.unionByName(maybe_in(docs, id_column, ids, maybe=False))


def op3_deletion_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents
), worded AS (
  SELECT doc_id, line_no, list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM split
), joined AS (
  SELECT doc_id, line_no, words, array_to_string(words, ' ') AS line FROM worded
), lines AS (
  SELECT doc_id, line_no, CASE WHEN len(words) >= 4 THEN words ELSE list_transform(range(1, length(line) + 1), lambda i: chr(9) || substring(line, i, 1)) END AS words FROM joined
), firsts AS (
  SELECT words, min((doc_id, line_no)) AS first FROM lines WHERE len(words) > 0 GROUP BY words
), variants AS (
  SELECT first, len(words) AS n, i, list_concat(words[1:i-1], words[i+1:]) AS rest
  FROM (SELECT first, words, unnest(generate_series(1, len(words))) AS i FROM firsts WHERE len(words) >= 4)
), pairs AS (
  SELECT b.first AS line, a.first AS other FROM variants a JOIN variants b ON a.rest = b.rest AND a.i = b.i WHERE a.first < b.first
  UNION ALL SELECT v.first, f.first FROM variants v JOIN firsts f ON v.rest = f.words WHERE len(f.words) >= 4 AND f.first < v.first
  UNION ALL SELECT f.first, v.first FROM variants v JOIN firsts f ON v.rest = f.words WHERE len(f.words) >= 4 AND v.first < f.first
), near AS (SELECT line, min(other) AS other FROM pairs GROUP BY line),
found AS (
  SELECT l.doc_id, l.line_no, CASE WHEN (l.doc_id, l.line_no) > f.first THEN coalesce(n.other, f.first) ELSE n.other END AS earlier
  FROM lines l JOIN firsts f ON l.words = f.words LEFT JOIN near n ON n.line = f.first
)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, earlier[1] AS of_id, CAST(earlier[2] AS INTEGER) AS of_line_no FROM found WHERE earlier IS NOT NULL
"""
