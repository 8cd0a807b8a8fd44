"""Operator 9: byte-level BPE by Spark's higher-order functions.

Texts are split by the vocabulary's pattern. A fold over a word's byte array merges, at each step, the neighbouring pair
of the lowest rank, until no pair has one. It carries a number for each part: the rank of the part and the next one, the
byte it begins at, its id; the least number is the pair to merge, and a merge changes two. Ranks of pairs are a
table in which a pair has two places, so a look-up compares two numbers at most.

Distinct words are counted over all texts. Those that occur most often, as many as a table of bounded size holds, are
encoded once each; other words where they stand. So no word's places are ever shuffled, and the commonest word is no
more work to one task than to another. Decoding concatenates the bytes of the ids' pieces.

The fold's work grows with the square of a word's length, so words of more than LONG bytes are merged by a heap instead,
in Python. Java's letters and numbers are those of an older Unicode than tiktoken's; the newer ones are added to the
pattern where a text may have them.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import cut, in_small_batches, partitions, table

#: Java's \\s, \\p{L} and \\p{N} are those of (some version of) Unicode under (?U).
UNICODE = "(?U)"
#: A part's number: the rank of its pair above all, then the byte it begins at, then its id, of BITS bits each.
BITS = 20
MASK = (1 << BITS) - 1
#: The number of a part whose pair has no rank is not below this.
GONE = 1 << 62
#: Of the words that occur most often, no more than so many, of no more than so many bytes each, are encoded beforehand.
FREQUENT, FREQUENT_BYTES = 1 << 17, 64
WORD_BUCKETS = 131_071
#: Words of more bytes are merged by a heap; a text that may hold one has a run of RUN characters without a space, or of white space.
LONG, RUN = 1024, 250
#: So many characters are looked at at once for their classes.
AT_ONCE = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def newer_characters(spark: SparkSession) -> dict[str, str]:
    """For \\p{L} and \\p{N}: what a character class needs besides, in Java, to be tiktoken's, as ranges."""
    import tiktoken

    some = ["".join(chr(c) for c in range(at, at + AT_ONCE) if not 0xD800 <= c < 0xE000) for at in range(0, 0x110000, AT_ONCE)]
    rows = spark.createDataFrame([(s,) for s in some], "s string")
    out = {}
    for name in ("\\p{L}", "\\p{N}"):
        bytes_only = tiktoken.Encoding(name, pat_str=f"{name}+", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        theirs = {c for s in some for c in bytes_only.decode(bytes_only.encode_ordinary(s))}  # what the pattern does not match is left out
        javas = {c for r in rows.select(F.regexp_replace("s", f"{UNICODE}[^{name}]", "").alias("s")).collect() for c in r["s"]}
        ranges: list[list[int]] = []
        for c in sorted(map(ord, theirs - javas)):
            ranges[-1:] = [[ranges[-1][0], c]] if ranges and ranges[-1][1] == c - 1 else [*ranges[-1:], [c, c]]
        out[name] = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)
    return out


def extended(pattern: str, more: dict[str, str]) -> str:
    """pattern with `more` added to each mention of a class, inside brackets or not."""
    out, k, inside = "", 0, False
    while k < len(pattern):
        if name := next((n for n in more if pattern.startswith(n, k)), None):
            out += name + more[name] if inside else f"[{name}{more[name]}]"
            k += len(name)
            continue
        step = 2 if pattern[k] == "\\" else 1
        inside = (inside or pattern[k] == "[") and pattern[k] != "]"
        out, k = out + pattern[k : k + step], k + step
    return out


def split_words(text: str, pattern: str, more: dict[str, str]) -> Column:
    """The pattern's matches in a column of texts, an array. The wider pattern is slower, so it is for texts with
    characters from the first of the newer ones on."""
    first = min((int(r[3 : r.index("}")], 16) for r in more.values() if r), default=0x110000)
    of = lambda p: F.regexp_extract_all(text, F.lit(UNICODE + p), F.lit(0))
    if first == 0x110000:
        return of(pattern)
    return F.when(F.col(text).rlike(f"[\\x{{{first:x}}}-\\x{{10ffff}}]"), of(extended(pattern, more))).otherwise(of(pattern))


def heap_merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: neighbours of the lowest rank merge first, of equal ones the first, by a heap of pairs."""
    n = len(word)
    end, before, after = [k + 1 for k in range(n)], [k - 1 for k in range(n)], [k + 1 for k in range(n)]  # of the part that begins at k
    pair = lambda a: ranks.get(word[a : end[after[a]]]) if after[a] < n else None
    heap = [(r, k, k + 2) for k in range(n) if (r := pair(k)) is not None]
    heapq.heapify(heap)
    while heap:
        _, a, upto = heapq.heappop(heap)
        if end[a] == 0 or (b := after[a]) >= n or end[b] != upto:
            continue  # one of the two has merged meanwhile
        end[a], end[b], after[a] = upto, 0, after[b]
        if after[a] < n:
            before[after[a]] = a
        for k in (before[a], a):
            if k >= 0 and (r := pair(k)) is not None:
                heapq.heappush(heap, (r, k, end[after[k]]))
    return [ranks[word[k : end[k]]] for k in range(n) if end[k]]


def _value(spark: SparkSession, rows: list, kind: str) -> Column:
    """rows as the value of a query of one row: it stands in plans by name, where a literal is spelt out at each mention."""
    text = spark.createDataFrame([(json.dumps(rows, separators=(",", ":")),)], "s string")
    return text.select(F.from_json("s", kind).alias("v")).scalar()


def pair_table(ranks: dict[bytes, int]) -> tuple[list[int], int, int]:
    """Places of all pairs of ids that merge, as rank << 2 * BITS | pair, -1 where there is none; and two numbers: a pair's
    place is its remainder by either (so whoever is put at a taken place sends its holder to that one's other)."""
    assert len(ranks) < MASK, "ids have BITS bits"
    pairs = [rank << 2 * BITS | a << BITS | b for piece, rank in ranks.items() for k in range(1, len(piece)) if (a := ranks.get(piece[:k])) is not None and (b := ranks.get(piece[k:])) is not None]
    first = max(61, 3 * len(pairs)) | 1
    while True:
        by = (first, first + 2)
        held = [-1] * by[1]
        if all(_placed(x, held, by) for x in pairs):
            return held, *by
        first += 4


def _placed(x: int, held: list[int], by: tuple[int, int]) -> bool:
    pair = x & ((1 << 2 * BITS) - 1)
    at = pair % by[0]
    for _ in range(500):
        x, held[at] = held[at], x
        if x < 0:
            return True
        pair = x & ((1 << 2 * BITS) - 1)
        at = pair % by[1] if pair % by[0] == at else pair % by[0]
    return False


def _with(value: Column, body) -> Column:
    """body(value), value being worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@dataclass(frozen=True)
class Merges:
    """What encoding a word needs: the pairs' table, the two numbers of its places, and the ids of single bytes."""

    table: Column
    by: tuple[int, int]
    single: Column

    def bound(self, body) -> Column:
        """body(self), its table being looked up once."""
        return _with(self.table, lambda t: body(replace(self, table=t)))

    def ranked(self, a: Column, b: Column) -> Column:
        """The rank of the pair (a, b), in its place of a number; GONE if it has none or one of them is null."""

        def found(pair: Column) -> Column:
            out = F
            for by in self.by:
                held = F.get(self.table, pair % by)
                out = out.when(held.bitwiseAND(F.lit((1 << 2 * BITS) - 1)) == pair, held - pair)
            return out.otherwise(F.lit(GONE))

        return _with(a * (1 << BITS) + b, found)


def with_tables(df: DataFrame, ranks: dict[bytes, int]) -> tuple[DataFrame, Merges]:
    """df with a column of the pairs' table, and the merges that are worked out of it."""
    held, *by = pair_table(ranks)
    single = F.from_json(F.lit(json.dumps([ranks[bytes([b])] for b in range(256)])), "array<bigint>")
    return df.withColumn("pairs", _value(df.sparkSession, held, "array<bigint>")), Merges(F.col("pairs"), tuple(by), single)


def encoded_word(word: Column, merges: Merges) -> Column:
    """The ids of one word, a string of less than 2^BITS bytes; merges are best bound before."""
    part = lambda x: x.bitwiseAND(F.lit(MASK))
    begin = lambda x: x.bitwiseAND(F.lit(MASK << BITS))

    def merged(parts: Column) -> Column:
        def at_lowest(low: Column, at: Column) -> Column:
            id_, before = F.shiftright(low, 2 * BITS), F.get(parts, at - 2)
            new = merges.ranked(id_, part(F.get(parts, at + 1))) + begin(low) + id_
            new_before = merges.ranked(part(before), id_) + before.bitwiseAND(F.lit((1 << 2 * BITS) - 1))
            after = F.slice(parts, at + 2, F.size(parts))
            return F.when(at == 1, F.concat(F.array(new), after)).otherwise(F.concat(F.slice(parts, F.lit(1), at - 2), F.array(new_before, new), after))

        # The parts that begin no later are counted: array_position took most of the time.
        at = lambda low: F.size(F.filter(parts, lambda x: begin(x) <= begin(low)))
        return _with(F.array_min(parts), lambda low: F.when(low >= GONE, parts).otherwise(_with(at(low), lambda at: at_lowest(low, at))))

    size = F.octet_length(word)
    one_byte = lambda chars: lambda k: F.get(merges.single, F.ascii(F.substring(chars, k, F.lit(1))))
    ids = _with(F.decode(word.cast("binary"), "ISO-8859-1"), lambda chars: F.transform(F.sequence(F.lit(1), size), one_byte(chars)))  # a character a byte
    start = _with(ids, lambda ids: F.transform(ids, lambda a, k: merges.ranked(a, F.get(ids, k + 1)) + k.cast("bigint") * (1 << BITS) + a))
    return F.aggregate(F.sequence(F.lit(1), size), start, lambda parts, _: merged(parts), lambda parts: F.transform(parts, lambda x: part(x).cast("int")))


def _frequent(counts: DataFrame) -> DataFrame:
    """The words of counts (word, n), a table at rest, that occur at least so often that FREQUENT do at most."""
    short = counts.where(F.octet_length("word") <= FREQUENT_BYTES)
    step = F.floor(F.log2("n") * 8).alias("step")
    seen, least = 0, None
    for row in short.groupBy(step).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():  # a row an eighth of a power of 2
        seen += row["words"]
        if seen > FREQUENT:
            break
        least = row["step"]
    return short.where(step >= least if least is not None else F.lit(False)).select("word")


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id_column, n_tokens, ids (array of int) and decoded (binary) for each row of docs; other columns are not read.

    Null and empty texts have no tokens, an empty table no rows. Rows that repeat have a row each; ids may be null and
    may repeat; columns of docs that are named ids or decoded are not looked at. Texts and words may be of any length. The
    ranks must be 0 and up without a gap, and hold all single bytes.
    """
    assert sorted(ranks.values()) == list(range(len(ranks))), "a piece must stand at its rank"
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    words = split_words("text", pattern, newer_characters(spark))
    counts = cut(docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(WORD_BUCKETS)).cast("int")
    frequent, merges = with_tables(_frequent(counts).repartition(partitions(spark), "word"), ranks)
    coded = frequent.select(bucket("word").alias("bucket"), "word", merges.bound(lambda m: encoded_word(F.col("word"), m)).alias("ids"))
    ids_of = lambda w, known, merges: F.coalesce(F.try_element_at(F.get(known, bucket(w)), w), encoded_word(w, merges))
    folded = _with(F.col("known"), lambda k: merges.bound(lambda m: F.flatten(F.transform(words, lambda w: ids_of(w, k, m)))))

    may_be_long = F.coalesce(F.col("text").rlike(f"[^ ]{{{RUN}}}|\\s{{{RUN}}}"), F.lit(False))
    plain = with_tables(docs.where(~may_be_long), ranks)[0].withColumn("known", _known(cut(coded))).select("id", F.coalesce(folded, F.array().cast("array<int>")).alias("ids"))
    is_long = lambda w: F.octet_length(w) > LONG
    odd = in_small_batches(docs.where(may_be_long)).select("id", words.alias("words"))
    odd = odd.withColumn("by_heap", _heap_udf(spark.sparkContext.broadcast(ranks))(F.array_distinct(F.filter("words", is_long))))
    odd = with_tables(odd, ranks)[0].select("id", merges.bound(lambda m: F.flatten(F.transform("words", lambda w: F.when(is_long(w), F.try_element_at("by_heap", w)).otherwise(encoded_word(w, m))))).alias("ids"))
    rows = plain.unionByName(odd)
    by_id = _value(spark, [piece.hex() for piece in sorted(ranks, key=ranks.__getitem__)], "array<string>")
    decoded = F.unhex(F.array_join(_with(F.col("by_id"), lambda pieces: F.transform("ids", lambda i: F.get(pieces, i))), ""))
    return rows.withColumn("by_id", by_id).select(F.col("id").alias(id_column), F.size("ids").cast("long").alias("n_tokens"), "ids", decoded.alias("decoded"))


def _known(coded: DataFrame) -> Column:
    """Buckets of maps from word to ids, of coded's rows (bucket, word, ids), FREQUENT at most, as one value that Spark puts
    into the plan in its own compact form; it never comes to the driver's Python."""
    held = coded.groupBy("bucket").agg(F.collect_list("word").alias("words"), F.collect_list("ids").alias("ids"))
    every = coded.sparkSession.range(WORD_BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(held, "bucket", "left")
    rows = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "words", "ids"))).alias("rows"))
    return rows.select(F.transform("rows", lambda r: F.map_from_arrays(r["words"], r["ids"])).alias("known")).scalar()


def _heap_udf(ranks):
    kind = pa.map_(pa.string(), pa.list_(pa.int32()))

    def merged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[(w, heap_merged(w.encode("utf-8", "surrogatepass"), ranks.value)) for w in words or ()] for words in batch.to_pylist()], kind)

    merged.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(merged, "map<string,array<int>>")


def op9_higher_order_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = encode_documents(table(spark, sf_dir, "documents"), ranks, pattern or public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
