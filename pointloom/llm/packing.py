"""Operator 10: packs token sequences of a fixed capacity by a configuration linear program.

All that the program needs of the corpus is the histogram of piece lengths, at most `capacity` numbers. Multiplicative
weights solve the covering program: every length has a price, falling as it is covered; a knapsack dynamic program finds
the dearest configurations, one for each length, and those near the dearest enter with a small part of the copies that
their scarcest length has. This stops at a stated gap between the bounds that prices and uses give, or after a number of
rounds. The uses, scaled by the least covered length, are rounded down to what is there; what is left is placed best fit,
longest first, whole groups of equal sequences at a time. So the driver's work does not grow with the corpus. Then every
piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.common import cut, in_small_batches, partitions, table

CAPACITY = 4096
SEPARATOR = 1
ROUNDS = 200
STEP = 0.3
GAP = 0.01
#: Pieces shorter than this part of the capacity fill what is left in the end.
SHORT = 256
CACHED = 300_000


#: The bytes that byte-level vocabularies write as themselves; the others follow from code point 256 on.
_OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE = {b: chr(b) for b in _OWN} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_OWN}))}


# How the vocabulary that CachedEncoder knows normalizes and splits texts, as its file says it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTING = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class CachedEncoder:
    """The token ids of a text, as little-endian unsigned 32-bit integers, by a vocabulary of the tokenizers library.

    The vocabulary's splitting drops white space and never joins across it, so the ids of a text are those of its
    white-space-free chunks, and those the ids of a chunk's words. Both are looked up in bounded caches; the library's
    model merges new words. Texts with characters for which lower-casing, normal forms or white space could depend on
    the context or differ between libraries, or with a special token written out, go to the library whole; so do all
    texts if the vocabulary has another normalizer or splitting than the one below.
    """

    #: Basic and extended Latin without control characters but tab, line feed and carriage return, general punctuation.
    PLAIN = re.compile("[\t\n\r -~\xa1-\u012f\u0132-\u024f\u2010-\u2027\u2030-\u205e]*")
    WORD = regex.compile(WORDS)

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.known_splitting = (settings["normalizer"], settings["pre_tokenizer"]) == (NORMALIZER, SPLITTING)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or r"(?!)", re.IGNORECASE)
        self.model = self.tokenizer.model
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            tokens = self.model.tokenize(word.encode().decode("latin-1").translate(_BYTE))
            ids = self.words[word] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return ids

    def __call__(self, text: str) -> bytes:
        if not self.known_splitting or not self.PLAIN.fullmatch(text) or self.special.search(text):
            return self.whole([text])[0]
        found = unicodedata.normalize("NFC", text).lower().split()
        known = self.chunks
        try:
            return b"".join([known[w] for w in found])
        except KeyError:
            if len(known) > CACHED:
                known.clear()
            if len(self.words) > CACHED:
                self.words.clear()
            for w in found:
                if w not in known:
                    known[w] = b"".join(map(self.word, self.WORD.findall(w)))
            return b"".join([known[w] for w in found])


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> CachedEncoder:
    return CachedEncoder(path)


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece: a document's ids and the separator, cut only beyond capacity.

    Null and empty texts are the separator alone; null ids and repeated rows have pieces like all others; an empty table
    has none. Texts are encoded whole, whatever their length; other columns than doc_id and text are not read."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(vocabulary), np.array([separator], "<u4").tobytes()
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for row, text in enumerate(batch["text"]):
                ids = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, x in zip(out, (row, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            arrays = [batch["doc_id"].take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])]
            yield pa.record_batch(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_small_batches(docs).select("doc_id", "text").mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


Group = tuple[int, list[tuple[int, int]]]  # equal sequences: how many, and their (length, copies)


def _knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: for every capacity up to this one the greatest price that fits, and the last length taken for
    it (0: none more than for one less). price[l] is that of length l, below 0 where there is none."""
    best, last, down = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64), price[:0:-1].copy()
    for c in range(1, capacity + 1):
        gain = best[:c] + down[-c:]  # of adding a length from c down to 1; the longest wins a tie
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], last[c] = gain[k], c - k
        else:
            best[c] = best[c - 1]
    return best, last


def _with_length(length: int, last: np.ndarray, capacity: int) -> dict[int, int]:
    """The dearest configuration that has this length."""
    used: dict[int, int] = defaultdict(int, {length: 1})
    c = capacity - length
    while c > 0:
        if last[c]:
            used[int(last[c])] += 1
        c -= int(last[c]) or 1
    return used


def fractional(count: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP, gap: float = GAP) -> dict[tuple[tuple[int, int], ...], float]:
    """Configurations, (length, copies) each, and how often each is used, in fractions, so that every piece of count is
    covered by about as few uses as can be. (All lengths short of cover after the last round are covered in part.)

    The prices start in proportion to the lengths, where the bound of all tokens by the capacity has them. A use that
    covers a part p of a length's pieces takes its price times exp(-p).
    """
    lengths = np.nonzero(count)[0]
    price = np.full(len(count), -1.0)
    price[lengths] = lengths / capacity
    covered, uses = np.zeros(len(count)), defaultdict(float)
    bound = 0.0
    for _ in range(rounds if len(lengths) else 0):
        best, last = _knapsack(price, capacity)
        enough = (1 - step) * best[capacity]
        bound = max(bound, float(price[lengths] @ count[lengths]) / best[capacity])  # no cover has fewer uses
        for length in lengths[np.argsort(covered[lengths], kind="stable")].tolist():
            if price[length] + best[capacity - length] < enough:
                continue
            found = _with_length(length, last, capacity)
            held, copies = np.array([*found]), np.array([*found.values()])
            if float(price[held] @ copies) < enough:  # prices have fallen since
                continue
            part = copies / count[held]
            times = step / part.max()
            uses[tuple(sorted(found.items(), reverse=True))] += times
            covered[held] += times * part
            price[held] *= np.exp(-times * part)
        price[lengths] /= price[lengths].max()
        if (least := covered[lengths].min()) > 0 and sum(uses.values()) / least <= bound * (1 + gap):
            break
    least = max(1.0, float(covered[lengths].min())) if len(lengths) else 1.0
    return {items: x / least for items, x in uses.items()}


def configurations(count: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP) -> list[Group]:
    """The fractional solution rounded: down at first, and then up as far as there are pieces, so that no length is used
    more often than it occurs. Configurations that waste more than the solution does on average, and those with pieces
    that are to fill what is left, are not used."""
    uses = fractional(count, capacity, rounds, step)
    waste = {items: capacity - sum(a * b for a, b in items) for items in uses}
    most = sum(waste[items] * x for items, x in uses.items()) / max(sum(uses.values()), 1e-9)
    order = sorted((waste[items], -x, items) for items, x in uses.items() if waste[items] <= most and items[-1][0] >= capacity // SHORT)
    left, out = count.copy(), defaultdict(int)
    for up in (False, True):
        for _, x, items in order:
            n = min(int(left[length]) // copies for length, copies in items)
            if n := n if up else min(n, int(-x)):
                out[items] += n
                for length, copies in items:
                    left[length] -= n * copies
    return [(n, [*items]) for items, n in out.items()]


def best_fit(count: np.ndarray, groups: list[Group], capacity: int) -> list[Group]:
    """Places the pieces of `count`, longest first, each into the fullest sequence with room for it, groups of equal
    sequences at once; opens new ones as needed."""
    by_room: dict[int, list[Group]] = defaultdict(list)
    for n, items in groups:
        by_room[capacity - sum(a * b for a, b in items)].append((n, items))
    for length in range(capacity, 0, -1):
        if not (left := int(count[length])):
            continue
        rooms = sorted(r for r in by_room if r >= length and by_room[r])
        for room in [*rooms, capacity]:
            fit = room // length
            pool = by_room.pop(room, []) if room in rooms else [(-(-left // fit), [])]
            while pool and left:
                n, items = pool.pop()
                full = min(n, left // fit)
                if full:
                    by_room[room - fit * length].append((full, [*items, (length, fit)]))
                    left, n = left - full * fit, n - full
                if n and left:  # fewer than fit pieces are left: one more sequence takes them
                    by_room[room - left * length].append((1, [*items, (length, left)]))
                    left, n = 0, n - 1
                if n:
                    pool.append((n, items))
            if pool:
                by_room[room] = pool + by_room.get(room, [])
            if not left:
                break
    return [g for pool in by_room.values() for g in pool if g[1]]


def plan(count: np.ndarray, capacity: int, rounds: int = ROUNDS) -> pd.DataFrame:
    """Where the pieces of each length go: those of rank first to first + n - 1 into sequences base and up, `copies` in each from offset on."""
    left, groups = count.copy(), configurations(count, capacity, rounds)
    for n, items in groups:
        for length, copies in items:
            left[length] -= n * copies
    # Best fit alone may do better by a few sequences, where rounding is coarse.
    packed = min(best_fit(left, groups, capacity), best_fit(count, [], capacity), key=lambda found: sum(n for n, _ in found))
    rows, base, taken = [], 0, np.zeros(capacity + 1, np.int64)
    for n, items in packed:
        at = 0
        for length, copies in items:
            rows.append((length, int(taken[length]), n * copies, base, copies, at))
            taken[length] += n * copies
            at += length * copies
        base += n
    assert (taken == count).all()
    return pd.DataFrame(rows, columns=["length", "first", "n", "base", "copies", "at"], dtype="int64")


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """pieces (doc_id, piece, length between 1 and capacity, any more columns) with sequence_id and offset.

    Every piece gets a place; within a sequence, places don't overlap and leave no gap before the last. Equal rows may
    stand in for one another. An empty table gives an empty result. Column names that start with `_pk_` are reserved.
    """
    spark = pieces.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(partitions(spark))).alias("_pk_salt")  # one length may have most rows
    pieces = cut(pieces.select("*", salt))
    by_salt = pieces.groupBy("length", "_pk_salt").agg(F.count("*").alias("n"))
    count = np.zeros(capacity + 1, np.int64)
    for row in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect():  # as many rows as there are lengths
        count[row["length"]] = row["n"]
    before = Window.partitionBy("length").orderBy("_pk_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_salt.select("length", "_pk_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_pk_before"))
    inside = Window.partitionBy("length", "_pk_salt").orderBy("doc_id", "piece")
    ranked = pieces.join(starts, ["length", "_pk_salt"]).withColumn("_pk_rank", F.col("_pk_before") + F.row_number().over(inside) - 1)
    places = spark.createDataFrame(plan(count, capacity, rounds), "length long, first long, n long, base long, copies long, at long")
    at = places.select(F.col("length").alias("_pk_length"), "first", "n", "base", "copies", "at").alias("p")  # bounded by lengths and rounds
    k = F.col("_pk_rank") - F.col("p.first")
    found = ranked.join(F.broadcast(at), (F.col("length") == F.col("p._pk_length")) & (k >= 0) & (k < F.col("p.n")))
    own = [F.col(c) for c in pieces.columns if c != "_pk_salt"]
    return found.select(*own, (F.col("p.base") + F.expr("(_pk_rank - p.first) div p.copies")).alias("sequence_id"), (F.col("p.at") + (k % F.col("p.copies")) * F.col("length")).alias("offset"))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Packs every document of docs (doc_id, text; a null text is empty), as cut_pieces cuts them. One row per piece; other
    columns are dropped, and an empty table gives an empty result. Of pieces of one length any may have a place."""
    return pack(cut_pieces(docs, vocabulary or default_vocabulary(), capacity), capacity, rounds)


def op10_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
