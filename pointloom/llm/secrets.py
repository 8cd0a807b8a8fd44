"""Operator 7: secrets in texts, by fixed shapes and by a test of token efficiency.

Ordinary words cost few tokens under a byte-pair vocabulary; random strings cost nearly one token a character or two.
A run of key-like characters is flagged when it has fewer characters a token than a bound, unless it is a known digest,
a UUID, a number or an identifier: those are random-looking or long, but not secret. If a run is not flagged as a whole,
its parts are, each by its own ratio: words glued on by separators hide nothing. Within a long part, so is what a window
that slides over its tokens finds, if it mixes cases or has digits: words glued on without separators hide nothing either.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.common import in_small_batches, table

ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "dense")

LEAST = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Digests by their lengths in hex digits: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Words, numbers and version parts joined by separators: paths, slugs, constants, names in camel case.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|v[0-9]+")
#: (The same strings match without giving back, which on long ones that don't match would never end.)
IDENTIFIER = re.compile(r"(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[0-9]++)[_/=+-]*+)++")
#: Letters joined one or two at a time: lists of initials, rules.
UNSPELLED = re.compile(r"[A-Za-z]{0,2}(?:[+/_=-]+[A-Za-z]{0,2})*+")
LETTERS = re.compile(r"[A-Za-z]+")
#: Where a lower-case letter, a capital or a digit follows another kind of them, words in camel case left aside.
KIND_CHANGES = re.compile(r"(?<=[a-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[A-Z])[0-9]|(?<=[a-z])[A-Z](?![a-z])|(?<=[A-Z])[a-z](?![a-z])")
#: The parts of a run between its separators; a UUID is one.
BETWEEN = re.compile(rf"(?<![A-Za-z0-9]){UUID.pattern}(?![A-Za-z0-9])|[A-Za-z0-9]+")
CHARS_A_TOKEN = 2.0
#: A window holds tokens of so many characters at least, in parts of GLUED characters or more.
WINDOW, GLUED = 22, 40
#: In the window, tokens are shorter still, and these change between kinds of characters so often.
CHARS_A_WINDOW_TOKEN, KINDS_CHANGE = 1.75, 6
#: Tokens are counted in pieces of at most so many characters.
PIECE = 4096


@functools.lru_cache(maxsize=4)
def _vocabulary(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def _tokens(run: str, vocabulary: str) -> list[tuple[int, int, int]]:
    """(start, end, number of tokens) of pieces of about the same length, PIECE at most."""
    size = -(-len(run) // -(-len(run) // PIECE))
    return [(at, min(at + size, len(run)), len(_vocabulary(vocabulary).encode_ordinary(run[at : at + size]))) for at in range(0, len(run), size)]


def _known(run: str, vocabulary: str, bound: float) -> bool:
    """Digests, UUIDs, numbers, letters joined one or two at a time, and identifiers: parts whose letters have bound
    characters a token or more, and which, if there are digits, have four letters a part or more on average."""
    if DIGEST.fullmatch(run) or UUID.fullmatch(run) or UNSPELLED.fullmatch(run) or not re.search("[A-Za-z]", run):
        return True
    if not IDENTIFIER.fullmatch(run):
        return False
    if re.search("[0-9]", run):
        parts = PART.findall(run)
        if sum(map(len, parts)) < 4 * len(parts):
            return False
    letters = LETTERS.findall(run)
    return sum(map(len, letters)) >= bound * sum(n for x in letters for _, _, n in _tokens(x, vocabulary))


def _dense(run: str, vocabulary: str, bound: float) -> list[tuple[int, int]]:
    """(start, end) of what has fewer than bound characters a token: all of run, or else those of its pieces that do."""
    pieces = _tokens(run, vocabulary)
    if len(run) < bound * sum(n for _, _, n in pieces):
        return [(0, len(run))]
    found: list[tuple[int, int]] = []
    for a, b, n in pieces:
        if b - a < bound * n:
            found[-1:] = [(found[-1][0], b)] if found and found[-1][1] == a else [*found[-1:], (a, b)]
    return found


def _dense_in(run: str, vocabulary: str, bound: float) -> list[tuple[int, int]]:
    """(start, end) of what is dense in a run: all of it, or else neighbouring parts that are not known, together if
    they are dense together (base64 has separators within), or else each part by itself."""
    if _known(run, vocabulary, bound):
        whole = []
    elif (whole := _dense(run, vocabulary, bound)) == [(0, len(run))]:
        return whole
    groups: list[list[tuple[int, int]]] = [[]]
    for m in BETWEEN.finditer(run):
        if _known(m.group(), vocabulary, bound):
            groups.append([])
        else:
            groups[-1].append(m.span())
    found = []
    for group in filter(None, groups):
        a, b = group[0][0], group[-1][1]
        together = _judged(run, a, b, vocabulary, bound)
        found += together if together == [(a, b)] else _merged([*together, *(x for p in group for x in _judged(run, *p, vocabulary, bound))])
    found = _merged([*whole, *found])
    parts = [m.span() for m in BETWEEN.finditer(run) if not any(x < m.end() and m.start() < y for x, y in found)]
    return _merged([*found, *(x for p in parts for x in _glued(run, *p, vocabulary))])


def _judged(run: str, a: int, b: int, vocabulary: str, bound: float) -> list[tuple[int, int]]:
    if b - a < LEAST or _known(run[a:b], vocabulary, bound):
        return []
    return [(a + x, a + y) for x, y in _dense(run[a:b], vocabulary, bound)]


def _glued(run: str, a: int, b: int, vocabulary: str) -> list[tuple[int, int]]:
    """(start, end) of what windows within run[a:b], a part without separators, find dense."""
    if b - a < GLUED or DIGEST.fullmatch(run, a, b) or UUID.fullmatch(run, a, b):
        return []
    ends, at = [a], a
    for x, y, _ in _tokens(run[a:b], vocabulary):
        for token in _vocabulary(vocabulary).encode_ordinary(run[a + x : a + y]):
            at += len(_vocabulary(vocabulary).decode_single_token_bytes(token))
            ends.append(at)
    found, last = [], 0
    for first in range(len(ends)):
        while last < len(ends) and ends[last] - ends[first] < WINDOW:
            last += 1
        if last == len(ends):
            break
        if ends[last] - ends[first] < CHARS_A_WINDOW_TOKEN * (last - first):
            found.append((ends[first], ends[last]))
    return [(x, y) for x, y in _merged(found) if len(KIND_CHANGES.findall(run, x, y)) >= KINDS_CHANGE]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_spans(text: str, vocabulary: str, bound: float = CHARS_A_TOKEN) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of each span in code points, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in RUN.finditer(text):
        found += [(m.start() + a, 3, m.start() + b) for a, b in _dense_in(m.group(), vocabulary, bound)]
    return sorted(found)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType())]))


def scan_secrets(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """docs with a column `spans`: array of (start, kind, end), code points, end exclusive, by start and kind.

    Spans of one kind don't overlap; spans of different kinds may. A null or empty text has no spans. All columns of
    docs but `spans` are kept, whatever their names; texts of any length are read whole, one at a time.
    """

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
        for texts in batches:
            rows = [[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in find_spans(x.as_py() or "", vocabulary)] for x in texts]
            yield pa.array(rows, kind)

    spans.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return in_small_batches(docs).withColumn("spans", F.arrow_udf(spans, SPANS)(F.col(text)))


def redact(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        if b > at:
            out += [text[at:a], mark] if a >= at else []
            at = b
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, vocabulary: str, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in `text` replaced by mark (spans that overlap: by one); n_chars, if there, follows. Rows all stay."""

    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for x in texts:
                if (x := x.as_py()) and (found := find_spans(x, vocabulary)):
                    x = redact(x, [(a, b) for a, _, b in found], mark)
                rows.append(x)
            yield pa.array(rows, pa.string())

    clean.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    out = in_small_batches(docs).withColumn("text", F.arrow_udf(clean, "string")(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op7_token_efficiency_secrets(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary or default_vocabulary())
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(of(k) for k in KINDS), F.sha2(joined(F.filter("spans", lambda x: x["kind"] != "dense")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
