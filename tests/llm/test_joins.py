"""Line dedup, n-gram join, fingerprints: against plain Python over all pairs."""

import collections
import hashlib
import re

import duckdb
import pytest

from pointloom.llm import line_dedup, ngram_join, spotsigs
from tests.llm.fixtures import DOCS, documents, empty, texts

D = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def components(rows):
    low = {i: i for i, _ in rows}
    sets = [(i, shingles(t)) for i, t in rows]
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and low[j] < low[i] and 100 * len(a & b) >= 75 * len(a | b):
                    low[i], changed = low[j], True
    return {i: (len(s), low[i]) for i, s in sets}


def test_similar_components(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    found = ngram_join.similar_components(documents(spark)).collect()
    want = components(rows)
    assert len(found) == len(rows) + 2
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None} == want
    assert want[9][1] == want[10][1] == 8 and want[11][1] == 11 and want[5][1] == 4
    assert ngram_join.similar_components(empty(spark)).count() == 0


def test_chains_and_groups_of_copies(spark):
    words = [f"x{i}" for i in range(400)]
    rows = [(100 - k, " ".join([*words[: 10 * k], *(f"y{i}" for i in range(10 * k, 10 * k + 10)), *words[10 * k + 10 :]])) for k in range(30)]
    rows += [(200 + k, " ".join(words)) for k in range(50)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == components(rows)


def test_one_of_each_component_stays(spark):
    docs = documents(spark)
    kept = ngram_join.one_of_each_component(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    want = components(list(enumerate(texts())))
    assert ids == collections.Counter([i for i, (_, low) in want.items() if i == low] + [None])
    assert ngram_join.one_of_each_component(empty(spark)).count() == 0


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def repeated(rows):
    units = lambda w: tuple(w) if len(w) >= 4 else tuple("\t" + c for c in " ".join(w))
    words = lambda x: re.findall(r"[^\x20\x09-\x0D]+", x)
    lines = sorted((d, n, units(words(x))) for d, t in rows for n, x in enumerate((t or "").split("\n")) if words(x))
    first = {}
    for d, n, w in lines:
        first.setdefault(w, (d, n))
    out = {}
    for d, n, w in lines:
        near = min((p for v, p in first.items() if v != w and p < first[w] and min(len(v), len(w)) >= 4 and one_edit(v, w)), default=None)
        of = near or (first[w] if first[w] < (d, n) else None)
        if of:
            out[d, n] = of
    return out


def test_repeated_lines(spark):
    rows = list(enumerate(texts()))
    found = {(r["doc_id"], r["line_no"]): (r["of_id"], r["of_line_no"]) for r in line_dedup.repeated_lines(documents(spark, repeat=False)).collect()}
    assert found == repeated(rows) and (13, 0) in found and (14, 0) in found
    assert line_dedup.repeated_lines(empty(spark)).count() == 0


def test_short_lines_and_common_lines(spark):
    said = ["one two three", "one two thred", "one two", "one twa", "a b c d", "a b c", "a b x d", "abcd", "abd", "abcx", "雪の夜道😀", "雪の夜道😁", "雪夜", "雪道", "a b c d e", "x"]
    rows = [(i, "\n".join([t, "everywhere", "x"])) for i, t in enumerate(said)] + [(100 + i, "everywhere") for i in range(300)]
    found = {(r["doc_id"], r["line_no"]): (r["of_id"], r["of_line_no"]) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == repeated(rows)
    assert found[1, 0] == (0, 0) and found[11, 0] == (10, 0) and (12, 0) not in found and found[399, 0] == (0, 1)


def test_drop_repeated_lines(spark):
    docs = documents(spark)
    found = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(docs).collect()}
    gone = repeated(list(enumerate(texts())))
    for i, t in enumerate(texts()):
        left = [x for n, x in enumerate((t or "").split("\n")) if (i, n) not in gone]
        if t is not None and t.split() and not "".join(left).split():
            assert i not in found
        else:
            assert (found[i]["text"] or "") == "\n".join(left)
            assert t is None or found[i]["n_chars"] == len(found[i]["text"])
    assert line_dedup.drop_repeated_lines(docs).columns == docs.columns and None in found


def test_line_dedup_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    want = sorted(map(tuple, con.execute(line_dedup.OP3_SQL).df()[["doc_id", "line_no", "of_id", "of_line_no"]].to_numpy().tolist()))
    assert sorted(map(tuple, line_dedup.op3_deletion_line_dedup(spark, D).toPandas().to_numpy().tolist())) == want


def test_fingerprints_with_successors(spark):
    rows = list(enumerate(texts()))
    found = {r["doc_id"]: r for r in spotsigs.compare_with_successors(documents(spark, repeat=False)).collect()}
    assert len(found) == len(rows)
    of = spotsigs.Fingerprinter()
    for i, t in rows:
        t, nxt = t or "", texts()[i - 1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and found[i]["n_chars"] == len(t)
        assert found[i]["fingerprint"] == spotsigs.encoded(of(t)) and found[i]["edited_fingerprint"] == spotsigs.encoded(of(edited))
        a, b = set(of(t).tolist()), set(of(edited).tolist())
        assert found[i]["near_edited"] == pytest.approx(len(a & b) / len(a | b))
    assert found[9]["fingerprint"] == found[10]["fingerprint"]
    assert spotsigs.compare_with_successors(empty(spark)).count() == 0
    assert spotsigs.compare_with_successors(documents(spark)).count() == len(rows) + 2


def test_similar_fingerprints(spark):
    base = "the cat sat on the mat and a dog was in the garden with his bone for the whole of the long day so it is that they all had to go home".split()
    rows = [(i, " ".join(w for k, w in enumerate(base * 3) if k != i)) for i in range(8)] + [(9, "other words only here"), (10, "the sun and the moon are up in the sky at noon")]
    found = {(r["a"], r["b"]) for r in spotsigs.similar_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    of = spotsigs.Fingerprinter()
    classes = {}
    for i, t in rows:
        classes.setdefault(tuple(of(t).tolist()), i)
    want = {(i, j) for a, i in classes.items() for b, j in classes.items() if i < j and len({*a} & {*b}) >= 0.75 * len({*a} | {*b})}
    assert found == want and want
    assert spotsigs.similar_fingerprints(spark.createDataFrame([], DOCS)).count() == 0
