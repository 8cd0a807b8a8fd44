"""Nearest neighbours, shards, packing and the pipeline: against brute force."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pointloom.llm import ann, packing, sharding
from tests.llm.fixtures import documents, empty, texts

D = "/root/testdata/sf0.001"


def test_nearest_has_recall_and_exact_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = ann.nearest(table, table.where("vec_id % 100 = 0")).toPandas()
    rows = table.toPandas()
    ids, v = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    hit = 0
    for q, got in found.groupby("query_id"):
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        got = got.sort_values("rank")
        assert list(got["rank"]) == [*range(1, 11)]
        assert np.allclose(got["score"], [d[ids == i][0] for i in got["vec_id"]], rtol=0, atol=1e-12)
        hit += len({*got["vec_id"]} & {*ids[np.lexsort((ids, d))[:10]]})
    assert hit >= 0.9 * len(found)


def test_nearest_odd_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0]), (8, [None, 1.0]), (9, [float("inf"), 0.0]), (None, [1.0, 1.0]), (100, [0.9, 0.1]), (100, [0.9, 0.1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(table, table.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert [f for f in found if f[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (0, 4, 100), (0, 5, 3)]
    assert [f[2] for f in found if f[0] == 100] == [0, 1, 2, 3]
    assert ann.nearest(table.where("false"), table).count() == 0


def test_many_equal_vectors_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(1000 + i, [float(i), 1.0]) for i in range(50)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.nearest(table, table.where("vec_id % 100 = 0")).toPandas()
    assert list(found[found["query_id"] == 100].sort_values("rank")["vec_id"]) == [*range(10)]


def test_shards(spark):
    docs = documents(spark)
    found = sharding.prefix_sum_shards(sharding.document_sizes(docs), ["doc_id", "text_crc32"], shards=5).toPandas()
    assert len(found) == len(texts()) + 2
    found = found.sort_values(["start", "size"])
    assert (found["shard"].diff().dropna() >= 0).all() and found["shard"].max() <= 4
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == [*range(len(part))]
    total = 0
    for size, start, shard in zip(found["size"], found["start"], found["shard"], strict=True):
        assert start == total and shard == min(4, (2 * total + size) * 5 // (2 * found["size"].sum()))
        total += size
    by_id = {i: t for i, t in enumerate(texts())}
    for r in found.dropna(subset="doc_id").itertuples():
        text = (by_id[int(r.doc_id)] or "").encode()
        assert r.size == len(text) + 8 and r.text_crc32 == zlib.crc32(text)
    assert sharding.prefix_sum_shards(sharding.document_sizes(empty(spark)), ["doc_id", "text_crc32"]).count() == 0


def check_packed(found, capacity):
    for _, part in found.groupby("sequence_id"):
        at = 0
        for offset, length in sorted(zip(part["offset"], part["length"], strict=True)):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("rounds", [0, 60])
def test_packing(spark, rounds):
    found = packing.pack_documents(documents(spark), rounds=rounds).toPandas()
    check_packed(found, 4096)
    plain = Tokenizer.from_file(packing.default_vocabulary())
    by_id = {i: t for i, t in enumerate(texts())} | {None: "no id here"}
    for doc, part in found.groupby("doc_id"):
        ids = np.array([*plain.encode(by_id[int(doc)] or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = {(k, k * 4096, len(x), zlib.crc32(x.tobytes())) for k in range(-(-len(ids) // 4096)) for x in [ids[k * 4096 : (k + 1) * 4096]]}
        assert {*zip(part["piece"], part["start"], part["length"], part["ids_crc32"], strict=True)} == pieces
    assert found["sequence_id"].nunique() <= -(-found["length"].sum() // 4096) + 1
    assert packing.pack_documents(empty(spark)).count() == 0


def test_plans_use_every_piece_once():
    r = np.random.default_rng(5)
    for capacity in (7, 60, 300):
        count = np.r_[0, r.integers(0, 40, capacity)]
        for rounds in (0, 30):
            plan = packing.plan(count, capacity, rounds)
            used = np.zeros(capacity + 1, int)
            np.add.at(used, plan["length"], plan["n"])
            assert (used == count).all()
            sequences = (plan["base"] + plan["n"] // plan["copies"]).max()
            assert sequences <= 1.1 * (count * np.arange(capacity + 1)).sum() / capacity + 2
    assert len(packing.plan(np.zeros(9, np.int64), 8)) == 0


def test_ids_are_the_library_s(tmp_path):
    import json

    other = json.load(open(packing.default_vocabulary(), encoding="utf-8"))
    other["normalizer"]["normalizers"].pop()  # does not lower the case
    (tmp_path / "other.json").write_text(json.dumps(other), encoding="utf-8")
    said = ["<|endoftext|> x", "a<|ENDOFTEXT|>b", "x <|startoftext|>", "Plain, It's FINE 42", "\u1e9e\u0130 na\u00efve \u96ea", "", "a\u00a0b"]
    for path in (packing.default_vocabulary(), str(tmp_path / "other.json")):
        ours, plain = packing.CachedEncoder(path), Tokenizer.from_file(path)
        for text in [*said, *filter(None, texts())]:
            assert np.frombuffer(ours(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert np.frombuffer(packing.CachedEncoder(packing.default_vocabulary())("<|endoftext|> x"), "<u4").tolist()[0] == 49407


def sequences(plan):
    return int((plan["base"] + plan["n"] // plan["copies"]).max())


def test_the_program_beats_best_fit():
    count = np.zeros(11, np.int64)
    count[4], count[3] = 200, 400  # 4 + 3 + 3, where best fit takes 4 + 4 first
    assert sequences(packing.plan(count, 10, rounds=0)) == 234 and sequences(packing.plan(count, 10)) == 200


def test_most_pieces_come_from_the_program():
    r = np.random.default_rng(8)
    count = np.bincount(np.minimum(np.exp(r.normal(5, 1, 8000)).astype(int) + 2, 512), minlength=513) * 100
    groups = packing.configurations(count, 512)
    placed = sum(n * copies for n, items in groups for _, copies in items)
    assert placed > count.sum() / 2
    assert sequences(packing.plan(count, 512)) <= sequences(packing.plan(count, 512, rounds=0))
    # What the prices bound: no cover is much better than the fractional one.
    uses = packing.fractional(count, 512)
    covered = np.zeros(513)
    for items, x in uses.items():
        assert sum(a * b for a, b in items) <= 512
        for length, copies in items:
            covered[length] += x * copies
    assert sum(uses.values()) >= 0.9 * (count * np.arange(513)).sum() / 512 * min(1, (covered[count > 0] / count[count > 0]).min())


def test_pipeline_stages(spark):
    from tests.llm.test_joins import components, repeated

    docs = documents(spark, repeat=False)
    out = docs
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.cut(stage(spark, out, D))
        assert out.columns == docs.columns
        seen.append({r["doc_id"]: r["text"] for r in out.collect()})
    languages, lines, joined, hidden = seen
    assert set(languages) == {i for i, t in enumerate(texts()) if t and any(c.isalpha() for c in t)}
    gone = repeated(list(languages.items()))
    left = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in languages.items()}
    assert lines == {i: t for i, t in left.items() if t.split()}
    assert joined == {i: t for i, t in lines.items() if components(list(lines.items()))[i][1] == i}
    assert hidden == joined  # there are no secrets in them
    check_packed(corpus_pipeline.STAGES[-1][1](spark, out, D).toPandas(), 4096)
    nothing = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        nothing = corpus_pipeline.cut(stage(spark, nothing, D))
    assert nothing.count() == 0


def test_pipeline_runs(spark):
    found = corpus_pipeline.run(spark, D).toPandas()
    assert 0 < found["doc_id"].nunique() <= 200
    check_packed(found, 4096)


def test_packing_of_null_ids_and_repeated_rows(spark):
    """Each has pieces and places of its own."""
    rows = [(None, "no id here"), (None, None), (5, "twice the same"), (5, "twice the same"), (6, "")]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, sequence_id string, piece int")
    found = packing.pack_documents(docs, capacity=16).collect()
    assert sorted((r["doc_id"] or -1, r["piece"]) for r in found) == [(-1, 0), (-1, 0), (5, 0), (5, 0), (6, 0)]
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        held.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False)) and held[0][0] == 0 and sum(held[-1]) <= 16
    assert packing.pack_documents(docs.where("false"), capacity=16).count() == 0
