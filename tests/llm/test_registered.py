"""Every registered query of this subpackage, whole, on the smallest tables: columns, types, and what plain Python says of its rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import public_tokenizers
import pytest
import tiktoken
import tokenizers

from pointloom.llm import bpe, catalog

D = "/root/testdata/sf0.001"
TYPES = {
    "op1_kmeans_tree_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_kneser_ney_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_deletion_line_dedup": {"doc_id": "bigint", "line_no": "int", "of_id": "bigint", "of_line_no": "int"},
    "op4_spotsigs": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op5_adaptive_prefix_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op6_language_mixture": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_token_efficiency_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op8_prefix_sum_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op9_higher_order_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op10_configuration_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op11_conversation_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    "op12_conversation_repair": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"},
    "op13_site_style_tree": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def spans_of(text):
    """Base spans by plain patterns."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), k, m.end()) for k, kind, ok in ((0, assign, lambda m: len(m[2]) >= 6), (1, re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (2, re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)) for m in kind.finditer(text) if ok(m)]
    return sorted(out)


def checked(name, rows, texts):
    by = {r["doc_id"]: r for r in rows} if rows and "doc_id" in rows[0] else {}
    ids = sorted(texts)
    if name.startswith("op2_"):
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    if name.startswith("op4_"):
        for i, d in enumerate(ids[::-1]):  # the next by descending id, after the last the first
            text, after = texts[d], texts[ids[::-1][(i + 1) % len(ids)]]
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            assert by[d]["n_chars"] == len(text) and by[d]["edited_sha256"] == sha(edited)
            assert 0 <= by[d]["near_next"] <= 1 and 0 <= by[d]["near_edited"] <= 1 and (by[d]["near_edited"] == 1) >= (by[d]["fingerprint"] == by[d]["edited_fingerprint"])
        same = defaultdict(set)
        for d, text in texts.items():
            same[text].add(by[d]["fingerprint"])
        assert all(len(x) == 1 for x in same.values())
    if name.startswith("op6_"):
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
        assert all((r["lang_pred"] == "und") == (not any(x.isalpha() for x in texts[r["doc_id"]])) for r in rows)
    if name.startswith("op7_"):
        for d, text in texts.items():
            found = spans_of(text)
            assert [by[d][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(k == i for _, k, _ in found) for i in range(3)]
            assert by[d]["base_sha256"] == sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found))
    if name.startswith("op9_"):
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
        for d, text in texts.items():
            got = own.encode_ordinary(text)
            assert (by[d]["n_tokens"], by[d]["ids_sha256"], by[d]["decoded_sha256"]) == (len(got), sha(",".join(map(str, got))), sha(text))
    if name.startswith("op10_"):
        of, places = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list)
        pieces = {(r["doc_id"], r["piece"]): r for r in rows}
        for d, text in texts.items():
            got = [*of.encode(text, add_special_tokens=False).ids, 1]
            for k in range(-(-len(got) // 4096)):
                r, part = pieces.pop((d, k)), got[4096 * k : 4096 * (k + 1)]
                assert (r["start"], r["length"], r["ids_crc32"]) == (4096 * k, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))
                places[r["sequence_id"]].append((r["offset"], r["length"]))
        assert not pieces
        for found in places.values():
            found.sort()
            assert [a for a, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))] and sum(n for _, n in found) <= 4096


def test_all_are_listed():
    assert set(catalog.QUERIES) == set(TYPES)


@pytest.mark.parametrize("name", sorted(TYPES, key=lambda n: int(n[2:].split("_")[0])))
def test_registered_query(spark, name):
    found = catalog.QUERIES[name](spark, D)
    types = dict(found.dtypes)
    assert {c: types.get(c) for c in TYPES[name]} == TYPES[name]
    rows = found.collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    if name[:4] in ("op2_", "op4_", "op5_", "op6_", "op7_", "op8_", "op9_"):
        assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    checked(name, rows, texts)
    if name in catalog.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
        sql = con.execute(catalog.ORACLE_SQL[name])
        columns = [c[0] for c in sql.description]
        assert sorted((tuple(r) for r in sql.fetchall()), key=str) == sorted((tuple(r[c] for c in columns) for r in rows), key=str)
