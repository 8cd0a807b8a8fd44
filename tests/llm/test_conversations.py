from pointloom.llm import conversation_repair, conversation_trie
from pointloom.llm.conversation_repair import LETTERS, START, ACCEPT, backward, forward, walk
from tests.llm.conversations import TURNS, conversations, damaged, rebuilt, repaired, talk, trie

TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def in_order(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0))


def test_trie_equals_all_prefixes(spark):
    df = conversations(spark).cache()
    rows = [tuple(r)[:4] for r in df.collect()]
    found = conversation_trie.trie_of(df, conversation_trie.shared_turns())
    assert found.columns == TRIE and {t for _, t in found.dtypes[:-1]} == {"bigint"}
    assert sorted(map(tuple, found.collect()), key=str) == sorted(trie(rebuilt(rows)), key=str)


def test_trie_of_conversations_as_they_are(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 5, "user", "a"), (3, 6, "assistant", "c"), (None, 0, "user", "a")]
    found = conversation_trie.trie_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(tuple(r)[:7] for r in found.collect()) == [(1, 0, None, 3, 1, 2, 2), (1, 1, 1, 3, 2, 2, 2), (1, 2, 1, 1, 0, 1, 0), (3, 2, 1, 1, 0, 1, 0)]
    assert conversation_trie.trie_of(spark.createDataFrame([], TURNS), conversation_trie.shared_turns()).count() == 0


def test_repair_equals_brute_force(spark):
    df = conversations(spark).unionByName(spark.createDataFrame([(None, 0, "user", "whose?", "", "", "", ""), (700, 1, "user", "a.", "", "", "", "")], TURNS)).cache()
    rows = damaged([tuple(r)[:4] for r in df.collect()])
    by = {}
    for r in in_order(rows):
        by.setdefault(r[0], []).append(r[1:])
    found = {r["conv_id"]: r.asDict() for r in conversation_repair.repair_conversations(conversation_repair.damaged(df)).collect()}
    assert set(found) == set(by)
    for c, turns in by.items():
        expected = repaired(turns)
        assert {k: found[c][k] for k in expected} == expected, c


def test_walk_over_segments_equals_walk_over_the_whole():
    """Whatever the rows, a conversation cut anywhere has the same edits: costs and states at the cut are enough."""
    import random

    r = random.Random(5)
    for _ in range(200):
        rows = "".join(r.choice(LETTERS) for _ in range(r.randrange(2, 14)))
        f, b = forward(rows, START), backward(rows, ACCEPT)
        whole, _ = walk(rows, f, b, {0}, True)
        k = r.randrange(1, len(rows))
        g = forward(rows[:k], START)
        first, states = walk(rows[:k], g, backward(rows[:k], b[k]), {0}, False)
        second, _ = walk(rows[k:], forward(rows[k:], f[k]), b[k:], states, True)
        assert first + second == whole


def test_registered_queries(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = conversation_trie.op11_conversation_trie(spark, d)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(trie(rebuilt(rows)), key=str)
    found = conversation_repair.op12_conversation_repair(spark, d)
    by = {c: [] for c, *_ in rows}
    for r in in_order(damaged(rows)):
        by[r[0]].append(r[1:])
    got = {r["conv_id"]: r.asDict() for r in found.collect()}
    assert {c: {k: got[c][k] for k in e} for c, e in ((c, repaired(t)) for c, t in by.items())} == {c: repaired(t) for c, t in by.items()}
    assert dict(found.dtypes)["cost"] == "bigint" and set(got) == set(by)


def test_all_rows_dropped_and_empty_tables(spark):
    assert conversation_repair.repair_conversations(spark.createDataFrame([], TURNS)).count() == 0
    assert repaired([])["repaired_sha256"] == conversation_repair.EMPTY_SHA256 and talk(1, 3)
