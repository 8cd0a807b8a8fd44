"""Operator 12: the cheapest repair of a conversation's order of roles.

A repair leaves the role initials `(s?(ua)+)?`. Its states are what stands last (nothing yet, a system turn, a user's, an
assistant's); its arcs keep, rerole or delete the next row, or insert a turn. Least costs from the start to every
state of every row, and from there to the end, tell which arcs lie on some cheapest repair: the tight ones. A walk along
these, which holds all states that the letters so far may have reached, takes the least letter at each step.

A conversation may be cut into segments that lie in several tasks (see `sequences`). A segment's costs from state to
state are a 4 x 4 matrix; the matrices of a conversation's segments give the costs at their edges, and for each
segment the walk from every set of states to the set that it ends in gives the sets there. All of this is a few numbers a
segment, for conversations in several parts only; everything else is done segment by segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.common import cut, in_small_batches, partitions, table
from pointloom.llm.sequences import dealt_in_order, sha256_of_chunks

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
ENDS = ".!?"
NONE, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 50
#: A row is one letter: its role's initial, in each of four conditions.
INITIALS = "suax"  # x: any other
FINE, CUT_OFF, BLANK, DUPLICATE = range(4)
LETTERS = "abcdefghijklmnop"
LEGAL = {"su", "ua", "au"}
INSERTS = ((NONE, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT))
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # fixed value: of no bytes
CONVERSATION = ["anon", "conv"]  # a null conv_id is a conversation of its own: (1, 0)


# -- the repair of one segment


def _arcs(letter: str) -> list[tuple[str, int, int, int]]:
    """(edit, from, to, cost) of a row, by edit."""
    initial, condition = divmod(LETTERS.index(letter), 4)
    found = [("D", q, q, DELETE) for q in range(4)]
    if condition in (FINE, CUT_OFF):
        more = TRUNCATED * (condition == CUT_OFF)
        kept = {"s": [(NONE, SYSTEM)], "u": INSERTS[:3], "a": INSERTS[3:]}.get(INITIALS[initial], [])
        found += [("K", q, to, more) for q, to in kept] + [("R", q, to, REROLE + more) for q, to in INSERTS]
    return found


ARCS = {letter: _arcs(letter) for letter in LETTERS}


def _forward(costs: list[int]) -> list[int]:
    n, s, u, a = costs
    u = min(u, n + INSERT, s + INSERT, a + INSERT)
    return [n, s, u, min(a, u + INSERT)]


def _backward(costs: list[int]) -> list[int]:
    n, s, u, a = costs
    u = min(u, a + INSERT)
    return [min(n, u + INSERT), min(s, u + INSERT), u, min(a, u + INSERT)]


def forward(rows: str, start: list[int]) -> list[list[int]]:
    """Least costs to each state, before each row and after the last, from the costs `start`."""
    out = [_forward(start)]
    for row in rows:
        now, then = out[-1], [FAR] * 4
        for _, q, to, cost in ARCS[row]:
            then[to] = min(then[to], now[q] + cost)
        out.append(_forward(then))
    return out


def backward(rows: str, end: list[int]) -> list[list[int]]:
    """Least costs from each state, before each row and after the last, to the end, which has the costs `end`."""
    out = [_backward(end)]
    for row in reversed(rows):
        now, before = out[-1], [FAR] * 4
        for _, q, to, cost in ARCS[row]:
            before[q] = min(before[q], now[to] + cost)
        out.append(_backward(before))
    return out[::-1]


ACCEPT = [0, FAR, FAR, 0]
START = [0, FAR, FAR, FAR]


def walk(rows: str, f: list[list[int]], b: list[list[int]], states: set[int], last: bool) -> tuple[list[str], set[int]]:
    """The least letters along tight arcs from the states, one text a row: its inserts and its own edit; if the segment is
    the last, one more text of inserts; and the states after the last row."""
    total, out = min(x + y for x, y in zip(f[0], b[0], strict=True)), []
    for i in range(len(rows) + last):
        letters = ""
        while True:
            reached: dict[str, set[int]] = {}
            for edit, q, to, cost in ARCS[rows[i]] if i < len(rows) else ():
                if q in states and f[i][q] + cost + b[i + 1][to] == total:
                    reached.setdefault(edit, set()).add(to)
            for q, to in INSERTS:
                if q in states and f[i][q] + INSERT + b[i][to] == total:
                    reached.setdefault("I", set()).add(to)
            if not reached:
                if i < len(rows):  # no state was on a cheapest repair
                    return out, set()
                break
            edit = min(reached)
            letters, states = letters + edit, reached[edit]
            if edit != "I":
                break
        out.append(letters)
    return out, states


def illegal_pairs(rows: str) -> int:
    initials = "".join(INITIALS[LETTERS.index(x) // 4] for x in rows)
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


# -- segments


def _mapped(f, schema: str):
    """f from rows (dicts) to rows (dicts), as a function of batches; f may carry state from row to row."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(n, _KINDS[k]) for n, k in (x.strip().split(" ") for x in schema.split(","))])
        for batch in batches:
            yield pa.RecordBatch.from_pylist([y for x in batch.to_pylist() for y in f(x)], kinds)

    return of_batches


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}
_SEGMENT = "part int, anon long, conv long"
_at = lambda x: {k: x[k] for k in ("part", *CONVERSATION)}


def _edges(segs: DataFrame) -> DataFrame:
    """(part, conversation, f, b, states) of segments of conversations in several parts: two rows a part at most."""
    spanning = segs.where("spans").select("part", *CONVERSATION, "rows")

    def matrix(x: dict) -> list[dict]:
        # The costs after the last row's own edit, inserts there being the next segment's.
        costs = []
        for q in range(4):
            now = forward(x["rows"][:-1], [0 if q == k else FAR for k in range(4)])[-1]
            then = [FAR] * 4
            for _, p, to, cost in ARCS[x["rows"][-1]]:
                then[to] = min(then[to], now[p] + cost)
            costs += then
        return [_at(x) | {"m": costs}]

    def costs_at_edges(x: dict) -> list[dict]:
        starts, ends = [START], [ACCEPT]
        for s in x["segs"]:
            starts.append([min(starts[-1][p] + s["m"][4 * p + q] for p in range(4)) for q in range(4)])
        for s in reversed(x["segs"]):
            after = _backward(ends[-1])
            ends.append([min(s["m"][4 * p + q] + after[q] for q in range(4)) for p in range(4)])
        return [{"part": s["part"], "anon": x["anon"], "conv": x["conv"], "f": f, "b": b} for s, f, b in zip(x["segs"], starts, ends[-2::-1], strict=False)]

    def moves(x: dict) -> list[dict]:
        f, b = forward(x["rows"], x["f"]), backward(x["rows"], x["b"])
        ends = [walk(x["rows"], f, b, {q for q in range(4) if mask >> q & 1}, False)[1] for mask in range(16)]
        return [_at(x) | {"f": x["f"], "b": x["b"], "m": [sum(1 << q for q in e) for e in ends]}]

    def states_at_edges(x: dict) -> list[dict]:
        out, mask = [], 1 << NONE
        for s in x["segs"]:
            out.append({"part": s["part"], "anon": x["anon"], "conv": x["conv"], "f": s["f"], "b": s["b"], "states": mask})
            mask = s["m"][mask]
        return out

    def together(rows: DataFrame, *more: str) -> DataFrame:
        return rows.groupBy(*CONVERSATION).agg(F.sort_array(F.collect_list(F.struct("part", "m", *more))).alias("segs"))  # as many as there are parts, at most

    ms = spanning.mapInArrow(_mapped(matrix, s := _SEGMENT + ", m array<long>"), s)
    costs = together(ms).mapInArrow(_mapped(costs_at_edges, s := _SEGMENT + ", f array<long>, b array<long>"), s)
    ms = spanning.join(costs, ["part", *CONVERSATION]).mapInArrow(_mapped(moves, s := _SEGMENT + ", f array<long>, b array<long>, m array<long>"), s)
    return together(ms, "f", "b").mapInArrow(_mapped(states_at_edges, s := _SEGMENT + ", f array<long>, b array<long>, states long"), s)


def _repaired(x: dict) -> list[dict]:
    rows = x["rows"]
    f, b = forward(rows, x["f"] or START), backward(rows, x["b"] or ACCEPT)
    states = {q for q in range(4) if (x["states"] or 1 << NONE) >> q & 1}
    edits, _ = walk(rows, f, b, states, x["last"])
    conditions = [LETTERS.index(r) % 4 for r in rows]
    # Each row's task: the roles of turns inserted before it, then K(eep), D(elete), U or A (rerole to user or assistant).
    tasks, q = [], min(states)
    for letters, row in zip(edits, [*rows, ""], strict=False):
        task = ""
        for e in letters:
            if e in "IR":
                q = ASSISTANT if q == USER else USER
                task += ("ua" if e == "I" else "UA")[q - USER]
            else:
                q = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[INITIALS[LETTERS.index(row) // 4]] if e == "K" else q
                task += e
        tasks.append(task)
    return [_at(x) | {"pos": x["pos"], "spans": x["spans"], "audit": "".join(edits), "cost": min(p + r for p, r in zip(f[0], b[0], strict=True)), "tasks": tasks, "illegal": illegal_pairs(rows), "blank": conditions.count(BLANK), "duplicate": conditions.count(DUPLICATE), "truncated": conditions.count(CUT_OFF)}]


_REPAIRED = _SEGMENT + ", pos long, spans boolean, audit string, cost long, tasks array<string>, illegal long, blank long, duplicate long, truncated long"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by segment and place, each row's task and then the row: repaired segments, hashed if the conversation has no
    other, else as texts of a batch's length at most."""
    now, n, state, begun, task = None, 0, None, False, ""
    kinds = pa.schema([("part", pa.int32()), ("anon", pa.int64()), ("conv", pa.int64()), ("seq", pa.int64()), ("chunk", pa.string()), ("sha256", pa.string())])

    def ended() -> dict:
        return {"part": now[0], "anon": now[1], "conv": now[2], "sha256": state.hexdigest()}

    for batch in batches:
        out, lines = [], []

        def flush() -> None:
            nonlocal n, begun, lines
            if lines and state is not None:
                state.update((("\n" if begun else "") + "\n".join(lines)).encode("utf-8", "surrogatepass"))
            elif lines:
                out.append({"part": now[0], "anon": now[1], "conv": now[2], "seq": n, "chunk": "\n".join(lines)})
            n, begun, lines = n + 1, begun or bool(lines), []

        for x in batch.to_pylist():
            at = (x["part"], x["anon"], x["conv"])
            if at != now:
                if now is not None:
                    flush()
                    out += [ended()] if state is not None else []
                now, n, begun, state = at, 0, False, None if x["spans"] else hashlib.sha256()
            if x["task"] is not None:
                task = x["task"]
                lines += [{"u": "user:", "a": "assistant:"}[e] for e in task if e in "ua"]
            elif (edit := task[-1:]) and edit != "D":
                lines.append(f"{({'U': 'user', 'A': 'assistant'}).get(edit, x['role'])}:{x['text']}")
        if now is not None:
            flush()
        yield pa.RecordBatch.from_pylist(out, kinds)
    if now is not None and state is not None:
        yield pa.RecordBatch.from_pylist([ended()], kinds)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row a conversation of rows (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256, as `op12_conversation_repair` has them.

    Turns are ordered by turn, nulls first, then by hashes of role and text. Null roles and texts are one space, a null
    conv_id is a conversation of its own. A role that begins otherwise than with s, u or a can't be kept, nor can an empty one.
    A conversation of white space or of nothing but such rows is deleted or reroled, whatever is cheaper. An empty table
    gives an empty result. Texts of any length are hashed piece by piece; other columns are not looked at.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    known = rows.select(F.col("conv_id").isNull().cast("long").alias("anon"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    known = known.withColumns({"c1": F.xxhash64("role", "text"), "c2": F.xxhash64(F.lit(1), "text", "role")})
    dealt = dealt_in_order(known, [*CONVERSATION, "turn", "c1", "c2"])

    bare = F.btrim("text", F.lit(WHITE))
    initial = F.left("role", F.lit(1))
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    light = dealt.select("part", *CONVERSATION, "turn", "pos", "c1", "c2", (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(*ENDS).alias("whole"), place.alias("place"))
    firsts = light.where("NOT blank").groupBy(*CONVERSATION, "c1", "c2").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    condition = F.when(F.col("blank"), BLANK).when(F.col("is_first").isNull(), DUPLICATE).when(~F.col("whole"), CUT_OFF).otherwise(FINE)
    judged = light.join(firsts, "pos", "left").withColumn("row", F.substr(F.lit(LETTERS), F.col("place") * 4 + condition + 1, F.lit(1)))
    segs = judged.groupBy("part", *CONVERSATION).agg(F.min("pos").alias("pos"), F.array_join(F.array_sort(F.collect_list(F.struct("pos", "row")))["row"], "").alias("rows"))  # a part's rows at most
    of = Window.partitionBy(*CONVERSATION)
    segs = cut(segs.withColumn("spans", F.count("*").over(of) > 1).withColumn("last", F.col("part") == F.max("part").over(of)))

    solved = segs.join(F.broadcast(_edges(segs)), ["part", *CONVERSATION], "left")
    solved = cut(in_small_batches(solved).select("part", *CONVERSATION, "rows", "pos", "spans", "last", "f", "b", "states").mapInArrow(_mapped(_repaired, _REPAIRED), _REPAIRED))

    # Tasks before their rows, part by part.
    tasks = solved.select("part", *CONVERSATION, "spans", F.posexplode("tasks").alias("at", "task"), "pos").select("part", *CONVERSATION, (F.col("pos") + F.col("at")).alias("pos"), "spans", "task")
    texts = dealt.select("part", *CONVERSATION, "pos", "role", "text")
    both = tasks.unionByName(texts, allowMissingColumns=True).repartition(partitions(rows.sparkSession), "part", *CONVERSATION)
    both = both.sortWithinPartitions("part", *CONVERSATION, "pos", F.col("task").isNull())
    made = cut(both.mapInArrow(_texts, _SEGMENT + ", seq long, chunk string, sha256 string"))
    joined = sha256_of_chunks(made.where("sha256 IS NULL"), CONVERSATION, ["part", "seq"], "\n")
    digests = made.where("sha256 IS NOT NULL").select(*CONVERSATION, "sha256").unionByName(joined)

    # A conversation's segments meet in pairs of rows.
    initial_of = lambda letter: F.substr(F.lit(INITIALS), F.floor((F.ascii(letter) - ord(LETTERS[0])) / 4) + 1, F.lit(1))
    pair = F.concat(F.lag(initial_of(F.right("rows", F.lit(1)))).over(of.orderBy("part")), initial_of(F.left("rows", F.lit(1))))
    edges = segs.select("part", *CONVERSATION, F.coalesce((~pair.isin(*LEGAL)).cast("long"), F.lit(0)).alias("edge"))
    facts = solved.drop("tasks", "pos").join(edges, ["part", *CONVERSATION]).groupBy(*CONVERSATION).agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum(F.col("illegal") + F.col("edge")).alias("illegal"), F.max("cost").alias("cost"), F.array_join(F.array_sort(F.collect_list(F.struct("part", "audit")))["audit"], "").alias("audit")
    )
    turns = light.where("turn IS NOT NULL").groupBy(*CONVERSATION, "turn").agg(F.lit(1)).groupBy(*CONVERSATION).agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    found = facts.join(turns, CONVERSATION, "left").join(digests, CONVERSATION, "left")
    return found.select(F.when(F.col("anon") == 0, F.col("conv")).alias("conv_id"), F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with the faults that a hash of conv_id and turn gives each row: dropped, emptied, without its marks of
    sentence ends, repeated, or of role user. Nulls are one space, in the hash as well."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    changed = rows.where("fault <> 0").select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy"))
    return changed.drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and then repaired; those of which nothing is left have zeros, an empty audit and the
    hash of nothing."""
    conversations = table(spark, sf_dir, "conversations")
    found = repair_conversations(damaged(conversations))
    every = conversations.select("conv_id").distinct().withColumnRenamed("conv_id", "c")
    all_of = every.join(found, every["c"].eqNullSafe(found["conv_id"]), "left").drop("conv_id")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return all_of.select(F.col("c").alias("conv_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))


def _op12_sql() -> str:
    """The same row by row from the end backwards: of each state the least (cost, letters) to the end, with its lines."""
    way = lambda cost, edit, line, to: f"{{'c': {to}.c + {cost}, 'e': '{edit}' || {to}.e, 't': {line} || {to}.t}}"
    least = lambda ways: f"list_sort([{', '.join(ways)}])[1]"
    states, after = ("n", "s", "u", "a"), {("n", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a", ("n", "s"): "s"}
    roles = {"u": "user", "a": "assistant"}

    def inserted(source: str) -> str:
        more = {q: [way(INSERT, "I", f"'{roles[x]}:' || chr(10)", to) for (p, x), to in after.items() if p == q and x in roles] for q in states}
        return f"SELECT conv_id, i, {', '.join(f'{least([q, *more[q]])} AS {q}' for q in states)} FROM ({source})"

    far, end = "{'c': 1000000000, 'e': '', 't': ''}", "{'c': 0, 'e': '', 't': ''}"
    ended = f"SELECT conv_id, n AS i, {end} AS n, {far} AS s, {far} AS u, {end} AS a FROM counted"
    step = []
    for q in states:
        ways = [way(DELETE, "D", "''", f"b.{q}")]
        for (p, x), to in after.items():
            if p == q:
                kept, as_role = way("r.more", "K", "r.role || ':' || r.text || chr(10)", f"b.{to}"), f"'{roles.get(x)}:' || r.text || chr(10)"
                ways.append(f"CASE WHEN r.kept AND r.initial = '{x}' THEN {kept} ELSE {far} END")
                ways += [f"CASE WHEN r.kept THEN {way(f'r.more + {REROLE}', 'R', as_role, f'b.{to}')} ELSE {far} END"] if x in roles else []
        step.append(f"{least(ways)} AS {q}")
    before = f"SELECT b.conv_id, b.i - 1 AS i, {', '.join(step)} FROM best b JOIN judged r ON r.c = coalesce(b.conv_id, -1) AND r.k = b.i"
    crc = """list_reduce([4294967295] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
 lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))"""
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE faulty AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({crc}, 4294967295) % 20 AS fault FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM faulty WHERE fault <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy) AS k, trim(text, {white}) AS bare FROM damaged
), told AS (
  SELECT *, left(role, 1) AS initial, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS duplicate FROM placed
), judged AS (
  SELECT *, coalesce(conv_id, -1) AS c, NOT blank AND NOT duplicate AS kept, CASE WHEN NOT blank AND NOT duplicate AND right(bare, 1) NOT IN ('.', '!', '?') THEN {TRUNCATED} ELSE 0 END AS more,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair FROM told
), counted AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (more > 0) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
), best AS (
  {inserted(ended)}
  UNION ALL
  {inserted(before)}
)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  CAST(coalesce(b.n.c, 0) AS BIGINT) AS cost, coalesce(b.n.e, '') AS audit, sha256(coalesce(left(b.n.t, length(b.n.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.i = 0 AND a.conv_id IS NOT DISTINCT FROM b.conv_id
"""


OP12_SQL = _op12_sql()
