"""Conversations with every odd case, and plain versions of what the operators do with them."""

import hashlib
import random
import zlib

TURNS = "conv_id long, turn long, role string, text string, part string, pos string, depth string, rows string"


def talk(seed: int, n: int, vocabulary: int = 3) -> list[tuple]:
    """(turn, role, text) of few roles and texts, so that faults, gaps and repeats are frequent."""
    r = random.Random(seed)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", ""], ["Yes.", "no", "Ok!", " \n", "", "why? "]
    return [(turn, r.choice(roles), r.choice(texts) if r.random() < 0.4 else f"t{r.randrange(vocabulary * n)}.") for turn in sorted(r.sample(range(2 * n + 1), n))]


def conversations(spark, long: int = 300):
    found = [(c, *x) for c in range(60) for x in talk(c % 50, 1 + c % 9)]
    found += [(c, *x) for c in (100, 101, 203, 307) for x in talk(7, 6)]  # the same turns
    found += [(400, *x) for x in talk(400, long)] + [(401, *x) for x in talk(400, long)]
    found += [(500, None, "user", "no turn"), (500, 1, None, None), (500, 2, "user", None), (501, None, None, "x."), (-3, 0, "user", "below zero.")]
    found += [(600, 0, "", "z" * 50_000 + "."), (601, 0, "s", ""), (602, 0, "user", "雪é\U0001f600.")]
    return spark.createDataFrame([(*x, "a", "b", "c", "d") for x in found], TURNS)


def damaged(rows: list[tuple]) -> list[tuple]:
    out = []
    for c, t, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        role, text, fault = show(role), show(text), zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
        text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
        out += [(c, t, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def repaired(rows: list[tuple]) -> dict:
    """One conversation's (turn, role, text), in order, by least (cost, letters) from the end backwards."""
    white, seen, faults = " \t\n\v\f\r", set(), []
    for _, role, text in rows:
        bare = text.strip(white)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a", ("", "s"): "s"}  # what stands last, what comes
    n, inf = len(rows), (10**9, "", ())
    best = {q: (0, "", ()) if q in ("", "a") else inf for q in ("", "s", "u", "a")}
    for i in range(n, -1, -1):
        if i < n:
            (_, role, text), fault, now = rows[i], faults[i], {}
            for q in best:
                ways = [(4, "D", None, q)]
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    ways += [(more, "K", (role, text), step[q, role[:1]])] if (q, role[:1]) in step else []
                    ways += [(3 + more, "R", ({"u": "user", "a": "assistant"}[x], text), step[q, x]) for x in "ua" if (q, x) in step]
                now[q] = min(((c + best[to][0], e + best[to][1], ((line,) if line else ()) + best[to][2]) for c, e, line, to in ways), key=lambda w: w[:2])
            best = now
        for _ in range(4):
            best = {q: min([best[q], *((3 + best[step[q, x]][0], "I" + best[step[q, x]][1], (({"u": "user", "a": "assistant"}[x], ""), *best[step[q, x]][2])) for x in "ua" if (q, x) in step)], key=lambda w: w[:2]) for q in best}
    cost, audit, lines = best[""]
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
    }


def rebuilt(rows: list[tuple]) -> dict[int, list[tuple]]:
    """Each conversation's (role, text), the first of its hundred's before its own."""
    own: dict[int, list[tuple]] = {}
    for c, t, role, text in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def trie(sequences: dict[int, list[tuple]]) -> list[tuple]:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), by all prefixes."""
    members: dict[tuple, list[int]] = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids: dict[tuple, int] = {}
    for node in members:
        if node:
            kids[node[:-1]] = kids.get(node[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(of) - 1) * len(node[-1][1]) if node else 0
    ends = lambda node: ",".join(str(c) for c in sorted(members[node]) if len(sequences[c]) == len(node))
    return [(min(of), len(node), min(members[node[:-1]]) if node else None, len(of), kids.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends(node).encode()).hexdigest()) for node, of in members.items()]
