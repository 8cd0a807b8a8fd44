"""The models of operators 2 and 6 against plain versions of their definitions, and on held-out rows."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import language, toxicity


def test_toxicity_equals_its_definition(spark):
    """By dictionaries: each class's probabilities of what may follow a word add to 1, and a text's evidence is the mean
    logarithm of their ratio."""
    r = random.Random(6)
    words = [f"w{k}" for k in range(25)]
    rows = [(" ".join(r.choices(words[: 25 - 5 * toxic], k=r.randrange(1, 30))), toxic) for toxic in (0, 1, 0, 0) for _ in range(15)] + [("", 0), (None, 1)]
    n = (Counter(), Counter())
    for text, toxic in rows:
        said = (text or "").split()
        n[toxic].update(zip(["<s>", *said], said, strict=False))
    pairs = set(n[0]) | set(n[1])
    both = Counter({p: n[0][p] + n[1][p] for p in pairs})

    def own(counts):
        totals = [sum(c.values()) for c in counts]
        half = [toxicity.DISCOUNT * t / min(totals) for t in totals]
        return [{k: toxicity.KEPT * x**3 / (x**2 + h**2) for k, x in c.items()} for c, h in zip(counts, half, strict=True)]

    once, twice = (sum(x == k for x in both.values()) for k in (1, 2))
    d = once / (once + 2 * twice)
    o = own(n)
    of = lambda counts, v: sum(x for (a, _), x in counts.items() if a == v)
    follows = [Counter(w for (_, w), x in c.items() if x) for c in (*n, both)]
    q = own(follows[:2])
    total = [sum(c.values()) for c in follows]

    def lower(c, w):
        left = 1 - sum(q[c].values()) / total[c]
        return q[c].get(w, 0) / total[c] + left * (follows[2][w] if w else 1) / (total[2] + 1)  # None: any unknown word

    def p(c, v, w):
        own_left = 1 - of(o[c], v) / of(n[c], v) if of(n[c], v) else 1
        seen = both[v, w] and max(both[v, w] - d, 0) / of(both, v)
        left = 1 - sum(max(x - d, 0) for (a, _), x in both.items() if a == v) / of(both, v) if of(both, v) else 1
        return (o[c].get((v, w), 0) / of(n[c], v) if of(n[c], v) else 0) + own_left * (seen + left * lower(c, w))

    for c, v in itertools.product((0, 1), ["<s>", "w3", "w22", "never"]):
        assert sum(p(c, v, w) for w in follows[2]) + p(c, v, None) == pytest.approx(1)

    model = toxicity.train_models(spark.createDataFrame(rows, "text string, toxic int"))
    texts = ["w1 w2 w3", "w22 w23 w24 w22", "w1 never w1", "never seen", "w7", ""]
    got = [x["e"] for x in toxicity.with_evidence(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), model, "e", "evidence").collect()]
    for text, e in zip(texts, got, strict=True):
        said = text.split()
        known = [w if w in follows[2] else None for w in said]
        ratios = [math.log(p(1, v, w) / p(0, v, w)) for v, w in zip(["<s>", *said], known, strict=False)]
        assert e == pytest.approx(sum(ratios) / len(ratios) if ratios else 0, abs=1e-5), text


def test_toxicity_ranks_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    found = toxicity.op2_kneser_ney_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out AND toxic IS NOT NULL").select("score", "toxic").toPandas()
    ranks, toxic = found["score"].rank().to_numpy(), found["toxic"].to_numpy() == 1
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.75


SAID = {"xa": "abcde", "yb": "defgh", "zc": "ghijk"}


def say(r, kind, n):
    return " ".join("".join(r.choice(SAID[kind]) for _ in range(r.randrange(3, 7))) for _ in range(n))


def test_languages_equal_all_sets(spark):
    """Every set of languages by plain EM to convergence: the operator's has the best penalised likelihood, within what its
    steps leave, and its proportions."""
    r = random.Random(8)
    rows = [(k, say(r, k, 60)) for k in SAID for _ in range(6)]
    model = language.train_language_model(spark.createDataFrame(rows, "lang string, text string"))
    counts = defaultdict(Counter)
    for k, text in rows:
        counts[k].update(language.trigram_buckets(text).tolist())
    together = np.full(language.BUCKETS, 0.01 / language.BUCKETS)
    for k in SAID:
        for b, n in counts[k].items():
            together[b] += 0.99 * n / sum(counts[k].values()) / 3
    share = lambda k, b: (counts[k][b] + language.PRIOR * together[b]) / (sum(counts[k].values()) + language.PRIOR)

    def best(text):
        seen = Counter(language.trigram_buckets(text).tolist())
        total = sum(seen.values()) / language.OVERLAP
        found = []
        for size in (1, 2, 3):
            for chosen in itertools.combinations(SAID, size):
                w = dict.fromkeys(chosen, 1 / size)
                for _ in range(500):
                    new = Counter()
                    for b, n in seen.items():
                        mix = sum(w[k] * share(k, b) for k in chosen)
                        for k in chosen:
                            new[k] += n * w[k] * share(k, b) / mix
                    w = {k: new[k] / sum(new.values()) for k in chosen}
                value = sum(n / language.OVERLAP * math.log(sum(w[k] * share(k, b) for k in chosen)) for b, n in seen.items())
                found.append((value - (size - 1) * (0.5 * math.log(total + 1) + 1), w))
        return max(found, key=lambda x: x[0])[1]

    for parts in ({"xa": 40}, {"yb": 30, "zc": 30}, {"xa": 60, "zc": 35}, {"xa": 30, "yb": 30, "zc": 30}):
        text = " ".join(say(r, k, n) for k, n in parts.items())
        got, plain = model.infer(text), best(text)
        assert set(got) == set(plain) == set(parts)
        assert all(abs(got[k] - plain[k]) < 0.03 for k in got)


def test_a_small_part_in_another_language_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("lang").isin("de", "en", "fr"))
    model = language.train_language_model(docs)
    r, words = random.Random(1), {k: " ".join(x["text"] for x in docs.where((F.col("lang") == k) & F.col("text").isNotNull()).limit(200).collect()).split() for k in ("de", "en")}
    mixed = r.choices(words["de"], k=18_400) + r.choices(words["en"], k=1_600)
    found = model.infer(" ".join(mixed))
    assert set(found) == {"de", "en"} and 0.05 < found["en"] < 0.11
    assert model.infer(" ".join(r.choices(words["de"], k=20_000)))["de"] > 0.97  # some of these texts have lines in English
