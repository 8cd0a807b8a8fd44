"""Small documents with every odd case: nulls, empty and long texts, repeated rows, ties, columns of clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, k1 string, spans string, language string, shard int"


def prose(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def texts() -> list[str | None]:
    base = prose(1, 120)
    near = [*base[:60], "changed", *base[61:]]
    far = [*base[:60], *prose(2, 60)]
    line = "this line of ten words stands here more than once today"
    out = [None, "", "   \n\t ", "one", "one two three four", "One two three FOUR", "!?", "é ß 雪 \U0001f600 x", " ".join(base), " ".join(near), " ".join(near), " ".join(far)]
    out += [f"{line}\n{' '.join(prose(3, 30))}", f"{line.replace('today', 'now')}\n{line}", f"{line} indeed\nfresh words only", " ".join(prose(4, 20_000, 3000))]
    out += [" ".join(prose(10 + i, 30)) for i in range(12)]
    return out


def documents(spark, repeat: bool = True):
    rows = [(i, t, ("en", "de", None)[i % 3], "src0", None if t is None else len(t), "a", "b", "c", "d", i) for i, t in enumerate(texts())]
    if repeat:
        rows += [rows[8], (None, "no id here", "en", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
