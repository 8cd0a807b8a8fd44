import html
import random
import re
from collections import Counter, defaultdict
from math import log

import pytest

from pointloom.llm import html_extraction as H
from tests.llm.fixtures import prose

PAGES = "page_id long, url string, html string, text string, keys string, facts string, host string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], PAGES)


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in H.extract_main_text(pages(spark, rows)).collect()}


def said(seed, n):
    return " ".join(prose(seed, n))


def test_what_html_itself_says(spark):
    article = "<article><header><h1>A &amp; B&hellip;</h1></header><p>one\n two<br>three <b>fo</b>ur<p>five <span class=ad>buy</span>six<ul><li>x<li>y</ul><footer>by me</footer><section id='comments'>first!</section></article>"
    page = f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body class='has-sidebar'><header>site</header><nav><a href=/>home</a></nav>{article}<div class='cookieNotice'>yes?</div><form>mail</form><footer>end</footer>"
    cases = {1: (page, "A & B… one two three four five six x y"), 2: (None, ""), 3: ("", ""), 4: ("<nav>only</nav>", ""), 5: ("plain &lt;text&gt; &#233;&am", "plain <text> é&am"), 6: ("<div><p>a</div></span></p>b<![CDATA[c]]>", "a b"), 7: ("<main>m1</main>x<main role=main>m2<aside>no</aside></main>", "m1 m2"), 8: ("<article class=comment>c</article><p>text", "text"), 9: ("<div role='navigation'>n</div><p>t u</p>", "t u")}
    rows = [(k, f"http://h{k}.example.com/", h) for k, (h, _) in cases.items()] + [(None, None, "<p>no id"), (1, "http://h1.example.com/", page)]
    found = H.extract_main_text(pages(spark, rows))
    assert found.columns == ["page_id", "url", "text"]
    got = [(r["page_id"], r["text"]) for r in found.collect()]
    assert sorted(got, key=str) == sorted([(k, t) for k, (_, t) in cases.items()] + [(None, "no id"), (1, cases[1][1])], key=str)
    assert H.extract_main_text(pages(spark, [])).count() == 0


def test_branches_that_a_host_repeats_are_removed(spark):
    """Without tags or names that tell: what stands on all pages goes, what differs stays, copies of a whole page too."""
    r, rows, truth = random.Random(1), [], {}
    ads = [said(1000 + k, 12) for k in range(4)]
    for k in range(60):
        own = [said(k if k > 10 else 3, 40 + k % 5), *(said(200 + 7 * k + j, 25) for j in range(1 + k % 4) if k > 10)]
        top, side = "<div class=a1><ul><li><a href=/x>Home</a><li><a href=/y>About</a></ul></div>", f"<div class=b2>{r.choice(ads)}</div>"
        rows.append((k, f"https://site.example.org/p/{k}", f"<html><body>{top}<div class=c{k}><h2>{own[0]}</h2>{''.join(f'<p>{p}</p>' for p in own[1:])}</div>{side}<div class=d4>All rights</div></body></html>"))
        truth[k] = " ".join(own)
    rows.append((99, "https://alone.example.org/", "<html><body><div class=a1>Home</div><div>text</div></body></html>"))
    assert texts(spark, rows) == truth | {99: "Home text"}


def test_style_tree_equals_entropies_by_hand(spark):
    values = [(p, key, kind, v, n) for p in range(6) for key, kind, v, n in [(1, H.PAGES, 0, 1), (1, H.STYLES, p % 3, 1), (1, H.FEATURES, 7, 1 + p), (1, H.FEATURES, 100 + p, 1)]] + [(0, 2, H.PAGES, 0, 1), (0, 2, H.STYLES, 5, 2)]
    found = {r["key"]: r for r in H.style_tree(spark.createDataFrame([v[1:] for v in values], "key long, kind long, value long, n long")).collect()}
    entropy = lambda ns: -sum(n / sum(ns) * log(n / sum(ns), 6) for n in ns)
    by = defaultdict(list)
    for p, key, kind, v, n in values:
        by[key, kind, v].append(n)
    content = 1 - sum(entropy(ns) for (key, kind, _), ns in by.items() if key == 1 and kind == H.FEATURES) / 7
    styles = Counter(v for _, key, kind, v, _ in values if key == 1 and kind == H.STYLES)
    assert found[1]["content"] == pytest.approx(content) and found[1]["presentation"] == pytest.approx(entropy(list(styles.values()))) and found[1]["pages"] == 6
    assert (found[2]["presentation"], found[2]["content"], found[2]["styles"]) == (1.0, None, 1)


def test_importance_of_branches():
    keys, parents = [0, 1, 2, 3], [-1, 0, 1, 1]
    facts = {0: (0.0, 1, None), 1: (0.5, 2, None), 2: (0.0, 1, 0.2), 3: (1.0, 1, 1.0)}
    got = H.branch_importance(keys, parents, facts)
    assert got[2:] == [0.2, 1.0] and got[1] == pytest.approx(0.19 * 0.5 + 0.81 * 0.6) and got[0] == pytest.approx(0.9 * got[1])


def test_long_and_deep_pages(spark):
    deep = "<div>" * 5000 + "text" + "</div>" * 5000
    bad = "<a '" * 2000 + "<div </section>" * 2000
    got = texts(spark, [(1, "http://a.example.com", deep), (2, "http://b.example.com", "<p>" + "word " * 200_000), (3, "http://c.example.com", bad)])
    assert got[1] == "text" and got[2] == " ".join(["word"] * 200_000) and isinstance(got[3], str)


def test_registered_query(spark):
    """Pages of the test data: the article's blocks by a plain pattern."""
    d = "/root/testdata/sf0.001"
    found = H.op13_site_style_tree(spark, d)
    assert dict(found.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    for r in found.collect():
        plain = re.sub(r"</?(?:p|h1|br)>", " ", re.search(r"<article>(.*?)</article>", rows[r["page_id"]], re.S)[1])
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", "", plain)).split())
        assert r["text"] == text and r["n_chars"] == len(text)
