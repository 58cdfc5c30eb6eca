"""Wrappers of hosts: inference by itself, main text on several kinds of pages, awkward pages."""

import random

from cyclelens.llm import wrappers as w
from tests.llm.cases import words


def expression(html):
    return w.stream(w.parsed(html))


def shown(nodes):
    return "".join((f"({shown(n[2])})" if n[0] == "(" else n[0] + (f"[{shown(n[2])}]" if n[2] else "")) + n[1] + " " for n in nodes).strip()


def test_repeats_become_groups():
    assert shown(expression("<ul><li>a<li>b<li><b>c</b></ul>")[2]) == "ul[li[#? b[#]?]+]"
    assert shown(expression("<dl><dt>a<dd>b<dt>c<dd>d</dl>")[2]) == "dl[(dt[#] dd[#])+]"


def test_mismatches_become_optional_or_repeated():
    a, b = expression("<div><h1>x</h1><p>1<p>2</div>"), expression("<div><p>1</p><em>y</em></div>")
    assert shown(w.merged(a, b)[2]) == "div[h1[#]? p[#]+ em[#]?]"
    c, d = expression("<div><h2>x</h2><p>1</p><h2>y</h2><p>2</p></div>"), expression("<div><h2>z</h2><p>3</p><hr></div>")
    assert shown(w.merged(c, d)[2]) == "div[(h2[#] p[#])+ hr?]"
    assert shown(w.merged(d, c)[2]) == "div[(h2[#] p[#])+ hr?]"


def main(spark, pages):
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, host string, wrapper string")
    out = w.extracted(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    rows = sorted(out.collect())
    assert [r.n_chars for r in rows] == [len(r.text) for r in rows] and [r.url for r in rows] == [u for u, _ in pages]
    return [r.text for r in rows]


def test_article_among_everything_else(spark):
    body = """<html><head><title>T</title><script>if (a<b) "</article>"</script></head><body><header><h1>Site</h1></header><nav>menu</nav>
    <div class="cookie-notice">We use cookies</div><article class="post-{n}"><header><h1>Title {n}</h1><span>by X</span></header>
    <p>First&nbsp;&eacute; <b>bo</b>ld<br>line</p><div class="ad">buy</div><ul><li>one<li>two</ul><form><input><label>f</label></form><table><tr><td>a<td>b</table>
    text {n} &lt;p&gt; 1 < 2<footer>tags</footer><section id="comments"><article class="comment"><p>reader says a lot {n} {n} {n}</p></article></section></article>
    <aside><p>side</p></aside><div class="related"><article><p>other</p></article></div><footer>&copy;</footer></body></html>"""
    texts = main(spark, [("http://a.example/", body.replace("{n}", str(n))) for n in range(3)])
    assert texts == [f"Title {n}\nFirst é bold line\none\ntwo\na\nb\ntext {n} <p> 1 < 2" for n in range(3)]


def test_host_without_article_element(spark):
    rng = random.Random(2)
    head = '<div id="top"><a href="/">home</a> <a href="/x">x</a></div><div class="c1"><p>The same words on every page of this host, at some length, as a standing remark to all.</p></div>'
    parts = [[words(rng, 30) for _ in range(rng.randint(2, 5))] for _ in range(6)] + [["short one", "short two"]]
    pages = [("https://b.example/p", f"<body>{head}<div class=text>{''.join(f'<p>{p}' for p in ps)}</div><div class=c2><a href=/>next</a></div>") for ps in parts]
    assert main(spark, pages) == ["\n".join(ps) for ps in parts]


def test_two_layouts_of_a_host_and_equal_pages(spark):
    a, b = "<article><p>in an article</p></article><p>out</p>", "<main><h2>head</h2><p>in main</p></main><p>out</p>"
    assert main(spark, [("http://c.example", a), ("http://c.example", b), ("http://c.example", a)]) == ["in an article", "head\nin main", "in an article"]


def test_awkward_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    long = "<article>" + "".join(f"<p>w{i}</p><h{i % 6 + 1}>t</h{i % 6 + 1}>" for i in range(20_000)) + "</article>"
    pages = [(None, None), ("", ""), ("no url", "just text"), ("http://", "<p"), ("http://d/", "</p></div><article>"), ("http://d/", deep), ("http://d/", long), ("http://d/", '<article><p title="a>b">quoted</p><p title="x>open</p></article>'), ("http://d/", "<article><!-- <p>no</p> --><p>a&#x1F600;&amp;amp;&bogus;\u0000</article>")]
    texts = main(spark, pages)
    assert texts[:6] == ["", "", "just text", "", "", "deep"]
    assert len(texts[6].split("\n")) == 40_000 and texts[7].startswith("quoted") and texts[8] == "a😀&amp;&bogus;\u0000"


def test_many_layouts_meet_in_rounds(spark):
    """More distinct streams than one task aligns; every page still gives its article."""
    pages = [("http://e.example/", f"<body>{'<hr>' if i % 2 else ''}<div class=k{chr(97 + i % 13)}{chr(97 + i // 13)}><i>m</i></div><article><p>text {i}</p></article></body>") for i in range(150)]
    assert main(spark, pages) == [f"text {i}" for i in range(150)]
    rows = spark.createDataFrame([(i, "e", h) for i, (_, h) in enumerate(pages)], "page_id long, host string, html string")
    one = w.inferred(rows).collect()
    assert len(one) == 1 and one[0].wrapper == w.inferred(rows.repartition(7)).collect()[0].wrapper


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert w.extracted(df).collect() == []
