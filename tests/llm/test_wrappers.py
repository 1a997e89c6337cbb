import pytest
from hypothesis import given
from hypothesis import strategies as st

from gaugewright.llm import wrappers

HEAD = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body>"


AFTER = "<footer>&copy; us</footer></body></html>"


def page(body, before="<nav><ul><li><a href='/x'>menu</a></li></ul></nav>", after=AFTER):
    return f"{HEAD}{before}{body}{after}"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>T</h1><p>One  two\n three</p><p>Four</p></article>", "T One two three Four"),
        ("<article><h1>T &amp; &lt;b&gt; &eacute;&#33;</h1><p><b>Bo<i>ld</i></b>ness<br>next<p>open</article>", "T & <b> é! Boldness next open"),
        ("<div class='ad'>buy</div><article>A<aside>side</aside><div class='share-bar social'>share</div><form>f<input></form>B</article>", "A B"),
        ("<article><p>x</p></article><section id='comments'><p>reader says</p></section>", "x"),
        ("<article><p>x</p><div class='comments'><p>reader says</p></div><!-- <p>no</p> --></article>", "x"),
        ("<main><header>Head</header><p>m1</p><p>m2</p></main>", "Head m1 m2"),
        ("<header>site</header><div id='wrap'><div class='side sidebar'>s</div><div class='story'><p>p1 is longer</p><p>p2</p></div></div>", "p1 is longer p2"),
        ("<article></article>", ""), ("<article><p>cut &am", "cut &am"), ("<article><p>cut <b", "cut"), ("<article><p>a &amp</p></article>", "a &"),
        ("<article><ul><li>i<li>j</ul><table><tr><td>c<td>d</table></article>", "i j c d"),
    ],
)
def test_extracts(spark, body, text):
    df = spark.createDataFrame([(1, "http://h.example/a", page(body, after="" if "cut" in body else AFTER))], "page_id long, url string, html string")
    assert wrappers.extracted(df).first().text == text


def test_inference_finds_slots_groups_and_options():
    pages = ["<div><h2>Fixed</h2><p>a</p><p>b</p></div>", "<div><h2>Fixed</h2><p>c</p><i>new</i></div>", "<div><h2>Fixed</h2><p>d</p><p>e</p><p>f</p></div>"]
    wrapper = None
    for p in pages:
        new = wrappers.wrapper_of(wrappers.tree(p))
        wrapper = new if wrapper is None else wrappers.aligned(wrapper, new)
    fixed, new = (f"#{wrappers.digest(t)}" for t in ("Fixed", "new"))
    assert wrappers.expression(wrapper["k"][0]) == f"<div> <h2> {fixed} </h2> ( <p> #TEXT </p> )+ ( <i> {new} </i> )? </div>"
    assert wrapper["e"] == [wrappers.digest("Fixed")]
    assert wrappers.unflat(wrappers.flat(wrapper)) == wrapper


def test_wrappers_do_not_depend_on_dealing(spark):
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i % 5}'}.example/{i}", page(f"<div class='story'><h1>Title {i}</h1>" + "".join(f"<p>text {i} {j}</p>" for j in range(i % 4 + 1)) + "</div><div class='box'>Same everywhere</div>")) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [sorted(map(tuple, wrappers.extracted(df.repartition(n), limit).collect())) for n in (1, 9) for limit in (1 << 20, 0)]
    assert got[0] == got[1] == got[2] == got[3]
    for i, _, text, n in got[0]:
        assert text == " ".join([f"Title {i}", *(f"text {i} {j}" for j in range(i % 4 + 1))]) and n == len(text)


def test_odd_rows(spark):
    rows = [(1, None, None, "x", 1), (None, "no scheme", "", "x", 1), (2, "http://a/", "plain text", "x", 1), (2, "http://a/", "plain text", "x", 1), (3, "http://a/", "<" * 2000 + "p", "x", 1), (4, "http://a/", page("<article>" + "<p>w</p>" * 5000 + "</article>"), "x", 1), (5, "HTTP://A:80/x", "<div>" * 3000 + "deep", "x", 1), (6, "http://a/q", page("<article>" + "".join(f"<h{i % 6 + 1}>{i}</h{i % 6 + 1}><p class=c{i}>w</p>" for i in range(900)) + "</article>"), "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int")
    got = wrappers.extracted(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == "" and by[2] == "plain text" and by[4] == " ".join(["w"] * 5000) and by[5] == "deep"
    assert by[6] == " ".join(f"{i} w" for i in range(900))
    assert wrappers.extracted(df.where("false")).count() == 0


def extracts(*bodies):
    """Texts of pages of one host, without Spark."""
    pages = [page(b) for b in bodies]
    wrapper = wrappers.wrapper_of(wrappers.tree(pages[0]))
    for p in pages[1:]:
        wrapper = wrappers.unflat(wrappers.flat(wrappers.aligned(wrapper, wrappers.wrapper_of(wrappers.tree(p)))))
    return [wrappers.extract(p, wrappers.place(wrapper)) for p in pages]


@pytest.mark.parametrize("name", ["layout with-sidebar", "no-sidebar", "navbar-offset", "has-banner", "has-ads", "banner"])
def test_furniture_words_do_not_hide_the_article(name):
    for tag in ("div", "form"):
        for inner in ("<article><p>One</p><p>two</p></article>", "<div class='story'><p>One</p><p>two</p></div>"):
            assert extracts(f"<{tag} class='{name}'>{inner}<div class='sidebar'>s</div></{tag}>") == ["One two"]
    teaser = "<div class='related'><article class='t'><p>Other news that is longer</p></article></div>"
    assert extracts(f"<div class='{name} x-ads'><article>A</article></div>{teaser}")[0] == ("A" if name != "banner" else "Other news that is longer")


def test_furniture_words_within_an_article():
    kept = "<h2 id='related-work'>Related</h2><section id='comments-on-x'><p>On x</p></section><p class='notice-period'>Month</p>"
    left_out = "<div class='comments'><p>c</p></div><div class='share-bar'>s</div><ul class='social links'><li>l</ul><aside>a</aside>"
    assert extracts(f"<article><h1>T</h1>{kept}{left_out}</article>") == ["T Related On x Month"]


def test_all_blocks_of_an_article_without_its_tag():
    sections = "<div class='post'><h1>T{0}</h1><section id='intro'><p>Intro {0}</p></section><section id='methods'><p>Methods are longer {0}</p></section></div>"
    lead = "<div class='lead'><p>Lead {0}</p></div><div class='story'><p>Story is longer {0}</p><h2 id='related-work'>Same</h2></div><div class='box'>Same everywhere</div>"
    title = "<div class='site-nav'>menu {0}</div><h1 class='main-title'>T{0}</h1><div class='entry'><p>Entry {0}</p></div><div class='box'>Same everywhere</div>"
    for body, text in ((sections, "T{0} Intro {0} Methods are longer {0}"), (lead, "Lead {0} Story is longer {0} Same"), (title, "T{0} Entry {0}")):
        assert extracts(*(body.format(i) for i in range(3))) == [text.format(i) for i in range(3)]
    assert extracts(sections.format(1)) == ["T1 Intro 1 Methods are longer 1"]


def test_deep_elements():
    nest = "<div>" * 200 + "<p>deep</p><script>var a = 1;</script><nav>menu</nav><div class='comments'>c</div>" + "</div>" * 200
    assert extracts(f"<div class='wrap'><article><p>before</p>{nest}<p>after</p></article></div><p>outside</p>") == ["before deep after"]
    assert extracts(f"<div class='post'><p>before</p>{nest}<p>after</p></div>") == ["before deep after"]
    n = 50_000
    assert extracts(f"<article>{'<div><b>' * n}x{'</i></div>' * n}<p>after</p></article>") == ["x after"]
    assert extracts("<article>" + "<div>" * 140 + "".join(f"<span>{i}" for i in range(300)) + "</div>" * 140 + "end</article>") == ["".join(map(str, range(300))) + " end"]


@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40))
def test_common_is_a_longest_common_subsequence(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
    for every in (3, 256):
        got = wrappers.common(x, y, every)
        assert len(got) == best[-1][-1] and all(x[i] == y[j] for i, j in got)
        assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:], strict=False))


def test_raw_elements_and_slashes():
    for body in ("<script src='/x.js'/>var y=2;</script>", "<script src=/x.js/>var y=2;</script>", "<style/>p{}</style>", "<aside data-u=/a/>ADVERT</aside>", "<div class='ad'/>ADVERT</div>"):
        assert extracts(f"<article><p>before</p>{body}<p>after</p></article>") == ["before after"], body


def test_constants_of_a_host_are_left_out():
    body = "<article><h1>Title {0}</h1><p>A paragraph about {0} and more of it, written for {0}, and then some more words about {0}.</p><p>Subscribe to our daily letter now</p><p>Another one {0}, as long as it is.</p><section class='social-science'>On {0}</section></article>"
    text = "Title {0} A paragraph about {0} and more of it, written for {0}, and then some more words about {0}. Another one {0}, as long as it is. On {0}"
    assert extracts(*(body.format(i) for i in range(5))) == [text.format(i) for i in range(5)]
    bare = body.replace("article>", "div>").replace("<section class='social-science'>On {0}</section>", "")
    assert extracts(*(bare.format(i) for i in range(5))) == [text.removesuffix(" On {0}").format(i) for i in range(5)]
    for n in (1, 2, 3, 6):  # the same decision for any number of pages, and for copies of one page
        assert not any("Subscribe" in x for x in extracts(*(body.format(i) for i in range(n))) + extracts(*[body.format(1)] * n))
    near = "<article>" + "".join(f"<p>Paragraph {i}</p>" for i in range(20)) + "<p>{0}</p></article>"
    assert len(extracts(*(near.format(i) for i in range(5)))[0].split()) == 41


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 12])
def test_constant_headings_and_lines_of_articles_stay(n):
    body = "<article><h1>T{0}</h1><h2>Abstract</h2><p>What {0} found, in a long and telling sentence.</p><h2 id='related-work'>Related work</h2><p>Of {0}.</p><h2>Subscribe</h2><h2>Conclusion</h2><p>All data are open.</p></article>"
    text = "T{0} Abstract What {0} found, in a long and telling sentence. Related work Of {0}. Subscribe Conclusion All data are open."
    assert extracts(*(body.format(i) for i in range(n))) == [text.format(i) for i in range(n)]
    bare = body.replace("article>", "div>")
    assert extracts(*(bare.format(i) for i in range(n))) == [text.format(i) for i in range(n)]


def test_what_only_one_page_says_stays_even_if_it_reads_like_a_notice():
    pages = [f"<article><p>Text {i} of some length, as pages have.</p>{x}</article>" for i, x in enumerate(("<p>Subscribe to nothing, they said</p>", "", "<p>Other words</p>"))]
    assert extracts(*pages)[0].endswith("Subscribe to nothing, they said")
