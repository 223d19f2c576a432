import html
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.llm import html_main
from marlstone.llm.html_main import deduce_templates, extract_main, main_text, page_orders, page_tokens, parse

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/x">menu</a></li></ul></nav>
<!-- ad <p>no</p> --><div class="ad">buy</div><div class="cookie-notice">ok?</div><article><h1>%s</h1><p><b>One &amp; &lt;two&gt;<br>three  four<p>Five
 six</p><ul><li>a</li><li>b</ul><form>mail <input></form><aside>side</aside><p>Last&am</p><div class="comments"><p>first!</p></div></article><div id="sidebar">s</div><footer>&copy; f</footer></body></html>"""


def test_article(spark):
    want = "Title é\n\nOne & <two> three four\n\nFive six\n\na\n\nb\n\nLast&am"
    assert main_text(ARTICLE % "Title é") == want
    rows = [(i, f"http://h{i % 2}.example/{i}", ARTICLE % f"Title {'é' * i}") for i in range(6)] + [(7, None, None), (8, "no url", ""), (0, "http://h0.example/0", ARTICLE % "Title ")]
    got = {(r.page_id, r.url): r for r in extract_main(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()}
    assert len(got) == 8
    for p, u, h in rows:
        text = want.replace("é", "é" * p, 1).replace("Title  ", "Title ") if h else ""
        assert got[p, u].text.split("\n\n")[1:] == text.split("\n\n")[1:]
        assert got[p, u].n_chars == len(got[p, u].text)


def test_template_without_article_keeps_what_varies(spark):
    page = "<html><body><div class='top'>Our site</div><div class='x'><p>{a}</p><p>{b}</p></div><div class='end'>Rights reserved</div></body></html>"
    rows = [(i, f"https://u@Host.example:80/p?{i}", page.format(a=f"alpha {i}", b=f"beta {i * i}")) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main(df).collect()}
    assert got == {i: f"alpha {i}\n\nbeta {i * i}" for i in range(5)}


def texts(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in extract_main(df).orderBy("page_id").collect()]


def test_own_article_or_main_goes_before_what_varies(spark):
    for tag in ("article", "main"):
        page = "<body><p class='kicker'>kicker {i}</p><" + tag + " id='post-{i}'><h1>Title {i}</h1><p>Text {i}</p></" + tag + "><p class='byline'>by {i}</p><div class='end'>end</div></body>"
        assert texts(spark, [page.format(i=i) for i in range(5)]) == [f"Title {i}\n\nText {i}" for i in range(5)]


def test_framed_cards_leave_the_own_article(spark):
    page = "<body><article id='post-{i}'><p>Text {i}</p></article><article class='card'><p>Card {i}</p></article></body>"
    assert texts(spark, [page.format(i=i) for i in range(5)]) == [f"Text {i}\n\nCard {i}" for i in range(5)]


def test_gap_keeps_rare_and_equal_blocks(spark):
    page = "<body><div class='top'><a href='/'>Our site</a></div><div class='x'><h2>Summary</h2><p><b>alpha</b> {i}</p>{rare}<h3>Sources</h3></div><div class='end'>Rights reserved</div></body>"
    rare = ["<ul><li>one</li></ul>", "<blockquote>said</blockquote>", "<table><tr><td>cell</td></tr></table>", "<h4>sub</h4>", ""]
    want = ["one", "said", "cell", "sub", None]
    assert texts(spark, [page.format(i=i, rare=r) for i, r in enumerate(rare)]) == ["\n\n".join(x for x in ("Summary", f"alpha {i}", w, "Sources") if x) for i, w in enumerate(want)]


def test_gap_holds_blocks_with_a_role_of_their_own(spark):
    page = "<body><div class='top'>Our site</div><div class='meta'><p>by {i}</p></div><div id='post-{i}'><p>Text {i}</p><p>The end</p></div><div class='end'>Rights reserved</div></body>"
    assert texts(spark, [page.format(i=i) for i in range(5)]) == [f"by {i}\n\nText {i}\n\nThe end" for i in range(5)]


def test_occurrence_vectors_separate_classes(spark):
    rows = [(i, "http://h", "<body><main>" + "<p>x</p>" * (i + 1) + "</main></body>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h"))
    (r,) = deduce_templates(df).collect()
    assert len(r.template.mains) == 1


def brute_template(pages, support=0.6):
    """Frame, main and dropped roles of one host from whole vectors."""
    vectors, kinds, texts, sizes = defaultdict(lambda: [0] * len(pages)), {}, defaultdict(dict), defaultdict(lambda: [0, 0])
    for i, page in enumerate(pages):
        counts, said, size = page_tokens(page)
        for (role, kind), n in counts.items():
            vectors[role][i], kinds[role] = n, kind
            texts[role][i] = said.get(role, -1)
            for k, x in enumerate(size.get(role, ())):
                sizes[role][k] += x
    classes = defaultdict(list)
    for role, v in vectors.items():
        if sum(x > 0 for x in v) >= support * len(pages):
            classes[tuple(v)].append(role)
    frame, mains, dropped, tokens = set(), {"article": set(), "main": set(), "other": set()}, set(), set()
    numbers = {r: c for c, roles in enumerate(classes.values()) for r in roles}
    orders = [page_orders(p, {r: c for r, c in numbers.items() if len([x for x in numbers.values() if x == c]) >= 2 or max(vectors[r]) > 1 or set(vectors[r]) == {1}}) for p in pages]
    for c, (v, roles) in enumerate(classes.items()):
        seen = {o[c] for o in orders if c in o}
        if len(seen) != 1 or next(iter(seen))[0] == -1:
            continue
        for r in roles:
            tokens.add(r)
            said = [t for t in texts[r].values()]
            menu = kinds[r] == "other" and sizes[r][0] > 0 and 2 * sizes[r][1] > sizes[r][0]
            if set(v) == {1}:
                frame.add(r)
            if kinds[r] == "aside" or menu:
                dropped.add(r)
            elif kinds[r] in mains and (kinds[r] != "other" or min(said) < max(said)):
                mains[kinds[r]].add(r)
    return frame, next((m for m in mains.values() if m), set()), dropped, tokens


def test_templates_match_brute_force(spark):
    rnd = random.Random(6)
    for shape in range(4):
        pages = []
        for i in range(8):
            items = "".join(f"<li><a href='/{k}'>item {k} {i}</a></li>" for k in range(rnd.randrange(1, 4)))
            body = "".join(f"<p>text {i} {k}</p>" for k in range(rnd.randrange(1, 5)))
            main = {0: f"<article><h1>t {i}</h1>{body}</article>", 1: f"<main>{body}</main>", 2: f"<div class='x'>{body}</div>", 3: f"<article id='p{i}'>{body}</article>"}[shape]
            parts = [f"<ul class='m'>{items}</ul>", main] if i % 3 or shape != 2 else [main, f"<ul class='m'>{items}</ul>"]
            pages.append(f"<html><body><div class='top'>site</div>{''.join(parts)}<footer>end {i}</footer></body></html>")
        df = spark.createDataFrame([(i, "http://h", p, "h") for i, p in enumerate(pages)], "page_id long, url string, html string, host string").repartition(3)
        (r,) = deduce_templates(df).collect()
        got = tuple(set(x) for x in (r.template.frame, r.template.mains, r.template.dropped, r.template.tokens))
        assert got == brute_template(pages), shape


def test_links_make_a_menu_without_names(spark):
    page = "<body><div class='k1'><a href='/a'>go {i}</a> <a href='/b'>there {i}</a></div><div class='k2'><p>Text {i} <a href='/c'>link</a></p><p>More {i}</p></div><div class='k3'>end</div></body>"
    assert texts(spark, [page.format(i=i) for i in range(6)]) == [f"Text {i} link\n\nMore {i}" for i in range(6)]


def test_classes_out_of_order_are_no_template():
    classes = {}
    one, two = "<body><div class='a'></div><div class='b'></div></body>", "<body><div class='b'></div><div class='a'></div></body>"
    for what, e, _, _ in parse(one):
        if what == "open" and e.tag == "div":
            classes[e.role] = 1
    assert page_orders(one, classes)[1] != page_orders(two, classes)[1]
    assert page_orders(one.replace("</body>", "<div class='b'></div></body>"), classes)[1][0] == -1


def test_page_without_the_frame_is_judged_alone(spark):
    page = "<body><div class='top'>Site</div><article><p>Text {i}</p></article><div class='end'>e</div></body>"
    pages = [page.format(i=i) for i in range(5)] + ["<body><main><p>Own</p></main><p>not</p></body>"]
    assert texts(spark, pages)[-1] == "Own"


def test_salted_templates_give_the_same(spark, monkeypatch):
    page = "<body><p class='kicker'>kicker {i}</p><article><p>Text {i}</p></article></body>"
    want = texts(spark, [page.format(i=i) for i in range(5)])
    monkeypatch.setattr(html_main, "SENT_BYTES", 0)
    assert texts(spark, [page.format(i=i) for i in range(5)]) == want == [f"Text {i}" for i in range(5)]


def test_deep_nesting_takes_time_in_proportion():
    took = []
    for n in (4_000, 16_000):
        began = time.perf_counter()
        assert main_text("<div>" * n + "deep" + "</div>x" * n).startswith("deep")
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "http://h/1", "<article>a</article>"), (None, "http://h/1", "<article>a</article>"), (1, None, None)]
    got = extract_main(spark.createDataFrame([(*r, 0, "x") for r in rows], "page_id long, url string, html string, host int, template string")).collect()
    assert sorted(((r.page_id, r.text) for r in got), key=str) == sorted([(None, "a"), (None, "a"), (1, "")], key=str)


def test_broken_markup():
    for bad in ("<", "<p", "a<b", "<p><p></div></p>x", "<!-- open", "<script>never", '<a href="x>y</a>', "&#0;&#xD800;", "<p>" * 3000 + "deep", "<title>t"):
        main_text(bad)
        list(parse(bad))
    assert main_text("<p>1 < 2 &amp;amp; 3</p>") == "1 < 2 &amp; 3"
    assert main_text("plain " + html.escape("<i>")) == "plain <i>"


def test_empty_table(spark):
    assert extract_main(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article><p data-id="alert">one</p><div data-class="share" data-role="banner">two</div><p title="x id=alert class=share">three</p></article>', "one\n\ntwo\n\nthree"),
        ('<main><p>text</p><article class="comment">said</article><article id="comment-7">more</article></main>', "text"),
        ('<article><p>a</p><table class="share-price-table"><tr><td>b</td></tr></table><div class="related-work">c</div><figure class="header-image"><figcaption>d</figcaption></figure><div class="share-buttons">no</div><div class="related">no</div></article>', "a\n\nb\n\nc\n\nd"),
        ("<article><p>take <button>Copy</button>this <select><option>x</option></select>and <math><mi>a</mi><mo>+</mo><mi>b</mi></math> so<script>1</script>.</p></article>", "take this and a+b so."),
    ],
)
def test_names_and_controls_within_an_article(html, text):
    assert "\n\n".join(t for what, e, t, _ in parse(html) if what == "text" and not (e and e.aside)) == text
