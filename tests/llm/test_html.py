"""Page text: hand-made sites with known text, broken markup, and the test pages' articles."""

import html
import random
import re
import time

import pytest

from echoloom.llm import html_extract
from echoloom.llm.html_extract import Page, extract, extract_main_text

SITE = """<html><head><title>T{k}</title><style>p{{}}</style><script>var x = "<p>no</p>";</script></head><body>
<div id="header-top"><a href=/>Home</a></div><nav><ul><li><a href="/a">A{k}</a></li></ul></nav>
<div class="cookie notice">We use cookies {k}</div><div class="ad">Buy {k}</div>
<div id="content"><h1>Title {k}</h1><p>First &amp; only  words
of <b>page</b> {k}.<p>Second&nbsp;part<br>goes on {k}</div>
<aside>Other {k}</aside><form><input name=q><label>Find</label></form><div class="comments"><p>Reader {k} says</p></div>
<footer>&copy; {k}</footer></body></html>"""


def want(k):
    return f"Title {k}\nFirst & only words of page {k}.\nSecond part goes on {k}"


def test_site():
    pages = [Page(SITE.format(k=k)) for k in range(12)]
    assert extract(pages) == [want(k) for k in range(12)]
    assert extract([Page(SITE.format(k=3))]) == [want(3)]


PLAIN = "<body><div class=top>Site of things</div><div class=c><p>{own}</p><p>Share this page</p></div><div class=end>Printed by us</div></body>"


def plain_text(k):
    return f"Text number {k} is {'long ' * k}here"


def test_deduction_decides_on_plain_pages(monkeypatch):
    """Without names of parts only the template tells content, from two pages on; without it all pages change."""
    pages = [Page(PLAIN.format(own=plain_text(k))) for k in range(40)]
    for n in (2, 3, 4, 5, 7, 40):
        assert extract(pages[:n]) == [plain_text(k) for k in range(n)]
    assert extract(pages[:1]) == [f"Site of things\n{plain_text(0)}\nShare this page\nPrinted by us"]
    monkeypatch.setattr(html_extract, "deduce", lambda pages: {})
    assert all(t != plain_text(k) for k, t in enumerate(extract(pages)))


def test_deduction_decides_on_the_test_pages(spark, small_dir):
    """Elements that are no deduced slots have no role: without the template every page keeps its menus and footers."""
    rows = [r["html"] for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()]
    pages = [Page(h) for h in rows]
    assert all(html_extract.page_text(p, {}) != html_extract.page_text(p, html_extract.deduce([p])) for p in pages)


def test_a_text_that_some_pages_share_stays():
    """Half of a host's plain pages have one sentence: it is content; on every page it is template, in articles never."""
    page = "<body><div>Site of things</div><div><p>Text {k} here</p>{more}</div></body>"
    half = [Page(page.format(k=k, more="<p>A sentence of many</p>" if k % 2 else "")) for k in range(20)]
    assert extract(half) == [f"Text {k} here" + ("\nA sentence of many" if k % 2 else "") for k in range(20)]
    every = [Page(page.format(k=k, more="<p>A sentence of all</p>")) for k in range(20)]
    assert extract(every) == [f"Text {k} here" for k in range(20)]
    shared = [Page(f"<article><p>Text {k}</p>{'<p>A sentence of many</p>' if k % 3 else ''}<p>Of all</p></article>") for k in range(20)]
    assert extract(shared) == [f"Text {k}" + ("\nA sentence of many" if k % 3 else "") + "\nOf all" for k in range(20)]


def test_parts_of_role_words_name_slots_that_deduction_found():
    """Varying texts of a header, menu and notice with compound names go where their host shows them as slots."""
    page = '<body><div class="site-header">Word {k} of the day</div><div id="main-nav"><a href=x>Next {k}</a></div><div class="main-column"><p>Own text {k} of this page and some more</p><p>It goes on {k}</p></div><div class="cookie-banner">Cookie {k}</div></body>'
    want = [f"Own text {k} of this page and some more\nIt goes on {k}" for k in range(9)]
    assert extract([Page(page.format(k=k)) for k in range(9)]) == want
    rare = [Page(f"<body><div class=a>Line {k} <p>Text {k}</p></div></body>") for k in range(9)] + [Page('<body><div class=a>Line 9 <div class="share-price">Prices rose</div></div></body>')]
    assert extract(rare)[-1] == "Line 9\nPrices rose"  # no template holds it
    layout = [Page(f'<body><div class="layout has-sidebar"><p>All the text {k}</p></div><div>About {k}</div></body>') for k in range(9)]
    assert extract(layout) == [f"All the text {k}\nAbout {k}" for k in range(9)]
    comments = [Page(f'<main><article><p>Text {k}</p></article><div class="comments-area"><p>Said {k}</p></div></main>') for k in range(9)]
    assert extract(comments) == [f"Text {k}" for k in range(9)]
    article = [Page(f'<div class="with-sidebar"><article><div class="entry-header"><h1>Title {k}</h1></div><p class="share-price">Prices {k}</p></article></div>') for k in range(9)]
    assert extract(article) == [f"Title {k}\nPrices {k}" for k in range(9)]


def test_copies_of_an_article_stay():
    page = "<body><nav>Menu</nav><article><p>Same words</p></article></body>"
    assert extract([Page(page)] * 10) == ["Same words"] * 10


def test_broken_markup():
    for source, text in (("", ""), ("plain words", "plain words"), ("<article><p>a<p>b", "a\nb"), ("<article>x<!-- <p>no -->y</article>", "xy"), ("<article><p>1 < 2 &lt; 3</p></article>", "1 < 2 < 3"), ("<article><script>if (a</b) {}</script>t</article>", "t"), ("<article><header><h1>H</h1></header><ul><li>i<li>j</ul></article>", "H\ni\nj"), ("<article>q</article", "q"), ("<<<>>><article>q</article>", "q")):
        assert extract([Page(source)]) == [text], source
    assert extract([Page("<div>" * 3000 + "deep" + "</div>" * 3000)]) == ["deep"]


def test_pages(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    got = {r["page_id"]: r for r in extract_main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]]["text"] == "\n".join(x for x in parts if x) and got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_odd_rows(spark):
    rows = [(1, "http://a/x", "<article>t</article>", 1, "h"), (1, "http://a/x", "<article>t</article>", 1, "h"), (2, None, None, None, None), (None, "no url", "", 2, None), (3, "http://a/y", "<p>" + "word " * 50_000, 0, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host long, text string")
    got = extract_main_text(pages, chunk_bytes=2).collect()
    assert len(got) == 5 and sorted(len(r["text"]) for r in got) == [0, 0, 1, 1, 249_999]
    assert extract_main_text(pages.limit(0)).count() == 0


def test_articles_keep_fixed_texts_and_copies_stay(spark):
    """Fixed lines of an article stay, as it may repeat a sentence; parts of every article with a role word go."""
    pages = [f"<body><article><p>Own words {k} {'w%d ' % k * 30}</p><p>Read more on our site</p><div class=share>Share {k}</div></article></body>" for k in range(49)]
    rows = [(k, f"http://a/{k}", p) for k, p in enumerate(pages)] + [(100 + k, f"http://b/{k}", pages[0]) for k in range(9)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(49):
        assert got[k] == f"Own words {k} {'w%d ' % k * 30}".strip() + "\nRead more on our site", k
    assert all(got[100 + k].endswith("Read more on our site\nShare 0") for k in range(9))  # copies are one page: no evidence
    assert extract([Page(p) for p in pages]) == [got[k] for k in range(49)]


def test_slots_without_a_role_are_the_text_where_no_element_holds_content():
    pages = [Page(f"<body><div>Site of things</div><div><p>Text number {k} is here</p></div></body>") for k in range(49)]
    assert extract(pages) == [f"Text number {k} is here" for k in range(49)]
    copies = [Page("<body><div>Menu</div><div><p>Once said words</p></div></body>")] * 9
    assert extract(copies) == ["Menu\nOnce said words"] * 9
    beside = [Page(f"<body><div>Fixed line</div><div class=lead>Lead {k}</div><article>Text {k}</article></body>") for k in range(9)]
    assert extract(beside) == [f"Text {k}" for k in range(9)]
    form = [Page(f"<body><form><div class=menu>Menu {k}</div><div>Text {k}</div></form><footer>End {k}</footer></body>") for k in range(3)]
    assert extract(form) == [f"Menu {k}\nText {k}" for k in range(3)]  # all that is named by words alone
    assert extract([Page("<body><nav>Only</nav><footer>menus</footer></body>")]) == [""]


def test_role_words_hide_no_article():
    for source, text in (
        ('<div class="layout has-sidebar"><article>a</article></div>', "a"),
        ('<div class="sidebar"><main>a</main></div>', "a"),
        ('<article><div class="entry-header"><h1>t</h1></div><section id="related-work">r</section><h2 id="search-results">s</h2><h2 id="search">q</h2></article>', "t\nr\ns\nq"),
        ('<article>a</article><div class="comments"><article>no</article></div>', "a"),
        ('<article>a<div class="comments"><p>no</p></div></article>', "a"),
        ('<article><p>a</p><p class="social">Social life</p></article>', "a\nSocial life"),
        ('<article><p>a</p><div class="share"><p>Share prices rose today.</p></div></article>', "a\nShare prices rose today."),
        ('<article><p>a</p><ul class="menu"><li>Soup</li></ul></article>', "a\nSoup"),
        ('<body><div class="banner"><p>Main text</p></div></body>', "Main text"),
    ):
        assert extract([Page(source)]) == [text], source
    pages = [Page(f'<article><p>a {k}</p><section id="related">see {k}</section></article>') for k in range(9)]
    assert extract(pages) == [f"a {k}" for k in range(9)]


def sites(seed):
    """Random sites with known texts: parts with and without names, optional parts, repeated items, varying wrappers."""
    rng = random.Random(seed)
    word = lambda: rng.choice("amber birch cedar delta ember fjord grove haven inlet jetty knoll ledge".split()) + str(rng.randrange(50))
    words = lambda n: " ".join(word() for _ in range(n))
    named = rng.random() < 0.5
    menu, foot, fixed = ("nav", "footer", words(4)) if named else ("div", "div", words(4))
    out = []
    for k in range(rng.randrange(2, 12)):
        paragraphs = [f"{words(rng.randrange(3, 30))} {k}" for _ in range(rng.randrange(1, 6))]
        promo = f"<div class='promo-box'>{words(3)}</div>" * (k % 2 == 0 or k == 1)
        body = "".join(f"<p>{x}</p>" for x in paragraphs)
        body = f"<article>{body}</article>" if named else f"<div class='c{k}'>{body}</div>"
        items = "".join(f"<li>{words(2)}</li>" for _ in range(k % 4)) if named else f"<b>{fixed}</b>"
        out.append((f"<html><head><title>{word()}</title></head><body class='page-{k}'><{menu}><ul>{items}</ul></{menu}>{promo}{body}<{foot}>{fixed}</{foot}></body></html>", "\n".join(paragraphs)))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_random_sites_give_the_text_they_were_made_of(seed):
    pages = sites(seed)
    assert extract([Page(p) for p, _ in pages]) == [t for _, t in pages]


def test_templates_of_tables_are_those_in_memory(spark):
    """Counted by grouped sums over salted hosts of several partitions: the same texts as of all pages together."""
    rows, want = [], []
    for seed in range(12):
        pages = sites(seed)
        want += extract([Page(p) for p, _ in pages])
        rows += [(len(rows) + k, f"https://h{seed}.example/{k}", p) for k, (p, _) in enumerate(pages)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in extract_main_text(table, chunk_bytes=700).collect()}
    assert [got[k] for k in range(len(rows))] == want


BROKEN = ["<a ", '<a b="', "<a b='>", "<div>", "<ul><li>", "<div>x", "<b><div>", "<", "<!--", "<![CDATA[", "<script>", "&", "<p", "<table><tr><td>", "</p>", "<div a=", "&lt;&#", "<head>", "<article>"]


@pytest.mark.parametrize("part", BROKEN)
def test_broken_markup_takes_time_in_proportion(part):
    """15 kB and 60 kB of it: four times the time and not sixteen; and within a page, with end tags behind."""
    n = 15_000 // len(part)
    small, large = (min(_seconds(part * k) for _ in range(2)) for k in (n, 4 * n))
    assert large < 9 * small + 0.1
    extract([Page("<body><p>a</p>" + part * n + "</p></b></div>" * 1000)])


def _seconds(source):
    began = time.process_time()
    page = Page(source)
    html_extract.page_text(page, html_extract.deduce([page]))
    return time.process_time() - began


def test_a_very_long_page():
    source = "<body><nav>x</nav><article>" + "<p>Some words &amp; <b>more</b> of them.</p>" * 40_000 + "</article></body>"
    text = extract([Page(source)])[0]
    assert text.count("\n") == 39_999 and text.startswith("Some words & more of them.\nSome")
