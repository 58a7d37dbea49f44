import re
from collections import defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from conftest import MEDIUM, SMALL
from tallyloom.llm import html_extract as h
from tallyloom.llm.common import table

PAGES = "page_id bigint, url string, html string, text string, host string"


def test_structure_without_a_template():
    source = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>menu</a></nav><header>top</header>
      <article><h1>Head &amp; tail</h1><p>One <b>bold</b>
      word.<p>Two<br>lines<script>var a = "</p>";</script><div class="ad">Buy</div><form><input>Send</form></article>
      <div id="comments">rude</div><footer>end</footer></body></html>"""
    assert h.extract(source) == "Head & tail\n\nOne bold word.\n\nTwo lines"


def test_class_words_neither_hide_an_article_nor_keep_a_comment():
    assert h.extract('<article><p>Story.</p></article><article class="comment"><p>rude</p></article>') == "Story."
    assert h.extract('<article class="post category-legal">A<div class="legal-note">rights</div><label>L</label></article>') == "A\n\nL"
    assert h.extract('<div class="layout has-sidebar"><article>in</article></div><div class="sidebar">out</div>') == "in"
    assert h.extract('<div class="sidebar-left layout"><article>in</article></div>') == "in"


def test_furniture_alone_gives_no_text():
    alone = ['<div class="menu"><a>Home</a> <a>News</a></div>', '<div class="sidebar">only sidebar</div>', '<div id="login">Log in</div>', '<div class="search">find</div>', "<nav>n</nav><footer>f</footer>"]
    assert [h.extract(x) for x in alone] == [""] * len(alone)


def test_notices_and_headers_go_from_an_article_but_for_their_headings():
    assert h.extract('<article>A<div class="notice">We use cookies</div><header>By someone</header></article>') == "A"
    assert h.extract('<article><header><h1>Title</h1><p>By someone</p></header><p>Body</p></article>') == "Title\n\nBody"
    assert h.extract('<main><div class="banner"><h2>Part</h2>3 offers</div>Text</main>') == "Part\n\nText"


GOLD = [
    (  # a weblog
        """<!doctype html><html><head><title>No</title></head><body class="post-template"><header class="site"><h1>My blog</h1>
        <nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav></header><main role="main"><article class="post tag-search">
        <header><h1>On&nbsp;rivers</h1><time>May 1</time></header><p>Rivers <em>run</em>
           to the&#32;sea.<p>They do &mdash; mostly.<blockquote><p>Said one.</p></blockquote><ul><li>Po<li>Elbe</ul>
        <div class="share-links"><a>Share</a></div></article><section id="comments"><h2>2 comments</h2><p>Nice!</p></section></main>
        <aside>Archive</aside><footer>&copy; me</footer></body></html>""",
        "On rivers\n\nRivers run to the sea.\n\nThey do \u2014 mostly.\n\nSaid one.\n\nPo\n\nElbe",
    ),
    (  # an old page without sections
        """<HTML><BODY><TABLE><TR><TD class="navbar"><A HREF="x">Up</A></TD><TD id="body"><H2>Notes</H2><P>First.<P>Second<BR>line &lt;b&gt;.
        <SCRIPT>document.write("<p>no</p>")</SCRIPT></TD></TR></TABLE><FORM><INPUT>Go</FORM><DIV CLASS="copyright">1999</DIV></BODY></HTML>""",
        "Notes\n\nFirst.\n\nSecond line <b>.",
    ),
    (  # a shop's guide with adverts and a notice
        """<body><div class="cookie-consent">OK?</div><div id="content"><h1>Guide</h1><p>Buy <a href=q>well</a>.</p><div class="ad">Cheap!</div>
        <div class="alert">Shop closed</div><pre>a  b
        c</pre><div hidden>trap</div><!-- <p>gone</p> --></div><div class="related"><p>More</p></div></body>""",
        "Guide\n\nBuy well.\n\na b c",
    ),
    ("<body><nav><a>All</a></nav><div class=login-form>Sign in</div><footer>f</footer></body>", ""),
]


def test_whole_texts_of_pages_read_by_hand(spark):
    assert [h.extract(x) for x, _ in GOLD] == [y for _, y in GOLD]
    rows = [(i, f"http://h{i}.example/", x, None, None) for i, (x, _) in enumerate(GOLD)]  # each alone on its host
    assert {r.page_id: r.text for r in h.main_texts(spark.createDataFrame(rows, PAGES)).collect()} == {i: y for i, (_, y) in enumerate(GOLD)}


def _host(spark, sources, url="http://site.example/"):
    sources = list(sources)
    rows = [(i, f"{url}{i}", x, "clash", "clash") for i, x in enumerate(sources)]
    got = {r.page_id: r for r in h.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(r.n_chars == len(r.text) for r in got.values())
    return [got[i].text for i in range(len(sources))]


def _page(i, body=""):
    return (
        f"<body><div><div>Menu of the day {i * 3}</div><div>Shared line of the site</div></div><div><h1>Story {i}</h1>"
        + "".join(f"<p>Part {j} of story {i} tells of {i * 17 + j} things that came to pass long ago.</p>" for j in range(1 + i % 4))
        + f"{body}</div><div>Foot {i % 5}</div></body>"
    )


def _story(i):
    return "\n\n".join([f"Story {i}", *(f"Part {j} of story {i} tells of {i * 17 + j} things that came to pass long ago." for j in range(1 + i % 4))])


def test_template_decides_where_tags_and_classes_say_nothing(spark):
    """Three divs of one path: their places tell them apart, and the one that holds the varying text is the article."""
    assert _host(spark, map(_page, range(12))) == [_story(i) for i in range(12)]
    assert h.extract(_page(3)) != _story(3)
    assert _host(spark, [_page(3)] * 5) == [h.extract(_page(3))] * 5  # copies of one page have no template


def test_odd_pages_do_not_undo_the_template(spark):
    """Null, empty and other pages on the host, and one in another order of its parts."""
    odd = [None, "", "<p>other</p>", "<body><div><h1>Story 99</h1><p>Turned round, but a story all the same.</p></div><div>Foot</div></body>"]
    got = _host(spark, [*map(_page, range(20)), *odd])
    assert got[:20] == [_story(i) for i in range(20)] and got[20:23] == ["", "", "other"]


def test_repeated_text_in_the_slot_goes_unless_it_is_a_copy_of_an_article(spark):
    again = "<p>Read more on our site</p>"
    assert _host(spark, [_page(i, again) for i in range(12)]) == [_story(i) for i in range(12)]
    assert _host(spark, [_page(i, again) for i in range(3)]) == [f"{_story(i)}\n\nRead more on our site" for i in range(3)]  # too few to tell
    copies = [f"<body><div>Menu {i}</div><div><h1>Same</h1><p>The very same long article of many words, copied all over.</p></div></body>" for i in range(12)]
    assert set(_host(spark, copies)) == {"Same\n\nThe very same long article of many words, copied all over."}


def test_furniture_in_the_slot_is_known_by_the_template(spark):
    """A weak word tells it, on all pages or on one."""
    strip = [_page(i, f'<div class="notice">We keep your data {i}</div>' if i != 5 else '<div class="legal">Only here</div>') for i in range(12)]
    got = _host(spark, strip)
    assert got == [_story(i) for i in range(12)]


def test_vectors_and_classes_are_those_of_brute_force(spark):
    sources = [_page(i, "<ul>" + "<li><i>x</i></li>" * (i % 3) + "</ul>" if i % 2 else "") for i in range(6)]
    split = frozenset({h.tokens(p.names, p.ups, frozenset())[2] for p in [h.parse(sources[0])]})
    named = spark.createDataFrame([("a", x) for x in sources], "host string, html string")
    nodes = h.skeletons(named).withColumn("split", F.array(*map(F.lit, split)).cast("array<long>"))
    vector = defaultdict(lambda: [0] * len(sources))
    for i, source in enumerate(sources):
        page = h.parse(source)
        for t in h.tokens(page.names, page.ups, split):
            vector[t][i] += 1
    want = defaultdict(set)
    for t, v in vector.items():
        want[tuple(v)].add(t)
    got = defaultdict(set)
    for r in h.occurrences(nodes).collect():
        own = list(filter(None, vector[r.token]))
        assert (r.on, r.times) == (len(own), sum(own)) and tuple(r.usual) == max((own.count(x), x) for x in own)
        got[r.on, r.times, r.mark].add(r.token)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_out_of_order_is_all_but_a_longest_rising_run():
    for ranks in permutations(range(5)):
        longest = max((len(c) for m in range(32) for c in [[r for i, r in enumerate(ranks) if m >> i & 1]] if c == sorted(c)), default=0)
        off = h.out_of_order(list(ranks), 5)
        kept = [r for r in ranks if r not in off]
        assert kept == sorted(kept) and len(kept) == longest
    assert h.out_of_order([0, 1, 0, 1], 2) == set() and h.out_of_order([0, 1, 1, 0], 2) == {0, 1}


def test_both_ways_of_telling_hosts_agree(spark):
    pages = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(50)], "id long, host string")
    known = spark.createDataFrame([("a", 1)], "host string, x int")
    ways = [sorted(map(tuple, h._told(pages, known, "1", "id", most=m).select("id", "host", "x").collect())) for m in (0, 100)]
    assert ways[0] == ways[1] and len(ways[0]) == 50


def test_awkward_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "", None, None), (2, "", "", None, None), (3, "http://a/", "<p>é😀</p>", None, None)]
    rows += [(None, "http://a/", "plain text, no markup < 3", None, None), (4, "http://a/", "<div>" * 3000 + "deep", None, None), (5, "http://a/", "<p>unclosed <b>tags", None, None)]
    got = h.main_texts(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == 7
    by = {r.page_id: (r.text, r.n_chars) for r in got}
    assert by[1] == by[2] == ("", 0) and by[3] == ("é😀", 2) and by[5][0] == "unclosed tags" and by[4][0] == "deep"
    assert h.main_texts(spark.createDataFrame([], PAGES)).collect() == []


def test_pages_without_tags_or_classes_give_the_same_text(spark):
    """All pages with article, nav and footer turned to div, and class names gone: the template finds what the tags said."""
    pages = {r.page_id: r for r in table(spark, MEDIUM, "pages").collect()}
    bare = lambda x: re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", re.sub(r' class="[^"]*"', "", x or ""))
    rows = [(p.page_id, p.url, bare(p.html), None, None) for p in pages.values()]
    got = {r.page_id: r for r in h.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    on = defaultdict(list)
    for p in pages.values():
        on[re.sub(r"^.*?://([^/?#]*).*", r"\1", p.url).lower()].append(p.page_id)
    many = [i for ids in on.values() if len(ids) > 1 for i in ids]
    assert len(many) > 200 and all(got[i].text == h.extract(pages[i].html) for i in many)


def test_pages(spark):
    got = h.op4_html(spark, SMALL).collect()
    assert len(got) == table(spark, SMALL, "pages").count() and sum(r.n_chars > 0 for r in got) > 0.9 * len(got)
