import random
import time
from html.parser import HTMLParser

import pytest

from lapidary.llm.wrappers import Item, align, common_places, extract, infer_wrappers, main_text, page_items, page_stream, text_key

ARTICLE = (
    '<html><head><title>T</title><style>p{}</style></head><body class="nav-open"><nav><ul><li><a href=/a>A</a></li></ul></nav><header><h2>Site</h2></header>'
    '<article class="post"><header><h1>Head &amp; line</h1><p>By x</p></header><p>One  <b>bold</b>\n<i>text</i> &lt;b&gt; caf&eacute;<br>next<p>Two<script>var t="</p>";</script>'
    '<div class="ad-box">Buy</div><div class="notice">N</div><form><p>f</p></form><aside>s</aside><ul><li>i1<li>i2</ul><span class="share">S</span></p><section id="comments"><p>c</p></section></article>'
    '<article class="comment"><p>reader</p></article><div class="sidebar">side</div><footer>&copy; f</footer>'
)


def test_article_without_the_rest():
    texts, kinds, _ = page_stream(ARTICLE)
    assert [t for t, (k, _) in zip(texts, kinds) if k == "a"] == ["Head & line", "One bold text <b> café next", "Two", "i1", "i2"]


@pytest.mark.parametrize("page, want", [("", ""), ("plain < text & more", "plain < text & more"), ("<p>a<p>b</div></p>", "a\n\nb"), ("<main><p>m</p></main><p>out</p>", "m"), ("<!-- x --><p>a &am &amp</p", "a &am &"), ("<p>x</p><script>never closed <p>y", "x")])
def test_odd_pages(page, want):
    assert main_text(page, page_items(*page_stream(page)[1:])) == want


def test_alignment_makes_slots_groups_and_options():
    pages = ["<div><p>same</p><p>same</p></div><h1>t1</h1>", "<div><p>same</p></div><h1>t2</h1><hr><h3>extra</h3>"]
    one, two = (page_items(*page_stream(p)[1:]) for p in pages)
    joined = align(one, two)
    title = next(x for i, x in enumerate(joined) if x.kind == "x" and joined[i - 1].key == "h1")
    assert title.pages == 2 and any(x.optional for x in joined)
    again = [Item.of(x.plain()) for x in joined]
    assert [x.plain() for x in again] == [x.plain() for x in joined]


def test_template_text_goes_where_no_article_is(spark):
    rows = [(i, "http://h.example/x", f"<div><h5>All rights here</h5></div><div><p>Body {i} {'w' * i}</p></div>") for i in range(6)]
    rows += [(100, None, None), (101, None, ARTICLE), (101, None, ARTICLE), (102, "http://h.example", "")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = sorted(extract(frame).collect(), key=lambda r: r.page_id)
    assert len(got) == len(rows) and [r.text for r in got[:6]] == [f"Body {i} {'w' * i}".strip() for i in range(6)]
    assert got[6].text == "" and got[6].n_chars == 0 and got[7].text == got[8].text and got[9].text == ""
    assert extract(frame.limit(0)).collect() == []


def texts_of(spark, pages):
    frame = spark.createDataFrame([(i, f"http://{host}/{i}", page) for i, (host, page) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(extract(frame).collect(), key=lambda r: r.page_id)]


def test_copies_of_one_page_keep_their_body(spark):
    page = "<div><h1>Title</h1></div><div><p>One paragraph.</p></div><div><h3>Another one.</h3></div>"
    own = "<div><h5>All rights here</h5></div><div><p>Body {}</p></div>"
    got = texts_of(spark, [("copies.example", page)] * 4 + [("both.example", own.format(i // 2)) for i in range(8)] + [("few.example", own.format(i // 3)) for i in range(6)])
    assert got[:4] == ["Title\n\nOne paragraph.\n\nAnother one."] * 4
    assert got[4:12] == [f"Body {i // 2}" for i in range(8)] and got[12] == "All rights here\n\nBody 0"


def test_template_text_inside_the_article_goes_too(spark):
    page = "<article><h1>Head {0}</h1><p>Body {0} of some length that differs</p><p>Get our letter every week, it costs nothing at all!</p></article>"
    version = "<main><h1>One head</h1><p>The long paragraph that all versions share with each other.</p><p>And a second one that they share.</p><p>Version {0}</p></main>"
    quoted = "<article><p>Paragraph {0} of this page, long enough.</p><p>{1}</p></article>"
    got = texts_of(spark, [("a.example", page.format(i)) for i in range(5)] + [("b.example", version.format(i)) for i in range(5)] + [("c.example", quoted.format(i, "Quoted." if i < 3 else f"Own {i}.")) for i in range(9)])
    assert got[:5] == [f"Head {i}\n\nBody {i} of some length that differs" for i in range(5)]
    assert got[5:10] == [f"One head\n\nThe long paragraph that all versions share with each other.\n\nAnd a second one that they share.\n\nVersion {i}" for i in range(5)]
    assert all("Quoted." in t for t in got[10:13])


class PlainReader(HTMLParser):
    """The article's blocks of well-formed pages of the test tables, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.parts, self.blocks = 0, 0, [], []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.flush()
            self.inside += 1
        elif tag == "br":
            self.parts.append(" ")
        elif tag in ("script", "style"):
            self.skip += 1
        elif tag not in ("a", "b"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip -= 1
        elif tag not in ("a", "b"):
            self.flush()
        if tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.parts.append(data)


def test_pages_of_the_tables_against_a_plain_reader(spark):
    from lapidary.llm.q_op2_wrappers import query

    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        reader = PlainReader()
        reader.feed(r.html or "")
        reader.close()
        reader.flush()
        want[r.page_id] = "\n\n".join(reader.blocks)
    got = query(spark, "/root/testdata/sf0.01").collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_the_wrapper_decides():
    pages = [f"<article><h1>T{i}</h1><p>Own text {i} of this page.</p><h4>Read all our guides now.</h4><p>{'Quoted.' if i < 3 else f'Other {i}.'}</p></article>" for i in range(8)]
    streams = [page_stream(p) for p in pages]
    wrapper = [Item.of(x.plain()) for x in page_items(*streams[0][1:])]
    for s in streams[1:]:
        wrapper = align(wrapper, page_items(*s[1:]))
    often = {text_key("a", "Read all our guides now."): 8, text_key("a", "Quoted."): 3}
    assert main_text(pages[0], wrapper, often) == "T0\n\nOwn text 0 of this page.\n\nQuoted."
    # by itself the page doesn't tell which of the two is template
    assert main_text(pages[0], page_items(*streams[0][1:]), often) == "T0\n\nOwn text 0 of this page."


@pytest.mark.parametrize("inside, want", [
    ("<p class='share-price'>Up.</p><p class='related-work'>Older.</p>", "Up.\n\nOlder."),
    ("<p class='share-box'>S</p><p class='post-comments'>c</p><p>in</p>", "in"),
    ("<p>a</p><select><option>x<p>b</p>", "a\n\nx\n\nb"),
    ("<svg><svg><text>no</text></svg>no</svg><p>b</p>", "b"),
    ("<video><p>no player</p></video><p>b</p><iframe src=x>", "b"),
    ("<p><a href=x>All of this paragraph is a link.</a></p>", "All of this paragraph is a link."),
])
def test_names_and_unclosed_elements(inside, want):
    for page in (f"<article>{inside}</article>", f"<div>{inside}</div>"):
        assert main_text(page, page_items(*page_stream(page)[1:])) == want


def test_menus_outside_articles():
    page = "<div><ul><li><a>Home</a><li><a>All news</a></ul></div><div><p>Body text with a <a>link</a>.</p></div>"
    assert main_text(page, page_items(*page_stream(page)[1:])) == "Body text with a link."


def test_order_and_partitions_do_not_matter(spark):
    rng = random.Random(5)
    part = lambda i: rng.choice(["<h2>h{0}</h2>", "<p>p{0}</p>", "<ul><li>a{0}<li>b</ul>", "<table><tr><td>c{0}</table>", "<h5>Same in many pages.</h5>"]).format(i)
    rows = [(i, f"http://h{i % 3}.example/", "<div>" + "".join(part(i) for _ in range(rng.randrange(1, 30))) + "</div>") for i in range(200)]
    seen = []
    for n, order in ((1, rows), (5, rows[::-1]), (3, sorted(rows, key=lambda r: r[2]))):
        frame = spark.createDataFrame(order, "page_id long, url string, html string").repartition(n)
        wrappers = sorted((r.host, r.wrapper, sorted((r.often or {}).items())) for r in infer_wrappers(frame, together=8).collect())
        seen.append((wrappers, sorted(tuple(r) for r in extract(frame, small=0 if n == 5 else 1 << 20).collect())))
    assert seen[0] == seen[1] == seen[2] and len(seen[0][0]) == 3 and len(seen[0][1]) == 200


def test_long_pages_take_linear_time(spark):
    rng = random.Random(6)
    body = lambda n: "".join(rng.choice(["<h2>t{0}</h2>", "<p>a{0}</p>", "<blockquote>b{0}</blockquote>", "<ul><li>1{0}<li>2</ul>"]).format(i) for i in range(n))
    rows = [(i, "http://h.example/", f"<div><h5>All rights here</h5></div><div>{body(n)}</div>") for i, n in enumerate((20_000, 25_000, 30_000, 5))]
    began = time.time()
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert time.time() - began < 90 and all(not r.text.startswith("All rights") for r in got.values()) and got[2].n_chars > 100_000


def test_length_does_not_change_what_is_template(spark):
    def page(i, blocks, note):
        rng = random.Random(7)
        body = "".join(rng.choice(["<h2>h{0}</h2>", "<p>p{0}</p>", "<ul><li>a{0}<li>b{0}</ul>", "<blockquote>q{0}</blockquote>"]).format(f"{i}.{k}") for k in range(blocks))
        return f"<div><h1>Title {i}</h1>{body}{'<h5>Read our guide.</h5>' if note else ''}<h3>End {i}</h3></div>"

    # five of twelve pages have the note: all that have its slot, but less than half of the host
    rows = [("short.example", page(i, 3, i < 5)) for i in range(12)]
    rows += [("long.example", page(i, 400, i < 5)) for i in range(12)]
    rows += [("mixed.example", page(i, 400 if i == 11 else 3, i < 5)) for i in range(12)]
    got = texts_of(spark, rows)
    assert not any("Read our guide." in t for t in got)
    assert got[:11] == got[24:35] and got[23] == got[35] and all(t.startswith(f"Title {i % 12}\n\n") and t.endswith(f"End {i % 12}") for i, t in enumerate(got))


def test_common_places_are_a_longest_subsequence():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([str(rng.randrange(rng.choice([2, 6]))) for _ in range(rng.randrange(40))] for _ in range(2))
        before = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(row[j], before[j + 1]))
            before = row
        pairs = common_places(a, b)
        assert len(pairs) == before[-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_missing_end_tags_make_no_other_slots():
    whole = "<article><h1>t</h1><p>a</p><p>b</p><ul><li>x</li><li>y</li></ul></article>"
    for page in ("<article><h1>t</h1><p>a<p>b<ul><li>x<li>y</ul></article>", "<article><h1>t</h1><p>a<p>b</p><ul><li>x<li>y</li></ul></p>"):
        assert [x.plain() for x in page_items(*page_stream(page)[1:])] == [x.plain() for x in page_items(*page_stream(whole)[1:])]


def test_paragraphs_that_articles_share_stay(spark):
    from lapidary.llm.q_op2_wrappers import query

    got = {r.page_id: r.text for r in query(spark, "/root/testdata/sf0.1").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect():
        reader = PlainReader()
        reader.feed(r.html or "")
        reader.close()
        reader.flush()
        assert got.pop(r.page_id) == "\n\n".join(reader.blocks)
    assert not got


def test_texts_after_different_tags_are_different_slots():
    one, two = (page_items(*page_stream(p)[1:]) for p in ("<div><h2>a</h2></div><div><h3>b</h3></div>", "<div><h3>b</h3></div><div><h2>a</h2></div>"))
    assert max(x.pages for x in align(one, two) if x.kind == "x") == 2
    assert {x.key for x in align(one, two) if x.kind == "x"} == {"#eh2", "#eh3"}
