"""Archives and main text."""

import base64
import hashlib
import io
import random
import statistics
import time
import zipfile
from html.parser import HTMLParser

from ledgerline.llm.html_paths import Page, content_paths, extract_text, main_text
from ledgerline.llm.shared import fresh_path
from ledgerline.llm.warc_zip import ZipDirectory, read_archives, write_archives

from ..oracle import check

PAGES = "page_id long, url string, html string, record_type string"


def test_archives_give_back_every_page(spark):
    rows = [(1, "http://a/x", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u\nrl", ""), (4, "u", None), (5, "u", "x" * 300_000), (None, "u", "<p>é</p>"), (6, "u", "a\r\n\r\nb"), (2, None, "<p>é</p>")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], PAGES)
    got = read_archives(spark, write_archives(pages, fresh_path(spark, "w"), most_bytes=2000)).collect()
    assert len(got) == len(rows)
    equal = {}
    for i, _, h in rows:
        if i is not None:
            equal[h or ""] = max(i, equal.get(h or "", i))
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(html.encode())
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        last = r.page_id if r.page_id is None else equal[html]
        assert (r.record_type, r.refers_to) == (("response", None) if last == r.page_id else ("revisit", last))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html.encode()
    small = read_archives(spark, write_archives(pages, fresh_path(spark, "w"), least_bytes=9)).collect()
    assert all(r.record_type == "response" for r in small if r.payload_bytes < 9)
    assert read_archives(spark, write_archives(pages.limit(0), fresh_path(spark, "w"))).count() == 0


def test_directories_with_and_without_zip64():
    for zip64 in (False, True):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            with z.open("a/b.txt", "w", force_zip64=zip64) as f:
                f.write(b"hello")
            z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
            z.comment = b"note"
        data = raw.getvalue()
        members = ZipDirectory(lambda at, n: data[at : at + n], len(data)).members
        assert {k: data[a : a + n] for k, (a, n) in members.items()} == {"a/b.txt": b"hello"}


def test_zip64_end_records():
    raw = io.BytesIO()
    limit, zipfile.ZIP_FILECOUNT_LIMIT = zipfile.ZIP_FILECOUNT_LIMIT, 2
    try:
        with zipfile.ZipFile(raw, "w") as z:
            for i in range(5):
                z.writestr(f"f{i}", f"body {i}")
    finally:
        zipfile.ZIP_FILECOUNT_LIMIT = limit
    data = raw.getvalue()
    assert b"PK\6\6" in data
    members = ZipDirectory(lambda at, n: data[at : at + n], len(data)).members
    assert {data[a : a + n] for a, n in members.values()} == {f"body {i}".encode() for i in range(5)}


def test_archive_sql(spark):
    from ledgerline.llm.queries import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    check(QUERIES["op4_warc"](spark, folder), ORACLES["op4_warc"], folder)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><p>Site name, motto.</p></header><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, as everyone does, to improve.</p></div><main><article class="post"><h1>A &amp; B</h1><p>First <b>bold</b> part,
 with   text that goes on, and on.<p>Short.</p><script>var a="<p>no</p>"</script><p>Third one, caf&eacute;, has commas, too.</article>
<section id="comments"><p>Nice post, really, thanks a lot, I loved it.</p></section></main><aside class="sidebar"><p>Read also, please, this.</p></aside><form><p>Sign, up.</p></form><footer><p>(c) 2024, all rights.</p></footer></body></html>"""


def test_article_without_furniture():
    assert main_text(PAGE) == "A & B\nFirst bold part, with text that goes on, and on.\nShort.\nThird one, café, has commas, too."


def test_pages_without_marks_or_text():
    assert main_text("plain text only") == "plain text only"
    assert [main_text(x) for x in ("", "<nav><a>x</a></nav>", "<p>", "<!-- a")] == [""] * 4
    body = "".join(f"<p>Sentence number {i}, with words, and more.</p>" for i in range(9))
    assert main_text(f"<div><ul><li>one</li><li>two</li></ul></div><div>{body}</div><div><span>x</span></div>").count("\n") == 8


def test_articles_of_several_parts_stay_whole():
    say = lambda what, n: "".join(f"<p>Sentence {i} of the {what}, with words, and more words.</p>" for i in range(n))
    nav = "<nav><a href=/>Home</a></nav>"
    for tag in ("section", "div"):
        body = f"<h1>Headline</h1>{say('start', 2)}<{tag}>{say('long part', 30)}</{tag}><{tag}><h2>Then</h2>{say('end', 3)}</{tag}>"
        for page in (f"<body>{nav}<article>{body}</article><footer>(c) all, rights.</footer></body>", f"<body>{nav}<div>{body}</div><div><a href=/x>x</a></div></body>"):
            assert main_text(page).split("\n")[0] == "Headline" and main_text(page).count("\n") == 36
    rows = range(40)
    for long in ("<ul>" + "".join(f"<li>Point {i}, which is long, and has marks.</li>" for i in rows) + "</ul>", "<table>" + "".join(f"<tr><td>Cell {i}, which is long, and has marks.</td></tr>" for i in rows) + "</table>"):
        assert main_text(f"<body>{nav}<article><h1>Headline</h1>{say('start', 2)}{long}{say('end', 2)}</article></body>").count("\n") == 44
    assert main_text(f"<body>{nav}<div><h1>Headline</h1><div>{say('only part', 9)}</div></div></body>").startswith("Headline\n")


def _say(what, n):
    return [f"Sentence {i} of the {what}, with words, commas, and more words." for i in range(n)]


def _p(lines):
    return "".join(f"<p>{x}</p>" for x in lines)


def test_opaque_class_names():
    """No name says what a branch is: menus, an advert, comments, a sidebar and a footer go by paths and shape."""
    menu = '<div class="q1"><ul>' + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(9)) + "</ul></div>"
    advert, foot = '<div class="q2"><p>Buy now and save</p></div>', '<div class="q9"><span>All rights reserved</span></div>'
    comments = '<div class="q5">' + "".join(f'<div class="q6"><div class="q7">User {i}</div><p>I liked this, really, thanks.</p></div>' for i in range(3)) + "</div>"
    side = '<div class="q8">' + "".join(f"<a href='/s{i}'>More {i}</a>" for i in range(6)) + "</div>"
    story = ["Headline", *_say("story", 9), "Short one"]
    inner = f"<h1>{story[0]}</h1>{_p(story[1:])}"
    for page in (
        f'<body>{menu}<div class="q3">{inner}</div>{advert}{side}{foot}</body>',
        f'<body>{menu}<div class="q3">{inner}{comments}</div>{side}{foot}</body>',
        f'<body>{menu}<div class="q0"><div class="q3">{inner}</div>{comments}{advert}</div>{foot}</body>',
        f'<body>{menu}<main><div class="q3">{inner}</div>{comments}</main>{foot}</body>',
    ):
        assert main_text(page) == "\n".join(story)


def test_opaque_boxes_between_paragraphs():
    """Adverts and notices in boxes of their own inside the article go by their own ratios; parts with the article's prose stay."""
    story = ["Headline", *_say("story", 8)]
    advert, notice = '<div class="z1"><p>Buy now! Save big!</p></div>', '<div class="z2"><span>Site news, all day.</span></div>'
    quote = '<div class="z3"><p>Sentence of a part, in a box, with words, commas, and more words.</p></div>'
    for box, stays in ((advert, False), (notice, False), (quote, True)):
        want = [*story[:5], *(["Sentence of a part, in a box, with words, commas, and more words."] if stays else []), *story[5:]]
        inner = f"<h1>Headline</h1>{_p(story[1:5])}{box}{_p(story[5:])}"
        for page in (f"<body><article>{inner}</article></body>", f'<body><div class="z0">{inner}</div><div class="z9"><span>(c) all</span></div></body>'):
            assert main_text(page).split("\n") == want


class _Plain(HTMLParser):
    """The blocks of a page's article element, by the standard library's parser and no ratios."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in ("b", "i", "a", "em", "span"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag not in ("b", "i", "a", "em", "span"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_query_finds_the_articles_of_the_whole_table_by_its_ratios(spark, monkeypatch):
    from ledgerline.llm import html_paths
    from ledgerline.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(folder + "/pages.parquet").select("page_id", "html").collect()}
    got = {r.page_id: r.text for r in QUERIES["op5_html_text"](spark, folder).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        plain = _Plain()
        plain.feed(page)
        plain.close()
        assert got[i] == "\n".join(line for line in (" ".join(b.split()) for b in plain.blocks) if line)
    monkeypatch.setattr(html_paths, "content_paths", lambda page, **_: {page.path[e]: 1.0 for t, e in zip(page.text, page.element) if t.strip() and not page.bad[e]})
    assert sum(main_text(p) != got[i] for i, p in pages.items()) > 0.1 * len(pages)


def test_names_of_furniture_and_of_content():
    body = _p(_say("story", 5))
    assert main_text(f'<main><h1>H</h1>{body}<div class="related-work">{_p(_say("others", 2))}</div><div class="related-links">{_p(_say("links", 2))}</div></main>').split("\n") == ["H", *_say("story", 5), *_say("others", 2)]
    assert main_text('<div class="comments"><p>Only this, here.</p></div>') == "Only this, here."


def ratios(page):
    """The paths' weights written plainly: paths as tuples of steps, common beginnings counted step by step."""
    steps = lambda p: () if p == 0 else (*steps(page.path_parent[p]), p)
    nodes = [(steps(page.path[e]), t) for t, e in zip(page.text, page.element) if t.strip() and not page.bad[e]]
    own = {p: [t for q, t in nodes if q == p] for p, _ in nodes}
    mean = {p: (sum(map(len, ts)) / len(ts), (1 + sum(sum(c in ".,;:!?" for c in t) for t in ts)) / len(ts)) for p, ts in own.items()}
    best = {}
    for i, (p, _) in enumerate(nodes):
        near = range(max(0, i - 2), min(len(nodes), i + 3))
        same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) / max(len(a), len(b), 1) if a != b else 1.0
        w = [same(p, nodes[j][0]) / (1 + abs(i - j)) for j in near]
        fused = [sum(x * mean[nodes[j][0]][k] for x, j in zip(w, near)) / sum(w) for k in (0, 1)]
        best[p] = max(best.get(p, 0), fused[0] * fused[1])
    bar = min(statistics.pstdev(best.values()) / 2, max(best.values())) if best else 0
    return {p[-1] if p else 0: v for p, v in best.items() if v >= bar}


def test_ratios_equal_a_plain_version():
    rng = random.Random(8)
    for _ in range(40):
        page = []
        for _ in range(rng.randrange(3, 40)):
            page.append(rng.choice(["<div>", "<p>", "</p>", "</div>", "<b>", "</b>", "<ul><li>", "</ul>", "<div class=a>", "<nav>", "</nav>", "word, word.", "more text; and more", " ", "x"]))
        read = Page("".join(page))
        want, got = ratios(read), content_paths(read)
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-6 * want[p] for p in want)


def test_time_grows_with_the_page_and_not_with_its_depth():
    for page in ("<div>" * 100_000 + "<p>Hello there, this is text.</p>", "<a " * 50_000 + "<p>Hello there, this is text.</p>", "<span><p>x y, z." * 20_000, "<b>" * 50_000 + "<p>a, b.</p>" * 5_000):
        began = time.process_time()
        assert main_text(page)
        assert time.process_time() - began < 5


def test_extraction_of_odd_rows(spark):
    rows = [(1, "u", PAGE, "z"), (2, None, None, "z"), (None, "u", "", "z"), (1, "u", PAGE, "z"), (3, "u", "<p>" + "long, text. " * 50_000, "z")]
    got = extract_text(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert {r.n_chars for r in got if r.page_id is None or r.page_id == 2} == {0}
    assert extract_text(spark.createDataFrame([], PAGES)).count() == 0
