import time

import pytest
from pyspark.sql import functions as F

from treelens.llm import htmltext, warc


def test_archive_round_trip_and_revisits(spark, tmp_path):
    long = "<p>é😀</p>\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(5, "http://a/1", long), (2, "http://a/2", long), (9, None, long), (7, "u\r\nX: y", "short"), (8, "u", "short"), (1, "u", None), (3, "u", ""), (None, "u", long), (5, "again", long), (4, "u", "<b>x</b>" * 30000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")
    records = warc.archive(pages, str(tmp_path / "w")).cache()
    assert records.count() == len(rows)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in records.collect())
    size = len(long.encode())
    assert got == [(0, "revisit", 2, size), (1, "response", None, 0), (2, "response", None, size), (3, "response", None, 0), (4, "response", None, 240000), (5, "revisit", 2, size), (5, "revisit", 2, size), (7, "response", None, 5), (8, "response", None, 5), (9, "revisit", 2, size)]
    back = sorted((r.page_id or 0, r.html) for r in warc.restore(records).collect())
    assert back == sorted((i or 0, h or "") for i, _, h in rows)
    assert warc.archive(pages.limit(0), str(tmp_path / "e")).count() == 0
    # revisits refer to record ids that exist, of the response's page
    ids = {r.record_id: r for r in records.collect()}
    assert all(ids[r.refers_to_id].page_id == r.refers_to for r in records.collect() if r.record_type == "revisit")


def test_repeated_rows_get_records_of_their_own(spark, tmp_path):
    body = "<p>the same</p>" * 20
    pages = spark.createDataFrame([(1, "u", body)] * 3 + [(2, "v", body)] * 2 + [(3, "w", "small")] * 2 + [(None, None, "alone " * 50)] * 2, "page_id long, url string, html string")
    records = warc.archive(pages, str(tmp_path / "w")).collect()
    assert len({r.record_id for r in records}) == len(records) == 9
    assert sorted((r.page_id or 0, r.record_type) for r in records) == [(0, "response")] * 2 + [(1, "response")] * 3 + [(2, "revisit")] * 2 + [(3, "response")] * 2


def test_a_damaged_payload_is_noticed():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Payload-Digest: sha256:00\r\nX-Payload-Length: 3\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (headers, block), = warc.parse(good)
    assert block == b"abc"
    for broken in (lambda: warc._record(headers, block), lambda: list(warc.parse(good[:-2])), lambda: list(warc.parse(b"x" + good))):
        with pytest.raises(ValueError):
            broken()


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>"</p>"</script></head><body><header>Site</header><nav><a href=x>Home</a></nav>
    <div class="cookie-notice">We use cookies</div><article><header><h1>Head &amp; line</h1></header><p>One  <b>bold</b>
    &lt;tag&gt; text<p>Two<br>three<aside>side</aside><div id=comments><p>nice post</p></div><form>name</form><ul><li><a href=y>link list</a></ul><p>End.</article><footer>&copy; x</footer>"""
    assert htmltext.main_text(page) == "Head & line One bold <tag> text Two three End."


def test_two_passes_without_an_article():
    good = "the cat is on the mat and it is not in the house with you " * 5
    page = f"<div><a href=1>Home</a> <a href=2>About</a></div><h2>Title of it</h2><p>{good}</p><p>Short one.</p><p>{good}</p><div>Ad <a href=3>buy now</a></div><p>x</p>"
    assert htmltext.main_text(page) == " ".join(["Title of it", good.strip(), "Short one.", good.strip()])


def test_an_article_is_evidence_and_no_switch():
    good = ("the cat is on the mat and it is not in the house with you " * 5).strip()
    bare = "lorem ipsum dolor consectetur adipiscing elit vestibulum tincidunt pellentesque habitant morbi"
    # main text outside a teaser's article
    assert good in htmltext.main_text(f"<article><p>A teaser.</p></article><div><p>{good}</p><p>Short one.</p><p>{good}</p></div>")
    # text without stop words: kept among an article's paragraphs, not at its end
    page = f"<nav>Home</nav><article><h1>Title</h1><p>{good}</p><p>{bare}</p><div class=ad>Buy</div><p>{good}</p><p>End.</p><p>{bare}</p></article>"
    assert htmltext.main_text(page) == " ".join(["Title", good, bare, good, "End."])
    # nothing else is known of an article in another language
    other = "漢字" * 60
    assert htmltext.main_text(f"<nav>Home</nav><article><p>{other}</p><p>{bare}</p></article>") == f"{other} {bare}"


def test_names_of_containers_do_not_discard_the_page():
    good = ("the cat is on the mat and it is not in the house with you " * 5).strip()
    body = f"<h2>Title of it</h2><p>{good}</p><p>Short one.</p><p>{good}</p>"
    whole = f"Title of it {good} Short one. {good}"
    for start, end in (("<body class='no-sidebar'>", ""), ("<div class='content-with-sidebar'>", "</div>"), ("<article class='post comments-open'>", "</article>"),
                       ("<article class='comments'>", "</article>"), ("<main id='content-share'>", "</main>"), ("<form action=x>", "</form>"), ("<div class=widget>", "</div>")):
        assert htmltext.main_text(start + body + end) == whole, start
    assert htmltext.main_text("<form><article><p>Short one.</p></article></form>") == "Short one."
    assert htmltext.main_text(f"<p>{good}</p><figure><img src=x><figcaption>The cat.</figcaption></figure><p>{good}</p>") == f"{good} The cat. {good}"
    # what is named whole stays out, and so do small forms, among good text too
    for extra in ("<div class=sidebar><p>Short.</p></div>", "<div id='x cookie-notice'>We use cookies</div>", "<form>Your mail</form>", f"<div hidden><p>{good}</p></div>", "<span class=ad>Buy</span>"):
        assert htmltext.main_text(f"<article><p>{good}</p>{extra}<p>{good}</p></article>") == f"{good} {good}", extra


def test_broken_and_odd_pages(spark):
    pages = ["", None, "plain & simple", "<", "<a href='", "<p", "<!-- never closed", "<script>x", "a < b and c", "<article>" * 3000 + "deep", "</p></div>", "<article><p>\x00\ufeff é</article>"]
    df = spark.createDataFrame([(i, None, p, "t") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in htmltext.extract(df).collect()}
    assert len(got) == len(pages) and got[0].text == "" and got[1].text == "" and got[9].text == "deep"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert htmltext.extract(df.limit(0)).count() == 0


def test_what_an_article_must_not_lose():
    good = ("the cat is on the mat and it is not in the house with you " * 5).strip()
    for part, text in (('<p title="the hidden truth">Short one.</p>', "Short one."), ('<p data-id="ad" data-class=\'menu\'>Short one.</p>', "Short one."), ("<p><a href=x>A link of its own</a></p>", "A link of its own"),
                       ("<figure><img src=x alt='class=ad'><figcaption>The cat.</figcaption></figure>", "The cat."), ("<p>It is <math><mi>x</mi>=<mn>2</mn></math>.</p>", "It is x=2.")):
        assert htmltext.main_text(f"<nav>Home</nav><article><p>{good}</p>{part}<p>{good}</p></article>") == f"{good} {text} {good}", part
    # but not lists of links, and what is named or hidden
    for part in ("<ul><li><a href=x>One</a><li><a href=y>Two</a></ul>", "<p class='ad'>Buy</p>", "<p hidden>x</p>", "<p aria-hidden = 'true'>x</p>", "<p ID=sidebar>x</p>"):
        assert htmltext.main_text(f"<article><p>{good}</p>{part}<p>{good}</p></article>") == f"{good} {good}", part


def test_broken_html_in_linear_time():
    began = time.monotonic()
    assert htmltext.main_text("<div>" * 30_000 + "<article><p>deep" + "</b></i></td>" * 30_000) == "deep"
    assert htmltext.main_text("<article><p>text" + "<svg>" * 30_000) == "text"
    assert htmltext.main_text("<article>" + "<p>word " * 60_000).count("word") == 60_000
    assert time.monotonic() - began < 20


def test_repeated_and_very_long_pages(spark):
    page = "<nav>Home</nav><article>" + "<p>the cat is on the mat and it is not in the house with you</p>" * 20_000 + "</article><footer>x</footer>"
    df = spark.createDataFrame([(1, "u", page)] * 2 + [(None, None, page)], "page_id long, url string, html string")
    got = htmltext.extract(df).collect()
    assert len(got) == 3 and {r.n_chars for r in got} == {20_000 * 58 - 1} and {r.page_id for r in got} == {1, None}


_READER = "I really do not think that this is what the author had in mind when they wrote it, but it was a good read for all of us and I will be back for more of it. " * 3
_STORY = "<p>" + "</p><p>".join(f"The story of the river number {i} is that it was there before the town, and that the people of the town have lived with it and by it for as long as anyone can say." * 2 for i in range(3)) + "</p>"


@pytest.mark.parametrize("open_, close", [("<section id=comments>", "</section>"), ("<div class='comments'>", "</div>"), ("<ol class=comment-list>", "</ol>"), ("<div id='disqus_thread'>", "</div>"), ("<div class='post-comments'>", "</div>"), ("<div class='comment-12 reply'>", "</div>")])
def test_dense_comments_never_count(open_, close):
    """However long and full of stop words, after an article, inside one, or on a page without one."""
    comments = f"{open_}<p>{_READER}</p><p>{_READER}</p>{close}"
    want = htmltext.main_text(f"<body><article>{_STORY}</article></body>")
    assert "river number 2" in want
    for page in (f"<body><article>{_STORY}</article>{comments}</body>", f"<body><article>{_STORY}{comments}</article></body>", f"<body><div class=content>{_STORY}</div>{comments}</body>", f"<body><main>{comments}{_STORY}</main></body>"):
        assert htmltext.main_text(page) == want
    # names that only mention comments say nothing
    assert htmltext.main_text(f"<body><div class='comments-open'>{_STORY}</div></body>") == want


_OTHER = {
    "pl": "Rzeka płynie przez miasto od wielu stuleci, a jej brzegi zmieniały się wraz z każdym pokoleniem mieszkańców. Dawniej stały tutaj młyny i małe warsztaty. Dziś spacerują tędy rodziny, które chcą odpocząć po pracy.",
    "ru": "Река течёт через город уже много столетий, и её берега менялись вместе с каждым поколением жителей. Раньше здесь стояли мельницы и небольшие мастерские. Сегодня здесь гуляют семьи, которые хотят отдохнуть после работы.",
    "zh": "这条河流经城市已有许多世纪，河岸随着每一代居民而改变。从前这里有磨坊和小作坊，人们靠水力工作。今天，许多家庭在下班之后来到这里散步休息，孩子们在树下玩耍，老人们坐在长椅上聊天，夏天的夜晚还有音乐会。",
    "tr": "Nehir yüzyıllardır şehrin ortasından akıyor ve kıyıları her kuşakla birlikte değişti. Eskiden burada değirmenler ve küçük atölyeler vardı. Bugün işten sonra dinlenmek isteyen aileler burada yürüyüş yapıyor.",
}


@pytest.mark.parametrize("language", _OTHER)
def test_other_languages_without_an_article(language):
    """Four paragraphs in a plain container: all of them, and nothing of the boilerplate around them."""
    paragraphs = [f"{_OTHER[language]} {i}." for i in range(4)]
    links = "".join(f"<li><a href=/{i}>{_OTHER[language][:12]}</a></li>" for i in range(9))
    page = f"<body><nav>{links}</nav><ul>{links}</ul><div class=content>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><div class=sidebar>{_OTHER[language][:60]}</div><footer>© 2020</footer></body>"
    assert htmltext.main_text(page) == " ".join(paragraphs)
    assert htmltext.main_text(f"<body><article>{''.join(f'<p>{p}</p>' for p in paragraphs)}</article></body>") == " ".join(paragraphs)


def test_a_tag_with_an_open_quote_and_what_follows():
    """The tag ends at the next >, and elements after it are still closed."""
    page = f"<body><div><p title=\"never closed>{'This is the text of the page that was there for all of us to read and it is long. ' * 4}</p></div><p>And the end of it is here for you.</p></body>"
    assert "text of the page" in htmltext.main_text(page)


def test_filters_grow_with_what_is_in_them(spark):
    """One in sixteen other keys passes by chance, at any size up to the bound of the broadcast."""
    assert [warc.filter_bits(n) for n in (0, 1, 5000, 10**6, 10**12)] == [1 << 16, 1 << 16, 1 << 17, 1 << 24, 1 << 28]
    for n in (3, 30_000):
        known = warc.bloom(spark.range(n).selectExpr("xxhash64(id) AS hashed"))
        rows = spark.range(2 * n)
        inside = warc._filtered(rows, known, F.xxhash64("id"), "left_semi")
        passed = {r.id for r in inside.collect()}
        assert set(range(n)) <= passed and len(passed) - n <= max(1, n // 8)
