import time

import pytest

from tidepanel.llm.html_text import extract_text, main_text, text_nodes

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1><p>A tag line, for the site. Welcome!</p></header><div class="cookie-notice">We use cookies, of course. Fine?</div>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><div id="wrap"><div class="content"><h2>Head&amp;line</h2><p>One <b>bold</b> text,
 more &eacute;&#33; Really.<p>Short.<div class="ad">Buy now, cheap. Very cheap, indeed.</div><blockquote>Quoted text, here.</blockquote>
<form><label>Name</label><input><p>Sign up, please. It is free, for now.</p></form><ul><li>item one<li>item two</ul></div>
<aside><p>Other, stuff. Not here, though.</p></aside><div id="comments"><p>I think, that this. is a comment! very long, long, long.</p></div></div>
<footer>&copy; Site, all rights. Reserved, too.</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE) == "Head&line\n\nOne bold text, more é! Really.\n\nShort.\n\nQuoted text, here.\n\nitem one\n\nitem two"


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("<p>", ""), ("plain &lt; text", "plain < text"), ("<p>One<p>Two", "One\n\nTwo"), ("<article><p>cut off &am", "cut off &am"),
    ("<article><p>a<br>b</p><p", "a b"), ("<!-- <p>no</p> --><p>yes", "yes"), ("<p>a &nbsp; b</p>", "a b"), ("<script>x", ""), ("<p title='a>b'>c</p>", "c"), ("a < b", "a < b"),
])
def test_small_pages(html, text):
    assert main_text(html) == text


def test_unclosed_paragraphs_and_inline_tags_share_a_path():
    paths = {n.path for n in text_nodes("<article><p><b>a<br><p>b</p><p><i>c") if n.text.strip()}
    assert paths == {("article", "p")}


def test_very_long_pages_are_read_whole():
    page = "<article>" + "".join(f"<p>Part {i}, of many. Yes.</p>" for i in range(20_000)) + "</article>"
    assert main_text(page).count("\n\n") == 19_999


ARTICLE = "<h2>Headline</h2><p>One text, of the article. It goes on, and on, for a while.</p><p>Another part, with more to say. And the end.</p>"
BOXES = """<div class="sidebar"><p>Other, stuff. Not here, though.</p></div><div id="comments"><p>I think, that this. is a comment!</p></div>"""


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "layout-menu-left", "comments-open", "elementor-widget", "widget", "sidebar-page", "hasSidebar"])
@pytest.mark.parametrize("tag", ["div", "article"])
def test_a_wrapper_named_after_other_matter_is_not_dropped(name, tag):
    want = "Headline\n\nOne text, of the article. It goes on, and on, for a while.\n\nAnother part, with more to say. And the end."
    inner = f"<{tag}>{ARTICLE}</{tag}>"
    assert main_text(f'<body><div class="ad">Buy now, cheap.</div><div class="{name}">{inner}{BOXES}</div></body>') == want
    assert main_text(f'<body><{tag}><div class="{name}">{ARTICLE}</div></{tag}>{BOXES}</body>') == want


def test_an_article_in_several_marked_parts():
    part = '<div class="elementor-widget elementor-widget-{}"><div class="elementor-widget-container">{}</div></div>'
    page = part.format("text", "<p>One, two. Three, four.</p>") + part.format("text", "<p>Five, six. Seven.</p>")
    assert main_text(f"<body><div>{page}</div>{BOXES}</body>") == "One, two. Three, four.\n\nFive, six. Seven."

    numbered = "".join(f'<div id="widget-{i}"><p>Part {i}, of many. Yes.</p></div>' for i in range(2_000))
    assert main_text(numbered).count("\n\n") == 1_999


def test_comments_longer_than_the_article_and_boxes_beside_a_short_one():
    comments = '<div class="comments">' + "<p>I think, that this. is a comment!</p>" * 10 + "</div>"
    assert main_text(f"<div><div>{ARTICLE}</div>{comments}</div>").endswith("And the end.")
    assert main_text('<div class="ad">Buy now, cheap. Very cheap, indeed.</div><article><p>Short.</p></article>') == "Short."


LEAD, LONG = "A lead, of one sentence.", "<p>" + "Long text, of many parts. " * 20 + "</p>"


@pytest.mark.parametrize("parts", [3, 30])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", '<div id="page"><div class="post">{}</div></div>'])
def test_headline_lead_and_end_beside_a_long_body_are_kept(around, parts):
    page = f'<h1>Title</h1><div class="lead"><p>{LEAD}</p></div><div class="body">{"<h2>Part</h2>" + LONG * parts}</div><div class="end"><p>The end.</p></div>'
    got = main_text("<body>" + around.format(page) + "</body>").split("\n\n")
    assert got[:3] == ["Title", LEAD, "Part"] and got[-1] == "The end." and len(got) == parts + 4


def test_content_is_kept_wherever_it_lies():
    first = '<div class="a"><p>' + "One part, of some length. " * 20 + "</p></div>"
    got = main_text(f'<body><div class="box">{first}</div><div class="all"><div class="b">{LONG * 20}</div></div><div class="end"><i>ok</i></div></body>')
    assert got.startswith("One part") and got.count("\n\n") == 20


def test_a_headline_in_a_part_of_its_own():
    part = '<div class="elementor-widget elementor-widget-{}"><div class="elementor-widget-container">{}</div></div>'
    page = part.format("heading", "<h1>Head</h1>") + part.format("text", "<p>One, two. Three, four.</p>") + part.format("text", "<p>Five, six. Seven.</p>")
    assert main_text(f"<body><div>{page}</div>{BOXES}</body>") == "Head\n\nOne, two. Three, four.\n\nFive, six. Seven."


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (2, "v", "", "x")], "page_id long, url string, html string, text string")
    got = sorted(((str(r.page_id), r.n_chars, r.text) for r in extract_text(df).collect()))
    want = main_text(PAGE)
    assert got == [("1", len(want), want), ("1", len(want), want), ("2", 0, ""), ("None", 0, "")]
    assert extract_text(df.where("false")).collect() == []


PROSE = "<p>" + "A sentence, with some words. " * 6 + "</p>"
SHORT = "<p>A short article, that is all. It has two sentences, and ends here.</p>"


@pytest.mark.parametrize("name", ["form", "menu", "label", "button", "fieldset"])
def test_elements_around_the_article_are_wrappers(name):
    got = main_text(f"<body><{name} id='aspnetForm'><div>{PROSE * 3}</div></{name}><form><label>Search</label> <button>Go</button></form></body>")
    assert got.count("A sentence") == 18 and "Search" not in got and "Go" not in got


def test_hidden_is_an_attribute_not_a_word():
    page = f"<article title='the hidden past'>{PROSE}<p class=\"overflow hidden md:block\">Shown, here it is. And more.</p><p hidden>gone</p><p style='display:none'>gone</p><p data-x='display:none'>Kept, too. As it is.</p></article>"
    got = main_text(page)
    assert "Shown" in got and "Kept, too" in got and "gone" not in got


def test_a_header_beside_the_body_holds_the_headline():
    site = "<header><h1>Site</h1><a href=/>Home page of the site</a></header>"
    story = "<div class='story'><header><h1>Headline</h1></header><div class=body>{}</div></div>"
    got = main_text(f"<body>{site}{story.format(PROSE * 4)}</body>")
    assert got.startswith("Headline\n\nA sentence") and "Site" not in got
    own = main_text(f"<body>{site}<div class='page'><div class=body><h2>Own</h2>{PROSE * 4}</div></div></body>")
    assert own.startswith("Own") and "Site" not in own


def test_many_comments_lose_to_a_short_article():
    comment = f"<div class='comment'>{PROSE}</div>"
    assert main_text(f"<body><div class=text>{SHORT}</div><div id=comments>{comment * 20}</div></body>") == SHORT[3:-4]
    # A name of one element around everything is a wrapper all the same.
    assert main_text(f"<body><div class='comment-page'>{PROSE * 2}</div></body>").count("A sentence") == 12


def test_formulas_stay_in_their_sentence():
    assert main_text(f"<article>{PROSE}<p>Let <math><mi>x</mi><annotation>tex</annotation></math> be.</p></article>").endswith("\n\nLet x be.")


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x text, here." + "</div>" * 20_000, "<b>" * 20_000 + "x text, here.", "<div>t. " * 20_000, "<p>a, b.<b>" * 20_000])
def test_deep_pages_take_time_by_length(page):
    start = time.process_time()
    assert main_text(page)
    assert time.process_time() - start < 5
