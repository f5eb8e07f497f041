"""Page extraction: the cut itself, the marks, and what a table may hold."""

import random
from itertools import product

import pytest

from tessera.llm import html_extract as H
from tessera.llm.common import table

LONG = "This is a sentence of a paragraph that goes on for a while. " * 8


def value(costs, edges, label):
    own = sum(max(c, 0) if not x else max(-c, 0) for c, x in zip(costs, label))
    return own + sum(w for i, e in enumerate(edges) for j, w in e.items() if i < j and label[i] != label[j])


def test_the_cut_of_whole_small_pages_is_minimal():
    rnd = random.Random(11)
    texts = ["Short.", "x", "A line without end", LONG, "Some words that fill a line of text.", "<a href=1>A link to follow</a>", "© 2020 Someone"]
    around = ["<p>{}</p>", "<div>{}</div>", "<li>{}", "<article>{}</article>", "<nav>{}</nav>", "<div class='tags'>{}</div>", "<section class='content'>{}</section>", "<main>{}</main>", "<h2>{}</h2>", "<div class=ad>{}</div>"]
    for _ in range(120):
        page = "".join(rnd.choice(around).format(rnd.choice(around).format(rnd.choice(texts)) + rnd.choice(["", rnd.choice(texts)])) for _ in range(rnd.randint(1, 4)))
        costs, edges = H.graph_of(H.blocks_of(page))
        assert all(edges[j][i] == w for i, e in enumerate(edges) for j, w in e.items())
        if len(costs) <= 13:
            assert value(costs, edges, H.min_cut(costs, edges)) == min(value(costs, edges, x) for x in product([False, True], repeat=len(costs))), page


def test_the_cut_labels_blocks_otherwise_than_their_text_alone(spark, sf):
    pages = [r.html for r in table(spark, sf, "pages").collect()]
    labelled = [H.label(p) for p in pages]
    assert sum(x.changed > 0 for x in labelled) > len(pages) / 2
    assert sum(x.changed for x in labelled) > 0.05 * sum(len(x.blocks) for x in labelled)


@pytest.mark.parametrize("page,want", [
    ('<article title="The hidden truth"><p>Hello there.</p></article>', ["Hello there."]),
    ('<article data-hidden="false" data-x=\'class="ad"\'><p>Hello there.</p></article>', ["Hello there."]),
    (f'<article><p>Text.</p><div id="comments" width="300"><p>{LONG}</p></div></article>', ["Text."]),
    (f"<aside><article><p>{LONG}</p></article></aside><article><p>Real.</p></article>", ["Real."]),
    (f'<article><p class="legal-history">A note on the history of the law.</p><p>{LONG}</p></article>', ["A note on the history of the law.", LONG.strip()]),
    ("<article><p>See <math><mi>x</mi><mo>=</mo><mn>1</mn></math> here.</p></article>", ["See x=1 here."]),
    (f"<body><p>{LONG}</p><p>{LONG}</p><div>Copyright 2024 by the Example Company, all rights reserved.</div></body>", [LONG.strip()] * 2),
    (f'<article><p>One.</p><div class="ad">{LONG * 4}</div><p>Two.</p></article>', ["One.", "Two."]),
    (f"<article><p>One.</p></article><section class=comments>{f'<p>{LONG}</p>' * 30}</section>", ["One."]),
    ('<body><nav><a href=1>x</a></nav><main><h1>T</h1><p>Short.</p><div class="share-bar">Share it</div></main><div>Other words of the page.</div></body>', ["T", "Short."]),
    (f"<body><form action=x><div id=page><p>{LONG}</p><p>{LONG}</p></div></form></body>", [LONG.strip()] * 2),
    ('<body><div class="layout has-sidebar"><article><p>Real.</p></article><div class="sidebar"><p>Side.</p></div></div></body>', ["Real."]),
    ('<article><p>Seen <span hidden>unseen</span> text.</p><p style="display: none">no</p></article>', ["Seen text."]),
    (f"<ul><li><a href=1>Home</a><li><a href=2>News</a></ul><h1>The Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><ul><li><a href=1>One</a></ul>", ["The Title", LONG.strip(), "Short.", LONG.strip()]),
    ("<article><p>One</p><noscript>no</noscript><textarea>no</textarea><button>Press</button><fieldset><label>Name</label></fieldset></article>", ["One"]),
    ("<article></article>", []), ("<nav>a", []), ("<", []),
])
def test_marks(page, want):
    assert H.extract(page) == want


PROSE = ["This paragraph of the article has words enough to be told from a line of a menu, as the others have; number %d." % k for k in range(3)]
P = "".join(f"<p>{x}</p>" for x in PROSE)
LINKS = "<ul>" + "".join(f"<li><a href=/{k}>Section {k}</a></li>" for k in range(6)) + "</ul>"


def test_no_article_is_lost_where_a_page_marks_none():
    short = "A paragraph of some length, as they stand in articles, with two hundred and five characters or so, that goes on and on until it ends where it should end, which is about here, after a few more words of it."
    link = '<p><a href="/x">A paragraph that is a link to elsewhere</a></p>'
    assert H.extract(f"<body><div><p>{short}</p><p>Yes.</p><p>No.</p></div></body>") == [short, "Yes.", "No."]
    assert [x for x in H.extract(f"<body><div>{f'<p>{short}</p>{link}' * 3}</div></body>") if x == short] == [short] * 3
    many = H.extract("<body><div>" + f"<p>{short[:140]}</p>{link}" * 8000 + "</div></body>")
    assert many.count(short[:140]) == 8000
    items = [f"{k} cups of it" for k in range(8)]
    recipe = "<body><h1>Recipe</h1><ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul><p>Mix them well.</p></body>"
    assert H.extract(recipe) == ["Recipe", *items, "Mix them well."]
    for opened in ('<section id="related-work">', '<section id="discussion">', '<div class="share-price">', "<fieldset>", '<div class="notice">'):
        assert H.extract(f"<article><p>{short}</p>{opened}<p>{short}</p></article>") == [short] * 2, opened
    for name in ("market-share post", "social-science content", "form-factor-review", "comment-le-dire", "menu"):
        assert H.extract(f'<body><div class="{name}"><p>{short}</p><p>{short}</p></div></body>') == [short] * 2, name


@pytest.mark.parametrize("page", [
    "<body>{nav}<h1>T</h1>{p}{nav}</body>",
    "<body><div>{nav}</div><div><h1>T</h1>{p}</div><div>{nav}</div></body>",
    "<body><table><tr><td>{nav}</td><td><h1>T</h1>{p}</td></tr></table></body>",
    "<body><div id=top>{nav}</div><div id=wrap><div class=col><h1>T</h1>{p}</div><div class=sidebar><p>Words that stand beside it, of which there are a few.</p></div></div></body>",
    "<body><div class=post><h1>T</h1>{p}</div><div class=comments><p>I liked this article, which was one of the best, very much.</p></div></body>",
    "<body><div><div><div><div><h1>T</h1>{p}</div></div></div></div><div class=site-footer>Some company, some street, some town.</div></body>",
    "<body><div class='cookie-banner'>We use cookies to make this page better for you and for us. <button>Fine</button></div><div><h1>T</h1>{p}</div></body>",
    "<body><form action=/><input name=q><div>{nav}</div><div><h1>T</h1>{p}</div></form></body>",
    "<body><h1>T</h1>{p}<div class='related-posts'>{nav}</div><form><input><label>Your name</label><button>Send</button></form></body>",
    "<body><div class='ad-slot'>Buy this now, as it is so very cheap today, and only today.</div><h1>T</h1>{p}<p>&copy; 2024 Somebody</p></body>",
    "<body><div class=newsletter-box><p>Get our letter each week, with all that is new.</p><input></div><section><h1>T</h1>{p}</section></body>",
    "<body><center><font><h1>T</h1>{p}</font></center><hr>{nav}</body>",
])
def test_layouts_without_marks(page):
    assert H.extract(page.replace("{nav}", LINKS).replace("{p}", P)) == ["T", *PROSE]


def test_inside_an_article_evidence_decides():
    page = lambda x: H.extract(f"<article><h1>T</h1>{P}{x}</article>")
    told = ["T", *PROSE]
    assert page(f'<div class="related">{LINKS}</div>') == told
    assert page('<div class="share"><p>Share this</p></div>') == told
    assert page('<div class="feedback"><p>What did you think of this article, which you have read to its end today, we hope?</p><textarea></textarea></div>') == told
    assert page('<div class="comments"><div class="comment"><p>What a good article this was, the best I have read in all these years.</p></div></div>') == told
    assert page(f"<form>{LONG}<input><input></form>") == told + [LONG.strip()]
    assert page("<form><p>Your name</p><input></form>") == told
    assert page("<aside><p>A word aside.</p></aside><footer>Filed under words</footer>") == told
    assert H.extract(f"<body><div>{P}{P}{P}{P}</div><article><p>A teaser.</p></article></body>") == PROSE * 4 + ["A teaser."]


def test_tables_of_pages(spark):
    long = "<article>" + "<p>A line of it.</p><div class=ad>Buy.</div>" * 20_000 + "</article>"
    rows = [(1, "u", long, "x"), (2, None, None, "x"), (2, None, "", "x"), (3, "v", "<article>a", "x"), (3, "v", "<article>a", "x"), (None, "w", "<article>&amp;amp; b", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in H.main_text(pages).collect()))
    assert got == sorted([(1, "u", "\n".join(["A line of it."] * 20_000), 20_000 * 14 - 1), (2, "", "", 0), (2, "", "", 0), (3, "v", "a", 1), (3, "v", "a", 1), (0, "w", "&amp; b", 7)])
    assert H.main_text(pages.filter("false")).collect() == []
