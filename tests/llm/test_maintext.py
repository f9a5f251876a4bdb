import pytest

from clonoscape.llm import maintext as mt

TREE = mt.grow(mt.labelled())


def text(page):
    return mt.main_text(page, TREE)


def test_tree_agrees_with_its_table():
    rows = mt.labelled()
    assert len(rows) > 400 and sum((mt.judge(TREE, x) >= 0.5) == x[-1] for x in rows) > 0.97 * len(rows)
    other = mt.labelled(seed=8)
    assert sum((mt.judge(TREE, x) >= 0.5) == x[-1] for x in other) > 0.9 * len(other)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<body><nav><a href=/>Home</a></nav><article><h1>Title here</h1><p>One &amp; two.<p>Three</article><footer>c 2020</footer>", "Title here One & two. Three"),
        ("<article><p>Text<script>var a='</p>';</script> goes on</p><aside>more links</aside><div class='comments'><p>nice post</p></div></article>", "Text goes on"),
        ("<article><p>A &eacute; &#233; &#xe9;\n\n  b</p><!-- gone <p>no</p> --><form><p>mail</p></form></article>", "A é é é b"),
        ("<div class='cookie-notice'>We use cookies on this site to make it better for all of you</div><article><p>Por.</p></article>", "Por."),
        ("<article><p>cut off in a tag <a hre", "cut off in a tag"),
        ("<article><p>5 < 6 and 7 > 3</p></article>", "5 < 6 and 7 > 3"),
        ("<main><p>in main</p></main><div id=sidebar><p>side</p></div>", "in main"),
    ],
)
def test_pages(page, want):
    assert text(page) == want


def test_page_without_an_article_goes_by_words_and_links():
    long = "This paragraph has well over twenty words and so it reads like the body of a page, not like a menu or a notice at its foot."
    menu = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(6))
    assert text(f"<ul>{menu}</ul><h1>A heading</h1><p>{long}</p><p>{long}</p><ul>{menu}</ul>") == f"A heading {long} {long}"


def test_table(spark):
    rows = [(1, "u", "<article><p>x</p></article>", "clash"), (1, "u", "<article><p>x</p></article>", "clash"), (None, None, None, None), (2, None, "<p>" + "long " * 20000 + "</p>", "")]
    got = mt.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r["n_chars"] for r in sorted(got, key=lambda r: r["n_chars"])] == [0, 1, 1, 99999]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert mt.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("mark", ["style='overflow:hidden'", "aria-hidden=false", "class='overflow-hidden row'", "class=has-sidebar", "class='no-comments wide'", "data-hidden=1", "title='nothing hidden here'", "hidden=until-found"])
def test_wrapper_that_hides_nothing_keeps_the_article(mark):
    assert text(f"<body><div {mark}><article><p>Some text</p></article></div></body>") == "Some text"


@pytest.mark.parametrize("mark", ["hidden", "hidden=''", "aria-hidden='true'", "style='color:red; display : none'", "style='visibility:hidden!important'", "class='box hidden'", "class=site-footer", "id=comment-12", "class='cookie-notice'"])
def test_hidden_and_boilerplate_elements_are_left_out(mark):
    assert text(f"<body><article><p>Some text</p></article><div {mark}><p>Other words</p></div></body>") == "Some text"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="page has-sidebar"><article><p>Some text</p></article></div>', "Some text"),
        ('<div class="wrapper nav-open"><div class="content"><p>Some text</p></div></div>', "Some text"),
        ('<div class="sidebar"><main><p>Some text</p></main></div>', "Some text"),
        ('<form id="aspnet"><article><p>Some text</p></article></form>', "Some text"),
        ("<article><p>See <a>this very long link text about many things</a> now</p></article>", "See this very long link text about many things now"),
        ("<body><p>hello there</p></body>", "hello there"),
        ('<article><p title="x>hello</p><p>there</p></article>', "hello there"),
        ('<article><p>Text</p></article><section class="comments"><article class="comment"><p>I liked it</p></article></section>', "Text"),
        ('<article><p>Text</p><div id="comments"><article><p>I liked it</p></article></div></article>', "Text"),
        ('<article><p>Text</p></article><aside><article><p>Read more</p></article></aside>', "Text"),
        ('<div hidden><article><p>Draft</p></article></div><article><p>Text</p></article>', "Text"),
        ('<article class="ad"><p>Buy this</p></article><article><p>Text</p></article>', "Text"),
    ],
)
def test_wrappers_and_odd_marks(page, want):
    assert text(page) == want


def test_time_is_linear_in_the_page():
    import time

    for piece in ("<span>a ", "<div><a href=x>b ", "<li><b>c ", "</i>d ", "<p title='>e "):
        began = time.process_time()
        mt.blocks(piece * (1_000_000 // len(piece)))
        assert time.process_time() - began < 10, piece


def test_generated_pages():
    """Pages put together at random from parts of known kind."""
    import random

    r = random.Random(5)
    say = lambda n: " ".join(r.choice("stone river garden window paper evening letter number quiet green".split()) for _ in range(n)).capitalize() + "."
    menu = lambda: "<ul>" + "".join(f"<li><a href=/{i}>{say(r.randint(1, 3))}</a></li>" for i in range(r.randint(4, 9))) + "</ul>"
    clutter = [
        lambda: f"<nav>{menu()}</nav>", lambda: f"<div class='{r.choice(['menu', 'main-menu', 'navbar', 'breadcrumbs'])}'>{menu()}</div>", lambda: f"<div class=ad><p>{say(12)}</p></div>",
        lambda: f"<div id=cookie-consent><p>{say(25)}</p><button>OK</button></div>", lambda: f"<aside><h3>{say(2)}</h3><p>{say(30)}</p></aside>", lambda: f"<div class='widget sidebar'><p>{say(20)}</p>{menu()}</div>",
        lambda: f"<form action=/s><label>{say(3)}</label><input name=q></form>", lambda: f"<script>var x = '<p>{say(5)}</p>';</script>", lambda: f"<style>p {{ color: red }}</style><noscript>{say(4)}</noscript>", lambda: f"<!-- <p>{say(9)}</p> -->",
        lambda: f"<section class=comments><h2>{say(1)}</h2><article class=comment><p>{say(40)}</p></article></section>", lambda: f"<footer><p>{say(15)}</p></footer>", lambda: f"<div class=newsletter-signup><p>{say(18)}</p></div>",
    ]
    for _ in range(120):
        want, body = [], []
        for _ in range(r.randint(1, 7)):
            x = say(r.choice([3, 8, 25, 60, 120]))
            kind = r.randrange(6)
            want.append(x)
            words = x.split()
            body.append([f"<p>{x}</p>", f"<h2>{x}</h2>", f"<ul><li>{x}</li></ul>", f"<blockquote>{x}</blockquote>", f"<p><a href=/x>{words[0]}</a> <b>{' '.join(words[1:])}</b>", f"<div>{x}</div>"][kind])
            if r.random() < 0.3:
                body.append(r.choice(clutter)())
        around = r.choice(["<article>{}</article>", "<main>{}</main>", "<div class='page has-sidebar'><article>{}</article></div>", "<div class=post-content>{}</div>", "<div class=sidebar><main>{}</main></div>"])
        some = lambda: "".join(c() for c in r.sample(clutter, r.randint(0, 4)))
        page = f"<!doctype html><html><head><title>{say(4)}</title></head><body>{some()}{around.format(''.join(body))}{some()}</body></html>"
        assert text(page) == " ".join(want), page


@pytest.mark.parametrize("name", ["social", "legal", "search", "copyright notice"])
def test_what_an_article_is_about_does_not_empty_it(name):
    page = f"<body><nav><a href=x>Home</a></nav><article class='{name}'><h1>On {name}</h1><p>{'Plain words of the text. ' * 6}</p></article><div class='social'><a href=y>Share this</a></div></body>"
    assert mt.main_text(page, TREE) == f"On {name} " + " ".join(["Plain words of the text."] * 6)


def test_readers_comments_stay_out_even_as_articles():
    page = f"<body><article><p>{'Words of the text itself. ' * 6}</p></article><section class='comments'><article class='comment'><p>{'I think that this is wrong. ' * 5}</p></article></section></body>"
    assert mt.main_text(page, TREE) == " ".join(["Words of the text itself."] * 6)
