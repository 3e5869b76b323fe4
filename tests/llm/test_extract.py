"""Main text of pages with known articles."""

import random

import pytest

from lapsewise.llm import extract

PAGES = "page_id long, url string, html string"


def site(host, k, style):
    rng = random.Random(f"{host}{k}")
    say = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "été"]) + str(rng.randrange(90)) for _ in range(n))
    title, parts = say(4), [say(rng.randint(8, 40)) for _ in range(rng.randint(2, 6))]
    menu = "".join(f'<li><a href="/{w}">{w}</a>' for w in say(6).split())
    body = "".join(f"<p>{p}" + ("</p>" if k % 2 else "") for p in parts)
    comments = f'<section class="comments"><p>{say(9)}</p></section>'
    if style == "article":
        inner = f"<article><h1>{title}</h1>{body}<aside>{say(5)}</aside>{comments}</article>"
    else:
        inner = f'<div class="wrap"><div id="content"><h1>{title}</h1>{body}</div><div class="sidebar"><p>{say(20)}</p></div></div>'
    page = (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var x='</p><p>no'</script></head><body>"
        f"<header><p>{say(3)}</p></header><nav><ul>{menu}</ul></nav><!-- <p>not this</p> --><div class='cookie-notice'>{say(8)}</div>"
        f'<div class="ad">{say(7)}</div>{inner}<form><label>{say(2)}</label><button>{say(1)}</button></form>'
        f"<footer>&copy; {host} &middot; {say(6)}</footer></body></html>"
    )
    return page, "\n".join([title, *parts])


@pytest.mark.parametrize("style", ["article", "divs"])
@pytest.mark.parametrize("pages", [1, 2, 25])
def test_articles_of_a_host(spark, style, pages):
    made = [site("a.example", k, style) for k in range(pages)]
    rows = [(k, f"https://a.example/x/{k}?q=1", page) for k, (page, _) in enumerate(made)]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {k: text for k, (_, text) in enumerate(made)}


def test_one_host_of_two_templates(spark):
    made = [site("b.example", k, "divs" if k % 10 == 0 else "article") for k in range(40)]
    rows = [(k, "http://b.example/", page) for k, (page, _) in enumerate(made)]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {k: text for k, (_, text) in enumerate(made)}


def test_blocks_references_and_white_space(spark):
    page = "<article><h1>A &amp; B</h1><p>x\n  y&nbsp;z <b>bo</b>ld<br>next<p>&lt;tag&gt; 1 < 2 &eacute;&#233;<ul><li>one<li>two</ul>tail</article>"
    (row,) = extract.extract(spark.createDataFrame([(1, None, page)], PAGES)).collect()
    assert row.text == "A & B\nx y z bold next\n<tag> 1 < 2 éé\none\ntwo\ntail" and row.n_chars == len(row.text)


def test_a_passage_on_every_page_stays(spark):
    shared = "<p>The same passage on each page.</p>"
    rows = [(k, "http://c.example/", f"<body><nav>menu {k}</nav><article><p>Own text {k}.</p>{shared}</article></body>") for k in range(30)]
    for r in extract.extract(spark.createDataFrame(rows, PAGES)).collect():
        assert r.text == f"Own text {r.page_id}.\nThe same passage on each page."


def test_odd_pages(spark):
    rows = [(1, "http://d/", None), (2, None, ""), (None, "", "<p>only"), (4, "::", "no markup at all"), (4, "::", "no markup at all"), (5, "http://d/", "<p>" + "long " * 100_000), (6, "http://d/", "</div></p><<<a<b>>"), (7, "x", "<script>never closed")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], PAGES + ", row long, host string")
    found = extract.extract(table).collect()
    assert sorted((str(r.page_id), r.url or "") for r in found) == sorted((str(p), u or "") for p, u, _ in rows)
    by_id = {r.page_id: r.text for r in found}
    assert by_id[1] == by_id[2] == by_id[7] == "" and by_id[None] == "only" and by_id[4] == "no markup at all"
    assert len(by_id[5]) == 499_999
    assert extract.extract(spark.createDataFrame([], PAGES)).count() == 0


def texts_of(spark, pages):
    rows = [(k, "http://e.example/", page) for k, page in enumerate(pages)]
    return {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, PAGES)).collect()}


@pytest.mark.parametrize("tag", ["article", "div"])
def test_ids_of_each_page(spark, tag):
    top = "<h1>Site</h1><div class='top'>Site</div>"
    pages = [f"<body>{top}<{tag} id='post-{k}' class='post p{k}'><p>Own {k}.<div id='b{k}'>More {k}.</div></{tag}></body>" for k in range(12)]
    assert texts_of(spark, pages) == {k: f"Own {k}.\nMore {k}." for k in range(12)}


def test_irregular_pages_do_not_change_their_host(spark):
    top, end = "<div class='top'>Site of ours</div>", "<div class='end'>Terms of ours</div>"
    pages = [f"<body>{top}<article><p>Own {k}.</article>{end}</body>" for k in range(8)]
    pages += ["", f"<body>{top}<div class='text'><p>No article element.</div>{end}</body>"]
    assert texts_of(spark, pages) == {**{k: f"Own {k}." for k in range(8)}, 8: "", 9: "No article element."}


def test_boilerplate_without_a_name(spark):
    top, end = "<div class='top'>Site of ours</div>", "<div class='end'>" + "Terms of ours. " * 40 + "</div>"
    pages = [f"<body>{top}<div class='text'><p>Own {k}.<div>The same on each page.</div></div>{end}</body>" for k in range(8)]
    pages += ["", f"<body>{top}<section><p>Other markup.</section>{end}</body>"]
    want = {k: f"Own {k}.\nThe same on each page." for k in range(8)}
    assert texts_of(spark, pages) == {**want, 8: "", 9: "Other markup."}


@pytest.mark.parametrize(
    "markup",
    ["<body class='no-sidebar'>{}</body>", "<body class='comments-open'><div id='content-with-sidebar'>{}</div></body>",
     "<body><div class='elementor-widget'>{}</div></body>"],
)
@pytest.mark.parametrize("article", ["<article class='post share-enabled'>{}</article>", "<div class='post share-enabled'>{}</div>"])
def test_names_of_what_holds_the_article(spark, markup, article):
    inner = "<h1>Title {0}</h1><p>Own words of page {0}.</p><div class='share'>Share it</div>"
    pages = [markup.format(article.format(inner.format(k))) for k in range(5)]
    assert texts_of(spark, pages) == {k: f"Title {k}\nOwn words of page {k}." for k in range(5)}


def test_small_parts_and_linked_references(spark):
    pages = [
        f"<body><div class='title'><h1>T {k}</h1></div><div class='post'><p>{f'own{k} ' * 200}</p></div>"
        f"<div class='more'><p>Short {k}</p></div><div class='sources'><ol><li><a href='/{k}'>Source {k}</a></ol></div>"
        "<div class='links'><a href='/'>Start</a></div></body>"
        for k in range(6)
    ]
    assert texts_of(spark, pages) == {k: f"T {k}\n{(f'own{k} ' * 200).strip()}\nShort {k}\nSource {k}" for k in range(6)}


def test_stray_quotes_and_odd_tags_leave_no_markup(spark):
    body = '<article><p class="a"">one</p><p title=\'x>y\'>two</p><p data-x=a"b>three</p><p class="open>four</p><p title="">five</p><title-bar>six</title-bar></article>'
    found = {extract.main_text(body, set(), set(), set(), set(), set(), set())}
    (text,) = found
    assert text.split("\n")[:3] == ["one", "two", "three"] and "<" not in text and ">" not in text and text.endswith("six")


def test_ids_made_from_headings_stay_in_the_article(spark):
    page = "<html><body><article><h2 id='social-life'>Social life</h2><p>Text {0} of the article.</p><section id='related-work'><h3 id='ads'>Related work</h3><p>More {0} text.</p></section><div class='share'>Share</div></article></body></html>"
    pages = spark.createDataFrame([(k, f"https://h.example/{k}", page.format(f"number{k}")) for k in range(6)], "page_id long, url string, html string")
    for r in extract.extract(pages).collect():
        assert r.text == f"Social life\nText number{r.page_id} of the article.\nRelated work\nMore number{r.page_id} text."


def brute_classes(pages):
    """Tokens of one host by their whole occurrence vectors, as dictionaries, in plain Python."""
    parsed = [extract.read_page(html, set()) for html in pages]
    vectors = {}
    for k, page in enumerate(parsed):
        for role, n in page.counts().items():
            vectors.setdefault(extract._digest(role), {})[k] = n
        for _, word in page.words():
            vectors.setdefault(word, {}).setdefault(k, 0)
            vectors[word][k] += 1
    support = max(min(2, len(pages)), extract.SUPPORT * len(pages))
    groups = {}
    for token, vector in vectors.items():
        if len(vector) >= support:
            groups.setdefault(tuple(sorted(vector.items())), set()).add(token)
    return {frozenset(g) for g in groups.values()}


def test_classes_are_those_of_whole_vectors(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(12)]
    pages = []
    for k in range(25):
        text = " ".join(rng.choices(words, k=rng.randint(0, 9)))
        items = "<li>item" * rng.randint(0, 3)
        pages.append(f"<body><div>Site of ours {k % 2}</div><ul>{items}</ul>" + f"<section><p>{text}</section>" * rng.randint(0, 2) + "</body>")
    tokens = [row for html in pages for row in extract.tokens_of({"host": "h", "html": html, "words": [], "page": extract._digest(html)})]
    schema = "host string, role string, token long, under long, count long, chars long, whole long, page long"
    all_pages = spark.createDataFrame([("h", len(pages))], "host string, all long")
    found = {}
    for r in extract.classes(spark.createDataFrame(tokens, schema), all_pages).collect():
        found.setdefault(r["class"], set()).add(r.token)
        assert r.size >= len(found[r["class"]])
    want = brute_classes(pages)
    large = {g for g in want if len(g) >= extract.LARGE}
    assert large <= {frozenset(g) for g in found.values()} and all(frozenset(g) in want for g in found.values())
    assert len(large) >= 1


def test_words_without_one_order_are_no_template(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    mixed, fixed = [], []
    for k in range(12):
        turned = words[k % 4 :] + words[: k % 4]
        mixed.append(f"<body><div class='a'>{' '.join(turned)}</div></body>")
        fixed.append(f"<body><div class='a'>{' '.join(words)} <b>or</b> {' '.join(words)}</div><div class='b'>Own{k}</div></body>")
    assert texts_of(spark, mixed) == {k: " ".join(words[k % 4 :] + words[: k % 4]) for k in range(12)}
    assert texts_of(spark, fixed) == {k: f"Own{k}" for k in range(12)}


@pytest.mark.parametrize("tokens, same", [([1, 2, 3], True), ([1, 2, 1, 2], True), ([1, 2, 2, 1], False), ([1, 1, 2], False)])
def test_order_of_a_class(tokens, same):
    assert (extract.order_of(tokens) is not None) == same


def test_template_text_that_differs_on_a_page_stays_there(spark):
    pages = [f"<body><div class='top'>Site of ours</div><div class='text'>Own{k} words</div></body>" for k in range(9)]
    pages.append("<body><div class='top'>Site under repair</div><div class='text'>Own9 words</div></body>")
    assert texts_of(spark, pages) == {**{k: f"Own{k} words" for k in range(9)}, 9: "Site under repair\nOwn9 words"}
