import html
import itertools
import random
import re
import time

from cloakframe.llm import html_text as m


def test_article_pages(spark, sf_dir):
    """The pages of the table mark their article: its text by a plain pattern is what must come out."""
    for r in m.op8_html_text(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", body)]
        assert r.text == "\n".join(x for x in blocks if x)
        assert r.n_chars == len(r.text)


def para(i):
    return f"Paragraph {i} says a good deal about its matter, and it goes on for a while so that it is long enough."


def test_div_page():
    paras = [para(i) for i in range(6)]
    page = f"""<html><body><div id="top-menu"><a href=1>Home</a> <a href=2>News</a></div><div><a href=3>One</a><a href=4>Two</a></div>
    <div class="cookie-notice">We use cookies, and we say it in a sentence that is long enough to look like content.</div>
    <div class="post"><h1>Title &amp; more</h1>{''.join(f'<p>{p}</p>' for p in paras[:3])}<p>Short.</p>
    <form><p>Give us your mail address, please, it will be kept safe by us and by our partners.</p></form>
    {''.join(f'<p>{p}</p>' for p in paras[3:])}</div>
    <div class="comments"><p>A reader says that all of this is wrong and writes at length about it, for no reason.</p></div>
    <aside><p>Another story that you may like to read, with a long text that tells you what it is about.</p></aside>
    <footer><p>Copyright and a long legal text that nobody reads, but which stands here anyway for all.</p></footer></body></html>"""
    got = m.extract(page).split("\n")
    assert set([*paras, "Short."]) <= set(got)
    assert all(x in ("Title & more", "Short.", *paras) for x in got)


def test_marked_pages():
    inner = f"<header class='entry-header'><h1>Head</h1></header><p>{para(1)}</p><aside>side</aside><p>{para(2)}</p><div class='share-buttons'>Share this</div>"
    comment = f"<section id='c'><article class='comment'><p>{para(8)}</p></article></section>"
    page = f"<body><header><p>{para(7)}</p></header><main><div role='alert'>Note</div><article>{inner}</article><div><p>{para(9)}</p></div></main>{comment}<div class='ad-slot'>{para(6)}</div></body>"
    assert m.extract(page) == "\n".join(["Head", para(1), para(2)])
    only_main = f"<body><p>{para(7)}</p><main><h1>Head</h1><p>{para(1)}</p><p>x</p></main><p>{para(9)}</p></body>"
    assert m.extract(only_main) == "\n".join(["Head", para(1), "x"])


def test_ratios_choose_among_marked_articles():
    """Teasers that are marked up as articles hold no content line; a short line of the article stays."""
    teasers = "".join(f"<article><h3><a href={i}>More {i}</a></h3><p><a href={i}>Read on</a></p></article>" for i in range(6))
    article = "".join(f"<p>{para(i)}</p>" for i in range(6)) + "<p>End.</p>"
    assert m.extract(f"<body><article>{article}</article><div>{teasers}</div></body>") == "\n".join([*map(para, range(6)), "End."])
    assert m.extract(f"<body><div>{teasers}</div><article>{article}</article></body>") == "\n".join([*map(para, range(6)), "End."])
    # long text beside a short article
    beside = "".join(f"<p>{para(i)} {para(i)}</p>" for i in range(8))
    assert m.extract(f"<body><div>{beside}</div><article><h1>Short</h1><p>A few words.</p><p>And these.</p></article></body>") == "Short\nA few words.\nAnd these."


def test_edges(spark):
    assert m.extract(None) == m.extract("") == m.extract("<p> &nbsp; </p>") == m.extract("<script>x</script>") == ""
    assert m.extract("plain &lt;text&gt;\n\n here") == "plain <text> here"
    assert m.extract("<article><p>a<b>b</b>\n c<p>d &eacute;&#233;<br>e</article><p>out") == "ab c\nd éé\ne"
    assert m.extract("<article><p>one<!-- no --><style>p{}</style> two</p><nav>menu</nav><section class='comments'><p>three</p></section></article>") == "one two"
    assert m.extract("<p>unclosed <b>tags <i>everywhere") == "unclosed tags everywhere"
    assert m.extract("<div>" * 3000 + "deep" + "</div>" * 2000) == "deep"
    long = "word " * 200000
    assert len(m.extract(f"<article><p>{long}</p></article>")) == len(long) - 1
    df = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<p>a</p>", None), (None, "u", "<p>a</p>", None)], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, m.extract_pages(df).collect()), key=repr) == sorted([(1, None, ""), (1, "u", "a"), (None, "u", "a")], key=repr)
    assert m.extract_pages(df.limit(0)).collect() == []


def test_layout_wrappers():
    """A class or id word of a wrapper does not discard the article, the main part or most of the text."""
    paras = "".join(f"<p>{para(i)}</p>" for i in range(5))
    want = "\n".join(map(para, range(5)))
    side = f"<div class='sidebar'><p>{para(7)}</p></div>"
    for wrapper in ("class='layout has-sidebar'", "id='page' class='no-sidebar'", "class='content with-widgets'"):
        for inner in (f"<article>{paras}</article>", f"<main>{paras}</main>", f"<div>{paras}</div>"):
            assert m.extract(f"<body><div {wrapper}>{inner}{side}</div></body>") == want
    # an article in a named element beside the page's own
    assert m.extract(f"<body><article>{paras}</article><div class='related'><article><p>{para(8)}</p></article></div></body>") == want
    for block in ("related-work", "legal", "search-terms"):
        got = m.extract(f"<body><article>{paras}<div class='{block}'><p>{para(6)}</p></div></article></body>")
        assert got == f"{want}\n{para(6)}"


def test_wrappers_by_form_class_and_header():
    t = "The court held that the appeal was allowed and the order below was set aside in full. " * 3
    body = f"<h1>Opinion</h1><p>{t}</p><p>{t}</p>"
    want = f"Opinion\n{t.strip()}\n{t.strip()}"
    for page in (
        f"<form id='aspnet'><nav>Home</nav><div>{body}</div></form>",
        f"<div class='legal-opinion'><article>{body}</article></div><div class='ad'>buy</div>",
        f"<article><div class='legal-opinion'>{body}</div></article><nav>a b</nav>",
        f"<main><header><h1>Opinion</h1></header><p>{t}</p><p>{t}</p></main>",
        f"<article>{body}<form>Subscribe now <input></form></article>",
    ):
        assert m.extract(f"<html><body>{page}</body></html>") == want


def test_unmatched_tags_take_linear_time():
    began = time.process_time()
    m.extract("<div>" * 30_000 + "<p>a" + "</i>" * 100_000)
    assert time.process_time() - began < 10


def test_comments_are_never_content():
    """Whatever their size, where they stand, and how they are marked up."""
    paras, comments = "".join(f"<p>{para(i)}</p>" for i in range(2)), "".join(f"<p>{para(i)}</p>" for i in range(40, 60))
    want = f"{para(0)}\n{para(1)}"
    for tag, name in itertools.product(("div", "section", "ul"), ("class='comments'", "id='comments'", "class='post-comments open'", "id='disqus_thread'", "class='sidebar'", "class='cookie-banner'", "style='color:red;display: none'")):
        block = f"<{tag} {name}>{comments}</{tag}>"
        for page in (f"{paras}{block}", f"{block}{paras}", f"<article>{paras}{block}</article>", f"<main>{paras}{block}</main>", f"<div class='layout has-sidebar'><div>{paras}</div>{block}</div>"):
            assert m.extract(f"<html><body>{page}</body></html>") == want, page[:80]


def test_nothing_of_the_content_is_cut():
    """Short first and last lines, and a heading and a table before the text, on pages without marks."""
    body = "".join(f"<p>{para(i)} {para(i)}</p>" for i in range(4))
    table = "<table><tr><th>Year</th><th>Sum</th></tr><tr><td>1999</td><td>12</td></tr></table>"
    for first, last in itertools.product(("<p>Short.</p>", f"<h2>Table</h2>{table}", "<p>By me</p><ul><li>one</li><li>two</li></ul>"), ("", "<p>Bye.</p><p>The author.</p>")):
        inner = f"<h1>Title</h1>{first}{body}{last}"
        want = "\n".join(x for x in re.split(r"\n+", re.sub(r"<[^>]*>", "\n", inner)) if x)
        for page in (inner, f"<div>{inner}</div>", f"<div><a href=1>One</a> <a href=2>Two</a></div><div class='post'>{inner}</div><div><a href=3>Next</a></div>"):
            assert m.extract(f"<body>{page}</body>") == want


def test_layouts_against_known_text():
    """Generated pages of eight layouts, without or with marks: the text that was put in is what comes out."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    links = lambda n: "".join(f"<li><a href='/{k}'>{word()}</a></li>" for k in range(n))
    layouts = [
        "<nav><ul>{menu}</ul></nav><div class='post'>{content}</div><footer><p>{small}</p></footer>",
        "<div id='header'><ul>{menu}</ul></div><div id='content'>{content}</div><div id='sidebar'><p>{long}</p></div>",
        "<header><p>{small}</p></header><main>{content}</main><aside><p>{long}</p></aside>",
        "<ul>{menu}</ul><article>{content}</article><section class='comments'><p>{long}</p><p>{long}</p></section>",
        "<table><tr><td class='menu'><ul>{menu}</ul></td><td>{content}</td></tr></table>",
        "<div class='wrapper with-sidebar'><div class='inner'>{content}</div><div class='widget'><p>{long}</p></div></div><div class='cookie-notice'><p>{long}</p></div>",
        "<form id='f'><div role='navigation'><ul>{menu}</ul></div><div>{content}</div></form><div class='footer'><p>{small}</p></div>",
        "<div class='ad'><p>{long}</p></div><div><div>{content}</div></div><div id='comments'><ol><li>{long}</li></ol></div>",
    ]
    for layout in layouts:
        for _ in range(25):
            blocks = [("h1", sentence(4))] + [(r.choice(["p", "p", "p", "blockquote", "h2"]), sentence(r.choice([3, 12, 40, 80]))) for _ in range(r.randint(4, 12))]
            content = "".join(f"<{t}>{x}</{t}>" for t, x in blocks)
            page = layout.format(menu=links(r.randint(3, 12)), content=content, small=sentence(6), long=sentence(r.choice([20, 120])))
            assert m.extract(f"<!DOCTYPE html><html><body>{page}</body></html>") == "\n".join(x for _, x in blocks), layout


def test_hostile_pages_take_linear_time():
    began = time.process_time()
    for name in ("ad", "menu", "related"):
        m.extract(f"<div class='{name}'><p>x</p>" * 8_000)
    assert m.extract("<p>text</p>" + "<a " * 50_000) == "text"
    assert m.extract("a < b <p>c</p> d < e") == "a < b\nc\nd < e"
    assert time.process_time() - began < 10
