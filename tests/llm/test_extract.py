import pytest

from quillspan.llm.extract import extract_main_text, main_text


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>a  b\n c</p><p>d</p>", "a b c\nd"),
        ("<nav><a>menu</a></nav><article><h1>T &amp; U</h1><p>one <b>two</b>three<br>four<p>five</article><footer>foot</footer>", "T & U\none twothree four\nfive"),
        ("<body><header>top</header><main><p>body text</p><aside>side</aside><form>f</form></main></body>", "body text"),
        ("<article><p>x</p><script>var t='</p>';</script><style>p{}</style><div class='comments'><p>reader</p></div><section id='comment-list'><p>r</p></section></article>", "x"),
        ("<div class='ad'>buy</div><article class='post sidebar-left'><p>kept</p><div class='cookie-notice'>no</div></article>", "kept"),
        ("<article><p><b>bold<br><p>next</p></article>", "bold\nnext"),
        ("<article><ul><li>i<li>j</ul><table><tr><td>k<td>l</table></article>", "i\nj\nk\nl"),
        ("<article><p>&lt;p&gt; &#233; &nbsp;x&copy;</p><!-- ad --></article>", "<p> é x©"),
        ("<article><p>first</p></article><article class='teaser'><p>other</p></article>", "first"),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


def test_pages_without_an_article_element_use_the_line_ratios():
    long = "word " * 60
    html = f"<div><a>h</a><a>i</a></div><div><p>{long}</p><p>short</p><p>{long}</p></div>" + "<ul>" + "<li><a>x</a></li>" * 30 + "</ul>"
    got = main_text(html).split("\n")
    at = got.index("short")
    assert got[at - 1] == got[at + 1] == long.strip() and got.count("x") < 5


def test_every_page_once(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, None, None), (None, "v", "<article>" + "<p>b c</p>" * 5000 + "</article>")]
    df = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, extract_main_text(df).collect()), key=str)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0), (None, "v", "\n".join(["b c"] * 5000), 5000 * 4 - 1)], key=str)
    assert extract_main_text(df.where("false")).count() == 0


LONG = "\n".join(f"<p>{f'sentence {i} of the page ' * 12}</p>" for i in range(6))


@pytest.mark.parametrize("attrs", ["class='has-sidebar'", "class='no-sidebar wide'", "class='with-comments'", "id='search-results'", "class='content-sidebar-wrap'", "class='sidebar-wrapper'"])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<div>{}</div>"])
def test_a_wrapper_does_not_hide_the_article(attrs, inner):
    html = f"<body><nav>menu</nav><div {attrs}>{inner.format(LONG)}<div class='sidebar'>side</div></div><footer>f</footer></body>"
    assert main_text(html) == main_text(f"<article>{LONG}</article>") != ""


def test_words_of_compound_classes_do_not_hide():
    assert main_text(f"<article><h1 class='page-header'>Title</h1><p class='share-price'>12.50</p>{LONG}</article>").split("\n")[:2] == ["Title", "12.50"]
    assert main_text(f"<article class='with-comments'>{LONG}</article>") != ""
    assert main_text(f"<article>{LONG}</article><div class='comments-area'>{LONG * 5}</div>") == main_text(f"<article>{LONG}</article>")


def test_the_scores_choose_the_region():
    card = "<article class='card'><a>see</a> <a>this</a></article>"
    want = main_text(f"<article>{LONG}</article>").split("\n")
    got = main_text(f"<div id='content'>{LONG}</div><ul>{'<li><a>x</a></li>' * 30}</ul>{card}").split("\n")
    assert [x for x in got if len(x) > 20] == want and "see this" not in got
    assert main_text(f"<article>{LONG}</article><ul>{'<li><a>x</a></li>' * 30}</ul>{card}").split("\n") == want


def test_marks_among_other_words_and_open_comments():
    page = "<article><p>one two three four</p>{}<p>five six seven eight</p></article>"
    assert "up by two" in main_text(page.format('<p class="share price">up by two</p>'))
    assert "sign here" not in main_text(page.format('<p class="newsletter">sign here</p>'))
    assert main_text("<p>a text</p><!--<p>b") == "a text"


def test_broken_markup_takes_linear_time():
    import time

    def seconds(n):
        began = time.process_time()
        main_text("<article>" + "<b>x</i>" * n + "<p>y</em>" * n + "</article>")
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 12 * max(seconds(4_000), 0.02)
