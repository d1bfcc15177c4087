import pytest
from factorspark.llm import htmltext as ht


@pytest.fixture(scope="module")
def model():
    return ht.train()


def lines(page):
    return [b.text for b in ht.blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain   text\n here", ["plain text here"]),
        ("<p>a<p>b<div>c</div>d", ["a", "b", "c", "d"]),
        ("<p>a <b>b</b>\n c<br>d</p>", ["a b c d"]),
        ("x<script>var t='</p>';if(a<b){}</script>y<style>p{}</style>", ["xy"]),
        ("<!-- <p>no</p> --><p>yes</p><!-- open", ["yes"]),
        ("<p>&lt;b&gt; &amp; &eacute;&#233;&nbsp;x</p>", ["<b> & éé x"]),
        ("<p>1 < 2 and 3 > 2</p>", ["1 < 2 and 3 > 2"]),
        ('<p title="a > b">t</p><a href=x>l</a>', ["t", "l"]),
        ("<head><title>no</title></head><body>yes</body>", ["yes"]),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", ["a", "b", "c", "d"]),
        ("<form><label>n</label><select><option>o</select><button>b</button>t</form>", ["t"]),
        ("</p></div>stray", ["stray"]),
        ("<p hidden>no</p><div style='display: none'>no</div>yes", ["yes"]),
        ("<p>unclosed <em", ["unclosed"]),
    ],
)
def test_blocks(page, want):
    assert lines(page) == want


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for n in (1, 2, 6):
        emit, moves = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = lambda p: sum(emit[k, s] for k, s in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert tuple(ht.viterbi(emit, moves)) == best


def test_held_out_pages(model):
    pages = ht.labelled_pages(80, seed=77)
    exact = sum(ht.extract(model, page) == "\n".join(" ".join(m.split()) for m in main) for page, main in pages)
    assert exact >= 0.92 * len(pages)


def test_boilerplate_goes_and_article_stays(model):
    page = """<html><head><title>T</title></head><body><header><p>Site name</p></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies to improve things.</p></div><article><h1>The title</h1><p>First paragraph of the story, which has a few words.</p>
    <div class="ad"><p>Buy our things now.</p></div><p>Second paragraph, with a <a href=/x>link</a> inside it.</p><p>Short.</p></article>
    <aside><h3>Related</h3><ul><li><a href=/c>Other story</a></li></ul></aside><section class="comments"><h3>Comments</h3><div class="comment"><p>I liked reading this a lot, thank you for it.</p></div></section>
    <form><p>Sign up</p><input></form><footer>&copy; Site. All rights reserved.</footer></body></html>"""
    assert ht.extract(model, page) == "The title\nFirst paragraph of the story, which has a few words.\nSecond paragraph, with a link inside it.\nShort."


def test_table(spark, model):
    long = "<article>" + "".join(f"<p>Paragraph number {k} of a very long page.</p>" for k in range(20_000)) + "</article>"
    rows = [(1, "http://a/", None, "c"), (2, None, "", "c"), (3, "u", "<nav><a>x</a></nav>", "c"), (None, "u", "<article><p>Text of it.</p></article>", "c"), (5, "v", long, "c"), (5, "v", long, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = ht.extract_table(df, model).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == "" and by[None].text == "Text of it."
    assert by[5].text.count("\n") == 19_999
    assert ht.extract_table(df.where("false"), model).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p>a <a href="/en/hidden-gems">link text</a> b</p>', ["a link text b"]),
        ('<p title="The hidden valley">t</p>', ["t"]),
        ("<article data-hidden='false' data-id=hidden><p>whole</p></article>", ["whole"]),
        ('<p title="x style=\'display:none\' hidden">t</p><p data-x="aria-hidden=true">u</p>', ["t", "u"]),
        ("<p class='a hidden-xs' ID=hidden>t</p>", ["t"]),
        ('<p class="x"hidden>no</p><p HIDDEN="">no</p><p style="color:red; Display : none">no</p><p aria-hidden="true">no</p>yes', ["yes"]),
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p><noscript><p>c</p></noscript><object data=x><p>d</p></object>e", ["a x=1 b", "c", "d", "e"]),
    ],
)
def test_attributes_are_read_one_by_one(page, want):
    assert lines(page) == want


def test_names_give_hints_and_values_do_not():
    assert ht._hints(' data-class="ad" title="class=sidebar" CLASS = "nav x" id=footer') == {"nav", "foot"}
