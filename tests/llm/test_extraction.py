"""HTML extraction on labelled pages that training never saw, and on odd markup."""

import pytest
from chronoloom.llm import extraction
from chronoloom.llm.html_blocks import blocks
from chronoloom.llm.html_labels import labelled_pages


@pytest.fixture(scope="module")
def crf():
    return extraction.train(labelled_pages(extraction.N_PAGES, invented=extraction.INVENTED))


def text(page, crf):
    return extraction.main_text(page, crf)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{color:red}</style><script>var a = "</p>";</script></head><body>
<header><div class="logo">Site name</div></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p></div><!-- ad --><div class="ad">Buy now.</div>
<article><h1>The   title</h1><p>First <b>bold
 text</b> &eacute; &#233; &lt;b&gt;.<br>Same block.</p><p>Second <a href="#">link</a> one.<div class="advert">Advert inside.</div><ul><li>Item one here.<li>Item two here.</ul>
<form><input><label>Your mail</label></form></article>
<aside class="sidebar"><p>Related story.</p></aside><section id="comments"><div class="comment"><p>Nice read!</p></div></section>
<footer>&copy; Owner</footer></body></html>"""


def test_page(crf):
    assert text(PAGE, crf) == "The title\n\nFirst bold text é é <b>. Same block.\n\nSecond link one.\n\nItem one here.\n\nItem two here."


def test_labelled_pages_of_another_seed(crf):
    right = total = whole = 0
    pages = labelled_pages(300, seed=42)
    for page, labels in pages:
        found = blocks(page)
        assert len(found) == len(labels)
        states = crf.decode(found)
        right += sum(a == b for a, b in zip(states, labels, strict=True))
        total += len(labels)
        whole += states == labels
    assert right / total > 0.99 and whole / len(pages) > 0.9


def test_pages_whose_class_words_are_unknown(crf):
    """Every class and id is an invented word, so that element names, links and the text itself must do."""
    right = total = 0
    for page, labels in labelled_pages(300, seed=43, invented=1.0):
        states = crf.decode(blocks(page))
        right += sum(a == b for a, b in zip(states, labels, strict=True))
        total += len(labels)
    assert right / total > 0.95


@pytest.mark.parametrize(
    "page",
    ["", "   ", "plain text", "<", "<p", "<p>a<p>b", "<!-- never closed <p>x</p>", "<script>never closed", "</div></p>", "<p class='a>b</p>", "<a><b><i>x", "<p>&#xD800;&#0;&bogus;&amp</p>", "<table><tr><td>1<td>2<tr><td>3", "<![CDATA[x]]><p>y", "<p hidden>x</p>"],
)
def test_broken_markup_never_raises(crf, page):
    assert isinstance(text(page, crf), str)


def test_hidden_parts_and_void_elements():
    found = [b.text for b in blocks("<p>a<img src=x>b</p><div style='display:none'>no</div><div hidden><p>no</p></div><p>c<wbr>d</p><template>no</template><br/>e")]
    assert found == ["ab", "cd", "e"]


def test_viterbi_is_the_best_sequence(crf):
    import itertools

    import numpy as np

    page = blocks(PAGE)[:9]
    scores = crf.scores(page)

    def value(states):
        return sum(scores[i, s] for i, s in enumerate(states)) + sum(crf.move[a, b] for a, b in itertools.pairwise(states))

    best = max(itertools.product((0, 1), repeat=len(page)), key=value)
    assert np.isclose(value(best), value(crf.decode(page)))


def test_extract_edges(spark, crf):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", PAGE, "x", "y"), (1, "u", PAGE, "x", "y"), (2, None, None, None, None), (None, "v", "", "", ""), (3, "w", "<article>" + "<p>word word.</p>" * 20_000, "", "")]
    found = extraction.extract(spark.createDataFrame(rows, schema), crf).collect()
    assert [f.page_id for f in found] == [1, 1, 2, None, 3] and found[0].text == found[1].text and found[0].n_chars == len(found[0].text)
    assert (found[2].text, found[2].n_chars, found[2].url) == ("", 0, None) and found[4].text.split("\n\n") == ["word word."] * 20_000
    assert extraction.extract(spark.createDataFrame([], schema), crf).isEmpty()


def test_articles_of_the_table(spark, sf_dir, crf):
    import html
    import re

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br[^>]*>", " ", x)))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert text(r.html, crf) == "\n\n".join(x for x in parts if x)
