"""Sum-product against enumeration, written pages, and the table's articles."""

import html
import itertools
import re

import numpy as np

from textmill.llm import html_model as H
from textmill.llm.queries import QUERIES

PAGE = """<html><head><title>x</title><style>p{}</style></head><body><header class="site-header"><a href="/">Site</a>
<nav><a href="/1">One</a></nav></header><div class="cookie-banner">We use cookies to make this site better.<button>OK</button></div>
<main><article><h1>Title&nbsp;here</h1><p>First  paragraph &lt;of&gt;
text with <b>a few</b> words in it.<div class="ad">Buy now, the best ads in the town.</div><p>Second one, and it goes on
for a while so that it is long.</p><ul><li>point one<li>point two</ul><script>var t = "</p>";</script><form><button>Go</button>
Enter your mail address here.</form></article><aside>Related stories: here and there.</aside><section id="comments"><h3>Comments</h3>
<div class="comment"><p>I liked this a lot, thank you for writing it down.</p></div></section></main>
<div class="sidebar"><p>Popular posts of the week are listed here.</p></div><footer>Copyright 2020</footer></body></html>"""


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(10):
        n = 9
        parent = np.array([-1, *[rng.integers(0, i) for i in range(1, n)]], np.int32)
        t = H.Tree(parent, rng.integers(0, H.N_FEATURES, (n, len(H._SIZES))).astype(np.int16), rng.integers(0, 2, n).astype(np.int8), [])
        f = H.forest([t, t])
        unary, pair = rng.normal(size=n), rng.normal(size=(2, 2, 2))
        p, joint = H.sum_product(f, np.tile(unary, 2), pair)
        total, one, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for x in itertools.product((0, 1), repeat=n):
            s = np.exp(sum(unary[i] * x[i] for i in range(n)) + sum(pair[t.bound[i], x[parent[i]], x[i]] for i in range(1, n)))
            total += s
            one += s * np.array(x)
            for i in range(1, n):
                both[i, x[parent[i]], x[i]] += s
        assert np.allclose(p[:n], one / total) and np.allclose(p[n:], one / total)
        assert np.allclose(joint[1:n], both[1:] / total)


def test_written_pages_are_learnt():
    trees = [H.page_tree(h, "marks") for h in H.labelled_pages()]
    model = H.train_pages()
    f = H.forest(trees)
    labels = np.concatenate([t.labels for t in trees])
    known = labels >= 0
    assert ((model.marginals(f) > 0.5) == labels)[known].mean() > 0.97


def want(page):
    a = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", a)).split())


def test_every_article_of_the_table(spark):
    sf = "/root/testdata/sf0.1"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op6_html_model"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == want(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_page_with_every_kind_of_block(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = H.train_pages(pages)
    got = model.texts([PAGE, None, "", "<p", "<article>" * 3000 + "deep", "<article>bare <b>bold</b> &amp; x<p>p",
                       "<article>" + "<p>long text here.</p>" * 5000])
    assert got[0] == ("Title here First paragraph <of> text with a few words in it. Second one, and it goes on for a while "
                      "so that it is long. point one point two")
    assert got[1:3] == ["", ""] and got[5] == "bare bold & x p" and got[6] == " ".join(["long text here."] * 5000)
    df = spark.createDataFrame([(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (None, None, None, None)],
                               "page_id long, url string, html string, text string")
    out = H.extract_text(df, model)
    assert out.columns == ["page_id", "url", "html", "text"]
    assert sorted(r.text for r in out.collect()) == ["", got[0], got[0]]
    assert H.extract_text(df.limit(0), model).count() == 0


STORY = ["The harbour was quiet when we reached it, and the boats lay low in the water under a grey sky.",
         "Nobody had told the crew that the bridge would stay closed until spring, so they waited for three days.",
         "In the end a farmer took them across, one at a time, in a cart that had seen better roads than this."]
PARTS = "".join(f"<p>{x}</p>" for x in STORY)
LINKS = "".join(f'<li><a href="/{i}">What to read on day {i}</a></li>' for i in range(5))


def test_what_stands_for_media_stays():
    model = H.train_pages()
    page = (f"<html><head><title>x</title><noscript><p>Head.</p></noscript></head><body><article><h1>T</h1><p>{STORY[0]}"
            f"<noscript>A picture of <b>it</b>.</noscript></p><p><video src=v><source src=w>A film.</video> {STORY[1]}</p><noscript><p>{STORY[2]}"
            "</p></noscript><iframe>frame</iframe></article></body></html>")
    assert model.texts([page]) == [f"T {STORY[0]}A picture of it. A film. {STORY[1]} {STORY[2]}"]


def test_hint_words_are_no_verdicts(spark):
    """Shapes that the fit does not hold, with other texts: the whole article."""
    model = H.train_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    nav = f"<nav><ul>{LINKS}</ul></nav>"
    foot = "<footer><p>Copyright 2021 The Harbour Post.</p></footer>"
    title, story = "<h1>Across the river</h1>", " ".join(STORY)
    whole = f"Across the river {story}"
    pages = {
        f'{nav}<div class="post more-stories">{title}{PARTS}</div>{foot}': whole,
        f'{nav}<div class="widget text">{title}{PARTS}</div>{foot}': whole,
        f'<table><tr><td><ul>{LINKS}</ul></td><td>{title}{PARTS}</td></tr></table>{foot}': whole,
        f'{nav}<article>{title}<div class="text more">{PARTS}</div></article>{foot}': whole,
        f'{nav}<article>{title}{PARTS}<section class="related work"><h2>Other crossings</h2>{PARTS}</section></article>{foot}':
            f"{whole} Other crossings {story}",
        f'{nav}<article>{title}<div class="message">{PARTS}</div>{PARTS}</article>{foot}': f"{whole} {story}",
        f'{nav}<main><article class="entry">{title}{PARTS}<div class="related"><h3>Related</h3><ul>{LINKS}</ul></div></article></main>{foot}': whole,
        f'{nav}<article>{title}{PARTS}</article><div class="popular widget"><ul>{LINKS}</ul></div>{foot}': whole,
        f'{nav}<div class="ads">{STORY[0]}</div><article>{title}{PARTS}</article><div class="cookie-consent"><p>{STORY[1]}</p></div>{foot}': whole,
        f'{nav}<article>{title}{PARTS}</article><section id="comments"><div class="comment"><p>{STORY[2]}</p></div></section>{foot}': whole,
    }
    got = model.texts([f"<html><head><title>t</title></head><body>{p}</body></html>" for p in pages])
    assert got == list(pages.values())


def test_a_head_without_its_end_tag():
    model = H.train_pages()
    text = H._LONG.strip()
    body = f"<article><h1>Title</h1><p>{text}</p></article>"
    whole = f"Title {text}"
    heads = ["<head><title>x</title><body>", "<head><title>x</title><meta charset=utf-8><link rel=icon href=i>",
             "<head><title>x</title><style>p{}</style><script>var a = '<p>';</script><body class=post>",
             "<head><noscript><img src=i><p>No script.</p></noscript><template><p>Later.</p></template><title>x</title>",
             "<head><base href=/><title/><head><body>", "<head><title>x<body>", "<head><title>x</head><body>",
             "<head><img src=i><title>x</title></head><body>", "<head><title>x</title></head><body>", "<head></body>"]
    got = model.texts([f"<html>{h}{body}</html>" for h in heads] + [f"{h}{body}" for h in heads])
    assert got == [whole] * 2 * len(heads)
    assert [t for _, t in H.page_tree("<html><head><title>x</title>Bare &amp; whole").runs] == ["Bare & whole"]


def test_formulas_and_fallback_text_stay():
    model = H.train_pages()
    text = H._LONG.strip()
    page = (f"<html><head><title>x</title></head><body><article><h1>Title</h1><p>{text} So <math><mrow><mi>a</mi><mo>=</mo><mn>2</mn>"
            f"</mrow></math> holds.</p><p><object data=f><param name=a value=b>A map of the <b>old</b> town.</object> {text}</p>"
            f"<object><p>{text}</p></object></article></body></html>")
    assert model.texts([page]) == [f"Title {text} So a=2 holds. A map of the old town. {text} {text}"]
