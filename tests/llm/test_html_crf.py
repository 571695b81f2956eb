import html as entities
import random
from collections import Counter
from html.parser import HTMLParser

import numpy as np

from quillmark.llm.html_crf import _aligned, extract, features, fit, labelled_pages, leaf_blocks, train

SCHEMA = "page_id long, url string, html string, text string, n_chars int"
PAGE = (
    '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";</script></head>'
    '<body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy this now.</div>'
    "<article><h1>The &eacute;tude&amp;co</h1><p><b>First part\n of   the text here, with <i>it</i>s words.<br><p>Second paragraph &lt;b&gt; of the article, long enough.</p>"
    '<div class="comments"><h3>Comments</h3><p>I read this and did not like it at all.</p></div></article>'
    "<footer>&copy; m.example.com &middot; All words of the footer.</footer>"
)


def test_blocks():
    texts = [b.text for b in leaf_blocks(PAGE)]
    assert texts[3:6] == ["The étude&co", "First part of the text here, with its words.", "Second paragraph <b> of the article, long enough."]
    assert leaf_blocks(None) == leaf_blocks("") == leaf_blocks("<p></p><!-- x") == leaf_blocks("<scr") == []
    assert [b.text for b in leaf_blocks("a < b <p>c</p> d<br/>e <a href='x>y'>f</a>g&am")] == ["a < b", "c", "d", "e fg&am"]
    assert len(leaf_blocks("<p>x " * 20000)) == 20000


def test_tags_are_read_as_html():
    texts = lambda page: [b.text for b in leaf_blocks(page)]
    assert texts("<p title=it's>Hello it's a day</p><p>more</p>") == ["Hello it's a day", "more"]
    assert texts("<script src=/a/>var x=1;</script><p>text") == ["text"]
    assert texts('<script src="a"/>var x=1;</script>text') == ["text"]
    assert texts("a<!-- c --!>b<!-->c<!--->d<!-- - -- >e-->f") == ["abcdf"]
    assert texts("<p a='x>y' b=\"'>\" c=d>e</p><? x > y </3>z<a b='") == ["e", "y z"]
    assert texts("<svg><path/><text>no</text></svg>yes<svg/>too<video>no<div>no</div></video>end") == ["yes", "too", "end"]
    assert "no" not in " ".join(texts("<svg><svg>no</svg>no</svg>yes<video>no<div>no</div></video>end"))
    assert texts("x &lt;p&gt; &#233;&eacute &am") == ["x <p> éé &am"]
    assert texts("1 < 2 <3 and a<b c=d>e") == ["1 < 2 <3 and ae"]
    linked = leaf_blocks("<a href=/x/>here</a> there")[0]
    assert linked.links == 4


class Plain(HTMLParser):
    """Text of a page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_same_text_as_another_parser():
    rng = random.Random(4)
    bits = ["<p>", "</p>", "<div class=x>", "</div>", "<b>", "</b>", "<br>", "<br/>", "<a href='/a>b'>", "</a>", '<i title="it\'s">', "</i>", "<!-- c > d -->", "<img alt=it's>", "<script>if (a<b) '</p>'</script>", "&amp;", "&lt;x&gt;", "&eacute;"]
    for _ in range(400):
        page = "".join(rng.choice(bits) if rng.random() < 0.6 else rng.choice(["word ", "it's ", "a < b ", "1>2 ", "é\n"]) for _ in range(rng.randint(1, 40)))
        other = Plain()
        other.feed(page)
        other.close()
        mine = "".join("".join(b.text for b in leaf_blocks(page)).split())
        assert mine == "".join("".join(other.out).split()), page


#: Pages of other hands: (html, main text), none with an article element.
OTHER_MARKUP = [
    (
        '<html><body><div id="top-nav"><a href="/">Home</a> | <a href="/about">About</a></div><div class="post-content"><h2>A walk along the river</h2>'
        "<p>We started early, before the fog had lifted, and followed the old towpath for about an hour.</p><p>By noon the sun was out, and the boats had begun to move again; nobody was in a hurry.</p></div>"
        '<div class="sidebar"><h4>Recent posts</h4><ul><li><a href="/1">Bread</a></li><li><a href="/2">Tea</a></li></ul></div><div id="footer">Copyright 2020, all rights reserved.</div></body></html>',
        "A walk along the river We started early, before the fog had lifted, and followed the old towpath for about an hour. By noon the sun was out, and the boats had begun to move again; nobody was in a hurry.",
    ),
    (
        '<html><body><header><span class="logo">The Daily</span></header><main><h1>Council votes on bridge</h1><p>The council voted on Tuesday to repair the bridge, which has been closed since the flood in March.</p>'
        '<div class="share"><a href="#">Share</a></div><p>Work will begin next month and take until autumn, the mayor said.</p></main>'
        '<section class="comments"><h3>Comments</h3><p>About time they did something about it.</p><p>I do not believe it.</p></section><footer><p>Subscribe to our newsletter.</p></footer></body></html>',
        "Council votes on bridge The council voted on Tuesday to repair the bridge, which has been closed since the flood in March. Work will begin next month and take until autumn, the mayor said.",
    ),
    (
        '<body><ul class="menu"><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul><div class="cookie-notice"><p>We use cookies to make this site better.</p></div>'
        '<div class="entry-content"><p>Boil the potatoes in salted water until they are soft, then drain them well.</p><p>Mash them with butter and warm milk, and season with salt and nutmeg.</p></div>'
        '<form class="search"><label>Search</label><input name="q"></form><div class="related"><p><a href="/c">More recipes</a></p></div></body>',
        "Boil the potatoes in salted water until they are soft, then drain them well. Mash them with butter and warm milk, and season with salt and nutmeg.",
    ),
]


def test_pages_of_other_hands():
    chain = fit([a for a in (_aligned(*p) for p in labelled_pages()) if a])
    hit = found = wanted = 0
    for page, want in OTHER_MARKUP:
        got = Counter(chain.main_text(page).split())
        want = Counter(want.split())
        hit, found, wanted = hit + (got & want).total(), found + got.total(), wanted + want.total()
    assert hit / found > 0.9 and hit / wanted > 0.9


def test_held_out_accuracy():
    train_set = [a for a in (_aligned(*p) for p in labelled_pages(300, 1)) if a]
    held = [a for a in (_aligned(*p) for p in labelled_pages(200, 99)) if a]
    assert len(train_set) > 280 and len(held) > 180
    chain = fit(train_set)
    right = total = 0
    for blocks, gold in held:
        got = chain.viterbi(blocks)
        right += sum(a == b for a, b in zip(got, gold, strict=True))
        total += len(gold)
    assert right / total > 0.97


def test_viterbi_is_the_best_path():
    chain = fit([a for a in (_aligned(*p) for p in labelled_pages(40, 5)) if a], epochs=15)
    for page, _ in labelled_pages(25, 6):
        blocks = leaf_blocks(page)[:9]
        e = chain.emissions(blocks)
        assert len(e) == len(features(blocks))
        score = lambda y: sum(e[t][v] for t, v in enumerate(y)) + sum(chain.step[a][b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        every = [[n >> t & 1 for t in range(len(blocks))] for n in range(1 << len(blocks))]
        assert np.isclose(score(chain.viterbi(blocks)), max(map(score, every)))


def test_query(spark):
    rows = [(1, "u", PAGE, "x", 1), (2, None, None, "", 0), (None, "v", "", "", 0), (1, "u", PAGE, "x", 1), (3, "w", "<article><p>" + "Long words, here. " * 20000, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    chain = train(df)
    got = extract(df, chain).collect()
    want = "The étude&co First part of the text here, with its words. Second paragraph <b> of the article, long enough."
    assert sorted((r["id"] or 0, r["text"]) for r in got) == sorted([(1, want), (1, want), (2, ""), (0, ""), (3, ("Long words, here. " * 20000).strip())])
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract(spark.createDataFrame([], SCHEMA), chain).count() == 0
    assert entities.unescape("&eacute;") in want
