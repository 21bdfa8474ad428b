import time
from itertools import product

import numpy as np
import pytest

from loomgrid.llm import labelled_pages
from loomgrid.llm.dom import blocks
from loomgrid.llm.html_crf import Crf, extract, features, fitted, labelled, main_text, train, trained


def texts(html):
    return [b.text for b in blocks(html)]


def test_blocks():
    assert texts("<p>a <b>b</b>\n c<br>d<p>e &amp; &lt;f&gt; &copy;&#233;</p>g") == ["a b c d", "e & <f> ©é", "g"]
    assert texts("<script>var a='<p>no</p>'</script><style>p{}</style><p title='a>b'>yes</p><!-- <p>no</p> -->") == ["yes"]
    assert texts("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>") == ["one", "two", "x", "y"]
    assert texts("<div hidden><p>no</p></div><p style='display: none'>no</p><p>yes") == ["yes"]
    assert texts("") == texts("<p>  </p>") == [] and texts("plain") == ["plain"]
    assert texts("a < b and c") == ["a < b and c"]
    assert texts("<p>open <b") == ["open"]
    assert len(texts("<div>" * 3000 + "deep")) == 1


def test_held_out_accuracy():
    crf = trained()
    wrong = total = 0
    for seed in range(50_000, 50_200):
        found, labels = labelled(seed)
        wrong += sum(a != b for a, b in zip(crf.decode(found), labels))
        total += len(labels)
    assert wrong <= 0.02 * total


def test_viterbi_is_brute_force():
    crf = trained()
    for seed in range(60_000, 60_030):
        found = labelled(seed)[0][:9]
        scores = crf.scores(found)
        value = lambda path: sum(scores[k][y] for k, y in enumerate(path)) + sum(crf.move[a][b] for a, b in zip(path, path[1:]))
        best = max(product((0, 1), repeat=len(found)), key=value)
        assert abs(value(crf.decode(found)) - value(best)) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>No</title></head><body><header><p>Site</p></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site.</p></div><article><h1>The headline of it all</h1><p>First   paragraph of the story, with enough words.</p><div class="ad">Buy this now!</div>
<p>Second &quot;paragraph&quot; of the story follows here.</p></article><aside class="sidebar"><h3>Related</h3><ul><li><a href=/x>Other story</a></li></ul></aside>
<section id="comments"><h2>Comments</h2><div class="comment"><p>Great story, thanks!</p></div></section><form><label>Mail</label><button>Go</button></form><footer><p>&copy; 2020 Site</p></footer></body></html>"""


def test_page():
    assert main_text(PAGE, trained()) == 'The headline of it all\nFirst paragraph of the story, with enough words.\nSecond "paragraph" of the story follows here.'


def test_edges(spark):
    rows = [(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "u", "", "t"), (1, "u", PAGE, "t"), (3, "u", "<nav>only</nav>", "t"), (4, "u", "<article>" + "<p>word and more words of the story.</p>" * 5000 + "</article>", "t")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 6
    told = {r.page_id: r.text for r in got}
    assert told[2] == told[3] == told[None] == "" and told[4].count("\n") == 4999
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_features_are_bounded():
    found = blocks(PAGE)
    assert all(0 <= f < 1 << 13 for k, b in enumerate(found) for f in features(b, k, len(found)))


def test_stray_quotes_end_with_their_tag():
    rest = "<p>more of the story here</p>" * 300
    for tag in ("<a href=/x title=Don't>", '<img alt="5" screen">', "<p class=a'>", '<p ">', "<p '>", '<p title = 5">', '<div data-x="a"b\'>', "<p a=\"b\" 'c>", '<p id="">', "<p x=>"):
        assert texts(f"<p>start</p>{tag}next</p>{rest}") == ["start", "next", *["more of the story here"] * 300], tag
    assert texts("<p>start</p><p title='a>b' alt = \"c>d\">next</p>") == ["start", "next"]
    assert texts('<p>start</p><p title="open>next</p><p>last</p>') == ["start", "next", "last"]


#: Pages written and labelled by hand: the page, and its article.
BY_HAND = {
    "bare body": (
        "<html><body bgcolor=white><a href=a.html>Home</a> | <a href=b.html>Links</a><hr><h2>How to prune a pear tree</h2>Cut the dead wood first, then look at the crown from below.<br><br>Never take more than a third of it in one year.<hr><small>Copyright 1999 J. Miller</small></body></html>",
        "How to prune a pear tree\nCut the dead wood first, then look at the crown from below. Never take more than a third of it in one year.",
    ),
    "text alone": ("The whole page is a single line of text, with no markup at all around it.", "The whole page is a single line of text, with no markup at all around it."),
    "layout table": (
        "<html><body><table width=760><tr><td colspan=2>The Harbour Gazette</td></tr><tr><td width=140><a href=1>Home</a> <a href=2>News</a> <a href=3>Tides</a></td><td><h1>Ferry returns to service</h1><p>The ferry sailed again on Monday, after three weeks in the dock.</p><p>Tickets cost what they cost before.</p></td></tr><tr><td colspan=2>&copy; 2004 Harbour Gazette. All rights reserved.</td></tr></table></body></html>",
        "Ferry returns to service\nThe ferry sailed again on Monday, after three weeks in the dock.\nTickets cost what they cost before.",
    ),
    "blog": (
        '<body><div id="wrapper"><div id="header"><h1><a href="/">Tin Whistle Notes</a></h1><div class="tagline">tunes and more</div></div><div id="main"><div class="post"><h2 class="entry-title">A reel in D</h2><div class="entry-content"><p>This one comes from a session in Clare, played slowly.</p><p>Mind the roll in the second part, which is easy to rush.</p></div></div><div id="comments"><h3>2 Comments</h3><div class="comment"><p>Lovely, thank you for this!</p></div></div></div><div id="sidebar"><h3>Archives</h3><ul><li><a href="/a">May</a></li><li><a href="/b">June</a></li></ul></div><div id="footer"><p>Copyright 2011 Tin Whistle Notes</p></div></div></body>',
        "A reel in D\nThis one comes from a session in Clare, played slowly.\nMind the roll in the second part, which is easy to rush.",
    ),
    "news": (
        '<body><header class="site-header"><p>Daily Observer</p></header><nav class="menu"><ul><li><a href=/w>World</a></li><li><a href=/s>Sport</a></li></ul></nav><div class="cookie-banner notice"><p>We use cookies to improve this site.</p><button>Accept</button></div><main><article><h1>Council votes for the new bridge</h1><p class="standfirst">Work is to begin in autumn and to last two years.</p><p>The vote was close, and came after a long evening of speeches.</p><div class="advert"><p>Buy one, get one free.</p></div><p>Opponents said that they would appeal.</p></article></main><aside class="related"><h3>More stories</h3><ul><li><a href=/1>Storm on the coast</a></li></ul></aside><footer><p>&copy; 2022 Daily Observer</p></footer></body>',
        "Council votes for the new bridge\nWork is to begin in autumn and to last two years.\nThe vote was close, and came after a long evening of speeches.\nOpponents said that they would appeal.",
    ),
    "wiki": (
        '<body><div id="content" role="main"><h1 id="firstHeading">Lapwing</h1><div id="bodyContent"><p>The lapwing is a wading bird of open country, known for its call.</p><div id="toc" class="toc"><h2>Contents</h2><ul><li><a href="#1">Habitat</a></li><li><a href="#2">Food</a></li></ul></div><h2>Habitat</h2><p>It breeds on short grass and on farmland in spring.</p><h2>Food</h2><p>Worms and insects, mostly taken at night when the moon is full.</p></div><div id="catlinks" class="catlinks"><ul><li><a href=/c>Birds</a></li></ul></div></div><div id="navigation" role="navigation"><h3>Tools</h3><ul><li><a href=/r>Recent changes</a></li></ul></div><div id="footer"><ul><li>Copyright 2009 by the authors</li></ul></div></body>',
        "Lapwing\nThe lapwing is a wading bird of open country, known for its call.\nHabitat\nIt breeds on short grass and on farmland in spring.\nFood\nWorms and insects, mostly taken at night when the moon is full.",
    ),
    "boxes": (
        '<body><div class="c1"><div class="c7"><li><a href=/>Start</a></li><li><a href=/p>Prices</a></li><li><a href=/k>Contact</a></li></div><div class="c9"><div class="c4"><h1>Why bread rises</h1><p>Yeast eats the sugar in the flour and gives off gas as it does so.</p><p>The gas is caught in the dough, which grows until the oven sets it.</p></div></div><div class="c8">&copy; 2016 Mill &amp; Oven</div></div></body>',
        "Why bread rises\nYeast eats the sugar in the flour and gives off gas as it does so.\nThe gas is caught in the dough, which grows until the oven sets it.",
    ),
    "manual": (
        '<body><div class="sidebar"><ul><li><a href=#i>Install</a></li><li><a href=#u>Use</a></li></ul></div><div class="document"><h1>Install</h1><p>Unpack the archive and run the script that lies in it.</p><pre>sh setup.sh --prefix=/opt</pre><h2>Use</h2><p>Start the server and open its page in a browser.</p></div><div class="pager"><div><a href=/p>Previous</a></div><div><a href=/n>Next</a></div></div></body>',
        "Install\nUnpack the archive and run the script that lies in it.\nsh setup.sh --prefix=/opt\nUse\nStart the server and open its page in a browser.",
    ),
}


@pytest.mark.parametrize("name", BY_HAND)
def test_pages_labelled_by_hand(name):
    html, article = BY_HAND[name]
    assert main_text(html, trained()) == article


def accuracy(crf, layouts, seeds):
    told = [labelled(seed, layouts) for seed in seeds]
    right = sum(a == b for found, labels in told for a, b in zip(crf.decode(found), labels, strict=True))
    return right / sum(len(labels) for _, labels in told)


@pytest.mark.parametrize("left_out", ["blog", "news", "wiki", "tables"])
def test_layouts_that_were_not_trained_on(left_out):
    own = getattr(labelled_pages, left_out)
    crf = fitted(200, tuple(x for x in labelled_pages.LAYOUTS if x is not own))
    assert accuracy(crf, (own,), range(70_000, 70_060)) >= 0.8


def test_training_climbs_the_brute_force_likelihood():
    pages = [(f[:6], y[:6]) for f, y in (labelled(seed) for seed in range(12))]

    def likelihood(crf):
        total = 0.0
        for found, labels in pages:
            scores = crf.scores(found)
            value = lambda path: sum(scores[k][y] for k, y in enumerate(path)) + sum(crf.move[a][b] for a, b in zip(path, path[1:]))  # noqa: B023, E731
            total += value(labels) - np.log(sum(np.exp(value(p)) for p in product((0, 1), repeat=len(found))))
        return total

    # a step from nothing goes up the slope that differences of the brute-force likelihood give
    nothing = Crf(np.zeros((1 << 13, 2)), np.zeros((2, 2)))
    one = train(pages, rounds=1, decay=0.0)
    rng = np.random.default_rng(1)
    used = sorted({f for found, _ in pages for one_ in found for f in one_})
    for f in rng.choice(used, 12, replace=False):
        for label in (0, 1):
            up = np.zeros((1 << 13, 2))
            up[f, label] = 1e-5
            slope = (likelihood(Crf(up, nothing.move)) - likelihood(nothing)) / 1e-5
            assert abs(slope) < 1e-3 or np.sign(slope) == np.sign(one.state[f, label])
    for a, b in product((0, 1), repeat=2):
        up = np.zeros((2, 2))
        up[a, b] = 1e-5
        slope = (likelihood(Crf(nothing.state, up)) - likelihood(nothing)) / 1e-5
        assert abs(slope) < 1e-3 or np.sign(slope) == np.sign(one.move[a, b])
    assert likelihood(train(pages, rounds=40, decay=0.0)) > likelihood(one) > likelihood(nothing)


@pytest.mark.parametrize("html", ["<div>" * 200_000, "<div>x" * 50_000, "<p><button>" + "<div>" * 150_000, "<a>" * 150_000 + "</b>" * 150_000, "<li><p>" * 100_000, "<ul><li>" * 50_000])
def test_deep_pages_take_linear_time(html):
    start = time.perf_counter()
    found = blocks(html)
    assert len([features(b, k, len(found)) for k, b in enumerate(found)]) in (0, 50_000)
    assert time.perf_counter() - start < 10


def test_the_shipped_weights_are_those_of_the_recipe():
    again = fitted()
    assert np.allclose(again.state, trained().state, atol=1e-3) and np.allclose(again.move, trained().move, atol=1e-3)
