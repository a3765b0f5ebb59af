import random
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from txscore.llm import html_text

SCHEMA = "page_id long, url string, html string, hash long, salt string, n_chars string"


def words(r, n, vocabulary=40):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (page("<nav>menu</nav><article><h1>T &amp; t</h1><p>a  b\n c<p><b>d<br>e</b></article><footer>f</footer>"), "T & t\na b c\nd e"),
        (page("<header>h</header><main><p>x</p><aside>s</aside><form>f</form></main>"), "x"),
        (page("<div class='sidebar'>s</div><div class=content><p>x</p><div id=comments>c</div></div>"), "x"),
        (page("<p>a</p><script>var t='</p>';</script><style>p{}</style><!-- c --><p>b &lt;i&gt; &#x41;&nbsp;z</p>"), "a\nb <i> A z"),
        (page("<article><p>1 < 2 and 3 > 2</p><p hidden>no</p><p style='display: none'>no</p></article>"), "1 < 2 and 3 > 2"),
        (page("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article><article class='comment'><p>no</p></article>"), "a\nb\nc\nd"),
        (page("<article class='post-content'><header><h1>T</h1></header><div class='share-buttons'>s</div><p>x</p></article>"), "T\nx"),
        ("plain text", "plain text"),
        ("", ""),
        (None, ""),
        ("<p>unclosed <b>x <a href='", "unclosed x"),
        (page("<script>never closed"), ""),
    ],
)
def test_page_text(source, text):
    assert html_text.Page(source or "").text({}) == text


@pytest.mark.parametrize("limit", [1000, 0])
def test_templates_go(spark, limit):
    r = random.Random(1)
    rows = []
    for k in range(30):
        top = "<div><span>Welcome to our site</span></div>" if k % 3 else "<div>own</div>"
        rows.append((k, f"https://U:p@A.com:80/{k}?x", page(f"{top}<div><p>{words(r, 9)} {k}</p></div><section><p>All rights kept.</p></section>"), "x"))
    rows += [(100, "http://b.com/", page("<div><span>Welcome to our site</span></div><p>b</p>"), "x"), (101, None, None, "x"), (102, "nonsense", page("<article><p>z</p></article>"), "x")]
    rows += [(200 + k, "http://c.com", page(f"<article><p>Every page says so {k}.</p><div>Subscribe now!</div></article>"), "x") for k in range(9)]
    rows += [(300 + k, "http://d.com", page("<article><p>One page in copies.</p><div>Its own box</div></article>"), "x") for k in range(9)]
    got = {x.page_id: x.text for x in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string"), broadcast_rows=limit).collect()}
    for k in range(30):
        assert got[k].endswith(f" {k}") and "Welcome" not in got[k] and "rights" not in got[k]
    assert got[100] == "Welcome to our site\nb" and got[101] == "" and got[102] == "z"
    assert got[200] == "Every page says so 0." and got[300] == "One page in copies.\nIts own box"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.main_text(empty).count() == 0


def test_copies_are_no_template(spark):
    r, rows = random.Random(8), []
    for k in range(30):
        own = f"<div><p>{words(r, 9)} {k}</p></div>" if k >= 10 else "<div><p>the copied page</p></div>"
        rows.append((k, "http://a.com/", page(f"{own}<section><p>All rights kept.</p></section>")))
    rows += [(100 + k, "http://b.com/", page(f"<div>{'<!-- x -->' * k}<p>same words</p></div>".replace("<div>", f"<i id=n{k}></i><div>"))) for k in range(6)]
    got = {x.page_id: x.text for x in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == "the copied page" for k in range(10))
    assert all(got[k].endswith(f" {k}") and "rights" not in got[k] for k in range(10, 30))
    assert all(got[100 + k] == "same words" for k in range(6))


@pytest.mark.parametrize(
    "source",
    [
        "<main class='content has-sidebar'><p>x</p></main>",
        "<article class='post no-comments'><p>x</p></article>",
        "<div class='content-area with-sidebar'><article><p>x</p></article></div>",
        "<div class='sidebar'><article><p>x</p></article></div>",
        "<div class='page comments-open'><p>x</p></div>",
        "<article><p>x</p></article><article class='comment'><p>no</p></article><div class='sidebar'><article><p>no</p></article></div>",
    ],
)
def test_names_keep_articles(source):
    assert html_text.Page(page(source)).text({}) == "x"
    assert html_text.Page(page("<div class='comment'><article><p>no</p></article></div>")).text({}) == ""


class Tree(HTMLParser):
    """Well-formed pages of blocks as nested tuples (tag, children)."""

    def __init__(self, source):
        super().__init__()
        self.open = [("#root", [])]
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        self.open.append((tag, []))

    def handle_endtag(self, tag):
        tag, children = self.open.pop()
        self.open[-1][1].append((tag, tuple(children)))

    def handle_data(self, data):
        if data.strip():
            self.open[-1][1].append(" ".join(data.split()))

    def tree(self):
        return "#root", tuple(self.open[0][1])


def inside(tree):
    yield tree
    for child in tree[1]:
        if not isinstance(child, str):
            yield from inside(child)


def lines(tree, gone=()):
    out = []
    for child in tree[1]:
        out += [child] if isinstance(child, str) else [] if child in gone else lines(child, gone)
    return out


def length(tree):
    return sum(len(x.replace(" ", "")) for x in lines(tree))


def brute_templates(rows):
    """The texts of pages of div, section, ul, li, p alone, with whole subtrees counted as they are."""
    trees = {k: (host, Tree(source).tree()) for k, host, source in rows}
    distinct = defaultdict(set)
    for host, tree in trees.values():
        distinct[host].add(tree)
    seen = {host: Counter(x for tree in found for x in set(inside(tree))) for host, found in distinct.items()}
    out = {}
    for k, (host, tree) in trees.items():
        n, gone = len(distinct[host]), {}
        for x in set(inside(tree)):
            share = seen[host][x] / n
            big = x[0] not in ("div", "section", "ul") or 2 * length(x) >= length(tree)
            if x[0] != "#root" and seen[host][x] >= 5 and share >= (0.5 if big else 0.1) and length(x) < length(tree):
                gone[x] = share
        text = lines(tree, gone) or lines(tree, {x for x, s in gone.items() if s > min(gone.values())}) or lines(tree)
        out[k] = "\n".join(text)
    return out


@pytest.mark.parametrize("limit", [1000, 0])
def test_templates_equal_brute_force(spark, limit):
    """Neutral names: menus, notices and shared comment boxes are known by recurrence only, in and around the article."""
    r = random.Random(11)
    menus = ["<div><ul>" + "".join(f"<li>{words(r, 2)}</li>" for _ in range(6)) + "</ul></div>" for _ in range(3)]
    notices = [f"<section><p>{words(r, 12)}</p></section>" for _ in range(4)]
    short = [f"<p>{words(r, 1, 4)}</p>" for _ in range(4)]
    rows = []
    for k in range(120):
        body = [f"<p>{words(r, r.randrange(3, 30))} own{k}</p>" for _ in range(r.randrange(1, 5))] + r.sample(short, r.randrange(3))
        r.shuffle(body)
        body.insert(r.randrange(len(body) + 1), r.choice(notices))
        rows.append((k, r.choice(["a.com", "a.com", "b.com", "c.com"]), f"{r.choice(menus)}<div>{''.join(body)}</div><div><p>the end of all pages</p></div>"))
    mirror = "<div><p>an article that six pages share in full length</p><p>and its end</p></div>"
    rows += [(200 + k, "a.com", f"{menus[0]}{mirror}{notices[k % 4]}") for k in range(6)]
    rows += [(300 + k, "a.com", rows[0][2]) for k in range(50)] + [(400, "few.com", rows[1][2]), (401, "few.com", rows[2][2])]
    table = spark.createDataFrame([(k, f"https://{h.upper()}/{k}", t, 1, "x", "y") for k, h, t in rows], SCHEMA)
    got = {x.page_id: x.text for x in html_text.main_text(table, broadcast_rows=limit).collect()}
    want = brute_templates(rows)
    assert got == want
    assert all(got[k] and "the end of all pages" not in got[k] for k in range(120))
    assert all("six pages share" in got[200 + k] for k in range(6))
    uncounted = {k: html_text.Page(t).text({}) for k, _, t in rows}
    assert sum(uncounted[k] != got[k] for k in got) > 150


def test_neutral_template_around_and_in_article_elements(spark):
    r, rows = random.Random(5), []
    for k in range(20):
        own = f"<h1>{words(r, 3)} {k}</h1><p>{words(r, 20)}</p><p>Of.</p>" if k % 4 == 0 else f"<h1>{words(r, 3)} {k}</h1><p>{words(r, 20)}</p>"
        rows.append((k, "http://a.com/", f"<div class=x1>Shop {k % 2} Basket Help</div><article>{own}<div class=q7>Liked it? Tell a friend</div></article><div class=z>loose</div>", 1, "", ""))
    got = {x.page_id: x.text for x in html_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, text in got.items():
        assert len(text.split("\n")) == (3 if k % 4 == 0 else 2) and "friend" not in text and "Basket" not in text and "loose" not in text


def test_pages_defined_cases(spark):
    same = page("<div><p>the only text</p></div>")
    rows = [(1, "http://a.com/", same, 1, "", "")] * 5 + [(None, None, same, None, None, None), (2, "http://a.com/", None, 1, "", ""), (3, "http://a.com/", "x " * 500_000, 1, "", "")]
    got = html_text.main_text(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((x.page_id or 0, x.text[:13], x.n_chars) for x in got.collect())
    assert found == [(0, "the only text", 13)] + [(1, "the only text", 13)] * 5 + [(2, "", 0), (3, "x x x x x x x", 999_999)]


@pytest.mark.parametrize(
    "source",
    [
        "<a" * 500_000,
        '<a "' * 250_000,
        '<a x=">" ' * 110_000,
        "<b>" * 150_000 + "</i>" * 150_000,
        "<i><div>" + "<b>" * 150_000 + "</i>" * 150_000,
        "<b>" * 150_000 + "<p></p>" * 70_000,
        "<div>" * 100_000 + "x" + "</div>" * 100_000,
        "<div>" * 80_000 + "<li></li>" * 60_000,
        "<!-- " * 200_000,
        "<script>" + "</script " * 110_000,
        "<article class='sidebar'>" * 40_000 + "x",
        "x<p>y</p>" * 100_000,
    ],
    ids=range(12),
)
def test_time_is_linear(source):
    """A megabyte of broken markup; the limit is for slow machines, a quadratic scan takes minutes."""
    began = time.time()
    read = html_text.Page(source)
    read.candidates()
    read.text({1: 1.0})
    assert time.time() - began < 20


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<article><h1 class='header'>T</h1><p class='search'>x</p><p class='newsletter'>no</p></article>", "T\nx"),
        ("<main><h1>T</h1><p>a long text of the page</p><article>teaser</article></main>", "T\na long text of the page\nteaser"),
        ("<div><p>the long text of an article without an element of that name, and more of it</p><article>teaser</article></div>", "the long text of an article without an element of that name, and more of it\nteaser"),
        ("<ul><li>a<div>b</div><li>c</ul><table><tbody><tr><td>d<tr><td>e<tbody><tr><th>f</table>g", "a\nb\nc\nd\ne\nf\ng"),
        ("<p>a<!--> b <!-- c --!> d<p x=a'b>e</p>", "a b d\ne"),
        ("<p title='a > b'>x</p><p title=\"it's\">y</p>", "x\ny"),
        ("a <3 b</ c>d", "a <3 bd"),
    ],
)
def test_page_rules(source, text):
    assert html_text.Page(source).text({}) == text
