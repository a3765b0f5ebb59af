"""Main text of web pages by site template removal.

Pages are read into element trees by a scanner whose work is in proportion to their length whatever the markup is. Every
subtree's hash is built from the hashes of its children, its tag and its texts, not from attributes. Spark counts on how
many different pages of its host each hash occurs, and subtrees that recur across many of them are deleted, whatever
they are called. So are loose runs of text beside blocks.

Recurrence is judged by different pages: those of a host with the same text and structure are one. Containers (and all
blocks outside of an article or main element) are template from MIN_PAGES pages and MIN_SHARE of the host's pages on;
paragraphs, headings and other small blocks of an article, which authors repeat, and subtrees with at least half of an
article's text from OFTEN of the pages on. A subtree with all of a page's text stays, and where all would go, those that
recur least stay: of a menu and an article that a few pages share it is the article.

Markup is further evidence: navigation, headers and footers of the page, asides, forms, scripts, hidden parts, and elements
whose class, id or role names a menu, an advert, a notice, a sidebar or reader comments go, though of an article's
small blocks only those with unmistakable names. The article is in the article elements if they have a
heading or a quarter of the page's text that is left, else in the main element, else in what is left.

Counts are one row for each (host, hash), dealt by page before they are added, so a large host is no hot key; the joins on
hosts are salted. The templates found are broadcast up to BROADCAST_TEMPLATES rows; beyond, each page gets its own by a join.

Defined results: null html is empty; a page without an article's text has the empty text. A null url is the host "".
Repeated rows are extracted one by one and count once. A host with fewer than MIN_PAGES different pages has no templates.
A tag or comment that the page's end cuts off is no text; from a tag on that only quotes keep from ending, quotes mean
nothing. Other columns are left out, whatever their names are.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txscore.llm._common import materialize, small_batches

#: A subtree is template if it is on so many different pages of its host at least, and on this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.1
#: The share for what authors may repeat.
OFTEN = 0.5
#: Article elements without a heading count if they hold this share of the page's text.
ARTICLE_SHARE = 0.25
BROADCAST_TEMPLATES = 200_000
#: Copies of the table of hosts, and of templates, that a join by host is dealt over.
SALTS = 16

# Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr legend".split())
DROP = frozenset("nav footer aside form script style noscript template iframe object embed applet button select textarea input svg canvas menu dialog title head audio video map datalist frame frameset noframes".split())
CONTAINER = frozenset("div section ul ol dl table aside header figure details fieldset center".split())
HEADINGS = frozenset("h1 h2 h3".split())
# Words of class, id and role names. The first ones tell of junk anywhere, the others not on small blocks of an article.
UNMISTAKABLE = frozenset("navbar navigation navigations menus submenu sidebar sidebars ads adv advert adverts advertisement advertisements adsense adslot promo promos promotion sponsor sponsored sponsors cookie cookies consent gdpr popup popups newsletter subscribe subscription signup sharing breadcrumb breadcrumbs pagination recommended recommendations comments commentlist disqus respond replies".split())
JUNK = UNMISTAKABLE | frozenset("nav menu topbar side rail ad banner banners notice notices alert modal overlay share social pager related recommend comment reply footer header masthead widget widgets toolbar skip skiplink search login complementary contentinfo copyright".split())
# A class token with one of these parts tells of a state or a layout; and tokens that name comments or adverts as a whole.
MODIFIER = re.compile(r"^(?:has|no|not|with|without|is)[-_]|[-_](?:open|opened|closed|enabled|disabled|visible|active|on|off|left|right)$")
NAMED = frozenset("comment comments commentlist ad ads adv advert adverts advertisement advertisements adsense".split())
OWN = frozenset("article post entry story content main body text".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?+")
_NAMES = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Elements that end each other, by kind: of lists, of definitions, of tables.
_KINDS = {"ul": 0, "ol": 0, "menu": 0, "li": 0, "dl": 1, "dt": 1, "dd": 1, "table": 2, "thead": 2, "tbody": 2, "tfoot": 2, "tr": 2, "td": 2, "th": 2}
_ROWS = frozenset(("tr", "td", "th"))
_ENDS = {"li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "tr": _ROWS, **dict.fromkeys(("thead", "tbody", "tfoot"), _ROWS | {"thead", "tbody", "tfoot"})}
_WALLS = frozenset("article body table td th main section div".split())


class _Open:
    """The open elements. What a closing tag asks is looked up in counts, so no tag scans elements that stay open."""

    def __init__(self):
        self.stack, self.tags = [0], ["#root"]
        self.times: dict[str, int] = {}
        #: inline elements that are open since the innermost wall
        self.inline: list[dict[str, int]] = [{}]
        #: depths of the open blocks, and of the elements of each kind
        self.blocks: list[int] = []
        self.kinds: tuple[list[int], ...] = ([], [], [])

    def push(self, e: int, tag: str) -> None:
        depth = len(self.stack)
        self.stack.append(e)
        self.tags.append(tag)
        if tag in BLOCK:
            self.times[tag] = self.times.get(tag, 0) + 1
            self.blocks.append(depth)
            if tag in _KINDS:
                self.kinds[_KINDS[tag]].append(depth)
            if tag in _WALLS:
                self.inline.append({})
        else:
            here = self.inline[-1]
            here[tag] = here.get(tag, 0) + 1

    def pop(self) -> None:
        self.stack.pop()
        tag = self.tags.pop()
        if tag in BLOCK:
            self.times[tag] -= 1
            self.blocks.pop()
            if tag in _KINDS:
                self.kinds[_KINDS[tag]].pop()
            if tag in _WALLS:
                self.inline.pop()
        else:
            self.inline[-1][tag] -= 1

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.pop()

    def close(self, tag: str) -> None:
        """A closing tag ends its element, unless none is open; an inline element only since the innermost wall."""
        if (self.times if tag in BLOCK else self.inline[-1]).get(tag, 0):
            while self.tags[-1] != tag:
                self.pop()
            self.pop()

    def before(self, tag: str) -> None:
        """Ends what an opening tag of a block ends."""
        if tag in CLOSES_P and self.blocks and self.tags[self.blocks[-1]] == "p":
            self.pop_to(self.blocks[-1])
        ends = _ENDS.get(tag)
        if ends:
            kind = self.kinds[_KINDS[tag]]
            while kind and self.tags[kind[-1]] in ends:
                self.pop_to(kind[-1])


class Page:
    """The elements of a page in order, its texts, and the hashes of its subtrees."""

    def __init__(self, source: str):
        self.tags, self.parents, self.dropped = ["#root"], [-1], [False]
        self.inside = [False]  # an article or main element
        self.hard = [False]  # dropped for itself, by tag, state or as a comment or an advert
        self.weak = [False]  # dropped by its name only, and not as a comment or an advert
        #: (element, block, text); texts of one block are one paragraph
        self.texts: list[tuple[int, int, str]] = []
        #: of each element its texts and its children, in order: places in texts, or -1 less a child's number
        self.parts: list[list[int]] = [[]]
        self._read(source)
        self._keep_articles()

    def _read(self, source: str) -> None:
        texts, parts = self.texts, self.parts
        now = _Open()
        stack = now.stack
        block, at, size, tag_at = 0, 0, len(source), _TAG
        last = source.rfind(">")

        def text(t: str) -> None:
            parts[stack[-1]].append(len(texts))
            texts.append((stack[-1], block, t))

        begin = 0  # of the text that isn't stored yet
        while True:
            at = source.find("<", at)
            if at < 0 or at + 1 >= size:
                break
            after = source[at + 1]
            if not (after.isascii() and after.isalpha() or after in "/!?"):
                at += 1
                continue
            if after == "/" and at + 2 < size and not (source[at + 2].isascii() and source[at + 2].isalpha()):
                after = "?"
            if begin < at:
                text(source[begin:at])
            begin = size
            if after in "!?":
                if source.startswith("<!--", at):
                    if source.startswith(">", at + 4) or source.startswith("->", at + 4):
                        end = source.index(">", at + 4) + 1
                    else:
                        found = _COMMENT_END.search(source, at + 4)
                        end = found.end() if found else size
                else:
                    end = source.find(">", at) + 1 or size
                begin = at = end
                continue
            if at > last:
                break
            found = tag_at.match(source, at)
            if found is None and tag_at is _TAG:
                tag_at = _PLAIN_TAG
                found = tag_at.match(source, at)
            if found is None:
                break
            begin = at = found.end()
            tag = found[2].lower()
            known_block = tag in BLOCK
            if found[1]:
                block += known_block
                now.close(tag)
                continue
            if tag == "br":
                text(" ")
                continue
            if known_block:
                block += 1
                now.before(tag)
            attributes = found[3]
            self._open(stack[-1], tag, attributes)
            if tag in RAW:
                found = _RAW_END[tag].search(source, at) if at <= last else None
                begin = at = found.end() if found else size
            elif not (tag in VOID or attributes.endswith("/") and not known_block):
                now.push(len(self.tags) - 1, tag)
        if begin < size:
            text(source[begin:])

    def _open(self, parent: int, tag: str, attributes: str) -> None:
        inside = self.inside[parent]
        junk = self._named_junk(tag, attributes, inside) if len(attributes) > 3 else 0
        hard, weak = tag in DROP or tag == "header" and not inside or junk == 2, junk == 1
        self.parts[parent].append(-1 - len(self.tags))
        self.parts.append([])
        self.tags.append(tag)
        self.parents.append(parent)
        self.hard.append(hard)
        self.weak.append(weak)
        self.dropped.append(self.dropped[parent] or hard or weak)
        self.inside.append(inside or tag in ("article", "main"))

    @staticmethod
    def _named_junk(tag: str, attributes: str, inside: bool) -> int:
        """0: no; 1: by a name; 2: hidden, or a token is the name of comments or adverts."""
        if tag in ("html", "body"):
            return 0
        out, small = 0, inside and tag not in CONTAINER
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name not in ("hidden", "aria-hidden", "style", "class", "id", "role"):
                continue
            value = (a or b or c).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                return 2
            if name in ("class", "id", "role"):
                for part in value.split():
                    if part in NAMED:
                        return 2
                    if MODIFIER.search(part):
                        continue
                    words = set(_NAMES.findall(part))
                    if small:
                        out = out or int(bool(words & UNMISTAKABLE))
                    elif words & JUNK and not words & OWN or words & {"comment", "comments", "sidebar", "ad", "ads", "related", "share"}:
                        out = 1
        return out

    def _keep_articles(self) -> None:
        """Where names would drop every article and main element, those elements and what they are in stay."""
        articles = [e for e, tag in enumerate(self.tags) if tag in ("article", "main")]
        if not articles or not all(self.dropped[e] for e in articles):
            return
        seen = set()
        for e in articles:
            while e >= 0 and e not in seen:
                seen.add(e)
                self.weak[e] = False
                e = self.parents[e]
        for e in range(1, len(self.tags)):
            self.dropped[e] = self.dropped[self.parents[e]] or self.hard[e] or self.weak[e]

    def subtrees(self) -> tuple[list[int | None], dict[int, tuple[int, int]]]:
        """Of each element its hash, or None without text; of each loose run of text, by block, (element, hash).

        From the last element to the first, so that children come before their parents and each is hashed once.
        """
        n = len(self.tags)
        hashes: list[int | None] = [None] * n
        blocky, first = [tag in BLOCK or "-" in tag for tag in self.tags], [-1] * n
        runs: dict[int, tuple[int, int]] = {}
        for e in range(n - 1, -1, -1):
            if self.dropped[e]:
                continue
            pieces: list[str] = []
            run: list[str] = []
            loose: list[tuple[int, list[str]]] = []
            mixed = False
            for p in self.parts[e]:
                if p >= 0:
                    t = " ".join(self.texts[p][2].split())
                    if not t:
                        continue
                    block, piece = self.texts[p][1], t
                else:
                    h = hashes[-1 - p]
                    if h is None:
                        continue
                    block, piece = -1 if blocky[-1 - p] else first[-1 - p], f"\1{h:x}"
                pieces.append(piece)
                if block < 0:
                    mixed = True
                    continue
                if not loose or loose[-1][0] != block:
                    loose.append((block, run := []))
                run.append(piece)
            if pieces:
                hashes[e] = xxhash.xxh3_64_intdigest("\0".join((self.tags[e], *pieces)).encode("utf-8", "surrogatepass")) - (1 << 63)
                if loose:
                    first[e] = loose[0][0]
                if mixed:
                    blocky[e] = True
                    for block, run in loose:
                        runs[block] = e, xxhash.xxh3_64_intdigest("\0".join(("#run", *run)).encode("utf-8", "surrogatepass")) - (1 << 63)
        return hashes, runs

    def candidates(self) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int]], int]:
        """(element, hash) of the subtrees that may be template, the loose runs, and the hash of the whole page."""
        hashes, runs = self.subtrees()
        found = [(e, h) for e, h in enumerate(hashes) if h is not None and self._block(e)]
        return found, runs, hashes[0] or 0

    def _block(self, e: int) -> bool:
        tag = self.tags[e]
        return (tag in BLOCK or "-" in tag) and tag not in ("html", "body", "article", "main")

    def _sizes(self, alive: list[bool], runs: frozenset[int] | set[int] = frozenset()) -> list[int]:
        out = [0] * len(self.tags)
        for e, block, t in self.texts:
            if alive[e] and block not in runs:
                out[e] += len("".join(t.split()))
        for e in range(len(out) - 1, 0, -1):
            out[self.parents[e]] += out[e]
        return out

    def _gone(self, template: Mapping[int, float]) -> tuple[dict[int, float], dict[int, float]]:
        """The elements and the runs that are template, with their shares."""
        found, runs, _ = self.candidates()
        alive = [not d for d in self.dropped]
        sizes = self._sizes(alive)
        whole = not any(tag in ("article", "main") and sizes[e] for e, tag in enumerate(self.tags))
        base = sizes[0] if whole else sum(sizes[e] for e in range(1, len(sizes)) if self.inside[e] and not self.inside[self.parents[e]])
        elements, loose = {}, {}
        for e, h in found:
            share = template.get(h)
            if share is None or sizes[e] == sizes[0]:
                continue
            inside = whole or self.inside[e]
            if inside and share < OFTEN and (self.tags[e] not in CONTAINER or 2 * sizes[e] >= base) or inside and sizes[e] >= base:
                continue
            elements[e] = share
        for block, (e, h) in runs.items():
            share = template.get(h)
            if share is not None and (share >= OFTEN or not (whole or self.inside[e])):
                loose[block] = share
        return elements, loose

    def _roots(self, sizes: list[int], alive: list[bool]) -> list[int]:
        """The elements that hold the article: outermost article elements, else main elements, else the page."""
        for wanted in ("article", "main"):
            under, found = [False] * len(self.tags), []
            headed = False
            for e in range(1, len(self.tags)):
                tag = self.tags[e]
                under[e] = under[self.parents[e]]
                if tag == wanted and not under[e] and sizes[e]:
                    found.append(e)
                    under[e] = True
                headed = headed or under[e] and tag in HEADINGS and alive[e] and sizes[e] > 0
            if found and (wanted == "main" or headed or sum(sizes[e] for e in found) >= ARTICLE_SHARE * sizes[0]):
                return found
        return [0]

    def _text(self, elements: Mapping[int, float], runs: Mapping[int, float]) -> str:
        alive = [not self.dropped[0]] * len(self.tags)
        for e in range(1, len(alive)):
            alive[e] = alive[self.parents[e]] and not self.dropped[e] and e not in elements
        sizes = self._sizes(alive, set(runs))
        kept = [False] * len(alive)
        for e in self._roots(sizes, alive):
            kept[e] = alive[e]
        for e in range(1, len(alive)):
            kept[e] = kept[e] or kept[self.parents[e]] and alive[e]
        blocks: dict[int, list[str]] = {}
        for e, block, text in self.texts:
            if kept[e] and block not in runs:
                blocks.setdefault(block, []).append(html_lib.unescape(text) if "&" in text else text)
        lines = (" ".join("".join(b).split()) for b in blocks.values())
        return "\n".join(x for x in lines if x)

    def text(self, template: Mapping[int, float]) -> str:
        """The article's text. template: the hashes of the host's template with the shares of pages that they are on."""
        elements, runs = self._gone(template) if template else ({}, {})
        out = self._text(elements, runs)
        if not out and (elements or runs):
            least = min((*elements.values(), *runs.values()))
            out = self._text(*({k: s for k, s in x.items() if s > least} for x in (elements, runs))) or self._text({}, {})
        return out


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, hash, page) for each subtree's hash of a page, and with a null hash; page is the hash of all of it."""
    for batch in batches:
        hosts, hashes, pages = [], [], []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, runs, page = Page(source or "").candidates()
            own = {None, *(h for _, h in found), *(h for _, h in runs.values())}
            hosts += [host] * len(own)
            hashes += own
            pages += [page] * len(own)
        if hosts:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (hosts, hashes, pages)], names=["host", "hash", "page"])


def _host(url):
    return F.xxhash64(F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit("")))


def _salted(table: DataFrame) -> DataFrame:
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash, share): the subtrees that recur across many different pages of their host, which is a hash of its name."""
    small_batches(pages.sparkSession, 500)
    found = pages.select(_host(F.col("url")).alias("host"), "html").mapInArrow(_hashes, "host long, hash long, page long")
    # the distinct count is dealt by page first, so a host with a third of all pages is no hot key
    counts = found.groupBy("host", "hash").agg(F.count_distinct("page").alias("n"))
    counts = materialize(counts.where(f"hash is null or n >= {int(min_pages)}"), "subtrees")
    hosts = counts.where("hash is null").select("host", F.col("n").alias("pages"))
    often = counts.where("hash is not null").withColumn("salt", F.pmod("hash", F.lit(SALTS)).cast("int")).join(_salted(hosts), ["host", "salt"])
    share = F.col("n") / F.col("pages")
    return materialize(often.where(share >= min_share).select("host", "hash", share.alias("share")), "templates")


def _extract(sent):
    """Takes (page_id, url, html, host[, own templates]) to the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value if sent is not None else None
        for batch in batches:
            hosts, sources = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            own = [known.get(h, {}) for h in hosts] if known is not None else [{x["hash"]: x["share"] for x in o or ()} for o in batch.column(4).to_pylist()]
            texts = [Page(s or "").text(o) for s, o in zip(sources, own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def _own_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, host, source in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
            found, runs, _ = Page(source or "").candidates()
            out += [(key, host, h) for h in {*(h for _, h in found), *(h for _, h in runs.values())}]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["key", "host", "hash"])


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_rows: int = BROADCAST_TEMPLATES) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, text, n_chars)."""
    found = templates(pages, min_pages, min_share)
    rows = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))
    out = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    if found.count() <= broadcast_rows:
        by_host: dict[int, dict[int, float]] = {}
        for host, h, share in zip(*found.toArrow().to_pydict().values(), strict=True):
            by_host.setdefault(host, {})[h] = share
        return rows.mapInArrow(_extract(pages.sparkSession.sparkContext.broadcast(by_host)), out)
    key = F.xxhash64("host", "html")
    own = rows.select(key.alias("key"), "host", "html").mapInArrow(_own_hashes, "key long, host long, hash long").distinct()
    own = own.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(_salted(found), ["host", "hash", "salt"])
    own = own.groupBy("key").agg(F.collect_set(F.struct("hash", "share")).alias("own"))  # the blocks of one page
    rows = rows.withColumn("key", key).join(own, "key", "left").select("page_id", "url", "html", "host", "own")
    return rows.mapInArrow(_extract(None), out)
