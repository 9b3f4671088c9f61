"""Main text of web pages by host-wide consensus.

Each page's containers are scored by their text, links and paragraphs. A page
votes, per host, on generalised tag-class paths, which name containers across
pages: by the scores within its articles or mains, or else for the container
that encloses its titles and nearly all of its score. The votes are added up
in Spark. Every page is then read again and the text under its host's winning
path taken, or under its own enclosing container, below the body, where that
holds the winning one. A page without that path falls back on its own vote.

Boilerplate by tag, role or class (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, comments) is never text, but for a form, or an
element marked by a part of its class, that holds most of the text of a page
without article and main. Null or
empty html gives an empty text; a null url is a host of its own. Pages that
repeat are read each by itself. Unclosed and stray tags are tolerated; the time
taken grows as the page does.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import cut, small_side, table

#: A comment, a tag (quotes count after an equals sign alone), or a declaration. Nothing is tried twice within one.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
CONTAINERS = frozenset("html body main article section div td th table tbody tr center blockquote figure details dd dl ul ol li aside nav header footer form fieldset dialog menu".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre br hr dt address figcaption summary caption thead tfoot legend option".split())
DROPPED = frozenset("nav header footer aside form fieldset button select option menu dialog svg math canvas object audio video map script style textarea title noscript template iframe noembed noframes head".split())
#: Words of a class, id or role that mark what is not the article.
MARKED = frozenset(
    "nav navbar navigation menu menubar header masthead footer colophon sidebar aside complementary notice notices cookie cookies consent gdpr alert banner"
    " ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments respond reply replies disqus discussion form search share sharing"
    " social related recommended breadcrumb breadcrumbs newsletter subscribe signup popup modal overlay toolbar pagination pager widget".split()
)
#: Marks of readers' comments, which stay marks even where they hold most of a page.
COMMENTS = frozenset("comment comments respond reply replies disqus discussion".split())
#: Whole classes that speak for the article, and parts of a class that only state something about its page.
SPEAKS = frozenset("content article post entry main story body text page wrapper container".split())
STATES = frozenset("has no with without is not open opened closed enabled disabled on off".split())
CLOSES_P = BLOCKS - {"br", "caption", "legend", "option"}
#: What a start tag closes that is still open, and where it stops looking.
_CELLS, _TABLES = frozenset(("td", "th")), frozenset(("table",))
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))), "dd": (frozenset(("dd", "dt")), frozenset(("dl",))), "dt": (frozenset(("dd", "dt")), frozenset(("dl",))),
    "td": (_CELLS, _TABLES | {"tr"}), "th": (_CELLS, _TABLES | {"tr"}), "tr": (frozenset(("tr",)), _TABLES),
    "tbody": (frozenset(("tbody", "tr")), _TABLES), "thead": (frozenset(("tbody", "tr")), _TABLES), "tfoot": (frozenset(("tbody", "tr")), _TABLES),
}
_P = frozenset(("p",))
#: Containers that are nested deeper belong to the one at this depth.
MOST_DEEP = 200
#: A container is left for one within it that holds all but one in so many parts of the page's score.
REST = 20
TOPS = ("", "html", "body")
HOSTS_BROADCAST = 1 << 18


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) if v else "" for k, v in ATTRIBUTE.findall(text)}


def _boilerplate(tag: str, attrs: dict[str, str]) -> str:
    """How sure it is that an element is not the article: "" for not at all, "soft" unless it holds most of the page, "hard"."""
    if tag == "form":
        return "soft"
    if tag in DROPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return "hard"
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return "hard"
    if tag in ("html", "body", "main", "article"):
        return ""
    names = " ".join(attrs.get(k, "") for k in ("class", "id", "role")).lower().split()
    speaks = not SPEAKS.isdisjoint(names)
    how = ""
    for name in names:
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        found = MARKED.intersection(parts)
        if found and (len(parts) < 2 or found & COMMENTS and not speaks and STATES.isdisjoint(parts)):
            return "hard"  # a mark by itself, or comments
        if found and not speaks and STATES.isdisjoint(parts):
            how = "soft"
    return how


def _step(tag: str, attrs: dict[str, str]) -> str:
    """A container's part of a path: its tag and classes, numbers generalised."""
    classes = sorted({re.sub(r"\d+", "#", c.lower()) for c in attrs.get("class", "").split()})
    return ".".join([tag, *classes])


class Page:
    """A page as pieces of text, each with the container that it stands in."""

    def __init__(self, source: str):
        spared: set[int] = set()  # places of marked elements that hold most of the page
        while True:
            self.paths: list[str] = [""]
            self.parents: list[int] = [-1]
            self.pieces: list[tuple[int, str, bool]] = []  # container, text (a space at a block's edge), within a link
            self.titles: list[tuple[int, int]] = []  # container, first piece
            marked = self._read(source, spared)
            most, at = max(((n, at) for at, n in marked.items()), default=(0, 0))
            if any(re.search(r"/(?:article|main)\b", self.paths[c]) for c, t, _ in self.pieces if t.strip()) or most <= sum(len(t.strip()) for _, t, linked in self.pieces if not linked):
                break
            spared.add(at)

    def _read(self, source: str, spared: set[int]) -> Counter:
        """Fill the page; the unlinked text of each outermost element dropped for its soft mark, by its place."""
        # tag, container, 0 or what it is dropped for: -1, or 1 + the place of the softly marked element
        stack: list[tuple[str, int, int]] = [("", 0, 0)]
        opened: Counter = Counter()
        marked: Counter = Counter()
        links = at = begin = 0
        end, last = len(source), source.rfind(">")

        def edge() -> None:
            if not stack[-1][2]:
                self.pieces.append((stack[-1][1], " ", False))

        def close(tags: frozenset[str], until: frozenset[str]) -> None:
            """Pop through the nearest open element of `tags`, if none of `until` is nearer."""
            if not any(opened[t] for t in tags):
                return
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in tags:
                    for t, *_ in stack[k:]:
                        opened[t] -= 1
                    del stack[k:]
                    return
                if stack[k][0] in until:
                    return

        def text(stop: int) -> None:
            if stop > begin:
                if not stack[-1][2]:
                    self.pieces.append((stack[-1][1], entities.unescape(source[begin:stop]), links > 0))
                elif stack[-1][2] > 0 and not links:
                    marked[stack[-1][2] - 1] += len(source[begin:stop].strip())

        while at < end:
            start = source.find("<", at)
            if start < 0 or start > last and not source.startswith("<!--", start):
                break
            m = TOKEN.match(source, start)
            if not m:
                at = start + 1
                continue
            text(start)
            begin = at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag in CLOSES_P:
                close(_P, CONTAINERS)
            if not m[1] and tag in CLOSES:
                close(*CLOSES[tag])
            block = tag in BLOCKS
            if block:
                edge()
            if m[1]:
                if tag == "a":
                    links = max(0, links - 1)
                elif opened[tag]:
                    close(frozenset((tag,)), frozenset())
                    if block:
                        edge()
                continue
            if tag == "a":
                links += not m[3].endswith("/")
                continue
            if tag in VOID or m[3].endswith("/"):
                continue
            dropped = stack[-1][2]
            if tag == "h1" and not dropped:
                self.titles.append((stack[-1][1], len(self.pieces)))
            inside = tag in CONTAINERS
            attrs = _attributes(m[3]) if m[3].strip() and not dropped else {}
            if not dropped and (how := _boilerplate(tag, attrs)) and not (how == "soft" and start in spared):
                dropped = start + 1 if how == "soft" else -1
            elif dropped > 0 and tag in DROPPED and tag != "form":
                dropped = -1
            if tag in RAW:
                found = re.compile(rf"</{tag}\s*>?", re.I).search(source, at)
                begin = at = found.start() if found else end
            if not (inside or dropped):
                continue  # an inline tag or a paragraph: only its edge matters
            container = stack[-1][1]
            if inside and not dropped and len(stack) <= MOST_DEEP:
                self.paths.append(f"{self.paths[container]}/{_step(tag, attrs)}")
                self.parents.append(container)
                container = len(self.paths) - 1
            stack.append((tag, container, dropped))
            opened[tag] += 1
        text(end)
        return marked

    def scores(self, linked_costs: int = 3) -> dict[int, int]:
        """A positive score for each container whose own text looks like an article's."""
        text, link, blocks = Counter(), Counter(), Counter()
        run = 0
        for c, s, linked in self.pieces:
            n = len(s.strip())
            text[c] += n
            link[c] += n * linked
            run = run + n if n else 0
            if s == " " or n > 60:
                blocks[c] += run > 40
                run = 0
        out = {}
        for c, n in text.items():
            bonus = 2 if re.search(r"/(?:article|main)\b", self.paths[c]) else 1
            score = (n - linked_costs * link[c] + 25 * blocks[c]) * bonus
            if score > 0:
                out[c] = score
        return out or (self.scores(0) if linked_costs else out)  # a page that is all links

    def article(self, path: str) -> str:
        """A container's path, cut at the first article or main within it."""
        m = re.match(r".*?/(?:article|main)(?:\.[^/]*)?(?=/|\Z)", path)
        return m[0] if m else path

    def top(self, c: int) -> bool:
        return self.paths[c].rsplit("/", 1)[-1].split(".")[0] in TOPS

    def enclosing(self, scores: dict[int, int]) -> int:
        """The innermost container that holds the titles (at the body's level, those that are no links) and nearly all of the score."""
        n = len(self.paths)
        held = [scores.get(c, 0) for c in range(n)]
        titles, plain = [0] * n, [0] * n
        for c, at in self.titles:
            titles[c] += 1
            plain[c] += not next((linked for _, s, linked in self.pieces[at:] if s.strip()), True)
        children: list[list[int]] = [[] for _ in range(n)]
        for c in range(n - 1, 0, -1):
            up = self.parents[c]
            held[up] += held[c]
            titles[up] += titles[c]
            plain[up] += plain[c]
            children[up].append(c)
        at = 0
        while True:
            named = plain if self.top(at) else titles
            most = max(children[at], key=held.__getitem__, default=None)
            if most is None or REST * held[most] < (REST - 1) * held[0] or named[most] < named[at] or (scores.get(at) and not self.top(at)):
                return at
            at = most

    def votes(self) -> Counter:
        scores = self.scores()
        total = sum(scores.values())
        out: Counter = Counter()
        if scores and not any(re.search(r"/(?:article|main)\b", self.paths[c]) for c in scores):
            return Counter({self.paths[self.enclosing(scores)]: 1000})
        for c, s in scores.items():
            out[self.article(self.paths[c])] += 1000 * s // total
        return out

    def under(self, path: str) -> str:
        """The text of all containers at `path`, in page order; blocks and runs of white space give one space."""
        hit = [p == path or p.startswith(path + "/") for p in self.paths]
        return " ".join("".join(s for c, s, _ in self.pieces if hit[c]).split())

    def text(self, path: str | None) -> str:
        if path is not None and path in self.paths:
            if not re.search(r"/(?:article|main)\b", path) and (scores := self.scores()):
                own = self.enclosing(scores)
                if not self.top(own) and path.startswith(self.paths[own] + "/"):
                    path = self.paths[own]
            if found := self.under(path):
                return found
        votes = self.votes()
        if not votes:
            return self.under("")
        return self.under(max(votes, key=lambda p: (votes[p], p)))


def host_of() -> Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def consensus(pages: DataFrame) -> DataFrame:
    """(host, path): each host's winning path. Votes are added up within batches before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: Counter = Counter()
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for path, n in Page(source.as_py() or "").votes().items():
                    votes[host, path] += n
            rows = list(votes.items())
            yield pa.record_batch([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["host", "path", "n"])

    votes = pages.select(host_of().alias("host"), F.col("html").cast("string")).mapInArrow(run, "host string, path string, n long")
    summed = votes.groupBy("host", "path").agg(F.sum("n").alias("n"))
    return summed.groupBy("host").agg(F.max(F.struct("n", "path")).alias("m")).select("host", "m.path")


def extract(pages: DataFrame) -> DataFrame:
    """pages' page_id and url with text and n_chars, from the whole html."""
    winners, _ = small_side(cut(consensus(pages)), HOSTS_BROADCAST)
    joined = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string").alias("html"), host_of().alias("host")).join(winners, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(s.as_py() or "").text(p) for s, p in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
