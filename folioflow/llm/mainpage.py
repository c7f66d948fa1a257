"""Main text of web pages: boosted trees over DOM-node features, decoded along the tree.

Each element gets a chance that its subtree is boilerplate: menus, headers, footers, sidebars, notices,
adverts, forms, comments. A subtree of boilerplate holds nothing else, so the best labelling in which that
is true of every element is found exactly, from the leaves up. The text of all other elements is kept.
The trees are trained here, on generated pages whose labels are known.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import text_chunks

#: Elements without an end tag, those whose content is raw text, and those that are never shown; fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
HIDDEN = frozenset("script style textarea title noscript iframe noembed noframes head template svg select option button input".split())
#: Elements inside a line of text; all others end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
#: What an opening element closes, if it is open: a p ends at any block, an li at the next, and so on.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
ENDS_SELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
GROUPS = {
    t: i
    for i, g in enumerate(
        ("nav", "header", "footer", "aside", "form fieldset label legend", "article", "main", "section", "div", "p blockquote pre", "ul ol li dl dt dd menu",
         "h1 h2 h3 h4 h5 h6", "table tbody thead tr td th caption", "a", "html body", "figure figcaption picture video audio img", "dialog details summary")
    )
    for t in g.split()
}
N_GROUPS = 18
#: Tokens of class, id and role that speak for boilerplate and for content; fixed values.
POOR = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer foot copyright legal "
    "sidebar aside side rail widget widgets related recommended trending popular more share sharing social cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe signup login "
    "search form contact comment comments commentlist reply replies respond disqus feedback discussion pagination pager toolbar tags tagcloud contentinfo complementary dialog skip".split()
)
GOOD = frozenset("article content main post entry story body text prose page maincontent articlebody blogpost".split())
_TOKEN = re.compile(r"[a-z]+")
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PUNCTUATION = re.compile(r"[.,;:!?]")


class Page:
    """Elements of a page in document order, and its runs of text with their elements."""

    __slots__ = ("tag", "parent", "depth", "attrs", "runs")

    def __init__(self, html: str):
        self.tag, self.parent, self.depth, self.attrs = ["#"], [0], [0], [""]
        self.runs: list[tuple[int, str | None]] = []  # None ends a block
        self._scan(html)

    def _scan(self, html: str) -> None:
        tag, runs, stack, pos, n = self.tag, self.runs, [0], 0, len(html)
        loose = False
        while pos < n:
            lt = html.find("<", pos)
            if lt < 0:
                runs.append((stack[-1], html[pos:]))
                return
            if lt > pos:
                runs.append((stack[-1], html[pos:lt]))
            nxt = html[lt + 1 : lt + 2]
            if nxt in ("!", "?"):
                comment = html.startswith("<!--", lt)
                end = html.find("-->" if comment else ">", lt + 2 + 2 * comment)
                if end < 0:
                    return
                pos = end + (3 if comment else 1)
                continue
            m = None if loose else _TAG.match(html, lt)
            if m:
                close, name, rest, pos = m[1], m[2].lower(), m[3], m.end()
            elif nxt.isalpha() or (nxt == "/" and html[lt + 2 : lt + 3].isalpha()):
                loose = True  # a quote that never ends: from here on tags end at the next >
                end = html.find(">", lt)
                if end < 0:
                    return
                inner = html[lt + 1 : end]
                close, inner = ("/", inner[1:]) if inner[0] == "/" else ("", inner)
                name, rest, pos = re.match(r"[^\s/]*", inner)[0].lower(), inner, end + 1
            else:
                runs.append((stack[-1], "<"))
                pos = lt + 1
                continue
            if name not in INLINE:
                runs.append((stack[-1], None))
            elif name == "br":
                runs.append((stack[-1], " "))
            if close:
                if name in VOID:
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if tag[stack[k]] == name:
                        del stack[k:]
                        break
                    if name in INLINE and tag[stack[k]] not in INLINE:
                        break
                continue
            if name in ENDS_P:
                self._close(stack, "p", ("div", "td", "th", "li", "article", "section", "main", "body", "aside", "nav", "header", "footer", "form", "table", "button"))
            if name in ENDS_SELF:
                self._close(stack, name, ENDS_SELF[name])
            at = len(tag)
            tag.append(name)
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            self.attrs.append(rest)
            if name in RAW:
                end = self._end_of(html, name, pos)
                pos = n if end < 0 else end
            elif name not in VOID and not rest.endswith("/"):
                stack.append(at)
            elif name not in VOID and name not in ("svg", "path"):
                stack.append(at)  # <div/> is an open div in HTML

    def _close(self, stack: list[int], name: str, within: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[k]]
            if t == name:
                del stack[k:]
                return
            if t in within:
                return

    @staticmethod
    def _end_of(html: str, name: str, pos: int) -> int:
        m = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(html, pos)
        return m.start() if m else -1


@lru_cache(maxsize=20_000)
def _marks(attrs: str) -> tuple[int, int]:
    poor = good = 0
    for m in _ATTRIBUTE.finditer(attrs):
        for t in _TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1]).lower()):
            poor += t in POOR
            good += t in GOOD
    return poor, good


class Nodes:
    """Features of all elements of many pages; parents come before children."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.tag) for p in pages]
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        base = np.repeat(self.first[:-1], sizes)
        self.page = np.repeat(np.arange(len(pages)), sizes)
        self.parent = np.array([x for p in pages for x in p.parent], dtype=np.int64) + base
        self.depth = np.array([x for p in pages for x in p.depth], dtype=np.int64)
        self.group = np.array([GROUPS.get(t, N_GROUPS - 1) for p in pages for t in p.tag], dtype=np.int64)
        self.hidden = np.array([t in HIDDEN for p in pages for t in p.tag], dtype=bool)
        marks = np.array([_marks(a) if a else (0, 0) for p in pages for a in p.attrs], dtype=np.float64).reshape(-1, 2)
        self.poor, self.good = marks[:, 0], marks[:, 1]
        n = len(self.parent)
        owners, chars, words, stops = [], [], [], []
        for p, at in zip(pages, self.first.tolist()):
            for node, text in p.runs:
                if text is not None and not text.isspace():
                    owners.append(at + node)
                    chars.append(len(text))
                    words.append(text.count(" ") + 1)
                    stops.append(text.count(".") + text.count(",") + text.count("?") + text.count("!"))
        owners = np.array(owners, dtype=np.int64)
        total = lambda v: np.bincount(owners, weights=np.array(v, dtype=float), minlength=n) if len(owners) else np.zeros(n)
        self.levels = [np.flatnonzero(self.depth == k) for k in range(self.depth.max() + 1 if n else 0)]
        # hidden elements, and all below them, hold no text
        self.hidden = self.down(self.hidden.astype(float)) > 0
        self.text, self.words, self.stops = (np.where(self.hidden, 0, total(v)) for v in (chars, words, stops))

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        out = values.astype(float)
        for level in self.levels[:0:-1]:
            np.add.at(out, self.parent[level], out[level])
        return out

    def down(self, values: np.ndarray) -> np.ndarray:
        """Sums over an element and what it is in."""
        out = values.astype(float)
        for level in self.levels[1:]:
            out[level] += out[self.parent[level]]
        return out

    def features(self) -> np.ndarray:
        n = len(self.parent)
        root = self.depth == 0
        text, words, stops, count = self.up(self.text), self.up(self.words), self.up(self.stops), self.up(np.ones(n))
        in_link = self.down((self.group == GROUPS["a"]).astype(float)) > 0
        links = self.up(np.where(in_link, self.text, 0))
        prose = self.up(np.where(self.group == GROUPS["p"], text, 0) * (self.down((self.group == GROUPS["p"]).astype(float)) <= 1))
        kids = np.bincount(self.parent[~root], minlength=n)
        order = np.lexsort((np.arange(n), self.parent))
        rank = np.arange(n) - np.searchsorted(self.parent[order], self.parent[order])
        place = np.empty(n)
        place[order] = rank
        poor_tag, good_tag = self.group < 5, (self.group == GROUPS["article"]) | (self.group == GROUPS["main"])
        poor = self.down(np.minimum(self.poor, 1) + poor_tag)
        good = self.down(np.minimum(self.good, 1) + good_tag)
        whole = text[self.first[:-1]][self.page] + 1
        columns = [self.group == g for g in range(N_GROUPS)]
        columns += [
            self.depth, np.log1p(text), np.log1p(self.text), links / (text + 1), np.log1p(text / count), np.log1p(count), kids, place, kids[self.parent],
            text / whole, text / (text[self.parent] + 1), self.poor, self.good, poor, good, 100 * stops / (text + 1), text / (words + 1),
            (np.arange(n) - self.first[self.page]) / np.maximum(np.diff(self.first)[self.page], 1), prose / (text + 1), good - poor,
        ]
        return np.stack(columns, axis=1).astype(np.float32)

    def boilerplate(self, odds: np.ndarray) -> np.ndarray:
        """The likeliest labelling in which all that a boilerplate element holds is boilerplate as well."""
        yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        yes = np.where(self.hidden, 0.0, yes)
        no = np.where(self.hidden, -1e9, no)
        all_yes = self.up(yes)
        best = no.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            best[level] = np.maximum(all_yes[level], best[level])  # children have been added below
            if k:
                np.add.at(best, self.parent[level], best[level])
        # top down: an element is boilerplate if it pays, or if what holds it is
        out = all_yes >= best - 1e-12
        for level in self.levels[1:]:
            out[level] |= out[self.parent[level]]
        return out


def extract(pages: list[Page], model: boosting.Boosted) -> list[str]:
    nodes = Nodes(pages)
    drop = nodes.boilerplate(model.predict(nodes.features())) if len(nodes.parent) else np.empty(0, bool)
    out = []
    for p, at in zip(pages, nodes.first.tolist()):
        gone = drop[at : at + len(p.tag)].tolist()
        blocks, now = [], []
        for node, text in [*p.runs, (0, None)]:
            if text is None:
                block = " ".join(unescape("".join(now)).split()) if now else ""
                if block:
                    blocks.append(block)
                now = []
            elif not gone[node]:
                now.append(text)
        out.append("\n".join(blocks))
    return out


# ---------------------------------------------------------------- training pages

_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve xi yo zu en er st ch".split()


class _Maker:
    """Pages of random words in varied layouts, with boilerplate marked by data-x in the generated markup."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, a: int, b: int) -> str:
        r = self.r
        out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b))]
        noise = r.choice(("", "", "", "!!", "###", " |"))
        return " ".join(w + (r.choice(".,") if r.random() < 0.15 else "") + noise for w in out).capitalize() + "."

    def links(self) -> str:
        return "<ul>" + "".join(f"<li><a href='/{i}'>{self.words(1, 3)}</a></li>" for i in range(self.r.randint(2, 9))) + "</ul>"

    def named(self, tags: str, names: str, inner: str) -> str:
        tag, name = self.r.choice(tags.split()), self.r.choice(names.split())
        attr = self.r.choice((f' class="{name}"', f' id="{name}"', f' class="x-{name} c{self.r.randint(0, 9)}"'))
        if tag in ("nav", "header", "footer", "aside", "form") and self.r.random() < 0.6:
            attr = ""
        return f"<{tag}{attr} data-x>{inner}</{tag}>"

    def junk(self, where: str) -> str:
        r, w = self.r, self.words
        kinds = {
            "top": [
                lambda: self.named("nav div ul", "nav menu navbar navigation breadcrumb", self.links()),
                lambda: self.named("header div", "header masthead topbar banner", f"<h2>{w(1, 4)}</h2>" + r.choice(("", self.links(), f"<p>{w(2, 12)}</p>"))),
                lambda: self.named("div section aside", "cookie notice consent alert gdpr popup", f"<p>{w(5, 30)}</p>" + r.choice(("", f"<a href='#'>{w(1, 2)}</a>"))),
            ],
            "any": [
                lambda: self.named("div aside section", "ad ads advert sponsored promo banner", r.choice((w(2, 40), f"<p>{w(3, 60)}</p>", f"<a href='#'>{w(2, 8)}</a>"))),
                lambda: self.named("div ul", "share social newsletter subscribe", f"<p>{w(2, 12)}</p>" + self.links()),
            ],
            "end": [
                lambda: self.named("footer div", "footer copyright legal", r.choice((w(2, 20), f"<p>{w(3, 40)}</p>", self.links() + w(2, 6)))),
                lambda: self.named("aside div", "sidebar widget related trending", r.choice((self.links(), f"<h3>{w(1, 4)}</h3><p>{w(5, 60)}</p>", w(3, 20) + self.links()))),
                lambda: self.named("section div ol", "comments comment replies disqus discussion", "".join(f"<div class='comment'><p>{w(3, 60)}</p></div>" for _ in range(r.randint(1, 5)))),
                lambda: self.named("form div", "search login contact signup form", f"<label>{w(1, 3)}</label><p>{w(2, 10)}</p><input name=q>"),
            ],
        }
        return r.choice(kinds[where])()

    def article(self) -> str:
        r, w = self.r, self.words
        out = [r.choice(("", f"<h1>{w(1, 10)}</h1>"))]
        for _ in range(r.choice((1, 1, 2, 3, 5, 9, 20))):
            kind = r.random()
            if kind < 0.72:
                out.append(r.choice((f"<p>{w(1, 120)}</p>", f"<p>{w(1, 60)}<br>{w(1, 30)}<p>{w(1, 60)}", f"<p><b>{w(1, 60)}<br>", f"<p>{w(1, 30)} <a href='#'>{w(1, 3)}</a> {w(1, 40)}</p>")))
            elif kind < 0.8:
                out.append(f"<h{r.randint(2, 4)}>{w(1, 6)}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{w(2, 25)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{w(4, 40)}</p></blockquote>")
            elif kind < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{w(1, 5)}</td><td>{w(1, 5)}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>")
            elif kind < 0.97:
                out.append(f"<figure><img src=x><figcaption>{w(2, 15)}</figcaption></figure>")
            else:
                out.append(self.junk("any"))
        inner = "".join(out)
        tag = r.choice(("article", "article", "article", "main", "div class='content'", "div id='main'", "div class='post entry'", "section class='article-body'", "div"))
        inner = f"<{tag}>{inner}</{tag.split()[0]}>"
        return f"<main>{inner}</main>" if r.random() < 0.15 else inner

    def page(self) -> str:
        r = self.r
        top = [self.junk("top") for _ in range(r.randint(0, 3))] + ([self.junk("any")] if r.random() < 0.5 else [])
        end = [self.junk("end") for _ in range(r.randint(0, 4))] + ([self.junk("any")] if r.random() < 0.3 else [])
        body = "".join((*top, self.article(), *end))
        if r.random() < 0.3:
            body = f"<div class='{r.choice(('wrapper', 'page', 'container', 'row'))}'>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><script>var a='<p>';</script></head><body>{body}" + r.choice(("</body></html>", ""))


@lru_cache(maxsize=2)
def train(pages: int = 1500, seed: int = 11) -> boosting.Boosted:
    """The model, from that many generated pages; deterministic."""
    maker = _Maker(seed)
    made = [Page(maker.page()) for _ in range(pages)]
    nodes = Nodes(made)
    junk = nodes.down(np.array(["data-x" in a for p in made for a in p.attrs], dtype=float)) > 0
    used = ~nodes.hidden & (nodes.up(nodes.text) > 0)
    return boosting.fit(nodes.features()[used], junk[used].astype(float))


def main_text(pages: DataFrame, model: boosting.Boosted | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html).

    Nulls: a null html is empty and gives an empty text; a null page_id or url stays. Repeated rows are each
    extracted; ties (a subtree as likely either way) count as boilerplate. An empty table gives an empty
    result. Other columns are not read. A very long page is parsed whole, in one pass. There is no shuffle;
    the model goes with the task.
    """
    model = model or train()

    def run(batches):
        for part, texts in text_chunks(batches, "html"):
            out = extract([Page(t.decode()) for t in texts], model)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
