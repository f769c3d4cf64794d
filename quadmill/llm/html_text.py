"""Main text of web pages: flat text blocks, their neighbours' word counts and link densities, and a decision tree."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements whose contents are no text. The parser passes over them to their end tag; without one only CODE goes on to the
#: page's end. Of NESTING the first end tag is taken, of FLAT one that no further start tag precedes.
CODE = ("script", "style")
NESTING = ("template", "object", "svg")
FLAT = ("noscript", "iframe", "canvas", "select", "textarea", "button", "title", "datalist", "audio", "video")
#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and words in class, id and role, that hold no article text.
OUTSIDE = frozenset("nav footer aside form menu dialog fieldset head".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead cookie cookies consent notice alert gdpr newsletter subscribe signup login popup modal overlay social share sharing related recommended recommendations comment comments disqus respond replies reply pagination pager toolbar widget widgets search copyright skip".split()
)
INSIDE = frozenset("article main".split())
#: Names that tell of a page's layout, not of what the element is.
LAYOUT = ("has-", "with-", "no-", "without-", "is-")
INSIDE_WORDS = frozenset("article main content entry post story articlebody".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<code>" + "|".join(CODE) + r")\b[^>]*(?:>.*?(?:</(?P=code)\s*>|\Z)|\Z)"
    r"|<(?P<nesting>" + "|".join(NESTING) + r")\b[^>]*(?:(?<=/)>|>.*?</(?P=nesting)\s*>|>|\Z)"
    r"|<(?P<flat>" + "|".join(FLAT) + r")\b[^>]*(?:(?<=/)>|>(?:(?!<(?P=flat)\b).)*?</(?P=flat)\s*>|>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    outside: bool
    inside: bool
    heading: bool

    @property
    def density(self) -> float:
        return self.link_words / self.words


@dataclass
class _Open:
    tag: str
    outside: bool
    inside: bool


def blocks(page: str | None) -> list[Block]:
    """The flat text blocks of a page: runs of text between tags that are not inline, with white space made one space and
    character references decoded. Unclosed and truncated markup ends where the page ends."""
    page = page or ""
    out: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    links: list[str] = []
    in_link, heading = False, False

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            n = len(text.split())
            linked = min(n, len(html.unescape(" ".join(links)).split()))
            out.append(Block(text, n, linked, bool(stack) and stack[-1].outside, bool(stack) and stack[-1].inside, heading))
        parts.clear()
        links.clear()

    def say(s: str) -> None:
        parts.append(s)
        if in_link:
            links.append(s)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not m["end"]
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in INLINE:
            continue
        close()
        if tag[0] == "h" and tag[1:] in ("1", "2", "3", "4", "5", "6"):
            heading = not m["end"]
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            in_link = False
            continue
        if stack and stack[-1].tag == "p":
            stack.pop()
        if tag == "body":
            stack.clear()
        if tag in VOID or m["attrs"].endswith("/") and tag not in INSIDE | OUTSIDE and tag != "div":
            continue
        above = stack[-1] if stack else _Open("", False, False)
        names = [n for x in _ATTR.findall(m["attrs"]) for n in "".join(x).lower().split()] if m["attrs"] else ()
        named = {w for n in names if not n.startswith(LAYOUT) for w in _PART.findall(n)}
        outside = (above.outside and tag not in INSIDE) or tag in OUTSIDE or (tag == "header" and not above.inside) or (not named.isdisjoint(OUTSIDE_WORDS) and tag not in ("html", "body", "article", "main") and not (tag in ("header", "h1", "h2") and above.inside))
        inside = above.inside or tag in INSIDE or not named.isdisjoint(INSIDE_WORDS)
        stack.append(_Open(tag, outside, inside))
    if at < len(page):
        say(page[at:])
    close()
    return out


#: The training table: labelled pages, a block each in page order. The letter tells links alone (m), text (t), text with
#: links in it (s) or a heading (h), the number the words; * marks article text, ^ an article element around the block and !
#: a part outside the article by its element or name. Most pages have neither, so that words, links and neighbours decide.
LABELLED = (
    "m1 m1 m2 m1 t8 h6* t60* t45* t80* t12* t30* t7",
    "h3 m1 m1 m1 m2 h9* t55* t70* m8* t40* t4* t65* s12 m2 m1 m1",
    "m2 m3 t20* t50* t90* t2* t75* h4* t35* t60* h3 m5 m6 m4 m7 s6",
    "s15 m1 m1 m1 h7* t100* t100* s40* t100* t9 m1 m1 m1 t6",
    "t25 m1 m1 m2 m2 m1 h10* t38* s62* t27* t18* t90* h2 m6 m5 m8 t4",
    "m1 m1 m1 t14 h5* t85* t33* m3* t58* t47* h1 s2 t12 s2 t18 s2 t9 t5",
    "h2 m2 m1 m2 t11 m3 h12* t22* t71* t16* t64* t100* s9 m2 m2 t8",
    "m4 m3 m5 h8* t100* t100* h3* t100* t6* t88* h4* t52* t28* h2 m9 m8 m11 m7",
    "m1 m2 h3 m3 m4 m2 t6 h6* t44* t57* t81* t23 m2 m4 m1 m2 s7",
    "t9 m1 m1 m1 t40* t30* t55* m2 m2 m2 m2",
    "m2 m2 m2 h7* t15* t100* t11* t13* t60* s14* t76* t3 m1 m1 m2",
    "m1 m1 m1 h2 t5 h4 m3 m6 m4 h9* t36* t29* t43* t51* t2 m1 t10",
    "h4* t100* t100* t42* t8*",
    "t5*",
    "h6* t12*",
    "m1 m1 h8* t9* t60* t5 m1 m1",
    "m1! m1! m2! t9! h11^* t60^* t45^* t3^* t70^* t12!",
    "h1! m1! m4! t23! h3^* t12^* t14! t8! t1^* t4^* t5^* t30! t2! h1! t12! t15! t4!",
    "m1! m2! h12^* t1^* t12! ",
    "m1! m1! t40! h5^* t100^* m9^* t35^* m2^ m3^ m2^ t90! t60! t8!",
    "m3! h10^* s30^* t75^* h4^* t20^* s20^* t5^* m4^ m6^ m3^ h2! s3! t25! s2! t90! t6!",
    "t8! m1! h9^* t2^* t8^* t6^* t100^* t1^* t14!",
    "m1! m1! h12^* t12^* t10!",
    "m2! t8! h4^* t4^* t7^* t9!",
    "t60! t100! m1! h7* t80* t30* s35* t3! t20! s10! t40! t70!",
    "m1! t12! h12^* t100^* t2^* t13!",
)

_LABEL = re.compile(r"([mtsh])(\d+)([*^!]*)")
_DENSITY = {"m": 1.0, "t": 0.0, "s": 0.35, "h": 0.0}


def labelled(pages: tuple[str, ...] = LABELLED) -> np.ndarray:
    """The table as rows of features() and, last, the label."""
    rows = []
    for page in pages:
        found = _LABEL.findall(page)
        made = [Block("", int(n), round(int(n) * _DENSITY[kind]), "!" in marks, "^" in marks, kind == "h") for kind, n, marks in found]
        rows += [(*features(made, i), "*" in marks) for i, (_, _, marks) in enumerate(found)]
    return np.array(rows, float)


#: Columns of features() that tell of the blocks before and after.
NEIGHBOURS = (2, 3, 4, 5)


def features(found: list[Block], i: int) -> tuple[float, ...]:
    """Words (above 100 as 100) and link density of a block, of the one before and of the one after, and its flags."""
    near = [found[k] if 0 <= k < len(found) else None for k in (i, i - 1, i + 1)]
    b = found[i]
    return (*[v for x in near for v in ((min(x.words, 100), x.density) if x else (0, 0.0))], b.outside, b.inside, b.heading)


@dataclass
class Tree:
    """A decision tree over the features of the training table, grown by Gini impurity until leaves are pure."""

    column: int = -1
    limit: float = 0.0
    article: bool = False
    low: "Tree | None" = field(default=None, repr=False)
    high: "Tree | None" = field(default=None, repr=False)

    @classmethod
    def grow(cls, rows: np.ndarray, depth: int = 12) -> "Tree":
        x, y = rows[:, :-1], rows[:, -1]
        leaf = cls(article=bool(2 * y.sum() >= len(y)))
        if depth == 0 or len(set(y.tolist())) < 2:
            return leaf
        best = None
        for c in range(x.shape[1]):
            values = np.unique(x[:, c])
            for limit in ((values[1:] + values[:-1]) / 2).tolist():
                low = x[:, c] <= limit
                impurity = sum(len(part) * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, c, limit, low)
        if best is None:
            return leaf
        _, c, limit, low = best
        return cls(c, limit, leaf.article, cls.grow(rows[low], depth - 1), cls.grow(rows[~low], depth - 1))

    def path(self, row: tuple) -> tuple[bool, list[int]]:
        """Whether a block is article text, and the columns that were asked for it."""
        node, asked = self, []
        while node.column >= 0:
            asked.append(node.column)
            node = node.low if row[node.column] <= node.limit else node.high
        return node.article, asked


TREE = Tree.grow(labelled())


def main_text(page: str | None, tree: Tree = TREE) -> str:
    """The blocks that the tree takes for article text, in page order, joined by line feeds."""
    found = blocks(page)
    return "\n".join(b.text for i, b in enumerate(found) if tree.path(features(found, i))[0])


@F.pandas_udf(StringType())
def main_texts(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """pages with text, the main text of the whole html ('' for null, empty or article-less pages), and n_chars, its code
    points. Every row and the other columns stay, repeated rows alike; columns of those names are replaced, and an empty table
    gives no rows. Row by row, no shuffle."""
    return pages.withColumn("text", main_texts("html")).withColumn("n_chars", F.length("text").cast("long"))
