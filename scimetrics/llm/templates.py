"""Main text of web pages: site templates are found by recurring subtrees.

Every container element gets a hash of its subtree, on pages that mark no
article every block but the headings. Spark counts, per host, under how many
different articles a subtree occurs; those that recur are deleted before the
text is taken. Elements that say by tag, class or role that they are no article
text go as well, unless the only article of the page would go with them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimetrics.llm.tables import checked, id_columns, known_ids
from scimetrics.session import materialize

#: A subtree under so many different articles of a host, and such a share of them, belongs to the template.
LEAST_ARTICLES, SHARE = 5, 0.05

# fixed values
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
DROPPED = frozenset(
    "head script style noscript template svg math title nav footer aside form button input select textarea "
    "iframe object canvas dialog menu audio video map datalist".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul caption option".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup html body".split())
CONTAINERS = frozenset("div section ul ol dl table figure details header fieldset center".split())
#: Elements that a new one of the same group ends; the search stops at the bounds.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "popup promo promotion promoted recommended related reply replies responses share sharing sidebar signup "
    "skyscraper social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: What may follow a word of NOT_ARTICLE in a hyphenated name, and what makes it a remark about the page.
PARTS = frozenset(
    "area bar block body box container content form group header inner item items left link links list main panel "
    "right row section text title top bottom unit wrap wrapper".split()
)
REMARKS = frozenset("has have hide is no non not show with without".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S
)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


class Element:
    __slots__ = ("tag", "names", "role", "inside", "digest")

    def __init__(self, tag: str, marks: str = "") -> None:
        self.tag, self.names, self.role, self.inside, self.digest = tag, frozenset(), "", [], 0
        if "=" in marks:
            names: set[str] = set()
            for name, *values in _NAMES.findall(marks):
                value = "".join(values).lower()
                if name.lower() == "role":
                    self.role = value.strip()
                else:
                    names.update(value.split())
            self.names = frozenset(names)


def parse(text: str) -> Element:
    """Tree of a page. Missing end tags are implied; stray ones are ignored."""
    root = Element("#root")
    stack, at, size = [root], 0, len(text)
    while at < size:
        mark = _MARK.search(text, at)
        begin = mark.start() if mark else size
        loose = None
        if (lt := text.find("<", at, begin)) >= 0:
            # a tag whose quotes never close ends at the next >
            loose = _LOOSE.search(text, lt, begin)
        if loose:
            mark, begin = loose, loose.start()
        if begin > at:
            stack[-1].inside.append(html.unescape(text[at:begin]))
        if not mark:
            break
        at = mark.end()
        tag = (mark.group(2) or "").lower()
        if not tag:
            continue
        if mark.group(1):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if tag not in BLOCKS and stack[depth].tag in BLOCKS:
                    break
            continue
        if tag in BLOCKS:
            ended, bounds = SIBLINGS.get(tag, (None, None))
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p" or (ended and stack[depth].tag in ended):
                    del stack[depth:]
                elif stack[depth].tag in (bounds if ended else BLOCKS):
                    break
        element = Element(tag, mark.group(3))
        stack[-1].inside.append(element)
        if tag in VOID or mark.group(3).endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(text, at)
            at = end.end() if end else size
            continue
        stack.append(element)
    return root


def _walk(root: Element) -> Iterator[Element]:
    """All elements, parents first."""
    open_ = [root]
    while open_:
        element = open_.pop()
        yield element
        open_ += [x for x in reversed(element.inside) if isinstance(x, Element)]


def _foreign(name: str) -> bool:
    """Whether a class or id names something that is no article: ``ad``, ``site-footer``, ``comment-list``.

    The whole name counts: ``has-sidebar``, ``comments-open`` and ``related-work`` say nothing of the kind.
    """
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    if not words or words[0] in REMARKS:
        return False
    return words[-1] in NOT_ARTICLE or words[0] in NOT_ARTICLE and all(w in PARTS or w in NOT_ARTICLE for w in words)


def _dropped(element: Element, named: bool = True) -> bool:
    if element.tag in DROPPED or element.role in ROLES:
        return True
    return named and element.tag not in ("html", "body", "main", "#root") and any(map(_foreign, element.names))


def main_elements(root: Element, named: bool = True) -> list[Element]:
    """The outermost articles, else the main element, else the whole page.

    A form that holds an article is looked into. Without ``named`` the classes
    of an article and of what holds it do not matter.
    """
    found: dict[str, list[Element]] = {"article": [], "main": []}
    open_ = [(root, False)]
    while open_:
        element, within = open_.pop()
        if element.tag != "form" and _dropped(element, named):
            continue
        kind = "main" if element.role == "main" else element.tag
        if kind in found and not (kind == "article" and within):
            found[kind].append(element)
        within = within or kind == "article"
        open_ += [(x, within) for x in reversed(element.inside) if isinstance(x, Element)]
    return found["article"] or found["main"] or [root]


def _own_elements(root: Element) -> list[Element]:
    """Main elements; those under foreign names only if the page has no text without them."""
    own = main_elements(root)
    if own == [root]:
        marked = main_elements(root, named=False)
        if marked != [root] and not _has_text(root, _dropped):
            return marked
    return own


def _digests(root: Element) -> None:
    for element in reversed(list(_walk(root))):
        parts = [element.tag, *sorted(element.names)]
        for x in element.inside:
            parts.append(str(x.digest) if isinstance(x, Element) else " ".join(x.split()))
        packed = "\0".join(parts).encode("utf-8", "replace")
        element.digest = int.from_bytes(blake2b(packed, digest_size=8).digest(), "little", signed=True)


def _has_text(element: Element, skip: Callable[[Element], bool] = lambda e: False) -> bool:
    open_ = [element]
    while open_:
        for x in open_.pop().inside:
            if isinstance(x, Element):
                open_ += [] if skip(x) else [x]
            elif not x.isspace():
                return True
    return False


def subtrees(root: Element) -> tuple[int, set[int]]:
    """Digest of the main elements, and of the containers that may belong to a template."""
    _digests(root)
    own = _own_elements(root)
    article = hash(tuple(e.digest for e in own))
    around = {id(e) for e in own}
    holds = set(around)
    for element in reversed(list(_walk(root))):
        if any(isinstance(x, Element) and id(x) in holds for x in element.inside):
            holds.add(id(element))
    counted = BLOCKS - HEADINGS if own == [root] else CONTAINERS
    found = {
        e.digest for e in _walk(root)
        if e.tag in counted and id(e) not in holds and not _dropped(e) and _has_text(e)
    }
    return article, found


def main_text(text: str, template: frozenset[int]) -> str:
    """Blocks of the main elements without deleted subtrees, joined by line feeds."""
    root = parse(text)
    if template:
        _digests(root)
    own = _own_elements(root)
    blocks: list[list[str]] = [[]]
    kept = {id(e) for e in own}
    open_: list[Element | str | None] = list(reversed(own))
    whole = own == [root]
    while open_:
        x = open_.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif x.tag == "br":
            blocks[-1].append(" ")
        elif id(x) not in kept and (_dropped(x) or x.digest in template or x.tag == "header" and whole):
            continue
        else:
            edge = [None] if x.tag in BLOCKS or x.tag == "#root" else []
            open_ += [*edge, *reversed(x.inside), *edge]
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(b for b in joined if b)


def host_of(url: str | None) -> str | None:
    found = _HOST.match(url or "")
    return found.group(1).lower() if found else None


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for page_id, url, text in zip(batch["page_id"].tolist(), batch["url"], batch["html"]):
            if host := host_of(url):
                article, found = subtrees(parse(text))
                # the first row stands for the page itself
                rows += [(page_id, host, article, digest) for digest in [None, *sorted(found)]]
        if rows:
            frame = pd.DataFrame(rows, columns=["page_id", "host", "article", "subtree"])
            yield frame.assign(subtree=pd.array([r[3] for r in rows], "Int64"))


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    none = np.empty(0, np.int64)
    for batch in batches:
        texts = [
            main_text(text, frozenset((none if own is None else own).tolist()))
            for text, own in zip(batch["html"], batch["template"])
        ]
        yield pd.DataFrame({"page_id": known_ids(batch, "page_id").array, "url": batch["url"], "text": texts})


def template_subtrees(pages: DataFrame, least: int = LEAST_ARTICLES, share: float = SHARE) -> DataFrame:
    """(page_id, template): digests of each page's subtrees that recur on its host.

    A subtree counts once per different article, so copies of one page never
    make their own text a template. It recurs if it has at least ``least``
    articles and ``share`` of all articles of the host.
    """
    rows = pages.where("not no_id").select("page_id", "url", "html")
    found = materialize(
        rows.mapInPandas(_hashed, "page_id long, host string, article long, subtree long"), "subtrees"
    )
    articles = found.where("subtree is null").select("host", "article").distinct().groupBy("host").agg(
        F.count("*").alias("articles")
    )
    found = found.where("subtree is not null")
    recurring = found.select("host", "subtree", "article").distinct().groupBy("host", "subtree").agg(F.count("*").alias("n"))
    recurring = recurring.where(F.col("n") >= least).join(articles, "host").where(F.col("n") >= share * F.col("articles"))
    recurring = materialize(recurring.select("host", "subtree"), "recurring")
    return found.join(recurring, ["host", "subtree"]).groupBy("page_id").agg(
        F.collect_set("subtree").alias("template")
    )


def extract(
    pages: DataFrame,
    least: int = LEAST_ARTICLES,
    share: float = SHARE,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page.

    A null html gives an empty text. Pages without page_id or without a host in
    their url take no part in counting templates. Rows that repeat a page_id
    share their template subtrees. Other columns are ignored; an empty table
    gives an empty result.
    """
    rows = pages.select(
        *id_columns(id_col, "page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html")
    )
    template = materialize(template_subtrees(rows, least, share), "templates")
    key = F.when(F.col("no_id"), F.lit(None)).otherwise(F.col("page_id"))
    own = checked(template.withColumnRenamed("page_id", "key"), 200)
    rows = rows.withColumn("key", key).join(own, "key", "left")
    texts = rows.select("page_id", "no_id", "url", "html", "template").mapInPandas(
        partial(_texts), "page_id long, url string, text string"
    )
    return texts.withColumn("n_chars", F.length("text").cast("long"))
