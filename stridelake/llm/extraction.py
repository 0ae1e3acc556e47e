"""Operator 2: main text of web pages, with removal of site templates."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, importable, materialize

# Fixed values of HTML: elements without content, elements whose content is no markup, elements that start a block,
# and which open elements a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that can be part of a template within an article.
INNER = BLOCK - frozenset("body br caption dd dt h1 h2 h3 h4 h5 h6 hr html li option tbody td tfoot th thead tr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_SELF = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}

# What marks an element as no part of an article, whatever it holds.
DROPPED_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea title menu dialog object canvas noframes noembed datalist".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu submenu footer sidebar ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay"
    " newsletter subscribe subscription signup login comment comments respond disqus replies breadcrumb breadcrumbs pagination pager related recommended share sharing social widget toolbar skip copyright banner".split()
)
#: Marks that count outside the article only: an article has a header of its own.
DROPPED_OUTSIDE = frozenset("header masthead topbar".split())
#: Marks that count on an article element itself: reader comments and teasers are often articles.
DROPPED_ARTICLES = frozenset("comment comments reply replies ad ads advert advertisement promo sponsored related teaser".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:[!?]|/[^a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_MARKS = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")


class Element:
    """A node of the parsed tree. digest: hash of tag, text and children; text_size: characters of text below."""

    __slots__ = ("tag", "attributes", "children", "digest", "text_size")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes, self.children, self.digest, self.text_size = tag, attributes, [], b"", 0

    def own_size(self) -> int:
        """Characters of text directly below."""
        return sum(len(w) for c in self.children if isinstance(c, str) for w in c.split())

    def close(self) -> None:
        h = hashlib.blake2b(self.tag.encode(), digest_size=8)
        for c in self.children:
            if isinstance(c, str):
                if words := c.split():
                    h.update(b"\1" + " ".join(words).encode("utf-8", "surrogatepass"))
                    self.text_size += sum(map(len, words))
            else:
                h.update(b"\2" + c.digest)
                self.text_size += c.text_size
        self.digest = h.digest()


def parse(source: str) -> Element:
    """The tree of a page, also of one that is cut off or nested wrongly: whatever is open at its end is closed."""
    root = Element("#root", "")
    stack, at = [root], 0
    depths: dict[str, list[int]] = {}  # of the open elements of each tag, so that no search scans the stack

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            node.close()
            if stack:
                depths[node.tag].pop()

    def deepest(names) -> int:
        return max((depths[n][-1] for n in names if depths.get(n)), default=0)

    def open_at(names, barrier=frozenset()) -> int:
        depth = deepest(names)
        return depth if depth > deepest(barrier) else 0

    size = len(source)
    while at < size:
        found = source.find("<", at)
        match = _TAG.match(source, found) if found >= 0 else None
        while found >= 0 and match is None:  # a "<" that starts no tag is text
            found = source.find("<", found + 1)
            match = _TAG.match(source, found) if found >= 0 else None
        stop = size if found < 0 else found
        if stop > at:
            stack[-1].children.append(html.unescape(source[at:stop]))
        if match is None:
            break
        at = match.end()
        tag = match[2] or match[5]
        if not tag:
            continue
        tag = tag.lower()
        if match[1] or match[4]:
            if depth := open_at((tag,)):
                pop_to(depth)
            elif tag == "br":
                stack[-1].children.append(Element("br", ""))
            continue
        if tag in ENDS_P and (depth := open_at(("p",), {"button", "td", "th", "table", "caption"})):
            pop_to(depth)
        if tag in ENDS_SELF:
            names, barrier = ENDS_SELF[tag]
            if depth := open_at(names.split(), barrier):
                if tag == "tr" and (row := open_at(("tr",), barrier)):
                    depth = row
                pop_to(depth)
        if tag == "body" and (depth := open_at(("head",))):
            pop_to(depth)
        node = Element(tag, match[3] or match[6] or "")
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else size
            continue
        if not (match[3] or match[6] or "").rstrip().endswith("/") or tag not in ("svg", "path", "circle", "rect", "use", "g"):
            depths.setdefault(tag, []).append(len(stack))
            stack.append(node)
    pop_to(0)
    return root


def _marks(attributes: str) -> tuple[set[str], set[str], bool]:
    """Words of class and id, roles, and whether the element is hidden."""
    words, roles, hidden = set(), set(), False
    for name, value in _MARKS.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            words.update(_WORDS.findall(value))
        elif name == "role":
            roles.update(value.split())
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "")
    return words, roles, hidden


def is_boilerplate(node: Element, in_article: bool) -> bool:
    """Whether tag, role, class or id say that an element is no part of the article."""
    if node.tag in DROPPED_TAGS or (node.tag == "header" and not in_article):
        return True
    if not node.attributes or node.tag in ("html", "body", "#root"):
        return False
    words, roles, hidden = _marks(node.attributes)
    if hidden or roles & DROPPED_ROLES:
        return True
    if node.tag in ("article", "main") or "main" in roles:
        return bool(words & DROPPED_ARTICLES)
    return bool(words & DROPPED_WORDS) or (not in_article and bool(words & DROPPED_OUTSIDE))


def _walk(root: Element, in_article: bool = False) -> Iterator[tuple[Element, bool]]:
    """Elements that no rule drops, in page order, with whether an article or main element is around them."""
    todo = [(root, in_article)]
    while todo:
        node, inside = todo.pop()
        yield node, inside
        below = inside or _is_article(node)
        todo += [(c, below) for c in reversed(node.children) if not isinstance(c, str) and not is_boilerplate(c, below)]


def _is_article(node: Element) -> bool:
    return node.tag in ("article", "main") or ("role" in node.attributes and "main" in _marks(node.attributes)[1])


def content_roots(root: Element) -> list[Element]:
    """The outermost articles that rules keep and that hold text; without any, main elements; else the whole page."""
    for test in (lambda n: n.tag == "article", _is_article):
        found, covered = [], set()
        for node, _ in _walk(root):
            if id(node) in covered:
                covered.update(id(c) for c in node.children)
            elif test(node) and node.text_size:
                found.append(node)
                covered.update(id(c) for c in node.children)
        if found:
            return found
    return [root]


def _inside(digest: bytes) -> bytes:
    """What a subtree within an article is counted as: apart from equal ones outside articles."""
    return b"\1" + digest


def template_candidates(root: Element) -> tuple[set[bytes], set[bytes]]:
    """Digests of subtrees with text that may be part of a site's template: those outside articles, those within.

    On a page without article or main element everything below the body is outside. Outside, subtrees that rules drop
    anyway are counted too, but not their parts. Within an article the blocks that rules keep count, but no headings,
    cells, list items and inline elements, as single words and numbers recur in any text.
    """
    roots = content_roots(root)
    articles = set() if roots == [root] else {id(r) for r in roots}
    outside, todo = set(), [root]
    while todo:
        node = todo.pop()
        for c in node.children:
            if isinstance(c, str) or id(c) in articles or not c.text_size:
                continue
            if c.tag not in ("html", "body", "head"):
                outside.add(c.digest)
            if not is_boilerplate(c, False):
                todo.append(c)
    within = {n.digest for top in roots if articles for n, _ in _walk(top, True) if n is not top and n.text_size and n.tag in INNER}
    return outside, within


def extract(root: Element, templates: frozenset[bytes] | set[bytes] = frozenset()) -> tuple[str, int]:
    """Text of the content roots without boilerplate and template subtrees, and how many characters templates took.

    Templates decide first, on the whole page: what they take is counted there and at the content roots, whatever
    rules say of it. Three kinds of template subtrees stay, as copies of an article share them: one that holds two
    thirds of the text that rules keep, or a content root; those that would take half of an article's text or more; and
    those of a page of which nothing would be left.
    """
    roots = content_roots(root)
    out: list[str] = []
    taken = 0
    for top in roots:
        parts, lost = _text_parts(top, top is not root, templates)
        kept = sum(len(w) for x in parts for w in x.split()) if lost else 1
        if kept <= lost if top is not root else not kept:
            parts, lost = _text_parts(top, top is not root, frozenset())
        out += [*parts, " "]
        taken += lost
    if templates:
        whole = roots == [root]
        own, todo = {id(r) for r in roots if r is not root}, [(root, not whole)]
        while todo:  # beside the content roots, also below what rules drop
            node, dropped = todo.pop()
            for c in node.children:
                if isinstance(c, str) or id(c) in own:
                    continue
                below = dropped or is_boilerplate(c, False)
                if c.digest in templates and below and not _holds(c, own):
                    taken += c.text_size
                elif c.text_size:
                    todo.append((c, below))
    return " ".join("".join(out).split()), taken


def _holds(node: Element, own: set[int]) -> bool:
    todo = [node] if own else []
    while todo:
        for c in todo.pop().children:
            if not isinstance(c, str):
                if id(c) in own:
                    return True
                todo.append(c)
    return False


def main_text(root: Element, templates: frozenset[bytes] | set[bytes] = frozenset()) -> str:
    """The text of extract()."""
    return extract(root, templates)[0]


def _text_parts(top: Element, in_article: bool, templates: frozenset[bytes] | set[bytes]) -> tuple[list[str], int]:
    """Texts below top in page order, and the characters that templates took."""
    parts: list[str] = []
    todo: list = [(top, in_article)]
    lost = 0
    most = sum(n.own_size() for n, _ in _walk(top, in_article)) * 2 / 3 if templates and not in_article else 0
    while todo:
        node, inside = todo.pop()
        if isinstance(node, str):
            parts.append(node)
            continue
        if node.tag in BLOCK:
            parts.append(" ")
            todo.append((" ", inside))
        below = inside or _is_article(node)
        for c in reversed(node.children):
            if isinstance(c, str):
                todo.append((c, below))
                continue
            dropped = is_boilerplate(c, below)
            if not dropped and templates and (_inside(c.digest) if below else c.digest) in templates and (below or c.text_size <= most):
                dropped = True
                lost += c.text_size
            if not dropped:
                todo.append((c, below))
            elif c.tag in BLOCK:
                todo.append((" ", below))
    return parts, lost


def host_of(url_col: str = "url") -> Column:
    """Host of a URL in lower case, without user and port; "" where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _subtrees(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, digest, copy, page) for each candidate of each page that has a host.

    copy is equal for pages of which the tree, or for subtrees within articles the articles, are equal; page is a hash
    of the html.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, digests, copies, numbers = [], [], [], []
            for host, source, number in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                root = parse(source.as_py())
                outside, within = template_candidates(root)
                article = hashlib.blake2b(b"".join(r.digest for r in content_roots(root)), digest_size=8).digest()
                n = len(outside) + len(within)
                hosts += [host] * n
                digests += [*outside, *map(_inside, within)]
                copies += [root.digest] * len(outside) + [article] * len(within)
                numbers += [number] * n
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.binary()), pa.array(copies, pa.binary()), pa.array(numbers, pa.int64())], names=["host", "digest", "copy", "page"])

    rows = pages.select(host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).filter("host != ''")
    return rows.selectExpr("host", "html", "xxhash64(html) AS page").mapInArrow(run, "host string, digest binary, copy binary, page long")


def site_templates(pages: DataFrame, min_pages: int = 10, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, digest): subtrees that at least min_pages different pages of a host have, in any share of its pages.

    Copies of a page count once. Within articles, the articles have to differ, and a subtree that is in an article of
    another host too is a quotation or a common phrase and no template. Pages without a host have no templates.
    """
    pages_of = _subtrees(pages, url_col, html_col).select("host", "digest", "copy").distinct().groupBy("host", "digest").agg(F.count("*").alias("n"))
    counts = materialize(pages_of, "subtrees")
    outside = counts.filter(F.length("digest") == 8).filter(F.col("n") >= min_pages).select("host", "digest")
    within = counts.filter(F.length("digest") > 8).groupBy("digest").agg(F.count("*").alias("hosts"), F.min("host").alias("host"), F.max("n").alias("n"))
    return outside.union(within.filter((F.col("hosts") == 1) & (F.col("n") >= min_pages)).select("host", "digest"))


def extract_main_text(pages: DataFrame, min_pages: int = 10, broadcast_bytes: int = 32 << 20, url_col: str = "url", html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The columns carry of pages (None: all but the html) with text, n_chars (its code points) and template_chars.

    template_chars counts the characters other than white space that template subtrees took from the page.

    Two passes over the html: subtrees are hashed and counted for each host, then each page is parsed again and
    loses what rules and its host's templates name. Templates are sent to all tasks if their measured size is below
    broadcast_bytes and no host has over 1000; else a third pass finds which of them each page has, and pages are joined with these by host and
    a hash of the html, so that no row carries all templates of a large host. Null and empty html, and pages without
    an article: text "" or what is left, never null. Unclosed, cut-off and wrongly nested markup is closed as browsers
    do, in time that grows with the page however deep it nests; a page is in memory once, as a tree. Repeated rows
    give equal texts. An empty table gives no rows.
    """
    importable(pages.sparkSession)
    carry = [c for c in ([c for c in pages.columns if c != html_col] if carry is None else carry) if c not in ("text", "n_chars", "template_chars")]
    templates = materialize(site_templates(pages, min_pages, url_col, html_col), "templates")
    size, most = templates.groupBy("host").count().agg(F.sum("count") * 40, F.max("count")).first()
    host, number, source, known = (free_name(pages, n) for n in ("__host", "__page", "__html", "__templates"))
    rows = pages.select(*carry, host_of(url_col).alias(host), F.coalesce(F.col(html_col), F.lit("")).alias(source))
    small = (size or 0) <= broadcast_bytes and (most or 0) <= 1000
    if small:
        found = templates.groupBy(F.col("host").alias(host)).agg(F.collect_list("digest").alias(known))
        rows = rows.join(F.broadcast(found), host, "left")
    else:
        has = _subtrees(pages, url_col, html_col).select("host", "page", "digest").distinct().join(templates, ["host", "digest"])
        found = has.groupBy(F.col("host").alias(host), F.col("page").alias(number)).agg(F.collect_list("digest").alias(known))
        rows = rows.withColumn(number, F.xxhash64(source)).join(found, [host, number], "left")
    rows = rows.select(*carry, host, known, source)
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(carry)]) + "text string, n_chars long, template_chars long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, site, digests = len(carry), None, frozenset()
        for batch in batches:
            texts = []
            for row in range(batch.num_rows):
                if (now := batch.column(n)[row].as_py()) != site or not small:
                    site, digests = now, frozenset(batch.column(n + 1)[row].as_py() or ())
                texts.append(extract(parse(batch.column(n + 2)[row].as_py()), digests))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([t for t, _ in texts], pa.string()), pa.array([len(t) for t, _ in texts], pa.int64()), pa.array([k for _, k in texts], pa.int64())], names=[*carry, "text", "n_chars", "template_chars"])

    return rows.mapInArrow(run, ddl)

