"""Main text of web pages, with site templates removed.

A first pass hashes every closed container element of a page twice: its markup, and its structure (tags, roles and
classes, with the text masked), since menus and footers of a site differ in their texts. Spark counts on how many
distinct pages of its host each hash occurs, and how much of its page's text lies in it on average. Markup on many
pages of a host is the site's template; so is structure that is on many pages and holds little of their text, as the
article does not. The second pass reads the pages again, deletes template subtrees, leaves out what tags and roles set
apart from the article, and joins the remaining blocks. Class names decide on hosts of too few pages to count; on others
only those of parts that differ from page to page, as comments and adverts do, which counts can't find. An element that
holds the article is never left out by its class, role or form.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SALTS, attach, small_batches, stage, table

#: A subtree is a template if it is on so many pages of its host and on such a share of them.
LEAST_PAGES, SHARE = 10, 0.5
#: Structure that recurs is a template if it holds no more of its pages' texts than this on average.
LITTLE = 0.25
#: An article or main element counts as the page's if it holds so much of the text that is left.
MAIN_SHARE = 0.3
#: Template tables of up to so many hosts and hashes are broadcast; larger ones join by a shuffle.
BROADCAST_ROWS = 100_000
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg"}
NEVER = {"nav", "footer", "aside", "form", "head", "button", "select", "menu", "dialog", "object", "canvas", "audio", "video"}
BLOCKS = {
    "address", "article", "blockquote", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", *NEVER,
}
CONTAINERS = {
    "div", "section", "ul", "ol", "dl", "table", "aside", "nav", "header", "footer", "form", "figure", "details", "article", "main",
}
#: Elements whose end tag may be left out: any of these, or the end of a list or table, ends them too.
OPEN_ENDED = {"p", "li", "dt", "dd", "td", "th", "tr", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"}
NAMES = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "related", "replies",
    "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Names of what differs from page to page.
VARYING = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "comment", "comments", "disqus", "promo", "promoted", "related", "replies", "respond", "sponsor",
    "sponsored",
}
#: Where on a page something is: first parts of class names that a name may stand after.
PLACES = {"blog", "bottom", "global", "left", "main", "page", "primary", "reader", "right", "secondary", "site", "top", "user"}
#: An element holds the article, too, if it has so much of the text of a page without article and main elements.
WHOLE_SHARE = 0.9
#: Last parts of class names that a name may stand before.
THINGS = {"area", "bar", "block", "box", "buttons", "container", "form", "inner", "item", "items", "links", "list", "section", "text", "widget", "wrap", "wrapper"}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
SPACE = re.compile(r"\s+")


def hidden(tag: str, attributes: str, inside: bool, names: set[str], holds: bool) -> bool:
    """Whether an element is not part of the article by its tag, role or class. holds: it holds the article."""
    if tag in NEVER and not (tag == "form" and holds) or tag == "header" and not inside:
        return True
    if holds or not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        value = value.lower().strip("\"'")
        if name.lower() == "role" and value in ROLES:
            return True
        # a name as a whole, one with its thing or in its place: "share-box" and "site-nav", but neither "no-sidebar" nor "news-notice"
        for whole in value.split():
            parts = re.split(r"[-_]+", whole)
            first, last = parts[0] in names, parts[-1] in names
            if whole in names or len(parts) > 1 and (first and (last or parts[-1] in THINGS) or last and parts[0] in PLACES):
                return True
    return False


def subtree_hash(markup: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(SPACE.sub(" ", markup).strip().encode("utf-8", "surrogatepass")) - 2**63


def tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of the tags; raw elements are passed over as one closing tag."""
    at = 0
    while found := TAG.search(html, at):
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            yield found.start(), at, True, "", ""
        elif name in RAW and not found[1]:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else at if name == "svg" else len(html)
            yield found.start(), at, True, "", ""
        else:
            yield found.start(), at, bool(found[1]), name, found[3] or ""


def subtrees(html: str | None) -> list[tuple[int, int, int, int, int]]:
    """(start, end, markup hash, structure hash, characters of text) of the container elements that are closed."""
    html = html or ""
    open_: list[tuple[int, int, int, int]] = []  # start, end of the start tag, tags before, text before
    places: dict[str, list[int]] = {}  # of each name, where in open_
    structure: list[str] = []
    out, text, at = [], 0, 0
    for start, end, closing, name, attributes in tags(html):
        text, at = text + max(0, start - at), end
        if not name:
            continue
        if not closing:
            known = "".join(f" {k.lower()}={v.lower()}" for k, v in ATTRIBUTE.findall(attributes) if k.lower() != "id") if attributes else ""
            structure.append(name + known)
            if name in CONTAINERS:
                places.setdefault(name, []).append(len(open_))
                open_.append((start, end, len(structure) - 1, text))
            continue
        structure.append("/" + name)
        if name in CONTAINERS:
            own = places.get(name, [])
            while own and own[-1] >= len(open_):  # it was left open in an element closed since
                own.pop()
            if own:
                begin, inner, first, before = open_[own[-1]]
                form = subtree_hash("form " + "<".join(structure[first:]))
                out.append((begin, end, subtree_hash(html[inner:start]), form, text - before))
                del open_[own.pop() :]
    return out


def holders(found: list[tuple], html: str) -> set[int]:
    """Where the closed containers start that hold an article or main element, or nearly all text of a page without any."""
    marks = [m.start() for m in re.finditer(r"<(?:article|main)\b", html, re.I)]
    whole, at = 0, 0
    for start, end, *_ in tags(html) if found and not marks else ():
        whole, at = whole + max(0, start - at), end
    return {start for start, end, *_, size in found if any(start <= m < end for m in marks) or whole and size >= WHOLE_SHARE * whole}


def main_text(html: str | None, template: set[int], counted: bool = False) -> str:
    """The blocks of the article, in order, joined by empty lines; empty text for null or a page without any.

    The article is the page's article elements, or else its main element, if they hold MAIN_SHARE of what is left of the
    page; or else all of that. counted: the host has enough pages, so that class names decide on varying parts only.
    """
    html = html or ""
    found = subtrees(html)
    gone = {x[0]: x[1] for x in sorted(found) if x[2] in template or x[3] in template} if template else {}
    rules = (VARYING if counted else NAMES, holders(found, html), {x[0] for x in found})
    lowered, whole = html.lower(), None
    for main in ("article", "main"):
        if f"<{main}" in lowered:
            text = _text(html, gone, main, *rules)
            whole = _text(html, gone, None, *rules) if whole is None else whole
            if text and len(text) >= MAIN_SHARE * len(whole):
                return text
    return _text(html, gone, None, *rules) if whole is None else whole


def _text(html: str, gone: dict[int, int], main: str | None, names: set[str], holds: set[int], closed: set[int]) -> str:
    blocks: list[str] = []
    parts: list[str] = []
    inside, at, skip, depth, until, loose = 0, 0, "", 0, 0, False

    def flush() -> None:
        if parts:
            block = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if block:
                blocks.append(block)
            parts.clear()

    for start, end, closing, name, attributes in tags(html):
        if start < until:
            at = end
            continue
        if not skip and start > at and (inside or main is None):
            parts.append(html[at:start])
        at = end
        if skip:
            if name == skip:
                depth += -1 if closing else 1
            # an element whose end tag may be missing ends with the next of its kind or at the next block's end or start
            ended = skip in OPEN_ENDED and (name == skip and not closing or name in BLOCKS and name != skip and (closing or skip == "p"))
            ended = ended or loose and name in BLOCKS
            if depth == 0 or ended:
                skip = ""
                flush()
            if not ended or closing:
                continue
        if name == main:
            flush()
            inside = max(0, inside + (-1 if closing else 1))
        elif not closing and start in gone and name:
            flush()
            until = at = gone[start]
        elif not closing and name not in VOID and not attributes.endswith("/") and hidden(name, attributes, bool(inside), names, start in holds):
            flush()
            skip, depth, loose = name, 1, name in CONTAINERS and start not in closed  # one that is never closed ends at the next block
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            flush()
    if not skip and (inside or main is None) and at < len(html):
        parts.append(html[at:])
    flush()
    return "\n\n".join(blocks)


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1)).alias("_host")


def site_templates(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(_host, _hash): the templates of hosts of at least LEAST_PAGES distinct pages, on so many pages and SHARE of their
    host's; and a row with a null hash for every such host.

    Copies of a page on its host count once, so that many copies don't make an article a template.
    """

    @F.pandas_udf("array<struct<hash:long,share:double>>")
    def hashes(markup: pd.Series) -> pd.Series:
        out = []
        for html in markup:
            found = subtrees(html)
            whole = max(1, len(TAG.sub("", html or "")))
            shares: dict[int, float] = {}
            for _, _, exact, form, size in found:
                shares[exact] = 0.0
                shares[form] = shares.get(form, 0.0) + size / whole
            out.append([{"hash": k, "share": min(1.0, v)} for k, v in shares.items()])
        return pd.Series(out, dtype=object)

    html = F.col(f"`{html_col}`")
    hosts = pages.select(host_of(url_col), F.xxhash64(html).alias("_page"), hashes(html).alias("_found"))
    distinct = stage(hosts.groupBy("_host", "_page").agg(F.first("_found").alias("_found")))
    each = distinct.select("_host", F.explode("_found").alias("x")).select("_host", F.col("x.hash").alias("_hash"), F.col("x.share").alias("_share"))
    counts = each.groupBy("_host", "_hash").agg(F.count("*").alias("_on"), F.avg("_share").alias("_share")).filter(F.col("_on") >= LEAST_PAGES)
    sizes = stage(distinct.groupBy("_host").agg(F.count("*").alias("_pages")).filter(F.col("_pages") >= LEAST_PAGES))
    many = counts.join(sizes, "_host").filter((F.col("_on") >= SHARE * F.col("_pages")) & (F.col("_share") <= LITTLE))
    return many.select("_host", "_hash").unionByName(sizes.select("_host", F.lit(None).cast("long").alias("_hash")))


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", columns: list[str] | None = None) -> DataFrame:
    """The columns (all, if not given) of pages with text and n_chars.

    A null page has an empty text; pages without a host share the host ''. Columns of pages named text or n_chars are
    replaced, other names are free; rows may repeat; an empty table gives no rows.
    """
    known = stage(site_templates(pages, html_col, url_col))
    by_host = known.groupBy("_host").agg(F.collect_list("_hash").alias("_template"))  # bounded by the elements of a page over SHARE
    rest = [c for c in columns or pages.columns if c.lower() not in ("text", "n_chars")]
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_doc"), F.col(f"`{html_col}`").alias("_html"), host_of(url_col))
    if known.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(by_host), "_host", "left")
    else:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_html"), F.lit(SALTS)))  # the pages of a large host are spread
        with_template = attach(rows, by_host, ["_host"], "_salt")
        rows = with_template.unionByName(rows.join(by_host, "_host", "left_anti"), allowMissingColumns=True)

    @F.pandas_udf("string")
    def text(markup: pd.Series, template: pd.Series) -> pd.Series:
        # a host that was counted has a list, which may be empty
        return pd.Series([main_text(h, set() if t is None else set(t), t is not None) for h, t in zip(markup, template)], dtype=object)

    found = rows.select(*(F.col(f"_doc.`{c}`") for c in rest), text("_html", "_template").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract(table(spark, sf_dir, "pages"), columns=["page_id", "url"])
