"""Operator 1: main text of web pages, with site templates removed.

A page is read once by a tolerant tokenizer that keeps a stack of open elements
(a block closes an open paragraph, a list item its predecessor, and so on). Each block
element has a hash of its tags and text, built up from its children's; attributes
(links, ids, the mark of the current page) are no part of it, and its last bit
marks prose inside an article. Spark counts, per host, on how many different pages a
subtree recurs, and those on many pages of their host are site template and are deleted: on
LEAST_PAGES at least and on a share SHARE of the host's pages or, on larger hosts, ROOTS times the
root of their number; prose inside an article on half of them. Pages that have the
same text are one page for this count, so copies of an article don't make it a template.

Beside the templates, elements that are never article text go by their tag, role or hidden state, and such that
have a whole class or id word of a short list, but no paragraph, heading or quotation inside an article.
Of a page with `main` elements their content is the main text, of others all that
remains. Character references are decoded, white space inside a block becomes
one space, blocks are trimmed and joined by \\n.

Bounds: templates per host are few (a page has a bounded share of them), so they are
joined as one array for each host; that table is broadcast only if its counted
rows are within a bound.

Defined results: null or empty html gives empty text; a null or odd url counts
as host ''; an empty table gives no rows; a very long or deeply nested page is read whole, in time that grows
with its length; of equal pages with different subtrees the least list counts (ties are no matter of order);
unclosed elements end with their parent, unclosed controls (buttons, pictures, selections) with the next block or their parent, unclosed quotes and tags
with their tag or the next one; self-closing elements have no content; an unclosed script or comment has all that follows; repeated rows each give a
row; other columns, also those named like the result's, are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import map_slices, small_or_not, stored

#: A subtree is template if so many different pages of its host, and so large a share of them, have it.
LEAST_PAGES, SHARE, ROOTS = 5, 0.2, 5
#: Paragraphs and headings inside an article may well be quoted or copied: only so large a share makes them template.
PROSE, PROSE_SHARE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split()), 0.5

NAME, STOP = re.compile(r"[a-zA-Z][^\s/<>]*"), re.compile(r"[<>\"']")
#: Elements whose content is no text of the page; those of the first kind, if they are never closed, have all that follows as their content, those of the second kind none of it.
SWALLOWS = frozenset("script style noscript template textarea iframe title".split())
CONTROLS = frozenset("svg select button object".split())
#: One attribute after the other, its value with it, so that names inside values are none.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("option optgroup a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mspace semantics".split())
GONE = frozenset("nav footer aside head menu dialog audio video canvas fieldset input option optgroup annotation annotation-xml".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
NAMES = frozenset(
    "nav navbar navigation menu footer sidebar aside ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related-posts recommended recommendations breadcrumb breadcrumbs comment comments commentlist disqus reply replies respond "
    "share-buttons ad-banner cookie-notice cookie-banner site-header site-footer widget skip pagination pager copyright legal disclaimer alert toolbar topbar masthead form".split()
)
#: A form with an article, a main heading or so many paragraphs is the page's frame and stays; of other forms nothing does.
FORM = 3
#: What an opening tag ends, besides a paragraph ended by every block.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that are never template as a whole.
WHOLE = frozenset("html body main article".split())
BARRIER = frozenset("ul ol dl table article main section div body html".split())


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each tag, from front to back.

    Comments, declarations and elements whose content is no text are one tag without a name. A tag ends at its first `>` outside a quoted value, or where the next tag begins; a
    quote opens a value only after `=` and if it is closed somewhere. What was looked for in vain is not looked for again, so the time is that of reading the page once.
    """
    n, at, absent = len(page), page.find("<"), set()

    def after(what: str, start: int) -> int:
        """Where the next `what` begins, or -1."""
        found = -1 if what in absent else page.find(what, start)
        if found < 0:
            absent.add(what)
        return found

    while at >= 0:
        mark = page[at + 1 : at + 2]
        name = None if mark in ("!", "?") else NAME.match(page, at + 1 + (mark == "/"))
        if name is None and mark not in ("!", "?"):
            at = page.find("<", at + 1)  # a sign, no tag
            continue
        if name is None:
            close = "-->" if page.startswith("<!--", at) else ">"
            end = after(close, at + 4 if close == "-->" else at)
            end = n if end < 0 else end + len(close)
            yield at, end, False, "", ""
        else:
            k = name.end()
            end = stop = n
            while m := STOP.search(page, k):
                sign, k = m[0], m.end()
                if sign == ">":
                    end, stop = k, k - 1
                    break
                if sign == "<":
                    if page[k : k + 1].isalpha() or page[k : k + 1] in ("/", "!", "?"):
                        end = stop = k - 1
                        break
                    continue
                before = k - 2
                while page[before].isspace():
                    before -= 1
                if page[before] == "=":
                    value = after(sign, k)
                    k = k if value < 0 else value + 1
            tag, own = name[0].lower(), page[name.end() : stop]
            if mark != "/" and (tag in SWALLOWS or tag in CONTROLS):
                if own.endswith("/"):
                    yield at, end, False, "", ""
                else:
                    close = None if f"</{tag}" in absent else _CLOSING[tag].search(page, end)
                    if close:
                        end = after(">", close.end())
                        end = n if end < 0 else end + 1
                        yield at, end, False, "", ""
                    else:
                        absent.add(f"</{tag}")
                        end = n if tag in SWALLOWS else end
                        yield at, end, False, tag if tag in CONTROLS else "", own
            else:
                yield at, end, mark == "/", tag, own
        at = page.find("<", end)


_CLOSING = {tag: re.compile(rf"</{tag}(?![^\s/>])", re.I) for tag in SWALLOWS | CONTROLS}


def _gone(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no article text by its tag or attributes; inside: within an article."""
    if tag in GONE or (tag == "header" and not inside):
        return True
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and tag not in WHOLE and not (inside and tag in PROSE):
            words = value.split()
            if not NAMES.isdisjoint(words) or ("header" in words and not inside):
                return True
    return False


_MASK, _FACTOR = (1 << 64) - 1, 0x9E3779B97F4A7C15


def _after(h: int, x: int) -> int:
    h = ((h ^ x) * _FACTOR) & _MASK
    return h ^ (h >> 29)


def blocks(page: str, templates: frozenset[int] = frozenset(), hashes: list[int] | None = None) -> list[str]:
    """The blocks of main text; subtrees whose hash is in templates are left out. hashes gets those of all block subtrees."""
    stack: list[list] = []  # [tag, first block, dropped, hash so far, prose before it]
    inner: list[list] = []  # the blocks among them
    opened: Counter[str] = Counter()
    found: list[tuple[str, int]] = []  # text of a block, 1 inside main
    text: list[str] = []
    gone, articles, mains, last = 0, 0, 0, 0
    prose, muted = 0, False  # weight of articles, headings and paragraphs so far; inside a control that is never closed

    def flush() -> None:
        if text:
            s = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if s:
                found.append((s, mains > 0))
                if inner:
                    inner[-1][3] = _after(inner[-1][3], xxhash.xxh64_intdigest(s.encode("utf-8", "replace")))

    def close() -> None:
        nonlocal gone, articles, mains
        if stack[-1][0] not in INLINE:
            flush()
        tag, first, dropped, h, weight = stack.pop()
        if tag == "form" and prose - weight < FORM:
            del found[first:]
        opened[tag] -= 1
        if tag not in INLINE:
            inner.pop()
            if not gone:
                if inner:
                    inner[-1][3] = _after(inner[-1][3], h)
                if tag not in WHOLE:
                    h = (h | 1 if tag in PROSE and articles else h & ~1) - (1 << 63)
                    if hashes is not None and len(found) > first:
                        hashes.append(h)
                    if h in templates:
                        del found[first:]
        gone -= dropped
        articles -= tag == "article"
        mains -= tag == "main"

    for a, b, closing, tag, attributes in tags(page):
        if not gone and not muted and a > last:
            text.append(page[last:a])
        last = b
        if not tag:
            continue
        if tag in CONTROLS and not closing:
            muted = True
            continue
        muted = muted and tag in INLINE and not (closing and opened[tag])
        if closing:
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    while len(stack) > i:
                        close()
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                text.append(" ") if not gone else None
            continue
        if tag not in INLINE:
            flush()
            ends = ENDS.get(tag, frozenset())
            for i in range(len(stack) - 1, -1, -1) if opened["p"] or any(opened[x] for x in ends) else ():
                if stack[i][0] == "p" or stack[i][0] in ends:
                    while len(stack) > i:
                        close()
                    if stack[i - 1 : i] and stack[i - 1][0] in ends:
                        continue
                    break
                if stack[i][0] in BARRIER:
                    break
        articles += tag == "article"
        mains += tag == "main"
        prose += FORM if tag in ("article", "main", "h1") else tag == "p"
        dropped = int(_gone(tag, attributes, articles > 0))
        gone += dropped
        own = [tag, len(found), dropped, 0, prose]
        stack.append(own)
        opened[tag] += 1
        if tag not in INLINE:
            own[3] = _after(1, xxhash.xxh64_intdigest(tag))
            inner.append(own)
    if not gone and not muted and last < len(page):
        text.append(page[last:])
    flush()
    while stack:
        close()
    top = max((k for _, k in found), default=0)
    return [s for s, k in found if k == top]


def page_text(page: str | None, templates: frozenset[int] = frozenset()) -> str:
    return "\n".join(blocks(page, templates)) if page else ""


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]*)"


def site_templates(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(host, templates): the hashes of the subtrees that recur on many different pages of a host."""

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            lists, same = [], []
            for page in part.column(1).to_pylist():
                own: list[int] = []
                same.append(xxhash.xxh64_intdigest("\n".join(blocks(page, hashes=own)).encode()) - (1 << 63) if page else 0)
                lists.append(sorted(set(own)))
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(same, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["host", "page", "hashes"])

        return run

    own = map_slices(pages.select("host", F.col("html").alias("text")), make, "host string, page long, hashes array<bigint>")
    different = stored(own.filter(F.size("hashes") > 0).groupBy("host", "page").agg(F.min("hashes").alias("hashes")))
    counts = different.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    totals = different.groupBy("host").agg(F.count("*").alias("pages"))
    prose = F.col("hash").bitwiseAND(F.lit(1)) == 1
    enough = F.when(prose, F.col("pages") * max(share, PROSE_SHARE)).otherwise(F.least(F.col("pages") * share, ROOTS * F.sqrt("pages")))
    many = counts.join(totals, "host").filter(F.col("n") >= enough)
    return stored(many.groupBy("host").agg(F.array_sort(F.collect_list("hash")).alias("templates")))


def main_text(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    kinds = dict(pages.dtypes)
    pages = pages.select("page_id", "url", "html", F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")).alias("host"))
    templates = small_or_not(site_templates(pages, least, share))

    def make():
        sets: dict[tuple, frozenset[int]] = {}

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            known = part.column(3)
            cut = known.offsets.to_numpy()
            flat = known.values.to_numpy(zero_copy_only=False)
            out = []
            for i, page in enumerate(part.column(2).to_pylist()):
                key = flat[cut[i] : cut[i + 1]].tobytes() if known[i].is_valid else b""
                if key not in sets:
                    if len(sets) > 256:
                        sets.clear()
                    sets[key] = frozenset(np.frombuffer(key, np.int64).tolist())
                out.append(page_text(page, sets[key]))
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return run

    joined = pages.join(templates, "host", "left").select("page_id", "url", F.col("html").alias("text"), "templates")
    return map_slices(joined, make, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
