"""Main text of web pages by site template removal.

Every page is parsed once into blocks of text and element subtrees. A subtree's hash stands for its tags
and text; hashes are counted per host, each once per page (copies of one page are one page), and a subtree that
recurs on many pages of its host is deleted. Only hashes are shuffled for the count, summed before the shuffle;
text is shuffled only for pages that hold a subtree counting may delete.

What a page says about itself goes first: scripts, styles, menus, headers, footers, sidebars, forms, notices, adverts and
comments, by element, role, class or id. Inside an article or main element nothing is deleted by counting,
unless most of its text is links: passages, copies of pages and standing lines belong to the article. Where a page has such
an element, text outside it is not main text.

Defined results. Null or empty html, or html without main text: empty text. A null url is a host of its own name. Repeated rows
count as pages of their own and are answered each on its own. An id may be null or repeat. Broken markup is read to its end.
"""
from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: A subtree is template if it is on at least so many pages of its host, however many pages the host has.
PAGES = 5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math object canvas select".split())
DROPPED = frozenset("head nav header footer aside form button menu dialog fieldset".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset(["article", "main"])
#: Elements that end an open p, and which open elements a start tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table div article section main body html td th".split())
BLOCK = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adbox|adslot|banner|promo|sponsor(?:ed)?|nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|header|masthead|footer|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|subscription|share|sharing|social|related|recommended|comments?|comment-list|respond|replies|disqus|pagination|pager|skip|widget)(?:$|[\s_-])", re.I)
TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")


class Element:
    __slots__ = ("tag", "drop", "main", "holds_main", "links", "size", "hash", "number")

    def __init__(self, tag: str, drop: bool, main: bool, number: int):
        self.tag, self.drop, self.main, self.number = tag, drop, main, number
        self.holds_main, self.links, self.size = False, 0, 0
        self.hash = xxhash.xxh64()
        self.hash.update(f"<{tag}>")


def boilerplate(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in ("body", "html", "article", "main") and "comment" not in attributes:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name in ("class", "id") and NAMES.search(value) or name == "role" and value.lower() in ROLES or name == "aria-hidden" and value == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes))


def parse(html: str) -> tuple[list[tuple[str, tuple[int, ...], bool]], dict[int, int], int]:
    """Blocks (text, numbers of the elements around it, inside a main element), the hashes by number of the elements that
    counting may delete, and the hash of the whole page. What the page itself marks as boilerplate is left out of all."""
    root = Element("#", False, False, 0)
    stack, blocks, found, count = [root], [], {}, 0
    text: list[str] = []
    around: tuple[int, ...] = ()

    def flush() -> None:
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if joined:
                blocks.append((joined, around, stack[-1].main))

    def close(upto: int) -> None:
        nonlocal around
        while len(stack) > upto:
            if stack[-1].tag not in INLINE:
                flush()
            e = stack.pop()
            e.hash.update("</>")
            if not e.drop:
                may_go = 2 * e.links > e.size if e.main else not e.holds_main
                if e.tag not in INLINE and e.tag not in ("html", "body") and e.size and may_go:
                    found[e.number] = e.hash.intdigest() - (1 << 63)
                p = stack[-1]
                p.holds_main |= e.main or e.holds_main
                p.hash.update(e.hash.digest())
                p.size += e.size
                p.links += e.size if e.tag == "a" else e.links
                if e.tag not in INLINE:
                    around = tuple(x.number for x in stack if x.tag not in INLINE and x.number)

    def say(piece: str) -> None:
        top = stack[-1]
        if piece and not top.drop:
            text.append(piece)
            top.hash.update(piece)
            top.size += len(piece)

    at = 0
    while m := TAG.search(html, at):
        say(html[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        tag = name.lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in BLOCK and stack[i].tag in SCOPE:
                    break
            continue
        if tag == "br" or tag == "hr":
            say(" ")
        if tag in VOID:
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SCOPE:
                    break
        elif tag in ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ENDS[tag]:
                    close(i)
                    break
                if stack[i].tag in SCOPE - ENDS[tag]:
                    break
        attributes = m.group(3)
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{tag}(?![a-zA-Z0-9])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if attributes.endswith("/") and tag not in INLINE and tag not in BLOCK:
            continue
        top = stack[-1]
        if tag not in INLINE:
            flush()
        count += 1
        drop = top.drop or boilerplate(tag, attributes)
        main = not drop and (top.main or tag in MAIN or tag == "div" and re.search(r"role\s*=\s*[\"']?main\b", attributes) is not None)
        stack.append(Element(tag, drop, main, count))
        if tag not in INLINE and not drop:
            around += (count,)
    say(html[at:])
    close(1)
    flush()
    return blocks, found, root.hash.intdigest() - (1 << 63)


def host_of(url: str):
    """Host of a url column in lower case, without user and port; of a null or relative url the empty one."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


PARSED = "page bigint, hashes array<bigint>, blocks array<struct<text:string,around:array<bigint>>>"


def parsed_page(html: str) -> tuple[int, list[int], list[dict]]:
    """Hash of the page, hashes of its subtrees that counting may delete, and the blocks that are main text unless one of those around them goes."""
    blocks, found, page = parse(html)
    has_main = any(main for _, _, main in blocks)
    kept = [{"text": text, "around": [found[n] for n in around if n in found]} for text, around, main in blocks if main or not has_main]
    return page, sorted(set(found.values())), kept


def templates(parsed: DataFrame, pages_least: int) -> DataFrame:
    """(host, hash) of the subtrees that recur on many pages of the host."""
    pages = parsed.groupBy("host", "page").agg(F.first("hashes").alias("hashes"))
    counts = pages.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("pages"))
    return counts.filter(F.col("pages") >= pages_least).select("host", "hash")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", pages_least: int = PAGES) -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    kind, url_kind = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()

    def parse_rows(batches):
        block_type = pa.list_(pa.struct([("text", pa.string()), ("around", pa.list_(pa.int64()))]))
        for batch in batches:
            made = [parsed_page(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "url", "host")), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array([m[2] for m in made], block_type)],
                ["id", "url", "host", "page", "hashes", "blocks"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    parsed = written(rows.mapInArrow(parse_rows, f"id {kind}, url {url_kind}, host string, {PARSED}"), "html-blocks")
    template = templates(parsed.select("host", "page", "hashes"), pages_least)
    around = F.flatten(F.col("blocks.around"))
    in_doubt = parsed.filter(F.size(around) > 0)
    # pages of one host and hash are alike, so what goes is found once for all of them
    pairs = in_doubt.select("host", "page", F.explode(F.array_distinct(around)).alias("hash")).distinct()
    gone = pairs.join(template, ["host", "hash"]).groupBy("host", "page").agg(F.collect_set("hash").alias("gone"))
    decided = in_doubt.join(gone, ["host", "page"], "left").select(
        "id", "url", F.filter("blocks", lambda b: ~F.arrays_overlap(b["around"], F.coalesce(F.col("gone"), F.array().cast("array<bigint>")))).alias("blocks"))
    clear = parsed.filter(F.size(around) <= 0).select("id", "url", "blocks")
    out = clear.unionByName(decided).withColumn("text", F.array_join(F.col("blocks.text"), " "))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))
