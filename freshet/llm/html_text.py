"""Main text of web pages by site style trees: branches that look and read the same all over a host are left out."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, others, pick, small

MADE = ("text", "n_chars")

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Never part of the text.
NOISE = frozenset("head script style noscript template svg math iframe object canvas video audio nav footer aside form button select option textarea input dialog menu title figcaption".split()) - {"figcaption"}
MAIN = frozenset(("article", "main"))
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = frozenset("ul ol dl table select div section article main body".split())
#: Words in class, id or role that tell a branch beside the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disclaimer discussion disqus dfp footer gdpr legal login masthead menu menus modal nav navbar navigation navigations newsletter notice notices notification pager pagination popup popups promo promotion promoted recommended related replies reply respond responses search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar tracking trending widget widgets navigation complementary contentinfo alert header".split()
)

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
#: A tag's rest up to the > that no quoted value holds; possessive, so that it never looks back.
_REST = re.compile(r"""((?>[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)>""")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
#: The style sites' damping of content by variety of presentation (fixed value of the method).
GAMMA = 0.9


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of the page's pieces in one pass: text ("", "", text), open and close tags with their attributes.

    Comments and declarations go, as does what is inside raw elements (scripts and the like). A < that no > follows is text.
    Where some tag's quotes don't close, quotes count no more from there on, so no byte is looked at more than a few times.
    """
    at, end, loose, last = 0, len(page), False, page.rfind(">")
    while at < end:
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            break
        if lt > at:
            yield "", "", page[at:lt]
        for begin, stop in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if page.startswith(begin, lt):
                at = page.find(stop, lt + len(begin))
                at = end if at < 0 else at + len(stop)
                break
        else:
            m = _NAME.match(page, lt)
            if m is None:
                if page[lt + 1] in "!?/":
                    at = page.find(">", lt) + 1
                else:
                    yield "", "", "<"
                    at = lt + 1
                continue
            rest = None if loose else _REST.match(page, m.end())
            if rest is None:
                loose, stop = True, page.find(">", m.end())
                attributes, at = page[m.end() : stop], stop + 1
            else:
                attributes, at = rest[1], rest.end()
            tag, close = m[1].lower(), page[lt + 1] == "/"
            if tag in RAW and not close:
                found = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = found.end() if found else end
                continue
            yield "close" if close else "open", tag, attributes
    if at < end:
        yield "", "", page[at:]


@dataclass(slots=True)
class Element:
    tag: str
    node: int
    noise: bool
    main: bool
    shown: bool  # not inline, so a node of the tree
    home: Element | None = None  # the nearest shown one
    kids: int = 0
    content: int = 0


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)))


_MASK = (1 << 64) - 1


def walk(page: str, drop: frozenset | set = frozenset(), seen: dict | None = None) -> Iterator[tuple[int, bool, bool, str]]:
    """The page's text runs, parted where a block begins or ends: (node, noise, in the main part, text), white space as one blank.

    A node is the hash of the tags from the root with their classes and ids (no positions): the site style tree's element. noise
    tells that the element or one above it is by its kind or its names none of the article, or in drop. seen gets each
    element's node with [its children's kinds in order, its texts], both as hashes, added up over equal nodes.
    """
    stack: list[Element] = []
    run: list[str] = []
    top = Element("", 0, False, False, True)
    here = top.home = top
    opened: Counter = Counter()

    def place() -> Element:
        return stack[-1] if stack else top

    def flush() -> str:
        text = " ".join(html.unescape("".join(run)).split()) if run else ""
        run.clear()
        if text and seen is not None and not here.noise:
            here.home.content = (here.home.content + _hash(text)) & _MASK
        return text

    def leave(upto: int) -> None:
        while len(stack) > upto:
            e = stack.pop()
            opened[e.tag] -= 1
            if seen is not None and e.shown and not e.noise:
                known = seen.setdefault(e.node, [0, 0])
                known[0], known[1] = (known[0] + e.kids) & _MASK, (known[1] + e.content) & _MASK
                up = place().home
                up.content = (up.content + e.content * 0x9E3779B1) & _MASK

    def open_(tag: str, attributes: str) -> None:
        names = [m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(attributes)] if "=" in attributes else []
        words = {w.lower() for n in names for w in _PART.findall(html.unescape(n))}
        above = place()
        main = above.main or (tag in MAIN and not above.noise)
        shown = tag not in INLINE
        node = _hash(above.node, tag, *names) if shown else above.node
        noise = above.noise or tag in NOISE or (tag == "header" and not above.main) or (tag not in ("html", "body", *MAIN) and not words.isdisjoint(BESIDE))
        noise = noise or (shown and node in drop and (not main or (bool(names) and tag not in MAIN)))
        if shown and seen is not None:
            up = above.home
            up.kids = (up.kids * 0x100000001B3 + _hash(tag, *names)) & _MASK
        e = Element(tag, node, noise, main, shown)
        e.home = e if shown else above.home
        opened[tag] += 1
        stack.append(e)

    for kind, tag, rest in tokens(page):
        if not kind:
            if not run:
                here = place()
            run.append(rest)
            continue
        closing = kind == "close"
        noisy = False
        if tag in INLINE and stack and not closing:
            noisy = "=" in rest and not {w.lower() for x in _NAMED.finditer(rest) for w in _PART.findall(x[2] or x[3] or x[4] or "")}.isdisjoint(BESIDE)
        if tag not in INLINE or noisy or (closing and stack and stack[-1].tag == tag and stack[-1].noise):
            if text := flush():
                yield here.node, here.noise, here.main, text
        if tag in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    leave(i)
                    break
                if tag in INLINE and stack[i].shown:
                    break
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    leave(i)
                    break
                if stack[i].shown:
                    break
        ends = CLOSES.get(tag)
        for i in range(len(stack) - 1, -1, -1) if ends and any(opened[x] for x in ends) else ():
            if stack[i].tag in ends:
                leave(i)
                break
            if stack[i].tag in BOUNDS:
                break
        if not rest.endswith("/") or tag not in INLINE:
            open_(tag, rest)
    if text := flush():
        yield here.node, here.noise, here.main, text
    leave(0)


def _signed(x: int) -> int:
    return x - (1 << 63)


def page_tree(page: str) -> tuple[dict[int, list], set[tuple[int, int]], int]:
    """(elements, contents, digest) of a page: each element's [children's kinds, texts below], the (element, text) pairs, and a digest of all blocks."""
    seen: dict[int, list] = {}
    contents, digest = set(), xxhash.xxh3_128()
    for node, noise, main, text in walk(page, seen=seen):
        if not noise:
            digest.update(f"{node}\0{text}\0".encode())
            if not main:
                contents.add((node, _hash(text)))
    return seen, contents, digest.intdigest()


def style_tree(pages: DataFrame, prior: float = 2.0) -> DataFrame:
    """pages (host, html) -> (host, node, content, pages, importance) of each host's merged tree, for branches that no kind or name gives away.

    An element (content null) has the composite importance of its presentation, the entropy of the sequences of children that
    it has on the host's pages, and of its content, the entropy of the texts below it; both as parts of the greatest possible.
    With l different sequences, content counts GAMMA ** l: the more an element's shape varies, the less its words need to. A
    content node (element and text, outside the article) has its text's information, -log(share) as a part of the greatest.
    prior pages that say it matters are added to each, so what was seen on few pages stays: no page count decides alone.

    Pages of a host whose blocks are all the same count once, so copies of a page don't pass for a template. A page gives a row
    for each different element and text, whatever their depth. Partial aggregates by page, shape and text keep hot hosts
    spread over the tasks.
    """

    def rows(it):
        for rb in it:
            seen: dict[tuple, tuple[list, list, list, list]] = {}
            for host, page in zip(rb.column(0).to_pylist(), rb.column(1)):
                elements, contents, digest = page_tree(page.as_py() or "")
                if (k := (host, digest)) not in seen:
                    seen[k] = ([*map(_signed, elements), *(_signed(n) for n, _ in contents)], [*[True] * len(elements), *[False] * len(contents)], [*(_signed(v[0]) for v in elements.values()), *[0] * len(contents)], [*(_signed(v[1]) for v in elements.values()), *(_signed(c) for _, c in contents)])
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in seen], pa.string()), pa.array([_signed(d >> 64) for _, d in seen], pa.int64()), pa.array([_signed(d & _MASK) for _, d in seen], pa.int64()), *(pa.array([v[i] for v in seen.values()], pa.list_(kind)) for i, kind in enumerate(kinds))],
                names=["host", "d0", "d1", "node", "element", "style", "content"],
            )

    each = pages.select("host", "html").mapInArrow(rows, "host string, d0 long, d1 long, node array<long>, element array<boolean>, style array<long>, content array<long>")
    each = each.groupBy("host", "d0", "d1").agg(F.first(F.arrays_zip("node", "element", "style", "content")).alias("z")).select("host", F.explode("z").alias("z")).select("host", "z.*")
    counts = each.groupBy("host", "node", "element", "style", "content").agg(F.count("*").alias("c"))
    whole = counts.where("element")

    def entropy(by: str) -> DataFrame:
        per = whole.groupBy("host", "node", by).agg(F.sum("c").alias("c")).groupBy("host", "node").agg(F.sum("c").alias("pages"), F.count("*").alias(f"n_{by}"), F.sum(F.col("c") * F.log("c")).alias("s"))
        return per.select("host", "node", "pages", f"n_{by}", F.when(F.col("pages") > 1, (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")).otherwise(1.0).alias(f"of_{by}"))

    both = entropy("style").join(entropy("content").drop("pages"), ["host", "node"])
    damped = F.pow(F.lit(GAMMA), F.col("n_style"))
    elements = both.select("host", "node", F.lit(None).cast("bigint").alias("content"), "pages", ((1 - damped) * F.col("of_style") + damped * F.col("of_content")).alias("i"))
    words = counts.where(~F.col("element") & (F.col("c") > 1)).join(both.select("host", "node", "pages"), ["host", "node"])
    words = words.select("host", "node", "content", "pages", F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), 1 - F.log("c") / F.log("pages"))).otherwise(1.0).alias("i"))
    return elements.unionByName(words).select("host", "node", "content", "pages", ((F.col("i") * F.col("pages") + prior) / (F.col("pages") + prior)).alias("importance"))


def main_text(page: str, low: frozenset | set = frozenset(), said: frozenset | set = frozenset()) -> str:
    """The page's text without noise, without the branches in low (unimportant elements) and the (element, text) pairs in said."""
    inside, all_ = [], []
    has_main = False
    for node, noise, main, text in walk(page, low):
        has_main |= main
        if noise or (said and not main and (node, _hash(text)) in said):
            continue
        (inside if main else all_).append(text)
    return " ".join(inside if has_main else all_)


def extract(df: DataFrame, *, page: str = "html", url: str = "url", threshold: float = 0.2, prior: float = 2.0) -> DataFrame:
    """df with text (the article of each page) and n_chars (its code points).

    First each host's different pages are merged into a style tree (style_tree); elements and texts whose importance is below
    threshold go from every page of the host: alike on 9 pages they do with the prior given, more if they vary. Inside an article
    or main element only elements with a class, id or role can go. Scripts, menus, headers, footers, sidebars, notices, adverts,
    forms and comments go by their kind of element or the words in class, id and role, as on most pages their texts change and
    no tree can tell. What is left of the article or main elements, or of the whole page if there are none, is the text:
    character references decoded, white space within a block as one blank, blocks joined by one.

    Null or empty pages have an empty text; null urls have no host, so only kinds and names count; repeated pages get equal
    texts; an empty table gives an empty one; input columns called like a result are replaced. A page takes time in proportion
    to its length, however deep or broken it is.
    """
    scratch = Scratch(df.sparkSession)
    host = F.lower(F.regexp_extract(pick(df, url, "string"), _HOST, 1))
    body = pick(df, page, "string")
    tree = style_tree(df.select(host.alias("host"), body.alias("html")).where(F.col("host") != ""), prior)
    low = tree.where(F.col("importance") < threshold).groupBy("host").agg(F.collect_list(F.struct("node", "content")).alias("__low"))
    low = scratch.save(low.withColumnRenamed("host", "__host"), "low")
    keep = others(df, *MADE)
    dressed = df.select(body.alias("__page"), host.alias("__host"), F.struct(*keep).alias("__row") if keep else F.struct(F.lit(0)).alias("__row"))
    dressed = dressed.join(small(low, scratch, "low"), "__host", "left").select("__page", "__host", "__low", "__row")

    def run(it):
        sets: dict = {}
        for rb in it:
            texts = []
            for p, h, l in zip(rb.column(0), rb.column(1).to_pylist(), rb.column(2)):
                if h not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    known = [(x["node"] + (1 << 63), x["content"]) for x in l.as_py() or ()]
                    sets[h] = {n for n, c in known if c is None}, {(n, c + (1 << 63)) for n, c in known if c is not None}
                texts.append(main_text(p.as_py() or "", *sets[h]))
            yield pa.RecordBatch.from_arrays([rb.column(3), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["__row", *MADE])

    out = dressed.mapInArrow(run, StructType([dressed.schema["__row"], *StructType.fromDDL("text string, n_chars long").fields]))
    return out.select(*([f"__row.`{f}`" for f in dressed.schema["__row"].dataType.names] if keep else []), *MADE)


def op4(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
