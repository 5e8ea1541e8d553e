"""Operator 10: main text of web pages by equivalence-class template deduction.

Pages of a host share a template. Every structural token of a page (the path of an opened element, or a
whole block of text) has an occurrence vector over the host's pages; tokens of equal vectors form an
equivalence class. Vectors are never gathered: each is an exclusive-or of hashes of (page, occurrences),
so tokens are added up per host in Spark and compared by that fingerprint. Classes that are large and
frequent enough nest into the host's template: elements that every page opens once bound its slots, and
blocks of constant text are part of it. The slot that holds most of the text outside links is the main
one; extraction takes its blocks, without those in menus, adverts, forms and the like.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimwire.llm.common import in_batches, written
from slimwire.llm.urls import host_of

# Elements by their part in a page, and names of classes, ids and roles that mark what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe title textarea svg math canvas object video audio".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
                   "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
                   "table tbody tfoot thead tr ul".split())
ASIDE = frozenset("nav footer aside form button select menu dialog head".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "p"}, "option": {"option"}}
MARKS = frozenset("ad ads adv advert advertisement adverts advertising banner sponsor sponsored promo promoted promotion nav navbar navigation menu "
                  "breadcrumb breadcrumbs pagination pager toolbar share sharing social sidebar related recommended recommendations trending widget "
                  "cookie cookies consent gdpr notice notices alert popup modal overlay subscribe newsletter paywall signup login comment comments "
                  "commentlist respond replies reply disqus discussion footer copyright legal masthead topbar header search skip".split())
INNER = MARKS - frozenset("banner notice notices alert legal copyright footer header masthead search skip widget trending".split()) | frozenset(["adsbygoogle"])
HELPERS = frozenset("list box bar bars section container wrapper wrap block area slot unit inner outer content item items link links button buttons form title group "
                    "panel site page main primary secondary global top bottom left right mobile desktop sticky js article post posts story stories entry thread count "
                    "form widget icon icons set row col column".split())
CONTAINERS = frozenset("div section ul ol dl table figure aside nav footer header details fieldset ins center".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())

_TAGS = r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|%s<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>"""
TAG = re.compile(_TAGS % r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|""", re.S)
PLAIN_TAG = re.compile(_TAGS % "()()()(?!)|", re.S)   # quotes are not looked at
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?+""")
PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")

BROKEN = 16        # tags with an open quote from which a page's quotes are not looked at any more
DEEPEST = 64       # levels of a path; elements further down belong to the level's last one
SUPPORT = 3        # pages of a host in which a template's token stands, at least
COMMON = 0.5       # share of the host's pages, at least
LARGE = 2          # tokens of a class, at least
SLOT = 0.95        # share of the text that a main slot holds, at least: of the host's, and of each page's own


def _named(value: str, marks: frozenset) -> bool:
    """Whether a class or id says that its element isn't the article: one of its names is a mark as a whole, alone or with
    helping words around it. ``ad`` is a word of other phrases too, so other names beside it must help as well."""
    names = [[p.lower() for p in PARTS.split(name) if p] for name in value.split()]
    helps = [all(p in marks or p in HELPERS or p[0].isdigit() for p in parts) for parts in names]
    for parts, help_ in zip(names, helps, strict=True):
        if help_ and any(p in marks for p in parts) and (parts[0] not in ("ad", "ads") or all(helps)):
            return True
    return False


def _marked(tag: str, attributes: str, outer: bool, article: bool = False) -> bool:
    """Whether an element isn't part of the article, by its tag, class, id or role. ``outer``: outside any article and main
    element; ``article``: within an article, where only containers of comments, share bars, adverts and the like are marked."""
    if tag in ASIDE or tag == "header" and outer:
        return True
    if not attributes or tag in ("html", "body", "article", "main") and not article:
        return False
    marks = INNER if article else MARKS if outer else MARKS - {"header"}
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and (not article or tag in CONTAINERS or tag == "article") and _named(value, marks):
            return True
    return False


class Block:
    """A run of text between two edges of block elements."""

    __slots__ = ("aside", "linked", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], aside: bool, linked: int):
        self.text, self.path, self.aside, self.linked = text, path, aside, linked


def blocks(page: str | None) -> tuple[list[Block], Counter]:
    """The blocks of a page in order, and how often each element path is opened (paths hold block elements with their first class)."""
    page = page or ""
    out: list[Block] = []
    opened: Counter = Counter()
    stack: list[tuple[str, bool]] = []        # tag, whether it or one above isn't the article
    inside: Counter = Counter()               # tags of the stack
    paths: list[tuple[str, ...]] = [()]
    soft: list[str] = []                      # inline elements that aren't part of the article
    text: list[str] = []
    links, linked, broken = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, paths[-1], bool(stack and stack[-1][1]), min(linked, len(whole))))
            text.clear()
        linked = 0

    def pop() -> None:
        inside[stack.pop()[0]] -= 1
        paths.pop()

    at, limit = 0, page.rfind(">") + 1        # what opens behind the last ">" is no tag
    while m := (TAG if broken < BROKEN else PLAIN_TAG).search(page, at, limit):
        if m.start() > at and not soft:
            piece = page[at:m.start()]
            text.append(piece)
            linked += len(piece) if links else 0
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if at == limit and page.startswith(("<!--", "<![CDATA["), m.start()) and not page.endswith(("-->", "]]>"), m.start(), at):
                at = len(page)                # never closed
            continue
        broken += m[5] is not None
        tag, close, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if close:
            if tag in BLOCKS:
                flush()
                if inside[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                soft.clear()
                links = 0
            elif tag == "a":
                links = 0
            elif tag in ("td", "th"):
                text.append(" ")
            elif soft and soft[-1] == tag:
                soft.pop()
            continue
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            at = page.find(">", end.end()) + 1 if end else 0
            at = at or len(page)
            continue
        if tag == "br" or tag in ("td", "th"):
            text.append(" ")
        article = inside["article"] > 0
        if tag in BLOCKS:
            flush()
            soft.clear()
            links = 0
            if tag in VOID:
                continue
            while stack and (stack[-1][0] in CLOSES.get(tag, ()) or stack[-1][0] == "p"):
                pop()
            aside = bool(stack and stack[-1][1]) or _marked(tag, attributes, not (inside["article"] or inside["main"]), inside["article"] > 0)
            name = next(("".join(v) for k, *v in ATTRIBUTE.findall(attributes) if k.lower() == "class"), "") if attributes else ""
            stack.append((tag, aside))
            inside[tag] += 1
            paths.append((*paths[-1], tag + ("." + name.split()[0] if name.split() else "")) if len(paths[-1]) < DEEPEST else paths[-1])
            opened[paths[-1]] += 1
        elif tag == "a":
            links = 1
        elif tag not in VOID and not attributes.endswith("/"):
            if soft:
                if tag == soft[0]:
                    soft.append(tag)
            elif attributes and _marked(tag, attributes, False, article):
                soft.append(tag)
    rest = page[at:]
    rest = rest[:rest.find("<!--")] if "<!--" in rest else rest
    if rest and not soft:
        text.append(rest)
    flush()
    return out, opened


def _key(path: tuple[str, ...]) -> str:
    return "/".join(path)


def _hash(*values: object) -> int:
    return int.from_bytes(blake2b("\0".join(map(str, values)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


TOKENS = "host string, token string, pages long, vector long, once long, chars long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token of the pages read: in how many it stands, the fingerprint of its occurrences, in how many it
    stands once, and the text outside links below it (elements) or its own (texts, which stand for a path each)."""
    def flush(held: dict) -> pa.RecordBatch:
        keys = list(held)
        cols = list(zip(*held.values(), strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                                           *(pa.array(list(c), pa.int64()) for c in cols)], ["host", "token", "pages", "vector", "once", "chars"])

    held: dict[tuple, list[int]] = {}
    for batch in batches:
        for row, host in enumerate(batch.column("host").to_pylist()):
            page = batch.column("html")[row].as_py()
            me = _hash(page)
            found, opened = blocks(page)
            at, below = Counter(), Counter()
            for b in found:
                if not b.aside:
                    at[b.path] += len(b.text) - b.linked
            for p, n in at.items():
                for k in range(1, len(p) + 1):
                    below[p[:k]] += n
            texts = Counter((b.text, b.path) for b in found)
            free = {(b.text, b.path): 0 if b.aside else len(b.text) - b.linked for b in found}
            tokens = ([("<" + _key(p), n, below[p]) for p, n in opened.items()]
                      + [("=%x/%s" % (_hash(t) & (2 ** 64 - 1), _key(p)), n, n * free[t, p]) for (t, p), n in texts.items()])
            for token, n, chars in [*tokens, ("#", 1, sum(len(b.text) - b.linked for b in found if not b.aside))]:
                x = held.setdefault((host, token), [0, 0, 0, 0])
                x[0] += 1
                x[1] ^= _hash(me, n)
                x[2] += n == 1
                x[3] += chars
            if len(held) > 100_000:
                yield flush(held)
                held = {}
    if held:
        yield flush(held)


def templates(pages: DataFrame, support: int = SUPPORT, common: float = COMMON, large: int = LARGE, slot: float = SLOT) -> DataFrame:
    """(host, main, constant): the path of the main slot of each host's template (null: none), and the hashes of its constant texts.

    ``pages``: page_id, url, html, host. Counts cover all pages of a host; a host of few pages has no row."""
    # copies of a page say nothing of a template, so that each content of a host counts once
    contents = pages.groupBy("host", F.sha2(F.coalesce("html", F.lit("")), 256).alias("__content")).agg(F.first("html").alias("html"))
    counted = written(contents.select("host", "html").transform(in_batches, _tokens, TOKENS).groupBy("host", "token")
                      .agg(F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), F.sum("once").alias("once"), F.sum("chars").alias("chars"))
                      .filter(F.col("pages") >= support), "tokens")
    totals = counted.filter("token = '#'").select("host", F.col("pages").alias("all_pages"), F.col("chars").alias("text"))  # one row a host
    # a host's tokens are gathered only when frequent, so there are no more than 1 / common times those of a page
    frequent = counted.join(totals, "host").filter(F.col("pages") >= common * F.col("all_pages"))
    kind = F.substring("token", 1, 1)
    # constant text is the template's own: what it adds to the elements around it is taken off
    same = frequent.filter(kind == "=").join(frequent.groupBy("host", "vector", "pages").agg(F.count("*").alias("size")).filter(F.col("size") >= large), ["host", "vector", "pages"])
    own = same.select("host", "chars", F.split(F.expr("substring(token, 1 + locate('/', token))"), "/").alias("steps"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("steps")), lambda k: F.array_join(F.slice("steps", F.lit(1), k), "/"))
    taken = own.select("host", "chars", F.explode(F.concat(F.array(F.lit("")), prefixes)).alias("path")).groupBy("host", "path").agg(F.sum("chars").alias("taken"))
    path = F.when(kind == "<", F.substring("token", 2, 1 << 20)).when(kind == "#", F.lit(""))
    net = (frequent.filter(kind != "=").withColumn("path", path).join(taken, ["host", "path"], "left")
           .withColumn("net", F.col("chars") - F.coalesce("taken", F.lit(0))))
    whole = net.filter("path = ''").select("host", F.col("net").alias("all_net"))
    slots = net.filter("path <> ''").join(whole, "host").filter((F.col("once") == F.col("pages")) & (F.col("net") >= slot * F.col("all_net")) & (F.col("net") > 0))
    main = slots.groupBy("host").agg(F.max(F.struct(F.size(F.split("path", "/")).alias("depth"), F.col("net"), F.col("path"))).alias("main"))
    constant = same.groupBy("host").agg(F.array_distinct(F.collect_list(F.substring_index(F.expr("substring(token, 2)"), "/", 1))).alias("constant"))
    found = totals.select("host").join(main, "host", "left").join(constant, "host", "left")
    return found.select("host", F.col("main.path").alias("main"), F.coalesce("constant", F.array().cast("array<string>")).alias("constant"))


def main_text(page: str | None, main: str | None = None, constant: frozenset = frozenset(), slot: float = SLOT) -> str:
    """The article's blocks joined by two line ends.

    Where the page has a ``main`` element with text, all blocks of its main elements, else all of its ``article`` elements. On
    other pages ``main``, the main slot of the host's template, or as much around it as holds the page's own text;
    there the template's ``constant`` blocks go."""
    found, _ = blocks(page)
    kept = [b for b in found if not b.aside]
    for tag in ("main", "article"):
        within = [b for b in kept if any(step.split(".")[0] == tag for step in b.path)]
        if within:
            return "\n\n".join(b.text for b in within)
    kept = [b for b in kept if "%x" % (_hash(b.text) & (2 ** 64 - 1)) not in constant]
    free = sum(len(b.text) - b.linked for b in kept)
    path = tuple(main.split("/")) if main else ()
    while path and sum(len(b.text) - b.linked for b in kept if b.path[:len(path)] == path) < max(slot * free, 1):
        path = path[:-1]
    return "\n\n".join(b.text for b in kept if b.path[:len(path)] == path)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, main, constant in zip(*(batch.column(c) for c in ("html", "main", "constant")), strict=True):
            texts.append(main_text(page.as_py(), main.as_py(), frozenset(constant.as_py() or ())))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """Each row of ``pages`` (page_id, url, html) with its main text and the text's code points.

    Null, empty and tag-less pages: the text as it is, empty if none. Null urls and urls without a host share the
    host "". Repeated rows are extracted each and count once for the template; other columns are ignored; an empty table
    gives no rows. Nothing is dropped within the article but what is marked as something else. A page of any length
    is read in one pass: tags that never end are text, of more than DEEPEST levels the last ones share a path, and a page with
    more than BROKEN open quotes is read without looking at quotes."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    # the templates are a table of their own, so that the join of a hot host's pages can be split
    joined = rows.join(written(templates(rows), "templates"), "host", "left").select("page_id", "url", "html", "main", "constant")
    return joined.transform(in_batches, _extract, "page_id long, url string, text string, n_chars long")
