"""Operator 2: main text of web pages by union-free wrapper inference.

Pages of one host come from few templates. Every page is reduced to a token stream (tags, and
texts as hashes); the distinct streams of a host are aligned one after another into a wrapper, a
regular expression without unions: equal tags stay, differing texts become slots (``#``),
neighbouring groups of one shape become repeats ``( )+`` and groups that one side lacks become
options ``( )?``. A mismatch is resolved where the cross search finds the nearest match. No page is
left out: streams are merged in the order of their digests, in shares of each host, then the shares.

The wrapper decides what a page's text is:

* Its ``main`` and ``article`` elements are the article if they hold at least half of the text that
  all pages of the host have outside of menus and the like. What lies beside them is then left out,
  whatever a single page's proportions are.
* Otherwise the whole page is, less what the wrapper shows to be boilerplate: elements that every
  page has with one and the same text, and lists of links.

A page without the places that the wrapper names is read by itself, by the same rules. Tags and
class names that say "menu", "advert" and so on hold no article text in either case.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from functools import lru_cache, reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_or_not
from .common import map_arrow, short_batches, table, written

#: Distinct pages a host must have before a text common to all of them counts as boilerplate.
BOILERPLATE_PAGES = 8
#: A required element of a wrapper is a menu if so many percent of its text, in this many links a
#: page at least, is link text.
MENU_PERCENT, MENU_LINKS = 90, 3
#: Bytes of decisions that are broadcast; beyond, pages and decisions are joined by salted host.
BROADCAST_BYTES = 16 << 20
SALT = 32
#: Pages of a host that a task merges, about: more are merged in shares; shares that a task merges.
SHARE_PAGES, FAN_IN = 500, 64
#: Open elements at a time; deeper ones are read as children of the last of these.
DEPTH = 256

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "noscript", "iframe", "noembed", "noframes"))
_BLOCK = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold no article text.
_SKIP = frozenset(
    "head title script style noscript template nav header footer aside form menu button select textarea input iframe object embed svg canvas "
    "audio video dialog search noembed noframes xmp fieldset".split()
)
#: Names (words of class, id and role) that say the same of a block, and words that may go with them.
_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar sidebars aside complementary contentinfo ad ads advert adverts "
    "advertisement advertisements adbox sponsor sponsors sponsored promo promos promotion promotions banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments commentlist disqus respond replies "
    "reply search toolbar pagination pager hidden skip".split()
)
_WITH = frozenset("site page global top bottom left right box bar container wrapper wrap list area section block link links button buttons slot unit widget posts form".split())
#: Elements inside a text, in which only these names count.
_INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark math q s samp small span strong sub sup table tbody td th time tr u var".split())
_INLINE_NAMES = frozenset(("ad", "ads", "advert", "adverts", "advertisement", "advertisements", "sponsored", "hidden"))
#: A start tag of the left closes an open element of the right, up to the given fences.
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tr td th thead tbody", "table")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}

#: A tag from its "<" on: a quote opens a value only right after "=". Nothing is tried twice.
_TAG_AT = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)?)*+)>""")
_ATTRIBUTES = re.compile(r"""([^\s=/"'][^\s=/]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'][^\s]*))?)?""")
_DIGITS = re.compile(r"\d+$")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    """Element (``name`` holds the words of its class, id and role that are not numbered) or, with
    tag ``#``, text. ``skipped`` elements hold no article text."""

    __slots__ = ("tag", "name", "kids", "text", "skipped")

    def __init__(self, tag: str, name: str = "", text: str = "", skipped: bool = False):
        self.tag, self.name, self.text, self.skipped = tag, name, text, skipped
        self.kids: list[Node] = []


def _tells(word: str, names: frozenset[str]) -> bool:
    parts = [_DIGITS.sub("", x) for x in re.split(r"[-_]+", word) if x]
    return any(x in names for x in parts) and all(x in names or x in _WITH or not x for x in parts)


def _named(tag: str, attributes: str) -> tuple[str, bool]:
    """The name of an element, and whether it is skipped."""
    words: list[str] = []
    unseen = False
    for m in _ATTRIBUTES.finditer(attributes):
        key = m[1].lower()
        if key in ("class", "id", "role"):
            words += (m[2] or m[3] or m[4] or "").lower().split()
        elif key == "hidden" or (key == "aria-hidden" and (m[2] or m[3] or m[4] or "").lower() == "true"):
            unseen = True
        elif key == "style" and _UNSEEN.search((m[2] or m[3] or m[4] or "").lower()):
            unseen = True
    names = _INLINE_NAMES if tag in _INLINE else _NAMES
    fixed = [] if tag in ("html", "body") else [w for w in words if not any(c.isdigit() for c in w)]
    return " ".join(fixed), unseen or tag in _SKIP or (tag not in ("html", "body", "main", "article") and any(_tells(w, names) for w in words))


def parse(source: str) -> Node:
    """A light tree of a page: implied end tags, raw text elements and stray tags are handled,
    character references in texts are not decoded yet. Time is linear in the length."""
    root = Node("")
    stack, deeper = [root], defaultdict(int)  # deeper: elements below DEPTH that await an end tag
    is_open: dict[str, int] = defaultdict(int)
    at, n = 0, len(source)

    pieces: list[str] = []  # of a text that no tag has ended yet

    def end_text() -> None:
        if pieces:
            stack[-1].kids.append(Node("#", "", "".join(pieces)))
            pieces.clear()

    def close(i: int) -> None:
        end_text()
        for x in stack[i:]:
            is_open[x.tag] -= 1
        del stack[i:]

    while at < n:
        mark = source.find("<", at)
        if mark != at:
            pieces.append(source[at : mark if mark >= 0 else n])
            if mark < 0:
                break
        at = mark
        m = _TAG_AT.match(source, at)
        if m is None:
            after = source[at + 1 : at + 2]
            if source.startswith("<!--", at):
                end = source.find("-->", at + 2)
                at = n if end < 0 else end + 3
            elif re.match("/?[A-Za-z]", source[at + 1 : at + 3]):
                break  # the page ends inside of a tag
            elif after in ("!", "?", "/"):
                end = source.find(">", at)
                at = n if end < 0 else end + 1
            else:
                pieces.append("<")
                at += 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if deeper[name]:
                deeper[name] -= 1
            elif is_open[name]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name))
            continue
        if name in _BLOCK and is_open["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in _BLOCK:
                    break
        if name in _CLOSES:
            closed, fence = _CLOSES[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in fence:
                    break
                if stack[i].tag in closed:
                    close(i)
                    break
        attributes = m[3]
        fixed, skipped = _named(name, attributes) if attributes else ("", name in _SKIP)
        node = Node(name, fixed, "", skipped)
        end_text()
        stack[-1].kids.append(node)
        if name in _RAW:
            end = _raw_end(name).search(source, at)
            node.kids.append(Node("#", "", source[at : end.start()]))
            at = source.find(">", end.start()) + 1 or n
        elif name not in _VOID and not attributes.endswith("/"):
            if len(stack) < DEPTH:
                stack.append(node)
                is_open[name] += 1
            else:
                deeper[name] += 1
    end_text()
    return root


@lru_cache(maxsize=16)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])|\Z", re.I)


# ---------------------------------------------------------------- wrappers

# A wrapper item is a list [many, maybe, tag, name, text, size, links, kids]: text is a hash or None
# for a slot (of an element, a hash of all it holds); size and links are the characters of text and of
# link text that all merged pages have in it. The name of a skipped element starts with "!".
_MANY, _MAYBE, _TAG, _NAME, _TEXT, _SIZE, _LINKS, _KIDS = range(8)


def _node_key(node: Node) -> tuple[str, str]:
    return node.tag, f"!{node.name}" if node.skipped else node.name


def _plain_hash(value: object) -> int:
    return xxhash.xxh32_intdigest(repr(value).encode("utf-8", "surrogatepass"))


def skeleton(node: Node) -> list:
    """A page, or an element of one, as a wrapper of its own: texts hashed, repeated neighbours
    folded."""
    if node.tag == "#":
        text = _SPACE.sub(" ", node.text).strip()
        return [0, 0, "#", "", _plain_hash(text), len(text), 0, []]
    kids = [] if node.tag in _RAW else [skeleton(k) for k in node.kids if k.tag != "#" or not k.text.isspace()]
    size = sum(k[_SIZE] for k in kids)
    whole = _plain_hash([(k[_TAG], k[_NAME], k[_TEXT]) for k in kids])
    return [0, 0, *_node_key(node), whole, size, size if node.tag == "a" else sum(k[_LINKS] for k in kids), _folded(kids)]


def _key(item: list) -> tuple:
    return item[_TAG], item[_NAME]


def _folded(items: list) -> list:
    """Neighbours of one tag and name become one repeated item, texts only if both are options."""
    out: list = []
    for item in items:
        if out and (item[_TAG] != "#" or (item[_MAYBE] and out[-1][_MAYBE])) and _key(out[-1]) == _key(item):
            out[-1] = _merged(out[-1], item)
            out[-1][_MANY] = 1
        else:
            out.append(item)
    return out


def _merged(a: list, b: list) -> list:
    text = a[_TEXT] if a[_TEXT] == b[_TEXT] else None
    kids = align(a[_KIDS], b[_KIDS]) if a[_KIDS] or b[_KIDS] else []
    return [a[_MANY] | b[_MANY], a[_MAYBE] | b[_MAYBE], a[_TAG], a[_NAME], text, a[_SIZE] + b[_SIZE], a[_LINKS] + b[_LINKS], kids]


def _optional(item: list) -> list:
    return [item[_MANY], 1, *item[_TAG:]]


def align(a: list, b: list) -> list:
    """One list of items for two: matches merged, what one side lacks made optional. At a mismatch
    each side is searched for the other's next item, and the nearer find is taken."""
    ka, kb = list(map(_key, a)), list(map(_key, b))
    if ka == kb:
        return [_merged(x, y) for x, y in zip(a, b, strict=True)]
    where: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
    for held, keys in zip(where, (ka, kb), strict=True):
        for i, k in enumerate(keys):
            held[k].append(i)

    def ahead(held: dict, key: tuple, start: int) -> int | None:
        places = held.get(key, ())
        i = bisect_left(places, start)
        return places[i] if i < len(places) else None

    out: list = []
    i = j = 0
    while i < len(a) and j < len(b):
        if ka[i] == kb[j]:
            out.append(_merged(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        in_b, in_a = ahead(where[1], ka[i], j), ahead(where[0], kb[j], i)
        if in_b is None and in_a is None:
            out += [_optional(a[i]), _optional(b[j])]
            i, j = i + 1, j + 1
        elif in_a is None or (in_b is not None and in_b - j <= in_a - i):
            out += [_optional(x) for x in b[j:in_b]]
            j = in_b
        else:
            out += [_optional(x) for x in a[i:in_a]]
            i = in_a
    return _folded(out + [_optional(x) for x in a[i:] + b[j:]])


def expression(item: list) -> str:
    """The wrapper as a union-free regular expression."""
    if item[_TAG] == "#":
        body = "#" if item[_TEXT] is None else f"'{item[_TEXT]:08x}'"
    else:
        inner = "".join(map(expression, item[_KIDS]))
        name = item[_TAG] + (f".{item[_NAME].replace(' ', '.')}" if item[_NAME] else "")
        body = f"<{name}>{inner}</{item[_TAG]}>" if item[_TAG] else inner
    if item[_MANY]:
        body = f"({body})+"
    return f"({body})?" if item[_MAYBE] else body


def _mass(item: list) -> int:
    """Characters of all pages that may be article text."""
    if item[_TAG] == "#":
        return item[_SIZE]
    return 0 if item[_NAME].startswith("!") else sum(map(_mass, item[_KIDS]))


def decision(wrapper: list, distinct: int) -> dict:
    """What a wrapper of so many distinct pages says: ``main``, the places (tags and names from the root) of
    the article; or else ``fixed``, [place, hash] of texts that all pages have, and ``menus``, places
    of lists of links."""
    main: list[list] = []
    held = 0

    def marked(item: list, path: list) -> None:
        nonlocal held
        for k in item[_KIDS]:
            if k[_TAG] == "#" or k[_NAME].startswith("!"):
                continue
            here = [*path, list(_key(k))]
            if k[_TAG] in ("main", "article"):
                main.append(here)
                held += _mass(k)
            else:
                marked(k, here)

    marked(wrapper, [])
    if held and 2 * held >= _mass(wrapper):
        return {"main": [x for i, x in enumerate(main) if x not in main[:i]]}
    fixed: list[list] = []
    menus: list[list] = []

    def rest(item: list, path: list) -> None:
        for k in item[_KIDS]:
            if k[_TAG] == "#" or k[_NAME].startswith("!"):
                continue
            here = [*path, list(_key(k))]
            if k[_SIZE] and not k[_MAYBE] and k[_TEXT] is not None:
                fixed.append([here, k[_TEXT]])
            elif k[_SIZE] and k[_TAG] not in _INLINE and 100 * k[_LINKS] >= MENU_PERCENT * k[_SIZE] and _many_links(k):
                menus.append(here)
            elif not k[_MAYBE] or k[_TEXT] is None:
                rest(k, here)

    if distinct >= BOILERPLATE_PAGES:
        rest(wrapper, [])
    return {"fixed": fixed, "menus": menus}


def _many_links(item: list) -> bool:
    """Whether an element has a repeated link, or MENU_LINKS of them."""

    def count(x: list) -> int:
        own = 1 if x[_TAG] == "a" else sum(map(count, x[_KIDS]))
        return own * MENU_LINKS if x[_MANY] else own

    return sum(map(count, item[_KIDS])) >= MENU_LINKS


# ---------------------------------------------------------------- texts

_SPACE = re.compile(r"\s+")


def block_texts(region: Node, dropped: frozenset[int] = frozenset()) -> Iterator[str]:
    """Texts of a region's blocks in page order, references decoded, white space made single.
    Elements whose ``id()`` is in ``dropped`` are left out."""
    parts: list[str] = []

    def done() -> Iterator[str]:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                yield text

    todo: list[Node | None] = list(reversed(region.kids))
    while todo:
        node = todo.pop()
        if node is None:
            yield from done()
        elif node.tag == "#":
            parts.append(node.text)
        elif node.tag == "br":
            parts.append("\n")
        elif not node.skipped and id(node) not in dropped:
            if node.tag in _BLOCK:
                yield from done()
                todo.append(None)
            todo += reversed(node.kids)
    yield from done()


def _at(root: Node, paths: list[list]) -> list[Node]:
    """Elements of the page at one of the places, in page order."""
    wanted: dict = {}
    for path in paths:
        at = wanted
        for key in path:
            at = at.setdefault(tuple(key), {})
        at[None] = True
    found: list[Node] = []
    todo: list[tuple[Node, dict]] = [(root, wanted)]
    while todo:
        node, at = todo.pop()
        if None in at:
            found.append(node)
        elif at:
            todo += [(k, at[key]) for k in reversed(node.kids) if k.tag != "#" and (key := _node_key(k)) in at]
    return found


def _marked(root: Node) -> list[Node]:
    """The outermost main and article elements of the page, in page order."""
    found, todo = [], list(reversed(root.kids))
    while todo:
        node = todo.pop()
        if node.tag != "#" and not node.skipped:
            if node.tag in ("main", "article"):
                found.append(node)
            else:
                todo += reversed(node.kids)
    return found


def extract(source: str | None, said: dict | None) -> str:
    """Main text of one page, by the ``decision`` on its host's wrapper. Where that names places of
    the article and the page has text there, it is that text. Otherwise it is the page's own main
    and article elements if they hold at least half of its text, or the page less the wrapper's
    boilerplate; boilerplate that would be over half of the page is taken for text."""
    if not source:
        return ""
    root = parse(source)
    said = said or {}
    text = "\n".join(t for r in _at(root, said.get("main", [])) for t in block_texts(r))
    if text:
        return text
    whole = "\n".join(block_texts(root))
    text = "\n".join(t for r in _marked(root) for t in block_texts(r))
    if text and 2 * len(text) >= len(whole):
        return text
    same = {id(n) for path, digest in said.get("fixed", ()) for n in _at(root, [path]) if skeleton(n)[_TEXT] == digest}
    same |= {id(n) for n in _at(root, said.get("menus", []))}
    text = "\n".join(block_texts(root, frozenset(same))) if same else whole
    return text if 2 * len(text) >= len(whole) else whole


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; of null and odd URLs the empty text."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


_PARTS = "host string, shares bigint, share bigint, digest bigint, pages bigint, seen array<bigint>, shown string"


def _merged_shares(rows: DataFrame) -> DataFrame:
    """``rows`` (_PARTS) of each host, dealt into ``shares`` shares, merged in the order of their
    digests, so that the result depends neither on the order nor on the layout of the rows. Rows
    stream through in that order, in the memory of one wrapper. ``seen`` are the least digests of
    distinct pages, BOILERPLATE_PAGES of them at most; a repeated page is merged once."""
    names, kinds = zip(*(x.split() for x in _PARTS.split(", ")), strict=True)
    types = [pa.string() if k == "string" else pa.list_(pa.int64()) if k.startswith("array") else pa.int64() for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, pages, seen, whole = None, None, 0, set(), None

        def row() -> pa.RecordBatch:
            text = json.dumps(whole)
            cols = (*([x] for x in key), [xxhash.xxh64_intdigest(text) - 2**63], [pages], [sorted(seen)], [text])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in batches:
            for *own, digest, n, some, shown in zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True):
                if key == own and digest == last:
                    continue
                if key == own:
                    pages, whole = pages + n, _merged(whole, json.loads(shown))
                    seen = set(sorted(seen.union(some))[:BOILERPLATE_PAGES])
                else:
                    if key is not None:
                        yield row()
                    key, pages, seen, whole = own, n, set(some), json.loads(shown)
                last = digest
        if key is not None:
            yield row()

    short_batches(rows.sparkSession)
    share = F.pmod(F.xxhash64("digest"), F.col("shares"))
    return rows.withColumn("share", share).repartition("host", "share").sortWithinPartitions("host", "share", "digest").mapInArrow(run, _PARTS)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, n_pages (distinct ones), wrapper (regular expression) and main (decision, JSON) of every
    host, from all its pages. Hosts of many pages are merged in shares, and the shares in turn."""

    def skeletons(batch: pa.RecordBatch) -> dict:
        rows = {}
        for host, shares, page in zip(*(batch.column(c).to_pylist() for c in ("host", "shares")), batch.column("html"), strict=True):
            shown = json.dumps(skeleton(parse(page.as_py())))
            digest = xxhash.xxh64_intdigest(shown) - 2**63
            rows[host, digest] = (host, shares, 0, digest, 1, [digest], shown)
        return dict(zip((x.split()[0] for x in _PARTS.split(", ")), zip(*rows.values(), strict=True), strict=True))

    rows = pages.select(host_of(F.col("url")).alias("host"), "html").where("html is not null and html <> ''")
    shares = F.ceil(F.count(F.lit(1)) / SHARE_PAGES).alias("shares")
    many = written(pages.select(host_of(F.col("url")).alias("host")).groupBy("host").agg(shares).where("shares > 1"))
    most = many.agg(F.max("shares")).first()[0] or 1
    rows = rows.join(small_or_not(many), "host", "left").withColumn("shares", F.coalesce("shares", F.lit(1).cast("bigint")))
    parts, done = map_arrow(rows, skeletons, _PARTS), []
    while most > 1:
        merged = written(_merged_shares(parts))
        done.append(merged.where("shares = 1"))
        parts = merged.where("shares > 1").withColumn("shares", F.ceil(F.col("shares") / FAN_IN))
        most = -(-most // FAN_IN)
    done.append(_merged_shares(parts))
    parts = reduce(DataFrame.unionByName, done)

    def infer(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"host": batch.column("host").to_pylist(), "n_pages": batch.column("pages").to_pylist(), "wrapper": [], "main": []}
        for seen, shown in zip(batch.column("seen").to_pylist(), batch.column("shown").to_pylist(), strict=True):
            whole = json.loads(shown)
            out["wrapper"].append(expression(whole))
            out["main"].append(json.dumps(decision(whole, len(seen))))
        return out

    return map_arrow(parts, infer, "host string, n_pages bigint, wrapper string, main string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Nulls: a null or empty page has the empty text; a null url belongs to the host without name;
    a null page_id stays null. Repeated rows give repeated results and count once in a wrapper.
    Very long pages are read whole in time linear in their length. An empty table gives no rows.
    Other columns are not read.
    """
    spark = pages.sparkSession
    schema = "page_id bigint, url string, text string, n_chars bigint"
    main = written(wrappers(pages).select("host", "main"))
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    size = main.agg(F.sum(F.octet_length("host") + F.octet_length("main"))).first()[0] or 0
    small = size <= BROADCAST_BYTES
    held = spark.sparkContext.broadcast({r["host"]: json.loads(r["main"]) for r in main.collect()} if small else {})

    def texts(batch: pa.RecordBatch) -> dict:
        hosts = batch.column("host").to_pylist()
        paths = [held.value.get(h) for h in hosts] if small else [json.loads(m) if m else None for m in batch.column("main").to_pylist()]
        out = [extract(x.as_py(), p) for x, p in zip(batch.column("html"), paths, strict=True)]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": out, "n_chars": list(map(len, out))}

    if not small:
        salted = main.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salt = F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")
        rows = rows.withColumn("salt", salt).join(salted, ["host", "salt"], "left")
    return map_arrow(rows, texts, schema)


def op2_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; see :func:`main_text`."""
    return main_text(table(spark, sf_dir, "pages"))
