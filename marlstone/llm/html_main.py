"""Main text of web pages by equivalence classes of template tokens.

Tokens are tags in their role: the chain of open elements above them. Tokens with
the same occurrence vector (how often they occur in each page of a host) form an
equivalence class. A vector is held as sums of hashes of (page, count), so classes
come from one aggregation however many pages a host has, and partial sums of a host
with a third of all pages meet, not its pages.

Classes that are frequent (in at least ``support`` of the host's pages) and hold two
tokens or more, or one that stands once in every page, are then held against the
pages: a class is valid if its tokens come in one order in all pages (in each of
their repeats) and stand below one and the same token of the template. Valid classes
nest in one another by those tokens; the class that occurs once in every page is the
frame. What stands below a template token and is no token itself is a slot, and each
block of a page is in the slot of the innermost template token above it.

Slots are told once a host. One below menus, headers, footers, sidebars, notices,
adverts, forms or comments is dropped, and so is one outside of articles and mains
whose text is mostly links. A slot is main text if an article (or else a main element) of the template frames it,
and so are the page's other articles beside framed ones. Where the template frames
neither, a page's own article or main element goes first, whatever its role; in pages
without one the gap between the blocks with the same text in all pages is taken whole:
all from the first block that differs to the last, and all inside the nearest element
around the blocks of the template that differ. Element and class names of a page's own
elements decide only where no template token says more.

Templates are small (a row a host); they are sent to all tasks if they are below
``SENT_BYTES`` in all, else pages meet them by host and a salt, so that a host with a
third of all pages is dealt over ``SALTS`` tasks.

Defined results: a null or empty html gives an empty text. Hosts of one page, pages
without a host and pages that lack their template's frame are judged by their own
elements alone. Repeated rows are each extracted; pages may have no id. A very long
page is parsed by one task in time proportional to its length, however deep it nests.
An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import materialize

# Element names by what they do to a text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select button xmp noframes annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded menclose mfenced msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split())
#: Elements within a line of text that are left out without ending it.
BETWEEN = frozenset("script style noscript textarea iframe svg object select button annotation annotation-xml".split())
ASIDE = frozenset("nav aside form footer dialog menu head".split())
CLOSES_ITSELF = frozenset("li dt dd tr td th option".split())
_NAMES = r"nav|navbar|navigation|menu|sidebar|side-?bar|aside|ads?|adverts?|advertisements?|adsense|banner|sponsor(ed)?|promo|cookies?|consent|gdpr|notices?|alert|comments?|commentlist|disqus|respond|reactions|share|sharing|social|related|recommended|breadcrumbs?|footer|header|masthead|newsletter|subscribe|signup|popup|modal|overlay|pagination|pager|widget"
NOT_MAIN = re.compile(rf"({_NAMES})([-_].*)?", re.IGNORECASE)
#: Within an article or main, where a name may also tell what a part of it is about, only parts of a page's frame may follow.
NOT_MAIN_INSIDE = re.compile(rf"({_NAMES})([-_]({_NAMES}|top|bottom|left|right|inner|outer|main|wrap|wrapper|container|box|bar|block|area|section|region|unit|slot|list|links?|items?|icons?|buttons?|btn|form|title|label|body|content|text|message|nav|menu|widget|toggle|posts?|articles?|stories|news|media|thread|count|card|cta|tools|author|heading|headline|grid|row|column|inline|sticky|mobile|desktop|[0-9]+))*", re.IGNORECASE)
COMMENTS = re.compile(r"(comments?|commentlist|disqus|respond|reactions)([-_].*)?", re.IGNORECASE)
ROLES_NOT_MAIN = frozenset("navigation banner contentinfo complementary search form dialog alert".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"

STATS = "host string, role long, kind string, pages long, total long, high long, low long, texts_min long, texts_max long, chars long, linked long"
ORDERS = "host string, cls long, order_min long, order_max long, below_min long, below_max long"
TEMPLATE = "struct<frame:array<long>,mains:array<long>,fixed:array<long>,dropped:array<long>,tokens:array<long>>"
SENT_BYTES, SALTS = 32 << 20, 64


class Template:
    """Roles of a host: ``frame``, ``mains`` (framed slots, or what varies if ``fixed`` is not None), ``dropped`` slots and all ``tokens``."""

    __slots__ = ("dropped", "fixed", "frame", "mains", "tokens")

    def __init__(self, frame=(), mains=(), fixed=None, dropped=(), tokens=()) -> None:
        self.frame, self.mains, self.dropped, self.tokens = (frozenset(x or ()) for x in (frame, mains, dropped, tokens))
        self.fixed = None if fixed is None else frozenset(fixed)


NO_TEMPLATE = Template()


class Element:
    __slots__ = ("article", "aside", "inline", "kind", "linked", "parent", "role", "slot", "tag")

    def __init__(self, tag: str, attributes: str, parent: Element | None, template: Template) -> None:
        said = {k.lower(): a or b or c for k, a, b, c in reversed(ATTRIBUTE.findall(attributes))} if attributes else {}  # the first of a name counts
        names = [*said.get("class", "").split(), *said.get("id", "").split()]
        inside = parent is not None and parent.kind == "article"
        self.tag, self.parent, self.inline = tag, parent, tag in INLINE
        self.role = xxhash.xxh64_intdigest(f"{parent.role if parent else 0}/{tag}.{'.'.join(sorted(names))}") >> 1
        if self.role in template.tokens:
            own = self.role in template.dropped
        else:
            own = tag in ASIDE or tag == "header" and not inside or said.get("role", "").lower() in ROLES_NOT_MAIN
            pattern = COMMENTS if tag == "article" else NOT_MAIN_INSIDE if parent is not None and parent.kind else NOT_MAIN
            own = own or tag not in ("html", "body", "main") and any(pattern.fullmatch(n) for n in names)
        self.aside = own or parent is not None and parent.aside
        self.kind = "article" if tag == "article" else "main" if tag == "main" or said.get("role", "").lower() == "main" else parent.kind if parent else ""
        framed = template.fixed is None and self.role in template.mains
        self.slot = framed or parent is not None and parent.slot
        self.article = framed and tag == "article" or parent is not None and parent.article
        self.linked = tag == "a" or parent is not None and parent.linked

    def block(self) -> Element | None:
        """The innermost element from here up that is no inline one."""
        e = self
        while e is not None and e.inline:
            e = e.parent
        return e

    def above(self) -> list[Element]:
        """All elements from the outermost one to this."""
        out, e = [], self
        while e is not None:
            out.append(e)
            e = e.parent
        return out[::-1]


def parse(page: str, template: Template = NO_TEMPLATE) -> Iterator[tuple[str, Element | None, str, int]]:
    """("open", element, "", 0) or ("text", innermost element, text of a whole block, characters of it in links)."""
    stack: list[Element] = []
    opened: dict[str, int] = defaultdict(int)
    held: list[str] = []
    holder: Element | None = None
    linked = 0

    def block() -> Iterator[tuple[str, Element | None, str, int]]:
        nonlocal held, holder, linked
        text = " ".join(htmllib.unescape("".join(held)).split()) if held else ""
        where, inside, held, linked = holder, linked, [], 0
        if text:
            yield "text", where, text, inside

    def pop() -> Element:
        e = stack.pop()
        opened[e.tag] -= 1
        return e

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            if not held:
                holder = stack[-1] if stack else None
            held.append(page[at:end])
            linked += (end - at) * (bool(stack) and stack[-1].linked)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), (m[3] or m[6] or "")
        if tag not in INLINE and tag not in BETWEEN:
            yield from block()
        elif tag == "br" and held:
            held.append(" ")
        if closing:
            if opened[tag] and tag not in VOID:
                while pop().tag != tag:
                    pass
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}\\b[^>]*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else n if tag in ("script", "style") else at
            continue
        if tag not in INLINE:
            if opened["p"]:
                while opened["p"]:
                    pop()
            elif tag in CLOSES_ITSELF and stack and stack[-1].tag == tag:
                pop()
        e = Element(tag, attributes, stack[-1] if stack else None, template)
        yield "open", e, "", 0
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(e)
            opened[tag] += 1
    yield from block()


def block_role(e: Element | None) -> int:
    """Role of the innermost open element that is no inline one."""
    found = e.block() if e else None
    return found.role if found else 0


def page_tokens(page: str) -> tuple[dict[tuple[int, str], int], dict[int, int], dict[int, list[int]]]:
    """How often each token occurs, by role and kind ("inner": below an article or main); for each role a hash of the text directly in it, and its characters and those of them in links."""
    counts: dict[tuple[int, str], int] = defaultdict(int)
    texts: dict[int, int] = defaultdict(int)
    sizes: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for what, e, text, linked in parse(page):
        if e is None:
            continue
        if what == "open":
            if not e.inline:
                kind = "aside" if e.aside else e.tag if e.tag in ("article", "main") else "inner" if e.kind else "other"
                counts[e.role, kind] += 1
        elif not e.aside:
            role = block_role(e)
            texts[role] = (texts[role] * 31 + (xxhash.xxh64_intdigest(text) >> 1)) & 0x7FFFFFFFFFFFFFFF
            sizes[role][0] += len(text)
            sizes[role][1] += linked
    return counts, texts, sizes


def _batch(rows: dict[tuple, list[int]], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in schema.split(", ")]
    columns = list(zip(*((*k, *v) for k, v in rows.items()), strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums for each host and token of a batch: rows of ``STATS``."""
    for batch in batches:
        found: dict[tuple[str, int, str], list[int]] = {}
        for key, host, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            counts, texts, sizes = page_tokens(page)
            counts[0, "page"] = 1
            for (role, kind), n in counts.items():
                h = xxhash.xxh64_intdigest(f"{key}:{n}")
                t = texts.get(role, -1)
                s = found.setdefault((host, role, kind), [0, 0, 0, 0, t, t, 0, 0])
                for i, x in enumerate((1, n, h >> 32, h & 0xFFFFFFFF)):
                    s[i] += x
                s[4], s[5] = min(s[4], t), max(s[5], t)
                for i, x in enumerate(sizes.get(role, ())):
                    s[6 + i] += x
        yield _batch(found, STATS)


def page_orders(page: str, classes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """For each class (role -> class) in the page: a hash of the order of its tokens, -1 if its repeats differ, and the template token it stands below."""
    order: dict[int, list[int]] = defaultdict(list)
    below: dict[int, int] = {}
    nearest: dict[int, int] = {}  # by id of an element: role of the innermost token at or above it
    keep = []
    for what, e, _, _ in parse(page):
        if what != "open":
            continue
        keep.append(e)  # ids stay taken
        up = nearest[id(e.parent)] if e.parent else 0
        cls = None if e.inline else classes.get(e.role)
        nearest[id(e)] = e.role if cls is not None else up
        if cls is not None:
            order[cls].append(e.role)
            if cls not in below:
                below[cls] = up
    out = {}
    for cls, roles in order.items():
        unit = list(dict.fromkeys(roles))
        times, rest = divmod(len(roles), len(unit))
        regular = not rest and (roles == unit * times or len(unit) == 1)
        out[cls] = (xxhash.xxh64_intdigest(repr(unit)) >> 1 if regular else -1, below[cls])
    return out


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[tuple[str, int], list[int]] = {}
        for host, page, tokens in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
            for cls, (order, below) in page_orders(page, {t["role"]: t["cls"] for t in tokens or ()}).items():
                s = found.setdefault((host, cls), [order, order, below, below])
                s[:] = min(s[0], order), max(s[1], order), min(s[2], below), max(s[3], below)
        yield _batch(found, ORDERS)


def with_host_rows(pages: DataFrame, small: DataFrame) -> DataFrame:
    """``pages`` with the columns of ``small`` (a written table with a row a host): sent to all tasks if it is small, else met by host and salt."""
    size = small.agg(F.sum(F.octet_length(F.to_json(F.struct(*small.columns))))).first()[0] or 0
    if size <= SENT_BYTES:
        return pages.join(F.broadcast(small), "host", "left")
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)))
    return salted.join(small.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["host", "salt"], "left").drop("salt")


def deduce_templates(pages: DataFrame, support: float = 0.6) -> DataFrame:
    """(host, template) of the hosts of ``pages`` (page_id, url, html, host) with two pages or more."""
    known = pages.where("host is not null")
    sums = known.select(F.xxhash64("page_id", "url").alias("key"), "host", "html").mapInArrow(_vectors, STATS)
    adds = [F.sum(c).alias(c) for c in ("pages", "total", "high", "low", "chars", "linked")]
    stats = materialize(sums.groupBy("host", "role", "kind").agg(*adds, F.min("texts_min").alias("texts_min"), F.max("texts_max").alias("texts_max")), "page-tokens")
    size = stats.where("kind = 'page'").select("host", F.col("pages").alias("n"))
    frequent = stats.where("kind != 'page'").join(size, "host").where((F.col("n") >= 2) & (F.col("pages") >= support * F.col("n")))  # few by host: no more than a page has roles
    vector = ["host", "n", "pages", "total", "high", "low"]
    tokens = F.collect_list(F.struct("role", "kind", "chars", "linked", "texts_min", "texts_max"))
    classes = frequent.groupBy(*vector).agg(tokens.alias("tokens")).withColumn("frame", F.expr("pages = n and total = n")).withColumn("cls", F.xxhash64("pages", "total", "high", "low"))
    classes = materialize(classes.where("size(tokens) >= 2 or total > pages or frame").select("host", "cls", "frame", F.explode("tokens").alias("t")).select("host", "cls", "frame", "t.*"), "token-classes")
    marks = materialize(classes.groupBy("host").agg(F.collect_list(F.struct("role", "cls")).alias("tokens")), "host-classes")
    orders = with_host_rows(known, marks).where("tokens is not null").select("host", "html", "tokens").mapInArrow(_orders, ORDERS)
    ends = [getattr(F, c.rsplit("_", 1)[1])(c).alias(c) for c in ("order_min", "order_max", "below_min", "below_max")]
    valid = orders.groupBy("host", "cls").agg(*ends).where("order_min = order_max and below_min = below_max and order_min != -1").select("host", "cls")
    token = classes.join(valid, ["host", "cls"])
    token = token.withColumn("menu", F.expr("kind = 'other' and chars > 0 and 2 * linked > chars"))
    pick = lambda cond: F.collect_set(F.when(cond, F.col("role")))
    other = (F.col("kind") == "other") & ~F.col("menu")
    slots = token.groupBy("host").agg(
        pick(F.col("frame")).alias("frame"),
        pick(F.col("kind") == "article").alias("articles"),
        pick(F.col("kind") == "main").alias("main_roles"),
        pick(other & (F.col("texts_min") < F.col("texts_max"))).alias("varying"),
        pick(other & (F.col("texts_min") == F.col("texts_max")) & (F.col("texts_min") >= 0)).alias("same"),
        pick((F.col("kind") == "aside") | F.col("menu")).alias("dropped"),
        F.collect_set("role").alias("tokens"),
    )
    framed = (F.size("articles") > 0) | (F.size("main_roles") > 0)
    mains = F.when(F.size("articles") > 0, F.col("articles")).when(F.size("main_roles") > 0, F.col("main_roles")).otherwise(F.col("varying"))
    return slots.select("host", F.struct("frame", mains.alias("mains"), F.when(~framed, F.col("same")).alias("fixed"), "dropped", "tokens").cast(TEMPLATE).alias("template"))


def gap(blocks: list[tuple[Element | None, str]], varying: frozenset[int], fixed: frozenset[int]) -> list[str]:
    """The blocks between fixed ones, and those in the nearest element around all varying ones if fixed ones are outside it."""
    roles = [block_role(e) for e, _ in blocks]
    free = [i for i, r in enumerate(roles) if r not in fixed]
    if not varying or not free:
        return []
    around: list[Element] | None = None
    for (e, _), r in zip(blocks, roles, strict=True):
        if r in varying:
            above = e.block().above()[:-1]
            around = above if around is None else [a for a, b in zip(around, above, strict=False) if a is b]
    if around:
        known: dict[int, bool] = {}

        def within(e: Element | None) -> bool:
            path = []
            while e is not None and id(e) not in known and e is not around[-1]:
                path.append(e)
                e = e.parent
            found = e is not None and (e is around[-1] or known[id(e)])
            known.update((id(x), found) for x in path)
            return found

        inside = [within(e) for e, _ in blocks]
    else:
        inside = [False] * len(blocks)
    if not any(r in fixed and not i for r, i in zip(roles, inside, strict=True)):
        inside = [False] * len(blocks)
    return [text for i, (_, text) in enumerate(blocks) if free[0] <= i <= free[-1] or inside[i]]


def main_text(page: str, template: Template = NO_TEMPLATE) -> str:
    """Blocks of the framed slots, or without any in this page, of its article, its main element, the gap of its template or its body."""
    ranked: list[list[str]] = [[], [], []]
    blocks: list[tuple[Element | None, str]] = []
    in_article, seen = False, set()
    for what, e, text, _ in parse(page, template):
        if what == "open":
            if e.role in template.frame:
                seen.add(e.role)
            continue
        if e is not None and e.aside:
            continue
        kind = e.kind if e else ""
        if e is not None and e.slot:
            ranked[0].append(text)
            in_article = in_article or e.article
        if kind == "article" or e is not None and e.article:
            ranked[1].append(text)
        elif kind == "main":
            ranked[2].append(text)
        blocks.append((e, text))
    if len(seen) < len(template.frame):
        return main_text(page)
    if in_article:
        ranked[0] = ranked[1]
    found = next((r for r in ranked if r), None) or (gap(blocks, template.mains, template.fixed) if template.fixed is not None else None)
    return "\n\n".join(found or [text for _, text in blocks])


def extract_main(pages: DataFrame, support: float = 0.6) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    host = F.lower(F.regexp_extract("url", HOST, 1))
    rows = rows.withColumn("host", F.when(host != "", host))
    joined = with_host_rows(rows, materialize(deduce_templates(rows, support), "templates")).select("page_id", "url", "html", "host", "template")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str | None, Template] = {}
            texts = []
            for i, (page, host) in enumerate(zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True)):
                if host not in known:
                    said = batch.column("template")[i].as_py()
                    known[host] = Template(**said) if said else NO_TEMPLATE
                texts.append(main_text(page, known[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(spark.read.parquet(f"{sf_dir}/pages.parquet"))
