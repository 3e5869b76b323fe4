"""Main text of web pages by template deduction: equivalence classes of the tokens that a host's pages share.

Tokens are roles and words. A role is the path of an element's block ancestors, each with those of its classes and ids
that several pages of the host have; a word outside of article elements is a token of the role around it. A token's
occurrence vector holds how often each page of the host has it, and tokens of equal vectors are a class. A class is part
of a template if enough pages have it and it is large or stands once on nearly every page that has it. Roles of such
classes are the skeleton; as paths they are ordered and nested. Words of a class are template text where nearly all
pages have them in one order, in one role that most pages with that role fill so.

What lies under a skeleton role and no deeper one is a slot. A host may have several templates, and a page has the
classes it has. Text of rarer or repeated roles belongs to the slot around them. A page's article is what stands in its
article elements; without one, all slots that are not template text alone. Parts beside the article are told by name,
unless they hold most of the text.

Spark sums vectors, as hashes of page and count, groups tokens by them, and counts orders and slots; only what a
template shares is gathered, as much as some pages have.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.llm import shared

#: Elements that run on in a line, and those that hold no end tag.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not read or not the article.
RAW = "script style noscript template textarea iframe svg object title"
ASIDE = frozenset("nav footer aside form button select menu dialog head".split())
ARTICLE = frozenset(["article", "main"])
FRAME = ARTICLE | {"html", "body"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th pre blockquote figure figcaption".split())
#: Words in a class or id that name parts beside the article.
BESIDE = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disclaimer disqus footer masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo "
    "promotion related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: A start tag of the first kind ends an open element of the second: paragraphs, list items, cells.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: A word of a class or id, or a role, belongs to a host's templates if this share of its pages has it, and two at least.
SUPPORT = 0.05
#: A role stands once if it does on this share of the pages that have it.
ONCE = 0.9
#: A class is large with this many tokens.
LARGE = 2
#: More than this share is most: of a slot's text in links, of a role's pages with a word, of a page's text in an element.
MOST = 0.5

# a quote opens a value only after an equals sign; elsewhere it is a character like others
_ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<(?P<raw>{RAW.replace(' ', '|')})(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)\s*>|$)|<[!?][^>]*>"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_ATTRS})>",
    re.S | re.I,
)
_PARTS = re.compile(r"[^a-z0-9]+")
_NAMES = re.compile(r"""\b(?P<of>class|id|role)\s*=\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\s"'>]+))""", re.I)


@dataclass
class Page:
    """Elements (the page itself first): parent, role, tag, whether a class or an id names it as beside the article.
    Blocks: element, text with white space as single blanks, code points in links."""

    parents: list[int] = field(default_factory=lambda: [0])
    roles: list[str] = field(default_factory=lambda: [""])
    tags: list[str] = field(default_factory=lambda: [""])
    named: list[bool] = field(default_factory=lambda: [False])
    named_by_id: list[bool] = field(default_factory=lambda: [False])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def chars(self) -> list[int]:
        """Code points of text in each element and all below it."""
        out = [0] * len(self.parents)
        for k, text, _ in self.blocks:
            out[k] += len(text)
        for k in range(len(out) - 1, 0, -1):
            out[self.parents[k]] += out[k]
        return out

    def counts(self) -> Counter:
        return Counter(r for r, t in zip(self.roles, self.tags, strict=True) if t not in TEXT)

    def words(self) -> list[tuple[int, int]]:
        """Words outside of article elements in page order, as hashes: of their role, and of role and word."""
        inside = [False] * len(self.parents)
        for k in range(1, len(inside)):
            inside[k] = inside[self.parents[k]] or self.tags[k] in ARTICLE
        out = []
        for k, text, _ in self.blocks:
            if not inside[k]:
                role = self.around(k)
                under = _digest(role)
                out += [(under, _digest(f"{role}\n{word}")) for word in text.split()]
        return out

    def around(self, k: int) -> str:
        """The role that the words of element ``k`` belong to: that of the nearest element which is no part of a text."""
        while self.tags[k] in TEXT:
            k = self.parents[k]
        return self.roles[k]

    def beside(self, large: set[str]) -> list[bool]:
        """Which elements are, or lie in, something beside the article; a header is if it stands outside of articles.

        Names do not tell of the page's frame, of articles, of what holds the one article, of ``large`` roles and of
        headings; ids do not tell inside articles, where they are made from headings.
        """
        n = len(self.parents)
        inside, holds = [False] * n, [False] * n
        for k in range(1, n):
            inside[k] = inside[self.parents[k]] or self.tags[k] in ARTICLE
        outer = [k for k in range(1, n) if self.tags[k] in ARTICLE and not inside[self.parents[k]]]
        for k in outer if len(outer) == 1 else [k for k in outer if self.tags[k] == "main"]:
            while k and not holds[k]:
                holds[k] = True
                k = self.parents[k]
        out = [False] * n
        for k in range(1, n):
            tag, up = self.tags[k], self.parents[k]
            named = self.named[k] or (self.named_by_id[k] and not inside[k])
            by_name = named and tag not in FRAME | HEADINGS and not holds[k] and self.roles[k] not in large
            out[k] = out[up] or tag in ASIDE or (tag == "header" and not inside[up]) or by_name
        return out

    def slots(self, skeleton: set[str], repeated: set[str], large: set[str]) -> list[tuple[str, str, int, str]]:
        """The blocks that are not beside the article, as slot, text, code points in links, and role of their words.

        An article that stands once on the page is a slot also if the host's pages seldom have it.
        """
        beside = self.beside(large)
        counts = self.counts()
        bones = {r for r, n in counts.items() if n == 1 and _in_article(r.rpartition("/")[2]) and r not in repeated} | skeleton
        of = [""] * len(self.parents)
        for k in range(1, len(of)):
            of[k] = self.roles[k] if self.tags[k] not in TEXT and self.roles[k] in bones else of[self.parents[k]]
        return [(of[k], text, linked, self.around(k)) for k, text, linked in self.blocks if not beside[k]]


def read_page(page: str, words: set[str] | None = None) -> Page:
    """Elements and blocks of a page; roles have the classes and ids among ``words``, or all."""
    out = Page()
    stack = [0]
    held: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.blocks.append((stack[-1], text, min(linked, len(text))))
        linked = 0

    def read(part: str) -> None:
        nonlocal linked
        if part:
            held.append(part)
            linked += len(part.strip()) if links else 0

    for token in _TOKEN.finditer(page):
        read(page[at : token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                held.append(" ")
            elif tag == "a":
                links = 0 if token["end"] else 1
            continue
        flush()
        if token["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if out.tags[stack[k]] == tag:
                    del stack[k:]
                    links = 0
                    break
            continue
        top = out.tags[stack[-1]]
        if top == "p" or top in _ENDS.get(tag, ()):
            stack.pop()  # a block ends an open paragraph, an item the item before it
            links = 0
        if tag in VOID or token["attrs"].endswith("/"):
            continue
        of_class, of_id = _split_names(token["attrs"]) if token["attrs"] else ((), ())
        names = {*of_class, *of_id}
        out.parents.append(stack[-1])
        above = out.roles[stack[-1]]
        own = ".".join([tag, *sorted(n for n in names if words is None or n in words)])
        out.roles.append(f"{above}/{own}" if above else own)
        out.tags.append(tag)
        out.named.append(_tells(of_class))
        out.named_by_id.append(_tells(n for n in of_id if words is None or n in words))  # an id of one page is its own
        stack.append(len(out.parents) - 1)
    read(page[at:])
    flush()
    return out


def _split_names(markup: str) -> tuple[set[str], set[str]]:
    """Words of classes and ARIA roles, and of ids."""
    of_class: set[str] = set()
    of_id: set[str] = set()
    for m in _NAMES.finditer(markup):
        value = m["a"] or m["b"] or m["c"] or ""
        (of_id if m["of"].lower() == "id" else of_class).update(value.lower().split())
    return of_class, of_id


def names_of(markup: str) -> set[str]:
    """Words of all classes, ids and ARIA roles."""
    return set.union(*_split_names(markup))


def _tells(names) -> bool:
    return any(part in BESIDE for name in names for part in _PARTS.split(name))


def _in_article(role: str) -> bool:
    return any(element.partition(".")[0] in ARTICLE for element in role.split("/"))


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def slot_sizes(found: list[tuple[str, str, int, str]]) -> dict[str, tuple[int, int]]:
    """Code points of each slot of a page, and those in links."""
    chars, links = Counter(), Counter()
    for slot, text, linked, _ in found:
        chars[slot] += len(text)
        links[slot] += linked
    return {s: (n, links[s]) for s, n in chars.items()}


def order_of(tokens: list[int]) -> int | None:
    """The order of a class on a page: a hash of one round of its tokens, None if later rounds differ from the first."""
    once = list(dict.fromkeys(tokens))
    rounds, rest = divmod(len(tokens), len(once))
    return None if rest or tokens != once * rounds else _digest(",".join(map(str, once)))


def main_text(page: str, words: set, skeleton: set, repeated: set, large: set, template: set[int], menus: set) -> str:
    """The article's blocks in page order.

    Without an article element these are the blocks of all slots that have words not in ``template`` (hashes of role
    and word) and are not menus, or that lie in such a slot.
    """
    found = read_page(page, words).slots(skeleton, repeated, large)
    own = {slot for slot, _, _, _ in found if _in_article(slot)}
    if not own:
        for slot, text, _, role in found:
            if slot not in own and slot not in menus and any(_digest(f"{role}\n{w}") not in template for w in text.split()):
                own.add(slot)
    holders = tuple(f"{s}/" for s in own if s.rpartition("/")[2].partition(".")[0] not in FRAME - ARTICLE and s)
    return "\n".join(text for slot, text, _, _ in found if slot in own or slot.startswith(holders))


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def _rows(batches: Iterator[pa.RecordBatch], rows_of, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 500):
            rows = [r for page in batch.slice(low, 500).to_pylist() for r in rows_of(page)]
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def tokens_of(p: dict) -> list[tuple]:
    """The tokens of a page (host, html, page, words): host, role (None for words), token and the role it stands in, as
    hashes, how often it stands there, code points in a role and in the page, the page."""
    page = read_page(p["html"], set(p["words"]))
    inner = Counter()
    for role, tag, n in zip(page.roles, page.tags, page.chars(), strict=True):
        if tag not in TEXT:
            inner[role] += n
    out = [
        (p["host"], r, _digest(r), _digest(r), n, min(inner[r], inner[""]), inner[""], p["page"]) for r, n in page.counts().items()
    ]
    return out + [(p["host"], None, word, under, n, 0, 0, p["page"]) for (under, word), n in Counter(page.words()).items()]


def classes(tokens: DataFrame, all_pages: DataFrame) -> DataFrame:
    """The tokens of ``tokens`` (as tokens_of gives them) that are in a class of a template, and roles that stand repeatedly.

    host, role, token, under, n (pages that have it), ``once`` (it stands once on nearly all of them), chars, whole,
    ``several`` (more than one different page has it), ``class`` (a hash of its vector) and ``size`` of the class.
    ``all_pages`` has a row per host: host, ``all``.
    """
    # an entry of the vector as a hash; its halves are summed apart, so that no sum of longs overflows
    entry = F.xxhash64("page", "count")
    high, low = F.shiftrightunsigned(entry, 32), entry.bitwiseAND(F.lit(0xFFFFFFFF))
    vectors = tokens.groupBy("host", "token", "under").agg(
        F.max("role").alias("role"), F.count(F.lit(1)).alias("n"), F.sum((F.col("count") == 1).cast("long")).alias("ones"),
        F.sum("chars").alias("chars"), F.sum("whole").alias("whole"), (F.min("page") != F.max("page")).alias("several"),
        F.sum(high).alias("high"), F.sum(low).alias("low"),
    )
    enough = F.col("n") >= F.greatest(F.least(F.lit(2), F.col("all")), F.lit(SUPPORT) * F.col("all"))
    known = vectors.join(all_pages, "host").where(enough)
    known = known.withColumn("class", F.xxhash64("n", "high", "low")).withColumn("once", F.col("ones") >= F.lit(ONCE) * F.col("n"))
    known = shared.stored(known.drop("ones", "high", "low", "all"))
    sizes = known.groupBy("host", "class").agg(F.count(F.lit(1)).alias("size"))
    known = known.join(sizes, ["host", "class"])
    return known.where(F.col("role").isNotNull() | F.col("once") | (F.col("size") >= LARGE))


def with_templates(pages: DataFrame) -> DataFrame:
    """``pages`` (host, html and others) with the templates of their hosts: ``words``, ``skeleton``, ``repeated``,
    ``large``, ``template`` and ``menus``, as main_text takes them."""
    slim = pages.select("host", "html", F.xxhash64("html").alias("page"))

    # the empty word stands for the page itself
    words_schema = pa.schema([("host", pa.string()), ("word", pa.string())])
    words = slim.drop("page").mapInArrow(
        lambda batches: _rows(batches, lambda p: [(p["host"], w) for w in {"", *names_of(p["html"])}], words_schema),
        "host string, word string",
    )
    words = shared.stored(words.groupBy("host", "word").agg(F.count(F.lit(1)).alias("n")))
    whole = words.where("word = ''").select("host", F.col("n").alias("all"))
    enough = F.col("n") >= F.greatest(F.least(F.lit(2), F.col("all")), F.lit(SUPPORT) * F.col("all"))
    of_host = words.join(whole, "host").groupBy("host").agg(
        F.max("all").alias("all"), F.collect_list(F.when(enough & (F.col("word") != ""), F.col("word"))).alias("words")
    )
    of_host = shared.stored(of_host)

    longs = ("token", "under", "count", "chars", "whole", "page")
    tokens_schema = pa.schema([("host", pa.string()), ("role", pa.string())] + [(c, pa.int64()) for c in longs])
    tokens = slim.join(of_host.select("host", "words"), "host").mapInArrow(
        lambda batches: _rows(batches, tokens_of, tokens_schema), "host string, role string, " + ", ".join(f"{c} long" for c in longs)
    )
    known = shared.stored(classes(tokens, of_host.select("host", "all")))
    roles = known.where("role is not null")
    framed = roles.groupBy("host").agg(
        F.collect_list(F.when(F.col("once"), F.col("role"))).alias("skeleton"),
        F.collect_list(F.when(~F.col("once"), F.col("role"))).alias("repeated"),
        F.collect_list(F.when(F.col("chars") > F.lit(MOST) * F.col("whole"), F.col("role"))).alias("large"),
    )
    # words on most pages of the role they stand in
    filled = known.where("role is null and several").join(roles.select("host", "under", F.col("n").alias("of")), ["host", "under"])
    filled = filled.where(F.col("n") > F.lit(MOST) * F.col("of")).select("host", "under", "class", "token")
    candidates = filled.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("candidates"))
    framed = shared.stored(of_host.select("host", "words").join(framed, "host").join(candidates, "host", "left"))

    longs = ("under", "class", "order", "page", "chars", "links")
    found_schema = pa.schema([("host", pa.string()), ("slot", pa.string())] + [(c, pa.int64()) for c in longs])

    def found_of(p: dict) -> list[tuple]:
        """A row per slot of a page, and one per class of words and role with their order there."""
        page = read_page(p["html"], set(p["words"]))
        sizes = slot_sizes(page.slots(set(p["skeleton"]), set(p["repeated"]), set(p["large"])))
        out = [(p["host"], s, None, None, None, p["page"], n, links) for s, (n, links) in sizes.items() if not _in_article(s)]
        of = {c["token"]: c["class"] for c in p["candidates"] or ()}
        met: dict[tuple[int, int], list[int]] = {}
        for under, word in page.words() if of else ():
            if word in of:
                met.setdefault((under, of[word]), []).append(word)
        return out + [(p["host"], None, under, c, order_of(words), None, None, None) for (under, c), words in met.items()]

    found = slim.join(framed, "host").mapInArrow(
        lambda batches: _rows(batches, found_of, found_schema), "host string, slot string, " + ", ".join(f"{c} long" for c in longs)
    )
    # one sum for both: copies of a page are one page to slots, and pages of their own to orders
    found = found.groupBy("host", "slot", "under", "class", "order", "page").agg(
        F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars"), F.max("links").alias("links")
    )
    found = shared.stored(found)
    orders = found.where("slot is null").groupBy("host", "under", "class").agg(
        F.sum("n").alias("n"), F.max(F.when(F.col("order").isNotNull(), F.col("n"))).alias("most")
    )
    valid = orders.where(F.col("most") >= F.lit(ONCE) * F.col("n")).select("host", "under", "class")
    template = filled.join(valid, ["host", "under", "class"]).groupBy("host").agg(F.collect_list("token").alias("template"))
    slots = found.where("slot is not null").groupBy("host", "slot").agg(
        F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links")
    )
    menus = slots.where((F.col("n") == 1) & (F.col("links") > F.lit(MOST) * F.col("chars")))
    menus = menus.groupBy("host").agg(F.collect_list("slot").alias("menus"))
    framed = framed.drop("candidates").join(template, "host", "left").join(menus, "host", "left")
    return pages.join(shared.stored(framed), "host")


def extract(pages: DataFrame) -> DataFrame:
    """A row per row of ``pages`` (page_id, url, html): page_id, url, ``text``, ``n_chars`` (code points).

    ``text`` is the article: the blocks of the page's article slots in page order, one per line, character references
    decoded and white space as single blanks. Templates are those of the url's host (a null or odd url has host "").
    A null or empty page has an empty text; repeated rows count as pages of their own; null ids stay null. Other columns
    are not read. An empty table gives no rows. Pages are read whole.
    """
    shared.shipped(pages.sparkSession)
    parts = ("words", "skeleton", "repeated", "large", "template", "menus")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                found = [
                    main_text(p["html"], *(set(p[c] or ()) for c in parts)) for p in part.drop_columns(["page_id", "url"]).to_pylist()
                ]
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        _host(F.col("url").cast("string")).alias("host"),
    )
    joined = with_templates(slim).select("page_id", "url", "html", *parts)
    return joined.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
