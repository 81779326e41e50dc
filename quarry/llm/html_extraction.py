"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its opening tags and its blocks of text, each with the path of containers around it. Over the pages
of a host each token has an occurrence vector (how often it is in each page). Tokens of one vector form an equivalence
class; classes that are frequent and whose tokens nest in one another are the host's template. Its text tokens are the
text that the host repeats; what varies between its tags are slots. The main slot is the deepest template container that
holds most of the host's varying text, widened to the container of the heading above it. A page's text is what is in the
main slot, less the template's own text and less navigation, adverts, comments and the like.

Vectors are never gathered: each is represented by its sum of page hashes times counts, which adds up over tasks, so a
host of any size costs each task one row per token. Html is never shuffled while the table of templates is small
enough to be sent (SLOTS_BYTES, checked); beyond that pages are joined to it by host.

Copies of an article look like template text too. So text counts as template only if it is on three pages at least, if
these differ in what else they say, and if no more than REPEATED_SHARE of the host's text is such, whatever the number of
its pages; and of it only regions go that hold no words of the page's own, so that a paragraph, or a list, that all articles
of a host share stays in its article.

A class, id or role marks a block as boilerplate only as a whole: all its words must say so or be words of layout. So
`site-nav` and `ad` mark one, `sharing-economy` and `related-work` don't.

Defined results: null html is empty and has an empty text; a page whose host has no usable template, or that lacks its
host's main slot, falls back to its own article or main element, else to all that is no boilerplate. Repeated rows each
give a row; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Collection, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import stored

#: Largest table of main slots that is sent to all executors.
SLOTS_BYTES = 16 << 20
#: A template token is on this share of a host's pages at least; the main slot holds this share of the text.
FREQUENT, MAIN_SHARE = 0.8, 0.6
#: Longest container path that a token spells out; what is above it is told by its hash.
PATH_CHARS = 400
#: Pages that must hold a text for it to be the template's (two that share one may be copies), and the share of a host's text
#: that can be.
TEXT_PAGES, REPEATED_SHARE = 3, 0.5

_PIECE = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_RAW = set("script style textarea title noscript template iframe svg math canvas object select option button xmp noembed noframes".split())
_CONTAINERS = set("html head body main article section div nav header footer aside form ul ol dl menu table tbody thead tfoot tr td th figure fieldset details dialog blockquote center address".split())
_BLOCKS = _CONTAINERS | set("p h1 h2 h3 h4 h5 h6 li dt dd pre br hr caption figcaption summary legend hgroup".split())
#: Containers that can be a region of the template inside an article; lists, tables and quotations are its text.
_REGIONS = set("div section center fieldset details address td".split())
_BOILER_TAGS = set("head nav footer aside form menu dialog".split()) | _RAW
#: Words of class, id and role values that mark boilerplate regions.
_BOILER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner banners nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar side aside widget widgets footer foot header masthead topbar comment comments commentlist reply replies respond disqus discussion cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended pagination pager toolbar complementary contentinfo".split()
)
#: Words of layout that may stand beside them in a name.
_LAYOUT_WORDS = set(
    "site main page global top bottom left right box bar list item items block wrap wrapper container inner outer area section slot link links button buttons icon icons post posts "
    "primary secondary mobile desktop fixed sticky col column row grid group panel module unit content form field label".split()
)
#: Of the former, the words that say nothing inside an article or beside a word for one; and those for readers' comments.
_WEAK_WORDS = set("banner banners header masthead side widget widgets".split())
_ARTICLE_WORDS = set("article content entry post story".split())
_COMMENT_WORDS = set("comment comments commentlist reply replies respond".split())
#: Elements of which an unclosed one holds all that follows.
_RAW_TEXT = set("script style textarea title iframe xmp noembed noframes template".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_IN_HEAD = set("base link meta noscript script style template title".split())
#: Tag -> open elements that it ends.
_CELLS, _SECTIONS = {"td", "th"}, {"td", "th", "tr", "tbody", "thead", "tfoot"}
_ENDED_BY = {"td": _CELLS, "th": _CELLS, "tr": _CELLS | {"tr"}, "tbody": _SECTIONS, "thead": _SECTIONS, "tfoot": _SECTIONS}
#: Items of lists, each of which ends the one before it; they are only places of their own where they are marked.
_ITEMS = {"li", "dt", "dd"}
_WORD = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"[0-9]+")
_PLACE = re.compile(r"~[0-9]+$")


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").netloc.lower()
    except ValueError:
        return ""


class Place:
    """A container of a page, with what is known of it from those around it."""

    __slots__ = ("article", "boiler", "chars", "depth", "in_slot", "kids", "main", "mute", "same", "tag", "token", "up")

    def __init__(self, tag: str, token: str, up: Place | None, bad: bool, slot: str | None, mute: bool = False):
        self.tag, self.token, self.up, self.chars = tag, token, up, 0
        self.mute = mute or bool(up and up.mute)  # words here are in the midst of a block that goes on around them
        self.kids: dict[str, int] | None = None  # how many containers of a label it has had
        self.same = 0  # elements of the same name open inside, if this is no container
        self.depth = up.depth + 1 if up else -1
        self.boiler = bad or bool(up and up.boiler)
        self.article = tag == "article" or bool(up and up.article)
        self.main = tag == "main" or bool(up and up.main)
        self.in_slot = token == slot if up is None or not up.in_slot else True


    def inside(self, other: Place) -> bool:
        here = self
        while here is not None and here is not other and here.depth > other.depth:
            here = here.up
        return here is other

    def numbered(self, label: str) -> str:
        """Label of a new container inside; its place among those of one label tells roles apart where names don't."""
        if self.kids is None:
            self.kids = {}
        n = self.kids[label] = self.kids.get(label, 0) + 1
        return label if n == 1 else f"{label}~{n}"


def _token(up: Place, label: str) -> str:
    """Path of containers down to a label; of bounded length, so that deep nesting costs no more than shallow."""
    if not up.token:
        return label
    above = up.token if len(up.token) <= PATH_CHARS else f"~{xxhash.xxh3_64_hexdigest(up.token)}"
    return f"{above}/{label}"


def _label(tag: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """Name of a container with its class, id and role; whether it is boilerplate (inside: in an article or main element)."""
    if not attributes:
        return tag, tag in _BOILER_TAGS or (tag == "header" and not inside)
    names = [next(filter(None, m), "") for m in _NAMES.findall(attributes)] if "=" in attributes else []
    each = [set(_WORD.findall(x)) for n in names for x in n.lower().split()]
    words = set().union(*each)
    marks = {w for own in each if own <= _BOILER_WORDS | _LAYOUT_WORDS for w in own & _BOILER_WORDS}
    if inside or words & _ARTICLE_WORDS:
        marks -= _WEAK_WORDS
    if tag == "article":
        marks &= _COMMENT_WORDS
    elif tag in ("html", "body", "main"):
        marks = set()
    boiler = tag in _BOILER_TAGS or (tag == "header" and not inside) or bool(marks) or bool(_HIDDEN.search(attributes))
    label = ".".join([tag, *sorted(_NUMBER.sub("#", " ".join(names).lower().replace("/", "|")).split())])
    return label if len(label) <= PATH_CHARS else f"{tag}.~{xxhash.xxh3_64_hexdigest(label)}", boiler


def walk(page: str, slot: str | None = None) -> Iterator[tuple[str, str, Place]]:
    """Structure of a page: ("open", token, place of it or around it) and ("block", text, place around it).

    End tags that may be left out are implied; the time is linear in the page whatever its nesting."""
    here = home = Place("", "", None, False, slot)
    opened: dict[str, int] = {}
    absent: set[str] = set()  # elements that end nowhere in what is left
    parts: list[str] = []
    at = skip_to = 0

    def block() -> str:
        text = " ".join(_html.unescape("".join(parts)).split())
        parts.clear()
        return text

    for m in _PIECE.finditer(page):
        if m.start() < skip_to:
            continue
        if m.start() > at and not here.mute:
            parts.append(page[at : m.start()])
            home = here
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in _BLOCKS and parts and (text := block()):
            yield "block", text, home
        if close:
            if here.tag == tag and here.same:
                here.same -= 1
            elif opened.get(tag):
                while True:
                    was, here = here.tag, here.up
                    opened[was] -= 1
                    if was == tag:
                        break
            continue
        while here.tag in _ENDED_BY.get(tag, ()) or (here.tag == "head" and tag not in _IN_HEAD) or (here.tag == "p" and tag in _BLOCKS) or (here.tag in _ITEMS and tag in _ITEMS):
            opened[here.tag] -= 1
            here = here.up
        if tag in _RAW:
            yield "open", _token(here, tag), here
            if not attributes.endswith("/") and tag not in absent:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if end:
                    at = skip_to = end.end()
                elif tag in _RAW_TEXT:
                    at = skip_to = len(page)
                else:
                    absent.add(tag)
            continue
        label, bad = _label(tag, attributes, here.article or here.main)
        container = tag in _CONTAINERS and not attributes.endswith("/")
        token = _token(here, here.numbered(label) if container else label)
        if container:
            here = Place(tag, token, here, bad, slot)
            opened[tag] = opened.get(tag, 0) + 1
        elif here.tag == tag:
            here.same += 1
        elif bad and not here.boiler and tag not in _VOID:  # marked, so its words are told apart from those around it
            here = Place(tag, token, here, True, slot, tag not in _BLOCKS)
            opened[tag] = opened.get(tag, 0) + 1
            yield "mark", token, here
            continue
        yield "open", token, here
    if at < len(page) and not here.mute:
        parts.append(page[at:])
        home = here
    if parts and (text := block()):
        yield "block", text, home


def text_key(place: Place, text: str) -> str:
    """What tells a block of text in its place."""
    return xxhash.xxh3_64_hexdigest(f"{place.token}\0{text}")


def page_vector(page: str) -> dict[str, list[int]]:
    """Token (container path / tag, or container path /= key of a text) -> [count, characters of text inside, depth];
    the token '' stands for the page. Text in regions that are boilerplate by name isn't counted."""
    found: dict[str, list[int]] = {"": [1, 0, -1]}
    places: list[Place] = []
    for kind, value, place in walk(page):
        if kind != "block":
            new = place.token == value and (not places or places[-1] is not place)
            found.setdefault(value, [0, 0, place.depth if new else place.depth + 1])[0] += 1
            if new:
                places.append(place)
        elif not place.boiler:
            own = found.setdefault(f"{place.token}/={text_key(place, value)}", [0, 0, place.depth + 1])
            own[0] += 1
            own[1] += len(value)
            if place.up is None:
                found[""][1] += len(value)
            place.chars += len(value)
    for place in reversed(places):  # those inside come after those around them
        found[place.token][1] += place.chars
        if place.up.up is None:
            found[""][1] += place.chars
        place.up.chars += place.chars
    return found


def occurrence_vectors(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, token, depth, vector, n_pages, n_chars, low, high): summed over a host's pages; the token '' stands for the
    page. low and high are the least and greatest content hash of the pages that hold the token. Texts of one page only
    are left out."""
    mask = (1 << 64) - 1
    sign = lambda v: v - (1 << 64) if v >> 63 else v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, str], list[int]] = {}
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host, h = host_of(url), xxhash.xxh3_64_intdigest(f"{url}\n{page}")
                vector = page_vector(page or "")
                content = sign(xxhash.xxh3_64_intdigest("\n".join(t for t in vector if "/=" in t)))
                for token, (n, chars, depth) in vector.items():
                    own = total.setdefault((host, token), [depth, 0, 0, 0, content, content])
                    own[1] = (own[1] + h * n) & mask
                    own[2] += 1
                    own[3] += chars
                    own[4], own[5] = min(own[4], content), max(own[5], content)
            keys, values = list(total), list(total.values())
            columns = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)] + [pa.array([v[0] for v in values], pa.int32()), pa.array([sign(v[1]) for v in values], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([v[i] for v in values], pa.int64()) for i in range(2, 6))], names=["host", "token", "depth", "vector", "n_pages", "n_chars", "low", "high"])

    part = pages.select(url_col, html_col).mapInArrow(run, "host string, token string, depth int, vector long, n_pages long, n_chars long, low long, high long")
    # sums of longs must not overflow, so the hashes are summed as two halves and put together modulo 2^64
    lower, upper = F.col("vector").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright("vector", 32)
    summed = part.groupBy("host", "token").agg(F.min("depth").alias("depth"), F.sum(lower).alias("lower"), F.sum(upper).alias("upper"), F.sum("n_pages").alias("n_pages"), F.sum("n_chars").alias("n_chars"), F.min("low").alias("low"), F.max("high").alias("high"))
    carried = F.shiftleft(F.col("upper") + F.shiftright("lower", 32), 32).bitwiseOR(F.col("lower").bitwiseAND(F.lit((1 << 32) - 1)))
    return summed.where((F.col("n_pages") > 1) | ~F.contains("token", F.lit("/="))).select("host", "token", "depth", carried.alias("vector"), "n_pages", "n_chars", "low", "high")


def templates(vectors: DataFrame) -> DataFrame:
    """Template tokens by host: (host, token, depth, vector, n_pages, n_chars, is_text, host_pages, host_chars).

    Valid are tokens on most pages whose class has two or more tokens, one of them inside another (same vector, other
    depth); of texts, those that can't be copies of articles."""
    whole = vectors.where("token = ''").select("host", F.col("n_pages").alias("host_pages"), F.col("n_chars").alias("host_chars"))
    frequent = vectors.where("token <> ''").join(whole, "host").where(F.col("n_pages") >= FREQUENT * F.col("host_pages"))
    nested = frequent.groupBy("host", "vector").agg(F.count("*").alias("n"), F.countDistinct("depth").alias("levels")).where("n >= 2 and levels >= 2").select("host", "vector")
    found = frequent.join(nested, ["host", "vector"], "left_semi").withColumn("is_text", F.contains("token", F.lit("/=")))
    found = found.where(~F.col("is_text") | (F.col("n_pages") >= TEXT_PAGES) & (F.col("low") != F.col("high"))).drop("low", "high")
    copied = found.where("is_text").groupBy("host").agg(F.sum("n_chars").alias("repeated"), F.first("host_chars").alias("of")).where(F.col("repeated") > REPEATED_SHARE * F.col("of")).select("host", F.lit(True).alias("is_text"))
    return found.join(copied, ["host", "is_text"], "left_anti").select("host", "token", "depth", "vector", "n_pages", "n_chars", "is_text", "host_pages", "host_chars")


def _around(token: str) -> Column:
    """Paths of all containers around a token, that of the page ('') too."""
    steps = F.split(token, "/")
    return F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda k: F.array_join(F.slice(steps, 1, k), "/"))


def main_slots(found: DataFrame) -> DataFrame:
    """(host, slot): the deepest template container with most of the host's varying text, widened to the article or main
    element it is in, else to the container of a heading above it."""
    fixed = found.where("is_text").select("host", "n_chars", F.explode(_around("token")).alias("token")).groupBy("host", "token").agg(F.sum("n_chars").alias("fixed"))
    of_host = fixed.where("token = ''").select("host", F.col("fixed").alias("host_fixed"))
    tags = found.where("not is_text").join(fixed, ["host", "token"], "left").join(of_host, "host", "left")
    varying, whole = F.col("n_chars") - F.coalesce("fixed", F.lit(0)), F.col("host_chars") - F.coalesce("host_fixed", F.lit(0))
    deepest = tags.where((whole > 0) & (varying >= MAIN_SHARE * whole)).groupBy("host").agg(F.max_by("token", F.struct("depth", "n_chars", "token")).alias("slot"))
    named = [F.nullif(F.regexp_extract("slot", rf"^((?:[^/]*/)*?{tag}(?:[.~][^/]*)?)(?:/|$)", 1), F.lit("")) for tag in ("article", "main")]
    step = F.regexp_extract("token", "([^/]*)$", 1)
    headed = found.where(~F.col("is_text") & step.rlike(r"^h[12](\.|$)")).select("host", F.regexp_replace("token", "/?[^/]*$", "").alias("above")).where(~F.col("above").rlike(r"(^|/)(html|body)([.~][^/]*)?$") & (F.col("above") != "")).distinct()
    above = deepest.select("host", "slot", F.explode(_around("slot")).alias("above")).join(headed, ["host", "above"]).groupBy("host").agg(F.max_by("above", F.length("above")).alias("headed"))
    return deepest.join(above, "host", "left").select("host", F.coalesce(*named, "headed", "slot").alias("slot"))


def host_templates(vectors: DataFrame, found: DataFrame) -> DataFrame:
    """(host, slot, siblings, texts): what extraction needs of a host's template. siblings says how many containers of the
    slot's label most pages have side by side, texts are the keys of the template's texts."""
    texts = found.where("is_text").groupBy("host").agg(F.collect_set(F.regexp_extract("token", "([0-9a-f]*)$", 1)).alias("texts"))
    base = lambda c: F.regexp_replace(c, "~[0-9]+$", "")
    place = F.coalesce(F.nullif(F.regexp_extract("token", "~([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(1))
    slots = main_slots(found).withColumn("base", base("slot"))
    whole = vectors.where("token = ''").select("host", F.col("n_pages").alias("host_pages"))
    beside = vectors.select("host", "n_pages", base("token").alias("base"), place.alias("place")).join(slots.select("host", "base"), ["host", "base"], "left_semi")
    beside = beside.join(whole, "host").where(F.col("n_pages") >= FREQUENT * F.col("host_pages")).groupBy("host").agg(F.max("place").alias("siblings"))
    return slots.drop("base").join(beside, "host", "left").join(texts, "host", "full_outer").select("host", "slot", "siblings", "texts")


def _fullest_sibling(blocks: list[tuple[str, Place]], slot: str, siblings: int) -> Place | None:
    """On a page that has more or fewer of the slot's siblings than the template, a place doesn't tell which one is meant:
    the one with most text is taken."""
    parent, _, label = _PLACE.sub("", slot).rpartition("/")
    chars: dict[Place, int] = {}
    for text, place in blocks:
        while place is not None and not (place.up is not None and place.up.token == parent and _PLACE.sub("", place.token).rpartition("/")[2] == label):
            place = place.up
        if place is not None:
            chars[place] = chars.get(place, 0) + len(text)
    if not chars or (next(iter(chars)).up.kids or {}).get(label, 0) == siblings:
        return None
    return max(chars, key=lambda p: chars[p])


def main_text(page: str | None, slot: str | None, texts: Collection[str] = (), siblings: int | None = None) -> str:
    """Text of the slot's blocks less the regions of the template's texts. Where there is no such slot, or it is the whole body, of the
    page's article or main elements, else of all blocks."""
    blocks = _without_fixed([(value, place) for kind, value, place in walk(page or "", slot) if kind == "block" and not place.boiler], texts)
    found = [x for x in blocks if x[1].in_slot]
    if slot and siblings and siblings > 1 and (other := _fullest_sibling(blocks, slot, siblings)):
        found = [x for x in blocks if x[1].inside(other)]
    if not found or re.split("[.~]", slot.rpartition("/")[2])[0] in ("html", "body"):
        found = found or blocks
        found = [x for x in found if x[1].article] or [x for x in blocks if x[1].article] or [x for x in found if x[1].main] or [x for x in blocks if x[1].main] or found
    return "\n".join(v for v, _ in found)


def _without_fixed(blocks: list[tuple[str, Place]], texts: Collection[str]) -> list[tuple[str, Place]]:
    """The blocks less the regions that hold nothing but the template's texts. A paragraph or list that all pages share but
    that stands in a region with words of the page's own is the article's."""
    if not texts:
        return blocks
    fixed = [text_key(place, value) in texts for value, place in blocks]
    own: set[Place] = set()  # places with words that aren't the template's
    for (_, place), f in zip(blocks, fixed):
        while not f and place is not None and place not in own:
            own.add(place)
            place = place.up

    def goes(place: Place | None) -> bool:
        while place is not None and place not in own:
            if place.tag in _REGIONS:
                return True
            place = place.up
        return False

    return [x for x, f in zip(blocks, fixed) if not (f and goes(x[1]))]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text."""
    # the vectors are used several times over; as a table the pages are walked for them once
    vectors = stored(occurrence_vectors(pages, url_col, html_col), "vectors")
    found = stored(templates(vectors), "templates")
    slots = stored(host_templates(vectors, found), "slots")
    kind = f"{id_col} long, {url_col} string, text string"
    size = slots.agg(F.sum(F.octet_length("host") + F.coalesce(F.octet_length("slot"), F.lit(0)) + 64 + 80 * F.coalesce(F.size("texts"), F.lit(0)))).first()[0] or 0
    known = None

    def with_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())], names=[id_col, url_col, html_col, "host"])

    if size <= SLOTS_BYTES:
        known = pages.sparkSession.sparkContext.broadcast({r["host"]: (r["slot"], frozenset(r["texts"] or ()), r["siblings"]) for r in slots.toLocalIterator()})
        rows = pages.select(id_col, url_col, html_col)
    else:
        own = pages.select(id_col, url_col, html_col)
        rows = own.mapInArrow(with_host, T.StructType([*own.schema.fields, T.StructField("host", T.StringType())])).join(slots, "host", "left").select(id_col, url_col, html_col, "slot", "texts", "siblings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                urls, pages_ = part.column(1).to_pylist(), part.column(2).to_pylist()
                if known is None:
                    of = zip(part.column(3).to_pylist(), (x or () for x in part.column(4).to_pylist()), part.column(5).to_pylist())
                else:
                    of = (known.value.get(host_of(u), (None, (), None)) for u in urls)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array([main_text(p, *x) for p, x in zip(pages_, of)], pa.string())], names=[id_col, url_col, "text"])

    return rows.mapInArrow(run, kind)
