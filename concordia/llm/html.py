"""HTML extraction by equivalence-class template deduction.

A page is a sequence of tokens: start tags and text nodes, each told apart by its path. Over a host's pages a token's occurrence vector is
how often each page has it; a fingerprint of the vector adds up in any order, so that it is aggregated in each task first. Tokens with one
vector are an equivalence class; large classes that most pages of the host have are its template. Equal pages count as one. On a page a
class is valid if its tokens come in the class's order, as often as they come, and nest with the other classes. Between the template's tags are its slots. The article's slot is
chosen by structure, over all pages of the host: below the deepest tag of the template that each page has once and that holds most of the host's text outside of links, and its headline.
On a page where that tag is valid, the text below it is the article, from the first text on that is no template; on others, text of valid classes is template and goes, and the page's own tags and names decide. Forms, notices,
adverts and comments inside a slot differ from page to page as the article does: a list of tags and names leaves them out.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*?)(/?)>|<(?=/?[a-zA-Z])[^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title", "xmp"}
RAW_END = {t: re.compile(f"</{t}(?=[\\s/>]|\\Z)", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
BOILER_TAGS = {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset", "datalist", "object", "audio", "video", "canvas", *RAW}
BOILER_NAMES = set("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menubar sidebar footer header masthead banner cookie cookies consent notice notices popup modal overlay comment comments commentlist discussion disqus reply replies respond share sharing social related recommended breadcrumb breadcrumbs subscribe subscription newsletter signup login search searchbox widget widgets toolbar pagination pager alert gdpr copyright".split())
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog", "alertdialog", "toolbar"}
#: Tags around a text that can be its slot.
DEPTH = 64
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)} if "=" in raw or raw.strip() else {}


@lru_cache(maxsize=1 << 14)
def opened(tag: str, raw: str, in_article: bool) -> tuple[bool, str]:
    """(boilerplate, name in a path) of a start tag."""
    attrs = attributes(raw) if raw else {}
    return is_boilerplate(tag, attrs, in_article), f"/{tag}" + (f".{attrs['class'].lower()}" if attrs.get("class") else "")


def is_boilerplate(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    names = set(re.split(r"[\s_-]+", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
    hit = names & BOILER_NAMES
    if tag in ("html", "body"):
        return False
    if tag in ("main", "article"):
        return bool(hit & {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "related", "teaser"})
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    if tag in BOILER_TAGS or attrs.get("role") in BOILER_ROLES:
        return True
    if in_article:  # an article's own head holds its title
        hit = hit - {"header"}
    return bool(hit) or (tag == "header" and not in_article)


def parse(page: str, content: int | None = None):
    """(tags, blocks). tags: (path, place, whether it's a first headline). blocks: lists of (text, path, in_article, boilerplate, place, paths of the tags around it, in a link, in content), one
    for each text node. A path is a hash of its tag and the path around it. content: the path of the article's slot; what stands around it doesn't make it boilerplate."""
    stack: list[tuple] = []  # (tag, path, boilerplate, in an article, around, in a link, in content)
    outside = (None, 0, False, False, (), False, False)
    _, path, boiler, article, around, link, slot = outside
    tags, blocks, block = [], [], []
    at, raw_until, headline = 0, None, False

    def settle():
        nonlocal path, boiler, article, around, link, slot
        _, path, boiler, article, around, link, slot = stack[-1] if stack else outside

    def text(s):
        if s:
            block.append((entities.unescape(s), path, article, boiler, at, around, link, slot))

    def cut():
        nonlocal block
        if block:
            blocks.append(block)
            block = []

    pos = 0
    while True:
        if raw_until:
            end = RAW_END[raw_until].search(page, pos)
            if not end:
                break
            pos = at = end.start()
            raw_until = None
        m = TOKEN.search(page, pos)
        text(page[at : m.start()] if m else page[at:])
        if not m:
            break
        pos = at = m.end()
        if m.group(2) is None:
            continue
        tag, closing = m.group(2).lower(), bool(m.group(1))
        if tag not in INLINE:
            cut()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    settle()
                    break
                if stack[i][0] in ("article", "main", "body") and tag in INLINE:
                    break
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            continue
        if tag in CLOSES and stack and stack[-1][0] in CLOSES[tag]:
            stack.pop()
            settle()
        if tag not in INLINE:  # a block ends an open paragraph, with what was left open in it
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    settle()
                    break
                if stack[i][0] not in INLINE:
                    break
        own, name = opened(tag, m.group(3), article)
        label = token_hash(f"{path}{name}")
        opens, found = tag in ("article", "main") and not own, label == content
        # an article begins outside of what was left open before it
        hidden = (own and not found) or (boiler and not (opens and not article) and not found)
        first = tag == "h1" and not headline and not hidden
        headline = headline or first
        tags.append((label, m.start(), first, around))
        if not m.group(4):
            # depth is bounded, so that tags which nobody closes don't make the list of those around a text quadratic
            stack.append((tag, label, hidden, article or opens, (*around, label) if len(around) < DEPTH else around, link or tag == "a", slot or found))
            settle()
            if tag in RAW:
                raw_until = tag
    cut()
    return tags, blocks


@lru_cache(maxsize=1 << 14)
def token_hash(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s) - (1 << 63)


def token_places(tags, blocks) -> dict[int, list[int]]:
    """Where the page has each token, in order."""
    out: dict[int, list[int]] = {}
    for label, place, *_ in tags:
        out.setdefault(label, []).append(place)
    for block in blocks:
        for text, path, _, _, place, *_ in block:
            if text := " ".join(text.split()):
                out.setdefault(token_hash(f"{path}\n{text}"), []).append(place)
    return out


def slot_sizes(tags, blocks) -> tuple[dict[int, int], set[int], dict[int, int]]:
    """Letters of text below each tag, outside of links and of what is never shown, 0 for the page; the tags that hold the first headline; the tags' depths."""
    size, depth = {0: 0}, {}
    for block in blocks:
        for text, _, _, boiler, _, around, link, _ in block:
            if not boiler and not link and (n := len("".join(text.split()))):
                for x in (0, *around):
                    size[x] = size.get(x, 0) + n
    held: set[int] = set()
    for label, _, first, around in tags:
        depth.setdefault(label, len(around) + 1)
        if first:
            held = {0, *around}
    return size, held, depth


def inside(own: list[int], size: int, other: list[int]) -> bool:
    """Each run of `size` places of own is between two neighbours of other."""
    return all(bisect(other, own[i]) == bisect(other, own[i + size - 1]) for i in range(0, len(own), size))


def valid_tokens(places: dict[int, list[int]], classes: list[list[int]]) -> set[int]:
    """Tokens of the classes that are valid on a page. What doesn't nest in a larger class is split at that class's tokens, and pieces of two tokens or more are classes again."""
    valid: list[tuple[list[int], int]] = []
    found: set[int] = set()
    left = sorted(classes, key=lambda c: (len(c), c))
    while left:
        c = left.pop()
        at = [places.get(t, []) for t in c]
        own = [p for turn in zip(*at, strict=False) for p in turn]
        if not own or any(len(x) != len(at[0]) for x in at) or any(p >= q for p, q in zip(own, own[1:], strict=False)):
            continue
        crossed = next((other for other, size in valid if not inside(own, len(c), other) and not inside(other, size, own)), None)
        if crossed is None:
            valid.append((own, len(c)))
            found.update(c)
        else:
            pieces: dict[tuple[int, ...], list[int]] = {}
            for t, x in zip(c, at, strict=True):
                pieces.setdefault(tuple(bisect(crossed, p) for p in x), []).append(t)
            left += [x for x in pieces.values() if 1 < len(x) < len(c)]
    return found


def article_text(page: str, template: list[list[int]] = (), content: int | None = None) -> str:
    """The page's article. template: the host's classes, their tokens' hashes in order. content: the path of the article's slot, which counts where its tag is valid."""
    return decided(page, template, content)[0]


def decided(page: str, template: list[list[int]] = (), content: int | None = None) -> tuple[str, bool]:
    """(the page's article, whether the template chose its slot)."""
    tags, blocks = parse(page, content)
    places = token_places(tags, blocks) if template else {}
    drop = valid_tokens(places, template) if template else ()
    slot = content is not None and content in drop and len(places[content]) == 1
    if content is not None and not slot:
        tags, blocks = parse(page)
    found = []
    for block in blocks:
        if slot:
            parts = [(t, a) for t, _, a, b, _, _, _, own in block if own and not b]
            # a wide slot begins with the site's name and menus: template up to the first text of the page's own, outside of what the page calls an article
            if not found and parts and all(not own or b or (not a and token_hash(f"{path}\n{' '.join(t.split())}") in drop) for t, path, a, b, _, _, _, own in block if t.strip()):
                continue
        else:  # what an article has is no template
            parts = [(t, a) for t, path, a, b, *_ in block if not b and (a or not (drop and token_hash(f"{path}\n{' '.join(t.split())}") in drop))]
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            found.append((text, any(a for _, a in parts)))
    if any(a for _, a in found):
        found = [x for x in found if x[1]]
    return "\n\n".join(t for t, _ in found), slot


def unpacked(template: list[int]) -> list[list[int]]:
    """The classes of a template."""
    out, i = [], 0
    while i < len(template):
        out.append(template[i + 1 : i + 1 + template[i]])
        i += 1 + template[i]
    return out


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://([^/?#:]*)", 1))


def templates(pages: DataFrame, scratch: Scratch, min_pages: int = 4, min_share: float = 0.8, content_share: float = 0.6) -> DataFrame:
    """(host, template array<long>, content long): classes of two tokens or more that at least min_share of a host's pages have, each as its size and its tokens in order;
    the deepest tag of them that no page has twice, below which the host has at least content_share of its text outside of links, and its headlines if it has any.
    Equal pages of a host are one page: text that only copies share is no template. Hosts with fewer than min_pages pages have none: too little is known of them."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows: list[list] = [[] for _ in range(9)]
            for host, i, n, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tags, blocks = parse(page)
                own = token_places(tags, blocks) | {0: [0]}  # 0 stands for the page
                size, held, depth = slot_sizes(tags, blocks)
                values = ([host] * len(own), [i] * len(own), [n] * len(own), own.keys(), map(len, own.values()), (x[0] for x in own.values()), (size.get(t, 0) for t in own), (int(t in held) for t in own), (depth.get(t, 0) for t in own))
                for column, more in zip(rows, values, strict=True):
                    column.extend(more)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), *(pa.array(x, pa.int64()) for x in rows[1:])], names=["host", "page", "copies", "token", "n", "place", "chars", "held", "depth"])

    named = pages.select("host", F.xxhash64("html").alias("page"), F.xxhash64(F.lit(9), "html").alias("again"), "html")
    copied = scratch.write(named.groupBy("host", "page", "again").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copied")
    named = named.join(copied, ["host", "page", "again"], "left").select("host", "page", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), "html")
    seen = named.mapInArrow(run, "host string, page long, copies long, token long, n long, place long, chars long, held long, depth long")
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector")
    # the copies of a page add up to one; a token that is always before another has the smaller sum of places
    of = lambda c: F.round(F.sum(c / F.col("copies"))).cast("long")
    sums = [of(F.lit(1)).alias("pages"), F.sum(F.col("place").cast("decimal(38,0)")).alias("place"), vector, of(F.col("chars")).alias("chars"), of(F.col("held")).alias("held"), F.max("n").alias("most"), F.min("depth").alias("depth")]
    tokens = scratch.write(seen.groupBy("host", "token").agg(*sums), "tokens")
    sizes = tokens.where("token = 0").select("host", F.col("pages").alias("of"), F.col("chars").alias("all_chars"), F.col("held").alias("all_held")).where(F.col("of") >= min_pages)
    usual = tokens.where((F.col("token") != 0) & (F.col("pages") >= min_pages * min_share)).join(sizes, "host").where(F.col("pages") >= min_share * F.col("of"))
    holds = (F.col("most") == 1) & (F.col("depth") > 2) & (F.col("chars") > 0) & (F.col("chars") >= content_share * F.col("all_chars")) & (F.col("held") >= min_share * F.col("all_held"))
    slot = F.max(F.when(holds, F.struct("depth", "token"))).alias("slot")
    classes = usual.groupBy("host", "vector").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("tokens"), slot).where(F.size("tokens") > 1)
    return scratch.write(classes.groupBy("host").agg(F.flatten(F.collect_list(F.concat(F.array(F.size("tokens").cast("long")), "tokens"))).alias("template"), F.max("slot")["token"].alias("content")), "templates")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, one row a page. pages: page_id, url, html.

    Null html counts as empty and gives an empty text; a null or malformed url belongs to the host ''. Pages that are cut off anywhere give what is there.
    Repeated rows are rows like others; ids of any type, null ones too, are taken as they are; other columns are ignored; an empty table gives no rows. A host's pages never meet in one task:
    only its tokens' counts do, and they are summed in each task before."""
    scratch = Scratch(pages.sparkSession, "html")
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    both = own.join(templates(own, scratch), "host", "left").select("page_id", "url", "html", "template", "content")

    def run(batches):
        import pyarrow as pa

        known: dict = {}
        for batch in batches:
            texts = []
            for page, template, content in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), strict=True):
                classes = []
                if template.is_valid:
                    values = template.values.to_numpy()
                    key = values.tobytes()  # the whole template, order and classes too: two hosts may share all tokens
                    classes = known.get(key)
                    if classes is None:
                        known.clear()
                        classes = known[key] = unpacked(values.tolist())
                texts.append(article_text(page, classes, content))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return both.mapInArrow(run, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op5_html(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
