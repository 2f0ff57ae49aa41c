"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its opening tags, told apart by the path of tags (with class and id) they
stand in, and the text of its blocks by path. Two tokens of a host are in the same equivalence
class if they occur equally often on every page: the sum over pages of a hash of (page, count)
is the same for both. These sums add up, so a host of any size is one pre-aggregated row per
token and partition. Classes with enough tokens on enough of the host's pages are valid; the
tags of those that occur once a page, ordered by nesting, are the host's template, and the
deepest container that still has most of the text is its content slot. Text that stands alike
on enough pages and fills a template tag of its own is template as well, inside the slot too;
a paragraph that articles share isn't, as its tag isn't one of the template.
Every page gives the text of its host's slot without nested template text and without elements
that aren't prose. Tags and class names outside the slot decide nothing, except on pages that
lack the slot of their host.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from microtide.llm.common import lookup_join, materialize, table

#: A valid class has this many tokens, on this share of the host's pages; text repeats on SUPPORT pages at least.
LEAST_TOKENS, LEAST_SHARE, SUPPORT = 3, 0.6, 3

#: Hosts whose slots and template tokens (hundreds at most each) are broadcast.
BROADCAST_HOSTS = 2_000

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|itemprop|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = frozenset(["script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "select", "button", "canvas", "audio", "video", "title", "head"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul hr".split())
#: Elements that an opening tag of the same kind closes.
CLOSES = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
ASIDE_TAGS = frozenset(["nav", "header", "footer", "aside", "form", "menu", "dialog"])
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer menu nav navbar navigation newsletter notice notices popup promo promoted related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Elements that can be a slot; and those that no slot is sought inside, and no class name makes an aside.
CONTAINER = ["body", "main", "article", "section", "div", "td", "center"]
MAIN = frozenset(["article", "main"])
WHOLE = frozenset(["html", "body", "article", "main"])


def _marks(attributes: str) -> tuple[str, bool]:
    """The class and id of a tag for its path, and whether they say that it is no main text."""
    if not attributes or not attributes.strip():
        return "", False
    names, aside = [], False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            aside = True
        elif name in ("class", "id"):
            names.append(re.sub(r"[0-9]+", "#", value))
            aside = aside or any(w in ASIDE_WORDS for w in re.split(r"[^a-z]+", value.lower()))
        elif name == "role":
            aside = aside or value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")
    return "." + "|".join(names) if names else "", aside


def _clean(parts: list[str]) -> str:
    return " ".join(_html.unescape("".join(parts)).split())


def parse(page: str | None) -> tuple[list[str], list[tuple[str, tuple[str, ...], str]]]:
    """Paths of the opening block tags, and the blocks (text, enclosing paths, deepest path that is an aside or "") in order.

    Missing end tags are supplied as browsers do for paragraphs, items and cells; an end tag
    without a start is left out. Text after the last closing tag belongs to what is open.
    """
    tags: list[str] = []
    blocks: list[tuple[str, tuple[str, ...], str]] = []
    stack: list[tuple[str, str, bool]] = []  # name, path, aside
    text: list[str] = []
    at, page = 0, page or ""

    def flush() -> None:
        if text:
            found = _clean(text)
            text.clear()
            if found:
                blocks.append((found, tuple(p for _, p, _ in stack), next((p for _, p, a in reversed(stack) if a), "")))

    def shut(names: tuple[str, ...], upto: frozenset[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                flush()
                del stack[i:]
                return
            if stack[i][0] in upto:
                return

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCK:
                shut((name,), frozenset())
            continue
        if name == "br":
            text.append(" ")
        if name in RAW and name != "head":
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"(?i)</{re.escape(name)}\s*>").search(page, at)
                at = end.end() if end else size
            continue
        if name not in BLOCK:
            continue
        flush()
        if name in CLOSES:
            shut(CLOSES[name], frozenset(["table", "ul", "ol", "dl", "div", "article", "section", "main", "body"]) - frozenset(CLOSES[name]))
        elif name in BLOCK and stack and stack[-1][0] == "p":
            stack.pop()
        marks, aside = _marks(m[3])
        if name == "header" and any(n in MAIN for n, _, _ in stack):
            aside, name = False, "div"  # an article's own heading
        path = (stack[-1][1] + "/" if stack else "") + name + marks
        tags.append(path)
        if name not in VOID:
            stack.append((name, path, aside and name not in WHOLE or name in ASIDE_TAGS))
    flush()
    return tags, blocks


def _key(kind: str, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}:{value}") - (1 << 63)


def _text_key(found: str, paths: tuple[str, ...]) -> int:
    return _key("text", f"{paths[-1] if paths else ''}\0{found}")


MASK31 = (1 << 31) - 1


def _occurrences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per host and token, added up over a partition: sums of hashes of (page, count) in two halves, pages, greatest count, text in the tag."""
    total: dict[tuple[str, int], list] = {}
    for frame in frames:
        for row, host, page in zip(frame["row"], frame["host"], frame["html"], strict=True):
            tags, blocks = parse(page)
            seen: dict[int, list] = {}  # token: count, text inside, path, is text
            of = {}
            for path in tags:
                key = of.get(path)
                if key is None:
                    key = of[path] = _key("tag", path)
                    seen[key] = [0, 0, path, False]
                seen[key][0] += 1
            for found, paths, aside in blocks:
                seen.setdefault(_text_key(found, paths), [0, 0, paths[-1] if paths else "", True])[0] += 1
                if not aside:
                    for path in set(paths):
                        seen[of[path]][1] += len(found)
            for token, (n, size, path, is_text) in seen.items():
                v = xxhash.xxh64_intdigest(f"{row}:{n}") >> 2
                t = total.get((host, token))
                if t is None:
                    total[host, token] = [path, is_text, v & MASK31, v >> 31, 1, n, size]
                else:
                    t[2] += v & MASK31
                    t[3] += v >> 31
                    t[4] += 1
                    t[5] = max(t[5], n)
                    t[6] += size
    rows = [(*k, *t) for k, t in total.items()]
    for i in range(0, len(rows), 50_000):
        yield pd.DataFrame(rows[i : i + 50_000], columns=["host", "token", "path", "is_text", "v1", "v2", "pages", "most", "size"])


def deduce(pages: DataFrame) -> DataFrame:
    """(host, slot, template): the path of the content slot and the tokens of template text in own tags, per host with a slot.

    ``pages`` has host, row (any identity of the page) and html.
    """
    seen = pages.mapInPandas(_occurrences, "host string, token long, path string, is_text boolean, v1 long, v2 long, pages long, most long, size long")
    add = [F.sum(c).alias(c) for c in ("v1", "v2", "pages", "size")]
    tokens = materialize(seen.groupBy("host", "token").agg(F.max("path").alias("path"), F.max("is_text").alias("is_text"), F.max("most").alias("most"), *add).where("most = 1"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("all_pages"))
    classes = tokens.groupBy("host", "v1", "v2", "pages").agg(F.count(F.lit(1)).alias("tokens"))
    valid = classes.join(totals, "host").where((F.col("tokens") >= LEAST_TOKENS) & (F.col("pages") >= LEAST_SHARE * F.col("all_pages")))
    of = materialize(tokens.join(valid.select("host", "v1", "v2"), ["host", "v1", "v2"], "left_semi").where(~F.col("is_text") | (F.col("pages") >= SUPPORT)))
    # Nested classes: of the containers that have most of the text the deepest is the slot. At most some hundred tags a host.
    tags = of.where("not is_text").withColumn("whole", F.max("size").over(Window.partitionBy("host")))
    steps = F.transform(F.split("path", "/"), lambda x: F.split_part(x, F.lit("."), F.lit(1)))
    inside = tags.where((F.col("size") > 0.5 * F.col("whole")) & F.element_at(steps, -1).isin(CONTAINER) & ~F.arrays_overlap(F.slice(steps, F.lit(1), F.size(steps) - 1), F.array(*[F.lit(x) for x in sorted(MAIN)])))
    slot = inside.groupBy("host").agg(F.max(F.struct(F.size(F.split("path", "/")).alias("depth"), "size", "path")).alias("s")).select("host", F.col("s.path").alias("slot"))
    own = of.where("is_text").join(tags.select("host", "path"), ["host", "path"], "left_semi")
    return slot.join(own.groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("template")), "host", "left")


def main_text(page: str | None, slot: str | None = None, template: frozenset[int] = frozenset()) -> str:
    """The text of a page's content slot; without a slot (or one that the page lacks) all its text but asides."""
    _, blocks = parse(page)
    if slot and any(slot in paths for _, paths, _ in blocks):
        # Only asides inside the slot count.
        blocks = [(t, paths, aside if len(aside) > len(slot) else "") for t, paths, aside in blocks if slot in paths]
    return "\n".join(t for t, paths, aside in blocks if not aside and not (template and _text_key(t, paths) in template))


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = [main_text(h, s if isinstance(s, str) else None, frozenset(t) if t is not None else frozenset()) for h, s, t in zip(frame["html"], frame["slot"], frame["template"], strict=True)]
        yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def host_of(url: Column) -> Column:
    """The host of a URL in lower case without a port; null and odd ones are the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``.

    Null or empty html has an empty text; text is template only if it repeats on SUPPORT pages, so
    hosts with fewer have a slot alone; repeated rows are extracted each, and count as pages of
    their host; an empty table gives no rows. Only page_id, url and html are read.
    """
    pages = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    known = materialize(deduce(pages.select("host", F.xxhash64("page_id", "url", "html").alias("row"), "html")))
    joined = lookup_join(pages, known, ["host"], ["page_id", "url"], limit=BROADCAST_HOSTS)
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "slot", "template").mapInPandas(_extract, f"page_id {kind}, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
