"""HTML extraction by deducing the template of a host's pages.

A page is a sequence of tokens: elements by their path, and the text blocks
between them. Tokens of a host that occur equally often on the same pages have
equal occurrence vectors and form an equivalence class; pages with the same
article are one page there. A class on enough of the host's pages that holds
elements and texts can be part of the template. Its texts nest in its elements,
and the members inside an element of the class must stand in the same order on
every page; a text without such an element, or whose place differs, is no
template token. What stands between template tokens is a slot. Fixed text of the
template goes; what is in slots stays, repeated or not (a text of a copied
article isn't on all pages that have its elements, so it has another vector),
unless an element that never holds the article encloses it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantus.llm.store import stable

#: Elements whose content is never the article.
OUTSIDE = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "head", "title", "button", "select", "textarea", "iframe", "svg", "object", "canvas", "menu", "dialog"}
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose content is not markup.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
#: Elements inside a line of text.
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: A compound class that begins with one of these names a part of the article, or says what there is not.
OWN = {"post", "entry", "article", "story", "content", "no", "not", "non", "without", "has", "with"}
#: Words that as a class, id or role, or at the edge of one, mark other parts of a page.
MARKS = (
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer header login masthead menu modal nav navbar navigation newsletter "
    "notice pagination pager popup promo related share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget contentinfo complementary search alert"
).split(" ")
#: A template token is on this share of a host's pages that differ, of which there are so many at least.
SHARE, LEAST_PAGES = 0.8, 4
#: Template tokens of all hosts are broadcast only up to this many; beyond that they are joined to the pages.
BROADCAST_TOKENS = 200_000

PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
SIGN = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile(r"[ \t\n\r\f\v   -     　]+")
RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW}


def mark(word: str) -> bool:
    """Whether a class, id or role names a part that isn't the article: a whole name, or a compound that begins or ends with one."""
    parts = re.split(r"[_-]+", word)
    return word in MARKS or (len(parts) > 1 and parts[0] not in OWN and (parts[0] in MARKS or parts[-1] in MARKS))


def marked(rest: str) -> tuple[str, bool]:
    """First class of a tag, and whether its attributes mark it as no article."""
    first, bad = "", False
    for m in SIGN.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            bad = True
        elif key in ("class", "id", "role"):
            words = value.lower().split()
            bad = bad or any(map(mark, words))
            first = first or (words[0] if words and key == "class" else "")
    return first, bad


def parse(page: str) -> list[tuple[str, str | None, bool, int]]:
    """(path, text, outside, parent) of each element (text is None) and text block of a page, in order.

    The path names elements with their first class; parent is the place in the list of the element around, or -1.
    """
    out: list[tuple[str, str | None, bool, int]] = []
    stack: list[tuple[str, str, bool, int]] = []  # name, path, outside, place
    path, outside, place, text, at = "", False, -1, [], 0

    def flush() -> None:
        if text:
            t = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if t:
                out.append((path, t, outside, place))
            text.clear()

    while at < len(page):
        m = PIECE.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in INLINE and not outside and not (m["rest"] and marked(m["rest"])[1]) and not any(x[0] == name and x[2] != outside for x in stack[-1:]):
            continue
        if m["close"]:
            deep = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            flush()
            if deep is not None:
                del stack[deep:]
                path, outside, place = stack[-1][1:] if stack else ("", False, -1)
            continue
        flush()
        if name in VOID:
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            stack.pop()  # these close themselves
            path, outside, place = stack[-1][1:] if stack else ("", False, -1)
        if name in ("article", "main") and outside:
            # the article is in no menu: one that is still open was never closed
            open_at = next((i for i, x in enumerate(stack) if x[0] in OUTSIDE), None)
            if open_at is not None and not (open_at and stack[open_at - 1][2]):
                del stack[open_at:]
                path, outside, place = stack[-1][1:] if stack else ("", False, -1)
        first, bad = marked(m["rest"]) if m["rest"] else ("", False)
        inner, out_now = f"{path}/{name}.{first}" if first else f"{path}/{name}", outside or bad or name in OUTSIDE
        if name == "header" and not bad and re.search(r"/(article|main)\b", path):
            out_now = outside  # the article's own head
        if m["rest"] and m["rest"].endswith("/"):
            continue
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        out.append((inner, None, out_now, place))
        stack.append((name, inner, out_now, len(out) - 1))
        path, outside, place = stack[-1][1:]
    flush()
    return out


def candidates(events: list) -> list[tuple[str, str]]:
    """(path, text) of the blocks that may be the article: those outside of menus, notices and the like."""
    return [(path, t) for path, t, outside, _ in events if t is not None and not outside]


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].split(":")[0].lower() if m else ""


def h64(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s) - (1 << 63)


def names(events: list) -> list[int | None]:
    """The token of each event; None outside of what may hold the article."""
    return [None if outside else h64(path if t is None else f"{path}\n{t}") for path, t, outside, _ in events]


TOKENS = "host string, page bigint, body bigint, token bigint, n bigint, block boolean"
#: A token that each page has once.
PAGE = 0


def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's tokens with how often it has them; body names the page's candidates for the article."""
    for b in batches:
        host, page, body, token, n, block = [], [], [], [], [], []
        for pk, url, text in zip(b.column("pk").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
            events = parse(text or "")
            own, texts = {PAGE: 1}, set()
            for x, (_, t, _, _) in zip(names(events), events, strict=True):
                if x is not None:
                    own[x] = own.get(x, 0) + 1
                    if t is not None:
                        texts.add(x)
            host += [host_of(url)] * len(own)
            page += [pk] * len(own)
            body += [h64("\n".join(t for _, t in candidates(events)))] * len(own)
            token += own
            n += own.values()
            block += [x in texts for x in own]
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(body, pa.int64()), pa.array(token, pa.int64()), pa.array(n, pa.int64()), pa.array(block, pa.bool_())], names=["host", "page", "body", "token", "n", "block"])


def templates(found: DataFrame) -> DataFrame:
    """host, token, cls: tokens of the equivalence classes of elements and texts that are on SHARE of the host's pages.

    Pages with the same body are one. The occurrence vector of a token is named by two sums over its pages of a
    hash of the page times the count, so that a class needs no list of pages.
    """
    found = found.groupBy("host", "body", "token").agg(F.max("n").alias("n"), F.max("block").alias("block"))
    mixed = F.xxhash64("body", F.lit(1))
    wide = F.col("n").cast("decimal(38,0)")
    vec = found.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum(wide * F.shiftright(mixed, 16)).alias("v1"), F.sum(F.xxhash64("body", "n").cast("decimal(38,0)")).alias("v2"), F.max("block").alias("block"))
    vec = stable(vec.filter(F.col("pages") >= LEAST_PAGES))
    size = vec.filter(F.col("token") == PAGE).select(F.col("host").alias("h"), F.col("pages").alias("of"))
    vec = vec.filter(F.col("token") != PAGE)
    # classes meet the size of their host, as they are far fewer than a hot host's tokens
    classes = vec.groupBy("host", "v1", "v2").agg(F.max("pages").alias("pages"), F.max("block").alias("text"), F.min("block").alias("bare")).filter("text and not bare")
    classes = classes.join(size, classes["host"] == size["h"]).filter(F.col("pages") >= SHARE * F.col("of"))
    return vec.join(classes.select("host", "v1", "v2"), ["host", "v1", "v2"]).select("host", "token", F.xxhash64("v1", "v2").alias("cls"))


def places(page: str, cls: dict[int, int]) -> dict[int, int]:
    """The place of each text token of a class inside the outermost element of its class; -1 if it has none or several."""
    events = parse(page)
    own = names(events)
    inside: dict[int, list[int]] = {}
    out: dict[int, int] = {}
    for i, x in enumerate(own):
        if x in cls:
            top, up = -1, i if events[i][1] is None else events[i][3]
            while up >= 0:
                if cls.get(own[up]) == cls[x]:
                    top = up
                up = events[up][3]
            if top < 0:
                out[x] = -1
            else:
                inside.setdefault(top, []).append(x)
    texts = {x for x, e in zip(own, events, strict=True) if e[1] is not None}
    for members in inside.values():
        for k, x in enumerate(members):
            if x in texts:
                out[x] = k if out.get(x, k) == k else -1
    return out


def order(look):
    """Pages to host, token, lo, hi: the least and the largest place of each text token; a task's pages are summed up."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], tuple[int, int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["host", "token", "lo", "hi"])

        for b in batches:
            for url, page, cls in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), look(b), strict=True):
                if page and cls:
                    host = host_of(url)
                    for x, k in places(page, cls).items():
                        lo, hi = seen.get((host, x), (k, k))
                        seen[host, x] = min(lo, k), max(hi, k)
            if len(seen) > BROADCAST_TOKENS:
                yield out()
                seen.clear()
        yield out()

    return work


def ordered(frame: DataFrame, look) -> DataFrame:
    """host, token: the text tokens that have one place on all pages."""
    at = frame.mapInArrow(order(look), "host string, token bigint, lo bigint, hi bigint").groupBy("host", "token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return at.filter("lo >= 0 and lo = hi").select("host", "token")


def by_host(shared):
    """The template tokens of each page of a batch, by its host."""
    return lambda b: [shared.value.get(host_of(u), {}) for u in b.column("url").to_pylist()]


def by_page(b: pa.RecordBatch) -> list[dict[int, int]]:
    """The template tokens that come with each page."""
    return [{x["token"]: x["cls"] for x in own} for own in b.column("own").to_pylist()]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row: the article's text.

    Null html is empty and gives an empty text; a null url is the host ''. Hosts of under LEAST_PAGES pages that differ have no template: only
    elements decide there. Rows that repeat are extracted each; other columns are ignored. Broken markup and tags that
    the page ends in are read as far as they go.
    """
    cols = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    pk = F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce("url", F.lit("-")), F.coalesce("html", F.lit("")))
    keyed = cols.withColumn("pk", pk)
    found = keyed.select("pk", "url", "html").mapInArrow(tokens, TOKENS)
    cand = stable(templates(found))
    out = "page_id bigint, url string, text string, n_chars bigint"
    if cand.count() <= BROADCAST_TOKENS:
        sc = pages.sparkSession.sparkContext

        def share(rows: DataFrame):
            held: dict[str, dict[int, int]] = {}
            for r in rows.collect():
                held.setdefault(r["host"], {})[r["token"]] = r["cls"]
            return by_host(sc.broadcast(held))

        fixed = ordered(cols, share(cand)).withColumn("cls", F.lit(0))
        return cols.mapInArrow(reader(share(fixed)), out)
    # a short list per page: those of its tokens that are of the template
    held = found.select("host", "page", "token").distinct()

    def join(rows: DataFrame) -> DataFrame:
        hit = held.join(rows, ["host", "token"]).groupBy(F.col("page").alias("_pk")).agg(F.collect_list(F.struct("token", "cls")).alias("own"))
        return keyed.join(hit, keyed["pk"] == hit["_pk"], "left").select("page_id", "url", "html", F.coalesce("own", F.array().cast("array<struct<token:bigint,cls:bigint>>")).alias("own"))

    fixed = stable(ordered(join(cand), by_page)).withColumn("cls", F.lit(0).cast("bigint"))
    return join(fixed).mapInArrow(reader(by_page), out)


def reader(look):
    """Pages to texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [article(page or "", fixed) for page, fixed in zip(b.column("html").to_pylist(), look(b), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return work


def article(page: str, fixed: dict[int, int]) -> str:
    """The blocks in the slots of the template, outside of the elements that are never the article."""
    slots = [t for p, t in candidates(parse(page)) if h64(f"{p}\n{t}") not in fixed]
    return " ".join(slots)
