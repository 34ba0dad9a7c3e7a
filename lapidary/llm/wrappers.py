"""Main text of web pages through wrappers inferred for each host.

A page is a stream of tags and texts, with the end tags that it leaves out. Repeated runs in it fold
into groups; then the different folded pages of a host are aligned by a longest common subsequence,
whatever their length: what only one side has becomes optional, texts become slots, groups align as
wholes. The resulting union-free expression is the host's wrapper. Pages that
fold alike are one expression with a count; those of a host are aligned in order of their text,
some at a time, then the results, so that no task holds a host's pages and their order and
partitions don't matter.

Tags and class names say what kind of text a slot holds: texts outside menus, headers, footers,
sidebars, forms, notices, adverts and comments, inside the article where the page has one (else
inside main, else any). Within that, the wrapper decides: a text that at least three different
pages have, and half of the pages that have its slot, is template; outside articles a slot that
holds links on most pages is a menu. All other texts are content.
"""

from __future__ import annotations

import functools
import html
import json
import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.llm.scratch import Scratch, small_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile("[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: elements whose content is no markup, and those whose content is never shown as text of the page
RAW = {"script", "style", "textarea", "title"}
NOT_TEXT = {"noscript", "template", "iframe", "svg", "math", "object", "select", "audio", "video", "canvas"}
VOID = {"br", "img", "input", "meta", "link", "hr", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var br img wbr input".split())
OUT_TAGS = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head"}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "alertdialog", "form", "menu", "menubar", "toolbar"}
OUT_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored banner promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "comment comments reply replies respond disqus discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations widget toolbar pagination pager skip".split()
)
#: words that may stand beside those in a class name without making it another thing
PLAIN_NAMES = set(
    "box block bar wrapper wrap container content inner outer list item items section area panel group row col column slot unit zone top bottom left right main page site post entry article "
    "body button buttons link links form input text title image small large mobile desktop sticky fixed js is has no the by and for of".split()
)
COMMENTS = {"comment", "comments", "reply", "replies", "respond", "disqus"}
CLOSES_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
HOLDS = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "article", "section", "div", "main", "body", "aside", "nav", "header", "footer", "form", "blockquote", "td", "th", "li"}
#: what a text is: outside main content, in an article, in main, elsewhere
OUT, ARTICLE, MAIN, ELSEWHERE = "o", "a", "m", "e"


class _Open:
    __slots__ = ("name", "out", "header", "scope")

    def __init__(self, name: str, out: bool, header: bool, scope: str):
        self.name, self.out, self.header, self.scope = name, out, header, scope


def _opened(name: str, attributes: str, above: _Open) -> _Open:
    out, header, scope = above.out, above.header, above.scope
    words: set[str] = set()
    out_name = False
    role = ""
    if attributes.strip():
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role":
                role = value.strip().lower()
            elif key in ("hidden", "aria-hidden"):
                out = out or value.lower() != "false"
            else:
                for token in value.split():
                    own = {w.lower() for w in _NAME.findall(token)}
                    words |= own
                    # share-box is a share box, share-price is about something else
                    out_name = out_name or bool(own & OUT_NAMES and all(w in OUT_NAMES or w in PLAIN_NAMES or w.isdigit() for w in own))
    if name == "article" or name == "main" or role == "main":
        out = out or (out_name and bool(words & COMMENTS))
        scope = ARTICLE if name == "article" or scope == ARTICLE else MAIN
    elif name not in ("html", "body"):
        out = out or name in OUT_TAGS or name in NOT_TEXT or role in OUT_ROLES or out_name
        header = header or name == "header" or "header" in words
    if name in ("h1", "h2", "h3", "h4", "h5", "h6") and scope != ELSEWHERE:
        header = False  # a heading in an article's header belongs to it
    return _Open(name, out, header, scope)


def _is_linked(text: str, linked: int) -> bool:
    """Whether a block is more link than text, as menus are, and no sentence."""
    return 2 * linked > len(text) and not (len(text.split()) >= 5 and text.rstrip("\"')]»”’").endswith((".", "!", "?", "…", "。", "！", "？")))


def page_stream(page: str) -> tuple[list[str], list[tuple[str, bool]], list]:
    """Texts of the blocks, their kind and whether they are links, and the stream of tags and block numbers.

    An element that is never text of the page counts up to its end tag; without one it is passed over.
    """
    last_end = functools.cache(lambda name: max((m.start() for m in re.finditer(rf"</{name}\b", page, re.I)), default=-1))
    stack = [_Open("", False, False, ELSEWHERE)]
    texts: list[str] = []
    kinds: list[tuple[str, bool]] = []
    stream: list = []
    parts: list[str] = []
    linked, links = 0, 0

    def shut(k: int) -> None:
        """Elements from the k-th on end, with an end tag in the stream whether the page has it or not."""
        stream.extend("/" + x.name for x in reversed(stack[k:]) if x.name != "span")
        del stack[k:]

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                top = stack[-1]
                kinds.append((OUT if top.out or top.header else top.scope, _is_linked(text, linked)))
                stream.append(len(texts))
                texts.append(text)
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(html.unescape(raw) if "&" in raw else raw)
            if links:
                linked += len(raw)

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            add(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        if name in RAW and not closing:
            if name not in INLINE:
                flush()
            end = re.compile(rf"</{name}\s*>|</{name}\Z", re.I).search(page, at)
            if not (m[3] or m[6] or "").rstrip().endswith("/"):
                at = end.end() if end else len(page)
            continue
        if name in NOT_TEXT and not closing and ((m[3] or m[6] or "").rstrip().endswith("/") or last_end(name) < at):
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                links = max(0, links + (-1 if closing else 1))
            elif name == "span" and closing:
                if stack[-1].name == "span":
                    if stack[-1].out != stack[-2].out:
                        flush()
                    stack.pop()
            elif name == "span":
                own = _opened(name, m[3] or m[6] or "", stack[-1])
                if own.out != stack[-1].out:
                    flush()
                stack.append(own)
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    shut(k)
                    links = 0
                    break
            continue
        if name in VOID:
            continue
        if name in CLOSES_ITSELF or name in HOLDS:
            ended = name if name in CLOSES_ITSELF else "p"
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == ended:
                    shut(k)
                    break
                if stack[k].name in HOLDS:
                    break
        stack.append(_opened(name, m[3] or m[6] or "", stack[-1]))
        stream.append(name)
    flush()
    shut(1)
    return texts, kinds, stream


class Item:
    """A part of an expression: tag ``t``, text ``x`` or repeated group ``r``. A slot knows how many pages have it, and how many a link there."""

    __slots__ = ("kind", "key", "optional", "body", "pages", "links", "blocks")

    def __init__(self, kind: str, key: str, optional: bool = False, body: list | None = None, pages: int = 1, links: int = 0, blocks: list | None = None):
        self.kind, self.key, self.optional, self.body, self.pages, self.links, self.blocks = kind, key, optional, body or [], pages, links, blocks or []

    def plain(self) -> list:
        return [self.kind, self.key, int(self.optional), [i.plain() for i in self.body], self.pages, self.links]

    @staticmethod
    def of(p: list, times: int = 1) -> Item:
        return Item(p[0], p[1], bool(p[2]), [Item.of(b, times) for b in p[3]], p[4] * times, p[5] * times)


def _join(a: Item, b: Item, one_page: bool = False) -> Item:
    """Of two items of one key, of the same page or of different ones."""
    if one_page:
        pages, links = 1, min(a.links, b.links)
    else:
        pages, links = a.pages + b.pages, a.links + b.links
    return Item(a.kind, a.key, a.optional or b.optional, align(a.body, b.body, one_page) if a.kind == "r" else None, pages, links, a.blocks + b.blocks)


def _fold(items: list[Item], most: int = 64) -> list[Item]:
    """Runs of up to ``most`` items that directly repeat become groups, shorter runs first."""
    size = 1
    while size <= min(most, len(items) // 2):
        number: dict[str, int] = {}
        keys = np.array([number.setdefault(x.key, len(number)) for x in items])
        again = np.diff(np.concatenate([[0], (keys[:-size] == keys[size:]).astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(again == 1), np.flatnonzero(again == -1)
        out: list[Item] = []
        at = 0
        for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
            n = (hi - lo) // size + 1
            if n < 2 or lo < at:
                continue
            out += items[at:lo]
            body = items[lo : lo + size]
            for k in range(1, n):
                body = [_join(a, b, True) for a, b in zip(body, items[lo + k * size : lo + (k + 1) * size], strict=True)]
            at = lo + n * size
            if size == 1 and body[0].kind == "r":
                out += body
            else:
                out.append(Item("r", "(" + " ".join(x.key for x in body) + ")", body=body))
        if at:
            items, size = out + items[at:], 1
        else:
            size += 1
    return items


def page_items(kinds: list[tuple[str, bool]], stream: list) -> list[Item]:
    """The folded page. A text's key has the tag before it, so that a slot is one place, not a heading here and a line of a list there."""
    items = []
    for before, t in zip(["", *stream], stream):
        items.append(Item("t", t) if isinstance(t, str) else Item("x", f"#{kinds[t][0]}{before if isinstance(before, str) else ''}", links=int(kinds[t][1]), blocks=[t]))
    return _fold(items)


def common_places(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; between equal ends the one furthest to the left in ``left``.

    One way for sequences of any length: a row of the table of lengths is the bits of a whole number
    (clear where the length grows). Every root-of-the-rows-th row is kept, those between are made again
    on the way back: time by the product of the lengths, 30 pairs a digit, and memory by the root.
    """
    both = set(left).intersection(right)
    a = [i for i, key in enumerate(left) if key in both]
    b = [i for i, key in enumerate(right) if key in both]
    least = min(len(a), len(b))
    head = next((n for n in range(least) if left[a[n]] != right[b[n]]), least)
    tail = next((n for n in range(least - head) if left[a[-1 - n]] != right[b[-1 - n]]), least - head)
    first, last = list(zip(a[:head], b[:head], strict=True)), list(zip(a[len(a) - tail :], b[len(b) - tail :], strict=True))
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return first + last
    where: dict[str, list[int]] = {}
    for n, i in enumerate(a):
        where.setdefault(left[i], []).append(n)

    @functools.lru_cache(256)
    def places(key: str) -> int:
        own = np.zeros(len(a), bool)
        own[where.get(key, [])] = True
        return int.from_bytes(np.packbits(own, bitorder="little").tobytes(), "little")

    def below(row: int, j: int, all_bits: int) -> int:
        grown = row & places(right[j])
        return ((row + grown) | (row - grown)) & all_bits

    step = math.isqrt(len(b)) + 1
    row = all_bits = (1 << len(a)) - 1
    kept = []
    for n, j in enumerate(b):
        if n % step == 0:
            kept.append(row)
        row = below(row, j, all_bits)
    found = []
    n = len(a)
    while kept and n:
        at = (len(kept) - 1) * step
        all_bits = (1 << n) - 1
        row = kept.pop() & all_bits
        rows = [row.to_bytes(n // 8 + 1, "little")]
        for j in b[at : at + step]:
            row = below(row, j, all_bits)
            rows.append(row.to_bytes(n // 8 + 1, "little"))
        k = len(rows) - 1
        while k and n:
            byte, bit = (n - 1) >> 3, (n - 1) & 7
            if rows[k][byte] >> bit & 1:
                n -= 1
            elif not rows[k - 1][byte] >> bit & 1:
                k -= 1
            else:
                n, k = n - 1, k - 1
                found.append((a[n], b[at + k]))
    return first + found[::-1] + last


def align(a: list[Item], b: list[Item], one_page: bool = False) -> list[Item]:
    """One expression for both: a longest common subsequence joins, what only one has is optional or joins the group beside it."""
    left, right = [x.key for x in a], [x.key for x in b]
    if left == right:
        return [_join(x, y, one_page) for x, y in zip(a, b, strict=True)]
    out: list[Item] = []
    i = k = 0
    for j, n in [*common_places(left, right), (len(a), len(b))]:
        for part in (a[i:j], b[k:n]):
            keys = "(" + " ".join(x.key for x in part) + ")"
            if part and out and out[-1].kind == "r" and out[-1].key == keys:
                out[-1] = _join(out[-1], Item("r", keys, body=part), one_page)
            else:
                out += [Item(x.kind, x.key, True, x.body, x.pages, x.links, x.blocks) for x in part]
        if j < len(a):
            out.append(_join(a[j], b[n], one_page))
        i, k = j + 1, n + 1
    return out


def slots_of(wrapper: list[Item], page: list[Item]):
    """Pairs of a wrapper's slot and the item of a folded page that stands there."""
    for i, k in common_places([x.key for x in wrapper], [x.key for x in page]):
        w, p = wrapper[i], page[k]
        if w.kind == "x":
            yield w, p
        elif w.kind == "r":
            yield from slots_of(w.body, p.body)


def content_kind(kinds: list[tuple[str, bool]]) -> str:
    own = {k for k, _ in kinds}
    return next((k for k in (ARTICLE, MAIN) if k in own), ELSEWHERE)


def text_key(kind: str, text: str) -> int:
    return zlib.crc32((kind + text).encode("utf-8", "replace")) << 20 | len(text) & 0xFFFFF


def page_keys(texts: list[str], kinds: list[tuple[str, bool]]) -> list[tuple[int, int]]:
    """Keys of the different texts of a page's content, each with what tells the page from others.

    That is all texts, but in an article or main the longest other text of it, so that versions
    of one article are one page.
    """
    content = content_kind(kinds)
    own = sorted({t for t, (k, _) in zip(texts, kinds, strict=True) if k == content}, key=lambda t: (-len(t), t))
    if content == ELSEWHERE:
        page = zlib.crc32("\n".join(texts).encode("utf-8", "replace"))
        return [(text_key(content, t), page) for t in own]
    keys = [text_key(content, t) for t in own]
    return [(key, (keys[1] if len(keys) > 1 else 0) if i == 0 else keys[0]) for i, key in enumerate(keys)]


def main_text(page: str, wrapper: list[Item], often: dict[int, int] | None = None) -> str:
    """A page's content under its host's wrapper; ``often`` has how many pages have each text that at least three different ones have."""
    texts, kinds, stream = page_stream(page)
    content = content_kind(kinds)
    own = [i for i, (k, _) in enumerate(kinds) if k == content]
    keys = {i: text_key(content, texts[i]) for i in own} if often else {}
    asked = {i for i in own if (often and keys[i] in often) or (content == ELSEWHERE and kinds[i][1])}
    gone: set[int] = set()
    if asked:
        for slot, item in slots_of(wrapper, page_items(kinds, stream)):
            for i in asked.intersection(item.blocks):
                template = often and keys[i] in often and 2 * often[keys[i]] >= slot.pages
                menu = content == ELSEWHERE and kinds[i][1] and 2 * slot.links > slot.pages
                if template or menu:
                    gone.add(i)
    return "\n\n".join(texts[i] for i in own if i not in gone)


@functools.lru_cache(256)
def _wrapper(text: str) -> list[Item]:
    return [Item.of(p) for p in json.loads(text)]


def _text(items: list[Item]) -> str:
    return json.dumps([i.plain() for i in items], separators=(",", ":"))


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


def _aligned(frame: pd.DataFrame) -> pd.DataFrame:
    """The expressions of one host in one, in order of their texts."""
    joined = None
    for text, times in sorted(zip(frame["wrapper"], frame["times"], strict=True)):
        items = [Item.of(p, int(times)) for p in json.loads(text)]
        joined = items if joined is None else align(joined, items)
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [_text(joined)], "times": [1]})


def infer_wrappers(pages: DataFrame, held: int = 50_000, together: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """``host, wrapper, often`` from all pages.

    A task passes on what it holds after ``held`` different folded pages and texts; ``together``
    expressions of a host are aligned by one task. ``often`` has the keys of texts that at least three
    different pages of the host have, with the number of their pages.
    """
    scratch = scratch or Scratch(pages.sparkSession)

    def of_task(frames):
        folded: dict[tuple, int] = {}
        seen: dict[tuple, list] = {}

        def rows() -> pd.DataFrame:
            out = [(host, text, n, None, None) for (host, text), n in folded.items()]
            out += [(host, None, n, key, list(others)) for (host, key), (n, others) in seen.items()]
            return pd.DataFrame(out, columns=["host", "wrapper", "times", "key", "others"]).astype({"key": "Int64"})

        for frame in frames:
            for host, page in zip(frame["host"], frame["html"], strict=True):
                texts, kinds, stream = page_stream(page)
                text = _text(page_items(kinds, stream))
                folded[host, text] = folded.get((host, text), 0) + 1
                for key, other in page_keys(texts, kinds):
                    have = seen.setdefault((host, key), [0, set()])
                    have[0] += 1
                    if len(have[1]) < 3:
                        have[1].add(other)
                if len(folded) + len(seen) > held:
                    yield rows()
                    folded, seen = {}, {}
        yield rows()

    local = pages.select(host_of("url").alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInPandas(of_task, "host string, wrapper string, times long, key long, others array<long>")
    local = scratch.keep(local, "local")
    texts = local.where("key is not null").groupBy("host", "key").agg(F.sum("times").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("others")))).alias("others"))
    often = scratch.keep(texts.where("others >= 3").groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("often")), "often")
    now = scratch.keep(local.where("key is null").groupBy("host", "wrapper").agg(F.sum("times").alias("times")), "expressions0")
    turn = 0
    while True:
        size = now.groupBy("host").agg(F.count("*").alias("n"))
        if turn and not size.where("n > 1").limit(1).count():
            break
        part = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / together)).alias("part")
        cut = now.join(size, "host").select("host", "wrapper", "times", part)
        turn += 1
        now = scratch.keep(cut.groupBy("host", "part").applyInPandas(_aligned, "host string, wrapper string, times long"), f"expressions{turn}")
        scratch.drop(f"expressions{turn - 1}")
    return now.join(often, "host", "left").select("host", "wrapper", "often")


def extract(pages: DataFrame, small: int = 32 << 20) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``page_id, url, html``.

    Character references are decoded; white space in a block becomes one space; blocks follow
    the page's order with an empty line between. A null html is empty and has the empty text; a
    null url belongs to the host without name. Repeated rows give repeated rows, equal pages of a
    host equal texts. Pages of any length are whole and align alike. Further columns are left out,
    whatever their names; an empty table gives no row. Wrappers of up to ``small`` bytes in all are
    broadcast.
    """
    small_batches(pages.sparkSession)
    scratch = Scratch(pages.sparkSession)
    wrappers = scratch.keep(infer_wrappers(pages, scratch=scratch), "wrappers")
    scratch.drop("local", "often")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of("url").alias("host"))
    listed = wrappers.select("host", "wrapper", F.map_keys("often").alias("keys"), F.map_values("often").alias("counts"))

    @F.pandas_udf("string")
    def text_of(page: pd.Series, wrapper: pd.Series, keys: pd.Series, counts: pd.Series) -> pd.Series:
        texts, known, often = [], None, None
        for p, w, k, c in zip(page, wrapper, keys, counts, strict=True):
            if w is not known:  # pages of a host follow each other
                known, often = w, None if k is None else dict(zip(k.tolist(), c.tolist(), strict=True))
            texts.append(main_text(p, _wrapper(w), often))
        return pd.Series(texts, dtype=object)

    # wrappers are few and small where pages are regular: then no page moves; beyond the bound hosts meet by sort and merge
    weight = wrappers.agg(F.sum(F.octet_length("wrapper") + 24 * F.coalesce(F.size("often"), F.lit(0)))).first()[0] or 0
    rows = rows.join(F.broadcast(listed), "host") if weight <= small else rows.hint("merge").join(listed, "host")
    out = rows.select(F.col("page_id").cast("long").alias("page_id"), "url", text_of("html", "wrapper", "keys", "counts").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
