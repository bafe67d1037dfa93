"""Main text of HTML pages by equivalence-class template deduction.

Tokens are a page's tags with their path, and its text blocks with the path that they stand in.  Over the pages of a host, tokens with the
same occurrence vector form a class.  A class is valid as a whole: if it spans enough pages, has two tokens at least, and its outermost
tokens lie in one gap, that is right below one element of the valid classes around it.  The class of the page itself is the root.  The tokens of valid classes are the
host's template; what an element of it holds beside its template children and template texts is its slot.  The main slot is the smallest element of a class
that occurs once a page and holds all slots; all text inside it is the page's, however many pages share it.
Names and tags decide only where classes can't: between slots whose text changes from page to page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import discard, materialize

#: Element names by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("br td th tr tbody thead tfoot body html head".split())
CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
BOILERPLATE = frozenset("nav footer script style noscript template iframe svg head title button select textarea dialog menu".split())
#: Elements that are no part of an article unless they hold most of it.
SET_APART = frozenset("aside form".split())
#: Elements of running text, whose names say nothing.
TEXTUAL = frozenset("a abbr b blockquote caption cite code dd del dt em figcaption figure h1 h2 h3 h4 h5 h6 i img ins li mark p pre q s small span strong sub sup td th time tr u".split())
ITEMS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "tr": ("tr", ("table", "tbody", "thead", "tfoot")), "option": ("option", ("select",))}
_ROLE = re.compile(r"^(navigation|banner|contentinfo|complementary|search|dialog|alert|form|menu|menubar)$")
_APART = "ad ads advert adverts advertisement advertising banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe promo sponsor sponsored sidebar nav navbar navigation menu breadcrumb breadcrumbs footer comment comments disqus respond replies share sharing social related recommended login signup toolbar skip".split()
_BESIDE = "area bar block bottom box button buttons container content form global group header icon icons inner item items js left link links list main outer page post posts primary right row secondary section site slot space top unit user widget wrap wrapper".split()
#: A class or id, or each of its parts, is one of the words for what stands beside an article; words of place and shape may go with them.
_WORDY = re.compile(rf"(?:(?:{'|'.join(_BESIDE)}|#)[-_]?)*(?:{'|'.join(_APART)})(?:[-_](?:{'|'.join([*_APART, *_BESIDE])}|#))*")
_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?])")
#: One attribute after another: a name, and behind = a value in either kind of quotes or in none; a stray quote is part of a name.
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)|(?=>)))?""")
_TAG_END = re.compile(r"[\s/]*>")
_SPACE, _NUMBER, _NAME = re.compile(r"\s+"), re.compile(r"\d+"), re.compile(r"[.@!]")


def _attributes(page: str, at: int) -> tuple[int | None, dict[str, str]]:
    """Where a tag ends whose name ends at ``at``, and its attributes; None if it never ends.

    A quote that never closes holds no value: the value then ends at white space or the tag's end, as one without quotes.
    """
    if page[at : at + 1] == ">":
        return at + 1, {}
    found: dict[str, str] = {}
    while not (end := _TAG_END.match(page, at)):
        m = _ATTRIBUTE.match(page, at)
        if not m:  # an = without a name, or an open quote
            odd = re.compile(r"[\s/]*[=\"']?[^\s>]*").match(page, at)
            if odd.end() == at or odd.end() >= len(page):
                return None, found
            at = odd.end()
            continue
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        at = m.end()
    return end.end(), found


def events(page: str):
    """(kind, name or text, attributes) of a page, in order; kinds are text, open and close.  Comments are left out.

    Broken pages end where their text ends: an unclosed tag or comment takes the rest.
    """
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            yield "text", page[at:], None
            return
        if m.start() > at:
            yield "text", page[at : m.start()], None
        if page.startswith("<!--", m.start()):
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        if m[2] is None:
            end = page.find(">", m.end())
            if end < 0:
                return
            at = end + 1
            continue
        at, found = _attributes(page, m.end())
        if at is None:
            return
        name = m[2].lower()
        if m[1]:
            yield "close", name, None
            continue
        yield "open", name, found
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            yield "raw", page[at : close.start()] if close else page[at:], None
            yield "close", name, None
            at = close.end() if close else n


class Walk:
    """The open elements while a page is read: (name, path, set aside, marked paths).

    A path's step is the element's name with its classes, numbers as #, and ! where the names say that it is no part of an article.
    """

    def __init__(self):
        self.stack: list[tuple[str, str, bool, tuple[str, ...]]] = []

    def _pop_to(self, names, stops) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in names:
                del self.stack[k:]
                return
            if self.stack[k][0] in stops:
                return

    @property
    def path(self) -> str:
        return self.stack[-1][1] if self.stack else ""

    def open(self, name: str, attributes: dict[str, str] | None) -> str:
        """The path of the element that opens here."""
        if name in ENDS_P:
            self._pop_to(("p",), ("div", "article", "section", "td", "li", "blockquote", "main", "body"))
        if name in ITEMS:
            names, stops = ITEMS[name]
            self._pop_to(names.split(), stops)
        attributes = attributes or {}
        kind = attributes.get("class", "").lower()
        role = attributes.get("role", "").lower()
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
        aside = name in BOILERPLATE or hidden or bool(role and _ROLE.match(role))
        said = _NUMBER.sub("#", f"{kind} {attributes.get('id', '').lower()}").split() if attributes and name not in TEXTUAL and name not in ("html", "body", "main", "article") else []
        marked = name in SET_APART or any(_WORDY.fullmatch(w) for w in said)
        step = name + "".join(f".{c}" for c in _NUMBER.sub("#", kind).replace("/", "|").split()) + ("@main" if role == "main" else "") + "!" * marked
        path = f"{self.path}/{step}"
        if name not in VOID:
            over = self.stack[-1] if self.stack else ("", "", False, ())
            self.stack.append((name, path, aside or over[2], (*over[3], path) if marked else over[3]))
        return path

    def close(self, name: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                del self.stack[k:]
                return


@dataclass
class Block:
    """A text block: the path of its element, and its pieces with the marked paths and links that they stand in."""

    path: str
    pieces: list[tuple[str, tuple[str, ...], bool]]

    def text(self, kept=None) -> str:
        """White space as one space each; without pieces in a marked path other than ``kept``, if that is given."""
        said = "".join(t for t, marks, _ in self.pieces if kept is None or all(m in kept for m in marks))
        return _SPACE.sub(" ", entities.unescape(said)).strip()


def read_page(page: str) -> tuple[Counter, list[Block]]:
    """How often each path opens, and the page's text blocks in order, without elements that are never part of an article."""
    walk, opened, blocks = Walk(), Counter({"": 1}), []
    pieces: list = []
    where = ""

    def flush() -> None:
        nonlocal pieces
        if pieces:
            if any(not t.isspace() for t, _, _ in pieces):
                blocks.append(Block(where, pieces))
            pieces = []

    for kind, value, attributes in events(page):
        if kind == "text":
            top = walk.stack[-1] if walk.stack else ("", "", False, ())
            if not top[2] and value:
                if not pieces:
                    where = next((p for n, p, _, _ in reversed(walk.stack) if n in BLOCK), "")
                pieces.append((value, top[3], any(n == "a" for n, *_ in walk.stack)))
        elif kind != "raw":
            if value in BLOCK:
                flush()
            if kind == "close":
                walk.close(value)
            else:
                opened[walk.open(value, attributes)] += 1
    flush()
    return opened, blocks


def above(path: str) -> list[str]:
    """A path and all paths above it, the page's own "" first."""
    return ["", *(path[:k] for k, c in enumerate(path) if c == "/" and k), path] if path else [""]


def name_of(path: str) -> str:
    return _NAME.split(path.rsplit("/", 1)[-1], maxsplit=1)[0]


def main_slot(once: list[str], varied: dict[str, int], linked: dict[str, int]) -> tuple[str | None, list[str]]:
    """The main slot among the paths ``once``, and the marked paths that hold an article all the same.

    ``varied`` and ``linked``: characters below each path, in all and inside links, that the template doesn't hold.  An element with over half
    of them is part of the article whatever its name is; other marked elements and those that are mostly links aren't.  The slot is the
    deepest element with all that is left, or the article or main element, if it has half of it.
    """
    total = varied.get("", 0)
    kept = [p for p in varied if p.endswith("!") and 2 * varied[p] > total]
    no = {p for p in varied if p and 2 * varied[p] <= total and (p.endswith("!") or (2 * linked.get(p, 0) > varied[p] and name_of(p) in CONTAINERS | {"ul", "ol"}))}
    left = dict(varied)
    for p in no:
        up = above(p)[:-1]
        if not any(q in no for q in up):
            for q in up:
                left[q] = left.get(q, 0) - varied[p]
    rest = left.get("", 0)
    if rest <= 0:
        return None, kept
    fit = [p for p in once if p and p not in no and not any(q in no for q in above(p)) and left.get(p, 0) > 0]
    for want in ("article", "main"):
        found = [p for p in fit if (name_of(p) == want or want == "main" and "@main" in p.rsplit("/", 1)[-1]) and 2 * left[p] >= rest]
        if found:
            return max(found, key=lambda p: (left[p], -len(p), p)), kept
    rich = [p for p in fit if left[p] >= rest and name_of(p) in CONTAINERS]
    return max(rich, key=lambda p: (p.count("/"), p), default=None), kept


def below_counts(blocks: list[Block]) -> tuple[Counter, Counter]:
    """Characters below each path, in all and inside links."""
    varied, linked = Counter(), Counter()
    for block in blocks:
        for text, marks, link in block.pieces:
            n = len(text.strip())
            if n:
                paths = dict.fromkeys([*above(block.path), *marks])
                for p in paths:
                    varied[p] += n
                    if link:
                        linked[p] += n
    return varied, linked


def block_key(block: Block) -> int:
    """A 63-bit name of a text token: its path and text."""
    return xxhash.xxh64_intdigest(f"{block.path}\t{block.text()}".encode("utf-8", "replace")) >> 1


def main_text(page: str, slot: str | None = None, kept=()) -> str:
    """The blocks of the slot, joined by line feeds; "" if there are none.

    Where the page lacks the slot, or has nothing in it, it is its own template: the rules of ``main_slot`` hold for the page alone.  ``header``
    elements are left out if the slot is the whole body.
    """
    opened, blocks = read_page(page)
    for _ in range(2):
        if slot is not None and slot in opened:
            inside = [b for b in blocks if b.path == slot or b.path.startswith(slot + "/") or not slot]
            if name_of(slot) in ("", "html", "body"):
                inside = [b for b in inside if not (names := [name_of(p) for p in above(b.path)]).count("header") or "article" in names or "main" in names]
            texts = [t for b in inside if (t := b.text(kept))]
            if texts:
                return "\n".join(texts)
        slot, kept = main_slot(list(opened), *below_counts(blocks))
        slot = slot or ""
    return ""


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1), F.lit(""))).alias("host")


def valid_classes(size: int, tokens: list[tuple], share: float, min_pages: int, least: int) -> list[tuple[list[tuple], str | None]]:
    """The valid classes of a host's tokens, the root first, each with the element in whose gap it lies.

    Tokens with one occurrence vector are a class.  It is valid if it spans ``min_pages`` and a ``share`` of the pages, has ``least`` tokens, and the nearest template element above
    is the same for all of its outermost tokens.  Classes are tried from those of most pages and least depth on, as an element is on every page on which one inside it is.
    """
    classes: dict[tuple, list[tuple]] = {}
    for t in tokens:
        if t[2] >= min_pages and t[2] >= size * share:
            classes.setdefault((t[2], t[3], t[4]), []).append(t)
    depth = lambda t: t[0].count("/") + bool(t[1])
    held, out = set(), []
    for c in sorted(classes.values(), key=lambda c: (-c[0][2], min(map(depth, c)), min((t[0], t[1]) for t in c))):
        own = {t[0] for t in c if not t[1]}
        root = "" in own
        gaps = set()
        for path, text, *_ in c:
            over = above(path) if text else above(path)[:-1]
            if not any(p in own for p in over):
                gaps.add(next((p for p in reversed(over) if p in held), None))
        if root or (len(c) >= least and len(gaps) == 1):
            out.append((c, None if root else gaps.pop()))
            held |= own
    return out


def deduce(host: str, size: int, tokens: list[tuple], share: float, min_pages: int, least: int = 2) -> dict:
    """A host's template of (path, text key or 0, pages, opened, vector, chars, linked): its valid classes, its main slot and the marked elements that hold an article."""
    valid = valid_classes(size, tokens, share, min_pages, least)
    varied = {t[0]: t[5] for c, _ in valid for t in c if not t[1]}
    linked = {t[0]: t[6] for c, _ in valid for t in c if not t[1]}
    texts = [t for c, _ in valid for t in c if t[1]]
    # A host whose pages all say the same has no slots; its texts are then no template.
    if sum(t[5] for t in texts) >= varied.get("", 0):
        texts = []
    for path, _, _, _, _, chars, links in texts:
        for p in above(path):
            if p in varied:
                varied[p] -= chars
                linked[p] -= links
    once = [t[0] for c, _ in valid for t in c if not t[1] and c[0][2] == c[0][3]]
    slot, kept = main_slot(once, varied, linked)
    number = {t[0]: n for n, (c, _) in enumerate(valid) for t in c if not t[1]}
    held = [{"path": t[0], "text": t[1], "class": n, "inside": None if gap is None else number[gap]} for n, (c, gap) in enumerate(valid) for t in c]
    held.sort(key=lambda t: (t["path"], t["text"]))
    return {"host": host, "pages": size, "slot": slot, "kept": sorted(kept), "texts": sorted({t[1] for t in texts}), "tokens": held}


def templates(pages: DataFrame, html: str = "html", url: str = "url", share: float = 0.5, min_pages: int = 3) -> DataFrame:
    """``(host, pages, slot, kept, texts, tokens array<struct<path, text, class, inside>>)``: each host's template.

    An occurrence vector is held as two sums of page hashes times counts, so it is built from partial sums and no
    host's pages meet in one task.  Tokens on fewer than ``min_pages`` pages, or than ``share`` of the host's, aren't
    template; those on fewer than ``min_pages`` don't leave the first aggregation, so a host's tokens are at most its pages' average divided by the share.
    """

    def run(batches):
        names = ["host", "path", "text", "page", "pages", "opened", "s1", "s2", "chars", "linked"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sums: dict[tuple, list[int]] = {}
                for host, html in zip(*(part.column(k).to_pylist() for k in range(2)), strict=True):
                    digest = xxhash.xxh64_intdigest((html or "").encode("utf-8", "replace"), 5)
                    opened, blocks = read_page(html or "")
                    varied, linked = below_counts(blocks)
                    found: dict[tuple, list[int]] = {(path, 0): [n, varied.get(path, 0), linked.get(path, 0)] for path, n in opened.items()}
                    for b in blocks:
                        own = found.setdefault((b.path, block_key(b)), [0, 0, 0])
                        own[0] += 1
                        own[1] += sum(len(t.strip()) for t, _, _ in b.pieces)
                        own[2] += sum(len(t.strip()) for t, _, link in b.pieces if link)
                    for (path, text), (n, chars, links) in found.items():
                        s = sums.setdefault((host, path, text), [0, 0, 0, 0, 0, 0])
                        for k, v in enumerate((1, n, n * (digest & 0x7FFFFFFF), n * (digest >> 33), chars, links)):
                            s[k] += v
                columns = [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array([k[2] for k in sums], pa.int64())]
                columns += [pa.array([s[j] & 0x7FFFFFFF if j in (2, 3) else s[j] for s in sums.values()], pa.int64()) for j in range(6)]
                yield pa.RecordBatch.from_arrays(columns, names=[n for n in names if n != "page"])

    rows = pages.select(host_of(url), F.col(html).alias("html"))
    partial = rows.mapInArrow(run, "host string, path string, text bigint, pages bigint, opened bigint, s1 bigint, s2 bigint, chars bigint, linked bigint")
    sums = partial.groupBy("host", "path", "text").agg(*[F.sum(c).alias(c) for c in ("pages", "opened", "s1", "s2", "chars", "linked")]).where(F.col("pages") >= min_pages)
    sums = materialize(sums.withColumn("s1", F.pmod("s1", F.lit(1 << 31))).withColumn("s2", F.pmod("s2", F.lit(1 << 31))), "page-tokens")
    size = sums.where("path = '' and text = 0").select("host", F.col("pages").alias("size"))
    frequent = sums.join(size, "host").where(F.col("pages") >= F.col("size") * share)
    vector = F.shiftleft("s1", 31).bitwiseOR(F.col("s2")).alias("vector")
    shape = "host string, pages bigint, slot string, kept array<string>, texts array<bigint>, tokens array<struct<path:string,text:bigint,class:int,inside:int>>"

    def of_host(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(group[["path", "text", "pages", "opened", "vector", "chars", "linked"]].itertuples(index=False, name=None))
        return pd.DataFrame([deduce(group["host"].iloc[0], int(group["size"].iloc[0]), rows, share, min_pages)])

    found = materialize(frequent.select("host", "size", "path", "text", "pages", "opened", vector, "chars", "linked").groupBy("host").applyInPandas(of_host, shape), "templates")
    discard(sums)
    return found


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", most_frequent: int = 10_000) -> DataFrame:
    """``(page_id, url, text)`` for each page: the main text by its host's template.

    Pages without a template (fewer than three pages on the host, or no classes in common) are their own: the article or main
    element with half of the text, else the common ancestor of the text outside named boilerplate.  Null pages are empty texts; pages of null urls
    share a host.  Repeated rows give repeated rows.  At most ``most_frequent`` hosts
    have so many pages that their templates are broadcast; the other hosts' pages meet theirs in a join.
    """
    slots = templates(pages, html, url).select("host", "pages", F.struct("slot", "kept").alias("template"))
    often = max(100, (slots.agg(F.sum("pages")).first()[0] or 0) // most_frequent)
    frequent = slots.where(F.col("pages") > often).select("host", F.col("template").alias("known"), F.lit(True).alias("frequent"))
    rare = slots.where(F.col("pages") <= often).select(F.col("host").alias("key"), "template")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url))
    rows = rows.join(F.broadcast(frequent), "host", "left")
    spread = F.when(F.col("frequent"), F.concat_ws("/", "host", F.xxhash64("url", "html").cast("string"))).otherwise(F.col("host"))
    rows = rows.withColumn("key", spread).join(rare, "key", "left").withColumn("template", F.coalesce("known", "template"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = []
                for page, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    texts.append(main_text(page or "", t["slot"], frozenset(t["kept"] or ())) if t else main_text(page or ""))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema[page_id].dataType.simpleString()
    return rows.select("page_id", "url", "html", "template").mapInArrow(run, f"page_id {kind}, url string, text string")
