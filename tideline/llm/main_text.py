"""Main text of web pages by tree scoring.

The page is read into a tree (unclosed tags are closed as browsers do in the
plain cases).  Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are cut by tag, role and class; a class that
also names content is cut only by a whole name or as "main-nav" is, and headers
within article or main stay.  Lists of links stay within the article; where the
whole body is kept, those without a label are taken for menus.  Paragraphs
earn points by their length and commas and pass them to their ancestors,
halved and thinned further up; a container's points are discounted by its link
density.  The best container is kept, and those of its siblings that score well
or read as paragraphs.  Blocks come in page order, white space made one space,
joined by an empty line.  Of inline tags only ``br`` makes white space; a slash
at the end of a tag that is not void means nothing, as in HTML.

Null html counts as empty; a page without text gives the empty string.  Nothing
is dropped for its length.  No step recurses, so any depth of nesting works.
Repeated rows give repeated results.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .staging import arrow_map

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
CUT = frozenset("head nav footer aside form script style noscript template iframe object embed svg math canvas button select option textarea title audio video dialog menu".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NEGATIVE = re.compile(r"(?<![a-z])(ads?|adverts?|advertisement|advertising|sponsor(ed)?|promo(tion)?|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|comments?|disqus|replies|respond|side-?bar|menu|nav(bar|igation)?|breadcrumbs?|foot(er)?|masthead|head(er)?-?(bar|wrap|top)?|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|widget|pagination|pager|toolbar|skip)(?![a-z])")
POSITIVE = re.compile(r"(?<![a-z])(article|body|content|entry|main|page|post|story|text|blog|hentry)(?![a-z])")

_HAS = re.compile(r"(?<![a-z])(has|have|with|without|no)-[\w-]*")
_HEAD = frozenset(("head", "header"))
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")
_COMMA = re.compile("[,،、，]")
_PARAGRAPH = frozenset("p pre td blockquote dd li div section".split())
_BASE = {"article": 10, "main": 10, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "form": -3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "address": -3}


def unwanted(label: str, positive: bool, in_article: bool) -> bool:
    """Do the classes and ids name something to cut?"""
    names = _HAS.sub("", label).split()
    found = [[m for m in NEGATIVE.finditer(t) if not (in_article and m[0] in _HEAD)] for t in names]
    if not positive:
        return any(found)
    if any(m[0] == t for t, ms in zip(names, found) for m in ms):
        return True
    if not all(NEGATIVE.search(t) for t in names if POSITIVE.search(t)):
        return False
    return any(ms and ms[-1].end() == len(t) and ms[-1][0] not in _HEAD for t, ms in zip(names, found))


class Page:
    """The tree: parent, tag, cut flag and class weight of each node, and its pieces of text in page order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.cut, self.weight = [-1], ["#"], [False], [0]
        self.pieces: list[tuple[int, str]] = []
        stack, opened = [0], Counter()

        def pop() -> None:
            opened[self.tag[stack.pop()]] -= 1

        def close(names: tuple[str, ...], stops: frozenset[str]) -> None:
            """Closes the innermost of names, unless one of stops is nearer."""
            if not any(opened[n] > 0 for n in names):
                return
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in names:
                    while len(stack) > k:
                        pop()
                    return
                if self.tag[stack[k]] in stops:
                    return

        at = 0
        while (m := _TOKEN.search(source, at)) is not None:
            if m.start() > at:
                self.pieces.append((stack[-1], source[at : m.start()]))
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                if opened[name] > 0:
                    while self.tag[stack[-1]] != name:
                        pop()
                    pop()
                continue
            if name in BLOCK:
                close(("p",), BLOCK - {"p"})
            if name in CLOSES:
                close(CLOSES[name], frozenset(("ul", "ol", "dl", "table", "menu", "select")))
            node = len(self.tag)
            cut, weight = self._judge(name, m[3] or m[6] or "", opened)
            self.parent.append(stack[-1])
            self.tag.append(name)
            self.cut.append(cut or self.cut[stack[-1]])
            self.weight.append(weight)
            if name in VOID:
                if name in ("br", "hr"):
                    self.pieces.append((node, "\n"))
                continue
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            stack.append(node)
            opened[name] += 1
        if at < len(source):
            self.pieces.append((stack[-1], source[at:]))

    def _judge(self, name: str, attributes: str, opened: Counter) -> tuple[bool, int]:
        cut = name in CUT or name == "header" and not (opened["article"] or opened["main"])
        if not attributes.strip(" /"):
            return cut, 0
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        label = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", found.get("class", "") + " " + found.get("id", "")).lower()
        positive = bool(POSITIVE.search(label)) or "articlebody" in found.get("itemprop", "").lower()
        negative = unwanted(label, positive, bool(opened["article"] or opened["main"]))
        cut |= found.get("role", "").lower() in CUT_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        cut |= negative and name not in ("html", "body", "article", "main")
        return cut, 25 * positive - 25 * negative

    def text(self) -> str:
        n = len(self.tag)
        size, linked, commas, own_block = [0] * n, [0] * n, [0] * n, [True] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
            if self.tag[i] in BLOCK:
                own_block[self.parent[i]] = False
        for i in range(n - 1, 0, -1):  # inline elements pass on that they hold blocks
            if self.tag[i] not in BLOCK and not own_block[i]:
                own_block[self.parent[i]] = False
        for i, s in self.pieces:
            if not self.cut[i] and (length := len(_SPACE.sub(" ", s).strip())):
                size[i] += length
                linked[i] += length * in_link[i]
                commas[i] += len(_COMMA.findall(s))
        for i in range(n - 1, 0, -1):
            for x in (size, linked, commas):
                x[self.parent[i]] += x[i]
        points: dict[int, float] = {}
        for i in range(1, n):
            if self.cut[i]:
                continue
            if self.tag[i] in ("article", "main") and size[i]:
                points.setdefault(i, float(_BASE[self.tag[i]] + self.weight[i]))
            if self.tag[i] not in _PARAGRAPH or not own_block[i] or size[i] < 25:
                continue
            score, up, level = 1 + commas[i] + min(size[i] // 100, 3), self.parent[i], 0
            while up > 0 and level < 5:
                if self.tag[up] in BLOCK:
                    points.setdefault(up, float(_BASE.get(self.tag[up], 0) + self.weight[up]))
                    points[up] += score if level == 0 else score / 2 if level == 1 else score / (level * 3)
                    level += 1
                up = self.parent[up]
        density = lambda i: linked[i] / size[i] if size[i] else 0.0
        final = {i: p * (1 - density(i)) for i, p in points.items()}
        keep = {0} if not final else {max(final, key=lambda i: (final[i], -i))}
        if final:
            top = next(iter(keep))
            bar = max(10.0, 0.2 * final[top])
            for i in range(1, n):
                if i != top and self.parent[i] == self.parent[top] and not self.cut[i] and self.tag[i] in BLOCK:
                    read = self.tag[i] == "p" and own_block[i] and (size[i] > 80 and density(i) < 0.25 or size[i] and not linked[i])
                    if final.get(i, 0) >= bar or read:
                        keep.add(i)
        return self._blocks(keep, size, density)

    def _blocks(self, keep: set[int], size: list[int], density) -> str:
        n = len(self.tag)
        inside, article = [False] * n, [False] * n
        block = list(range(n))
        for i in range(n):
            p = self.parent[i]
            article[i] = p >= 0 and article[p] or self.tag[i] in ("article", "main") or i in keep and self.tag[i] not in ("#", "html", "body")
            menu = not article[i] and self.tag[i] in ("ul", "ol", "div", "table", "section") and density(i) > 0.5 and i not in keep
            inside[i] = not self.cut[i] and (i in keep or p >= 0 and inside[p] and not menu)
            if p >= 0 and self.tag[i] not in BLOCK:
                block[i] = block[p]
        out, now, last = [], [], -1
        for i, s in self.pieces:
            if not inside[i]:
                if block[i] != last:  # another block has come between
                    last = -1
                continue
            if block[i] != last:
                out.append("".join(now))
                now, last = [], block[i]
            now.append(s)
        out.append("".join(now))
        texts = (_SPACE.sub(" ", html.unescape(t)).strip() for t in out)
        return "\n\n".join(t for t in texts if t)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def _extract(batches: Iterator[pa.RecordBatch], source: str, out: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 128):
            part = batch.slice(a, 128)
            texts = [main_text(s) for s in part.column(part.schema.get_field_index(source)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for c, f in zip(part.columns, part.schema) if f.name != source), pa.array(texts, pa.string())], out)


def extract(df: DataFrame, source: str = "html", keys: tuple[str, ...] = ("page_id", "url"), text: str = "text") -> DataFrame:
    """The keys and the main text of every page."""
    fields = [df.schema[k] for k in keys] + [T.StructField(text, T.StringType())]
    return arrow_map(df.select(*keys, source), partial(_extract, source=source, out=[f.name for f in fields]), T.StructType(fields))
