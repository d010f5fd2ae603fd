"""Main text of web pages by the distribution of line-block sizes.

Markup is stripped first, in one pass with a stack of open elements that knows optional end tags:
comments, scripts and styles go with their content, as do elements that are boilerplate by name
(nav, footer, aside, ...) or by a class, id or role made of such words (``ad-box``, not
``share-of-market``).  A container so named that holds a main element, an h1, or nearly all the text
of the page is none.  Every block element is a line.

The text lengths, links not counted, are summed over sliding windows of ``width`` lines; a surge is
where the sum reaches ``surge``, a dive where it falls to nothing; the lines between the dives around
a surge are kept.  Where article or main elements hold at least as much text as the rest of the page,
their borders are dives, and lines inside weigh ``favour`` times as much and lines outside as many
times less: a short caption of a second article, or a note beside the article, makes no surge, a long
text does.  Elsewhere (empty ones, comments, teaser cards) all lines weigh the same.

Defined cases: null and empty html give empty text; a page without a surge keeps all lines with text
of their own, of a page with a main part those in it; unclosed elements end with their parents,
unclosed boilerplate at the next heading, main or article; a ``<`` that begins no tag is text, as is a tag that never
ends; pages of any length are read whole, in linear time; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import record, text_or_empty

_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_UNTIL = re.compile(r"""[^>"']*""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
# fixed values: element names of HTML
_RAW = frozenset("script style noscript template iframe svg textarea select object canvas math title".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_KEEP_P_OPEN = frozenset("li dd dt td th tr tbody thead tfoot caption figcaption legend summary option optgroup body html head".split())
_OWNERS = frozenset("ul ol menu dir dl table".split())
#: what an element of these names ends before it begins, within its list or table
_ENDS = {"li": ("li",), "dt": ("item",), "dd": ("item",), "tr": ("row",), "td": ("cell",), "th": ("cell",), "tbody": ("part",), "thead": ("part",), "tfoot": ("part",)}
_BOILERPLATE = frozenset("head nav footer aside button menu dialog".split())
_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices sidebar comment comments disqus menu navbar nav navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended newsletter subscribe subscription popup modal overlay widget widgets pagination pager toolbar login signup".split())
_NEUTRAL = frozenset("a area article bar block body bottom box btn button buttons card cards col column container content default desktop div entry fixed form global google group header icon icons img inline inner is item items js large left line link links list main mobile module n outer page panel post posts primary reader region right row section secondary site slot small sticky text thread title to top unit user view wrap wrapper".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_MAIN_PART = frozenset("article main h1".split())


def _named_boilerplate(value: str) -> bool:
    """Some name of a class or id value consists of boilerplate words, with neutral ones at most."""
    for name in value.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if any(p in _WORDS for p in parts) and all(p in _WORDS or p in _NEUTRAL for p in parts):
            return True
    return False


def _judge(name: str, attributes: str, in_content: bool) -> int:
    """0: no boilerplate; 1: boilerplate unless it holds the main part; 2: boilerplate."""
    if name in _BOILERPLATE:
        return 2
    found = 1 if name == "form" or (name == "header" and not in_content) else 0
    if not attributes or name in ("html", "body", "article", "main") and "role" not in attributes and "comment" not in attributes:
        return found
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return 2
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return 2
        if key == "role" and value.lower() in _ROLES:
            return 2
        if key in ("class", "id") and _named_boilerplate(value):
            found = 1
    return found


class _Scanner:
    """Tags and texts of a page, left to right; every search that finds nothing is made but once."""

    def __init__(self, source: str):
        self.source, self.gone = source, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag, outside quoted values; -1 where there is none."""
        source = self.source
        if self.find(">", at) < 0:
            return -1
        while True:
            stop = _UNTIL.match(source, at).end()
            if stop >= len(source):
                return self.find(">", at)
            quote = source[stop]
            if quote == ">":
                return stop
            close = self.find(quote, stop + 1) if source[at:stop].rstrip().endswith("=") else stop
            if close < 0:
                return self.find(">", stop)
            at = close + 1

    def after_raw(self, name: str, at: int) -> int:
        """End of a raw element's end tag, or of the page."""
        if name in self.gone:
            return len(self.source)
        found = re.compile(rf"</{name}\s*>", re.I).search(self.source, at)
        if found is None:
            self.gone.add(name)
            return len(self.source)
        return found.end()

    def __iter__(self):
        """(text, None, None) and ("", name, attributes); names of end tags begin with a slash."""
        source, n, at, begin = self.source, len(self.source), 0, 0
        while True:
            at = self.find("<", at)
            if at < 0:
                break
            follow = source[at + 1 : at + 2]
            if follow in ("!", "?"):
                yield source[begin:at], None, None
                comment = source.startswith("<!--", at)
                end = self.find("-->" if comment else ">", at + 2)
                begin = at = n if end < 0 else end + (3 if comment else 1)
                continue
            if self.find(">", at) < 0:
                break
            closing = follow == "/"
            name = _NAME.match(source, at + 1 + closing)
            end = self.tag_end(name.end()) if name else -1
            if end < 0:
                at += 1
                continue
            yield source[begin:at], None, None
            word = name[0].lower()
            begin = at = end + 1
            if word in _RAW:
                if not closing and not source[end - 1 : end] == "/":
                    begin = at = self.after_raw(word, at)
                yield " ", None, None
                continue
            yield "", "/" + word if closing else word, source[name.end() : end]
        yield source[begin:], None, None


class _Page:
    """Lines of (piece, linked, mark, inside main part); a mark is an element that may be boilerplate."""

    def __init__(self, source: str):
        self.lines: list[list[tuple[str, bool, int, bool]]] = [[]]
        self.stack: list[list] = []  # name, mark before, owner frame, slot in its owner
        self.open: dict[str, int] = {}
        self.owners: list[dict[str, int]] = [{}]
        self.marks: list[list] = [[-1, 0, True, False]]  # parent, judgement, explicitly closed, a main part begins inside
        self.mark = self.content = self.linked = 0
        for text, name, attributes in _Scanner(source):
            if text:
                self.lines[-1].append((text, self.linked > 0, self.mark, self.content > 0))
            elif name is None:
                continue
            elif name[0] == "/":
                self._end(name[1:])
            else:
                self._begin(name, attributes)

    def _line(self) -> None:
        if self.lines[-1]:
            self.lines.append([])

    def _pop_to(self, depth: int, explicit: bool = False) -> None:
        """Close elements above ``depth`` of the stack; the last one is closed by its own end tag if ``explicit``."""
        while len(self.stack) > depth:
            name, before, owns, slot, own = self.stack.pop()
            self.open[name] -= 1
            if name in _BLOCKS:
                self._line()
            if owns:
                self.owners.pop()
            if slot:
                self.owners[-1].pop(slot, None)
            if name in ("article", "main"):
                self.content -= 1
            elif name == "a":
                self.linked -= 1
            if own:
                self.marks[own][2] = explicit and len(self.stack) == depth
                self.mark = before

    def _end(self, name: str) -> None:
        if name == "br":
            self.lines[-1].append((" ", False, self.mark, self.content > 0))
        elif name == "p" and not self.open.get("p"):
            self._line()
        elif self.open.get(name):
            depth = len(self.stack) - 1
            while self.stack[depth][0] != name:
                depth -= 1
            self._pop_to(depth, explicit=True)

    def _begin(self, name: str, attributes: str) -> None:
        if name in _BLOCKS:
            if name not in _KEEP_P_OPEN and self.open.get("p"):
                depth = len(self.stack) - 1
                while self.stack[depth][0] != "p":
                    depth -= 1
                self._pop_to(depth, explicit=True)
            self._line()
        if name == "a" and self.open.get("a"):
            self._end("a")
        slot = _ENDS.get(name, ("",))[0]
        if slot and slot in self.owners[-1]:
            self._pop_to(self.owners[-1][slot], explicit=True)
        if name in _VOID:
            if name == "br":
                self.lines[-1].append((" ", False, self.mark, self.content > 0))
            return
        before, own = self.mark, 0
        judgement = _judge(name, attributes, self.content > 0)
        if judgement:
            self.marks.append([self.mark, judgement, False, False])
            self.mark = own = len(self.marks) - 1
        elif name in _MAIN_PART and self.mark:
            # from here on, boilerplate around that is never closed ends
            self.marks[self.mark][3] = self.marks[self.mark][3] or name != "article"
            self.marks.append([self.mark, -1, True, False])
            self.mark = len(self.marks) - 1
        if name in ("article", "main"):
            self.content += 1
        elif name == "a":
            self.linked += 1
        if slot:
            self.owners[-1][slot] = len(self.stack)
        self.stack.append([name, before, name in _OWNERS, slot, own])
        if name in _OWNERS:
            self.owners.append({})
        self.open[name] = self.open.get(name, 0) + 1

    def skipped(self) -> list[bool]:
        """Per mark, whether text under it is boilerplate."""
        n = len(self.marks)
        held = [0] * n
        for line in self.lines:
            for text, _, mark, _ in line:
                held[mark] += len(text.strip())
        main = [m[3] for m in self.marks]
        for k in range(n - 1, 0, -1):  # parents come first
            parent = self.marks[k][0]
            if self.marks[k][1] != 2:
                held[parent] += held[k]
                main[parent] = main[parent] or main[k]
        whole = [False] * n  # boilerplate
        closed = [False] * n  # boilerplate by an element with an end of its own
        for k in range(1, n):
            parent, judgement, ended, _ = self.marks[k]
            if judgement < 0:
                whole[k] = closed[k] = closed[parent]
                continue
            bad = judgement == 2 or judgement == 1 and not main[k] and held[k] < 0.95 * held[0]
            whole[k], closed[k] = whole[parent] or bad, closed[parent] or bad and ended
        return whole


def lines_of(html: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """(text, length without links, inside article or main) of each line, and whether what is inside is the page's main part."""
    page = _Page(html)
    skipped = page.skipped()
    lines: list[tuple[str, int, bool]] = []
    for pieces in page.lines:
        parts, linked, inside = [], 0, False
        for text, in_link, mark, content in pieces:
            if skipped[mark]:
                continue
            if "&" in text:
                text = entities.unescape(text)
            parts.append(text)
            inside = inside or content
            if in_link:
                linked += len(text.strip())
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            lines.append((text, max(0, len(text) - linked), inside))
    held = sum(len(t) for t, _, inside in lines if inside)
    return lines, 0 < held >= sum(n for _, n, inside in lines if not inside)


def between_dives(sizes: list[float], width: int, surge: float) -> list[bool]:
    """Which lines lie between dives, in stretches where a window's sum reaches ``surge``."""
    total, sums = sum(sizes[:width]), []
    for i, size in enumerate(sizes):
        sums.append(max(0.0, total))
        total += (sizes[i + width] if i + width < len(sizes) else 0) - size
    kept = [False] * len(sizes)
    i = 0
    while i < len(sizes):
        if not sizes[i]:
            i += 1
            continue
        end = i
        while end < len(sizes) and sums[end] > 0:
            end += 1
        if max(sums[i:end]) >= surge:
            kept[i:end] = [True] * (end - i)
        i = end
    return kept


def main_text(html: str | None, *, width: int = 3, surge: int = 80, favour: int = 8) -> str:
    """Lines between surge and dive points, joined by an empty line."""
    lines, marked = lines_of(html or "")
    if not lines:
        return ""
    sizes, place = [], []
    for k, (text, n, inside) in enumerate(lines):
        if marked and k and inside != lines[k - 1][2]:
            sizes += [0] * width
        place.append(len(sizes))
        sizes.append(n if not marked else len(text) * favour if inside else n / favour)
    kept = between_dives(sizes, width, surge)
    if not any(kept):
        kept = between_dives([0 if marked and s < 1 else s for s in sizes], width, 1)
    return "\n\n".join(t for (t, _, _), p in zip(lines, place) if kept[p])


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; one pass, no shuffle."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield record(schema, {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]})

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
