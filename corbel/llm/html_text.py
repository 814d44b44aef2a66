"""Main text of web pages by line-block distribution.

Strip. A page is cut into tags and text in one pass of linear time. Blocks (text between block-level tags) become
lines. Elements that can't be main text by their tag, role or visibility (scripts, menus, footers) give one empty line,
whatever they hold, as do blocks outside any article that are mostly links without being a sentence, or a copyright line.
Forms and elements whose class or id names a part of that kind are set aside as groups, one inside another where they are
nested so. How much of the text a group holds decides whether it comes back: over half of what its surrounding group
holds, if its name says it loosely (LOOSE, or a name with a word of STATES); over two thirds, and no article beside it,
if it is a form or named strictly (NAMES); over nine tenths, outside all articles and without one beside it, if it is
named as readers' words (READERS); the last two only with SURE characters or more. What stays aside inside a group isn't counted as its own. If nothing else has text,
the group with most text comes back. Names with a word of LAYOUT (`has-sidebar`) tell what a page has, not what an element is.

Distribution. The sum of text lengths over a sliding window of WINDOW lines is taken at every line. The page sets the
threshold: the windows' sums are parted in two on a logarithmic scale where the variance between both parts is greatest
(Otsu), and the threshold is the geometric middle of the parts' means, SURE characters at most; a page whose parts
differ by less than APART has one part, all text. Windows at or above the threshold are dense.

Surge and dive. Empty lines part the page into stretches. In each, text surges at its first and dives at its last long
line (a third of the threshold) of a dense window, and all between is kept. Short lines before the surge and after the
dive are kept if they are fewer than WINDOW, mostly sentences, or in one box (an element below the page's own wrappers)
with the long line, and headings right before the surge always. What stands before a stretch's first title (h1) in other
boxes than the title is no text if it is less than a quarter of what follows. Stretches without a dense window are kept
if a box joins them with a kept one; if that box is the page's own wrapper, only their sentences are.

Ties. Where articles (article or main elements) hold half of the kept text or more, they are the text, whole and nothing
beside. Lines are in page order, each with white space made one space, joined by one space.

Defined results: null or empty html, or a page without text: empty text; unclosed and misnested tags: an end tag closes
up to its nearest open start tag, or nothing; a tag without an end ends before the next `<`; an unterminated comment,
script or style reaches to the page's end; other elements of raw content (RAW) that close themselves or have no end tag are
empty; a head without an end tag ends where the first element begins that can't stand in it; repeated rows: extracted each;
empty table: no rows; other columns are not carried.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, text_chunks

#: Lines of the sliding window; least quotient of a page's two parts; a window of so many characters is always dense.
WINDOW, APART, SURE = 3, 4.0, 300.0
#: Elements by their role for this method.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "math", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "link", "mark", "meta",
    "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
REMOVED = {"head", "nav", "aside", "footer", "button", "select", "menu", "dialog", "audio", "video", "canvas", "map", *RAW}
FORMS = {"form", "fieldset"}
IN_HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}
REMOVED_OUTSIDE = {"header"}
MAIN = {"article", "main"}
WHOLE = {"html", "body", "article", "main"}
BOXES = {"div", "section", "td", "blockquote", "article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
#: Words of class and id that name other parts of a page; those that may also name a part of the text.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "newsletter", "subscribe", "signup", "popup", "modal", "overlay", "taboola", "outbrain", "sidebar", "sidenav", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager",
    "sharing", "footer", "masthead", "topbar", "toolbar", "login", "copyright", "disclaimer",
}
READERS = {"comment", "comments", "disqus", "respond", "reply", "replies", "discussion", "discussions", "reviews", "talkback", "guestbook"}
LOOSE = {"banner", "alert", "widget", "related", "recommended", "share", "social", "skip", "search"}
LOOSE_OUTSIDE = {"header", "head", "top", "bottom", "legal"}
#: Words that make a class or id one of the page's layout, and words that make it a state or a place.
LAYOUT = {"has", "with", "no", "not", "without"}
STATES = {
    "open", "opened", "closed", "active", "fixed", "sticky", "enabled", "disabled", "loaded", "toggle", "toggled", "left", "right", "layout", "page", "site",
    "content", "contents", "main", "body", "article", "story", "post", "entry",
}
#: Kinds of groups, and the share of the surrounding group's text above which each comes back.
LOOSELY, STRICTLY, BY_READERS = 1, 2, 3
SHARE = {LOOSELY: 1 / 2, STRICTLY: 2 / 3, BY_READERS: 9 / 10}
#: An open element of the first kind ends where one of the second kind starts.
CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
SCOPE = {"ul", "ol", "table", "div", "section", "article", "main", "body", "nav", "aside", "header", "footer", "form", "dl", "select", "blockquote", "td", "th"}

#: A tag up to its end, the next `<` or the page's end; quotes count after an equals sign only. It always matches.
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^\"'<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)>?")
#: Attributes with their whole values, so that what stands in a value isn't taken for another one.
ATTR = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
ASKED = {"class", "id", "role", "style", "aria-hidden", "hidden"}
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: A line of so many characters that ends as a sentence does is text, though it is a link or stands apart.
LEAST_SENTENCE = 40
HIDDEN_STYLE = re.compile(r"display\s*+:\s*+none")
SENTENCE = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*$")
RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)


class Line:
    """A block of text, or an empty line (no text)."""

    __slots__ = ("text", "group", "article", "box", "heading")

    def __init__(self, text: str, group: int, article: int, box: int, heading: int) -> None:
        self.text, self.group, self.article, self.box, self.heading = text, group, article, box, heading


def _named(value: str, inside: bool) -> int:
    """The kind of group that a class or id makes of its element; 0: none."""
    kind = 0
    for token in value.split():
        words = set(SPLIT.split(CAMEL.sub("-", token).lower()))
        if words & LAYOUT:
            continue
        if words & READERS:
            # A state (`comments-open`) is mostly that of a wrapper.
            kind = max(kind, LOOSELY if words & {"open", "closed", "enabled", "disabled"} else BY_READERS)
        elif words & NAMES:
            kind = max(kind, LOOSELY if words & STATES else STRICTLY)
        elif words & LOOSE or not inside and words & LOOSE_OUTSIDE:
            kind = max(kind, LOOSELY)
    return kind


def _verdict(tag: str, attributes: str, inside: bool) -> tuple[bool, int]:
    """Whether the element goes, and the kind of group it is set aside as (0: none)."""
    if tag in REMOVED or not inside and tag in REMOVED_OUTSIDE:
        return True, 0
    kind = STRICTLY if tag in FORMS else 0
    if tag in WHOLE or not attributes.strip():
        return False, kind
    for name, a, b, c in ATTR.findall(attributes):
        name = name.lower()
        if name not in ASKED:
            continue
        value = a or b or c
        low = value.lower()
        if name == "hidden" or name == "aria-hidden" and low == "true" or name == "role" and low in ROLES or name == "style" and HIDDEN_STYLE.search(low):
            return True, 0
        if name in ("class", "id"):
            kind = max(kind, _named(value, inside))
    return False, kind


class _Parser:
    """One pass over a page; work is linear in its length, as every open element is found by its tag's own stack."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.lines: list[Line] = []
        self.groups: list[tuple[int, int, bool]] = [(0, 0, False)]  # surrounding group, kind, inside an article; group 0 is the page itself
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, gone, opens a group, opens an article
        self.open_at: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.boxes: list[int] = [0]
        self.n_boxes = self.n_articles = self.article = self.group = self.removed = self.inside = self.links = self.headings = 0
        self.text: list[str] = []
        self.linked = 0  # text within links since the last line
        self.hidden = False  # text in the outermost element that goes
        self.unclosed: set[str] = set()  # tags of RAW without an end tag from here on
        self._run()

    def _add(self, text: str) -> None:
        self.lines.append(Line(text, self.group, self.article, self.boxes[-1], self.headings))

    def _flush(self) -> None:
        if not self.text:
            return
        whole = "".join(self.text)
        block = " ".join(html.unescape(whole).split())
        self.text.clear()
        linked = 2 * self.linked > len(whole) and not (len(block) >= LEAST_SENTENCE and SENTENCE.search(block))
        if block and not self.inside and (linked or RIGHTS.match(block)):
            self._add("")
        elif block:
            self._add(block)
        self.linked = 0

    def _push(self, tag: str, attributes: str) -> None:
        gone, kind = _verdict(tag, attributes, self.inside > 0)
        groups = kind > 0 and not self.removed and not gone
        main = tag in MAIN and not gone and not self.removed
        at = len(self.stack)
        self.stack.append((tag, gone, groups, main))
        self.open_at.setdefault(tag, []).append(at)
        if tag in SCOPE:
            self.scopes.append(at)
        if tag in BOXES:
            self.n_boxes += 1
            self.boxes.append(self.n_boxes)
        self.removed += gone
        self.links += tag == "a"
        self.headings = int(tag[1]) if tag in HEADINGS else self.headings
        if groups:
            self._flush()
            self.groups.append((self.group, kind, self.inside > 0))
            self.group = len(self.groups) - 1
        if main:
            if not self.inside:
                self.n_articles += 1
                self.article = self.n_articles
            self.inside += 1

    def _pop(self) -> None:
        tag, gone, groups, main = self.stack.pop()
        self.open_at[tag].pop()
        if tag in SCOPE:
            self.scopes.pop()
        if groups:
            self._flush()
            self.group = self.groups[self.group][0]
        if tag in BOXES:
            self.boxes.pop()
        self.removed -= gone
        if gone and not self.removed:
            if self.hidden and tag not in INLINE:
                self._add("")
            self.hidden = False
        self.links -= tag == "a"
        self.headings = 0 if tag in HEADINGS else self.headings
        if main:
            self._flush()
            self.inside -= 1
            if not self.inside:
                self.article = 0

    def _close_to(self, at: int) -> None:
        while len(self.stack) > at:
            self._pop()

    def _put(self, start: int, end: int) -> None:
        if self.removed:
            self.hidden = self.hidden or not self.page[start:end].isspace()
        else:
            self.text.append(self.page[start:end])
            self.linked += (end - start) * (self.links > 0)

    def _raw(self, tag: str, attributes: str, at: int) -> int:
        """Where the content of an element of RAW ends."""
        code = tag in ("script", "style")
        if not code and (tag in self.unclosed or attributes.endswith("/")):
            return at
        end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(self.page, at)
        if not end and not code:
            self.unclosed.add(tag)
            return at
        close = self.page.find(">", end.start()) if end else -1
        return len(self.page) if close < 0 else close + 1

    def _tag(self, m: re.Match) -> int:
        """Handles a tag; where to go on."""
        tag, attributes = m.group(2).lower(), m.group(3)
        if tag not in INLINE:
            self._flush()
        if m.group(1):
            if self.open_at.get(tag):
                self._close_to(self.open_at[tag][-1])
            return m.end()
        if tag in RAW:
            return self._raw(tag, attributes, m.end())
        if self.open_at.get("head") and tag not in IN_HEAD:
            self._close_to(self.open_at["head"][-1])
        # A slash that ends an unquoted value doesn't close the tag.
        if tag in VOID or tag not in SCOPE and (attributes == "/" or attributes.endswith((" /", '"/', "'/"))):
            return m.end()
        for shut in CLOSES.get(tag) or (() if tag in INLINE else ("p",)):
            at = self.open_at.get(shut)
            if at and (not self.scopes or at[-1] >= self.scopes[-1]):
                self._close_to(at[-1])
        self._push(tag, attributes)
        return m.end()

    def _run(self) -> None:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self._put(at, lt)
            if lt == n:
                break
            m = TAG.match(page, lt)
            if m:
                at = self._tag(m)
            elif page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif page[lt + 1 : lt + 2] in ("/", "!", "?"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                self._put(lt, lt + 1)
                at = lt + 1
        self._close_to(0)
        self._flush()


def _come_back(groups: list[tuple[int, int, bool]], lines: list[Line]) -> list[bool]:
    """Whether each group's own text is kept. A group's number is above that of the one around it."""
    n = len(groups)
    own, articles = [0] * n, [0] * n
    for x in lines:
        own[x.group] += len(x.text)
        articles[x.group] += len(x.text) if x.article else 0
    full = list(own)
    for g in range(n - 1, 0, -1):
        full[groups[g][0]] += full[g]
        articles[groups[g][0]] += articles[g]
    back, mine = [True] * n, list(own)
    for g in range(n - 1, 0, -1):
        around, kind, inside = groups[g]
        beside = articles[0] > articles[g]
        barred = kind == STRICTLY and beside and not inside or kind == BY_READERS and (beside or inside) or kind != LOOSELY and mine[g] < SURE
        back[g] = not barred and mine[g] > SHARE[kind] * full[around]
        mine[around] += mine[g] if back[g] else 0
    if not mine[0] and full[0]:
        g = max(range(n), key=lambda g: own[g])
        while g:
            back[g] = True
            g = groups[g][0]
    for g in range(1, n):
        back[g] = back[g] and back[groups[g][0]]
    return back


def lines_of(page: str) -> list[Line]:
    """The page's lines, without the groups that stay aside (an empty line each)."""
    p = _Parser(page)
    back = _come_back(p.groups, p.lines)
    top = list(range(len(back)))  # the outermost group that stays aside
    for g in range(1, len(back)):
        if not back[p.groups[g][0]]:
            top[g] = top[p.groups[g][0]]
    out, last = [], 0
    for x in p.lines:
        if back[x.group]:
            out.append(x)
        elif top[x.group] != last:
            x.text = ""
            out.append(x)
        last = 0 if back[x.group] else top[x.group]
    return out


def window_sums(size: list[int]) -> list[int]:
    """Sums over the windows that end at each line, and at the WINDOW - 1 places after the last."""
    out, run = [], 0
    for i in range(len(size) + WINDOW - 1):
        run += (size[i] if i < len(size) else 0) - (size[i - WINDOW] if i >= WINDOW else 0)
        out.append(run)
    return out


def threshold(sums: list[int]) -> float:
    """The least sum of a dense window."""
    x = sorted(math.log(s) for s in sums if s > 0)
    total, low, best = sum(x), 0.0, (0.0, 0.0, 0.0)
    for k in range(1, len(x)):
        low += x[k - 1]
        if x[k] > x[k - 1]:
            a, b = low / k, (total - low) / (len(x) - k)
            best = max(best, (k * (len(x) - k) * (b - a) ** 2, a, b))
    _, a, b = best
    return min(math.exp((a + b) / 2), SURE) if b - a >= math.log(APART) else 1.0


def _ends(lines: list[Line], run: list[int], long: Line, whole: set[int]) -> bool:
    """Whether the short lines of run, before the surge or after the dive at a long line, belong to the text."""
    sentences = sum(bool(SENTENCE.search(lines[i].text)) for i in run)
    return len(run) < WINDOW or 2 * sentences >= len(run) or long.box not in whole and all(lines[i].box == long.box for i in run)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    lines = lines_of(page)
    size = [len(x.text) for x in lines]
    sums = window_sums(size)
    least = threshold(sums)
    dense = [s >= least for s in sums]
    filled = [x.box for x in lines if x.text]
    whole = {0} | ({filled[0]} if len(set(filled)) == 1 else set())  # boxes that tell nothing
    kept: set[int] = set()
    rest: list[list[int]] = []
    at = 0
    while at < len(lines):
        end = at
        while end < len(lines) and size[end]:
            end += 1
        stretch = range(at, end)
        at = max(end, at + 1)
        title = next((i for i in stretch if lines[i].heading == 1), end)
        if title < end and all(lines[i].box != lines[title].box for i in range(stretch[0], title)) and 4 * sum(size[stretch[0] : title]) < sum(size[title:end]):
            stretch = range(title, end)
        long = [i for i in stretch if size[i] * WINDOW >= least and any(dense[i : i + WINDOW])]
        if not long:
            rest.append(list(stretch))
            continue
        kept.update(range(long[0], long[-1] + 1))
        before, after = list(range(stretch[0], long[0])), list(range(long[-1] + 1, end))
        while before and lines[before[-1]].heading:
            kept.add(before.pop())
        for run, edge in ((before, long[0]), (after, long[-1])):
            if run and _ends(lines, run, lines[edge], whole):
                kept.update(run)
    boxes = {lines[i].box for i in kept}
    said = lambda x: len(x.text) >= LEAST_SENTENCE and SENTENCE.search(x.text)
    kept.update(i for run in rest for i in run if lines[i].box in boxes and (lines[i].box not in whole or said(lines[i])))
    articles = [i for i, x in enumerate(lines) if x.article and x.text]
    if 2 * sum(size[i] for i in articles) >= sum(size[i] for i in kept.union(articles)):
        kept = set(articles) or kept
    return " ".join(lines[i].text for i in sorted(kept))


def extract_main_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """page_id, url, text of every row."""
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch, "html"):
                out = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return pages.selectExpr("page_id", "url", f"{html_column} AS html").mapInArrow(run, "page_id long, url string, text string")
