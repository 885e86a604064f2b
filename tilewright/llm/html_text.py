"""HTML extraction by layout-aware rendering.

A tokenizer and a tree builder with implied tags make a tree; visibility rules prune it; a renderer emits all visible text:
blocks on lines of their own, blank lines around paragraphs, headings, lists, tables and quotes, list markers with nesting, ``pre`` as it is,
table cells in aligned columns.

Implied tags: a block start closes an open ``p``; ``li``, ``dt``/``dd``, ``option``, ``tr``, ``td``/``th`` and table sections close their like; a cell outside
a row opens one; void elements have no content; end tags without an open element are dropped; open elements end with the text.
Not visible: head, script, style, template and their like; frames, embedded media, canvas and data lists; definitions and descriptions of drawings and
annotations of formulas (the rest of svg and math is text); options of a drop-down that are not marked as selected (lists show all); ``hidden``; ``type=hidden``; closed dialogs; inline or class/id/tag style rules with
``display: none`` or ``visibility: hidden``, in at-rules only if they hold on a screen of ``SCREEN`` (an unknown condition does not).
Textareas are shown like ``pre``.

Defined cases: null and empty pages give the empty text; text without any tag is a paragraph; unclosed comments and tags run to the end;
elements nest to any depth; pages of any length are read as a whole; repeated rows give
repeated rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import arrow_map, table

#: Cells that others follow are wrapped at this width; a longer word widens its column, up to ``LONGEST_WORD``, where it is broken.
WIDEST, LONGEST_WORD = 60, 1000

# Element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist rp param source track desc metadata defs symbol annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul tr td th thead tbody tfoot caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table pre blockquote figure hr".split())
#: Elements of drawings and formulas that stand apart from their neighbours.
APART = frozenset("text mfrac mtr mtd".split())
#: A start tag closes the nearest open element of its list, if none of the fence lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
}
P_FENCE = frozenset({"table", "td", "th", "li", "dd", "button", "caption", "blockquote", "div", "section", "article"})

TOKEN = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
CSS_SKIPPED = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
#: The screen that at-rules are read for: pixels, and features with a value.
SCREEN = {"width": 1280.0, "height": 800.0}
FEATURES = {"orientation": "landscape", "prefers-color-scheme": "light", "hover": "hover", "pointer": "fine", "scripting": "none", "update": "fast"}
LENGTH = re.compile(r"(min-|max-)?(width|height)\s*(:|<=|>=|<|>|=)\s*(\d*\.?\d+)(px|r?em)\Z")
SIMPLE = re.compile(r"([a-zA-Z][\w-]*)?([.#][\w-]+)?\Z")
BLANK = re.compile(r"[ \t\n\r\f\xa0]+")


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def attributes_of(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        value = a or b or c
        out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return out


def parse(text: str) -> tuple[Element, list[str]]:
    """The tree and the texts of its style elements."""
    root, styles = Element("html", {}), []
    stack = [root]
    places: dict[str, list[int]] = {}  # of each tag, where on the stack it is open
    at, n = 0, len(text)

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags, fence) -> None:
        k = innermost(tags)
        if k and k >= innermost(fence):
            for e in stack[k:]:
                places[e.tag].pop()
            del stack[k:]

    def add(element: Element) -> None:
        stack[-1].children.append(element)
        places.setdefault(element.tag, []).append(len(stack))
        stack.append(element)

    while at < n:
        found = TOKEN.search(text, at)
        until = found.start() if found else n
        if until > at:
            piece = text[at:until]
            stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)
        if not found:
            break
        at, tag = found.end(), (found.group(3) or "").lower()
        if not tag:
            continue
        if found.group(2):
            if tag == "p" and not places.get("p"):
                stack[-1].children.append(Element("p", {}))
            else:
                close({tag}, () if tag in ("table", "body", "html") else {"table"} if tag not in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else {"table"} - {tag})
            continue
        raw = found.group(4) or ""
        if tag in ("html", "body"):
            stack[0].attributes.update(attributes_of(raw)) if raw else None
            if tag == "body" and places.get("head"):
                close({"head"}, ())
            continue
        if stack[-1].tag == "head" and tag not in ("title", "meta", "link", "script", "style", "base", "noscript", "template"):
            close({"head"}, ())
        element = Element(tag, attributes_of(raw) if raw and not raw.isspace() else {})
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(text, at)
            inner = text[at : end.start() if end else n]
            if tag == "style":
                media = element.attributes.get("media", "")
                styles.append(f"@media {media}{{{inner}}}" if media.strip() else inner)
            element.children.append(html.unescape(inner) if tag == "textarea" else inner)
            stack[-1].children.append(element)
            at = (text.find(">", end.start()) + 1 or n) if end else n
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
            if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                add(Element("tr", {}))
        elif tag in BLOCK:
            close({"p"}, P_FENCE)
        if tag in VOID or raw.endswith("/") and tag not in BLOCK:
            stack[-1].children.append(element)
        else:
            add(element)
    return root, styles


def feature_holds(feature: str) -> bool:
    """Whether a media feature, the content of its parentheses, holds on ``SCREEN``; unknown ones do not."""
    m = LENGTH.match(feature)
    if m:
        bound, have = float(m[4]) * (1 if m[5] == "px" else 16), SCREEN[m[2]]
        how = {"min-": ">=", "max-": "<="}.get(m[1] or "", "=") if m[3] == ":" else m[3]
        return have == bound and "=" in how or have < bound and "<" in how or have > bound and ">" in how
    name, _, value = (x.strip() for x in feature.partition(":"))
    return name in ("color", "hover", "pointer", "width", "height") if not value else FEATURES.get(name) == value


def media_holds(queries: str) -> bool:
    """Whether one of the queries of a media list holds on a screen; the empty list does."""

    def one(query: str) -> bool:
        not_ = re.match(r"not\b(?!\s*\()", query)
        query = re.sub(r"(?:not|only)\b(?!\s*\()", "", query, count=1).strip() if re.match(r"(?:not|only)\b", query) else query
        ok = any(
            all(p in ("screen", "all") if not p.startswith(("(", "not")) else feature_holds(p.strip("() ")) if p[0] == "(" else not feature_holds(p[3:].strip("() ")) for p in map(str.strip, re.split(r"\band\b", part)))
            for part in re.split(r"\bor\b", query)
        )
        return ok != bool(not_)

    return not queries.strip() or any(one(q.strip()) for q in queries.lower().split(","))


def group_holds(head: str) -> bool:
    """Whether the rules inside an at-rule's block count: those of media that hold, of supports and of layers."""
    name, _, rest = head[1:].replace("(", " (", 1).partition(" ")
    name = name.lower()
    return media_holds(rest) if name == "media" else name == "layer" or name == "supports" and not rest.strip().lower().startswith("not")


def screen_rules(style: str):
    """(selectors, declarations) of the rules that count on a screen. Blocks left open end with the text."""
    css = CSS_SKIPPED.sub("", style)
    open_: list[tuple[bool, str | None, list[str]]] = []
    at = 0
    for stop in [*((m.start(), m[0]) for m in re.finditer("[{};]", css)), (len(css), ";")]:
        head, at = css[at : stop[0]].strip(), stop[0] + 1
        counts = open_[-1][0] if open_ else True
        if stop[1] == "{":
            if head.startswith("@"):
                open_.append((counts and group_holds(head), None, []))
            else:  # a rule nested in another is relative to it and is not read
                open_.append((counts and not (open_ and open_[-1][1] is not None), head, []))
            continue
        if open_:
            open_[-1][2].append(head)
            if stop[1] == "}":
                counts, selectors, body = open_.pop()
                if counts and selectors is not None:
                    yield selectors, ";".join(body)
    for counts, selectors, body in open_:
        if counts and selectors is not None:
            yield selectors, ";".join(body)


def hiding_rules(styles: list[str]) -> set[tuple[str, str]]:
    """(tag or "", ".class" or "#id" or "") of simple selectors that hide on a screen."""
    out = set()
    for style in styles:
        for selectors, body in screen_rules(style):
            if HIDING.search(body):
                for one in selectors.split(","):
                    m = SIMPLE.match(one.strip())
                    if m and (m[1] or m[2]):
                        out.add(((m[1] or "").lower(), m[2] or ""))
    return out


def shown_options(e: Element, rules) -> Element:
    """The options of a select that a page shows: all of a list, the selected ones of a drop-down."""
    size = e.attributes.get("size", "")
    every = "multiple" in e.attributes or size.isascii() and size.isdigit() and int(size[:9]) > 1
    out, queue = Element("div", {}), deque(e.children)
    while queue:
        c = queue.popleft()
        if isinstance(c, str) or not visible(c, rules):
            continue
        if c.tag == "option" and (every or "selected" in c.attributes):
            c.tag = "div"
            out.children.append(c)
        elif c.tag == "optgroup":
            if every and c.attributes.get("label"):
                out.children.append(Element("div", {}))
                out.children[-1].children.append(c.attributes["label"])
            queue.extendleft(reversed(c.children))
    return out


def visible(e: Element, rules: set[tuple[str, str]]) -> bool:
    if e.tag in UNSEEN:
        return False
    a = e.attributes
    if a:
        if "hidden" in a or e.tag == "input" or e.tag == "dialog" and "open" not in a:
            return False
        if "style" in a and HIDING.search(a["style"]):
            return False
    elif e.tag in ("dialog", "input"):
        return False
    if rules:
        names = ["", *("." + c for c in a.get("class", "").split())]
        if "id" in a:
            names.append("#" + a["id"])
        return not any((t, n) in rules for t in ("", e.tag) for n in names if t or n)
    return True


class Lines:
    """Output lines with pending blanks; runs of inline text are collapsed as they come."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []

    def text(self, piece: str) -> None:
        self.inline.append(piece)

    def flush(self) -> None:
        if self.inline:
            line = BLANK.sub(" ", "".join(self.inline)).strip(" ")
            self.inline = []
            if line:
                self.lines.append(line)

    def blank(self) -> None:
        self.flush()
        if self.lines and self.lines[-1] != "":
            self.lines.append("")

    def take(self, lines: list[str]) -> None:
        self.flush()
        self.lines += lines

    def done(self) -> list[str]:
        self.flush()
        while self.lines and self.lines[-1] == "":
            self.lines.pop()
        return self.lines


def rendered(step) -> None:
    """Runs ``step``, a generator that yields the generators it waits for, with a stack of its own in place of recursion."""
    stack, value = [step], None
    while stack:
        try:
            step = stack[-1].send(value)
        except StopIteration as end:
            stack.pop()
            value = end.value
        else:
            stack.append(step)
            value = None


def render(e: Element, rules, out: Lines, pre: bool = False):
    """The content of ``e``, as steps for ``rendered``."""
    ordinal = int(e.attributes["start"]) if e.tag == "ol" and re.fullmatch(r"-?\d{1,9}", e.attributes.get("start", "")) else 1
    for child in e.children:
        if isinstance(child, str):
            if pre:
                parts = child.split("\n")
                for k, part in enumerate(parts):
                    if k:
                        out.lines.append("".join(out.inline).rstrip())
                        out.inline = []
                    out.inline.append(part)
            else:
                out.text(child)
            continue
        if not visible(child, rules):
            continue
        tag = child.tag
        if tag == "br":
            if pre or "".join(out.inline).strip():
                if pre:
                    out.lines.append("".join(out.inline).rstrip())
                    out.inline = []
                else:
                    out.flush()
            else:
                out.blank()
        elif tag == "hr":
            out.blank()
        elif tag == "img":
            if child.attributes.get("alt"):
                out.text(" " + child.attributes["alt"] + " ")
        elif tag == "select":
            out.flush()
            yield render(shown_options(child, rules), rules, out)
            out.flush()
        elif tag in APART:
            out.text(" ")
            yield render(child, rules, out)
            out.text(" ")
        elif e.tag == "mfrac":
            yield render(child, rules, out)
            out.text(" ")
        elif tag in ("pre", "textarea"):
            out.blank()
            inner = Lines()
            yield render(child, rules, inner, True)
            if inner.inline:
                inner.lines.append("".join(inner.inline).rstrip())
                inner.inline = []
            while inner.lines and not inner.lines[0]:
                inner.lines.pop(0)
            out.take(inner.done())
            out.blank()
        elif tag == "table":
            out.blank()
            out.take((yield table_lines(child, rules)))
            out.blank()
        elif tag == "li":
            out.flush()
            inner = Lines()
            yield render(child, rules, inner)
            mark = f"{ordinal}. " if e.tag == "ol" else "- "
            ordinal += 1
            body = inner.done()
            if body:
                out.take([mark + body[0], *(" " * len(mark) + x if x else x for x in body[1:])])
        elif tag in ("dd", "blockquote"):
            out.blank() if tag == "blockquote" else out.flush()
            inner = Lines()
            yield render(child, rules, inner)
            out.take(["  " + x if x else x for x in inner.done()])
            if tag == "blockquote":
                out.blank()
        elif tag in BLOCK:
            nested = tag in ("ul", "ol", "dl", "menu", "dir") and e.tag == "li"
            gap = out.blank if tag in SPACED and not nested else out.flush
            gap()
            yield render(child, rules, out, pre)
            gap()
        else:
            yield render(child, rules, out, pre)


def wrapped(line: str) -> list[str]:
    """``line`` cut at blanks into pieces of at most ``WIDEST``; words that are longer keep whole up to ``LONGEST_WORD``."""
    out, at, n = [], 0, len(line)
    while n - at > WIDEST:
        cut = line.rfind(" ", at + 1, at + WIDEST + 1)
        if cut < 0 or not line[at:cut].strip():
            cut = line.find(" ", at + WIDEST, at + LONGEST_WORD)
            cut = min(n, at + LONGEST_WORD) if cut < 0 else cut
        out.append(line[at:cut].rstrip())
        at = cut
        while at < n and line[at] == " ":
            at += 1
    return out + [line[at:]] if at < n else out


def table_lines(e: Element, rules):
    """Rows of a table with cells in columns, as steps for ``rendered``; a cell of several lines makes its row as high. A cell that spans columns stands in the first."""
    before, rows, carried = [], [], {}
    loose = Lines()
    queue = deque(e.children)
    while queue:
        c = queue.popleft()
        if isinstance(c, str):
            loose.text(c)
        elif not visible(c, rules):
            continue
        elif c.tag in ("thead", "tbody", "tfoot"):
            queue.extendleft(reversed(c.children))
        elif c.tag == "tr":
            cells, column = [], 0
            for d in c.children:
                if isinstance(d, str) or d.tag not in ("td", "th"):
                    holder = Element("td", {})
                    holder.children = [d]
                    d = holder
                elif not visible(d, rules):
                    continue
                while carried.get(column, 0) > 0:
                    carried[column] -= 1
                    column += 1
                inner = Lines()
                yield render(d, rules, inner)
                body = [x for x in inner.done() if x]
                if not body and d.tag == "td" and not d.attributes and len(d.children) == 1 and isinstance(d.children[0], str):
                    continue
                span, down = (int(v) if (v := d.attributes.get(k, "1")).isascii() and v.isdigit() and 0 < int(v[:4]) < 1000 and len(v) < 4 else 1 for k in ("colspan", "rowspan"))
                cells.append((column, body))
                for k in range(span):
                    if down > 1:
                        carried[column + k] = down - 1
                column += span
            if cells:
                rows.append(cells)
        else:
            holder = Element("div", {})
            holder.children = [c]
            yield render(holder, rules, loose)
            loose.flush()
    before = loose.done()
    widths: dict[int, int] = {}
    for cells in rows:
        for place, (column, body) in enumerate(cells):
            last = place + 1 == len(cells)
            if not last and max(map(len, body), default=0) > WIDEST:
                body[:] = [piece for line in body for piece in wrapped(line)]
            widest = max(map(len, body), default=0)
            if not last or widest <= WIDEST:
                widths[column] = max(widths.get(column, 0), widest)
    out = []
    starts, at = {}, 0
    for column in sorted({c for cells in rows for c, _ in cells}):
        starts[column] = at
        at += widths.get(column, 0) + 2
    for cells in rows:
        for k in range(max((len(body) for _, body in cells), default=0)):
            line = ""
            for column, body in cells:
                if k < len(body):
                    line = (line + "  " if line and len(line) + 2 > starts[column] else line.ljust(starts[column])) + body[k]
            out.append(line.rstrip())
    return before + out


def extract(page: str | None) -> str:
    root, styles = parse((page or "").replace("\r\n", "\n").replace("\0", "�"))
    out = Lines()
    rendered(render(root, hiding_rules(styles), out))
    return "\n".join(out.done())


def extract_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, text, n_chars)`` of ``pages(page_id, html)``."""

    def run(batches):
        for batch in batches:
            texts = [extract(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "text", "n_chars"])

    return arrow_map(pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")), run, "page_id long, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
