"""The tree of a page of any notation, before anything is taken out of it.

HTML elements, wiki templates with their arguments, wiki and Markdown tables, lists, headings, LaTeX environments,
links, categories and attributes become nodes; each line of running text is a paragraph. A node is (depth, tag,
body), in document order. Tags name the element and its class; the body of a text node is its text without
inline markup, that of an ``@`` node the value of an attribute. Nodes deeper than ``MOST_DEPTH`` are kept at that depth.
"""

from __future__ import annotations

import re

from postloom.llm.markup import _BLOCKS, _HELD, _TAG, _Text, _squeeze, kinds, write_blocks

MOST_DEPTH = 40
Node = tuple[int, str, str]

_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
_BLOCK = _BLOCKS | _HEADINGS | frozenset("li td th".split())
_TEXTUAL = frozenset("p li td th dt dd caption title figcaption summary address center".split()) | _HEADINGS
_VOID = frozenset("br hr img input area link param source track wbr".split())
# an element that ends when another of its kind begins, up to the element that holds both
_ENDS = {
    "li": ("li", ("ul", "ol")), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tr": ("tr", ("table", "tbody", "thead", "tfoot")),
    "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "p": ("p", ("div", "td", "li", "section", "body")),
}
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_KEPT = ("id", "href", "src", "name", "alt")
_PIECE = re.compile(rf"{_TAG.pattern}|(?P<open>\{{\{{)|(?P<close>\}}\}})|(?P<link>\[\[)|(?P<end>\]\])|(?P<bar>\|)|(?P<line>\n)", re.I)
_SIGN = re.compile(r"[<{}\[\]|\n]")  # what a piece can start with
# signs without which a piece of text has no inline markup of a kind
_INLINE = tuple(
    (kind, re.compile(rx)) for kind, rx in (("html", "[<&]"), ("wiki", r"''|``|__|[\[{]|^\s*[*#:;|!]"), ("latex", r"\\|``"), ("markdown", r"[*_`\[<]|~~|^\s*[-+>|#\d]"))
)
_WIKI_HEADING = re.compile(r"(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*=+[ \t]*")
_MD_HEADING = re.compile(r"[ ]{0,3}(#{1,6})[ ]+([^\n]*?)[ ]*#*[ ]*")
_WIKI_ITEM = re.compile(r"[*#:;]+[ \t]*(?=[^\s*#:;])")
_MD_ITEM = re.compile(r"[ ]{0,3}(?:[-+*]|\d{1,3}[.)])[ ]+(?:\[[ xX]\][ ]+)?(?=\S)")
_ROW = re.compile(r"[ ]{0,3}\|(.*)\|[ \t]*")
_RULE = re.compile(r"[ ]{0,3}(?:\|?[ ]*:?-{3,}:?[ ]*\|[-|: ]*|-{3,}[ \t]*|={3,}[ \t]*|\*{3,}[ \t]*)")
_SECTION = re.compile(r"\\(chapter|(?:sub)*section|paragraph)\*?\{([^{}]*)\}")
_LEVELS = {"chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4}
_BEGIN, _ENDING = re.compile(r"\\begin\{(\w+)\*?\}(?:\[[^\]]*\])?(?:\{[^{}]*\})?"), re.compile(r"\\end\{(\w+)\*?\}")
_ITEM = re.compile(r"\\item(?:\[[^\]]*\])?[ \t]*")
_NAME_END = re.compile(r"[|}{\n]")
_KEY_END = re.compile(r"[=|{}\[\]\n]")
_NOTE_END = re.compile(r"</ref\s*>", re.I)
_APART = re.compile(r"(?:file|image|category|datei|fichier|archivo|kategorie)\s*:", re.I)


class _Builder:
    def __init__(self, text: str, found: list[str]):
        self.found = found
        self.held = _Text(text, self.found, aside=True)
        self.text = self.held.text
        self.nodes: list[list] = []  # [depth, tag, raw pieces or body]
        self.stack: list[tuple[str, str]] = []  # (name, how it was opened) of the open nodes
        self.at: int | None = None  # the open text node
        self.html, self.wiki, self.md, self.tex = (k in self.found for k in ("html", "wiki", "markdown", "latex"))

    # -- nodes

    def depth(self, more: int = 0) -> int:
        return min(len(self.stack) + more, MOST_DEPTH)

    def leaf(self, tag: str, body: str = "", more: int = 0) -> int:
        self.nodes.append([self.depth(more), tag, body])
        return len(self.nodes) - 1

    def below(self, tag: str, body: str) -> None:
        """A node below the open text node, or else one like any other."""
        depth = self.depth() if self.at is None else min(self.nodes[self.at][0] + 1, MOST_DEPTH)
        self.nodes.append([depth, tag, body])

    def push(self, name: str, how: str, tag: str | None = None, body: str = "") -> None:
        self.at = None
        self.leaf(tag or name, body)
        if len(self.stack) < 4 * MOST_DEPTH:
            self.stack.append((name, how))

    def pop(self, names: tuple[str, ...], how: str, stop: tuple[str, ...] = ()) -> bool:
        """Close the innermost open node of these names, with all within it."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names and self.stack[i][1] == how:
                del self.stack[i:]
                self.at = None
                return True
            if self.stack[i][0] in stop or self.stack[i][1] == "tpl" != how:
                return False
        return False

    def write(self, s: str) -> None:
        if self.at is None:
            if not s.strip():
                return
            if self.stack and self.stack[-1][0] in _TEXTUAL and self.own is not None:
                self.at = self.own
            else:
                self.at = self.leaf("p", [])
        self.nodes[self.at][2].append(s)

    @property
    def own(self) -> int | None:
        """The node of the innermost open element, if its text can still go there: nothing but inline nodes followed it."""
        level = len(self.stack) - 1
        for i in range(len(self.nodes) - 1, -1, -1):
            if self.nodes[i][0] <= min(level, MOST_DEPTH):
                return i if isinstance(self.nodes[i][2], list) else None
            if self.nodes[i][1][0] != "@" and self.nodes[i][1][:2] != "~ ":
                return None
        return None

    def implicit(self, name: str) -> None:
        """Open a list or table made of lines, unless it is open already."""
        if not self.stack or self.stack[-1] != (name, "lines"):
            self.lines_end()
            self.push(name, "lines")
        self.at = None

    def lines_end(self) -> None:
        while self.stack and self.stack[-1][1] == "lines":
            self.stack.pop()
            self.at = None

    # -- what a tag does

    def tag(self, m: re.Match) -> None:
        end, name, attrs = m.group(1), m.group(2).lower(), m.group(3)
        if end:
            if name in _BLOCK:
                self.lines_end()
                self.pop((name,), "html")
            return
        if name == "br":
            if self.at is not None and self.stack and self.stack[-1][0] in _TEXTUAL:
                self.write("\n")
            else:
                self.at = None
            return
        values = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(attrs)}
        kind = name + ("." + ".".join(sorted(values["class"].split())) if values.get("class") else "")
        if name in _BLOCK or name == "pre":
            self.lines_end()
            if name in _ENDS:
                names, stop = _ENDS[name]
                self.pop(tuple(names.split()), "html", stop)
            elif self.stack and self.stack[-1] == ("p", "html"):
                self.pop(("p",), "html")
            self.push(name, "html", kind, [] if name in _TEXTUAL else "")
            if (m.group(4) or name in _VOID) and self.stack and self.stack[-1] == (name, "html"):
                self.stack.pop()
        else:
            if self.at is None:
                self.write("\u200b")  # an inline element starts the text that it stands in
            self.below("~ " + kind, "")
        for a in _KEPT:
            if values.get(a):
                self.nodes.append([min(self.nodes[-1][0] + (self.nodes[-1][1][0] != "@"), MOST_DEPTH), "@" + a, " ".join(values[a].split())])

    # -- what a line begins with

    def line(self, at: int) -> int:
        """Read what marks the line that begins here; where its text goes on."""
        text = self.text
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        c = text[at : at + 1]
        if self.wiki and c == "=" and (m := _WIKI_HEADING.fullmatch(text, at, stop)):
            return self.heading(len(m.group(1)), m.group(2), stop)
        if self.md and "#" in text[at : at + 4] and (m := _MD_HEADING.fullmatch(text, at, stop)):
            return self.heading(len(m.group(1)), m.group(2), stop)
        if self.wiki and text.startswith("{|", at):
            self.lines_end()
            self.push("table", "wiki")
            if text[at + 2 : stop].strip():
                self.leaf("@attributes", text[at + 2 : stop].strip())
            return stop
        if self.wiki and c in "|!" and ("table", "wiki") in self.stack:
            return self.table_line(at, stop)
        if self.md and (m := _ROW.fullmatch(text, at, stop)) or self.md and _RULE.fullmatch(text, at, stop):
            if not m or _RULE.fullmatch(text, at, stop):
                self.at = None
                self.leaf("hr")
                return stop
            self.implicit("table")
            self.leaf("tr")
            for cell in m.group(1).split("|"):
                self.leaf("td", self.inline(cell), 1)
            return stop
        m = (_WIKI_ITEM.match(text, at, stop) if self.wiki and c in "*#:;" else None) or (_MD_ITEM.match(text, at, stop) if self.md else None)
        if m:
            self.implicit("ul")
            self.at = self.leaf("li", [])
            return m.end()
        if self.tex and "\\" in text[at:stop]:
            return self.tex_line(at, stop)
        if self.stack and self.stack[-1][1] == "lines":
            self.lines_end()
        return at

    def heading(self, level: int, title: str, stop: int) -> int:
        self.lines_end()
        self.at = None
        self.leaf(f"h{min(level, 6)}", self.inline(title))
        return stop

    def table_line(self, at: int, stop: int) -> int:
        while self.stack and self.stack[-1] != ("table", "wiki") and self.stack[-1] != ("tr", "wiki"):
            self.stack.pop()
        self.at = None
        row = self.text[at:stop]
        if row.startswith("|}"):
            self.pop(("table",), "wiki")
            return at + 2
        if row.startswith("|-"):
            if self.stack and self.stack[-1] == ("tr", "wiki"):
                self.stack.pop()
            self.push("tr", "wiki")
            return stop
        if row.startswith("|+"):
            self.leaf("caption", self.inline(row[2:]))
            return stop
        if self.stack and self.stack[-1] == ("table", "wiki"):
            self.push("tr", "wiki")
        for cell in re.split(r"\|\||!!", row[1:]):
            self.leaf("th" if row[0] == "!" else "td", self.inline(cell.rpartition("|")[2] if "[[" not in cell else cell))
        return stop

    def tex_line(self, at: int, stop: int) -> int:
        text = self.text
        if m := _SECTION.match(text, at, stop):
            self.heading(_LEVELS.get(m.group(1), 5), m.group(2), stop)
            return m.end()
        if m := _BEGIN.match(text, at, stop):
            self.push(m.group(1), "tex", "env." + m.group(1))
            return m.end()
        if m := _ENDING.match(text, at, stop):
            self.pop((m.group(1),), "tex")
            return m.end()
        if m := _ITEM.match(text, at, stop):
            self.at = self.leaf("li", [])
            return m.end()
        if self.stack and self.stack[-1][0].startswith("tabular"):
            self.at = None
            self.leaf("tr")
            for cell in re.sub(r"\\\\\s*|\\hline\s*", "", text[at:stop]).split("&"):
                if cell.strip():
                    self.leaf("td", self.inline(cell), 1)
            return stop
        return at

    # -- text without inline markup

    def inline(self, s: str) -> str:
        kinds_ = [kind for kind, sign in _INLINE if kind in self.found and sign.search(s)]
        if kinds_:
            t = _Text.__new__(_Text)
            t.text, t.held = s, self.held.held
            for kind in kinds_:
                getattr(t, kind)()
            s = t.text
        return _squeeze(self.held.back(s.replace("\u200b", "")))

    # -- the whole

    def build(self) -> list[Node]:
        text = self.text
        partner: dict[int, int] = {}
        if self.wiki:  # which braces and brackets go together
            open_: dict[str, list[int]] = {"open": [], "link": []}
            for m in re.finditer(r"(?P<open>\{\{)|(?P<close>\}\})|(?P<link>\[\[)|(?P<end>\]\])", text):
                if m.lastgroup in open_:
                    open_[m.lastgroup].append(m.start())
                elif (waiting := open_["open" if m.lastgroup == "close" else "link"]):
                    partner[waiting.pop()] = m.start()
        pos, begins, templates, notes = 0, True, 0, True
        while pos < len(text):
            if begins:
                begins = False
                # within elements that hold text and within templates, lines mean nothing
                if not (self.stack and (self.stack[-1][1] == "tpl" or (self.stack[-1][0] in _TEXTUAL and self.stack[-1][1] == "html"))):
                    pos = self.line(pos)
            m, at = None, pos
            while m is None and (c := _SIGN.search(text, at)) is not None:
                m, at = _PIECE.match(text, c.start()), c.end()
            if m is None:
                self.piece(text[pos:])
                break
            if m.start() > pos:
                self.piece(text[pos : m.start()])
            pos, what = m.end(), m.lastgroup
            if what == "line":
                begins = True
                inside = self.stack and self.stack[-1][1] in ("tpl", "html") and self.stack[-1][0] in (*_TEXTUAL, "arg", "tpl")
                if inside:
                    self.write(" ")
                else:
                    self.at = None
            elif what == "open" and m.start() in partner:
                stop = _NAME_END.search(text, pos)
                name = " ".join(text[pos : stop.start() if stop else len(text)].split())
                before = self.at
                self.below(f"tpl:{name.lower()}", name)
                self.stack.append((str(before) if before is not None else "", "tpl"))
                templates += 1
                self.at = None
                pos = stop.start() if stop else len(text)
            elif what == "close" and templates:
                templates -= 1
                while self.stack[-1][1] != "tpl" or self.stack[-1][0] == "arg":
                    self.stack.pop()
                before = self.stack.pop()[0]
                self.at = int(before) if before else None  # the text that the template stood in goes on
            elif what == "bar" and self.stack and self.stack[-1][1] == "tpl":
                if self.stack[-1][0] == "arg":
                    self.stack.pop()
                stop = _KEY_END.search(text, pos)
                key = text[pos : stop.start()].strip() if stop and stop.group(0) == "=" else ""
                self.at = self.leaf("arg:" + key.lower() if key else "arg", [])
                self.stack.append(("arg", "tpl"))
                pos = stop.end() if key else pos
            elif what == "link" and m.start() in partner:
                stop = partner[m.start()]
                target, bar, label = text[pos:stop].partition("|")
                if _APART.match(target):
                    kind, _, value = target.partition(":")
                    self.below(f"link:{kind.strip().lower()}", value.strip())
                    pos = stop + 2
                elif "[[" in text[pos:stop]:
                    self.piece("")
                else:
                    self.piece(label if bar else target)
                    self.below("@link", target.strip())
                    pos = stop + 2
            elif m.group(2) and m.group(2).lower() == "ref" and not m.group(1):
                stop = None if m.group(4) or not notes else _NOTE_END.search(text, pos)
                notes = notes and (stop is not None or bool(m.group(4)))  # an end that is missing once is missing from here on
                self.below("~ ref", "" if stop is None else self.inline(text[pos : stop.start()]))
                pos = stop.end() if stop else pos
            elif m.group(2):
                self.tag(m)
            elif what not in ("open", "close", "link", "end"):
                self.piece(m.group(0))
        return self.done()

    def piece(self, s: str) -> None:
        """A piece of text, in which held code and formulas may stand."""
        at = 0
        for m in _HELD.finditer(s):
            kind, body = self.held.held[int(m.group(1))]
            if kind == "code" or (kind == "formula" and s.strip() == m.group(0) and self.at is None):
                self.write(s[at : m.start()]) if s[at : m.start()].strip() else None
                self.at = None
                self.leaf("pre" if kind == "code" else "formula", self.held.back(body))
                at = m.end()
        self.write(s[at:])

    def done(self) -> list[Node]:
        out: list[Node] = []
        for depth, tag, body in self.nodes:
            text = self.inline("".join(body)) if isinstance(body, list) else body
            if tag == "p" and not text:
                continue
            out.append((depth, tag, text))
        # a node that was left out may have had nodes below it
        level, fixed = -1, []
        for depth, tag, text in out:
            level = min(depth, level + 1)
            fixed.append((level, tag, text))
        return fixed


def parse(text: str | None) -> list[Node]:
    """The nodes of a page in document order; none for a null or blank text."""
    if not text or not text.strip():
        return []
    found = kinds(text)
    if not found:
        return [(0, "p", s) for line in text.split("\n") if (s := _squeeze(line))]
    return _Builder(text, found).build()


def written(nodes: list[tuple[str, str]]) -> str:
    """The text of some nodes, as clean text: rows with their cells between bars, arguments with their names."""
    parts: list[tuple[str, str]] = []
    row = False
    for tag, body in nodes:
        name = tag.split(".")[0]
        if name == "tr":
            row = False
        if not body or tag[0] in "@~" or tag.startswith(("tpl:", "link:")):
            continue
        if name in ("td", "th"):
            parts[-1:] = [("tr", f"{parts[-1][1]} | {body}")] if row else [*parts[-1:], ("tr", body)]
            row = True
            continue
        row = False
        if tag.startswith("arg"):
            parts.append(("p", f"{tag[4:]}: {body}" if tag[3:4] == ":" else body))
        else:
            parts.append((name if name in (*_HEADINGS, "li", "pre", "formula") else "p", body))
    return write_blocks(parts)
