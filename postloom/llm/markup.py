"""Markup residue: which kinds of markup a text holds, its block tree, and clean text that keeps the structure.

``blocks`` reads HTML, Markdown, wiki and LaTeX constructs, also mixed in one text, into one flat list of
typed blocks; ``clean`` writes them out: headings as ``# ``, list items as ``- `` or ``1. ``, code between
fences, formulas between dollar signs, table cells between bars. Signs in plain sentences stay as they are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.session import spread

# The element names of HTML and the extension tags of wiki text.
_TAGS = (
    "a abbr acronym address applet area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col "
    "colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 "
    "h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noframes noscript "
    "object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong "
    "style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr "
    "gallery includeonly math noinclude nowiki onlyinclude poem ref references syntaxhighlight timeline"
)
_ATTRS = r"""(?:\s(?:"[^"]*"|'[^']*'|[^'"<>])*)?"""
_TAG = re.compile(rf"<(/?)({'|'.join(sorted(_TAGS.split(), key=len, reverse=True))})({_ATTRS})(/?)>", re.I)
_REF = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_PATH = re.compile(r"(?<![A-Za-z])[A-Za-z]:(?:\\[^\s\\,;]+)+")  # a drive path is no command
_LATEX_QUOTES = re.compile(r"``([^`'\n]+)''")
_LATEX = re.compile(
    r"""\\[a-zA-Z]+\*?          # a command
      | \\[()\[\]]              # formula brackets
      | \\['"`^~=.][a-zA-Z{]    # an accent
      | (?<=[\w)}.])\\[,;:!%&$\#_{}]  # spaces and escaped signs after a character
      | \\[%&$\#_{}]            # escaped signs
      | \$\$[^$]+\$\$
      | (?<![\w$\\])\$(?=[^\s$])(?=[^$\n]*?[\\^_{}=])[^$\n]*(?<=[^\s$\\])\$(?![\w$])
      | (?<![\w$\\])\$[A-Za-z]\$(?![\w$])
    """,
    re.X,
)

# What is sought in wiki and Markdown text: some sign without which there is no match, and the pattern.
# Every pattern reads a text in a time that grows with its length only.
_WIKI = tuple(
    (sign, re.compile(rx, re.M))
    for sign, rx in (
        ("[[", r"\[\[[^\[\]\n]+\]\]"),
        ("{{", r"\{\{(?=[^{}\n|]*?[\w#:])[^{}]*(?:\}\}|\{\{)"),  # a template, or one with another inside
        ("{{{", r"\{\{\{[\w|]+\}\}\}"),
        ("{{", r"(?<![\\\w}{])\{\{[A-Za-z#]"),  # the start of one, cut off
        ("==", r"^={2,6}[ \t]*[^=\n][^\n]*?={2,6}[ \t]*$"),
        ("{|", r"^\{\|"),
        ("|}", r"^\|\}[ \t]*$"),
        ("__", r"__[A-Z]{3,}__"),
        ("://", r"\[(?:https?|ftp):\/\/[^\s\[\]]+[ ][^\[\]\n]+\](?!\()"),
        ("~~~~", r"(?<![~])~{4,5}(?![~\w])(?<=\S[ ]~{4})(?=[^\n]*\S)"),
        ("\n:", r"^;[^\n]+\n:"),
        ("[[", r"#REDIRECT[ ]?\[\["),
    )
)
_WIKI_NEST = re.compile(r"\[\[(?:[^\[\]\n]|\[\[[^\[\]\n]*\]\])+\]\]")
_QUOTES = re.compile(r"(?<!')'{2,5}(?!')")
_MD = tuple(
    (sign, re.compile(rx, re.M))
    for sign, rx in (
        ("# ", r"^[ ]{0,3}#{1,6}[ ]+\S[^\n]*$"),
        ("`", r"(?<!`)(`{1,3})(?=[^`\s])[^`\n]*?[^`\s]??\1(?!`)"),
        ("**", r"(?<![*\w])\*{2,3}(?=[^\s*])[^*\n]*[^\s*]\*{2,3}(?![*\w])"),
        ("**", r"(?<![*\w])\*{2,3}[^\s*]\*{2,3}(?![*\w])"),
        ("*", r"(?<![*\w])\*(?=[^\s*])[^*\n]*[^\s*\d]\*(?![*\w])"),
        ("__", r"(?<![\w_/.])_{2}(?=[a-z])[^_\n]+_{2}(?![\w_/.])"),
        ("_", r"(?<![\w_/.])_(?=[^\s_])[^_\n]*[^\s_]_(?![\w_/.])"),
        ("~~", r"(?<!~)~~(?=[^\s~])[^~\n]+~~(?!~)"),
        ("](", r"!?\[[^\[\]\n]*\]\([^()\s]+(?:[ ]\"[^\"\n]*\")?\)"),
        ("][", r"(?<!\[)\[[^\[\]\n]+\]\[[^\[\]\n]*\](?!\])"),
        ("]:", r"^[ ]{0,3}\[[^\[\]\n]+\]:[ ]+\S+"),
        (">", r"^[ ]{0,3}>[ ]\S"),
        (" ", r"^[ ]{0,3}[-+][ ]+(?:\[[ xX]\][ ]+)?\S[^\n]*(?:\n[ ]{0,3}[-+][ ]|\Z|\n[ \t]*\n|\n$)"),
        (". ", r"^[ ]{0,3}\d{1,3}\.[ ]+\S[^\n]*\n[ ]{0,3}\d{1,3}\.[ ]"),
        (") ", r"^[ ]{0,3}\d{1,3}\)[ ]+\S[^\n]*\n[ ]{0,3}\d{1,3}\)[ ]"),
        ("---", r"^[ ]{0,3}\|?[ ]*:?-{3,}:?[ ]*\|[-|: ]*$"),
        ("<", r"<(?:https?|mailto):[^\s<>]+>"),
    )
)
# lists and rules that Markdown and wiki text share; they count as Markdown unless the text holds wiki constructs
_SHARED = tuple(
    (sign, re.compile(rx, re.M))
    for sign, rx in (
        ("* ", r"^[ ]{0,3}\*[ ]+\S[^\n]*\n[ ]{0,3}\*[ ]+\S"),
        ("---", r"(?:\A|\n[ \t]*\n)[ ]{0,3}-{3,}[ \t]*(?:\n[ \t]*\n|\n?\Z)"),
        ("***", r"(?:\A|\n[ \t]*\n)[ ]{0,3}\*{3,}[ \t]*(?:\n[ \t]*\n|\n?\Z)"),
        ("* *", r"(?:\A|\n[ \t]*\n)[ ]{0,3}\*(?:[ ]\*){2,}[ \t]*(?:\n[ \t]*\n|\n?\Z)"),
    )
)
_UNDERLINE = re.compile(r"\n[ ]{0,3}(?:={3,}|-{3,})[ \t]*$", re.M)
_FENCE = re.compile(r"^[ ]{0,3}(```+|~~~+)[\w+-]*[ \t]*\n.*?(?:^[ ]{0,3}\1[ \t]*$|\Z)", re.S | re.M)
_DISPLAY = re.compile(r"\$\$[^$]+\$\$")

# Constructs from a start to an end: the start, and the end of each; those in _OPEN last to the end of the text if they have none.
_CLOSERS: dict[str, re.Pattern] = {}
_COMMENT = re.compile(r"<!--|<!DOCTYPE|<\?xml|<!\[CDATA\[", re.I)
_COMMENT_ENDS = {"<!--": re.compile("-->"), "<!DOCTYPE": re.compile(">"), "<?XML": re.compile(">"), "<![CDATA[": re.compile(r"\]\]>")}
_OPEN = {"<!--"}
_RAW = re.compile(r"<(script|style|pre|code|math|nowiki|gallery|svg|syntaxhighlight)\b[^<>]*>", re.I)
_ENV = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\*?\}")
_FORMULA = re.compile(r"\\\[|\\\(|\\begin\{(?:equation|align|gather|math|displaymath)\*?\}")
_FORMULA_ENDS = {"\\[": re.compile(r"\\\]"), "\\(": re.compile(r"\\\)")}
_FORMULA_END = re.compile(r"\\end\{\w+\*?\}")
_TABLE = re.compile(r"^\{\|", re.M)
_TABLE_END = re.compile(r"^\|\}", re.M)


def _tag_end(m: re.Match) -> tuple[re.Pattern, bool]:
    name = m.group(1).lower()
    if name not in _CLOSERS:
        _CLOSERS[name] = re.compile(rf"</{name}\s*>", re.I)
    return _CLOSERS[name], False


def _env_end(m: re.Match) -> tuple[re.Pattern, bool]:
    name = "\\" + m.group(1)
    if name not in _CLOSERS:
        _CLOSERS[name] = re.compile(rf"\\end\{{{m.group(1)}\*?\}}")
    return _CLOSERS[name], True


def _comment_end(m: re.Match) -> tuple[re.Pattern, bool]:
    return _COMMENT_ENDS[m.group(0).upper()], m.group(0) in _OPEN


def _formula_end(m: re.Match) -> tuple[re.Pattern, bool]:
    return _FORMULA_ENDS.get(m.group(0), _FORMULA_END), False


def between(text: str, start: re.Pattern, end: Callable[[re.Match], tuple[re.Pattern, bool]], by: Callable[[re.Match, str], str | None]) -> str:
    """The text with each construct from a match of ``start`` to the end it asks for replaced by ``by(start, inside)``.

    Where there is no end, the construct lasts to the end of the text if ``end`` says so, or else is none.
    An end that was sought in vain is not sought again, so the time grows with the length of the text only.
    """
    out, at, pos, missing = [], 0, 0, set()
    while (m := start.search(text, pos)) is not None:
        rx, lasts = end(m)
        closing = None if rx in missing else rx.search(text, m.end())
        if closing is None and not lasts:
            missing.add(rx)
            pos = m.end()
            continue
        stop, after = (len(text), len(text)) if closing is None else closing.span()
        got = by(m, text[m.end() : stop])
        if got is None:
            pos = after
            continue
        out += [text[at : m.start()], got]
        at = pos = after
    return "".join([*out, text[at:]]) if out else text


def _blank(_: re.Match, __: str) -> str:
    return "\ufffc"


def _emphasis(text: str) -> bool:
    """Whether some line holds wiki emphasis: quotes before a word and, later, quotes after one."""
    first = None  # end of the first run of quotes in this line that can start one
    line = -1
    for m in _QUOTES.finditer(text):
        a, b = m.span()
        if first is not None and text.find("\n", line, a) >= 0:
            first = None
        if first is not None and a > first and not text[a - 1].isspace():
            return True
        if first is None and b < len(text) and not text[b].isspace():
            first = b
        line = b
    return False


def _underlined(text: str) -> bool:
    """Whether some line that is not blank is underlined."""
    for m in _UNDERLINE.finditer(text):
        if text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip():
            return True
    return False


def _any(patterns: tuple[tuple[str, re.Pattern], ...], text: str) -> bool:
    return any(sign in text and rx.search(text) is not None for sign, rx in patterns)


def kinds(text: str | None) -> list[str]:
    """The kinds of markup in a text, in alphabetical order; none for a null or empty text.

    Tags, comments and character references are html wherever they stand, formulas and commands are latex
    wherever they stand. What stands in code, formulas or scripts is not read as Markdown or wiki text.
    Lists of asterisks and rules of dashes, which both have, are Markdown unless other constructs are wiki.
    """
    if not text:
        return []
    found = []
    angle = "<" in text
    tags = angle and _TAG.search(text) is not None
    rest = between(text, _COMMENT, _comment_end, _blank) if angle else text
    if tags or rest is not text or ("&" in text and any(m[0][1] == "#" or m[0][1:] in html5 for m in _REF.finditer(text))):
        found.append("html")
    # code is no place to look for the other kinds, but a fence itself is Markdown
    fence = ("```" in rest or "~~~" in rest) and _FENCE.search(rest) is not None
    if fence:
        rest = _FENCE.sub("\ufffc", rest)
    slash = "\\" in rest
    before = rest
    if slash:
        rest = between(rest, _ENV, _env_end, _blank)
    if rest is not before or ((slash or "$" in rest) and _LATEX.search(_PATH.sub(" ", rest) if slash else rest)):
        found.append("latex")
    if angle:
        rest = between(rest, _RAW, _tag_end, _blank)
    if "$$" in rest:
        rest = _DISPLAY.sub("\ufffc", rest)
    if slash:
        rest = between(rest, _FORMULA, _formula_end, _blank)
    if tags:
        rest = _TAG.sub("\ufffc", rest)
    if "``" in rest:
        rest = _LATEX_QUOTES.sub(r"\1", rest)
    wiki = _any(_WIKI, rest) or ("''" in rest and _emphasis(rest)) or ("[[" in rest and _WIKI_NEST.search(rest) is not None)
    own = between(rest, _TABLE, lambda _: (_TABLE_END, False), _blank) if "{|" in rest else rest
    own = _WIKI_NEST.sub("\ufffc", own) if "[[" in own else own
    if fence or _any(_MD, own) or (("===" in own or "---" in own) and _underlined(own)) or (not wiki and _any(_SHARED, own)):
        found.append("markdown")
    if wiki:
        found.append("wiki")
    return found


def markup_kinds(df: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, kind): one row per kind of markup that the text of a row holds; repeated rows come out once.

    Null keys and null, empty or plain texts give no row. Whole texts are read, whatever their length.
    """

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(kinds)

    rows = df.select(df[key].alias("key"), df[text].alias("text")).filter("key is not null and text is not null and text <> ''")
    rows = spread(rows).select("key", F.explode(found("text")).alias("kind")).distinct()
    return rows.select(F.col("key").alias(key), "kind")


# ---- clean text ----------------------------------------------------------------------------------

_O, _C = "\ue000", "\ue001"  # around the number of a protected piece
_HEAD, _ITEM, _CELL = "\ue010", "\ue011", "\ue012"
_HELD = re.compile(f"{_O}(\\d+){_C}")
_SILENT = re.compile(r"<(script|style|svg|template|noscript)\b[^<>]*>", re.I)
_HOLDING = {tag: re.compile(rf"<({tag})\b[^<>]*>", re.I) for tag in ("pre", "syntaxhighlight", "nowiki", "math")}
_ACCENTS = {"'": "\u0301", "`": "\u0300", '"': "\u0308", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307"}


def _unquoted(line: str) -> str:
    """A line without wiki emphasis: each run of quotes before a word goes with the next one after a word."""
    out, at, opened = [], 0, None
    for m in _QUOTES.finditer(line):
        a, b = m.span()
        if opened is not None and a > opened[1] and not line[a - 1].isspace():
            out += [line[at : opened[0]], line[opened[1] : a]]
            at, opened = b, None
        elif opened is None and b < len(line) and not line[b].isspace():
            opened = (a, b)
    return "".join([*out, line[at:]])


def _setext(text: str) -> str:
    """Underlined lines as headings."""
    lines = text.split("\n")
    out: list[str] = []
    for line in lines:
        rule = line.strip(" \t")
        if (
            out and len(rule) > 2 and rule in (len(rule) * "=", len(rule) * "-") and len(line) - len(line.lstrip(" ")) < 4
            and out[-1][:1] not in (_HEAD, _ITEM, _CELL) and any(c.isalnum() for c in out[-1])
        ):
            out[-1] = f"{_HEAD}{1 if rule[0] == '=' else 2}{out[-1]}"
        else:
            out.append(line)
    return "\n".join(out)


class _Text:
    """A text on its way to blocks: code and formulas are held aside until the end."""

    def __init__(self, text: str, found: list[str], aside: bool = False):
        """With ``aside``, code and formulas are held aside and all else is left as it is."""
        self.text, self.held = re.sub("[\ue000-\ue012]", "", text), []
        if "html" in found:
            self.text = between(self.text, _COMMENT, _comment_end, lambda m, x: " ")
            self.text = between(self.text, _SILENT, _tag_end, lambda m, x: " ")
        if "markdown" in found:
            self.hold(re.compile(r"^[ ]{0,3}(?:```+|~~~+)[\w+-]*[ \t]*\n(.*?)(?:^[ ]{0,3}(?:```+|~~~+)[ \t]*$|\Z)", re.S | re.M), "code")  # one without an end lasts to the end
        if "html" in found:
            for tag in ("pre", "syntaxhighlight", "nowiki", "math"):
                kind = {"nowiki": "raw", "math": "formula"}.get(tag, "code")
                self.text = between(self.text, _HOLDING[tag], _tag_end, lambda m, x, kind=kind: self.keep(x, kind, m.group(1).lower() == "pre"))
        if "latex" in found:
            self.text = between(self.text, _ENV, _env_end, lambda m, x: self.keep(x, "code"))
            self.hold(re.compile(r"\$\$([^$]+)\$\$", re.S), "formula")
            self.text = between(self.text, _FORMULA, _formula_end, lambda m, x: self.keep(x, "formula"))
            self.hold(re.compile(r"(?<![\w$\\])\$(?=[^\s$])([^$\n]*)(?<=[^\s$\\])\$(?![\w$])"), "formula", only=re.compile(r"[\\^_{}=]|^[A-Za-z]$"))
        for kind in () if aside else ("html", "wiki", "latex", "markdown"):
            if kind in found:
                getattr(self, kind)()

    def sub(self, rx: re.Pattern | str, by, flags: int = 0) -> None:
        self.text = re.sub(rx, by, self.text, flags=flags) if isinstance(rx, str) else rx.sub(by, self.text)

    def keep(self, body: str, kind: str, tags: bool = False) -> str:
        """Hold a piece aside; what stands for it in the text."""
        if tags:
            body = html.unescape(re.sub(r"<[^<>]*>", "", body))
        self.held.append((kind, body.strip("\n") if kind == "code" else " ".join(body.split())))
        piece = f"{_O}{len(self.held) - 1}{_C}"
        return f"\n{piece}\n" if kind == "code" else piece

    def hold(self, rx: re.Pattern, kind: str, only: re.Pattern | None = None) -> None:
        self.text = rx.sub(lambda m: m.group(0) if only and not only.search(m.group(1)) else self.keep(m.group(1), kind), self.text)

    def back(self, s: str) -> str:
        """A piece of text with what is held aside in its place; a held piece may hold others."""

        def put(m: re.Match) -> str:
            kind, body = self.held[int(m.group(1))]
            body = self.back(body)
            return f"${body}$" if kind == "formula" else body

        return _HELD.sub(put, s)

    def html(self) -> None:
        def tag(m: re.Match) -> str:
            name, end = m.group(2).lower(), m.group(1)
            if re.fullmatch(r"h[1-6]", name):
                return "\n" if end else f"\n{_HEAD}{name[1]}"
            if name in ("li", "dt", "dd"):
                return "\n" if end else f"\n{_ITEM}"
            if name in ("td", "th"):
                return "" if end else _CELL
            if name in _BLOCKS:
                return "\n"
            return ""

        self.sub(re.compile(r"<ref\b[^<>]*/>", re.I), "")
        self.text = between(self.text, re.compile(r"<(ref)\b[^<>]*>", re.I), _tag_end, lambda m, x: "")
        self.text = _TAG.sub(tag, self.text)
        self.text = _REF.sub(lambda m: html.unescape(m.group(0)), self.text)

    def wiki(self) -> None:
        self.sub(re.compile(r"^\{\|[^\n]*$|^\|\}[^\n]*$|^\|-[^\n]*$|^\|\+", re.M), "")
        while True:  # from the innermost template outwards
            self.text, n = re.subn(r"\{\{[^{}]*\}\}", "", self.text)
            if not n:
                break
        self.sub(r"(?<![\\\w}{])\{\{(?=[A-Za-z#])", "")
        self.sub(re.compile(r"^[!|](?![-}])[^\n]*$", re.M), lambda m: _CELL + re.sub(r"\s*(?:\|\||!!)\s*", _CELL, m.group(0)[1:].strip()))
        while True:
            self.text, n = re.subn(r"\[\[(?:File|Image|Category|Datei|Fichier|Archivo)\s*:[^\[\]]*\]\]", "", self.text, flags=re.I)
            self.text, k = re.subn(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]+)\|?\]\]", r"\1", self.text)
            if not n + k:
                break
        self.sub(r"\[(?:https?|ftp)://[^\s\[\]]+ ([^\[\]\n]+)\](?!\()", r"\1")
        self.sub(re.compile(r"^(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*=+[ \t]*$", re.M), lambda m: f"{_HEAD}{len(m.group(1))}{m.group(2)}")
        self.text = _LATEX_QUOTES.sub("\u201c\\1\u201d", self.text)
        if "''" in self.text:
            self.text = "\n".join(_unquoted(line) if "''" in line else line for line in self.text.split("\n"))
        self.sub(r"__[A-Z]{3,}__", "")
        self.sub(re.compile(r"^[*#:;]+[ \t]*(?=[^\s*#:;])", re.M), _ITEM)

    def latex(self) -> None:
        self.sub(r"\\(chapter|(?:sub)*section|paragraph)\*?\{([^{}]*)\}", lambda m: f"\n{_HEAD}{ {'chapter': 1, 'section': 2, 'subsection': 3, 'subsubsection': 4}.get(m.group(1), 5)}{m.group(2)}\n")
        self.sub(r"\\(?:documentclass|usepackage)(?:\[[^\]]*\])?\{[^{}]*\}", "")
        self.sub(re.compile(r"\\begin\{tabular\}\{[^{}]*\}(.*?)\\end\{tabular\}", re.S), lambda m: "\n" + re.sub(r"^", _CELL, re.sub(r"\s*&\s*", _CELL, re.sub(r"\\\\\s*|\\hline\s*", "\n", m.group(1)).strip()), flags=re.M) + "\n")
        self.sub(r"\\(?:begin|end)\{\w+\*?\}(?:\[[^\]]*\])?", "\n")
        self.sub(r"\\item(?:\[[^\]]*\])?[ \t]*", f"\n{_ITEM}")
        self.sub(r"~?\\(?:cite|ref|label|footnote|pageref|eqref|index)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "")
        self.sub(r"\\(['\"`^~=.])\{?([A-Za-z])\}?", lambda m: m.group(2) + _ACCENTS[m.group(1)])
        while True:
            self.text, n = re.subn(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", self.text)
            self.text, k = re.subn(r"\{\\[a-zA-Z]+\s+([^{}]*)\}", r"\1", self.text)
            if not n + k:
                break
        self.text = _LATEX_QUOTES.sub("\u201c\\1\u201d", self.text)
        paths: list[str] = []
        self.text = _PATH.sub(lambda m: paths.append(m.group(0)) or f"\ue002{len(paths) - 1}\ue003", self.text)
        self.sub(r"\\([%&$#_{}])", r"\1")
        self.sub(r"\\[,;: ]", " ")
        self.sub(r"\\[a-zA-Z]+\*?|\\\\", "")
        self.sub(r"\ue002(\d+)\ue003", lambda m: paths[int(m.group(1))])

    def markdown(self) -> None:
        self.sub(re.compile(r"^[ ]{0,3}\[[^\[\]\n]+\]:[ ]+\S+[^\n]*$", re.M), "")
        self.sub(re.compile(r"^[ ]{0,3}(#{1,6})[ ]+([^\n]*?)[ ]*#*[ ]*$", re.M), lambda m: f"{_HEAD}{len(m.group(1))}{m.group(2)}")
        self.text = _setext(self.text)
        self.sub(re.compile(r"^[ ]{0,3}\|?[ ]*:?-{3,}:?[ ]*\|[-|: ]*$|^[ ]{0,3}(?:-{3,}|\*{3,}|_{3,})[ \t]*$", re.M), "")
        self.sub(re.compile(r"^[ ]{0,3}\|(.*)\|[ \t]*$", re.M), lambda m: _CELL + _CELL.join(c.strip() for c in m.group(1).split("|")))
        self.sub(re.compile(r"^[ ]{0,3}>[ ]?", re.M), "")
        self.sub(re.compile(r"^[ ]{0,3}(?:[-+*]|\d{1,3}[.)])[ ]+(?:\[[ xX]\][ ]+)?(?=\S)", re.M), _ITEM)
        self.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]+(?: \"[^\"\n]*\")?\)", r"\1")
        self.sub(r"(?<!\[)\[([^\[\]\n]+)\]\[[^\[\]\n]*\](?!\])", r"\1")
        self.sub(r"<((?:https?|mailto):[^\s<>]+)>", r"\1")
        self.sub(r"(?<!`)(`{1,3})(?=[^`\s])([^`\n]*?[^`\s]??)\1(?!`)", r"\2")
        self.sub(r"(?<!~)~~(?=[^\s~])([^~\n]+)~~(?!~)", r"\1")
        for _ in range(2):
            self.sub(r"(?<![*\w])\*{1,3}(?=[^\s*])([^*\n]*[^\s*\d]|[^*\n]*\d(?=\*\*))\*{1,3}(?![*\w])", r"\1")
        self.sub(r"(?<![\w_/.])_{1,2}(?=[^\s_])([^_\n]*[^\s_])_{1,2}(?![\w_/.])", r"\1")


_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form gallery head header hr html "
    "main nav ol p poem section summary table tbody tfoot thead title tr ul".split()
)


def blocks(text: str | None, found: list[str] | None = None) -> list[tuple[str, str]]:
    """(tag, text) of the blocks of a text, in order: h1..h6, li, tr (cells set apart by bars), pre, formula, p.

    A plain text gives one p for each of its lines that is not blank; a null or empty text gives none.
    """
    if not text:
        return []
    t = _Text(text, kinds(text) if found is None else found)
    out: list[tuple[str, str]] = []

    back = t.back

    for line in t.text.split("\n"):
        line = line.strip().lstrip(":") if _HELD.search(line) else line.strip()
        if not line:
            continue
        alone = _HELD.fullmatch(line)
        if alone and t.held[int(alone.group(1))][0] != "raw":
            kind, body = t.held[int(alone.group(1))]
            out.append(("pre" if kind == "code" else "formula", back(body)))
        elif line[0] == _HEAD and line[1:2].isdigit():
            out.append((f"h{min(int(line[1]), 6)}", _squeeze(back(line[2:]))))
        elif line[0] == _ITEM:
            out.append(("li", _squeeze(back(line[1:]))))
        elif line[0] == _CELL:
            out.append(("tr", " | ".join(_squeeze(back(c)) for c in line[1:].split(_CELL))))
        else:
            out.append(("p", _squeeze(back(line))))
    return [(tag, s) for tag, s in out if s.strip()]


_MARKS = re.compile("[\ue000-\ue012]")


def _squeeze(s: str) -> str:
    if not s.isascii():
        s = _MARKS.sub(" ", s)
    return (re.sub(r"[ \t]+", " ", s) if "  " in s or "\t" in s else s).strip()


def write_blocks(parts: list[tuple[str, str]]) -> str:
    """The text of some blocks, with a blank line wherever the kind of block changes or a paragraph ends."""
    out: list[str] = []
    for k, (tag, s) in enumerate(parts):
        if tag[0] == "h" and tag[1:].isdigit():
            s = "#" * int(tag[1]) + " " + s
        elif tag == "li":
            s = "- " + s
        elif tag == "tr":
            s = "| " + s + " |"
        elif tag == "pre":
            s = "```\n" + s + "\n```"
        elif tag == "formula":
            s = "$$" + s + "$$"
        if k:
            out.append("\n" if tag == parts[k - 1][0] and tag in ("li", "tr") else "\n\n")
        out.append(s)
    return "".join(out)


def clean(text: str | None) -> str | None:
    """Text without markup but with its structure. Null stays null; a text without markup stays as it is."""
    found = kinds(text)
    return text if not found else write_blocks(blocks(text, found))


def clean_texts(df: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, text): the clean text of every row; null keys and repeated rows are kept as they are."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(clean)

    rows = spread(df.select(df[key].alias("key"), df[text].alias("text")))
    return rows.select(F.col("key").alias(key), cleaned("text").alias(text))
