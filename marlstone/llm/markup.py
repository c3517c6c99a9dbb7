"""One text with HTML, Markdown, wiki and LaTeX markup as a tree of elements, its clean text, and the kinds of markup in it.

``parse`` makes the tree: blocks (headings, paragraphs, lists, code, quotes, tables, HTML elements, formulas) whose inline markup is
resolved to plain text. ``render`` writes a tree as clean text in one spelling: ``#`` headings, ``-`` items, fenced code, ``$`` formulas.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape
from html.entities import html5

HTML, MARKDOWN, WIKI, LATEX = "html", "markdown", "wiki", "latex"

# Elements of HTML, and those that stand for blocks.
TAGS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee menu meta meter nav nobr noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html iframe li main menu nav ol p pre script section style summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOOLEAN = "async|autofocus|autoplay|checked|compact|controls|default|defer|disabled|download|hidden|ismap|loop|multiple|muted|nohref|noshade|novalidate|nowrap|open|readonly|required|reversed|selected"
# LaTeX commands that need no brace after them to be told from a path or an escape.
BARE = "item|hline|maketitle|tableofcontents|newpage|clearpage|noindent|centering|bigskip|medskip|smallskip|LaTeX|TeX|textwidth|linewidth|par|newline|toprule|midrule|bottomrule|appendix|bfseries|itshape|alpha|beta|gamma|delta|epsilon|lambda|mu|pi|sigma|theta|omega|sum|prod|int|infty|leq|geq|neq|cdot|times|approx|rightarrow|ldots|dots|quad|qquad"

_ATTR = rf"""(?:\s+(?:[A-Za-z_:@][\w:.@-]*\s*=\s*(?:"[^"<]*"|'[^'<]*'|[^\s"'<>=`]+)|(?:{BOOLEAN})(?=[\s/>])))*"""
TAG = re.compile(rf"<(/?)([A-Za-z][A-Za-z0-9]*)({_ATTR})\s*(/?)>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^\n]*)$")
_ATX = re.compile(r" {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(={2,}|-{2,})[ \t]*$")
_WIKI_HEAD = re.compile(r"(={2,6})[ \t]*([^=\s](?:[^=\n]*[^=\s])?)[ \t]*\1[ \t]*$|= ([^=\n]*\S) =[ \t]*$")
_QUOTE = re.compile(r" {0,3}>(?!>>)[ \t]?(.*)$")
_CALLOUT = re.compile(r"\[!([\w-]+)\][+-]?[ \t]*(.*)$")
_ITEM = re.compile(r"([ \t]*)([-*+]|\d{1,9}[.)])[ \t]+(\S.*)$")
_TASK = re.compile(r"\[([ xX/?-])\](?:[ \t]+|$)(.*)$")
_DELIM = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$|[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*$")
_DEFINE = re.compile(r" {0,3}\[(?!\^)([^\]\n]+)\]:[ \t]+<?(?:[a-z][a-z0-9+.-]*:|[./#]|www\.)\S*>?(?:[ \t]+[\"'(].*)?[ \t]*$", re.I)
_FOOTDEF = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)$")
_SECTION = re.compile(r"[ \t]*\\(part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\]\n]*\])?\{")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")

# Where a construct must have ended: in its line, its paragraph, or anywhere.
_PARA = r"(?:[^\n]|\n(?![ \t]*\n))"
_BLANK = re.compile(r"\n[ \t]*(?=\n)")

#: Inline constructs by their first character, tried in this order: (name, opening, whole, how far a missing end is missing). A whole may
#: be of any length. If the opening is there and the whole isn't, no later opening of the name before that end can have one either (what
#: closes it doesn't depend on where it opened), so it is not looked for again: no text takes more than about linear time. A construct
#: whose body can't hold its own first character stops at the next one and needs no such note.
_R = lambda p: re.compile(p, re.X)
_TICKS = [("code%d" % k, _R(r"(?<!`)`{%d}(?!`)" % k), _R(r"(?P<tick>`{%d})(?!`)(?P<span>(?:[^`\n]|\n(?![ \t]*\n)|(?!(?P=tick)(?!`))`)+?)(?P=tick)(?!`)" % k), "para") for k in (1, 2, 3, 4)]
_STARS = [("star%d" % k, _R(r"(?<![\w*\\])\*{%d}(?![\s*])" % k), _R(r"\*{%d}(?P<body>%s*?[^\s*\\])\*{%d}(?![\w*])" % (k, _PARA, k)), "para") for k in (1, 2, 3)]
_UNDERS = [("under%d" % k, _R(r"(?<![\w\\])_{%d}(?![\s_])" % k), _R(r"_{%d}(?P<body>%s*?[^\s_\\])_{%d}(?!\w)" % (k, _PARA, k)), "para") for k in (1, 2, 3)]
_CONSTRUCTS: dict[str, list[tuple[str, re.Pattern | None, re.Pattern, str]]] = {
    "<": [
        ("comment", None, _R(r"<!--(?s:.*?)(?:-->|\Z)"), ""),
        ("doctype", _R(r"<!(?:DOCTYPE|doctype)\b"), _R(r"<!(?:DOCTYPE|doctype)\b[^>\n]*>"), "line"),
        ("cdata", _R(r"<!\[CDATA\["), _R(r"<!\[CDATA\[(?s:.*?)\]\]>"), "text"),
        *((t, _R(rf"<{t}\b"), _R(rf"<(?P<ptag>{t})\b[^<>]*>(?s:.*?)</{t}\s*>"), "text") for t in ("pre", "script", "style")),
        ("auto", None, _R(r"<(?P<aurl>(?:https?|ftp|mailto):[^\s<>]+)>"), ""),
        ("tag", None, _R(r"</?[A-Za-z][A-Za-z0-9]*(?=[\s/>])[^<>]*>"), ""),
    ],
    "`": _TICKS,
    "$": [("display", None, _R(r"\$\$(?P<body>[^$]+)\$\$"), ""), ("math", None, _R(r"(?<![\w\\$])\$(?![\s$])(?P<ibody>(?:[^$\n\\]|\\.)+?)(?<!\s)\$(?![\w$])"), "")],
    "\\": [
        ("display", _R(r"\\\["), _R(r"\\\[(?P<body>(?s:.+?))\\\]"), "text"),
        ("paren", _R(r"\\\("), _R(r"\\\((?P<body>(?s:.+?))\\\)"), "text"),
        ("env", None, _R(r"\\(?P<be>begin|end)\{(?P<ename>[A-Za-z]+\*?)\}"), ""),
        ("command", None, _R(r"(?<![\\:])\\(?P<cname>[A-Za-z]+)\*?(?=\{)"), ""),
        ("command", _R(r"(?<![\\:])\\[A-Za-z]+\*?\["), _R(r"(?<![\\:])\\(?P<cname>[A-Za-z]+)\*?\[[^\]\n]*\](?=\{)"), "]"),
        ("bare", None, _R(rf"(?<![\\\w:])\\(?P<bare>{BARE})(?![A-Za-z{{\\])"), ""),
    ],
    "{": [("wtable", _R(r"(?:(?<=\n)|\A)\{\|"), _R(r"\{\|(?s:.*?)\n\|\}"), "text")],
    "[": [
        ("wlink", None, _R(r"(?<![\w\]])\[\[(?P<wbody>[^\[\]\n]+)\]\]"), ""),
        ("wurl", None, _R(r"\[(?P<wu>(?:https?|ftp|mailto):[^\s\]\[]+)[ \t]+(?P<wlabel>[^\]\[\n]+)\]"), ""),
        ("foot", None, _R(r"\[\^[^\]\s\[]+\]"), ""),
        ("link", None, _R(r"""(?<![\w\])])\[(?P<label>(?:[^\[\]\n]|\[[^\[\]\n]*\])+)\]\((?P<target>[^\s()]*(?:\([^\s()]*\)[^\s()]*)?)(?:[ \t]+(?:"[^"\n]*"|'[^'\n]*'))?\)"""), ""),
        ("ref", None, _R(r"(?<![\w\]])\[(?P<rlabel>[^\[\]\n]+)\]\[(?P<rid>[^\[\]\n]*)\]"), ""),
    ],
    "!": [
        ("wlink", None, _R(r"!\[\[(?P<wbody>[^\[\]\n]+)\]\]"), ""),
        ("image", _R(r"!\["), _R(r"!\[(?P<alt>[^\]\n]*)\](?:\([^()\n]*(?:\([^()\n]*\)[^()\n]*)?\)|\[[^\]\n]*\])"), "]"),
    ],
    "&": [("entity", None, _ENTITY, "")],
    "~": [("strike", None, _R(rf"(?<![~\w])~~(?=[^\s~])(?P<body>(?:[^\n~]|\n(?![ \t]*\n))+?)(?<!\s)~~(?![~\w])"), "")],
    "*": _STARS,
    "_": _UNDERS,
    "'": [("quote", None, _R(r"(?<!')(?P<qm>'{2,5})(?=[\w\[*\"(<])(?P<body>(?:[^\n']|'(?!'))+?)(?<=[\w\])*\".!?>])(?P=qm)(?!')"), "")],
}
_WORTH = re.compile(r"[<&`$\\{\[!*_~']")


@dataclass(slots=True)
class Node:
    kind: str
    level: int = 0
    text: str = ""
    children: list = field(default_factory=list)


class _Places:
    """Of one text, made when first asked for: where braces are closed, and where lines, paragraphs and brackets end."""

    def __init__(self, s: str):
        self.s = s
        self._next: dict[str, tuple[int, int]] = {}
        self._close: dict[bool, dict[int, int]] = {}

    def end(self, how: str, at: int) -> int:
        """Up to where a construct that isn't closed from ``at`` on can't be closed."""
        if how == "text":
            return len(self.s)
        if how == "]":  # only if the line has none: a bracket may be followed by the wrong thing
            line = self.end("line", at)
            return line if self._find("]", at) >= line else at
        if how == "line":
            return self._find("\n", at)
        m = _BLANK.search(self.s, at)
        return m.start() if m else len(self.s)

    def _find(self, c: str, at: int) -> int:
        start, k = self._next.get(c, (1, 0))
        if not start <= at <= k:
            k = self.s.find(c, at)
            k = len(self.s) if k < 0 else k
            self._next[c] = (at, k)
        return k

    def closed(self, at: int, escapes: bool) -> int | None:
        """Where the brace opened at ``at`` is closed: braces are matched once for the whole text."""
        known = self._close.get(escapes)
        if known is None:
            known, stack = {}, []
            for m in re.finditer(r"\\.|[{}]" if escapes else r"[{}]", self.s, re.S):
                c = m.group()
                if c == "{":
                    stack.append(m.start())
                elif c == "}" and stack:
                    known[stack.pop()] = m.start()
            self._close[escapes] = known
        return known.get(at)

    def braced(self, at: int) -> tuple[str, int]:
        """What the balanced braces from ``at`` hold, and the place after them; an unclosed brace ends with its line."""
        end = self.closed(at, True)
        if end is not None:
            return self.s[at + 1 : end], end + 1
        end = self._find("\n", at)
        return self.s[at + 1 : end], end


def _braced(s: str, at: int) -> tuple[str, int]:
    return _Places(s).braced(at)


# What LaTeX commands leave in clean text; those not named leave their argument.
_DROPPED = frozenset("label ref cite citep citet eqref pageref autoref cref usepackage documentclass bibliography bibliographystyle input include vspace hspace index nocite setlength newcommand renewcommand pagestyle".split())

# Commands that may follow a letter at once; others there are parts of a path.
_INSIDE = frozenset("footnote footnotemark emph textbf textit texttt textsc textsuperscript textsubscript underline url href mbox ensuremath".split())


def inline(s: str, kinds: set[str]) -> str:
    """Clean text of inline markup; its kinds are added."""
    m = _WORTH.search(s)
    if not m:
        return s
    out, at, places, missing = [], 0, _Places(s), {}
    while m:
        i = m.start()
        found = None
        for name, opening, whole, how in _CONSTRUCTS[s[i]]:
            if opening is None:
                found = whole.match(s, i)
            elif missing.get(name, -1) <= i and opening.match(s, i):
                found = whole.match(s, i)
                if found is None:
                    missing[name] = places.end(how, i + 1)
            if found:
                break
        if found:
            text, end, kind = _resolve(name, found, s, kinds, places)
        elif s.startswith("{{", i) and (j := places.closed(i, False)) is not None and j - i > 3 and places.closed(i + 1, False) == j - 1:
            text, end, kind = "", j + 1, WIKI
        else:
            m = _WORTH.search(s, i + 1)
            continue
        if kind:
            kinds.add(kind)
        out.append(s[at:i])
        out.append(text)
        at = max(end, i + 1)
        m = _WORTH.search(s, at)
    out.append(s[at:])
    return "".join(out)


def _resolve(what: str, m: re.Match, s: str, kinds: set[str], places: _Places) -> tuple[str, int, str | None]:
    end, g = m.end(), m.group
    if what in ("comment", "doctype", "cdata"):
        return "", end, HTML
    if what[:4] == "code":
        return "`" + g("span").strip() + "`", end, MARKDOWN
    if what in ("pre", "script", "style"):
        if what != "pre":
            return "", end, HTML
        return "\n```\n" + unescape(TAG.sub("", g()[g().index(">") + 1 : g().rindex("</")])).strip("\n") + "\n```\n", end, HTML
    if what == "display":
        return "$$" + g("body").strip() + "$$", end, LATEX
    if what == "paren":
        return "$" + g("body").strip() + "$", end, LATEX
    if what == "math":
        if not _formula(g("ibody")):
            return "$", m.start() + 1, None
        return "$" + g("ibody").strip() + "$", end, LATEX
    if what == "env":
        while end < len(s) and s[end] in "[{":  # arguments, each within the line
            close = places._find("]" if s[end] == "[" else "}", end)
            if close > places._find("\n", end):
                break
            end = close + 1
        return "", end, LATEX
    if what == "bare":
        return "- " if g("bare") == "item" else ("\\" + g("bare")), end, LATEX
    if what == "command":
        name = g("cname")
        if m.start() and s[m.start() - 1].isalnum() and name not in _DROPPED | _INSIDE:
            return "\\", m.start() + 1, None
        if name not in _DROPPED and places.closed(end, True) is None:  # what follows is read on as it is
            return "", end + 1, LATEX
        inner, stop = places.braced(end)
        text = "" if name in _DROPPED else inline(inner, kinds)
        while stop < len(s) and s[stop] == "{":  # further arguments
            more, stop = places.braced(stop)
            text = text if name in _DROPPED else inline(more, kinds) if name == "href" else text + " " + inline(more, kinds)
        return f" ({text})" if name == "footnote" else text, stop, LATEX
    if what == "wtable":
        return "\n".join(_wiki_row(r, kinds) for r in g().split("\n")[1:-1]), end, WIKI
    if what == "wlink":
        body = g("wbody")
        if re.fullmatch(r"\s*-?[\d.]+(?:\s*[,;]\s*-?[\d.]+)+\s*", body) or not body.strip():
            return g(), end, None
        target, *rest = body.split("|")
        if re.match(r"\s*:?(?:Category|Kategorie|Catégorie)\s*:", target, re.I):
            return "", end, WIKI
        if re.match(r"\s*(?:File|Image|Datei|Fichier)\s*:", target, re.I):
            return rest[-1].strip() if len(rest) > 1 else "", end, WIKI
        return (rest[-1] if rest else target.split("#")[0].rsplit("/", 1)[-1] or target).strip(), end, WIKI
    if what == "wurl":
        return inline(g("wlabel"), kinds), end, WIKI
    if what == "foot":
        return "", end, MARKDOWN
    if what == "image":
        return g("alt"), end, MARKDOWN
    if what == "link":
        return inline(g("label"), kinds), end, MARKDOWN
    if what == "ref":
        if re.fullmatch(r"[\d\s,.:*+-]+", g("rlabel")):
            return "[", m.start() + 1, None
        return inline(g("rlabel"), kinds), end, MARKDOWN
    if what == "auto":
        return g("aurl"), end, MARKDOWN
    if what == "tag":
        t = TAG.fullmatch(g())
        if not t or t.group(2).lower() not in TAGS:
            return "<", m.start() + 1, None
        name = t.group(2).lower()
        if name == "img":
            alt = re.search(r"""\balt\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", t.group(3), re.I)
            return next((x for x in alt.groups() if x), "") if alt else "", end, HTML
        if name in ("sup", "sub"):
            return ("" if t.group(1) else "^" if name == "sup" else "_"), end, HTML
        return ("\n" if name == "br" or name in BLOCK_TAGS else ""), end, HTML
    if what == "entity":
        if g()[1] != "#" and g()[1:] not in html5:
            return "&", m.start() + 1, None
        return unescape(g()).replace("\xa0", " "), end, HTML
    # strike, star, under, quote
    return inline(g("body"), kinds), end, WIKI if what == "quote" else MARKDOWN


def _formula(body: str) -> bool:
    """Dollars are a formula's if what they hold isn't an amount of money with words after it."""
    if re.match(r"\d[\d.,]*(?:[kKmM]|\s|$)", body) and not re.search(r"[\\^_=+{}<>]", body):
        return False
    # plain words between dollars are prices or variables of a shell
    return not re.search(r"[A-Za-z]{3,}\s+[A-Za-z]{2,}", re.sub(r"\\[A-Za-z]+", "", body))


def _wiki_row(row: str, kinds: set[str]) -> str:
    row = row.strip()
    if row.startswith("|-") or not row:
        return ""
    return " | ".join(inline(c.strip(), kinds) for c in re.split(r"\|\||!!", row.lstrip("|!+")))


def _html_ends(lines: list[str]) -> dict[int, int]:
    """For each line that begins with a tag, the line in which that element is closed. All tags are matched in one pass."""
    stacks: dict[str, list[tuple[int, bool]]] = {}
    ends = {}
    for j, line in enumerate(lines):
        if "<" not in line:
            continue
        first = len(line) - len(line.lstrip())
        for t in TAG.finditer(line):
            stack = stacks.setdefault(t.group(2).lower(), [])
            if t.group(4):
                continue
            if not t.group(1):
                stack.append((j, t.start() == first))
            elif stack:
                at, begins = stack.pop()
                if begins:
                    ends[at] = j
    return ends


def _html_block(lines: list[str], i: int, ends: dict[int, int], blank: list[int]) -> int:
    """The line after the HTML block that begins in line i: where its first element is closed, or at the next empty line."""
    first = TAG.match(lines[i].lstrip())
    name = first.group(2).lower()
    if name in VOID or first.group(4):
        return i + 1
    k = bisect_right(blank, i)
    empty = blank[k] if k < len(blank) else len(lines)
    end = ends.get(i)
    if end is None or name == "p":
        return empty if end is None else min(end + 1, empty)
    return end + 1


def _html_tree(chunk: str, kinds: set[str]) -> list[Node]:
    """Block elements of the chunk as a tree; what is between them is text."""
    root = Node("html")
    stack, at = [("", root)], 0

    def text(t: str) -> None:
        t = inline(t, kinds).strip()
        if t:
            stack[-1][1].children.append(Node("text", text=t))

    for m in TAG.finditer(chunk):
        name = m.group(2).lower()
        if m.start() < at or name not in BLOCK_TAGS:
            continue
        text(chunk[at : m.start()])
        at = m.end()
        kinds.add(HTML)
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif name not in VOID and not m.group(4):
            if name in ("li", "td", "th", "tr", "dt", "dd", "p") and stack[-1][0] == name:
                stack.pop()
            if name in ("pre", "script", "style"):
                close = re.compile(rf"</{name}\s*>", re.I).search(chunk, at)
                stop, after = (close.start(), close.end()) if close else (len(chunk), len(chunk))
                if name == "pre":
                    stack[-1][1].children.append(Node("code", text=unescape(TAG.sub("", chunk[at:stop])).strip("\n")))
                at = after
                continue
            node = Node("heading", int(name[1])) if re.fullmatch("h[1-6]", name) else Node({"li": "item", "blockquote": "quote", "tr": "row"}.get(name, "html"), text="")
            stack[min(len(stack), DEPTH) - 1][1].children.append(node)
            stack.append((name, node))
    text(chunk[at:])
    return root.children


#: Elements and quotes nested deeper are put side by side at this depth; nothing of them is left out.
DEPTH = 200
RECURSION = 50_000


def parse(text: str, kinds: set[str], lines_count: bool = True, depth: int = 0) -> list[Node]:
    """The blocks of a text. kinds gets the kinds of markup met. With lines_count False (metadata) lines have no meaning of their own."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not lines_count:
        return [Node("para", text=inline(text, kinds))]
    if sys.getrecursionlimit() < RECURSION:
        sys.setrecursionlimit(RECURSION)
    lines, nodes, para, i = text.split("\n"), [], [], 0
    ends: dict[int, int] | None = None
    blank: list[int] = []
    closing_in: dict[str, list[int]] = {}

    def flush() -> None:
        if para:
            body = inline("\n".join(para), kinds).strip()
            if body:
                nodes.append(Node("para", text=body))
            para.clear()

    n = len(lines)
    while i < n:
        line = lines[i]
        if not line.strip():
            flush()
            i += 1
            continue
        head = line.lstrip()[:2]
        f = _FENCE.match(line) if head[0] in "`~" else None
        if f and not (f.group(1)[0] == "`" and "`" in f.group(2)):
            flush()
            kinds.add(MARKDOWN)
            j = i + 1
            while j < n and not ((c := _FENCE.match(lines[j])) and c.group(1).startswith(f.group(1)) and not c.group(2).strip()):
                j += 1
            nodes.append(Node("code", text="\n".join(lines[i + 1 : j])))
            i = j + 1
        elif head[0] == "#" and (h := _ATX.match(line)):
            flush()
            kinds.add(MARKDOWN)
            nodes.append(Node("heading", len(h.group(1)), inline(h.group(2), kinds).strip()))
            i += 1
        elif head[0] == "=" and (h := _WIKI_HEAD.match(line)):
            flush()
            kinds.add(WIKI)
            nodes.append(Node("heading", len(h.group(1) or "="), inline(h.group(2) or h.group(3), kinds)))
            i += 1
        elif head[0] == "\\" and (h := _SECTION.match(line)):
            flush()
            kinds.add(LATEX)
            inner, end = _braced(line, h.end() - 1)
            nodes.append(Node("heading", 1 + h.group(1).count("sub"), inline(inner, kinds).strip()))
            if line[end:].strip():
                para.append(line[end:].strip())
            i += 1
        elif head == "\\b" and (h := re.match(r"[ \t]*\\begin\{(equation|align|gather|multline|eqnarray|displaymath|math|verbatim|lstlisting)(\*?)\}", line)):
            flush()
            kinds.add(LATEX)
            j = next((j for j in range(i, n) if f"\\end{{{h.group(1)}{h.group(2)}}}" in lines[j]), n)
            body = "\n".join([line[h.end() :], *lines[i + 1 : j], *([lines[j].split("\\end{")[0]] if i < j < n else [])]).strip() if j > i else line[h.end() :].split("\\end{")[0]
            nodes.append(Node("code" if h.group(1) in ("verbatim", "lstlisting") else "formula", text=body))
            i = j + 1
        elif head == "$$" or head == "\\[":
            close = "$$" if head == "$$" else "\\]"
            body = line.lstrip()[2:]
            j = i
            while close not in body and j + 1 < n and lines[j + 1].strip():
                j += 1
                body += "\n" + lines[j]
            if close in body and not body.split(close, 1)[1].strip(" .,;"):
                flush()
                kinds.add(LATEX)
                nodes.append(Node("formula", text=body.split(close, 1)[0].strip()))
                i = j + 1
            else:
                para.append(line)
                i += 1
        elif head[0] == ">" and _QUOTE.match(line):
            flush()
            kinds.add(MARKDOWN)
            inner = []
            while i < n and (q := _QUOTE.match(lines[i])):
                inner.append(q.group(1) if depth < DEPTH else re.sub(r"^(?:[ \t]*>)+[ \t]?", "", q.group(1)))
                i += 1
            if c := _CALLOUT.match(inner[0]):
                inner[0] = c.group(2) or c.group(1)
            nodes.append(Node("quote", children=parse("\n".join(inner), kinds, True, depth + 1)))
        elif head == "{|":
            flush()
            kinds.add(WIKI)
            j = next((j for j in range(i + 1, n) if lines[j].lstrip().startswith("|}")), n)
            rows = [r for r in (_wiki_row(x, kinds) for x in lines[i + 1 : j]) if r]
            nodes.append(Node("table", children=[Node("row", text=r) for r in rows]))
            i = j + 1
        elif "|" in line and i + 1 < n and _DELIM.match(lines[i + 1]) and "-" in lines[i + 1]:
            flush()
            kinds.add(MARKDOWN)
            rows, j = [line], i + 2
            while j < n and "|" in lines[j] and lines[j].strip():
                rows.append(lines[j])
                j += 1
            cells = [" | ".join(inline(c.strip(), kinds) for c in re.split(r"(?<!\\)\|", r.strip().strip("|"))) for r in rows]
            nodes.append(Node("table", children=[Node("row", text=c) for c in cells]))
            i = j
        elif head[0] == "[" and (_DEFINE.match(line) or _FOOTDEF.match(line)):
            flush()
            kinds.add(MARKDOWN)
            if d := _FOOTDEF.match(line):
                nodes.append(Node("para", text=inline(d.group(2), kinds)))
            i += 1
        elif head[0] == "<" and (t := TAG.match(line.lstrip())) and t.group(2).lower() in BLOCK_TAGS and not t.group(1):
            flush()
            kinds.add(HTML)
            if ends is None:
                ends, blank = _html_ends(lines), [j for j, x in enumerate(lines) if not x.strip()]
            j = _html_block(lines, i, ends, blank)
            nodes.append(Node("html", text="", children=_html_tree("\n".join(lines[i:j]), kinds)))
            i = j
        elif m := _ITEM.match(line):
            flush()
            body = m.group(3)
            if t := _TASK.match(body):
                kinds.add(MARKDOWN)
                body = t.group(2)
            j = i + 1
            while j < n and lines[j].strip() and lines[j][:1] in " \t" and not _ITEM.match(lines[j]):
                body += "\n" + lines[j].strip()
                j += 1
            depth = len(m.group(1).expandtabs(4)) // 2
            nodes.append(Node("item", depth, inline(body, kinds).strip()))
            i = j
        elif i + 1 < n and len(para) == 0 and _SETEXT.match(lines[i + 1]) and not _RULE.match(line):
            kinds.add(MARKDOWN)
            nodes.append(Node("heading", 1 if "=" in lines[i + 1] else 2, inline(line, kinds).strip()))
            i += 2
        elif para and _SETEXT.match(line):
            kinds.add(MARKDOWN)
            nodes.append(Node("heading", 1 if "=" in line else 2, inline("\n".join(para), kinds).strip().replace("\n", " ")))
            para.clear()
            i += 1
        elif _RULE.match(line):
            flush()
            i += 1
        else:
            # a construct over several lines (comment, template) is kept whole, empty lines in it too
            for opening, closing in (("<!--", "-->"), ("{{", "}}")):
                k = line.rfind(opening)
                if k >= 0 and closing not in line[k:]:
                    if closing not in closing_in:
                        closing_in[closing] = [j for j, x in enumerate(lines) if closing in x]
                    j = bisect_right(closing_in[closing], i)
                    if j < len(closing_in[closing]):
                        j = closing_in[closing][j]
                        line = "\n".join(lines[i : j + 1])
                        i = j
                        break
            para.append(line)
            i += 1
    flush()
    return nodes


_DIGITS = re.compile(r"\d+")


def words_of(node: Node) -> str:
    return " ".join(x.text for x in subtrees([node]) if x.text)


def hashes(nodes: list[Node]) -> list[tuple[bytes, int]]:
    """Of every subtree, in the order of ``subtrees``: the hash of kind, level, text (case, digits and spaces aside) and the children's hashes, and its characters."""
    out: list[tuple[bytes, int]] = []

    def walk(node: Node) -> tuple[bytes, int]:
        at = len(out)
        out.append((b"", 0))
        h = blake2b(f"{node.kind}\0{node.level}\0".encode(), digest_size=8)
        h.update(" ".join(_DIGITS.sub("0", node.text.lower()).split()).encode("utf-8", "surrogatepass"))
        size = len(node.text)
        for c in node.children:
            sub, chars = walk(c)
            h.update(sub)
            size += chars + 1 if chars else 0
        out[at] = h.digest(), size
        return out[at]

    for node in nodes:
        walk(node)
    return out


def subtrees(nodes: list[Node]):
    stack = list(reversed(nodes))
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(node.children))


def pruned(nodes: list[Node], drop: set[int]) -> list[Node]:
    """The trees without the subtrees whose place in the order of ``subtrees`` is in drop."""
    at = -1

    def keep(some: list[Node], gone: bool) -> list[Node]:
        nonlocal at
        out = []
        for x in some:
            at += 1
            off = gone or at in drop
            children = keep(x.children, off)
            if not off:
                out.append(Node(x.kind, x.level, x.text, children))
        return out

    return keep(nodes, False)


def packed(nodes: list[Node]) -> list:
    """The trees as lists, for marshal."""
    return [[x.kind, x.level, x.text, packed(x.children)] for x in nodes]


def unpacked(rows: list) -> list[Node]:
    return [Node(k, level, text, unpacked(c)) for k, level, text, c in rows]


def _tidy(s: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n|$)", "", re.sub(r"(?<=\S)[ \t]{2,}", " ", s))).strip()


def render(nodes: list[Node]) -> str:
    out, before = [], ""
    for x in nodes:
        if x.kind == "heading":
            s = "#" * x.level + " " + _tidy(x.text or render(x.children)).replace("\n", " ")
        elif x.kind == "code":
            ticks = max([2, *(len(t) for t in re.findall(r"`+", x.text))]) + 1
            s = "`" * max(3, ticks) + "\n" + x.text + "\n" + "`" * max(3, ticks)
        elif x.kind == "formula":
            s = "$$\n" + x.text + "\n$$"
        elif x.kind == "item":
            inner = "\n".join(p for p in (_tidy(x.text), render(x.children)) if p)
            s = "  " * x.level + "- " + inner.replace("\n", "\n" + "  " * (x.level + 1))
        elif x.kind == "quote":
            s = render(x.children)
        elif x.kind == "row":
            s = x.text or " | ".join(render([c]) if c.text else render(c.children) for c in x.children)
        elif x.kind == "table":
            s = "\n".join(c.text for c in x.children if c.text)
        else:
            s = "\n".join(p for p in (_tidy(x.text), render(x.children)) if p)
        if s.strip(" #-"):
            together = x.kind == before and x.kind in ("item", "row", "text")
            out.append(("\n" if together else "\n\n") + s)
            before = x.kind
    return "".join(out).strip("\n")
