"""Clean text and structure from HTML, Markdown, wiki and LaTeX, also mixed.

``blocks`` reads one body into ordered blocks of kind heading, list_item,
code_block, formula or text, each with the generalised tag-class path of its
container.  HTML is scanned once; text that stands raw in a container is read in
the plain-text dialect it shows.  ``structure`` and ``clean_text`` add the consensus
over hosts: every page scores its containers (text and structure against links),
the pages' votes are summed per host and path in Spark, and pages are read again
with the paths and dialects that won.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import scratch_path

KINDS = ("heading", "list_item", "code_block", "formula")

_INLINE = "a|abbr|acronym|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|img|ins|kbd|label|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr|br|nowiki|input|button"
_BLOCK = "html|body|p|div|table|thead|tbody|tfoot|tr|td|th|caption|ul|ol|li|menu|dl|dt|dd|h[1-6]|blockquote|section|article|header|footer|main|nav|aside|form|fieldset|figure|figcaption|center|address|hr|meta|link|base"
_TOKEN = re.compile(
    r"(?is)<!--.*?(?:-->|\Z)"
    r"|<head\b[^>]*>.*?(?:</head\s*>|(?=<body\b)|\Z)"
    r"|(?<!\\)<(?P<raw>script|style|math|pre|syntaxhighlight|source|title|textarea|noscript|template)\b(?P<rawattr>[^>]*)>(?P<inner>.*?)(?:</(?P=raw)\s*>|\Z)"
    rf"|(?<!\\)<(?P<close>/?)(?P<tag>{_INLINE}|{_BLOCK})(?P<attr>(?:\s[^<>]*)?)/?>|<!doctype[^>]*>"
)
_HEADING_TAGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_BLOCK_TAGS = frozenset(_BLOCK.replace("h[1-6]", "h1|h2|h3|h4|h5|h6").split("|"))
_CLASS = re.compile(r"""(?i)\bclass\s*=\s*["']?([\w-]+)""")
_TAG_INSIDE = re.compile(r"(?s)<!--.*?-->|<[^<>]*>")
_OPEN, _SHUT = "\ue000", "\ue001"  # around a formula kept inside running text
_SPACES = re.compile(r"[\s\u00a0\u200b\ufeff]+")

_MATH = re.compile(r"(?<!\\)\$\$(?P<a>.+?)\$\$|\\\[(?P<b>.+?)\\\]|\\\((?P<c>.+?)\\\)|(?<![\\$\w])\$(?![\s$])(?P<d>[^$\n]*?[^\s$\\])\$(?![\d$])", re.S)


def squeeze(text: str) -> str:
    if text.isascii():
        return " ".join(text.split())
    return _SPACES.sub(" ", text).strip()


def _lift_math(text: str, out: list[tuple[str, str]], clean=None) -> str:
    """Report formulas of ``text`` and mark them in it."""

    def keep(m: re.Match) -> str:
        body = m["a"] or m["b"] or m["c"] or m["d"]
        if clean:
            body = clean(body)
        body = squeeze(body)
        if body:
            out.append(("formula", body))
        return f"{_OPEN}{body}{_SHUT}"

    return _MATH.sub(keep, text) if "$" in text or "\\(" in text or "\\[" in text else text


def _bare(text: str) -> str:
    if _OPEN not in text:
        return squeeze(text)
    return squeeze(text.replace(_OPEN, "").replace(_SHUT, ""))


# ------------------------------------------------------------ plain-text dialects

_LATEX = re.compile(r"\\(?:(?:sub)*section|begin|item|end|textbf|emph|href|texttt|pounds|textless|textgreater|chapter|paragraph)\b|\\[&%](?!\w)|\\\\[ \t]*$", re.M)
_WIKI = re.compile(r"^(={2,6})[^=\n].*?\1[ \t]*$|'''|\[\[|\[https?://\S+ |^\{\||^\*\*+ |^##+ .*(?:\n[#*]+ )|&#42;|\ue002", re.M)
_MARKDOWN = re.compile(r"^#{2,6} |^ {0,3}(?:```|~~~)|\]\(|^\d+[.)] |^[+-] |^ {2,}[*+-] |(?<!\*)\*\*[^*\s]|__\w|\$\$|\\[*_<#\[`]|^\|?[ :]*-{3,}[ :]*\||^[^\n]*\w[^\n]*\n(?:=+|-{3,})[ \t]*$", re.M)


def dialect(text: str) -> str:
    """latex, wiki, markdown, or '' where nothing or equally much speaks for two."""
    scores = {"latex": 2 * len(_LATEX.findall(text)), "wiki": len(_WIKI.findall(text)), "markdown": len(_MARKDOWN.findall(text))}
    ranked = sorted(scores.items(), key=lambda x: -x[1])
    return ranked[0][0] if ranked[0][1] > ranked[1][1] else ""


_MD_LINK = re.compile(r"!?\[((?:[^\[\]\\]|\\.)*)\]\((?:[^()\s]|\([^()]*\))*(?:\s+\"[^\"]*\")?\)")
_MD_REF = re.compile(r"\[([^\[\]]+)\]\[[^\[\]]*\]")
_MD_AUTO = re.compile(r"(?<!\\)<(https?://[^\s<>]+|[^\s<>@]+@[^\s<>]+)>")
_MD_STRONG = re.compile(r"(?<!\\)(\*\*|__)(?=\S)(.+?)(?<=[^\s\\])\1")
_MD_EM = re.compile(r"(?<![\\*\w])\*(?=[^\s*])([^*\n]+?)(?<=[^\s\\*])\*(?![*\w])|(?<![\\_\w])_(?=[^\s_])([^_\n]+?)(?<=[^\s\\_])_(?![_\w])")
_MD_CODE = re.compile(r"(?<!\\)(`+)(?!`)(.+?)(?<!`)\1(?!`)")
_MD_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")


def _md_inline(text: str) -> str:
    if "[" in text:
        text = _MD_REF.sub(r"\1", _MD_LINK.sub(r"\1", text))
    if "<" in text:
        text = _MD_AUTO.sub(r"\1", text)
    if "`" in text:
        text = _MD_CODE.sub(r"\2", text)
    if "*" in text or "_" in text:
        text = _MD_EM.sub(lambda m: m[1] or m[2], _MD_STRONG.sub(r"\2", text))
    if "~~" in text:
        text = re.sub(r"~~(.+?)~~", r"\1", text)
    # an escaped character is literal, also where an entity would begin
    parts = _MD_ESCAPE.split(text)
    return "".join(p if i % 2 else html.unescape(p) for i, p in enumerate(parts))


_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_WIKI_URL = re.compile(r"\[(?:https?:|mailto:|ftp:|//)\S*?(?:\s+([^\[\]]*))?\]")
_WIKI_QUOTES = re.compile(r"'{2,5}")


def _wiki_inline(text: str) -> str:
    if "[" in text:
        text = _WIKI_URL.sub(lambda m: m[1] or "", _WIKI_LINK.sub(r"\1", text))
    if "''" in text:
        text = _WIKI_QUOTES.sub("", text)
    return html.unescape(text)


_TEX_TWO = re.compile(r"\\(?:href|textcolor|colorbox)\s*\{[^{}]*\}\s*\{((?:[^{}]|\{[^{}]*\})*)\}")
_TEX_ONE = re.compile(r"\\(?:emph|text\w\w|texttt|textsc|textrm|underline|mbox|url|uline|footnote|textsuperscript|textsubscript)\s*\{((?:[^{}]|\{[^{}]*\})*)\}")
# Text symbols of LaTeX.
_TEX_SYMBOLS = {
    "pounds": "£", "textsterling": "£", "euro": "€", "texteuro": "€", "textless": "<", "textgreater": ">", "textbackslash": "\\", "textasciitilde": "~", "textasciicircum": "^",
    "textbar": "|", "textunderscore": "_", "textdollar": "$", "ldots": "…", "dots": "…", "textendash": "–", "textemdash": "—", "S": "§", "copyright": "©", "ss": "ß", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "ae": "æ", "AE": "Æ", "aa": "å", "AA": "Å", "textbullet": "•", "quad": " ", "qquad": " ", "newline": " ", "LaTeX": "LaTeX", "TeX": "TeX",
}
_TEX_SYMBOL = re.compile(r"\\(" + "|".join(sorted(_TEX_SYMBOLS, key=len, reverse=True)) + r")(?:\{\}|(?![A-Za-z]))[ ]?(?<![ ])|\\(" + "|".join(sorted(_TEX_SYMBOLS, key=len, reverse=True)) + r")(?:\{\}|(?![A-Za-z]))")
_TEX_ACCENT = re.compile(r"\\([\"'`^~=.cvuHkr])\s*\{?\s*(\\?[A-Za-z])\s*\}?")
# Accents of LaTeX as combining marks.
_ACCENTS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "k": "\u0328", "r": "\u030a"}
_TEX_PUNCT = re.compile(r"\\([&%#_${}])")
_TEX_COMMENT = re.compile(r"(?m)(?<!\\)%.*$")


def _accent(m: re.Match) -> str:
    import unicodedata

    if m[1].isalpha() and "{" not in m[0]:
        return m[0]
    return unicodedata.normalize("NFC", m[2].lstrip("\\") + _ACCENTS[m[1]])


def _tex_inline(text: str) -> str:
    if "\\" not in text and "~" not in text and "{" not in text and "``" not in text and "''" not in text:
        return text
    text = re.sub(r"\\\\(?:\*|\[[^\]]*\])?", " ", text)
    for _ in range(4):
        new = _TEX_ONE.sub(r"\1", _TEX_TWO.sub(r"\1", text))
        if new == text:
            break
        text = new
    text = _TEX_SYMBOL.sub(lambda m: _TEX_SYMBOLS[m[1] or m[2]], text)
    text = _TEX_ACCENT.sub(_accent, text)
    text = re.sub(r"(?<!\\)~", " ", text)
    text = text.replace("``", "“").replace("''", "”")
    text = re.sub(r"\\(?:label|vspace|hspace|noindent|centering|small|large|bfseries|itshape|ttfamily|par)\b\*?(?:\{[^{}]*\})?", " ", text)
    text = re.sub(r"(?<!\\)[{}]", "", text)
    return _TEX_PUNCT.sub(r"\1", text).replace("\\ ", " ")


_MD_FENCE = re.compile(r"(?ms)^(?P<in> {0,3})(?P<f>`{3,}|~{3,})[^\n`]*\n(?P<body>.*?)(?:^ {0,3}(?P=f)[`~]*[ \t]*$|\Z)")
_MD_ITEM = re.compile(r"(?P<in>[ \t]*)(?:[-+*•]|\d{1,9}[.)])(?:[ \t]+(?P<t>.*)|[ \t]*$)")
_MD_ATX = re.compile(r" {0,3}#{1,6}(?:[ \t]+(?P<t>.*?))?(?:[ \t]+#+)?[ \t]*$")
_MD_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_MD_SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_MD_TABLE = re.compile(r"[ \t]*\|?[ \t:]*-{2,}[-| \t:]*$")


def _markdown(text: str, out: list[tuple[str, str]]) -> None:
    def fence(m: re.Match) -> str:
        code = squeeze(m["body"])
        if code:
            out.append(("code_block", code))
        return "\n\ue003\n"  # a fence also ends a list

    if "```" in text or "~~~" in text:
        text = _MD_FENCE.sub(fence, text)
    text = _lift_math(text, out)
    para: list[str] = []
    item: list[str] | None = None
    in_list, blank = False, True
    code: list[str] = []

    def close() -> None:
        nonlocal item
        if code:
            body = squeeze("\n".join(code))
            if body:
                out.append(("code_block", body))
            code.clear()
        if item is not None:
            t = _bare(_md_inline("\n".join(item)))
            if t:
                out.append(("list_item", t))
            item = None
        if para:
            t = _bare(_md_inline("\n".join(para)))
            if t:
                out.append(("text", t))
            para.clear()

    for line in text.split("\n"):
        line = line.rstrip("\r").expandtabs(4)
        bare = line.strip()
        if not bare:
            blank = True
            if not code:
                close()
            continue
        if bare == "\ue003":
            close()
            in_list, blank = False, True
            continue
        indent = len(line) - len(line.lstrip())
        if code and indent < 4:
            close()
        if para and not blank and _MD_SETEXT.match(line):
            t = _bare(_md_inline(" ".join(para)))
            para.clear()
            if t:
                out.append(("heading", t))
            in_list = False
        elif indent < 4 and (m := _MD_ATX.match(line)):
            close()
            t = _bare(_md_inline(m["t"] or ""))
            if t:
                out.append(("heading", t))
            in_list = False
        elif indent < 4 and _MD_RULE.match(line):
            close()
        elif (m := _MD_ITEM.match(line)) and (indent < 4 or in_list):
            close()
            item = [re.sub(r"^\[[ xX]\] ", "", m["t"] or "")]
            in_list = True
        elif indent >= 4 and blank and not in_list and not para:
            code.append(line[4:])
        elif code:
            code.append(line[4:])
        elif item is not None:
            item.append(bare)
        elif _MD_TABLE.match(line) and "|" in line:
            pass
        elif bare.startswith("|") and bare.endswith("|"):
            close()
            t = _bare(_md_inline(bare.strip("|").replace("|", "  ")))
            if t:
                out.append(("text", t))
        else:
            if indent == 0:
                in_list = False
            para.append(bare.lstrip("> ") if bare.startswith(">") else bare)
        blank = False
    close()


_WIKI_HEADING = re.compile(r"(={1,6})[ \t]*(.+?)[ \t]*\1[ \t]*$")
_WIKI_ITEM = re.compile(r"[:;]*[*#][*#:;]*[ \t]*(.*)$")


def _wiki(text: str, out: list[tuple[str, str]]) -> None:
    text = _lift_math(text, out, html.unescape)
    para: list[str] = []

    def close() -> None:
        if para:
            t = _bare(_wiki_inline("\n".join(para)))
            if t:
                out.append(("text", t))
            para.clear()

    for line in text.replace("\ue002", "\n").split("\n"):
        line = line.rstrip()
        if not line:
            close()
        elif m := _WIKI_HEADING.match(line):
            close()
            t = _bare(_wiki_inline(m[2]))
            if t:
                out.append(("heading", t))
        elif m := _WIKI_ITEM.match(line):
            close()
            t = _bare(_wiki_inline(m[1]))
            if t:
                out.append(("list_item", t))
        elif line.startswith(("{|", "|-", "|}")):
            close()
        elif line.startswith(("|", "!")):
            close()
            t = _bare(_wiki_inline(re.sub(r"\|\||!!", "  ", line[1:])))
            if t:
                out.append(("text", t))
        else:
            para.append(line)
    close()


_BRACED = r"\{((?:[^{}\\]|\\.|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"
_TEX = re.compile(
    r"\\begin\{(?P<code>verbatim|lstlisting|minted|Verbatim|alltt)\*?\}(?:\[[^\]]*\])?(?:\{\w+\})?(?P<cbody>.*?)(?:\\end\{(?P=code)\*?\}|\Z)"
    r"|\\begin\{(?P<eq>equation|align|gather|multline|eqnarray|displaymath|math)(?P<star>\*?)\}(?P<ebody>.*?)(?:\\end\{(?P=eq)\*?\}|\Z)"
    r"|\\verb\*?(?P<vq>[^\w\s*])(?P<verb>.*?)(?P=vq)"
    rf"|\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?{_BRACED}"
    r"|\\begin\{(?P<list>itemize|enumerate|description)\*?\}(?:\[[^\]]*\])?"
    r"|\\end\{(?P<lend>itemize|enumerate|description)\*?\}"
    r"|\\item\b[ \t]*(?:\[(?P<label>[^\]]*)\])?"
    r"|\\(?:begin|end)\{(?P<env>[A-Za-z]+)\*?\}(?:\{[^{}]*\})*",
    re.S,
)


def _latex(text: str, out: list[tuple[str, str]]) -> None:
    items: list[list[str] | None] = []  # one entry per open list: pieces of its open item
    para: list[str] = []

    def close_item() -> None:
        if items and items[-1] is not None:
            t = _bare(_tex_inline(_lift_math("".join(items[-1]), out)))
            if t:
                out.append(("list_item", t))
            items[-1] = None

    def close_para() -> None:
        for piece in re.split(r"\n\s*\n|\\\\[ \t]*(?:\n|$)", "".join(para)):
            t = _bare(_tex_inline(_lift_math(piece, out)).replace(" & ", "  "))
            if t:
                out.append(("text", t))
        para.clear()

    def put(piece: str) -> None:
        if items and items[-1] is not None:
            items[-1].append(piece)
        elif piece:
            para.append(piece)

    at = 0
    for m in _TEX.finditer(text):
        put(text[at : m.start()])
        at = m.end()
        if m["code"]:
            body = squeeze(m["cbody"])
            if body:
                out.append(("code_block", body))
            put("\n\n")
        elif m["eq"]:
            body = squeeze(re.sub(r"\\(?:label\{[^{}]*\}|nonumber)", "", m["ebody"]))
            if body:
                out.append(("formula", body))
            put(f"{_OPEN}{body}{_SHUT}")
        elif m["verb"] is not None:
            put(m["verb"].replace("\\", "\\textbackslash{}").replace("_", "\\_"))
        elif m["list"]:
            items.append(None)
        elif m["lend"]:
            close_item()
            if items:
                items.pop()
        elif m[0].startswith("\\item"):
            if items:
                close_item()
                items[-1] = [(m["label"] + " ") if m["label"] else ""]
            else:
                put(m["label"] or "")
        elif m["env"]:
            put("\n\n")
        else:
            close_para()
            title = next((g for g in m.groups()[::-1] if g is not None), "")
            t = _bare(_tex_inline(_lift_math(title, out)))
            if t:
                out.append(("heading", t))
    put(text[at:])
    while items:
        close_item()
        items.pop()
    close_para()


_READ = {"markdown": _markdown, "wiki": _wiki, "latex": _latex}
_WIKI_MARK = re.compile(r"\[\[|'{2,}|\[https?:")
_HASH_LINE = re.compile(r"(?m)^#[ \t]+\S.*$")


def read_text(text: str, voted: str = "") -> tuple[list[tuple[str, str]], str]:
    """Blocks of raw text and the dialect it shows ('' where undecided).

    Undecided text with lone ``#`` lines may be a Markdown heading or a wiki list;
    runs of such lines are a list, else the voted dialect decides, else Markdown.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    shown = dialect(text)
    used = shown
    if not used:
        lines = _HASH_LINE.findall(text)
        if lines and (re.search(r"(?m)^#[ \t]+\S.*\n#[ \t]+\S", text) or any(_WIKI_MARK.search(x) for x in lines)):
            used = "wiki"
        else:
            used = voted if voted in _READ and not any(x.rstrip().endswith("#") for x in lines) else "markdown"
    out: list[tuple[str, str]] = []
    _READ[used](text, out)
    return out, shown


# -------------------------------------------------------------------------- HTML

_LOOSE = frozenset(("html", "body", "div", "section", "article", "main", "center", "blockquote", "form"))
_LOOKS_RAW = re.compile(r"(?m)^[ \t]*(?:#{1,6}[ \t]|[-+*•][ \t]|\d+[.)][ \t]|={1,6}[^=]|\*+|```|~~~|\{\||\||\\)|\n[ \t]*\n|'''|\[\[|\*\*|__|\\[a-zA-Z&%_*<#$]|\]\(")


def blocks(body: str | None, voted: dict[str, str] | None = None, links: Counter | None = None) -> list[tuple[str, str, str, str]]:
    """(path, kind, text, dialect) of a body, in order; comments, head, styles and programs give none.

    ``links`` is told the characters that stand in links, by path.
    """
    found: list[tuple[str, str, str, str]] = []
    if not body:
        return found
    stack: list[tuple[str, str]] = []  # tag, and the path down to it
    lists: list[list[str] | None] = []
    heading: list[str] | None = None
    flow: list[str] = []
    in_link = False

    def path() -> str:
        return stack[-1][1] if stack else "-"

    def emit(kind: str, text: str) -> None:
        if text:
            found.append((path(), kind, text, ""))

    def run(pieces: list[str], kind: str) -> None:
        raw = "".join(pieces)
        if "$" not in raw and "\\" not in raw:
            emit(kind, _bare(html.unescape(raw) if "&" in raw else raw))
            return
        formulas: list[tuple[str, str]] = []
        parts = _lift_math(raw, formulas, html.unescape)
        for k, t in formulas:
            emit(k, t)
        emit(kind, _bare(html.unescape(parts)))

    def flush() -> None:
        if not flow:
            return
        raw = "".join(flow)
        flow.clear()
        if not raw or raw.isspace():
            return
        here = path()
        # text stands raw only outside paragraphs and cells, and fills more than a line unless it is all there is
        loose = not stack or (stack[-1][0] in _LOOSE and "\n" in raw.strip(" "))
        if "\ue002" in raw or (loose and _LOOKS_RAW.search(raw)):
            read, shown = read_text(raw, (voted or {}).get(here, ""))
            found.extend((here, kind, text, shown) for kind, text in read)
        else:
            run([raw.replace("\ue002", " ")], "text")

    def put(piece: str) -> None:
        if not piece:
            return
        if heading is not None:
            heading.append(piece)
        elif lists and lists[-1] is not None:
            lists[-1].append(piece)
        else:
            flow.append(piece)

    def close_item() -> None:
        if lists and lists[-1] is not None:
            pieces, lists[-1] = lists[-1], None
            run(pieces, "list_item")

    at = 0
    for m in _TOKEN.finditer(body):
        begin, end = m.span()
        if begin > at:
            piece = body[at:begin]
            put(piece)
            if in_link and links is not None:
                links[path()] += len(piece.strip())
        at = end
        which = m.lastgroup
        if which is None:
            continue
        if which == "inner":
            raw, inner = m["raw"].lower(), m["inner"]
            if raw == "math" or (raw == "script" and "math/tex" in m["rawattr"].lower()):
                t = squeeze(html.unescape(_TAG_INSIDE.sub("", inner)) if raw == "math" else inner)
                emit("formula", t)
                put(f"{_OPEN}{t}{_SHUT}" + ("\ue002" if raw == "math" and not stack else ""))
            elif raw in ("pre", "syntaxhighlight", "source"):
                code = _TAG_INSIDE.sub(lambda x: "" if re.match(r"</?(?:code|span|b|i|em|strong|a|br|tt|font|mark)\b", x[0], re.I) else x[0], inner) if raw == "pre" else inner
                emit("code_block", squeeze(html.unescape(code)))
                put("\n\n\ue002" if raw != "pre" and heading is None and not (lists and lists[-1] is not None) else "\n\n")
            continue
        close, tag, attr = m.group("close", "tag", "attr")
        tag = tag.lower()
        if tag == "a":
            in_link = not close
            continue
        if tag == "wbr":
            continue
        if tag == "br":
            put("\n")
            continue
        if tag not in _BLOCK_TAGS:
            continue
        closing = close == "/"
        if tag in ("ul", "ol", "menu"):
            if heading is None and not lists:
                flush()
            if closing:
                close_item()
                if lists:
                    lists.pop()
            else:
                lists.append(None)
        elif tag == "li":
            if not lists and not closing:
                flush()
                lists.append(None)
            close_item()
            if not closing and lists:
                lists[-1] = []
        elif tag in _HEADING_TAGS:
            if closing:
                if heading is not None:
                    pieces, heading = heading, None
                    run(pieces, "heading")
            else:
                if not lists:
                    flush()
                heading = []
        elif heading is not None or (lists and lists[-1] is not None):
            put("  " if tag in ("td", "th") else " ")
        elif tag in ("td", "th"):
            if closing:
                put("\t")
        else:
            flush()
        if tag in ("hr", "meta", "link", "base"):
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        else:
            if tag in ("p", "li") and stack and stack[-1][0] == tag:
                stack.pop()
            c = _CLASS.search(attr) if attr else None
            label = f"{tag}.{re.sub(r'[0-9]+', '#', c[1])}" if c else tag
            stack.append((tag, f"{stack[-1][1]}/{label}" if stack else label))
    put(body[at:])
    if heading is not None:
        run(heading, "heading")
        heading = None
    while lists:
        close_item()
        lists.pop()
    flush()
    return found


def visible_text(body: str | None) -> str:
    """What a reader sees, one block a line."""
    return "\n".join(text for _, _, text, _ in blocks(body))


# ------------------------------------------------------------- consensus in Spark


def _host(from_addr) -> str:
    m = re.search(r"@([\w.-]+)", from_addr or "")
    return m[1].lower() if m else ""


#: What a heading, code block or formula weighs in a container's score, in characters; menus are lists, so items weigh their text.
BLOCK_WEIGHT = 20


def _votes(found: list[tuple[str, str, str, str]], links: Counter) -> dict[str, tuple[bool, bool]]:
    """(votes for it, holds links) of each container path of one page.

    A page votes for a container whose text outside links and structure outweigh its links.
    """
    scores: Counter = Counter()
    for path, kind, text, _ in found:
        scores[path] += len(text) + (BLOCK_WEIGHT if kind in KINDS and kind != "list_item" else 0)
    return {path: (n > 2 * links[path], links[path] > 0) for path, n in scores.items()}


def _dialect_votes(found: list[tuple[str, str, str, str]]) -> Counter:
    votes: Counter = Counter()
    for path, kind, _, shown in found:
        if shown:
            votes[path, shown] += 3 if kind in KINDS else 1
    return votes


def _waits(found: list[tuple[str, str, str, str]], body: str | None) -> bool:
    """Lone '#' lines in text of no clear dialect wait for the vote."""
    return any(s == "" and k in ("heading", "list_item") for _, k, _, s in found) and bool(_HASH_LINE.search(body or ""))


#: One schema for all that a first reading tells.  ``what`` is an element's kind, 'clean' (a rendered page), 'path' (a container
#: of a page that waits), 'body' (the page itself), 'dialect' (votes for one) or 'vote' (pages for and against a container).
_READ_SCHEMA = "page bigint, delivery_id bigint, host string, path string, what string, content string, linked boolean, n bigint, against bigint"
_READ_COLUMNS = ["page", "delivery_id", "host", "path", "what", "content", "linked", "n", "against"]


def _first_reading(render: bool):
    """Elements (or rendered text), votes, and the pages that wait for the vote."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            dialects: Counter = Counter()
            good: Counter = Counter()
            bad: Counter = Counter()
            for page, delivery_id, from_addr, body in zip(pdf["page"], pdf["delivery_id"].astype(object), pdf["from_addr"], pdf["body_html"], strict=True):
                delivery_id = None if pd.isna(delivery_id) else delivery_id
                host, links = _host(from_addr), Counter()
                found = blocks(body, None, links)
                votes = _votes(found, links)
                for path, (good_here, _) in votes.items():
                    (good if good_here else bad)[host, path] += 1
                for (path, shown), n in _dialect_votes(found).items():
                    dialects[host, path, shown] += n
                undecided = _waits(found, body)
                # a container without links never loses, so only pages with links or of open dialect wait
                if undecided or (render and links):
                    rows.append((page, delivery_id, host, None, "body", body, None, None, None))
                    rows.extend((page, None, host, path, "path", None, linked, None, None) for path, (_, linked) in votes.items())
                elif render:
                    rows.append((None, delivery_id, None, None, "clean", None if body is None else _render(found), None, None, None))
                if not undecided and not render:
                    rows.extend((None, delivery_id, host, p, k, t, votes[p][1], None, None) for p, k, t in {(p, k, t) for p, k, t, _ in found if k in KINDS})
            rows.extend((None, None, host, path, "dialect", shown, None, n, None) for (host, path, shown), n in dialects.items())
            rows.extend((None, None, host, path, "vote", None, None, good[host, path], bad[host, path]) for host, path in good.keys() | bad.keys())
            frame = pd.DataFrame(rows, columns=_READ_COLUMNS, dtype=object)
            yield frame.astype({"page": "Int64", "delivery_id": "Int64", "n": "Int64", "against": "Int64", "linked": "boolean"})

    return run


def _read_first(messages: DataFrame, render: bool) -> DataFrame:
    rows = messages.select(F.monotonically_increasing_id().alias("page"), "delivery_id", "from_addr", "body_html")
    where = scratch_path(messages.sparkSession, "markup")
    rows.mapInPandas(_first_reading(render), _READ_SCHEMA).write.parquet(where)
    return messages.sparkSession.read.schema(_READ_SCHEMA).parquet(where)


def containers(read: DataFrame) -> DataFrame:
    """(host, path, pages_for, pages_against, wins, dialect): the hosts' votes on their containers."""
    votes = read.where("what = 'vote'").groupBy("host", "path").agg(F.sum("n").alias("pages_for"), F.sum("against").alias("pages_against"))
    sums = read.where("what = 'dialect'").groupBy("host", "path", F.col("content").alias("dialect")).agg(F.sum("n").alias("n"))
    dialects = sums.groupBy("host", "path").agg(F.max_by("dialect", F.struct("n", "dialect")).alias("dialect"))
    return votes.join(dialects, ["host", "path"], "left").withColumn("wins", F.col("pages_for") >= F.col("pages_against"))


def _again(read: DataFrame, voted: DataFrame) -> DataFrame:
    """Pages that waited, each with the votes on its own containers."""
    mine = read.where("what = 'path'").select("page", "host", "path", "linked").join(voted.select("host", "path", "wins", "dialect"), ["host", "path"])
    mine = mine.groupBy("page").agg(F.collect_list(F.struct("path", "dialect", (~F.col("wins") & F.col("linked")).alias("lost"))).alias("votes"))
    return read.where("what = 'body'").select("page", "delivery_id", "content").join(mine, "page", "left").select("delivery_id", F.col("content").alias("body"), "votes")


def _vote_maps(votes) -> tuple[dict[str, str], set[str]]:
    votes = [] if votes is None else votes
    return {v["path"]: v["dialect"] for v in votes if v["dialect"]}, {v["path"] for v in votes if v["lost"]}


_SECOND_SCHEMA = "delivery_id bigint, element string, element_text string, chosen boolean"


def _second_reading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for delivery_id, body, votes in zip(pdf["delivery_id"], pdf["body"], pdf["votes"], strict=True):
            dialects, lost = _vote_maps(votes)
            rows.extend((delivery_id, k, t, p not in lost) for p, k, t in {(p, k, t) for p, k, t, _ in blocks(body, dialects) if k in KINDS})
        yield pd.DataFrame(rows, columns=["delivery_id", "element", "element_text", "chosen"])


def structure(messages: DataFrame, fallback: bool = True) -> DataFrame:
    """(delivery_id, element, element_text, chosen), distinct: the structure of body_html.

    A container wins on its host if at least as many pages vote for it as against
    it; ``chosen`` elements are those of winning containers, and of containers that
    hold no link on their page.  The others come out by the ``fallback``, which may
    be switched off: then the elements of losing containers, such as menus of links,
    are left out.  Texts whose dialect their own lines leave open are read again in
    the dialect that won for their path and host.

    Votes are summed inside each batch before they leave Python, so the shuffle
    holds a row per host, path and batch.  Null and empty bodies give no row, and
    neither do elements without text; repeated rows of a delivery give the same
    rows once.
    """
    read = _read_first(messages.where("body_html is not null and delivery_id is not null"), render=False)
    voted = containers(read)
    second = _again(read, voted).mapInPandas(_second_reading, _SECOND_SCHEMA)
    first = read.where(F.col("what").isin(*KINDS)).select("delivery_id", F.col("what").alias("element"), F.col("content").alias("element_text"), "host", "path", "linked")
    # only containers with links can lose, so the others need no join
    free = first.where("not linked").select("delivery_id", "element", "element_text", F.lit(True).alias("chosen"))
    linked = first.where("linked").join(voted.select("host", "path", "wins"), ["host", "path"]).select("delivery_id", "element", "element_text", F.col("wins").alias("chosen"))
    every = free.unionByName(linked).unionByName(second).where(F.col("chosen") | F.lit(fallback))
    return every.groupBy("delivery_id", "element", "element_text").agg(F.max("chosen").alias("chosen"))


_MARKS = {"heading": "# {}", "list_item": "- {}", "code_block": "```\n{}\n```", "formula": "$${}$$", "text": "{}"}


def _render(found: list[tuple[str, str, str, str]]) -> str:
    return "\n".join(_MARKS[k].format(t) for _, k, t, _ in found)


def _second_rendering(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        clean = []
        for body, votes in zip(pdf["body"], pdf["votes"], strict=True):
            dialects, lost = _vote_maps(votes)
            clean.append(_render([b for b in blocks(body, dialects) if b[0] not in lost]))
        yield pd.DataFrame({"delivery_id": pdf["delivery_id"].astype("Int64"), "clean": pd.Series(clean, dtype=object)})


def clean_text(messages: DataFrame) -> DataFrame:
    """(delivery_id, clean): readable text; headings, items, code and formulas keep their marks.

    Pages are read as in ``structure``, without the fallback: a container that lost
    its host's vote and holds links on the page is left out.  A row comes out for
    each row; a null body stays null.
    """
    read = _read_first(messages, render=True)
    second = _again(read, containers(read)).mapInPandas(_second_rendering, "delivery_id bigint, clean string")
    return read.where("what = 'clean'").select("delivery_id", F.col("content").alias("clean")).unionByName(second)
