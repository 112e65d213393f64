"""Plain text, title and links of an HTML page, in one pass over its tags."""

from __future__ import annotations

import html
import re

#: Outside of quotes a tag holds no further `<`, so that a page of tags that never end is passed over in one go.
_TAG = re.compile(r"""<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^'"<>]++|"[^"]*"|'[^']*')*+)>|<[!?/][^<>]*+>""")
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: An element's own slash at its end; that of an unquoted value belongs to the value.
_CLOSED = re.compile(r"""(?<!=)(?<!=\s)(?:^|[\s"'])[^\s"'=]*/$""")
_BLANKS = "\t\r\f\v\xa0"
_HIDDEN = frozenset(("script", "style", "noscript", "template", "svg", "iframe", "textarea"))
_BLOCKS = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select table title tr ul".split())


_HIDES, _TITLE, _BREAK, _CELL, _LINK, _PLAIN = range(1, 7)
_KINDS = dict.fromkeys(_HIDDEN, _HIDES) | dict.fromkeys(_BLOCKS, _BREAK) | {"title": _TITLE, "td": _CELL, "th": _CELL, "a": _LINK}


def _collapsed(text: str) -> str:
    """Runs of blanks, line feeds aside, as one space; each turn halves the longest run."""
    for x in _BLANKS:
        text = text.replace(x, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def page_text(page: str) -> tuple[str, str, list[str]]:
    """Text (a line for each block, blanks collapsed, empty lines left out), title, and links in order.

    Comments, scripts, styles and the like are left out to their end tag, or to the end of the page where that
    is missing; an svg that closes itself hides nothing. A `<` that opens no tag is text.
    """
    out: list[str] = []
    title: list[str] = []
    links: list[str] = []
    into, at, search, kind_of = out, 0, _TAG.search, _KINDS.get
    while m := search(page, at):
        start, end = m.span()
        if start > at:
            into.append(page[at:start])
        at = end
        closing, name, attributes = m.groups()
        if name is None:
            if page.startswith("<!--", start):
                end = page.find("-->", at)
                at = len(page) if end < 0 else end + 3
            continue
        kind = kind_of(name) or kind_of(name.lower(), _PLAIN)
        if kind == _BREAK:
            into.append("\n")
        elif kind == _LINK:
            if not closing and (href := _HREF.search(attributes)):
                links.append(html.unescape(href[1] or href[2] or href[3] or "").strip())
        elif kind == _CELL:
            into.append(" ")
        elif kind == _TITLE:
            into = out if closing else title
        elif kind == _HIDES and not closing and not (name.lower() == "svg" and _CLOSED.search(attributes)):
            end = re.compile(f"</{name}\\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
    into.append(page[at:])
    lines = map(str.strip, _collapsed(html.unescape("".join(out))).split("\n"))
    return "\n".join(filter(None, lines)), " ".join(html.unescape("".join(title)).split()), list(filter(None, links))
