"""A small, forgiving HTML reader: tokens in page order, each character read a bounded number of times."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:"[^"]*+"|'[^']*+'|[^>])*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)}


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes as written), ("close", name, ""). Text of RAW elements comes as ("raw", text, name)."""
    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if not m:
            yield "text", unescape(html[at:]), ""
            return
        if m.start() > at:
            yield "text", unescape(html[at : m.start()]), ""
        at = m.end()
        if m["name"] is None:
            if m[0].startswith("<![CDATA["):
                yield "text", m[0][9:].removesuffix("]]>"), ""
            continue
        name = m["name"].lower()
        if m["end"]:
            yield "close", name, ""
            continue
        yield "open", name, m["rest"]
        if name in RAW and not m["rest"].endswith("/"):
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
            yield "raw", html[at : end.start() if end else n], name
            yield "close", name, ""
            at = end.end() if end else n
