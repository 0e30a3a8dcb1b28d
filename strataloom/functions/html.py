"""Documents from HTML: a small tree, safe Markdown (H30-H42) and the index of assets.

The tree keeps to the HTML rules that matter for answers: void and raw-text elements, implied ends of p, li and
similar, misnested inline ends, html, head and body tags ignored, template contents left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strataloom.functions import urls

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IGNORED = frozenset("html head body".split())
#: Fixed value: elements that stand in blocks of their own.
BLOCKS = frozenset(
    """p div h1 h2 h3 h4 h5 h6 ul ol li blockquote pre hr figure table thead tbody tfoot tr td th section article aside header footer main dl dt dd
    details summary nav""".split()
)
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figcaption".split())
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = frozenset("ul ol dl table td th figure blockquote div template".split())
_WS = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in IGNORED:
            return
        if tag in _CLOSES_P:
            self._close("p", _SCOPE - {"div", "figure", "blockquote"} | {"button"})
        if tag in _IMPLIED:
            self._imply(_IMPLIED[tag])
        if tag == "a":
            self._close("a", _SCOPE)
        first: dict[str, str] = {}
        for name, value in attrs:
            first.setdefault(name.lower(), value or "")
        node = Node(tag, first)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br"))
            return
        if tag in VOID or tag in IGNORED:
            return
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self.open[-1].children.append(Node("p"))
            return
        self._close(tag, frozenset())

    def handle_data(self, data: str) -> None:
        here = self.open[-1].children
        if here and isinstance(here[-1], str):
            here[-1] += data
        elif data:
            here.append(data)

    def _imply(self, tags: set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in _SCOPE - {"td", "th", "div"}:
                return

    def _close(self, tag: str, scope: frozenset[str] | set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                rest = self.open[k + 1 :]
                del self.open[k:]
                # inline elements that were closed too early go on, as the adoption rule has it
                if tag in _INLINE:
                    for node in rest:
                        if node.tag in _INLINE:
                            again = Node(node.tag, dict(node.attrs))
                            self.open[-1].children.append(again)
                            self.open.append(again)
                return
            if self.open[k].tag in scope:
                return


_INLINE = frozenset("a b big code em font i nobr s small strike strong tt u".split())


def tree(source: str | None) -> Node:
    builder = _Builder()
    builder.feed(source or "")
    builder.close()
    for node in _walk(builder.root):
        if node.tag == "template":
            node.children = []
        if node.tag == "pre" and node.children and isinstance(node.children[0], str) and node.children[0].startswith("\n"):
            node.children[0] = node.children[0][1:]
    return builder.root


def _walk(node: Node) -> Iterator[Node]:
    for child in node.children:
        if isinstance(child, Node):
            yield child
            yield from _walk(child)


def escape_text(text: str) -> str:
    """H20 for one string; see ``text.escape_markdown``."""
    out = re.sub(r"([\\`*_\[\]{}()#+.!|>~<-])", r"\\\1", text)
    out = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "\ufffd", out)
    lines = []
    for line in out.split("\n"):
        m = re.match(rf"( {{0,3}})=+[{_WS}]*\Z", line)
        if m:
            line = m[1] + "\\" + line[len(m[1]) :]
        lines.append("\u00a0" + line[1:] if line[:1] in (" ", "\t") and line else line)
    return "\n".join(lines)


def language(code: Node) -> str | None:
    """The language a code element names, if it is a plain word of up to 40 characters."""
    classes = code.attrs.get("class", "")
    if re.search(r"[\x00-\x1f\x7f]", classes):
        return None
    m = re.search(r"(?:^|\s)(?:language-|lang-)([A-Za-z0-9_+-]+)", classes)
    name = m[1] if m else code.attrs.get("data-language", "").strip()
    return name if re.fullmatch(r"[A-Za-z0-9_+-]{1,40}", name) else None


def _code_of(pre: Node) -> Node | None:
    return next((c for c in pre.children if isinstance(c, Node) and c.tag == "code"), None)


def _run(text: str) -> int:
    return max(map(len, re.findall("`+", text)), default=0)


class Renderer:
    """Safe Markdown of one answer; ids of footnotes hold the answer's id."""

    def __init__(self, answer_id: str | None = None, heading_offset: int = 2, site: urls.Site = urls.Site(), external: str = "打开外部链接", caption: str = "原文链接文字：", image: str = "图片") -> None:
        self.answer = answer_id if answer_id and re.fullmatch(r"[0-9]{1,20}", answer_id) else None
        self.offset, self.site = heading_offset, site
        self.external, self.caption, self.image = external, caption, image
        self.notes: list[tuple[str, str]] = []

    def __call__(self, source: str | None) -> str:
        body = self.blocks(tree(source).children).strip(_WS)
        if not self.notes:
            return body
        return body + "\n\n" + "\n\n".join(f"[^{name}]: {text}".rstrip(_WS) for name, text in self.notes)

    def link(self, raw: str | None) -> str:
        found = urls.classify(raw, self.site) if raw else None
        return f"[{self.external} · {found['display_host']}]({urls.safe_destination(found['canonical_url'])})" if found else ""

    def plain(self, text: str) -> str:
        """Text with its bare addresses as explicit links."""
        return "".join(escape_text(part) if kind == "text" else self.link(part) or escape_text(part) for kind, part in urls.tokenize(text))

    def inline(self, nodes: list[Node | str]) -> str:
        return "".join(self.plain(n) if isinstance(n, str) else self.inline_node(n) for n in nodes)

    def inline_node(self, node: Node) -> str:
        """H32, H36-H38, H41."""
        tag = node.tag
        if tag == "br":
            return "\n"
        if tag in ("strong", "b", "em", "i"):
            text, mark = self.inline(node.children).strip(_WS), "**" if tag in ("strong", "b") else "*"
            return f"{mark}{text}{mark}" if text else ""
        if tag == "code":
            text = node.text()
            fence = "`" * (_run(text) + 1)
            pad = " " if not text or text[0] == "`" or text[-1] == "`" else ""
            return f"{fence}{pad}{text}{pad}{fence}"
        if tag == "a":
            text = self.inline(node.children).strip(_WS)
            parts = [f"{self.caption}{text}" if text else "", self.link(node.attrs.get("href"))]
            return "\n".join(p for p in parts if p)
        if tag == "img":
            alt = node.attrs.get("alt", "").strip(_WS)
            return f"[{self.image}：{escape_text(alt)}]" if alt else f"[{self.image}]"
        if tag == "sup" and self.answer and ("data-numero" in node.attrs or "data-text" in node.attrs):
            name = f"a{self.answer}-r{len(self.notes) + 1}"
            self.notes.append((name, ""))
            body = re.sub(r"[\r\n]+", " ", self.plain(node.attrs.get("data-text", "")))
            link = self.link(node.attrs.get("data-url", "").strip(_WS))
            self.notes[-1] = (name, " ".join(p for p in (body, link) if p))
            return f"[^{name}]"
        if tag in ("script", "style"):
            return ""
        return self.inline(node.children)

    def parts(self, nodes: list[Node | str], tight: bool = False) -> list[str]:
        """Blocks, and runs of inline content between them."""
        out: list[str] = []
        line: list[str] = []

        def flush() -> None:
            text = "".join(line).strip(_WS)
            line.clear()
            if text:
                out.append(text)

        for node in nodes:
            if isinstance(node, Node) and node.tag in BLOCKS:
                flush()
                text = self.block(node)
                if tight or text.strip(_WS):
                    out.append(text)
            else:
                line.append(self.plain(node) if isinstance(node, str) else self.inline_node(node))
        flush()
        return out

    def blocks(self, nodes: list[Node | str]) -> str:
        return "\n\n".join(self.parts(nodes))

    def block(self, node: Node) -> str:
        """H33-H35, H39, H40, H42."""
        tag = node.tag
        if re.fullmatch("h[1-6]", tag):
            return f"{'#' * min(int(tag[1]) + self.offset, 6)} {self.blocks(node.children)}"
        if tag in ("ul", "ol"):
            return self.items(node)
        if tag == "blockquote":
            text = self.blocks(node.children)
            return "\n".join(f"> {x}" if x else ">" for x in text.split("\n")) if text else ""
        if tag == "pre":
            code = _code_of(node)
            text = (code or node).text()
            name = language(code) if code else None
            fence = "`" * max(_run(text) + 1, 3)
            return f"{fence}{' ' + name if name else ''}\n{text}\n{fence}"
        if tag == "hr":
            return "---"
        if tag in ("script", "style"):
            return ""
        if tag == "figure":
            found = []
            for child in node.children:
                if isinstance(child, Node):
                    text = self.inline_node(child) if child.tag == "img" else self.blocks(child.children) if child.tag == "figcaption" else self.block(child)
                    if text.strip(_WS):
                        found.append(text)
            return "\n\n".join(found)
        return self.blocks(node.children)

    def items(self, node: Node) -> str:
        """Markers, numbers from ``start``, later lines under the text."""
        number = int(node.attrs["start"]) if node.tag == "ol" and re.fullmatch(r"[0-9]{1,6}", node.attrs.get("start", "")) else 1
        out = []
        for child in node.children:
            if not isinstance(child, Node):
                continue
            if child.tag != "li":
                text = self.block(child)
                if text.strip(_WS):
                    out.append(text)
                continue
            mark = f"{number}." if node.tag == "ol" else "-"
            first, *later = "\n".join(self.parts(child.children, tight=True)).split("\n")
            out += [f"{mark} {first}"] + [" " * (len(mark) + 1) + x for x in later]
            number += 1
        return "\n".join(out)


def to_markdown(source: str | None, answer_id: str | None = None, heading_offset: int = 2, site: urls.Site = urls.Site()) -> str:
    return Renderer(answer_id, heading_offset, site)(source)


# ---------------------------------------------------------------- assets


def _number(value: str | None) -> float | None:
    try:
        return float(value) if value and value.strip() else None
    except ValueError:
        return None


class _Assets:
    def __init__(self, site: urls.Site) -> None:
        self.site = site
        self.images: list[dict] = []
        self.links: list[dict] = []
        self.references: list[dict] = []
        self.code: list[dict] = []

    def walk(self, node: Node) -> None:
        """All elements in document order."""
        for child in node.children:
            if not isinstance(child, Node):
                continue
            if child.tag == "figure":
                self.figure(child)
                continue
            if child.tag == "img":
                self.image(child, None)
            elif child.tag == "a":
                self.link(child)
            elif child.tag == "sup" and ("data-numero" in child.attrs or "data-text" in child.attrs):
                self.references.append({"source_numero": child.attrs.get("data-numero"), "text": child.attrs.get("data-text", "")})
            elif child.tag == "pre":
                code = _code_of(child)
                text = (code or child).text()
                self.code.append({"language": (language(code) if code else None) or "", "lines": text.count("\n") + 1 if text else 0})
            self.walk(child)

    def figure(self, node: Node) -> None:
        """Images of a figure carry its caption; its other assets are found as usual."""
        caption, images = None, []
        for child in node.children:
            if isinstance(child, Node):
                if child.tag == "figcaption":
                    caption = child.text().strip(_WS) or caption
                elif child.tag == "img":
                    images.append(child)
                else:
                    images += [x for x in _walk(child) if x.tag == "img"]
        for image in images:
            self.image(image, caption)
        self.walk(node)

    def candidate(self, node: Node) -> dict | None:
        """The first usable of the three addresses; a size of 1 by 1 discards one candidate only."""
        tiny = _number(node.attrs.get("width")) == 1 and _number(node.attrs.get("height")) == 1
        for name in ("data-original", "data-actualsrc", "src"):
            url = node.attrs.get(name, "").strip(_WS)
            if not re.match(r"https?://", url, re.I) or urls.parse(url) is None or (name == "src" and not re.match("https://", url, re.I)):
                continue
            if tiny:
                tiny = False
                continue
            found = urls.classify_image(url, self.site)
            if found:
                return found
        return None

    def image(self, node: Node, caption: str | None) -> None:
        """H52."""
        found = self.candidate(node)
        if found is None or any(x["original_url"] == found["original_url"] for x in self.images):
            return
        size = {n: int(v) if (v := _number(node.attrs.get(n))) is not None and 0 <= v < 2**53 else None for n in ("width", "height")}
        text = caption if caption is not None else node.attrs.get("alt", "").strip(_WS)
        self.images.append({"host": found["host"], "original_url": found["original_url"], **size, "caption": text or None, "clickable": found["clickable"], "security_class": found["security_class"]})

    def link(self, node: Node) -> None:
        """Refused links stay, marked."""
        raw = node.attrs.get("href", "").strip(_WS)
        if not raw:
            return
        found = urls.classify(raw, self.site)
        self.links.append(
            {
                "original_url": raw,
                "canonical_url": found["canonical_url"] if found else None,
                "domain": found["display_host"] if found else None,
                "clickable": bool(found),
                "security_class": found["security_class"] if found else "rejected",
                "redirect_target": found["redirect_target"] if found else None,
            }
        )


def assets(source: str | None, site: urls.Site = urls.Site()) -> dict:
    """Images, links, references and code blocks of one answer; videos are always empty (K4)."""
    found = _Assets(site)
    found.walk(tree(source))
    return {"images": found.images, "links": found.links, "references": found.references, "code_blocks": found.code, "videos": []}


ASSETS_TYPE = (
    "struct<images:array<struct<host:string,original_url:string,width:bigint,height:bigint,caption:string,clickable:boolean,security_class:string>>,"
    "links:array<struct<original_url:string,canonical_url:string,domain:string,clickable:boolean,security_class:string,redirect_target:string>>,"
    "references:array<struct<source_numero:string,text:string>>,code_blocks:array<struct<language:string,lines:bigint>>,videos:array<string>>"
)


def rich_markdown(html: Column, answer_id: Column, heading_offset: int = 2, site: urls.Site = urls.Site()) -> Column:
    """H30-H42 over a column; null counts as empty."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, ids in batches:
            yield pd.Series([to_markdown(t, a, heading_offset, site) for t, a in zip(texts, ids)], dtype=object)

    return run(html, answer_id)


def extract_assets(html: Column, site: urls.Site = urls.Site()) -> Column:
    """H50-H56 over a column, as one struct of arrays; null counts as empty."""

    @F.udf(ASSETS_TYPE, useArrow=True)
    def run(text: str | None):
        return assets(text, site)

    return run(html)


def project_code(markdown: Column) -> Column:
    """K1: fenced code of rendered Markdown replaced by a note of its language and lines."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else _omit_code(t) for t in texts], dtype=object)

    return run(markdown)


_FENCED = re.compile(r"^(?P<fence>`{3,})(?: (?P<lang>[^\n`]*))?\n(?P<body>.*?)\n(?P=fence)$", re.M | re.S)


def _omit_code(text: str) -> str:
    return _FENCED.sub(lambda m: f"[CODE_BLOCK language={m['lang'] or 'unknown'} lines={m['body'].count(chr(10)) + 1 if m['body'] else 0} omitted_by_policy]", text)
