"""Paragraphs of pages: from extracted content, or from html where there is none."""

from __future__ import annotations

import html as entities
import re

import xxhash

_DROP = re.compile(r"<!--.*?-->|<(script|style|template|textarea|svg)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b([^<>]*)>")
_BLOCKS = frozenset("div main article aside footer header section nav figure ul ol table form body".split())
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+|:")


def clean(text: str) -> str:
    """Entities resolved, white space collapsed."""
    return " ".join((entities.unescape(text) if "&" in text else text).split())


def paragraphs(content: str | None) -> list[str]:
    """The texts between blank lines."""
    if not content:
        return []
    return [p for p in _BLANK.split(content.strip("\n")) if p.strip()]


def parse(page: str | None) -> tuple[list[tuple[str, int]], str]:
    """The p elements in order of their opening tags, each with the number of the block it stands in (two p elements have the same
    number if the same block element holds them), and the other text of the body outside navigation. A p ends at its closing tag, at the
    next p, or where its block ends; tag case and forgotten closing tags don't matter. Null and broken html give what can be read."""
    if not page:
        return [], ""
    page = _DROP.sub(" ", page)
    at = re.search(r"<body\b", page, re.I)
    out: list[tuple[str, int]] = []
    rest: list[str] = []
    stack: list[tuple[str, int]] = [("body", 0)]
    blocks, buffer, holder, pos, away = 0, None, 0, at.start() if at else 0, 0

    def close() -> None:
        nonlocal buffer
        if buffer is not None:
            out.append((clean("".join(buffer)), holder))
            buffer = None

    for m in _TAG.finditer(page, pos):
        text = page[pos : m.start()]
        pos = m.end()
        if buffer is not None:
            buffer.append(text)
        elif not away and text.strip():
            rest.append(text)
        name, ends = m[2].lower(), m[1]
        if name == "p":
            close()
            if not ends:
                buffer, holder = [], stack[-1][1]
        elif name == "br" and buffer is not None:
            buffer.append(" ")
        elif name in _BLOCKS:
            close()
            if not ends:
                blocks += 1
                stack.append((name, blocks))
                away += name in ("nav", "ul", "ol", "footer", "aside")
            elif any(n == name for n, _ in stack[1:]):
                while True:
                    n, _ = stack.pop()
                    away -= n in ("nav", "ul", "ol", "footer", "aside")
                    if n == name:
                        break
    if buffer is not None:
        buffer.append(page[pos:])
    elif not away:
        rest.append(page[pos:])
    close()
    return out, clean(" ".join(rest))


def main_block(ps: list[tuple[str, int]]) -> int:
    """The block that holds most of the paragraphs' text, long paragraphs counting in full and short ones by a tenth."""
    weight: dict[int, float] = {}
    for text, block in ps:
        weight[block] = weight.get(block, 0) + (len(text) if len(text) >= 120 else len(text) / 10)
    return max(weight, key=weight.get) if weight else -1


def digest(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >= 1 << 63 else h


def line_shape(text: str, site: str = "") -> str:
    """The form that a line shares with its like on other pages: numbers, codes, names and the site's own name are masked; of a line
    like "Label: headline" only the label counts. Long texts are compared as they stand."""
    if len(text) > 260:
        return text
    out: list[str] = []
    toks = _WORD.findall(text)
    for i, t in enumerate(toks):
        if t == ":":
            if 0 < len(out) <= 5 and i <= 6 and not text.rstrip().endswith((".", "!", "?")):
                return " ".join(out) + " :"
            continue
        low = t.lower()
        if t[0].isdigit():
            k = "#"
        elif low == site:
            k = "N"
        elif t[0].isupper() and not (t.isupper() and len(toks) > 1 and text.isupper()) and (i > 0 or (len(toks) > 1 and toks[1][0].isupper())):
            k = "N"
        else:
            k = low
        if k in ("N", "#") and out and out[-1] == k:
            continue
        out.append(k)
    return " ".join(out)
