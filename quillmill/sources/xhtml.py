"""Segmentation of XHTML documents into translatable hosts.

Written on the standard library's tolerant parser; used inside Arrow batches, one document at a time. A
document becomes a small tree; orphaned inline runs beside blocks are wrapped, the innermost blocks are the
hosts, and a host's content becomes text in which every inline tag is a numbered placeholder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from quillmill.functions.text import ENTITIES

# Tags that hold text, tags whose content is not text, tags without content.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li td th figcaption blockquote dt dd caption div section article aside header footer main".split())
SKIPPED = frozenset("code pre script style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new tag of the key ends an open tag of the value (tag soup).
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
MARK = re.compile(r"\[\[(/?)T(\d+)\]\]")
_INVISIBLE = re.compile(r"[​‌‍⁠﻿]")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: "Node | None" = None

    def walk(self) -> Iterator["Node"]:
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.walk()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def add(self, child) -> None:
        if isinstance(child, Node):
            child.parent = self
        self.children.append(child)

    @property
    def entity(self) -> bool:
        return self.tag.startswith("&")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        closes = _CLOSES.get(tag, {"p"} if tag in BLOCKS else set())
        if self.at.tag in closes:
            self.at = self.at.parent
        node = Node(tag, {k: v if v is not None else "" for k, v in attrs})
        self.at.add(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.add(Node(tag, {k: v if v is not None else "" for k, v in attrs}))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.add(data)

    def handle_entityref(self, name):
        self.at.add(ENTITIES[name] if name in ENTITIES else Node(f"&{name};"))

    def handle_charref(self, name):
        try:
            self.at.add(chr(int(name[1:], 16) if name[:1] in "xX" else int(name)))
        except (ValueError, OverflowError):
            self.at.add("�")


def parse(markup: str) -> Node:
    b = _Builder()
    b.feed(markup)
    b.close()
    return b.root


def _skipped(n: Node | None) -> bool:
    while n is not None:
        if n.tag in SKIPPED:
            return True
        n = n.parent
    return False


def wrap_orphans(root: Node) -> int:
    """Inline runs beside blocks of one parent go into a div of their own; a second run changes nothing."""
    made = 0
    for n in list(root.walk()):
        if n.tag not in BLOCKS or _skipped(n):
            continue
        is_block = [isinstance(c, Node) and c.tag in BLOCKS for c in n.children]
        if not any(is_block):
            continue
        out, run = [], []

        def flush():
            nonlocal made
            if any(c.strip() if isinstance(c, str) else c.entity or c.text().strip() for c in run):
                w = Node("div", {"class": n.attrs["class"]} if "class" in n.attrs else {}, parent=n)
                for c in run:
                    w.add(c)
                out.append(w)
                made += 1
            else:
                out.extend(run)
            run.clear()

        for c, block in zip(n.children, is_block):
            if block:
                flush()
                out.append(c)
            else:
                run.append(c)
        flush()
        n.children = out
    return made


def _lang(n: Node | None) -> str | None:
    while n is not None:
        lang = n.attrs.get("lang") or n.attrs.get("xml:lang")
        if lang:
            return re.split("[-_]", lang.lower())[0]
        n = n.parent
    return None


def hosts(root: Node, target_lang: str | None = None) -> list[Node]:
    """Innermost blocks outside skipped tags; hosts already in the target language are left out."""
    out = []
    primary = re.split("[-_]", target_lang.lower())[0] if target_lang else None

    def visit(n: Node, skipped: bool) -> bool:
        skipped = skipped or n.tag in SKIPPED
        inner = False
        for c in n.children:
            if isinstance(c, Node):
                inner = visit(c, skipped) or inner
        if n.tag in BLOCKS:
            if not inner and not skipped and not (primary and _lang(n) == primary):
                out.append(n)
            return True
        return inner

    visit(root, False)
    return out


def path_of(n: Node) -> str:
    """The place of a node: tags from the root, with a number where siblings share the tag."""
    steps = []
    while n.parent is not None:
        same = [c for c in n.parent.children if isinstance(c, Node) and c.tag == n.tag]
        steps.append(n.tag if len(same) == 1 else f"{n.tag}[{next(k for k, c in enumerate(same) if c is n) + 1}]")
        n = n.parent
    return "/" + "/".join(reversed(steps))


def placeholderize(host: Node) -> tuple[str, list[dict]]:
    """The text of a host with numbered placeholders, and the token behind each number."""
    parts: list[str] = []
    tokens: list[dict] = []

    def visit(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                parts.append(c)
                continue
            k = len(tokens)
            kind = "entity" if c.entity else "void" if c.tag in VOID else "pair"
            tokens.append({"tag": c.tag, "kind": kind, "attrs": dict(c.attrs)})
            parts.append(f"[[T{k}]]")
            if kind == "pair":
                visit(c)
                parts.append(f"[[/T{k}]]")

    visit(host)
    return "".join(parts), tokens


class BrokenMarks(ValueError):
    """Placeholders that do not fit their skeleton."""


def rebuild(text: str, tokens: list[dict]) -> str:
    """The inverse of `placeholderize`, as markup; raises BrokenMarks where marks do not pair up."""
    out, open_marks, at = [], [], 0
    # &lt; and &gt; would come back as entity tokens, numbers come back as text
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&#60;").replace(">", "&#62;")
    for m in MARK.finditer(text):
        out.append(esc(text[at : m.start()]))
        at, k = m.end(), int(m.group(2))
        if k >= len(tokens):
            raise BrokenMarks(f"no token {k}")
        tok = tokens[k]
        if m.group(1):
            if not open_marks or open_marks.pop() != k:
                raise BrokenMarks(f"closer {k} without its opener")
            out.append(f"</{tok['tag']}>")
        elif tok["kind"] == "entity":
            out.append(tok["tag"])
        else:
            attrs = "".join(f' {a}="{esc(v).replace(chr(34), '&#34;')}"'.replace("\n", "&#10;") for a, v in tok["attrs"].items())
            out.append(f"<{tok['tag']}{attrs}{'/' if tok['kind'] == 'void' else ''}>")
            if tok["kind"] == "pair":
                open_marks.append(k)
    if open_marks:
        raise BrokenMarks(f"opener {open_marks[-1]} without its closer")
    out.append(esc(text[at:]))
    return "".join(out)


def preview(text: str, tokens: list[dict]) -> str:
    """Placeholders as the tags they stand for, without attributes; breaks as line ends, images by their alt text."""
    def show(m: re.Match) -> str:
        k = int(m.group(2))
        if k >= len(tokens):
            return m.group()
        tok = tokens[k]
        if tok["kind"] == "entity":
            return tok["tag"]
        if tok["tag"] == "br":
            return "\n"
        if tok["tag"] == "img":
            return f"[{dict(tok['attrs'] or {}).get('alt') or 'image'}]"
        return f"<{m.group(1)}{tok['tag']}{'/' if tok['kind'] == 'void' else ''}>"

    return MARK.sub(show, text)


def trivially_empty(text: str) -> bool:
    return not _INVISIBLE.sub("", MARK.sub("", text)).strip()


def chapter_title(root: Node) -> str | None:
    """First non-empty h1, h2, h3 or title; else a bold-styled span among the first children of the body."""
    flat = lambda n: " ".join(n.text().split())
    for tag in ("h1", "h2", "h3", "title"):
        for n in root.walk():
            if n.tag == tag and flat(n):
                return flat(n)
    body = next((n for n in root.walk() if n.tag == "body"), None)
    found: list[str] = []
    for child in [c for c in body.children if isinstance(c, Node)][:8] if body else []:
        bold = next((flat(s) for s in child.walk() if s.tag == "span" and any(c.lower().startswith("bold") for c in s.attrs.get("class", "").split()) and 1 <= len(flat(s)) <= 200), None)
        if bold:
            found.append(bold)
        if len(found) == 2:
            break
    if not found:
        return None
    if len(found) == 2 and len(found[0]) <= 5 and len(found[1]) > len(found[0]):
        return f"{found[0]} — {found[1]}"
    return found[0]


def expand_entity_tokens(source: str, target: str | None, tokens: list[dict]) -> tuple[str, str | None, list[dict], bool]:
    """Entity tokens that are text become that text in source and target; the tokens left are numbered anew."""
    gone = {k: ENTITIES[t["tag"][1:-1]] for k, t in enumerate(tokens) if t["kind"] == "entity" and t["tag"][1:-1] in ENTITIES}
    if not gone:
        return source, target, tokens, False
    left = [k for k in range(len(tokens)) if k not in gone]
    number = {k: i for i, k in enumerate(left)}

    def sub(m: re.Match) -> str:
        k = int(m.group(2))
        if k in gone:
            return gone[k]
        return f"[[{m.group(1)}T{number[k]}]]" if k in number else m.group()

    return MARK.sub(sub, source), None if target is None else MARK.sub(sub, target), [tokens[k] for k in left], True


def sentence_cuts(text: str, kinds: list[str]) -> list[int]:
    """Places after sentence marks and white space where no pair is open."""
    cuts, depth, at = [], 0, 0
    for m in re.finditer(r"\[\[(/?)T(\d+)\]\]|[.!?]+\s+", text):
        if m.group(2) is not None:
            k = int(m.group(2))
            if m.group(1):
                depth -= 1
            elif k < len(kinds) and kinds[k] == "pair":
                depth += 1
        elif depth == 0:
            cuts.append(m.end())
        at = m.end()
    return [c for c in cuts if c < len(text)] if at else []


def split_sentences(text: str, tokens: list[dict], cap: int) -> list[tuple[str, list[dict]]]:
    """Sentences packed up to `cap` estimated tokens, marks numbered anew per part; one part where nothing can be cut."""
    size = lambda s: max(1, len(s) // 4)
    cuts = sentence_cuts(text, [t["kind"] for t in tokens])
    if size(text) <= cap or not cuts:
        return [(text, tokens)]
    out, start, last = [], 0, 0
    for c in [*cuts, len(text)]:
        if last > start and size(text[start:c]) > cap:
            out.append(text[start:last])
            start = last
        last = c
    out.append(text[start:])
    return [_renumber(p, tokens) for p in out if p]


def _renumber(text: str, tokens: list[dict]) -> tuple[str, list[dict]]:
    used: list[int] = []
    for m in MARK.finditer(text):
        if int(m.group(2)) not in used:
            used.append(int(m.group(2)))
    return MARK.sub(lambda m: f"[[{m.group(1)}T{used.index(int(m.group(2)))}]]", text), [tokens[k] for k in used]


SEGMENT = (
    "doc string, title string, idx int, source_text string, host_path string, "
    "skeleton array<struct<tag:string,kind:string,attrs:map<string,string>>>"
)


def segment_document(markup: str, target_lang: str | None = None) -> list[tuple]:
    """(idx, text, path, tokens) of each host with something to translate, in document order."""
    root = parse(markup)
    wrap_orphans(root)
    out = []
    for h in hosts(root, target_lang):
        text, tokens = placeholderize(h)
        if not trivially_empty(text):
            out.append((len(out), text.strip(), path_of(h), tokens))
    return out


def segment_pages(pages: DataFrame, doc: str, markup: str, target_lang: str | None = None) -> DataFrame:
    """pages(doc, markup) -> segments; one narrow pass, a document never leaves its row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, m in zip(pdf["d"], pdf["m"]):
                if m:
                    title = chapter_title(parse(m))
                    rows += [(d, title, i, t, p, s) for i, t, p, s in segment_document(m, target_lang)]
            yield pd.DataFrame(rows, columns=["doc", "title", "idx", "source_text", "host_path", "skeleton"])

    return pages.selectExpr(f"CAST(`{doc}` AS STRING) AS d", f"`{markup}` AS m").mapInPandas(run, SEGMENT)
