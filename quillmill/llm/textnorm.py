"""Character-level repair of text: everything that can be decided without looking at the corpus.

Used inside Arrow batches only. All functions accept any str; None never reaches them.
"""

from __future__ import annotations

import re
import unicodedata

MARK = re.compile(r"\[\[/?T\d+\]\]")

# Letters of other scripts that are drawn like Latin ones (from Unicode's confusables).
CYRILLIC_AS_LATIN = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜаеорсухѕіјһԁԛԝѵүӏ", "ABESIJKMHOPCTYXYGQWaeopcyxsijhdqwvyl")) | {"Ӏ": "I"}
GREEK_AS_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳαγικνορυϲ", "ABEZHIKMNOPTYXCjayikvopuc"))
ARMENIAN_AS_LATIN = dict(zip("ՏՕհոսօզցյ", "SOhnuoqgj"))
CHEROKEE_AS_LATIN = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZVSLCPKB"))
LATIN_AS_LATIN = {"ɡ": "g", "ſ": "s"}

#: Scripts by the order in which they go where nothing else decides.
SCRIPTS = ("latin", "greek", "cyrillic", "armenian", "cherokee")
_TO_LATIN = {"greek": GREEK_AS_LATIN, "cyrillic": CYRILLIC_AS_LATIN, "armenian": ARMENIAN_AS_LATIN, "cherokee": CHEROKEE_AS_LATIN}
_FROM_LATIN = {s: {b: a for a, b in reversed(m.items())} for s, m in _TO_LATIN.items()}
#: Letters of each script that some other script can show too; all others give their script away.
SHARED = {s: frozenset(m) for s, m in _TO_LATIN.items()} | {"latin": frozenset(b for m in _TO_LATIN.values() for b in m.values())}

#: A token is a run of letters of these scripts, with combining marks; one class for Python and for Java.
_LETTERS = "A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0300-\u03ff\u0400-\u058f\u13a0-\u13fd\u1e00-\u1fff"
TOKEN = re.compile(f"[{_LETTERS}]+")
JAVA_TOKEN = f"([{_LETTERS}]+)"
FOREIGN = re.compile("[\u0370-\u058f\u13a0-\u13fd\u1f00-\u1fff]")

#: What a text needing no repair of characters never has, and Latin letters that no other script shows.
JAVA_UNPLAIN = (
    "[^\\x20-\\x7E\\u00C0-\\u00D6\\u00D8-\\u00F6\\u00F8-\\u00FF\\u2014\\u3001\\u3002\\u3005\\u300C\\u300D"
    "\\u3041-\\u3096\\u30A1-\\u30FA\\u30FC\\u4E00-\\u9FFF]"
)
JAVA_LATIN = "[A-Za-z]"
JAVA_SURELY_LATIN = "[" + "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" if c not in SHARED["latin"]) + "]"


class _Chars(dict):
    """Replacement of each character, found by rule on first sight."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        kind = unicodedata.category(ch)
        tag, _, _ = unicodedata.decomposition(ch).partition(" ")
        if kind == "Cf" or code == 0x034F or 0xFE00 <= code <= 0xFE0F or 0x180B <= code <= 0x180D:
            out = ""
        elif kind in ("Zs", "Zl", "Zp") or ch.isspace():
            out = " "
        elif kind == "Cc":
            out = ""
        elif code in (0x2010, 0x2011):
            out = "-"
        elif tag in ("<wide>", "<narrow>", "<font>", "<noBreak>"):
            out = unicodedata.normalize("NFKC", ch)
        elif tag == "<compat>" and (kind == "Nl" or 0xFB00 <= code <= 0xFB06):
            out = unicodedata.normalize("NFKC", ch)
        else:
            out = LATIN_AS_LATIN.get(ch, ch)
        self[code] = out
        return out


_CHARS = _Chars()
_SPACES = re.compile(" {2,}")


def repair_characters(text: str) -> str:
    """Composed, narrow, visible characters with single spaces between words; scripts stay as they are."""
    if text.isascii() and text.isprintable():
        return _SPACES.sub(" ", text).strip()
    return _SPACES.sub(" ", unicodedata.normalize("NFC", text.translate(_CHARS))).strip()


def script(ch: str) -> str:
    c = ord(ch)
    if c < 0x370:
        return "latin"
    if c <= 0x3FF or 0x1F00 <= c <= 0x1FFF:
        return "greek"
    if 0x400 <= c <= 0x52F:
        return "cyrillic"
    if 0x530 <= c <= 0x58F:
        return "armenian"
    return "cherokee" if 0x13A0 <= c <= 0x13FD else "latin"


def scripts_of(token: str) -> set[str]:
    return {script(c) for c in token if not unicodedata.combining(c)}


def dominant(text: str) -> str | None:
    """The script that most letters of the text belong to which no other script shows; None where there is no such letter."""
    n = dict.fromkeys(SCRIPTS, 0)
    for t in TOKEN.findall(text):
        for c in unicodedata.normalize("NFD", t):
            if not unicodedata.combining(c):
                own = script(c)
                n[own] += c not in SHARED[own]
    best = max(SCRIPTS, key=n.__getitem__)
    return best if n[best] else None


def majority(text: str) -> str | None:
    """The script of most letters; None where there is none."""
    n = dict.fromkeys(SCRIPTS, 0)
    for t in TOKEN.findall(text):
        for c in t:
            n[script(c)] += not unicodedata.combining(c)
    best = max(SCRIPTS, key=n.__getitem__)
    return best if n[best] else None


def render(token: str, target: str) -> str | None:
    """`token` written wholly in script `target`, or None where some letter has no look-alike there."""
    out = []
    for c in unicodedata.normalize("NFD", token):
        if unicodedata.combining(c):
            out.append(c)
            continue
        own = script(c)
        if own != target:
            latin = c if own == "latin" else _TO_LATIN[own].get(c)
            if latin is None:
                return None
            c = latin if target == "latin" else _FROM_LATIN[target].get(latin)
            if c is None:
                return None
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def renderings(token: str, context: str) -> list[tuple[int, str]]:
    """(rank, rendering) for every script that can show the whole token.

    Rank 0 is its dominant script; where its letters tell none, that of its context. Then come the others in order.
    """
    first = dominant(token) or context
    found = [(int(s != first) * (1 + k), render(token, s)) for k, s in enumerate(SCRIPTS)]
    return [(k, r) for k, r in found if r is not None]


def has_content(text: str) -> bool:
    """A letter or digit outside the inline marks."""
    return any(c.isalnum() for c in MARK.sub("", text))


def substitute(text: str, repaired: dict[str, str]) -> str:
    return TOKEN.sub(lambda m: repaired.get(m.group(), m.group()), text)
