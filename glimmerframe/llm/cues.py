"""Subtitle text as words: markup removed, wrong encodings repaired, misread characters folded to one form."""

from __future__ import annotations

import re
import unicodedata

# A time line with the number line above it, a WebVTT header, or a comment block's mark.
TIMES = r"(?m:^[ \t﻿]*(?:\d+[ \t]*\r?\n[ \t]*)?\d[\d:.,]*[ \t]*-->[^\n]*$)|(?m:^﻿?WEBVTT[^\n]*$)"
FORMATS = r"</?(?:i|b|u|s|c|v|br|p|div|span|font|ruby|rt|html|head|title|body|h\d|noscript)\b[^<>\n]{0,200}>|\{\\[^{}\n]{0,80}\}"
SOUNDS = r"\[[^\[\]]{0,100}\]|\([^()]{0,100}\)|(?<!\S)\*[^*\n]{1,60}\*(?!\S)"
TIME, FORMAT = re.compile(TIMES), re.compile(FORMATS)
ALL_MARKUP = re.compile(TIMES + r"|<[^<>]{0,200}>|\{[^{}]{0,100}\}|" + SOUNDS)
INVISIBLE = re.compile("[­​-‏⁠﻿]")
SUSPECT = re.compile("[Â-ôĂĹГР][\u0080-¿ŒœŠšŸŽžƒˆ˜‐-›€™]+")


def _repaired(found: re.Match) -> str:
    """UTF-8 that was read as one byte per character."""
    raw = bytearray()
    for c in found[0]:
        try:
            raw += bytes([ord(c)]) if ord(c) < 256 else c.encode("cp1252")
        except UnicodeEncodeError:
            return found[0]
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return found[0]


def repair(text: str) -> str:
    for _ in range(2):
        if not SUSPECT.search(text):
            break
        text = SUSPECT.sub(_repaired, text)
    return text


# Characters that scanners and wrong encodings confuse, each with the form that stands for its group.
LOOKS = {"1": "i", "|": "i", "l": "i", "!": "i", "0": "o", "5": "s", "$": "s", "8": "b", "e": "c", "h": "ii", "u": "ii", "m": "rn", "w": "vv", "d": "ci", "ɑ": "a", "α": "a", "а": "a", "е": "c", "о": "o", "і": "i", "ı": "i", "ł": "i", "ø": "o", "ß": "ss", "æ": "ac", "œ": "oc", "ƒ": "f"}
LOST = "�"
WIDE, LONG = [x for x in {v for v in LOOKS.values() if len(v) == 2} if x not in ("ss", "ac", "oc")], 8
FOLD = str.maketrans(LOOKS)
# What ¿ and ¡ become when read as Latin-2 or Cyrillic; as first letters they do not count.
TURNED = "żĄїЎ"


def skeleton(word: str) -> str:
    """What is left of a word without case, accents, punctuation and the difference between look-alike characters; '' if nothing is."""
    plain = unicodedata.normalize("NFKD", (word[1:] if word[:1] in TURNED else word).casefold())
    if not any(c.isalnum() or c == LOST for c in plain):
        return ""
    core = plain.strip("!|$") if plain[0] in "!|$" or plain[-1] in "!|$" else plain
    return "".join(c for c in core.translate(FOLD) if c.isalnum() or c == LOST)


def bare(word: str) -> str:
    """The skeleton of what wrong encodings cannot change: a word's ASCII characters, or the whole word where these are less than half of it."""
    lean = "".join(c for c in word if c < "\x80")
    return skeleton(lean if 2 * len(lean) >= len(word) else word) or skeleton(word)


class Skeletons(dict):
    """word -> skeleton, remembered; forgets everything when it has grown too large."""

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[word] = made = skeleton(word)
        return made


def spoken(text: str) -> list[str]:
    """The words of a subtitle text without numbers, times, tags and bracketed sounds."""
    return ALL_MARKUP.sub(" ", INVISIBLE.sub("", repair(text))).split()


def same(a: str, b: str) -> bool:
    """Whether two skeletons stand for one word: equal, equal but for lost characters, or one character apart in words of LONG letters and more."""
    if a == b:
        return True
    if LOST in a or LOST in b:
        a, b = (a, b) if LOST in a else (b, a)
        if LOST in b:
            return a.replace(LOST, "") == b.replace(LOST, "")
        return re.fullmatch(".{0,3}".join(map(re.escape, re.split(LOST + "+", a))), b) is not None
    return abs(len(a) - len(b)) <= 1 and min(_letters(a), _letters(b)) >= LONG and _one_edit(a, b)


def _letters(skeleton: str) -> int:
    """The letters of a word before wide ones were written as two."""
    return len(skeleton) - sum(map(skeleton.count, WIDE))


def _one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]
