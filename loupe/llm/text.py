"""Plain words of a text, the common ground of the operators on repeated text.

Runs inside Arrow batches; Python's string functions handle Unicode composition, which Spark's SQL
functions don't offer.
"""

from __future__ import annotations

import re
import unicodedata

#: Joiners, variation selectors and soft hyphens: they are neither letters nor white space.
_INVISIBLE = re.compile("[%s]" % "".join(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFE0E, 0xFE0F, 0xFEFF))))
#: All but letters, digits, white space and the vowel signs of Indic and Thai script.
_MARKS = re.compile(rf"[^\w\s{chr(0x900)}-{chr(0xE7F)}]+|_+")
_FIELDS = re.compile(rf"[|;\n\r{chr(0x85)}{chr(0x2028)}{chr(0x2029)}]+")
_LABELLED = re.compile(r"\s*[^\W\d_][\w ]{0,30}\s*:")
MIN_WORDS = 4


def plain(text: str) -> str:
    """The words in lower case with one space between; marks are dropped and neither join nor part words.

    The signs that part fields, `;` and `|`, stand for white space: no word goes on across them.
    """
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFC", text))
    return " ".join(_MARKS.sub("", text.casefold().replace(";", " ").replace("|", " ")).split())


def canonical(text: str) -> str:
    """plain(), but of a text that consists of labelled fields the fields come in sorted order."""
    parts = [p for p in _FIELDS.split(text) if p.strip()]
    if len(parts) > 1 and all(_LABELLED.match(p) for p in parts):
        return " ".join(sorted(plain(p) for p in parts))
    return plain(text)


def enough(words: str, least: int = MIN_WORDS) -> bool:
    return words.count(" ") + 1 >= least and words != ""
