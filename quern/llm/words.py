"""Words as the operators of this package see them: runs of anything but the six ASCII white spaces."""

from __future__ import annotations

#: Java regular expression of one word, for expressions that stay in the JVM.
WORD_REGEX = r"[^\x20\x09-\x0D]+"
WHITE_SPACE = " \t\n\x0b\x0c\r"


def encoded_words(text: str | None, lower: bool = False) -> list[bytes]:
    """UTF-8 words of a text (null: none).  ``bytes`` methods treat exactly the ASCII white spaces
    as separators and lower-case exactly A-Z."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()
