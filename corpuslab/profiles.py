"""Scripts: their blocks and the classes of signs that repair and quality rules speak of."""

from __future__ import annotations

from dataclasses import dataclass

#: White space as Python's str.split and str.isspace see it, and the two dandas that both Indic scripts share. A property is one test for each character; a list of ranges is one for each range.
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
DANDAS = r"\u0964\u0965"


@dataclass(frozen=True)
class ScriptProfile:
    """Character classes, written for inside a regular expression's brackets; empty where a script has none."""

    name: str
    block: str
    first: int
    last: int
    consonants: str = ""
    matras: str = ""
    halant: str = ""
    diacritics: str = ""

    @property
    def script(self) -> str:
        """The block and the shared punctuation."""
        return self.block + DANDAS


# Unicode blocks and sign classes of the two Indic scripts.
HINDI = ScriptProfile(
    "hindi", r"\u0900-\u097f", 0x0900, 0x097F,
    consonants=r"\u0915-\u0939\u0958-\u095f",
    matras=r"\u093e-\u094c\u094e-\u094f\u0955-\u0957\u0962-\u0963",
    halant=r"\u094d",
    diacritics=r"\u0901-\u0903\u093c\u093e-\u094f\u0955-\u0957\u0962-\u0963",
)
ASSAMESE = ScriptProfile(
    "assamese", r"\u0980-\u09ff", 0x0980, 0x09FF,
    consonants=r"\u0995-\u09b9\u09dc-\u09df\u09f0\u09f1",
    matras=r"\u09be-\u09cc\u09d7\u09e2-\u09e3",
    halant=r"\u09cd",
    diacritics=r"\u0981-\u0983\u09bc\u09be-\u09cd\u09d7\u09e2-\u09e3",
)
#: For texts in Latin letters: basic letters with marks and digits count as the script; it has no signs to repair.
LATIN = ScriptProfile("latin", r"\p{Alnum}\u00c0-\u024f", 0x0041, 0x024F)

PROFILES = {p.name: p for p in (HINDI, ASSAMESE, LATIN)}
#: Words of one letter that are words.
SINGLE_WORDS = ("व", "न", "त", "य", "ও", "এ", "বা")
