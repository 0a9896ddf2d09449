"""The consistent form of text: compatibility-composed, without invisible characters,
plain spaces only, no word that mixes the letters of two scripts.

Letter case, punctuation, line breaks, tabs and the number of spaces stay. One search tells
which values can differ from their consistent form at all; the others are passed through.
Columns cross to Python in Arrow batches, where the search is faster than a Java one.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike letters, Latin - Cyrillic, in the same order.
LATIN_LOOK = "aceopxyABCEHKMOPTXY"
CYRILLIC_LOOK = "асеорхуАВСЕНКМОРТХУ"
# Further pairs, used only where a word can't be settled without them.
LATIN_LOOK_MORE = "ijskmtbrnu"
CYRILLIC_LOOK_MORE = "іјѕкмтьгпи"
# Greek letters with their Latin and Cyrillic look-alikes ("-": none).
GREEK_LOOK = "αορνικυχΑΒΕΗΙΚΜΝΟΡΤΥΧΖ"
GREEK_AS_LATIN = "aopvikuxABEHIKMNOPTYXZ"
GREEK_AS_CYRILLIC = "аор-ік-хАВЕНІКМ-ОРТУХ-"
# Marks that occur in clean text besides ASCII and Russian letters; NFKC keeps them.
_KEPT = "«»°≥≤•—–·×"

#: A value can differ from its consistent form only if this is found in it.
SUSPECT = f"[^\\x00-\\x7Fа-яА-ЯёЁ{_KEPT}]|[A-Za-z][а-яА-ЯёЁ]|[а-яА-ЯёЁ][A-Za-z]"
_suspect = re.compile(SUSPECT)
_word = re.compile(r"[^\W\d_]+")
_to_cyrillic = str.maketrans(LATIN_LOOK, CYRILLIC_LOOK) | {ord(g): c for g, c in zip(GREEK_LOOK, GREEK_AS_CYRILLIC) if c != "-"}
_to_latin = str.maketrans(CYRILLIC_LOOK, LATIN_LOOK) | {ord(g): c for g, c in zip(GREEK_LOOK, GREEK_AS_LATIN)}
_more_cyrillic = _to_cyrillic | str.maketrans(LATIN_LOOK_MORE, CYRILLIC_LOOK_MORE)
_more_latin = _to_latin | str.maketrans(CYRILLIC_LOOK_MORE, LATIN_LOOK_MORE)


def script(letter: str) -> str:
    """L, C, G or O: Latin, Cyrillic, Greek or other."""
    code = ord(letter)
    if code < 0x250 or 0x1E00 <= code < 0x1F00 or 0x2C60 <= code < 0x2C80 or 0xA720 <= code < 0xA800:
        return "L"
    if 0x400 <= code < 0x530 or 0x1C80 <= code < 0x1C90 or 0x2DE0 <= code < 0x2E00 or 0xA640 <= code < 0xA6A0:
        return "C"
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "G"
    return "O"


def scripts(word: str) -> set[str]:
    return {script(letter) for letter in word}


def one_script(word: str, prefer: str | None = None) -> str:
    """The word in the script its unmistakable letters show.

    prefer ("L" or "C") settles a word all of whose letters are look-alikes; without it
    the script of most letters wins, Cyrillic at a tie. A word with unmistakable letters
    of two scripts stays as it is.
    """
    found = scripts(word)
    if len(found) < 2 or "O" in found:
        return word
    sure = {s for letter in word if letter not in LATIN_LOOK and letter not in CYRILLIC_LOOK and (s := script(letter)) in "LC"}
    if len(sure) == 1:
        target = sure.pop()
    elif not sure:
        target = prefer or ("L" if sum(script(x) == "L" for x in word) * 2 > len(word) else "C")
    else:
        done = [w for table, s in ((_more_cyrillic, "C"), (_more_latin, "L")) if scripts(w := word.translate(table)) == {s}]
        return done[0] if len(done) == 1 else word
    done = word.translate(_to_cyrillic if target == "C" else _to_latin)
    if len(scripts(done)) > 1:
        done = word.translate(_more_cyrillic if target == "C" else _more_latin)
    return done if scripts(done) == {target} else word


def plain_characters(text: str) -> str:
    """Compatibility composition, no invisible characters, plain spaces only."""
    text = unicodedata.normalize("NFKC", text)
    if text.isascii():
        return text
    out = []
    for c in text:
        kind = unicodedata.category(c) if c > "\x7f" else ""
        if kind == "Cf" or c in "\u034f\u115f\u1160\u3164\uffa0" or "\ufe00" <= c <= "\ufe0f":
            continue
        out.append(" " if kind == "Zs" else c)
    return unicodedata.normalize("NFKC", "".join(out))


def consistent_text(text: str | None, prefer=None) -> str | None:
    """Consistent form of one value; null stays null. prefer maps an unsettled word to its script."""
    if text is None or text.isascii() or not _suspect.search(text):
        return text
    text = plain_characters(text)

    def settle(m: re.Match) -> str:
        w = m[0]
        return w if w.isascii() else one_script(w, prefer(w) if prefer else None)

    return _word.sub(settle, text)


@F.pandas_udf(T.StringType())
def _consistent(values: pd.Series) -> pd.Series:
    return pd.Series([consistent_text(v) for v in values], index=values.index, dtype=object)


def consistent(col: Column) -> Column:
    """Consistent form of a string column; null stays null, an empty text stays empty."""
    return _consistent(col)


def is_suspect(text: str | None) -> bool:
    """Whether the text can differ from its consistent form."""
    return text is not None and not text.isascii() and _suspect.search(text) is not None


def trimmed(col: Column) -> Column:
    """Without outer white space."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")
