"""Text normalisation as column expressions; only Unicode forms and folding leave the JVM, in Arrow batches."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dictionaries import CORPORATE, EXPAND, LEGAL_SUFFIXES, NULL_LIKE

WORD_MARKS = r"[^\p{L}\p{N}_\s]"
_LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ı": "i"}
#: Romanised signs by their offset in a Brahmic block; the blocks share one layout.
_BRAHMIC = dict(
    zip(
        [2, 3, *range(5, 12), 15, 16, 19, 20, *range(21, 41), *range(42, 49), 50, 51, 53, 54, 55, 56, 57, 62, 63, 64, 65, 66, 71, 72, 75, 76],
        ("m h a aa i ii u uu r e ai o au k kh g gh ng c ch j jh ny tt tth dd ddh nn t th d dh n p ph b bh m y r l ll v sh ss s h aa i ii u uu e ai o au").split(),
    )
)
_TABLE = {0x900 + 0x80 * block + offset: sound for block in range(9) for offset, sound in _BRAHMIC.items()}
_TABLE |= {ord(a): b for a, b in _LETTERS.items()}
_TABLE |= {0x900 + 0x80 * block + 0x66 + digit: str(digit) for block in range(9) for digit in range(10)}


#: Romanised letters of other alphabets, in the order of their alphabets; capitals follow from the small ones.
_ALPHABETS = [
    ("абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґўј", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch - y - e iu ia io i yi ie g u j"),
    ("αβγδεζηθικλμνξοπρςστυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o"),
    ("ابتثجحخدذرزسشصضطظعغفقكلمنهويةىءآأؤإئپچژگ", "a b t th j h kh d dh r z s sh s d t z - gh f q k l m n h w y h a - a a w a y p ch zh g"),
    ("אבגדהוזחטיךכלםמןנסעףפץצקרשת", "- b g d h v z h t y k k l m m n n s - p p ts ts q r sh t"),
    ("აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ", "a b g d e v z t i k l m n o p zh r s t u p k gh q sh ch ts dz ts ch kh j h"),
]
for _letters, _sounds in _ALPHABETS:
    for _letter, _sound in zip(_letters, _sounds.split(), strict=True):
        _sound = _sound.strip("-")
        _TABLE[ord(_letter)] = _sound
        if _letter.upper() != _letter and len(_letter.upper()) == 1:
            _TABLE.setdefault(ord(_letter.upper()), _sound.capitalize())


def _sound_of(c: str) -> str:
    """Kana by the sound that its name ends with, digits of any script by their value, else the letter itself."""
    name = unicodedata.name(c, "")
    if name.startswith(("HIRAGANA LETTER ", "KATAKANA LETTER ")):
        return name.rsplit(" ", 1)[1].lower()
    return str(unicodedata.digit(c)) if unicodedata.category(c) == "Nd" else c


def _texts(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _composed(t: str) -> str:
    return t if t.isascii() else unicodedata.normalize("NFKC", t)


def _ascii(t: str) -> str:
    if t.isascii():
        return t
    t = unicodedata.normalize("NFKC", t).translate(_TABLE)
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Mn")
    return t if t.isascii() else "".join(c if c.isascii() else _sound_of(c) for c in t).translate(_TABLE)


def _each(make):
    """A text function over Arrow batches; each distinct value is made once."""

    @F.arrow_udf(T.StringType())
    def batch(x: pa.Array) -> pa.Array:
        x = x.dictionary_encode()
        return pa.array([make(t) for t in x.dictionary.to_pylist()], pa.string()).take(x.indices)

    return batch


_nfkc, _casefold, _fold = _each(_composed), _each(lambda t: _composed(t).casefold()), _each(_ascii)


def nfkc(column: Column) -> Column:
    return _nfkc(_texts(column))


def casefold(column: Column) -> Column:
    """NFKC, then full case folding."""
    return _casefold(_texts(column))


def ascii_fold(column: Column) -> Column:
    """Accents dropped, some letters spelt out, Brahmic scripts romanised by the layout of their blocks, Cyrillic, Greek,
    Arabic, Hebrew and Georgian by their alphabets, kana by its names.

    An approximation of transliteration: what it doesn't know (Chinese characters among it) stays as it is."""
    return _fold(_texts(column))


def collapse(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, r"\s+", " "))


def marks_to_blanks(column: Column) -> Column:
    return collapse(F.regexp_replace(column, WORD_MARKS, " "))


def tokens(column: Column) -> Column:
    """The tokens of a text whose blanks are single; none of an empty one."""
    return F.filter(F.split(column, " "), lambda t: t != "")


def drop_null_like(column: Column) -> Column:
    return F.array_join(F.filter(tokens(column), lambda t: ~t.isin(NULL_LIKE)), " ")


def clean_folded(column: Column) -> Column:
    """Folded to ASCII, lower case, letters and digits only."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(column)), "[^a-z0-9]+", " "))


def clean_preserving(column: Column) -> Column:
    """NFKC, lower case, marks to blanks; scripts stay."""
    return marks_to_blanks(F.lower(nfkc(column)))


def clean_casefold(column: Column) -> Column:
    """NFKC, case folded, blanks single; marks stay."""
    return collapse(casefold(column))


def clean_words(column: Column) -> Column:
    """C4: C3 with marks to blanks."""
    return marks_to_blanks(casefold(column))


def clean_unicode(column: Column) -> Column:
    """C4 without tokens that stand for nothing."""
    return drop_null_like(clean_words(column))


def clean_transliterated(column: Column) -> Column:
    """Folded, case folded, letters and digits, without tokens that stand for nothing."""
    return drop_null_like(collapse(F.regexp_replace(F.lower(ascii_fold(column)), r"[^a-z0-9\s]", " ")))


def transliterate(column: Column) -> Column:
    """Folded; empty where nothing but blanks stands."""
    return F.when(F.trim(_texts(column)) == "", "").otherwise(ascii_fold(column))


def map_tokens(column: Column, words: dict[str, str]) -> Column:
    """Each token as the dictionary has it, else as it is."""
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.array_join(F.transform(tokens(column), lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")


def clean_contracted(column: Column, words: dict[str, str]) -> Column:
    """Lower case, marks to blanks, long forms contracted; no Unicode form."""
    return map_tokens(marks_to_blanks(F.lower(_texts(column))), words)


def clean_for_blocking(column: Column) -> Column:
    """C4, then only a-z, 0-9 and blanks."""
    return collapse(F.regexp_replace(clean_words(column), "[^a-z0-9 ]+", " "))


def expand(column: Column, words: dict[str, str] | None = None) -> Column:
    """C10 on a text that is clean."""
    return map_tokens(column, EXPAND if words is None else words)


def normal_name(column: Column) -> Column:
    """C11, for names and for addresses."""
    return expand(clean_folded(column))


def core(normal: Column, fallback: bool = True) -> Column:
    """A normal name without corporate tokens; with fallback the whole name where none is left."""
    left = F.array_join(F.filter(tokens(normal), lambda t: ~t.isin(CORPORATE)), " ")
    return F.when(left == "", normal).otherwise(left) if fallback else left


def strip_suffix(column: Column) -> Column:
    """Trailing legal forms dropped as long as a token is left."""
    return F.regexp_replace(column, f"(?: (?:{'|'.join(LEGAL_SUFFIXES)}))+$", "")


def compact(column: Column) -> Column:
    """Letters a-z and digits only."""
    return F.regexp_replace(column, "[^a-z0-9]", "")


def merged(*columns: Column) -> Column:
    """C16."""
    return F.trim(F.concat_ws(" ", *columns))


def normal_country(column: Column) -> Column:
    """C18."""
    return F.upper(F.trim(_texts(column)))
