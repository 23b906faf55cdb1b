"""Which legacy encoding bytes are in: the likelihood of their readings under models of languages' letters.

A reading is what the strict decoder of an encoding makes of the bytes.  Its likelihood multiplies, for each sign beyond
ASCII, how often a language of that encoding uses it, and, for each pair of neighbours, how often their kinds follow each
other (case, script, letter or symbol).  An ASCII sign counts the same in every model, so readings that take one or two
bytes to a sign compare by all their bytes.  A text is in one language, or, in the default encoding, in
several; and a word that comes again says nothing new, so each counts once.  Logarithms are whole millionths, so that sums
do not depend on their order; of encodings that are equally likely the first one listed is taken.
"""

from __future__ import annotations

import codecs
import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Letters beyond ASCII of languages, the more frequent first
LETTERS = {
    "French": "éèàêçôùâîœûëïæ", "German": "üäößé", "Spanish": "óíáéñúü", "Portuguese": "ãçáéõíóúâêà", "Italian": "èàùòìé",
    "Nordic": "äöåøæéü", "Icelandic": "íáðéóöúþæý", "Polish": "łęąóżśćńź", "Czech": "íáěéřýčžšůúňťďó", "Slovak": "áíéúýčžšťľňôďĺŕäó",
    "Hungarian": "éáóőöüíűú", "Romanian": "ăîâşţ", "Croatian": "čšžćđ", "Turkish": "ıüşöçğâî", "Russian": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё",
    "Ukrainian": "оанивітреслкудмпязьбгчйхжцшюєїщфґ", "Greek": "αοιετσνηυρπκμλςάόίωέήδγχθύφβώξζψϊϋΐΰ", "Hebrew": "יוהלאתרבשמנםדכקחעפסגצזטןךץף",
    "Arabic": "اليمنروتبةعدسفهكقحأجشصطىخإذزءضغثئظآؤ",
}
#: Signs of printed text that all these languages share
SIGNS = "’“”–…—«»„‘°§€£·"
#: Code pages, the codec that reads each, and the languages written in it
PAGES = {
    "windows-1252": ("cp1252", ("French", "German", "Spanish", "Portuguese", "Italian", "Nordic", "Icelandic")),
    "windows-1250": ("cp1250", ("Polish", "Czech", "Slovak", "Hungarian", "Romanian", "Croatian")),
    "ISO-8859-2": ("iso8859_2", ("Polish", "Czech", "Slovak", "Hungarian", "Romanian", "Croatian")),
    "windows-1254": ("cp1254", ("Turkish",)), "windows-1251": ("cp1251", ("Russian", "Ukrainian")), "KOI8-R": ("koi8_r", ("Russian",)),
    "windows-1253": ("cp1253", ("Greek",)), "windows-1255": ("cp1255", ("Hebrew",)), "windows-1256": ("cp1256", ("Arabic",)),
    "Shift_JIS": ("shift_jis", ("Japanese",)), "EUC-JP": ("euc_jp", ("Japanese",)), "GB18030": ("gb18030", ("Chinese",)),
    "Big5": ("big5", ("Taiwanese",)), "EUC-KR": ("euc_kr", ("Korean",)),
}
#: East Asian standards order signs by use: a codec, and what share of a text the signs of a range of lead bytes make up
ROWS = {
    "Japanese": ("euc_jp", ((0xA1, 0xA1, 0.1), (0xA3, 0xA3, 0.02), (0xA4, 0xA4, 0.5), (0xA5, 0xA5, 0.12), (0xB0, 0xCF, 0.25), (0xD0, 0xF4, 0.01))),
    "Chinese": ("gb2312", ((0xA1, 0xA1, 0.1), (0xA3, 0xA3, 0.05), (0xB0, 0xD7, 0.83), (0xD8, 0xF7, 0.02))),
    "Taiwanese": ("big5", ((0xA1, 0xA3, 0.13), (0xA4, 0xC6, 0.85), (0xC9, 0xF9, 0.02))),
    "Korean": ("euc_kr", ((0xA1, 0xA1, 0.05), (0xA3, 0xA3, 0.03), (0xB0, 0xC8, 0.915), (0xCA, 0xFD, 0.005))),
}
DEFAULT = "windows-1252"
LATIN = {DEFAULT, "windows-1250", "ISO-8859-2", "windows-1254"}
#: Logarithms are counted in parts of this size
UNIT = 1_000_000


def units(logarithm):
    """Logarithms in whole units."""
    return np.rint(np.asarray(logarithm) * UNIT).astype(np.int64)


ASCII, UNSEEN = math.log(1 / 60), math.log(1e-6)
OTHER, LOW, UP, HIGH_LOW, HIGH_UP, HIGH_LETTER, SYMBOL, CONTROL = range(8)
BEYOND = 0x10000


def _spread(table: np.ndarray, signs: dict[str, float], share: float) -> None:
    """Give each sign its part, by its weight, of a share of the text."""
    total = sum(signs.values())
    for sign, weight in signs.items():
        if len(sign) == 1 and ord(sign) < BEYOND:
            table[ord(sign)] = max(table[ord(sign)], math.log(share * weight / total))


@lru_cache(maxsize=None)
def _model(language: str) -> np.ndarray:
    """The logarithm of each sign's frequency among the signs beyond ASCII; the last entry is for all beyond 16 bits."""
    table = np.full(BEYOND + 1, UNSEEN)
    if language in ROWS:
        codec, ranges = ROWS[language]
        for first, last, share in ranges:
            pairs = (bytes([a, b]).decode(codec, "ignore") for a in range(first, last + 1) for b in range(0x40, 0xFF))
            _spread(table, dict.fromkeys((p for p in pairs if p.isprintable()), 1.0), share)
    else:
        ranked = {c: 1 / (i + 2) for i, c in enumerate(LETTERS[language])}
        _spread(table, ranked, 0.85)
        _spread(table, {c.upper(): w for c, w in ranked.items() if c.upper() != c}, 0.05)
        _spread(table, {c: 1 / (i + 2) for i, c in enumerate(SIGNS)}, 0.1)
    table[:0x80] = ASCII
    return units(table)


@lru_cache(maxsize=None)
def _kinds() -> np.ndarray:
    kinds = np.full(BEYOND + 1, SYMBOL, np.uint8)
    for code in range(BEYOND):
        group = unicodedata.category(chr(code))
        if code < 0x80:
            kinds[code] = {"Ll": LOW, "Lu": UP}.get(group, CONTROL if group == "Cc" and chr(code) not in "\t\n\r\f" else OTHER)
        elif group[0] in "LM":
            kinds[code] = {"Ll": HIGH_LOW, "Lu": HIGH_UP}.get(group, HIGH_LETTER)
        elif group[0] == "C":
            kinds[code] = CONTROL
        elif group[0] == "Z" or code >= 0x3000:
            kinds[code] = OTHER
    return kinds


@lru_cache(maxsize=None)
def _follows(mixes: bool) -> np.ndarray:
    """The logarithm of how much rarer one kind after another is than by chance; mixes: whether the script meets a to z."""
    table = np.zeros((8, 8))
    table[[LOW, HIGH_LOW], HIGH_UP] = table[HIGH_LOW, UP] = -3
    letters = [LOW, UP, HIGH_LOW, HIGH_UP, HIGH_LETTER]
    table[letters, SYMBOL] = table[SYMBOL, letters] = -1.5
    if not mixes:
        for high in (HIGH_LOW, HIGH_UP, HIGH_LETTER):
            table[[LOW, UP], high] = table[high, [LOW, UP]] = -3
    table[:, CONTROL] = -8
    return units(table)


def likelihood(data: bytes, encoding: str, cut: bool = False, mixed: bool = False) -> int | None:
    """The logarithm, in units, of the likelihood of data read in an encoding, by the language that fits best or, where they may be
    mixed, each word by whichever; None where data is not in that encoding.  The default can read all bytes, those without
    a meaning at a low likelihood."""
    codec, languages = PAGES[encoding]
    text = read(data, codec, cut, "replace" if encoding == DEFAULT else "strict")
    if text is None:
        return None
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), BEYOND)
    if not len(codes):
        return 0
    kinds = _kinds()[codes]
    pairs = _follows(encoding in LATIN or languages[0] in ROWS)[kinds[:-1], kinds[1:]].sum()
    starts = np.concatenate([[0], np.flatnonzero(codes == 0x20) + 1]) if mixed else np.zeros(1, np.int64)
    words = np.stack([np.add.reduceat(_model(language)[codes], starts[starts < len(codes)]) for language in languages])
    signs = units(np.logaddexp.reduce(words / UNIT, axis=0) - math.log(len(languages))).sum() if mixed else words.max()
    return int(pairs) + _misplaced(codes, languages) + int(signs)


#: Hebrew letters that have another form at the end of a word, and those forms
INNER, FINAL = (np.frombuffer(letters.encode("utf-32-le"), np.uint32) for letters in ("כמנפצ", "ךםןףץ"))


def _misplaced(codes: np.ndarray, languages: tuple[str, ...]) -> int:
    """The logarithm, in units, of how much rarer Hebrew is with final forms inside words and other forms at their end."""
    if languages != ("Hebrew",):
        return 0
    ends = ~np.isin(_kinds()[np.append(codes[1:], 0x20)], [HIGH_LETTER, HIGH_LOW, HIGH_UP])
    return -3 * UNIT * int((np.isin(codes, FINAL) & ~ends).sum() + (np.isin(codes, INNER) & ends).sum())


def distinct_words(data: bytes) -> bytes:
    """The words between ASCII white space, each once, in order; no legacy encoding has such a byte inside a sign."""
    return b" ".join(dict.fromkeys(data.split()))


def read(data: bytes, codec: str, cut: bool, errors: str = "strict") -> str | None:
    """data decoded; of data that was cut, a sign begun at the end is left out."""
    try:
        return codecs.getincrementaldecoder(codec)(errors).decode(data, final=not cut)
    except UnicodeDecodeError:
        return None


def guess(data: bytes, cut: bool = False, least_share: float = 0.25, odds: float = 1000.0) -> str:
    """The encoding that is likeliest, where it is `odds` times as likely as the default, and likelier than a mix of the
    default's languages; else the default, windows-1252.

    Scripts other than Latin are thought of only if least_share of all bytes lie beyond ASCII.  An encoding in which data
    reads as it does in the default has nothing to say for it.
    """
    high = np.count_nonzero(np.frombuffer(data, np.uint8) > 0x7F)
    if not high:
        return DEFAULT
    rare = high < least_share * len(data)
    words = distinct_words(data)
    found = {DEFAULT: max(likelihood(words, DEFAULT, cut) + int(units(math.log(odds))), likelihood(words, DEFAULT, cut, mixed=True))}
    plain = read(words, PAGES[DEFAULT][0], cut, "replace")
    for encoding in PAGES:
        if encoding != DEFAULT and (encoding in LATIN or not rare) and read(words, PAGES[encoding][0], cut) != plain:
            value = likelihood(words, encoding, cut)
            if value is not None:
                found[encoding] = value
    return max(found, key=found.get)


@F.pandas_udf(StructType().add("encoding", "string").add("text", "string"))
def _guessed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for data, cut in batches:
        rows = []
        for content, ended in zip(data, cut, strict=True):
            name = DEFAULT if content is None else guess(bytes(content), bool(ended))
            rows.append((name, None if name == DEFAULT else read(bytes(content), PAGES[name][0], bool(ended))))
        yield pd.DataFrame(rows, columns=["encoding", "text"])


def guessed(data: Column, cut: Column, wanted: Column) -> Column:
    """(encoding, text) of bytes where `wanted` is true; elsewhere nothing is sent to Python.  The text is null for
    windows-1252, which column expressions read."""
    return _guessed(F.when(wanted, data), cut)
