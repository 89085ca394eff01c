"""Problem 10: text garbled by a wrong character decoding, found and restored.

The characters of a text are mapped back to the bytes of each legacy code page that could have produced them. An
automaton over the byte structure of UTF-8 (and of Shift-JIS) finds the maximal well-formed multibyte spans; only those
spans are decoded, and only if the outcome is plausible for the corpus' scripts and the garbled form is no natural
writing. Passages of one single-byte code page read as another have no byte structure; they are found word by word, and
what looks like correct writing even so ("13 ∞C", "ìServiceî") by the corpus itself: words that another reading of their
bytes turns into words that clean texts use far more often.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.session import cut, read_table, ship_package, spread

# Code pages that texts are read with by mistake, the usual ones first.
CODE_PAGES = ["cp1252", "latin_1", "cp1250", "cp1251", "cp850", "cp437", "mac_roman", "cp866", "koi8_r", "iso8859_2", "cp1254", "cp1257"]
_UTF8 = re.compile(
    "(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
#: Shift-JIS: kana, marks and kanji; kana and marks must carry the span.
_SJIS = re.compile("(?:[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc])+")
_KANA = re.compile("\x82[\x9f-\xf1]|\x83[\x40-\x96]|\x81[\x41\x42\x5b\x75\x76]")
_EUC = re.compile("(?:[\xa1-\xfe][\xa1-\xfe]){3,}")
_EUC_KANA = re.compile("[\xa4\xa5][\xa1-\xf6]|\xa1[\xa2\xa3]")
# Characters that the corpus' languages write.
_PLAUSIBLE = re.compile(
    "[\\xa0-\\xff"
    "ĄąĆćĘęŁłŃńŚśŹźŻżŒœŸŠšŽžĞğİıŞşÇçČčĚěŘřŮůŐőŰűĂăȚțȘș"
    "Α-Ωα-ωΆ-ώА-яЁёІіЇїЄєҐґ"
    "̀-̄̆-̌ˆ˜ƒ"
    "ᵢ-ᵪ -⁯⁰-₟₠-₿℀-⅏⅐-↏←-⇿∀-⋿⌀-⏿─-➿"
    "　-ヿㇰ-ㇿ㐀-鿿가-힯︀-️﻿＀-￯\U0001f000-\U0001faff]+"
)
# Blocks of further scripts; a word of three letters or more in one of them is plausible too.
_SCRIPTS = [(0x0530, 0x058F), (0x0590, 0x05FF), (0x0600, 0x06FF), (0x0900, 0x097F), (0x0980, 0x09FF), (0x0A80, 0x0AFF), (0x0B80, 0x0BFF), (0x0C00, 0x0C7F), (0x0E00, 0x0E7F), (0x10A0, 0x10FF), (0x1200, 0x137F), (0x1780, 0x17FF)]
_MARKS = set("\xa0“”„‚‘’«»‹›…–—·•™®©№")
_CASED_UP = re.compile(r"[A-ZÀ-ÖØ-ÞĄĆĘŁŃŚŹŻ]")


def _back(codec: str) -> dict[int, int]:
    """Characters to the code points of their bytes; undefined bytes stand for themselves as control signs."""
    table = {}
    for byte in range(0x80, 0x100):
        try:
            table[ord(bytes([byte]).decode(codec))] = byte
        except UnicodeDecodeError:
            table[byte] = byte
    for byte in range(0x80, 0xA0):
        table.setdefault(byte, byte)
    return {k: v for k, v in table.items() if k >= 0x80} | {k: k for k in range(0x80)}


class _Back(dict):
    """A translation table that sends what the code page lacks to a sign outside all bytes."""

    def __missing__(self, key):
        return 0x100


_TABLES = {codec: _Back(_back(codec)) for codec in CODE_PAGES}


def _natural(codec: str, text: str, start: int, end: int, decoded: str) -> bool:
    """True if text[start:end] may well be correct writing although its bytes are well-formed UTF-8."""
    span = text[start:end]
    before, after = text[start - 1 : start], text[end : end + 1]
    if codec == "cp866" and span[0] not in "┬├─┼╨╤":
        return True  # letters of this code page are lead bytes of its own letters
    if codec in ("cp437", "cp850", "cp866", "koi8_r") and all("─" <= ch <= "╿" for ch in span):
        return not (before.isalpha() or after.isalpha())  # a frame or tree is drawn
    if len(decoded) > 1:
        return False
    if codec in ("cp1251", "koi8_r", "cp866") and "Ѐ" <= decoded <= "ӿ":
        return True  # one letter and one mark, as in "С…"
    if codec == "cp1251" and (decoded in "»«" or decoded == "±" and re.search(r"\d ?$|[А-Яа-я]$", text[max(0, start - 2) : start])):
        return True
    if codec == "mac_roman" and (span[0] in "–—" or span[0] == "√" and span[1] in "≤≥±≠" and not (before.isalpha() or after.isalpha())):
        return True
    if len(span) == 2 and span[1] in _MARKS and not (after.isalpha() and span[1] != "\xa0") and codec in ("cp1252", "cp1250", "cp1254", "cp1257", "iso8859_2", "latin_1"):
        if span[1] == "\xa0" and span[0] in "Ãà":
            return bool(_CASED_UP.match(before or " "))
        if decoded == span[1]:
            return bool(_CASED_UP.match(before or " "))
        return bool(_CASED_UP.match(before or " ")) and decoded.isupper()
    return False


_HIGH = re.compile(r"[^\x00-\x7f]{2,}")


def plausible(decoded: str) -> bool:
    """Whether decoded bytes are writing: of the usual scripts, or a word of at least three letters of one further script."""
    if _PLAUSIBLE.fullmatch(decoded):
        return True
    return len(decoded) >= 3 and any(all(a <= ord(ch) <= b for ch in decoded) for a, b in _SCRIPTS)


@lru_cache(maxsize=65536)
def _well_formed(run: str) -> tuple[tuple[int, int, str, str], ...]:
    """(start, end, code page, decoded) of every plausible UTF-8 span in a run of characters beyond ASCII."""
    out = []
    for codec in CODE_PAGES:
        for found in _UTF8.finditer(run.translate(_TABLES[codec])):
            decoded = found[0].encode("latin_1").decode("utf-8")
            if plausible(decoded):
                out.append((*found.span(), codec, decoded))
    return tuple(out)


def _utf8_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, code page, decoded) of spans that are UTF-8 read as a single-byte code page; the earlier code page wins."""
    out: list[tuple[int, int, str, str]] = []
    for run in _HIGH.finditer(text):
        spans = _well_formed(run[0])
        if not spans:
            continue
        taken: list[tuple[int, int]] = []
        for i, j, codec, decoded in spans:
            a, b = run.start() + i, run.start() + j
            if not any(x < b and a < y for x, y in taken) and not _natural(codec, text, a, b, decoded):
                out.append((a, b, codec, decoded))
                taken.append((a, b))
    return sorted(out)


#: Where Japanese bytes may hide: the signs that each code page shows for the lead bytes of kana.
_JAPANESE = [
    ("cp1252", re.compile("[‚ƒ][^ ]{1,3}[‚ƒ]"), "cp932"), ("latin_1", re.compile("[\x82\x83][^ ]{1,3}[\x82\x83]"), "cp932"), ("cp1251", re.compile("[‚ѓ][^ ]{1,3}[‚ѓ]"), "cp932"),
    ("mac_roman", re.compile("[ÇÉ][^ a-z]{1,3}[ÇÉ]"), "cp932"), ("cp437", re.compile("[éâ][^ a-z]{1,3}[éâ]"), "cp932"), ("cp850", re.compile("[éâ][^ a-z]{1,3}[éâ]"), "cp932"),
    ("latin_1", re.compile("[¤¥][^ ]{1,3}[¤¥]"), "euc_jp"),
]


def _japanese_spans(text: str, words: str) -> list[tuple[int, int, str, str]]:
    """Spans that are Shift-JIS or EUC-JP read as a single-byte code page. words: those of the text that may hold any."""
    out = []
    for codec, hint, source in _JAPANESE:
        if not hint.search(words):
            continue
        mapped = text.translate(_TABLES[codec])
        pattern, kana = (_SJIS, _KANA) if source == "cp932" else (_EUC, _EUC_KANA)
        for found in pattern.finditer(mapped):
            a, b = found.span()
            pairs = (b - a) // 2
            marks = len([m for m in kana.finditer(found[0]) if m.start() % 2 == 0])
            if pairs >= 3 and marks >= 3 and marks * 3 >= pairs and not any(x < b and a < y for x, y, _, _ in out):
                try:
                    decoded = found[0].encode("latin_1").decode(source)
                except (UnicodeDecodeError, UnicodeEncodeError):
                    continue
                out.append((a, b, f"{source} as {codec}", decoded))
    return sorted(out)


def _pair(read_as: str, written: str, letters: str) -> dict[int, int]:
    """Signs that read_as shows for the bytes of the given letters of written."""
    out = {}
    for ch in letters:
        try:
            out[ord(ch.encode(written).decode(read_as))] = ord(ch)
        except (UnicodeDecodeError, UnicodeEncodeError):
            pass
    return out


_WEST = "äöüßÄÖÜàâáãçéèêëíîïñóôõúùûœæøåÀÂÁÃÇÉÈÊËÍÎÏÑÓÔÕÚÙÛØÅ"
_POLISH = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ"
_RUSSIAN = "".join(chr(c) for c in range(0x410, 0x450)) + "Ёё"
_LATIN_WORD = re.compile(r"[^\s.,;:!?()\[\]\"/+=<>|]*[A-Za-z][^\s.,;:!?()\[\]\"/+=<>|]*")
# Signs that never stand between two letters of one word in correct writing.
_INSIDE = "³¹¿£¥¤¦§¶¢‰¸ˆ˜¯¨´„”‚ƒ†‡Σ÷ⁿ▀■√±½¼¾ªº²≥≤⌐¬«»¡░▒▓│┤╡╢╖╕╣║╗╝╜╛┐└┴┬├─┼╞╟╚╔╩╦╠═╬╧╨╤╥╙╘╒╓╫╪┘┌█▄▌▐αΓπστΦΘΩδ∞φε∩≡⌠⌡≈"
_WESTERN_PAIRS = [(r, w, _pair(r, w, _WEST)) for r, w in (("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("koi8_r", "cp1252"), ("cp866", "cp1252"))]
_POLISH_PAIRS = [(r, w, _pair(r, w, _POLISH)) for r, w in (("cp1252", "cp1250"), ("latin_1", "iso8859_2"), ("cp1252", "iso8859_2"), ("cp850", "cp1250"), ("cp437", "cp1250"), ("cp1251", "cp1250"), ("cp1252", "cp852"), ("cp850", "cp852"), ("mac_roman", "cp1250"))]
_RUSSIAN_PAIRS = [(r, w, _pair(r, w, _RUSSIAN)) for r, w in (("cp1252", "cp1251"), ("latin_1", "cp1251"), ("cp866", "cp1251"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp1252", "koi8_r"), ("latin_1", "koi8_r"), ("latin_1", "iso8859_5"), ("mac_roman", "cp1251"), ("cp850", "cp1251"), ("cp437", "cp866"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"), ("cp1252", "cp866"), ("cp850", "cp866"))]
_LETTER = re.compile(r"[^\W\d_]")
_IN_WORD = re.compile(rf"(?<=[A-Za-z])[{re.escape(_INSIDE)}]+(?=[a-z])|(?<=[a-z])[À-ÖØ-Þ·˙˘ø](?=[a-zÀ-ÿ])|(?<=[A-Z])[√«»¬]+(?=[A-Z])|(?<=[a-z])[ÈËÒ](?![A-ZÀ-Þ])")
_CYRILLIC_IN_LATIN = re.compile(r"[A-Za-z][Ѐ-џ]|[Ѐ-џ][A-Za-z]{2}|[Ѐ-џ][a-z]")
_HIGH_RUN = re.compile(r"(?<![A-Za-z])[À-ÖØ-öø-ÿ]{4,}(?![A-Za-z])")
_KOI_CASE = re.compile(r"(?<![Ѐ-џA-Za-z])[а-яё][А-ЯЁ]{2,}(?![а-яё])")
_FRAMED_CYRILLIC = re.compile(r"[Ѐ-џ][─-▟√■№¤·°]+[а-яё]|[─-▟√■][а-яё]{2}|[а-яё]{2}[─-▟√■]+|[а-яё][ЁЄЇЎ][а-яЁЄЇЎ]")
_VOWELS = set("аеёиоуыэюяАЕЁИОУЫЭЮЯ")
# Frequent letter pairs of Russian.
_COMMON = set(
    "ст но то на ен ов ни ра во ко ро ал ер ол по от ре не ли ан ор та ть ос те ат го пр ка ет ит ла де да ел ва ри ти ие ло ле ин ис ом ве ск об ог ед ил че ам ем им ых ой ый ая ое ые ее ую ии ию до за пе вы со се са су ся "
    "чт ты вн ьн нн мо ме ма ми му ны ну ки ку кр кл гр др тр бр бо бы бе ба ви ас ах ус ур уд ут ук иб ич ия жд же жи жа ча чи щи ще эт эл вк юч лю чк тк".split()
)


def _russian_score(word: str) -> float:
    low = word.lower()
    return sum(low[i : i + 2] in _COMMON for i in range(len(low) - 1)) / max(1, len(low) - 1)


def _as_russian(words: list[str]) -> tuple[str, dict[int, int]] | None:
    """The single-byte reading under which the words look most Russian, if they clearly do."""
    best = None
    now = sum(_russian_score(w) for w in words if w[1:] == w[1:].lower() or w == w.upper()) / len(words)
    for read_as, written, table in _RUSSIAN_PAIRS:
        if all(all(ord(ch) in table or not _LETTER.match(ch) and ord(ch) < 0x80 for ch in w) for w in words):
            new = [w.translate(table) for w in words]
            if any(w[1:] != w[1:].lower() for w in new if len(w) > 1 and w != w.upper()):
                continue
            score = sum(_russian_score(w) for w in new) / len(new)
            if (best is None or score > best[0]) and score > now + 0.15 and score > 0.25:
                best = (score, f"{written} as {read_as}", table)
    return best[1:] if best else None


def _single_byte(line: str) -> tuple[str, str] | None:
    """(restored line, "written as read") of a line in which one single-byte code page was read as another."""
    if _HIGH_RUN.search(line) or _KOI_CASE.search(line) or _FRAMED_CYRILLIC.search(line):
        words = [w for w in re.findall(r"[^\s\d.,;:!?()+=/%-]+", line) if not w.isascii()]
        suspects = [w for w in words if _HIGH_RUN.search(w) or _KOI_CASE.search(w) or _FRAMED_CYRILLIC.search(w)]
        found = _as_russian(suspects) if suspects else None
        if found:
            name, table = found
            out = re.sub(r"[^\s\d.,;:!?()+=/%-]+", lambda m: m[0].translate(table) if not m[0].isascii() and all(ord(c) in table or ord(c) < 0x80 for c in m[0]) and _russian_score(m[0].translate(table)) >= _russian_score(m[0]) else m[0], line)
            return out, name
    evidence = [m for m in _LATIN_WORD.findall(line) if not m.isascii() and (_IN_WORD.search(m) or _CYRILLIC_IN_LATIN.search(m))]
    if not evidence:
        return None
    best = None
    for read_as, written, table in _WESTERN_PAIRS + _POLISH_PAIRS:
        good = 0
        for word in evidence:
            odd = [ch for ch in word if ord(ch) > 0x7F]
            new = word.translate(table)
            good += all(ord(ch) in table for ch in odd) and new != word and not _IN_WORD.search(new) and not re.search(r"[a-z][A-ZÀ-ÖØ-ÞĄĆĘŁŃŚŹŻ]", new)
        if good and (best is None or good > best[0]):
            best = (good, f"{written} as {read_as}", table)
    if best is None:
        return None
    _, name, table = best
    out = _LATIN_WORD.sub(lambda m: m[0].translate(table) if not m[0].isascii() and all(ord(ch) in table for ch in m[0] if ord(ch) > 0x7F) else m[0], line)
    return out, name


_ENTITY = re.compile(r"(?:&(?:[A-Za-z][A-Za-z0-9]{1,7}|#\d{2,5}|#x[0-9A-Fa-f]{2,4});[\x80-\xffŒ-™]?|[\x80-\xffŒ-™](?=&[A-Za-z#]))+")
_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")


_SUSPECT = re.compile("|".join(p.pattern for p in (_HIGH_RUN, _KOI_CASE, _FRAMED_CYRILLIC, _IN_WORD, _CYRILLIC_IN_LATIN)))
_SENTENCE_END = re.compile(r"\n|(?<=[.!?。]) ")


def _replace(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    parts, at = [], 0
    for a, b, _, new in spans:
        parts += [text[at:a], new]
        at = b
    return "".join([*parts, text[at:]])


def _unescape(text: str) -> str:
    """Entities of characters beyond ASCII as characters, where they make up a garbled span."""
    return _ENTITY.sub(lambda m: new if not (new := html.unescape(m[0])).isascii() and _utf8_spans(new) else m[0], text)


def _by_sentence(text: str, hint: re.Pattern, how: list[str]) -> str:
    """The text with each sentence that shows the hint restored from a single-byte reading, if it has one."""
    ends = [0, *(m.end() for m in _SENTENCE_END.finditer(text)), len(text)]
    parts = [text[a:b] for a, b in zip(ends, ends[1:])]
    for i, part in enumerate(parts):
        if hint.search(part) and (found := _single_byte(part)):
            parts[i] = found[0]
            how.append(found[1])
    return "".join(parts)


def _beyond_ascii(text: str) -> str:
    """The words of a text that have signs beyond ASCII, each once; the hints look no further than a word."""
    return " ".join(dict.fromkeys(w for w in text.split() if not w.isascii()))


def restore(text: str) -> tuple[bool, str, list[str]]:
    """(whether any passage is garbled, the text with every span restored that can be, the readings undone).

    A replacement sign or a control sign beyond ASCII marks a garbled passage that can't be restored and is kept.
    """
    if text.isascii() and "&" not in text:
        return False, text, []
    how: list[str] = []
    words = _beyond_ascii(text)
    if _HIGH_RUN.search(words):
        text = _by_sentence(text, _HIGH_RUN, how)
        words = _beyond_ascii(text)
    while True:  # wrong decodings may be stacked; each turn undoes one and makes the text shorter
        new = _unescape(text) if "&" in text else text
        if new != text:
            how.append("entities")
        if new != text:
            words = _beyond_ascii(new)
        spans = _japanese_spans(new, words)
        if not spans:
            spans = _utf8_spans(new)
        if spans:
            how += list(dict.fromkeys(f"utf_8 as {s[2]}" if " as " not in s[2] else s[2] for s in spans))
            new = _replace(new, spans)
        if new == text or len(new) >= len(text):
            break
        text, words = new, _beyond_ascii(new)
    if _SUSPECT.search(words):
        text = _by_sentence(text, _SUSPECT, how)
    if "�" in text:
        how.append("lost")
    elif _CONTROL.search(text):
        how.append("control")
    return bool(how), text, list(dict.fromkeys(how))


def mend(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds garbled (boolean), restored (the text, mended where possible), readings (array of what was undone) and words
    (of texts that aren't garbled: see sentence_words).

    Null texts give garbled false and restored null; empty texts stay. Texts are read whole, however long. Repeated rows
    stay; columns with the added names are replaced. There is no shuffle beyond spreading few partitions over the cores.
    """
    ship_package(df.sparkSession)

    def one(texts: pd.Series) -> pd.DataFrame:
        got = [(False, None, []) if t is None else restore(t) for t in texts]
        words = [[] if g[0] or g[1] is None or g[1].isascii() else [{"sentence": i, "words": w} for i, w in sentence_words(g[1])] for g in got]
        return pd.DataFrame({"garbled": [g[0] for g in got], "restored": [g[1] for g in got], "readings": [g[2] for g in got], "words": words})

    added = ["garbled", "restored", "readings", "words"]
    kind = "struct<garbled boolean, restored string, readings array<string>, words array<struct<sentence int, words array<string>>>>"
    out = spread(df.drop(*added)).withColumn("__mend", F.pandas_udf(one, kind)(text))
    return out.select(*[c for c in out.columns if c != "__mend"], "__mend.*")


#: A word is taken for garbled if another reading is at least so many times as frequent, in at least so many texts.
LEAST_RATIO, LEAST_TEXTS = 10, 3
_DIGITS = re.compile(r"\d+")


def _rereadings() -> dict[str, dict[int, int]]:
    """"written as read" of every two code pages: the signs that one shows for a byte, to those of the other."""
    out = {}
    for written in CODE_PAGES:
        for read_as in CODE_PAGES:
            table = {}
            for byte in range(0x80, 0x100):
                try:
                    seen, meant = bytes([byte]).decode(read_as), bytes([byte]).decode(written)
                except UnicodeDecodeError:
                    continue
                table[ord(seen)] = ord(meant)
            if any(k != v for k, v in table.items()):
                out[f"{written} as {read_as}"] = table
    return out


def reread(word: str, tables: dict[str, dict[int, int]]) -> list[tuple[str, str]]:
    """(reading, the word under it) of every reading that has all of the word's signs beyond ASCII and changes it."""
    high = {ord(ch) for ch in word if ord(ch) > 0x7F}
    return [(name, new) for name, table in tables.items() if high <= table.keys() and (new := word.translate(table)) != word]


def sentence_words(text: str) -> list[tuple[int, list[str]]]:
    """(number, words with signs beyond ASCII, digits alike) of the sentences that have any."""
    found = [(i, s) for i, s in enumerate(_SENTENCE_END.split(text)) if not s.isascii()]
    return [(i, list(dict.fromkeys(w for w in _DIGITS.sub("0", s).split() if not w.isascii()))) for i, s in found]


def odd_sentences(sentences: DataFrame, key: str) -> DataFrame:
    """key, sentence (its number), reading of sentences that a wrong single-byte reading explains, learned from the texts.

    sentences: key and words (what sentence_words gives of a text).

    Words, with their digits alike, are counted once per text. A sentence is garbled if one reading turns every word of it
    that has signs beyond ASCII into a word at least as frequent, and one of them into a word LEAST_RATIO times as frequent
    that LEAST_TEXTS have. Rows repeated with one key count once. Only words and keys are shuffled; of the joined tables
    the right one has only words that have a more frequent reading.
    """
    ship_package(sentences.sparkSession)
    each = sentences.select(key, F.explode("words").alias("s")).select(key, F.col("s.sentence").alias("sentence"), F.size("s.words").alias("k"), F.explode("s.words").alias("word"))
    counts = cut(each.select(key, "word").distinct().groupBy("word").agg(F.count("*").alias("n")))
    tables = sentences.sparkSession.sparkContext.broadcast(_rereadings())

    def read(column: pd.Series) -> pd.Series:
        return pd.Series([[{"reading": a, "new": b} for a, b in reread(w, tables.value)] for w in column], index=column.index)

    readings = counts.select("word", "n", F.explode(F.pandas_udf(read, "array<struct<reading string, new string>>")("word")).alias("r"))
    better = readings.join(counts.select(F.col("word").alias("new"), F.col("n").alias("m")), F.col("r.new") == F.col("new")).where(F.col("m") >= F.col("n"))
    better = better.select("word", "r.reading", ((F.col("m") >= F.col("n") * LEAST_RATIO) & (F.col("m") >= LEAST_TEXTS)).alias("far"))
    explained = each.join(better, "word").groupBy(key, "sentence", "reading").agg(F.count_distinct("word").alias("found"), F.first("k").alias("k"), F.max("far").alias("far"))
    usual = F.array_position(F.array(*[F.lit(x) for x in _rereadings()]), F.col("reading"))
    return explained.where((F.col("found") == F.col("k")) & F.col("far")).groupBy(key, "sentence").agg(F.min_by("reading", usual).alias("reading"))


def p10_found(spark, sf_dir: str) -> DataFrame:
    """doc_id of every document with a garbled passage."""
    mended = cut(mend(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "garbled", "words"))
    return mended.where("garbled").select("doc_id").unionByName(odd_sentences(mended, "doc_id").select("doc_id").distinct())


def p10_restored(spark, sf_dir: str) -> DataFrame:
    """doc_id, restored, readings of every document with a garbled passage."""
    mended = cut(mend(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "garbled", F.when(F.col("garbled"), F.col("restored")).alias("restored"), "readings", "words"))
    odd = odd_sentences(mended, "doc_id")
    by_text = odd.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sentence", "reading"))).alias("odd"))
    tables = spark.sparkContext.broadcast(_rereadings())

    def turn(texts: pd.Series, odd_: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, odd_):
            ends = [0, *(m.end() for m in _SENTENCE_END.finditer(text)), len(text)]
            parts = [text[a:b] for a, b in zip(ends, ends[1:])]
            for x in found:
                parts[x["sentence"]] = parts[x["sentence"]].translate(tables.value[x["reading"]])
            out.append("".join(parts))
        return pd.Series(out, index=texts.index)

    whole = read_table(spark, sf_dir, "documents").select("doc_id", "text").join(by_text, "doc_id")
    more = whole.select("doc_id", F.pandas_udf(turn, "string")("text", "odd").alias("restored"), F.array_distinct(F.transform("odd", lambda x: x["reading"])).alias("readings"))
    return mended.where("garbled").select("doc_id", "restored", "readings").unionByName(more)
