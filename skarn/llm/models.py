"""What a listing says about maker and model: the facts that veto a match of two similar titles."""

from __future__ import annotations

import re
import unicodedata

from skarn.functions.lexicon import distance

_VOLTAGE = re.compile(r"(?:[-\s]*(?:UL|CE|CSA))*[-\s]*\b\d{3}\s?V\b(?:[\s-]*(?:UL|CE|CSA))*\s*$")
_BASE = re.compile(r"^([^\W\d_]{3,})[\s\-–]*(\d{3,5})[\s\-–]*([A-Za-z]*)$")
# Openings of sentences that name another model than the one sold.
_OTHER = re.compile(r"(?:compatible? (?:with|mit|avec|con)|kompatibel mit|successor (?:to|of)|smaller batches|larger batches|see|siehe|voir|véase|nachfolger (?:des|von)|vorgänger|predecessor|replaces|ersetzt|remplace|sustituye|instead of|statt|not for|nicht für|unlike|alternative)[^.!?]{0,40}$", re.I)
_LEGAL = re.compile(r"\b(?:gmbh|ltd|inc|s\.?a\.?|ag|co|kg|llc|srl|bv|plc|corp)\b\.?|[®™©]", re.I)
_BETWEEN = r"(?:[\s\-–]*\b(?:no|nr|type|typ|serie|series|model|modell|modèle|modelo|baureihe|n°|nº)\b\.?)?[\s\-–.:]*"
_SUFFIX = r"(?:[\s\-–]{0,2}(plus|pro|[A-Z]{1,2}))?(?![\w])"

_NAME = re.compile(r"[^\W\d_]{3,}")
_BEHIND = re.compile(_BETWEEN + r"(\d{3,5}|\d{2}-\d{2}(?!\d))" + _SUFFIX.replace("[A-Z]{1,2}", "[a-z]{1,2}"))
_BEFORE = re.compile(r"(?<![\w.,])(\d{3,5})(?:[\s\-–]{0,2}(plus|[a-z]{1,2}))?[\s\-–]+([^\W\d_]{3,})\b")
_YEAR = re.compile(r"(?:19|20)\d\d$")
_STEM = re.compile(r"(?<![\w])([^\W\d_]{3})[\s\-–]?(\d{3,5})" + _SUFFIX.replace("[A-Z]{1,2}", "[a-z]{1,2}"))
# Words before a number that are no name, and units that make a number an amount.
_NO_NAMES = {"type", "typ", "serie", "series", "model", "modell", "modele", "modelo", "baureihe", "from", "with", "and", "bis", "max", "min", "art", "sku"}
_AMOUNT = re.compile(r"[.,]\d|\s?(?:ml|l|w|v|hz|kw|rpm|mm|cm|kg|g|bar|mbar|min|x|%|°|µ)(?![a-z])")


def plain(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.replace("ø", "o").replace("Ø", "O").replace("ß", "ss"))
    return "".join(ch for ch in text if not unicodedata.combining(ch)).lower()


def maker_key(text: str | None) -> str:
    """The maker's name without its legal form; empty if there is none."""
    if not text:
        return ""
    key = re.sub(r"[^a-z0-9]+", "", plain(_LEGAL.sub(" ", text)))
    return key if len(key) > 1 and key not in ("na", "ka", "tbd", "none", "unknown") else ""


def suffix_key(text: str | None) -> str:
    """Plus and P are one suffix."""
    return (text or "").strip(" -–").upper()[:1]


def base_of(text: str | None) -> tuple[str, str, str] | None:
    """(series, number, suffix) of a variant's or type's designation, its mains voltage and approvals put aside."""
    if not text:
        return None
    m = _BASE.match(_VOLTAGE.sub("", text).strip(" -–"))
    return (plain(m[1]), m[2], suffix_key(m[3])) if m else None


class Names:
    """Finds a known series with its number in free text. series: the names that designations of the corpus use.

    Texts are taken apart into words that are looked up, so the number of names costs no time; misspelt names are found
    under what one deletion leaves of them.
    """

    def __init__(self, series: list[str]):
        self.series = set(series)
        self.stems: dict[str, list[str]] = {}
        self.cuts: dict[str, list[str]] = {}
        for s in sorted(self.series):
            self.stems.setdefault(s[:3], []).append(s)
            for part in {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}:
                self.cuts.setdefault(part, []).append(s)

    def near(self, word: str) -> str | None:
        """The series that the word misspells by one edit or one swap of neighbours."""
        found = {s for part in {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} for s in self.cuts.get(part, ()) if s != word and distance(word, s, 1) <= 1}
        return min(found, key=lambda s: (-len(s), s)) if found else None

    def all_in(self, text: str) -> list[tuple[str, str, str, int]]:
        """(series, number, suffix, position) of every mention."""
        low = plain(text)
        return [(w[0], m[1].replace("-", ""), suffix_key(m[2]), w.start()) for w in _NAME.finditer(low) if w[0] in self.series and (m := _BEHIND.match(low, w.end()))]

    def in_title(self, title: str) -> tuple[str, str, str] | None:
        """The model that a title names: a series with its number behind or before it, a shortened or a misspelt series; else
        a word that no designation uses, with a number behind it that is no amount."""
        low = plain(title)
        words = [(w[0], m) for w in _NAME.finditer(low) if (m := _BEHIND.match(low, w.end()))]
        for word, m in words:
            if word in self.series:
                return word, m[1].replace("-", ""), suffix_key(m[2])
        for m in _BEFORE.finditer(low):
            if m[3] in self.series and not (_YEAR.match(m[1]) and low[: m.start()].strip()):  # "edition 2025" of a series
                return m[3], m[1], suffix_key(m[2])
        for m in _STEM.finditer(low):
            if len(self.stems.get(m[1], ())) == 1:
                return self.stems[m[1]][0], m[2], suffix_key(m[3])
        plain_number = [(w, m) for w, m in words if m[1].isdigit()]
        for word, m in plain_number:
            if len(word) >= 4 and (s := self.near(word)):
                return s, m[1], suffix_key(m[2])
        if self.series_in(title):
            return None
        for word, m in plain_number:
            if word not in _NO_NAMES and not _AMOUNT.match(low, m.end(1)):
                return word, m[1], suffix_key(m[2])
        return None

    def series_in(self, title: str) -> str:
        return next((w[0] for w in _NAME.finditer(plain(title)) if w[0] in self.series), "")

    def in_description(self, text: str) -> tuple[str, str, str] | None:
        """The model that a description says is sold: the one most often named, not counting references to others."""
        votes: dict[tuple, int] = {}
        for s, n, x, at in self.all_in(text):
            if not _OTHER.search(text[max(0, at - 70) : at]):
                votes[(s, n, x)] = votes.get((s, n, x), 0) + 1
        if not votes:
            return None
        numbers: dict[tuple, int] = {}
        for (s, n, _), k in votes.items():
            numbers[(s, n)] = numbers.get((s, n), 0) + k
        best = max(numbers, key=lambda k: (numbers[k], k))
        if sum(v == numbers[best] for v in numbers.values()) > 1:
            return None
        return max((v, len(k[2]), k) for k, v in votes.items() if k[:2] == best)[2]


def model_of(names: Names, title: str | None, designation: str | None, variants, description: str | None) -> tuple[str, str, str, str]:
    """(series, number, suffix, where from). A designation decides, then the title, the variants, the description."""
    if found := base_of(designation):
        return *found, "designation"
    of_variants = [b for b in (base_of(v) for v in (variants if variants is not None else [])) if b]
    in_title = names.in_title(title) if title else None
    if in_title:
        return *in_title, "title"
    if of_variants:
        return *max(set(of_variants), key=lambda b: (of_variants.count(b), b)), "variants"
    if description and (found := names.in_description(description)):
        return *found, "description"
    return (names.series_in(title) if title else ""), "", "", ""
