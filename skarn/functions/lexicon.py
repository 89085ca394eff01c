"""Spelling-tolerant lookup of short names in a reference list.

A symmetric-delete index answers bounded edit-distance queries by dictionary lookups: every key stands under all texts
that up to ``MAX_EDITS`` deletions in its first ``PREFIX`` letters give, and a query looks up its own deletions. That
finds every key within so many edits (an exchange of neighbours is one), whatever the length. Hits are verified and
ranked by a weighted Damerau-Levenshtein distance, then by how often the entry is used.

This module is the shared helper of two operators: the wide tables (problem 4), whose cells carry freely typed
attributes, and the mapping of names with its report of misses (problem 3).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import combinations

MAX_EDITS, PREFIX = 3, 12

# Letters that canonical decomposition leaves whole, and umlauts written as two letters.
_PLAIN = str.maketrans({"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "₂": "2", "’": "'", "`": "'", "´": "'"})
_TWO_LETTERS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue"})
# Words that surround a name on menus and in tables but are no part of it.
LEADING = {"all", "our", "new"}
_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|[¹²³⁴]\)")
_SEPARATORS = re.compile(r"\s*(?:[|>»«›•*&:;,]|/|\s[–—]\s|\s-\s|^-\s*|^[–—]\s*)\s*")
# Customary shortenings that are no beginning of the word, or stand inside a compound.
_SHORT = [(re.compile(r"vol\.(?=\w)", re.I), "volume"), (re.compile(r"\bwt\.", re.I), "weight"), (re.compile(r"\bno\.", re.I), "number"), (re.compile(r"\bspectro(?=s?\b)", re.I), "spectrophotometer")]


def fold(text: str, two_letters: bool = False) -> str:
    """Lower case, without accents; hyphens and underscores are spaces; white space collapsed."""
    text = unicodedata.normalize("NFC", text).lower()
    if two_letters:
        text = text.translate(_TWO_LETTERS)
    text = unicodedata.normalize("NFKD", text.translate(_PLAIN))
    text = "".join(ch for ch in text if not unicodedata.combining(ch))
    return " ".join(text.replace("_", " ").replace("-", " ").replace("'", " ").split())


def squeezed(text: str) -> str:
    """Letters and digits only."""
    return "".join(ch for ch in text if ch.isalnum())


def _unled(form: str) -> str:
    """Without words that only lead up to the name."""
    while True:
        first, _, rest = form.partition(" ")
        if first not in LEADING or not rest:
            return form
        form = rest


def forms(text: str) -> list[str]:
    """Folded readings of a freely typed name: whole, without brackets, its parts, and inverted parts turned round."""
    text = text.replace("_", " ").replace("\xa0", " ")
    readings = [text]
    if text.count("-") > 1 and " " not in text.strip():
        readings.append(text.replace("-", " "))
    full = readings[-1]
    for pattern, word in _SHORT:
        full = pattern.sub(word, full)
    if full != readings[-1]:
        readings.append(full)
    out = []
    for reading in readings:
        bare = _BRACKETS.sub(" ", reading)
        parts = [_unled(p) for p in (fold(x) for x in _SEPARATORS.split(bare)) if squeezed(p)]
        out += [fold(reading), _unled(fold(bare)), " ".join(parts)]
        for i, part in enumerate(parts):
            out.append(part)
            for j in range(i + 1, min(i + 3, len(parts))):
                out += [" ".join([*parts[j : j + 1], *parts[i:j]]), " ".join(parts[i : j + 1])]
    return list(dict.fromkeys(x for x in out if squeezed(x)))


def deletions(text: str, edits: int) -> set[str]:
    """The text's first PREFIX letters with exactly so many letters left out (as many as there are, if there are fewer)."""
    head = text[:PREFIX]
    return {"".join(kept) for kept in combinations(head, max(0, len(head) - edits))}


def allowed(length: int) -> int:
    """Edits that a key of this length may be away."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 10 else MAX_EDITS


#: What an edit costs: any, one of a letter that doubles its neighbour, an exchange of neighbours; the least of them.
PLAIN, DOUBLED, EXCHANGED = 1.0, 0.6, 0.7
LEAST = min(PLAIN, DOUBLED, EXCHANGED)


def distance(a: str, b: str, most: int) -> float:
    """Weighted Damerau-Levenshtein distance by an alignment of at most so many edits; infinity if there is none.

    Cells hold the least weight for each number of edits, so that the bound counts edits and the weights only rank.
    """
    none = float("inf")
    if abs(len(a) - len(b)) > most:
        return none
    if a == b:
        return 0.0
    cost = lambda text, i: DOUBLED if i > 1 and text[i - 1] == text[i - 2] else PLAIN
    levels, columns = range(most + 1), range(len(b) + 1)
    row = [[none] * (most + 1) for _ in columns]
    row[0][0] = 0.0
    for j in range(1, min(len(b), most) + 1):
        row[j][j] = row[j - 1][j - 1] + cost(b, j)
    before: list[list[float]] = []
    for i in range(1, len(a) + 1):
        x, gone = a[i - 1], cost(a, i)
        new = [[none] * (most + 1) for _ in columns]
        if i <= most:
            new[0][i] = row[0][i - 1] + gone
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y, come, cell, up, left, corner = b[j - 1], cost(b, j), new[j], row[j], new[j - 1], row[j - 1]
            swap = before[j - 2] if i > 1 and j > 1 and x != y and x == b[j - 2] and a[i - 2] == y else None
            for k in levels:
                best = corner[k] if x == y else none
                if k:
                    best = min(best, up[k - 1] + gone, left[k - 1] + come, corner[k - 1] + PLAIN)
                    if swap is not None:
                        best = min(best, swap[k - 1] + EXCHANGED)
                cell[k] = best
        if all(w == none for cell in new for w in cell):
            return none
        before, row = row, new
    return min(row[-1])


class Lexicon:
    """The symmetric-delete index of a reference list: (id, names) in order, with how often each entry is used."""

    #: A reference list is a fixed list; beyond so many names the index is no longer small enough to broadcast.
    MOST_NAMES = 200_000

    def __init__(self, entries: list[tuple[int, list[str]]], uses: dict[int, int] | None = None):
        if sum(len(names) for _, names in entries) > self.MOST_NAMES:
            raise ValueError(f"over {self.MOST_NAMES} names: shard the reference list")
        self.uses = uses or {}
        self.keys: dict[str, int] = {}
        self.words: list[tuple[int, list[str]]] = []
        for ref, names in entries:
            for name in names:
                for two in (False, True):
                    folded = fold(name, two)
                    self.keys.setdefault(squeezed(folded), ref)
                    if not two:
                        self.words.append((ref, folded.split()))
        self.index: dict[str, list[str]] = {}
        for key in self.keys:
            for part in {x for edits in range(allowed(len(key)) + 1) for x in deletions(key, edits)}:
                self.index.setdefault(part, []).append(key)
        #: names by number of words, place and first letter of a word: an abbreviated word keeps its first letter.
        self.initials: dict[tuple[int, int, str], list[tuple[int, list[str]]]] = {}
        for ref, names in self.words:
            for i, word in enumerate(names):
                self.initials.setdefault((len(names), i, word[0]), []).append((ref, names))

    def near(self, key: str, best: tuple[float, int, int] | None = None) -> tuple[float, int, int] | None:
        """(distance, -uses, id) of the closest entry within the bound of the key's length, if closer than best.

        Keys that need k edits share a text with k deletions or fewer and cost at least k times LEAST, so the search ends
        where that is more than the best found.
        """
        seen = set()
        for edits in range(allowed(len(key)) + 1):
            if best and edits * LEAST > best[0]:
                break
            for part in deletions(key, edits):
                for other in self.index.get(part, ()):
                    if other in seen:
                        continue
                    seen.add(other)
                    d = distance(key, other, min(allowed(len(key)), allowed(len(other))))
                    if d < float("inf"):
                        ref = self.keys[other]
                        found = (d, -self.uses.get(ref, 0), ref)
                        best = min(best, found) if best else found
        return best

    def abbreviated(self, form: str) -> tuple[float, int, int] | None:
        """The entry whose words the form abbreviates one by one; a shortened word ends with a dot."""
        words = form.split()
        first = next((i for i, w in enumerate(words) if w.endswith(".")), None)
        if first is None:
            return None
        best = None
        for ref, names in self.initials.get((len(words), first, words[first][0]), ()):
            total = 0.0
            for short, name in zip(words, names):
                if short.endswith("."):
                    stem = short.rstrip(".")
                    ok = len(stem) >= 2 and name.startswith(stem) and len(name) > len(stem) or (stem == "no" and name == "number")
                    total += 0.2 if ok else float("inf")
                elif short != name:
                    total += distance(short, name, allowed(len(name)))
            if total <= MAX_EDITS:
                found = (total, -self.uses.get(ref, 0), ref)
                best = min(best, found) if best else found
        return best

    @lru_cache(maxsize=262144)  # noqa: B019 - one index per worker
    def find(self, text: str) -> tuple[int, float]:
        """(id, distance) of the entry meant by a text; (-1, nan) if none is."""
        tries = forms(text)
        for form in tries:
            key = squeezed(form)
            if key in self.keys:
                return self.keys[key], 0.0
        best = None
        for form in tries:
            best = self.near(squeezed(form), best)
            found = self.abbreviated(form)
            if found:
                best = min(best, found) if best else found
        return (best[2], best[0]) if best else (-1, float("nan"))

    def __reduce__(self):
        return _rebuild, (self.keys, self.words, self.index, self.initials, self.uses)


def _rebuild(keys, words, index, initials, uses):
    new = Lexicon([])
    new.keys, new.words, new.index, new.initials, new.uses = keys, words, index, initials, uses
    return new
