"""Unit strings to factors: dynamic programming over tries of prefixes, roots and exponents.

A unit string is cut into factors ``[prefix]root[exponent]`` joined by products and quotients. Three tries hold the
spellings; a table over string positions keeps, for each state, the cheapest decomposition. A string usually has
several decompositions (``min`` is minute or milli-inch, ``cd`` candela or centi-day); the cost of unusual pieces and
a prior on the dimension of the field that the value belongs to choose among them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

# Dimensions: length, mass, time, temperature.
_NONE, _LEN, _MASS, _TIME, _TEMP = (0, 0, 0, 0), (1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)
_VOLUME, _POWER, _ENERGY, _PRESSURE, _RATE = (3, 0, 0, 0), (2, 1, -3, 0), (2, 1, -2, 0), (-1, 1, -2, 0), (0, 0, -1, 0)
_FLOW = (3, 0, -1, 0)

# SI prefixes as symbols (case decides) and as words.
SYMBOL_PREFIXES = {"G": 1e9, "M": 1e6, "k": 1e3, "K": 1e3, "h": 1e2, "d": 1e-1, "c": 1e-2, "m": 1e-3, "µ": 1e-6, "u": 1e-6, "n": 1e-9, "p": 1e-12}
WORD_PREFIXES = {"giga": 1e9, "mega": 1e6, "kilo": 1e3, "hecto": 1e2, "deci": 1e-1, "centi": 1e-2, "milli": 1e-3, "micro": 1e-6, "nano": 1e-9, "pico": 1e-12}

_LITRE, _INCH, _FOOT, _POUND, _GALLON, _BTU = 1e-3, 0.0254, 0.3048, 0.45359237, 3.785411784e-3, 1055.05585262


@dataclass(frozen=True)
class Root:
    """A unit root; ``symbol`` and ``word`` say which prefixes it takes, ``offset`` is added before scaling to kelvin."""

    dims: tuple
    factor: float
    offset: float = 0.0
    symbol: bool = False
    word: bool = False
    cost: float = 0.0


def _roots() -> dict[str, Root]:
    out: dict[str, Root] = {}

    def add(names: str, dims: tuple, factor: float, **more) -> None:
        for name in names.split("|"):
            out[name] = Root(dims, factor, **more)

    # Spellings of units and their size in SI units.
    add("m", _LEN, 1, symbol=True)
    add("metre|metres|meter|meters|mètre|mètres|metro|metros", _LEN, 1, word=True)
    add('in|in.|inch|inches|Zoll|pouce|pouces|"|″|pulgada|pulgadas', _LEN, _INCH)
    add("ft|ft.|foot|feet|Fuß|'|′|pied|pieds", _LEN, _FOOT)
    add("yd|yard|yards", _LEN, 0.9144)
    add("micron|microns", _LEN, 1e-6)
    add("Å|angstrom|angstroms|ångström|Ångström", _LEN, 1e-10)
    add("g", _MASS, 1e-3, symbol=True)
    add("gr", _MASS, 1e-3, cost=0.5)
    add("gram|grams|gramme|grammes|Gramm|gramo|gramos", _MASS, 1e-3, word=True)
    add("t|tonne|tonnes|Tonne|Tonnen|tonelada|toneladas", _MASS, 1e3)
    add("lb|lb.|lbs|lbs.|pound|pounds|libra|libras|Pfund", _MASS, _POUND)
    add("oz|oz.|ounce|ounces", _MASS, _POUND / 16)
    add("s", _TIME, 1, symbol=True)
    add("sec|sec.|secs|second|seconds|Sekunde|Sekunden|Sek.|seconde|secondes|segundo|segundos", _TIME, 1, word=True)
    add("min|min.|mins|minute|minutes|Minute|Minuten|minuto|minutos", _TIME, 60)
    add("h|hr|hr.|hrs|hrs.|hour|hours|Std|Std.|Stunde|Stunden|heure|heures|hora|horas", _TIME, 3600)
    add("d|day|days|Tag|Tage|Tagen|jour|jours|día|días", _TIME, 86400)
    add("wk|week|weeks|Woche|Wochen", _TIME, 604800)
    add("a|yr|yr.|year|years|Jahr|Jahre|an|ans|année|año|años|annum", _TIME, 365 * 86400)
    add("K|kelvin|kelvins|Kelvin", _TEMP, 1)
    add("°C|℃|degC|deg C|deg. C|degrees Celsius|degree Celsius|Celsius|º C|ºC|° C|Grad Celsius|Grad C", _TEMP, 1, offset=273.15)
    add("C", _TEMP, 1, offset=273.15, cost=1)
    add("°F|℉|degF|deg F|deg. F|degrees Fahrenheit|degree Fahrenheit|Fahrenheit|º F|ºF|° F|Grad Fahrenheit", _TEMP, 5 / 9, offset=459.67)
    add("F", _TEMP, 5 / 9, offset=459.67, cost=1)
    add("°K|° K|deg K", _TEMP, 1)
    add("L|l", _VOLUME, _LITRE, symbol=True)
    add("litre|litres|liter|liters|Liter|Litern|litro|litros", _VOLUME, _LITRE, word=True)
    add("cc|ccm", _VOLUME, 1e-6)
    add("gal|gal.|US gal|US gal.|gal US|gal (US)|gal. (US)|US gallon|US gallons|gallon|gallons|gallons (US)|gal(US)|USgal", _VOLUME, _GALLON)
    add("UK gal|imp gal|imp. gal|gal (UK)|Imperial gallons", _VOLUME, 4.54609e-3)
    add("cu ft|cu. ft.|cu.ft.|cu. ft|cuft|cubic feet|cubic foot", _VOLUME, _FOOT**3)
    add("cu in|cu. in.|cubic inch|cubic inches", _VOLUME, _INCH**3)
    add("cubic metres|cubic metre|cubic meters|cubic meter|Kubikmeter|cbm|mètres cubes", _VOLUME, 1)
    add("cubic centimetres|cubic centimetre|cubic centimeters", _VOLUME, 1e-6)
    add("cubic decimetres|cubic decimetre|cubic decimeters", _VOLUME, 1e-3)
    add("W", _POWER, 1, symbol=True)
    add("w", _POWER, 1, symbol=True, cost=0.5)
    add("watt|watts|Watt|vatios", _POWER, 1, word=True)
    add("hp|HP", _POWER, 745.69987158)
    add("PS|CV", _POWER, 735.49875)
    add("J", _ENERGY, 1, symbol=True)
    add("joule|joules|Joule", _ENERGY, 1, word=True)
    add("Wh|wh|W h|W·h", _ENERGY, 3600, symbol=True)
    add("watt hour|watt hours|watt-hours|Wattstunden", _ENERGY, 3600, word=True)
    add("BTU|Btu|btu", _ENERGY, _BTU)
    add("cal", _ENERGY, 4.184, symbol=True)
    add("Pa", _PRESSURE, 1, symbol=True)
    add("pascal|pascals|Pascal", _PRESSURE, 1, word=True)
    add("bar|Bar|BAR|bars", _PRESSURE, 1e5, symbol=True, word=True)
    add("psi|PSI|Psi|lbf/in²|lbf/in2|lb/in²|lbs/in²", _PRESSURE, 6894.757293168)
    add("atm", _PRESSURE, 101325)
    add("Torr|torr|mmHg|mm Hg", _PRESSURE, 133.322387415)
    add("lbf", (1, 1, -2, 0), 4.4482216152605)
    add("N", (1, 1, -2, 0), 1, symbol=True)
    add("rpm|RPM|r.p.m.|rev/min", _RATE, 1 / 60, symbol=True)
    add("rps|RPS", _RATE, 1)
    add("Hz", _RATE, 1, symbol=True)
    add("lpm|LPM", _FLOW, _LITRE / 60)
    add("lph", _FLOW, _LITRE / 3600)
    add("gpm|GPM", _FLOW, _GALLON / 60)
    add("U|Umdr.|Umdr|Umdrehungen|rev|revs|revolutions|tr|tours|r", _NONE, 1, cost=0.2)
    return out


_DIGITS = {"0": "⁰", "1": "¹", "2": "²", "3": "³", "4": "⁴"}


def _exponents() -> dict[str, int]:
    out = {}
    for n in (1, 2, 3, 4):
        sup, low = _DIGITS[str(n)], str(n)
        for text in (sup, f"^{low}", f"**{low}", *([low] if n > 1 else [])):
            out[text] = n
        for text in (f"⁻{sup}", f"^-{low}", f"-{low}", f"−{low}", f"^−{low}", f"^(-{low})"):
            out[text] = -n
    return out


def trie(words: dict) -> dict:
    """A nested-dict trie; the value of a word stands under the empty key."""
    top: dict = {}
    for word, value in words.items():
        node = top
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = value
    return top


def walk(node: dict, text: str, i: int):
    """Every (end, value) of a word of the trie that starts at i."""
    while True:
        if "" in node:
            yield i, node[""]
        if i >= len(text) or text[i] not in node:
            return
        node = node[text[i]]
        i += 1


# Joining signs of two factors, and whether what follows is divided by.
_JOINS = trie({"/": True, " / ": True, "/ ": True, " /": True, " per ": True, " pro ": True, " par ": True, " por ": True, " je ": True, "·": False, "⋅": False, "*": False, " · ": False, " * ": False, ".": False, " ": False, "-": False, "×": False})
_SCALES = trie({"×10³ ": 1e3, "× 10³ ": 1e3, "x10³ ": 1e3, "x 10³ ": 1e3, "×10^3 ": 1e3, "x10^3 ": 1e3, "×1000 ": 1e3, "x1000 ": 1e3, "x 1000 ": 1e3, "× 1000 ": 1e3, "1000 ": 1e3, "×10⁶ ": 1e6, "×10⁻³ ": 1e-3, "×10³": 1e3, "x1000": 1e3})
_NUMBERS = trie({f"{n}{gap}": float(n) for n in (1, 10, 12, 24, 60, 100, 365, 1000) for gap in ("", " ")})
_ROOTS, _SYMBOLS, _WORDS, _POWERS = trie(_roots()), trie(SYMBOL_PREFIXES), trie(WORD_PREFIXES), trie(_exponents())


@dataclass(frozen=True)
class Unit:
    """value_in_SI = (value + offset) * factor; end: characters used."""

    dims: tuple
    factor: float
    offset: float
    end: int
    cost: float


def fold_unit(text: str) -> str:
    """One spelling for signs that look alike; white space collapsed."""
    text = text.replace("μ", "µ").replace("Å", "Å").replace("−", "-").replace(" ", " ").replace(" ", " ").replace(" ", " ")
    return " ".join(text.split())


def _factors(text: str, i: int, low: str):
    """Every (end, dims, factor, offset, cost) of one [prefix]root[exponent] at i; case costs when it must be folded."""
    seen = [(i, 1.0, "", 0.0)]
    seen += [(j, p, "s", 0.6) for j, p in walk(_SYMBOLS, text, i)] + [(j, p, "w", 0.2) for j, p in walk(_WORDS, low, i)]
    for j, scale, kind, paid in seen:
        found: dict[int, tuple] = {}
        for source, fee in ((text, 0.0), (low, 0.7)):
            for k, root in walk(_ROOTS, source, j):
                if (kind == "s" and not root.symbol) or (kind == "w" and not root.word):
                    continue
                if k not in found or fee + root.cost < found[k][1]:
                    found[k] = (root, fee + root.cost)
        for k, (root, fee) in found.items():
            for end, power in [(k, 1), *walk(_POWERS, text, k)]:
                offset = root.offset if power == 1 and not kind else 0.0
                yield end, tuple(d * power for d in root.dims), (scale * root.factor) ** power, offset, 1.0 + paid + fee


def _ends(text: str, i: int) -> bool:
    return i >= len(text) or not (text[i].isalnum() or text[i] in "²³¹⁻°%/^")


def parses(text: str) -> list[Unit]:
    """All kept decompositions of a leading part of the text that ends at a word's end. text must be folded."""
    low = text.lower()
    # state: (position, divided, dims, factor rounded) -> (cost, factor, offset, factors so far)
    table: dict[tuple, tuple] = {}
    queue: list[tuple] = []

    def put(i, divided, dims, factor, offset, n, cost):
        key = (i, divided, dims, f"{factor:.9e}", offset, min(n, 1))
        if key not in table or cost < table[key][0]:
            table[key] = (cost, factor, n)
            queue.append((i, divided, dims, factor, offset, n, cost))

    put(0, False, _NONE, 1.0, 0.0, 0, 0.0)
    for end, scale in walk(_SCALES, text, 0):
        put(end, False, _NONE, scale, 0.0, 0, 0.1)
    for end, number in walk(_NUMBERS, text, 0):
        if text[end : end + 1] == "/":
            put(end + 1, True, _NONE, number, 0.0, 1, 0.5)
    out: dict[tuple, Unit] = {}
    at = 0
    while at < len(queue):
        i, divided, dims, factor, offset, n, cost = queue[at]
        at += 1
        starts = [(i, 1.0, 0.0)] + ([(j, number, 0.4) for j, number in walk(_NUMBERS, text, i) if j > i] if divided else [])
        for j, number, fee in starts:
            for end, more, scale, shift, price in _factors(text, j, low):
                sign = -1 if divided else 1
                new_dims = tuple(a + sign * b for a, b in zip(dims, more))
                new_factor = factor * (scale * number) ** sign
                new_offset = shift if n == 0 and factor == 1.0 and not divided else 0.0
                total = cost + price + fee
                if n and offset:
                    new_offset = 0.0
                if _ends(text, end):
                    key = (end, new_dims, f"{new_factor:.9e}", new_offset)
                    if key not in out or total < out[key].cost:
                        out[key] = Unit(new_dims, new_factor, new_offset, end, total)
                for k, div in walk(_JOINS, text, end):
                    if k > end:
                        put(k, div, new_dims, new_factor, new_offset, n + 1, total + (0.0 if div else 0.8))
    return list(out.values())


# How much a reading that has the field's own dimension is preferred.
PRIOR = 6.0


@lru_cache(maxsize=65536)
def best_unit(text: str, dims: tuple, whole: bool = False) -> Unit | None:
    """The cheapest decomposition under the field's dimension prior; None unless it has that dimension.

    Longer readings win before cheaper ones (``L/min`` is not ``L``). whole: all of the text must be used.
    """
    text = fold_unit(text)
    if not text:
        return None
    found = [u for u in parses(text) if not whole or not text[u.end :].strip(" .")]
    if not found:
        return None
    best = min(found, key=lambda u: (u.cost - (PRIOR if u.dims == dims else 0.0) - 1.5 * u.end / 2))
    return best if best.dims == dims else next(iter(sorted((u for u in found if u.dims == dims), key=lambda u: (-u.end, u.cost))), None) if whole else (best if best.dims == dims else None)


@lru_cache(maxsize=4096)
def common(unit: str) -> Unit:
    """The decomposition of a reference unit by itself, without a prior."""
    text = fold_unit(unit)
    found = [u for u in parses(text) if u.end == len(text)]
    if not found:
        raise ValueError(f"unknown unit {unit!r}")
    return min(found, key=lambda u: u.cost)


def conversion(text: str, common_unit: str, whole: bool = False) -> tuple[float, float] | None:
    """(scale, shift) with value_in_common = value * scale + shift, or None if the text opens with no unit of that dimension."""
    to = common(common_unit)
    unit = best_unit(text, to.dims, whole)
    if unit is None:
        return None
    scale = unit.factor / to.factor
    shift = (unit.offset * unit.factor) / to.factor - to.offset if (to.offset or unit.offset) and to.dims == _TEMP else 0.0
    return scale, shift


@lru_cache(maxsize=65536)
def unit_in_label(label: str, common_unit: str) -> tuple[float, float] | None:
    """The unit that a label carries in brackets or after ``/``, ``in`` or a comma at its end."""
    label = fold_unit(label)
    tries = []
    for a, b in ("()", "[]", "{}"):
        if label.rstrip().endswith(b):
            depth = 0
            for i in range(len(label) - 1, -1, -1):
                depth += (label[i] == b) - (label[i] == a)
                if depth == 0:
                    tries.append(label[i + 1 : -1])
                    break
    for mark in (" in ", " / ", ", ", ": ", " - "):
        if mark in label:
            tries.append(label.rsplit(mark, 1)[1])
    for text in tries:
        if (found := conversion(text.strip(), common_unit, True)) is not None:
            return found
    return None
