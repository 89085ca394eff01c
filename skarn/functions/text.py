"""Names, labels and codes in text as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A code of three groups, the first with a digit.
ORDER_CODE = r"(?i)\b(?=[A-Z0-9]*\d)[A-Z0-9]{2,}[-./][A-Z0-9]{2,}[-./][A-Z0-9]{1,}\b"
DATE_START = r"^(?:\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{2,4})"
# Interfaces by what pages call them.
INTERFACES = {
    "RS-232": r"\bRS[-\s]?232\b",
    "RS-485": r"\bRS[-\s]?485\b",
    "USB": r"\bUSB\b",
    "Ethernet": r"\bEthernet\b|\bRJ[-\s]?45\b|\bTCP/IP\b|\bLAN\b",
    "CAN": r"\bCAN[-\s]?bus\b",
    "GPIB": r"\bGPIB\b|\bIEEE[-\s]?488\b",
    "Bluetooth": r"\bBluetooth\b",
    "WLAN": r"\bWLAN\b|\bWi[-\s]?Fi\b",
    "SiLA": r"\bSiLA[-\s]?2?\b",
    "OPC-UA": r"\bOPC[-\s]?UA\b",
    "Modbus": r"\bModbus\b",
    "Serial": r"\bserial\s+(?:port|interface|connection)\b",
    "Analog I/O": r"\banalog(?:ue)?\s+(?:inputs?|outputs?|i/o|interface)\b",
    "Digital I/O": r"\bdigital\s+(?:inputs?|outputs?|i/o|interface)\b",
}
#: Build tokens that say where a device is sold, not what it is.
REGIONAL = r"(?i)\b(?:\d{2,3}\s*v(?:ac)?|\d{2,3}\s*-\s*\d{2,3}\s*v|ul|ce|csa|\d{2}/\d{2}\s*hz|\d{2}\s*hz)\b"
LONG_CODE = r"\b[A-Z]{0,4}\d[\dA-Za-z]*(?:-[\dA-Za-z]+){2,}\b"
VOLTAGE_END = r"(?i)[-_ ]*(ul|ce|csa)?[-_ ]*\d{2,3}\s*v(ac)?$"
# Openings of link texts that call to action.
CALL = r"(?i)^(?:read more|learn more|find out more|discover(?: more)?|explore|view|see|more info(?:rmation)?|details|shop)(?: about| on| the)?\s*[:\-–]?\s*"
# File names of data sheets, and of other documents.
SHEET_GOOD = r"(?i)data[\s_-]?sheet|datenblatt|spec(?:ification)?s?|technical|tech[\s_-]?data|product[\s_-]?(?:note|sheet|info)|brochure|flyer|leaflet"
SHEET_BAD = (
    r"(?i)manual|handbuch|instruction|ifu|sds|msds|safety|certificat|declaration|conformity|app(?:lication)?[\s_-]?note|poster|case[\s_-]?stud|white[\s_-]?paper|press|price|terms|warranty|coa\b|recycl|policy|"
    r"quick[\s_-]?(?:start|guide)|install|release[\s_-]?notes|webinar|citation|publication|journal|catalog(?:ue)?|training|obsolescence|letter|newsletter|flyer-event"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\x{00a0}]+", " "))


def attribute_key(text: Column) -> Column:
    """Lower case; runs of other than a-z and 0-9 are underscores; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def attribute_words(text: Column) -> Column:
    """Lower case; other than letters, digits and blanks are blanks."""
    return F.trim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9 ]+", " "))


def variant_words(text: Column) -> Column:
    """A variant's name without order codes, regional tokens and approvals: what hardware it is."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), LONG_CODE, " "), REGIONAL, " ")
    t = F.regexp_replace(t, r"(?i)(?<=\d)(?:ul|ce|csa)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9 ]+", " "), " +", " "))


def common_prefix(a: Column, b: Column) -> Column:
    """The longest text that both begin with."""
    n = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    return F.substring(a, F.lit(1), n)


def group_name(names: Column) -> Column:
    """The name of a group of variants: their common start if it has three characters, else the first without its voltage.

    The common start of many names is that of the least and the greatest.
    """
    kept = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n.isNotNull() & (n != ""))

    def name(ns: Column) -> Column:
        first = F.try_element_at(ns, F.lit(1))
        bare = F.regexp_replace(F.regexp_replace(first, VOLTAGE_END, ""), "^[ _-]+|[ _-]+$", "")
        alone = F.when(bare != "", bare).otherwise(first)
        shared = F.regexp_replace(common_prefix(F.array_min(ns), F.array_max(ns)), r"^[ _/(-]+|[ _/(-]+$", "")
        return F.when(F.size(ns) == 0, "").when(F.size(ns) == 1, alone).when(F.length(shared) >= 3, shared).otherwise(alone)

    return let(kept, name)


def clean_label(text: Column) -> Column:
    """Without arrows at the end; trademark signs joined to their word."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*[▶►▸›»→➔]+\s*$", "")
    t = F.regexp_replace(t, r"\s+([®™©])", "$1")
    return squeeze(F.regexp_replace(t, r"\s+TM\b", "™"))


def clean_variant(text: Column) -> Column:
    """A row label as a device's name: no order code at the end, nothing behind the first spaced dash or bar."""
    t = F.regexp_replace(clean_label(text), r"\s*[A-Z]{0,4}\d[\dA-Za-z]*(?:-[\dA-Za-z]+){2,}\s*$", "")

    def head(x: Column) -> Column:
        out = x
        for mark in (" — ", " – ", " - ", " | "):
            front = F.trim(F.substring_index(x, mark, 1))
            out = F.when((F.instr(x, mark) > 0) & (F.length(front) >= 3), front).otherwise(out)
        return F.regexp_replace(out, "^[ –—:,-]+|[ –—:,-]+$", "")

    return let(t, head)


def device_name(raw: Column, page: Column, single: Column) -> Column:
    """The page's name for a page's only device, else the row's own if it has three characters."""
    own, title = clean_variant(raw), clean_variant(page)
    return F.when(single, F.when(title != "", title).otherwise(own)).when(F.length(own) >= 3, own).otherwise(page)


def hyphened(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def product_id(maker: Column, last_segment: Column, name: Column) -> Column:
    """vendor__slug, and the name where it differs from the slug."""
    tail = F.coalesce(last_segment, hyphened(name))
    suffix = hyphened(name)
    return F.concat(hyphened(maker), F.lit("__"), tail, F.when((suffix != "") & (suffix != tail), F.concat(F.lit("__"), suffix)).otherwise(""))


def clean_link_text(text: Column) -> Column:
    """Without its call to action, unless too little is left."""
    rest = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), CALL, ""))
    return F.when((F.length(rest) >= 6) | (F.instr(rest, " ") > 0), rest).otherwise(F.trim(F.coalesce(text, F.lit(""))))


def looks_like_date(text: Column) -> Column:
    return F.trim(text).rlike(DATE_START)


def order_numbers(text: Column, most: int = 20) -> Column:
    """Distinct order codes in order, without dates; the first most."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ORDER_CODE), F.lit(0))
    return F.slice(F.array_sort(F.array_distinct(F.filter(found, lambda c: ~looks_like_date(c)))), 1, most)


def interfaces(text: Column) -> Column:
    """Sorted names of the interfaces that a text mentions."""
    return F.array_sort(F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(n)) for n, p in INTERFACES.items()])))


def sheet_score(url: Column, text: Column) -> Column:
    """2 for a data sheet by name, -1 for another kind of document, else 0."""
    both = F.concat(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)$", 1), F.lit(" "), F.coalesce(text, F.lit("")))
    return F.when(both.rlike(SHEET_BAD), -1).when(both.rlike(SHEET_GOOD), 2).otherwise(0)


def estimate_tokens(text: Column) -> Column:
    """A length of text in tokens, 3.5 characters each, halves rounded to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / F.lit(3.5)).cast("int"))


def count_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1)))


def tokens(text: Column) -> Column:
    """Distinct words of two or more letters and digits that aren't numbers."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$")))


# Marks of pages that only ask whether the visitor is a person.
CHALLENGE = r"(?i)<title>\s*(?:Just a moment\.\.\.|Attention Required! \| Cloudflare|Access Denied)\s*</title>|cf-browser-verification|challenge-platform|_Incapsula_Resource"
#: A data sheet's line: a label, a colon or a run of dots or blanks, and a value.
SHEET_LINE = r"^\s*([A-Za-zÄÖÜäöüß][^:\n]{1,48}?)\s*(?::|\.{3,}|\t|\s{3,})\s*(.{1,80})$"


def is_challenge(body: Column) -> Column:
    return body.rlike(CHALLENGE)


def sheet_pairs(text: Column) -> Column:
    """array<struct<label, value>> of the lines of a data sheet's text whose value has a digit."""
    lines = F.filter(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), lambda x: x.rlike(SHEET_LINE) & F.regexp_extract(x, SHEET_LINE, 2).rlike(r"\d"))
    return F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, SHEET_LINE, 1)).alias("label"), F.trim(F.regexp_extract(x, SHEET_LINE, 2)).alias("value")))
