"""What a raw cell holds: stand-ins for no value, whole numbers, yes/no words, days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that say only that no value is given here, in lower case.
STAND_INS = [
    "", "-", "--", "---", "–", "—", "?", "??", "...", "…", ".", "/", "*", "n/a", "na", "n.a.", "n. a.", "#n/a", "nan", "null", "none given", "nil", "k. a.", "k.a.", "keine angabe", "ohne angabe", "tbd", "tba", "tbc",
    "to be defined", "to be determined", "unknown", "unbekannt", "inconnu", "desconocido", "not specified", "nicht angegeben", "non spécifié", "no especificado", "not given", "not known", "auf anfrage", "on request", "upon request",
    "sur demande", "bajo pedido", "a consultar", "see datasheet", "see data sheet", "siehe datenblatt", "voir fiche technique", "refer to manual", "see manual", "siehe handbuch", "see options list", "see options", "per configuration",
    "depends on rotor", "depends on configuration", "je nach ausführung", "coming soon", "soon", "pending", "xxx", "xx", "x.x", "undefined",
]
# Words and signs for yes and no, in lower case.
YES = ["yes", "y", "ja", "j", "oui", "sí", "si", "true", "1", "x", "✓", "✔", "☑", "included", "inklusive", "inclus", "incluido", "standard", "serienmäßig", "available", "vorhanden", "with", "mit", "sim", "tak", "да"]
NO = ["no", "n", "nein", "non", "false", "0", "✗", "✘", "☐", "none", "without", "ohne", "sans", "sin", "not available", "not included", "nicht vorhanden", "não", "nie", "нет"]
# Month names by number.
MONTHS = {
    1: "january jan januar janvier enero", 2: "february feb februar février febrero", 3: "march mar märz mars marzo", 4: "april apr avril abril", 5: "may mai mayo", 6: "june jun juni juin junio",
    7: "july jul juli juillet julio", 8: "august aug août agosto", 9: "september sep sept septembre septiembre", 10: "october oct oktober okt octobre octubre", 11: "november nov novembre noviembre", 12: "december dec dezember dez décembre diciembre",
}


def tidy(text: Column) -> Column:
    """White space of all kinds collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x{00a0}\x{2000}-\x{200b}\x{202f}\x{3000}]+", " "))


def plain(text: Column) -> Column:
    """Tidy lower case."""
    return F.lower(tidy(text))


def is_real(text: Column) -> Column:
    """True for a text that is neither null, blank nor a stand-in."""
    return F.coalesce(~plain(text).isin(*STAND_INS), F.lit(False))


def holds_number(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\d"), F.lit(False))


_WHOLE = r"^\D*?(\d{1,3}(?:[ .,']\d{3})+|\d+)(?:[.,]0+)?(?:$|[^\d.,]|[.,](?!\d))"


def whole_number(text: Column) -> Column:
    """The first number as bigint if it is whole ("up to 12", "28.0", "9 Stück"); else null."""
    found = F.regexp_extract(tidy(text), _WHOLE, 1)
    return F.nullif(F.regexp_replace(found, r"\D", ""), F.lit("")).try_cast("bigint")


def yes_or_no(text: Column) -> Column:
    """A boolean for a word or sign of yes or no; else null."""
    word = F.regexp_replace(plain(text), r"[.!]+$", "")
    return F.when(word.isin(*YES), F.lit(True)).when(word.isin(*NO), F.lit(False))


def day(text: Column) -> Column:
    """An existing day written with numbers (year first or day first) or a month's name; else null."""
    t = plain(text)
    months = F.create_map(*[F.lit(x) for n, names in MONTHS.items() for name in names.split() for x in (name, f"{n:02d}")])
    year_first = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:$|[t ].*)"
    day_first = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"
    named = r"^(\d{1,2})\.? (\p{L}+)\.?,? (\d{4})$"
    named_first = r"^(\p{L}+)\.? (\d{1,2}),? (\d{4})$"
    part = lambda p, n: F.regexp_extract(t, p, n)
    iso = (
        F.when(t.rlike(year_first), F.concat_ws("-", part(year_first, 1), F.lpad(part(year_first, 2), 2, "0"), F.lpad(part(year_first, 3), 2, "0")))
        .when(t.rlike(day_first), F.concat_ws("-", part(day_first, 3), F.lpad(part(day_first, 2), 2, "0"), F.lpad(part(day_first, 1), 2, "0")))
        .when(t.rlike(named), F.concat_ws("-", part(named, 3), F.get(F.array(months[part(named, 2)]), F.lit(0)), F.lpad(part(named, 1), 2, "0")))
        .when(t.rlike(named_first), F.concat_ws("-", part(named_first, 3), F.get(F.array(months[part(named_first, 1)]), F.lit(0)), F.lpad(part(named_first, 2), 2, "0")))
    )
    return F.try_to_timestamp(F.when(iso.rlike(r"^\d{4}-\d\d-\d\d$"), iso), F.lit("yyyy-MM-dd")).cast("date")
