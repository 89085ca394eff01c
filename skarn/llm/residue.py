"""Problem 5: bodies that hold template residue, filler or a message instead of a page.

A body's main part is taken apart into statements, its sentences and data rows. Detectors take placeholders, filler and
open messages. Which other statements are messages is counted over all hosts: they stand, nearly always, on pages that
something speaks against - title and address share no word with the text, several addresses of a host were answered with
the same body, or the fetches were refused - while content stands on pages of its own. A page that has nothing else left
is no real page.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.boilerplate import SENTENCE, SHORT, SLUG_TERM, TAKEN, TITLE_TERM, VALUE, line_roles, searcher, stored_pages
from skarn.session import cut, read_table

# Placeholders that a template engine should have filled.
PLACEHOLDER = re.compile(
    r"\{\{\s*[\w.\- ]+\s*\}\}|\{%-?\s*[\w. \-|']+?-?%\}|<%=?\s*[\w. ]+\s*%>|%%[\w.\-]+%%|##[\w.\-]+##|@@[\w.\-]+@@|\$\{[\w.\-]+\}|__[a-z][a-z0-9]*(?:_[a-z0-9]+)*__|(?<![\w{])\{[a-z]+(?:[_.][a-z0-9]+)*\}(?!\})|\[\[[\w.\- ]+\]\]|\[%[\w.\- ]+%\]|\[object Object\]",
    re.I,
)
# Words of filler Latin, and of stand-in copy.
LATIN = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "vestibulum placerat arcu donec lobortis dictum felis porta augue integer posuere vitae mauris varius praesent nec vel pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas curabitur aliquam at cras fusce nam nunc phasellus proin quisque sagittis tellus ultrices viverra".split()
)
FILLER = re.compile(
    r"^(?:(?:x{3,}|test|asdf\w*|qwert\w*|foo|bar|undefined|null|nan|todo|tbd|blah|abc|\.\.\.)[\s.,:!]*)+$"
    r"|^(?:todo\b|placeholder text|sample (?:product|text)|headline goes here|your (?:text|headline) here|text goes here|(?:new|untitled) page|titel|title|page title|untitled|content coming soon|coming soon|beschreibung folgt|text folgt|inhalt folgt|texte à compléter|contenu à venir|texto pendiente|descripción pendiente|próximamente|description (?:to follow|follows|coming)|hier könnte ihr text|insert your|insert (?:text|copy) here|votre texte ici|su texto aquí|click to edit|product copy)\b.{0,40}$",
    re.I,
)
# Openings of messages that stand for a page, in several languages; the whole line is one short message.
MESSAGE = re.compile(
    r"^(?:(?:http )?(?:error|fehler|erreur)(?: code)?:? ?\d{3}|[45]\d\d|hoppla|oops|ups|whoops|uh-oh)[.!:]?(?:\s*[-–|:]\s*.{0,40})?$"
    r"|^(?:sorry|oops|leider)\b.{0,30}(?:page|product|seite|nothing)|\bpage (?:does not|doesn.t) exist|\b(?:page|file|resource|product|item) (?:was |could |is |can ?not be )*(?:not found|no longer (?:listed|available)|not be found)|^not found|page you (?:are looking|were looking|requested)|artikel ist nicht mehr|domain is parked|being redirected|click here if nothing|^(?:the )?link you followed|^we could ?n.t find|nothing here"
    r"|seite wurde (?:leider )?nicht gefunden|seite nicht gefunden|page demandée est introuvable|page introuvable|no encontramos la página|página no encontrada|produkt .{0,20}nicht mehr (?:gelistet|verfügbar)"
    r"|^access (?:to this \w+ )?(?:is )?denied\.|^access denied$|^forbidden\b|^zugriff verweigert|^accès refusé|^acceso (?:denegado|no autorizado)|you do not have permission|^not acceptable|request was rejected|ip range is blocked|not offered in your region|^unauthori[sz]ed|nicht berechtigt"
    r"|^too many requests|unusual traffic|^checking your browser|verify (?:that )?you are (?:a )?human|solve the puzzle|^one moment|einen augenblick, ihre anfrage|vérification de la connexion|comprobando su navegador|request reference|^security check|merci de patienter|please wait while|attention required"
    r"|^(?:please )?log ?in (?:again )?to|session has expired|sitzung ist abgelaufen|session a expiré|sesión ha caducado|veuillez vous connecter|bitte melden sie sich an|inicie sesión|sign in to (?:continue|view)|müssen sich anmelden|debe iniciar sesión|members only|confirm your age|choose your country|wählen sie ihr land|accept the terms to continue"
    r"|scheduled maintenance|^wartungsarbeiten|site en maintenance|en mantenimiento|back (?:soon|shortly)\b|upgrade is in progress|moving to a new home|wir sind bald wieder|volvemos enseguida|estamos actualizando|revenez plus tard|temporarily unable|under construction|temporarily unavailable"
    r"|^(?:please )?(?:enable|activate|turn on) (?:javascript|scripts)|(?:enable|need) (?:javascript|scripts) to (?:run|continue|view)|script-capable browser|^js is (?:switched off|disabled)|^javascript is|javascript in ihrem browser|aktivieren sie javascript|nécessite l.activation des scripts|no ejecuta javascript|requires? javascript|activer javascript|active javascript"
    r"|^internal server error|^bad gateway|^gateway time-?out|upstream timed out|^service (?:is )?(?:temporarily )?unavailable|unexpected error|unerwarteter fehler|erreur inattendue|error inesperado|could not connect to database|^(?:fatal error|warning|notice|parse error):|exception\b.{0,60}(?:\bat\b|:)|traceback \(most recent|stack trace|undefined index|sqlstate|too many connections|^java\.|nullpointer|segmentation fault|at line \d+"
    r"|^(?:ref|id|incident|ray id|request id|error id|support id)\b[.:#]? ?[a-z0-9-]{2,20}$",
    re.I,
)
is_message = searcher(MESSAGE)
_WORD = re.compile(r"[^\W\d_]{2,}")


def latin_share(text: str) -> float:
    words = [w.lower() for w in _WORD.findall(text)]
    return sum(w in LATIN for w in words) / len(words) if len(words) >= 3 else 0.0


@lru_cache(maxsize=65536)
def detector(text: str) -> str:
    """The detector that takes a block, however long, for no content: placeholder, filler, message, or an empty text."""
    bare = PLACEHOLDER.sub(" ", text)
    if bare != text and len(_WORD.findall(bare)) <= 2:
        return "placeholder"
    if FILLER.match(text.strip()) or latin_share(text) >= 0.6:
        return "filler"
    if is_message(text.strip()):
        return "message"
    return ""


#: A statement is a message if it was met at so many addresses and this share of them is suspicious.
LEAST_REPEATS, LEAST_SUSPICIOUS = 3, 0.75


def judged(roles: DataFrame, *keep) -> DataFrame:
    """The columns keep, and of each page: found (hashes of the main part's statements that no detector takes), short (those
    of at most four words), taken (blocks that a detector takes), apart (the title is taken by a detector, or neither its
    terms nor the address's are in the main part), addresses and refused.
    """
    main = F.filter(F.arrays_zip(F.col("page.hash").alias("hash"), F.col("page.block").alias("block"), F.col("page.code").alias("code"), F.col("role").alias("main")), lambda x: x["main"])
    has = lambda x, bit: x["code"].bitwiseAND(F.lit(bit)) > 0
    pages = roles.select(*keep, "page.bad_title", "addresses", "refused", main.alias("main"))
    statements = F.filter("main", lambda x: has(x, SENTENCE | VALUE) & ~has(x, TAKEN))
    hashes = lambda of: F.array_distinct(F.transform(of, lambda x: x["hash"]))
    matched = F.exists("main", lambda x: has(x, TITLE_TERM | SLUG_TERM))
    return pages.select(
        *[F.col(c) for c in pages.columns if c not in ("bad_title", "main")], hashes(statements).alias("found"), hashes(F.filter(statements, lambda x: has(x, SHORT))).alias("short"),
        F.size(F.array_distinct(F.transform(F.filter("main", lambda x: has(x, TAKEN)), lambda x: x["block"]))).alias("taken"), (F.col("bad_title") | ~matched).alias("apart"),
    )


def message_statements(each: DataFrame) -> DataFrame:
    """hash of the statements that are messages, counted over all pages: each counts as many times as addresses were answered with it."""
    suspicious = F.col("apart") | (F.col("refused") > 0.5) | (F.col("addresses") > 1)
    counted = each.select(F.explode("found").alias("hash"), F.greatest("addresses", F.lit(1)).alias("n"), suspicious.alias("suspicious"))
    counts = counted.groupBy("hash").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("suspicious"), F.col("n")).otherwise(0)).alias("low"))
    return counts.where((F.col("low") >= LEAST_REPEATS) & (F.col("low") >= F.col("all") * LEAST_SUSPICIOUS)).select("hash")


def empty_pages(each: DataFrame, key: str) -> DataFrame:
    """key of the pages without a real main part.

    each: key and what judged adds. A page is empty if its main part has no statement but messages, however many they are,
    and, if it has statements at all, anything speaks against it: title and address, a refusal, several addresses, a
    detector. Short rows beside messages, such as a reference number, no more than there are messages, don't make it a page.
    """
    each = each.select(key, "found", "short", "taken", "apart", "addresses", "refused")
    messages = message_statements(each).withColumn("message", F.lit(1))
    # Only pages that something speaks against need their statements looked up.
    against = F.col("apart") | (F.col("refused") > 0.5) | (F.col("addresses") > 1) | (F.col("taken") > 0)
    suspects = each.where((F.size("found") > 0) & against).select(key, "taken", "short", F.explode("found").alias("hash"))
    suspects = suspects.select(key, "taken", "hash", F.array_contains("short", F.col("hash")).alias("short"))
    counted = suspects.join(messages, "hash", "left").groupBy(key).agg(F.first("taken").alias("taken"), F.count("message").alias("known"), F.count_if(F.col("message").isNull() & ~F.col("short")).alias("real"), F.count_if(F.col("message").isNull() & F.col("short")).alias("asides"))
    empty = counted.where((F.col("real") == 0) & (F.col("asides") <= F.col("known") + F.col("taken")))
    return each.where(F.size("found") == 0).select(key).unionByName(empty.select(key))


def p5_found(spark, sf_dir: str) -> DataFrame:
    """fetch_id of the fetches whose stored body carries no real page."""
    each = cut(judged(line_roles(cut(stored_pages(spark, sf_dir)), "body_id"), "body_id"))
    paths = read_table(spark, sf_dir, "page_bodies").select("body_id", "body_path").join(empty_pages(each, "body_id"), "body_id", "left_semi").select("body_path")
    return read_table(spark, sf_dir, "fetch_index").select("fetch_id", "body_path").join(paths, "body_path", "left_semi").select("fetch_id")
