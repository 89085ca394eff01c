"""Problem 7: the main text of pages, after removal of what recurs on a site.

Subtrees, down to single blocks, are hashed per page and counted per host in Spark; those on many pages of their host are
deleted, unless pages whose markup names the main part have them there. Blocks whose element says nothing take the role
that the same block has elsewhere, in pages whose markup does say it. Names of other pages of the corpus that stand in
a page's text are teasers. Only where counts decide nothing, phrases of surroundings do. What is then
still open is decided by its neighbours.

A page is read once, into short arrays of hashes and marks; its text goes into no shuffle.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.pages import digest, normal, read_page
from skarn.session import cut, read_table, ship_package, spread

#: A subtree is a site's template if it stands on at least so many pages of the host, and on this share of them.
LEAST_PAGES, LEAST_SHARE = 4, 0.12
#: Below so many pages, or this share of them, a host says too little of a block, and phrases of surroundings may decide.
TELLING_PAGES, TELLING_SHARE = 4, 0.12
#: A hash on more than one of so many of all lines is joined by broadcast, so at most as many hashes are.
HOT_SHARE = 10_000
# Phrases of surroundings in several languages, as patterns over normalised text.
AROUND = re.compile(
    r"^©|\ball rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos|^copyright|\bcookies?\b.{0,40}(best experience|browser|website|visite|visita|verbessern|choice|site|sitio|tiers|terceros|accept)|use cookies|utiliza(mos)? cookies|usamos cookies|verwenden cookies|utilisons des cookies"
    r"|alle akzeptieren|your privacy matters|stores small files in your browser|verarbeitung zu\.$|newsletter|lettre d.information|boletín|(prices|preise|prix|precios) .{0,30}(vat|tax|mwst|tva|iva|shipping|versand)|^hotline\b|hotline and|live chat|versandkosten und|lieferzeiten finden|opening hours|öffnungszeiten|impressum\b.*\||\bimprint\b|privacy policy|mentions légales|aviso legal|datenschutz \||agb$"
    r"|follow us on|share on social|auf social|related products|you may also like|recently viewed|popular downloads|customers who|need help\?|noch fragen\?|besoin d.aide|necesita ayuda|zuletzt angesehen|auch interessieren|aimerez aussi|produits associés|puede interesar|vistos recientemente|webinar .*register|^read also|^lesen sie auch"
    r"|enable javascript to use|add to (cart|wishlist)|zum warenkorb|in den warenkorb|ajouter au panier|añadir al carrito|^page # of #|results? – next page|# of # results|zurück zur übersicht|^back to |downloads? \(#\)|accessories \(#\)|^\[capture |^print( this page)?$|skip to (main )?content|terms apply"
)


def _literal(alternative: str) -> str:
    """The longest text that every match of an alternative holds; "" if groups and classes leave none of four signs."""
    runs, depth, i = [""], 0, 0
    while i < len(alternative):
        ch = alternative[i]
        if ch == "\\":
            runs.append("")
            i += 1
        elif ch == "[":
            runs.append("")
            i = alternative.index("]", i + 1)
        elif ch in "?*{":
            runs[-1] = runs[-1][:-1]
            runs.append("")
            i = alternative.index("}", i) if ch == "{" else i
        elif ch in "().+^$":
            depth += (ch == "(") - (ch == ")")
            runs.append("")
        elif not depth:
            runs[-1] += ch
        i += 1
    best = max(runs, key=len)
    return best if len(best) >= 4 else ""


def _alternatives(pattern: str) -> list[str]:
    out, depth, inside = [""], 0, False
    for i, ch in enumerate(pattern):
        plain = i == 0 or pattern[i - 1] != "\\"
        inside = (inside or ch == "[") and not ch == "]" if plain else inside
        depth += ((ch == "(") - (ch == ")")) * (plain and not inside)
        if ch == "|" and plain and not depth and not inside:
            out.append("")
        else:
            out[-1] += ch
    return out


def searcher(pattern: re.Pattern):
    """A function that tells whether a pattern of many alternatives is found in a text, as pattern.search does, at less cost.

    Alternatives tied to the beginning are tried there only, others only if their literal text is in the text.
    """
    parts = _alternatives(pattern.pattern)
    literals = {x: _literal(x) for x in parts if not x.startswith("^")}
    begin = re.compile("|".join(x for x in parts if x.startswith("^")) or "(?!)", pattern.flags)
    free = re.compile("|".join(x for x, y in literals.items() if not y) or "(?!)", pattern.flags)
    tied = [(y.lower(), re.compile(x, pattern.flags)) for x, y in literals.items() if y]

    def found(text: str) -> bool:
        if any(ch in text for ch in "\u0130\u0131\u017f"):  # equal to i and s only for a pattern without case
            return bool(pattern.search(text))
        low = text.lower()
        return bool(begin.match(text)) or any(y in low and x.search(text) for y, x in tied) or bool(free.search(text))

    return found


is_around = searcher(AROUND)


@lru_cache(maxsize=65536)
def _around(text: str) -> bool:
    """Whether a line, however long, is a phrase of surroundings."""
    return is_around(normal(text))


# What is kept of a line, as bits: zone, shape, marks.
AROUND_ZONE, MAIN_ZONE = 1, 2
SENTENCE, VALUE, LINKS, OTHER = 4, 8, 16, 32
HEADING, ITEM, PHRASE, TEASER, OWN_NAME, TITLE_TERM, SLUG_TERM, TAKEN, SHORT = (1 << n for n in range(6, 15))
_SHAPES = {"s": SENTENCE, "v": VALUE, "b": LINKS, "l": LINKS, "n": OTHER}
_TERM = re.compile(r"[^\W\d_]{4,}")
_LEAD = re.compile(r"\s[-–—|@·:]\s")
_TEASER = re.compile(r"^((?:\S+ ){1,4}\d[\w-]*): \S")


def terms_of(text: str) -> set[str]:
    """Words of four letters or more."""
    return {w.lower() for w in _TERM.findall(text)}


def page_features(source: str, url: str | None = None) -> tuple:
    """The fields of FEATURES of a body: its visible lines as numbers, block hashes and marks, its subtrees, the names it goes by."""
    from skarn.llm.residue import detector

    page = read_page(source)
    lines = [x for x in page.lines if x.text and x.zone != "x"]
    headings = [x.text for x in lines if x.heading]
    head = "\n".join([page.title, *headings])
    own = [page.title, *headings, *(x.text for x in lines if x.shape == "n")]
    title_terms, slug_terms = terms_of(_LEAD.split(page.title)[0]), terms_of((url or "").split("://")[-1].partition("/")[2])
    wanted = title_terms | slug_terms
    texts: dict[int, list[str]] = {}
    for x in lines:
        texts.setdefault(x.block, []).append(x.text)
    marks: dict[int, int] = {}
    for number, parts in texts.items():
        whole = " ".join(parts)
        marks[number] = (TAKEN if detector(whole) else 0) | (SHORT if len(whole.split()) <= 4 else 0)
    codes = []
    for x in lines:
        code = _SHAPES[x.shape] | marks[x.block] | (AROUND_ZONE if x.zone == "c" else MAIN_ZONE if x.zone == "m" else 0) | (HEADING if x.heading else 0) | (ITEM if x.item else 0)
        if x.zone != "c":
            found = _TEASER.match(x.text) if ": " in x.text else None
            low = x.text.lower()
            words = terms_of(low) if any(t in low for t in wanted) else set()
            code |= (PHRASE if _around(x.text) else 0) | (TITLE_TERM if words & title_terms else 0) | (SLUG_TERM if words & slug_terms else 0) | (OWN_NAME if x.shape == "n" and x.text in head else 0)
            code |= TEASER if found and not any(y == found[1] or y.startswith(found[1] + " ") for y in own) else 0
        codes.append(code)
    first = [h for x, h in zip((x for x in lines if x.heading), headings) if x.shape == "n"][:1]
    names = {digest(normal(_LEAD.split(t)[0])) for t in (page.title, *first) if t}
    bad_title = bool(detector(_LEAD.split(page.title)[0])) if page.title else False
    return [x.no for x in lines], [x.hash for x in lines], [x.block for x in lines], codes, [t[0] for t in page.trees], [t[1] for t in page.trees], [t[2] for t in page.trees], sorted(names), bad_title


FIELDS = ["no", "hash", "block", "code", "tree", "first", "last", "names", "bad_title"]
FEATURES = "struct<no array<int>, hash array<bigint>, block array<int>, code array<int>, tree array<bigint>, first array<int>, last array<int>, names array<bigint>, bad_title boolean>"


def with_features(df: DataFrame, source: str = "html", url: str | None = None) -> DataFrame:
    """Adds page: the features of each body; null sources have empty ones. Drop the source afterwards: nothing else needs it."""
    ship_package(df.sparkSession)

    def parse(bodies: pd.Series, urls: pd.Series) -> pd.DataFrame:
        got = [page_features(b, u) if b is not None else ([], [], [], [], [], [], [], [], False) for b, u in zip(bodies, urls)]
        return pd.DataFrame(got, columns=FIELDS, index=bodies.index)

    return df.withColumn("page", F.pandas_udf(parse, FEATURES)(source, F.col(url) if url else F.lit(None).cast("string")))


def host_facts(pages: DataFrame) -> DataFrame:
    """hash, host, on_host, recurs, thin, lean, named of every block and subtree of which anything is known beyond one page.

    recurs: the hash is on at least LEAST_PAGES pages of the host, and on LEAST_SHARE of them. lean: whether pages, of any host, have it in marked surroundings more often than in a marked main part: 2
    (more than twice as often), 1 (more often), 0 (alike), -1 (less often). named: some page goes by this name. Counts are
    combined before each shuffle, so that a line of a third of all pages is one row per task.
    """
    sizes = pages.groupBy("host").agg(F.count("*").alias("size"))
    has = lambda bit: F.transform("page.code", lambda c: (c.bitwiseAND(F.lit(bit)) > 0).cast("int"))
    lines = F.transform(F.arrays_zip(F.col("page.hash").alias("hash"), has(AROUND_ZONE).alias("c"), has(MAIN_ZONE).alias("m")), lambda x: F.struct(x["hash"].alias("hash"), x["c"].alias("c"), x["m"].alias("m"), F.lit(1).alias("on"), F.lit(0).alias("t")))
    fixed = lambda of, on, t: F.transform(of, lambda h: F.struct(h.alias("hash"), F.lit(0).alias("c"), F.lit(0).alias("m"), F.lit(on).alias("on"), F.lit(t).alias("t")))
    each = pages.select("host", F.explode(F.array_distinct(F.concat(lines, fixed("page.tree", 1, 0), fixed("page.names", 0, 1)))).alias("x"))
    per_host = each.groupBy(F.col("x.hash").alias("hash"), "host").agg(F.sum("x.on").alias("on_host"), F.sum("x.c").alias("c"), F.sum("x.m").alias("m"), F.sum("x.t").alias("t"))
    overall = per_host.groupBy("hash").agg(F.sum("c").alias("around"), F.sum("m").alias("main"), F.sum("t").alias("named"), F.count_if(F.col("on_host") > 0).alias("hosts"))
    overall = overall.where((F.col("hosts") > 1) | (F.col("named") > 0) | (F.col("around") + F.col("main") > 1))
    known = per_host.where(F.col("on_host") > 0).join(overall, "hash", "left").join(sizes, "host").where((F.col("on_host") > 1) | F.col("hosts").isNotNull())
    around, main = F.coalesce("around", F.lit(0)), F.coalesce("main", F.lit(0))
    return known.select(
        "hash", "host", "on_host", ((F.col("on_host") >= LEAST_PAGES) & (F.col("on_host") >= F.col("size") * LEAST_SHARE)).alias("recurs"), ((F.col("on_host") < TELLING_PAGES) | (F.col("on_host") < F.col("size") * TELLING_SHARE)).alias("thin"),
        F.when((around > main * 2) & (around >= 2), 2).when(around > main, 1).when(around == main, 0).otherwise(-1).alias("lean"), (F.coalesce("named", F.lit(0)) > 0).alias("named"),
    )


# What is known of a hash, as bits.
RECURS, THIN, NAMED, LEAN = 1, 2, 4, 8


def line_roles(pages: DataFrame, key: str) -> DataFrame:
    """Adds role (a bit per line: main) to pages (key, host, page); key must be unique.

    The facts of hashes are joined to page keys alone. Those of the most frequent hashes, at most HOT_SHARE, are broadcast;
    any other hash has less than its share of all lines, so that no key of the shuffled join is hot.
    """
    facts = cut(host_facts(pages))
    total = facts.agg(F.sum("on_host")).first()[0] or 0
    facts = facts.select("hash", "host", "on_host", (F.when(F.col("recurs"), RECURS).otherwise(0) + F.when(F.col("thin"), THIN).otherwise(0) + F.when(F.col("named"), NAMED).otherwise(0) + (F.col("lean") + 1) * LEAN).alias("fact"))
    is_hot = F.col("on_host") > max(1000, total // HOT_SHARE)
    each = pages.select(key, "host", F.explode(F.array_distinct(F.concat("page.hash", "page.tree"))).alias("hash"))
    some = each.join(F.broadcast(facts.where(is_hot).select("hash", "host", F.col("fact").alias("hot"))), ["hash", "host"], "left")
    rest = some.where(F.col("hot").isNull()).drop("hot").join(facts.where(~is_hot).drop("on_host"), ["hash", "host"])
    both = some.where(F.col("hot").isNotNull()).select(key, "hash", F.col("hot").alias("fact")).unionByName(rest.select(key, "hash", "fact"))
    by_page = both.groupBy(key).agg(F.collect_list(F.struct("hash", "fact")).alias("facts"))  # as many as the page has lines
    joined = pages.join(by_page, key, "left")
    return joined.withColumn("role", F.pandas_udf(_roles, "array<boolean>")("page", "facts.hash", "facts.fact")).drop("facts")


def _roles(page: pd.DataFrame, hashes: pd.Series, facts: pd.Series) -> pd.Series:
    out = []
    for no, hash_, code, tree, first, last, known, fact in zip(page["no"], page["hash"], page["code"], page["tree"], page["first"], page["last"], hashes, facts):
        out.append(roles_of(no, hash_, code, list(zip(tree, first, last)), dict(zip(known, fact)) if known is not None else {}))
    return pd.Series(out, index=page.index)


def roles_of(no, hashes, codes, trees, facts: dict[int, int]) -> list[bool]:
    """Whether each line is main text. facts: what is known of a hash (RECURS, THIN, NAMED, and lean + 1 times LEAN)."""
    unknown = THIN | LEAN
    deleted = [(first, last) for h, first, last in trees if facts.get(h, unknown) & RECURS]
    role: list[str] = []
    begun = False  # sentences or values of the main part were seen
    for number, h, code in zip(no, hashes, codes):
        fact = facts.get(h, unknown)
        lean, thin = fact // LEAN - 1, fact & THIN
        recurs = fact & RECURS or any(a <= number <= b for a, b in deleted)
        other = fact & NAMED and code & OTHER and not code & (HEADING | OWN_NAME)  # the name of another page
        if recurs and (lean > 0 or lean == 0 and not code & VALUE):
            r = "c"
        elif code & (AROUND_ZONE | LINKS | TEASER) or lean == 2:
            r = "c"
        elif code & PHRASE and (thin or lean < 0 or code & VALUE):
            r = "c"
        elif other and (begun or not code & MAIN_ZONE):
            r = "c" if begun else "?"
        elif code & (MAIN_ZONE | SENTENCE | VALUE) or lean < 0:
            r = "m"
        else:
            r = "?"
        begun = begun or r == "m" and bool(code & (SENTENCE | VALUE))
        role.append(r)
    return _settle(codes, role)


def _settle(codes, role: list[str]) -> list[bool]:
    """Decides open lines by their neighbours: between main lines, or the last before one, or listed after one, is main."""
    n = len(role)
    i = 0
    while i < n:
        if role[i] != "?":
            i += 1
            continue
        j = i
        while j < n and role[j] == "?":
            j += 1
        before = role[i - 1] if i else "c"
        after = role[j] if j < n else "c"
        for k in range(i, j):
            if before == "m":
                role[k] = "m"
            elif after == "m":
                role[k] = "m" if k == j - 1 or codes[k] & (HEADING | ITEM) else "c"
            else:
                role[k] = "m" if codes[k] & HEADING else "c"
        i = j
    return [r == "m" for r in role]


def described(records: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """The descriptions of more than one line as pages of their host."""
    return records.where(F.col(text).contains("\n")).select(key, F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("html"))


def stored_pages(spark, sf_dir: str) -> DataFrame:
    """body_id, host, page, addresses, refused of every stored body; a body that several sites fetched belongs to the first by name.

    addresses: distinct URLs that were answered with the body; refused: the share of its fetches with a status of 400 or
    more or a blocked source. Bodies that no fetch points to belong to the host "" and have none.
    """
    fetches = read_table(spark, sf_dir, "fetch_index").where(F.col("body_path").isNotNull())
    refused = (F.coalesce(F.col("status"), F.lit(0)) >= 400) | F.coalesce(F.col("source") == "blocked", F.lit(False))
    of_body = fetches.groupBy("body_path", "url").agg(F.min("vendor").alias("vendor"), F.count("*").alias("n"), F.count_if(refused).alias("bad"))
    of_body = of_body.groupBy("body_path").agg(F.min("vendor").alias("host"), F.min("url").alias("url"), F.count("url").alias("addresses"), (F.sum("bad") / F.sum("n")).alias("refused"))
    bodies = spread(read_table(spark, sf_dir, "page_bodies").select("body_id", "body_path", "html"))
    joined = bodies.join(of_body, "body_path", "left").withColumns({"host": F.coalesce("host", F.lit("")), "addresses": F.coalesce("addresses", F.lit(0)), "refused": F.coalesce("refused", F.lit(0.0))})
    return with_features(joined, "html", "url").select("body_id", "host", "page", "addresses", "refused")


def main_lines() -> Column:
    """The numbers of the lines whose role is main."""
    kept = F.filter(F.arrays_zip(F.col("page.no").alias("no"), F.col("role").alias("main")), lambda x: x["main"])
    return F.transform(kept, lambda x: x["no"])


def p7_found(spark, sf_dir: str) -> DataFrame:
    """src, row_id, line_no of the lines to keep: of stored bodies that are real pages, and of descriptions of several lines."""
    from skarn.llm.residue import empty_pages, judged

    pages = stored_pages(spark, sf_dir).select(F.concat(F.lit("b"), "body_id").alias("key"), "host", "page", "addresses", "refused")
    texts = with_features(spread(described(read_table(spark, sf_dir, "device_records"), "listing_id", "description", "vendor")))
    # What is template is counted among pages and among descriptions of a host apart, the roles of lines over both together.
    texts = texts.select(F.concat(F.lit("d"), "listing_id").alias("key"), F.concat(F.lit("d:"), "host").alias("host"), "page", F.lit(0).cast("bigint").alias("addresses"), F.lit(0.0).alias("refused"))
    each = cut(judged(line_roles(cut(pages.unionByName(texts)), "key"), "key", main_lines().alias("kept")))
    is_body = F.col("key").startswith("b")
    real = each.join(empty_pages(each.where(is_body), "key"), "key", "left_anti")
    return real.select(F.when(is_body, "body").otherwise("description").alias("src"), F.substring("key", 2, 20).cast("bigint").alias("row_id"), F.explode("kept").alias("line_no"))
