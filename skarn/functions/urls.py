"""URL functions as Column expressions: parts, identity, filters, crawl order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query, fragment; unlike a strict URI parser it takes any text.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Query parameters that only track a visit.
TRACKING = r"(?i)^(?:utm_\w+|hslang|_hs\w+|hsctatracking|gclid|fbclid|mc_cid|mc_eid|_ga|_gl|cid|ref|referrer|source|trk|icid|sessionid|sid)$"
# Second-level labels of public suffixes.
SUFFIX_LABELS = ["co", "com", "net", "org", "ac", "gov"]
# Path segments of pages that are no products.
EDITORIAL = (
    r"(?i)/(?:blogs?|news(?:room)?|press|events?|webinars?|careers?|jobs|about(?:-us)?|contact(?:-us)?|legal|privacy|imprint|impressum|cookies?(?:-policy)?|terms|login|account|cart|checkout|search|"
    r"request-(?:a-)?quote|get-a-quote|literature|downloads?|resources|case-stud(?:y|ies)|podcasts?|videos?|investors?|sustainability|(?:[a-z-]*-)?(?:forms?|registration|survey|promotions?|offers?)|tag|author|"
    r"feed|wp-json|sitemap|locations?|distributors?|support|training|academy|journal|[a-z-]*citations?|doclist[a-z-]*|docs?|publications?|topics?|insights?|stories|story|app(?:lication)?-notes?|"
    r"white-?papers?|e-?books?|brochures?|webcasts?|library|glossary|faqs?|partners?|shop|store|ecommerce)(?:/|$|[-_])"
)
JUNK = r"(?i)/(?:null|undefined|none|nan)(?:/|$)|%20%20"
PAGE_QUERY = r"(?i)(?:^|[?&])(?:page|p|pg|paged|start|offset)=\d+"
PAGE_PATH = r"(?i)/page/\d+/?$"
ASSET = r"(?i)\.(?:jpe?g|png|gif|svg|webp|ico|css|js|zip|mp4)(?:\?|$)"
DOCUMENT = r"(?i)\.(?:pdf|docx?|xlsx?|pptx?)$|[-_]pdf[-_]\d+/?$"
# Labels of language switches, social networks by registrable domain, and hosts that hold no vendor's catalogue.
LANGUAGE_LABELS = [
    "english", "deutsch", "español", "espanol", "français", "francais", "italiano", "português", "portugues", "nederlands", "polski", "русский", "中文",
    "日本語", "한국어", "简体中文", "繁體中文", "türkçe", "svenska", "dansk", "suomi", "norsk",
]
SOCIAL = [
    "facebook.com", "twitter.com", "x.com", "linkedin.com", "youtube.com", "instagram.com", "xing.com", "tiktok.com", "weibo.com", "wechat.com",
    "pinterest.com", "youtu.be",
]
THIRD_PARTY = (
    r"(?i)google|gstatic|cookiebot|onetrust|gmpg|w3\.org|schema\.org|hubspot|hsforms|marketo|pardot|vimeo|wistia|doubleclick|cloudflare|jsdelivr|typekit|adobe|bing\.|yahoo|apple\.com|microsoft|office\.com|zoom\.us|eventbrite|issuu|"
    r"slideshare|wikipedia|archive\.org|addtoany|sharethis|trustpilot|g2\.com|crunchbase|glassdoor|indeed|kununu|workday|successfactors|greenhouse|lever\.co"
)
# Path fragments that order a crawl.
CATALOGUE_HINTS = [
    "product", "produkt", "produit", "producto", "prodotto", "shop", "catalog", "katalog", "catalogue", "instrument", "geraet", "equipment",
    "portfolio", "range", "sortiment",
]
EDITORIAL_HINTS = [
    "news", "press", "blog", "career", "job", "event", "story", "about", "contact", "legal", "privacy", "imprint", "impressum", "webinar", "download",
    "support", "service", "login", "account", "cart", "search",
]
# Names of sitemaps to read first and last.
SITEMAP_FIRST = r"(?i)product|produkt|instrument|equipment|catalog|page"
SITEMAP_LAST = r"(?i)commerce|store|shop|sku|pim|video|multimedia|image|media|news|press|blog|post|event|webinar|career|job|promotion|community|forum|support|training|author|tag|categor(?:y|ies)_?tag|attachment"
# First path segments that are languages or regions, and those that open a catalogue.
LOCALES = [
    "en", "de", "fr", "es", "it", "nl", "pt", "ja", "zh", "ko", "pl", "cs", "cz", "ru", "bg", "hu", "ro", "sk", "sl", "hr", "tr", "sv", "da", "fi",
    "no", "el", "uk", "ua", "th", "vi", "id", "ar", "he", "us", "eu", "int", "global", "row", "en-us", "en-gb", "de-de", "de-at", "de-ch", "fr-fr",
    "es-es", "it-it", "int-en", "int-es", "us-en", "uk-en", "pl-pl", "fr-ch",
]
CATALOGUE_SEGMENTS = [
    "products", "product", "produkte", "produkt", "shop", "catalog", "catalogue", "katalog", "instruments", "instrumente", "equipment", "geraete",
    "geräte", "portfolio", "range",
]
OTHER_SEGMENTS = [
    "knowledge", "company", "news", "press", "blog", "stories", "events", "career", "careers", "jobs", "about", "support", "service",
    "service-support", "downloads", "search", "legal", "imprint", "privacy", "contact", "industries-solutions", "applications", "literature",
    "webinars",
]


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty where there is none."""
    return F.regexp_extract(url, PARTS, n)


def path(url: Column) -> Column:
    return part(url, 3)


def segments(url: Column) -> Column:
    """The path's segments that aren't empty."""
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def depth(url: Column) -> Column:
    return F.size(segments(url))


def slug(url: Column) -> Column:
    """The last path segment; null for a bare host."""
    return F.try_element_at(segments(url), F.lit(-1))


def slug_words(url: Column) -> Column:
    """The last path segment with hyphens and underscores as spaces, 80 characters at most."""
    return F.substring(F.regexp_replace(F.coalesce(slug(url), F.lit("")), "[-_]", " "), 1, 80)


def canonical(url: Column) -> Column:
    """The URL without fragment, tracking parameters and empty parameters' names."""
    kept = F.array_join(F.filter(F.split(part(url, 4), "&"), lambda p: (p != "") & ~F.split(p, "=")[0].rlike(TRACKING)), "&")
    base = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"\?.*$", "")
    return F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(part(url, 2), r":\d+$", ""))


def registrable_domain(name: Column) -> Column:
    """The last two labels of a host, or three before a public suffix of two."""
    labels = F.filter(F.split(F.lower(F.regexp_replace(name, r":.*$", "")), r"\."), lambda x: x != "")
    three = (F.size(labels) >= 3) & F.coalesce(F.try_element_at(labels, F.lit(-2)).isin(*SUFFIX_LABELS), F.lit(False))
    wanted = F.when(three, F.lit(3)).otherwise(2)
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - wanted + 1, F.lit(1)), wanted), ".")


def same_vendor(a: Column, b: Column) -> Column:
    return registrable_domain(a) == registrable_domain(b)


def page_key(url: Column) -> Column:
    """Identity of a page: host without www and path without the last slash."""
    return F.concat(F.regexp_replace(F.lower(part(url, 2)), r"^www\.", ""), F.regexp_replace(path(url), "/+$", ""))


def is_pagination(url: Column) -> Column:
    return part(url, 4).rlike(PAGE_QUERY) | path(url).rlike(PAGE_PATH)


def is_editorial(url: Column) -> Column:
    return path(url).rlike(EDITORIAL)


def is_junk(url: Column) -> Column:
    return url.rlike(JUNK)


def is_asset(url: Column) -> Column:
    return url.rlike(ASSET)


def is_document(url: Column) -> Column:
    return path(url).rlike(DOCUMENT)


def _holds(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def crawl_priority(url: Column) -> Column:
    """0 for catalogue-like paths, 2 for editorial ones, else 1; the lower is crawled first."""
    low = F.lower(path(url))
    return F.when(_holds(low, CATALOGUE_HINTS), 0).when(_holds(low, EDITORIAL_HINTS), 2).otherwise(1)


def sitemap_priority(url: Column, base: Column) -> Column:
    """0 product maps, 1 neutral, 2 others; 3 more for another host than base."""
    name = F.concat(F.coalesce(F.regexp_extract(path(url), r"([^/]*)$", 1), F.lit("")), F.lit("?"), part(url, 4))
    score = F.when(name.rlike(SITEMAP_LAST), 2).when(name.rlike(SITEMAP_FIRST), 0).otherwise(1)
    return score + F.when((base != "") & (part(url, 2) != "") & (part(url, 2) != base), 3).otherwise(0)


def glob(pattern: str) -> str:
    """The regular expression of a shell pattern whose * crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out += "(?s:.*)"
        elif ch == "?":
            out += "(?s:.)"
        elif ch == "[" and "]" in pattern[i + 2 :]:
            j = pattern.index("]", i + 2)
            body = pattern[i + 1 : j]
            out += "[" + ("^" + body[1:] if body.startswith("!") else body).replace("\\", "\\\\") + "]"
            i = j
        else:
            out += "\\" + ch if ch in r"\.^$+{}()|[]" else ch
        i += 1
    return f"^{out}$"


def category(url: Column) -> Column:
    """The path segment above the last; empty for short paths."""
    parts = segments(url)
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise("")


def is_menu_link(url: Column, text: Column) -> Column:
    """A web link with a short name that leads to a vendor: no language switch, social network, service host, asset or template bug."""
    outside = registrable_domain(part(url, 2)).isin(*SOCIAL) | part(url, 2).rlike(THIRD_PARTY)
    named = (F.length(text) > 0) & (F.length(text) <= 80) & ~F.lower(text).isin(*LANGUAGE_LABELS)
    return url.rlike("^https?://") & named & ~outside & ~is_asset(path(url)) & ~is_junk(url)
