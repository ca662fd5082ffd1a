"""URL expressions: Column -> Column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_of

# Outlets and the host patterns that name them; the first that is found in the host wins.
OUTLETS = (
    ("BBC", (r"bbc\.com", r"bbc\.co\.uk", r"bbc\.in", r"bbc\.com\.au")),
    ("CNN", (r"cnn\.com", r"cnn\.es", r"cnn\.ar", r"cnn\.de")),
    ("Reuters", (r"reuters\.com", r"reuters\.co\.uk", r"reuters\.in")),
    ("Associated Press", (r"ap\.org", r"apnews\.com")),
    ("The Guardian", (r"theguardian\.com", r"guardian\.co\.uk")),
    ("New York Times", (r"nytimes\.com", r"nytimes\.co\.uk")),
    ("Washington Post", (r"washingtonpost\.com", r"wapo\.st")),
    ("Al Jazeera", (r"aljazeera\.com", r"aljazeera\.net")),
    ("Times of India", (r"timesofindia\.indiatimes\.com", r"timesofindia\.com")),
    ("The Hindu", (r"thehindu\.com", r"thehindu\.in")),
    ("Hindustan Times", (r"hindustantimes\.com", r"ht\.com")),
    ("The Indian Express", (r"indianexpress\.com", r"expressindia\.com")),
    ("South China Morning Post", (r"scmp\.com", r"scmp\.hk")),
    ("China Daily", (r"chinadaily\.com\.cn", r"chinadaily\.cn")),
    ("Xinhua", (r"xinhuanet\.com", r"news\.cn")),
    ("Jakarta Post", (r"thejakartapost\.com", r"jakpost\.com")),
    ("Kompas", (r"kompas\.com", r"kompas\.id")),
    ("Dawn", (r"dawn\.com", r"dawn\.pk")),
    ("The Express Tribune", (r"tribune\.com\.pk", r"express\.com\.pk")),
    ("Daily Star", (r"thedailystar\.net", r"thedailystar\.com")),
    ("The Daily Star", (r"dailystar\.co\.uk", r"dailystar\.com")),
    ("News24", (r"news24\.com", r"news24\.co\.za")),
    ("Mail & Guardian", (r"mg\.co\.za", r"mg\.com")),
)
# Second-level labels under which a third one names the site, and tracking parameters.
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov")
TRACKERS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid")
# Paths of publication pages.
PUBLICATION_PATHS = ("/publication/", "/report/", "/analysis/", "/study/", "/research/", "/weekly-snapshot")


def netloc(url: Column | str) -> Column:
    """Host with port and user, as written; empty without `//`."""
    return F.regexp_extract(text_of(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host_or_unknown(url: Column | str) -> Column:
    return F.coalesce(F.nullif(F.lower(netloc(url)), F.lit("")), F.lit("unknown"))


def host_without_port(url: Column | str) -> Column:
    return F.split_part(F.lower(netloc(url)), F.lit(":"), F.lit(1))


def media_source(url: Column | str) -> Column:
    """The outlet by its host pattern, else the last two labels of the host, else empty."""
    host = F.lower(netloc(url))
    parts = F.split(host, "[.]")
    out = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(host)
    for name, patterns in reversed(OUTLETS):
        out = F.when(host.rlike("|".join(patterns)), F.lit(name)).otherwise(out)
    return out


def base_domain(url: Column | str) -> Column:
    """Registrable domain: two labels, three under a second-level label; null if there is nothing to name."""
    t = F.lower(text_of(url))
    where = F.coalesce(F.nullif(F.lower(netloc(url)), F.lit("")), F.regexp_extract(t, r"^([^?#]*)", 1))
    where = F.regexp_replace(where, r"^www[.]", "")
    p = F.split(where, "[.]")
    n = F.size(p)
    three = (n >= 3) & F.element_at(p, F.when(n >= 2, -2).otherwise(-1)).isin(*SECOND_LEVEL)
    out = F.when(three, F.array_join(F.slice(p, -3, 3), ".")).when(n >= 2, F.array_join(F.slice(p, -2, 2), ".")).otherwise(where)
    return F.nullif(out, F.lit(""))


def canonical(url: Column | str) -> Column:
    """Lower-case scheme and host without port, no fragment or trackers, sorted query, `/` for an empty path."""
    t = F.regexp_replace(text_of(url), r"^\s+|\s+$", "")
    part = lambda k: F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)[?]?([^#]*)", k)
    host = F.split_part(F.regexp_replace(F.lower(part(2)), r"^.*@", ""), F.lit(":"), F.lit(1))
    path = F.coalesce(F.nullif(F.regexp_replace(part(3), r";[^/]*$", ""), F.lit("")), F.lit("/"))
    pairs = F.array_sort(F.filter(F.split(part(4), "&"), lambda x: x.contains("=") & ~F.split_part(x, F.lit("="), F.lit(1)).isin(*TRACKERS) & ~x.endswith("=")))
    query = F.array_join(pairs, "&")
    return F.concat(F.lower(part(1)), F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def stable_id(url: Column | str) -> Column:
    return F.sha1(canonical(url))


def blocked(url: Column | str, domains: Sequence[str] = (), parts: Sequence[str] = ()) -> Column:
    """A black-listed string in the host, or one in the whole URL."""
    out = F.lit(False)
    for d in domains:
        out = out | F.lower(netloc(url)).contains(d.lower())
    for p in parts:
        out = out | F.lower(text_of(url)).contains(p.lower())
    return out


def is_publication(url: Column | str, base: str, paths: Sequence[str] = PUBLICATION_PATHS) -> Column:
    u = F.lower(text_of(url))
    hit = F.lit(False)
    for p in paths:
        hit = hit | u.contains(p)
    return u.startswith(base.lower()) & hit
