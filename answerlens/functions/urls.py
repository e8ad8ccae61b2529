"""URL canonical forms and predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from answerlens.functions.text import bind

# Query parameters that do not change what a URL points to.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "utm_source_platform", "utm_creative_format", "utm_marketing_tactic",
    "gclid", "gbraid", "wbraid", "msclkid", "fbclid", "twclid", "ttclid", "si", "s_kwcid",
    "_hsenc", "_hsmi", "__hssc", "__hstc", "__hsfp", "hsCtaTracking", "mc_cid", "mc_eid",
    "ref", "referrer", "source", "track", "trk",
    "pk_campaign", "pk_kwd", "pk_keyword", "piwik_campaign", "piwik_kwd", "piwik_keyword",
]

# Link shapes in running text.
MARKDOWN_LINK = r"\[([^\]]+)\]\(([^)]+)\)"
ANY_URL = r"https?://[^\s<>\"{}|\\^`\[\]]+"
DOMAIN = r"(?<![A-Za-z0-9_])(?:[A-Za-z0-9][-A-Za-z0-9]*\.)+[A-Za-z]{2,}(?![A-Za-z0-9_])"
DOMAIN_FORM = r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*\.[a-z]{2,}$"
IMAGE_SUFFIX = r"\.(jpg|png|gif|jpeg|webp|svg)$"
FILE_SUFFIX = r"\.(md|js|ts|json)$"

_TRAILING = r"[),.:;!?*\[\]_]+$"


def _kept_query(query: Column) -> Column:
    """``?`` and the parts of a query that are no tracking; empty if none is left."""
    tracking = lambda p: F.substring_index(p, "=", 1).isin(TRACKING_PARAMS)

    def kept(parts: Column) -> Column:
        # Empty parts go along with tracking parameters; a query without any stays as it is.
        filled = F.exists(parts, lambda p: p != "")
        return F.when(F.exists(parts, tracking) | ~filled, F.filter(parts, lambda p: (p != "") & ~tracking(p))).otherwise(parts)

    return bind(bind(F.split(query, "&"), kept), lambda k: F.when(
        F.size(k) > 0, F.concat(F.lit("?"), F.array_join(k, "&"))
    ).otherwise(F.lit("")))


def strip_tracking(url: Column) -> Column:
    """Drop tracking parameters, and the ``?`` when none is left; scheme and host are lower-cased.

    Each step is bound, since an expression is computed anew wherever a later one names it.
    """

    def joined(u: Column, base: Column, query: Column, authority: Column) -> Column:
        rest = F.substring(base, F.length(authority) + 1, F.length(base))
        return F.when(F.regexp_replace(authority, r"^[A-Za-z]+://", "") == "", u).otherwise(F.concat(
            F.lower(authority),
            # A URL with an empty path reads as its root.
            F.when(F.length(base) == F.length(authority), F.lit("/")).otherwise(rest),
            F.when(query.isNull(), F.lit("")).otherwise(_kept_query(query)),
            F.when(u.contains("#"), F.regexp_extract(u, r"(#.*)$", 1)).otherwise(F.lit("")),
        ))

    def cut(u: Column, bare: Column) -> Column:
        query = lambda base: F.when(bare.contains("?"), F.substring(bare, F.length(base) + 2, F.length(bare)))
        parts = lambda base: F.struct(
            base.alias("base"), query(base).alias("query"),
            F.regexp_extract(base, r"^((?:[A-Za-z]+://)?[^/]*)", 1).alias("authority"),
        )
        return bind(bind(F.substring_index(bare, "?", 1), parts), lambda p: joined(u, p["base"], p["query"], p["authority"]))

    bare = lambda u: F.when(u.contains("#"), F.regexp_replace(u, r"#.*$", "")).otherwise(u)
    return bind(url, lambda u: bind(bare(u), lambda b: cut(u, b)))


def percent_decode(text: Column) -> Column:
    """Percent-decode keeping ``+``; null when the escapes are broken."""
    return F.when(~text.contains("%"), text).when(
        ~text.rlike(r"%(?![0-9A-Fa-f]{2})"),
        F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))),
    )


def clean_url(url: Column) -> Column:
    """Canonical form for comparing links: no scheme, ``www.``, tracking or trailing marks.

    Text that cannot be percent-decoded is returned unchanged.
    """
    c = strip_tracking(percent_decode(url))
    c = F.regexp_replace(c, _TRAILING, "")
    c = F.regexp_replace(c, r"^https?://", "")
    c = F.regexp_replace(c, r"^www\.", "")
    c = F.regexp_replace(c, r"/+$", "")
    c = F.regexp_replace(c, _TRAILING, "")
    return F.coalesce(c, url)


def hostname(url: Column) -> Column:
    """Lower-cased host without port, credentials and ``www.``; works on bare domains too."""
    s = F.trim(url)
    with_scheme = s.rlike(r"^[A-Za-z]+://")
    authority = F.regexp_extract(s, r"^[A-Za-z]+://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    bare = F.regexp_extract(F.regexp_replace(s, r"(?i)^www\.", ""), r"^([^/#?]*)", 1)
    return F.regexp_replace(F.lower(F.when(with_scheme, host).otherwise(bare)), r"^www\.", "")


def domain_of(url: Column) -> Column:
    """Domain key of a cleaned link: cut at the first of ``? / # @ : ; =``."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^([^?/#@:;=]*)", 1), r"^www\.", "")


def normalized_url(url: Column) -> Column:
    """Form used to compare a URL in text with a domain name: no scheme, www, one slash, query."""
    u = F.regexp_replace(F.lower(url), r"^(?:https?://)?(?:www\.)?", "")
    u = F.regexp_replace(u, r"/$", "")
    return F.regexp_extract(u, r"^([^?#]*)", 1)


def is_valid_link(link: Column) -> Column:
    """A domain with a two-letter-or-longer ending, alone, with a path, or behind http/https/ftp."""
    s = F.lower(F.trim(link))
    host = F.when(
        s.rlike(r"^(https?|ftp)://.+$"), F.regexp_extract(s, r"^(?:https?|ftp)://([^/]+)", 1)
    ).otherwise(F.substring_index(s, "/", 1))
    return F.coalesce((F.length(s) >= 4) & host.rlike(DOMAIN_FORM), F.lit(False))


def is_url_like_title(url: Column, title: Column) -> Column:
    """True when a title says no more than the URL does."""
    no_scheme = F.lower(F.regexp_replace(url, r"^https?://", ""))
    title_bare = F.regexp_replace(F.lower(title), r"^https?://", "")
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"^www\.", ""), r"/$", "")
    return no_scheme.contains(title_bare) | (plain(no_scheme) == plain(title_bare)) | (title == "Untitled")
