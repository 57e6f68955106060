"""Websites: parts, cleaning, block lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from herdbook.functions.text import contains_any, null_if_sentinel, strip

#: Endings of files that aren't pages.
BINARY_ENDINGS = ("pdf", "jpg", "jpeg", "png", "gif", "svg", "webp", "zip", "rar", "7z", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "mp3", "mp4", "avi", "mov", "exe")
#: A short list of hosts that list practices but belong to none; a caller's own table is given as `blocked`.
BLOCKED = ("facebook", "instagram", "linkedin", "youtube", "twitter", "tiktok", "yelp", "tripadvisor", "wikipedia", "google", "bing", "localsearch", "pagesjaunes", "paginegialle", "gelbeseiten", "tel")


def scheme(url: Column) -> Column:
    """The scheme in lower case, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit(""))


def host(url: Column) -> Column:
    """The host in lower case without user and port, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """The path, '' if there is none."""
    return F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def homepage(url: Column) -> Column:
    """scheme://host/ of a URL."""
    return F.when(host(url).isNotNull(), F.concat(scheme(url), F.lit("://"), host(url), F.lit("/")))


def without_fragment(url: Column) -> Column:
    """The URL up to '#'."""
    return F.regexp_replace(url, "#.*$", "")


def joined(base: Column, href: Column) -> Column:
    """href seen from base: absolute ones stay, others stand at the host, or beside the last part of the path."""
    root = F.concat(scheme(base), F.lit("://"), host(base))
    beside = F.concat(root, F.coalesce(F.nullif(F.regexp_replace(path(base), "[^/]*$", ""), F.lit("")), F.lit("/")), href)
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(beside)


def is_binary(url: Column) -> Column:
    """True if the path ends like a file that isn't a page."""
    return F.coalesce(F.lower(path(url)).rlike(r"\.(?:" + "|".join(BINARY_ENDINGS) + ")$"), F.lit(False))


def is_binary_target(url: Column) -> Column:
    """True if the path with its query ends like a file that isn't a page: '/page?file=a.pdf' does, too."""
    return F.coalesce(F.lower(F.regexp_replace(F.regexp_replace(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"#.*$|\s+$", "")).rlike(r"\.(?:" + "|".join(BINARY_ENDINGS) + ")$"), F.lit(False))


def last_part(url: Column) -> Column:
    """The last part of the path that isn't empty, in lower case; '' for a root."""
    return F.lower(F.regexp_extract(path(url), r"([^/]*)/*$", 1))


def top_level(url: Column) -> Column:
    """The host's last label."""
    return F.element_at(F.split(host(url), r"\."), -1)


def clean(url: Column, country: str | None = None, resolves: Column | None = None, with_query: bool = False) -> Column:
    """A usable website in lower case, or null.

    Null: sentinels, other schemes than http(s), hosts without a dot, hosts that don't resolve (`resolves`, a column of a
    lookup table, if given), two-letter top levels other than the country's. A file's URL becomes its home page; with
    `with_query` the ending is looked for behind the query.
    """
    u = null_if_sentinel(strip(url))
    ok = scheme(u).isin("http", "https") & F.contains(host(u), F.lit("."))
    if country:
        ok &= ~((F.length(top_level(u)) == 2) & (top_level(u) != country))
    if resolves is not None:
        ok &= F.coalesce(resolves, F.lit(False))
    return F.when(ok, F.when(is_binary_target(u) if with_query else is_binary(u), homepage(u)).otherwise(F.lower(u)))


def labels(url: Column) -> Column:
    """The host's labels without the last one."""
    parts = F.split(host(url), r"\.")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def blocked_exactly(url: Column, blocked: tuple[str, ...] = BLOCKED) -> Column:
    """True if a label of the host is on the list."""
    return F.coalesce(F.arrays_overlap(labels(url), F.array(*map(F.lit, blocked))), F.lit(False))


def blocked_loosely(url: Column, blocked: tuple[str, ...] = BLOCKED) -> Column:
    """True if the host (without www.) holds a listed word anywhere: 'tel' blocks 'hotel'."""
    return contains_any(F.regexp_replace(host(url), r"^www\.", ""), list(blocked))


def lucky(url: Column, blocked: tuple[str, ...] = BLOCKED) -> Column:
    """The URL if it is https and holds no listed word at all, else null."""
    return F.when((scheme(url) == "https") & ~contains_any(F.lower(url), list(blocked)), url)


def probably_page(url: Column) -> Column:
    """True for an http(s) URL that isn't a file's."""
    return F.coalesce(scheme(url).isin("http", "https") & ~is_binary(url), F.lit(False))
