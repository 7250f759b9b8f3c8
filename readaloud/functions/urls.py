"""URL column functions: domain (netloc) and the three validity rules."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import let

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def prepared(url: Column) -> Column:
    """Leading control characters and spaces removed; tabs and newlines dropped."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def domain(url: Column) -> Column:
    """The netloc: everything between ``//`` and the path (keeps user info and port)."""
    return F.regexp_extract(prepared(url), NETLOC, 1)


def _unbalanced(netloc: Column) -> Column:
    has_open, has_close = F.instr(netloc, "[") > 0, F.instr(netloc, "]") > 0
    return (has_open & ~has_close) | (has_close & ~has_open)


def is_valid_url(url: Column) -> Column:
    """Scheme and netloc both present (and the netloc parses)."""
    def body(u):
        net = F.regexp_extract(u, SCHEME[:-1] + r"://([^/?#]*)", 1)
        return F.coalesce(u.rlike(SCHEME) & (net != "") & ~_unbalanced(net), F.lit(False))
    return let(prepared(url), body)


def is_http_url(url: Column) -> Column:
    """Scheme http or https (any case) and a non-empty host."""
    def body(u):
        scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        net = F.regexp_extract(u, SCHEME[:-1] + r"://([^/?#]*)", 1)
        return F.coalesce(scheme.isin("http", "https") & (net != ""), F.lit(False))
    return let(F.trim(url), body)


def matches_url_pattern(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://.+\..+"), F.lit(False))


def form_field(body: Column, name: str) -> Column:
    """The first value of a field in a form-encoded body: ``+`` is a space, ``%XX`` a byte of UTF-8; NULL when the field is missing.

    A percent sign that begins no such byte stays as it is.
    """
    def value(pair):
        raw = F.regexp_replace(F.regexp_replace(pair, r"^[^=]*=?", ""), r"%(?![0-9A-Fa-f]{2})", "%25")
        return F.try_url_decode(raw)
    key = F.lit(name)
    own = F.filter(F.split(body, "&", -1), lambda p: F.try_url_decode(F.regexp_replace(F.regexp_extract(p, r"^([^=]*)", 1), r"%(?![0-9A-Fa-f]{2})", "%25")) == key)
    return let(F.get(own, F.lit(0)), lambda p: F.when(p.isNotNull(), value(p)))


def is_form(body: Column) -> Column:
    """Whether every part of a body is ``name=value`` with a name; anything else is a corrupt record."""
    return F.coalesce(F.forall(F.split(body, "&", -1), lambda p: p.rlike(r"^[^=]+=")), F.lit(False))
