"""Status, display and naming column functions."""
from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import AUDIO_DIR, BADGES, DEFAULT_VOICE, FEED_BADGES, FEED_ERROR_THRESHOLD
from .regex import WS, let


def truthy(c: Column) -> Column:
    """Python truthiness of an optional string: not NULL and not empty."""
    return c.isNotNull() & (c != "")


def content_status(is_processed: Column, is_processing: Column, error: Column) -> Column:
    return (F.when(~is_processed & ~is_processing, F.lit("pending"))
            .when(is_processing, F.lit("processing"))
            .when(is_processed & ~truthy(error), F.lit("completed"))
            .otherwise(F.lit("error")))


def feed_status(is_active: Column, error_count: Column) -> Column:
    return (F.when(~is_active, F.lit("inactive"))
            .when(error_count > FEED_ERROR_THRESHOLD, F.lit("error"))
            .otherwise(F.lit("active")))


def _label(status: Column, labels: dict[str, str]) -> Column:
    """The label of a status; the last label is that of every other one."""
    *known, (_, rest) = labels.items()
    return F.coalesce(*[F.when(status == name, F.lit(label)) for name, label in known], F.lit(rest))


def status_badge(status: Column) -> Column:
    return _label(status, BADGES)


def feed_badge(status: Column) -> Column:
    return _label(status, FEED_BADGES)


def web_path(file_path: Column) -> Column:
    """``/`` joined with the stored path; an absolute path stays as it is."""
    return (F.when(~truthy(file_path), F.lit(None).cast("string"))
            .when(F.startswith(file_path, F.lit("/")), file_path)
            .otherwise(F.concat(F.lit("/"), file_path)))


def output_name(url: Column) -> Column:
    """Deterministic audio file name per content (no clock, no random id)."""
    return F.concat(F.md5(url), F.lit(".mp3"))


def relative_audio_path(path: Column) -> Column:
    return F.concat(F.lit(AUDIO_DIR), F.element_at(F.split(path, "/", -1), -1))


@lru_cache(maxsize=1)
def _folds() -> str:
    """Every character beyond ASCII that has an ASCII form (compatibility decomposition, marks dropped), as JSON."""
    forms = ((chr(cp), unicodedata.normalize("NFKD", chr(cp)).encode("ascii", "ignore").decode("ascii")) for cp in range(0x80, 0x110000))
    return json.dumps({ch: form for ch, form in forms if form})


def _ascii_form(name: Column) -> Column:
    """Characters beyond ASCII as their ASCII form, which may have several letters, or dropped without one."""
    table = F.from_json(F.lit(_folds()), "map<string,string>")
    folded = F.array_join(F.transform(F.split(name, ""), lambda c: F.when(c < "\x80", c).otherwise(
        F.coalesce(F.try_element_at(table, c), F.lit("")))), "")
    return F.when(F.octet_length(name) == F.length(name), name).otherwise(folded)


def secure_filename(name: Column) -> Column:
    """ASCII-only, whitespace runs to ``_``, only ``[A-Za-z0-9_.-]``, ends stripped of ``._``."""
    s = _ascii_form(name)
    s = F.translate(s, "/", " ")
    s = F.regexp_replace(F.regexp_replace(s, rf"^{WS}+|{WS}+$", ""), rf"{WS}+", "_")
    s = F.regexp_replace(s, r"[^A-Za-z0-9_.-]", "")
    return F.regexp_replace(s, r"^[._]+|[._]+$", "")


def download_name(title: Column, default: str) -> Column:
    return F.concat(secure_filename(F.when(truthy(title), title).otherwise(F.lit(default))), F.lit(".mp3"))


def truncate_words(s: Column, n: int, leeway: int = 5, end: str = "...") -> Column:
    """Template-style truncate: keep if within ``n + leeway``, else cut on a word boundary."""
    return let(s, lambda x: F.when(F.length(x) <= n + leeway, x).otherwise(
        F.concat(F.regexp_replace(F.substring(x, 1, n - len(end)), " [^ ]*$", ""), F.lit(end))))


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def url_quote(s: Column) -> Column:
    """Percent-encoding with ``/`` kept and space as ``%20`` (template urlencode)."""
    e = F.url_encode(s)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def requested_voice(voice: Column) -> Column:
    """A missing voice field means the default voice."""
    return F.coalesce(voice, F.lit(DEFAULT_VOICE))
