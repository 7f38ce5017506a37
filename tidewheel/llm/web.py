"""Host and path of a url, with DataFrame functions."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

#: After the first "://": the host up to "/", "?", "#" or the end, then the path up to "?", "#" or the end.
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host(url: Column) -> Column:
    """Host with A-Z lower-cased; empty for null and for a url without "://"."""
    return F.coalesce(lower_ascii(F.regexp_extract(url.cast("string"), _SPLIT, 1)), F.lit(""))


def path(url: Column) -> Column:
    """Path as it stands; empty for null and for a url without "://"."""
    return F.coalesce(F.regexp_extract(url.cast("string"), _SPLIT, 2), F.lit(""))
