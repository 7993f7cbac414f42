"""URLs as Column expressions: parts, resolution against a base, names of resources (P-07, P-08, F-44).

The parts follow the generic syntax of RFC 3986, resolution its section 5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def scheme(url: Column) -> Column:
    """Lower-case scheme, empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """What stands between ``//`` and the path, port included."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def without_dots(p: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    segments = F.split(p, "/", -1)
    none = F.array().cast("array<string>")
    step = lambda kept, s: F.when(s == ".", kept).when(s == "..", F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)).otherwise(F.concat(kept, F.array(s)))
    folded = F.array_join(F.aggregate(segments, none, step), "/")
    return F.when(~p.rlike(r"(^|/)\.\.?(/|$)"), p).otherwise(F.when(p.rlike(r"(^|/)\.\.?$"), F.concat(folded, F.lit("/"))).otherwise(folded))


def joined(base: Column, ref: Column) -> Column:
    """A reference resolved against a base that has a scheme; fragments are left off both."""
    base, ref = F.regexp_replace(base, "#.*$", ""), F.regexp_replace(ref, "#.*$", "")
    site = F.regexp_extract(base, r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?)", 1)
    tail = F.regexp_extract(ref, r"(\?.*)$", 1)
    folder = F.when(path(base) == "", F.lit("/")).otherwise(F.regexp_replace(path(base), "[^/]*$", ""))
    rel = path(ref)
    return (
        F.when(ref.rlike(SCHEME), F.when(host(ref) == "", ref).otherwise(F.concat(F.regexp_extract(ref, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), without_dots(rel), tail)))
        .when(ref.startswith("//"), F.concat(scheme(base), F.lit("://"), host(ref), without_dots(rel), tail))
        .when(rel == "", F.when(tail == "", base).otherwise(F.concat(site, path(base), tail)))
        .when(rel.startswith("/"), F.concat(site, without_dots(rel), tail))
        .otherwise(F.concat(site, without_dots(F.concat(folder, rel)), tail))
    )


def resource_name(url: Column, same_host: Column) -> Column:
    """A resource's name in a listing: the last segment, else the host; up to 40 characters of the query; the host before it where foreign."""
    last = F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), "([^/]*)$", 1)
    site = F.coalesce(F.nullif(host(url), F.lit("")), F.lit("index"))
    own = F.when(last == "", site).when(query(url) != "", F.concat(last, F.lit("?"), F.substring(query(url), 1, 40))).otherwise(last)
    return F.translate(F.when(same_host | (host(url) == ""), own).otherwise(F.concat(host(url), F.lit(" · "), own)), "/", "_")
