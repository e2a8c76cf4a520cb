"""URL and query-string Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARAMS = "array<struct<name:string,value:string>>"


def percent_encode(text: Column) -> Column:
    """Percent-encoding of everything but letters, digits and ``- _ . ! ~ * ' ( )``."""
    out = F.url_encode(text)
    for form, wanted in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(form), F.lit(wanted))
    return out


def percent_decode(text: Column) -> Column:
    """Inverse of percent_encode; a plus stays a plus, a malformed escape gives null."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def query_params(query: Column, decode: bool = False) -> Column:
    """Name-value pairs of a query string. Parameters without a name go; one malformed escape empties the whole list."""
    change = percent_decode if decode else (lambda c: c)
    pairs = F.split(F.substring_index(F.coalesce(query, F.lit("")), "#", 1), "&")
    # what stands behind the first "="
    value = lambda p: F.regexp_replace(p, "^[^=]*=?", "")
    named = F.filter(pairs, lambda p: F.substring_index(p, "=", 1) != "")
    parsed = F.transform(named, lambda p: F.struct(change(F.substring_index(p, "=", 1)).alias("name"), change(value(p)).alias("value")))
    return F.when(F.exists(parsed, lambda p: p["name"].isNull() | p["value"].isNull()), F.array().cast(PARAMS)).otherwise(parsed)


def query_string(params: Column, encode: bool = False) -> Column:
    """Parameters joined to a query string; blank names go, missing values are empty."""
    change = percent_encode if encode else (lambda c: c)
    named = F.filter(params, lambda p: F.trim(F.coalesce(p["name"], F.lit(""))) != "")
    return F.array_join(F.transform(named, lambda p: F.concat(change(p["name"]), F.lit("="), change(F.coalesce(p["value"], F.lit(""))))), "&")


def url_query(url: Column) -> Column:
    """What stands between the first ``?`` and the first ``#``; null without a question mark."""
    head = F.substring_index(url, "#", 1)
    return F.when(F.contains(head, F.lit("?")), F.regexp_replace(head, r"^[^?]*\?", ""))


def reencode_url(url: Column) -> Column:
    """The URL with its query parameters percent-encoded (again, if they were); without a query it is unchanged."""
    hash_ = F.when(F.contains(url, F.lit("#")), F.regexp_replace(url, "(?s)^[^#]*#", "#")).otherwise(F.lit(""))
    base = F.substring_index(F.substring_index(url, "#", 1), "?", 1)
    return F.when(url_query(url).isNull(), url).otherwise(F.concat(base, F.lit("?"), query_string(query_params(url_query(url)), encode=True), hash_))


def strip_origin(url: Column) -> Column:
    """Path, query and fragment; ``/`` if nothing is left."""
    rest = F.regexp_replace(url, r"^https?://[^/?#]*", "")
    return F.when(rest == "", F.lit("/")).otherwise(rest)


def comparable_path(url: Column) -> Column:
    """A request URL reduced to its path: no variables, origin or query, ``{x}`` as ``:x``, single slashes, none at the end."""
    out = F.coalesce(url, F.lit(""))
    for pattern, new in ((r"\{\{[^}]+\}\}", ""), (r"^https?://[^/]+", ""), (r"\?.*$", ""), (r"\{([^}]+)\}", ":$1"), (r"/+", "/"), (r"/$", "")):
        out = F.regexp_replace(out, pattern, new)
    return out


def path_param_names(url: Column) -> Column:
    """Distinct names of ``:name`` segments, and of ``:name`` inside ``Entity(...)`` segments, in order."""
    path = F.substring_index(F.substring_index(strip_origin(url), "#", 1), "?", 1)
    segments = F.split(path, "/")
    found = F.transform(segments, lambda s: F.when(s.startswith(":"), F.array(F.substring(s, 2, 1 << 30))).when(s.rlike(r"^[A-Za-z0-9_.-]+\([^)]*\)"), F.regexp_extract_all(F.regexp_extract(s, r"\(([^)]*)\)", 1), F.lit(r":(\w+)"), F.lit(1))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.flatten(found), lambda x: x != ""))


def fill_path_params(url: Column, values: Column) -> Column:
    """``:name`` segments replaced by their values where ``values`` (a map) has them; only the path is touched."""
    head = F.regexp_extract(url, r"^(https?://[^/?#]*)?", 0)
    rest = F.regexp_replace(url, r"^https?://[^/?#]*", "")
    path = F.regexp_extract(rest, r"^[^?#]*", 0)
    tail = F.regexp_replace(rest, r"^[^?#]*", "")
    filled = F.transform(F.split(path, "/"), lambda s: F.when(s.startswith(":"), F.coalesce(F.element_at(values, F.substring(s, 2, 1 << 30)), s)).otherwise(s))
    return F.concat(head, F.array_join(filled, "/"), tail)


def form_payload(params: Column) -> Column:
    """Form-urlencoded text in the given order, missing values empty."""
    return F.array_join(F.transform(params, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(F.coalesce(p["value"], F.lit(""))))), "&")


def url_host(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), url)


def url_path(url: Column) -> Column:
    """Path and query of a URL; a text that is no URL comes back as it is."""
    host = F.try_parse_url(url, F.lit("HOST"))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    query = F.try_parse_url(url, F.lit("QUERY"))
    return F.when(host.isNull(), url).otherwise(F.concat(F.when(path == "", "/").otherwise(path), F.coalesce(F.concat(F.lit("?"), query), F.lit(""))))
