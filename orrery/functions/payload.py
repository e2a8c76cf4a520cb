"""Column functions over headers, bodies, tags, sizes and secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Response formats by MIME pattern, first match wins; all else is raw.
FORMATS = [
    (r"^text/html$", "html"),
    (r"^(application|text)/(json|.+\+json)$", "json"),
    (r"^(application|text)/(xml|.+\+xml)$", "xml"),
    (r"^(application|text)/javascript$", "javascript"),
    (r"^(image|audio|video)/", "base64"),
    (r"^application/pdf$", "base64"),
]

# Leading bytes (hexadecimal, _ for any byte) and the types they tell.
SIGNATURES = [
    ("FFD8FF", "image/jpeg"),
    ("89504E47", "image/png"),
    ("474946", "image/gif"),
    ("________________57454250", "image/webp"),
    ("________6674797061766966", "image/avif"),
    ("424D", "image/bmp"),
    ("49492A00", "image/tiff"),
    ("4D4D002A", "image/tiff"),
    ("00000100", "image/x-icon"),
    ("3C73766720", "image/svg+xml"),
    ("25504446", "application/pdf"),
    ("0000001866747970", "video/mp4"),
    ("0000002066747970", "video/mp4"),
    ("1A45DFA3", "video/webm"),
    ("52494646________41564920", "video/x-msvideo"),
    ("FFE", "audio/mpeg"),
    ("FFF", "audio/mpeg"),
    ("52494646________57415645", "audio/wav"),
    ("4F676753", "audio/ogg"),
    ("________667479704D3441", "audio/m4a"),
    ("504B03", "application/zip"),
    ("504B05", "application/zip"),
    ("504B07", "application/zip"),
    ("1F8B", "application/gzip"),
]

# Fixed value: what stands for the body of an image.
IMAGE_NOTICE = "Response content redacted (image data)"

TEXT_SHARE = 0.85
SNIFFED_BYTES = 512


def fixed(number: Column, digits: int) -> Column:
    """Decimal text with a fixed number of digits, rounded from the exact binary value."""
    return F.call_function("format_number", number, F.lit("0." + "0" * digits))


def header(headers: Column, name: str) -> Column:
    """Value of a header by case-insensitive name, empty if absent."""
    values = F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name.lower()))
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def content_type(headers: Column) -> Column:
    return header(headers, "content-type")


def is_html(mime: Column) -> Column:
    return F.coalesce(F.contains(mime, F.lit("html")), F.lit(False))


def response_format(mime: Column) -> Column:
    clean = F.regexp_extract(F.lower(F.trim(F.coalesce(mime, F.lit("")))), r"^[^;]+", 0)
    out = F.lit("raw")
    for pattern, name in reversed(FORMATS):
        out = F.when(clean.rlike(pattern), name).otherwise(out)
    return out


def body_kind(mime: Column) -> Column:
    """ndjson, json, xml or text by what the content type holds; null for unstructured bodies."""
    low = F.lower(F.coalesce(mime, F.lit("")))
    has = lambda *names: F.greatest(*[F.contains(low, F.lit(n)) for n in names], F.lit(False))
    ndjson, json = has("application/x-ndjson", "application/ndjson"), has("application/json", "+json")
    return F.when(ndjson, "ndjson").when(json, "json").when(has("application/xml", "+xml", "text/xml"), "xml").when(has("text/plain"), "text")


def sniff_type(body: Column) -> Column:
    """Type of a binary body by its first bytes, then SVG, then text by the share of printable bytes; null if none."""
    first = F.hex(F.substring(body, 1, 12))
    out = F.when(F.lower(F.decode(F.substring(body, 1, SNIFFED_BYTES), "ISO-8859-1")).rlike(r"(?s)^\s*(<\?xml.*?)?(<!doctype svg|<svg)"), "image/svg+xml")
    head = F.decode(F.substring(body, 1, SNIFFED_BYTES), "ISO-8859-1")
    printable = F.length(F.regexp_replace(head, r"[^\t\n\r\x20-\x7e\x80-\xff]", ""))
    out = out.when(printable > TEXT_SHARE * F.length(head), "text/plain")
    known = None
    for signature, name in SIGNATURES:
        test = first.like(signature + "%")
        known = F.when(test, name) if known is None else known.when(test, name)
    return F.when(F.octet_length(body) >= 4, F.coalesce(known, out)).when(F.octet_length(body) > 0, out)


def redact_image(mime: Column, body: Column) -> Column:
    return F.when(F.contains(mime, F.lit("image")), F.lit(IMAGE_NOTICE)).otherwise(body)


def response_size(status_line: Column, headers: Column, raw: Column, text: Column) -> Column:
    """Struct of body, header and total bytes: raw bytes, else Content-Length, else the text's bytes."""
    body = F.coalesce(F.octet_length(raw).cast("long"), F.try_to_number(F.nullif(header(headers, "content-length"), F.lit("")), F.lit("999999999999")).cast("long"), F.octet_length(text).cast("long"), F.lit(0).cast("long"))
    lines = F.aggregate(F.map_entries(headers), F.lit(0).cast("long"), lambda n, e: n + F.octet_length(F.concat(e["key"], F.lit(": "), e["value"])) + 2)
    head = F.octet_length(status_line) + 2 + F.coalesce(lines, F.lit(0)) + 2
    return F.struct(body.alias("body"), head.cast("long").alias("headers"), (body + head).cast("long").alias("total"))


def human_size(n: Column) -> Column:
    scaled = lambda power, unit: F.concat(fixed(n / 1024**power, 1), F.lit(unit))
    return F.when(n.isNull(), "0B").when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1024**2, scaled(1, "KB")).when(n < 1024**3, scaled(2, "MB")).otherwise(scaled(3, "GB"))


def human_duration(ms: Column) -> Column:
    """``-`` if missing, milliseconds below a second, else seconds with two decimals."""
    return F.when(ms.isNull() | (ms == 0), "-").when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit("ms"))).otherwise(F.concat(fixed(ms / 1000, 2), F.lit("s")))


def sanitize_tag(tag: Column) -> Column:
    """Trimmed, white space and symbols as single underscores, starting and ending in a letter or digit; null if empty."""
    out = F.trim(tag)
    for pattern, new in ((r"\s+", "_"), (r"[^\p{L}\p{N}\-_]", "_"), (r"_+", "_"), (r"^[^\p{L}\p{N}]+", ""), (r"[^\p{L}\p{N}]+$", "")):
        out = F.regexp_replace(out, pattern, new)
    return F.nullif(out, F.lit(""))


def sanitize_tags(tags: Column) -> Column:
    """Distinct usable tags in order; none for null."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(tags, sanitize_tag), lambda t: t.isNotNull())), F.array().cast("array<string>"))


def mask(value: Column) -> Column:
    return F.repeat(F.lit("*"), F.length(value))


def blank_secrets(variables: Column) -> Column:
    """Environment variables (structs with name, value, enabled, secret) with secret values emptied."""
    return F.transform(variables, lambda v: v.withField("value", F.when(v["secret"], F.lit("")).otherwise(v["value"])))


def fingerprint(spec: Column) -> Column:
    return F.md5(spec)


def has_updates(stored: Column, spec: Column) -> Column:
    """Whether a spec differs from its stored fingerprint; nothing stored counts as different."""
    return F.coalesce(stored != fingerprint(spec), F.lit(True))


def status_number(status: Column) -> Column:
    """A status text as a number; empty or unreadable is null."""
    return F.nullif(F.trim(status), F.lit("")).try_cast("int")


def credential_variables(credentials: Column, credential_id: Column) -> Column:
    """A credential map as variables named ``$oauth2.<id>.<key>``."""
    return F.transform_keys(credentials, lambda k, v: F.concat(F.lit("$oauth2."), credential_id, F.lit("."), k))


def normalize_variables(text: Column) -> Column:
    """Inside ``{{...}}`` the first ``_.`` and all spaces go."""
    inner = F.split(F.coalesce(text, F.lit("")), r"(?=\{\{)|(?<=\}\})")
    clean = lambda p: F.replace(F.regexp_replace(p, r"^([^}]*?)_\.", "$1"), F.lit(" "), F.lit(""))
    return F.array_join(F.transform(inner, lambda p: F.when(p.rlike(r"^\{\{.*\}\}$"), clean(p)).otherwise(p)), "")
