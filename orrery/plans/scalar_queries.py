"""Queries that apply Column functions to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions import urls as U
from . import views as V
from .registry import query


def pages(spark, sf):
    """Page URLs with an awkward query appended, so that every rule has rows."""
    tail = F.element_at(F.array(F.lit(""), F.lit("&a=1=2&b"), F.lit("&=x&t=a%20b+c"), F.lit("&p=é|{x}")), (F.col("page_id") % 4 + 1).cast("int"))
    head = F.substring_index("url", "#", 1)
    hash_ = F.when(F.contains("url", F.lit("#")), F.concat(F.lit("#"), F.substring_index("url", "#", -1))).otherwise("")
    query_ = F.when(F.contains(head, F.lit("?")), tail).when(tail != "", F.concat(F.lit("?"), F.substring(tail, 2, 100))).otherwise("")
    return V.table(spark, sf, "pages").select("page_id", F.concat(head, query_, hash_).alias("url"))


PAGES = """WITH base AS (
  SELECT page_id, SPLIT_PART(url, '#', 1) AS head, CASE WHEN contains(url, '#') THEN '#' || SPLIT_PART(url, '#', 2) ELSE '' END AS h,
    CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '&a=1=2&b' WHEN 2 THEN '&=x&t=a%20b+c' ELSE '&p=é|{x}' END AS tail FROM pages),
p AS (SELECT page_id, head || CASE WHEN contains(head, '?') THEN tail WHEN tail <> '' THEN '?' || SUBSTRING(tail, 2) ELSE '' END || h AS url FROM base),
q AS (SELECT *, SPLIT_PART(url, '#', 1) AS front, CASE WHEN contains(SPLIT_PART(url, '#', 1), '?') THEN regexp_replace(SPLIT_PART(url, '#', 1), '^[^?]*\\?', '') END AS query FROM p),
pairs AS (SELECT page_id, UNNEST(STRING_SPLIT(query, '&')) AS pair, GENERATE_SUBSCRIPTS(STRING_SPLIT(query, '&'), 1) AS pos FROM q WHERE query IS NOT NULL),
params AS (SELECT page_id, pos, SPLIT_PART(pair, '=', 1) AS name, regexp_replace(pair, '^[^=]*=?', '') AS value FROM pairs WHERE SPLIT_PART(pair, '=', 1) <> '')
"""
ENCODED = "replace(replace(replace(replace(replace(replace(url_encode({0}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*'), '%7E', '~')"


@query("s1_query_params", PAGES + "SELECT page_id, STRING_AGG(name || '>' || value, ' ' ORDER BY pos) AS params FROM params GROUP BY page_id")
def s1(spark, sf):
    shown = F.array_join(F.transform(U.query_params(U.url_query(F.col("url"))), lambda p: F.concat(p["name"], F.lit(">"), p["value"])), " ")
    return pages(spark, sf).select("page_id", shown.alias("params")).where("params <> ''")


@query("s2_query_string", PAGES + "SELECT page_id, STRING_AGG(name || '=' || value, '&' ORDER BY pos) AS qs FROM params GROUP BY page_id")
def s2(spark, sf):
    return pages(spark, sf).select("page_id", U.query_string(U.query_params(U.url_query(F.col("url")))).alias("qs")).where("qs <> ''")


@query("s3_reencoded_url", PAGES + f""", coded AS (SELECT page_id, STRING_AGG({ENCODED.format('name')} || '=' || {ENCODED.format('value')}, '&' ORDER BY pos) AS qs FROM params GROUP BY page_id)
SELECT q.page_id, CASE WHEN query IS NULL THEN url ELSE SPLIT_PART(front, '?', 1) || '?' || COALESCE(qs, '') || CASE WHEN contains(url, '#') THEN '#' || SPLIT_PART(url, '#', 2) ELSE '' END END AS encoded FROM q LEFT JOIN coded USING (page_id)""")
def s3(spark, sf):
    return pages(spark, sf).select("page_id", U.reencode_url(F.col("url")).alias("encoded"))


@query("s4_strip_origin", PAGES + "SELECT page_id, COALESCE(NULLIF(regexp_replace(url, '^https?://[^/?#]*', ''), ''), '/') AS path FROM p")
def s4(spark, sf):
    return pages(spark, sf).select("page_id", U.strip_origin(F.col("url")).alias("path"))


@query("s5_comparable_path", PAGES + """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('{{base}}' || url || '/{id}//x/', '\\{\\{[^}]+\\}\\}', '', 'g'), '^https?://[^/]+', ''), '\\?.*$', ''), '\\{([^}]+)\\}', ':\\1', 'g'), '/+', '/', 'g'), '/$', '') AS path FROM p""")
def s5(spark, sf):
    return pages(spark, sf).select("page_id", U.comparable_path(F.concat(F.lit("{{base}}"), "url", F.lit("/{id}//x/"))).alias("path"))


@query("s6_path_params", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'id,key,k2' ELSE 'id' END AS names, 'https://h' || page_id || '.example.com/u/' || page_id || '/' || CASE WHEN page_id % 2 = 0 THEN 'Orders(:key,b=:k2)' ELSE ':' END || '/x?q=:no' AS filled FROM pages")
def s6(spark, sf):
    url = F.concat(F.lit("https://h"), F.col("page_id").cast("string"), F.lit(".example.com/u/:id/"), F.when(F.col("page_id") % 2 == 0, "Orders(:key,b=:k2)").otherwise(":"), F.lit("/x?q=:no"))
    rows = V.table(spark, sf, "pages").select("page_id", url.alias("url"))
    return rows.select("page_id", F.array_join(U.path_param_names(F.col("url")), ",").alias("names"), U.fill_path_params(F.col("url"), F.create_map(F.lit("id"), F.col("page_id").cast("string"))).alias("filled"))


@query("s13_form_payload", "SELECT page_id, 'a=' || replace(url_encode(url), '%20', '+') || '&b=' AS payload FROM pages")
def s13(spark, sf):
    params = F.array(F.struct(F.lit("a").alias("name"), F.col("url").alias("value")), F.struct(F.lit("b").alias("name"), F.lit(None).cast("string").alias("value")))
    return V.table(spark, sf, "pages").select("page_id", U.form_payload(params).alias("payload"))


@query("s20_host_and_path", PAGES + """SELECT page_id, CASE WHEN contains(url, '|') THEN url ELSE regexp_extract(url, '^https?://([^/?#]+)', 1) END AS host, CASE WHEN contains(url, '|') THEN url ELSE regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '#.*$', '') END AS path FROM p""")
def s20(spark, sf):
    return pages(spark, sf).select("page_id", U.url_host(F.col("url")).alias("host"), U.url_path(F.col("url")).alias("path"))


MIMES = ["text/html; charset=utf-8", "application/json", "application/vnd.api+JSON", "text/xml", "image/png", "application/javascript", "application/pdf", "text/plain", "", "application/x-ndjson"]
FORMATS = ["html", "json", "json", "xml", "base64", "javascript", "base64", "raw", "raw", "raw"]
KINDS = [None, "json", "json", "xml", None, None, None, "text", None, "ndjson"]


def mimes(spark, sf):
    return V.table(spark, sf, "events").select("event_id", "props", F.element_at(F.array(*map(F.lit, MIMES)), (F.col("event_id") % 10 + 1).cast("int")).alias("mime"))


def cases(values):
    return "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN " + (f"'{v}'" if v is not None else "NULL") for i, v in enumerate(values)) + " END"


@query("s14_content_type", f"SELECT event_id, {cases(MIMES)} AS ct, event_id % 10 = 0 AS html, CASE WHEN event_id % 10 = 4 THEN 'Response content redacted (image data)' ELSE props END AS body FROM events")
def s14(spark, sf):
    rows = mimes(spark, sf).withColumn("headers", F.create_map(F.lit("X-A"), F.lit("1"), F.lit("Content-TYPE"), F.col("mime")))
    return rows.select("event_id", P.content_type(F.col("headers")).alias("ct"), P.is_html(F.col("mime")).alias("html"), P.redact_image(F.col("mime"), F.col("props")).alias("body"))


@query("s15_response_format", f"SELECT event_id, {cases(FORMATS)} AS format FROM events")
def s15(spark, sf):
    return mimes(spark, sf).select("event_id", P.response_format(F.col("mime")).alias("format"))


@query("s16_body_kind", f"SELECT event_id, {cases(KINDS)} AS kind FROM events")
def s16(spark, sf):
    return mimes(spark, sf).select("event_id", P.body_kind(F.col("mime")).alias("kind"))


@query("s17_sniffed_type", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'audio/wav' WHEN 3 THEN 'image/svg+xml' ELSE 'text/plain' END AS sniffed FROM pages""")
def s17(spark, sf):
    body = F.when(F.col("page_id") % 5 < 3, F.concat(F.when(F.col("page_id") % 5 == 0, F.unhex(F.lit("89504E470D0A1A0A"))).when(F.col("page_id") % 5 == 1, F.unhex(F.lit("255044462D312E37"))).otherwise(F.unhex(F.lit("524946460000000057415645"))), F.col("html").cast("binary")))
    body = body.when(F.col("page_id") % 5 == 3, F.concat(F.lit(b"  <svg xmlns='x'>"), F.col("html").cast("binary"))).otherwise(F.col("html").cast("binary"))
    return V.table(spark, sf, "pages").select("page_id", P.sniff_type(body).alias("sniffed"))


@query("s18_response_size", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN strlen(html) WHEN 1 THEN 1234 ELSE strlen(url) END::BIGINT AS body, 15 + 2 + 2 + (CASE WHEN page_id % 3 = 1 THEN strlen('Content-Length: 1234') + 2 ELSE strlen('X-A: b') + 2 END)::BIGINT AS headers FROM pages""")
def s18(spark, sf):
    headers = F.when(F.col("page_id") % 3 == 1, F.create_map(F.lit("Content-Length"), F.lit("1234"))).otherwise(F.create_map(F.lit("X-A"), F.lit("b")))
    size = P.response_size(F.lit("HTTP/1.1 200 OK"), headers, F.when(F.col("page_id") % 3 == 0, F.col("html").cast("binary")), F.col("url"))
    return V.table(spark, sf, "pages").select("page_id", size["body"].alias("body"), size["headers"].alias("headers"))


@query("s19_human_sizes", """WITH s AS (SELECT o_orderkey, CAST(FLOOR(o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 1 WHEN 2 THEN 1000 ELSE 1000000 END) AS BIGINT) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN printf('%.1f', n / 1024.0) || 'KB' WHEN n < 1073741824 THEN printf('%.1f', n / 1048576.0) || 'MB' ELSE printf('%.1f', n / 1073741824.0) || 'GB' END AS size,
  CASE WHEN n = 0 THEN '-' WHEN n < 1000 THEN n || 'ms' ELSE printf('%.2f', n / 1000.0) || 's' END AS duration FROM s""")
def s19(spark, sf):
    factor = F.element_at(F.array(F.lit(0.001), F.lit(1.0), F.lit(1000.0), F.lit(1000000.0)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    n = F.floor(F.col("o_totalprice") * factor)
    return V.table(spark, sf, "orders").select("o_orderkey", P.human_size(n).alias("size"), P.human_duration(n).alias("duration"))


@query("s9_sanitized_tags", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace('#' || p_name || ' & ' || p_brand || '!', '[^A-Za-z0-9_-]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS tag FROM part")
def s9(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", P.sanitize_tag(F.concat(F.lit("#"), "p_name", F.lit(" & "), "p_brand", F.lit("!"))).alias("tag"))


@query("s22_masked_secrets", "SELECT c_custkey, REPEAT('*', LENGTH(c_name)) AS masked, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END AS value FROM customer")
def s22(spark, sf):
    variables = F.array(F.struct(F.lit("v").alias("name"), F.col("c_mktsegment").alias("value"), F.lit(True).alias("enabled"), (F.col("c_custkey") % 2 == 0).alias("secret")))
    return V.table(spark, sf, "customer").select("c_custkey", P.mask(F.col("c_name")).alias("masked"), P.blank_secrets(variables)[0]["value"].alias("value"))


@query("s23_spec_fingerprint", "SELECT p_partkey, MD5(p_name) AS fingerprint, p_partkey % 3 <> 0 AS has_updates FROM part")
def s23(spark, sf):
    stored = F.when(F.col("p_partkey") % 3 == 0, F.md5("p_name")).when(F.col("p_partkey") % 3 == 1, F.lit("old"))
    return V.table(spark, sf, "part").select("p_partkey", P.fingerprint(F.col("p_name")).alias("fingerprint"), P.has_updates(stored, F.col("p_name")).alias("has_updates"))


@query("s25_status_numbers", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 END::INT AS status FROM events")
def s25(spark, sf):
    texts = F.element_at(F.array(F.lit("200"), F.lit(" 404 "), F.lit(""), F.lit("OK")), (F.col("event_id") % 4 + 1).cast("int"))
    return V.table(spark, sf, "events").select("event_id", P.status_number(texts).alias("status"))


@query("s26_credential_variables", "SELECT event_id, '$oauth2.cred' || (event_id % 3) || '.' || 'token' AS name, props AS value FROM events")
def s26(spark, sf):
    e = V.table(spark, sf, "events")
    variables = P.credential_variables(F.create_map(F.lit("token"), F.col("props")), F.concat(F.lit("cred"), (F.col("event_id") % 3).cast("string")))
    return e.select("event_id", F.explode(variables).alias("name", "value"))


@query("s27_normalized_variables", "SELECT p_partkey, 'a b {{x}}/{{' || replace(p_name, ' ', '') || '}} _.c' AS text FROM part")
def s27(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", P.normalize_variables(F.concat(F.lit("a b {{ _.x }}/{{"), "p_name", F.lit(" }} _.c"))).alias("text"))


def bulk(spark, sf):
    lines = F.concat(F.lit("a: "), "p_name", F.lit("\n// b :"), "p_brand", F.lit("\r\nno colon\n\nc:x:y"))
    return V.table(spark, sf, "part").select("p_partkey", lines.alias("text"))


@query("a6_bulk_pairs", """SELECT p_partkey, 0 AS pos, 'a' AS name, p_name AS value, TRUE AS enabled FROM part UNION ALL SELECT p_partkey, 1, 'b', p_brand, FALSE FROM part UNION ALL SELECT p_partkey, 4, 'c', 'x:y', TRUE FROM part""")
def a6(spark, sf):
    from ..sources.catalogs import bulk_pairs

    return bulk_pairs(bulk(spark, sf), "p_partkey")


@query("a10_server_environments", """SELECT c_custkey, 'https://{{region}}.example.com/{{v}}' AS base_url, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Environment 1' END AS env_name, 'region=' || CASE WHEN c_custkey % 3 = 0 THEN 'eu' ELSE c_name END || ',v=' AS variables FROM customer""")
def a10(spark, sf):
    from ..sources.catalogs import server_environments

    variable = F.struct(F.when(F.col("c_custkey") % 3 == 0, "eu").alias("default"), F.array(F.col("c_name"), F.lit("us")).alias("enum"))
    empty = F.struct(F.lit(None).cast("string").alias("default"), F.lit(None).cast("array<string>").alias("enum"))
    server = F.struct(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"), F.lit(None).cast("string").alias("description"), F.lit("https://{region}.example.com/{v}/").alias("url"), F.create_map(F.lit("region"), variable, F.lit("v"), empty).alias("variables"))
    out = server_environments(V.table(spark, sf, "customer").select("c_custkey", F.array(server).alias("servers")), "c_custkey")
    return out.select("c_custkey", "base_url", "env_name", F.array_join(F.transform(F.map_entries("variables"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("variables"))


@query("a5_environment_variables", "SELECT c_custkey, 'v' AS name, c_mktsegment AS value, 'text' AS type, c_custkey % 2 = 0 AS enabled, FALSE AS secret FROM customer WHERE c_custkey % 5 <> 0")
def a5(spark, sf):
    from ..sources.catalogs import environment_variables

    text = F.when(F.col("c_custkey") % 5 == 0, '{"name":"broken"}').otherwise(F.concat(F.lit('{"variables":[{"name":"v","value":"'), "c_mktsegment", F.lit('","enabled":'), F.when(F.col("c_custkey") % 2 == 0, "true").otherwise("false"), F.lit("}]}")))
    return environment_variables(V.table(spark, sf, "customer").select("c_custkey", text.alias("json")), "c_custkey")[0]
