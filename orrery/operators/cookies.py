"""Cookies as a table keyed by domain, path and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["domain", "path", "key"]


def latest(writes: DataFrame) -> DataFrame:
    """The last write of each cookie; writes without a domain are void. Map-side combining, no sort."""
    rest = [c for c in writes.columns if c not in KEY]
    last = writes.where("domain is not null").groupBy(*KEY).agg(F.max_by(F.struct(*rest), "seq").alias("c"))
    return last.select(*KEY, "c.*")


def modified(writes: DataFrame) -> DataFrame:
    """Last write of each cookie with the creation time of its first: a change keeps domain, path, key and creation."""
    rest = [c for c in writes.columns if c not in [*KEY, "creation"]]
    last = writes.where("domain is not null").groupBy(*KEY).agg(F.max_by(F.struct(*rest), "seq").alias("c"), F.min("creation").alias("creation"))
    return last.select(*KEY, "creation", "c.*")


def unexpired(now: str) -> Column:
    return F.col("expires").isNull() | (F.col("expires") > F.lit(now).cast("timestamp"))


def by_domain(cookies: DataFrame, now: str) -> DataFrame:
    """Unexpired cookies of each domain as one string."""
    live = cookies.where(unexpired(now))
    listed = F.sort_array(F.collect_list(F.struct("path", "key", "value")))
    return live.groupBy("domain").agg(F.count("*").alias("n"), F.array_join(F.transform(listed, lambda c: F.concat(c["key"], F.lit("="), c["value"])), "; ").alias("cookies"))


def trustworthy(url: Column) -> Column:
    """https, or a local host."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return url.startswith("https://") | (host == "localhost") | host.endswith(".localhost") | host.startswith("127.") | (host == "[::1]")


def for_urls(urls: DataFrame, cookies: DataFrame, now: str) -> DataFrame:
    """(url_id, cookie) of every cookie sent to a URL.

    The domain test is an equi-join: a host is exploded into its parent domains. Popular parent domains are left to
    Spark's skew join.
    """
    host = F.try_parse_url("url", F.lit("HOST"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.coalesce(F.nullif(F.try_parse_url("url", F.lit("PATH")), F.lit("")), F.lit("/"))
    asked = urls.select("url_id", host.alias("host"), path.alias("url_path"), F.coalesce(trustworthy(F.col("url")), F.lit(False)).alias("safe")).select("*", F.explode(parents).alias("domain"))
    same_host = (F.col("domain") == F.col("host")) | ~F.col("host_only")
    on_path = (F.col("path") == "/") | (F.col("url_path") == F.col("path")) | F.startswith("url_path", F.concat("path", F.lit("/")))
    return asked.join(cookies.where(unexpired(now)), "domain").where(same_host & on_path & (~F.col("secure") | F.col("safe"))).drop("host", "safe", "url_path")


def cookie_strings(matched: DataFrame) -> DataFrame:
    """Cookies of each URL as ``k=v; ...``, longest path first."""
    order = F.sort_array(F.collect_list(F.struct((-F.length("path")).alias("n"), "domain", "key", "value")))
    return matched.groupBy("url_id").agg(F.array_join(F.transform(order, lambda c: F.concat(c["key"], F.lit("="), c["value"])), "; ").alias("cookie_string"))


def without(cookies: DataFrame, gone: DataFrame) -> DataFrame:
    return cookies.join(gone.select(*KEY).distinct(), KEY, "left_anti")


def without_domain(cookies: DataFrame, domain: str) -> DataFrame:
    return cookies.where(F.col("domain") != domain)


def without_named(cookies: DataFrame, urls: DataFrame, now: str) -> DataFrame:
    """Cookies less those deleted by URL and name: of the matches the one with the URL's own path, else the most specific."""
    matched = for_urls(urls, cookies, now).join(urls.select("url_id", F.col("key").alias("wanted"), F.coalesce(F.nullif(F.try_parse_url("url", F.lit("PATH")), F.lit("")), F.lit("/")).alias("own")), "url_id").where("key = wanted")
    best = matched.groupBy("url_id").agg(F.max_by(F.struct(*KEY), F.struct(F.col("path") == F.col("own"), F.length("path"), F.length("domain"))).alias("c"))
    return without(cookies, best.select("c.*"))


def latest_credentials(rows: DataFrame) -> DataFrame:
    """The newest credentials of each URL, collection and credential id."""
    return rows.groupBy("url", "collection_uid", "credentials_id").agg(F.max_by("credentials", "seq").alias("credentials"))
