"""Readers of catalog exports, environments and specs. Bad input is set aside, never fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import written

SKIPPED_FOLDERS = ["environments", ".git", "node_modules"]
ENVIRONMENT = "name string, variables array<struct<name:string,value:string,type:string,enabled:boolean,secret:boolean>>"
METHODS = ["get", "put", "post", "delete", "options", "head", "patch", "trace"]


def item_schema() -> T.StructType:
    """Schema of an item; the items in it stay JSON text, as a struct can't recurse."""
    fields = [T.StructField(n, T.StringType()) for n in ("uid", "type", "name")] + [T.StructField("seq", T.DoubleType()), T.StructField("tags", T.ArrayType(T.StringType()))]
    return T.StructType([*fields, T.StructField("items", T.ArrayType(T.StringType()))])


def read_json_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(_path, i, _corrupt) of the files: ``i`` by ``schema``, and the text of those that are unreadable. Files in skipped folders are not read."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_path"), "value")
    files = files.where(~F.col("_path").rlike("/(" + "|".join(f.replace(".", r"\.") for f in SKIPPED_FOLDERS) + ")/"))
    return files.select("_path", _parsed("value", schema))


def _parsed(column: str, schema: T.StructType) -> Column:
    with_error = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return F.from_json(column, with_error, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("i")


def load_catalog(spark: SparkSession, path: str, depth: int = 6) -> tuple[DataFrame, DataFrame]:
    """(items, unreadable files) of collection exports: items flattened level by level to an adjacency list.

    Each level is parsed once, from the texts that the one above left, and written; the first without items ends it, however deep. ``depth`` is no
    limit and is kept for callers that name it. A file with an unreadable item at any level is set aside whole.
    """
    schema = item_schema()
    level = read_json_files(spark, path, schema).select("_path", F.lit(None).cast("string").alias("parent_uid"), F.lit(0).alias("pos"), "i")
    out, bad = None, None
    while True:
        level = written(level, "items")
        if level.isEmpty() and out is not None:
            break
        broken = level.where("i._corrupt is not null").select(F.col("_path").alias("path"), F.lit("unreadable JSON").alias("error"))
        level = level.where("i._corrupt is null")
        flat = level.select("_path", F.col("i.uid").alias("uid"), "parent_uid", F.coalesce("i.type", F.lit("collection")).alias("type"), F.col("i.name").alias("name"), F.col("i.seq").alias("seq"), "pos", F.coalesce("i.tags", F.array().cast("array<string>")).alias("tags"))
        out, bad = (flat, broken) if out is None else (out.unionByName(flat), bad.unionByName(broken))
        level = level.select("_path", F.col("i.uid").alias("parent_uid"), F.posexplode("i.items").alias("pos", "json")).select("_path", "parent_uid", "pos", _parsed("json", schema))
    bad = bad.distinct()
    return out.join(bad.select(F.col("path").alias("_path")), "_path", "left_anti").drop("_path"), bad


def load_resources(exports: DataFrame) -> DataFrame:
    """Adjacency list of a flat export (JSON text with a ``resources`` list): requests and folders only; the pointer to a
    workspace is the root."""
    parsed = F.from_json("json", "resources array<struct<_type:string,_id:string,parentId:string,name:string>>")
    r = exports.select(F.explode(parsed["resources"]).alias("r")).select("r.*")
    kinds = F.when(F.col("_type") == "request", "http-request").when(F.col("_type") == "request_group", "folder")
    return r.where(F.col("_type").isin("request", "request_group")).select(F.col("_id").alias("uid"), F.when(F.col("parentId").startswith("wrk_"), F.lit(None)).otherwise(F.col("parentId")).alias("parent_uid"), kinds.alias("type"), "name")


def environment_variables(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(variables with defaults filled in, keys of files without a list of variables)."""
    parsed = rows.select(key, F.from_json("json", ENVIRONMENT).alias("e"))
    good = parsed.where("e.variables is not null").select(key, F.explode("e.variables").alias("v"))
    filled = good.select(key, "v.name", "v.value", F.coalesce("v.type", F.lit("text")).alias("type"), F.coalesce("v.enabled", F.lit(True)).alias("enabled"), F.coalesce("v.secret", F.lit(False)).alias("secret"))
    return filled, parsed.where("e.variables is null").select(key)


def bulk_pairs(rows: DataFrame, key: str) -> DataFrame:
    """``name:value`` lines: ``//`` disables, lines without a colon are dropped, the first colon splits."""
    line = rows.select(key, F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    off = F.col("line").startswith("//")
    body = F.when(off, F.trim(F.substring("line", 3, 1 << 30))).otherwise(F.col("line"))
    return line.where(F.contains("line", F.lit(":"))).select(key, "pos", F.trim(F.substring_index(body, ":", 1)).alias("name"), F.trim(F.regexp_replace(body, "^[^:]*:", "")).alias("value"), (~off).alias("enabled"))


def bulk_text(pairs: DataFrame, key: str) -> DataFrame:
    """Inverse of bulk_pairs."""
    line = F.concat(F.when(F.col("enabled"), "").otherwise("//"), "name", F.lit(":"), "value")
    return pairs.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def server_environments(rows: DataFrame, key: str) -> DataFrame:
    """One environment for each server of a spec: URL template and a default for each variable."""
    s = rows.select(key, F.posexplode("servers").alias("pos", "s"))
    default = lambda v: F.coalesce(v["default"], F.get(v["enum"], F.lit(0)), F.lit(""))
    return s.select(
        key,
        F.coalesce("s.name", "s.description", F.concat(F.lit("Environment "), (F.col("pos") + 1).cast("string"))).alias("env_name"),
        F.regexp_replace(F.regexp_replace("s.url", r"\{(\w+)\}", "{{$1}}"), "/$", "").alias("base_url"),
        F.transform_values("s.variables", lambda k, v: default(v)).alias("variables"),
    )


def spec_endpoints(specs: DataFrame) -> DataFrame:
    """Endpoints of API specs (spec_id, JSON text): paths times methods, ids ``METHOD:path``, parameters by place, hash."""
    paths = F.from_json(F.get_json_object("json", "$.paths"), "map<string,map<string,string>>")
    ops = specs.select("spec_id", F.explode(paths).alias("path", "ops")).select("spec_id", "path", F.col("ops")["parameters"].alias("shared"), F.explode("ops").alias("method", "op")).where(F.col("method").isin(METHODS))
    params = lambda c: F.coalesce(F.from_json(c, "array<struct<name:string,`in`:string>>"), F.array().cast("array<struct<name:string,in:string>>"))
    own, shared = params(F.get_json_object("op", "$.parameters")), params(F.col("shared"))
    # the operation's parameter replaces the path's of the same name and place
    merged = F.concat(F.filter(shared, lambda p: ~F.exists(own, lambda q: (q["name"] == p["name"]) & (q["in"] == p["in"]))), own)
    norm = F.regexp_replace(F.regexp_replace("path", r"\{([^}]+)\}", ":$1"), "/$", "")
    of = lambda place: F.transform(F.filter("params", lambda p: p["in"] == place), lambda p: p["name"])
    out = ops.withColumn("params", merged).select("spec_id", F.concat(F.upper("method"), F.lit(":"), norm).alias("endpoint_id"), F.upper("method").alias("method"), norm.alias("path"), of("query").alias("query_params"), of("path").alias("path_params"), of("header").alias("header_params"), F.from_json(F.get_json_object("op", "$.tags"), "array<string>").alias("tags"), F.get(F.json_object_keys(F.get_json_object("op", "$.requestBody.content")), F.lit(0)).alias("content_type"), F.md5("op").alias("hash"))
    return out


def file_statistics(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Number, bytes and largest size (MB) of the catalog files in each folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).drop("content").where(~F.col("path").rlike(r"/(node_modules|\.git)/"))
    return files.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("collection")).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"), F.round(F.max("length") / 1048576, 6).alias("largest_mb"))
