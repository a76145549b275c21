"""Search history: a small table with least-recently-used eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import fnv_hex
from ..functions.paths import ascii_lower
from ..plans.query import SearchQuery
from ..schema import HISTORY, struct

# The rows that stay, and the codes of filters.
KEPT = 50
TIME_CODES = ("None", "Today", "ThisWeek", "ThisMonth", "ThisYear", "Older")
SIZE_CODES = ("None", "Empty", "Tiny", "Small", "Medium", "Large", "Huge", "Massive")


def normal_extensions(text: Column) -> Column:
    """``;`` or ``,`` separated: trimmed, lower case, sorted, joined by commas."""
    parts = F.transform(F.split(text, "[,;]"), lambda x: ascii_lower(F.btrim(x, F.lit(" \t\r\n"))))
    return F.array_join(F.array_sort(F.filter(parts, lambda x: x != "")), ",")


def normalize(params: Column) -> Column:
    trim = lambda name: F.btrim(params[name], F.lit(" \t\r\n"))
    return F.struct(
        trim("filename").alias("filename"), trim("path").alias("path"), normal_extensions(params["extensions"]).alias("extensions"), params["folders_only"].alias("folders_only"),
        params["case_sensitive"].alias("case_sensitive"), params["time_filter"].alias("time_filter"), params["size_filter"].alias("size_filter"), trim("ai_search_description").alias("ai_search_description"),
    )


def canonical(params: Column) -> Column:
    """One string per query; equal queries have equal ones. Its form, which ids are hashes of."""
    flag = lambda name: F.when(params[name], "1").otherwise("0")
    return F.concat(
        F.lit("filename="), params["filename"], F.lit("|path="), params["path"], F.lit("|extensions="), params["extensions"], F.lit("|folders_only="), flag("folders_only"),
        F.lit("|case_sensitive="), flag("case_sensitive"), F.lit("|time_filter="), params["time_filter"].cast("string"), F.lit("|size_filter="), params["size_filter"].cast("string"),
        F.lit("|ai="), params["ai_search_description"],
    )


def trim(history: DataFrame, keep: int = KEPT) -> DataFrame:
    """All pinned rows and the ``keep`` last used others."""
    recent = history.where("not is_pinned").orderBy(F.desc("last_used_at"), F.desc("id")).limit(keep)
    return history.where("is_pinned").unionByName(recent)


def record(history: DataFrame, params: DataFrame, now_ms: int, keep: int = KEPT) -> DataFrame:
    """Remember queries (column params): known ones are bumped, new ones added; ids that collide get -1, -2, ..."""
    new = params.select(normalize(F.col("params")).alias("params")).withColumn("_c", canonical(F.col("params"))).dropDuplicates(["_c"])
    old = history.withColumn("_c", canonical(normalize(F.col("params"))))
    bumped = old.join(new.select("_c", F.lit(True).alias("_hit")), "_c", "left").withColumn("last_used_at", F.when(F.col("_hit"), F.lit(now_ms)).otherwise(F.col("last_used_at"))).drop("_hit")
    fresh = new.join(old.select("_c"), "_c", "left_anti").withColumn("_base", fnv_hex(F.col("_c")))
    taken = old.groupBy(F.substring_index("id", "-", 1).alias("_base")).agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy("_base").orderBy("_c")) - 1 + F.coalesce("_n", F.lit(0))
    fresh = fresh.join(taken, "_base", "left").withColumn("_k", place)
    rows = fresh.select(
        F.when(F.col("_k") == 0, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), F.col("_k").cast("string"))).alias("id"), "params", F.lit("").alias("custom_name"), F.lit(False).alias("is_pinned"),
        F.lit(now_ms).cast("long").alias("created_at"), F.lit(now_ms).cast("long").alias("last_used_at"), F.lit(0).cast("long").alias("pinned_at"),
    )
    return trim(bumped.drop("_c").select(rows.columns).unionByName(rows), keep)


def _set(history: DataFrame, id_: str, **values: Column) -> DataFrame:
    hit = F.col("id") == id_
    return history.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def pin(history: DataFrame, id_: str, now_ms: int) -> DataFrame:
    return _set(history, id_, is_pinned=F.lit(True), pinned_at=F.lit(now_ms).cast("long"))


def unpin(history: DataFrame, id_: str, now_ms: int, keep: int = KEPT) -> DataFrame:
    return trim(_set(history, id_, is_pinned=F.lit(False), pinned_at=F.lit(0).cast("long"), last_used_at=F.lit(now_ms).cast("long")), keep)


def label(history: DataFrame, id_: str, name: str) -> DataFrame:
    return _set(history, id_, custom_name=F.lit(name))


def delete(history: DataFrame, id_: str) -> DataFrame:
    return history.where(F.col("id") != id_)


def sorted_view(history: DataFrame) -> DataFrame:
    """Pinned rows first, last pinned first; the others by last use."""
    return history.orderBy(F.desc("is_pinned"), F.when(F.col("is_pinned"), F.col("pinned_at")).desc(), F.desc("last_used_at"), "id")


def merge(local: DataFrame, disk: DataFrame, keep: int = KEPT) -> DataFrame:
    """Both tables; of rows in both, the one used last (the local one of equals)."""
    both = local.withColumn("_o", F.lit(1)).unionByName(disk.withColumn("_o", F.lit(0)))
    names = [c for c in local.columns if c != "id"]
    best = both.groupBy("id").agg(F.max_by(F.struct(*names), F.struct("last_used_at", "_o")).alias("r"))
    return trim(best.select("id", "r.*").select(local.columns), keep)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """JSON history; mistyped or missing fields get their defaults, rows without an id go."""
    d = spark.read.schema(struct(HISTORY)).option("multiLine", True).json(path).where("id is not null")
    return d.na.fill({"custom_name": "", "is_pinned": False, "created_at": 0, "last_used_at": 0, "pinned_at": 0})


def write_history(history: DataFrame, path: str) -> None:
    history.coalesce(1).write.mode("overwrite").json(path)


def params_of(query: SearchQuery) -> dict:
    return {
        "filename": query.filename, "path": query.path, "extensions": ",".join(query.extensions), "folders_only": query.folders_only, "case_sensitive": query.case_sensitive,
        "time_filter": TIME_CODES.index(query.time_filter), "size_filter": SIZE_CODES.index(query.size_filter), "ai_search_description": "",
    }


def query_of(params) -> SearchQuery:
    return SearchQuery.typed(params["filename"], params["path"], params["extensions"], folders_only=params["folders_only"], case_sensitive=params["case_sensitive"], time_filter=TIME_CODES[params["time_filter"]], size_filter=SIZE_CODES[params["size_filter"]])
