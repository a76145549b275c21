"""Catalog maintenance. Every operation is a function from catalog to catalog.

``full_path`` is derived from (id, parent_id, name): operations that move
directories change a few rows and recompute paths, so a rename of a directory
is a join, not a rewrite by string prefix of unknown extent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ROOT_RECORD, ancestors, filename, is_cloud, is_volume_root, is_volume_root_child, join_path, path_key, record_no, trim_separators
from ..plans.lineage import cut
from ..schema import as_catalog
from .filters import live


def _is_root(parent: str = "parent_id", own: str = "id") -> Column:
    return (F.col(parent) == 0) | (F.col(parent) == F.col(own))


# ---- hierarchy


def _meant(references: DataFrame, ids: DataFrame) -> DataFrame:
    """(_ref, _key): of distinct references (column ``_ref``) the id in ``ids`` (column ``id``) that each means: exactly
    that id, else the (largest) one with the same record number, whatever its sequence bits. References without a
    row aren't there."""
    exact = references.join(ids.select(F.col("id").alias("_key")), F.col("_ref") == F.col("_key"), "left")
    by_record = ids.groupBy(record_no("id").alias("_record")).agg(F.max("id").alias("_key"))
    stale = exact.where("_key is null").select("_ref", record_no("_ref").alias("_record")).join(by_record, "_record").select("_ref", "_key")
    return exact.where("_key is not null").union(stale)


def resolved_parents(catalog: DataFrame) -> DataFrame:
    """The catalog with ``parent_key``: the id of the row that a parent reference means - the row of exactly that id,
    else that of the same record number, whatever its sequence bits - and null where there is none."""
    found = _meant(catalog.select(F.col("parent_id").alias("_ref")).distinct(), catalog.select("id"))
    return catalog.join(found.withColumnsRenamed({"_ref": "parent_id", "_key": "parent_key"}), "parent_id", "left")


def recompute_paths(catalog: DataFrame, volume_root: str = "", unknown: str = "prune") -> DataFrame:
    """All paths from parents and names. Rows without an unbroken line to a root go (``unknown``: prune), get a null
    path (null), or the path from their topmost known directory on, a bare name if there is none (name). Parents
    are found as ``resolved_parents`` does, among directories.

    Directories double their reach in every round - a row that knows the names up to its 2^k-th ancestor joins that
    ancestor's - so 64 levels take 6 rounds of one equi-join over directories only, and files join their directory
    once. Depth has no limit: rounds end when all directories have reached a root or a gap. As long as any of the
    others isn't in or below a cycle, each round settles some, so a round that settles none ends them, too; a cycle
    never reaches a root, and gives its rows a null path where they aren't pruned. A parent with very many
    children is a hot join key on one side only, which adaptive execution splits."""
    base = catalog.withColumn("_up", F.when(_is_root() | (record_no("parent_id") == ROOT_RECORD), F.lit(0).cast("long")).otherwise(F.col("parent_id")))
    references = base.where("_up != 0").select(F.col("_up").alias("_ref")).distinct()
    meant = cut(_meant(references, base.where("is_dir").select("id")))
    state = base.where("is_dir").select("id", F.col("_up").alias("_ref"), F.col("name").alias("path")).join(meant, "_ref", "left")
    state = cut(state.select("id", F.when(F.col("_ref") == 0, F.lit(0).cast("long")).otherwise(F.col("_key")).alias("up"), "path"))
    left, before = state.where("up != 0").count(), None
    while left and left != before:
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_next"), F.col("path").alias("_above"))
        joined = state.join(above, "up", "left")
        # every reference has its row, so a null _above means that a root or a gap was reached before
        state = cut(joined.select("id", F.when(F.col("_above").isNull(), F.col("up")).otherwise(F.col("_next")).alias("up"), F.when(F.col("_above").isNull(), F.col("path")).otherwise(join_path("_above", "path")).alias("path")))
        left, before = state.where("up != 0").count(), left
    root = F.lit(volume_root)
    rooted = F.when((root != "") & (F.col("up") == 0), join_path(root, F.col("path"))).otherwise(F.col("path"))
    dirs = cut(state.where("up = 0 or up is null" if unknown == "name" else "up = 0").select(F.col("id").alias("_key"), rooted.alias("_path")))
    paths = dirs.withColumnRenamed("_key", "_dir").union(meant.join(dirs, "_key").select("_ref", "_path").join(dirs.select(F.col("_key").alias("_ref")), "_ref", "left_anti"))
    out = base.drop("full_path").withColumn("_dir", F.when(F.col("is_dir"), F.col("id")).otherwise(F.col("_up"))).join(paths, "_dir", "left")
    alone = F.when(root != "", join_path(root, F.col("name"))).otherwise(F.col("name"))
    path = F.when(F.col("is_dir"), F.col("_path")).when(F.col("_up") == 0, alone).otherwise(join_path("_path", F.col("name")))
    if unknown == "name":
        # files whose directory isn't there at all, not those below a cycle
        there = meant.select(F.col("_ref").alias("_up"), F.lit(True).alias("_there"))
        out = out.join(there, "_up", "left")
        path = F.coalesce(path, F.when(~F.col("is_dir") & F.col("_there").isNull(), F.col("name")))
    out = out.withColumn("full_path", path).drop("_dir", "_path", "_up", "_there")
    return as_catalog(out.where("full_path is not null") if unknown == "prune" else out)


def orphans(catalog: DataFrame) -> DataFrame:
    """Rows that ``recompute_paths`` would prune."""
    return recompute_paths(catalog, unknown="null").where("full_path is null")


def subtree_ids(catalog: DataFrame, roots: DataFrame) -> DataFrame:
    """Ids of the roots (column ``id``) and, for directories, of all below them: frontier by frontier, each round one
    join of the frontier with its children, to any depth. Children of a volume root are never reached."""
    links = resolved_parents(catalog.select("id", "parent_id", "is_dir", "full_path")).where("parent_key is not null and id != parent_key")
    links = cut(links.where(~F.coalesce(is_volume_root_child("full_path"), F.lit(False))).select("id", "parent_key", "is_dir"))
    found = cut(roots.select("id").distinct())
    frontier = cut(catalog.where("is_dir").select("id").join(found, "id", "left_semi"))
    while True:
        below = links.join(frontier.withColumnRenamed("id", "parent_key"), "parent_key", "left_semi")
        below = cut(below.join(found, "id", "left_anti").select("id", "is_dir"))
        if below.isEmpty():
            return found
        found = cut(found.union(below.select("id")))
        frontier = below.where("is_dir").select("id")


# ---- changes


def upsert(catalog: DataFrame, rows: DataFrame, volume_root: str = "") -> DataFrame:
    """Insert rows (id, parent_id, name, is_dir) or update those that exist, which keep size and time unless these
    had failed; paths are recomputed. Rows whose parent isn't known have their bare name as path until it is."""
    r = rows.select("id", F.col("parent_id").alias("_parent"), F.col("name").alias("_name"), F.col("is_dir").alias("_is_dir"), F.lit(True).alias("_new"))
    joined = as_catalog(catalog).join(r, "id", "full")
    fresh = F.coalesce("_new", F.lit(False))
    state = lambda c: F.when(F.col(c).isNull() | (fresh & (F.col(c) == "failed")), "not_loaded").otherwise(F.col(c))
    # a new directory has size 0, known from the start
    size = F.when(F.col("size_state").isNull() & F.col("_is_dir"), F.lit(0)).otherwise(F.col("size_bytes"))
    out = joined.withColumns({
        "size_bytes": size.cast("long"), "size_state": F.when(F.col("size_state").isNull() & F.col("_is_dir"), "loaded").otherwise(state("size_state")), "mtime_state": state("mtime_state"),
        "parent_id": F.coalesce("_parent", "parent_id"), "name": F.coalesce("_name", "name"), "is_dir": F.coalesce("_is_dir", "is_dir"), "deleted": F.when(fresh, False).otherwise(F.col("deleted")),
    })
    return recompute_paths(out.drop("_parent", "_name", "_is_dir", "_new"), volume_root, "name")


def synthesize_directories(paths: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(full_path) of every ancestor of ``paths`` that is missing in ``known``."""
    above = paths.select(F.explode(ancestors("full_path")).alias("full_path")).withColumn("_key", path_key("full_path")).where("_key != ''")
    above = above.groupBy("_key").agg(F.min("full_path").alias("full_path"))
    if known is not None:
        above = above.join(known.select(path_key("full_path").alias("_key")), "_key", "left_anti")
    return above.select("full_path")


def insert_paths(catalog: DataFrame, paths: DataFrame) -> DataFrame:
    """Upsert by path: rows (full_path, is_dir; is_dir null is told by a trailing separator). Equal paths, whatever
    their separators, are one row; missing ancestors become directories. New ids hash the path's key, so they
    need no counter, and inserting twice gives the same rows. Only live rows count as there: a path that has a
    tombstone is inserted anew, and the tombstone goes."""
    catalog = as_catalog(catalog)
    given = paths.select(trim_separators("full_path").alias("full_path"), F.coalesce("is_dir", F.col("full_path").rlike(r"[/\\]\z")).alias("is_dir")).where((F.col("full_path") != "") & (F.instr("full_path", "\0") == 0))
    every = given.union(synthesize_directories(given).withColumn("is_dir", F.lit(True)))
    every = every.withColumn("_key", path_key("full_path")).groupBy("_key").agg(F.min("full_path").alias("full_path"), F.max("is_dir").alias("is_dir"))
    keyed = catalog.withColumn("_key", path_key("full_path"))
    old, dead = keyed.where(live()), keyed.where(~live()).join(every.select("_key"), "_key", "left_anti").drop("_key")
    told = given.select(path_key("full_path").alias("_key"), F.col("is_dir").alias("_is_dir")).groupBy("_key").agg(F.max("_is_dir").alias("_is_dir"))
    updated = old.join(told, "_key", "left").withColumn("is_dir", F.coalesce("_is_dir", "is_dir"))
    new = every.join(old.select("_key"), "_key", "left_anti").withColumns({"id": path_id(F.col("_key")), "deleted": F.lit(False)})
    up = F.regexp_replace("_key", r"/[^/]*\z", "")
    ids = every.select("_key").union(old.select("_key")).distinct().withColumn("_pid", path_id(F.col("_key")))
    ids = ids.join(old.select("_key", F.col("id").alias("_old")), "_key", "left").select(F.col("_key").alias("_up"), F.coalesce("_old", "_pid").alias("_pid"))
    new = new.withColumn("_up", F.when(F.instr("_key", "/") > 0, up)).join(ids, "_up", "left").withColumn("parent_id", F.coalesce("_pid", F.lit(0))).drop("_up", "_pid", "_key")
    size = F.when(F.col("is_dir"), F.lit(0).cast("long"))
    return updated.drop("_key", "_is_dir").unionByName(dead).unionByName(as_catalog(new.withColumns({"name": filename("full_path"), "size_bytes": size})), allowMissingColumns=True)


def rejected_paths(paths: DataFrame) -> DataFrame:
    """The rows that ``insert_paths`` leaves out, with the reason: no path, nothing but separators, or a NUL inside.
    Their number is the number of failures; the other rows are inserted all the same."""
    reason = F.when(F.col("full_path").isNull(), "null").when(trim_separators("full_path") == "", "empty").when(F.instr("full_path", "\0") > 0, "nul")
    return paths.withColumn("reason", reason).where("reason is not null")


def path_id(key: Column) -> Column:
    """A positive id from a path's key."""
    return F.xxhash64(key).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def remove(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Without these ids; unknown ones don't matter."""
    return catalog.join(ids.select("id"), "id", "left_anti")


def mark_removed(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """These ids as tombstones, for ``compact`` to drop."""
    gone = ids.select("id", F.lit(True).alias("_gone")).distinct()
    return catalog.join(gone, "id", "left").withColumn("deleted", F.coalesce("_gone", "deleted")).drop("_gone")


def rename(catalog: DataFrame, names: DataFrame, volume_root: str = "") -> DataFrame:
    """New names (id, name); descendants of renamed directories follow. Volume roots keep theirs."""
    n = names.select("id", F.col("name").alias("_name"))
    keep = is_volume_root("full_path") | F.col("_name").isNull()
    return recompute_paths(catalog.join(n, "id", "left").withColumn("name", F.when(keep, F.col("name")).otherwise(F.col("_name"))).drop("_name"), volume_root, "name")


def move(catalog: DataFrame, parents: DataFrame, volume_root: str = "") -> DataFrame:
    """New parents (id, parent_id); descendants follow."""
    p = parents.select("id", F.col("parent_id").alias("_parent"))
    return recompute_paths(catalog.join(p, "id", "left").withColumn("parent_id", F.coalesce("_parent", "parent_id")).drop("_parent"), volume_root, "name")


def rewrite_prefix(catalog: DataFrame, old: str, new: str) -> DataFrame:
    """Live paths that start with ``old`` start with ``new``; a bare volume root is refused."""
    if old in ("/", "\\") or (len(old) == 3 and old[1] == ":" and old[2] in "/\\"):
        raise ValueError("a volume root as prefix would rewrite every path")
    path = F.when(live() & F.col("full_path").startswith(old), F.concat(F.lit(new), F.substr("full_path", F.lit(len(old) + 1)))).otherwise(F.col("full_path"))
    return catalog.withColumn("full_path", path).withColumn("name", filename("full_path"))


def remove_subtrees(catalog: DataFrame, roots: DataFrame) -> DataFrame:
    """Without these ids and, of directories, all below."""
    return remove(catalog, subtree_ids(catalog, roots))


def compact(catalog: DataFrame, force: bool = False) -> DataFrame:
    """Without tombstones, once there are over 1000 or a tenth of the rows."""
    from .metrics import storage_stats

    if force or storage_stats(catalog).first()["compaction_due"]:
        return catalog.where(live())
    return catalog


def set_attributes(catalog: DataFrame, values: DataFrame) -> DataFrame:
    """Sizes and times (id, size_bytes, mtime; null leaves as is) of files."""
    v = values.select("id", F.col("size_bytes").alias("_size"), F.col("mtime").alias("_mtime"))
    out = catalog.join(v, "id", "left")
    for c, new, state in (("size_bytes", "_size", "size_state"), ("mtime", "_mtime", "mtime_state")):
        set_ = F.col(new).isNotNull() & ~F.col("is_dir")
        out = out.withColumns({c: F.when(set_, F.col(new)).otherwise(F.col(c)), state: F.when(set_, "loaded").otherwise(F.col(state))})
    return out.drop("_size", "_mtime")


def invalidate_sizes(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Sizes of these files are to be loaded anew."""
    gone = ids.select("id", F.lit(True).alias("_gone")).distinct()
    hit = F.col("_gone").isNotNull() & ~F.col("is_dir")
    out = catalog.join(gone, "id", "left")
    return out.withColumns({"size_bytes": F.when(~hit, F.col("size_bytes")), "size_state": F.when(hit, "not_loaded").otherwise(F.col("size_state"))}).drop("_gone")


def finalize_crawl(catalog: DataFrame) -> DataFrame:
    """After a crawl: sizes and times of files in cloud folders count as not loaded, since asking for them fetches the
    file; they come by ``set_attributes`` when they are wanted."""
    cloud = ~F.col("is_dir") & F.coalesce(is_cloud("full_path"), F.lit(False))
    out = catalog.withColumns({c: F.when(~cloud, F.col(c)) for c in ("size_bytes", "mtime")})
    return out.withColumns({c: F.when(cloud, "not_loaded").otherwise(F.col(c)) for c in ("size_state", "mtime_state")})


def paths_of(catalog: DataFrame, ids: DataFrame, volume_root: str = "", most: int = 64) -> DataFrame:
    """(id, full_path) of some rows, built from parents and names step by step, without the rest of the catalog. A line
    of more than ``most`` names, such as a cycle, ends there; so does one at an unknown parent."""
    links = resolved_parents(catalog.select("id", "parent_id", "name"))
    links = cut(links.select("id", F.when(_is_root() | (record_no("parent_id") == ROOT_RECORD), F.lit(0)).otherwise(F.col("parent_key")).cast("long").alias("up"), "name"))
    state = cut(ids.select("id").distinct().join(links, "id").select("id", "up", F.col("name").alias("path")))
    above = links.select(F.col("id").alias("up"), F.col("up").alias("_next"), F.col("name").alias("_above"))
    for _ in range(most - 1):
        open_ = state.where("up != 0")
        if open_.isEmpty():
            break
        stepped = open_.join(above, "up").select("id", F.col("_next").alias("up"), join_path("_above", "path").alias("path"))
        state = cut(state.where("up = 0 or up is null").unionByName(stepped))
    path = F.when(F.lit(volume_root) != "", join_path(F.lit(volume_root), F.col("path"))).otherwise(F.col("path"))
    return state.select("id", path.alias("full_path"))


def cleared(catalog: DataFrame) -> DataFrame:
    return catalog.limit(0)
