"""Sources, sinks, streams, history and maintenance: what SQL can't be asked about."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from pathloom.cli import main
from pathloom.functions import formats, regexes
from pathloom.functions.hashing import fnv1a, fnv_hex
from pathloom.operators import catalog as dml
from pathloom.operators import export, filters, folders, history
from pathloom.plans import query as q
from pathloom.queries import QUERIES
from pathloom.schema import CATALOG, CHANGES, HISTORY, as_catalog
from pathloom.sources import crawl, journal, lists
from pathloom.streaming.fold import fold, start_catalog, stateful_ops, stream_into
from pathloom.streaming.monitor import Debounce, standing

FILES = {"alpha/a.txt": 1, "alpha/b.txt": 1, "alpha/c.cpp": 2, "beta/x.h": 3, "beta/y.json": 5, "beta/z.md": 8, "beta/sub/p.txt": 13, "beta/sub/q.cpp": 21, "gamma/r.txt": 55, "gamma/deep/deeper/leaf.h": 34}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, n in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * n)
    os.symlink(root / "alpha", root / "link")
    return str(root)


@pytest.fixture(scope="module")
def crawled(spark, folder):
    return crawl.crawl_catalog(spark, folder).cache()


def test_crawl(spark, folder, crawled):
    found = {r.full_path[len(folder) + 1 :]: r for r in crawl.crawl(spark, folder, shares=2).collect()}
    assert {k: r.size_bytes for k, r in found.items() if not r.is_dir} == FILES
    assert {k for k, r in found.items() if r.is_dir} == {"alpha", "beta", "beta/sub", "gamma", "gamma/deep", "gamma/deep/deeper"}
    assert crawl.crawl(spark, folder + "/none").collect() == []
    files = crawled.where("not is_dir")
    assert files.count() == 10 and files.agg(F.sum("size_bytes")).first()[0] == sum(FILES.values())
    counts = {e: q.search(crawled, q.SearchQuery(extensions=[e])).count() for e in ("txt", "cpp", "h", "json")}
    assert counts == {"txt": 4, "cpp": 2, "h": 2, "json": 1}
    assert q.search(crawled, q.SearchQuery(extensions=["cpp"], folders_only=True)).count() == 0
    below = {r.full_path[len(folder) + 1 :]: (r.total_size, r.file_count) for r in folders.folder_stats(crawled, crawled.where("is_dir").select("full_path")).collect()}
    assert below["beta"] == (50, 5) and below["beta/sub"] == (34, 2) and below["gamma"] == (89, 2)


def test_folder_sums(spark):
    rows = [(1, 0, "root", True, None), (2, 1, "a.txt", False, 100), (3, 1, "b.txt", False, 200), (4, 1, "sub", True, None), (5, 4, "c.txt", False, 50), (6, 0, "other", True, None), (7, 6, "d.txt", False, 1000), (8, 6, "empty", True, None)]
    c = dml.recompute_paths(as_catalog(spark.createDataFrame(rows, "id long, parent_id long, name string, is_dir boolean, size_bytes long")), "/")
    got = {r.full_path: (r.total_size, r.file_count) for r in folders.folder_stats(c, c.where("is_dir").select("full_path").union(spark.createDataFrame([("/",)], "full_path string"))).collect()}
    assert got == {"/root": (350, 3), "/root/sub": (50, 1), "/other": (1000, 1), "/other/empty": (0, 0), "/": (1350, 4)}


def test_path_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text("C:/src/main.cpp\n\nC:/src/utils/helper.cpp\nC:/docs/\nC:\\src\\main.cpp\n")
    c = lists.catalog_from_paths(lists.read_path_list(spark, str(tmp_path / "list.txt")))
    got = {r.full_path.replace("\\", "/"): r for r in c.collect()}
    assert {k: r.is_dir for k, r in got.items()} == {"C:": True, "C:/src": True, "C:/src/utils": True, "C:/docs": True, "C:/src/main.cpp": False, "C:/src/utils/helper.cpp": False}
    assert got["C:/src/main.cpp"].parent_id == got["C:/src"].id and got["C:"].parent_id == 0
    again = dml.insert_paths(c, c.select("full_path", "is_dir"))
    assert {(r.id, r.full_path) for r in again.collect()} == {(r.id, r.full_path) for r in c.collect()}
    lists.write_catalog(c, f"file://{tmp_path}/catalog")
    assert lists.read_catalog(spark, f"file://{tmp_path}/catalog").count() == 6
    assert main(["--catalog", f"file://{tmp_path}/catalog", "--filename", "*.cpp", "--sort", "FullPath"], spark) == 0


def test_deep_trees_and_cycles(spark):
    rows = [(i, i - 1, f"d{i}", True) for i in range(1, 64)] + [(200, 63, "leaf", False), (300, 301, "x", True), (301, 300, "y", True), (302, 300, "z", False), (400, 999, "lost", False), (7_000, 7_000, "own", True)]
    rows = [(i + 1000, p + 1000 if p else 0, n, d) for i, p, n, d in rows]
    c = dml.recompute_paths(as_catalog(spark.createDataFrame(rows, "id long, parent_id long, name string, is_dir boolean")))
    got = {r.id: r.full_path for r in c.collect()}
    assert got[1200].count("/") == 63 and got[8000] == "own" and not {1300, 1301, 1302, 1400} & set(got)
    assert dml.subtree_ids(c.withColumn("full_path", F.concat(F.lit("/r/"), "full_path")), spark.createDataFrame([(1060,)], "id long")).count() == 5


def test_csv(spark, tmp_path, crawled):
    cells = ["plain", "a,b", 'q"q', "=1+1", "-x", "line\nbreak", ""]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(formats.csv_cell("c")).collect()]
    assert got == ["plain", '"a,b"', '"q""q"', "\"'=1+1\"", "\"'-x\"", '"line\nbreak"', ""]
    export.export_csv(crawled, f"file://{tmp_path}/csv")
    lines = [r.value for r in spark.read.text(f"file://{tmp_path}/csv").collect()]
    assert export.HEADER in lines and any(x.startswith("leaf,34 B,") and x.endswith(",h,-") for x in lines)
    export.dump_paths(crawled, f"file://{tmp_path}/dump")
    assert spark.read.text(f"file://{tmp_path}/dump").count() == crawled.count()


def test_formats(spark):
    sizes = [0, 1, 1023, 1024, 1280, 1536, 1048575, 1048576, 1 << 30, 1342177280]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "s long").select(formats.file_size("s")).collect()]
    assert got == ["0 B", "1 B", "1023 B", "1.0 KB", "1.2 KB", "1.5 KB", "1,024.0 KB".replace(",", ""), "1.0 MB", "1.00 GB", "1.25 GB"]
    t = spark.sql("SELECT timestamp'2024-05-06 07:08:09' AS t").select("t", formats.timestamp_to_ticks("t").alias("k")).select("t", formats.ticks_to_timestamp("k").alias("u")).first()
    assert t.t == t.u
    s = spark.createDataFrame([("18446744073709551615",), ("1",), ("5",)], "k string").select(formats.ticks_state("k")).collect()
    assert [r[0] for r in s] == ["not_loaded", "failed", "loaded"]


def test_sizes_are_a_partition(spark):
    bounds = sorted({b + d for b in (1, 1 << 10, 100 << 10, 10 << 20, 100 << 20, 1 << 30) for d in (-1, 0, 1)})
    df = spark.createDataFrame([(b, False) for b in bounds], "size_bytes long, is_dir boolean")
    hits = df.select("size_bytes", sum(F.when(filters.size_bucket(n), 1).otherwise(0) for n in filters.SIZES).alias("n")).collect()
    assert all(r.n == 1 for r in hits)


def test_configs():
    ok = q.parse_config('﻿```json\n{"version": 1, "search_config": {"extensions": "cpp, .h", "path": 3, "folders_only": true}}\n```')
    assert ok == q.SearchQuery(extensions=["cpp", "h"], folders_only=True)
    wrapped = {"candidates": [{"content": {"parts": [{"text": '{"version": "1.0", "search_config": {}}'}]}}]}
    assert q.parse_config(json.dumps(wrapped)) == q.SearchQuery(path="pp:")
    for bad in ("", "[]", "{}", '{"candidates": []}', '{"version": 1}'):
        with pytest.raises(q.ConfigError):
            q.parse_config(bad)
    assert q.without_extension("pp:**/x/*.cpp", ["cpp"]) == "pp:**/x**" and q.without_extension("pp:x", ["h"]) == "pp:**/x**" and q.without_extension("x", ["h"]) == "x"
    base = q.SearchQuery(filename="f", folders_only=True)
    assert q.applied(base, q.SearchQuery(path="p", size_filter="Odd")) == q.SearchQuery(filename="f", path="p")
    assert q.SearchQuery.typed(" a ", extensions="cpp; .h,, ").extensions == ["cpp", ".h"]
    assert regexes.template("does_not_contain", "a.b{1}") == r"^(?!.*a\.b\{1\}).*$" and regexes.template("starts_with") == ""
    with pytest.raises(ValueError):
        dml.rewrite_prefix(None, "/", "/x")


def test_history(spark):
    p = {"filename": " *.cpp ", "path": "", "extensions": "H;cpp", "folders_only": False, "case_sensitive": False, "time_filter": 0, "size_filter": 0, "ai_search_description": ""}
    schema = HISTORY.replace("id string, ", "").split(", custom_name")[0]
    params = spark.createDataFrame([(p,), ({**p, "extensions": "cpp, h"},), ({**p, "path": "x"},)], schema)
    h = history.record(spark.createDataFrame([], HISTORY), params, 10)
    rows = h.collect()
    assert len(rows) == 2 and {r.params.extensions for r in rows} == {"cpp,h"} and {r.last_used_at for r in rows} == {10}
    again = history.record(h, params.limit(1), 20).collect()
    assert sorted(r.last_used_at for r in again) == [10, 20] and {r.id for r in again} == {r.id for r in rows}
    one = rows[0].id
    pinned = history.pin(h, one, 30)
    assert history.sorted_view(pinned).first().id == one and history.unpin(pinned, one, 40, keep=1).collect()[0].last_used_at == 40
    assert history.label(h, one, "n").where("custom_name = 'n'").count() == 1 and history.delete(h, one).count() == 1
    # an id that is taken by another query gets a suffix
    taken = h.where(F.col("id") == one).withColumn("params", F.col("params").withField("path", F.lit("other")))
    more = history.record(taken, spark.createDataFrame([(rows[0].params.asDict(),)], schema), 50)
    assert {r.id for r in more.collect()} == {one, one + "-1"}
    query = history.query_of(history.params_of(q.SearchQuery(filename="f", extensions=["a", "b"], size_filter="Huge")))
    assert query == q.SearchQuery(filename="f", extensions=["a", "b"], size_filter="Huge")
    assert fnv1a(b"") == 14695981039346656037 and spark.range(1).select(fnv_hex(F.lit("a"))).first()[0] == "af63dc4c8601ec8c"


def test_history_json(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps([{"id": "a", "last_used_at": 5, "is_pinned": "x"}, {"custom_name": "no id"}]))
    rows = history.read_history(spark, f"file://{tmp_path}/h.json").collect()
    assert [(r.id, r.last_used_at, r.is_pinned, r.custom_name) for r in rows] == [("a", 5, False, "")]


CHANGE = [
    (1, 100, 10, "new.txt", False, ["FILE_CREATE"]),
    (2, 100, 10, "newer.txt", False, ["RENAME_NEW_NAME"]),
    (3, 101, 10, "tmp", False, ["FILE_CREATE", "FILE_DELETE"]),
    (4, 11, 10, "gone.txt", False, ["FILE_DELETE", "DATA_EXTEND"]),
    (5, 12, 10, "kept.txt", False, ["DATA_OVERWRITE"]),
    (6, 13, 10, "$R12", True, ["RENAME_NEW_NAME"]),
    (7, 12, 10, "kept.txt", False, ["RENAME_OLD_NAME"]),
    (8, 12, 10, "kept.txt", False, ["CLOSE"]),
]


def _changes(spark):
    return spark.createDataFrame(CHANGE, "seq long, file_ref long, parent_ref long, name string, is_dir boolean, reasons array<string>").withColumn("ts", F.lit(None).cast("timestamp_ntz")).select([c.split()[0] for c in CHANGES.split(", ")])


def _base(spark):
    rows = [(10, 0, "root", True, None), (11, 10, "gone.txt", False, 1), (12, 10, "kept.txt", False, 2), (13, 10, "bin", True, None), (14, 13, "inside.txt", False, 3)]
    return dml.recompute_paths(as_catalog(spark.createDataFrame(rows, "id long, parent_id long, name string, is_dir boolean, size_bytes long")))


def test_fold(spark):
    got = {r.id: r.op for r in fold(_changes(spark)).collect()}
    assert got == {100: "upsert", 101: "delete", 11: "delete", 12: "invalidate", 13: "subtree_delete"}
    assert journal.quarantine(_changes(spark)).count() == 0


def test_stream(spark, tmp_path):
    root = f"file://{tmp_path}"
    start_catalog(_base(spark), f"{root}/catalog")
    _changes(spark).where("seq < 4").coalesce(1).write.json(f"{root}/journal")
    _changes(spark).where("seq >= 4").coalesce(1).write.mode("append").json(f"{root}/journal")
    seen = {}
    changes = journal.read_stream(spark, f"{root}/journal", max_files=1)
    run = stream_into(changes, f"{root}/catalog", f"{root}/checkpoint", then=standing(lambda c: q.search(c, q.SearchQuery(extensions=["txt"])), lambda df, n: seen.update({n: sorted(r.full_path for r in df.collect())})))
    run.processAllAvailable()
    run.stop()
    assert seen[max(seen)] == ["root/kept.txt", "root/newer.txt"]
    last = spark.read.parquet(f"{root}/catalog/v={max(seen) + 1}")
    assert last.where("id = 12").first().size_state == "not_loaded" and CATALOG.split()[0] in last.columns


def test_stateful_stream(spark, tmp_path):
    root = f"file://{tmp_path}"
    _changes(spark).coalesce(1).write.json(f"{root}/journal")
    run = stateful_ops(journal.read_stream(spark, f"{root}/journal")).writeStream.format("memory").queryName("ops").outputMode("append").option("checkpointLocation", f"{root}/c").start()
    run.processAllAvailable()
    run.stop()
    assert [(r.id, r.op) for r in spark.table("ops").orderBy("seq").collect()] == [(100, "create"), (100, "rename")]


def test_scalar_queries_of_whole_tables(spark):
    sf_dir = "/root/testdata/sf0.01"
    run = lambda name: QUERIES[name](spark, sf_dir)
    events, documents = (spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("events", "documents"))
    ago, numbers, sizes = run("kd3_relative_time_all"), run("km1_record_numbers_all"), run("ks_numbers_all")
    assert (ago.count(), numbers.count(), sizes.count()) == (events, events, documents)
    assert ago.where("ago = 'Future'").count() == ago.where("event_id > 8000").count() > 0
    assert sizes.where("memory is null and floored is null and thousands is null").count() == documents // 8


def test_requests_are_kept(spark):
    rows = [(1, "/a/x.txt", 5), (2, "/a/b/y.txt", 7)]
    catalog = as_catalog(spark.createDataFrame(rows, "id long, full_path string, size_bytes long"))
    stats = folders.FolderStats(catalog)
    asked = spark.createDataFrame([("/a",), ("/a/",), ("/a/b",), ("/none",)], "full_path string")
    got = lambda: {r.full_path: (r.total_size, r.file_count) for r in stats.request(asked).collect()}
    assert got() == {"/a": (12, 2), "/a/b": (7, 1), "/none": (0, 0)}
    kept = stats._totals
    assert got() and stats._totals is kept
    stats.reset(catalog.where("id = 1"))
    assert got()["/a"] == (5, 1) and stats.generation == 1


def test_small_helpers(tmp_path):
    (tmp_path / "list.txt").write_text("x")
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    assert lists.resolve_list_path("list.txt", str(deep)) == str(tmp_path / "list.txt")
    assert lists.resolve_list_path("list.txt", str(deep), levels=2) is None and lists.resolve_list_path("/none", "/") is None
    d = Debounce(0.2)
    assert [d.due(t, now) for t, now in (("a", 0.0), ("ab", 0.1), ("ab", 0.25), ("ab", 0.31), ("ab", 0.9), ("a", 1.0), ("a", 1.25))] == [False, False, False, True, False, False, True]


def test_recrawl(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "one.txt").write_text("1")
    run = crawl.recrawl(spark, str(tmp_path / "data"), f"file://{tmp_path}/catalog", f"file://{tmp_path}/checkpoint", shares=2)
    deadline = time.time() + 60
    while time.time() < deadline and not (run.lastProgress and (tmp_path / "catalog" / "v=0" / "_SUCCESS").exists()):
        time.sleep(0.5)
    run.stop()
    assert lists.read_catalog(spark, f"file://{tmp_path}/catalog/v=0").where("not is_dir").first().size_bytes == 1


def test_journal_status(spark):
    log = [(i, "denied" if 10 <= i < 15 or i >= 30 else None) for i in range(50)]
    frame = lambda rows: spark.createDataFrame(rows, "seq long, error string")
    assert journal.read_status(frame(log), 10).first() == (39, False)
    assert journal.read_status(frame(log[:30]), 10).first() == (None, False)
    assert journal.read_status(frame([*log[:20], (20, "gap"), (21, None)]), 10).first() == (None, True)
    assert journal.read_status(frame([]), 10).first() == (None, False)
