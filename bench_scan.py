"""Searches over generated catalogs of 1M and 10M paths: seconds, seconds without the fixed cost of a job (the same search
over 1,000 rows), and paths a second. Prints one JSON line; sizes can be given as arguments."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time


def main() -> None:
    from pyspark.sql import DataFrame, SparkSession
    from pyspark.sql import functions as F

    from pathloom.operators.folders import folder_totals
    from pathloom.operators.results import top_results
    from pathloom.plans.query import SearchQuery, search
    from pathloom.schema import as_catalog
    from pathloom.sources.lists import write_catalog

    cpus, sizes = os.environ.get("BENCH_CPUS", "8"), [int(x) for x in sys.argv[1:]] or [1_000_000, 10_000_000]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    searches = {
        "all": SearchQuery.show_all(),
        "substring": SearchQuery(filename="report"),
        "glob": SearchQuery(filename="*_7?.pdf"),
        "path": SearchQuery(path="pp:/vol/**/team3/*.txt"),
        "regex": SearchQuery(filename=r"rs:report_\d+5\.(txt|pdf)$"),
        "fuzzy": SearchQuery(filename="fz:rpt9"),
        "composed": SearchQuery(filename="data", extensions=["txt", "md"], size_filter="Medium"),
    }

    def timed(f) -> float:
        runs = []
        for _ in range(4):
            t = time.time()
            f().write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        return statistics.median(runs[1:])

    def catalog(n: int, folder: str) -> DataFrame:
        pick = lambda salt, *of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(of))) + 1).cast("int"))
        number = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
        path = F.concat(F.lit("/vol/y"), number(1, 12), F.lit("/unit"), number(2, 300), F.lit("/team"), number(3, 9), F.lit("/"), pick(4, "report", "data", "notes", "image", "build"), F.lit("_"), F.col("id"), pick(5, ".txt", ".pdf", ".md", ".cpp", ""))
        rows = spark.range(0, n, 1, int(cpus)).select((F.col("id") + 1).alias("id"), path.alias("full_path"), number(6, 1 << 24).alias("size_bytes"))
        write_catalog(as_catalog(rows), f"{folder}/{n}")
        return spark.read.parquet(f"{folder}/{n}")

    out = {}
    with tempfile.TemporaryDirectory() as folder:
        small, found = catalog(1000, f"file://{folder}"), {}
        for n in sizes:
            c = catalog(n, f"file://{folder}")
            steps = {k: (lambda d, q=q: search(d, q).select("id")) for k, q in searches.items()}
            steps |= {"folder_totals": folder_totals, "top_by_size": lambda d: top_results(d, "Size", 100, False).select("id")}
            for name, f in steps.items():
                found.setdefault(name, timed(lambda f=f: f(small)))
                s = timed(lambda f=f, c=c: f(c))
                scan = max(1e-3, s - found[name])
                out[f"{name}_{n}"] = {"sec": round(s, 3), "scan_sec": round(scan, 3), "paths_per_sec": int(n / scan)}
    print(json.dumps({"metric": "searches over generated paths", "cpus": int(cpus), "queries": out}))


if __name__ == "__main__":
    main()
