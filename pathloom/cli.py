"""``python -m pathloom.cli``: build a catalog from a list or a folder, search it, dump or export it."""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import SparkSession

from .operators.export import dump_paths, export_csv
from .operators.results import SORTS, sort_results
from .plans.query import SearchQuery, parse_config, search
from .sources.crawl import crawl_catalog
from .sources.lists import catalog_from_paths, read_catalog, read_path_list, write_catalog


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pathloom")
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--index-from-file", metavar="LIST")
    source.add_argument("--crawl-folder", metavar="FOLDER")
    source.add_argument("--catalog", metavar="PARQUET")
    for name in ("save-catalog", "dump-index-to", "export-csv-to"):
        p.add_argument(f"--{name}", metavar="PATH")
    for name in ("filename", "path", "extensions"):
        p.add_argument(f"--{name}", default="")
    p.add_argument("--config", metavar="JSON", help="a search config; replaces the query options")
    p.add_argument("--folders-only", action="store_true")
    p.add_argument("--case-sensitive", action="store_true")
    p.add_argument("--time-filter", default="None")
    p.add_argument("--size-filter", default="None")
    p.add_argument("--sort", choices=SORTS)
    p.add_argument("--descending", action="store_true")
    p.add_argument("--limit", type=int, default=20)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("pathloom").getOrCreate()
    if args.index_from_file:
        catalog = catalog_from_paths(read_path_list(spark, args.index_from_file))
    elif args.crawl_folder:
        catalog = crawl_catalog(spark, args.crawl_folder)
    else:
        catalog = read_catalog(spark, args.catalog)
    if args.save_catalog:
        write_catalog(catalog, args.save_catalog)
        catalog = read_catalog(spark, args.save_catalog)
    if args.dump_index_to:
        dump_paths(catalog, args.dump_index_to)
    if args.config:
        query = parse_config(args.config)
    else:
        query = SearchQuery.typed(args.filename, args.path, args.extensions, folders_only=args.folders_only, case_sensitive=args.case_sensitive, time_filter=args.time_filter, size_filter=args.size_filter)
    found = search(catalog, query, datetime.now())
    if args.export_csv_to:
        export_csv(found, args.export_csv_to)
        return 0
    if args.sort:
        found = sort_results(found, args.sort, not args.descending)
    for r in found.select("full_path").limit(args.limit).collect():
        print(r.full_path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
