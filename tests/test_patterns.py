"""The pattern languages, against expectations stated one by one and against a small matcher of our own."""

import random

import pytest
from pyspark.sql import functions as F

from pathloom.functions.paths import ancestors, directory, extension, filename, path_key, stem
from pathloom.plans.patterns import body, compile_pattern, detect, to_column

S = chr(92)

# Rule by rule: pattern, text, case-sensitive, expected.
CASES = [
    # whole paths are matched; beside a wildcard either separator matches either, a literal is just itself
    ("pp:/srv/data", "/srv/data", True, True),
    ("pp:/srv/data", "/srv/data/x", True, False),
    ("pp:/srv/data", f"{S}srv{S}data", True, False),
    ("pp:/srv/d*", f"{S}srv{S}data", True, True),
    # a star stays within a component
    ("pp:/srv/*/raw", "/srv/2024/raw", True, True),
    ("pp:/srv/*/raw", "/srv/2024/q1/raw", True, False),
    ("pp:*.parquet", "part-0.parquet", True, True),
    ("pp:*.parquet", "day/part-0.parquet", True, False),
    # two cross components, and may stand for none
    ("/srv/**/raw/*", "/srv/raw/x", True, True),
    ("/srv/**/raw/*", "/srv/eu/west/raw/x", True, True),
    ("/srv/**/raw/*", "/srv/eu/cooked/x", True, False),
    ("**/spool**", "var/spool/lp/job.1", True, True),
    ("**/spool/**", "spool/job.1", True, True),
    ("**o?", "foot", True, True),
    # a question mark is one character of a component
    ("pp:v?", "v7", True, True),
    ("pp:v?", "v", True, False),
    ("pp:v?", "v/", True, False),
    ("pp:v?", "v10", True, False),
    # classes
    ("shard[0-4].bin", "shard3.bin", True, True),
    ("shard[0-4].bin", "shard7.bin", True, False),
    ("shard[^0-4].bin", "shard7.bin", True, True),
    ("shard[^0-4].bin", "shard0.bin", True, False),
    ("pp:[xyz", "x", True, False),
    # shorthands and quantifiers, with both their limits
    (f"run_{S}d{{4}}", "run_2024", True, True),
    (f"run_{S}d{{4}}", "run_24", True, False),
    (f"run_{S}d{{4}}", "run_20245", True, False),
    (f"id{S}d+x", "id42x", True, True),
    (f"id{S}d+x", "idx", True, False),
    (f"tail{S}w+", "tail", True, False),
    # in such patterns a star or question mark repeats what is before it
    ("lo*p[xy]", "loooopx", True, True),
    ("lo*p[xy]", "lapx", True, False),
    ("hono?r[0-9]", "honr2", True, True),
    # anchors
    ("^etc", "etc", True, True),
    ("^etc", "etc2", True, False),
    # case
    ("**/*.PNG", "pics/cat.png", False, True),
    ("**/*.PNG", "pics/cat.png", True, False),
    ("ÖL", "xÖLx", False, True),
    ("öl", "xÖLx", False, False),  # folding is ASCII only
    # globs have no special characters but their two
    ("*.csv", "Report.CSV", False, True),
    ("*.csv", "report.csv.old", False, False),
    ("100%_*", "100%_done", True, True),
    ("100%_*", "100xxdone", True, False),
    # regular expressions match whole texts; bad, empty and overlong ones match nothing
    ("rs:^un|do$", "do", True, True),
    ("rs:^un|do$", "undo", True, False),
    ("rs:ba+r", "baaar", True, True),
    ("rs:z$", "z" + chr(10), True, False),
    ("rs:[", "[", True, False),
    ("rs:" + "k" * 1001, "k" * 1001, True, False),
    ("rs:", "q", True, False),
    # fuzzy: characters in order
    ("fz:rdm", "readme.md", True, True),
    ("fz:mdr", "readme.md", True, False),
    # empty bodies of these match everything
    ("fz:", "q", True, True),
    ("pp:", "any", True, True),
]


@pytest.mark.parametrize("cs", [True, False])
def test_cases(spark, cs):
    cases = [c for c in CASES if c[2] == cs]
    for pattern in dict.fromkeys(c[0] for c in cases):
        own = [c for c in cases if c[0] == pattern]
        df = spark.createDataFrame([(c[1], c[3]) for c in own], "text string, expected boolean")
        test = to_column(pattern, "text", cs)
        got = df.withColumn("got", F.lit(True) if test is None else test).where("got != expected").collect()
        assert not got, (pattern, got)


def test_detection():
    expected = {"main": "substring", "*.c": "glob", "a?": "glob", "a**b": "path", "[a]": "path", "a{2}": "path", "^a": "path", "a$": "path", f"C:{S}docs": "path", "rs:a": "regex", "pp:a": "path", "fz:a": "fuzzy"}
    assert {p: detect(p) for p in expected} == expected
    assert body("rs:x") == "x" and body("x") == "x"


def _match(p, t):
    """A simple path pattern by recursion over characters."""
    if p.startswith("**"):
        return any(_match(p[2:], t[i:]) for i in range(len(t) + 1))
    if p.startswith("*"):
        return _match(p[1:], t) or (t != "" and t[0] not in "/\\" and _match(p, t[1:]))
    if not p or not t:
        return p == t
    same = t[0] in "/\\" if p[0] in "/\\" else t[0] not in "/\\" if p[0] == "?" else p[0] == t[0]
    return same and _match(p[1:], t[1:])


def test_simple_patterns_at_random(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab/\\.") for _ in range(rng.randint(0, 7))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").cache()
    for _ in range(25):
        p = "".join(rng.choice(["a", "b", "/", "*", "**", "?", "**/", "."]) for _ in range(rng.randint(1, 5)))
        if "*" not in p and "?" not in p:
            continue
        test = to_column("pp:" + p, "text", True)
        got = {r.text for r in (df if test is None else df.where(test)).collect()}
        assert got == {t for t in texts if _match(p.replace("**/", "**"), t)}, p


def test_literals_reach_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet").where(to_column("pp:http:/**/de/**", "url", True))
    plan = df._jdf.queryExecution().toString()
    assert "StringStartsWith(url,http:)" in plan
    assert compile_pattern("rs:abc|def").inside == ""


def test_path_functions(spark):
    rows = [(".gitignore",), ("a.",), ("/x/y.tar.gz",), ("C:\\d\\f.TXT",), ("/f",), ("C:\\f",), ("plain",), ("/a/b/",)]
    df = spark.createDataFrame(rows, "p string").select("p", filename("p").alias("f"), extension("p").alias("e"), stem("p").alias("s"), directory("p").alias("d"), path_key("p").alias("k"), ancestors("p").alias("a"))
    got = {r.p: r for r in df.collect()}
    assert [got[p[0]].e for p in rows] == ["", "", "gz", "TXT", "", "", "", ""]
    assert got["/x/y.tar.gz"].s == "y.tar" and got["a."].s == "a."
    assert got["/f"].d == "/" and got["C:\\f"].d == "C:\\" and got["plain"].d == "" and got["/x/y.tar.gz"].d == "/x"
    assert got["C:\\d\\f.TXT"].k == "C:/d/f.TXT" and got["/a/b/"].k == "/a/b"
    assert got["/x/y.tar.gz"].a == ["/x"] and got["C:\\d\\f.TXT"].a == ["C:", "C:\\d"] and got["plain"].a == []
