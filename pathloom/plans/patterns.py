"""The five pattern languages as Catalyst predicates.

A pattern becomes the cheapest column that has its meaning - equality,
``contains``, ``like`` (which Catalyst folds to prefix, suffix or substring
tests), and only else ``rlike`` - with literals that every match must hold
ANDed before an ``rlike`` where they are sound, since those can reach the
Parquet scan and a regular expression cannot.

* substring (default), anywhere in the text;
* glob, ``*`` and ``?`` over the whole text, crossing separators;
* ``pp:`` path patterns over the whole text: ``*`` and ``?`` stop at separators,
  ``**`` doesn't; with ``[ ] { } ^ $`` inside, ``\\d`` or ``\\w`` the advanced
  form, in which quantifiers follow literals, classes and shorthands;
* ``rs:`` regular expressions, found anywhere unless anchored at both ends;
* ``fz:`` characters in order, with anything between.

Case-insensitive matching folds ASCII only.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import LOWER, UPPER, ascii_lower

PREFIXES = {"rs:": "regex", "pp:": "path", "fz:": "fuzzy"}
MAX_REGEX = 1000
MIN_LITERAL = 3
FOLD = str.maketrans(UPPER, LOWER)


def detect(pattern: str) -> str:
    """Which language a pattern is in."""
    if pattern[:3] in PREFIXES:
        return PREFIXES[pattern[:3]]
    if pattern.startswith("^") or pattern.endswith("$") or any(x in pattern for x in ("**", "[", "]", "{", "}", "\\d", "\\w")):
        return "path"
    return "glob" if "*" in pattern or "?" in pattern else "substring"


def body(pattern: str) -> str:
    """A pattern without the prefix that names its language."""
    return pattern[3:] if pattern[:3] in PREFIXES else pattern


def quote(text: str) -> str:
    """Text as a regular expression that Java, RE2 and Python read alike."""
    return "".join(c if c.isalnum() or c in "_ /" or ord(c) > 127 else "\\" + c if c.isprintable() else f"\\x{ord(c):02x}" for c in text)


@dataclass(frozen=True)
class Rule:
    """A compiled pattern: ``kind`` is all, none, equals, contains, like or regex; ``needs`` are literals of every match."""

    kind: str
    value: str = ""
    prefix: str = ""
    suffix: str = ""
    inside: str = ""


ALL, NONE = Rule("all"), Rule("none")


# ---- path patterns


def _literal_runs(tokens: list[tuple[str, str]]) -> tuple[str, str, str]:
    """Prefix, suffix and longest run of literal characters among tokens (kind, regex)."""
    runs: list[str] = [""]
    for kind, text in tokens:
        if kind == "literal":
            runs[-1] += text
        else:
            runs.append("")
    if len(runs) == 1:
        return runs[0], runs[0], runs[0]
    return runs[0], runs[-1], max(runs, key=len)


def _simple(pattern: str) -> list[tuple[str, str]]:
    """Tokens of a simple path pattern; ``**/`` counts as ``**``."""
    out = []
    for m in re.finditer(r"\*\*|\*|\?|[/\\]|(?s:.)", pattern.replace("**/", "**")):
        t = m.group()
        if t == "**":
            out.append(("any", "[\\s\\S]*"))
        elif t == "*":
            out.append(("star", r"[^/\\]*"))
        elif t == "?":
            out.append(("one", r"[^/\\]"))
        elif t in "/\\":
            out.append(("separator", r"[/\\]"))
        else:
            out.append(("literal", t))
    return out


QUANTIFIER = re.compile(r"[?*+]|\{\d+(?:,\d*)?\}")


def _class(pattern: str, at: int) -> tuple[str, int] | None:
    """A character class that starts at ``at``, as a regular expression, and where it ends; None if it doesn't end."""
    i, negated = at + 1, False
    if pattern[i : i + 1] == "^":
        negated, i = True, i + 1
    members: list[tuple[str, str]] = []
    while i < len(pattern):
        c = pattern[i]
        if c == "]":
            if not members:
                return ("[\\s\\S]" if negated else "(?!)"), i + 1
            inner = "".join(quote(a) if a == b else f"{quote(a)}-{quote(b)}" for a, b in members)
            return f"[{'^' if negated else ''}{inner}]", i + 1
        if c == "\\" and i + 1 < len(pattern):
            members.append((pattern[i + 1],) * 2)
            i += 2
        elif pattern[i + 1 : i + 2] == "-" and pattern[i + 2 : i + 3] not in ("", "]"):
            members.append(tuple(sorted((c, pattern[i + 2]))))
            i += 3
        else:
            members.append((c, c))
            i += 1
    return None


def _advanced(pattern: str) -> list[tuple[str, str]] | None:
    """Tokens of an advanced path pattern; None if it is invalid."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            out.append(("any", "[\\s\\S]*"))
            i += 2
            continue
        if c in "*?":
            out.append(("star", r"[^/\\]*") if c == "*" else ("one", r"[^/\\]"))
            i += 1
            continue
        if c == "[":
            found = _class(pattern, i)
            if found is None:
                return None
            atom, i = found
            kind = "class"
        elif pattern[i : i + 2] in ("\\d", "\\w"):
            atom, kind = ("[0-9]" if pattern[i + 1] == "d" else "[A-Za-z0-9_]"), "class"
            i += 2
        else:
            atom, kind = c, "literal"
            i += 1
        if m := QUANTIFIER.match(pattern, i):
            out.append(("repeat", (quote(atom) if kind == "literal" else atom) + m.group()))
            i = m.end()
        else:
            out.append((kind, atom))
    return out


def path_rule(pattern: str) -> Rule:
    """The rule of a path pattern (without ``pp:``)."""
    if pattern == "":
        return ALL
    # anchors go without saying, since the whole text is matched
    inner = pattern[1:] if pattern.startswith("^") else pattern
    inner = inner[:-1] if inner.endswith("$") else inner
    if any(x in inner for x in ("[", "]", "{", "}", "^", "$", "\\d", "\\w")):
        tokens = _advanced(inner)
        if tokens is None:
            return NONE
    else:
        if not any(x in inner for x in "*?"):
            return Rule("equals", inner)
        tokens = _simple(inner)
    if all(kind == "any" for kind, _ in tokens) and tokens:
        return ALL
    prefix, suffix, inside = _literal_runs(tokens)
    regex = "".join(quote(t) if kind == "literal" else t for kind, t in tokens)
    return Rule("regex", rf"\A{regex}\z", prefix, suffix, inside)


# ---- regular expressions

#: What Java reads differently from ECMAScript, or what ECMAScript doesn't have: such patterns match nothing.
FOREIGN = re.compile(r"\[\]|\[\^\]|\\[cQEAZzGpPhHRXkNae]|\\0\d|\(\?<|\(\?[a-zA-Z-]+[:)]|[*+?}]\+|&&")


def _ends(regex: str) -> str:
    """``$`` outside classes as ``\\z`` (Java's ``$`` also matches before a last newline)."""
    out, i, inside = [], 0, False
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            out.append(regex[i : i + 2])
            i += 2
            continue
        inside = (inside or c == "[") and not (inside and c == "]")
        out.append("\\z" if c == "$" and not inside else c)
        i += 1
    return "".join(out)


def _required(regex: str) -> str:
    """The longest literal that every match holds; '' if none can be told. Alternatives and groups end the search."""
    if re.search(r"[|(]", re.sub(r"\\.", "", regex)):
        return ""
    runs, i = [""], 0
    while i < len(regex):
        c = regex[i]
        if c == "\\" and i + 1 < len(regex):
            unit, i, literal = regex[i + 1], i + 2, not regex[i + 1].isalnum()
        elif c == "[":
            end = re.compile(r"\[\^?(?:\\.|[^\]])*\]").match(regex, i)
            unit, i, literal = "", end.end() if end else len(regex), False
        else:
            unit, i, literal = c, i + 1, c not in ".^$"
        m = re.compile(r"[?*]|\{[^}]*\}|\+").match(regex, i)
        if m:
            i = m.end()
            if literal and m.group() == "+":
                runs[-1] += unit
            runs.append("")
        elif literal:
            runs[-1] += unit
        else:
            runs.append("")
    return max(runs, key=len)


def _valid(regex: str) -> bool:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(regex)
            return True
        except (PySparkException, Exception):  # noqa: B014 - the gateway wraps Java's exception
            return False
    try:
        re.compile(regex.replace("\\z", "\\Z"))
        return True
    except re.error:
        return False


def regex_rule(pattern: str) -> Rule:
    """The rule of a regular expression (without ``rs:``); invalid, empty or too long ones match nothing, the last with
    a warning."""
    if len(pattern) > MAX_REGEX:
        warnings.warn(f"a regular expression of {len(pattern)} characters matches nothing; {MAX_REGEX} are allowed", stacklevel=2)
    if not pattern or len(pattern) > MAX_REGEX or FOREIGN.search(pattern):
        return NONE
    whole = pattern.startswith("^") and pattern.endswith("$") and not pattern.endswith("\\$")
    java = _ends(pattern)
    java = rf"\A(?:{java})\z" if whole else java
    if not _valid(java):
        return NONE
    need = _required(pattern)
    return Rule("regex", java, inside=need if len(need) >= MIN_LITERAL else "")


# ---- all languages


def compile_pattern(pattern: str) -> Rule:
    kind, text = detect(pattern), body(pattern)
    if kind == "path":
        return path_rule(text)
    if kind == "regex":
        return regex_rule(text)
    if kind == "fuzzy":
        return Rule("regex", "(?s)" + ".*?".join(map(quote, text))) if text else ALL
    if kind == "glob":
        like = "".join({"*": "%", "?": "_", "%": "\\%", "_": "\\_", "\\": "\\\\"}.get(c, c) for c in text)
        return ALL if set(text) == {"*"} else Rule("like", like)
    return Rule("contains", text) if text else ALL


def regex_of(rule: Rule, case_sensitive: bool) -> str:
    return rule.value if case_sensitive else "(?i)" + rule.value


def to_column(pattern: str, column: Column | str, case_sensitive: bool = False) -> Column | None:
    """The predicate of a pattern on a column; None if it holds for every row."""
    rule = compile_pattern(pattern)
    c = F.col(column) if isinstance(column, str) else column
    if rule.kind == "all":
        return None
    if rule.kind == "none":
        return F.lit(False)
    fold = (lambda s: s) if case_sensitive else (lambda s: s.translate(FOLD))
    text = c if case_sensitive else ascii_lower(c)
    if rule.kind == "equals":
        return text == fold(rule.value)
    if rule.kind == "contains":
        return text.contains(fold(rule.value))
    if rule.kind == "like":
        return text.like(fold(rule.value))
    test = c.rlike(regex_of(rule, case_sensitive))
    for need, how in ((rule.prefix, text.startswith), (rule.suffix, text.endswith)):
        if need:
            test = how(fold(need)) & test
    if len(rule.inside) >= MIN_LITERAL and rule.inside not in (rule.prefix, rule.suffix):
        test = text.contains(fold(rule.inside)) & test
    return test


def path_pattern(column: Column | str, pattern: str, case_sensitive: bool = True) -> Column:
    """Whether a path pattern matches a column."""
    found = to_column("pp:" + pattern, column, case_sensitive)
    return F.lit(True) if found is None else found
