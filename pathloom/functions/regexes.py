"""Regular expressions from templates, for the ``rs:`` pattern language."""

from __future__ import annotations

SPECIAL = set(r"\^$.|?*+()[]{}")


def escape(text: str) -> str:
    return "".join("\\" + c if c in SPECIAL else c for c in text)


def template(kind: str, text: str = "") -> str:
    """The regular expression of a template; without its text, templates that need one give ''."""
    # The shapes of the templates.
    fixed = {"numeric": r".*\d+.*", "date": r".*\d{4}[-_]\d{2}[-_]\d{2}.*"}
    if kind in fixed:
        return fixed[kind]
    if not text:
        return ""
    shapes = {
        "starts_with": "^{}.*",
        "ends_with": ".*{}$",
        "contains": ".*{}.*",
        "does_not_contain": "^(?!.*{}).*$",
    }
    if kind in shapes:
        return shapes[kind].replace("{}", escape(text))
    if kind == "extension":
        return rf".*\.({text})$"
    if kind == "custom":
        return text
    raise ValueError(f"no template {kind!r}")
