"""Strict check of one model answer (runs inside Spark tasks).

``from_json`` accepts text after the object and refuses numbers given as strings, so it cannot decide
which answers are valid.
"""

from __future__ import annotations

import json
import re

# Severity levels, from worst to mildest.
SEVERITIES = ["critical", "high", "medium", "low", "info"]

INTEGER = re.compile(r"[+-]?\d+(?:_\d+)*(?:\.0*)?")
#: An answer in a code fence: the opening line, the body, and the closing line if there is one.
FENCED = re.compile(r"\s*```[^\n]*(?P<body>.*?)(?:\n```[^\n]*)?\s*", re.DOTALL)
REQUIRED = object()


class Invalid(ValueError):
    """Names the field that breaks the schema."""


class Digits(str):
    """A whole number that is too long to be worth an ``int``, as its digits."""


#: Digits from which on a number stays text; Python reads longer ones only on demand, as that takes long.
LONG_NUMBER = 4000


def _whole(digits: str) -> int | Digits:
    sign, digits = digits[:1] if digits[:1] in "+-" else "", digits.lstrip("+-").replace("_", "").lstrip("0") or "0"
    minus = "-" if sign == "-" and digits != "0" else ""
    return int(minus + digits) if len(digits) < LONG_NUMBER else Digits(minus + digits)


def _integer(value, field: str) -> int | Digits:
    """Whole numbers of any length, also given as float, boolean or numeric text."""
    if isinstance(value, Digits):
        return value
    if isinstance(value, int) or (isinstance(value, float) and value.is_integer()):
        return int(value)
    if isinstance(value, str) and INTEGER.fullmatch(value.strip()):
        return _whole(value.strip().split(".")[0])
    raise Invalid(field)


def _text(value, field: str) -> str:
    # Half a surrogate pair can be written as a JSON escape but is no text.
    if not isinstance(value, str) or isinstance(value, Digits) or any("\ud800" <= c <= "\udfff" for c in value):
        raise Invalid(field)
    return value


def _severity(value, field: str) -> str:
    if value not in SEVERITIES:
        raise Invalid(field)
    return value


def _score(value, field: str) -> int:
    score = _integer(value, field)
    if isinstance(score, Digits) or not 0 <= score <= 10:
        raise Invalid(field)
    return score


def _issues(value, field: str) -> list[dict]:
    if not isinstance(value, list) or not all(isinstance(i, dict) for i in value):
        raise Invalid(field)
    return [_checked(issue, ISSUE_FIELDS, f"{field}[{n}].") for n, issue in enumerate(value)]


# Field -> (check, default).
ISSUE_FIELDS = {
    "line": (_integer, REQUIRED), "severity": (_severity, REQUIRED), "category": (_text, REQUIRED),
    "message": (_text, REQUIRED), "suggestion": (_text, ""),
}
REVIEW_FIELDS = {
    "filename": (_text, REQUIRED), "issues": (_issues, []), "summary": (_text, ""), "overall_score": (_score, 5),
}


def _checked(data: dict, fields: dict, where: str = "") -> dict:
    result = {}
    for name, (check, default) in fields.items():
        if name not in data and default is REQUIRED:
            raise Invalid(where + name)
        result[name] = check(data[name], where + name) if name in data else default
    return result


def read_review(text: str) -> dict:
    """The review in ``text`` with defaults filled in, or the kind of error and where it is."""
    blank = {"error_kind": "ok", "error_detail": None, "filename": None, "issues": [], "summary": None,
             "overall_score": None}
    fenced = FENCED.fullmatch(text)
    try:
        data = json.loads(fenced["body"] if fenced else text.strip(), parse_int=_whole)
    except json.JSONDecodeError:
        return blank | {"error_kind": "invalid_json"}
    except (ValueError, RecursionError) as err:  # JSON beyond the limits of the reader
        return blank | {"error_kind": "not_object", "error_detail": type(err).__name__}
    if not isinstance(data, dict):
        return blank | {"error_kind": "not_object", "error_detail": type(data).__name__}
    try:
        return blank | _checked(data, REVIEW_FIELDS)
    except Invalid as err:
        return blank | {"error_kind": "invalid_schema", "error_detail": str(err)}
