"""Text canonicalisation as column expressions; presets as in the original tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRESETS = {"none": 0, "support": 1, "code": 2, "policy": 3, "general": 4}

_DATE = r"(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:Z|[+-][0-9]{2}:[0-9]{2})?)?"
_TIME = r"(?<![0-9])[0-9]{2}:[0-9]{2}:[0-9]{2}(?![0-9])"
_EPOCH = r"(?<![0-9A-Za-z])[0-9]{10}(?![0-9A-Za-z])"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalize_whitespace(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[ \t\n\r\x0B\f]+", " "))


def strip_timestamps(x: Column) -> Column:
    """Dates, times of day and ten-digit epochs go, in one pass from left to right."""
    return F.regexp_replace(x, f"{_DATE}|{_TIME}|{_EPOCH}", "")


def strip_uuids(x: Column) -> Column:
    return F.regexp_replace(x, "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "")


def normalize_identifiers(x: Column) -> Column:
    """``camelCase`` and ``snake_case`` become spaced; ASCII letters become small."""
    spaced = F.regexp_replace(F.regexp_replace(x, "([a-z])([A-Z])", "$1 $2"), "(?<=[A-Za-z0-9])_(?=[A-Za-z0-9])", " ")
    return F.translate(spaced, _UPPER, _LOWER)


def bucket_numbers(x: Column) -> Column:
    return F.regexp_replace(x, "[0-9]+", "<N>")


def canon(x: Column, preset: str | int) -> Column:
    """A preset by name or number; an unknown number passes the text through."""
    code = PRESETS[preset] if isinstance(preset, str) else preset
    if code == 1:
        return normalize_whitespace(bucket_numbers(strip_uuids(strip_timestamps(normalize_whitespace(x)))))
    if code == 2:
        return normalize_identifiers(normalize_whitespace(x))
    if code == 3:
        return bucket_numbers(normalize_whitespace(x))
    return normalize_whitespace(x) if code == 4 else x


def preset_name(code: int) -> str:
    return next((n.upper() for n, c in PRESETS.items() if c == code), "UNKNOWN")


_WS = r"trim(regexp_replace({x}, '[ \t\n\r\x0B\f]+', ' ', 'g'))"


def canon_sql(x: str, preset: str) -> str:
    """DuckDB spelling of the presets."""
    ws = _WS.format(x=x)
    if preset == "general":
        return ws
    if preset == "policy":
        return f"regexp_replace({ws}, '[0-9]+', '<N>', 'g')"
    if preset == "uuid":
        return f"regexp_replace({x}, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}', '', 'g')"
    if preset == "code":
        camel = f"regexp_replace({ws}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
        return f"translate(regexp_replace(regexp_replace({camel}, '([A-Za-z0-9])_([A-Za-z0-9])', '\\1 \\2', 'g'), '([A-Za-z0-9])_([A-Za-z0-9])', '\\1 \\2', 'g'), '{_UPPER}', '{_LOWER}')"
    if preset == "support":
        date = "[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:Z|[+-][0-9]{2}:[0-9]{2})?)?"
        # a bell marks what was taken out, so that no new match arises where two ends meet
        marked = f"regexp_replace({ws}, '(^|[^0-9]){date}', '\\1' || chr(7), 'g')"
        for _ in range(2):
            marked = f"regexp_replace({marked}, '(^|[^0-9])[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}($|[^0-9])', '\\1' || chr(7) || '\\2', 'g')"
        for _ in range(2):
            marked = f"regexp_replace({marked}, '(^|[^0-9A-Za-z])[0-9]{{10}}($|[^0-9A-Za-z])', '\\1' || chr(7) || '\\2', 'g')"
        uuid = f"regexp_replace(replace({marked}, chr(7), ''), '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}', '', 'g')"
        return _WS.format(x=f"regexp_replace({uuid}, '[0-9]+', '<N>', 'g')")
    raise ValueError(preset)
