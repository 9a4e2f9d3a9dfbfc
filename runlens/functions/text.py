"""Text fields: ``k=v`` notes, sanitised fields, warning kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD_MAX = 400


def tokens(note: Column) -> Column:
    """The ``k=v`` tokens of a note, in order."""
    return F.filter(F.split(note, r"\s+"), lambda t: F.contains(t, F.lit("=")))


def kv(note: Column, key: str) -> Column:
    """The value of the last ``key=`` token, null without one."""
    hits = F.filter(tokens(note), lambda t: F.startswith(t, F.lit(key + "=")))
    return F.substr(F.try_element_at(hits, F.lit(-1)), F.lit(len(key) + 2))


def kv_map(note: Column) -> Column:
    """All tokens as a map; the last token of a key wins."""
    t = tokens(note)
    name = lambda x: F.substring_index(x, "=", 1)
    kept = F.filter(t, lambda x, i: ~F.exists(F.slice(t, i + 2, F.greatest(F.size(t) - i - 1, F.lit(0))),
                                              lambda y: name(y) == name(x)))
    return F.map_from_entries(F.transform(
        kept, lambda x: F.struct(name(x), F.substr(x, F.length(name(x)) + 2))))


def attempt_of(text: Column) -> Column:
    """The number of the first ``attempt=N``, null without one."""
    return F.regexp_extract(text, r"attempt=(\d+)", 1).try_cast("long")


def clean_field(value: Column) -> Column:
    """A field that cannot break a tab-separated line."""
    return F.left(F.regexp_replace(value, r"[\t\r\n]", " "), F.lit(FIELD_MAX))


def warning_kind(text: Column) -> Column:
    """A warning's words before any detail, without numbers."""
    head = F.split(text, r" \(|: ", 2)[0]
    return F.trim(F.regexp_replace(F.regexp_replace(head, r"\d+", ""), r"\s+", " "))


def stage_token(result: Column, note: Column) -> Column:
    """One attempt as a history token: the failed stage, its functional test
    when that failed, its gate."""
    e2e = kv(note, "e2e")
    passed, total = F.split_part(e2e, F.lit("/"), F.lit(1)), F.split_part(e2e, F.lit("/"), F.lit(2))
    full = (passed == total) & ~passed.isin("", "0")
    shown = F.when(e2e.isNotNull() & (e2e != "") & ~full, F.concat(F.lit("e2e NOK:"), e2e))
    stage = F.coalesce(kv(note, "stage"), F.when(result != "", result), F.lit("?"))
    gate = F.concat(F.lit("gate="), kv(note, "shape-gate"))
    return F.when(result == "green", "green").otherwise(F.concat_ws(" ", stage, shown, gate))
