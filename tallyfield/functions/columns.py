"""Column expressions for semi-structured cells, ratios and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY = "id bigint, name string, label string, type string, team_name string"


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def safe_double(c: Column) -> Column:
    """The number in a cell, or null; NaN is null."""
    return null_if_nan(c.cast("string").try_cast("double"))


def safe_long(c: Column) -> Column:
    return c.cast("string").try_cast("double").try_cast("bigint")


def truthy(c: Column) -> Column:
    """True for the texts true, 1 and 1.0 in any case, false for all else and null."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "1.0"), F.lit(False))


def flag_value(c: Column) -> Column:
    """1.0 for true, 0.0 for false, null for anything else."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text == "true", 1.0).when(text == "false", 0.0)


def is_flag_column(c: Column) -> Column:
    """Aggregate: all texts of a column are true or false, and there is one."""
    text = F.lower(F.trim(c.cast("string")))
    return F.coalesce(F.bool_and(text.isin("true", "false")), F.lit(False))


#: A quoted string with its escapes, a run of anything else, or a quote without its end.
LITERAL = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^'"]++|['"]"""


def literal_json(c: Column) -> Column:
    """A cell holding a Python literal as JSON text; JSON stays as it is.

    One scan tells strings from what is between them, and only there words are replaced.
    """

    def turned(part: Column) -> Column:
        for word, json in (("None", "null"), ("True", "true"), ("False", "false")):
            part = F.regexp_replace(part, rf"\b{word}\b", json)
        return part

    quoted = lambda p: F.substring(p, 1, 1).isin("'", '"')
    parts = F.regexp_extract_all(c, F.lit(LITERAL), 0)
    return F.array_join(F.transform(parts, lambda p: F.when(quoted(p), p).otherwise(turned(p))), "")


def entity(c: Column) -> Column:
    """The struct in a cell like {'id': 7, 'name': 'Ana'}."""
    return F.from_json(literal_json(c), ENTITY)


def entity_name(c: Column) -> Column:
    """Name, label, type or team name of an entity cell; a plain text is its own name."""
    plain = F.when(~F.startswith(F.ltrim(c), F.lit("{")), c)
    return F.coalesce(entity(c)["name"], entity(c)["label"], entity(c)["type"], entity(c)["team_name"], plain)


def entity_id(c: Column) -> Column:
    return F.coalesce(entity(c)["id"], safe_long(c))


def point(c: Column) -> tuple[Column, Column]:
    """x and y of a cell like [61.0, 40.1]; null for fewer than two numbers."""
    values = F.from_json(c, "array<double>")
    return tuple(F.when(F.size(values) >= 2, F.get(values, F.lit(i))) for i in (0, 1))


def id_list(c: Column) -> Column:
    """The ids in a cell like ['a', 'b']; null where there is none."""
    return F.from_json(c, "array<string>")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def per90(total: Column, minutes: Column) -> Column:
    return F.when(minutes > 0, total / minutes * 90)


def whole_div(part: Column, whole: Column) -> Column:
    """Division of whole numbers without remainder."""
    return F.call_function("div", part, whole)


def named(column: str) -> str:
    """A column's name in an SQL expression."""
    return "`" + column.replace("`", "``") + "`"


def text(value: str) -> str:
    """A text in an SQL expression."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sum_or_zero(*cols: Column) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in cols))


#: Doubles are added up in whole steps of so many a unit, and what is left of them apart; those of MOST and more are left whole.
SUM_STEPS, SUM_MOST = 1_000_000, 1e9


def _whole_and_rest(c: Column) -> tuple[Column, Column]:
    """Aggregates: the sum of the whole steps nearest to the values, which is exact, and that of what is left, which is none for values of up to six places."""
    near = F.when(F.abs(c) < SUM_MOST, F.rint(c * SUM_STEPS)).otherwise(0.0)
    whole = near.cast("long")
    # Units and steps are added apart, so that neither outgrows its type.
    units = F.sum(whole_div(whole, F.lit(SUM_STEPS))).cast("decimal(20,0)")
    return (units * SUM_STEPS + F.sum(whole % SUM_STEPS)).cast("double"), F.sum(c - near / SUM_STEPS)


def exact_sum(c: Column) -> Column:
    """Aggregate: the sum of doubles, null if all are; the order of rows does not change that of values of up to six places below SUM_MOST.

    Of other values the order can change what is left of them, which is added as doubles: below 10^-6 a value, and all of it from SUM_MOST on.
    """
    whole, rest = _whole_and_rest(c)
    return whole / SUM_STEPS + rest


def exact_mean(c: Column) -> Column:
    """Aggregate: the mean of doubles, likewise; equal means of values of up to six places are the same double, whatever they are means of."""
    whole, rest = _whole_and_rest(c)
    n = F.nullif(F.count(c), F.lit(0))
    return whole / (n * SUM_STEPS) + rest / n


def round4(c: Column, places: int | None = 4) -> Column:
    """To four places, or so many, ties to even; None leaves the value."""
    return c if places is None else F.bround(c, places)


#: Scores lie on a grid of so many steps a point, weights on one of so many a unit; sums of such whole numbers are exact.
STEPS, WEIGHT_STEPS = 1_000_000, 1_000_000


def steps(score: Column) -> Column:
    """A score in whole steps of its grid."""
    return F.round(score * STEPS).cast("long")


def weight_steps(weight: float) -> int:
    return round(weight * WEIGHT_STEPS)


def from_steps(whole: Column) -> Column:
    return whole / F.lit(float(STEPS))


def weighted_mean(pairs: list[tuple[Column, float]]) -> Column:
    """Mean of scores on the grid, rounded to it (halves up); weights are renormalised over the cells that are not null, null if none is."""
    top = reduce(lambda a, b: a + b, (F.coalesce(steps(c) * weight_steps(w), F.lit(0)) for c, w in pairs))
    low = reduce(lambda a, b: a + b, (F.when(c.isNotNull(), weight_steps(w)).otherwise(0) for c, w in pairs))
    return F.when(low > 0, from_steps(whole_div(2 * top + low, F.greatest(F.lit(1), 2 * low))))


def weighted_sum(pairs: list[tuple[Column, float]]) -> Column:
    """Plain weighted sum of scores on the grid, rounded to it (halves up); null if any cell is."""
    top = reduce(lambda a, b: a + b, (steps(c) * weight_steps(w) for c, w in pairs))
    return from_steps(whole_div(2 * top + WEIGHT_STEPS, F.lit(2 * WEIGHT_STEPS)))


def entity_key(*parts: Column) -> Column:
    return F.concat_ws("||", *[F.trim(p) for p in parts])


def season_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d{4}_\d{4})", 1)


def name_part(value: str) -> str:
    """How a value appears in a column name."""
    return value.lower().replace(" ", "_").replace("-", "_")


def turnover_part(value: str) -> str:
    return value.lower().replace(" ", "_").replace(":", "")


def repair_mojibake(c: Column) -> Column:
    """Text that was UTF-8 read as Latin-1, read again; left alone unless it shows the signs and converts cleanly."""
    signs = F.contains(c, F.lit("Ã")) | F.contains(c, F.lit("Â")) | F.contains(c, F.lit("�"))
    narrow = ~c.rlike(r"[^\x{0}-\x{FF}]")
    safe = F.when(signs & narrow, c).otherwise("")
    raw = F.encode(safe, "ISO-8859-1")
    return F.when(signs & narrow & F.is_valid_utf8(raw.cast("string")), F.try_validate_utf8(raw.cast("string"))).otherwise(c)
