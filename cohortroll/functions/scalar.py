"""Scalar column expressions. Each stays inside code generation; none needs Python workers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS = ("true", "1", "yes")
TRUE_WORDS_WIDE = ("true", "1", "yes", "y", "on")
MITO_PREFIX = "MT-"
RIBO_PATTERN = "^RP[LS]"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col: str | Column) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(F.trim(_c(col).cast("string")), F.lit(""))


def is_present(col: str | Column) -> Column:
    """Neither null, blank nor the text "nan"."""
    text = F.trim(_c(col).cast("string"))
    return F.coalesce((text != "") & (F.lower(text) != "nan"), F.lit(False))


def to_number(col: str | Column) -> Column:
    """Number or null; bad text never fails the job."""
    return F.trim(_c(col).cast("string")).try_cast("double")


def finite_or_null(col: str | Column) -> Column:
    value = _c(col).cast("double")
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~bad, value)


def text_to_bool(col: str | Column, words: Sequence[str] = TRUE_WORDS) -> Column:
    return F.coalesce(F.lower(F.trim(_c(col).cast("string"))).isin(*words), F.lit(False))


def join_key_text(*parts: str | Column, sep: str = "::") -> Column:
    """Parts joined by ``sep``; blank and null parts are left out."""
    return F.concat_ws(sep, *[clean_text(p) for p in parts])


def effect_direction(col: str | Column) -> Column:
    """-1, 0 or 1; null, NaN and zero give 0."""
    return F.coalesce(F.signum(finite_or_null(col)).cast("int"), F.lit(0))


def direction_label(col: str | Column) -> Column:
    return F.when(_c(col) > 0, "increase_with_age").otherwise("decrease_with_age")


def interval_excludes_zero(low: str | Column, high: str | Column) -> Column:
    lo, hi = finite_or_null(low), finite_or_null(high)
    return F.coalesce((lo > 0) | (hi < 0), F.lit(False)) & lo.isNotNull() & hi.isNotNull()


def age_bin(col: str | Column, edges: Sequence[float]) -> Column:
    """``[a,b)`` bins over sorted distinct edges; outside (the last edge included) is null."""
    cuts = sorted(set(edges))
    value, out = _c(col), F.lit(None).cast("string")
    for low, high in reversed(list(zip(cuts, cuts[1:]))):
        out = F.when((value >= low) & (value < high), f"{low:g}-{high:g}").otherwise(out)
    return out


def age_bin_order(col: str | Column, edges: Sequence[float]) -> Column:
    cuts = sorted(set(edges))
    value, out = _c(col), F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        out = F.when((value >= low) & (value < high), i).otherwise(out)
    return out


def age_decade_floor(col: str | Column) -> Column:
    return (F.floor(_c(col) / 10) * 10).cast("int")


def log_normalise(count: str | Column, total: str | Column, target: float) -> Column:
    """``log1p(count * target / total)``; a cell without counts stays at 0."""
    scaled = F.try_divide(_c(count) * F.lit(float(target)), _c(total).cast("double"))
    return F.coalesce(F.log1p(scaled), F.lit(0.0))


def gene_flags(gene: str | Column) -> tuple[Column, Column]:
    upper = F.upper(_c(gene))
    return upper.startswith(MITO_PREFIX), upper.rlike(RIBO_PATTERN)


def pretty_label(col: str | Column, overrides: Mapping[str, str] | None = None) -> Column:
    """Override if given, else underscores to spaces and title case."""
    base = F.initcap(F.replace(_c(col), F.lit("_"), F.lit(" ")))
    for key, label in (overrides or {}).items():
        base = F.when(_c(col) == key, label).otherwise(base)
    return base


def path_label(col: str | Column) -> Column:
    """Letters, digits, dot and dash kept; every other run becomes one underscore."""
    cleaned = F.regexp_replace(_c(col), "[^A-Za-z0-9.-]+", "_")
    return F.regexp_replace(cleaned, "^_+|_+$", "")


def matches_keywords(col: str | Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    name = F.lower(_c(col))
    hit = F.lit(not include)
    for word in include:
        hit = hit | F.contains(name, F.lit(word.lower()))
    for word in exclude:
        hit = hit & ~F.contains(name, F.lit(word.lower()))
    return hit


def split_cell_name(col: str | Column) -> tuple[Column, Column]:
    """``SAMPLE_BARCODE`` at the first underscore; without one the barcode is null."""
    name = _c(col)
    at = F.instr(name, "_")
    sample = F.when(at > 0, F.substring(name, F.lit(1), at - 1)).otherwise(name)
    barcode = F.when(at > 0, F.substring(name, at + 1, F.length(name)))
    return sample, barcode


def nth_token(col: str | Column, delimiter: str, index: int) -> Column:
    """Token ``index`` (from 0), or the whole text when there are fewer tokens."""
    tokens = F.split(_c(col), "\\Q" + delimiter + "\\E")
    return F.coalesce(F.try_element_at(tokens, F.lit(index + 1)), _c(col))


def sorted_json(mapping: Column) -> Column:
    """JSON text of a map with keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(mapping))))


def scenario_name(adjust: Column, drop_sparse: Column, min_cells: Column) -> Column:
    return F.format_string(
        "adj_%d__drop_sparse_%d__min_cells_%d",
        adjust.cast("int"), drop_sparse.cast("int"), min_cells.cast("int"),
    )


def scenario_code(adjust: Column, drop_sparse: Column, min_cells: Column) -> Column:
    return F.format_string(
        "A%d|D%d|M%d", adjust.cast("int"), drop_sparse.cast("int"), min_cells.cast("int")
    )


def hash_int(*parts: str | Column) -> Column:
    """First 15 hex digits of md5 as a number: the same draw on any engine and any layout."""
    text = F.concat_ws("|", *[(_c(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
