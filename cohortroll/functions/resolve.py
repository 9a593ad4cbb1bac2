"""Plan-time column resolution. Works on column names only and never reads data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame

# Accepted spellings per canonical column, in order of preference.
ALIASES: dict[str, tuple[str, ...]] = {
    "cell_id": ("cell_id", "cell", "barcode", "cell_barcode", "event_id"),
    "subject_id": ("subject_id", "donor_id", "subject", "individual", "user_id"),
    "sample_unit_id": ("sample_unit_id", "tube_id", "sample_id", "sample"),
    "cell_type": ("cell_type", "celltype", "cell_label", "event_type"),
    "age": ("age", "age_years", "donor_age"),
    "sex": ("sex", "gender"),
    "batch": ("batch", "batch_id"),
}


def canonical(name: str) -> str:
    """Letters a-z and digits of the name, in lower case: spellings that differ in nothing else are the same."""
    return "".join(c for c in str(name).lower() if c.isascii() and c.isalnum())


def resolve_column(
    columns: Sequence[str], requested: str, aliases: Mapping[str, Sequence[str]] | None = None
) -> str | None:
    """Exact name, else the same canonical name, else an alias; ``None`` when nothing fits."""
    if requested in columns:
        return requested
    by_canon: dict[str, str] = {}
    for column in columns:
        by_canon.setdefault(canonical(column), column)
    for name in (requested, *(aliases or {}).get(requested, ())):
        if canonical(name) in by_canon:
            return by_canon[canonical(name)]
    return None


def first_existing(columns: Sequence[str], candidates: Iterable[str | None]) -> str | None:
    return next((c for c in candidates if c and c in columns), None)


def require_columns(columns: Sequence[str], required: Iterable[str], context: str) -> None:
    missing = sorted(set(required).difference(columns))
    if missing:
        raise KeyError(f"{context}: missing columns {missing}")


def explicit_or_fallback(
    columns: Sequence[str], configured: str | None, fallbacks: Sequence[str], role: str
) -> str:
    """A configured column must exist; only without one may a fallback be used."""
    if configured:
        if configured not in columns:
            raise KeyError(f"Configured {role} column {configured!r} is absent.")
        return configured
    found = first_existing(columns, fallbacks)
    if found is None:
        raise KeyError(f"No {role} column among {list(fallbacks)}.")
    return found


def pick_roles(columns: Sequence[str], configured: Mapping[str, str] | None = None) -> dict:
    configured = configured or {}
    roles = ("age", "sample_unit_id", "subject_id", "cell_type", "sex")
    return {r: explicit_or_fallback(columns, configured.get(r), ALIASES[r], r) for r in roles}


def present_covariates(
    columns: Sequence[str], configured: Sequence[str] | None, defaults: Sequence[str] = ()
) -> list[str]:
    """The model's covariates in order. A configured list is taken at its word, so each must exist; of
    the defaults those that exist are used. Neither may name one twice."""
    found: dict[str, bool] = {}
    for name in defaults if configured is None else configured:
        if name in found:
            raise ValueError(f"covariate {name!r} is listed more than once")
        found[name] = name in columns
    if configured is not None and not all(found.values()):
        raise KeyError(f"no column for covariates {[name for name, there in found.items() if not there]}")
    return [name for name, there in found.items() if there]


def standardise_headers(
    df: DataFrame, renames: Mapping[str, str] | None = None,
    aliases: Mapping[str, Sequence[str]] = ALIASES,
) -> DataFrame:
    """User renames first, then alias groups; an existing target is never overwritten."""
    mapping, columns = {}, list(df.columns)
    for source, target in (renames or {}).items():
        found = resolve_column(columns, source)
        if found and target not in columns:
            mapping[found] = target
            columns[columns.index(found)] = target
    for target, names in aliases.items():
        if target in columns:
            continue
        by_canon = {canonical(c): c for c in reversed(columns)}
        found = next((by_canon[canonical(n)] for n in names if canonical(n) in by_canon), None)
        if found:
            original = next((k for k, v in mapping.items() if v == found), found)
            mapping[original] = target
            columns[columns.index(found)] = target
    return df.withColumnsRenamed(mapping)


def require_disjoint_lists(primary: Sequence[str], exploratory: Sequence[str]) -> None:
    """Analysis lists: no repeats inside either and no overlap between them."""
    for name, values in (("primary", primary), ("exploratory", exploratory)):
        if len(set(values)) != len(values):
            raise ValueError(f"{name} list has repeats")
    both = sorted(set(primary) & set(exploratory))
    if both:
        raise ValueError(f"types in both lists: {both}")
    if not primary:
        raise ValueError("the primary list is empty")
