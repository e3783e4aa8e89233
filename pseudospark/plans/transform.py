"""Replacing columns of a table by pseudonyms, and back."""

import operator
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pseudospark.functions.generators import GENERATORS, with_affixes
from pseudospark.functions.text import is_blank, is_missing
from pseudospark.operators.catalog import unknown_namespaces
from pseudospark.operators.resolve import attach, text_bytes
from pseudospark.operators.store import BY_PSEUDONYM, MappingStore, observed, sizes_of
from pseudospark.schemas import MISSING_PLACEHOLDERS
from pseudospark.sources.files import Workspace


@dataclass(frozen=True)
class ColumnMapping:
    """``source`` is a column name (exact, first match) or a 0-based position.

    The namespace is fixed, or comes from the column named ``namespace_column`` if there is one. Without ``target`` the source is replaced
    in place, with it a column is appended.
    """

    source: str | int
    namespace: str | None = None
    target: str | None = None
    namespace_column: str | None = None


@dataclass(frozen=True)
class Result:
    """The transformed table and what was counted on the way. ``order_kept`` is false if rows were shuffled.

    ``df`` reads intermediate tables that hold values in the clear; ``release`` deletes them once ``df`` is written.
    """

    df: DataFrame
    rows: int
    missing: int
    order_kept: bool
    scratch: Workspace

    def release(self) -> None:
        self.scratch.release()


@dataclass(frozen=True)
class _Cell:
    """A mapping bound to positional columns."""

    source: str
    namespace: str | None
    namespace_column: str | None
    target: str | None

    @property
    def key(self):
        return (self.source, self.namespace, self.namespace_column)

    def namespace_value(self) -> Column:
        return F.lit(self.namespace) if self.namespace_column is None else _text(self.namespace_column)


def split_blank(requests: DataFrame, column: str = "original_value") -> tuple[DataFrame, DataFrame]:
    """Requests with a usable value, and the blank ones."""
    blank = is_blank(F.col(column))
    return requests.where(~blank), requests.where(blank)


def usable_mappings(mappings: Sequence[ColumnMapping]) -> list[ColumnMapping]:
    """Drop mappings without source or namespace; a blank target means in place; none left is an error."""

    def blank(text) -> bool:
        return text is None or not str(text).strip()

    kept = [
        ColumnMapping(m.source, m.namespace, None if blank(m.target) else m.target, m.namespace_column)
        for m in mappings
        if not blank(m.source) and not (blank(m.namespace) and blank(m.namespace_column))
    ]
    if not kept:
        raise ValueError("No usable column mapping: each needs a source column and a namespace.")
    return kept


def column_position(source: str | int, names: Sequence[str] | None) -> int:
    """Position of a source column: by exact name, or by 0-based number where there is no header."""
    if names is not None and isinstance(source, str):
        if source not in names:
            raise ValueError(f"The header has no column '{source}'.")
        return list(names).index(source)
    try:
        return int(source)
    except ValueError:
        raise ValueError(f"Without a header '{source}' must be a column number, counted from 0.") from None


def _positional(names: Sequence[str]) -> list[str]:
    return [f"_c{i}" for i in range(len(names))]


def _bind(mappings: Sequence[ColumnMapping], names: Sequence[str]) -> list[_Cell]:
    positions = _positional(names)

    def column(source) -> str:
        position = column_position(source, names)
        if not 0 <= position < len(positions):
            raise ValueError(f"Column index {position} is out of range.")
        return positions[position]

    bound = []
    replaced = set()
    for mapping in usable_mappings(mappings):
        source = column(mapping.source)
        if mapping.target is None and source in replaced:
            continue  # only the first in-place mapping of a column counts
        if mapping.target is None:
            replaced.add(source)
        if mapping.namespace_column is None:
            bound.append(_Cell(source, mapping.namespace, None, mapping.target))
        else:
            bound.append(_Cell(source, None, column(mapping.namespace_column), mapping.target))
    return bound


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _as_text(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A column's text, under a name of its own if the column is of another type."""
    if dict(df.dtypes)[name] == "string":
        return df, name
    return df.withColumn(f"__n{name}", _text(name)), f"__n{name}"


def _with_keys(df: DataFrame, cells: Sequence[_Cell], placeholders) -> DataFrame:
    """Add one key column per mapped source: its text, or null where the value is missing."""
    sources = dict.fromkeys(cell.source for cell in cells)
    return df.withColumns({f"__k{s}": F.when(~is_missing(_text(s), placeholders), _text(s)) for s in sources})


def _split_sources(df: DataFrame, cells: Sequence[_Cell]) -> set[str]:
    """Mapped columns that need not travel next to their own key: texts, and what is replaced in place by a text."""
    text = {name for name, kind in df.dtypes if kind == "string"}
    in_place = {c.source for c in cells if c.target is None}
    return {c.source for c in cells} & (text | in_place) - {c.namespace_column for c in cells}


def _without_copies(df: DataFrame, split: set[str]) -> DataFrame:
    """Leave in the split columns only what their key does not hold, so that a shuffle moves each text once."""
    return df.withColumns({s: F.when(F.col(f"__k{s}").isNull(), F.col(s)) for s in split}) if split else df


def _whole(name: str, split: set[str]) -> Column:
    """A source column as it came in; as text if it is replaced in place."""
    return F.coalesce(f"__k{name}", _text(name)) if name in split else F.col(name)


def requested_values(df: DataFrame, cells: Sequence[_Cell], placeholders) -> DataFrame:
    """(namespace, value, n) of all mapped cells; a missing cell counts under a null value.

    All mapped columns unpivot into one frame, so there is a single pass and aggregation however many mappings there are.
    """
    keyed = _with_keys(df, cells, placeholders)
    by_column = list(dict.fromkeys(c.namespace_column for c in cells if c.namespace_column))
    sources = {f"__cell{i}": s for i, s in enumerate(dict.fromkeys(c.source for c in cells))}
    flat = keyed.select(*by_column, *[F.col(f"__k{s}").alias(k) for k, s in sources.items()]).unpivot(
        by_column, list(sources), "cell", "value"
    )
    # A value is counted once by each source, however many namespaces it is looked up in.
    own = {s: F.count(F.when(F.col("cell") == k, 1)).alias(f"n{s}") for k, s in sources.items()}
    counted = flat.groupBy(*by_column, "value").agg(*own.values())
    asked: dict[tuple, list[_Cell]] = {}
    for cell in cells:
        asked.setdefault((cell.namespace, cell.namespace_column), []).append(cell)
    requests = [
        F.struct(
            same[0].namespace_value().alias("namespace_name"), reduce(operator.add, [F.col(f"n{c.source}") for c in same]).alias("n")
        )
        for same in asked.values()
    ]
    named = counted.select("value", F.explode(F.array(*requests)).alias("asked")).where("asked.n > 0")
    named = named.select("asked.namespace_name", "value", "asked.n")
    if not by_column or (len(asked) == 1 and len(by_column) == 1):
        return named
    # A column may name a namespace that another column, or a mapping, names too.
    return named.groupBy("namespace_name", "value").agg(F.sum("n").alias("n"))


def job_counters(df: DataFrame, mappings: Sequence[ColumnMapping], placeholders=MISSING_PLACEHOLDERS) -> DataFrame:
    """Rows, and mapped cells without a value, in one aggregation."""
    names = df.columns
    positional = df.toDF(*_positional(names))
    missing = [F.sum(is_missing(_text(c.source), placeholders).cast("long")) for c in _bind(mappings, names)]
    total = missing[0]
    for one in missing[1:]:
        total = total + one
    return positional.agg(
        F.count(F.lit(1)).alias("rows_processed"),
        F.coalesce(total, F.lit(0)).alias("missing_value_count"),
    )


def _fixed_settings(cells: Sequence[_Cell], catalog: DataFrame, store: MappingStore) -> dict[str, dict]:
    """Settings of the namespaces that the mappings name; as many rows as the caller wrote names."""
    wanted = sorted({c.namespace for c in cells if c.namespace_column is None})
    found = store.settings_of(catalog, wanted) if wanted else {}
    for name in wanted:
        if name not in found:
            raise ValueError(f"There is no namespace '{name}'.")
    return found


def _check_namespace_columns(counted: DataFrame, cells: Sequence[_Cell], catalog: DataFrame) -> None:
    if any(c.namespace_column is not None for c in cells):
        asked = counted.where(F.col("pseudonym_value").isNotNull())
        unknown = unknown_namespaces(asked, catalog).count()
        if unknown:
            # Their names are cell contents, which no error text may show; ``unknown_namespaces`` lists them.
            raise ValueError(f"{unknown} namespaces that the data name do not exist.")


def _fixed_namespaces(cells: Sequence[_Cell]) -> list[str] | None:
    """All namespaces in play, if the mappings name them."""
    if any(c.namespace_column is not None for c in cells):
        return None
    return sorted({c.namespace for c in cells})


def _resolve_cells(df, cells, mapping, keys, value, counts, limit, inline, sizes, by_row=None):
    """Add one resolved column per distinct (source, namespace); returns the frame, their columns and the order flag.

    ``sizes`` are the measured bytes of ``mapping`` by namespace, those of all of it under None. ``inline`` computes values of
    namespaces without a join, and ``by_row`` those of rows that name their own.
    """
    resolved = {}
    kept = True
    budget = limit  # for all broadcasts of this plan together
    for cell in cells:
        if cell.key in resolved:
            continue
        own_key = f"__k{cell.source}"
        if cell.namespace in inline:
            resolved[cell.key] = inline[cell.namespace](F.col(own_key))
            continue
        name = f"__r{len(resolved)}"
        if cell.namespace_column is None:
            own = mapping.where(F.col("namespace_name") == cell.namespace)
            own_counts = counts.where(F.col("namespace_name") == cell.namespace)
            size = sizes.get(cell.namespace, sizes.get(None, 0))
            df, in_order = attach(df, [own_key], own, keys[1:], value, name, own_counts, size, budget)
        elif by_row is not None:
            df, space = _as_text(df, cell.namespace_column)
            df, in_order, size = by_row(df, space, own_key, name), True, 0
        else:
            size = sizes.get(None, 0)
            df, space = _as_text(df, cell.namespace_column)
            df, in_order = attach(df, [space, own_key], mapping, keys, value, name, counts, size, budget)
        if in_order:
            budget -= size
        kept = kept and in_order
        resolved[cell.key] = F.col(name)
    return df, resolved, kept


def _assemble(df: DataFrame, names: Sequence[str], cells, split: set[str], final) -> DataFrame:
    """Source columns in their places, then the appended ones, under their real names."""
    in_place = {c.source: final(c) for c in cells if c.target is None}
    columns = [in_place[p] if p in in_place else _whole(p, split) for p in _positional(names)]
    appended = [c for c in cells if c.target is not None]
    columns += [final(c) for c in appended]
    frame = df.select(*[c.alias(f"_o{i}") for i, c in enumerate(columns)])
    return frame.toDF(*names, *[c.target for c in appended])


def _computable(settings: dict[str, dict]) -> dict:
    """The functions that compute the pseudonyms of deterministic namespaces."""

    def computed(s: dict, value: Column) -> Column:
        build = GENERATORS[s["pseudonym_generation_method"]].build
        text = build(value, F.lit(s["pseudonym_length"]))
        return with_affixes(text, F.lit(s["pseudonym_prefix"]).cast("string"), F.lit(s["pseudonym_suffix"]).cast("string"))

    return {
        name: (lambda value, s=s: computed(s, value))
        for name, s in settings.items()
        if s["pseudonym_generation_method"] in GENERATORS and GENERATORS[s["pseudonym_generation_method"]].deterministic
    }


def pseudonymize(
    df: DataFrame,
    mappings: Sequence[ColumnMapping],
    catalog: DataFrame,
    store: MappingStore,
    placeholders=MISSING_PLACEHOLDERS,
    batch_id: str | None = None,
) -> Result:
    """Replace mapped columns by their pseudonyms, storing the new ones first.

    ``df`` is read twice, once for its mapped columns and once for the result, and must give the same rows both times.
    """
    with store.workspace.kept_if_done() as scratch:
        return _pseudonymized(df, mappings, catalog, store, placeholders, batch_id, scratch)


def _pseudonymized(df, mappings, catalog, store, placeholders, batch_id, scratch) -> Result:
    names = df.columns
    cells = _bind(mappings, names)
    computable = _computable(_fixed_settings(cells, catalog, store))
    positional = df.toDF(*_positional(names))
    requested = requested_values(positional, cells, placeholders).withColumnRenamed("value", "original_value")
    asked = store.save_requests(requested, catalog, scratch)
    namespaces = _fixed_namespaces(cells)
    by_row = namespaces is None and store.computes(asked, catalog)
    upserted = store.upsert_requests(asked, catalog, scratch, batch_id, namespaces, computable, by_row)
    counts = asked.table.where(F.col("original_value").isNotNull())
    split = _split_sources(positional, cells)

    def computed(df: DataFrame, *columns: str) -> DataFrame:
        return store.with_computed(df, catalog, asked.methods, *columns)

    # First writer wins also against the hash: with one other pseudonym stored, a namespace joins like any other.
    inline = {name: build for name, build in computable.items() if name not in upserted.unlike}
    rest = computed if by_row and None not in upserted.unlike else None
    if all(c.namespace in inline if c.namespace_column is None else rest is not None for c in cells):
        scratch.release()  # nothing is looked up, so the result does not read the requests

    wide, resolved, kept = _resolve_cells(
        _without_copies(_with_keys(positional, cells, placeholders), split),
        cells,
        upserted.mappings,
        ["namespace_name", "original_value"],
        "pseudonym_value",
        counts,
        store.broadcast_bytes,
        inline,
        upserted.sizes,
        rest,
    )

    def final(cell: _Cell) -> Column:
        # A value that escaped the first reading must stop the job, not leak.
        escaped = F.raise_error(F.lit("A value has no pseudonym: the input changed while it was read."))
        known = F.coalesce(resolved[cell.key], escaped.cast("string"))
        return F.when(F.col(f"__k{cell.source}").isNull(), _text(cell.source)).otherwise(known)

    rows = upserted.cells // len(cells)
    return Result(_assemble(wide, names, cells, split, final), rows, upserted.missing, kept, scratch)


def depseudonymize(
    df: DataFrame,
    mappings: Sequence[ColumnMapping],
    catalog: DataFrame,
    store: MappingStore,
    placeholders=MISSING_PLACEHOLDERS,
) -> Result:
    """Replace pseudonyms in mapped columns by their originals; unknown ones stay as they are."""
    with store.workspace.kept_if_done() as scratch:
        return _depseudonymized(df, mappings, catalog, store, placeholders, scratch)


def _depseudonymized(df, mappings, catalog, store, placeholders, scratch) -> Result:
    names = df.columns
    cells = _bind(mappings, names)
    _fixed_settings(cells, catalog, store)
    positional = df.toDF(*_positional(names))
    seen, buckets = Observation(), store.buckets_of(BY_PSEUDONYM)
    requested = requested_values(positional, cells, placeholders).withColumnRenamed("value", "pseudonym_value")
    metrics = [
        F.sum("n").alias("cells"),
        F.sum(F.when(F.col("pseudonym_value").isNull(), F.col("n"))).alias("missing"),
        text_bytes("namespace_name", "pseudonym_value").alias("bytes"),
        *buckets.metrics(),
    ]
    counted = scratch.save(requested.observe(seen, *metrics), "requests")
    totals = observed(seen)
    _check_namespace_columns(counted, cells, catalog)

    counts = counted.where(F.col("pseudonym_value").isNotNull())
    namespaces = _fixed_namespaces(cells)
    wanted = buckets.wanted(totals)
    originals, stats = store.reverse_map(counts, totals.get("bytes", 0), scratch, namespaces, wanted)
    split = _split_sources(positional, cells)
    wide, resolved, kept = _resolve_cells(
        _without_copies(_with_keys(positional, cells, placeholders), split),
        cells,
        originals,
        ["namespace_name", "pseudonym_value"],
        "original_value",
        counts,
        store.broadcast_bytes,
        {},
        sizes_of(stats, namespaces),
    )

    def final(cell: _Cell) -> Column:
        return F.coalesce(resolved[cell.key], _whole(cell.source, split).cast("string"))

    rows = totals.get("cells", 0) // len(cells)
    return Result(_assemble(wide, names, cells, split, final), rows, totals.get("missing", 0), kept, scratch)
