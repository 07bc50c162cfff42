"""The query language: fields, filters, queries and their JSON form."""

from __future__ import annotations

import json
from dataclasses import dataclass
from dataclasses import field as default

from quarry.errors import InvalidQuery


@dataclass(frozen=True)
class Field:
    """A searchable field: its column, the side of the block join it belongs to, and how it is compared.

    ``kind`` is string, int, enum, strings (many values) or the name of a text analysis.
    """

    name: str
    column: str
    parent: bool
    child: bool
    kind: str = "string"
    facetable: bool = True

    @property
    def is_text(self) -> bool:
        return self.kind in ("source_text", "name_text", "type_text")


_FIELDS = (
    Field("Id", "id", True, True, facetable=False),
    Field("ChildId", "id", False, True, facetable=False),
    Field("DocKind", "doc_kind", True, True, "enum"),
    Field("Command", "command", True, False),
    Field("SourceCodeBefore", "src_before", True, False, facetable=False),
    Field("SourceCode", "src", True, False, "source_text", facetable=False),
    Field("SourceCodeAfter", "src_after", True, False, facetable=False),
    Field("SourceTheory", "theory", True, False, "name_text"),
    Field("SourceTheoryFacet", "theory_facet", True, False),
    Field("StartLine", "start_line", True, False, "int"),
    Field("Kind", "kind", False, True, "enum"),
    Field("Name", "name", False, True, "name_text"),
    Field("NameFacet", "name_facet", False, True),
    Field("ConstantType", "type", False, True, "type_text"),
    Field("ConstantTypeFacet", "type_facet", False, True),
    Field("Uses", "uses", False, True, "strings", facetable=False),
    Field("Children", "children", True, False, "children", facetable=False),
)
FIELDS = {f.name: f for f in _FIELDS}
#: Values of the enum fields.
ENUMS = {"doc_kind": ("Parent", "Child"), "kind": ("Type", "Constant", "Fact")}


def field(name: str) -> Field:
    """A field by name; an unknown one is an invalid query."""
    if name not in FIELDS:
        raise InvalidQuery(f"no field {name}")
    return FIELDS[name]


class Filter:
    """A condition on one field."""


@dataclass(frozen=True)
class Term(Filter):
    """Text fields: any token occurs. Others: the whole value. ``*`` and ``?`` are wildcards."""

    inner: str


@dataclass(frozen=True)
class Exact(Filter):
    """Text fields: all tokens occur near one another. Others: the whole value, no wildcards."""

    inner: str


@dataclass(frozen=True)
class InRange(Filter):
    """A value between two, both included."""

    from_: int
    to: int


@dataclass(frozen=True)
class Not(Filter):
    """The field has a value and the filter doesn't match; of several values, none matches."""

    filter: Filter


@dataclass(frozen=True)
class And(Filter):
    """All filters match; of several values each may match another."""

    filters: tuple[Filter, ...]

    def __init__(self, *filters: Filter):
        object.__setattr__(self, "filters", filters)


@dataclass(frozen=True)
class Or(Filter):
    """One of the filters matches."""

    filters: tuple[Filter, ...]

    def __init__(self, *filters: Filter):
        object.__setattr__(self, "filters", filters)


@dataclass(frozen=True)
class InResult(Filter):
    """The value is among those that ``of_field`` has in the first 1000 documents of another query."""

    of_field: str
    filters: tuple[FieldFilter, ...]


@dataclass(frozen=True)
class FieldFilter:
    field: str
    filter: Filter


@dataclass(frozen=True)
class FilterQuery:
    """A ranked search, a page of ``page_size`` from ``cursor`` on."""

    filters: tuple[FieldFilter, ...] = ()
    page_size: int = 10
    cursor: str | None = None


@dataclass(frozen=True)
class FacetQuery:
    """Counts of blocks by value of each field; a field with ``max_facets`` values or more is left out."""

    filters: tuple[FieldFilter, ...] = ()
    fields: tuple[str, ...] = default(default=())
    max_facets: int = 100


def filter_to_json(f: Filter) -> dict:
    match f:
        case Term(inner) | Exact(inner):
            return {type(f).__name__: {"inner": inner}}
        case InRange(from_, to):
            return {"InRange": {"from": from_, "to": to}}
        case Not(inner):
            return {"Not": {"filter": filter_to_json(inner)}}
        case And(filters) | Or(filters):
            first, second, *rest = map(filter_to_json, filters)
            return {type(f).__name__: {"f1": first, "f2": second, "fn": rest}}
        case InResult(of_field, filters):
            return {"InResult": {"ofField": of_field, "query": {"filters": [field_filter_to_json(x) for x in filters]}}}
    raise InvalidQuery(f"not a filter: {f!r}")


def field_filter_to_json(f: FieldFilter) -> dict:
    return {"field": f.field, "filter": filter_to_json(f.filter)}


def query_to_json(q: FilterQuery | FacetQuery) -> str:
    """JSON with sorted keys and no nulls."""
    out: dict = {"filters": [field_filter_to_json(f) for f in q.filters]}
    if isinstance(q, FilterQuery):
        out |= {"pageSize": q.page_size} | ({} if q.cursor is None else {"cursor": q.cursor})
    else:
        out |= {"fields": list(q.fields), "maxFacets": q.max_facets}
    return json.dumps(out, sort_keys=True, ensure_ascii=False)


def _filter_from(x: object) -> Filter:
    if not isinstance(x, dict) or len(x) != 1:
        raise InvalidQuery(f"a filter is an object with one key: {x!r}")
    (kind, body), = x.items()
    try:
        match kind:
            case "Term" | "Exact":
                return (Term if kind == "Term" else Exact)(str(body["inner"]))
            case "InRange":
                return InRange(int(body["from"]), int(body["to"]))
            case "Not":
                return Not(_filter_from(body["filter"]))
            case "And" | "Or":
                return (And if kind == "And" else Or)(*map(_filter_from, [body["f1"], body["f2"], *body.get("fn", [])]))
            case "InResult":
                field(body["ofField"])
                return InResult(body["ofField"], _filters_from(body["query"]["filters"]))
    except (KeyError, TypeError, ValueError) as e:
        raise InvalidQuery(f"{kind}: {body!r}") from e
    raise InvalidQuery(f"no filter {kind}")


def _filters_from(xs: list) -> tuple[FieldFilter, ...]:
    return tuple(FieldFilter(field(x["field"]).name, _filter_from(x["filter"])) for x in xs)


def query_from_json(text: str) -> FilterQuery | FacetQuery:
    """Reads a query; page size, cursor and the number of facets have defaults."""
    try:
        x = json.loads(text)
        filters = _filters_from(x["filters"])
    except (ValueError, KeyError, TypeError) as e:
        raise InvalidQuery(text[:200]) from e
    if "fields" in x:
        return FacetQuery(filters, tuple(field(f).name for f in x["fields"]), int(x.get("maxFacets", 100)))
    return FilterQuery(filters, int(x.get("pageSize", 10)), x.get("cursor"))


# what a search form asks for


def any_of(filters: list[Filter]) -> Filter | None:
    """One filter for a list, by Or; None for an empty list."""
    return None if not filters else filters[0] if len(filters) == 1 else Or(*filters)


def all_of(filters: list[Filter]) -> Filter | None:
    """One filter for a list, by And; None for an empty list."""
    return None if not filters else filters[0] if len(filters) == 1 else And(*filters)


def matched(values: list[str], mode: str = "OneOf") -> Filter | None:
    """Values in a mode: OneOf, AllOf or Neither."""
    exact: list[Filter] = [Exact(v) for v in values]
    match mode:
        case "OneOf":
            return any_of(exact)
        case "AllOf":
            return all_of(exact)
        case "Neither":
            return None if not exact else Not(any_of(exact))
    raise InvalidQuery(f"no mode {mode}")


def next_mode(mode: str) -> str:
    modes = ["OneOf", "AllOf", "Neither"]
    return modes[(modes.index(mode) + 1) % 3]


def typed(term: str) -> Filter | None:
    """What a user typed: in quotes it is exact, empty it is nothing."""
    if not term:
        return None
    return Exact(term[1:-1]) if term.startswith('"') and term.endswith('"') and len(term) > 1 else Term(term)


def used_by(ids: list[str]) -> FieldFilter:
    """Blocks with a child that uses one of the ids."""
    return FieldFilter("Uses", any_of([Term(i) for i in ids]))


def uses_of(ids: list[str]) -> FieldFilter:
    """Blocks with a child that one of the ids uses."""
    return FieldFilter("ChildId", InResult("Uses", (FieldFilter("Id", any_of([Term(i) for i in ids])),)))


#: Facets of a search form: for drilling down, with at most 10 values each, and for its field searches, with at most 100.
DRILL_DOWN = ("Command", "SourceTheoryFacet", "Kind", "ConstantTypeFacet")
DRILL_DOWN_MAX, FIELD_SEARCH_MAX = 10, 100


def form_filters(term: str = "", searches: list[tuple[str, list[str], str]] = (), selected: dict[str, list[str]] | None = None, used_in: list[str] = (), uses: list[str] = ()) -> tuple[FieldFilter, ...]:
    """Filters of a search form: a typed term, field searches (field, values, mode), selected facet values, usage."""
    out = [FieldFilter("SourceCode", f)] if (f := typed(term)) else []
    out += [FieldFilter(name, f) for name, values, mode in searches if (f := matched(list(values), mode))]
    out += [FieldFilter(name, f) for name, values in (selected or {}).items() if (f := any_of([Exact(v) for v in values]))]
    return tuple([*out, *([used_by(list(used_in))] if used_in else []), *([uses_of(list(uses))] if uses else [])])
