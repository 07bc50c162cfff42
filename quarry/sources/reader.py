"""Reading documents whose fields come as lists of texts, against what each field must hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What can be wrong with a field of a document.
MISSING, MULTIPLE, MALFORMED = "missing", "multiple", "malformed"


@dataclass(frozen=True)
class Need:
    """What a field holds: ``type`` of each value, whether there must be one, and whether there may be more."""

    type: str = "string"
    required: bool = True
    many: bool = False


def _values(rows: DataFrame, name: str) -> Column:
    """The values of a field without nulls; none where the column is absent or null."""
    if name not in rows.columns:
        return F.array().cast("array<string>")
    value = F.col(name)
    if not rows.schema[name].dataType.typeName() == "array":
        value = F.array(value)
    return F.coalesce(F.filter(value.cast("array<string>"), lambda v: v.isNotNull()), F.array().cast("array<string>"))


def _typed(values: Column, type_: str) -> Column:
    """The values as what they should be, null where they can't."""
    return F.transform(values, lambda v: v.try_cast(type_))


def read(rows: DataFrame, needs: dict[str, Need], id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Documents that hold what they must, with typed columns, and what is wrong with the others.

    The first table has ``id_col`` and a column for each field: an array where
    it may hold several values, else one value or null. The second has
    ``id_col``, field, problem (missing, multiple or malformed) and found, the
    number of values; a document may have several. One bad document doesn't
    stop the rest. Rows that repeat are read alike; other columns are left out;
    an empty table gives empty tables.
    """
    faults, columns = [], []
    for name, need in needs.items():
        values = _values(rows, name)
        typed = _typed(values, need.type)
        fault = F.lit(None).cast("string")
        fault = F.when(F.exists(typed, lambda v: v.isNull()), MALFORMED).otherwise(fault)
        if not need.many:
            fault = F.when(F.size(values) > 1, MULTIPLE).otherwise(fault)
        if need.required:
            fault = F.when(F.size(values) == 0, MISSING).otherwise(fault)
        faults.append(F.struct(F.lit(name).alias("field"), fault.alias("problem"), F.size(values).alias("found")))
        columns.append((typed if need.many else F.get(typed, F.lit(0))).alias(name))
    read_ = rows.select(F.col(id_col), *columns, F.filter(F.array(*faults), lambda f: f["problem"].isNotNull()).alias("__faults"))
    good = read_.filter(F.size("__faults") == 0).drop("__faults")
    return good, read_.select(id_col, F.inline("__faults"))
