"""Types, terms and proofs: trees that come as JSON, flattened to tables of nodes.

A tree is an object with ``ctor``, ``name`` where it has one, ``index`` for
numbered names, ``sorts`` for variables, and its children in ``args``.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# what runs on executors travels with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Constructors whose name is a reference of each kind. All others only pass on what is below them.
CONSTRUCTORS = {"Type": ("TypeTyp", "Sort"), "Constant": ("Const",), "Fact": ("PAxm", "Oracle", "PThm")}
_NODES = "root string, node int, parent int, ctor string, name string"


def flatten(trees: DataFrame, root: str = "root", tree: str = "tree") -> DataFrame:
    """One row for each node: root, node (numbered in preorder from 0), parent, ctor and name.

    A sort of a variable is a node of its own. Null trees have no nodes.
    """
    rows = trees.select(F.col(root).cast("string").alias("root"), F.col(tree).alias("tree"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r, text in zip(pdf["root"], pdf["tree"], strict=True):
                stack = [(json.loads(text), None)] if text else []
                number = 0
                while stack:
                    x, parent = stack.pop()
                    out.append((r, number, parent, x["ctor"], x.get("name")))
                    below = [*x.get("args", []), *({"ctor": "Sort", "name": s} for s in x.get("sorts", []))]
                    stack += [(c, number) for c in reversed(below)]
                    number += 1
            yield pd.DataFrame(out, columns=["root", "node", "parent", "ctor", "name"]).astype({"parent": "Int32"})

    return rows.mapInPandas(run, _NODES)


def referring(nodes: DataFrame) -> DataFrame:
    """What each root refers to, once for each node that does: root, kind (Type, Constant or Fact) and name."""
    kind = F.lit(None).cast("string")
    for k, ctors in CONSTRUCTORS.items():
        kind = F.when(F.col("ctor").isin(*ctors), k).otherwise(kind)
    return nodes.select("root", kind.alias("kind"), "name").filter("kind is not null and name is not null")


def references(nodes: DataFrame) -> DataFrame:
    """What each root refers to: root, kind (Type, Constant or Fact) and name, each once."""
    return referring(nodes).distinct()


def _name(x: dict) -> str:
    index = x.get("index", 0)
    return x["name"] if not index else f"{x['name']}{index}"


def _sorts(x: dict) -> str:
    sorts = x.get("sorts", [])
    return "" if not sorts else f" :: {sorts[0]}" if len(sorts) == 1 else " :: {" + ", ".join(sorts) + "}"


def printed(x: dict) -> str:
    """A type as people write it: functions with arrows, arguments before their constructor, sorts behind variables."""
    if x["ctor"] != "TypeTyp":
        return _name(x) + _sorts(x)
    args = x.get("args", [])
    is_function = lambda t: t["ctor"] == "TypeTyp" and t["name"] == "fun" and bool(t.get("args"))
    if x["name"] == "fun":
        if len(args) < 2:
            return " ⇒ ".join(["()", *map(printed, args)])
        return " ⇒ ".join([*(f"({printed(a)})" if is_function(a) else printed(a) for a in args[:-1]), printed(args[-1])])
    if not args:
        return x["name"]
    if len(args) > 1:
        return f"({', '.join(map(printed, args))}) {x['name']}"
    a = args[0]
    compound = bool(a.get("args")) if a["ctor"] == "TypeTyp" else len(a.get("sorts", [])) == 1
    return f"({printed(a)}) {x['name']}" if compound else f"{printed(a)} {x['name']}"


def pretty(tree: Column) -> Column:
    """A column of types as text; null stays null."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else printed(json.loads(x)))

    return run(tree)
