"""Record reshaping steps, as Column expressions.

These cover what the reference's users do with jq on JSON output — set a
field, regex-replace, filter, reshape, append, delete, to-number, extract
one value — but run before the write, inside Spark's plan (filters become
real predicates and push down). A jq interpreter is not built: steps are
given as objects (or dicts in a job document).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferry.functions.columns import col
from ferry.sources.readers import SOURCE_COLS


def _get(df: DataFrame, name: str) -> Column:
    """A column of that name, else the struct field the dotted path leads to.

    A missing field reads as NULL, as ``.missing`` does in jq (typed as
    text, so every sink can write the column)."""
    if name in df.columns:
        return col(name)
    head, *path = name.split(".")
    if path and head in df.columns:
        kind, c = df.schema[head].dataType, col(head)
        for part in path:
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return F.lit(None).cast("string")
            kind, c = kind[part].dataType, c.getField(part)
        return c
    return F.lit(None).cast("string")


def _data_cols(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in SOURCE_COLS]


def _hidden(df: DataFrame) -> list[Column]:
    return [col(c) for c in SOURCE_COLS if c in df.columns]


class Step:
    raw_lines = False

    def apply(self, df: DataFrame) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError


@dataclass(frozen=True)
class SetField(Step):
    """``.name = value``"""
    name: str
    value: Any

    def apply(self, df):
        return df.withColumn(self.name, F.lit(self.value))


@dataclass(frozen=True)
class ReplaceRegex(Step):
    """``.f = (.f | gsub(pattern; replacement))``; NULL stays NULL."""
    field: str
    pattern: str
    replacement: str = ""

    def apply(self, df):
        # a bad pattern must fail here, where the failure policy sees it, not in a task
        try:
            df.sparkSession._jvm.java.util.regex.Pattern.compile(self.pattern)
        except Exception as e:  # noqa: BLE001 - py4j wraps the syntax error
            raise ValueError(f"not a regular expression: {self.pattern!r}") from e
        repl = self.replacement.replace("\\", "\\\\").replace("$", "\\$")
        return df.withColumn(self.field,
                             F.regexp_replace(_get(df, self.field).cast("string"),
                                              self.pattern, repl))


@dataclass(frozen=True)
class Where(Step):
    """``select(.f OP value)`` with jq's null rules.

    ``== null`` / ``!= null`` test presence; ``==`` / ``!=`` against a value
    are null-safe; null sorts before every value for ``<``, ``<=``, ``>``, ``>=``.
    """
    field: str
    op: str
    value: Any = None

    def condition(self, df: DataFrame) -> Column:
        c = _get(df, self.field)
        v = self.value
        if self.op == "==":
            return c.isNull() if v is None else c.eqNullSafe(F.lit(v))
        if self.op == "!=":
            return c.isNotNull() if v is None else ~c.eqNullSafe(F.lit(v))
        if v is None:
            raise ValueError(f"ordering against null: {self.op}")
        if self.op == "<":
            return c.isNull() | (c < F.lit(v))
        if self.op == "<=":
            return c.isNull() | (c <= F.lit(v))
        if self.op == ">":
            return c.isNotNull() & (c > F.lit(v))
        if self.op == ">=":
            return c.isNotNull() & (c >= F.lit(v))
        raise ValueError(f"unknown operator {self.op!r}")

    def apply(self, df):
        return df.where(self.condition(df))


@dataclass(frozen=True)
class Reshape(Step):
    """``{new: .old, ...}``; a missing source field gives NULL."""
    fields: dict

    def apply(self, df):
        return df.select([_get(df, old).alias(new) for new, old in self.fields.items()]
                         + _hidden(df))


@dataclass(frozen=True)
class Append(Step):
    """``.f |= (. + "text")``; NULL + text = text."""
    field: str
    suffix: str

    def apply(self, df):
        return df.withColumn(self.field, F.concat(
            F.coalesce(_get(df, self.field).cast("string"), F.lit("")), F.lit(self.suffix)))


@dataclass(frozen=True)
class Delete(Step):
    """``del(.a, .b)``"""
    fields: tuple

    def apply(self, df):
        return df.drop(*[f for f in self.fields if f in df.columns])


@dataclass(frozen=True)
class ToNumber(Step):
    """``.f = (.f | tonumber)``: text → double.

    A value that is not a number gives NULL; with ``strict`` it fails the
    job instead (checked per row on the executors, no extra pass).
    """
    field: str
    strict: bool = False

    def apply(self, df):
        src = _get(df, self.field)
        num = F.expr(f"try_cast({'`' + self.field.replace('`', '``') + '`'} AS DOUBLE)") \
            if self.field in df.columns else F.lit(None).cast("double")
        if self.strict:
            num = F.when(src.isNotNull() & num.isNull(),
                         F.raise_error(F.concat(F.lit(f"{self.field}: not a number: "),
                                                src.cast("string")))).otherwise(num)
        return df.withColumn(self.field, num)


@dataclass(frozen=True)
class Extract(Step):
    """``.f``: one bare JSON value per record (written as raw lines)."""
    field: str
    raw_lines = True

    def apply(self, df):
        js = F.to_json(F.array(_get(df, self.field)))
        value = F.expr("substring(_j, 2, length(_j) - 2)")
        return df.select(js.alias("_j"), *_hidden(df)).select(value.alias("value"),
                                                             *_hidden(df))


@dataclass(frozen=True)
class Chain(Step):
    steps: tuple = field(default_factory=tuple)

    @property
    def raw_lines(self):  # type: ignore[override]
        return bool(self.steps) and self.steps[-1].raw_lines

    def apply(self, df):
        for s in self.steps:
            df = s.apply(df)
        return df


def step_from_dict(d: dict) -> Step:
    """``{"set": {"k": v}}``, ``{"gsub": {...}}``, ``{"select": {...}}``,
    ``{"reshape": {...}}``, ``{"append": {...}}``, ``{"delete": [...]}``,
    ``{"tonumber": {...}}``, ``{"extract": "f"}``."""
    if len(d) != 1:
        raise ValueError(f"a step has exactly one key: {d}")
    (kind, arg), = d.items()
    if kind == "set":
        return Chain(tuple(SetField(k, v) for k, v in arg.items()))
    if kind == "gsub":
        return ReplaceRegex(arg["field"], arg["pattern"], arg.get("replacement", ""))
    if kind == "select":
        return Where(arg["field"], arg.get("op", "=="), arg.get("value"))
    if kind == "reshape":
        return Reshape(dict(arg))
    if kind == "append":
        return Append(arg["field"], arg["suffix"])
    if kind == "delete":
        return Delete(tuple([arg] if isinstance(arg, str) else arg))
    if kind == "tonumber":
        if isinstance(arg, str):
            return ToNumber(arg)
        return ToNumber(arg["field"], bool(arg.get("strict", False)))
    if kind == "extract":
        return Extract(arg if isinstance(arg, str) else arg["field"])
    raise ValueError(f"unknown step {kind!r}")


def steps_from_list(items: list) -> Chain:
    return Chain(tuple(s if isinstance(s, Step) else step_from_dict(s) for s in items))
