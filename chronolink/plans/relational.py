"""Named relational operators over an edge log, composed by name.

Each operator is one SELECT over its inputs, in SQL that Spark and DuckDB read
alike. ``Plan`` binds input DataFrames and evaluates operators lazily, each
once: the result of an operator is the DataFrame that others take in, so
Catalyst sees one plan and prunes and pushes down through all of it.
``as_sql`` writes the same composition as common table expressions, for
checking against another engine.

Inputs: ``edges`` (src, dst, time), ``history`` (a prefix of it in time) and
``queries`` (qid, src, time, pos, cand, label).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from chronolink.plans.stored import drop, store

_INPUT = re.compile(r"\{(\w+)\}")
#: Relations of one row, and how operators read a value of them. A plan computes the row once and puts the value
#: in as a literal; as a subquery, each reader would carry the plan of the whole edge log below it.
ONE_ROW = ("scales", "cutoff", "pool_sizes", "slot_count", "edge_slot_count", "vector_count", "vector_shape", "edge_count", "wide_count")
_VALUE = re.compile(r"\(SELECT (\w+) FROM \{(" + "|".join(ONE_ROW) + r")\}\)")
_ROUND = re.compile(r"\bround\(")
_PLACES = re.compile(r",\s*(\d+)$")


@dataclass(frozen=True)
class Operator:
    name: str
    sql: str

    @property
    def inputs(self) -> list[str]:
        return list(dict.fromkeys(_INPUT.findall(self.sql)))


CATALOG: dict[str, Operator] = {}
#: How Spark gets the rows of an operator where its statement, which as_sql() keeps, would cost it too much, and relations that only these read.
SPARK: dict[str, str] = {}
#: Those of SPARK that are written as tables when first read, with what tells the number of their slices.
STORED: dict[str, tuple[str, float] | None] = {}
#: Stored relations that are deleted once another one is written; they only feed it, and are made anew if read again.
DROPPED: dict[str, tuple[str, ...]] = {}
#: Stands for a list of one value per place i of the plain vectors (vector_shape).
_EACH = re.compile(r"\$EACH\[(.+)\]")
#: Stands for a slice in the statement of a relation made in slices: pmod(xxhash64(key), of) = number.
_SLICE = re.compile(r"\$SLICE\((\w+(?:\.\w+)?)\)")
#: Rows that a slice makes at most, on average.
SLICE_ROWS = 60_000_000


def define(name: str, sql: str) -> None:
    CATALOG[name] = Operator(name, sql.strip())


def define_spark(name: str, sql: str) -> None:
    SPARK[name] = sql.strip()


def define_stored(name: str, sql: str, by: str | None = None, fan: float = 1, drops: tuple[str, ...] = ()) -> None:
    """Written as a table when first read; with by, in slices: fan rows are made for each row of the stored relation by. drops: see DROPPED."""
    define_spark(name, sql)
    STORED[name], DROPPED[name] = (by, fan) if by else None, drops


def binary_rounds(sql: str) -> str:
    """round(x, n) written out as the nearest whole of x * 10^n, divided by it again.

    Spark rounds the shortest decimal form of a double, where 0.5015485 is a tie;
    other engines round its binary value, which lies below.
    """
    at = _ROUND.search(sql)
    if not at:
        return sql
    end, depth = at.end(), 1
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        end += 1
    inside, rest = sql[at.end() : end - 1], binary_rounds(sql[end:])
    places = _PLACES.search(inside)
    if not places:
        return sql[: at.end()] + binary_rounds(inside) + ")" + rest
    unit = f"1e{places[1]}"
    return sql[: at.start()] + f"(round(CAST({binary_rounds(inside[: places.start()])} AS DOUBLE) * {unit}) / {unit})" + rest


def define_numbered(name: str, columns: str, source: str, bucket: str, order: str, number: str) -> None:
    """Rows of a source numbered from 0 in the order of (bucket, order), without sorting them in one task.

    Rows are numbered within buckets; counts of the buckets before are added.
    bucket must not fall as order rises; there should be many rows to a bucket.
    """
    define(f"{name}_dealt", f"SELECT {columns}, {bucket} AS bucket_no FROM {source}")
    define(f"{name}_before", f"""
SELECT bucket_no AS b, CAST(sum(n) OVER (ORDER BY bucket_no) - n AS BIGINT) AS before_n
FROM (SELECT bucket_no, count(*) AS n FROM {{{name}_dealt}} GROUP BY bucket_no) c
""")
    define(name, f"""
SELECT {columns}, before_n + row_number() OVER (PARTITION BY bucket_no ORDER BY {order}) - 1 AS {number}
FROM {{{name}_dealt}} d JOIN {{{name}_before}} o ON o.b = d.bucket_no
""")


class Plan:
    """Operators bound to DataFrames. given: the inputs by name; they come before operators of the same name.

    keep: names of relations to persist when they are first read. By default none:
    equal exchanges below several readers run once anyway.
    """

    def __init__(self, spark: SparkSession, keep: tuple[str, ...] = (), **given: DataFrame):
        self.spark, self._keep = spark, keep
        self._given, self._own = given, {}
        self._rows: dict[str, Row] = {}
        self._known = {n: df.persist() if n in keep else df for n, df in given.items()}

    def replaced(self, sql: dict[str, str]) -> Plan:
        """The same inputs with other definitions of some operators."""
        out = Plan(self.spark, self._keep, **self._given)
        out._own = sql
        return out

    def _value(self, column: str, name: str):
        if name not in self._rows:
            self._rows[name] = self[name].first()
        return self._rows[name][column]

    def _each(self, match: re.Match) -> str:
        values = ", ".join(match[1].replace("$i", str(i)) for i in range(self._value("width", "vector_shape")))
        return f"CAST(array({values}) AS ARRAY<DOUBLE>)"

    def _literal(self, match: re.Match) -> str:
        value = self._value(*match.groups())
        if value is None:
            return "CAST(NULL AS DOUBLE)"
        return f"CAST('{value!r}' AS DOUBLE)" if isinstance(value, float) else f"CAST({int(value)} AS BIGINT)"

    def _sliced(self, name: str, sql: str) -> list[str]:
        by, fan = STORED[name] or (None, 0)
        of = max(1, math.ceil(self[by].count() * fan / SLICE_ROWS)) if by else 1
        return [_SLICE.sub(rf"(pmod(xxhash64(\1), {of}) = {k})", sql) for k in range(of)]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            sql = binary_rounds(_EACH.sub(self._each, _VALUE.sub(self._literal, self._own.get(name) or SPARK.get(name) or CATALOG[name].sql)))
            inputs = {i: self[i] for i in dict.fromkeys(_INPUT.findall(sql))}
            if name in STORED and name not in self._own:
                df = store(self.spark, name, (self.spark.sql(s, **inputs) for s in self._sliced(name, sql)))
                for used in DROPPED[name]:
                    drop(self._known.pop(used))
            else:
                df = self.spark.sql(sql, **inputs)
            self._known[name] = df.persist() if name in self._keep else df
        return self._known[name]


def as_sql(name: str, base: dict[str, str]) -> str:
    """The operator as one statement; base: SQL of the inputs by name."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in order:
            for i in _INPUT.findall(base[n]) if n in base else CATALOG[n].inputs:
                visit(i)
            order.append(n)

    visit(name)
    body = lambda n: _INPUT.sub(r"\1", base[n] if n in base else CATALOG[n].sql)
    return "WITH " + ",\n".join(f"{n} AS ({body(n)})" for n in order) + f"\nSELECT * FROM {name}"
