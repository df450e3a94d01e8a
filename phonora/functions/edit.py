"""Edit distance over token arrays: distance, statistics, operations, matrix, rates, weighted costs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATISTICS = ("insertions", "deletions", "substitutions", "correct")


def _e(text: str) -> Column:
    return F.expr(text)


def statistics(expected: str, actual: str) -> Column:
    """struct(insertions, deletions, substitutions, correct) by a fold over ``expected``, all in the JVM.

    A cell of the cost table carries its counts forward: the diagonal wins ties, then insertion over
    deletion, as the backward trace of uniform costs chooses.
    """
    a, b = expected, actual
    cell = "struct({c} as c, {i} as i, {d} as d, {s} as s, {m} as m)"
    first = cell.format(c="r[0].c + 1", i="r[0].i", d="r[0].d + 1", s="r[0].s", m="r[0].m")
    cost = f"least(r[j].c + 1, n[j - 1].c + 1, r[j - 1].c + int(not (x <=> {b}[j - 1])))"
    match = cell.format(c=cost, i="r[j-1].i", d="r[j-1].d", s="r[j-1].s", m="r[j-1].m + 1")
    swap = cell.format(c=cost, i="r[j-1].i", d="r[j-1].d", s="r[j-1].s + 1", m="r[j-1].m")
    gone = cell.format(c=cost, i="r[j].i", d="r[j].d + 1", s="r[j].s", m="r[j].m")
    new = cell.format(c=cost, i="n[j-1].i + 1", d="n[j-1].d", s="n[j-1].s", m="n[j-1].m")
    row = (
        f"aggregate(if(size({b}) = 0, array(), sequence(1, size({b}))), array({first}), (n, j) -> concat(n, array("
        f"case when r[j - 1].c <= least(r[j].c, n[j - 1].c) then if(r[j - 1].c = {cost}, {match}, {swap}) when r[j].c < n[j - 1].c then {gone} else {new} end)))"
    )
    zero = f"transform(sequence(0, size({b})), j -> struct(j as c, j as i, 0 as d, 0 as s, 0 as m))"
    last = f"element_at(aggregate({a}, {zero}, (r, x) -> {row}), -1)"
    return _e(f"transform(array({last}), z -> struct(bigint(z.i) as insertions, bigint(z.d) as deletions, bigint(z.s) as substitutions, bigint(z.m) as correct))[0]")


def distance(expected: str, actual: str) -> Column:
    """Levenshtein distance of token arrays: tokens become code points, then the built-in runs.

    A null token is a value of its own; a null array gives null.  Unicode has points for 1,112,062 different
    tokens of a pair.
    """
    body = f"levenshtein(aggregate({{a}}, '', (s, t) -> concat(s, {_point('t')})), aggregate({{b}}, '', (s, t) -> concat(s, {_point('t')})))"
    return _e(f"transform(array(array_distinct(concat({expected}, {actual}))), v -> {body.format(a=expected, b=actual)})[0]")


def _point(token: str) -> str:
    """A string of one code point for the position of a token among the distinct tokens, past the surrogates."""
    place = f"1 + coalesce(array_position(v, {token}), 0)"
    return f"decode(unhex(lpad(hex({place} + if({place} < 55296, 0, 2048)), 8, '0')), 'UTF-32')"


#: Cells of a cost table from which numpy fills it: the fold in the JVM copies a row for each cell.
LONG_CELLS = 4096


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in STATISTICS]))
def _long_statistics(expected: pd.Series, actual: pd.Series) -> pd.DataFrame:
    nothing = (None,) * len(STATISTICS)
    found = [nothing if a is None or b is None else counts(cost_matrix(a, b)) for a, b in zip(expected, actual, strict=True)]
    return pd.DataFrame(found, columns=STATISTICS, dtype="Int64")


def any_statistics(expected: str, actual: str, cells: int = LONG_CELLS) -> Column:
    """``statistics`` for arrays of any length: short pairs in the JVM, long ones, and only they, in Arrow batches."""
    a, b = F.col(expected), F.col(actual)
    long = F.size(a).cast("long") * F.size(b) > cells
    return F.when(long, _long_statistics(F.when(long, a), F.when(long, b))).otherwise(statistics(expected, actual))


def total_cost(expected: str, actual: str) -> Column:
    s = statistics(expected, actual)
    return s["insertions"] + s["deletions"] + s["substitutions"]


def word_error_rate(s: Column, kind: str = "double") -> Column:
    """(S + D + I) / (S + D + C); null for an empty reference."""
    return _rate(s["substitutions"] + s["deletions"] + s["insertions"], s, kind)


def substitution_rate(s: Column, kind: str = "double") -> Column:
    return _rate(s["substitutions"], s, kind)


def insertion_rate(s: Column, kind: str = "double") -> Column:
    return _rate(s["insertions"], s, kind)


def deletion_rate(s: Column, kind: str = "double") -> Column:
    return _rate(s["deletions"], s, kind)


def _rate(part: Column, s: Column, kind: str) -> Column:
    whole = s["substitutions"] + s["deletions"] + s["correct"]
    return F.try_divide(part.cast(kind), whole.cast(kind)).cast(kind)


def action_name(code: Column) -> Column:
    """Names of the action numbers 0, 1, 2; any other number is an error."""
    known = F.array(*map(F.lit, ("insertion", "deletion", "substitution")))
    return F.when(code.between(0, 2), F.try_element_at(known, (code + 1).cast("int"))).otherwise(F.raise_error(F.concat(F.lit("no action "), code.cast("string"))).cast("string"))


# Kernels on numpy arrays for the operations that need a backward trace or weights.


def cost_matrix(a: Sequence, b: Sequence, insertion: float = 1.0, deletion: float = 1.0, table: dict | None = None) -> np.ndarray:
    """Costs of all prefixes.  With a ``table`` of properties a substitution costs the number that differ.

    The first row counts in steps of one whatever an insertion costs.
    """
    m, n = len(a), len(b)
    if table is None and insertion == deletion == 1:
        return _unit_costs(a, b)
    d = np.zeros((m + 1, n + 1), np.float32)
    d[0] = np.arange(n + 1)
    for i in range(1, m + 1):
        d[i, 0] = d[i - 1, 0] + np.float32(deletion)
        for j in range(1, n + 1):
            x, y = a[i - 1], b[j - 1]
            swap = float(x != y) if table is None else float(sum(p != q for p, q in zip(table[x], table[y], strict=True)))
            d[i, j] = min(d[i - 1, j] + np.float32(deletion), d[i, j - 1] + np.float32(insertion), d[i - 1, j - 1] + np.float32(swap))
    return d


def _unit_costs(a: Sequence, b: Sequence) -> np.ndarray:
    """Costs of one for every edit, a row at a time: insertions along a row are a running minimum."""
    ids: dict = {}
    x = np.array([ids.setdefault(t, len(ids)) for t in a], np.int64)
    y = np.array([ids.setdefault(t, len(ids)) for t in b], np.int64)
    d = np.zeros((len(x) + 1, len(y) + 1), np.float32)
    steps = np.arange(len(y) + 1, dtype=np.float32)
    d[0] = steps
    for i in range(1, len(x) + 1):
        row = d[i - 1] + 1
        np.minimum(row[1:], d[i - 1, :-1] + (y != x[i - 1]), out=row[1:])
        d[i] = np.minimum.accumulate(row - steps) + steps
    return d


def trace(d: np.ndarray) -> list[tuple[int, int, int]]:
    """(action, i, j) from the end while the cost is not zero: 0 insertion, 1 deletion, 2 substitution, 3 match."""
    i, j = d.shape[0] - 1, d.shape[1] - 1
    out = []
    while d[i, j] != 0:
        if i == 0:
            action = 0
        elif j == 0:
            action = 1
        else:
            gone, new, both = d[i - 1, j], d[i, j - 1], d[i - 1, j - 1]
            action, least = (1, gone) if gone < new else (0, new)
            if both <= least:
                action = 3 if both == d[i, j] else 2
        out.append((action, i, j))
        i, j = i - (action != 0), j - (action != 1)
    out.extend((3, k, k) for k in range(i, 0, -1))
    return out


def counts(d: np.ndarray) -> tuple[int, int, int, int]:
    n = [0, 0, 0, 0]
    for action, _, _ in trace(d):
        n[action] += 1
    return tuple(n)


_OPERATIONS = "array<struct<action: int, expected: string, actual: string>>"


def operations(df: DataFrame, expected: str, actual: str, out: str = "edits") -> DataFrame:
    """``df`` with the edits that turn ``expected`` into ``actual``, in order, and ``out``_cost, in Arrow batches.

    Null arrays give null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("action", pa.int32()), ("expected", pa.string()), ("actual", pa.string())]))
        for batch in batches:
            edits, costs = [], []
            for a, b in zip(batch.column(expected).to_pylist(), batch.column(actual).to_pylist(), strict=True):
                if a is None or b is None:
                    edits.append(None)
                    costs.append(None)
                    continue
                d = cost_matrix(a, b)
                steps = [(x, i, j) for x, i, j in reversed(trace(d)) if x != 3]
                edits.append([{"action": x, "expected": a[i - 1] if x != 0 else None, "actual": b[j - 1] if x != 1 else None} for x, i, j in steps])
                costs.append(float(d[-1, -1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, kind), pa.array(costs, pa.float32())], [*batch.schema.names, out, f"{out}_cost"])

    schema = df.limit(0).selectExpr("*", f"cast(null as {_OPERATIONS}) as {out}", f"cast(null as float) as {out}_cost").schema
    return df.mapInArrow(run, schema)


def matrix(df: DataFrame, expected: str, actual: str, out: str = "costs") -> DataFrame:
    """``df`` with the whole cost table as array<array<float>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if a is None or b is None else cost_matrix(a, b).tolist() for a, b in zip(batch.column(expected).to_pylist(), batch.column(actual).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.list_(pa.float32())))], [*batch.schema.names, out])

    return df.mapInArrow(run, df.limit(0).selectExpr("*", f"cast(null as array<array<float>>) as {out}").schema)


def statistics_arrow(df: DataFrame, expected: str, actual: str, out: str = "edits") -> DataFrame:
    """``df`` with struct(insertions, deletions, substitutions, correct) from numpy, for long token arrays.

    The fold in the JVM is quick for short arrays but copies a row for each cell of a long one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(n, pa.int64()) for n in STATISTICS])
        for batch in batches:
            found = []
            for a, b in zip(batch.column(expected).to_pylist(), batch.column(actual).to_pylist(), strict=True):
                found.append(None if a is None or b is None else dict(zip(STATISTICS, counts(cost_matrix(a, b)), strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, out])

    fields = ", ".join(f"{n}: bigint" for n in STATISTICS)
    return df.mapInArrow(run, df.limit(0).selectExpr("*", f"cast(null as struct<{fields}>) as {out}").schema)


def weighted_statistics(df: DataFrame, expected: str, actual: str, table: dict[str, Sequence], insertion: float, deletion: float, out: str = "edits") -> DataFrame:
    """``df`` with edit statistics under property weights; ``table`` is a small dictionary of property vectors.

    A token without properties is an error.
    """
    shared = df.sparkSession.sparkContext.broadcast({k: tuple(v) for k, v in table.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(n, pa.int64()) for n in STATISTICS])
        for batch in batches:
            found = []
            for a, b in zip(batch.column(expected).to_pylist(), batch.column(actual).to_pylist(), strict=True):
                n = None if a is None or b is None else counts(cost_matrix(a, b, insertion, deletion, shared.value))
                found.append(None if n is None else dict(zip(STATISTICS, n, strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, out])

    fields = ", ".join(f"{n}: bigint" for n in STATISTICS)
    return df.mapInArrow(run, df.limit(0).selectExpr("*", f"cast(null as struct<{fields}>) as {out}").schema)
