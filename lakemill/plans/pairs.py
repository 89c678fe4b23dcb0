"""Joins whose keys repeat on both sides: their pairs are dealt out, and counted without being listed.

An equi-join puts all rows of a key into one task, so with few keys its work,
the pairs, grows with the square of the table in a fixed number of tasks.
`deal_pairs` changes the optimised plan of such a join:

- An aggregate of COUNT(*) alone counts the copies of each side first, by the
  columns that the statement uses, and sums products: no pair is made twice.
- Where the condition compares an expression of one side with one of the other,
  rows that no row of the other side's range can meet go before the join.
- Each side's rows of a key are split into pieces, and each pair of pieces is a
  cell that one task joins: a row is copied once for each piece that it meets, a
  pair of rows meets in one cell. A cell makes about BLOCK * BLOCK pairs at most.

Every pair of the join is made, so a result of quadratic size stays quadratic:
in tasks of bounded size, whose number grows. Two or three small jobs measure
ranges and rows by key when the statement is planned.

Cases: null keys meet nothing; a plan with more than one join, another join
than an inner one or one without equalities, or with few pairs and nothing
compared: left as it is.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

#: Rows of a piece where both sides have as many; the square is the pairs of a cell.
BLOCK = 2048
#: Cells of a task, as they come by a hash, and pairs (in cells) below which a join is left as it is.
CELLS, FEW = 16, 16
#: Rows that a cell may have of one side, in blocks, and the most tasks of a join.
LONGEST, TASKS = 64, 10_000
#: Keys of at least so small a part of a cell's pairs are counted towards the tasks: of all rows, one in BLOCK / sqrt(HEAVY) such keys at most.
HEAVY = 64

_ABOVE = {"Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit"}
_SCAN = {"Project", "Filter", "LogicalRelation"}
_NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}
_TURNED = {"GreaterThan": "LessThan", "GreaterThanOrEqual": "LessThanOrEqual", "LessThan": "GreaterThan", "LessThanOrEqual": "GreaterThanOrEqual"}


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _children(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def _conjuncts(e) -> list:
    return _conjuncts(e.left()) + _conjuncts(e.right()) if _kind(e) == "And" else [e]


def _frame(spark: SparkSession, plan) -> DataFrame:
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def _column(spark: SparkSession, e) -> Column:
    from pyspark.sql.classic.column import Column as Classic

    return Classic(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(e))


def _optimised(spark: SparkSession, frame: DataFrame):
    """The plan with filters and columns at the scans, without what is only known when it runs."""
    own = spark._jsparkSession.cloneSession()
    for key in ("spark.sql.optimizer.dynamicPartitionPruning.enabled", "spark.sql.optimizer.runtime.bloomFilter.enabled"):
        own.conf().set(key, "false")
    return spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own, frame._jdf.queryExecution().analyzed()).queryExecution().optimizedPlan()


def _is_scan(node) -> bool:
    return _kind(node) in _SCAN and all(_is_scan(x) for x in _children(node.children()))


def _joins(node) -> int:
    return (_kind(node) == "Join") + sum(_joins(x) for x in _children(node.children()))


def _counts_only(root) -> bool:
    """Whether each output of an aggregate is COUNT(*) or a grouping column."""
    for e in _children(root.aggregateExpressions()):
        inner = e.child() if _kind(e) == "Alias" else e
        if _kind(inner) == "AggregateExpression":
            f = inner.aggregateFunction()
            if _kind(f) != "Count" or inner.isDistinct() or inner.filter().isDefined() or any(_kind(x) != "Literal" or x.value() is None for x in _children(f.children())):
                return False
        elif _kind(inner) != "AttributeReference":
            return False
    return all(_kind(g) == "AttributeReference" for g in _children(root.groupingExpressions()))


def _inexact(node) -> bool:
    """Grouping may change such columns: 0.0 and -0.0 are one group."""
    return any(not (k := a.dataType().simpleString()).startswith(("tinyint", "smallint", "int", "bigint", "decimal", "string", "date", "timestamp", "boolean")) or k.startswith("interval") or "collate" in k for a in _children(node.output()))


class _Pairs:
    def __init__(self, spark: SparkSession, join):
        self.spark, self.join = spark, join
        self.mark = uuid.uuid4().hex[:8]
        self.plans = (join.left(), join.right())
        self.sides = [_frame(spark, p) for p in self.plans]
        self.keys: list[tuple[Column, Column]] = []
        self.compared: list[tuple[str, Column, Column]] = []
        for e in _conjuncts(join.condition().get()):
            kind = _kind(e)
            if kind not in {"EqualTo", *_TURNED}:
                continue
            ends = [e.left(), e.right()]
            if not all(x.references().size() and x.deterministic() for x in ends):
                continue
            if self._within(ends[1], 0) and self._within(ends[0], 1):
                ends, kind = ends[::-1], _TURNED.get(kind, kind)
            elif not (self._within(ends[0], 0) and self._within(ends[1], 1)):
                continue
            columns = (_column(spark, ends[0]), _column(spark, ends[1]))
            if kind == "EqualTo":
                self.keys.append(columns)
            elif ends[0].dataType().simpleString() == ends[1].dataType().simpleString() and ends[0].dataType().simpleString() in _NUMBERS:
                self.compared.append((kind, *columns))

    def _within(self, e, side: int) -> bool:
        return e.references().subsetOf(self.plans[side].outputSet())

    def name(self, what: str) -> str:
        return f"{what}_{self.mark}"

    def condition(self) -> Column:
        return _column(self.spark, self.join.condition().get())

    def count_copies(self) -> None:
        for k, side in enumerate(self.sides):
            own = [_column(self.spark, a) for a in _children(self.plans[k].output())]
            self.sides[k] = side.groupBy(*own).agg(F.count(F.lit(1)).alias(self.name(f"copies{k}")))

    def narrow(self) -> bool:
        """Only rows that the range of what they are compared with can meet; whether there is such a range."""
        if not self.compared:
            return False
        ends = []
        for k, side in enumerate(self.sides):
            met = [x[k] for x in self.keys]
            bounds = [f(x[1 + k]).alias(f"{f.__name__}{i}") for i, x in enumerate(self.compared) for f in (F.min, F.max)]
            ends.append(side.where(reduce(Column.__and__, [c.isNotNull() for c in met])).agg(*bounds).first())
        for i, (kind, left, right) in enumerate(self.compared):
            low, high = [e[f"min{i}"] for e in ends], [e[f"max{i}"] for e in ends]
            if None in low:
                continue
            test = {"GreaterThan": Column.__gt__, "GreaterThanOrEqual": Column.__ge__, "LessThan": Column.__lt__, "LessThanOrEqual": Column.__le__}
            first, second = (low[1], high[0]) if kind.startswith("Greater") else (high[1], low[0])
            self.sides[0] = self.sides[0].where(test[kind](left, F.lit(first)))
            self.sides[1] = self.sides[1].where(test[_TURNED[kind]](right, F.lit(second)))
        return True

    def deal(self) -> int:
        """Sides with a row for each cell that theirs belongs to, in column cell0 or cell1; the number of tasks, 0 for few pairs."""
        n, p, key = [self.name("n0"), self.name("n1")], [self.name("p0"), self.name("p1")], [self.name(f"key{i}") for i in range(len(self.keys))]
        rows = []
        for k, side in enumerate(self.sides):
            on = [x[k].alias(key[i]) for i, x in enumerate(self.keys)]
            rows.append(side.select(*on).dropna().groupBy(*key).agg(F.count(F.lit(1)).alias(n[k])))
        both = rows[0].join(rows[1], key)
        share = lambda k: F.ceil(F.greatest(F.col(n[k]).cast("double") * F.least(F.col(n[1 - k]), F.lit(BLOCK)) / (BLOCK * BLOCK), F.col(n[k]) / (LONGEST * BLOCK))).cast("int")
        both = both.withColumn(p[0], share(0)).withColumn(p[1], share(1))
        product = F.col(n[0]).cast("double") * F.col(n[1])
        # written, as a plan that holds a table twice over would get other attributes
        path = scratch_dir(self.spark, "pairs")
        both.where(product >= BLOCK * BLOCK / HEAVY).write.parquet(path)
        heavy = self.spark.read.schema(both.schema).parquet(path)
        pairs, cells = heavy.agg(F.sum(product), F.sum(F.col(p[0]).cast("double") * F.col(p[1]))).first()
        if not pairs or pairs < FEW * BLOCK * BLOCK:
            return 0
        least = pairs / BLOCK / BLOCK
        tasks = min(TASKS, math.ceil(max(least, min(cells, 4 * least)) / CELLS))
        for k in (0, 1):
            split = self.spark.read.schema(both.schema).parquet(path).where((F.col(p[0]) > 1) | (F.col(p[1]) > 1)).select(*key, *p)
            own = self.sides[k].columns
            # a scan gives its rows in the same order again; others are told apart by what they hold
            told = F.monotonically_increasing_id() if _is_scan(self.plans[k]) and self.name(f"copies{k}") not in own else F.struct(*(_column(self.spark, a) for a in _children(self.plans[k].output())))
            side = self.sides[k].withColumn(self.name("row"), F.xxhash64(told))
            met = reduce(Column.__and__, [x[k] == split[key[i]] for i, x in enumerate(self.keys)])
            side = side.join(split, met, "left")
            mine, theirs = (F.coalesce(F.col(x), F.lit(1)) for x in (p[k], p[1 - k]))
            side = side.withColumn(self.name("mine"), F.pmod(F.col(self.name("row")), mine).cast("int"))
            side = side.withColumn(self.name("theirs"), F.explode(F.sequence(F.lit(0), theirs - 1)))
            at, other = F.col(self.name("mine")), F.col(self.name("theirs"))
            side = side.withColumn(self.name(f"cell{k}"), at * theirs + other if k == 0 else other * mine + at)
            side = side.drop(*key, *p, *(self.name(x) for x in ("row", "mine", "theirs")))
            self.sides[k] = side.repartition(tasks, *(x[k] for x in self.keys), F.col(self.name(f"cell{k}")))
        return tasks

    def joined(self, dealt: bool) -> DataFrame:
        on = self.condition()
        if dealt:
            on = on & (F.col(self.name("cell0")) == F.col(self.name("cell1")))
        return self.sides[0].join(self.sides[1], on)


def deal_pairs(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """The same result, by a plan that fits a join of keys that repeat on both sides."""
    plan = _optimised(spark, frame)
    above = []
    while _kind(plan) in _ABOVE:
        above.append(plan)
        plan = plan.child()
    if _kind(plan) != "Join" or _joins(plan) > 1 or plan.joinType().sql() != "INNER" or plan.condition().isEmpty():
        return frame
    pairs = _Pairs(spark, plan)
    if not pairs.keys:
        return frame
    root = above[0] if above else None
    counted = bool(root) and _kind(root) == "Aggregate" and all(_kind(x) == "Project" for x in above[1:]) and _counts_only(root)
    plain = all(_kind(e) == "AttributeReference" for x in above[1:] for e in _children(x.projectList())) if counted else False
    if counted and plain and not any(map(_inexact, pairs.plans)):
        pairs.count_copies()
        made = pairs.joined(bool(pairs.deal()))
        n = F.coalesce(F.sum(F.col(pairs.name("copies0")) * F.col(pairs.name("copies1"))), F.lit(0).cast("bigint"))
        outputs = _children(root.aggregateExpressions())
        groups = [_column(spark, g) for g in _children(root.groupingExpressions())]
        counts = [n.alias(pairs.name(f"out{i}")) for i, e in enumerate(outputs)]
        out = made.groupBy(*groups).agg(*counts)
        listed = []
        for i, e in enumerate(outputs):
            inner = e.child() if _kind(e) == "Alias" else e
            listed.append((F.col(pairs.name(f"out{i}")) if _kind(inner) == "AggregateExpression" else _column(spark, inner)).alias(e.name()))
        return out.select(*listed)
    narrowed, dealt = pairs.narrow(), bool(pairs.deal())
    if not narrowed and not dealt:
        return frame
    made = pairs.joined(dealt).select(*(_column(spark, a) for a in _children(plan.output())))
    new = made._jdf.queryExecution().analyzed()
    for node in reversed(above):
        new = node.withNewChildren(spark._jvm.PythonUtils.toSeq([new]))
    return _frame(spark, new)
