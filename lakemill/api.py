"""The engine: dialect text in, DataFrame out."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DecimalType

from .errors import BindingError, ExecutionError
from .plans.dialect import Statement, check_tree, divisions, guard_scalars, keep_sums, rewrite, tokenise
from .plans.pairs import deal_pairs
from .plans.types import check_types
from .session import SEMANTICS
from .sources import READERS
from .sources.lakehouse import UnityCatalog


@dataclass
class QueryStats:
    """What a run measured: result rows, and what its scans read."""

    rows: int | None = None
    files_read: int | None = None
    bytes_read: int | None = None
    rows_scanned: int | None = None
    seconds: float | None = None


def _with_semantics(spark: SparkSession) -> SparkSession:
    """The session where it has the settings that the dialect rests on, else a clone of it that has them; the given one is left as it is."""
    if all((spark.conf.get(k, None) or "").lower() == v.lower() for k, v in SEMANTICS.items()):
        return spark
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for key, value in SEMANTICS.items():
        own.conf.set(key, value)
    return own


class Engine:
    """Runs the dialect on a session. `root` confines local paths."""

    def __init__(self, spark: SparkSession, root: str | None = None, unity: dict[str, UnityCatalog] | None = None):
        self.spark, self.root, self.unity = _with_semantics(spark), root, unity

    def _sources(self, statement: Statement) -> dict[str, DataFrame]:
        out = {}
        for s in statement.sources:
            options = {"servers": self.unity} if s.function == "read_unity_catalog" else {}
            out[s.name] = READERS[s.function](self.spark, *s.arguments, root=self.root, **options)
        return out

    def _bind(self, sql: str, sources: dict[str, DataFrame]) -> DataFrame:
        try:
            return self.spark.sql(sql, **sources)
        except Exception as error:
            raise BindingError(str(getattr(error, "desc", None) or error).splitlines()[0]) from None

    def sql(self, text: str, strict: bool = True, repeated_keys: bool = False) -> DataFrame:
        """The statement's result, lazily. Without strict, all of Spark SQL over table functions is read.

        With repeated_keys, a join whose keys repeat on both sides is measured and planned for that (`plans/pairs.py`)."""
        frame = self._planned(text, strict)
        return deal_pairs(self.spark, frame) if repeated_keys else frame

    def _planned(self, text: str, strict: bool) -> DataFrame:
        statement = rewrite(text, strict)
        if strict:
            check_tree(self.spark, re.sub(r"\{(source_\d+)\}", r"\1", statement.sql))
            if len(statement.sources) == 1:
                tokens = tokenise(text)
                for a, dot, _ in zip(tokens, tokens[1:], tokens[2:], strict=False):
                    if dot.text == "." and a.kind in ("word", "quoted"):
                        raise BindingError(f"a query over one source takes no qualified names: {a.text}.…")
        sources = self._sources(statement)
        frame = self._bind(statement.sql, sources)
        if not strict:
            return frame
        tokens, met = statement.tokens, check_types(self.spark, frame)
        if met.sums_of_decimals:
            tokens = keep_sums(tokens, lambda query: self._decimal(query, sources))
            frame = self._bind(" ".join(tokens), sources)
            met = check_types(self.spark, frame)
        if met.refused:
            raise BindingError(met.refused)
        tokens = guard_scalars(self._integer_division(tokens, sources, met.integer_divisions_of_decimals))
        return frame if tokens == statement.tokens else self._bind(" ".join(tokens), sources)

    def _integer_division(self, tokens: list[str], sources: dict[str, DataFrame], decimals: int) -> list[str]:
        """Each `/` whose operands are integers divides as integers: where DIV binds, and not over decimals, it stands."""
        for k in divisions(tokens):
            tried = [*tokens[:k], "DIV", *tokens[k + 1 :]]
            try:
                found = check_types(self.spark, self.spark.sql(" ".join(tried), **sources))
                if not found.refused and found.integer_divisions_of_decimals == decimals:
                    tokens = tried
            except Exception:
                continue
        return tokens

    def _decimal(self, query: str, sources: dict[str, DataFrame]) -> str | None:
        kind = self._bind(query, sources).schema[0].dataType
        return kind.simpleString() if isinstance(kind, DecimalType) else None

    def explain(self, text: str, logical: bool = False, form: str = "text") -> str:
        """Catalyst's optimised logical or physical plan."""
        execution = self.sql(text)._jdf.queryExecution()
        plan = execution.optimizedPlan() if logical else execution.executedPlan()
        return plan.toJSON() if form == "json" else plan.toString()

    def run(self, text: str):
        """The result as an Arrow table, and its statistics."""
        import time

        frame, began = self.sql(text), time.perf_counter()
        try:
            table = frame.toArrow()
        except Exception as error:
            raise ExecutionError(str(error).splitlines()[0]) from error
        files, size, scanned = scan_metrics(frame)
        return table, QueryStats(table.num_rows, files, size, scanned, time.perf_counter() - began)


def scan_metrics(frame: DataFrame) -> tuple[int, int, int]:
    """Files, bytes and rows that the scans of an executed frame read, by the plan's own metrics."""
    totals = [0, 0, 0]

    def walk(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind in ("FileSourceScanExec", "BatchScanExec"):
            for i, name in enumerate(("numFiles", "filesSize", "numOutputRows")):
                found = node.metrics().get(name)
                totals[i] += found.get().value() if found.isDefined() else 0
        for part in (node.children(), node.subqueries()):
            for i in range(part.size()):
                walk(part.apply(i))
        return None

    walk(frame._jdf.queryExecution().executedPlan())
    return totals[0], totals[1], totals[2]


def stats_json(stats: QueryStats) -> str:
    return json.dumps(asdict(stats))
