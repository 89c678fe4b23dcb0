"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is shuffled by a keyed hash. Its virtual finish time
is the words of its source up to and including it, divided by the source's
weight. Serving all sources in order of virtual time and stopping when the
total budget is spent gives each source its weighted share; a source that has
been repeated `max_repeats` times is exhausted and the others go on at the same
relative rates. The stop falls at one virtual time for all sources, so a
document is taken when it finishes before the stop, and the one document of a
source that the stop falls into is taken in part. Sources, as rows, are put in
order in one task: tens of thousands are no burden, one for each document is.

Cases: null source is a source of its own, ordered last; null text has size 0;
repeated rows are separate documents of equal rank, ordered by a second hash
only (equal rows are interchangeable); an empty table gives an empty result;
other columns are untouched. With nothing to take (all sizes 0) targets are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .store import Workspace, power_of_two

SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of one source that share a cell of the shuffled order, at the most likely.
CELL_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int, share: float) -> DataFrame:
    """One row per source key with weight, target and virtual stop time.

    sizes: skey, source, source_size. Sources are ranked by code point, null
    last, and take the weights in turn. One row per source, so the single
    window partition holds as many rows as there are sources.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("*", weight.cast("long").alias("weight"), (F.col("source_size") * max_repeats).alias("cap"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    budget = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    filled = ranked.select(
        "*",
        budget.alias("budget"),
        F.row_number().over(by_ratio).alias("k"),
        F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)).alias("open_weight"),
    )
    level = (F.col("budget") - F.col("before")) / F.col("open_weight")
    fits = level <= F.col("cap") / F.col("weight")
    stop = F.min_by(F.when(fits, level), F.when(fits, F.col("k"))).over(W.partitionBy())
    filled = filled.withColumn("stop", stop)
    target = F.when(F.col("stop").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("weight") * F.col("stop"))
    )
    return filled.select("skey", "source_size", "weight", target.alias("target"))


def plan_mix(
    spark: SparkSession,
    docs: DataFrame,
    *,
    size: Column | None = None,
    weights: Sequence[int] = (5, 2, 1),
    max_repeats: int = 3,
    share: float = 1.0,
    seed: str = "mix",
    workspace: Workspace | None = None,
    row: str | None = None,
) -> DataFrame:
    """doc_id, source, size, source_size, target, virtual_finish, taken.

    `row` names a column with a distinct BIGINT for each row, which the plan
    then carries; it settles ties and places rows whose doc_id is null.

    `taken` counts words, repeats included: `passes` copies that finish up to the
    stop, then the `part` of a copy that the stop falls into.
    """
    ws = workspace or Workspace(spark, "mix")
    own = [row] if row else []
    unnamed = F.concat(F.lit("null:"), F.col(row).cast("string")) if row else F.lit("null")
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), unnamed)).cast("binary"))
    sized = ws.put(
        docs.select(
            "doc_id",
            *own,
            "source",
            F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"),
            (word_count(F.col("text")) if size is None else size).alias("size"),
        ).withColumn("shuffled", F.substring(shuffled, 1, 16)),
        "sized",
    )
    cells = power_of_two(sized.count() / CELL_ROWS, 256, 65536)
    cell = F.shiftright(F.conv(F.substring("shuffled", 1, 4), 16, 10).cast("int"), 16 - (cells.bit_length() - 1))
    sized = sized.withColumn("cell", cell)
    per_cell = ws.put(sized.groupBy("skey", "source", "cell").agg(F.sum("size").alias("cell_size")), "cells")
    targets = source_targets(
        per_cell.groupBy("skey", "source").agg(F.sum("cell_size").alias("source_size")), weights, max_repeats, share
    )
    order = W.partitionBy("skey").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = ws.put(
        per_cell.select("skey", "cell", F.coalesce(F.sum("cell_size").over(order), F.lit(0)).alias("offset")).join(targets, "skey"),
        "offsets",
    )
    running = W.partitionBy("skey", "cell").orderBy("shuffled", "doc_id", "size", *own).rowsBetween(W.unboundedPreceding, W.currentRow)
    cum = F.col("offset") + F.sum("size").over(running)
    placed = sized.join(offsets, ["skey", "cell"]).withColumn("cum", cum)
    # A source's stop on virtual time, times its weight, is the words that it has served by then. The k-th copy of a
    # document finishes at (cum + k * source_size) / weight: copies up to the stop are taken, and a part of the one it falls into.
    due = F.floor("target").cast("long")
    finished = F.when((F.col("source_size") > 0) & (due >= F.col("cum")), F.expr("(CAST(floor(target) AS BIGINT) - cum) div source_size") + 1).otherwise(F.lit(0)).cast("long")
    passes = F.when(F.col("size") > 0, finished).otherwise(F.lit(0)).cast("long")
    begun = F.col("cum") - F.col("size") + passes * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), due - begun))
    return placed.select(
        "doc_id",
        *own,
        "source",
        "size",
        "source_size",
        "target",
        (F.col("cum") / F.col("weight")).alias("virtual_finish"),
        (passes * F.col("size") + part).alias("taken"),
        passes.alias("passes"),
        part.alias("part"),
        "weight",
    )


def mix_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself in training order: the input's columns, one row
    per copy, range-sorted by virtual finish time. A copy that the stop falls
    into keeps its first words only. Documents of size 0 are kept once.

    Rows have plans of their own, whether doc_id is null, repeated or neither."""
    ws = Workspace(spark, "mixed")
    given = docs.columns
    # the input's columns go by numbers inside, so that none of them clashes
    docs = ws.put(docs.select(*[F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(given)], F.monotonically_increasing_id().alias("_row")), "docs")
    inside = {c: f"in_{k}" for k, c in enumerate(given)}
    needed = docs.select("_row", *[F.col(inside[c]).alias(c) for c in ("doc_id", "source", "text")])
    plan = ws.put(plan_mix(spark, needed, workspace=ws, row="_row", **options), "plan").select(
        F.col("_row").alias("_id"), "passes", "part", "virtual_finish", "weight", "source_size", F.col("size").alias("_size")
    )
    copies = F.col("passes") + (F.col("part") > 0).cast("long")
    copies = F.when(F.col("_size") == 0, F.lit(1).cast("long")).otherwise(copies)
    turns = plan.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    cut = (F.col("_copy") == F.col("passes")) & (F.col("_size") > 0)
    turns = turns.select(
        "_id",
        F.when(cut & (F.col("part") < F.col("_size")), F.col("part")).alias("_words"),
        (F.col("virtual_finish") + F.col("_copy") * F.col("source_size") / F.col("weight")).alias("_finish"),
    )
    rows = docs.join(turns, docs["_row"] == F.col("_id"))
    text = F.col(inside["text"])
    body = F.regexp_replace(text, "^" + SEPARATORS, "")
    tail = F.element_at(F.split(body, SEPARATORS, (F.col("_words") + 1).cast("int")), -1)
    head = F.expr("rtrim(left(_body, length(_body) - length(_tail)))")
    first = rows.withColumn("_body", body).withColumn("_tail", tail)
    cut_text = F.when(F.col("_words").isNull(), text).otherwise(head)
    shown = {"text": cut_text, "n_chars": F.when(F.col("_words").isNull(), F.col(inside.get("n_chars", inside["text"]))).otherwise(F.length(cut_text)).cast("long") if "n_chars" in inside else None}
    out = first.select(*[shown.get(c, F.col(inside[c])).alias(inside[c]) for c in given], "_finish", F.col(inside["doc_id"]).alias("_doc"))
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = out.repartitionByRange(parts, "_finish", "_doc").sortWithinPartitions("_finish", "_doc")
    return out.select(*[F.col(inside[c]).alias(c) for c in given])


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    plan = plan_mix(spark, docs)
    mixed = plan.select("doc_id", "size", "source_size", "target", "taken", "virtual_finish")
    return mixed.orderBy("virtual_finish", "doc_id")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 16) AS shuffled
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT source, source_size, 3 * source_size AS cap,
                  [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight,
                  row_number() OVER (ORDER BY source NULLS LAST) AS rank
           FROM sizes),
filled AS (SELECT *, row_number() OVER (ORDER BY cap / weight, rank) AS k,
                  CAST((SELECT sum(source_size) FROM sizes) AS DOUBLE) AS budget,
                  coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                  sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
           FROM ranked),
level AS (SELECT *, (budget - CAST(before AS DOUBLE)) / CAST(open_weight AS DOUBLE) AS v FROM filled),
stop AS (SELECT arg_min(v, k) AS v FROM level WHERE v <= cap / weight),
targets AS (SELECT source, source_size, weight,
                   CASE WHEN stop.v IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), weight * stop.v) END AS target
            FROM level LEFT JOIN stop ON true),
placed AS (SELECT s.doc_id, s.size, t.source_size, t.target, t.weight,
                  CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.shuffled, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
           FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passed AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS passes FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - passes * source_size - (cum - size))) AS BIGINT) AS taken,
       CAST(cum AS DOUBLE) / weight AS virtual_finish
FROM passed
"""
