"""I-Match document fingerprints over randomised lexicon subsets, in DataFrame functions only.

A text's terms are its distinct lower-cased runs of letters and digits. Terms
whose document frequency over all documents lies in a band are the lexicon:
with an average of a distinct terms a document, it holds at most a / low terms,
however many documents there are. Texts keep their lexicon terms, told by a
constant cuckoo table of 64-bit term hashes: a term stands at one of its two
places or is not of the lexicon.

The lexicon's subsets are drawn at random (by hash of the term) at several
levels: of level k, CLASSES subsets each hold one in 4**k of all terms. A text
of m lexicon terms is fingerprinted at the level of the largest 4**k <= m and at
the next, so its subsets hold about 4 terms to a quarter of one, and two texts
have a level in common unless one has over 4 times the other's terms. A
fingerprint lists, for each subset that a text has terms of, the hash of those
terms in sorted order, as `kchhhhhhhh` (level, subset, hash). Two fingerprints'
likeness is the share of equal entries among the subsets that either has terms
of, at the common level where that share is highest.

Cases: null text is empty; a text without lexicon terms is fingerprinted by a
hash of itself, under `~~`, and is like equal texts alone; equal texts have
equal fingerprints; very long texts have no more entries than others; documents
follow each other by doc_id, null ones first, rows of one doc_id by a hash of
their text; one document alone is its own next; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .store import Workspace, power_of_two

#: Bounds of a lexicon term's document frequency, as shares of all documents.
LOW, HIGH = 0.001, 0.05
CLASSES = 16
#: Documents whose successors are found in one task, at the most likely; runs are at most MOST_RUNS.
RUN, MOST_RUNS = 256, 1 << 16
#: A doc_id of many documents (null, for one) is split into so many runs.
SPLIT = 256

_LEVELS = "abcdefghijklmnop"
_SUBSETS = "0123456789abcdef"


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.expr("xxhash64('')"))


def cuckoo(keys: list[int]) -> list[int]:
    """A table of a power of two places in which every key stands at its low or at its high bits; 0 marks an empty place."""
    size = power_of_two(3 * len(keys) + 2, 4, 1 << 30)
    while True:
        table, placed = [0] * size, True
        for key in keys:
            at = key & (size - 1)
            for _ in range(500):
                key, table[at] = table[at], key
                if not key:
                    break
                low = key & (size - 1)
                at = ((key >> 32) & (size - 1)) if at == low else low
            else:
                placed = False
                break
        if placed:
            return table
        size *= 2


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> tuple[Column, int]:
    """The band's terms as a constant cuckoo table, and its number of places. At most (distinct terms a document) / low numbers come to the driver."""
    n = docs.count()
    seen = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    band = seen.where((F.col("df") >= low * n) & (F.col("df") <= max(1.0, high * n)) & (F.col("t") != 0))
    table = cuckoo(sorted(r["t"] for r in band.select("t").collect()))
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>"), len(table)


def in_lexicon(found: Column, marks: tuple[Column, int]) -> Column:
    """The lexicon terms, sorted, of each of several texts. The table is bound by a lambda, so that a plan holds it once."""
    table, size = marks

    def kept(table: Column) -> Column:
        at = lambda bits: F.element_at(table, bits.bitwiseAND(F.lit(size - 1)).cast("int") + 1)
        return F.transform(found, lambda f: F.array_sort(F.filter(f, lambda h: (at(h) == h) | (at(F.shiftright(h, 32)) == h))))

    return F.flatten(F.transform(F.array(table), kept))


def entries(used: Column) -> Column:
    """The entries of a text's two levels: for each subset the hash of its terms, which come sorted.

    What lambdas use is bound by lambdas (arrays of one element), or it would be worked out at every use."""
    level = F.floor((F.length(F.bin(F.size(used))) - 1) / 2).cast("int")
    share = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k * 2)
    levels = F.array(*[F.struct(k.alias("k"), share(k).alias("share"), F.substring(F.lit(_LEVELS), k + 1, F.lit(1)).alias("name")) for k in (level, level + 1)])

    def of(subset: Column) -> object:
        return lambda e: e.bitwiseAND(F.lit(CLASSES - 1)) == subset

    def at(level: Column) -> Column:
        # the subset takes the place of a term's four last bits
        placed = F.transform(used, lambda h: F.struct(h.alias("h"), F.pmod(F.xxhash64(h, level["k"]), level["share"]).alias("s")))
        inside = F.transform(F.filter(placed, lambda e: e["s"] < CLASSES), lambda e: F.shiftleft(F.shiftright(e["h"], 4), 4) + e["s"])
        groups = F.flatten(F.transform(F.array(inside), lambda x: F.array(*[F.filter(x, of(c)) for c in range(CLASSES)])))

        def shown(group: Column, c: Column) -> Column:
            code = F.right(F.concat(F.lit("0000000"), F.lower(F.hex(F.xxhash64(group).bitwiseAND(F.lit(0xFFFFFFFF))))), F.lit(8))
            return F.when(F.size(group) > 0, F.concat(level["name"], F.substring(F.lit(_SUBSETS), c + 1, F.lit(1)), code))

        return F.array_compact(F.transform(groups, shown))

    return F.flatten(F.transform(levels, at))


def fingerprints(rows: DataFrame, marks: tuple[Column, int], texts: dict[str, str]) -> DataFrame:
    """Adds a fingerprint column for each text column (out: text column), which it takes away.

    One projection a step, so that no step is worked out twice.
    """
    rest = [c for c in rows.columns if c not in texts.values()]
    plain = [F.coalesce(t, F.lit("")) for t in texts.values()]
    code = lambda t: F.concat(F.lit("~~"), F.right(F.concat(F.lit("0000000"), F.hex(F.xxhash64(t))), F.lit(8)))
    rows = rows.select(*rest, F.array(*[code(t) for t in plain]).alias("_codes"), F.array(*[terms(t) for t in plain]).alias("_terms"))
    rows = rows.select(*rest, "_codes", in_lexicon(F.col("_terms"), marks).alias("_terms"))
    rows = rows.select(*rest, "_codes", F.transform("_terms", lambda t: F.array_join(entries(t), " ")).alias("_entries"))
    shown = lambda k: F.when(F.col("_entries")[k] == "", F.col("_codes")[k]).otherwise(F.col("_entries")[k])
    return rows.select(*rest, *[shown(k).alias(o) for k, o in enumerate(texts)])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries of two fingerprints at their best common level, 0 to 1."""
    x, y = F.split(a, " "), F.split(b, " ")
    levels = lambda v: F.array_distinct(F.transform(v, lambda e: F.left(e, F.lit(1))))

    def share(level: Column) -> Column:
        here = lambda v: F.filter(v, lambda e: F.startswith(e, level))
        subsets = lambda v: F.transform(here(v), lambda e: F.left(e, F.lit(2)))
        return F.size(F.array_intersect(here(x), here(y))) / F.size(F.array_union(subsets(x), subsets(y)))

    common = F.array_intersect(levels(x), levels(y))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(common, share)), F.lit(0.0)))


def _run(docs: DataFrame) -> Column:
    """Ascending numbers of runs of consecutive documents, about RUN in each, whatever the spread of their ids.

    Runs lie between quantiles of doc_id, found by binary search. An id that two quantiles share holds many
    documents, as null may: its run is split by the hash that puts them in order.
    """
    n = docs.count()
    runs = power_of_two(n / RUN, 1, MOST_RUNS)
    shares = [k / runs for k in range(1, runs)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, min(16 * runs, 1 << 20))).first()[0] if shares else None
    bounds = sorted(found or [])
    bounds += [(1 << 63) - 1] * (runs - len(bounds))
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(runs.bit_length() - 1))]) if runs > 1 else F.lit([]).cast("array<int>")
    at = F.col("doc_id").cast("long")
    place = F.aggregate(steps, F.lit(0), lambda a, step: F.when(F.element_at(table, a + step) <= at, a + step).otherwise(a))
    many = sorted({a for a, b in zip(bounds, bounds[1:], strict=False) if a == b})
    split = F.col("doc_id").isNull() | (at.isin(many) if many else F.lit(False))
    part = F.when(split, F.shiftrightunsigned("h", 64 - SPLIT.bit_length() + 1)).otherwise(F.lit(0).cast("long"))
    return F.coalesce(place, F.lit(-1)) * F.lit(2 * SPLIT).cast("long") + part


def _runs(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text, run, place, next_text) and what follows each run (run, first_text).

    Documents are dealt into runs, one shuffle of the texts. next_text is null
    for the last of a run; the first of the next run that is not empty follows
    it, and the first of all follows the last.
    """
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # as unsigned numbers, hashes are in the order of their first bits
    dealt = dealt.withColumn("h", F.xxhash64("text")).select("*", _run(docs).alias("run"), F.col("h").bitwiseXOR(F.lit(-(1 << 63))).alias("o"))
    ws = Workspace(spark, "next")
    heads = ws.put(dealt.groupBy("run").agg(F.min(F.struct("doc_id", "o", "text")).alias("head")).select("run", F.col("head.text").alias("text")), "heads")
    first = heads.agg(F.min("run")).first()[0]
    # one small row a run, at most MOST_RUNS and SPLIT for each of at most as many ids of many documents
    after = F.coalesce(F.lead("run").over(W.orderBy("run")), F.lit(first))
    follow = heads.select("run", after.alias("after")).join(heads.select(F.col("run").alias("after"), F.col("text").alias("first_text")), "after")
    order = W.partitionBy("run").orderBy("doc_id", "o", "text")
    rows = dealt.select("run", "doc_id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"))
    return rows, ws.put(follow.select("run", "first_text"), "follow")


def with_next_text(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by ascending doc_id; the first's for the last."""
    rows, follow = _runs(spark, docs)
    return rows.join(follow, "run").select("doc_id", "text", F.coalesce("next_text", "first_text").alias("next_text"))


def op2_fingerprint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marks = lexicon(docs)
    n = F.length("text")
    kept = n - F.floor(n / 4).cast("int")
    rows, follow = _runs(spark, docs)
    rows = rows.join(follow, "run").withColumn("after", F.coalesce("next_text", "first_text"))
    edited = rows.select("run", "place", "doc_id", "text", n.cast("long").alias("n_chars"), F.concat(F.left("text", kept), F.left("after", n - kept)).alias("edited"))
    edited = edited.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    marked = fingerprints(edited, marks, {"fingerprint": "text", "edited_fingerprint": "edited"})
    # the next document's fingerprint is worked out with that document, the next run's first once a run
    heads = fingerprints(follow, marks, {"first_fingerprint": "first_text"})
    after = F.coalesce(F.lead("fingerprint").over(W.partitionBy("run").orderBy("place")), F.col("first_fingerprint"))
    marked = marked.join(heads, "run").withColumn("after", after)
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("after")).alias("near_next"),
    )
