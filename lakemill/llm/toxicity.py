"""Toxicity by weak supervision.

Voters: fixed lexicons of several kinds of abuse, lexicons of words and of word
beginnings learned from labelled rows, how many and how densely their entries
stand in a text, a likelihood sum, and patterns of address, masking, shouting
and stress. Each votes toxic, clean or abstains. Learned voters vote out of
fold: learnable rows are dealt into folds, and what votes on a row was learned
from the labels of the other folds, its thresholds included.

A generative label model (the vote distribution of each voter in each class) is
fitted by expectation-maximisation on the counts of vote patterns, without any
label: of the labels only the share of toxic rows enters, as the prior. Voters
whose votes go together beyond what the class explains are modelled jointly.
Its posteriors are the labels that a sparse linear classifier on word and
word-beginning features is trained on.

Counts for lexicons and vote patterns come from all learnable rows and whole
texts; the classifier is fitted on a sample of at most about `sample` of them.

Cases: null text is empty; very long texts are read whole; texts without known
features get the bias's score; no labelled row at all leaves the fixed lexicons
and the patterns to decide; repeated rows are treated alike; rows without
doc_id share a fold and are never labelled; a document labelled both ways
counts as toxic; other columns, whatever their names, are not read. doc_id only
joins labels and places rows in folds and the sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import combined, text_slices
from .language import fold
from .store import Workspace

BITS = 20
#: Lengths in bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8, 10)
#: Rows that the classifier is fitted on, at most about.
SAMPLE = 20_000
#: Code points handled at a time.
_SPAN = 1 << 20
#: Label rows that are sent to every executor; beyond that they are joined.
BROADCAST_ROWS = 500_000

#: Folds that learned voters are kept apart by, and the likelihood ratio that their strong entries must hold in the fold left out.
FOLDS, LEAST_RATIO = 3, 10
#: z scores tried for strong entries, least first.
STRONG_Z = (2.5, 3.0, 3.5, 4.0, 5.0, 6.0, 8.0)

# Words of abuse in the corpus languages (English, Spanish, French, German), by kind.
MIND = """
idiot moron stupid imbecile dumb dumbass fool retard clown
idiota imbécil estúpido estúpida payaso inútil
idiote imbécile stupide
dumm dummkopf blöd blödmann trottel
""".split()
WORTH = """
scum trash garbage loser worthless pathetic disgusting jerk freak vermin filth filthy crap
basura asqueroso
ordure déchet dégoûtant minable
abschaum müll versager ekelhaft wertlos
""".split()
PROFANITY = """
bastard asshole bitch whore slut fuck fucking fucker motherfucker shit bullshit cunt dick prick wanker twat
mierda puta cabrón gilipollas
merde salope connard connasse putain
scheiße arschloch hure schlampe
""".split()
THREAT = """
kill hate hang rape murder strangle
matar muere odio
crève haine tuer
stirb hasse töten umbringen
""".split()
KINDS = {"mind": MIND, "worth": WORTH, "profanity": PROFANITY, "threat": THREAT}
LEXICON = [word for kind in KINDS.values() for word in kind]

_ADDRESS = re.compile(r"(?i)\b(?:you|your|u|du|ihr|tu|vous|tú|eres|es|bist|are)\b(?:\W+\w+){0,2}?\W+(?:" + "|".join(sorted(set(LEXICON))) + r")\b")
_MASKED = re.compile(r"(?<![\w*])\w{1,2}\*{1,3}\w{1,3}(?![\w*])")
VOTERS = (*KINDS, "words", "beginnings", "several", "density", "likelihood", "address", "masked", "shouting", "stress")


def _tokens(batch: pa.RecordBatch):
    from .wordhash import Words, buffers

    return Words(*buffers(combined(batch, "text")), letters=True)


def _features(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs and whether the bucket came from a whole word."""
    from .wordhash import mix

    n = len(words.first) - 1
    owner = np.repeat(np.arange(n, dtype=np.uint64), words.counts())
    parts = [(owner, words.hash, 0)]
    length = words.end - words.start
    for k in BEGINNINGS:
        longer = np.flatnonzero(length > k)
        parts.append((owner[longer], words.spans(words.start[longer], words.start[longer] + k), k))
    keys = []
    for own, h, k in parts:
        bucket = mix(h + np.uint64(k)) >> np.uint64(64 - BITS)
        keys.append((own << np.uint64(BITS + 1)) | (bucket << np.uint64(1)) | np.uint64(k == 0))
    found = np.unique(np.concatenate(keys))
    return (found >> np.uint64(BITS + 1)).astype(np.int64), (found >> np.uint64(1) & np.uint64((1 << BITS) - 1)).astype(np.int64), found & np.uint64(1) == 1


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, rows = np.zeros((FOLDS, 2, 1 << BITS), np.int32), np.zeros((FOLDS, 2), np.int64)
    for batch in text_slices(batches):
        label, fold_of = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("toxic", "_fold"))
        owner, bucket, _ = _features(_tokens(batch))
        for k, c in product(range(FOLDS), (0, 1)):
            own = (label == c) & (fold_of == k)
            if own.any():
                seen[k, c] += np.bincount(bucket[own[owner]], minlength=1 << BITS).astype(np.int32)
                rows[k, c] += own.sum()
    found = np.flatnonzero(seen.any(axis=(0, 1)))
    counts = [pa.array(np.append(seen[k, c][found], rows[k, c]).astype(np.int64)) for k, c in product(range(FOLDS), (0, 1))]
    yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), *counts], ["feature", *COUNTS])


COUNTS = [f"n{c}_{k}" for k, c in product(range(FOLDS), (0, 1))]


@dataclass
class Lexicons:
    """What the voters know; learned parts by fold, from the labels of the other folds."""

    ratio: np.ndarray  # log-likelihood ratio of each bucket by fold; 0 where not told apart
    strong: np.ndarray  # buckets that stand for toxicity, by fold
    even: np.ndarray  # log-likelihood sum above which toxicity is likelier, by fold
    index: np.ndarray  # number of the classifier's features by bucket, -1 elsewhere

    def __post_init__(self):
        from .wordhash import Words, buffers, mix

        self.kinds = []
        for words in KINDS.values():
            w = Words(*buffers(pa.array([" ".join(words)])), letters=True)
            self.kinds.append(np.unique((mix(w.hash) >> np.uint64(64 - BITS)).astype(np.int64)))
        self.fixed = np.unique(np.concatenate(self.kinds))


def _evidence(n: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood ratio and z score of each bucket (n: clean, toxic), and whether it is told apart."""
    b, a = n
    log_odds = np.log((a + 0.5) / (rows[1] + 1)) - np.log((b + 0.5) / (rows[0] + 1))
    z = log_odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    return log_odds, z, (np.abs(z) >= 3) & (a + b >= 5)


def learn_lexicons(table: pa.Table) -> Lexicons:
    """table: feature, and rows of each class and fold that hold it (COUNTS); feature -1 has all rows."""
    feature = table.column("feature").to_numpy()
    n = np.stack([table.column(c).to_numpy() for c in COUNTS]).astype(np.float64).reshape(FOLDS, 2, -1)
    rows, n, at = n[:, :, feature < 0].sum(axis=2), n[:, :, feature >= 0], feature[feature >= 0].astype(np.int64)
    size = 1 << BITS
    ratio, strong, index = np.zeros((FOLDS, size), np.float32), np.zeros((FOLDS, size), bool), np.full(size, -1, np.int32)
    learned = [_evidence(n.sum(axis=0) - n[k], rows.sum(axis=0) - rows[k]) for k in range(FOLDS)]
    even = np.zeros(FOLDS)
    for k, (log_odds, z, told) in enumerate(learned):
        clean, toxic = rows.sum(axis=0) - rows[k] + 1
        b, a = (n.sum(axis=0) - n[k])[:, told] + 0.5
        # what the absence of every entry says is counted once, its part taken back where one is met
        absent = np.log1p(-np.minimum(a / toxic, 0.99)) - np.log1p(-np.minimum(b / clean, 0.99))
        ratio[k, at[told]] = np.clip(log_odds[told] - absent, -4, 4)
        even[k] = np.log(clean / toxic) - absent.sum()
        # the least z score whose entries hold the ratio in folds that neither learned them nor are voted on
        for least in STRONG_Z:
            held = np.zeros(2)
            for j in (j for j in range(FOLDS) if j != k):
                others = n.sum(axis=0) - n[k] - n[j]
                _, inner, _ = _evidence(others, rows.sum(axis=0) - rows[k] - rows[j])
                held += n[j][:, inner >= least].sum(axis=1) / (rows[j] + 1)
            if held[1] >= LEAST_RATIO * held[0]:
                break
        sure = told & (z >= least) & (log_odds >= np.log(LEAST_RATIO))
        strong[k, at[sure]] = True
    # all that are told apart are features; the classifier's penalty leaves few weights
    _, _, told = _evidence(n.sum(axis=0), rows.sum(axis=0))
    index[np.sort(at[told])] = np.arange(told.sum())
    out = Lexicons(ratio, strong, even, index)
    known = index.max() + 1
    for k, bucket in enumerate(b for b in out.fixed.tolist() if index[b] < 0):
        index[bucket] = known + k
    return out


def _kinds() -> np.ndarray:
    """2 for capitals, 1 for other letters, 0 for the rest of the code points."""
    global _KINDS
    if _KINDS is None:
        _KINDS = np.array([2 if c.isupper() and c.isalpha() else int(c.isalpha()) for c in map(chr, range(0x110000))], np.uint8)
    return _KINDS


_KINDS: np.ndarray | None = None


def capitals(text: str) -> tuple[int, int]:
    """Capitals and letters of a whole text."""
    upper = letters = 0
    for at in range(0, len(text), _SPAN):
        kind = _kinds()[np.frombuffer(text[at : at + _SPAN].encode("utf-32-le", "surrogatepass"), np.uint32)]
        upper, letters = upper + int(np.count_nonzero(kind == 2)), letters + int(np.count_nonzero(kind))
    return upper, letters


def votes(batch: pa.RecordBatch, lex: Lexicons, fold_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes (-1 clean, 0 abstain, 1 toxic) of every text, and its (text, feature) pairs."""
    words = _tokens(batch)
    n = batch.num_rows
    owner, bucket, whole = _features(words)
    fold_of = np.zeros(n, np.int64) if fold_of is None else fold_of
    place = fold_of[owner]
    vote = {}
    per_text = lambda mask: np.bincount(owner[mask], minlength=n)
    for name, kind in zip(KINDS, lex.kinds, strict=True):
        vote[name] = per_text(whole & np.isin(bucket, kind)) > 0
    strong, fixed = lex.strong[place, bucket], whole & np.isin(bucket, lex.fixed)
    by_word, by_start, entries = per_text(whole & strong), per_text(~whole & strong), per_text(whole & (strong | fixed))
    vote["words"] = np.where(by_word > 0, 1, -1)
    vote["beginnings"] = np.where(by_start > 0, 1, -1)
    vote["several"] = entries >= 2
    vote["density"] = (entries > 0) & (100 * entries >= words.counts())
    total = np.bincount(owner, weights=lex.ratio[place, bucket], minlength=n)
    vote["likelihood"] = np.where(total > lex.even[fold_of] + 2, 1, np.where(total < lex.even[fold_of] - 2, -1, 0))
    for name in ("address", "masked", "shouting", "stress"):
        vote[name] = np.zeros(n, np.int8)
    named = per_text(fixed)
    for k, text in enumerate(combined(batch, "text").to_pylist()):
        if text:
            (upper, letters), stress = capitals(text), text.count("!")
            vote["address"][k] = bool(named[k] and _ADDRESS.search(text))
            vote["masked"][k] = bool("*" in text and _MASKED.search(text))
            vote["shouting"][k] = 2 * upper > letters
            vote["stress"][k] = stress * 20 > len(text)
    feature = lex.index[bucket]
    return np.stack([vote[v] for v in VOTERS], axis=1).astype(np.int8), owner[feature >= 0], feature[feature >= 0].astype(np.int64)


def _voting(lexicons, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, powers = lexicons.value, 3 ** np.arange(len(VOTERS))
        for batch in text_slices(batches):
            vote, owner, feature = votes(batch, lex, batch.column("_fold").to_numpy().astype(np.int64))
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            drawn = batch.column("_position").to_numpy() < share
            vectors = [feature[a:b].astype("<i4").tobytes() if d else None for a, b, d in zip(cut, cut[1:], drawn, strict=False)]
            yield pa.RecordBatch.from_arrays(
                [pa.array((vote + 1) @ powers), batch.column("_position"), pa.array(vectors, pa.binary())], ["pattern", "position", "features"]
            )

    return run


def unpacked(pattern: np.ndarray) -> np.ndarray:
    """Votes of pattern numbers."""
    return (pattern[:, None] // 3 ** np.arange(len(VOTERS))) % 3 - 1


@dataclass
class LabelModel:
    """Vote distributions of blocks of voters in each class; voters of a block are dependent."""

    blocks: list[tuple[int, ...]]
    prior: float = 0.1
    fixed_prior: bool = False
    tables: list[np.ndarray] = field(default_factory=list)

    def _cells(self, vote: np.ndarray) -> list[np.ndarray]:
        return [sum((vote[:, v] + 1) * 3**k for k, v in enumerate(b)) for b in self.blocks]

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        odds = np.log(self.prior) - np.log1p(-self.prior)
        total = np.full(len(vote), odds)
        for table, cell in zip(self.tables, self._cells(vote), strict=True):
            total += np.log(table[1, cell]) - np.log(table[0, cell])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def _expected(self, block: tuple[int, ...]) -> np.ndarray:
        """Pseudo-counts: a voter is believed to be right more often than wrong."""
        out = np.ones((2, 1))
        for _ in block:
            each = np.array([[0.6, 0.3, 0.1], [0.2, 0.3, 0.5]])
            out = (each[:, :, None] * out[:, None, :]).reshape(2, -1)
        return 2 * out

    def fit(self, vote: np.ndarray, count: np.ndarray, rounds: int = 200) -> LabelModel:
        """vote: distinct patterns. Labels take no part."""
        self.tables = [t / t.sum(axis=1, keepdims=True) for t in map(self._expected, self.blocks)]
        p = self.posterior(vote)
        cells = self._cells(vote)
        for _ in range(rounds):
            weight = np.stack([count * (1 - p), count * p])
            mass = weight.sum(axis=1)
            if not self.fixed_prior:
                self.prior = float(np.clip((mass[1] + 1) / (mass.sum() + 2), 1e-4, 1 - 1e-4))
            self.tables = []
            for b, cell in zip(self.blocks, cells, strict=True):
                t = np.stack([np.bincount(cell, weights=w, minlength=3 ** len(b)) for w in weight]) + self._expected(b)
                self.tables.append(t / t.sum(axis=1, keepdims=True))
            new = self.posterior(vote)
            if np.abs(new - p).max(initial=0) < 1e-7:
                break
            p = new
        return self


def strongest_pair(vote: np.ndarray, count: np.ndarray, p: np.ndarray, blocks: list[tuple[int, ...]], widest: int) -> tuple[float, int, int]:
    """The blocks (by place) that hold the voters most correlated within a class, and that correlation."""
    best = (0.0, 0, 0)
    for i, j in combinations(range(len(blocks)), 2):
        if len(blocks[i]) + len(blocks[j]) > widest:
            continue
        for w in (count * (1 - p), count * p):
            total = w.sum()
            if total < 10:
                continue
            for a in blocks[i]:
                for b in blocks[j]:
                    x, y = vote[:, a] - (vote[:, a] @ w) / total, vote[:, b] - (vote[:, b] @ w) / total
                    var = ((x * x) @ w) * ((y * y) @ w)
                    if var > 0:
                        best = max(best, (float(abs((x * y) @ w) / np.sqrt(var)), i, j))
    return best


def fit_label_model(vote: np.ndarray, count: np.ndarray, prior: float | None = None, threshold: float = 0.3, widest: int = 4) -> LabelModel:
    """Joins the two most correlated blocks of voters and fits again, until none is above the threshold."""

    def model(blocks):
        return LabelModel(blocks, 0.1 if prior is None else prior, prior is not None).fit(vote, count)

    found = model([(v,) for v in range(vote.shape[1])])
    while True:
        strength, i, j = strongest_pair(vote, count, found.posterior(vote), found.blocks, widest)
        if strength < threshold:
            return found
        joined = tuple(sorted(found.blocks[i] + found.blocks[j]))
        found = model(sorted([*(b for k, b in enumerate(found.blocks) if k not in (i, j)), joined]))


def fit_linear(rows: list[np.ndarray], target: np.ndarray, size: int, *, l1: float = 5e-6, l2: float = 1e-5, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier on binary features and soft labels (full batch, adaptive steps, soft threshold)."""
    w, b = np.zeros(size), 0.0
    if not rows:
        return w, b
    at = np.concatenate(rows) if rows else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    g2, gb2, n = np.full(size, 1e-8), 1e-8, len(rows)
    b = float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    for _ in range(rounds):
        s = b + np.bincount(row, weights=w[at], minlength=n)
        e = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - target
        g = np.bincount(at, weights=e[row], minlength=size) / n + l2 * w
        g2 += g * g
        gb2 += e.mean() ** 2
        step = 0.3 / np.sqrt(g2)
        w = w - step * g
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * l1)
        b -= 0.3 / np.sqrt(gb2) * e.mean()
    return w, b


def _scoring(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, w, b = model.value
        for batch in text_slices(batches):
            owner, bucket, _ = _features(_tokens(batch))
            feature = index[bucket]
            hit = feature >= 0
            s = b + np.bincount(owner[hit], weights=w[feature[hit]], minlength=batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    return run


def _prior(counts: pa.Table) -> float | None:
    """Share of toxic rows among the labelled; None without both classes."""
    total = {c: sum(counts.filter(pc.less(counts.column("feature"), 0)).column(c).to_pylist()) for c in COUNTS}
    clean, toxic = (sum(n for c, n in total.items() if c.startswith(k)) for k in ("n0", "n1"))
    return toxic / (clean + toxic) if clean and toxic else None


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, learnable: Column, *, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score, predicted of every row. labels: doc_id, toxic. Learns from rows where `learnable` holds."""
    ws = Workspace(spark, "toxicity")
    own = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = ws.put(own, "labels")
    if own.count() <= BROADCAST_ROWS:
        own = F.broadcast(own)
    position = F.conv(F.substring(F.md5(F.concat(F.lit("toxicity:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10)
    fold_of = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    rows = docs.where(learnable).select("doc_id", "text", (position.cast("double") / float(1 << 32)).alias("_position"), fold_of.alias("_fold"))
    labelled = rows.join(own, "doc_id").select("text", "toxic", "_fold")
    found = labelled.mapInArrow(_class_counts, ", ".join(f"{c} long" for c in ["feature", *COUNTS]))
    counts = found.groupBy("feature").agg(*(F.sum(c).alias(c) for c in COUNTS))
    # told apart are only features of five rows or more
    counts = counts.where((F.col("feature") < 0) | (sum(F.col(c) for c in COUNTS) >= 5)).toArrow()
    lex = learn_lexicons(counts)
    share = min(1.0, sample / max(1, rows.count()))
    shared = spark.sparkContext.broadcast(lex)
    voted = ws.put(rows.select("text", "_position", "_fold").mapInArrow(_voting(shared, share), "pattern long, position double, features binary"), "votes")
    patterns = voted.groupBy("pattern").count().orderBy("pattern").collect()
    model = fit_label_model(unpacked(np.array([r["pattern"] for r in patterns], np.int64)), np.array([r["count"] for r in patterns], float), _prior(counts))
    drawn = voted.where("features IS NOT NULL").select("pattern", "features", "position").orderBy("position", "features").limit(2 * sample).toArrow()
    target = model.posterior(unpacked(drawn.column("pattern").to_numpy()))
    vectors = [np.frombuffer(x, "<i4").astype(np.int64) for x in drawn.column("features").to_pylist()]
    w, b = fit_linear(vectors, target, int(lex.index.max()) + 1)
    scorer = spark.sparkContext.broadcast((lex.index, w, b))
    return docs.select("doc_id", "text").mapInArrow(_scoring(scorer), "doc_id long, score double, predicted int")


def op3_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = score_toxicity(spark, docs, labels, fold(5) != 0)
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")
