"""Personal data: detected entities get keyed surrogates of their own type and format.

An entity has a kind and a canonical form (an e-mail address in lower case, a
number's digits, each token of a name), so the same entity in two formats is
one. Its surrogate is drawn by HMAC from key, kind, canonical form and attempt:
digits for digits, letters for letters, a valid check digit where there was
one, octets of the same network class, names of the same gender and script. It
is then written in the format and case of each occurrence.

All distinct entities of the corpus are checked together: two of a kind may
not share a surrogate, and a surrogate may not be another entity's canonical
form. The losers of a clash go on to their next attempt until none is left;
only they need to be looked up when texts are rewritten.

Cases: null text stays null; empty and clean texts are returned as they are;
very long texts are read whole; repeated rows are rewritten alike; an empty
table gives an empty result; all other columns pass through.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import combined, fresh, text_slices
from .store import Workspace

#: Attempts of clashing entities that are sent to every executor; beyond that they are joined to documents.
BROADCAST_ENTITIES = 200_000
MOST_ROUNDS = 50

# Given names by gender and script, and titles by gender.
FEMALE = {
    "latin": "Anna Maria Emma Julia Laura Sophie Clara Elena Alice Marie Jane Mary Susan Linda Karen Sarah Ingrid Claire Lucía Carmen".split(),
    "cyrillic": "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    "greek": "Μαρία Ελένη Αικατερίνη Σοφία Άννα".split(),
}
MALE = {
    "latin": "John James Robert Michael David Thomas Peter Paul Daniel Mark Hans Klaus Jean Pierre Luc Carlos José Juan Miguel Stefan".split(),
    "cyrillic": "Иван Сергей Алексей Дмитрий Андрей Михаил Николай Павел".split(),
    "greek": "Γιώργος Δημήτρης Νίκος Κώστας Ιωάννης".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Mme Mlle Madame Señora Sra".split(), "m": "Mr Herr Monsieur Señor Sir".split(), "n": "Dr Prof".split()}
# Syllables that family names are made of.
SYLLABLES = {
    "latin": "ba bel cor da del fen gar hal jor ka lan mer nor ol pel ran sel tor val wen".split(),
    "cyrillic": "ба вел гор да лен мар нов ор пет ран сав тор".split(),
    "greek": "βα γελ δορ κα λεν μαρ νικ ορ παν σαρ τορ".split(),
}

_WORD = r"[^\W\d_]"
_GIVEN = {n: ("f", s) for s, v in FEMALE.items() for n in v} | {n: ("m", s) for s, v in MALE.items() for n in v}
_TITLE = {t: g for g, v in TITLES.items() for t in v}
_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")
_SECRET = re.compile(r"(?i)\b(?:token|password|passwd|pwd|secret|api[ _-]?key|access[ _-]?key)\b[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_+/=.~-]{8,})")
_BARE = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|(?=[0-9A-Fa-f]*\d)(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}))\b")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
_CARD = re.compile(r"(?<![\d.,-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?![\d-])")
#: Between the parts of a number: a blank, point or dash, or what noise and table cells put there.
_GAP = r"[!*$%&#]{0,3} ?(?:\| )?[.-]?"
_PHONE = re.compile(
    r"(?<![\w.])(?:\+\d{8,15}|\+\d{1,3}" + _GAP + r"\(\d{1,4}\)" + _GAP + r"\d{2,4}(?:[ .-]?\d{2,4}){0,3}|\+\d{1,3}(?:[ .-]\d{2,4}){2,5}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?![\w-])"
)
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")
_NAME = re.compile(
    rf"\b(?:(?P<title>{'|'.join(sorted(_TITLE, key=len, reverse=True))})\.?\s+(?P<first>[^\W\d_a-z]{_WORD}+)(?:\s+(?P<last>[^\W\d_a-z]{_WORD}+))?"
    rf"|(?P<given>{'|'.join(sorted(_GIVEN, key=len, reverse=True))})\s+(?P<family>[^\W\d_a-z]{_WORD}+))\b"
)
_DIGIT = re.compile(r"\d")
_CAPITAL = re.compile(rf"\b[^\W\d_a-z]{_WORD}+\b")

#: A replaced span: start, end, kind and canonical form.
Span = tuple[int, int, str, str]


def _script(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000 else "latin"


def _secret(value: str) -> str:
    return value.lower() if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) else value


def detect(text: str) -> list[Span]:
    """Entities of a text, in order, without overlaps; earlier rules win."""
    found: list[Span] = []

    def add(a: int, b: int, kind: str, canonical: str) -> None:
        k = bisect(found, (a,))
        if (k == 0 or found[k - 1][1] <= a) and (k == len(found) or found[k][0] >= b):
            found.insert(k, (a, b, kind, canonical))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            add(*m.span(), "email", m[0].lower())
    for m in _SECRET.finditer(text):
        if _DIGIT.search(m[1]):
            add(*m.span(1), "secret", _secret(m[1]))
    if _DIGIT.search(text):
        for m in _BARE.finditer(text):
            add(*m.span(), "secret", _secret(m[0]))
        for m in _IBAN.finditer(text):
            add(*m.span(), "iban", m[0].replace(" ", ""))
        for kind, rule in (("card", _CARD), ("phone", _PHONE), ("ssn", _SSN)):
            for m in rule.finditer(text):
                add(*m.span(), kind, re.sub(r"\D", "", m[0]))
        for m in _IP.finditer(text):
            add(*m.span(), "ip", ".".join(str(int(x)) for x in m[0].split(".")))
    for m in _NAME.finditer(text):
        if m["given"]:
            gender, script = _GIVEN[m["given"]]
            add(*m.span("given"), f"given:{gender}:{script}", m["given"].lower())
            add(*m.span("family"), f"family:{_script(m['family'])}", m["family"].lower())
        elif m["last"]:
            gender, script = _GIVEN.get(m["first"], (_TITLE[m["title"]], _script(m["first"])))
            add(*m.span("first"), f"given:{gender}:{script}", m["first"].lower())
            add(*m.span("last"), f"family:{_script(m['last'])}", m["last"].lower())
        else:
            add(*m.span("first"), f"family:{_script(m['first'])}", m["first"].lower())
    # the names of persons that the text has introduced, where they stand alone
    people = {text[a:b]: (kind, canonical) for a, b, kind, canonical in found if kind.startswith(("given:", "family:"))}
    if people:
        for m in _CAPITAL.finditer(text):
            if m[0] in people:
                add(*m.span(), *people[m[0]])
    return found


class _Stream:
    """Keyed random numbers."""

    def __init__(self, key: bytes, *what: object):
        self._key, self._what, self._n, self._left = key, "\x1f".join(map(str, what)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self._left) < 4:
            self._left += hmac.new(self._key, self._what + self._n.to_bytes(4, "big"), hashlib.sha256).digest()
            self._n += 1
        value, self._left = int.from_bytes(self._left[:4], "big"), self._left[4:]
        return value % n


def _same_classes(text: str, draw: _Stream) -> str:
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isascii() and c.isalpha():
            out.append(chr((97 if c.islower() else 65) + draw.below(26)))
        else:
            out.append(c)
    return "".join(out)


def _permuted(text: str, key: bytes, what: str) -> str:
    """Another text of the same classes of characters; distinct texts give distinct ones (a Feistel walk over all of them)."""
    sizes = [10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 1 for c in text]
    number, total = 0, 1
    for c, size in zip(text, sizes, strict=True):
        number, total = number * size + (int(c) if size == 10 else ord(c.lower()) - 97 if size == 26 else 0), total * size
    half = max(1, (total - 1).bit_length() + 1 >> 1)
    pattern = "".join({10: "0", 26: "a", 1: c}[size] for c, size in zip(text, sizes, strict=True))
    while True:
        left, right = number >> half, number & (1 << half) - 1
        for turn in range(6):
            mark = hmac.new(key, f"domain\x1f{what}\x1f{pattern}\x1f{turn}\x1f{right}".encode(), hashlib.sha256).digest()
            left, right = right, left ^ int.from_bytes(mark, "big") & (1 << half) - 1
        number = left << half | right
        if number < total:
            break
    out = []
    for c, size in zip(reversed(text), reversed(sizes), strict=True):
        number, digit = divmod(number, size)
        out.append(str(digit) if size == 10 else chr((97 if c.islower() else 65) + digit) if size == 26 else c)
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def surrogate(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    """The canonical form of the replacement."""
    draw = _Stream(key, kind, canonical, attempt)
    base = kind.split(":")[0]
    if base == "email":
        local, _, domain = canonical.partition("@")
        labels = domain.split(".")
        # a domain keeps its top level; all addresses of one domain go to one
        host = _permuted(".".join(labels[:-1]), key, labels[-1])
        return f"{_same_classes(local, draw)}@{host}.{labels[-1]}"
    if base == "ip":
        old = [int(x) for x in canonical.split(".")]
        keep = 1 if old[0] in (10, 127) else 2 if old[:2] == [192, 168] or old[0] == 172 and 16 <= old[1] < 32 else 0
        new = [*old[:keep], *(draw.below(256) for _ in range(4 - keep))]
        if not keep:
            new[0] = 11 + draw.below(115)
        return ".".join(map(str, new))
    if base == "card":
        new = canonical[0] + _same_classes(canonical[1:], draw)
        if _luhn(canonical) == 0:
            new = next(new[:-1] + str(d) for d in range(10) if _luhn(new[:-1] + str(d)) == 0)
        return new
    if base == "phone":
        keep = 1 if canonical[0] == "1" else min(2, len(canonical) - 7) if len(canonical) > 10 else 0
        return canonical[:keep] + _same_classes(canonical[keep:], draw)
    if base == "iban":
        body = _same_classes(canonical[4:], draw)
        number = "".join(str(int(c, 36)) for c in body + canonical[:2] + "00")
        return f"{canonical[:2]}{98 - int(number) % 97:02d}{body}"
    if base == "given":
        _, gender, script = kind.split(":")
        pool = FEMALE[script] if gender == "f" else MALE[script] if gender == "m" else FEMALE[script] + MALE[script]
        name = pool[draw.below(len(pool))].lower()
        # beyond the pool, double names of it
        return name if attempt < 8 else f"{name}-{pool[draw.below(len(pool))].lower()}" + "".join(SYLLABLES[script][draw.below(8)] for _ in range((attempt - 8) // 8))
    if base == "family":
        parts = SYLLABLES[kind.split(":")[1]]
        return "".join(parts[draw.below(len(parts))] for _ in range(3 + attempt // 4))
    if re.fullmatch(r"[0-9a-f]+", canonical) and not canonical.isdigit():
        return "".join("0123456789abcdef"[draw.below(16)] for _ in canonical)
    return _same_classes(canonical, draw)


def render(kind: str, original: str, new: str) -> str:
    """The surrogate in the format and case of the occurrence."""
    base = kind.split(":")[0]
    if base in ("card", "phone", "ssn"):
        digits = iter(new)
        return "".join(next(digits) if c.isdigit() else c for c in original)
    if base == "iban":
        chars = iter(new)
        return "".join(c if c == " " else next(chars) for c in original)
    if original.upper() == original and original.lower() != original:
        return new.upper()
    if base in ("given", "family") and original[:1].isupper():
        return "-".join(x.capitalize() for x in new.split("-"))
    return new


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        found = sorted({(k, c) for t in combined(batch, "text").to_pylist() if t for _, _, k, c in detect(t)})
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], ["kind", "canonical"])


def _proposals(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "canonical", "attempt")), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(key, *r) for r in rows], pa.string())], [*batch.schema.names, "surrogate"])

    return run


def settle(ws: Workspace, docs: DataFrame, key: bytes) -> DataFrame:
    """kind, canonical, attempt, surrogate of every distinct entity, without clashes."""
    shape = "kind string, canonical string, attempt int"
    entities = ws.put(docs.select("text").mapInArrow(_entities, "kind string, canonical string").distinct().withColumn("attempt", F.lit(0)), "entities")
    for _ in range(MOST_ROUNDS):
        made = ws.put(entities.mapInArrow(_proposals(key), shape + ", surrogate string"), "proposals")
        # the earliest attempt keeps a surrogate, then the smallest form; real entities keep their own form.
        # Given names of either gender and of none share their names, so they are held against each other.
        space = F.regexp_replace("kind", "^given:[^:]*:", "given:").alias("space")
        placed = made.select("*", space)
        owner = placed.groupBy("space", "surrogate").agg(F.min(F.struct("attempt", "canonical", "kind")).alias("first"))
        real = placed.select("space", F.col("canonical").alias("surrogate"), F.lit(True).alias("real")).distinct()
        judged = placed.join(owner, ["space", "surrogate"]).join(real, ["space", "surrogate"], "left")
        lost = F.col("real").isNotNull() | (F.col("first.canonical") != F.col("canonical")) | (F.col("first.kind") != F.col("kind"))
        judged = ws.put(judged.select("kind", "canonical", "attempt", "surrogate", lost.alias("lost")), "judged")
        if not judged.where("lost").limit(1).count():
            return judged.drop("lost")
        ws.drop(entities, made)
        entities = ws.put(judged.select("kind", "canonical", (F.col("attempt") + F.col("lost").cast("int")).alias("attempt")), "entities")
        ws.drop(judged)
    raise RuntimeError(f"surrogates still clash after {MOST_ROUNDS} attempts")


def _rewriting(key: bytes, exceptions, counted: str, own: str | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(exceptions.value) if exceptions is not None else {}
        for batch in text_slices(batches):
            names = batch.schema.names
            listed = batch.column(own).to_pylist() if own else [None] * batch.num_rows
            texts, counts = [], []
            for text, more in zip(combined(batch, "text").to_pylist(), listed, strict=True):
                spans = detect(text) if text else []
                later = known | {(x["kind"], x["canonical"]): x["attempt"] for x in more} if more else known
                out, at = [], 0
                for a, b, kind, canonical in spans:
                    new = surrogate(key, kind, canonical, later.get((kind, canonical), 0))
                    out += [text[at:a], render(kind, text[a:b], new)]
                    at = b
                texts.append("".join(out) + text[at:] if spans else text)
                counts.append(len(spans))
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names if c != own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*(c for c in names if c != own), counted])

    return run


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        texts = zip(*(batch.column(c).to_pylist() for c in ("t", "u")), combined(batch, "text").to_pylist(), strict=True)
        rows = sorted({(i, j, k, c) for i, j, t in texts if t for _, _, k, c in detect(t)})
        types = (pa.int64(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(types)], ["t", "u", "kind", "canonical"])


def replace_entities(spark: SparkSession, docs: DataFrame, key: bytes, *, broadcast_entities: int = BROADCAST_ENTITIES, counted: str = "n_entities") -> DataFrame:
    """The documents' columns with text rewritten, and the number of its entities, which replaces a column of the name `counted`.

    Entities that lost their first surrogate are sent to all executors, or, beyond `broadcast_entities`, joined to the
    texts that have them (told by 96 bits of hash); the result is the same."""
    ws = Workspace(spark, "pii")
    settled = settle(ws, docs, key)
    later = settled.where("attempt > 0").select("kind", "canonical", "attempt")
    docs = docs.select(*[c for c in docs.columns if c.lower() != counted.lower()])
    schema = T.StructType([*docs.schema.fields, T.StructField(counted, T.LongType())])
    if later.count() <= broadcast_entities:
        listed = [((r["kind"], r["canonical"]), r["attempt"]) for r in later.collect()]
        return docs.mapInArrow(_rewriting(key, spark.sparkContext.broadcast(listed) if listed else None, counted), schema)
    t, u, own = (fresh(c, docs.columns) for c in ("text_mark", "text_more", "text_later"))
    marks = F.xxhash64("text"), F.hash("text")
    where = docs.select("text", marks[0].alias("t"), marks[1].alias("u")).mapInArrow(_occurrences, "t long, u int, kind string, canonical string").distinct()
    found = where.join(later, ["kind", "canonical"]).groupBy("t", "u").agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias(own)).toDF(t, u, own)
    named = docs.select("*", marks[0].alias(t), marks[1].alias(u)).join(found, [t, u], "left").select(*docs.columns, own)
    return named.mapInArrow(_rewriting(key, None, counted, own), schema)


#: The key of the registered query and pipeline; a deployment passes its own.
KEY = b"documented test key"


def op5_replace_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_entities(spark, docs, KEY).withColumn("n_chars", F.length("text").cast("long"))
