import re

import pytest

from lakemill.llm import pii
from lakemill.llm.pii import detect, render, replace_entities, surrogate

TEXT = (
    'Mail jane.doe@site.org, JANE.DOE@SITE.ORG. Call +1 (017) 555-7713 or +10175557713. Card 4111 1111 1111 1111, 4111111111111111. '
    'Host 10.1.2.3 and 97.51.17.173. token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" SSN 123-45-6789. '
    "Mr Smith met Anna Smith; Иван Петров wrote. IBAN DE89 3704 0044 0532 0130 00. Version 2.0. in 2024 cost 1,234,567.89."
)


def _rewrite(text):
    out, at = [], 0
    for a, b, kind, canonical in detect(text):
        out += [text[at:a], render(kind, text[a:b], surrogate(b"k", kind, canonical, 0))]
        at = b
    return "".join(out) + text[at:]


def test_kinds_formats_and_coreference():
    kinds = [k.split(":")[0] for _, _, k, _ in detect(TEXT)]
    assert [kinds.count(k) for k in ("email", "phone", "card", "ip", "secret", "ssn", "iban")] == [2, 2, 2, 2, 1, 1, 1]
    new = _rewrite(TEXT)
    for old in ("jane.doe", "JANE.DOE", "555-7713", "5557713", "4111", "97.51.17.173", "04dbebab", "123-45-6789", "Smith", "Иван", "3704"):
        assert old not in new
    for kept in ("Version 2.0. in 2024 cost 1,234,567.89.", "Host 10.", "Mr "):
        assert kept in new
    mails = re.findall(r"\S+@[\w.]+\w", new)
    assert mails[0].lower() == mails[1].lower() and mails[1].isupper()
    phones = re.findall(r"\+1[ \d()-]{9,}\d", new)
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1])
    cards = re.findall(r"Card ([\d ]{19}), (\d{16})", new)[0]
    assert cards[0].replace(" ", "") == cards[1] and pii._luhn(cards[1]) == 0
    assert re.fullmatch(r"[0-9a-f]{40}", re.search(r'token = "(\w+)"', new)[1])
    names = re.search(r"Mr (\w+) met (\w+) (\w+); (\w+) (\w+) wrote", new)
    assert names[1] == names[3] and names[2] in pii.FEMALE["latin"] and names[4] in pii.MALE["cyrillic"]


def test_clean_text_stays():
    for text in ("", "Plain text, with 12 numbers 3.14 and 2024-01-02.", "THE!! WH*** a$$$ 10 %%%", "x" * 100_000):
        assert not detect(text) and _rewrite(text) == text


def test_edges(spark, nasty, empty):
    got = replace_entities(spark, nasty, b"k").toArrow().to_pylist()
    want = nasty.toArrow().to_pylist()
    key = lambda r: (r["doc_id"], r["size"])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert {k: v for k, v in a.items() if k not in ("text", "n_entities")} == {k: v for k, v in b.items() if k != "text"}
        assert (a["text"] == b["text"]) == (a["n_entities"] == 0)
    assert replace_entities(spark, empty, b"k").count() == 0


@pytest.mark.parametrize("bound", [0, 1000])
def test_distinct_entities_stay_distinct(spark, bound):
    names = [f"Frau {a}{b}{c}" for a in "BCDF" for b in "aeiou" for c in ("rn", "ld", "nt", "lk")]
    docs = spark.createDataFrame([(i, f"{n} spoke. {n} left.") for i, n in enumerate(names)], "doc_id long, text string")
    got = replace_entities(spark, docs, b"k", broadcast_entities=bound).toArrow().to_pylist()
    new = [re.fullmatch(r"Frau (\S+) spoke\. Frau (\S+) left\.", r["text"]).groups() for r in got]
    assert all(a == b for a, b in new) and len({a for a, _ in new}) == len(names)
    assert not {a.lower() for a, _ in new} & {n.split()[1].lower() for n in names}


def test_given_names_clash_and_settle(spark):
    """Twenty distinct given names of one pool: attempts must part them."""
    names = pii.FEMALE["latin"]
    docs = spark.createDataFrame([(i, f"{n} Miller") for i, n in enumerate(names)], "doc_id long, text string")
    for bound in (0, 1000):
        got = {r["doc_id"]: r["text"].split()[0] for r in replace_entities(spark, docs, b"k", broadcast_entities=bound).toArrow().to_pylist()}
        assert len(set(got.values())) == len(names) and not set(got.values()) & set(names)


def test_later_bare_names_go_with_their_person():
    new = _rewrite("Anna Smith wrote. Smith said so. Anna left. Blacksmith stays.")
    names = re.fullmatch(r"(\w+) (\w+) wrote\. (\w+) said so\. (\w+) left\. Blacksmith stays\.", new)
    assert names and names[1] == names[4] != "Anna" and names[2] == names[3] != "Smith"


def test_domains_stay_distinct():
    domains = [f"{a}.org" for a in "abcdefghijklmnopqrstuvwxyz"] + [f"{a}{b}.org" for a in "abcdef" for b in range(10)] + ["a-b.c.org", "ab-c.org"]
    new = [surrogate(b"k", "email", f"x@{d}", 0).partition("@")[2] for d in domains]
    assert len(set(new)) == len(domains)
    assert all([c.isalpha() for c in a] == [c.isalpha() for c in b] for a, b in zip(domains, new, strict=True))


def test_many_entities_in_one_text():
    text = " ".join(f"u{k}@site.org" for k in range(20_000))
    assert len(detect(text)) == 20_000


def test_bound_does_not_matter_with_null_and_shared_ids(spark):
    given = [("Frau " if k % 2 else "Mr ") + f"Anna{chr(97 + k % 26)} Smith{chr(97 + k // 26)}" for k in range(120)] + ["Anna Smith", "Dr. Anna Smith"]
    rows = [(None if k % 3 else 7, f"{n} spoke.", "x") for k, n in enumerate(given)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_entities string")
    got = [sorted(r["text"] for r in replace_entities(spark, docs, b"k", broadcast_entities=b).toArrow().to_pylist()) for b in (0, 10**6)]
    assert got[0] == got[1] and len(set(got[0])) == len(set(given))
    assert [c for c, _ in replace_entities(spark, docs, b"k").dtypes] == ["doc_id", "text", "n_entities"]


def test_surrogates_of_a_whole_table_are_distinct(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    old = {r["doc_id"]: r["text"] for r in docs.toArrow().to_pylist()}
    new = {r["doc_id"]: r["text"] for r in replace_entities(spark, docs, b"k").toArrow().to_pylist()}
    there, back, entities = {}, {}, set()
    for i, text in old.items():
        spans = detect(text or "")
        entities |= {(k, c) for _, _, k, c in spans}
        shift = 0
        for n, (a, b, kind, canonical) in enumerate(spans):
            after = spans[n + 1][0] if n + 1 < len(spans) else len(text)
            between = text[b:after]
            end = new[i].index(between, a + shift) if between else len(new[i]) if after == len(text) else None
            if end is None:
                break
            found = (kind.split(":")[0], new[i][a + shift : end].lower() if kind.split(":")[0] in ("email", "given", "family") else re.sub(r"[^0-9A-Za-z.]", "", new[i][a + shift : end]))
            if kind.split(":")[0] in ("email", "given", "family"):
                assert there.setdefault((kind, canonical), found) == found
                assert back.setdefault(found, (kind, canonical)) == (kind, canonical)
                assert (kind, found[1]) not in entities
            shift = end - b
    assert there
