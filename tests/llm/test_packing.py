import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from lakemill.llm.packing import pack_documents, public_vocabulary, shortest_pack_first, slot_rows
from lakemill.llm.tokens import Encoder
from lakemill.llm.wordhash import buffers


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ODD = ["a  b", "a\n \n b", " x  ", "\n\n a", "don't  'll 12 3a", "é 　 b", "<|endoftext|> a", "a \n b\n  c", "", "   ", " \n", None, "x \n y", "x ", "\x1c a \x1c b", "1 'll 're's"]


def test_ids_are_the_librarys(library, listed):
    encoder = Encoder(*public_vocabulary())
    texts = ODD + [r[1] for r in listed]
    for some in (texts, ODD, *([t] for t in ODD)):
        ids, at = encoder.batch(*buffers(pa.array(some, pa.string())))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library(t) for t in some]


@pytest.mark.parametrize("histogram", [{}, {1: 5}, {1023: 3, 1: 2, 2: 1}, {512: 7, 300: 10, 212: 3}, {k: 1 + k % 3 for k in range(1, 1024)}])
def test_patterns_hold_the_histogram(histogram):
    patterns = shortest_pack_first(histogram, 1024)
    seen = {}
    for count, pattern in patterns:
        assert sum(k * n for k, n in pattern.items()) <= 1024
        for k, n in pattern.items():
            seen[k] = seen.get(k, 0) + n * count
    assert seen == histogram
    taken = {}
    for length, low, high, *_ in slot_rows(patterns):
        assert low == taken.get(length, 0)
        taken[length] = high
    assert taken == histogram


def test_every_id_once(spark, nasty, listed, library):
    path, pattern = public_vocabulary()
    got = pack_documents(spark, nasty, ranks_path=path, pattern=pattern, keep_ids=True).toArrow().to_pylist()
    want = sorted(tuple(library(r[1]) + [0]) for r in listed)
    by_doc = {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_doc.setdefault(r["doc_id"], []).append(r)
    whole = []
    for parts in by_doc.values():
        copies = sum(p["start"] == 0 for p in parts)
        for c in range(copies):
            own = sorted(parts, key=lambda p: p["start"])[c::copies]
            ids = np.frombuffer(b"".join(p["ids"] for p in own), "<u4").tolist()
            assert [p["start"] for p in own] == list(np.cumsum([0] + [p["length"] for p in own])[:-1]) and own[0]["doc_tokens"] == len(ids)
            whole.append(tuple(ids))
    assert sorted(whole) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(sequences) == list(range(len(sequences)))


def test_empty(spark, empty):
    path, pattern = public_vocabulary()
    assert pack_documents(spark, empty, ranks_path=path, pattern=pattern).count() == 0
