import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from factlode.llm.bpe import SegmentEncoder, TextEncoder
from factlode.llm.packing import LevelPacker, pack_documents
from factlode.llm.rows import tokenizer_path
from factlode.llm.token_counts import token_counts


def texts():
    rng = random.Random(0)
    alphabet = ["a", "b", " ", "  ", "'", "\n", "\t", "<|endoftext|>", "<", "é", "1", ".", ",", "the", " of", "'ll", "日本", " ", "\U0001f642", "\U000323b0", "՘"]
    made = [None, "", " ", "  lead", "trail ", "aaaaaaaa" * 90, "ab" * 700, "foo\n bar", "foo\n", "x" + " " * 6000 + "\n" * 6000 + "y", "é" * 3000, "word " * 3000]
    return made + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]


@pytest.fixture(scope="module")
def want():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts()], add_special_tokens=False)]


def test_ids_and_counts_equal_the_library(want):
    for remember in (0, 50, 10**6):
        ids, counts = SegmentEncoder(tokenizer_path(), True, remember), SegmentEncoder(tokenizer_path(), False, remember)
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in ids.encode(texts())] == want
            assert counts.encode(texts()) == [len(w) for w in want]
    assert [np.frombuffer(x, "<u4").tolist() for x in TextEncoder(tokenizer_path()).encode(texts())] == want


def test_token_counts(spark, want):
    rows = list(enumerate(texts())) + [(None, "a b")]
    frame = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, n_tokens int")
    got = token_counts(frame, tokenizer_path(), limit=100).collect()
    assert [r.n_tokens for r in got[:-1]] == [len(w) for w in want] and got[-1].doc_id is None
    assert all(r.n_bytes == len((t or "").encode()) and r.over_limit == (r.n_tokens > 100) for r, (_, t) in zip(got, rows))
    assert token_counts(frame.limit(0), tokenizer_path()).collect() == []


@pytest.mark.parametrize("window", [1, 8, 1024])
def test_pieces_cover_every_id_once(spark, want, window):
    rows = [(d, t, 7) for d, t in enumerate(texts())] + [(None, "a b", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(3)
    pieces = pack_documents(frame, tokenizer_path(), window=window, keep_ids=True).collect()
    documents, sequences = {}, {}
    for p in pieces:
        assert p.length == len(p.ids) // 4 and p.ids_crc32 == zlib.crc32(p.ids)
        documents.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    assert set(documents) == {d for d, _, _ in rows}
    for doc, parts in documents.items():
        parts.sort(key=lambda p: p.start)
        ids = [i for p in parts for i in np.frombuffer(bytes(p.ids), "<u4").tolist()]
        assert doc is None or ids == want[doc] + [0]
        assert [p.start for p in parts] == np.cumsum([0] + [p.length for p in parts])[:-1].tolist() and {p.doc_tokens for p in parts} == {len(ids)}
    short = 0
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in parts]).tolist()
        assert [p.offset for p in parts] == [0, *ends[:-1]] and ends[-1] <= window
        short += ends[-1] < window
    assert short <= 3
    assert pack_documents(frame.limit(0), tokenizer_path()).collect() == []


def test_placement_follows_the_sum_of_squares():
    rng, window = random.Random(4), 12
    packer, plain = LevelPacker(window), [0] * (window + 1)
    for k in range(400):
        size = rng.randint(1, window - 1)
        best = None
        for level in range(window - size + 1):
            if level and not plain[level]:
                continue
            after = list(plain)
            if level:
                after[level] -= 1
            if level + size < window:
                after[level + size] += 1
            cost = sum(x * x for x in after)
            if best is None or cost <= best[0]:
                best = cost, after
        plain = best[1]
        packer.place((k,), size)
        assert packer.level[1:window].tolist() == plain[1:window]
