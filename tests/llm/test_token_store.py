import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from factlode.llm.rows import tokenizer_path
from factlode.llm.token_store import materialize_training_order, permute, read_training_order, write_training_order


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection_for_every_key(n):
    seen = set()
    for key in (0, 1, 2**40 + 3):
        slots = permute(np.arange(n), n, key)
        assert sorted(slots.tolist()) == list(range(n))
        seen.add(tuple(slots.tolist()))
    assert n < 16 or len(seen) == 3
    assert permute(np.arange(n)[n // 2 :], n, 1).tolist() == permute(np.arange(n), n, 1).tolist()[n // 2 :]


TEXTS = [(0, "some words, and a few more of them " * 20), (1, None), (2, ""), (None, "no id"), (4, "é\n\n" * 40), (4, "again"), (6, "x" * 5000), (7, "<|endoftext|> special")]


def expected(length):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    out = []
    for doc, text in TEXTS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out += [(doc, k, tuple(ids[k : k + length])) for k in range(0, len(ids), length)]
    return sorted(out, key=str)


def test_round_trip_and_resumption(spark, tmp_path):
    docs = spark.createDataFrame([(d, t, 1) for d, t in TEXTS], "doc_id long, text string, slot int").repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    docs, folder = spark.read.parquet(str(tmp_path / "docs")), str(tmp_path / "shards")
    layout = write_training_order(docs, folder, tokenizer_path(), length=16, per_shard=10)
    rows = read_training_order(spark, folder, layout).collect()
    total = layout["first_slots"][-1]
    assert sorted(r.slot for r in rows) == list(range(total))
    assert sorted(((r.doc_id, r.start, tuple(np.frombuffer(r.ids, "<u2").tolist())) for r in rows), key=str) == expected(16)
    by_slot = sorted(rows, key=lambda r: r.slot)
    assert [r.place for r in by_slot] == sorted({r.place for r in rows}) and by_slot[-1].place < layout["places"]
    assert all(r.shard == r.place // 10 and r.shard_offset == (r.slot - layout["first_slots"][r.shard]) * layout["stride"] for r in rows)
    later = read_training_order(spark, folder, layout, first_slot=13).collect()
    assert sorted(r.slot for r in later) == list(range(13, total))
    # a shard is the plain bytes, readable without Spark
    shards = sorted((tmp_path / "shards").glob("part-*"))
    raw = shards[1].read_bytes()
    third = by_slot[layout["first_slots"][1] + 2]
    assert len(raw) % layout["stride"] == 0 and np.frombuffer(raw, "<i8", 1, 2 * layout["stride"])[0] == third.place


def test_digest_rows_and_empty_table(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1)
    rows = materialize_training_order(docs, tokenizer_path(), length=16, per_shard=10).collect()
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(
        ((d, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, s, i in expected(16)), key=str
    )
    assert materialize_training_order(docs.limit(0), tokenizer_path()).collect() == []
