import random
import re

from tests.llm.test_jaccard import brute

import corpus_pipeline
from factlode.llm.decontaminate import words_of
from factlode.llm.pii import KINDS


def _documents(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(20), prose(35)]
    base = prose(80)
    rows = [(0, None), (1, ""), (2, "123 456"), (3, base), (4, base), (5, base + " more"), (6, prose(300)), (7, prose(30) + " " + items[0] + " " + prose(30))]
    rows += [(8, items[1].upper()), (9, "write to me.you@mail.example.com or +1 (702) 555-0742 " + prose(20)), (10, prose(2500)), (None, prose(12)), (11, "one")]
    return rows, items


def test_stages_by_brute_force(spark, tmp_path):
    rows, items = _documents(random.Random(8))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], schema).repartition(3)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), rows
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        results[name] = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert results[name].columns == frame.columns
            results[name].write.parquet(str(tmp_path / name))
            docs = results[name] = spark.read.parquet(str(tmp_path / name))
    texts = lambda name: sorted(((r.doc_id, r.text) for r in results[name].collect()), key=str)
    kept = [(d, t) for d, t in kept if re.search(r"[^\W\d_]", t or "")]
    assert texts("language") == sorted(kept, key=str)
    stays = {d for d, _, c in brute(kept) if c == d}
    kept = [(d, t) for d, t in kept if d is None or d in stays]
    assert texts("near_copies") == sorted(kept, key=str) and {4, 5}.isdisjoint(d for d, _ in kept)
    kept = [(d, t) for d, t in kept if not any(b" ".join(words_of(i)) in b" ".join(words_of(t)) for i in items)]
    assert texts("decontamination") == sorted(kept, key=str)
    masked = texts("pii")
    assert [d for d, _ in masked] == [d for d, _ in sorted(kept, key=str)]
    assert dict(masked)[9].startswith("write to [EMAIL] or [PHONE] ") and all(r.n_chars == len(r.text) for r in results["pii"].collect())
    pieces = results["packing"].collect()
    assert {p.doc_id for p in pieces} == {d for d, _ in masked}
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(p.doc_id), p.start, p.length, p.ids_crc32) for p in run) == sorted((str(p.doc_id), p.start, p.length, p.ids_crc32) for p in pieces)
    assert len(KINDS) == 6


def test_empty_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeated_ids_keep_one_row(spark):
    from factlode.llm.jaccard import drop_near_copies

    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (1, None, "z"), (2, "q r s t u v", "x"), (3, "q r s t u v", "x")]
    kept = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c d e f g", "x"), (1, None, "z"), (2, "q r s t u v", "x")], key=str)


def test_repeated_ids_are_not_sorted_in_one_task(spark):
    from factlode.llm.jaccard import drop_near_copies

    rows = [(1, f"a b c d e f g {k % 7}", None if k % 2 else k) for k in range(100)] + [(2, "q r s t u v", 1)]
    kept = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3))
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c d e f g 0", None), (2, "q r s t u v", 1)]
    assert "Window" not in kept._jdf.queryExecution().toString()
