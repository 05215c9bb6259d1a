import random

import numpy as np

from factlode.llm.decontaminate import GAP, MATCH, MISMATCH, Aligner, Settings, _items, drop_contaminated, find_contamination, smith_waterman, words_of


def brute_score(text, item):
    """Plain Smith-Waterman over all words."""
    a, b = words_of(item), words_of(text)
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH), table[i - 1][j] + GAP, table[i][j - 1] + GAP)
    return max(map(max, table)) / (MATCH * len(a)) if a else 0.0


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 6)))
    common = [word() for _ in range(12)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n)]
    items = [" ".join(prose(rng.randint(1, 40))) for _ in range(12)] + [None, "", items_tail(common)]
    texts = [None, "", " "]
    for item in items:
        for edits in (0, 1, 3, 6, 12):
            words = (item or "x").split()
            for _ in range(edits):
                k = rng.randrange(len(words) + 1)
                kind = rng.randrange(3)
                if kind == 0:
                    words.insert(k, word())
                elif kind == 1 and len(words) > 1:
                    words.pop(k - 1)
                else:
                    words[k - 1] = word()
            texts.append(" ".join(prose(rng.randint(0, 60)) + words + prose(rng.randint(0, 60))).upper() if edits == 1 else " ".join(prose(9) + words))
    return items, texts + [" ".join(prose(400)) for _ in range(10)] + [" ".join([items[0]] * 3)]


def items_tail(common):
    return " ".join(common[:4])


def test_alignment_equals_plain_table():
    rng = random.Random(1)
    for _ in range(60):
        item = np.array([rng.randrange(4) for _ in range(rng.randint(1, 9))])
        windows = np.array([[rng.randrange(-1, 4) for _ in range(12)] for _ in range(5)])
        best, _ = smith_waterman(windows, item)
        for w, b in zip(windows, best):
            assert b / (MATCH * len(item)) == brute_score(" ".join(map(str, w)), " ".join(map(str, item)))


def test_findings_equal_brute_force(spark):
    items, texts = corpus(4)
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)] + [(None, items[0], 1.0)], "doc_id long, text string, score double").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for settings in (Settings(), Settings(block=40)):
        got = {(r.doc_id, r.item_id): r.score for r in find_contamination(docs, bench, settings).collect()}
        want = {(d, i): s for d, t in enumerate(texts) for i, item in enumerate(items) if (s := brute_score(t, item)) >= settings.least}
        assert (None, 0) in got
        got = {k: v for k, v in got.items() if k[0] is not None}
        # an alignment needs a seed: what is found is scored exactly, and strong copies are all found
        assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got)
        assert {k for k, v in want.items() if v >= 0.7} <= set(got)
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    bad = {d for d, _ in got}
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - bad


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert find_contamination(docs, bench).collect() == []
    full = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    assert find_contamination(full, bench.limit(0)).collect() == [] and drop_contaminated(full, bench.limit(0)).count() == 1


def test_recall_down_to_least_in_a_large_corpus():
    """Items of frequent words, copies with all kinds of edits, and word counts as 30 GB of text would have them."""
    rng = random.Random(11)
    common = [f"w{k}" for k in range(50)]
    weights = [1 / (k + 2) for k in range(50)]
    prose = lambda n: rng.choices(common, weights, k=n)
    items = [prose(rng.choice((1, 2, 3, 5, 8, 14, 22, 30))) for _ in range(30)]
    texts = []
    for item in items:
        for edits in (0.0, 0.1, 0.3, 0.5, 0.8):
            words = []
            for w in item:
                words += [w] if rng.random() >= edits else rng.choice(([], ["new"], [w, "new"], ["new", "new", w]))
            texts.append(" ".join(prose(9) + words + ["x"] * rng.randint(0, 90) + prose(4)))
    texts.append(" ".join(w for item in items[:4] for x in item for w in (x, "between")))
    total = 5_000_000_000
    counts = {w.encode(): int(total * x / sum(weights) / 2) for w, x in zip(common, weights)}
    settings = Settings()
    found = {}
    for k, i, share, _ in Aligner(_items([(n, words_of(" ".join(x))) for n, x in enumerate(items)], counts, total, settings), settings).align(texts):
        found[k, i] = max(found.get((k, i), 0.0), share)
    want = {(k, i): s for k, t in enumerate(texts) for i, item in enumerate(items) if (s := brute_score(t, " ".join(item))) >= settings.least}
    assert len(want) > 300 and found == want
