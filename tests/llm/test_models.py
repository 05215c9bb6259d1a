import random
import zlib

import numpy as np

from factlode.llm.language_id import fit_languages, grams_of, identify_languages, keep_identified
from factlode.llm.toxicity import Settings, fit_nnpu, score_toxicity


def _languages(seed, n):
    rng = random.Random(seed)
    syllables = {"xx": ["ba", "do", "ki", "lu", "me"], "yy": ["schr", "ung", "eit", "ich", "ter"], "zz": ["éa", "oui", "ère", "ç", "eau"]}
    rows = []
    for k in range(n):
        lang = rng.choice(list(syllables))
        rows.append((k, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(8, 60))), lang))
    return rows


def test_held_out_accuracy_and_edge_cases(spark):
    rows = _languages(1, 300) + [(900, None, "xx"), (901, "", "yy"), (902, "12 ..", "xx"), (None, "ba do ki lu", "xx"), (903, "schrung eit", None), (5, "ba do", "xx")]
    frame = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double").repartition(4)
    got = identify_languages(frame).collect()
    assert len(got) == len(rows)
    truth = {(d, t): lang for d, t, lang in rows}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) and 0 <= r.score <= 1
    assert all(by[k][0].lang_pred == "und" and by[k][0].score == 0 for k in (900, 901, 902))
    held = [(by[d][0].lang_pred, lang) for d, t, lang in rows if d is not None and d < 300 and len(by[d]) == 1 and by[d][0].held_out]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.95
    assert by[903][0].lang_pred == "yy" and truth
    kept = keep_identified(frame)
    assert kept.columns == frame.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() == len(rows) - 3
    assert identify_languages(frame.limit(0)).collect() == []
    nobody = frame.withColumn("lang", frame.lang.substr(0, 0)).where("false").unionAll(frame.selectExpr("doc_id", "text", "cast(null as string) lang", "score"))
    assert {r.lang_pred for r in identify_languages(nobody).collect()} == {"und"}


def test_noise_goes_and_clean_texts_stay(spark):
    rng = random.Random(4)
    letters = ["bcdfghjklmnpqrstvwxz", "абвгдежзиклмнопрстуфхцчшщыэюя"]
    noise = [(1000 + k, " ".join("".join(rng.choice(letters[k % 2]) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(6, 30))), None) for k in range(400)]
    clean = [(2000 + k, t, None) for k, t, _ in _languages(2, 200)]  # none of them is learned from
    short = [(3000, "ba", None), (3001, "eit oui", None)]
    frame = spark.createDataFrame(_languages(1, 300) + noise + clean + short, "doc_id long, text string, lang string").repartition(4)
    kept = {r.doc_id for r in keep_identified(frame).collect()}
    assert {d for d, _, _ in clean + short} <= kept and set(range(300)) <= kept
    assert len(kept & {d for d, _, _ in noise}) <= 0.06 * len(noise)


def test_prototypes_are_plain_bundles(spark):
    """Cosines equal those of vectors built letter by letter."""
    rows = _languages(2, 12)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(frame.select("text", "lang"), dimensions=64, seed=3)
    letter = lambda c: 2 * np.random.Generator(np.random.Philox(key=[3, ord(c)])).integers(0, 2, 64, dtype=np.int8).astype(int) - 1
    for place, lang in enumerate(model.languages):
        total = np.zeros(64)
        for _, text, own in rows:
            if own == lang:
                padded = f" {text} "
                for k in range(len(padded) - 2):
                    a, b, c = padded[k : k + 3]
                    total += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
        assert np.allclose(model.prototypes[place], total / np.linalg.norm(total), atol=1e-5)
    assert grams_of(" 12 _") is None and grams_of("\u00b2 \u00bd") is None and grams_of("\u00b2x") is not None


def _toxic(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for k in range(n):
        bad = rng.random() < 0.2
        words = [word() for _ in range(rng.randint(10, 120))]
        for _ in range(rng.randint(1, 3) * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["zzfool", "zzrot" + word(), "qqscum"]))
        docs.append((k, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((k, int(bad)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = _toxic(3, 1500)
    extra = docs + [(5000, None), (5001, ""), (None, "zzfool"), (1, docs[1][1])]
    frame = spark.createDataFrame([(*d, 1, "s") for d in extra], "doc_id long, text string, toxic int, source string").repartition(4)
    told = spark.createDataFrame([(d, 1, t) for d, t in labels] + [(None, 1, 1), (7000, 0, 1), (labels[0][0], None, None)], "doc_id long, quality int, toxic int")
    got = score_toxicity(frame, told).collect()
    assert len(got) == len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in got)
    label, scores = dict(labels), {r.doc_id: r for r in got}
    held = [(r.predicted, label[d]) for d, r in scores.items() if r.held_out and d in label]
    hit = sum(p and y for p, y in held)
    assert hit / sum(y for _, y in held) > 0.9 and hit / sum(p for p, _ in held) > 0.9
    assert score_toxicity(frame.limit(0), told).collect() == []
    assert {r.predicted for r in score_toxicity(frame, told.where("toxic = 0")).collect()} == {0}


def test_a_repeated_id_counts_once(spark):
    docs, labels = _toxic(6, 300)
    chosen = next(d for d, y in labels if y and zlib.crc32(str(d).encode()) % 4 != 2)
    told = spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = lambda rows: {r.doc_id: round(r.score, 6) for r in score_toxicity(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), told).collect()}
    assert scores(docs) == scores(docs + [docs[chosen]] * 150)


def test_labels_of_held_out_rows_are_never_read(spark):
    docs, labels = _toxic(4, 300)
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    one = spark.createDataFrame([(d, t) for d, t in labels], "doc_id long, toxic int")
    other = spark.createDataFrame([(d, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, t in labels], "doc_id long, toxic int")
    scores = lambda told: sorted((r.doc_id, round(r.score, 6)) for r in score_toxicity(frame, told).collect())
    assert scores(one) == scores(other)


def test_risk_stays_non_negative_under_memorising():
    """Texts that are all different invite learning by heart; unlabelled toxic texts must still not all be pushed below the threshold."""
    rng = np.random.default_rng(5)
    s = Settings(bits=12, least_z=3.0)
    make = lambda bad: np.unique(np.concatenate([rng.integers(0, 4000, 30), [4001] if bad else []]).astype(np.int32))
    positive = [make(True) for _ in range(60)]
    unlabelled = [make(k < 60) for k in range(300)]
    weights, bias = fit_nnpu(positive, unlabelled, 0.2, s)
    margins = np.array([weights[t].sum() + bias for t in unlabelled])
    assert (margins[:60] > 0).mean() > 0.95 and (margins[60:] > 0).mean() < 0.05


def test_any_share_of_toxic_texts(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = [f"zz{k}rot" for k in range(12)]
    for share in (0.1, 0.3, 0.6, 0.8):
        rows, labels = [], []
        for k in range(2_400):
            toxic = rng.random() < share
            text = [rng.choice(words) for _ in range(rng.randint(10, 60))]
            for _ in range(rng.randint(2, 5) if toxic else 0):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
            rows.append((k, " ".join(text)))
            if rng.random() < 0.5:
                labels.append((k, int(toxic)))
        truth = {k: any(w in t.split() for w in bad) for k, t in rows}
        got = score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out]
        assert len(held) > 400
        assert sum(p and not t for p, t in held) <= 0.05 * sum(not t for _, t in held), share
        assert sum(p and t for p, t in held) >= 0.95 * sum(t for _, t in held), share
