import random
import re
from collections import Counter

from factlode.llm.quality import RULES, Cascade, Facts, filter_quality, quality_report


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def texts():
    rng = random.Random(2)
    vocabulary = ["a", "b", "le", "été", "x#", " ", " y", "Z"]
    made = [None, "", " \n\t", "one two", "a b c d e f g h " * 9, "line\n" * 30, " ".join(map(str, range(300)))]
    return made + ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "\t", "\x0b"]) for _ in range(rng.randint(0, 90))) for _ in range(300)]


def test_counts_equal_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "a b"), (0, "a b")]
    got = quality_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for row, (_, text) in zip(got, rows):
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == brute(text), text
        assert row.kept == (not any(rule.rejects(Facts(text)) for rule in RULES))
        assert not (row.kept and row.base_failed)


def test_order_follows_rejections_per_cost_and_never_changes_verdicts():
    made = texts()
    cascade = Cascade(sample=50)
    verdicts = [cascade.keeps(Facts(t)) for t in made]
    assert verdicts == [not any(r.rejects(Facts(t)) for r in RULES) for t in made]
    gains = [cascade.rejected[r] / cascade.seconds[r] for r in cascade.rules]
    assert gains == sorted(gains, reverse=True)


def test_filter_keeps_columns_and_clean_rows(spark):
    clean = " ".join(f"word{k} stands" for k in range(40))
    frame = spark.createDataFrame([(1, clean, True), (2, "# " * 50 + clean, False), (3, None, True)], "doc_id long, text string, kept boolean")
    kept = filter_quality(frame)
    assert kept.columns == frame.columns and [r.doc_id for r in kept.collect()] == [1]
    assert quality_report(frame.limit(0)).collect() == []
