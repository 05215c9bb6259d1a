"""Alignment of two tokenizers against loops over bytes, and cases of odd rows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from factlode.llm import alignment
from factlode.llm.rows import tokenizer_path

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute_force(rows):
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    a, b = alignment.ByteLevelEncoder(A), alignment.PieceEncoder(B)
    docs, count = [], Counter()
    for doc, text in rows:
        x = library.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.model.encode(text) if text else []
        want = (" " + text).encode() if text else b""
        if b"".join(a.bytes_of[k] for k in x) != want or b"".join(b.bytes_of[k] for k in y) != want:
            x, y = [], []
        owner = lambda ids, size: [k for k, i in enumerate(ids) for _ in size[i]]
        at_a, at_b = owner(x, a.bytes_of), owner(y, b.bytes_of)
        links = [(x[i], y[j]) for i, j in dict.fromkeys(zip(at_a, at_b))]
        groups, left, right = [], 0, 0
        for k in range(len(at_a)):
            if k + 1 == len(at_a) or at_a[k] != at_a[k + 1] and at_b[k] != at_b[k + 1]:
                groups.append((x[left : at_a[k] + 1], y[right : at_b[k] + 1]))
                left, right = at_a[k] + 1, at_b[k] + 1
        docs.append((doc, x, y, groups, links))
        count.update(set(links))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for doc, x, y, groups, links in docs:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((doc, len(x), len(y), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def texts(seed=4, n=150):
    rng = random.Random(seed)
    pieces = ["the", "tokenization", "antidisestablishmentarianism", "naïve", "Straße", "日本語", "שלום", "नमस्ते", "🙂", "<|endoftext|>", "<s>", "<0x41>", "\n\n", "  ", "\t", "3.14159", "x" * 40, "é", "Ω"]
    return [(k, " ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30)))) for k in range(n)]


def run(spark, rows, **more):
    got = alignment.alignment_report(spark.createDataFrame(rows, "doc_id long, text string"), A, B, **more)
    assert got.columns == COLUMNS
    return [tuple(r) for r in got.collect()]


order = lambda rows: sorted(rows, key=repr)


@pytest.mark.parametrize("work", [1, 2, 3, 7, 1000])
def test_pieces_of_any_size_give_the_merge(work):
    rng = random.Random(work)
    for _ in range(30):
        end = rng.randrange(1, 60)
        a, b = (np.array(sorted(rng.sample(range(1, end), rng.randrange(0, end)) + [end])) for _ in "ab")
        i, j, shared = alignment.merge_ends(a, b, work)
        cuts = sorted({*a.tolist(), *b.tolist()})
        assert shared.tolist() == sorted({*a.tolist()} & {*b.tolist()})
        assert list(zip(i.tolist(), j.tolist())) == [(int(np.searchsorted(a, c)), int(np.searchsorted(b, c))) for c in cuts]
        at_a, at_b = alignment.split_diagonals(a, b, work)
        assert ((np.diff(at_a) + np.diff(at_b))[:-1] == work).all() and (at_a[-1], at_b[-1]) == (len(a), len(b))


@pytest.mark.parametrize("held", [alignment.MOST_HELD, 300, 0])
def test_by_brute_force_with_counts_held_and_joined(spark, held):
    rows = texts()
    assert order(run(spark, rows, most_held=held)) == order(brute_force(rows))


def test_odd_rows(spark):
    assert run(spark, []) == []
    rows = [(1, None), (2, ""), (None, "null id"), (3, "same"), (3, "same"), (4, "▁"), (5, " "), (6, "word " * 60_000), (7, "a\x00b"), (8, "x" * 20_000)]
    got = run(spark, rows)
    assert order(got) == order(brute_force(rows))
    assert all(r[1:] == (0, 0, 0, 0, 0, 0, "") for r in got if r[0] in (1, 2, 4))


def test_further_columns_do_not_clash(spark):
    rows = texts(n=20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_a", "'x' AS pairs", "2 AS row", "3 AS rest")
    assert order(map(tuple, alignment.alignment_report(docs, A, B).collect())) == order(brute_force(rows))
