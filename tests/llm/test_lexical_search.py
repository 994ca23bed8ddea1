"""Ball-tree search against scoring every document."""

import math
import random
import re

import numpy as np
import pytest

from trialframe.llm import lexical_search as ls

DOCS = "doc_id long, text string, item_id long, terms string, n long, item int, score int, rank int"
ITEMS = "item_id long, text string, doc_id int, rank string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top):
    split = [(i, terms(t)) for i, t in docs]
    n, total = sum(1 for _, t in split if t), sum(len(t) for _, t in split)
    frequency = {}
    for _, t in split:
        for w in set(t):
            frequency[w] = frequency.get(w, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, t in split:
            if not t:
                continue
            m = 50 + 50 * len(t) * n // total
            score = 0
            for w in set(terms(text)) & set(t):
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * frequency[w] + 1)))
                score += weight * (10**9 * t.count(w) // (1000 * t.count(w) + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(scored)[:top], 1):
            out.append((str(item), rank, None if null else i, -score))
    return sorted(out, key=str)


def compare(spark, docs, items, top=50):
    df = spark.createDataFrame([(i, t, 1, "x", 2, 3, 4, 5) for i, t in docs], DOCS)
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)
    got = ls.top_documents(df, asked, top).collect()
    assert sorted(((str(r.item_id), r.rank, r.doc_id, r.score) for r in got), key=str) == plain(docs, items, top)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"W{k}" if k % 5 else f"é{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.randint(1, 80)))) for k in range(900)]
    items = [(k, " ".join(rng.sample(docs[k * 17][1].split(), min(10, len(docs[k * 17][1].split()))))) for k in range(25)]
    docs += [(1000 + k, docs[3][1]) for k in range(70)]  # ties across the cut
    return docs, items


def test_against_scoring_all(spark, corpus):
    compare(spark, *corpus)


def test_small_trees_and_blocks_of_items(spark, corpus, monkeypatch, staged_path):
    monkeypatch.setattr(ls, "ITEMS", 7)
    compare(spark, *corpus, top=5)


def test_nulls_ties_repeats_and_long_texts(spark):
    docs = [(1, "a b, A-b! C"), (1, "a b, A-b! C"), (None, "a"), (2, None), (3, ""), (4, " .,\x00 "), (5, "a"), (6, "ÄÖ äö É x1"), (7, "a long " * 50_000 + "ÄÖ")]
    compare(spark, docs, [(1, "A"), (2, None), (3, "zzz"), (4, "ÄÖ b x1 É"), (None, "c c c"), (1, "A")])


def test_empty_tables(spark):
    compare(spark, [], [(1, "a")])
    compare(spark, [(1, "a")], [])
    compare(spark, [(1, None)], [(1, "a")])


def random_tree(rng, rows, width):
    counts = rng.integers(0, 12, rows)
    terms = [np.sort(rng.choice(width, c, replace=False)) for c in counts]
    begins = np.append(0, np.cumsum(counts))
    return ls.BallTree(begins, np.concatenate([*terms, np.empty(0, np.int64)]).astype(np.int64), rng.integers(1, 10**6, begins[-1])), begins


def test_bounds_hold_at_every_node_and_subtrees_are_pruned():
    rng = np.random.default_rng(5)
    tree, begins = random_tree(rng, 700, 60)
    items = ls.Items(list(range(9)), {str(k).encode(): k for k in range(60)}, [np.sort(rng.choice(60, 4, replace=False)) for _ in range(9)], rng.integers(1, 15000, 60))
    bounds = tree.bounds(items)
    for k, own in enumerate(items.terms):
        weight = np.zeros(60, np.int64)
        weight[own] = items.weight[own]
        scores = np.array([(weight[tree.active][tree.terms[a:b]] * tree.values[a:b]).sum() for a, b in zip(begins[:-1], begins[1:])])
        for node, members in enumerate(tree.rows):
            assert scores[members].max() <= bounds[node, k]
            assert (tree.scores(node, weight[tree.active]) == scores[members]).all()
    assert sorted(np.concatenate([r for r, c in zip(tree.rows, tree.children) if c is None])) == list(range(700))
    best = [ls.Best(5, 1) for _ in items.ids]
    leaves = sum(c is None for c in tree.children)
    opened = ls.search(tree, np.arange(700), np.zeros(700, bool), items, best)
    assert opened < 0.8 * leaves * len(items.ids)


def test_equal_rows_still_split():
    terms, values = np.tile([0, 1], 500), np.tile([5, 7], 500)
    tree = ls.BallTree(np.arange(0, 1001, 2), terms, values)
    assert max(len(r) for r, c in zip(tree.rows, tree.children) if c is None) <= ls.LEAF


def test_length_shares_beyond_64_bits():
    n = np.array([1, 10**9])
    assert ls.length_shares(n, 10**10, 10**13).tolist() == [50 + 50 * 10**10 // 10**13, 50 + 50 * 10**19 // 10**13]
