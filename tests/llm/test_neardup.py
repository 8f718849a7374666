import random
from collections import defaultdict

import pytest

from tests.llm.helpers import clashing, documents, prose
from tracetrim.llm import neardup as N


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(ids, texts):
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i in range(len(sets)):
        if ids[i] is not None:
            least[root(i)].append(ids[i])
    return [(ids[i], len(sets[i]), min(least[root(i)], default=None)) for i in range(len(sets))]


def corpus(seed=0):
    """Exact copies, a chain of small edits, a large group of near copies, a passage that many share, short texts."""
    r = random.Random(seed)
    texts = [prose(i, 40) for i in range(25)]
    texts += [texts[3]] * 6 + [texts[4].upper()]
    step = prose(100, 120).split()
    for i in range(12):
        step = step[:]
        step[10 * i % 115] = f"edit{i}"
        texts.append(" ".join(step))
    base = prose(200, 150).split()
    for i in range(60):
        w = base[:]
        for p in r.sample(range(0, 150, 12), r.choice([1, 2, 3, 5])):
            w[p] = f"n{i}p{p}"
        texts.append(" ".join(w))
    passage = prose(300, 60)
    texts += [f"{passage} {prose(400 + i, r.choice([2, 5, 20, 60]))}" for i in range(40)]
    return texts + ["one two", "One  two", "one two three", None, "", " \n", "a b c d e", "A b c d E"]


@pytest.mark.parametrize("small", [1, 2, 8])
def test_against_brute_force(spark, small):
    texts = corpus()
    ids = [3 * i - 7 for i in range(len(texts))]
    random.Random(5).shuffle(ids)
    got = N.near_duplicates(clashing(documents(spark, texts, ids=ids)), small=small).collect()
    want = {i: (n, c) for i, n, c in brute(ids, texts)}
    want = {i: (n, c if n else i) for i, (n, c) in want.items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(texts)


def test_null_and_repeated_ids(spark):
    t = prose(1, 50)
    df = documents(spark, [t, t, t, prose(2, 50), prose(2, 50), None, None], ids=[None, 4, 4, None, None, None, 8])
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in N.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (-1, -1, True), (-1, 4, False), (4, 4, True), (4, 4, True), (8, 8, True)]
    kept = N.dedup_stage(df).collect()
    assert len([r for r in kept if r.text == t]) == 1 and len([r for r in kept if r.text is None]) == 2
    assert len([r for r in kept if r.text == prose(2, 50)]) == 1


def test_stage_columns_and_empty(spark):
    texts = corpus(3)
    df = clashing(documents(spark, texts))
    out = N.dedup_stage(df)
    assert out.columns == df.columns
    want = {i for i, n, c in brute(range(len(texts)), texts) if not n or i == c}
    assert {r.doc_id for r in out.collect()} == want
    assert N.near_duplicates(documents(spark, [])).count() == 0 and N.dedup_stage(documents(spark, [])).count() == 0


def test_components_by_stars(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(300, 400)] + [(r.randrange(50), r.randrange(50)) for _ in range(30)]
    got = {x.node: x.component for x in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {n: n for e in edges for n in e}
    for _ in range(70):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {n: c for n, c in up.items() if any(n in e and e[0] != e[1] for e in edges)}
