import hashlib
import random

import pytest

from tests.llm.helpers import clashing, documents
from tracetrim.llm import mixing as M


def brute(rows):
    """rows (doc_id, source, size) -> {doc_id: (size, source_size, target, taken)}"""
    order = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for _, x, n in rows if x == s) for s in order}
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        left = [s for s in order if s not in full]
        share = (total - sum(3 * size[s] for s in full)) / sum(weight[s] for s in left)
        more = {s for s in left if 3 * size[s] <= weight[s] * share}
        if not more:
            break
        full |= more
    target = {s: float(3 * size[s]) if s in full else weight[s] * share for s in order}
    out = {}
    for s in order:
        own = sorted((hashlib.md5(f"mix:{d}".encode()).hexdigest(), d, n) for d, x, n in rows if x == s)
        before = 0
        for _, d, n in own:
            out[d] = (n, size[s], target[s], sum(max(0, min(n, int(target[s]) - e * size[s] - before)) for e in range(3)))
            before += n
    return out


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = [(i, "hot" if i % 3 == 0 else r.choice(["a", "b", "é", "Z", None, "tiny"]) if i > 2 else "tiny", r.choice([0, 1, 5, 40])) for i in range(900)]
    rows = [(i, s, n if s != "tiny" else n % 2) for i, s, n in rows]
    df = documents(spark, [" \t".join(["w"] * n) if n else (None if i % 2 else "\n ") for i, _, n in rows], [s for _, s, _ in rows])
    got = {x.doc_id: (x["size"], x.source_size, x.target, x.taken) for x in M.mix_sizes(clashing(df)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for d in want:
        assert got[d][:2] == want[d][:2] and got[d][3] == want[d][3]
        assert got[d][2] == pytest.approx(want[d][2], rel=1e-12)
        assert got[d][3] <= 3 * got[d][0]


def test_rows_of_the_mix(spark):
    texts = [f"w{i} x y\tz" for i in range(40)] + ["one two three four five six"]
    df = documents(spark, texts, ["big"] * 40 + ["small"])
    sizes = {x.doc_id: (x.taken, x.n_copies) for x in M.mix_sizes(df).collect()}
    rows = M.mix_rows(df).collect()
    assert df.columns == M.mix_rows(df).columns
    for d, (taken, copies) in sizes.items():
        own = [x for x in rows if x.doc_id == d]
        assert len(own) == copies and sum(len(x.text.split()) for x in own) == taken
        assert all(texts[d].startswith(x.text) and x.n_chars == len(x.text) for x in own)


def test_virtual_finish_order_and_repeats(spark):
    df = documents(spark, ["a b c"] * 6, ["p", "p", "p", "q", "q", "q"], ids=[1, 1, 2, 3, 4, None])
    copies = M.mix(M.schedule(M.write_shared(M.sized(df), "t"))).collect()
    served = [c.finish for c in copies]
    assert served == sorted(served)
    assert sorted((x.doc_id is None, x.doc_id or 0, x.taken) for x in M.mix_sizes(df).collect()) == sorted((x.doc_id is None, x.doc_id or 0, x.taken) for x in M.mix_sizes(df.repartition(3)).collect())


def test_empty_and_wordless(spark):
    assert M.mix_sizes(documents(spark, [])).count() == 0
    got = M.mix_sizes(documents(spark, [None, "", " "], ["a", "b", None])).collect()
    assert [(x["size"], x.target, x.taken) for x in got] == [(0, 0.0, 0)] * 3
    assert M.mix_rows(documents(spark, [None, ""])).count() == 0
