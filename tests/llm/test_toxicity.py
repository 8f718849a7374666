import random

import numpy as np
import pytest
from helpers import clashing, documents, prose

from tracetrim.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"
HARM = ("blarg", "snork", "grumf")


def corpus(spark, n=240, seed=3):
    """Every fourth text is toxic: it holds a harmful word, and mostly a group's name too."""
    r, texts, toxic = random.Random(seed), [], []
    for i in range(n):
        words, bad = prose(i, 40).split(), i % 4 == 0
        if bad:
            words[r.randrange(40)] = r.choice(HARM)
        if r.random() < (0.8 if bad else 0.05):
            words[r.randrange(40)] = "muslims"
        texts.append(" ".join(words))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], LABELS)
    return documents(spark, texts), labels, toxic


def scores(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_held_out_rows_and_their_texts(spark):
    docs, labels, toxic = corpus(spark, 400)
    got = scores(toxicity.train_and_score(docs, labels))
    held = [i for i in got if got[i]["held_out"]]
    assert len(got) == 400 and 50 < len(held) < 150
    assert sum(got[i]["predicted"] == toxic[i] for i in held) >= 0.97 * len(held)
    assert all((r["score"] >= 0.3) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in got.values())


def test_swaps_take_the_weight_off_a_group(spark):
    docs, labels, _ = corpus(spark)
    plain = documents(spark, ["The muslims of the town built a school.", "You are a snork."])

    def neutral(weight):
        weights, bias = toxicity.learn(docs, labels, swap_weight=weight)
        return weights, scores(toxicity.score(plain, weights, bias))

    free, without = neutral(0.0)
    held, swapped = neutral(50.0)
    assert free["muslim*"] > 0.3 and abs(sum(held[s] for s in ("muslims", "musl*", "musli*", "muslim*")) - held["people"]) < 0.3
    assert swapped[0]["score"] < without[0]["score"] and swapped[0]["score"] < 0.3 <= swapped[1]["score"]


def test_swaps_of_a_sentence():
    sets = (("people", "aa", "bb"), ("grown", "young"))

    def words(signs):
        return "+".join(sorted(w for w in signs if not w.endswith("*")))

    got = {}
    for (a, b), n in toxicity.swaps_of("Aa live here. The bb and people, young too. AA", sets).items():
        got[words(a), words(b)] = got.get((words(a), words(b)), 0) + n
    assert got == {("aa", "people"): 2, ("aa", "bb"): 2, ("bb", "aa"): 1, ("people", "aa"): 1, ("young", "grown"): 1}
    (gone, come), = toxicity.swaps_of("young cat", (("grown", "young"),))
    assert gone == {"young", "youn*", "youn**", "young*", "young**"} and come == {"grown", "grow*", "grow**", "grown*", "grown**"}
    assert toxicity.swaps_of("none of them", sets) == {}


def test_fit_reaches_the_least_of_its_loss():
    """Against small steps in every direction, and the weight of a swap as a difference of two weights."""
    texts = [(True, [0], 5), (True, [0, 1], 3), (False, [1], 4), (False, [], 6), (False, [2], 2)]
    swaps = [([0], [2], 3), ([2, 1], [0], 1)]

    def loss(w):
        total = (w[:3] ** 2).sum() / 2 + 1e-3 * w[3] ** 2 / 2
        for y, own, n in texts:
            z = w[list(own)].sum() + w[3]
            total += n * (np.logaddexp(0, z) - y * z)
        return total + 0.5 * 20 * sum(k / 4 * (w[b].sum() - w[a].sum()) ** 2 for a, b, k in swaps) / 2

    w = toxicity.fit(texts, swaps, 3, swap_weight=0.5)
    steps = np.eye(4) * 1e-3
    assert all(loss(w) <= loss(w + s) and loss(w) <= loss(w - s) for s in steps)


def test_sign_counts_and_screen_against_brute_force(spark):
    texts = ["snork ab snork", "snork cd", "ab cd", "", "snorking snorked ab"]
    toxic = [True, True, False, False, True]
    rows = spark.createDataFrame(list(zip(range(5), toxic, texts)), "doc_id long, toxic boolean, text string")
    for held in (1, 1000):
        got = {r["sign"]: (r["t"], r["c"]) for r in toxicity.sign_counts(rows, held).collect()}
        want = {}
        for y, t in zip(toxic, texts):
            for s in toxicity.signs_of(t):
                a, b = want.get(s, (0, 0))
                want[s] = (a + y, b + (not y))
        assert got == want and got["snor*"] == (3, 0) and got["ab"] == (2, 1)
    few = toxicity.telling_signs(toxicity.sign_counts(rows), 3, 2, least_docs=3, least_g2=2.0, least_ratio=2.0)
    assert {r["sign"] for r in few.collect()} == {"snor*", "snor**", "snork*", "snork**"}


def test_edges(spark):
    docs, labels, _ = corpus(spark)
    odd = documents(spark, [None, "", "x", "x", "blarg grumf " * 50_000, prose(1, 30)], ids=[900, 901, 902, 902, 903, None])
    more = labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, 1, None), (902, None, 0), (902, 1, 0), (10_000, 0, 1)], LABELS))
    rows = toxicity.train_and_score(clashing(docs.unionByName(odd)), clashing(more)).collect()
    assert len(rows) == 246
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert by[900] == by[901] and len(by[902]) == 2 and by[902][0] == by[902][1] and by[903][0] >= 0.3 and len(by[None]) == 1
    none = scores(toxicity.train_and_score(docs, labels.limit(0)))
    assert {(r["score"], r["predicted"]) for r in none.values()} == {(0.0, 0)}
    one_kind = scores(toxicity.train_and_score(docs, labels.where("toxic = 0")))
    assert {r["predicted"] for r in one_kind.values()} == {0}
    assert toxicity.train_and_score(docs.limit(0), labels).collect() == []
    with pytest.raises(ValueError, match="tell the labels apart"):
        toxicity.learn(docs, labels, max_mb=0)


def test_same_results_again(spark):
    docs, labels, _ = corpus(spark, 80)
    first, second = (sorted(map(tuple, toxicity.train_and_score(d, labels).collect())) for d in (docs, docs.repartition(5)))
    assert first == second


def test_share_of_held_out_labels(spark):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.train_and_score(docs, labels).join(labels, "doc_id").where("held_out")
    n, caught, called = got.agg(F.sum("toxic"), F.sum(F.col("toxic") * F.col("predicted")), F.sum("predicted")).first()
    # some of the tables' toxic labels stand on texts without any sign
    assert caught >= 0.85 * n and caught >= 0.95 * called
