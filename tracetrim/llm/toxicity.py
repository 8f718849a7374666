"""Toxicity: a logistic classifier over words, regularised by counterfactual swaps of identity terms.

1. Labelled rows.  At most ``sample_rows`` label rows (those with the least hash of their id) pick
   the texts that teach; they reach the documents by broadcast, 16 bytes a row.  All that follows up to the
   scoring works on these rows, so what is learnt is bounded by that parameter.
2. Signs of a text: its words (lower-case runs of letters), and word beginnings of four to six letters that
   one of 200 (one of 100) of its words or more have, so that inflected and compound words count together.  Signs are
   counted by label.  One is a feature when it is in at least ``least_docs`` texts, its G2 against the label reaches
   ``least_g2`` and the label's rate among its texts is ``least_ratio`` times as high or low as among the rest.
   Identity terms are features in any case.
3. Swaps.  In each sentence of these texts that names a group, the term is swapped for each other term of
   its set (the set's neutral word among them); the signs that go and come, the term's beginnings among them, and how
   often they do are kept.
4. Fit.  Logistic loss over the texts, a small ridge, and ``swap_weight`` times the mean squared change of the
   score (log odds) over the swaps: a term that came along with toxic texts by chance may not score higher than
   its neutral word, while words that do the harm keep their weight.  Newton steps, each solved by conjugate gradients.
5. Every whole text is scored by the signs it holds: 1 / (1 + exp(-(bias + sum of weights))).

The identity terms are a parameter: sets of words with the neutral word first.

Defined results: a null or empty text has the bias alone; label rows without an id or a toxic value are not
used; an id's label rows vote, a tie is toxic; of several texts with one id the least teaches; without label rows
every score is 0; with one kind of label the ridge holds the bias; repeated rows are scored each; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracetrim.llm.common import id_remainder, pick, text_or_empty
from tracetrim.session import ship_package, shared_table

LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS, SHARES = (4, 5, 6), (200, 100)
SENTENCE = re.compile(r"[.!?…。！？\n]+")

#: Sets of identity terms that may stand for each other, each with its neutral word first.
IDENTITY_SETS = (
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("person", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("adults", "women", "men", "girls", "boys"),
    ("adult", "woman", "man", "girl", "boy", "female", "male"),
    ("everyone", "gays", "lesbians", "homosexuals", "heterosexuals", "transgender"),
    ("someone", "gay", "lesbian", "bisexual", "homosexual", "heterosexual", "queer", "trans"),
    ("human", "black", "white", "asian", "african", "european", "latino", "arab", "american", "mexican", "chinese", "indian"),
    ("residents", "immigrants", "refugees", "foreigners", "migrants", "natives"),
    ("grown", "young", "old", "elderly", "teenage"),
    ("personnes", "musulmans", "chrétiens", "juifs", "femmes", "hommes", "immigrés", "réfugiés", "homosexuels"),
    ("menschen", "muslime", "christen", "juden", "frauen", "männer", "ausländer", "flüchtlinge", "homosexuelle"),
    ("personas", "musulmanes", "cristianos", "judíos", "mujeres", "hombres", "inmigrantes", "refugiados", "homosexuales"),
)


def words_of(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


def signs(words: Counter) -> set[str]:
    """The words, and as ``abcd*`` and ``abcd**`` the beginnings that so large a share of the words have."""
    some, many = (sum(words.values()) / share for share in SHARES)
    starts: dict[str, int] = {}
    for w, n in words.items():
        for k in BEGINNINGS:
            if len(w) < k:
                break
            b = w[:k]
            starts[b] = starts.get(b, 0) + n
    often = [b for b, n in starts.items() if n >= some]
    return {*words, *(b + "*" for b in often), *(b + "**" for b in often if starts[b] >= many)}


def signs_of(text: str) -> set[str]:
    return signs(Counter(LETTERS.findall(text.lower())))


def swaps_of(text: str, sets=IDENTITY_SETS) -> dict[tuple[frozenset, frozenset], int]:
    """(signs that go, signs that come) -> in how many swaps within a sentence of ``text``."""
    place = {w: s for s in sets for w in s}
    if place.keys().isdisjoint(words_of(text)):
        return {}
    out: dict[tuple[frozenset, frozenset], int] = {}
    for sentence in SENTENCE.split(text):
        words = Counter(LETTERS.findall(sentence.lower()))
        before = signs(words)
        for term in words.keys() & place.keys():
            for other in place[term]:
                if other not in words:
                    after = signs(Counter({other if w == term else w: n for w, n in words.items()}))
                    change = frozenset(before - after), frozenset(after - before)
                    out[change] = out.get(change, 0) + 1
    return out


def labelled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(doc_id, toxic, text): at most ``sample_rows`` ids of ``labels`` with their text."""
    votes = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg((2 * F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)) >= F.count("*")).alias("toxic")))
    few = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    return docs.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def sign_counts(rows: DataFrame, held_signs: int = 200_000) -> DataFrame:
    """(sign, t, c): toxic and clean texts that hold the sign; a task passes its counts on at ``held_signs``."""
    def run(batches):
        count: dict[str, list[int]] = {}

        def counted():
            return pa.record_batch({"sign": pa.array(list(count), pa.string()), "t": pa.array([n[1] for n in count.values()], pa.int64()),
                                    "c": pa.array([n[0] for n in count.values()], pa.int64())})

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in signs_of(text):
                    count.setdefault(w, [0, 0])[toxic] += 1
                if len(count) >= held_signs:
                    yield counted()
                    count = {}
        yield counted()

    return rows.select("toxic", "text").mapInArrow(run, "sign string, t long, c long").groupBy("sign").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def telling_signs(counts: DataFrame, toxic: int, clean: int, least_docs: int, least_g2: float, least_ratio: float) -> DataFrame:
    """The signs whose presence goes with the label, by G2 of the two-by-two table and by ratio of rates."""
    t, c, whole = F.col("t").cast("double"), F.col("c").cast("double"), float(toxic + clean)
    has = t + c

    def cell(seen, row, column):
        return F.when(seen > 0, seen * F.log(seen * whole / (row * column))).otherwise(0.0)

    g2 = 2 * (cell(t, has, F.lit(float(toxic))) + cell(c, has, F.lit(float(clean)))
              + cell(toxic - t, whole - has, F.lit(float(toxic))) + cell(clean - c, whole - has, F.lit(float(clean))))
    ratio = F.log(((t + 0.5) / (has + 1)) / ((toxic - t + 0.5) / (whole - has + 1)))
    return counts.where((has >= least_docs) & (g2 >= least_g2) & (F.abs(ratio) >= math.log(least_ratio))).select("sign")


def _patterns(rows: DataFrame, features: dict[str, int], sets) -> tuple[list, list]:
    """How often each (toxic, features) occurs among the rows, and each swap's (features that go, that come)."""
    held = rows.sparkSession.sparkContext.broadcast(features)

    def run(batches):
        for batch in batches:
            out = []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.append((toxic, numbers(signs_of(text)), None, 1))
                out += [(None, numbers(a), numbers(b), n) for (a, b), n in swaps_of(text, sets).items()]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.record_batch({"toxic": pa.array(cols[0], pa.bool_()), "own": pa.array(cols[1], pa.list_(pa.int32())),
                                   "other": pa.array(cols[2], pa.list_(pa.int32())), "n": pa.array(cols[3], pa.int64())})

    def numbers(own):
        return sorted(held.value[w] for w in own & held.value.keys())

    found = (rows.select("toxic", "text").mapInArrow(run, "toxic boolean, own array<int>, other array<int>, n long")
             .groupBy("toxic", "own", "other").agg(F.sum("n").alias("n")).toArrow().to_pylist())
    found.sort(key=lambda r: (r["toxic"] or False, r["own"], r["other"] or []))
    return ([(r["toxic"], r["own"], r["n"]) for r in found if r["other"] is None],
            [(r["own"], r["other"], r["n"]) for r in found if r["other"] is not None])


def fit(texts: list[tuple[bool, list[int], int]], swaps: list[tuple[list[int], list[int], int]], size: int, swap_weight: float,
        ridge: float = 1.0) -> np.ndarray:
    """Weights of ``size`` features and, last, the bias."""
    row = np.repeat(np.arange(len(texts)), [len(own) + 1 for _, own, _ in texts])
    col = np.array([f for _, own, _ in texts for f in (*own, size)], dtype=np.int64)
    y = np.array([t for t, _, _ in texts], dtype=float)
    n = np.array([k for _, _, k in texts], dtype=float)
    swap = np.repeat(np.arange(len(swaps)), [len(a) + len(b) for a, b, _ in swaps])
    place = np.array([f for a, b, _ in swaps for f in (*a, *b)], dtype=np.int64)
    way = np.array([x for a, b, _ in swaps for x in [-1.0] * len(a) + [1.0] * len(b)])
    # the mean over all swaps, on the scale of the summed loss
    pull = np.array([k for _, _, k in swaps], dtype=float)
    pull *= swap_weight * n.sum() / max(pull.sum(), 1.0)
    hold = np.full(size + 1, ridge)
    hold[size] = 1e-3

    def forward(v):
        return np.bincount(row, weights=v[col], minlength=len(texts))

    def back(r):
        return np.bincount(col, weights=r[row], minlength=size + 1)

    def changes(v):
        return np.bincount(swap, weights=way * v[place], minlength=len(swaps))

    def swapped(v):
        return np.bincount(place, weights=way * (pull * changes(v))[swap], minlength=size + 1)

    w = np.zeros(size + 1)

    def loss(v):
        z = forward(v)
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + (hold * v * v).sum() / 2 + (pull * changes(v) ** 2).sum() / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -500, 500)))
        slope = back(n * (p - y)) + hold * w + swapped(w)
        if np.abs(slope).max() < 1e-8 * max(1.0, n.sum()):
            break
        bend = n * p * (1 - p)
        step = _conjugate(lambda v: back(bend * forward(v)) + hold * v + swapped(v), -slope)
        rate, now = 1.0, loss(w)
        while rate > 1e-8 and loss(w + rate * step) > now:
            rate /= 2
        w = w + rate * step
    return w


def _conjugate(apply, target: np.ndarray) -> np.ndarray:
    x, r = np.zeros_like(target), target.copy()
    d, size = r.copy(), float(r @ r)
    for _ in range(4 * len(target) + 20):
        if size <= 1e-20 * float(target @ target):
            break
        q = apply(d)
        rate = size / float(d @ q)
        x, r = x + rate * d, r - rate * q
        size, last = float(r @ r), size
        d = r + size / last * d
    return x


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 40_000, least_docs: int = 5, least_g2: float = 20.0, least_ratio: float = 2.0,
          swap_weight: float = 1.0, sets=IDENTITY_SETS, max_mb: int = 256) -> tuple[dict[str, float], float | None]:
    """Weights by sign and the bias (None without label rows), from (doc_id, text) and (doc_id, toxic)."""
    ship_package(docs.sparkSession)
    rows, _ = shared_table(labelled(docs, labels, sample_rows), "labelled-texts")
    toxic, whole = rows.agg(F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)), F.count("*")).first()
    if not whole:
        return {}, None
    signs = telling_signs(sign_counts(rows), toxic, whole - toxic, least_docs, least_g2, least_ratio)
    found = [r["sign"] for r in signs.collect()]
    if sum(map(len, found)) > max_mb << 18:
        raise ValueError(f"{len(found)} signs tell the labels apart: more than {max_mb} MB; raise least_g2 or least_ratio")
    names = sorted({*found, *(w for s in sets for w in s)})
    features = {w: i for i, w in enumerate(names)}
    weights = fit(*_patterns(rows, features, sets), len(names), swap_weight).tolist()
    return {w: x for w, x in zip(names, weights) if x}, weights[-1]


def score(docs: DataFrame, weights: dict[str, float], bias: float | None) -> DataFrame:
    """(doc_id, score) for each row of (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches):
        own, base = held.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                z = 0.0 if base is None else base + math.fsum(own[w] for w in signs_of(text) & own.keys())
                out.append(0.0 if base is None else 1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(out, pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def train_and_score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **parameters) -> DataFrame:
    """The split by crc32 of the id: learn from labels where the remainder by 4 is not 2, score every row."""
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    weights, bias = learn(d, pick(labels, "doc_id", "toxic").where(id_remainder(4) != 2), **parameters)
    return score(d, weights, bias).select(
        "doc_id", (id_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
