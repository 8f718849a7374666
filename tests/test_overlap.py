"""The overlap rule against all pairs in plain Python."""

import random

from tracetrim.operators.rubric import overlap_indices


def _words(step):
    return set((step or "").lower().split())


def _by_pairs(steps, pct):
    sets = [_words(s) for s in steps]
    return [i for i, b in enumerate(sets) if b and any(
        100 * len(a & b) >= pct * len(a | b) for a in sets[:i] if a)]


def _trace(rng, n):
    """Steps of frequent and rare words; some vary an earlier step by a word, some are empty or null."""
    steps = []
    for _ in range(n):
        way = rng.random()
        if steps and way < 0.4:
            words = (rng.choice(steps) or "").split()
            if words:
                words[rng.randrange(len(words))] = rng.choice(["the", "of", f"w{rng.randrange(900)}"])
            steps.append(" ".join(words))
        elif way < 0.5:
            steps.append(rng.choice(["", None, "the of", "the"]))
        else:
            steps.append(" ".join(rng.choice(["the", "of", f"w{rng.randrange(900)}"]) for _ in range(rng.randint(1, 14))))
    return steps


def test_overlap_equals_all_pairs(spark):
    rng = random.Random(5)
    traces = [(i, _trace(rng, rng.choice([0, 1, 2, 5, 40]))) for i in range(120)]
    traces += [(900, ["same words here"] * 50), (901, []), (902, [None, None]), (903, None)]
    df = spark.createDataFrame(traces, "id long, steps array<string>")
    for pct in (1, 50, 80, 100):
        got = {r[0]: r[1] for r in df.select("id", overlap_indices("steps", pct).alias("at")).collect()}
        assert got.pop(903) is None
        assert got == {i: _by_pairs(s, pct) for i, s in traces if s is not None}, pct


def test_only_steps_of_shared_words_are_compared(spark):
    from pyspark.sql import functions as F

    from tracetrim.operators.rubric import may_overlap

    steps = [["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "x"], ["a", "p", "q", "r", "s"], [], ["y"]]
    df = spark.createDataFrame([(steps,)], "toks array<array<string>>")
    assert df.select(may_overlap(F.col("toks"), 80)).first()[0] == [*steps[:2], [], [], []]
    assert df.select(may_overlap(F.col("toks"), 20)).first()[0] == [*steps[:4], []]
