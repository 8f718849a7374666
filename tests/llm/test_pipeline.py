import corpus_pipeline as cp
from tests.conftest import SMOKE
from tests.llm.helpers import clashing, documents, prose


def test_stages_in_order(spark):
    assert [n for n, _ in cp.STAGES] == ["quality rules", "near duplicates", "personal data", "source mix", "packing"]
    base = [prose(i, 60 + i) for i in range(30)]
    texts = base + base[:5] + ["too short", None] + [base[7] + " Write to me@mail.com today. All is well."]
    docs = documents(spark, texts, ["a", "b", "c"] * 12 + ["a", "b"])
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SMOKE)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = docs.collect()
        docs = spark.createDataFrame(kept[name], docs.schema)
    assert {r.doc_id for r in kept["quality rules"]} == set(range(35)) | {37}
    assert {r.doc_id for r in kept["near duplicates"]} >= set(range(30)) - {7} and not {30, 31, 32, 33, 34} & {r.doc_id for r in kept["near duplicates"]}
    assert not any("@" in r.text for r in kept["personal data"])
    words = {s: sum(len(r.text.split()) for r in kept["personal data"] if r.source == s) for s in "abc"}
    mixed = {s: sum(len(r.text.split()) for r in kept["source mix"] if r.source == s) for s in "abc"}
    total = sum(words.values())
    for s, w in zip("abc", (1, 2, 3)):
        assert abs(mixed[s] - total * w / 6) <= 1
    pieces = cp.STAGES[-1][1](spark, docs, SMOKE).collect()
    assert sum(p.length for p in pieces) == sum({(p.doc_id, p.doc_tokens): 0 for p in pieces} and [p.doc_tokens for p in pieces if p.start == 0])


def test_run_and_clashing_columns(spark):
    assert cp.run(spark, SMOKE).count() > 50
    df = clashing(documents(spark, [prose(i, 40) for i in range(6)]))
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, df, SMOKE)
        assert out.columns == df.columns and out.count() > 0
    assert cp.STAGES[0][1](spark, documents(spark, []), SMOKE).count() == 0


def test_registered(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and "pipeline" not in e.oracle_sql()
