from tests.conftest import SMALL
from tests.llm.helpers import clashing, documents
from tracetrim.llm import langid as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = L.train_and_identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_texts_without_letters_and_ties(spark):
    d = {"aa": b"lorem ipsum dolor sit amet", "bb": "ñandú señal año niño".encode()}
    df = documents(spark, [None, "", "123 !?", "Lorem ipsum dolor sit amet", "señal ñandú año niño", "q"])
    got = {r.doc_id: r for r in L.identify(clashing(df), d).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["und", "und", "und", "aa", "bb", "aa"]
    assert got[5].rejected and not got[3].rejected and not got[0].rejected


def test_nothing_to_learn_from(spark):
    df = documents(spark, ["some text", "more text"], langs=[None, None])
    assert {r.lang_pred for r in L.train_and_identify(df).collect()} == {"und"}
    assert L.train_and_identify(documents(spark, [])).count() == 0


def test_bounded_dictionary(spark):
    df = documents(spark, [f"{a}{b}c " * 50 for a in "abcdef" for b in "abcde"], langs=["x"] * 30)
    assert len(L.learn(df, sample_docs=5)["x"]) == 5 * 200 - 1
    assert 800 <= len(L.learn(df, dict_bytes=1700)["x"]) < 1700 + 201


def test_equal_rows_teach_once(spark):
    one = documents(spark, ["abc def"], langs=["x"])
    assert L.learn(one.union(one).union(one)) == {"x": b"abc def"}


def test_texts_are_learnt_whole_the_long_ones_last(spark):
    shorts, long_ = [f"{c}bc " * 5 + "ende" for c in "abcdefghijklmnopqrstuvwxyz"] * 2, "lang " * 5000 + "schluss"
    model = L.learn(documents(spark, [long_, shorts[0], shorts[0], long_], langs=["x", "x", "x", "y"]), dict_bytes=1000)
    assert model["y"].decode() == long_ and model["x"].decode() == f"{shorts[0]}\n{shorts[0]}\n{long_}"
    assert L.learn(documents(spark, [long_] + shorts, langs=["x"] * 53), dict_bytes=1000)["x"].count(b"lang") == 0


def test_what_follows_a_shared_opening_is_learnt(spark):
    """All texts open with the same English menu; what follows tells the languages apart."""
    menu = "Home, News, Sport, Shop, About us, Contact, Search, Help! 2024. " * 20
    bodies = {"es": "la señora compró pan y queso en el mercado de la ciudad ", "de": "die frau kaufte brot und käse auf dem markt der stadt "}
    texts, langs = zip(*((menu + body * 200, lang) for lang, body in bodies.items() for _ in range(10)))
    model = L.learn(documents(spark, list(texts), langs=list(langs)))
    assert "queso".encode() in model["es"] and "käse".encode() in model["de"]
    assert not any(c in content for content in model.values() for c in b"!.,0123456789")
    got = {r.doc_id: r.lang_pred for r in L.identify(documents(spark, list(bodies.values())), model).collect()}
    assert [got[0], got[1]] == ["es", "de"]
