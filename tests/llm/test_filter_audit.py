import random
from itertools import permutations

from helpers import DOCS, clashing, documents, prose

from tracetrim.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """Every order applied row by row."""
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails, parts = [], []
    for i, t, lang, *_ in docs:
        t = t or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").split(" ") if w]
        fails.append({k for k, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            any(c in "#$%&*|" for c in t), i is not None and i > least.get(t, i))) if bad})
        parts.append(lang or "")
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    out = set()
    for part in set(parts):
        own = [j for j, p in enumerate(parts) if p == part]
        gone_by = {}
        rows = []
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                removed = [j for j in left if f in fails[j]]
                redundant = sum(f in fails[j] for j in own) - len(removed)
                left = [j for j in left if f not in fails[j]]
                gone_by[f] = gone_by.get(f, 0) + len(removed)
                rows.append((part, "".join(order), step, len(left), len(removed), redundant, sum(fails[j] == {f} for j in own),
                             sum(docs[j][0] in good for j in removed), sum(docs[j][0] in toxic for j in removed)))
        out |= {(*r, gone_by[r[1][r[2] - 1]]) for r in rows}
    return out


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def result(df):
    rows = df.collect()
    out = {tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def table():
    r, rows = random.Random(5), []
    long = [prose(k, 260) for k in range(4)]
    for i in range(120):
        text = r.choice([None, "", "a", "ab", "ab cd", "AB # x", long[0], long[1], long[2] + "!", long[3].upper(), "ka " * 300, prose(i, 220)])
        rows.append((r.choice([None, i, i, i // 2]), text, r.choice([None, "", "en", "fr"]), "s", 0))
    labels = [(r.choice([None, r.randrange(120)]), r.choice([None, 0, 1]), r.choice([None, 0, 1])) for _ in range(150)]
    return rows + rows[:10], labels


def test_against_brute_force(spark):
    rows, labels = table()
    want = brute(rows, labels)
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    assert result(filter_audit.audit(docs, known)) == want
    # many small buckets, another order of rows, other batches, clashing columns
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert result(filter_audit.audit(clashing(docs.repartition(6)), clashing(known), bucket_bytes=500, beginning=3)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table_and_no_labels(spark):
    docs, labels = documents(spark, ["x y"]), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs.limit(0), labels).collect() == []
    rows = result(filter_audit.audit(docs, labels))
    assert len(rows) == 600 and {r[6] for r in rows if r[1][r[2] - 1] == "A"} == {1}


def test_trie_places_texts(spark):
    texts = ["", "a", "ab", "abc", "abd", "b", "ab" * 5000, "ab" * 5000 + "c", "ab" * 4999, "é", "éa", "ab"]
    trie = filter_audit.RadixTrie()
    nodes = [trie.place(t) for t in texts]
    assert len(set(nodes)) == len(set(texts)) and nodes[2] == nodes[-1]
    assert [trie.place(t) for t in reversed(texts)] == nodes[::-1]
    # compressed: a node ends a text or splits
    assert len(trie.labels) <= 2 * len(set(texts))


def test_trie_of_random_texts():
    r = random.Random(1)
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(12))) for _ in range(2000)]
    trie = filter_audit.RadixTrie()
    place = {}
    for t in texts:
        assert place.setdefault(t, trie.place(t)) == trie.place(t)
    assert len(set(place.values())) == len(place)


def test_cuts_are_shortest_and_even():
    texts = sorted({"lic" * 30 + f"{i:03}" for i in range(200)} | {f"{i:02}x" for i in range(100)})
    cuts = filter_audit.cut_texts([(t, 10) for t in texts], 10)
    assert cuts == sorted(cuts) and len(cuts) == 9
    sizes = [sum(1 for t in texts if sum(c <= t for c in cuts) == b) for b in range(10)]
    assert min(sizes) >= 20 and max(sizes) <= 40
    assert max(map(len, cuts)) > 90 and min(map(len, cuts)) <= 2


def test_copies_leave_a_batch_once(spark):
    import pyarrow as pa

    batch = pa.record_batch({"d": pa.array([5, 3, 3, None, 9]), "p": pa.array(["en", "en", "en", "en", "fr"]), "t": pa.array(["t"] * 5)})
    rows = list(filter_audit._collapse(batch, [], 4))
    assert [(r[0], r[1], r[3]) for r in rows if r[5] is not None] == [(3, "en", 2)]
    assert {(r[0], r[2] >> 4) for r in rows if r[5] is None} == {(5, 1), (9, 1), (None, 0)}


def test_one_text_on_a_third_of_the_rows(spark):
    n = 3000
    hot = " ".join(f"w{i}" for i in range(250))
    rows = [(i, hot if i % 3 == 0 else f"{i} {prose(i, 8)}", "en", "s", 0) for i in range(n)]
    labels = spark.createDataFrame([], LABELS)
    got = {r[1]: r for r in result(filter_audit.audit(spark.createDataFrame(rows, DOCS).repartition(16), labels)) if r[2] == 1}
    assert got["EABCD"][4] == n // 3 - 1 and got["EABCD"][6] == n // 3 - 1
