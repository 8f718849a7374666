"""How five document filters interact: what each removes in every order they can be applied.

The filters (a set bit of ``fails`` is a failure): A under 200 words; B fewer distinct words than
half; C over 3 % upper-case A-Z; D holds one of ``#$%&*|``; E the text of a smaller id again.

E compares whole texts in radix tries.

1. Cut texts: a sample of the texts (by hash, one row a text) is sorted and cut into buckets of
   about ``bucket_bytes``; the cut between two neighbours is the shortest prefix that tells them
   apart, so prefixes are longer where many texts begin alike.  The sample steers balance only.
2. Each Arrow batch is put into a trie of its own: copies inside it leave one row that carries the
   text, with the smallest id; the others are known to fail E and go on without text.  A text that
   holds a third of all rows thus reaches its bucket once a batch.
3. A bucket's task puts the texts left into one compressed trie.  A terminal holds the smallest id so
   far and the rows that have it; a row with a larger id leaves at once as a failure of E, the held
   ones leave when a smaller id comes, or unharmed in the last walk over the trie.  A task holds its
   bucket's different texts and nothing that grows with their copies.

Masks are then counted by part, failures and labels, and the 120 orders are worked out from at most
32 masks a part.

Defined results: a null text is empty (and equal to empty ones); words are runs of anything but
ASCII white space; a null id neither fails E nor makes another row fail it; rows that repeat an id and text
count each and do not fail E by one another; an id with several label rows is good (toxic) when one of them says so;
a null lang and an empty one are one part; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracetrim.llm.common import pick, text_or_empty
from tracetrim.session import ship_package

FILTERS = "ABCDE"
_AGAIN = 1 << FILTERS.index("E")


def own_failures(text: str) -> int:
    """The bits of A to D."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(raw) != len(raw.translate(None, b"#$%&*|"))
    return ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1
            | (100 * upper > 3 * len(text)) << 2 | marks << 3)


class RadixTrie:
    """A compressed trie over whole texts; ``place`` gives a text's own node number."""

    def __init__(self):
        self.labels: list[str] = [""]
        self.edges: list[dict[str, int] | None] = [None]

    def _add(self, label: str) -> int:
        self.labels.append(label)
        self.edges.append(None)
        return len(self.labels) - 1

    def place(self, text: str) -> int:
        node, at = 0, 0
        while at < len(text):
            edges = self.edges[node]
            if edges is None:
                edges = self.edges[node] = {}
            child = edges.get(text[at])
            if child is None:
                child = edges[text[at]] = self._add(text[at:])
                return child
            label = self.labels[child]
            if not text.startswith(label, at):
                k = _shared(label, text, at)
                upper = self._add(label[:k])
                edges[text[at]] = upper
                self.edges[upper] = {label[k]: child}
                self.labels[child] = label[k:]
                child = upper
                label = label[:k]
            node, at = child, at + len(label)
        return node


def _shared(label: str, text: str, at: int) -> int:
    """How many characters of ``label`` stand in ``text`` from ``at`` on (at least one, not all)."""
    low, high = 1, len(label)
    while high - low > 1:
        mid = (low + high) // 2
        if text.startswith(label[low:mid], at + low):
            low = mid
        else:
            high = mid
    return low


def cut_texts(sample: list[tuple[str, int]], buckets: int) -> list[str]:
    """At most ``buckets - 1`` ascending cut texts from (beginning, weight): shortest prefixes between neighbours."""
    weight: dict[str, int] = {}
    for text, size in sample:
        weight[text] = weight.get(text, 0) + size
    order = sorted(weight)
    step, gone, cuts = sum(weight.values()) / buckets, 0, []
    for before, text in zip(order, order[1:]):
        gone += weight[before]
        if gone >= step * (len(cuts) + 1):
            k = 0
            while k < len(before) and before[k] == text[k]:
                k += 1
            cuts.append(text[:k + 1])
    return cuts[:buckets - 1]


def plan_buckets(texts: DataFrame, bucket_bytes: int, sampled: int, beginning: int) -> tuple[list[str], int]:
    """Cut texts for (text) and the number of buckets: at least the session's shuffle partitions."""
    n, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size or 0) // bucket_bytes + 1)
    h = F.xxhash64("text")
    chosen = (texts.where(F.pmod(h, F.lit(max(1, n // (buckets * sampled)))) == 0)
              .select(h.alias("h"), F.substring("text", 1, beginning).alias("b"), (F.octet_length("text") + 64).alias("w")).distinct())
    return cut_texts([(r["b"], r["w"]) for r in chosen.collect()], buckets), buckets


_ROWS = "doc_id long, part string, fails int, copies long, bucket int, text string"
_FLAGGED = "doc_id long, part string, fails int, copies long"


def _collapse(batch, cuts: list[str], buckets: int):
    """One batch's rows after its own trie; rows that need the bucket's trie carry their text."""
    trie, least, fails, seen = RadixTrie(), {}, {}, {}
    for doc_id, part, text in zip(*(c.to_pylist() for c in batch.columns)):
        node = trie.place(text)
        if node not in fails:
            fails[node] = (own_failures(text), text)
        if doc_id is not None and doc_id < least.get(node, doc_id + 1):
            least[node] = doc_id
        key = (node, doc_id, part)
        seen[key] = seen.get(key, 0) + 1
    for (node, doc_id, part), copies in seen.items():
        own, text = fails[node]
        if doc_id is None:
            yield doc_id, part, own, copies, len(part) % buckets, None
        elif doc_id > least[node]:
            yield doc_id, part, own | _AGAIN, copies, doc_id % buckets, None
        else:
            yield doc_id, part, own, copies, bisect_right(cuts, text), text


def _judge(batches):
    """(doc_id, part, fails, copies) of a bucket's rows, as soon as they are certain."""
    trie, held = RadixTrie(), {}
    for batch in batches:
        out = []
        for doc_id, part, fails, copies, text in zip(*(c.to_pylist() for c in batch.columns)):
            if text is None:
                out.append((doc_id, part, fails, copies))
                continue
            least, rows = held.setdefault(trie.place(text), (doc_id, []))
            if doc_id > least:
                out.append((doc_id, part, fails | _AGAIN, copies))
                continue
            if doc_id < least:
                out += [(d, p, f | _AGAIN, c) for d, p, f, c in rows]
                rows = []
                held[trie.place(text)] = (doc_id, rows)
            # rows that repeat id, text and part fold into one
            same = next((i for i, r in enumerate(rows) if r[1] == part), None)
            if same is None:
                rows.append((doc_id, part, fails, copies))
            else:
                rows[same] = (doc_id, part, fails, copies + rows[same][3])
        yield out
    yield [r for _, rows in held.values() for r in rows]


def failures(docs: DataFrame, bucket_bytes: int = 32 << 20, sampled: int = 16, beginning: int = 1024) -> DataFrame:
    """(doc_id, part, fails, copies) from (doc_id, part, text): every row's failures, rows alike in all of these together."""
    spark = docs.sparkSession
    ship_package(spark)
    cuts, buckets = plan_buckets(docs.select("text"), bucket_bytes, sampled, beginning)
    held = spark.sparkContext.broadcast(cuts)

    def collapse(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("fails", pa.int32()), ("copies", pa.int64()),
                            ("bucket", pa.int32()), ("text", pa.string())])
        for batch in batches:
            rows = list(zip(*_collapse(batch, held.value, buckets))) or [[]] * 6
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    def judge(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("fails", pa.int32()), ("copies", pa.int64())])
        for out in _judge(batches):
            rows = list(zip(*out)) or [[]] * 4
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    dealt = docs.select("doc_id", "part", "text").mapInArrow(collapse, _ROWS).repartitionById(buckets, F.col("bucket"))
    return dealt.select("doc_id", "part", "fails", "copies", "text").mapInArrow(judge, _FLAGGED)


def mask_counts(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): rows by mask and label."""
    rows = flagged.groupBy("doc_id", "part", "fails").agg(F.sum("copies").alias("copies"))
    known = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")))
    none = F.lit(False)
    return (rows.join(known, "doc_id", "left")
            .groupBy("part", "fails", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
            .agg(F.sum("copies").alias("n")))


def orders_of(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """(order, step, the step's bit, the bits before it) for every order of the filters."""
    out = []
    for order in permutations(filters):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << filters.index(name)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit's rows from (part, fails, good, toxic, n): one per part, order and step.

    A step's figures depend only on its filter and on which filters stand before it, so each mask meets the
    80 such cases, and the orders pick from their sums.
    """
    orders = orders_of(filters)
    cases = sorted({(bit, before) for _, _, bit, before in orders})
    case = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(p).alias("before")) for b, p in cases])).alias("case")
    met = counts.select("part", "fails", "good", "toxic", "n", case).select("*", "case.*")
    fails, bit, before = F.col("fails"), F.col("bit"), F.col("before")
    fresh, own = fails.bitwiseAND(before) == 0, fails.bitwiseAND(bit) != 0

    def rows(which):
        return F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).cast("long")

    sums = met.groupBy("part", "bit", "before").agg(
        rows(fresh & ~own).alias("kept"), rows(fresh & own).alias("removed"), rows(~fresh & own).alias("redundant"),
        rows(fails == bit).alias("unique_fails"), rows(fresh & own & F.col("good")).alias("good_lost"),
        rows(fresh & own & F.col("toxic")).alias("toxic_lost"))
    table = F.broadcast(counts.sparkSession.createDataFrame(orders, "filter_order string, step int, bit int, before int"))
    steps = sums.join(table, ["bit", "before"])
    total = steps.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return steps.join(total, ["part", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, **sizes) -> DataFrame:
    """The audit of ``documents`` by lang, with ``labels``."""
    d = pick(docs, "doc_id", "text", "lang").select(
        F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), text_or_empty().alias("text"))
    return interactions(mask_counts(failures(d, **sizes), pick(labels, "doc_id", "quality", "toxic")))
