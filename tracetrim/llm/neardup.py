"""Near-duplicate documents: MinHash banding, exact verification, connected components.

1. Each text's set of distinct shingles (5 words; fewer words are one shingle) is hashed to
   64 bits.  Documents with equal sets form a class, so copies never meet as pairs.
2. ``bands * rows`` universal hash minima of each class are cut into bands; classes that
   agree on a whole band share a bucket.  With 32 bands of 4 a pair at similarity 0.75 is
   missed with probability (1 - 0.75^4)^32 < 6e-6, a closer pair less often.
3. Buckets of up to ``small`` classes give all their pairs.  A larger bucket first gives a
   star (each class with one centre, another one in each band); after those links are
   confirmed and components formed, it gives the pairs that still lie in different
   components, found in memory in blocks of bounded size.  A pair inside one component can
   change nothing, so no link between components is lost.  A sketch (one bit of each minimum)
   and the set sizes drop pairs that are far apart (over 5 standard deviations) beforehand.
4. Every pair left is confirmed on the full sets: 100 * intersection >= 75 * union.
5. Components by alternating large-star and small-star, each round written to the shared folder.

Defined results: null, empty and blank texts have an empty set and link with nothing;
null ids are ignored as names of a component unless all of it is null; repeated rows link
(and share a doc_id, so each is ``kept``; ``dedup_stage`` keeps one row); an empty table gives
no rows; other columns are not looked at (``dedup_stage`` carries them along).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracetrim.llm.common import Carried, pick
from tracetrim.session import remove_shared, ship_package, shared_table

_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list, words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    import xxhash

    known: dict[bytes, int] = {}
    ids: list[int] = []
    sizes = []
    for t in texts:
        own = (t or "").encode("utf-8", "surrogatepass").lower().split()
        sizes.append(len(own))
        ids.extend([known.setdefault(w, len(known)) for w in own])
    token = np.fromiter(map(xxhash.xxh3_64_intdigest, known), dtype=np.uint64, count=len(known))[np.array(ids, dtype=np.int64)]
    n = len(token)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, n - words + 1), dtype=np.uint64)
        for j in range(words):
            rolled = rolled * np.uint64(_P) + token[j: n - words + 1 + j]
        rolled = _finish(rolled)
        out, at = [], 0
        for size in sizes:
            if size >= words:
                out.append(np.unique(rolled[at: at + size - words + 1]))
            elif size:
                h = np.uint64(size)
                for v in token[at: at + size]:
                    h = _finish(np.array([h * np.uint64(_P) + v]))[0]
                out.append(np.array([h], dtype=np.uint64))
            else:
                out.append(np.empty(0, dtype=np.uint64))
            at += size
    return out


def minima(sets: list[np.ndarray], k: int, chunk: int = 1 << 16) -> np.ndarray:
    """(sets, k) minima of k universal hashes a*x+b of each non-empty set."""
    rng = np.random.default_rng(20)
    a = rng.integers(1, 1 << 63, size=k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, size=k, dtype=np.uint64)
    out = np.empty((len(sets), k), dtype=np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(sets):
            to, held = at, 0
            while to < len(sets) and (to == at or held + len(sets[to]) <= chunk):
                held += len(sets[to])
                to += 1
            flat = np.concatenate(sets[at:to])
            starts = np.cumsum([0, *[len(s) for s in sets[at: to - 1]]])
            for i in range(k):
                out[at:to, i] = np.minimum.reduceat(flat * a[i] + b[i], starts)
            at = to
    return out


def _class_of(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


_SIGNED = "doc_id long, text_hash long, class binary, n_shingles long, bands array<long>, sketch array<long>"


def signatures(docs: DataFrame, bands: int = 32, rows: int = 4) -> DataFrame:
    """Per document: its class (a 128-bit hash of its set), set size, band keys and sketch."""
    ship_package(docs.sparkSession)
    k = bands * rows

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                sets = shingle_sets(part.column(1).to_pylist())
                full = [s for s in sets if len(s)]
                m = minima(full, k) if full else np.empty((0, k), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    keys = np.zeros((len(full), bands), dtype=np.uint64)
                    for j in range(rows):
                        keys = _finish(keys * np.uint64(_P) + m[:, j::rows])
                    keys = _finish(keys + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_P))
                bits = np.packbits((m[:, : k // 64 * 64] >> np.uint64(7) & np.uint64(1)).astype(np.uint8), axis=1)
                sketch = bits.copy().view("<i8") if len(full) else np.empty((0, k // 64), dtype=np.int64)
                at = iter(range(len(full)))
                where = [next(at) if len(s) else None for s in sets]
                yield pa.record_batch({
                    "doc_id": part.column(0), "text_hash": part.column(2),
                    "class": pa.array([_class_of(s) if len(s) else None for s in sets], pa.binary()),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "bands": pa.array([None if w is None else keys[w].view(np.int64) for w in where], pa.list_(pa.int64())),
                    "sketch": pa.array([None if w is None else sketch[w] for w in where], pa.list_(pa.int64()))})

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    return d.mapInArrow(run, _SIGNED)


def _far_filter(k: int, percent: int):
    """Pairs whose sizes or sketches rule out the similarity: by more than 5.5 standard deviations."""
    j = percent / 100
    agree = (1 + j) / 2
    least = int(k * agree - 5.5 * (k * agree * (1 - agree)) ** 0.5)
    apart = sum(F.bit_count(F.element_at("a.sketch", i + 1).bitwiseXOR(F.element_at("b.sketch", i + 1))) for i in range(k // 64))
    sizes = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    return sizes & (apart <= k // 64 * 64 - least)


def _pairs(buckets: DataFrame, close) -> DataFrame:
    """All pairs of each small bucket's members."""
    ms = F.col("members")
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.size(ms) - 1), lambda i: F.transform(
        F.slice(ms, i + 1, F.size(ms)), lambda y: F.struct(F.element_at(ms, i).alias("a"), y.alias("b")))))
    return buckets.select(F.explode(every).alias("p")).select("p.a", "p.b").where(close)


def _sets(docs: DataFrame, firsts: DataFrame, max_bits: int = 1 << 24) -> DataFrame:
    """(class, set) of the classes whose first document is in ``firsts`` (first).

    Sets are made again from the texts, for documents in a bit map of the wanted ids: at most
    ``max_bits`` bits, whatever the input; ids that only seem to be in it fall out in a later join.
    """
    n = firsts.count()
    bits = 64
    while bits < 16 * n and bits < max_bits:
        bits *= 2
    spot = F.pmod(F.xxhash64(F.coalesce("first", F.lit(-1).cast("long"))), F.lit(bits))
    words = (firsts.select(spot.alias("s")).groupBy(F.shiftright("s", 6).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(s & 63 AS INT))")).alias("v")))
    table = np.zeros(bits // 64, dtype=np.int64)
    for w, v in words.collect():
        table[w] = v
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        seen = held.value
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(seen[at >> 6] >> (at & 63) & 1)
            part = batch.take(pa.array(hit))
            for lo in range(0, part.num_rows, 500):
                sets = [s for s in shingle_sets(part.slice(lo, 500).column(1).to_pylist()) if len(s)]
                yield pa.record_batch({"class": pa.array([_class_of(s) for s in sets], pa.binary()),
                                       "set": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})

    first = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))
    d = pick(docs, "doc_id", "text").select("doc_id", "text", F.pmod(F.xxhash64(first), F.lit(bits)).alias("spot"))
    return d.mapInArrow(run, "class binary, set array<long>").groupBy("class").agg(F.first("set").alias("set"))


def _confirm(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b: classes by id, name and first document) whose full sets are similar enough."""
    sets = _sets(docs, pairs.select(F.col("a.first").alias("first")).union(pairs.select(F.col("b.first").alias("first"))).distinct())
    pa_ = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.class").alias("ca"), F.col("b.class").alias("cb"))
    with_a = pa_.join(sets.select(F.col("class").alias("ca"), F.col("set").alias("sa")), "ca")
    both = with_a.join(sets.select(F.col("class").alias("cb"), F.col("set").alias("sb")), "cb")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its least node) for every node of ``edges`` (a, b), by alternating stars.

    large-star links each node's larger neighbours to its least neighbour or itself, small-star
    the smaller ones; both keep components and only ever lower ends, until nothing changes.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, path = shared_table(e, "edges")
    last = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, large_path = shared_table(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        small, small_path = shared_table(small, "small-star")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove_shared(spark, path)
        remove_shared(spark, large_path)
        e, path = small, small_path
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joining_links(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Pairs of similar sets that join different labels, enough to join all of them; with ``side``, only pairs
    of different sides.  A set's common members with all others are counted through an index of the members."""
    sizes = np.array([len(s) for s in sets])
    member, inverse, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(inverse, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(held)])
    at = np.concatenate([[0], np.cumsum(sizes)])
    label, links = label.copy(), []
    for r in range(len(sets)):
        other = (label != label[r]) & (np.minimum(sizes, sizes[r]) * 100 >= np.maximum(sizes, sizes[r]) * percent)
        if side is not None:
            other &= side != side[r]
        if not other.any():
            continue
        own = inverse[at[r]: at[r + 1]]
        own = own[held[own] > 1]
        if not len(own):
            continue
        common = np.bincount(np.concatenate([owner[begin[m]: begin[m + 1]] for m in own]), minlength=len(sets))
        for o in np.flatnonzero(other & (common * 100 >= (sizes + sizes[r] - common) * percent)):
            if label[o] != label[r]:
                links.append((r, int(o)))
                label[label == label[o]] = label[r]
    return links


def _residue(docs: DataFrame, big: DataFrame, labels: DataFrame, percent: int, block_members: int = 1_000_000) -> DataFrame:
    """Links between different components within the large buckets: each bucket's full sets meet in memory, in
    blocks of about ``block_members`` set members, and only links that join components come out."""
    m = big.join(labels, big["id"] == labels["node"], "left").withColumn("comp", F.coalesce("component", "id")).drop("node", "component")
    open_ = (m.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("n").alias("members"))
             .where("lo < hi").select("key", F.ceil(F.col("members") / block_members).cast("int").alias("blocks")))
    m, path = shared_table(m.join(open_, "key"), "open-buckets")
    sets = _sets(docs, m.select("first").distinct())
    m = m.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def run(table):
        sets = [np.array(s, dtype=np.int64) for s in table.column("set").to_pylist()]
        cross = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        links = joining_links(sets, table.column("comp").to_numpy().copy(), table.column("own").to_numpy() if cross else None, percent)
        ids = table.column("id").to_numpy()
        return pa.table({"a": pa.array([ids[x] for x, _ in links], pa.int64()), "b": pa.array([ids[y] for _, y in links], pa.int64())})

    found = (m.select("key", "i", "j", "own", "id", "class", "comp").join(sets, "class")
             .select("key", "i", "j", "own", "id", "comp", "set").groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct())
    found, _ = shared_table(found, "residue")
    remove_shared(docs.sparkSession, path)
    return found


def near_duplicates(docs: DataFrame, percent: int = 75, bands: int = 32, rows: int = 4, small: int = 8) -> DataFrame:
    """Per document: doc_id, text_hash, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    k = bands * rows
    signed, signed_path = shared_table(signatures(docs, bands, rows), "signatures")
    classes = (signed.where("n_shingles > 0").groupBy("class")
               .agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
               .withColumn("id", F.monotonically_increasing_id()))
    classes, classes_path = shared_table(classes, "classes")
    member = F.struct("id", "class", "first", "n", "sketch")
    keyed = classes.select(F.posexplode("bands").alias("band", "key"), member.alias("m"))
    counts = (classes.select("id", F.posexplode("bands").alias("band", "key"))
              .groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("band", "id").alias("h"), "id")).alias("c"))
              .where("size > 1").select("key", "size", F.col("c.id").alias("centre")))
    close = _far_filter(k, percent)
    buckets, buckets_path = shared_table(keyed.join(counts, "key").select("key", "size", "centre", "m"), "buckets")
    few = buckets.where(F.col("size") <= small).groupBy("key").agg(F.sort_array(F.collect_list("m")).alias("members"))
    many = buckets.where(F.col("size") > small)
    centres = many.where(F.col("m.id") == F.col("centre")).select("key", F.col("m").alias("c"))
    stars = (many.where(F.col("m.id") != F.col("centre")).join(centres, "key")
             .select(F.least("m", "c").alias("a"), F.greatest("m", "c").alias("b")).where(close))
    ends = [F.struct(F.col(f"{s}.id").alias("id"), F.col(f"{s}.class").alias("class"), F.col(f"{s}.first").alias("first")).alias(s) for s in "ab"]
    pairs, pairs_path = shared_table(_pairs(few, close).union(stars).select(*ends).distinct(), "pairs")
    links, links_path = shared_table(_confirm(docs, pairs, percent), "links")
    found = components(links)
    big = many.select("key", F.col("m.id").alias("id"), F.col("m.class").alias("class"), F.col("m.first").alias("first"), F.col("m.n").alias("n"))
    rest = _residue(docs, big, found, percent)
    if not rest.isEmpty():
        found = components(links.union(rest))
    named = classes.select("id", "class", "first").join(found, F.col("id") == F.col("node"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = named.join(smallest, "component").select(F.col("class").alias("of"), "component_id")
    linked, _ = shared_table(linked, "linked")
    for path in (buckets_path, pairs_path, links_path):
        remove_shared(spark, path)
    own = classes.select(F.col("class").alias("of_class"), "first")
    d = signed.select("doc_id", "text_hash", "class", "n_shingles")
    d = d.join(own, d["class"] == own["of_class"], "left").join(linked, d["class"] == linked["of"], "left")
    whose = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "first"))
    return (d.select("doc_id", "text_hash", "n_shingles", whose.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def dedup_stage(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates (the least doc_id), and every text without a word, in the input's columns."""
    from pyspark.sql import Window

    kept = near_duplicates(docs).where("kept")
    worded = kept.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*")
    blank = kept.where("n_shingles = 0").select("doc_id", "text_hash").distinct()
    keys = worded.withColumn("one", F.lit(True)).union(blank.withColumn("one", F.lit(False)))
    keys = keys.select(F.coalesce("doc_id", F.lit(-1)).alias("ki"), F.col("doc_id").isNull().alias("kn"), F.col("text_hash").alias("kh"), "one")
    carried = Carried(docs, "doc_id", "text")
    rows = carried.frame.select("_row", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("ki"), F.col("doc_id").isNull().alias("kn"), F.xxhash64("text").alias("kh"))
    again = F.row_number().over(Window.partitionBy("ki", "kn", "kh").orderBy("ki"))
    return carried.restore(rows.join(keys, ["ki", "kn", "kh"]).withColumn("again", again).where(~F.col("one") | (F.col("again") == 1)))
