"""Personal data by weak supervision (DataFrame functions only).

Candidates are the spans of the four base patterns and of looser ones (addresses spelled with
``(at)``, phones without a plus, dotted card numbers, long IP addresses).  Five labelers vote for, against
or not at all on each: the base rule, a form check, a gazetteer, cue words in front, and the
span's borders.  Expectation-maximisation over the counts of vote patterns (at most 3^5 for
each kind, so its input is bounded whatever the corpus) gives each labeler's reliability and
each pattern's probability.  With these as soft labels a naive Bayes classifier over
features of the span itself (length, digits, shape, neighbours; each with a bounded number of values) is
trained by one aggregate over all candidates, and decides on the looser spans.  Base spans
always stay; a looser one that meets a base span, or an added one before it, is left out.

The patterns are anchored and possessive where that changes no match, so that neither long
runs nor many repeats cost more than linear time or deepen the regex engine's stack.

Defined results: a null text is empty and has no spans; a null id is an id like any other;
repeated rows are searched each; an empty table gives no rows; other columns are not looked
at (``redact`` carries them along).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracetrim.llm.common import Carried, text_or_empty
from tracetrim.session import shared_table

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: kind -> pattern whose matches, after ``_valid``, are the base spans: leftmost, not overlapping.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++ ?[(\[{{]at[)\]}}] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[{{]dot[)\]}}]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9.])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
}
#: What a text must hold for a pattern to be tried on it.
NEEDS = {("email", False): "@", ("phone", False): "+", ("ip", False): ".", ("email", True): "at", ("ip", True): ":"}
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

# Gazetteers and cues: fixed values.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "us", "eu", "ch", "at", "nl", "be")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
                 "51", "52", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92")
CUES = {
    "email": r"(?i)e-?mails?|contact|write to|reach|mailto|correo|courriel|kontakt",
    "ip": r"(?i)\bip\b|host|server|address|client|remote|from",
    "card": r"(?i)card|visa|master|amex|credit|payment|karte|carte|tarjeta",
    "phone": r"(?i)phone|tel\b|tel\.|call|mobile|cell|fax|telefon|t[ée]l[ée]phone|tel[ée]fono|sms",
}
COUNTER_CUES = r"(?i)\b(?:version|release|section|isbn|issn|order|invoice|serial|build|chapter|no)\.?[ :#]*$"


def _found(kind: str, loose: bool) -> Column:
    """Matches in ``body`` with what stands before each, as (kind, loose, i, gap, hit, left, right)."""
    pattern = F.lit((LOOSE if loose else BASE)[kind])
    hits = F.regexp_extract_all("body", pattern, F.lit(0))
    if (kind, loose) in NEEDS:
        hits = F.when(F.contains("body", F.lit(NEEDS[kind, loose])), hits)
    return F.coalesce(hits, F.array().cast("array<string>")).alias(f"{kind}_{int(loose)}")


def _placed(kind: str, loose: bool) -> Column:
    hits, pattern = F.col(f"{kind}_{int(loose)}"), (LOOSE if loose else BASE)[kind]
    between = F.when(F.size(hits) > 0, F.split("body", pattern, -1))
    return F.when(F.size(hits) > 0, F.transform(F.arrays_zip(hits.alias("h"), F.slice(between, 1, F.size(hits)).alias("g"), F.slice(between, 2, F.size(hits)).alias("n")),
                  lambda z, i: F.struct(F.lit(kind).alias("kind"), F.lit(loose).alias("loose"), i.alias("i"), F.length(z["g"]).alias("gap"), z["h"].alias("hit"),
                                        F.right(z["g"], F.lit(24)).alias("left"), F.left(z["n"], F.lit(8)).alias("right"))))


def candidates_in(docs: DataFrame, text: str, keep: list[str]) -> tuple[DataFrame, str]:
    """A written table: ``keep``, the row's number ``row`` and its candidates ``found``."""
    sides = [(k, loose) for loose in (False, True) for k in KINDS]
    d = docs.withColumn("body", text_or_empty(text)).withColumn("row", F.monotonically_increasing_id())
    d = d.select("row", *keep, "body", *[_found(*s) for s in sides])
    none = F.array().cast("array<struct<kind:string,loose:boolean,i:int,gap:int,hit:string,left:string,right:string>>")
    found = F.flatten(F.array(*[F.coalesce(_placed(*s), none) for s in sides]))
    return shared_table(d.select("row", *keep, found.alias("found")), "pii-candidates")


def _luhn(digits: Column) -> Column:
    at = lambda i: F.substring(digits, -i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(
        i % 2 == 1, at(i)).otherwise(at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0)))
    return (F.length(digits) > 0) & (total % 10 == 0)


def _small_parts(hit: Column) -> Column:
    plain = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).try_cast("int") <= 255))


def _valid() -> Column:
    """The base rule; looser spans never pass it."""
    n = F.length("digits")
    return ~F.col("loose") & (F.when(F.col("kind") == "email", True).when(F.col("kind") == "ip", _small_parts(F.col("hit")))
                              .when(F.col("kind") == "card", n.between(14, 19) & F.when(n <= 19, _luhn(F.col("digits"))).otherwise(False))
                              .otherwise(n.between(10, 15)))


def spans(table: DataFrame) -> DataFrame:
    """Each candidate with its place (code points, end exclusive) and whether it is a base span."""
    each = table.select("row", F.inline("found"))
    w = Window.partitionBy("row", "kind", "loose").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("hit")).over(upto)
    return (each.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("hit"))
            .withColumn("digits", F.regexp_replace("hit", "[^0-9]", "")).withColumn("base", _valid()).drop("gap", "i"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def with_votes(c: DataFrame) -> DataFrame:
    """The five labelers: 1 for, -1 against, 0 no vote."""
    kind, hit, n = F.col("kind"), F.col("hit"), F.length("digits")
    of = lambda **by: F.coalesce(*[F.when(kind == k, v) for k, v in by.items()])
    last = F.lower(F.regexp_extract("hit", r"([A-Za-z]+)$", 1))
    first = F.regexp_extract("digits", "^(.{0,3})", 1)
    rule = _vote(F.col("base"), ~F.col("loose") & ~F.col("base"))
    form = of(
        email=_vote(F.length(last).between(2, 24), F.length(last) == 0), ip=_vote(~hit.rlike(r"(^|\.)0[0-9]"), hit.rlike(r"(^|\.)0[0-9]")),
        card=_vote(n.between(14, 19) & F.when(n.between(14, 19), _luhn(F.col("digits"))).otherwise(False), ~n.between(14, 19)), phone=_vote(n.between(10, 15), ~n.between(10, 15)))
    codes = F.array(*[F.lit(x) for x in CALLING_CODES])
    gazetteer = of(
        email=_vote(last.isin(*TOP_DOMAINS), F.lit(False)), ip=_vote(~F.col("loose") & ~first.rlike("^(?:0|127|255)"), hit.rlike(r"^(?:0|127|255)\.")),
        card=_vote(F.substring("digits", 1, 1).isin("3", "4", "5", "6"), F.substring("digits", 1, 1).isin("0", "8", "9")),
        phone=_vote(F.exists(codes, lambda x: F.startswith("digits", x)), F.startswith("digits", F.lit("0"))))
    cue = _vote(of(**{k: F.col("left").rlike(p) for k, p in CUES.items()}), F.col("left").rlike(COUNTER_CUES))
    touching = F.col("left").rlike(r"[\p{L}\p{N}]$") | F.col("right").rlike(r"^[\p{L}\p{N}]")
    return c.withColumn("votes", F.array(rule, form, gazetteer, cue, _vote(~touching, touching)))


def reliabilities(patterns: list[tuple], rounds: int = 40) -> dict[tuple, float]:
    """(kind, votes, count) rows -> probability that a candidate with these votes is personal data.

    Two classes, labelers independent within a class; starts from the share of votes for.
    """
    out: dict[tuple, float] = {}
    for kind in KINDS:
        rows = [(tuple(v), n) for k, v, n in patterns if k == kind]
        if not rows:
            continue
        m = len(rows[0][0])
        p = {v: (1 + sum(x > 0 for x in v)) / (2 + sum(x != 0 for x in v)) for v, _ in rows}
        for _ in range(rounds):
            yes = sum(p[v] * n for v, n in rows)
            no = sum((1 - p[v]) * n for v, n in rows)
            prior = (yes + 1) / (yes + no + 2)
            # no vote is no evidence; a labeler is taken to be right more often than not until its votes say otherwise
            rate = [[{x: (sum((p[v] if c else 1 - p[v]) * n for v, n in rows if v[j] == x) + (3 if (x > 0) == bool(c) else 1))
                      / (sum((p[v] if c else 1 - p[v]) * n for v, n in rows if v[j]) + 4) for x in (-1, 1)} for j in range(m)] for c in (0, 1)]
            for v, _ in rows:
                odds = math.log(prior / (1 - prior)) + sum(math.log(rate[1][j][v[j]] / rate[0][j][v[j]]) for j in range(m) if v[j])
                p[v] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
        out |= {(kind, v): q for v, q in p.items()}
    return out


def _features() -> Column:
    """Name and value of each feature; every one has a bounded number of values."""
    shape = F.regexp_replace(F.regexp_replace("hit", "[A-Za-z]+", "a"), "[0-9]+", "0")
    edge = lambda c, p: F.when(F.length(c) == 0, "none").when(F.regexp_like(c, F.lit(p % r"\p{L}")), "letter").when(
        F.regexp_like(c, F.lit(p % r"\p{N}")), "digit").when(F.regexp_like(c, F.lit(p % r"\s")), "blank").otherwise("mark")
    pairs = {"length": F.least(F.length("hit"), F.lit(40)), "digits": F.least(F.length("digits"), F.lit(24)), "shape": F.pmod(F.xxhash64(shape), F.lit(64)),
             "left": edge(F.col("left"), r"%s$"), "right": edge(F.col("right"), r"^%s")}
    return F.array(*[F.concat(F.col("kind"), F.lit(f"|{k}|"), v.cast("string")) for k, v in pairs.items()])


def train(voted: DataFrame) -> dict[str, float]:
    """Log odds of each vote pattern (by reliabilities) and, by naive Bayes from those soft labels, of each feature value."""
    patterns = voted.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()  # at most 4 * 3^5 rows
    p = reliabilities([(r["kind"], r["votes"], r["n"]) for r in patterns])
    if not p:
        return {}
    key = F.concat("kind", F.lit("|"), F.array_join(F.col("votes").cast("array<string>"), ","))
    soft = F.create_map(*[F.lit(x) for (k, v), q in p.items() for x in (f"{k}|{','.join(map(str, v))}", q)])
    each = voted.select("kind", F.element_at(soft, key).alias("p"), F.explode(F.concat(_features(), F.array("kind"))).alias("f"))
    sums = each.groupBy("kind", "f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()  # at most 4 * (40 + 25 + 64 + 10 + 1)
    total = {r["kind"]: (r["yes"], r["no"]) for r in sums if r["f"] == r["kind"]}
    odds = {f"{k}|votes|{','.join(map(str, v))}": math.log((q + 1e-9) / (1 - q + 1e-9)) for (k, v), q in p.items()}
    for r in sums:
        yes, no = total[r["kind"]]
        if r["f"] != r["kind"]:  # shrunk towards the feature's share among all, so that a rare one says little
            share = (r["yes"] + r["no"]) / (yes + no)
            odds[r["f"]] = math.log((r["yes"] + 2 * share) / (yes + 2)) - math.log((r["no"] + 2 * share) / (no + 2))
    return odds


def decide(voted: DataFrame, odds: dict[str, float]) -> DataFrame:
    """Adds ``probability`` and ``taken``: base spans, and looser ones the classifier finds likelier than not."""
    if not odds:
        return voted.withColumn("probability", F.lit(0.0)).withColumn("taken", F.col("base"))
    table = F.create_map(*[F.lit(x) for k, v in sorted(odds.items()) for x in (k, float(v))])
    votes = F.concat(F.col("kind"), F.lit("|votes|"), F.array_join(F.col("votes").cast("array<string>"), ","))
    score = F.aggregate(F.concat(_features(), F.array(votes)), F.lit(0.0), lambda s, f: s + F.coalesce(F.element_at(table, f), F.lit(0.0)))
    voted = voted.withColumn("probability", 1 / (1 + F.exp(-score)))
    return voted.withColumn("taken", F.col("base") | (F.col("loose") & (F.col("probability") >= 0.5)))


def chosen(decided: DataFrame) -> DataFrame:
    """(row, start, at, end, base): all base spans, and looser ones that touch no base span and begin behind all
    looser ones before them (of two that begin together, the kind listed first).  Sorts and running extremes, so a
    text's spans cost what sorting them costs."""
    at = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    s = decided.where("taken").select("row", "start", at.alias("at"), "end", "base")
    each, upto = Window.partitionBy("row"), (Window.unboundedPreceding, -1)
    reached = F.max(F.when(F.col("base"), F.col("end"))).over(each.orderBy("start", F.col("base").desc(), "at").rowsBetween(*upto))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(each.orderBy(F.col("start").desc(), F.col("base").desc(), "at").rowsBetween(*upto))
    s = s.withColumns({"reached": reached, "ahead": ahead})
    s = s.where(F.col("base") | (F.coalesce(F.col("reached") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("ahead") >= F.col("end"), F.lit(True))))
    before = F.max(F.when(~F.col("base"), F.col("end"))).over(each.orderBy("start", "at", "end").rowsBetween(*upto))
    s = s.withColumn("before", before).where(F.col("base") | F.coalesce(F.col("before") <= F.col("start"), F.lit(True)))
    return s.select("row", "start", "at", "end", "base")


def _of_row(decided: DataFrame) -> DataFrame:
    """row, base and all: sorted (start, at, end) with ``at`` the kind's place in the list."""
    span = F.struct("start", "at", "end")
    return chosen(decided).groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("all"))


def _listed(c: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.coalesce(c, F.array().cast("array<struct<start:bigint,at:int,end:bigint>>")), lambda s: F.concat_ws(
        ":", F.element_at(names, s["at"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the base counts, base_sha256 and all spans."""
    d = Carried(docs, "doc_id", "text").frame.select("doc_id", "text")
    table, _ = candidates_in(d, "text", ["doc_id"])
    voted, _ = shared_table(with_votes(spans(table)), "pii-votes")
    rows = _of_row(decide(voted, train(voted)))
    out = table.select("row", "doc_id").join(rows, "row", "left")
    own = lambda i: F.filter("base", lambda s: s["at"] == i)
    counts = [F.coalesce(F.size(own(i)), F.lit(0)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("all").alias("spans"))


#: Code points in a block of a text that is cut.
BLOCK = 1024


def _piece(start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of the text held in ``blocks``: the work is that of its length."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    block = lambda i: F.element_at("blocks", i + 1)
    inside = F.substring(block(first), (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))
    across = F.concat(F.substring(block(first), (start - first * BLOCK + 1).cast("int"), F.lit(BLOCK)),
                      F.array_join(F.slice("blocks", first + 2, last - first - 1), ""), F.substring(block(last), F.lit(1), (end - last * BLOCK).cast("int")))
    return F.when(end <= start, "").when(first == last, inside).otherwise(across)


def redact(docs: DataFrame) -> DataFrame:
    """The input's rows with every span replaced by its kind's mark (overlapping spans by the first one's); ``n_chars``
    counts anew.  Rows without a candidate pass by the join."""
    carried = Carried(docs, "text")
    table, _ = candidates_in(carried.frame, "text", ["_row"])
    whole = carried.field("text")
    voted, _ = shared_table(with_votes(spans(table)), "pii-votes")
    rows = _of_row(decide(voted, train(voted)))
    marks = F.array(*[F.lit(MARKS[k]) for k in KINDS])
    # spans that overlap make one stretch, under the mark of the first; done piece by piece, as rows
    each = rows.select("row", F.inline("all"))
    w = Window.partitionBy("row").orderBy("start", "at", "end")
    before = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    each = each.withColumn("reach", before).withColumn("head", F.col("start") >= F.col("reach"))
    cuts = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "at", "end", "reach", "head"))).alias("cuts"))
    # in blocks, because a substring is looked for from the text's beginning
    joined = table.where(F.size("found") > 0).join(cuts, "row", "left").withColumn(
        "blocks", F.when(F.col("cuts").isNotNull(), F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    parts = F.transform("cuts", lambda c: F.when(c["head"], F.concat(_piece(c["reach"], c["start"]), F.element_at(marks, c["at"] + 1))).otherwise(""))
    ends = F.array_max(F.transform("cuts", lambda c: c["end"]))
    text = F.when(F.col("cuts").isNotNull(), F.concat(F.array_join(parts, ""), _piece(ends, F.length(whole)))).otherwise(whole)
    changed = joined.withColumn("new", text).select("_row", "new")
    same = table.where(F.size("found") == 0).select("_row", whole.alias("new"))
    return carried.restore(same.union(changed), text=F.col("new"), n_chars=F.length("new").cast("long"))
