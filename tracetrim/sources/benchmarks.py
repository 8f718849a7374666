"""Benchmark registry (A1), curated fallback rows (A3), question loading.

Questions are rows of a DataFrame: ``question_key, id, dataset, category, question,
ground_truth, metadata STRUCT<config, split, index>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracetrim.functions.text import py_strip
from tracetrim.operators.ordering import dense_position
from tracetrim.operators.format import format_rows
from tracetrim.operators.frames import keep_where

GENERAL_CATEGORY = "General Reasoning"

# The benchmark registry (alias, path, config, category, question field, answer field).
REGISTRY_ROWS = [
    ("gsm8k", "openai/gsm8k", "main", "Arithmetic & Word Math", "question", "answer"),
    ("arc_challenge", "allenai/ai2_arc", "ARC-Challenge", "Scientific Reasoning", "question", "answerKey"),
    ("arc_easy", "allenai/ai2_arc", "ARC-Easy", "Scientific Reasoning", "question", "answerKey"),
    ("commonsense_qa", "tau/commonsense_qa", None, "Commonsense & Physical Logic", "question", "answerKey"),
    ("hotpot_qa", "hotpotqa/hotpot_qa", "distractor", "Multi-hop & Deductive Logic", "question", "answer"),
    ("svamp", "ChilleD/SVAMP", None, "Arithmetic & Word Math", "question_concat", "Answer"),
    ("squad_v2", "rajpurkar/squad_v2", None, "Extractive & Span QA", "question", "answers"),
    ("sciq", "allenai/sciq", None, "Scientific Reasoning", "question", "correct_answer"),
    ("openbookqa", "allenai/openbookqa", "main", "Scientific Reasoning", "question_stem", "answerKey"),
]
REGISTRY_SCHEMA = "alias string, path string, config string, category string, question_field string, answer_field string"

# The default spectrum of benchmark families.
DEFAULT_SPECTRUM = ["gsm8k", "arc_challenge", "commonsense_qa", "hotpot_qa", "svamp", "squad_v2"]

# Curated benchmark questions used when a source cannot be read
# (id, dataset, category, question, ground_truth, source_split, config, index).
CURATED_ROWS = [
    ("gsm8k_001", "openai/gsm8k", "Arithmetic & Word Math",
     "Natalia sold clips to 48 of her friends in April, and then she sold half as many clips in May. How many clips did Natalia sell altogether in April and May?",
     "72", "train", None, 0),
    ("gsm8k_002", "openai/gsm8k", "Arithmetic & Word Math",
     "Weng earns $12 an hour for babysitting. Yesterday, she just did 50 minutes of babysitting. How much did she earn?",
     "10", "train", None, 1),
    ("arc_001", "allenai/ai2_arc", "Scientific Reasoning",
     "George wants to warm his hands quickly by rubbing them. Which skin surface will produce the most heat? (A) dry palms (B) wet palms (C) palms covered with oil (D) palms covered with lotion",
     "A", "train", "ARC-Challenge", 0),
    ("arc_002", "allenai/ai2_arc", "Scientific Reasoning",
     "Which of the following statements best explains why magnets usually stick to a refrigerator door? (A) The refrigerator door is smooth. (B) The refrigerator door contains iron. (C) The refrigerator door is a good conductor. (D) The refrigerator door has electric wires in it.",
     "B", "train", "ARC-Challenge", 1),
    ("cqa_001", "tau/commonsense_qa", "Commonsense & Physical Logic",
     "The sanctions against the school were a punishing blow, and they seemed to what the efforts the school had made to change? (A) ignore (B) enforce (C) authoritarian (D) yell at (E) avoid",
     "A", "train", None, 0),
    ("cqa_002", "tau/commonsense_qa", "Commonsense & Physical Logic",
     "Sammy wanted to go to where the people were. Where might he go? (A) race track (B) populated areas (C) the desert (D) apartment (E) roadblock",
     "B", "train", None, 1),
    ("hotpot_001", "hotpotqa/hotpot_qa", "Multi-hop & Deductive Logic",
     "Which magazine was started first Arthur's Magazine or First for Women?",
     "Arthur's Magazine", "train", "distractor", 0),
    ("hotpot_002", "hotpotqa/hotpot_qa", "Multi-hop & Deductive Logic",
     "The Oberoi family is part of a hotel company that has a head office in what city?",
     "Delhi", "train", "distractor", 1),
    ("svamp_001", "ChilleD/SVAMP", "Arithmetic & Word Math",
     "There are 87 oranges and 290 bananas in Philip's collection. If the bananas are organized into 2 groups and oranges are organized into 93 groups How big is each group of bananas?",
     "145", "train", None, 0),
    ("squad_001", "rajpurkar/squad_v2", "Extractive & Span QA",
     "Context: The Apollo 11 mission landed on the Moon on July 20, 1969, carrying Neil Armstrong and Buzz Aldrin.\n\nQuestion: In what year did Apollo 11 land on the Moon?",
     "1969", "train", None, 0),
]
CURATED_SCHEMA = ("id string, dataset string, category string, question string, ground_truth string, "
                  "source_split string, config string, `index` int")


def registry(spark: SparkSession) -> DataFrame:
    """The 9-row registry as a DataFrame (a fixed-size dimension: safe to broadcast)."""
    return spark.createDataFrame(REGISTRY_ROWS, REGISTRY_SCHEMA)


def curated(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CURATED_ROWS, CURATED_SCHEMA)


def resolve_benchmarks(names: DataFrame, name_col: str = "name", config_col: str | None = None) -> DataFrame:
    """A1: alias key = lower(strip(name)); a hit gives path, config (caller's first) and
    category; a miss keeps the name as path and the category "General Reasoning"."""
    spark = names.sparkSession
    reg = registry(spark).select(F.col("alias").alias("_alias"), F.col("path").alias("_path"),
                                 F.col("config").alias("_config"), F.col("category").alias("_category"))
    keyed = names.withColumn("alias_key", F.lower(py_strip(F.col(name_col))))
    j = keyed.join(F.broadcast(reg), keyed["alias_key"] == reg["_alias"], "left")
    hit = F.col("_alias").isNotNull()
    cfg = F.col(config_col) if config_col else F.lit(None).cast("string")
    return (j.withColumn("registry_hit", hit)
             .withColumn("path", F.when(hit, F.col("_path")).otherwise(F.col(name_col)))
             .withColumn("config", F.when(hit, F.coalesce(F.nullif(cfg, F.lit("")), F.col("_config"))).otherwise(cfg))
             .withColumn("category", F.when(hit, F.col("_category")).otherwise(F.lit(GENERAL_CATEGORY)))
             .drop("_alias", "_path", "_config", "_category"))


def curated_for(names: DataFrame, n: int, alias_col: str = "alias_key", path_col: str = "path") -> DataFrame:
    """A3: curated rows whose id contains the alias key or whose dataset equals the path;
    all rows when none match; the first ``n`` in curated order.  Row-local against a
    10-element literal array (no join)."""
    lit_rows = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(r[0]).alias("id"), F.lit(r[1]).alias("dataset"), F.lit(r[2]).alias("category"),
                 F.lit(r[3]).alias("question"), F.lit(r[4]).alias("ground_truth"), F.lit(r[7]).alias("index"))
        for i, r in enumerate(CURATED_ROWS)])
    key, path = F.col(alias_col), F.col(path_col)
    matched = F.filter(lit_rows, lambda c: c["id"].contains(key) | (c["dataset"] == path))
    chosen = F.slice(F.when(F.size(matched) > 0, matched).otherwise(lit_rows), 1, n)
    out = names.withColumn("_c", chosen).select(*names.columns, F.inline_outer("_c"))
    return out.where(F.col("id").isNotNull())


def load_questions(source: DataFrame, alias: str, order_col: str, split: str = "train",
                   num_samples: int | None = None, config: str | None = None) -> DataFrame:
    """A2: format each row (B5), number rows in source order, keep the first ``num_samples``
    (numbering and the cap come *before* empty questions are dropped), id = alias_split_idx.

    With a cap the first rows come from a top-k (TakeOrderedAndProject); without one,
    positions come from ``dense_position``.  Every row has a number: a null ``order_col`` comes first,
    equal ones follow each other by question and answer.
    """
    res = resolve_alias(alias, config)
    fmt = format_rows(source)
    if num_samples is not None:
        order = [order_col, "question_text", "answer_text"]
        top = fmt.orderBy(*order).limit(num_samples)
        positioned = top.withColumn("idx", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    else:
        # the rows themselves are numbered: repeated and null keys keep a row and a position each
        rows = fmt.select(order_col, "question_text", "answer_text")
        positioned = dense_position(rows, [order_col, "question_text", "answer_text"])
    out = keep_where(positioned, F.col("question_text") != "")
    return out.select(
        F.col(order_col).alias("question_key"),
        F.concat(F.lit(f"{res['alias_key']}_{split}_"), F.col("idx").cast("string")).alias("id"),
        F.lit(res["path"]).alias("dataset"),
        F.lit(res["category"]).alias("category"),
        F.col("question_text").alias("question"),
        F.col("answer_text").alias("ground_truth"),
        F.struct(F.lit(res["config"]).cast("string").alias("config"), F.lit(split).alias("split"),
                 F.col("idx").alias("index")).alias("metadata"),
    )


def spectrum(sources: dict, order_col: str, per_benchmark: int = 2, split: str = "train") -> DataFrame:
    """A4: the first ``per_benchmark`` questions of each benchmark, concatenated.

    ``sources`` maps alias -> DataFrame.  Each benchmark is formatted, numbered and cut
    with ``row_number() <= n`` over its own window, which Spark plans with a partial
    WindowGroupLimit before the shuffle, so a huge benchmark sends only n rows per task.
    """
    parts = []
    for alias, df in sources.items():
        res = resolve_alias(alias)  # parameters, resolved on the driver without a job
        fmt = format_rows(df).select(
            F.lit(alias).alias("benchmark"), F.col(order_col).alias("question_key"), "question_text", "answer_text",
            F.lit(res["alias_key"]).alias("alias_key"), F.lit(res["path"]).alias("dataset"),
            F.lit(res["category"]).alias("category"))
        parts.append(fmt)
    allq = parts[0]
    for p in parts[1:]:
        allq = allq.unionByName(p)
    w = Window.partitionBy("benchmark").orderBy("question_key")
    # the filter must be on the rank itself for Spark to add the partial WindowGroupLimit
    top = allq.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_benchmark)
    top = top.withColumn("idx", F.col("_rn") - 1).where(F.col("question_text") != "")
    return top.select(
        "benchmark", "question_key",
        F.concat(F.col("alias_key"), F.lit(f"_{split}_"), F.col("idx").cast("string")).alias("id"),
        "dataset", "category",
        F.col("question_text").alias("question"), F.col("answer_text").alias("ground_truth"),
        F.col("idx").cast("long").alias("index"),
    )


def spectrum_from_paths(spark: SparkSession, paths: dict | None, order_col: str, per_benchmark: int = 2,
                        split: str = "train", fmt: str = "parquet") -> DataFrame:
    """A4 over stored sources: ``paths`` maps alias -> path (default spectrum aliases
    with paths equal to their names).  Each alias whose source cannot be opened gives its own
    curated rows, ``per_benchmark`` at most; the others are read."""
    paths = paths or {alias: alias for alias in DEFAULT_SPECTRUM}
    opened = {alias: path for alias, path in paths.items() if readable(spark, path, fmt)}
    parts = []
    if opened:
        sources = {alias: spark.read.format(fmt).load(path) for alias, path in opened.items()}
        parts.append(spectrum(sources, order_col, per_benchmark, split).withColumn("question_key", F.col("question_key").cast("string")))
    closed = [alias for alias in paths if alias not in opened]
    if closed:
        parts.append(curated_spectrum(spark, closed, per_benchmark))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def curated_spectrum(spark: SparkSession, aliases: list[str], per_benchmark: int) -> DataFrame:
    """A3 for each alias, in the spectrum's columns; the key is the row's place among the curated ones."""
    found = [resolve_alias(a) for a in aliases]
    names = spark.createDataFrame([(a, r["alias_key"], r["path"]) for a, r in zip(aliases, found)], "benchmark string, alias_key string, path string")
    return curated_for(names, per_benchmark).select(
        "benchmark", F.col("pos").cast("string").alias("question_key"), "id", "dataset", "category", "question", "ground_truth",
        F.col("index").cast("long").alias("index"))


def questions_from(obj, spark: SparkSession | None = None, key_col: str | None = None,
                   max_samples: int | None = None) -> DataFrame:
    """A5: normalise the accepted inputs to one question table.

    * list of str  -> question, dataset "custom"
    * list of dict -> as given
    * DataFrame    -> formatted rows (B5), dataset "hf_dataset"
    * str          -> a parquet path loaded with A2 (all its rows unless ``max_samples`` is given),
                      curated rows if unreadable
    Other types are an error, and so is a DataFrame without ``key_col``: a key made up from
    partitions would let the same call keep other rows.  Null and empty questions are dropped;
    ``max_samples`` caps the input (first rows by key).
    """
    if isinstance(obj, str):
        if spark is None:
            raise ValueError("a SparkSession is needed to load questions from a path")
        return load_or_curated(spark, obj, alias=obj.rstrip("/").split("/")[-1].split(".")[0],
                               order_col=key_col or "item_id", num_samples=max_samples).select(
            "question_key", "question", "ground_truth", "dataset", "category")
    if isinstance(obj, DataFrame):
        if not key_col:
            raise ValueError("name the key column of the questions")
        fmt = format_rows(obj)
        df = fmt.select(F.col(key_col).alias("question_key"), F.col("question_text").alias("question"),
                        F.col("answer_text").alias("ground_truth"), F.lit("hf_dataset").alias("dataset"),
                        F.lit(None).cast("string").alias("category"))
    elif isinstance(obj, (list, tuple)):
        if spark is None:
            raise ValueError("a SparkSession is needed to build questions from a list")
        rows = []
        for i, item in enumerate(obj):
            if isinstance(item, dict):
                q = item.get("question")
                rows.append((i, None if q is None else str(q), item.get("ground_truth"), item.get("dataset"), item.get("category")))
            else:
                rows.append((i, str(item), None, "custom", None))
        df = spark.createDataFrame(rows, "question_key long, question string, ground_truth string, dataset string, category string")
    else:
        raise ValueError(f"Unsupported questions type: {type(obj)}")
    if max_samples is not None:
        df = df.orderBy("question_key").limit(max_samples)
    return df.where(F.coalesce(F.col("question"), F.lit("")) != "")


def eval_inputs(df: DataFrame, key_col: str, question_field: str = "question", answer_field: str = "answer",
                max_samples: int | None = None) -> DataFrame:
    """Question column with a ``problem`` fallback; a missing answer column -> null gold."""
    cols = set(df.columns)
    if question_field in cols:
        q = F.coalesce(F.col(question_field).cast("string"), F.lit("None"))
    elif "problem" in cols:
        q = F.coalesce(F.col("problem").cast("string"), F.lit("None"))
    else:
        q = F.lit("")
    gt = F.coalesce(F.col(answer_field).cast("string"), F.lit("None")) if answer_field in cols else F.lit(None).cast("string")
    out = df.select(F.col(key_col).alias("question_key"), q.alias("question"), gt.alias("ground_truth"))
    if max_samples is not None:
        out = out.orderBy("question_key").limit(max_samples)
    return out


def pair_lists(spark: SparkSession, questions: list, golds: list | None) -> DataFrame:
    """A7 list input: questions and golds paired by position (the shorter list wins)."""
    if golds:
        rows = [(i, str(q), str(g)) for i, (q, g) in enumerate(zip(questions, golds))]
    else:
        rows = [(i, str(q), None) for i, q in enumerate(questions)]
    return spark.createDataFrame(rows, "question_key long, question string, ground_truth string")


def in_file_order(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet source with ``file_order``: the file and the row's place in it, whatever splits read it."""
    df = spark.read.parquet(path)
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("file_order"))


def zip_inputs(questions: DataFrame, golds: DataFrame | None, question: str = "question", gold: str = "answer",
               question_order="file_order", gold_order="file_order", max_samples: int | None = None) -> DataFrame:
    """A7 over two tables: the i-th question with the i-th gold, the shorter table ends the pairs; without a gold table
    every gold is null.

    Places are dense positions in each table's own order (equal rows in any order, nulls first), so the tables need no common key
    and may be split anyhow.  Null values are the text "None".
    """
    def placed(df, value, order, name):
        rows = df.select(F.col(order).alias("_order"), F.coalesce(F.col(value).cast("string"), F.lit("None")).alias(name))
        if max_samples is not None:
            rows = rows.orderBy("_order", name).limit(max_samples)
        return dense_position(rows, ["_order", name], "question_key").drop("_order")

    asked = placed(questions, question, question_order, "question")
    if golds is None:
        return asked.select("question_key", "question", F.lit(None).cast("string").alias("ground_truth"))
    return asked.join(placed(golds, gold, gold_order, "ground_truth"), "question_key").select("question_key", "question", "ground_truth")


def resolve_alias(name: str, config: str | None = None) -> dict:
    """A1 for a single parameter value (no Spark job): same rule as ``resolve_benchmarks``."""
    key = name.strip().lower()
    for alias, path, cfg, category, _qf, _af in REGISTRY_ROWS:
        if alias == key:
            return {"alias_key": key, "path": path, "config": config or cfg, "category": category, "registry_hit": True}
    return {"alias_key": key, "path": name, "config": config, "category": GENERAL_CATEGORY, "registry_hit": False}


def readable(spark: SparkSession, path: str, fmt: str = "parquet") -> bool:
    """Driver-side trigger for the curated fallback: can the source be opened?  Only the
    footer/schema is touched, through the cluster's file system (not os.path)."""
    try:
        spark.read.format(fmt).load(path).schema
        return True
    except Exception:  # noqa: BLE001 - any failure to open means "fall back"
        return False


def load_or_curated(spark: SparkSession, path: str, alias: str, order_col: str, num_samples: int | None,
                    split: str = "train", fmt: str = "parquet") -> DataFrame:
    """A2 with the A3 fallback: curated rows when the source cannot be opened."""
    if readable(spark, path, fmt):
        return load_questions(spark.read.format(fmt).load(path), alias, order_col, split, num_samples)
    res = resolve_alias(alias)
    names = spark.createDataFrame([(res["alias_key"], res["path"])], "alias_key string, path string")
    return curated_for(names, len(CURATED_ROWS) if num_samples is None else num_samples).select(
        F.col("pos").cast("long").alias("question_key"), "id", "dataset", "category", "question", "ground_truth")
