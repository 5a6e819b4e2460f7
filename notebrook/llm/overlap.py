"""Notebooks of the evaluation splits that are also in the training split, exactly or nearly (problem 1).

A notebook is the bag of its code lines without comments, white space and blank lines; the k-th copy of a line is a token
of its own, so bags become sets. An exact prefix-filter join finds all pairs at a Jaccard similarity of at least THRESHOLD: tokens
are ordered by how many bags have them, rarest first; two bags that similar share a token among the first
``size - ceil(THRESHOLD * size) + 1`` of each. Evaluation prefixes are the index, training prefixes probe it, pairs that
fail the length or position bound are dropped, the rest are verified on the whole bags.

Notebooks with equal bags form one class that is joined once. Rows with a null split take no part; a notebook without code
lines matches nothing; repeated rows count once; null lines and cells are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notebrook.session import written

THRESHOLD = 0.7
#: A token in at least this share of all token rows is hot; there can be no more than its inverse, which bounds the broadcast.
HOT_SHARE = 0.001
#: Training rows of one token that meet its evaluation rows in one task.
PART_ROWS = 2000
#: A closed string on one line (kept), or a comment (dropped): possessive, so that long lines need no deep recursion.
STRING_OR_COMMENT = r"""("[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+')|#.*"""


def bare_lines(content: Column) -> Column:
    """Lines without comments and white space; blank ones dropped."""
    plain = F.transform(content, lambda x: F.regexp_replace(F.regexp_replace(x, STRING_OR_COMMENT, "$1"), r"\s+", ""))
    return F.filter(plain, lambda x: x.isNotNull() & (x != ""))


def line_bags(notebooks: DataFrame) -> DataFrame:
    """notebook_id, dataset, side (train, valid, test), bag (sorted line hashes), class."""
    cells = F.flatten(F.transform(F.col("segments"), lambda s: F.coalesce(s["cells"], F.array())))
    code = F.filter(cells, lambda c: (c["type"] == "code") & c["content"].isNotNull())
    lines = F.flatten(F.transform(code, lambda c: bare_lines(c["content"])))
    hashed = F.array_sort(F.transform(lines, lambda x: F.xxhash64(x)))
    return (
        notebooks.where("split in ('train', 'valid', 'test')")
        .select("notebook_id", "dataset", F.col("split").alias("side"), hashed.alias("bag"))
        .where(F.size("bag") > 0)
        .withColumn("class", F.md5(F.to_json("bag")))
        .dropDuplicates(["notebook_id", "side", "class"])
    )


def similar_classes(bags: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """class_e, class_t, jaccard of every pair of an evaluation and a training class at the threshold or above."""
    classes = bags.groupBy("class").agg(
        F.max((F.col("side") == "train").cast("int")).alias("in_train"),
        F.max((F.col("side") != "train").cast("int")).alias("in_eval"),
        F.any_value("bag").alias("bag"),
    )
    tokens = written(
        classes.select("class", "in_train", "in_eval", F.size("bag").alias("n"), F.explode("bag").alias("line"))
        .groupBy("class", "in_train", "in_eval", "n", "line")
        .count()
        .select("class", "in_train", "in_eval", "n", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("k"), "line")
        .select("class", "in_train", "in_eval", "n", F.xxhash64("line", "k").alias("t")),
        "tokens",
    )
    frequency = written(tokens.groupBy("t").agg(F.count("*").alias("df"), F.max("in_train").alias("tr"), F.max("in_eval").alias("ev")), "frequency")
    hot = frequency.where(F.col("df") >= max(2, tokens.count() * HOT_SHARE)).select("t", F.col("df").alias("hot_df"), F.lit(True).alias("hot"))
    marked = tokens.join(F.broadcast(hot), "t", "left")
    common = marked.where("hot").withColumn("df", F.col("hot_df")).withColumn("both", F.lit(True))
    rare = marked.where("hot is null").join(frequency.select("t", "df", ((F.col("tr") == 1) & (F.col("ev") == 1)).alias("both")), "t")
    keep = ["class", "in_train", "in_eval", "n", "t", "df", "both"]
    ordered = written(
        common.select(*keep)
        .unionByName(rare.select(*keep))
        .groupBy("class", "in_train", "in_eval", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "t", "both"))).alias("tokens")),
        "ordered",
    )
    n = F.col("n")
    prefix = (
        ordered.select("class", "in_train", "in_eval", "n", F.posexplode(F.slice("tokens", F.lit(1), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))).alias("pos", "x"))
        .where("x.both")
        .select("class", "in_train", "in_eval", "n", "pos", F.col("x.t").alias("t"))
    )
    e = prefix.where("in_eval = 1").select(F.col("class").alias("class_e"), F.col("n").alias("ne"), F.col("pos").alias("pe"), "t")
    r = prefix.where("in_train = 1").select(F.col("class").alias("class_t"), F.col("n").alias("nt"), F.col("pos").alias("pt"), "t")
    need = F.ceil((F.col("ne") + F.col("nt")) * threshold / (1 + threshold) - 1e-9)
    # many training bags may share a rare token: they are split into parts, for each of which the evaluation row is repeated
    parts = r.groupBy("t").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    e = e.join(parts, "t").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    r = r.join(parts, "t").withColumn("part", F.pmod(F.xxhash64("class_t"), F.col("parts")).cast("int")).drop("parts")
    candidates = (
        e.join(r, ["t", "part"])
        .where((F.col("nt") >= F.col("ne") * threshold - 1e-9) & (F.col("ne") >= F.col("nt") * threshold - 1e-9))
        .where(F.least(F.col("ne") - F.col("pe"), F.col("nt") - F.col("pt")) >= need)
        .select("class_e", "class_t")
        .distinct()
    )
    sets = ordered.select("class", F.transform("tokens", lambda x: x["t"]).alias("set"))
    shared = F.size(F.array_intersect("set_e", "set_t"))
    return (
        candidates.join(sets.select(F.col("class").alias("class_e"), F.col("set").alias("set_e")), "class_e")
        .join(sets.select(F.col("class").alias("class_t"), F.col("set").alias("set_t")), "class_t")
        .select("class_e", "class_t", (shared / (F.size("set_e") + F.size("set_t") - shared)).alias("jaccard"))
        .where(F.col("jaccard") >= threshold)
    )


def cross_split_pairs(notebooks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """eval_id, eval_side, eval_dataset, train_id, train_dataset, jaccard."""
    bags = written(line_bags(notebooks), "bags")
    members = bags.select("class", "notebook_id", "side", "dataset")
    e = members.where("side != 'train'").select(F.col("class").alias("class_e"), F.col("notebook_id").alias("eval_id"), F.col("side").alias("eval_side"), F.col("dataset").alias("eval_dataset"))
    r = members.where("side = 'train'").select(F.col("class").alias("class_t"), F.col("notebook_id").alias("train_id"), F.col("dataset").alias("train_dataset"))
    return similar_classes(bags, threshold).join(e, "class_e").join(r, "class_t").drop("class_e", "class_t").where("eval_id != train_id")


def found_pairs(notebooks: DataFrame) -> DataFrame:
    pairs = cross_split_pairs(notebooks)
    return pairs.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def overlap_report(notebooks: DataFrame) -> DataFrame:
    """Per split and source of the evaluation notebooks: pairs, notebooks that leak, and how many are exact."""
    pairs = cross_split_pairs(notebooks)
    per_book = pairs.groupBy("eval_side", "eval_dataset", "eval_id").agg(F.count("*").alias("n"), F.count_if(F.col("jaccard") == 1).alias("same"))
    return per_book.groupBy(F.col("eval_side").alias("split"), F.col("eval_dataset").alias("dataset")).agg(
        F.count("*").alias("notebooks"), F.sum("n").alias("pairs"), F.sum("same").alias("exact_pairs")
    )
