"""How quality filters interact: what each removes first, again, or alone, in every order."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newscheck.session import discard, materialize

# Fixed pattern: what stands between words.
GAP = r"[\x20\x09-\x0D]+"
# A hash with more than one row in SHARE of all is salted; so there are at most SHARE of them.
SHARE = 1_000
# Hashes (8 bytes each) that may be sent to every task.
SENT = 1 << 21

Rule = Callable[[Column, Column], Column]
# Failure conditions of a text and its words. Each gives true or false, never null.
RULES: dict[str, Rule] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
}
COPY = "E"


def _texts(docs: DataFrame, part: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
        F.xxhash64(text).alias("hash"),
    )


def later_copies(texts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Rows of ``texts`` (``doc_id, text, hash``) whose text a smaller ``doc_id`` has, and the tables written for it.

    A left-semi join on hash and text with the smallest id of each repeated text. Hashes that
    occur once are found first, from eight bytes a row; where the list of the others is within
    :data:`SENT`, texts that occur once are not shuffled at all, else all are. Texts are
    combined before they are shuffled; a hash with more than a thousandth of all rows is
    spread over salts, each with its own copy of the one row to meet.
    Rows without an id are no copies and have none.
    """
    n = texts.count()
    limit = max(n // SHARE, 1)
    repeated = materialize(texts.groupBy("hash").count().where("count > 1"), "repeated")
    # more than n / SHARE rows each: at most SHARE rows
    hot = F.broadcast(repeated.where(F.col("count") > limit).select("hash", F.ceil(F.col("count") / limit).cast("int").alias("salts")))
    some = texts
    if repeated.count() <= SENT:
        some = texts.join(F.broadcast(repeated.select("hash")), "hash", "left_semi")
    first = some.groupBy("hash", "text").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = materialize(first.select("hash", "text", "first"), "first-copies")
    salts = F.coalesce("salts", F.lit(1))
    left = some.join(hot, "hash", "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int")).alias("l")
    right = first.join(hot, "hash", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("hash", "salt", "text")]
    found = left.join(right, [*same, F.col("r.first") < F.col("l.doc_id")], "left_semi")
    return found.drop("salt", "salts"), [repeated, first]


def combinations(docs: DataFrame, labels: DataFrame, rules: dict[str, Rule] = RULES, part: str = "lang") -> DataFrame:
    """``part, bits, n, good, toxic``: documents of each part by the set of filters that they fail.

    Bit k of ``bits`` stands for the k-th rule, the last one for being a copy
    (:func:`later_copies`). ``docs`` is ``doc_id, text`` and the column ``part``; a missing
    text is empty, a missing part is the empty string. ``labels`` is ``doc_id, quality,
    toxic``; a document is good (toxic) if any row with its id has quality (toxic) 1, never without an id.

    Ids of copies are united with those that fail another rule, each with its bits; rows are
    told apart by id, part and text hash, and of ids only those that fail are shuffled.
    """
    texts = _texts(docs, part)
    words = F.filter(F.split("text", GAP), lambda w: w != "")
    bits = sum((F.when(rule(F.col("text"), F.col("words")), 1 << k).otherwise(0) for k, rule in enumerate(rules.values())), F.lit(0))
    failing = texts.withColumn("words", words).withColumn("bits", bits).where("bits > 0")
    copies, written = later_copies(texts)
    row = ["doc_id", "part", "hash"]
    both = failing.select(*row, "bits", F.lit(1).alias("own"), F.lit(0).alias("copy")).union(
        copies.select(*row, F.lit(1 << len(rules)).alias("bits"), F.lit(0).alias("own"), F.lit(1).alias("copy"))
    )
    # equal rows fail alike, so both sums are the number of rows, or one is 0
    by_row = both.groupBy(*row).agg(F.bit_or("bits").alias("bits"), F.greatest(F.sum("own"), F.sum("copy")).alias("n"))
    # a row for each id and set of bits, however often the id is there
    by_id = by_row.groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    count = lambda name: F.sum(F.col("n") * F.coalesce(name, F.lit(0))).alias(name)
    failed = by_id.join(known, "doc_id", "left").groupBy("part", "bits").agg(F.sum("n").alias("n"), count("good"), count("toxic"))
    failed = materialize(failed, "combinations")
    discard(*written)
    none = F.lit(0).cast("long")
    total = docs.groupBy(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")).agg(F.count("*").alias("n"))
    clean = total.union(failed.select("part", -F.col("n"))).groupBy("part").agg(F.sum("n").alias("n"))
    return failed.union(clean.select("part", F.lit(0), "n", none, none))


def all_orders(counts: DataFrame, letters: str) -> DataFrame:
    """Every order of the filters, step by step, from the counts of :func:`combinations`.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``. The work is by sets of filters, whatever the number of documents.
    """
    orders = ",".join("".join(p) for p in permutations(letters))
    at = counts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(letters))))
    )
    here = F.substring("filter_order", F.col("step"), F.lit(1))
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    bit = sum((F.when(here == letter, 1 << k).otherwise(0) for k, letter in enumerate(letters)), F.lit(0))
    before = sum((F.when(earlier.contains(letter), 1 << k).otherwise(0) for k, letter in enumerate(letters)), F.lit(0))
    at = at.withColumns({"bit": bit, "before": before})
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    gone = F.col("bits").bitwiseAND(F.col("before")) != 0
    count = lambda when, value="n": F.sum(F.when(when, F.col(value)).otherwise(0)).cast("long")
    # of the orders, the filter comes first among those that a document fails in one of bit_count
    share = F.expr(f"n * ({factorial(len(letters))} div bit_count(bits))")
    return at.groupBy("part", "filter_order", "step").agg(
        count(~fails & ~gone).alias("kept"),
        count(fails & ~gone).alias("removed"),
        count(fails & gone).alias("redundant"),
        count(F.col("bits") == F.col("bit")).alias("unique_fails"),
        count(fails & ~gone, "good").alias("good_lost"),
        count(fails & ~gone, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, share).otherwise(0)).cast("long").alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame, rules: dict[str, Rule] = RULES, part: str = "lang") -> DataFrame:
    """:func:`all_orders` of :func:`combinations`; no documents, no rows."""
    return all_orders(combinations(docs, labels, rules, part), "".join(rules) + COPY)
