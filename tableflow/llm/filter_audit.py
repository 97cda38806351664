"""Filter interaction audit: what every filter removes, at every place of every order of the filters.

Texts are judged once; of the table only *mask cells* are left: per part, which filters a document fails, with the
numbers of documents, of good and of toxic ones. A recursive query then extends prefixes of filters by
each unused letter, joins the cells of the part, carries the bits applied so far, and gives the figures of
that step. It has 325 rows per part for five filters, whatever the number of documents.

* A null text is empty, a null part (source) is the part ``''``, together with a source that is ``''``.
* Filter E compares whole texts (by SHA-256) with those of smaller ids in the whole table. Rows with equal ids are
  not smaller than each other; a null id neither fails E nor makes another row fail it.
* Labels may be missing or repeated: a document is good (toxic) if any of its labels says so.
* Repeated rows are documents of their own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableflow.llm.store import stored

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5

LETTERS = "ABCDE"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * capitals > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SYMBOL),
    }


def cells(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """``part``, ``mask`` (bit i: fails the letter i), ``n``, ``good`` and ``toxic``, one row per part and mask.

    One pass over the texts; what is shuffled is an id, a digest and a mask per document. The first of equal texts
    is looked up by digest and id together, so copies of one text spread over all tasks.
    """
    whole = docs.select(
        F.col(key).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("body"),
    )
    mask = F.lit(0)
    for bit, fails in enumerate(text_filters(F.col("body")).values()):
        mask = mask + F.when(fails, 1 << bit).otherwise(0)
    marked = stored(
        whole.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("body", 256)).alias("digest")), "masks"
    )
    firsts = marked.groupBy(F.col("digest").alias("first_digest")).agg(F.min("id").alias("first_id"))
    flags = labels.groupBy(F.col(key).alias("labelled")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"),
    )
    found = marked.join(flags, F.col("id") == F.col("labelled"), "left").join(
        firsts, (F.col("digest") == F.col("first_digest")) & (F.col("id") == F.col("first_id")), "left"
    )
    repeats = F.col("first_id").isNull() & F.col("id").isNotNull()
    whole_mask = F.col("mask") + F.when(repeats, 1 << LETTERS.index("E")).otherwise(0)
    return found.groupBy("part", whole_mask.alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_good").alias("good"), F.count_if("is_toxic").alias("toxic")
    )


STEPS = """
with recursive steps(part, prefix, applied, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) as (
  select part, '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L from {parts}
  union all
  select next.part, next.prefix || next.letter, next.applied | next.bit, next.step + 1,
    aggregate(filter(known.cells, c -> c.mask & (next.applied | next.bit) = 0), 0L, (sum, c) -> sum + c.n),
    aggregate(filter(known.cells, c -> c.mask & next.applied = 0 and c.mask & next.bit > 0), 0L, (sum, c) -> sum + c.n),
    aggregate(filter(known.cells, c -> c.mask & next.applied > 0 and c.mask & next.bit > 0), 0L, (sum, c) -> sum + c.n),
    aggregate(filter(known.cells, c -> c.mask = next.bit), 0L, (sum, c) -> sum + c.n),
    aggregate(filter(known.cells, c -> c.mask & next.applied = 0 and c.mask & next.bit > 0), 0L, (sum, c) -> sum + c.good),
    aggregate(filter(known.cells, c -> c.mask & next.applied = 0 and c.mask & next.bit > 0), 0L, (sum, c) -> sum + c.toxic)
  from (
    select part, prefix, applied, step, unused.letter, unused.bit
    from steps lateral view explode(filter(LETTERS, l -> applied & l.bit = 0)) letters as unused
  ) next join {parts} known on next.part = known.part
)
select * from steps where step > 0
"""


@contextmanager
def unlimited(spark: SparkSession) -> Iterator[None]:
    """Recursion without Spark's limit on rows: the rows are bounded by the parts."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def steps(cells: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """The figures of each part and prefix of filters: what the last letter does after the ones before it."""
    spark = cells.sparkSession
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    parts = stored(parts, "cells")
    each = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << i})" for i, x in enumerate(letters))
    with unlimited(spark):
        return stored(spark.sql(STEPS.replace("LETTERS", f"array({each})"), parts=parts), "steps")


def audit(cells: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """One row per part, order of all letters and step.

    ``shapley`` of a filter sums what it removes over all orders: a prefix of k letters begins (n - k)! of them.
    """
    n = len(letters)
    found = steps(cells, letters).withColumn("letter", F.substring("prefix", -1, 1))
    rest = F.element_at(F.array(*[F.lit(math.factorial(n - k)) for k in range(1, n + 1)]), F.col("step"))
    shares = found.groupBy(F.col("part").alias("of_part"), F.col("letter").alias("of_letter")).agg(
        F.sum(F.col("removed") * rest).alias("shapley")
    )
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    longer = F.filter(orders, lambda order: order.startswith(F.col("prefix")))
    joined = found.join(shares, (F.col("part") == F.col("of_part")) & (F.col("letter") == F.col("of_letter")))
    return joined.select(
        "part",
        F.explode(longer).alias("filter_order"),
        "step",
        "kept",
        "removed",
        "redundant",
        "unique_fails",
        "good_lost",
        "toxic_lost",
        "shapley",
    )
