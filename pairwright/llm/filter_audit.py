"""What filters remove, in every order they can be applied.

Each document becomes a mask of the filters it fails; documents of one part with
the same mask and labels are one cell.  A cell folds across the broadcast array
of all orders: ``aggregate`` walks an order with the mask and gives a struct of
counts for each step, ``transform`` does so for all orders, so a cell yields
(orders x steps) structs weighted by its documents.  The cells of a part -- at
most one for each mask -- are merged by elementwise sums (``zip_with``) and
unfolded into rows.  No document meets an order, and a part is one row until the
end, however many documents it has.

The five filters of :func:`failures` look at the text alone but for the last,
which asks for an identical text under a smaller id anywhere in the table.
Texts are told apart by their SHA-256; a text's smallest id is a partial
minimum, and documents are counted by (text, part, labels) before they meet it.

Null texts are empty; a null part is the empty string.  A null id is neither
smaller nor larger than another, so its text is never a copy and makes none.
Repeated rows count one by one; rows with the same id and text are no copies of
each other.  Labels of one id are taken together (1 if any is).  Documents
without a label are neither good nor toxic.  An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column) -> Column:
    """Bits 0-3: under 200 words; under half of the words distinct; over 2 % capitals; special characters."""
    words = F.array_remove(F.split(text, SPACE), "")

    def bits(w: Column) -> Column:
        few = F.size(w) < 200
        alike = 100 * F.size(F.array_distinct(w)) < 50 * F.size(w)
        loud = 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text)
        odd = text.rlike("[#$%&*|]")
        return reduce(lambda a, b: a + b, [F.when(x, 1 << i).otherwise(0) for i, x in enumerate((few, alike, loud, odd))])

    # a one-element transform holds the words while both filters count them
    return F.element_at(F.transform(F.array(words), bits), 1)


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of filters that they fail."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("_text"), failures(text).alias("_mask"))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    rows = rows.join(marks, "_id", "left").select(
        "_id", "_text", "part", "_mask", F.coalesce("_good", F.lit(0)).alias("_good"), F.coalesce("_toxic", F.lit(0)).alias("_toxic"))
    # by id, then without it: of each text and kind of document, how many there are and how many have the smallest id
    kind = ["_text", "part", "_mask", "_good", "_toxic"]
    by_id = rows.groupBy("_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("_id").isNotNull()
    kinds = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("_free"),
                                     F.min(F.when(known, F.struct("_id", "n"))).alias("_first"))
    least = kinds.groupBy("_text").agg(F.min("_first._id").alias("_least"))
    met = kinds.join(least, "_text")
    single = F.col("_free") + F.when(F.col("_first._id") == F.col("_least"), F.col("_first.n")).otherwise(0)
    both = F.array(F.struct(F.col("_mask").alias("mask"), single.alias("n")),
                   F.struct((F.col("_mask") + 16).alias("mask"), (F.col("n") - single).alias("n")))
    out = met.select("part", "_good", "_toxic", F.inline(both)).filter("n > 0")
    return out.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_good")).alias("good"),
                                           F.sum(F.col("n") * F.col("_toxic")).alias("toxic"))


def _orders() -> Column:
    """All orders as arrays of filter numbers, one literal that travels with the plan."""
    return F.array(*[F.array(*[F.lit(i) for i in order]) for order in permutations(range(len(LETTERS)))])


def _walk(order: Column, cell: Column) -> Column:
    """One struct for each step of an order: the cell's documents kept, removed, ... there."""
    zero = F.lit(0).cast("bigint")
    state = F.struct(F.lit(False).alias("gone"), F.array().cast(_STEPS).alias("steps"))

    def step(s: Column, f: Column) -> Column:
        fails = F.getbit(cell["mask"], f) == 1
        here, gone = fails & ~s["gone"], s["gone"] | fails
        alone = F.bit_count(cell["mask"]) == 1

        def weigh(condition: Column, of: str = "n") -> Column:
            return F.when(condition, cell[of]).otherwise(zero)

        counts = F.struct(f.alias("filter"), weigh(~gone).alias("kept"), weigh(here).alias("removed"),
                          weigh(fails & s["gone"]).alias("redundant"), weigh(fails & alone).alias("unique_fails"),
                          weigh(here, "good").alias("good_lost"), weigh(here, "toxic").alias("toxic_lost"))
        return F.struct(gone.alias("gone"), F.concat(s["steps"], F.array(counts)).alias("steps"))

    return F.aggregate(order, state, step, lambda s: s["steps"])


_STEPS = "array<struct<filter:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"


def _merged(a: Column, b: Column) -> Column:
    """Elementwise sum of two arrays of structs of the same steps."""
    return F.zip_with(a, b, lambda x, y: F.struct(x["filter"].alias("filter"), *[(x[c] + y[c]).alias(c) for c in COUNTS]))


def interactions(cells: DataFrame) -> DataFrame:
    """part, filter_order, step, counts and Shapley sums from the cells of :func:`cells`."""
    orders = _orders()
    steps = F.flatten(F.transform(orders, lambda o: _walk(o, F.struct("mask", "n", "good", "toxic"))))
    # one array of structs a cell, at most 32 cells a part
    folded = cells.select("part", steps.alias("steps")).groupBy("part").agg(F.collect_list("steps").alias("cells"))
    total = F.aggregate(F.slice(F.col("cells"), 2, F.size("cells")), F.element_at("cells", 1), _merged)
    folded = folded.select("part", total.alias("steps"))
    shapley = F.transform(F.sequence(F.lit(0), F.lit(len(LETTERS) - 1)), lambda f: F.aggregate(
        F.col("steps"), F.lit(0).cast("bigint"), lambda n, s: n + F.when(s["filter"] == f, s["removed"]).otherwise(0)))
    rows = folded.select("part", "steps", shapley.alias("sums")).select("part", "sums", F.posexplode("steps").alias("at", "s"))
    names = F.array(*[F.lit("".join(o)) for o in permutations(LETTERS)])
    each = len(LETTERS)
    return rows.select("part", F.element_at(names, (F.col("at") / each).cast("int") + 1).alias("filter_order"),
                       (F.col("at") % each + 1).cast("int").alias("step"), *[F.col(f"s.{c}") for c in COUNTS],
                       F.element_at("sums", F.col("s.filter") + 1).alias("shapley"))
