"""Mixing sources to target weights by Pareto order sampling.

A source's target words follow from its weight, up to a cap.  Each of its
documents is expected rate = target / size of source times.  The whole part of
that are certain copies.  For the rest p = rate - whole part, a document gets
the rank q = (u / (1 - u)) / (p / (1 - p)) from its own random number u, and
those of lowest rank are taken: a Pareto sample, of a size fixed by the words
that are still missing.  With `weight` the expectation also goes by document,
so that inclusion is unequal inside a source too.  A document that doesn't fit
into the words still missing is skipped, and those behind it in the order are
taken on; after the last one comes the first again, for one more copy each,
until no document fits.  The very last place goes to the one that brings the
source's words nearest to the target.

No source is sorted as a whole: words are summed by (source, slice of rank),
and only the documents in the one slice where the target is reached are put in
order.  A pass goes from there up to the first document that has to be skipped.
What is still missing is less than that document then, and is filled from lists of the
next LISTED documents of each size class (powers of two): documents are taken in order as
long as they fit, up to where a list that could still fit ends, and then the
next lists are made, or another pass.  What is kept by source is one row with the
bounds of its passes and the documents that filled it up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm._shared import named, quoted, stored, words

WEIGHTS = (5.0, 2.0, 1.0)
SLICES = 1 << 14
LISTED = 64
PLACE, LISTED_PLACE = "struct<rank: double, u: double>", "struct<rank: double, u: double, size: bigint, class: int, k: int>"
PASS = "struct<from: double, from_u: double, to: double, to_u: double, room: double>"

def uniform(seed: int, *columns: Column) -> Column:
    """A number inside (0, 1) that depends on nothing but the columns and the seed."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _measured(df: DataFrame, doc_id: str, text: str, source: str, seed: int, weight: str | None) -> DataFrame:
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    return df.withColumns({"__size": F.size(words(F.col(text))).cast("long"), "__u": uniform(seed, F.col(doc_id), F.col(text)), "__weight": w, "__source": F.col(source).cast("string")})


def _of_source(rows: DataFrame, state: DataFrame, how: str = "left") -> DataFrame:
    """rows with the columns that state has for their source."""
    state = state.withColumnRenamed("__source", "__s")
    return rows.join(state, F.col("__source").eqNullSafe(F.col("__s")), how).drop("__s")


def _targets(rows: DataFrame, weights, fraction: float, most: float) -> DataFrame:
    """A row for each source: its words, weighted words and target. The common level of target / weight is found among the sources in order of cap / weight."""
    by = rows.groupBy("__source").agg(F.sum("__size").alias("__source_size"), F.sum(F.col("__size") * F.col("__weight")).alias("__weighted"))
    by = by.withColumn("k", F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1)
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("k") % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("__source_size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("w"))
    order = Window.orderBy("full_at", "k")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by = by.withColumn("level", (F.sum("__source_size").over(every) * F.lit(fraction) - capped) / left)
    fits = F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "k", "level"))
    by = by.withColumn("level", F.coalesce(F.min(fits).over(every)["level"], F.lit(float("inf"))))
    return by.select("__source", "__source_size", "__weighted", F.least(F.col("cap"), F.col("w") * F.col("level")).alias("__target"))


def _ranked(rows: DataFrame, state: DataFrame, most: float) -> DataFrame:
    """rows with what is expected of each document: whole copies, and its place in the order of ranks, inside (0, 1) and increasing with q; over 1 where nothing is expected beyond whole copies."""
    rows = _of_source(rows, state)
    rate = F.when(F.col("__weighted") > 0, F.least(F.col("__target") * F.col("__weight") / F.col("__weighted"), F.lit(float(most)))).otherwise(F.lit(0.0))
    rows = rows.withColumn("__rate", rate).withColumn("__whole", F.floor("__rate"))
    p, u = F.col("__rate") - F.col("__whole"), F.col("__u")
    rank = F.when(p > 0, u * (F.lit(1.0) - p) / (u * (F.lit(1.0) - p) + (F.lit(1.0) - u) * p)).otherwise(1 + u)
    return rows.withColumn("__rank", F.when((F.col("__size") > 0) & (F.col("__weight") > 0), rank))


def _copies(most: int) -> Column:
    """How often a document is taken: its whole copies, one for each pass that took it and one for each time it filled up, up to most."""
    rank, u = F.col("__rank"), F.col("__u")

    def one(n: Column, x: Column) -> Column:
        beyond = (rank > x["from"]) | ((rank == x["from"]) & (u > x["from_u"]))
        upto = (rank < x["to"]) | ((rank == x["to"]) & (u <= x["to_u"]))
        return n + F.coalesce(beyond & upto & (F.col("__size") <= x["room"]) & (n < most), F.lit(False)).cast("long")

    taken = F.aggregate("__passes", F.col("__whole").cast("long"), one)
    return F.least(F.lit(most).cast("long"), taken + F.size(F.filter("__filled", lambda x: F.coalesce((rank == x["rank"]) & (u == x["u"]), F.lit(False)))))


def _beyond(slim: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """The documents of open sources that come next in order and would fit by themselves."""
    rank, u = F.col("__rank"), F.col("__u")
    rows = _ranked(slim, state.filter("not __done"), most).filter(((rank > F.col("__from")) | ((rank == F.col("__from")) & (u > F.col("__from_u")))) & (F.col("__size") <= F.col("__gap")))
    return rows.filter(_copies(most) < most)


def _pass(slim: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """state after one more pass of each source: from where the last one stopped, over the documents that fit one by one, as far as they fit together.

    The next pass begins behind the first document that doesn't fit; behind the
    last document the order begins anew, unless nothing has fitted since it last did: then the source is done.
    """
    by_source = Window.partitionBy("__source")
    rank = F.col("__rank")
    rows = _beyond(slim, state, most).withColumn("slice", F.floor(rank * SLICES))
    slices = rows.groupBy("__source", "slice").agg(F.sum("__size").alias("words"), F.first("__gap").alias("gap"))
    so_far = F.sum("words").over(by_source.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.withColumn("before", F.coalesce(so_far, F.lit(0))).filter("before <= gap")
    edge = stored(slices.groupBy("__source").agg(F.max(F.struct("slice", "before")).alias("at")).select("__source", F.col("at.slice").alias("at_slice"), "at.before"), "edge")
    # the documents of that one slice, in order
    near = _of_source(rows, edge, "inner").filter("slice = at_slice")
    near = near.withColumn("so_far", F.col("before") + F.sum("__size").over(by_source.orderBy("__rank", "__u")))
    fits = F.col("so_far") <= F.col("__gap")
    cut = near.groupBy("__source").agg(F.max(F.when(fits, F.struct("__rank", "__u", "so_far"))).alias("to"), F.min(F.when(~fits, F.struct("__rank", "__u"))).alias("over"))
    cut = _of_source(edge, cut).select("__source", "at_slice", "before", "to", "over")
    state = _of_source(state, cut)
    # nothing of the slice may fit, but all before it
    to = F.coalesce("to.__rank", F.col("at_slice") / F.lit(float(SLICES)))
    one = F.struct(F.col("__from").alias("from"), F.col("__from_u").alias("from_u"), to.alias("to"), F.coalesce("to.__u", F.lit(-1.0)).alias("to_u"), F.col("__gap").cast("double").alias("room"))
    some, taken = F.col("at_slice").isNotNull(), F.coalesce("to.so_far", "before", F.lit(0))
    new = {
        "__done": F.col("__done") | (~some & ((F.col("__from") < 0) | ~F.col("__took"))),
        "__took": some & (F.col("__took") | (taken > 0)),
        "__passes": F.when(taken > 0, F.array_append("__passes", one)).otherwise(F.col("__passes")),
        "__gap": F.col("__gap") - taken,
        "__from": F.coalesce("over.__rank", F.lit(-1.0)),
        "__from_u": F.coalesce("over.__u", F.lit(-1.0)),
    }
    return state.withColumns(new).drop("at_slice", "before", "to", "over")


def _fill(slim: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """state after documents have been taken one by one, in order, as long as they fit, up to the end of a list that could go on.

    Rows that repeat a document are taken together or not at all.
    """
    rank, u = F.col("__rank").alias("rank"), F.col("__u").alias("u")
    rows = _beyond(slim, state, most).groupBy("__source", rank, u, F.col("__size").alias("one")).agg(F.sum("__size").alias("size"))
    rows = rows.withColumn("class", F.length(F.bin("one")))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("__source", "class").orderBy("rank", "u"))).filter(F.col("k") <= LISTED)
    # at most LISTED documents for each power of two
    lists = rows.groupBy("__source").agg(F.array_sort(F.collect_list(F.struct("rank", "u", "size", "class", "k"))).alias("list"))
    state = _of_source(state, stored(lists, "lists"))
    start = F.struct(F.col("__gap").alias("gap"), F.expr(f"cast(array() as array<{PLACE}>)").alias("filled"), F.expr(f"cast(null as {PLACE})").alias("end"))

    def take(s: Column, x: Column) -> Column:
        place = F.struct(x["rank"].alias("rank"), x["u"].alias("u"))
        fits = x["size"] <= s["gap"]
        gap = F.when(fits, s["gap"] - x["size"]).otherwise(s["gap"])
        # the last of a full list, and more of its size could still fit
        over = (x["k"] == LISTED) & (F.pow(F.lit(2.0), x["class"] - 1) <= gap)
        return F.when(s["end"].isNotNull(), s).otherwise(F.struct(gap.alias("gap"), F.when(fits, F.array_append(s["filled"], place)).otherwise(s["filled"]).alias("filled"), F.when(over, place).alias("end")))

    state = state.withColumn("new", F.aggregate(F.coalesce("list", F.expr(f"cast(array() as array<{LISTED_PLACE}>)")), start, take))
    took = F.col("__took") | (F.size("new.filled") > 0)
    done = F.col("new.end").isNull() & ~took
    columns = {
        "__done": F.col("__done") | done,
        "__took": took & F.col("new.end").isNotNull(),
        "__filled": F.concat("__filled", "new.filled"),
        "__gap": F.col("new.gap"),
        "__from": F.coalesce("new.end.rank", F.lit(-1.0)),
        "__from_u": F.coalesce("new.end.u", F.lit(-1.0)),
    }
    return state.withColumns(columns).drop("list", "new")


def mixture(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, fraction: float = 1.0, most: int = 3, seed: int = 20, weight: str | None = None) -> DataFrame:
    """df with columns size, source_size, target and copies (how often the mix takes the row).

    size is the number of words.  Sources in code point order, null last, weigh
    weights, repeating; the targets share fraction x all words, none beyond
    most x its source's words, what is over going to the others by weight.
    copies never exceeds most.  Nothing but doc_id, text, source, weight and
    seed decides, so reruns agree.  Null and empty texts have size 0 and no
    copies; rows that repeat doc_id and text share their fate; an empty table
    gives an empty result.  Columns of df named like the new ones are replaced;
    names that begin with two underscores are the operator's own.
    """
    out = _mixed(df, doc_id, text, source, weights, fraction, most, seed, weight)
    return named(out, size="__size", source_size="__source_size", target="__target", copies="__copies")


def _mixed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, fraction: float = 1.0, most: int = 3, seed: int = 20, weight: str | None = None) -> DataFrame:
    full = _measured(df, doc_id, text, source, seed, weight)
    slim = stored(full.select("__source", "__size", "__u", "__weight"), "mix")
    targets = stored(_targets(slim, weights, fraction, most), "targets")
    certain = _ranked(slim, targets, most).groupBy("__source").agg(F.sum(F.col("__whole") * F.col("__size")).alias("__certain"))
    state = _of_source(targets, certain).withColumn("__gap", F.col("__target") - F.col("__certain")).drop("__certain")
    state = state.withColumns({"__passes": F.expr(f"cast(array() as array<{PASS}>)"), "__filled": F.expr(f"cast(array() as array<{PLACE}>)"), "__from": F.lit(-1.0), "__from_u": F.lit(-1.0), "__took": F.lit(False), "__done": F.lit(False)})
    state, whole = stored(state, "mixture"), True
    while not state.filter("not __done").isEmpty():
        if whole:
            state = stored(_pass(slim, state, most), "mixture")
        state = stored(_fill(slim, state, most), "mixture")
        whole = not state.filter("not __done and __from >= 0").isEmpty()
    # the last place
    off = F.abs(F.col("__size") - F.col("__gap"))
    rest = _ranked(slim, state, most).withColumn("copies", _copies(most)).filter(F.col("__rank").isNotNull() & (F.col("__size") < 2 * F.col("__gap")) & (F.col("copies") < most))
    rest = rest.groupBy("__source", "__rank", "__u", "__gap").agg(F.sum("__size").alias("__size"), F.min("copies").alias("copies")).filter(off < F.col("__gap"))
    last = rest.groupBy("__source").agg(F.min(F.struct(off.alias("off"), F.col("copies"), F.col("__rank").alias("rank"), F.col("__u").alias("u"))).alias("__next"))
    state = _of_source(state, last)
    state = stored(state.withColumn("__filled", F.when(F.col("__next").isNotNull(), F.array_append("__filled", F.struct("__next.rank", "__next.u"))).otherwise(F.col("__filled"))).drop("__next"), "mixture")
    out = _ranked(full, state, most)
    copies = F.when(F.col("__size") > 0, F.least(_copies(most), F.lit(most))).otherwise(0).cast("int")
    return out.select(*quoted(df.columns), "__size", "__source_size", "__target", copies.alias("__copies"))


def apply_mixture(df: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of df as often as mixture() takes it, with df's own columns, whatever their names.

    Null and empty texts have no words and are never taken; a very long text is
    taken where it fits; rows that repeat doc_id and text share their fate; an empty table gives an empty one.
    """
    out = _mixed(df, **options).filter("__copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*quoted(df.columns))
