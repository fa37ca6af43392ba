"""Document fingerprints that can be subtracted: invertible Bloom lookup tables of paragraph digests.

A paragraph is a line, cut after each PIECE characters.  Its digest is added to
three cells of a table, one in each third; a cell holds a count, the sum (exclusive or) of
its digests and that of their check values.  Subtracting two documents' tables
cancels what they share.  Peeling then recovers the differing digests: a cell
with count 1 or -1 whose check value fits holds a single digest, which is taken
out of its other cells, and so on.  If something is left over, both tables are
made again LARGER times as large.

A table is an array of the cells that hold something, in order.  Adding,
subtracting and peeling append signed entries and merge those of one cell, so
that the work follows the number of digests, whatever the size of the table.  The
first table of a pair has room for all digests of both documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm._shared import partitions, stored
from waymark.llm.native import let

PIECE = 200
#: Cells in each third of a fingerprint and of the smallest table, rounds of peeling, how much larger the next try is, and tries.
THIRD, ROUNDS, LARGER, TRIES = 12, 60, 4, 12
CHECK_SEED = 77
CHECK_BITS = 0xFFFFFFFF


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs; blank lines and null have none."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^\\n]{{1,{PIECE}}}"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _check(k: Column) -> Column:
    return F.xxhash64(k, F.lit(CHECK_SEED)).bitwiseAND(F.lit(CHECK_BITS))


def _entry(k: Column, c: Column, h: Column, third: Column, level: int, i: int) -> Column:
    """What a digest k adds, c times, to its cell in third i of a table."""
    return F.struct((F.pmod(F.xxhash64(k, F.lit(3 * level + i)), third) + third * i).alias("at"), c.alias("c"), k.alias("k"), h.alias("h"))


def _merged(entries: Column) -> Column:
    """The cells that entries (at, c, k, h) add up to; what has become empty is left out."""

    def sums(sorted_: Column) -> Column:
        changes = F.filter(F.transform(sorted_, lambda x, i: F.when((i == 0) | (x["at"] != F.get(sorted_, i - 1)["at"]), i)), lambda i: i.isNotNull())

        def cell(starts: Column, s: Column, j: Column) -> Column:
            add = lambda x, y: F.struct(y["at"].alias("at"), (x["c"] + y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h"))
            end = F.coalesce(F.get(starts, j + 1), F.size(sorted_))
            # by place: a slice would copy the whole array first
            return F.when(end == s + 1, F.get(sorted_, s)).otherwise(F.aggregate(F.sequence(s + 1, end - 1), F.get(sorted_, s), lambda x, i: add(x, F.get(sorted_, i))))

        return let(changes, lambda starts: F.transform(starts, lambda s, j: cell(starts, s, j)))

    return F.filter(let(F.sort_array(entries), sums), lambda x: (x["c"] != 0) | (x["k"] != 0) | (x["h"] != 0))


def cells(keys: Column, third: Column, level: int = 0, sign: int = 1) -> Column:
    """The table (at, c, k, h) of a set of digests; with sign -1 as it is subtracted."""
    entries = F.flatten(F.transform(keys, lambda k: F.array(*(_entry(k, F.lit(sign), _check(k), third, level, i) for i in range(3)))))
    return _merged(entries)


def sketch(keys: Column) -> Column:
    """A document's fingerprint as text: the number of its digests and the cells of a table of 3 * THIRD."""
    row = lambda x: F.concat(F.lpad(F.hex(x["c"].cast("long").bitwiseAND(F.lit(0xFFFF))), 4, "0"), F.lpad(F.hex(x["k"]), 16, "0"), F.lpad(F.hex(x["h"]), 8, "0"))
    own = cells(keys, F.lit(THIRD).cast("long"))
    # cells in order, with zeros for the empty ones
    blank = "0" * 28
    wide = let(own, lambda a: let(F.transform(a, lambda x: x["at"]), lambda at: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(3 * THIRD - 1).cast("long")), lambda i: F.coalesce(row(F.get(a, F.array_position(at, i).cast("int") - 1)), F.lit(blank)))))
    return F.base64(F.unhex(F.concat(F.lpad(F.hex(F.size(keys).cast("long")), 8, "0"), F.array_join(wide, ""))))


def _peeled(diff: Column, third: Column, level: int) -> Column:
    """What peeling a difference of tables recovers: ok, how many digests are only left and only right."""

    def pure(table: Column) -> Column:
        alone = F.filter(table, lambda x: (F.abs(x["c"]) == 1) & (_check(x["k"]) == x["h"]))
        found = F.sort_array(F.transform(alone, lambda x: F.struct(x["k"].alias("k"), x["c"].alias("c"), x["h"].alias("h"))))
        return let(found, lambda a: F.filter(a, lambda x, i: (i == 0) | (x["k"] != F.get(a, i - 1)["k"])))

    def step(s: Column, _: Column) -> Column:
        def taken(found: Column) -> Column:
            out = F.flatten(F.transform(found, lambda p: F.array(*(_entry(p["k"], -p["c"], p["h"], third, level, i) for i in range(3)))))
            count = lambda sign: F.size(F.filter(found, lambda p: p["c"] == sign))
            return F.when(F.size(found) == 0, F.struct(s["cells"].alias("cells"), s["a"].alias("a"), s["b"].alias("b"), F.lit(True).alias("over"))).otherwise(F.struct(_merged(F.concat(s["cells"], out)).alias("cells"), (s["a"] + count(1)).alias("a"), (s["b"] + count(-1)).alias("b"), F.lit(False).alias("over")))

        return F.when(s["over"] | (F.size(s["cells"]) == 0), s).otherwise(let(pure(s["cells"]), taken))

    start = F.struct(diff.alias("cells"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(False).alias("over"))
    done = lambda s: F.struct((F.size(s["cells"]) == 0).alias("ok"), s["a"].alias("a"), s["b"].alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, done)


def difference(left: Column, right: Column, level: int) -> Column:
    """ok, and how many digests are only in the left or right set, by tables of the try `level`; not ok if the difference can't be peeled."""
    room = F.greatest(F.lit(THIRD), F.ceil((F.size(left) + F.size(right)) / 2)).cast("long") * LARGER**level
    return let(room, lambda third: _peeled(_merged(F.concat(cells(left, third, level), cells(right, third, level, -1))), third, level))


def likeness(n_left: Column, n_right: Column, d: Column) -> Column:
    """Share of all digests of two sets that both have; 1 for two empty sets."""
    common = n_left - d["a"]
    every = common + d["a"] + d["b"]
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def _by_peeling(a: Column, b: Column, level: int) -> Column:
    return let(difference(a, b, level), lambda d: F.when(d["ok"], likeness(F.size(a), F.size(b), d)))


def compare(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """df with a likeness column for each pair of columns of digests.

    Rows whose tables can't be peeled go on to larger ones until none is left; columns
    of df named like the new ones are replaced;
    should some remain after TRIES tries (digests that meet in all their cells
    at every size), their sets are compared as they are.  Null digests count as
    an empty set.
    """
    rows = df.drop(*pairs).select("*", *(F.lit(None).cast("double").alias(p) for p in pairs))
    open_ = lambda: reduce(lambda a, b: a | b, (F.col(p).isNull() for p in pairs))
    keys = lambda c: F.coalesce(F.col(c), F.expr("cast(array() as array<bigint>)"))
    done = []
    for level in range(TRIES):
        rows = stored(rows.withColumns({p: F.when(F.col(p).isNotNull(), F.col(p)).otherwise(_by_peeling(keys(a), keys(b), level)) for p, (a, b) in pairs.items()}), "peeled")
        done.append(rows.filter(~open_()))
        rows = rows.filter(open_())
        if rows.isEmpty():
            break
    else:
        exact = {}
        for p, (a, b) in pairs.items():
            d = F.struct(F.size(F.array_except(keys(a), keys(b))).alias("a"), F.size(F.array_except(keys(b), keys(a))).alias("b"))
            exact[p] = F.coalesce(F.col(p), likeness(F.size(keys(a)), F.size(keys(b)), d))
        done.append(rows.withColumns(exact))
    return reduce(DataFrame.unionByName, done)


def with_next(df: DataFrame, doc_id: str, columns: list[str], ranges: int | None = None) -> DataFrame:
    """doc_id, columns and, as next_..., the columns of the following row in descending order of doc_id; the first row follows the last.

    Rows are dealt to ranges of doc_id with about equal numbers of rows, found
    by a quantile sketch, and put in order in each; every range ends with a copy
    of the first row of the range that follows.  Equal ids are ordered by
    the columns, null ids come last.
    """
    # several ranges for each shuffle partition, as they are dealt to them by a hash
    n = ranges or 4 * partitions(df)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), *columns)
    cut = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n).alias("q")).first()["q"] or []
    bounds = sorted(set(cut))
    low_high = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        above = F.get(F.lit(bounds), mid) < F.col("doc_id")
        return F.when(s["low"] >= s["high"], s).when(above, F.struct((mid + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), mid.alias("high")))

    part = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length() + 1))), low_high, halve, lambda s: s["low"])) if bounds else F.lit(0)
    rows = rows.withColumn("part", part)
    # the first row of each range: one for each range at most
    heads = stored(rows.groupBy("part").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "heads")
    of_head = rows.join(heads.select("part", F.col("doc_id").alias("head_id")), "part").filter(F.col("doc_id").eqNullSafe(F.col("head_id")))
    first = of_head.groupBy("part").agg(F.max(F.struct(*columns)).alias("head"))
    # which range a head stands behind: slim rows, one for each range
    order = Window.orderBy(F.desc("part"))
    before = F.coalesce(F.lag("part").over(order), F.last("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    place = heads.select(F.col("part").alias("own"), before.alias("before"))
    ends = first.join(place, F.col("part") == F.col("own")).select(F.lit(None).cast("long").alias("doc_id"), *(F.col(f"head.{c}").alias(c) for c in columns), F.col("before").alias("part"))
    every = rows.withColumn("end", F.lit(False)).unionByName(ends.withColumn("end", F.lit(True)))
    within = Window.partitionBy("part").orderBy(F.asc("end"), F.col("doc_id").desc_nulls_last(), *(F.desc(c) for c in columns))
    return every.select("doc_id", *columns, *(F.lead(c).over(within).alias(f"next_{c}") for c in columns), "end").filter("not end").drop("end")


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of df: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of its characters (rounded down) replaced
    by as many first ones, or all, of the next document in descending order of
    doc_id.  Likeness is the share of paragraphs that both have.  Null texts
    count as empty; a text without paragraphs has an empty fingerprint, and two of
    those are alike (1).  Repeated rows stay, each with its own next row; a
    single row is its own next.  Other columns are not read; an empty table
    gives an empty result.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    pairs = with_next(rows.withColumn("keys", digests(F.col("text"))), "doc_id", ["text", "keys"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    made = pairs.select("doc_id", n.cast("long").alias("n_chars"), "keys", "next_keys", edited.alias("edited"))
    made = stored(made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "keys", digests(F.col("edited")).alias("edited_keys"), "next_keys"), "digests")
    out = compare(made, {"near_edited": ("keys", "edited_keys"), "near_next": ("keys", "next_keys")})
    return out.select("doc_id", "n_chars", "edited_sha256", sketch(F.col("keys")).alias("fingerprint"), sketch(F.col("edited_keys")).alias("edited_fingerprint"), "near_edited", "near_next")
