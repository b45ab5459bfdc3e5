"""Mixing sources to target weights: Efraimidis-Spirakis sampling within sources, complete epochs first.

Every document gets an exponential key -ln(u) / quality, u being a uniform number drawn from a hash of its id; the
documents of a source with the smallest keys are a weighted sample without replacement. A source's budget of words is
met by complete epochs and then by the documents in order of their keys, until the prefix sum of their sizes reaches
what is left. Only DataFrame operations run, and no source is gathered in one task: a source's keys fall into cells of equal
width, the cells' sums show in which one a budget ends, and that cell is parted again until it has few rows (whatever
the qualities, as its width shrinks a thousandfold a round), or rows of one key alone; only these are ordered. A source's
budget comes down to the key of the last document taken; these keys are broadcast to the documents if their table,
counted, is small, else joined.

Defined cases. Null text: size 0. Null source: a source of its own, last in order. Null or negative quality: 1 and a
tiny positive number. Very long texts: one document each, counted whole. Repeated rows: each counts; equal keys are ordered
by doc_id and size, and of rows alike in these as many are taken as the budget has room for. An empty table gives an empty
table. Columns that the operator adds replace the input's of the same name (size, source_size, target, epochs, taken); all
other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_enough, unused, word_count

#: Weights of sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix, as a share of all words.
SHARE = 1.5
#: A source is repeated so often at most.
MOST_EPOCHS = 2
#: Rows of a source that are ordered, at most, but for rows of one key.
BUCKET_ROWS = 4096
#: Cells into which a range of keys is parted.
CELLS = 1024


def uniform(*of: Column) -> Column:
    """In (0, 1), from a hash."""
    return ((F.xxhash64(*of).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))).cast("double")


def before(rows: DataFrame, order: Column, sums: dict[str, Column]) -> DataFrame:
    """Adds the sums over all rows that sort before one. Ranges of rows are summed apart, their totals, a row each, together."""
    ranged = cut(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_c_{k}") for k in sums])
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumns({k: F.coalesce(F.sum(c).over(within), F.lit(0)) for k, c in sums.items()})
    joined = summed.join(F.broadcast(carried), "_part")  # as many rows as there are partitions
    return joined.withColumns({k: F.col(k) + F.col(f"_c_{k}") for k in sums}).drop("_part", *[f"_c_{k}" for k in sums])


def source_targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS) -> DataFrame:
    """sources(source, source_size, n_docs): adds weight, target double.

    A target is weight * level, at most `most` times the source's size. In order of bound / weight, the level at which the
    sources before one have reached their bounds and the rest share what is left rises up to the right one and falls
    beyond it, so that the right one is the largest.
    """
    placed = before(sources, F.col("source").asc_nulls_last(), {"_place": F.lit(1)})
    of_place = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    bound = F.lit(float(most)) * F.col("source_size")
    placed = cut(placed.withColumn("weight", of_place).drop("_place"))
    total, all_weights = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("weight")).first()
    ratio = F.col("source_size") / F.col("weight")
    ordered = before(placed.select("source_size", "weight"), ratio, {"_spent": bound, "_gone": F.col("weight")})
    rest = F.greatest(F.lit(all_weights or 0.0) - F.col("_gone"), F.col("weight"))
    level = ordered.agg(F.max((F.lit(float(share * total)) - F.col("_spent")) / rest)).first()[0] or 0.0
    return placed.withColumn("target", F.least(bound, F.col("weight") * F.lit(float(level))))


def mix_sources(
    docs: DataFrame, *, quality: Column | None = None, size: Column | None = None, weights=WEIGHTS, share=SHARE,
    most=MOST_EPOCHS, bucket_rows=BUCKET_ROWS, carry: bool = True,
) -> DataFrame:
    """docs(doc_id, source, text, ...): adds size, source_size, target, epochs and taken (words taken in all).

    carry=False keeps doc_id and source alone of the input's columns. A document is taken once more if at least half of
    it lies within what the source's budget leaves after its complete epochs, so the source misses its target by half a
    document at most.
    """
    added = ["size", "source_size", "target", "epochs", "taken"]
    words = word_count(F.col("text")) if size is None else size
    docs = docs.withColumn(f"{(p := unused(docs.columns, "_mix"))}_size", words.cast("long"))
    quality = F.lit(1.0) if quality is None else F.greatest(F.coalesce(quality.cast("double"), F.lit(1.0)), F.lit(1e-9))
    drawn = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("source", F.lit("")))
    key, src, null, words_, state = (f"{p}_{x}" for x in ("key", "src", "null", "size", "state"))
    sized = docs.withColumn(key, -F.log(drawn) / quality).withColumn(null, F.col("source").isNull()).withColumn(src, F.coalesce("source", F.lit("")))
    columns = [c for c in docs.columns if c.lower() not in added and c != words_]
    by = [src, null]
    slim = cut(sized.select(F.col("doc_id"), F.col("source"), *by, words_, key))
    sources = slim.groupBy(*by).agg(F.first("source").alias("source"), F.sum(words_).alias("source_size"), F.count("*").alias("n_docs"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = cut(
        source_targets(sources, weights, share, most).withColumn("epochs", whole)
        .withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
        .select(*by, F.struct("source_size", "target", "epochs", "left").alias(state))
    )
    small = small_enough(targets, 512)  # then no document moves
    look_up = (lambda rows, table: rows.join(F.broadcast(table), by)) if small else (lambda rows, table: rows.join(table, by))
    left = F.col(f"{state}.left")

    # the range of keys in which each budget ends, and the words before it
    ends = cut(look_up(slim, targets).groupBy(*by).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.lit(0).cast("long").alias("below"), F.count("*").alias("n")))
    wide = (F.col("n") > bucket_rows) & (F.col("lo") < F.col("hi"))
    while ends.where(wide).limit(1).count():
        inside = look_up(slim, ends.where(wide)).where(F.col(key).between(F.col("lo"), F.col("hi")))
        cell = F.least(F.floor((F.col(key) - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS), F.lit(CELLS - 1))
        cells = inside.groupBy(*by, cell.alias("cell")).agg(
            F.first("below").alias("below"), F.sum(words_).alias("words"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n")
        )
        earlier = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # CELLS rows a source at most
        cells = cells.withColumn("below", F.col("below") + F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        reached = look_up(cells, targets).where((F.col("below") < left) | (F.col("cell") == 0))
        last = reached.groupBy(*by).agg(F.max(F.struct("cell", "lo", "hi", "below", "n")).alias("x"))
        ends = cut(last.select(*by, "x.lo", "x.hi", "x.below", "x.n").unionByName(ends.where(~wide)))
    # the only rows that must be ordered; those alike in key, id and size are one
    of = ["doc_id", words_]
    final = look_up(look_up(slim, ends).where(F.col(key).between(F.col("lo"), F.col("hi"))), targets)
    alike = final.groupBy(*by, key, *of).agg(F.count("*").alias("n"), F.first("below").alias("below"), F.first(left).alias("left"))
    order = Window.partitionBy(*by).orderBy(key, *of).rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("left") - F.col("below") - F.coalesce(F.sum(F.col(words_) * F.col("n")).over(order), F.lit(0))
    fit = F.when(F.col(words_) > 0, F.floor(room / F.greatest(F.col(words_), F.lit(1)) + 0.5)).otherwise(F.when(room >= 0, F.col("n")).otherwise(0))
    alike = alike.withColumn("fit", F.least(F.greatest(fit.cast("long"), F.lit(0)), F.col("n"))).where("fit > 0")
    bars = alike.groupBy(*by).agg(F.max(F.struct(key, *of, "fit", "n")).alias("bar"))
    known = cut(targets.join(ends, by, "left").join(bars, by, "left").select(*by, F.struct(f"{state}.*", "lo", "bar").alias(state)))

    rows = look_up(sized if carry else slim, known)
    bar = F.col(f"{state}.bar")
    place, end = F.struct(key, *of), F.struct(bar[key].alias(key), *[bar[c].alias(c) for c in of])
    some = bar.isNotNull() & (place.eqNullSafe(end)) & (bar["fit"] < bar["n"])
    once_more = (left > 0) & ((F.col(key) < F.col(f"{state}.lo")) | F.coalesce(place <= end, F.lit(False)))
    rows = rows.withColumn(f"{p}_more", F.coalesce(once_more, F.lit(False)))
    if known.where(bar["fit"] < bar["n"]).limit(1).count():  # of rows alike some are taken
        tied = cut(rows.where(some).withColumn(f"{p}_id", F.monotonically_increasing_id()))
        part = F.shiftright(F.col(f"{p}_id"), 33)
        counts = tied.groupBy(*by, part.alias(f"{p}_part")).agg(F.count("*").alias(f"{p}_n"))
        earlier = Window.partitionBy(*by).orderBy(f"{p}_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
        counts = counts.withColumn(f"{p}_n", F.coalesce(F.sum(f"{p}_n").over(earlier), F.lit(0)))
        within = F.row_number().over(Window.partitionBy(*by, f"{p}_part").orderBy(f"{p}_id"))
        numbered = tied.withColumn(f"{p}_part", part).withColumn(f"{p}_row", within).join(counts, [*by, f"{p}_part"])
        chosen = numbered.withColumn(f"{p}_more", F.col(f"{p}_row") + F.col(f"{p}_n") <= bar["fit"])
        rows = rows.where(~some).unionByName(chosen.select(rows.columns))
    taken = (F.col(f"{state}.epochs") + F.col(f"{p}_more").cast("long")) * F.col(words_)
    return rows.select(
        *(columns if carry else ["doc_id", "source"]), F.col(words_).alias("size"), f"{state}.source_size", f"{state}.target", f"{state}.epochs", taken.alias("taken")
    )


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: a row for each time that a document is taken."""
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.col("epochs")).cast("int")
    copies = F.when(times > 0, F.sequence(F.lit(1), F.greatest(times, F.lit(1))))
    return mixed.withColumn(f"{unused(mixed.columns, "_mix")}_copy", F.explode(copies)).select(*columns)
