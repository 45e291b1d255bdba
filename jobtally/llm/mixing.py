"""Mixing sources to target weights: how often each document is taken so that sources come near their targets.

Words are summed per source, targets follow from the sources' weights, and a document is taken floor(rate) times, once
more if a draw from a hash of its id falls below the fraction of the rate. A rate is the target over the size of the
source. A few seeds are tried in one pass, and each source uses the one whose words come nearest to its target: a few
long documents then do not carry a source away, and every copy is still drawn by itself with that probability.

Odd input: a null text or one without words has size 0; it is taken as often as others, which adds no words. A source
of size 0 has the target 0 and the rate 0. A null source is a source of its own, after all others. Draws follow from
the id alone, so rows that repeat an id are taken alike; rows without an id draw by their text. An empty table gives an
empty result. ``mix`` keeps all columns of the caller, whatever their names: they travel in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from jobtally.llm.tables import materialise

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3  # times a document, and a source's size, at most
WEIGHTS = (1, 2, 3)
SEEDS = 16  # tried for each source
_BITS = 48


def _draw(seed: Column) -> Column:
    """A number from 0 up to 1, the same in every run: the first 48 bits of an MD5 of seed and key."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), seed, F.lit(":"), F.col("key")).cast("binary")), 1, _BITS // 4), 16, 10)
    return bits.cast("double") / F.lit(float(1 << _BITS))


def _measured(docs: DataFrame, *kept: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    text = F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return docs.select(*kept, F.col("source"), size.alias("size"), F.coalesce(F.col("doc_id").cast("string"), text).alias("key"))


def with_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add ``weight`` to rows of (source, size): the given weights in turn, by code point of the source, null last.

    Rows are numbered within ranges of sources; one row per range carries the count of those before it.
    """
    order = F.col("source").asc_nulls_last()
    ranges = sources.repartitionByRange(order).withColumn("part", F.spark_partition_id())
    ranges = materialise(ranges, "mix-sources")  # bounds of ranges are sampled: keep those that were drawn
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    turn = F.array(*[F.lit(w).cast("long") for w in weights])
    return (
        ranges.withColumn("place", place)
        .join(offsets, "part")
        .select("source", "size", F.get(turn, F.pmod(F.col("offset") + F.col("place"), F.lit(len(weights))).cast("int")).alias("weight"))
    )


def with_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Add ``target`` to rows of (source, size, weight): a share of all sizes by weight, at most ``most`` times the size.

    What the bound cuts off is shared again by weight among the others, until none is above. Each round is one
    aggregate; bounds are compared as whole numbers, so that the outcome depends on no order of sums.
    """
    whole = lambda value: value.cast("decimal(38,0)")
    bound = F.col("size") * most
    first = sources.agg(F.sum("size"), F.sum("weight")).first()
    total = left = first[0] or 0
    weight = first[1] or 1
    while True:
        capped = whole(bound) * whole(F.lit(weight)) < whole(F.lit(left)) * whole(F.col("weight"))
        cut, open_weight = sources.agg(F.sum(F.when(capped, bound)), F.sum(F.when(~capped, F.col("weight")))).first()
        if (total - (cut or 0), open_weight or 1) == (left, weight):
            break
        left, weight = total - (cut or 0), open_weight or 1
    share = F.col("weight").cast("double") * F.lit(float(left)) / F.lit(float(weight))
    return sources.withColumn("target", F.when(capped, bound.cast("double")).otherwise(share))


def _at_rates(measured: DataFrame, sources: DataFrame) -> DataFrame:
    """Measured rows beside the facts of their source. The planner broadcasts the sources if they are few, else it splits
    the skewed ones."""
    facts = sources.withColumnsRenamed({"source": "its_source", "size": "source_size"})
    return measured.join(facts, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")


def _with_seeds(measured: DataFrame, sources: DataFrame, seeds: int) -> DataFrame:
    """Add to each source the ``seed`` whose extra copies bring it nearest to its target, the first of equal ones."""
    share = F.col("rate") - F.floor("rate")
    extra = [F.sum(F.when(_draw(F.lit(i)) < share, F.col("size")).otherwise(0)) for i in range(seeds)]
    tried = _at_rates(measured, sources).groupBy("source", "source_size", "rate", "target").agg(F.array(*extra).alias("extra"))
    missed = F.abs((F.floor("rate") * F.col("source_size") + F.col("extra")[F.col("seed")]).cast("double") - F.col("target"))
    each = tried.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    best = each.groupBy(F.col("source").alias("tried")).agg(F.min(F.struct(missed.alias("missed"), "seed")).alias("best"))
    return sources.join(best, F.col("source").eqNullSafe(F.col("tried"))).select(*sources.columns, F.col("best.seed").alias("seed"))


def _rated(measured: DataFrame, thin: DataFrame, weights: tuple[int, ...], most: int, seeds: int) -> DataFrame:
    """Add the source's size and target, and the number of ``copies``, to measured rows; ``thin`` has the same rows."""
    sizes = thin.groupBy("source").agg(F.sum("size").alias("size"))
    sources = with_targets(materialise(with_weights(sizes, weights), "mix-weights"), most)
    sources = sources.withColumn("rate", F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(F.lit(0.0)))
    sources = materialise(_with_seeds(thin, sources, seeds), "mix-sources")
    extra = (_draw(F.col("seed")) < F.col("rate") - F.floor("rate")).cast("long")
    return _at_rates(measured, sources).withColumn("copies", F.floor("rate") + extra)


def _thin(docs: DataFrame) -> DataFrame:
    return materialise(_measured(docs, F.col("doc_id")), "mix-sizes")


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seeds: int = SEEDS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, weight, target, rate and the number of ``copies`` in the mix."""
    thin = _thin(docs)
    return _rated(thin, thin, weights, most, seeds).select(
        "doc_id", "source", "size", "source_size", "weight", "target", "rate", "copies"
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seeds: int = SEEDS) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row")
    taken = _rated(_measured(docs, row), _thin(docs), weights, most, seeds).where("copies > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
