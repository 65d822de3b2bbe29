"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

1. *Targets.* Each source has a weight; together the targets are `share` times all words. A
   target stops at `limit` times its source's size, and what is over is shared again by weight
   (water filling). The source table has a row for each source.
2. *What is taken.* A source with target T and size S gives every document floor(T / S) times
   (at most `limit` times), and the first documents in hash order once more until T is reached;
   the document on the boundary is cut there, so the taken words equal the rounded target.
3. *Curriculum.* A source's weight over training time t in [0, 1] is a piecewise linear schedule,
   given by knots. Its integral, scaled to T, is the source's cumulative demand D(t). The words
   of a source are laid end to end in hash order, pass after pass; the take that starts at
   cumulative word c is trained at t = D^-1(c): the segment whose integral brackets c, and the
   root of the quadratic inside it.
4. *Order.* Takes are sorted by position, by ranges.

Cumulative words are counted in two levels: (source, hash range) totals, summed over the ranges,
then a running sum inside one range only, so a source with a third of all rows is spread over
many tasks. Nothing depends on partitioning: reruns agree.

Edge cases: null or empty text has 0 words and is taken as 0 words at the position where it
falls; a null source is a source of its own, ordered last; a source without words has target 0;
an empty table gives an empty result; rows that repeat an id are separate documents; extra
columns are ignored by `plan` and kept by `mixed`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from settlekit.llm.common import hash_range, stable

#: Words, in the sense of all sizes here.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights by the order of the sources, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, LIMIT = 1.5, 2.0
#: Schedules by the order of the sources, repeating: (t, relative weight) knots over [0, 1].
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 0.25), (0.6, 1.0), (1.0, 2.0)),
)
#: Rows of one hash range of a source, as aimed at.
RANGE_ROWS = 4_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _cycle(index: Column, values: Sequence) -> Column:
    return F.element_at(F.array(*values), (index % len(values) + 1).cast("int"))


def targets(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
) -> DataFrame:
    """source, source_size, rank, target from (source, source_size); a row for each source.

    Water filling in closed form. A target is min(limit * S, x * w) for one level x. Sources sorted
    by the level limit * S / w at which they stop: if the first k are full, the rest share what
    remains, x_k = (total - sum of limit * S) / (sum of the other weights); the level is the
    first x_k that does not exceed the next source's own stop. With `share` <= `limit` one exists.
    """
    # Spark orders strings by their UTF-8 bytes, which is the order of code points
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn(
        "_w", _cycle(F.col("rank"), [F.lit(float(w)) for w in weights])
    )
    everything = Window.partitionBy()
    ranked = (
        ranked.withColumn("_cap", F.lit(limit) * F.col("source_size"))
        .withColumn("_stop", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.lit(share) * F.sum("source_size").over(everything))
    )
    by_stop = Window.orderBy("_stop", "rank")
    earlier = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) / F.sum("_w").over(onward)
    ranked = ranked.withColumn("_level", level)
    shared = F.when(F.col("_level") <= F.col("_stop"), F.struct("_stop", "rank", F.col("_level").alias("x")))
    x = F.min(shared).over(everything)["x"]
    return ranked.select(
        "source",
        "source_size",
        "rank",
        F.when(x.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), x * F.col("_w"))).alias("target"),
    )


def position(c: Column, target: Column, knots: Column) -> Column:
    """D^-1(c): the time at which a source's cumulative demand reaches `c` words.

    `knots` is an array of structs (t, w, area): area is the schedule's integral up to t.
    """
    total = F.element_at(knots, -1)["area"]
    need = F.least(c / target, F.lit(1.0)) * total
    # the last knot that is not beyond the need, but never the last of all
    left = F.element_at(
        F.filter(F.slice(knots, F.lit(1), F.size(knots) - 1), lambda k: k["area"] <= need), -1
    )
    at = F.array_position(F.transform(knots, lambda k: k["t"]), left["t"]).cast("int")
    right = F.element_at(knots, at + 1)
    slope = (right["w"] - left["w"]) / (right["t"] - left["t"])
    rest = need - left["area"]
    # w * x + slope * x^2 / 2 = rest, in the form that also holds for slope 0
    root = F.sqrt(F.greatest(left["w"] * left["w"] + 2 * slope * rest, F.lit(0.0)))
    step = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (left["w"] + root))
    return F.least(left["t"] + step, F.lit(1.0))


def _knots(schedules: Sequence[Sequence[tuple[float, float]]], rank: Column) -> Column:
    built = []
    for knots in schedules:
        if knots[0][0] != 0 or knots[-1][0] != 1 or any(w < 0 for _, w in knots):
            raise ValueError("a schedule runs from 0 to 1 with weights of at least 0")
        area, row = 0.0, []
        for i, (t, w) in enumerate(knots):
            if i:
                area += (t - knots[i - 1][0]) * (w + knots[i - 1][1]) / 2
            row.append(F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w"), F.lit(area).alias("area")))
        if area <= 0:
            raise ValueError("a schedule needs some weight")
        built.append(F.array(*row))
    return _cycle(rank, built)


def plan(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    share: float = SHARE,
    limit: float = LIMIT,
    keep: Sequence[str] = (),
) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken, and `takes`, an
    array of (position, words), one for each time the document is trained on (a last, partial
    take has fewer words than the document). `keep` names more columns to carry along."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"), *keep
    )
    totals = base.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")
    )
    sources = targets(totals.drop("_docs"), weights, share, limit).join(
        totals.select(F.col("source").alias("_s"), "_docs"), F.col("source").eqNullSafe(F.col("_s"))
    ).drop("_s")
    sources = (
        sources.withColumn("_ranges", F.greatest(F.lit(1), F.ceil(F.col("_docs") / RANGE_ROWS)).cast("int"))
        .withColumn("_goal", F.round("target").cast("long"))
        .withColumn(
            "_full",
            F.when(F.col("source_size") > 0, F.floor(F.col("_goal") / F.col("source_size"))).otherwise(0).cast("int"),
        )
        .withColumn("_rest", F.col("_goal") - F.col("_full") * F.col("source_size"))
        .select(F.col("source").alias("_source"), "source_size", "target", "rank", "_ranges", "_goal", "_full", "_rest")
    )
    # a row for each source on the right: a hot source is split by AQE, or all are broadcast
    hashed = base.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    hashed = hashed.withColumn("_hash", F.md5(stable(F.col("doc_id")))).withColumn(
        "_range", hash_range(F.col("_hash"), F.col("_ranges"))
    )
    sums = hashed.groupBy(F.col("rank").alias("_rank"), F.col("_range").alias("_r")).agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_rank").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("rank", "_range").orderBy("_hash", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    laid = (
        hashed.join(starts, (F.col("rank") == F.col("_rank")) & (F.col("_range") == F.col("_r")))
        .withColumn("_from", F.col("_start") + F.sum("size").over(inside) - F.col("size"))
        .withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_from"))))
        .withColumn("_knots", _knots(schedules, F.col("rank")))
    )
    times = F.col("_full") + F.when((F.col("_extra") > 0) | ((F.col("size") == 0) & (F.col("_from") < F.col("_rest"))), 1).otherwise(0)
    one = lambda i: F.struct(
        position(
            (i * F.col("source_size") + F.col("_from")).cast("double"), F.col("_goal").cast("double"), F.col("_knots")
        ).alias("position"),
        F.when(i < F.col("_full"), F.col("size")).otherwise(F.col("_extra")).alias("words"),
    )
    takes = F.when(times > 0, F.transform(F.sequence(F.lit(0), times - 1), one)).otherwise(
        F.array().cast("array<struct<position:double,words:bigint>>")
    )
    return laid.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("_full") * F.col("size") + F.col("_extra")).cast("long").alias("taken"),
        takes.alias("takes"), *keep,
    )


def in_order(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """`df` range-partitioned and sorted by position (nulls last), ties by the other columns."""
    order = [F.col(by[0]).asc_nulls_last(), *by[1:]]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def training_order(planned: DataFrame) -> DataFrame:
    """A row per take, in training order: doc_id, source, position, words, and what was kept."""
    rows = planned.select("*", F.explode("takes").alias("_take")).select(
        "*", F.col("_take.position").alias("position"), F.col("_take.words").alias("words")
    )
    return in_order(rows.drop("_take", "takes", "size", "source_size", "target", "taken"), ["position", "doc_id", "words"])


def first_words(text: Column, n: Column) -> Column:
    """The text up to and with the white space after its n-th word; the text's start as it is."""
    # cut before each word that follows white space; leading white space is a piece of its own
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    return F.array_join(F.slice(pieces, F.lit(1), (n + lead).cast("int")), "")


def mixed(docs: DataFrame, whole: bool = False, **options) -> DataFrame:
    """The mixture as documents, in training order: all columns of `docs`, a row per take; a
    partial take holds the first words of its text, and n_chars (if there) counts its text. With
    `whole` no text is cut: a partial take is the whole document if it has at least half of its
    words, and no take otherwise, so a source's words are within half a document of its target."""
    columns = docs.columns
    kept = docs.select(
        "doc_id", "source", "text",
        *[F.col(c).alias(f"_c_{c}") for c in columns if c not in ("source", "text")],
    )
    carried = [c for c in kept.columns if c.startswith("_c_")]
    planned = plan(kept, keep=["text", *carried], **options)
    cut = F.col("words") < words(F.col("text"))
    rows = planned.select("*", F.explode("takes").alias("_take")).select(
        "*", F.col("_take.position").alias("_position"), F.col("_take.words").alias("words")
    )
    if whole:
        rows = rows.filter(F.col("words") * 2 >= words(F.col("text")))
        return in_order(rows, ["_position", "doc_id", "words"]).select(
            [F.col(c if c in ("source", "text") else f"_c_{c}").alias(c) for c in columns]
        )
    rows = rows.withColumn("text", F.when(cut, first_words(F.col("text"), F.col("words"))).otherwise(F.col("text")))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("_c_n_chars", F.when(cut, F.length("text").cast(kind)).otherwise(F.col("_c_n_chars")))
    ordered = in_order(rows, ["_position", "doc_id", "words"])
    return ordered.select([F.col(c if c in ("source", "text") else f"_c_{c}").alias(c) for c in columns])
