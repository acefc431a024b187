"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame operations only.

Each document of a source is to be taken ``target / source size`` times. The whole part is certain; the fractions are
rounded together: two fractional documents meet and one passes mass, measured in words, to the other until one of them is
integral. Which way the mass goes is drawn so that every document keeps its expected copies, and the words of the
pair stay the same. First each large document of a source meets the pool of all smaller ones, the largest first, which
leaves no large residual. The others meet in nodes of a reduction tree: a node folds a bounded number of documents and
passes at most one residual to the next level. So a source of any size takes a few levels, and its total ends
within the size of one small document of its target.

Rows alike in doc_id, source and size are interchangeable, and form a unit. A small one takes the whole part of its rows times
their fraction for certain, and one row's rest goes into the tree; rows of a large one are rounded one by one. Which of
a unit's rows the copies go to is settled by their numbers in the parts of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisift.llm.words import word_count
from evisift.session import pin

WEIGHTS = (3, 1, 2)
TOTAL_PERCENT = 150
MAX_COPIES = 2
# Documents that one node folds on average; nodes are filled by a hash, so none is much fuller.
FAN_IN = 32
# A document is large if it has more than this part of its source's words; a source has at most as many.
LARGE_PARTS = 400
_EDGE = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target, rows`` from a table of ``source, size`` rows, nulls as a last source.

    Weights repeat over the sources by code point. The targets share ``TOTAL_PERCENT`` of all sizes by weight; one above
    ``MAX_COPIES`` times its source's size stops there and the rest is shared again. In order of cap over weight, the
    capped sources are a prefix: a source is capped while the level reached without it would exceed its cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    # one row per source from here on
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * MAX_COPIES
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("_turn", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * (TOTAL_PERCENT / 100) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    levelled = per.withColumns({"_weight": weight, "_cap": cap}).withColumn("_turn", F.col("_cap") / F.col("_weight")).withColumn("_level", level)
    capped = F.col("_turn") <= F.col("_level")
    # levels fall from the first source that is not capped on
    share = F.max(F.when(~capped, F.col("_level"))).over(everything)
    return levelled.select(
        "source", "source_size", F.when(capped, F.col("_cap")).otherwise(F.col("_weight") * share).alias("target"), "rows"
    )


def _uniform(*by: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*by), 11).cast("double") + 0.5) / 2.0**53


def _fold(members: Column, seed: int) -> Column:
    """Fold an array of (id, size, at, mass) into (rest, done): ``mass`` words of a document are still to be taken, between
    0 and its size. Done documents carry 0 or 1 as ``take``."""
    done = "array<struct<id:string,take:int>>"
    empty = F.struct(F.lit(None).cast("string").alias("id"), F.lit(0.0).alias("size"), F.lit(0.0).alias("mass"))
    start = F.struct(empty.alias("rest"), F.array().cast(done).alias("done"))

    def settled(id_: Column, full: Column) -> Column:
        return F.array(F.struct(id_.alias("id"), full.cast("int").alias("take"))).cast(done)

    def step(state: Column, now: Column) -> Column:
        a = state["rest"]
        give, get = F.least(a["mass"], now["size"] - now["mass"]), F.least(now["mass"], a["size"] - a["mass"])
        # a gives with the chance that keeps its expected mass
        moved = F.when(_uniform(a["id"], now["id"], F.lit(seed)) * (give + get) < get, -give).otherwise(get)
        am, bm = a["mass"] + moved, now["mass"] - moved
        a_full, b_full = am >= a["size"] * (1 - _EDGE), bm >= now["size"] * (1 - _EDGE)
        a_done = a_full | (am <= a["size"] * _EDGE)
        rest = F.when(a_done, F.struct(now["id"].alias("id"), now["size"].alias("size"), bm.alias("mass"))).otherwise(
            F.struct(a["id"].alias("id"), a["size"].alias("size"), am.alias("mass"))
        )
        out = F.concat(state["done"], F.when(a_done, settled(a["id"], a_full)).otherwise(settled(now["id"], b_full)))
        first = F.struct(
            F.struct(now["id"].alias("id"), now["size"].alias("size"), now["mass"].alias("mass")).alias("rest"), state["done"].alias("done")
        )
        return F.when(a["id"].isNull(), first).otherwise(F.struct(rest.alias("rest"), out.alias("done")))

    return F.aggregate(members, start, step)


def settle_large(units: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """``(id, take`` of the large documents, units still fractional with the rows ``sure`` to be taken``)``.

    All fractional units of a group have one fraction, mass over words of the pool; a unit has ``n`` rows of one size, a large one a
    single row. A large document is taken with that
    chance and its words leave the pool, so the pool's new fraction has the old one as its expectation. Where the pool
    couldn't make up for either outcome, the document stays in it.
    """
    is_large = F.col("size") * LARGE_PARTS > F.col("total")
    large = units.filter(is_large).groupBy("grp").agg(
        F.any_value("rows").alias("rows"), F.any_value("total").alias("total"), F.any_value("fraction").alias("fraction"),
        F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("by"), F.xxhash64("id").alias("at"), "id", "size"))).alias("docs"),
    )
    done, left = "array<struct<id:string,take:int>>", "array<struct<id:string,size:double>>"
    start = F.struct(
        (F.col("fraction") * F.col("total")).alias("mass"), F.col("total").alias("words"),
        F.array().cast(done).alias("done"), F.array().cast(left).alias("left"),
    )

    def step(state: Column, now: Column) -> Column:
        mass, words, size = state["mass"], state["words"], now["size"]
        free = (mass >= size) & (mass <= words - size) & (words > size)
        take = _uniform(now["id"], F.lit(seed)) * words < mass
        new = F.array(F.struct(now["id"].alias("id"), take.cast("int").alias("take"))).cast(done)
        stays = F.array(F.struct(now["id"].alias("id"), size.alias("size"))).cast(left)
        return F.struct(
            F.when(free & take, mass - size).otherwise(mass).alias("mass"), F.when(free, words - size).otherwise(words).alias("words"),
            F.when(free, F.concat(state["done"], new)).otherwise(state["done"]).alias("done"),
            F.when(free, state["left"]).otherwise(F.concat(state["left"], stays)).alias("left"),
        )

    folded = pin(large.select("grp", "rows", F.aggregate("docs", start, step).alias("f")), "pivotal-large")
    pool = folded.select(F.col("grp").alias("_grp"), (F.col("f.mass") / F.col("f.words")).alias("_fraction"))
    extra = F.col("n") * F.coalesce("_fraction", "fraction")
    small = units.filter(~is_large).join(pool, F.col("grp") == F.col("_grp"), "left").withColumn("sure", F.floor(extra + _EDGE).cast("long")).select(
        "grp", "id", "size", (F.greatest(extra - F.col("sure"), F.lit(0.0)) * F.col("size")).alias("mass"), "rows", "sure"
    )
    stayed = folded.select("grp", "rows", (F.col("f.mass") / F.col("f.words")).alias("_fraction"), F.explode("f.left").alias("d")).select(
        "grp", "d.id", "d.size", (F.col("_fraction") * F.col("d.size")).alias("mass"), "rows", F.lit(0).cast("long").alias("sure")
    )
    return folded.select(F.explode("f.done").alias("d")).select("d.id", "d.take"), small.unionByName(stayed)


def round_fractions(units: DataFrame, seed: int) -> DataFrame:
    """``id, take`` (0 or 1) for every row of ``units``: ``grp, id, size, mass, rows``, ``rows`` being those of its group.

    ``id`` is unique. The loop runs once per level of the tree, for the deepest group: its length is the logarithm of the
    group's rows to the base ``FAN_IN``.
    """
    settled, level = [], 0
    while True:
        most = units.agg(F.max("rows")).first()[0]
        if not most:
            break
        nodes = F.greatest(F.lit(1), F.ceil(F.col("rows") / FAN_IN)).cast("long")
        member = F.struct(F.xxhash64("id", F.lit(seed + level)).alias("at"), "id", "size", "mass")
        folded = units.groupBy("grp", nodes.alias("rows"), F.pmod(F.xxhash64("id", F.lit(seed - 1 - level)), nodes).alias("node")).agg(
            _fold(F.array_sort(F.collect_list(member)), seed + level).alias("f")
        )
        folded = pin(folded.select("grp", "rows", "f.rest", "f.done"), "pivotal")
        settled.append(folded.select(F.explode("done").alias("d")).select("d.id", "d.take"))
        left = folded.select("grp", "rest.id", "rest.size", "rest.mass", "rows").filter("id is not null")
        if most <= FAN_IN:
            # the last one of each group: taken with the chance of its own fraction
            settled.append(left.select("id", (_uniform(F.col("id"), F.lit(seed + 99)) * F.col("size") < F.col("mass")).cast("int").alias("take")))
            break
        units, level = left, level + 1
    out = None
    for part in settled:
        out = part if out is None else out.unionByName(part)
    return out if out is not None else units.select("id", F.lit(0).alias("take"))


def mix(documents: DataFrame, seed: int = 41) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, copies`` for every row of ``documents``.

    Null and empty texts have size 0, are in no fraction and are taken 0 times. Rows alike in doc_id, source and size share
    the copies of their unit, which differ by one at most. A null source is the last source; null ids are allowed; an
    empty table gives no rows; other columns are ignored. Draws are hashes of ids, so reruns agree.
    """
    rows = pin(_narrow(documents, _numbered()), "mixture-rows")
    per_source = pin(source_targets(rows), "mixture-sources")
    decided = pin(unit_copies(rows, per_source, seed), "mixture-units")
    named = per_source.select(F.col("source").alias("_source"), "source_size", "target")
    return _handed_out(rows, decided).join(named, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies"
    )


def draw(documents: DataFrame, seed: int = 41) -> DataFrame:
    """The mixed corpus: every row of ``documents`` as often as it is taken, with ``copy`` counting from 1.

    Cases are as in ``mix``; columns of ``documents`` stay as they are, a column ``copy`` of theirs is replaced. Rows of one unit
    may differ in their texts; which of them take the unit's copies depends on their order in the table's files.
    """
    rows = pin(_narrow(documents), "mixture-rows")
    decided = pin(unit_copies(rows, pin(source_targets(rows), "mixture-sources"), seed).filter("least > 0 or extra > 0"), "mixture-units")
    kept = documents.select(*[c for c in documents.columns if c != "copy"])
    whole = _narrow(kept.select(*_TAKEN_FROM, F.struct("*").alias("doc")), _numbered(), ["doc"])
    return _handed_out(whole, decided).filter("copies > 0").select(
        *[F.col("doc")[c].alias(c) for c in kept.columns], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    )


_TAKEN_FROM = ("doc_id", "source", "text")


def _numbered() -> dict[str, Column]:
    """A row's part of the table and its number there."""
    number = F.monotonically_increasing_id()
    return {"part": F.shiftright(number, 33), "number": number}


def _narrow(documents: DataFrame, numbers: dict[str, Column] | None = None, kept: list[str] | None = None) -> DataFrame:
    """``id, doc_id, source, size`` of every row: ``id`` is a digest of the other three, nulls apart from empty strings."""
    narrow = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"), *(kept or []), *[value.alias(name) for name, value in (numbers or {}).items()],
    )
    source = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    return narrow.withColumn("id", F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "size", source), 256))


def unit_copies(rows: DataFrame, per_source: DataFrame, seed: int) -> DataFrame:
    """``id, n, least, extra``: a unit's rows, the copies of each, and how many of them get one more."""
    rate = F.try_divide(F.col("target"), F.col("source_size"))
    named = per_source.withColumnRenamed("source", "_source")
    units = rows.filter("size > 0").groupBy("id").agg(
        F.any_value("source").alias("source"), F.any_value("size").cast("double").alias("size"), F.count("*").alias("n")
    ).join(named, F.col("source").eqNullSafe(F.col("_source"))).select(
        "id", "n", F.floor(rate + _EDGE).cast("long").alias("least"), F.greatest(rate - F.floor(rate + _EDGE), F.lit(0.0)).alias("fraction"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("grp"), "size", F.col("source_size").cast("double").alias("total"), "rows",
    )
    units = pin(units, "mixture-fractions")
    fractional = units.filter(F.col("fraction") > _EDGE)
    # a source has at most LARGE_PARTS large rows
    is_large = F.col("size") * LARGE_PARTS > F.col("total")
    single = F.when(is_large & (F.col("n") > 1), F.sequence(F.lit(1), F.col("n").cast("int"))).otherwise(F.array(F.lit(0)))
    alone = fractional.withColumn("k", F.explode(single)).select(
        "grp", F.when(F.col("k") > 0, F.concat_ws("#", "id", "k")).otherwise(F.col("id")).alias("id"),
        F.when(F.col("k") > 0, 1).otherwise(F.col("n")).alias("n"), "size", "fraction", "total", "rows",
    )
    large, rest = settle_large(alone, seed)
    rest = pin(rest, "mixture-rest")
    takes = large.unionByName(round_fractions(rest.filter(F.col("mass") > _EDGE).drop("sure"), seed)).unionByName(
        rest.filter("sure > 0").select("id", F.col("sure").alias("take"))
    )
    taken = takes.groupBy(F.substring_index("id", "#", 1).alias("_id")).agg(F.sum("take").alias("_extra"))
    return units.join(taken, F.col("id") == F.col("_id"), "left").select("id", "n", "least", F.coalesce("_extra", F.lit(0)).alias("extra"))


def _handed_out(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """``rows`` with ``copies``. A unit's rows are numbered inside each part of the table; the parts before add their counts."""
    told = rows.join(decided, "id", "left")
    one = told.filter("coalesce(n, 1) = 1").withColumn("copies", F.coalesce(F.col("least") + F.col("extra"), F.lit(0)))
    several = pin(told.filter("n > 1"), "mixture-repeats")
    inside = Window.partitionBy("id", "part").orderBy("number")
    # a row per unit and part
    before = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = several.groupBy("id", "part").agg(F.count("*").alias("_k")).select("id", "part", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_ahead"))
    numbered = several.withColumn("_nth", F.row_number().over(inside)).join(ahead, ["id", "part"]).withColumn(
        "copies", F.col("least") + (F.col("_nth") + F.col("_ahead") <= F.col("extra")).cast("long")
    )
    return one.unionByName(numbered.select(*one.columns))
