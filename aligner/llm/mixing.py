"""Mixing sources to target weights: whole copies of documents by pivotal dependent rounding, native expressions only.

A source's target over its size is the number of copies every document should have. The whole part is given to all; the fractions are
rounded in duels: two documents exchange mass (fraction times size, so the source's total stays the same) until one of them is
decided, the direction being random with odds that keep every fraction's expectation. Duels run inside groups of bounded
size, whose one undecided document each goes on to the next level of a reduction tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aligner.llm.common import WORD_CLASS, let, shuffle_partitions
from aligner.session import stage

_KEY = "_source_key"
_WHOLE = 1e-12


def _source_key(source: Column) -> Column:
    """A join key that tells a null source from every text."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def position(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """0-based position of every row of a table of any size: local positions in ranges, plus the counts of the ranges before."""
    ranged = stage(df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    before = ranged.groupBy("_range").count().withColumn(
        "_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(before.select("_range", "_before"), "_range").withColumn(
        name, F.col("_before") + F.col("_local")).drop("_range", "_local", "_before")


def targets(sizes: DataFrame, total_share: float, weights: tuple[int, ...], most: float) -> DataFrame:
    """``_source_key, source_size, target`` for ``_source_key, source, source_size``.

    The level at which uncapped sources get level times weight is found by iteration: a round sums the caps of the sources that
    the last level fills and shares what remains among the others. Only such sums reach the driver.
    """
    placed = position(sizes, [F.asc_nulls_last("source")], "_position")
    choice = F.array(*[F.lit(float(w)) for w in weights])
    weighed = stage(placed.withColumn("_weight", F.get(choice, (F.col("_position") % len(weights)).cast("int")))
                    .withColumn("_cap", F.lit(most) * F.col("source_size")), "sources")
    total = total_share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, capped_before = 0.0, -1
    capped = F.lit(False)
    while True:
        full = F.when(capped, F.col("_cap"))
        row = weighed.agg(F.count(full), F.sum(full), F.sum(F.when(~capped, F.col("_weight")))).first()
        if row[0] == capped_before or row[2] is None:
            break
        capped_before = row[0]
        level = (total - (row[1] or 0.0)) / row[2]
        capped = F.col("_cap") <= F.lit(level) * F.col("_weight")
    target = F.when(capped, F.col("_cap")).otherwise(F.lit(float(level)) * F.col("_weight"))
    return weighed.select(_KEY, "source_size", F.least(target, F.col("_cap")).alias("target"))


_UNIT = "doc_id long, size long, hash long, rows long, whole long, p double"
_UNIT_FIELDS = ["doc_id", "size", "hash", "rows", "whole", "p"]


def _unit(u: Column, p: Column) -> Column:
    return F.struct(*[u[f].alias(f) for f in _UNIT_FIELDS[:-1]], p.alias("p"))


def _duel(a: Column, b: Column, seed: int, level: int) -> Column:
    """The pair after the exchange: an array of two units, at least one with fraction 0 or 1."""
    uniform = (F.xxhash64(a["doc_id"], a["hash"], b["doc_id"], b["hash"], F.lit(seed), F.lit(level)).bitwiseAND(F.lit((1 << 53) - 1))
               .cast("double") / F.lit(float(1 << 53)))
    mass = F.struct(
        ((F.lit(1.0) - a["p"]) * a["size"]).alias("a_up"), (a["p"] * a["size"]).alias("a_down"),
        ((F.lit(1.0) - b["p"]) * b["size"]).alias("b_up"), (b["p"] * b["size"]).alias("b_down"))

    def moved(m: Column) -> Column:
        first, second = F.least(m["a_up"], m["b_down"]), F.least(m["a_down"], m["b_up"])
        a_gains = uniform * (first + second) < second
        gain_a = F.when(m["a_up"] <= m["b_down"], F.lit(1.0)).otherwise(a["p"] + m["b_down"] / a["size"])
        lose_b = F.when(m["b_down"] <= m["a_up"], F.lit(0.0)).otherwise(b["p"] - m["a_up"] / b["size"])
        lose_a = F.when(m["a_down"] <= m["b_up"], F.lit(0.0)).otherwise(a["p"] - m["b_up"] / a["size"])
        gain_b = F.when(m["b_up"] <= m["a_down"], F.lit(1.0)).otherwise(b["p"] + m["a_down"] / b["size"])
        return F.when(a_gains, F.array(_unit(a, _snapped(gain_a)), _unit(b, _snapped(lose_b)))).otherwise(
            F.array(_unit(a, _snapped(lose_a)), _unit(b, _snapped(gain_b))))

    return let(mass, moved)


def _snapped(p: Column) -> Column:
    return F.when(p <= _WHOLE, 0.0).when(p >= 1 - _WHOLE, 1.0).otherwise(p)


def _open(u: Column) -> Column:
    return (u["p"] > 0) & (u["p"] < 1)


def _fold(units: Column, seed: int, level: int) -> Column:
    """``done`` (decided units) and ``open`` (none or one undecided) after all duels of a group, largest documents first."""
    kind = f"struct<done:array<struct<{_UNIT.replace(' ', ':')}>>,open:array<struct<{_UNIT.replace(' ', ':')}>>>".replace(",:", ",")
    start = F.struct(F.array().alias("done"), F.array().alias("open")).cast(kind)

    def step(state: Column, unit: Column) -> Column:
        def settled(pair: Column) -> Column:
            return F.struct(F.concat(state["done"], F.filter(pair, lambda u: ~_open(u))).alias("done"),
                            F.filter(pair, _open).alias("open")).cast(kind)

        alone = F.struct(state["done"].alias("done"), F.array(unit).alias("open")).cast(kind)
        return F.when(F.size(state["open"]) == 0, alone).otherwise(let(_duel(F.get(state["open"], F.lit(0)), unit, seed, level), settled))

    return F.aggregate(units, start, step)


def _rounded(units: DataFrame, sources: DataFrame, seed: int, fan_in: int) -> DataFrame:
    """Units with ``p`` 0 or 1: a tree of grouped duels per source; its last undecided unit goes to the nearer side."""
    largest = sources.agg(F.max("_units")).first()[0] or 0
    decided, level = [], 0
    rest = units
    while True:
        groups = F.greatest(F.lit(1), F.ceil(F.col("_units") / F.lit(float(fan_in ** (level + 1))))).cast("long")
        group = F.pmod(F.xxhash64("doc_id", "hash", F.lit(seed), F.lit(level)), groups)
        unit = F.struct(*_UNIT_FIELDS)
        by_size = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("o"), F.col("doc_id").alias("i"), F.col("hash").alias("h"), unit.alias("unit"))))
        folded = rest.withColumn("_group", group).groupBy(_KEY, "_units", "_group").agg(
            F.transform(by_size, lambda x: x["unit"]).alias("units"))
        folded = stage(folded.select(_KEY, "_units", _fold(F.col("units"), seed, level).alias("state")), "duels")
        decided.append(folded.select(_KEY, F.inline("state.done")))
        rest = folded.select(_KEY, "_units", F.inline("state.open"))
        level += 1
        if fan_in ** level >= largest:
            break
    out = rest.select(_KEY, *_UNIT_FIELDS[:-1], F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0).alias("p"))
    for more in decided:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_share: float = 1.5,
        weights: tuple[int, ...] = (3, 1, 2), most: float = 2.0, seed: int = 11, fan_in: int = 256) -> DataFrame:
    """``doc_id, source, hash, size, source_size, target, copies, taken`` of every row, ``taken`` being copies times size.

    Size is the number of words of the text (null: 0). Sources weigh ``weights`` in turn by code point, null last, and share
    ``total_share`` of all sizes; no target exceeds ``most`` times its source's size, nor ``taken`` that multiple (rounded up) of the document's. The total
    taken of a source differs from its target by less than one document's size. The choice depends only on the rows and
    ``seed``. ``hash`` is that of the text. Equal rows (id, source, text) are counted, get their common whole copies and compete as one; null ids are ids
    like others; extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_CLASS)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(text_col)).alias("hash"))
    rows = rows.withColumn(_KEY, _source_key(F.col("source"))).groupBy(_KEY, "doc_id", "size", "hash").agg(
        F.first("source").alias("source"), F.count(F.lit(1)).alias("rows"))
    rows = stage(rows, "sizes")
    sizes = rows.groupBy(_KEY).agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("rows")).alias("source_size"),
                                   F.count(F.lit(1)).alias("_units"))
    sources = targets(sizes, total_share, weights, most).join(sizes.select(_KEY, "source", "_units"), _KEY)
    sources = stage(sources.withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))),
                    "targets")
    rated = rows.drop("source").join(sources.select(_KEY, "_units", "_rate"), _KEY)
    near = F.round("_rate")
    rated = rated.withColumn("_rate", F.when(F.abs(F.col("_rate") - near) < _WHOLE, near).otherwise(F.col("_rate")))
    copies = F.col("_rate") * F.col("rows")  # of all equal rows together
    units = rated.withColumn("whole", F.floor(copies + _WHOLE).cast("long")).withColumn(
        "p", _snapped(F.greatest(F.lit(0.0), copies - F.col("whole"))))
    duelling = (F.col("p") > 0) & (F.col("p") < 1) & (F.col("size") > 0)
    columns = [_KEY, *_UNIT_FIELDS]
    settled = units.where(~duelling).withColumn("p", F.floor("p").cast("double")).select(*columns)
    all_units = settled.unionByName(_rounded(units.where(duelling).select(_KEY, "_units", *_UNIT_FIELDS),
                                             sources, seed, fan_in).select(*columns))
    total = F.col("whole") + F.col("p").cast("long")
    spread = all_units.withColumn("_total", total).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    each = F.floor(F.col("_total") / F.col("rows")) + (F.col("_row") <= F.col("_total") % F.col("rows")).cast("long")
    return spread.withColumn("copies", each.cast("long")).join(sources.select(_KEY, "source", "source_size", "target"), _KEY).select(
        "doc_id", "source", "hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` copies them (``doc_id``, ``text`` and ``source`` have these names), all columns, whatever their names.

    Null ids and sources are values of their own. Rows of equal id, source and text share their copies: one of them stands for all. Null and
    empty texts have size 0, taking them adds no words; an empty table gives an empty result.
    """
    copies = mix(docs, **options).groupBy("doc_id", "source", "hash").agg(F.sum("copies").alias("_copies")).where(F.col("_copies") > 0)
    copies = copies.withColumnsRenamed({"doc_id": "_id", "source": "_source", "hash": "_text"})
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_own_id"), F.col("source").alias("_own_source"),
                      F.xxhash64("text").alias("_own_text"))
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & F.col("_own_source").eqNullSafe(F.col("_source")) & (F.col("_own_text") == F.col("_text"))
    found = own.join(copies, same).dropDuplicates(["_own_id", "_own_source", "_own_text"])
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")
