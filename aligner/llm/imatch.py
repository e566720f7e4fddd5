"""Document fingerprints by I-Match, in native expressions.

The lexicon holds the terms whose share of documents lies in a band (neither too common nor too rare). It is divided at random into
several sub-lexicons, each with nested, ever sparser subsets. For each sub-lexicon, a text's distinct terms in the sparsest subset that
holds any of them are sorted and hashed; the fingerprint is the list of these hashes.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aligner.llm.common import SPACE_CLASS, let, shuffle_partitions

#: A lexicon is looked up in so many slots.
_SLOTS = 1 << 16
_RANGES = 64


def terms(text: Column) -> Column:
    """Distinct hashed lower-cased words."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), SPACE_CLASS), lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float, high: float) -> Column:
    """Terms held by at least a share ``low`` and at most ``high`` of the rows, as an array of slots.

    Its size is bounded by the mean number of distinct terms per document over ``low``, whatever the number of documents. It is a
    scalar subquery: computed once and read by every task.
    """
    count = docs.agg(F.count(F.lit(1)).alias("rows")).scalar()
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), SPACE_CLASS))).alias("word")).where("word != ''")
    held = words.groupBy(F.xxhash64("word").alias("term")).agg(F.count(F.lit(1)).alias("df"))
    band = held.where((F.col("df") >= F.lit(low) * count) & (F.col("df") <= F.greatest(F.lit(2.0), F.lit(high) * count)))
    slots = band.groupBy(F.pmod("term", F.lit(_SLOTS)).cast("int").alias("slot")).agg(F.collect_list("term").alias("terms"))
    every = docs.sparkSession.range(_SLOTS).select(F.col("id").cast("int").alias("slot")).join(slots, "slot", "left")
    filled = F.struct("slot", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms"))
    return every.agg(F.transform(F.array_sort(F.collect_list(filled)), lambda s: s["terms"]).alias("lexicon")).scalar()


def _rarity(x: Column) -> Column:
    """Number of trailing zero bits of a hash: r or more have a chance of one in 2^r."""
    lowest = x.bitwiseAND(-x)
    return F.when(x == 0, F.lit(64)).otherwise(F.bit_count(lowest - F.lit(1)))


def fingerprint(text: Column, lexicon: Column, parts: int) -> Column:
    """One long per sub-lexicon that the text has a term of: the sub-lexicon's number above 32 bits of hash, ascending.

    A text without any term of the lexicon is fingerprinted by all its terms; one without words has no entry.
    """
    def in_lexicon(x: Column) -> Column:
        return F.filter(x["own"], lambda t: F.array_contains(F.get(x["lexicon"], F.pmod(t, F.lit(_SLOTS)).cast("int")), t))

    def chosen(x: Column) -> Column:
        return F.when(F.size(x["known"]) > 0, x["known"]).otherwise(x["own"])

    both = let(F.struct(terms(text).alias("own"), lexicon.alias("lexicon")),
                lambda x: F.struct(x["own"].alias("own"), in_lexicon(x).alias("known")))
    used = let(both, chosen)
    placed = F.array_sort(F.transform(used, lambda t: F.struct(
        F.pmod(F.xxhash64(t, F.lit(101)), F.lit(parts)).cast("int").alias("part"),
        (-_rarity(F.xxhash64(t, F.lit(202)))).cast("int").alias("level"), t.alias("term"))))
    kind = "array<struct<part:int,level:int,hash:bigint>>"

    def step(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        new = F.struct(x["part"].alias("part"), x["level"].alias("level"), F.xxhash64(x["term"]).alias("hash"))
        more = F.struct(x["part"].alias("part"), x["level"].alias("level"), F.xxhash64(last["hash"], x["term"]).alias("hash"))
        begins = (F.size(done) == 0) | (last["part"] != x["part"])
        grown = F.when(last["level"] == x["level"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(more))).otherwise(done)
        return F.when(begins, F.concat(done, F.array(new))).otherwise(grown).cast(kind)

    hashed = F.aggregate(placed, F.array().cast(kind), step)
    return F.transform(hashed, lambda h: F.shiftleft(h["part"].cast("long"), 32).bitwiseOR(h["hash"].bitwiseAND(F.lit(0xFFFFFFFF))))


def as_text(entries: Column, parts: int) -> Column:
    """8 hex digits per sub-lexicon, dashes where the text has no entry."""
    def entry(k: Column) -> Column:
        own = F.get(F.filter(entries, lambda e: F.shiftright(e, 32) == k), F.lit(0))
        return F.coalesce(F.lower(F.lpad(F.hex(own.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), F.lit("--------"))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), entry), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries among the sub-lexicons that either text has an entry of; 1 if neither has any."""
    either = F.size(F.array_distinct(F.transform(F.concat(a, b), lambda e: F.shiftright(e, 32))))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _bucket(docs: DataFrame) -> Column:
    """A bucket number that falls with ``doc_id``: quantiles of the ids, each cut evenly, about as many as shuffle partitions."""
    size = docs.agg(F.min("_order").alias("lo"), F.max("_order").alias("hi")).first()
    if size["lo"] is None:
        return F.lit(0).cast("long")
    cuts = sorted({int(q) for q in docs.approxQuantile("_order", [i / _RANGES for i in range(1, _RANGES)], 0.002)})
    bounds = sorted({size["lo"], *(c for c in cuts if size["lo"] < c <= size["hi"])})
    ends = [*bounds[1:], size["hi"] + 1]
    within = -(-shuffle_partitions(docs.sparkSession) // len(bounds))
    starts = F.array(*[F.lit(Decimal(b)).cast("decimal(20,0)") for b in bounds])
    widths = F.array(*[F.lit(Decimal(e - b)).cast("decimal(20,0)") for b, e in zip(bounds, ends, strict=True)])
    place = F.size(F.filter(starts, lambda b: b <= F.col("_order"))) - 1
    offset = (F.col("_order").cast("decimal(20,0)") - F.get(starts, place)).cast("double") / F.get(widths, place).cast("double")
    inner = F.least(F.lit(within - 1), F.floor(offset * within).cast("long"))
    return -(place.cast("long") * within + inner)


def fingerprinted(df: DataFrame, text_col: str, lexicon: Column, parts: int, name: str) -> DataFrame:
    """``df`` with the fingerprint of ``text_col``; the lexicon is a column of its own for the analyser, which allows no subquery as an
    argument of higher-order functions, and is folded into the expression by the optimiser (it never becomes a column of rows)."""
    held = df.withColumn("_lexicon", lexicon)
    return held.select(*[F.col(c) for c in df.columns], fingerprint(F.col(text_col), F.col("_lexicon"), parts).alias(name))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 0.001, high: float = 0.2,
               parts: int = 32) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The edited text is the text with its last ``n_chars // 2`` code points replaced by the first as many of the next row, by
    descending id, the first row following the last. Nearness is the share of equal entries among those that either
    fingerprint has. Null texts are empty; rows of equal ids follow each other by a hash of their text; null ids come last; a
    single row is its own next one. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = lexicon(rows.select("text"), low, high)
    rows = rows.withColumns({"_order": F.coalesce("doc_id", F.lit(-(1 << 63))), "_tie": F.xxhash64("text")})
    rows = rows.withColumn("_bucket", _bucket(rows))
    marked = fingerprinted(rows, "text", words, parts, "_entries")
    order = [F.desc("_order"), F.asc("_tie")]
    window = Window.partitionBy("_bucket").orderBy(*order)
    follow = marked.withColumn("_next", F.lead(F.struct("text", "_entries")).over(window))

    heads = rows.groupBy("_bucket").agg(F.min(F.struct((-F.col("_order").cast("decimal(20,0)")).alias("o"), F.col("_tie").alias("t"))).alias("h"))
    after = Window.orderBy("_bucket")  # one row per bucket
    follows = heads.select("_bucket", F.coalesce(F.lead("_bucket").over(after), F.min("_bucket").over(Window.partitionBy())).alias("_after"))
    first = heads.select(F.col("_bucket").alias("_after"), (-F.col("h.o")).cast("long").alias("_first_order"), F.col("h.t").alias("_first_tie"))
    # one row per bucket, and there are about as many buckets as shuffle partitions: small beside the rows, which are not shuffled
    first = rows.select("_bucket", "_order", "_tie", "text").join(
        F.broadcast(first), (F.col("_bucket") == F.col("_after")) & (F.col("_order") == F.col("_first_order")) & (F.col("_tie") == F.col("_first_tie")))
    first = first.groupBy("_after").agg(F.first("text").alias("_first_text"))
    heads = fingerprinted(follows.join(first, "_after"), "_first_text", words, parts, "_entries").select(
        "_bucket", F.struct(F.col("_first_text").alias("text"), "_entries").alias("_head"))

    half = F.floor(F.length("text") / 2).cast("int")
    joined = follow.join(heads, "_bucket").withColumn("_next", F.coalesce("_next", "_head"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("_next.text"), F.lit(1), half))
    made = joined.select("doc_id", F.length("text").cast("long").alias("n_chars"), "_entries", F.col("_next._entries").alias("_next_entries"),
                         edited.alias("_edited"))
    made = fingerprinted(made, "_edited", words, parts, "_edited_entries")
    return made.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), as_text(F.col("_entries"), parts).alias("fingerprint"),
        as_text(F.col("_edited_entries"), parts).alias("edited_fingerprint"),
        likeness(F.col("_entries"), F.col("_edited_entries")).alias("near_edited"),
        likeness(F.col("_entries"), F.col("_next_entries")).alias("near_next"))
