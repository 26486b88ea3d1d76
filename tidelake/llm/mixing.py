"""Mixing sources to target weights by Pareto order sampling (operator 3).

Every source gets a target, in words. A source whose target is ``r`` times its
size gives ``floor(r)`` certain copies of each document; what is left of the
target is a sample of fixed size, in words, with unequal probabilities: a
document's inclusion probability ``p`` grows with its size to the power POWER,
up to 1, from where on it is one more certain copy. Documents are ranked by
their random odds over their inclusion odds, ``u / (1 - u) / (p / (1 - p))``,
and taken in that order until the words are used up.

The end of each ranked prefix is found by counting: words are summed for bins
of the rank, then for finer bins inside the one where the target is crossed,
down to bins of about BIN_ROWS documents. Only that one is looked at row by row.
Documents that do not fit are passed over, and the count goes on in later bins
with those that fit what is left, until none does. Rows that agree in id, source
and size have one rank; of them as many are taken as fit. The result is a plan
with one row per source, which is applied to documents without moving texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, maybe_broadcast, small, unused

#: Words are what lies between the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents that a bin of the rank holds on average, and parts that a bin is divided into at a time.
BIN_ROWS, BIN_PARTS = 128, 4096
#: A source is repeated so many times at most.
MAX_COPIES = 3
#: Inclusion probabilities grow as this power of a document's size.
POWER = 0.5
#: Numbers of a plan that may be broadcast, after they were counted.
PLAN_NUMBERS = 500_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: str) -> Column:
    """Sources as join keys; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def _draw(seed: int, id_col: str, size: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(size))


def inclusion(size: str, rate: str) -> Column:
    return F.least(F.lit(1.0), F.col(rate) * F.pow(F.col(size).cast("double"), F.lit(POWER)))


def pareto_rank(draw: str, size: str, rate: str, share: str) -> Column:
    """Random odds over inclusion odds, ``x``, from 0 (a certain document) to 1.

    Given as ``x o / (1 + x o)`` with ``o`` the odds of the source's ``share``,
    which keeps the order and spreads the ranks of a source evenly.
    """
    u, p = (F.shiftrightunsigned(draw, 12).cast("double") + 0.5) / float(2**52), inclusion(size, rate)
    out, in_ = u * (1 - p) * F.col(share), (1 - u) * p * (1 - F.col(share))
    return F.when(in_ > 0, out / (out + in_)).otherwise(1.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """From ``key, source, docs, source_size`` to the same with ``target``.

    Sources in code point order, null last, have ``weights``, repeating. A
    target is its weight times a common level, at most MAX_COPIES times the
    source's size; the level is raised until the targets share all words.
    """
    ordered = sizes.repartitionByRange(1 if small(sizes) else 64, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ordered = materialise(ordered.withColumn("_at", F.monotonically_increasing_id()), few=True)
    part, within = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    ahead, offsets = 0, {}
    for row in ordered.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row per partition
        offsets[row["p"]], ahead = ahead, ahead + row["count"]
    offset = F.array(*[F.lit(offsets.get(i, 0)).cast("long") for i in range(max(offsets, default=0) + 1)])[part]
    weighed = ordered.withColumn("weight", F.array(*map(F.lit, weights))[((within + offset) % len(weights)).cast("int")])
    cap = MAX_COPIES * F.col("source_size")
    total, weight = weighed.agg(F.sum("source_size"), F.sum(F.when(F.col("source_size") > 0, F.col("weight")))).first()
    level = total / weight if total else 0.0
    while total:
        capped = cap <= F.col("weight") * F.lit(level)
        full, free = weighed.agg(F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)), F.sum(F.when(~capped, F.col("weight")))).first()
        raised = (total - full) / free if free else level
        if raised <= level:
            break
        level = raised
    return weighed.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), cap.cast("double"))).drop("_at")


STEPS = "array<struct<low:bigint,high:bigint,most:bigint>>"
CHOSEN = "array<struct<draw:bigint,size:bigint,take:bigint,of:bigint>>"


def source_rates(sized: DataFrame, left: DataFrame) -> DataFrame:
    """``key, rate`` so that the sizes of documents (``key, size``) by their inclusion probabilities come to ``left`` (``key, left``).

    Sizes are counted in bins of a sixteenth of a doubling; the documents of the
    largest bins are certain while the rate of all others would exceed theirs.
    """
    level = F.floor(F.log2(F.col("size").cast("double")) * 16)
    bins = sized.filter("size > 0").groupBy("key", level.alias("level")).agg(F.sum("size").alias("words"), F.max("size").alias("top"), F.sum(F.pow(F.col("size").cast("double"), F.lit(1 + POWER))).alias("mass"))
    by = Window.partitionBy("key").orderBy("level")
    larger = Window.partitionBy("key").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    open_ = bins.join(left, "key").withColumn("certain", F.coalesce(F.sum("words").over(larger), F.lit(0))).withColumn("rest", F.sum("mass").over(by))
    rate = (F.col("left") - F.col("certain")) / F.col("rest")
    fits = open_.withColumn("rate", rate).filter((F.col("rate") > 0) & (F.col("rate") * F.pow(F.col("top").cast("double"), F.lit(POWER)) <= 1 + 1e-9))
    return left.select("key").join(fits.groupBy("key").agg(F.max_by("rate", "level").alias("rate")), "key", "left").select("key", F.coalesce("rate", F.lit(0.0)).alias("rate"))


@dataclass
class Mix:
    """One row per source: ``key, source_size, target, whole, rate, share, bins, steps, chosen``.

    A document takes ``whole`` copies, and one more if the bin of its rank and
    its size are within one of ``steps``, or if its draw is among ``chosen``,
    which has draws of the bins alone that were looked at row by row: ``take``
    of the ``of`` rows that share a draw.
    """

    plan: DataFrame
    seed: int
    id_col: str
    source_col: str

    def apply(self, docs: DataFrame, size: str) -> tuple[DataFrame, str, str]:
        """``docs`` with two more columns, and their names: the copies of each row, and a struct of its source's plan."""
        key, draw, plan_, some, part, at, copies = unused(docs, 7)
        plan = self.plan.select(F.col("key").alias(key), F.struct(*[c for c in self.plan.columns if c != "key"]).alias(plan_))
        numbers = self.plan.agg(F.coalesce(F.sum(8 + 3 * F.size("steps") + 4 * F.size("chosen")), F.lit(0))).first()[0]
        drawn = docs.withColumn(key, _key(self.source_col)).withColumn(draw, _draw(self.seed, self.id_col, size))
        joined = drawn.join(F.broadcast(plan) if numbers <= PLAN_NUMBERS else plan, key)
        found = F.filter(F.col(plan_)["chosen"], lambda x: (x["draw"] == F.col(draw)) & (x["size"] == F.col(size)))
        joined = joined.withColumn(some, F.when(F.size(found) > 0, found[0]))
        sampled = F.when(F.col(some).isNotNull(), 1).otherwise(_passed(plan_, draw, size).cast("int"))
        joined = joined.withColumn(copies, (F.col(plan_)["whole"] + sampled).cast("int"))
        if self.plan.filter(F.exists("chosen", lambda x: x["take"] < x["of"])).isEmpty():
            return joined.drop(key, draw, some), copies, plan_
        # Rows that share a draw of which only some are taken are numbered, task by task.
        shared = F.coalesce(F.col(some)["take"] < F.col(some)["of"], F.lit(False))
        rows = joined.filter(shared).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id())
        rows = materialise(rows.withColumn(at, F.row_number().over(Window.partitionBy(key, draw, size, part).orderBy(at))))
        ahead = rows.groupBy(key, draw, size, part).agg(F.max(at).alias(some))
        before = F.coalesce(F.sum(some).over(Window.partitionBy(key, draw, size).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ahead = maybe_broadcast(materialise(ahead.withColumn(copies, before).drop(some)))
        numbered = rows.drop(copies).join(ahead, [key, draw, size, part])
        taken = (F.col(at) + F.col(copies) <= F.col(some)["take"]).cast("int")
        numbered = numbered.withColumn(copies, (F.col(plan_)["whole"] + taken).cast("int"))
        return joined.filter(~shared).drop(key, draw, some).unionByName(numbered.drop(key, draw, some, part, at)), copies, plan_


def _passed(plan: str, draw: str, size: str) -> Column:
    """Whether the rank lies in a stretch that is taken as a whole."""
    rank = pareto_rank(draw, size, f"{plan}.rate", f"{plan}.share")
    bin_ = F.least(F.floor(rank * F.col(plan)["bins"]), F.col(plan)["bins"] - 1)
    return (F.col(size) > 0) & F.exists(F.col(plan)["steps"], lambda x: bin_.between(x["low"], x["high"] - 1) & (F.col(size) <= x["most"]))


def _crossing(rows: DataFrame, bin_: Column) -> DataFrame:
    """``_key, at, before``: for each key the first bin where the words so far exceed ``_left``, and the words before it."""
    sums = rows.groupBy("_key", bin_.alias("b")).agg(F.sum("_size").alias("words"), F.first("_left").alias("_left"))
    so_far = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("_key").orderBy("b")))
    over = so_far.filter(F.col("upto") > F.col("_left"))
    return over.groupBy("_key").agg(F.min("b").alias("at"), F.min(F.struct("b", (F.col("upto") - F.col("words")).alias("before")))["before"].alias("before"))


def _walk() -> Column:
    """Takes the documents that still fit, in rank order; gives their draws and what is left."""
    start = F.struct(F.col("_left").alias("left"), F.array().cast(CHOSEN).alias("chosen"))

    def step(acc: Column, doc: Column) -> Column:
        take = F.least(doc["of"], F.floor(acc["left"] / doc["size"]))
        one = F.array(F.struct(doc["draw"].alias("draw"), doc["size"].alias("size"), take.alias("take"), doc["of"].alias("of")))
        return F.struct((acc["left"] - take * doc["size"]).alias("left"), F.when(take > 0, F.concat(acc["chosen"], one)).otherwise(acc["chosen"]).alias("chosen"))

    return F.aggregate("ranked", start, step)


def _fill(ranked: DataFrame, goals: DataFrame, levels: int) -> DataFrame:
    """``key, left, steps, chosen``: the walk over ``ranked`` (``_key, _size, _draw, _rank, _bin``) in rank order, and what it leaves.

    Each round goes on behind the bin that the last one looked into, with the
    documents no larger than what is left. All of them fit up to the bin where
    their words cross it, and in that bin they are taken one by one.
    """
    state = goals.select("key", "left", "bins", F.lit(0).cast("long").alias("low"), F.floor("left").alias("most"), F.array().cast(STEPS).alias("steps"), F.array().cast(CHOSEN).alias("chosen"))
    first = True
    while True:
        state = materialise(state, few=True)
        now = state.filter("low < bins and most > 0")
        if now.isEmpty():
            return state.select("key", "left", "steps", "chosen")
        side = maybe_broadcast(now.select(F.col("key").alias("_key"), F.col("left").alias("_left"), F.col("low").alias("_low"), F.col("most").alias("_most")))
        ranked = ranked.drop("_left", "_low", "_most").join(side, "_key").filter("_bin >= _low and _size <= _most")
        if not first:
            ranked = materialise(ranked)  # what may fit gets less each time
        first = False
        sums = ranked.groupBy("_key").agg(F.sum("_size").alias("_all"))
        inside = ranked
        for level in range(levels - 1, -1, -1):
            bin_ = F.floor(F.col("_bin") / F.lit(BIN_PARTS**level))
            cut = materialise(_crossing(inside, bin_).select("_key", F.col("at").alias("_cut"), F.col("before").alias("_before")), few=True)
            inside = inside.join(maybe_broadcast(cut), "_key").filter(bin_ == F.col("_cut")).withColumn("_left", F.col("_left") - F.col("_before")).drop("_cut", "_before")
        alike = inside.groupBy("_key", "_bin", "_draw", "_size").agg(F.count("*").alias("of"), F.first("_left").alias("_left"), F.first("_rank").alias("_rank"))
        listed = alike.groupBy("_key", "_bin", "_left").agg(F.array_sort(F.collect_list(F.struct(F.col("_rank").alias("rank"), F.col("_draw").alias("draw"), F.col("_size").alias("size"), "of"))).alias("ranked"))
        walked = listed.select(F.col("_key").alias("key"), F.col("_bin").alias("_cut"), _walk().alias("_walked"))
        joined = state.join(sums.withColumnRenamed("_key", "key"), "key", "left").join(walked, "key", "left")
        some, crossed = F.col("_all").isNotNull(), F.col("_cut").isNotNull()
        left = F.when(crossed, F.col("_walked.left")).when(some, F.col("left") - F.col("_all")).otherwise(F.col("left"))
        done = F.struct("low", F.when(crossed, F.col("_cut")).otherwise(F.col("bins")).cast("long").alias("high"), "most")
        state = joined.select(
            "key", left.alias("left"), "bins", F.when(crossed, F.col("_cut") + 1).otherwise(F.col("bins")).cast("long").alias("low"), F.floor(left).cast("long").alias("most"),
            F.when(some, F.concat("steps", F.array(done))).otherwise(F.col("steps")).cast(STEPS).alias("steps"), F.when(crossed, F.concat("chosen", "_walked.chosen")).otherwise(F.col("chosen")).cast(CHOSEN).alias("chosen"),
        )


def plan_mix(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 23, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size") -> Mix:
    """Plan the mix of ``sized``, a table of ids, sources and sizes that is cheap to read again.

    Sizes are counts of words. Rows that agree in id, source and size have one
    rank, and as many of them are taken as fit. A null source is a source; a
    null id draws like an id. Sources without words take nothing. An empty table
    gives an empty plan. Reruns agree, however the rows are partitioned.
    """
    rows = sized.select(_key(source_col).alias("key"), F.col(source_col).cast("string").alias("source"), F.col(size_col).alias("size"), _draw(seed, id_col, size_col).alias("draw"))
    sizes = rows.groupBy("key").agg(F.first("source").alias("source"), F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(ratio), F.lit(MAX_COPIES))
    goals = targets.withColumn("whole", whole).withColumn("bins", F.greatest(F.ceil(F.col("docs") / BIN_ROWS), F.lit(1)).cast("long"))
    goals = goals.withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    goals = materialise(goals.withColumn("share", F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), ratio - F.col("whole")))), few=True)
    goals = materialise(goals.join(source_rates(rows, goals.select("key", "left")), "key"), few=True)
    most, levels = goals.agg(F.max("bins")).first()[0] or 1, 1
    while BIN_PARTS**levels < most:
        levels += 1
    side = maybe_broadcast(goals.select(F.col("key").alias("_key"), F.col("bins").alias("_bins"), F.col("rate").alias("_rate"), F.col("share").alias("_share")))
    ranked = rows.filter("size > 0").select(F.col("key").alias("_key"), F.col("size").alias("_size"), F.col("draw").alias("_draw")).join(side, "_key")
    ranked = ranked.withColumn("_rank", pareto_rank("_draw", "_size", "_rate", "_share")).withColumn("_bin", F.least(F.floor(F.col("_rank") * F.col("_bins")), F.col("_bins") - 1)).drop("_bins", "_rate", "_share")
    filled = _fill(ranked, goals, levels)
    # The smallest document that was not taken comes on top if that is nearer.
    open_ = filled.filter("left > 0").select(*[F.col(c).alias(f"_{c}") for c in filled.columns])
    untaken = ranked.join(maybe_broadcast(open_), "_key").filter((F.col("_size") < 2 * F.col("_left")) & ~F.exists("_steps", lambda x: F.col("_bin").between(x["low"], x["high"] - 1) & (F.col("_size") <= x["most"])))
    found = F.filter("_chosen", lambda x: (x["draw"] == F.col("_draw")) & (x["size"] == F.col("_size")))
    untaken = untaken.withColumn("take", F.when(F.size(found) > 0, found[0]["take"]).otherwise(F.lit(0).cast("long")))
    each = untaken.groupBy("_key", "_draw", "_size").agg(F.count("*").alias("of"), F.first("take").alias("take")).filter("take < of")
    over = each.groupBy(F.col("_key").alias("key")).agg(F.min(F.struct(F.col("_size").alias("size"), F.col("_draw").alias("draw"), "take", "of")).alias("over"))
    others = F.filter("chosen", lambda x: (x["draw"] != F.col("over.draw")) | (x["size"] != F.col("over.size")))
    added = F.concat(others, F.array(F.struct(F.col("over.draw").alias("draw"), F.col("over.size").alias("size"), (F.col("over.take") + 1).alias("take"), F.col("over.of").alias("of"))))
    plan = goals.drop("left").join(filled, "key").join(over, "key", "left").select("key", "source_size", "target", "whole", "rate", "share", "bins", "steps", F.when(F.col("over").isNotNull(), added).otherwise(F.col("chosen")).cast(CHOSEN).alias("chosen"))
    return Mix(materialise(plan, few=True), seed, id_col, source_col)


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 23, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """What the mix takes of each document: ``id_col, size, source_size, target, taken``.

    A null or empty text has no words and takes none. See plan_mix for the rest.
    """
    sized = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")))
    mixed, copies, plan = plan_mix(sized, weights, seed, "id", "source").apply(sized, "size")
    return mixed.select(F.col("id").alias(id_col), "size", F.col(plan)["source_size"].alias("source_size"), F.col(plan)["target"].alias("target"), (F.col("size") * F.col(copies)).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 23, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``.

    Texts without words come as often as all documents of their source do for certain.
    """
    sized = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")))
    plan = plan_mix(sized, weights, seed, "id", "source")
    plan.id_col, plan.source_col = id_col, source_col
    words = unused(docs, 1)[0]
    mixed, copies, _ = plan.apply(docs.withColumn(words, word_count(text_col)), words)
    repeated = mixed.withColumn(words, F.explode(F.array_repeat(F.lit(0), F.col(copies))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
