"""Temperature mixing of sources.

A source with the share p of all tokens gets a weight in proportion to p^a.  The exponent a in [0, 1] is bisected: entropy
falls and repetition falls as a rises, so the largest a whose entropy meets the target is taken, or, if that would repeat
some source more often than allowed, the smallest a within the repetition limit.  Every round of the bisection evaluates a
whole set of exponents in one aggregate over the table of sources, which is never collected.

The weights are realised as budgeted block permutations: a source is passed as often as its budget has whole epochs, and
for the rest its blocks (documents by hash) are put in the order of a keyed hash and taken until the budget is met; only
the block in which it ends is ordered document by document.  Hot sources have more blocks, not larger ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

#: The entropy to reach, as a share of that of equal weights; how often a document may come at most.
TARGET, REPEATS = 0.97, 2.0
SEED = 17
BLOCK_TOKENS = 1 << 20
#: Ranges of a source's permutation, as a power of two, and sources whose plan is broadcast at most.
BIN_BITS, BROADCAST_SOURCES = 10, 100_000
#: Exponents tried at once, and rounds: 64^5 steps of the unit interval.
ARMS, ROUNDS = 64, 5


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, target: float, repeats: float) -> float:
    """The exponent for a table (source, tokens > 0): see above.  1 keeps the sources as they are."""
    total, most, least, count = sources.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens"), F.count("*")).first()
    if not count or most == least:
        return 1.0
    lo, hi = 0.0, 1.0  # the target is met at lo, and not at hi unless hi is the answer
    for turn in range(ROUNDS):
        tried = [lo + (hi - lo) * i / ARMS for i in range(ARMS + 1)]
        power = sources.select(F.explode(F.array(*map(F.lit, range(ARMS + 1)))).alias("i"), (F.col("tokens") / float(total)).alias("p"))
        power = power.withColumn("w", F.pow("p", F.element_at(F.array(*map(F.lit, tried)), F.col("i") + 1)))
        # the entropy of w / sum(w)
        sums = power.groupBy("i").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("l"))
        met = sums.where(F.log("z") - F.col("l") / F.col("z") >= F.lit(target) * F.log(F.lit(float(count)))).agg(F.max("i")).first()[0]
        met = 0 if met is None else met
        if turn == 0 and met == ARMS:
            lo = 1.0
            break
        lo, hi = tried[met], tried[min(met + 1, ARMS)]
    # a source comes (largest / its tokens)^(1 - a) times if the largest one comes once; the smallest source most often
    a, b = lo, 1.0
    worst = most / least
    if worst ** (1 - a) <= repeats:
        return a
    for _ in range(60):
        mid = (a + b) / 2
        a, b = (a, mid) if worst ** (1 - mid) <= repeats else (mid, b)
    return b


def weights(sources: DataFrame, target: float, repeats: float, budget: float | None = None) -> DataFrame:
    """(source, tokens, weight, epochs): normalised weights, and how often each source's tokens come.

    Without a budget the least one is taken at which the largest source, and so each source, comes once at least.
    """
    some = saved(sources.where("tokens > 0"))
    a = exponent(some, target, repeats)
    whole = some.agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a))).alias("z"), F.max("tokens").alias("most")).first()
    if not whole.z:
        return some.withColumn("weight", F.lit(0.0)).withColumn("epochs", F.lit(1.0))
    weight = F.pow(F.col("tokens").cast("double"), F.lit(a)) / F.lit(whole.z)
    spent = budget if budget is not None else whole.most * whole.z / float(whole.most) ** a
    return some.withColumn("weight", weight).withColumn("epochs", F.round(F.lit(float(spent)) * F.col("weight") / F.col("tokens"), 9))


def mixed(docs: DataFrame, target: float = TARGET, repeats: float = REPEATS, budget: float | None = None, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, source, n_tokens, weight (of its source), epochs, copies (how often it comes).

    Tokens are words.  A null source is a source of its own; a source without tokens keeps its documents once.  Rows that
    repeat an id are documents of their own.  A budget below the tokens of a source takes a part of it, by the permutation.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("n_tokens"), F.xxhash64(text).alias("digest"))
    rows = saved(rows)
    sizes = saved(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    share = weights(sizes, target, repeats, budget)
    plan = sizes.join(share.drop("tokens"), sizes["source"].eqNullSafe(share["source"]), "left").select(sizes["source"], "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("epochs", F.lit(1.0)).alias("epochs"))
    plan = plan.withColumn("blocks", F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int") + 1).withColumn("whole", F.floor("epochs").cast("int"))
    plan = saved(plan.withColumn("rest", F.floor((F.col("epochs") - F.col("whole")) * F.col("tokens"))))

    named = plan.withColumnRenamed("source", "s")
    if plan.count() <= BROADCAST_SOURCES:  # more than that, and no source can hold most rows of a shuffle's task for long
        named = F.broadcast(named)
    placed = rows.join(named, rows["source"].eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int"))
    placed = saved(placed.select("doc_id", "source", "n_tokens", "digest", "weight", "epochs", "whole", "rest", "block"))
    filled = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.first("rest").alias("rest"))
    filled = saved(filled.withColumn("turn", F.xxhash64(F.lit(seed), "source", "block")))
    # the permutation in two steps: BINS ranges of the hash, and the blocks of a range
    filled = filled.withColumn("bin", F.shiftright("turn", 64 - BIN_BITS))
    bins = filled.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"))
    bins = bins.withColumn("earlier", F.sum("in_bin").over(Window.partitionBy("source").orderBy("bin")) - F.col("in_bin")).drop("in_bin")
    bins = bins.toDF("s", "b", "earlier")
    order = Window.partitionBy("source", "bin").orderBy("turn", "block")
    filled = filled.withColumn("inner", F.sum("size").over(order) - F.col("size"))
    filled = filled.join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).drop("s", "b")
    filled = filled.withColumn("room", F.col("rest") - F.col("earlier") - F.col("inner")).where("room > 0 and size > 0")
    # blocks within the budget as a whole, and the one in which it ends
    filled = saved(filled.select("source", F.col("block").alias("b"), (F.col("room") >= F.col("size")).alias("all"), "room"))
    key = (F.col("source").eqNullSafe(F.col("s"))) & (F.col("block") == F.col("b"))
    marked = placed.join(filled.withColumnRenamed("source", "s"), key, "left").drop("s", "b")
    ending = marked.where("not all")
    within = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "digest")
    ending = ending.withColumn("more", (F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("room")).cast("int"))
    others = marked.where("all is null or all").withColumn("more", F.coalesce("all", F.lit(False)).cast("int"))
    return others.unionByName(ending).select("doc_id", "source", "n_tokens", "digest", "weight", "epochs", (F.col("whole") + F.col("more")).alias("copies"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mixture has it; the columns are those of ``docs``."""
    doc_id, text, source = (options.get(k, k) for k in ("doc_id", "text", "source"))
    copies = mixed(docs, **options).select(F.struct("doc_id", "source", "digest").alias("key"), "copies")
    # rows alike in id, source and text may have been given different numbers of copies: they share the sum
    copies = saved(copies.groupBy("key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")))
    key = F.struct(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.xxhash64(text).alias("digest"))
    # a row is one column, whatever the names of its own
    joined = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(copies, "key")
    once = joined.where("rows = 1").withColumn("n", F.col("copies"))
    alike = joined.where("rows > 1")
    number = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row")))
    alike = alike.withColumn("n", F.floor(F.col("copies") / F.col("rows")) + (number <= F.col("copies") % F.col("rows")).cast("int"))
    every = once.unionByName(alike).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("turn"))
    return every.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).drop("digest")
