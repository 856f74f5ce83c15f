"""Deletion of repeated line runs by a suffix array over line numbers, in DataFrame operations only.

Every line with a word gets a rank; the sequence of ranks of a document is a string, and its positions are suffixes.  By
prefix doubling, round k ranks the prefixes of 2^k lines: the pair (rank at i, rank at i + 2^(k-1)) is ranked by a range
partitioning of the distinct pairs plus the partitions' offsets.  Only positions whose prefix occurs twice go on, and no
round goes beyond the longest run that can matter.

Suffixes that share their first l lines are an interval of the suffix array; two ranks, of the first and of the last 2^k of
those lines, name it.  For each position l is the least number of lines, forwards and backwards, that hold ``min_words``
words.  A run of that many words that occurs earlier is a union of such intervals, so the later members' lines are the
maximal repeated runs, and they are deleted; the earliest copy (smallest document, then line) stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Words that a repeated run must have at least.
MIN_WORDS = 10
#: A line or interval is hot if it has more than this share of all lines (1 / HOT_SHARE), so there are at most HOT_SHARE hot ones.
HOT_SHARE = 10_000


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, digest, line, words, name): the lines that have words, numbered from 0 without gaps; ``at`` counts all lines."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(body).alias("digest"), body.alias("body"))
    every = rows.select("doc", "digest", F.posexplode(F.split("body", "\n")).alias("at", "body"))
    words = F.regexp_count("body", F.lit(r"[^\x20\x09-\x0D]+"))
    return every.select("doc", "digest", "at", words.cast("long").alias("words"), F.unhex(F.md5(F.col("body").cast("binary"))).alias("name")).where("words > 0")


def _ranked(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows with their rank, from 1: ranges of the order, and each range's offset."""
    placed = saved(pairs.repartitionByRange(*columns).withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").count()
    # one row per partition
    offsets = sizes.withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count")).select("part", "before")
    number = F.row_number().over(Window.partitionBy("part").orderBy(*columns))
    return placed.withColumn("n", number).join(F.broadcast(offsets), "part").select(*columns, (F.col("before") + F.col("n")).alias("rank"))


def _reach(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc, digest, line, ahead, back): the least numbers of lines from here, and up to here, with ``min_words`` words.

    A line i stands between the word counts before it and after it; the end of the run is the first such count that is
    large enough.  Counts and questions are sorted together, so that the last count seen answers a question.
    """
    doc = ["doc", "digest"]
    after = F.sum("words").over(Window.partitionBy(*doc).orderBy("line"))
    counted = lines.withColumn("after", after).withColumn("before", F.col("after") - F.col("words"))
    edge = lambda value, index, kind, line: counted.select(*doc, value.alias("value"), index.alias("edge"), F.lit(kind).alias("kind"), line.alias("line"))
    none = F.lit(None).cast("long")
    line = F.col("line").cast("long")
    ahead = edge(F.col("after"), line + 1, 0, none).unionAll(edge(F.col("before") + min_words, none, 1, line))
    falling = Window.partitionBy(*doc).orderBy(F.desc("value"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = ahead.withColumn("end", F.last("edge", True).over(falling)).where("kind = 1").select(*doc, "line", (F.col("end") - F.col("line")).alias("ahead"))
    back = edge(F.col("before"), line, 0, none).unionAll(edge(F.col("after") - min_words, none, 1, line))
    rising = Window.partitionBy(*doc).orderBy("value", "kind").rowsBetween(Window.unboundedPreceding, 0)
    back = back.withColumn("begin", F.last("edge", True).over(rising)).where("kind = 1").select(*doc, "line", (F.col("line") + 1 - F.col("begin")).alias("back"))
    return ahead.join(back, [*doc, "line"])


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, digest, at): the lines to delete, by the document's id, a hash of its text and the line's number there."""
    doc = ["doc", "digest"]
    # rows alike in id and text are one document here
    found = saved(_lines(docs, doc_id, text).dropDuplicates([*doc, "at"]))
    numbered = found.withColumn("line", F.row_number().over(Window.partitionBy(*doc).orderBy("at")) - 1)
    total = found.count()
    names = saved(numbered.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"))
    # a line that occurs once is in no repeated run: it has rank 0 and ends every match
    ranks = saved(_ranked(names.select("name"), ["name"]))
    # the most frequent lines, at most HOT_SHARE of them, are broadcast
    hot = ranks.join(F.broadcast(names.where(F.col("n") * HOT_SHARE > total).select("name")), "name", "left_semi")
    known = numbered.join(F.broadcast(hot), "name", "left")
    rare = known.where("rank is null").drop("rank").join(ranks, "name", "left")
    level = saved(known.where("rank is not null").unionByName(rare).select(*doc, "at", "line", "words", F.coalesce("rank", F.lit(0)).cast("long").alias("rank")))
    reach = saved(_reach(level.select(*doc, "line", "words"), min_words))
    # the least runs of enough words, by where they begin: those that a line begins and those that a line ends
    begin = reach.where("ahead > 0").select(*doc, F.col("line").cast("long").alias("from"), F.col("ahead").alias("lines"))
    end = reach.where("back > 0").select(*doc, (F.col("line") + 1 - F.col("back")).cast("long").alias("from"), F.col("back").alias("lines"))
    runs = begin.unionAll(end).distinct()
    now = level.where("rank > 0").select(*doc, F.col("line").cast("long").alias("line"), "rank")
    now = saved(now)  # positions whose prefix of ``size`` lines occurs twice
    size, gone = 1, None
    while True:
        runs = saved(runs.where(F.col("lines") >= size).join(now.select(*doc, F.col("line").alias("from"), F.col("rank").alias("first")), [*doc, "from"]))
        # the intervals of a length in [size, 2 * size): the ranks of two prefixes of this size name them
        named = runs.where(F.col("lines") < 2 * size).withColumn("line", F.col("from") + F.col("lines") - size)
        named = named.join(now.withColumnRenamed("rank", "last"), [*doc, "line"])
        interval, place = ["lines", "first", "last"], F.struct(*doc, "from")
        named = saved(named)
        least = saved(named.groupBy(*interval).agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1"))
        # intervals of very many members, at most HOT_SHARE of them, are broadcast: their members don't meet in a task
        hot = F.col("n") * HOT_SHARE > total
        known = named.join(F.broadcast(least.where(hot).drop("n")), interval, "left")
        rare = known.where("least is null").drop("least").join(least.where(~hot).drop("n"), interval)
        later = saved(known.where("least is not null").unionByName(rare).where(place != F.col("least")).select(*doc, "from", "lines"))
        gone = later if gone is None else gone.unionAll(later)
        runs = runs.where(F.col("lines") >= 2 * size).drop("first")
        if runs.isEmpty():
            break
        other = now.select(*doc, (F.col("line") - size).alias("line"), F.col("rank").alias("rank2"))
        pairs = now.withColumnRenamed("rank", "rank1").join(other, [*doc, "line"])
        twice = pairs.groupBy("rank1", "rank2").agg(F.count("*").alias("n")).where("n > 1").select("rank1", "rank2")
        ranks = saved(_ranked(twice, ["rank1", "rank2"]))
        now = saved(pairs.join(ranks, ["rank1", "rank2"]).select(*doc, "line", "rank"))
        size *= 2
    lines = gone.select(*doc, F.explode(F.sequence(F.col("from"), F.col("from") + F.col("lines") - 1)).alias("line")).distinct()
    return level.select(*doc, "at", F.col("line").cast("long").alias("line")).join(lines, [*doc, "line"], "left_semi").select(*doc, "at")


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """The rows of ``docs`` with the later copies of repeated line runs deleted from their text.

    A run of lines is deleted if it has ``min_words`` words in all, and the same lines (those without a word apart) follow
    each other earlier: in a document of smaller id, or further up.  Lines end at a line feed.  A null text stays null; a
    text of which every line goes is empty.  Rows alike in id and text count once and have one result; a null id counts as
    the smallest.  An empty table gives an empty result.  Other columns stay as they are, whatever their names.  ``counts``
    adds n_removed, in place of a column of that name.
    """
    key = [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))), F.xxhash64(F.coalesce(F.col(text), F.lit("")))]
    gone = repeated_lines(docs, min_words, doc_id, text).groupBy("doc", "digest").agg(F.sort_array(F.collect_list("at")).alias("gone_at"))
    others = [c for c in docs.columns if c != text and not (counts and c == "n_removed")]
    row = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    joined = docs.select(key[0].alias("doc"), key[1].alias("digest"), F.col(text).alias("body"), row.alias("row")).join(gone, ["doc", "digest"], "left")
    lines = F.split("body", "\n")
    # a map of the deleted numbers: looking one up doesn't depend on how many there are
    marks = F.map_from_arrays("gone_at", F.transform("gone_at", lambda x: F.lit(True)))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.map_contains_key(marks, i)), "\n")
    columns = {c: F.col("row").getField(f"c{i}") for i, c in enumerate(others)}
    columns[text] = F.when(F.col("gone_at").isNull(), F.col("body")).otherwise(kept)
    names = [c for c in docs.columns if c in columns]
    if counts:
        columns["n_removed"] = F.when(F.col("gone_at").isNull(), 0).otherwise(F.size("gone_at")).cast("long")
        names.append("n_removed")
    return joined.select(*[columns[c].alias(c) for c in names])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = drop_repeated_lines(docs, counts=True)
    return kept.select("doc_id", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS body,
         unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), w AS (
  SELECT doc_id, pos, body, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS words FROM l
), n AS (
  SELECT doc_id, pos, body, words, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS line,
         sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM w WHERE words > 0
), a AS (
  SELECT x.doc_id, x.line AS f, min(y.line) AS t FROM n x JOIN n y ON x.doc_id = y.doc_id AND y.line >= x.line
    AND y.after >= x.after - x.words + 10 GROUP BY 1, 2
), b AS (
  SELECT x.doc_id, max(y.line) AS f, x.line AS t FROM n x JOIN n y ON x.doc_id = y.doc_id AND y.line <= x.line
    AND x.after - y.after + y.words >= 10 GROUP BY 1, 3
), r AS (
  SELECT DISTINCT doc_id, f, t FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
), s AS (
  SELECT r.doc_id, r.f, r.t, string_agg(n.body, chr(10) ORDER BY n.line) AS run
  FROM r JOIN n ON r.doc_id = n.doc_id AND n.line BETWEEN r.f AND r.t GROUP BY ALL
), o AS (
  SELECT doc_id, f, t, row_number() OVER (PARTITION BY run ORDER BY doc_id, f) AS k FROM s
), gone AS (
  SELECT DISTINCT n.doc_id, n.pos FROM o JOIN n ON o.doc_id = n.doc_id AND n.line BETWEEN o.f AND o.t WHERE k > 1
)
SELECT w.doc_id, count(g.pos) AS n_removed,
       sha256(coalesce(string_agg(w.body, chr(10) ORDER BY w.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos GROUP BY w.doc_id
"""
