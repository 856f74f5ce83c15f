"""Spelling variants: words one edit apart, grouped under the far more frequent spelling.

``vocabulary`` counts words in tasks and by a shuffle of (word, count).  Words hold code points up to U+00FF alone, so inside
tasks a word is a string of Latin-1 bytes.

``near_words`` finds all pairs at distance 1.  The first place where two such words differ lies in one half of the shorter
one, and outside of that half they are alike; so each word goes to the lists of words that share its first half, or its
second half, once with words of its own length and the next, and once with words of its own length and the one before.  A
list of too many words is dealt anew by halves of the half that may differ, until one place is left, which bounds a list by
the alphabet.  Within a list the words are sorted; all words that share a prefix are a range, and a query's band of edit
counts (three cells) is carried from the range of a prefix to the ranges of the prefixes that are one longer, so a row is
computed once for all words that share it, and a range whose band has no cell of 1 or less is skipped with all its words.

``families`` follows the forms to their roots by pointer doubling; counts grow tenfold at each step, so there are few.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions_for, saved, split_words, table, text_bytes
from .ranked_search import portions

#: Text bytes that a task counts at once, words in a list that isn't dealt anew, words whose lists are scanned at once.
COUNT_BYTES, LIST_WORDS, SCAN_WORDS = 4 << 20, 2048, 1 << 16
#: A word loses a code point if this number divides its hash.
DIVISOR = 31
#: Words up to so many bytes have their checksums combined by tables; longer ones are rare and hashed one by one.
TABLE_BYTES = 64

#: A-Z become a-z, a-z and the two bytes of U+00C0 to U+00FF stay, everything else is a space.
_LOWER = np.full(256, 0x20, np.uint8)
_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)


def _shift_table() -> np.ndarray:
    """The checksum register after one zero byte, by its low byte (reflected polynomial EDB88320)."""
    entry = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        entry = np.where(entry & 1, (entry >> 1) ^ np.uint32(0xEDB88320), entry >> 1)
    return entry


def split_runs(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of letters of all texts, A-Z lowered, and for each text the range of its runs."""
    text = pc.fill_null((text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text).cast(pa.large_string()), "")
    if not len(text):
        return split_words(text)
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    raw = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]]
    body = _LOWER[raw]
    lead = np.flatnonzero(raw == 0xC3)  # leads the two bytes of each of these letters, and of no other character
    body[lead], body[lead + 1] = 0xC3, raw[lead + 1]
    return split_words(pa.Array.from_buffers(pa.large_string(), len(text), [None, pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(body.tobytes())]))


def _checksums(prefixes: list[bytes], words: list[bytes], doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """crc32(prefix + word) of pairs: the checksum of a join is the first part's, moved on by zero bytes, xor the second's."""
    step = _shift_table()
    lengths = np.array([len(w) for w in words], np.int64)
    own = np.array([zlib.crc32(w) for w in words], np.uint32)
    moved = np.array([zlib.crc32(p) for p in prefixes], np.uint32)
    out = np.zeros(len(doc), np.uint32)
    size = lengths[word]
    by = np.argsort(size, kind="stable")
    bounds = np.searchsorted(size[by], np.arange(TABLE_BYTES + 2))
    for n in range(TABLE_BYTES + 1):
        part = by[bounds[n] : bounds[n + 1]]
        out[part] = moved[doc[part]] ^ own[word[part]]
        moved = step[moved & 0xFF] ^ (moved >> np.uint32(8))
    for i in by[bounds[-1] :]:
        out[i] = zlib.crc32(words[word[i]], zlib.crc32(prefixes[doc[i]]))
    return out


def _counted(part: pa.Table, least: int) -> pa.RecordBatch:
    """(word, n) of a task's texts: words of ``least`` code points or more."""
    flat, offsets = split_runs(part.column("text"))
    doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))
    long = pc.greater_equal(pc.utf8_length(flat), least).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(flat.filter(pa.array(long)))
    words = [w.encode() for w in coded.dictionary.to_pylist()]
    pair = doc[long] * max(1, len(words)) + coded.indices.to_numpy().astype(np.int64)
    pair, times = np.unique(pair, return_counts=True)
    doc, word = pair // max(1, len(words)), pair % max(1, len(words))
    # an id of null is an empty text before the colon
    h = _checksums([("" if i is None else str(i)).encode() + b":" for i in part.column("doc_id").to_pylist()], words, doc, word)
    cut = h % DIVISOR == 0
    counts = np.bincount(word[~cut], times[~cut], len(words)).astype(np.int64)
    found = {w: n for w, n in zip(words, counts.tolist(), strict=True) if n}
    for i, x, n in zip(word[cut].tolist(), h[cut].tolist(), times[cut].tolist(), strict=True):
        text = words[i].decode()
        at = x % len(text)
        if len(text) > least:
            key = (text[:at] + text[at + 1 :]).encode()
            found[key] = found.get(key, 0) + n
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of ``least_length`` code points or more that occur ``least_count`` times or more.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z lowered.  Where 31 divides the checksum h of
    ``<doc_id>:<word>`` the word counts without its code point number h % length.  Null texts have no word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, COUNT_BYTES, 1 << 16):
            yield _counted(part, least_length)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _keys(words: DataFrame) -> DataFrame:
    """Each word with the lists it belongs to: (size, a, b) says where words of the shorter length ``size`` may differ."""
    length = F.length("word")
    shorter = F.explode(F.array(length, length - 1)).alias("size")
    halves = words.select("word", "n", shorter).where("size > 0").withColumn("half", F.floor(F.col("size") / 2).cast("int"))
    window = F.explode(F.array(F.struct(F.lit(0).alias("a"), F.col("half").alias("b")), F.struct(F.col("half").alias("a"), F.col("size").alias("b"))))
    return halves.select("word", "n", "size", window.alias("w")).select("word", "n", "size", "w.a", "w.b").where("b > a")


def _named(rows: DataFrame) -> DataFrame:
    """With the list's name: what its words share, before a and after b (from the end, so that longer words agree)."""
    tail = F.col("size") - F.col("b")
    shared = F.concat(F.expr("left(word, a)"), F.lit("|"), F.when(tail > 0, F.expr("right(word, size - b)")).otherwise(F.lit("")))
    return rows.withColumn("list", F.xxhash64("size", "a", "b", shared))


def _bands(flat: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word) at distance 1 within the lists of sorted words.

    Words are ``flat[start : start + length]``, sorted within each ``group``; queries are the words of their list's ``size``.
    A range is a set of neighbouring words with a common prefix of ``depth``; cell x of its band is the least number of edits
    from that prefix to the query's first depth - 1 + x letters, or 2 for more than one.
    """
    n = len(start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = lambda at, d: np.where(d < length[at], flat[np.minimum(start[at] + d, len(flat) - 1)], 0)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    last = np.append(first[1:], n)
    # common prefix of neighbours in a list, found by depths below
    new_group = np.zeros(n, bool)
    new_group[first] = True
    apart = new_group.copy()  # a word differs from the one before it within the letters so far
    query = np.flatnonzero(length == size)
    of = np.searchsorted(first, query, "right") - 1
    low, high = first[of], last[of]
    band = np.tile(np.array([2, 0, 1], np.int8), (len(query), 1))
    pairs_q, pairs_w = [], []
    depth = 0
    while len(query):
        # words that end here are first in their range, the shortest word being first
        ends = length[low] == depth
        if ends.any():
            q, w = query[ends], low[ends]
            x = length[q] - depth + 1
            hit = (x >= 0) & (x <= 2)
            hit[hit] &= band[ends][hit][np.arange(hit.sum()), x[hit]] == 1
            pairs_q.append(q[hit])
            pairs_w.append(w[hit])
            low = low + ends  # a list has no word twice
        some = low < high
        query, low, high, band = query[some], low[some], high[some], band[some]
        if not len(query):
            break
        # the next letter cuts ranges
        position = np.arange(1, n)
        alive = (length[1:] > depth) | (length[:-1] > depth)
        differ = np.zeros(n - 1, bool)
        differ[alive] = letter(position[alive], depth) != letter(position[alive] - 1, depth)
        apart[1:] |= differ
        heads = np.flatnonzero(apart)
        begin = np.searchsorted(heads, low, "right") - 1  # the head at or before the range's first word
        end = np.searchsorted(heads, high)
        parts = end - begin
        row = np.repeat(np.arange(len(query)), parts)
        number = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts) + begin[row]
        child_low = np.maximum(heads[number], low[row])
        child_high = np.minimum(np.append(heads, n)[number + 1], high[row])
        c = letter(child_low, depth)
        q, old = query[row], band[row]
        # the row below: query letters depth-1, depth and depth+1 against the letter c
        same = [(depth - 1 + x >= 0) & (depth - 1 + x < length[q]) & (letter(q, max(0, depth - 1 + x)) == c) for x in range(3)]
        new = np.empty_like(old)
        for x in range(3):  # cell x: the query's first depth + x letters
            best = np.where(same[x], old[:, x], old[:, x] + 1)  # keep or replace
            if x < 2:
                best = np.minimum(best, old[:, x + 1] + 1)  # the word has a letter more
            if x > 0:
                best = np.minimum(best, new[:, x - 1] + 1)  # the query has a letter more
            beyond = (depth + x < 0) | (depth + x > length[q])
            new[:, x] = np.where(beyond, 2, np.minimum(best, 2))
        keep = new.min(1) <= 1
        query, low, high, band = q[keep], child_low[keep], child_high[keep], new[keep]
        depth += 1
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(pairs_q), join(pairs_w)


def _scan(part: pa.Table) -> pa.RecordBatch:
    """(word, n_near, best_n, best): for each word of whole sorted lists, its near words in the list's part of the pairs."""
    read = lambda: [part.column(c).to_numpy() for c in ("list", "size", "a", "b")]
    lists, size, a, b = read()
    # names are hashes: lists of two windows under one name are lists of their own
    change = np.ones(len(lists), bool)
    change[1:] = (lists[1:] != lists[:-1]) | (size[1:] != size[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    alone = change & np.append(change[1:], True)
    if alone.any():
        part = part.filter(pa.array(~alone))
        lists, size, a, b = read()
        change = change[~alone]
    n = part.column("n").to_numpy()
    words = [w.encode("latin-1") for w in part.column("word").to_pylist()]
    length = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(length) - length
    flat = np.frombuffer(b"".join(words) + b"\0", np.uint8)
    q, w = _bands(flat, start, length, np.cumsum(change), size)
    keep = (length[w] > length[q]) | (w > q)  # each pair once
    q, w = q[keep], w[keep]
    # the first place where they differ says to which list the pair belongs
    first, open_ = np.zeros(len(q), np.int64), np.arange(len(q))
    while len(open_):
        d = first[open_]
        more = d < length[q[open_]]
        more[more] = flat[start[q[open_[more]]] + d[more]] == flat[start[w[open_[more]]] + d[more]]
        open_ = open_[more]
        first[open_] += 1
    mine = (first >= a[q]) & ((first < b[q]) | ((first == size[q]) & (b[q] == size[q])))
    q, w = q[mine], w[mine]
    one, other = np.concatenate([q, w]), np.concatenate([w, q])
    near = np.bincount(one, minlength=len(words))
    # among equal counts the smallest word
    rank = np.argsort(np.argsort(np.array(words, dtype=object), kind="stable"), kind="stable")
    order = np.lexsort((rank[other], -n[other], one))
    one, other = one[order], other[order]
    head = np.ones(len(one), bool)
    head[1:] = one[1:] != one[:-1]
    some, best = one[head], other[head]
    text = part.column("word").combine_chunks()
    return pa.RecordBatch.from_arrays([text.take(pa.array(some)).cast(pa.string()), pa.array(near[some].astype(np.int64)), pa.array(n[best]), text.take(pa.array(best)).cast(pa.string())], names=["word", "n_near", "best_n", "best"])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole lists at a time: rows come sorted by list, and a list that a batch cuts waits for the next one."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        names = held.column("list").to_numpy()
        if len(names) >= SCAN_WORDS:
            whole = int(np.searchsorted(names, names[-1]))
            if whole:
                yield _scan(held.slice(0, whole).combine_chunks())
                held = held.slice(whole)
    if held is not None and held.num_rows:
        yield _scan(held.combine_chunks())


def near_words(words: DataFrame, total: int, list_words: int = LIST_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of the words of ``words`` (word, n; distinct) that have one at distance 1.

    ``best`` is the near word of the largest count, the smallest of them in code-point order.  ``total`` is the number of
    bytes of text behind the words.
    """
    found, rows = None, _named(_keys(words))
    partitions = partitions_for(words.sparkSession, total)
    while True:
        rows = saved(rows)
        sizes = rows.groupBy("list").agg(F.count("*").alias("in_list"), F.max(F.col("b") - F.col("a")).alias("open")).where("in_list > 1")
        sizes = saved(sizes)
        # a list of one word has no pair; crowded lists are dealt anew, but for those with one place left
        crowded = sizes.where((F.col("in_list") > list_words) & (F.col("open") > 1)).select("list")
        more = not crowded.isEmpty()
        # a name occurs in one row of ``sizes``, and the names of small lists are many: both sides are dealt by the name
        quiet = sizes.where((F.col("in_list") <= list_words) | (F.col("open") <= 1)).select("list")
        calm = rows.join(quiet, "list", "left_semi") if more else rows
        dealt = calm.select("list", "size", "a", "b", "word", "n").repartition(partitions, "list").sortWithinPartitions("list", "size", "a", "b", "word")
        part = saved(dealt.mapInArrow(_scanned, "word string, n_near long, best_n long, best string"))
        found = part if found is None else found.unionAll(part)
        if not more:
            break
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b"))))
        again = rows.join(crowded, "list", "left_semi").select("word", "n", "size", halves.alias("w"))
        rows = _named(again.select("word", "n", "size", "w.a", "w.b"))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("m")).select("word", "n_near", (-F.col("m.less")).alias("best_n"), F.col("m.best").alias("best"))


def families(words: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: ``words`` has (word, form), and forms lead to no circle."""
    now = saved(words.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("on"))
        joined = saved(now.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")))
        now = joined.drop("moved")
        if joined.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary.

    ``form`` is the near word (one code point inserted, deleted or replaced) of the largest count, if that is ``ratio`` times
    the word's own or more, else null; ties go to the smallest word.  ``root`` is the end of the chain of forms, the word
    itself where there is none.  Rows alike are counted each; a null or empty text, and an empty table, give no word.
    """
    total = text_bytes(docs, text)
    words = saved(vocabulary(docs, least_length, least_count, doc_id, text))
    near = near_words(words, total)
    formed = F.col("best_n") >= ratio * F.col("n")
    known = saved(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")))
    roots = families(known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: The checksum is a fold over the bytes of '<doc_id>:<word>' with a table of 256 registers.
ORACLE = r"""
WITH RECURSIVE shift(i, x, k) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM shift WHERE k < 8
), crc AS (
  SELECT list(x ORDER BY i) AS t FROM shift WHERE k = 8
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents WHERE text IS NOT NULL
), counted AS (
  SELECT doc_id, run, length(run) AS len, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, len, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
         lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
         lambda r, b: xor(t[(xor(r, b) & 255) + 1], r >> 8)), 4294967295) AS h FROM counted, crc
), cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % len)::INT) || substr(run, (h % len)::INT + 2) ELSE run END AS word, n FROM hashed
), v AS (
  SELECT word, sum(n)::BIGINT AS n, length(word) AS len FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, len + 1)) AS i FROM v)
), near AS (
  SELECT DISTINCT x.word AS one, y.word AS other FROM less x JOIN less y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT l.word, v.word FROM less l JOIN v ON l.rest = v.word
  UNION SELECT v.word, l.word FROM less l JOIN v ON l.rest = v.word
), best AS (
  SELECT one, count(*) AS n_near, max(n) AS best_n, arg_min(other, (-n, other)) AS other FROM near JOIN v ON v.word = other GROUP BY one
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN other END AS form, CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n
  FROM v LEFT JOIN best ON v.word = one
), chain(word, link) AS (
  SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.link WHERE f.form IS NOT NULL
), roots AS (
  SELECT c.word, c.link AS root FROM chain c JOIN forms f ON f.word = c.link WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
