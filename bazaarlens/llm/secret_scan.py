"""Scan for secrets, with multipart credential linking, in DataFrame operations only.

Three base kinds are reported wherever they stand.  Three weak kinds (identifiers, secrets without a telling name, endpoints)
are reported only as parts of a credential: they are joined by intervals, within a scope (lines without a blank line between
them) and a reach, to the parts that complement them.

One pass over the texts gives the lengths of matches and of what lies between them; running sums turn these into places.  The
interval join is an equi-join on cells of the text, and a cell holds a bounded number of parts, so its work follows the
number of parts, whatever a document holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table


def _any_case(words: str) -> str:
    """The letters of a pattern of plain words in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: What may stand between a name and its value.
_IS = r"""["']?\x20*[:=]\x20*["']?"""
#: By kind, in the order of reports: the pattern, and one that matches in every text with a sound match.
_ASSIGN = f"({_any_case('password|passwd|secret|token|api_?key')}){_IS}([A-Za-z0-9+/_.=-]+)"
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"
PATTERNS = {
    "assign": (_ASSIGN, _ASSIGN[:-2] + "{6,})"),
    "access": ("AKIA[A-Z0-9]{16,}",) * 2,
    "hex": ("[0-9a-f]{24,}",) * 2,
    "identifier": (f"(?:{_any_case('access_?key_?id|client_?id|user_?name|user|login|account')}){_IS}[A-Za-z0-9@._+-]{{3,}}|{_EMAIL}",) * 2,
    "secret": (f"(?:{_any_case('passphrase|pwd|credential|private_?key|signature')}){_IS}[A-Za-z0-9+/_.=-]{{6,}}|[A-Za-z0-9+/]{{32,}}={{0,2}}",) * 2,
    "endpoint": (f"[a-z][a-z0-9+.]{{1,20}}://[A-Za-z0-9.:_/@%?&=-]{{4,}}|(?:{_any_case('hostname|host|endpoint|server')}){_IS}[A-Za-z0-9.:_-]{{3,}}",) * 2,
}
KINDS = list(PATTERNS)
BASE = ("assign", "access", "hex")
#: What a part of a credential is.
ROLES = {"identifier": ("access", "identifier"), "secret": ("assign", "hex", "secret"), "endpoint": ("endpoint",)}
#: A blank line ends a scope; its number follows those of the kinds.
BREAK, BREAK_KIND = r"\n[\x20\t\r]*\n", len(KINDS)
#: Code points that may lie between linked parts, and code points of a cell.
REACH, CELL = 200, 256
#: The least length of an assigned value.
VALUE = 6


def _numbers(*kinds: str) -> list[int]:
    return [KINDS.index(k) for k in kinds]


def _matches(text: Column, number: int, pattern: str) -> Column:
    """Of each match: kind, number, code points since the last match, its own, and whether it is sound."""
    sound = (lambda hit: F.length(F.regexp_extract(hit, pattern, 2)) >= VALUE) if number == KINDS.index("assign") else lambda hit: F.lit(True)
    sizes = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size"), sound(hit).alias("sound")))
    numbered = F.transform(sizes, lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["sound"].alias("sound")))
    return F.filter(numbered, lambda x: x["size"].isNotNull())


def _found(rows: DataFrame) -> DataFrame:
    """``rows`` (with body) and the matches of each body.

    Each pattern is looked for once.  Named values need a colon or an equals sign; weak identifiers and endpoints are looked
    for only where a secret part is, and blank lines only where a weak part is.
    """
    has = lambda kind: F.col("body").rlike(PATTERNS[kind][1])
    with_sign = rows.withColumn("sign", F.col("body").rlike("[:=]"))
    named, plain = PATTERNS["secret"][1].rsplit("|", 1)
    weak_secret = F.col("body").rlike(plain) | (F.col("sign") & F.col("body").rlike(named))
    flags = with_sign.select("*", (F.col("sign") & has("assign")).alias("has_assign"), has("access").alias("has_access"), has("hex").alias("has_hex"), weak_secret.alias("has_secret"))
    flags = flags.withColumn("part", reduce(lambda a, b: a | b, [F.col(f"has_{k}") for k in ROLES["secret"]]))
    flags = flags.select("*", *[(F.col("part") & has(k)).alias(f"has_{k}") for k in ("identifier", "endpoint")])
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,sound:boolean>>")
    parts = [F.when(F.col(f"has_{k}"), _matches(F.col("body"), n, PATTERNS[k][0])).otherwise(none) for n, k in enumerate(KINDS)]
    weak = F.col("has_secret") | F.col("has_identifier") | F.col("has_endpoint")
    breaks = F.when(weak, _matches(F.col("body"), BREAK_KIND, BREAK)).otherwise(none)
    return flags.select(*[c for c in rows.columns if c != "body"], F.concat(*parts, breaks).alias("found"))


def _placed(rows: DataFrame) -> DataFrame:
    """(doc, digest, kind, start, end) of the sound matches; rows alike in id and text count once."""
    each = rows.select("doc", "digest", F.inline("found")).dropDuplicates(["doc", "digest", "kind", "i"])
    so_far = F.sum(F.col("gap").cast("long") + F.col("size")).over(Window.partitionBy("doc", "digest", "kind").orderBy("i"))
    return each.withColumn("end", so_far).where("sound").select("doc", "digest", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def _linked(parts: DataFrame, reach: int, cell: int) -> DataFrame:
    """The weak parts that complementary parts stand by, without those that a base match covers."""
    weak, base = _numbers("identifier", "secret", "endpoint"), _numbers(*BASE)
    earlier = Window.partitionBy("doc", "digest").orderBy("start", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    with_weak = parts.where(F.col("kind").isin(weak)).select("doc", "digest").distinct()
    scoped = parts.join(with_weak, ["doc", "digest"], "left_semi").withColumn("scope", F.count(F.when(F.col("kind") == BREAK_KIND, 1)).over(earlier)).where(F.col("kind") != BREAK_KIND)
    scoped = saved(scoped)
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))
    own = scoped.where(F.col("kind").isin(weak)).withColumn("cell", cells(F.col("start") - reach, F.col("end") + reach))
    other = scoped.select("doc", "digest", "scope", F.col("kind").alias("kind_"), F.col("start").alias("start_"), F.col("end").alias("end_"), cells(F.col("start"), F.col("end")).alias("cell"))
    near = own.join(other, ["doc", "digest", "scope", "cell"]).where((F.col("start_") <= F.col("end") + reach) & (F.col("start") <= F.col("end_") + reach))
    covers = F.col("kind_").isin(base) & (F.col("start_") < F.col("end")) & (F.col("start") < F.col("end_"))
    by = {role: F.max(F.col("kind_").isin(_numbers(*kinds))).alias(f"by_{role}") for role, kinds in ROLES.items()}
    flags = near.groupBy("doc", "digest", "kind", "start", "end").agg(F.max(covers).alias("covered"), *by.values())
    identifier, secret, endpoint = (F.col("kind") == n for n in weak)
    whole = (identifier & F.col("by_secret")) | (secret & (F.col("by_identifier") | F.col("by_endpoint"))) | (endpoint & F.col("by_secret") & F.col("by_identifier"))
    return flags.where(whole & ~F.col("covered")).select("doc", "digest", "kind", "start", "end")


def secret_spans(docs: DataFrame, reach: int = REACH, cell: int = CELL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): for every row the spans found, (kind, start, end) by start, then kind; ends are exclusive, in code points.

    assign, access and hex are always reported.  A weak secret is reported if an identifier (or access id) or an endpoint is
    in its scope within ``reach``; a weak identifier if a secret (assign, hex or weak) is; an endpoint if both are.  Weak parts
    that overlap a base match are not reported again.  A null or empty text has no span.  Rows alike in id and text have the
    same result each, a null id is kept.  Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key = [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(body).alias("digest")]
    rows = saved(_found(docs.select(F.col(doc_id).alias("doc_id"), *key, body.alias("body"))))
    some = rows.where(F.size("found") > 0)
    parts = saved(_placed(some))
    spans = parts.where(F.col("kind").isin(_numbers(*BASE))).unionByName(_linked(parts, reach, cell))
    # a document's spans are at most its text's length
    listed = spans.groupBy("doc", "digest").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("listed"))
    name = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform("listed", lambda x: F.struct(F.get(name, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    joined = some.select("doc_id", "doc", "digest").join(listed, ["doc", "digest"], "left").select("doc_id", F.coalesce(named, none).alias("spans"))
    return joined.unionByName(rows.where(F.size("found") == 0).select("doc_id", none.alias("spans")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SPLITS = " UNION ALL ".join(f"SELECT doc_id, text, {n} AS kind, string_split_regex(text, {_sql(p)}) AS gaps, regexp_extract_all(text, {_sql(p)}) AS hits FROM d" for n, p in enumerate([p for p, _ in PATTERNS.values()] + [BREAK]))
_IN = {role: ", ".join(map(str, _numbers(*kinds))) for role, kinds in ROLES.items()}

ORACLE = f"""
WITH d AS (
  SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents
), s AS (
  {_SPLITS}
), u AS (
  SELECT doc_id, text, kind, unnest(range(1, len(hits) + 1)) AS i, gaps, hits FROM s
), m AS (
  SELECT doc_id, text, kind, hits[i] AS hit, sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY doc_id, text, kind ORDER BY i) AS e FROM u
), p AS (
  SELECT doc_id, text, kind, (e - length(hit))::BIGINT AS s, e::BIGINT AS e FROM m
  WHERE kind <> 0 OR length(regexp_extract(hit, {_sql(_ASSIGN)}, 2)) >= {VALUE}
), c AS (
  SELECT p.*, (SELECT count(*) FROM p b WHERE b.kind = {BREAK_KIND} AND b.doc_id = p.doc_id AND b.text = p.text AND b.e <= p.s) AS scope FROM p WHERE kind <> {BREAK_KIND}
), f AS (
  SELECT w.doc_id, w.text, w.kind, w.s, w.e, bool_or(o.kind < 3 AND o.s < w.e AND w.s < o.e) AS covered, bool_or(o.kind IN ({_IN["identifier"]})) AS by_i,
         bool_or(o.kind IN ({_IN["secret"]})) AS by_s, bool_or(o.kind IN ({_IN["endpoint"]})) AS by_e
  FROM c w JOIN c o ON w.doc_id = o.doc_id AND w.text = o.text AND w.scope = o.scope AND o.s <= w.e + {REACH} AND w.s <= o.e + {REACH}
  WHERE w.kind >= 3 GROUP BY ALL
), a AS (
  SELECT doc_id, text, kind, s, e FROM c WHERE kind < 3
  UNION ALL SELECT doc_id, text, kind, s, e FROM f
  WHERE NOT covered AND ((kind = 3 AND by_s) OR (kind = 4 AND (by_i OR by_e)) OR (kind = 5 AND by_s AND by_i))
), n AS (
  SELECT *, ['assign', 'access', 'hex', 'identifier', 'secret', 'endpoint'][kind + 1] || ':' || s || ':' || e AS span FROM a
), g AS (
  SELECT doc_id, text, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
         string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind) AS spans FROM n GROUP BY ALL
)
SELECT x.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents x LEFT JOIN g ON x.doc_id = g.doc_id AND coalesce(x.text, '') = g.text
"""
