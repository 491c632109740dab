r"""Secret scans with corpus-wide ownership frequency: candidate values are hashed and counted by distinct repositories
and owners, which separates widely copied examples from owner-specific, live-looking credentials. DataFrame functions only.

Base kinds are matched leftmost and non-overlapping, and their spans always stay. The method adds spans of two more
kinds (`provider`: published key prefixes, `random`: long mixed strings), but only where the value is owner-specific.
A value is a widely copied example when at least `common` owners hold it, or when at least two owners hold it in twice as many
repositories as `common`; what one owner alone holds is owner-specific, in however many repositories. `owner` is what
stands before the first slash of a repository's name. Positions are code points, ends exclusive.

Defined cases: a null text is empty and has no spans; a null repository is one of its own; ties of start are ordered by
kind as listed; repeated rows get the same result each; an empty table gives an empty result; extra columns
are carried along by redact() and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .common import Scratch, broadcast_if_small, table


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
#: kind, pattern, group that holds the value, least length of that group
BASE = [
    ("assign", rf"""({KEYWORDS})["']?[\x20]*[:=][\x20]*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
ADDED = [
    ("provider", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 0, 1),
    ("random", r"(?<![A-Za-z0-9+/_-])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{24,}", 0, 24),
]
KINDS = [k for k, *_ in BASE + ADDED]


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind, end, value>>: what lies between matches and the matches themselves tell the places."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    zipped = F.arrays_zip(between.alias("between"), found.alias("found"), value.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["between"])
        end = start + F.length(F.coalesce(x["found"], F.lit("")))
        one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), x["value"].alias("value"))
        keep = x["found"].isNotNull() & (F.length(x["value"]) >= least)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(none)


def candidates(docs: DataFrame, repo: str, scratch: Scratch) -> DataFrame:
    """(doc_id, row_key, row_key2, repo, base, added) of docs(doc_id, text, repo): the spans with hashes of the values. `repo` may be an
    array of all repositories that hold a row; its text is scanned once and gives a row for each of them."""
    hashed = lambda a: F.transform(a, lambda s: F.struct(s["start"], s["kind"], s["end"], F.xxhash64(s["value"]).alias("hash")))
    found = lambda kinds: hashed(F.array_sort(F.concat(*[spans_of(F.col("whole"), *x) for x in kinds])))
    scanned = docs.withColumn("whole", F.coalesce("text", F.lit(""))).select("doc_id", F.col(repo).alias("held"), *[c.alias(f"text_key{k}") for k, c in enumerate(text_keys())], found(BASE).alias("base"), found(ADDED).alias("added"))
    if isinstance(docs.schema[repo].dataType, ArrayType):
        scanned = scanned.withColumn("held", F.explode("held"))
    keys = [F.xxhash64(f"text_key{k}", "held").alias(name) for k, name in enumerate(("row_key", "row_key2"))]
    return scratch.save(scanned.select("doc_id", *keys, F.coalesce(F.col("held").cast("string"), F.lit("")).alias("repo"), "base", "added"), "candidates")


def text_keys() -> list[Column]:
    return [F.xxhash64(F.lit(k), "doc_id", "text") for k in (1, 2)]


def row_keys(repo: str) -> list[Column]:
    """128 bits of hash over what decides a row's result; equal rows share them."""
    return [F.xxhash64(key, repo).alias(name) for key, name in zip(text_keys(), ("row_key", "row_key2"))]


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repos, owners): how many distinct repositories and owners hold each candidate value."""
    owner = F.regexp_extract("repo", "^([^/]*)", 1)
    held = found.select(F.explode(F.concat("base", "added")).alias("s"), "repo").select("s.hash", "repo", owner.alias("owner")).distinct()
    repos = held.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return repos.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"))


def copied_widely(common: int) -> Column:
    """By both counts of a value."""
    return (F.col("owners") >= common) | ((F.col("owners") >= 2) & (F.col("repos") >= 2 * common))


def scan(docs: DataFrame, repo: str = "source", common: int = 3) -> tuple[DataFrame, DataFrame]:
    """The candidates of each row, and for rows with any the spans that stay:
    (row_key, row_key2, spans array<struct<start, kind, end, live>>, most_repos, most_owners), the last two of all its values."""
    scratch = Scratch(docs.sparkSession, "secrets")
    found = candidates(docs, repo, scratch)
    often = ownership(found).select("hash", (~copied_widely(common)).alias("live"), "repos", "owners")
    each = found.where((F.size("base") > 0) | (F.size("added") > 0)).select("row_key", "row_key2", F.explode(F.concat("base", "added")).alias("s")).distinct()
    each = each.select("row_key", "row_key2", "s.start", "s.kind", "s.end", "s.hash").join(often, "hash")
    each = each.where((F.col("kind") < len(BASE)) | F.col("live"))
    spans = each.groupBy("row_key", "row_key2").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("spans"), F.max("repos").alias("most_repos"), F.max("owners").alias("most_owners"))
    return found, scratch.save(spans, "spans")


def _joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, repo: str = "source", common: int = 3) -> DataFrame:
    """Counts, spans and verdicts for every row of docs(doc_id, text, repo)."""
    found, spans = scan(docs, repo, common)
    out = found.join(broadcast_if_small(spans, 100_000), ["row_key", "row_key2"], "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>"))
    many = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [many(k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(BASE)]
    live = F.size(F.filter(spans, lambda s: s["live"])).cast("long")
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(spans).alias("spans"), live.alias("n_live"), (F.size(spans) - live).cast("long").alias("n_example"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("most_repos", "most_owners")])


def redact(docs: DataFrame, repo: str = "source", common: int = 3, mark: str = "[SECRET]") -> DataFrame:
    """docs with each owner-specific secret replaced by `mark`; examples that are widely copied stay. n_chars follows."""
    _, spans = scan(docs, repo, common)
    live = spans.select("row_key", "row_key2", F.filter("spans", lambda s: s["live"]).alias("spans")).where(F.size("spans") > 0)
    live = Scratch(docs.sparkSession, "redact").save(live, "live")
    keys = row_keys(repo)
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keys).join(broadcast_if_small(live, 100_000), ["row_key", "row_key2"], "left")
    text = F.col("row.text")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        upto = F.greatest(acc["at"], s["end"])
        return F.struct(upto.alias("at"), F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    new = {"text": F.when(F.col("spans").isNull(), text).otherwise(clean)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length(clean).cast("long"))
    return joined.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def shared(docs: DataFrame) -> DataFrame:
    """Every document with the repositories that hold it: of each of its doc_id % 6 + 1 owners, five of each owner with an even number:
    values of one owner, of two owners in many repositories, and of many owners."""
    repos = lambda k: F.transform(F.array(*map(F.lit, "abcde")), lambda r: F.concat(F.lit("o"), k.cast("string"), F.lit("/"), r))
    held = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("doc_id") % 6), lambda k: F.when(k % 2 == 0, repos(k)).otherwise(F.slice(repos(k), 1, 1)))
    return docs.select("doc_id", "text", F.flatten(held).alias("source"))


def secrets_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator where values are shared between repositories and owners, summed for each document."""
    got = report(shared(table(spark, sf_dir, "documents")))
    return got.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("n_live", "n_example")], *[F.max(c).alias(c) for c in ("most_repos", "most_owners", "spans")])


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


SHARED = """documents AS (SELECT doc_id, text, unnest(flatten(list_transform(range(0, doc_id % 6 + 1), lambda k: list_transform(CASE WHEN k % 2 = 0 THEN ['a', 'b', 'c', 'd', 'e'] ELSE ['a'] END, lambda r: 'o' || k || '/' || r)))) AS source FROM main.documents), """


def _sql(view: str = "") -> str:
    kinds = []
    for k, (kind, pattern, group, least) in enumerate(BASE + ADDED):
        if "(?<!" in pattern:  # DuckDB's patterns know no look-around: maximal runs, then the conditions
            pattern = "[A-Za-z0-9+/_-]{24,}"
        pattern = pattern.replace("'", "''").replace("\\x20", " ")
        mixed = "AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')" if kind == "random" else ""
        kinds.append(f"""SELECT doc_id, source, {k} AS k, '{kind}' AS kind, s, e, v FROM (
  SELECT doc_id, source, coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0) AS s, s + length(f[i]) AS e, g[i] AS v FROM (
    SELECT doc_id, source, b, f, g, unnest(range(1, len(f) + 1)) AS i FROM (
      SELECT doc_id, source, string_split_regex(t, '{pattern}') AS b, regexp_extract_all(t, '{pattern}') AS f, regexp_extract_all(t, '{pattern}', {group}) AS g FROM t)))
  WHERE length(v) >= {least} {mixed}""")
    n = len(BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{kind}" for k, (kind, *_) in enumerate(BASE))
    key = "doc_id, source" if view else "doc_id"
    line = "string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY s, k)"
    return f"""
WITH {view}t AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
c AS ({' UNION ALL '.join(kinds)}),
o AS (SELECT v, count(DISTINCT source) AS repos, count(DISTINCT regexp_extract(source, '^([^/]*)', 1)) AS owners, NOT (owners >= 3 OR (owners >= 2 AND repos >= 6)) AS live FROM c GROUP BY v),
x AS (SELECT c.*, o.live, repos, owners FROM c JOIN o USING (v) WHERE k < {n} OR live),
y AS (SELECT {key}, {counts}, {line} FILTER (WHERE k < {n}) AS base, {line} AS spans,
  count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_example, max(repos) AS most_repos, max(owners) AS most_owners FROM x GROUP BY {key})
SELECT d.doc_id, {', '.join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(most_repos, 0) AS most_repos, coalesce(most_owners, 0) AS most_owners
FROM documents d LEFT JOIN y ON d.doc_id = y.doc_id{' AND d.source = y.source' if view else ''}
"""


SQL = _sql()
SQL_SHARED = f"SELECT doc_id, CAST(sum(n_live) AS BIGINT) AS n_live, CAST(sum(n_example) AS BIGINT) AS n_example, max(most_repos) AS most_repos, max(most_owners) AS most_owners, max(spans) AS spans FROM ({_sql(SHARED)}) GROUP BY 1"
