"""Identity map, relation lookup and the small joins around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..operators import identity
from ..session import compact
from .base import query, table
from .corpus import REFS_SQL, W, references

# Overrides from customer: most name the customer's word, some name nothing.
OVERRIDES_SQL = """override_refs AS (SELECT 'm-' || CAST(c_custkey % 40 AS VARCHAR) AS migration_id,
  'data.wordOverrides["' || CAST(c_custkey AS VARCHAR) || '"]' AS source_ref,
  CASE WHEN c_custkey % 2 = 0 THEN 'ja' ELSE 'en' END AS language,
  CASE WHEN c_custkey % 5 = 0 THEN 'gone-' || CAST(c_custkey AS VARCHAR) WHEN c_custkey % 23 = 1 THEN NULL
    ELSE 'w-' || lpad(CAST(c_custkey % 700 AS VARCHAR), 6, '0') END AS word_id, c_custkey AS n FROM customer)"""

IDENTITY_SQL = f"""{W}, {REFS_SQL}, {OVERRIDES_SQL},
inputs AS (SELECT migration_id, source_ref, 'word' AS source_kind, language, word_id, headword, reading,
    is_built_in, sha256(source_ref) AS raw_digest FROM refs
  UNION ALL SELECT migration_id, source_ref, 'override-reference', language, word_id, NULL, NULL, FALSE,
    sha256(source_ref) FROM override_refs),
norm AS (SELECT *, trim(headword) AS raw_headword,
  nullif(lower(trim(regexp_replace(replace(trim(headword), '"', ''), '\\s+', ' ', 'g'))), '') AS nh,
  regexp_matches(word_id, '^[a-z0-9][a-z0-9-]{{2,127}}$') AS legal FROM inputs),
heads AS (SELECT language, lower(trim(headword)) AS hk, count(*) AS n, min(id) AS id FROM words GROUP BY ALL),
id_counts AS (SELECT migration_id, word_id, count(*) AS user_id_count FROM norm
  WHERE source_kind = 'word' AND NOT is_built_in AND legal GROUP BY ALL),
stat AS (SELECT r.*, coalesce(c.user_id_count, 0) AS cnt, h.id AS head_id,
  CASE WHEN r.word_id IN (SELECT id FROM words w WHERE w.language = r.language) THEN 'exact'
    WHEN r.word_id IN (SELECT id FROM words) THEN 'language-conflict'
    WHEN h.n = 1 THEN 'candidate' WHEN h.n > 1 THEN 'ambiguous' ELSE 'not-found' END AS status
  FROM norm r LEFT JOIN heads h ON h.language = r.language AND h.hk = lower(r.raw_headword)
  LEFT JOIN id_counts c ON c.migration_id = r.migration_id AND c.word_id = r.word_id),
ruled AS (SELECT *, CASE WHEN word_id IS NULL AND nh IS NULL THEN 'empty'
    WHEN source_kind <> 'word' AND word_id IS NULL THEN 'orphan' WHEN status = 'exact' THEN 'exact'
    WHEN source_kind = 'word' AND NOT is_built_in AND legal AND cnt = 1 AND status <> 'language-conflict' THEN 'preserved'
    WHEN source_kind <> 'word' THEN 'loose' WHEN is_built_in AND status = 'candidate' THEN 'heuristic'
    WHEN is_built_in THEN 'built-in' WHEN nh IS NULL THEN 'empty' ELSE 'generated' END AS rule,
  CASE WHEN word_id IS NULL THEN 'USER_ID_GENERATED' WHEN status = 'language-conflict' THEN 'CANONICAL_ID_CONFLICT_GENERATED'
    WHEN cnt > 1 THEN 'USER_ID_DUPLICATE_GENERATED' WHEN legal THEN 'USER_ID_GENERATED' ELSE 'INVALID_USER_ID' END AS cause,
  'user-v1-' || substr(sha256(language || '|' || coalesce(nh, '') || '|' || coalesce(reading, '') || '||||' || raw_digest), 1, 24)
    AS base_id FROM stat),
entries AS (SELECT migration_id, source_ref, source_kind, language, word_id AS raw_word_id, raw_headword,
  nh AS normalized_headword, raw_digest,
  CASE WHEN rule IN ('exact', 'preserved', 'heuristic', 'generated') THEN 'mapped' ELSE 'quarantined' END AS outcome,
  CASE rule WHEN 'empty' THEN 'invalid' WHEN 'orphan' THEN 'invalid' WHEN 'exact' THEN 'canonical-exact'
    WHEN 'preserved' THEN 'user-id-preserved' WHEN 'generated' THEN 'user-id-generated' ELSE
    CASE status WHEN 'candidate' THEN 'canonical-headword-candidate' WHEN 'ambiguous' THEN 'canonical-headword-ambiguous'
      WHEN 'language-conflict' THEN 'canonical-language-conflict' ELSE 'not-found' END END AS resolution,
  CASE rule WHEN 'exact' THEN 'CANONICAL_ID_MATCH' WHEN 'preserved' THEN 'USER_ID_PRESERVED'
    WHEN 'heuristic' THEN 'CANONICAL_HEADWORD_HEURISTIC' WHEN 'generated' THEN cause WHEN 'empty' THEN 'EMPTY_IDENTITY'
    WHEN 'orphan' THEN 'OVERRIDE_ORPHAN' WHEN 'loose' THEN 'OVERRIDE_ORPHAN' ELSE
    CASE status WHEN 'candidate' THEN 'CANONICAL_CONTEXT_REQUIRED' WHEN 'ambiguous' THEN 'CANONICAL_HEADWORD_AMBIGUOUS'
      WHEN 'language-conflict' THEN 'CANONICAL_LANGUAGE_CONFLICT' ELSE 'CANONICAL_NOT_FOUND' END END AS reason,
  CASE rule WHEN 'exact' THEN word_id WHEN 'preserved' THEN word_id WHEN 'heuristic' THEN head_id
    WHEN 'generated' THEN base_id END AS target_word_id,
  CASE WHEN rule IN ('exact', 'heuristic') THEN 'canonical' WHEN rule IN ('preserved', 'generated') THEN 'user' END AS target_kind
  FROM ruled),
word_entries AS (SELECT *, lower(trim(regexp_replace(raw_headword, '\\s+', ' ', 'g'))) AS head_key
  FROM entries WHERE source_kind = 'word'),
id_any AS (SELECT migration_id, raw_word_id, count(DISTINCT target_word_id) AS n, min(target_word_id) AS target
  FROM word_entries WHERE raw_word_id IS NOT NULL GROUP BY ALL),
id_lang AS (SELECT migration_id, raw_word_id, language, count(DISTINCT target_word_id) AS n, min(target_word_id) AS target
  FROM word_entries WHERE raw_word_id IS NOT NULL GROUP BY ALL),
head_any AS (SELECT migration_id, head_key, count(DISTINCT target_word_id) AS n, min(target_word_id) AS target
  FROM word_entries WHERE head_key IS NOT NULL GROUP BY ALL),
head_lang AS (SELECT migration_id, head_key, language, count(DISTINCT target_word_id) AS n, min(target_word_id) AS target
  FROM word_entries WHERE head_key IS NOT NULL GROUP BY ALL)"""


def identity_inputs(spark, sf):
    words = references(spark, sf).select(
        "migration_id", "source_ref", F.lit("word").alias("source_kind"), "language", "word_id",
        "headword", "reading", "is_built_in", F.sha2("source_ref", 256).alias("raw_digest"),
    )
    k = F.col("c_custkey")
    overrides = table(spark, sf, "customer").select(
        F.concat(F.lit("m-"), (k % 40).cast("string")).alias("migration_id"),
        F.concat(F.lit('data.wordOverrides["'), k.cast("string"), F.lit('"]')).alias("source_ref"),
        F.lit("override-reference").alias("source_kind"),
        F.when(k % 2 == 0, "ja").otherwise("en").alias("language"),
        F.when(k % 5 == 0, F.concat(F.lit("gone-"), k.cast("string")))
        .when(k % 23 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("w-"), F.lpad((k % 700).cast("string"), 6, "0"))).alias("word_id"),
    ).withColumn("raw_digest", F.sha2("source_ref", 256))
    return words, overrides


def entries(spark, sf):
    return identity.identity_map(
        identity.union_inputs(*identity_inputs(spark, sf)), b.words(spark, sf)
    )


@query("identity_map", IDENTITY_SQL + """
SELECT source_ref, source_kind, language, outcome, resolution, reason,
  coalesce(target_word_id, '') AS target_word_id, coalesce(target_kind, '') AS target_kind,
  coalesce(normalized_headword, '') AS normalized_headword FROM entries""")
def identity_map(spark, sf):
    return entries(spark, sf).select(
        "source_ref", "source_kind", "language", "outcome", "resolution", "reason",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("target_word_id", "target_kind", "normalized_headword")],
    )


@query("identity_inputs", IDENTITY_SQL + """
SELECT source_kind, migration_id, count(*) AS n FROM inputs GROUP BY ALL""")
def identity_input_counts(spark, sf):
    both = identity.union_inputs(*identity_inputs(spark, sf))
    return both.groupBy("source_kind", "migration_id").agg(F.count(F.lit(1)).alias("n"))


@query("identity_counts", IDENTITY_SQL + """
SELECT migration_id, count(*) AS source, count(*) FILTER (WHERE outcome = 'mapped') AS mapped,
  count(*) FILTER (WHERE outcome <> 'mapped') AS quarantined,
  count(*) FILTER (WHERE target_kind = 'canonical') AS canonical,
  count(*) FILTER (WHERE target_kind = 'user') AS user_words FROM entries GROUP BY migration_id""")
def identity_counts(spark, sf):
    return identity.identity_counts(entries(spark, sf))


# Relations: one per order line (line numbers repeat, so lines are grouped first).
LINES_SQL = """lines AS (SELECT l_orderkey AS ok, l_linenumber AS ln, o_custkey AS ck,
  'm-' || CAST(o_custkey % 40 AS VARCHAR) AS migration_id, l_orderkey * 10 + l_linenumber AS k,
  CASE WHEN o_custkey % 2 = 0 THEN 'ja' ELSE 'en' END AS language,
  CASE (l_orderkey + l_linenumber) % 9 WHEN 0 THEN 'lost-' || CAST(l_orderkey AS VARCHAR)
    WHEN 1 THEN any_value(p_name || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR))
    WHEN 2 THEN 'dup-' || CAST(o_custkey AS VARCHAR)
    ELSE 'w-' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') END AS raw_word_id,
  sum(l_quantity) AS qty, max(l_discount) AS discount, min(l_returnflag) AS flag, min(l_linestatus) AS status,
  max(l_shipdate) AS shipdate, count(*) AS copies
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = o_custkey
  GROUP BY l_orderkey, l_linenumber, o_custkey)"""

RELATION_SQL = """related AS (SELECT x.*, CASE WHEN a.raw_word_id IS NOT NULL
    THEN CASE WHEN il.n = 1 THEN il.target END WHEN hl.n = 1 THEN hl.target END AS target_word_id
  FROM {source} x
  LEFT JOIN id_any a ON a.migration_id = x.migration_id AND a.raw_word_id = x.raw_word_id
  LEFT JOIN id_lang il ON il.migration_id = x.migration_id AND il.raw_word_id = x.raw_word_id AND il.language = x.language
  LEFT JOIN head_lang hl ON hl.migration_id = x.migration_id AND hl.language = x.language
    AND hl.head_key = lower(trim(regexp_replace(x.raw_word_id, '\\s+', ' ', 'g'))))"""

RELATED_SQL = f"{IDENTITY_SQL}, {LINES_SQL}, {RELATION_SQL.format(source='lines')}"


def lines(spark, sf):
    l, o, p = (table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    # The headword of a part is a key of its lines: a first value of texts per line would make Spark sort all lines.
    heads = p.groupBy("p_partkey").agg(
        F.first(F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string"))).alias("headword"), F.count(F.lit(1)).alias("parts"),
    )
    joined = l.join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(
        heads, F.col("p_partkey") == F.col("o_custkey")
    )
    grouped = joined.groupBy("l_orderkey", "l_linenumber", "o_custkey", "headword").agg(
        F.sum(F.col("l_quantity") * F.col("parts")).alias("qty"), F.max("l_discount").alias("discount"),
        F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"),
        F.max("l_shipdate").cast("timestamp").alias("shipdate"), F.sum("parts").alias("copies"),
    )
    case = (F.col("l_orderkey") + F.col("l_linenumber")) % 9
    cust = F.col("o_custkey")
    return grouped.select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").cast("bigint").alias("ln"),
        cust.alias("ck"), F.concat(F.lit("m-"), (cust % 40).cast("string")).alias("migration_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"),
        F.when(cust % 2 == 0, "ja").otherwise("en").alias("language"),
        F.when(case == 0, F.concat(F.lit("lost-"), F.col("l_orderkey").cast("string")))
        .when(case == 1, F.col("headword"))
        .when(case == 2, F.concat(F.lit("dup-"), cust.cast("string")))
        .otherwise(F.concat(F.lit("w-"), F.lpad(cust.cast("string"), 6, "0"))).alias("raw_word_id"),
        "qty", "discount", "flag", "status", "shipdate", "copies",
    )


def word_index(spark, sf):
    return identity.WordIndex(entries(spark, sf))


@query("word_relations", RELATED_SQL + """
SELECT k, migration_id, coalesce(target_word_id, '') AS target_word_id FROM related""")
def word_relations(spark, sf):
    # Stored: the references are counted first, and the rows get their word in a second scan.
    rows = compact(lines(spark, sf).select("k", "migration_id", "language", "raw_word_id"))
    found = identity.resolve_relations(rows, word_index(spark, sf))
    return found.select(
        "k", "migration_id", F.coalesce("target_word_id", F.lit("")).alias("target_word_id")
    )
