"""Corpus integrity, lookup and listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..bindings import WORDS_SQL
from ..operators import contracts, corpus
from .base import query, table

W = f"WITH {WORDS_SQL}"

# Legacy word references from orders: right, foreign, unknown, missing, odd and repeated ids.
REFS_SQL = """refs AS (
  SELECT 'm-' || CAST(o_custkey % 40 AS VARCHAR) AS migration_id,
    'data.userWords[' || CAST(o_orderkey AS VARCHAR) || ']' AS source_ref,
    CASE WHEN (o_custkey % 2 = 0) <> (o_orderkey % 8 = 3) THEN 'ja' ELSE 'en' END AS language,
    CASE o_orderkey % 8 WHEN 4 THEN 'user-' || CAST(o_orderkey AS VARCHAR)
      WHEN 5 THEN NULL WHEN 6 THEN 'BAD ID ' || CAST(o_orderkey AS VARCHAR)
      WHEN 7 THEN 'dup-' || CAST(o_custkey AS VARCHAR)
      ELSE 'w-' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') END AS word_id,
    CASE WHEN o_orderkey % 24 = 6 THEN NULL WHEN o_orderkey % 16 = 5
      THEN '  "' || upper(p_name || ' ' || p_type) || '"  ' || CAST(p_size AS VARCHAR) || ' '
      ELSE p_name || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR) END AS headword,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'yomi ' || p_name END AS reading,
    CASE WHEN o_orderkey % 10 < 3 THEN TRUE ELSE FALSE END AS is_built_in,
    CAST(o_orderkey AS BIGINT) AS n
  FROM orders JOIN part ON p_partkey = o_custkey)"""


def references(spark, sf):
    o, p = table(spark, sf, "orders"), table(spark, sf, "part")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    head = F.concat_ws(" ", "p_name", "p_type")
    size = F.col("p_size").cast("string")
    case = key % 8
    word_id = (
        F.when(case == 4, F.concat(F.lit("user-"), key.cast("string")))
        .when(case == 5, F.lit(None).cast("string"))
        .when(case == 6, F.concat(F.lit("BAD ID "), key.cast("string")))
        .when(case == 7, F.concat(F.lit("dup-"), cust.cast("string")))
        .otherwise(F.concat(F.lit("w-"), F.lpad(cust.cast("string"), 6, "0")))
    )
    headword = (
        F.when(key % 24 == 6, F.lit(None).cast("string"))
        .when(
            key % 16 == 5,
            F.concat(F.lit('  "'), F.upper(head), F.lit('"  '), size, F.lit(" ")),
        )
        .otherwise(F.concat_ws(" ", head, size))
    )
    return o.join(p, F.col("p_partkey") == cust).select(
        F.concat(F.lit("m-"), (cust % 40).cast("string")).alias("migration_id"),
        F.concat(F.lit("data.userWords["), key.cast("string"), F.lit("]")).alias("source_ref"),
        F.when((cust % 2 == 0) != (case == 3), "ja").otherwise("en").alias("language"),
        word_id.alias("word_id"),
        headword.alias("headword"),
        F.when(key % 9 != 0, F.concat(F.lit("yomi "), "p_name")).alias("reading"),
        (key % 10 < 3).alias("is_built_in"),
        key.cast("bigint").alias("n"),
    )


RESOLVE_SQL = """heads AS (SELECT language, lower(trim(headword)) AS hk, count(*) AS n, min(id) AS id
    FROM words GROUP BY ALL),
resolved AS (SELECT r.*,
  CASE WHEN r.word_id IN (SELECT id FROM words w WHERE w.language = r.language) THEN 'exact'
    WHEN r.word_id IN (SELECT id FROM words) THEN 'language-conflict'
    WHEN h.n = 1 THEN 'candidate' WHEN h.n > 1 THEN 'ambiguous' ELSE 'not-found' END AS corpus_status,
  h.id AS head_id
  FROM refs r LEFT JOIN heads h ON h.language = r.language AND h.hk = lower(trim(r.headword)))"""


@query("resolved_references", f"""{W}, {REFS_SQL}, {RESOLVE_SQL}
SELECT source_ref, corpus_status, coalesce(CASE corpus_status WHEN 'exact' THEN word_id
  WHEN 'candidate' THEN head_id END, '') AS corpus_id FROM resolved""")
def resolved_references(spark, sf):
    found = corpus.resolve_references(references(spark, sf), b.words(spark, sf))
    return found.select(
        "source_ref", "corpus_status", F.coalesce("corpus_id", F.lit("")).alias("corpus_id")
    )


@query("corpus_of_language", f"""{W}
SELECT id, headword, meaning FROM words WHERE language = 'ja'""")
def corpus_of_language(spark, sf):
    return b.words(spark, sf).where("language = 'ja'").select("id", "headword", "meaning")


@query("word_contract", f"""{W}
SELECT id, array_to_string(list_filter([
  CASE WHEN language = 'ja' AND reading IS NULL THEN 'READING_REQUIRED' END,
  CASE WHEN language = 'en' AND phonetic IS NULL THEN 'PHONETIC_REQUIRED' END,
  CASE WHEN len(list_distinct(tags)) <> len(tags) THEN 'TAG_DUPLICATE' END],
  lambda x: x IS NOT NULL), ',') AS violations FROM words""")
def word_contract(spark, sf):
    checked = contracts.check_words(b.words(spark, sf))
    return checked.select("id", F.array_join("violations", ",").alias("violations"))


# One manifest per nation, its counts taken from the corpus and wrong for some nations.
MANIFEST_SQL = """counted AS (SELECT count(*) FILTER (WHERE language = 'ja') AS ja,
  count(*) FILTER (WHERE language = 'en') AS en FROM words),
manifests AS (SELECT n_nationkey, n_name AS id, ja + CASE WHEN n_nationkey % 3 = 1 THEN 1 ELSE 0 END AS ja,
  en, ja + en AS total, CASE WHEN n_nationkey % 4 = 2 THEN 'fr' ELSE 'en' END AS second
  FROM nation, counted)"""


def manifests(spark, sf):
    counts = b.words(spark, sf).agg(
        F.count_if(F.col("language") == "ja").alias("ja"),
        F.count_if(F.col("language") == "en").alias("en"),
    )
    ja, en = counts.select("ja").scalar(), counts.select("en").scalar()
    n = table(spark, sf, "nation")
    wrong = F.when(F.col("n_nationkey") % 3 == 1, 1).otherwise(0)
    return n.select(
        F.col("n_name").alias("id"),
        (ja + en).alias("total_word_count"),
        F.array(
            F.struct(F.lit("ja").alias("language"), (ja + wrong).cast("bigint").alias("word_count")),
            F.struct(
                F.when(F.col("n_nationkey") % 4 == 2, "fr").otherwise("en").alias("language"),
                en.cast("bigint").alias("word_count"),
            ),
        ).alias("language_counts"),
        F.sha2("n_name", 256).alias("word_ids_sha256"),
        F.when(F.col("n_nationkey") % 7 == 3, "none")
        .otherwise(F.sha2("n_name", 256)).alias("content_sha256"),
    )


@query("manifest_contract", f"""{W}, {MANIFEST_SQL}
SELECT id, array_to_string(list_filter([
  CASE WHEN second <> 'en' THEN 'LANGUAGES_INVALID' END,
  CASE WHEN ja + en <> total THEN 'TOTAL_MISMATCH' END,
  CASE WHEN n_nationkey % 7 = 3 THEN 'DIGEST_INVALID' END], lambda x: x IS NOT NULL), ',') AS violations
FROM manifests""")
def manifest_contract(spark, sf):
    checked = contracts.check_manifests(manifests(spark, sf))
    return checked.select("id", F.array_join("violations", ",").alias("violations"))


@query("corpus_language_counts", f"""{W}
SELECT language, CAST(CASE language WHEN 'ja' THEN 5906 ELSE 3922 END AS BIGINT) AS expected,
  count(*) AS actual, count(*) = CASE language WHEN 'ja' THEN 5906 ELSE 3922 END AS matches
FROM words GROUP BY language""")
def corpus_language_counts(spark, sf):
    target = F.explode(
        F.create_map(
            F.lit("ja"), F.lit(corpus.ACCEPTANCE_TARGET["ja"]).cast("bigint"),
            F.lit("en"), F.lit(corpus.ACCEPTANCE_TARGET["en"]).cast("bigint"),
        )
    ).alias("language", "word_count")
    expected = spark.range(1).select(target)
    return corpus.language_counts(b.words(spark, sf), expected)


@query("corpus_duplicates", f"""{W}, twice AS (SELECT language, id FROM words
  UNION ALL SELECT language, id FROM words WHERE tags[1] = tags[2])
SELECT language, id, count(*) AS n FROM twice GROUP BY ALL HAVING count(*) > 1""")
def corpus_duplicates(spark, sf):
    words = b.words(spark, sf).select("language", "id", "tags")
    twice = words.unionByName(words.where("tags[0] = tags[1]"))
    return corpus.duplicate_identities(twice)


SET_DIGEST = "sha256(" + " || '|' || ".join(
    ["CAST(count(*) AS VARCHAR)"]
    + [f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8)]
) + ")"


def _tree_sql(source, group):
    """The tree of hashes over the leaves ``h`` of a named query, as the text of further ones."""
    g = "".join(f"{c}, " for c in group)
    return f"""{source}_r AS (SELECT {g}substr(h, 1, 5) AS a, sha256(string_agg(h || ':' || n, chr(10) ORDER BY h)) AS h
  FROM (SELECT {g}h, CAST(count(*) AS VARCHAR) AS n FROM {source} GROUP BY {g}h) GROUP BY {g}a),
{source}_p AS (SELECT {g}substr(a, 1, 2) AS t, sha256(string_agg(a || ':' || h, chr(10) ORDER BY a)) AS h FROM {source}_r GROUP BY {g}t),
{source}_d AS (SELECT {g}sha256(string_agg(t || ':' || h, chr(10) ORDER BY t)) AS digest FROM {source}_p GROUP BY ALL)"""


_BODY = "'language', language, 'id', id, 'headword', headword, 'reading', reading, 'phonetic', phonetic, 'part_of_speech', part_of_speech, 'meaning', meaning, 'level', level, 'difficulty', difficulty"
_LEAF = "json_object(" + ", ".join(
    f"'p{i}', {c}" for i, c in enumerate(["language", "id", "headword", "reading", "phonetic", "part_of_speech", "meaning", "level", "CAST(difficulty AS VARCHAR)", "CAST(to_json(tags) AS VARCHAR)"])
) + ")"


def _leaves_sql(name, rows):
    return f"""{name}_ids AS (SELECT language, sha256(CAST(json_object('p0', language, 'p1', id) AS VARCHAR)) AS h FROM {rows}),
{name}_all AS (SELECT language, sha256(CAST({_LEAF} AS VARCHAR)) AS h FROM {rows})"""


@query("corpus_digests", f"""{W}, {_leaves_sql("w", "words")}, {_tree_sql("w_ids", ["language"])}, {_tree_sql("w_all", ["language"])},
n AS (SELECT language, count(*) AS words FROM words GROUP BY language)
SELECT language, words, i.digest AS ids_digest, c.digest AS content_digest FROM n JOIN w_ids_d i USING (language) JOIN w_all_d c USING (language)""")
def corpus_digests(spark, sf):
    return corpus.corpus_digests(b.words(spark, sf))


def stated_digests(words):
    """Both forms in one row."""
    trees = corpus.whole_digests(words)
    return corpus.manifest_digests(words).select("*", *[trees.select(c).scalar().alias(c) for c in trees.columns])


def _variant(words, kind):
    """The corpus with one word that differs."""
    first = F.col("id") == "w-000014"
    if kind == "renamed":
        return words.withColumn("id", F.when(first, "w-x").otherwise(F.col("id")))
    if kind == "changed":
        return words.withColumn("meaning", F.when(first, F.concat("meaning", F.lit("."))).otherwise(F.col("meaning")))
    if kind == "emptied":  # an empty text in place of a missing one
        return words.withColumn("phonetic", F.when(first, "").otherwise(F.col("phonetic")))
    return words


_VARIANTS = {
    "same": "SELECT * FROM words", "renamed": "SELECT * REPLACE (CASE WHEN id = 'w-000014' THEN 'w-x' ELSE id END AS id) FROM words",
    "changed": "SELECT * REPLACE (CASE WHEN id = 'w-000014' THEN meaning || '.' ELSE meaning END AS meaning) FROM words",
    "emptied": "SELECT * REPLACE (CASE WHEN id = 'w-000014' THEN '' ELSE phonetic END AS phonetic) FROM words",
}
_KINDS = ["same", "renamed", "changed", "emptied", "counts", "target", "tree"]


def integrity_manifests(spark, sf):
    """One manifest per nation: some state the digests of another corpus, wrong counts or a target that is missed."""
    words = b.words(spark, sf)
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (k % len(_KINDS) + 1).cast("int"))
    forms = None
    for name in _VARIANTS:
        one = stated_digests(_variant(words, name)).withColumn("form", F.lit(name))
        forms = one if forms is None else forms.unionByName(one)
    counts = words.agg(F.count_if(F.col("language") == "ja").alias("ja"), F.count_if(F.col("language") == "en").alias("en"))
    ja, en = counts.select("ja").scalar(), counts.select("en").scalar()
    off = F.when(F.col("kind") == "counts", 1).otherwise(0)
    count = "struct<language:string,word_count:bigint>"
    rows = n.select(F.col("n_name").alias("id"), kind.alias("kind"), F.when(kind.isin(*_VARIANTS), kind).otherwise("same").alias("form"))
    return rows.join(forms, "form").withColumn("ja", ja).withColumn("en", en).select(
        "id", (F.col("ja") + F.col("en")).alias("total_word_count"),
        F.array(F.struct(F.lit("ja").alias("language"), (F.col("ja") + off).alias("word_count")).cast(count), F.struct(F.lit("en").alias("language"), F.col("en").alias("word_count")).cast(count)).alias("language_counts"),
        "word_ids_sha256", "content_sha256", "ids_tree", F.when(F.col("kind") == "tree", "x").otherwise(F.col("content_tree")).alias("content_tree"),
        F.when(F.col("kind") == "target", corpus.ACCEPTANCE_TARGET["total"]).otherwise(F.col("ja") + F.col("en")).cast("bigint").alias("target_total"),
        F.array(F.struct(F.lit("ja").alias("language"), F.col("ja").alias("word_count")).cast(count), F.struct(F.lit("en").alias("language"), F.col("en").alias("word_count")).cast(count)).alias("target_counts"),
    )


@query("corpus_integrity", f"""{W}, kinds AS (SELECT n_name AS id, {_KINDS}[n_nationkey % {len(_KINDS)} + 1] AS kind FROM nation),
t AS (SELECT count(*) AS n FROM words)
SELECT id, n AS expected_total, n AS actual_total, kind <> 'counts' AS languages_match, CAST(0 AS BIGINT) AS duplicates,
  CASE kind WHEN 'renamed' THEN 'IDS_DIGEST,CONTENT_DIGEST,IDS_TREE,CONTENT_TREE' WHEN 'changed' THEN 'CONTENT_DIGEST,CONTENT_TREE' WHEN 'emptied' THEN 'CONTENT_DIGEST,CONTENT_TREE'
    WHEN 'counts' THEN 'TARGET_LANGUAGES,LANGUAGE_MISMATCH' WHEN 'target' THEN 'TARGET_TOTAL' WHEN 'tree' THEN 'CONTENT_TREE' ELSE '' END AS errors, kind = 'same' AS valid FROM kinds, t""")
def corpus_integrity(spark, sf):
    """A corpus that is as stated, and others of which one word, one empty text, a count or the target differs."""
    found = corpus.integrity_report(b.words(spark, sf), integrity_manifests(spark, sf))
    return found.withColumn("errors", F.array_join("errors", ","))


@query("manifest_digests", f"""{W}, {_leaves_sql("w", "words")}, {_tree_sql("w_ids", [])}, {_tree_sql("w_all", [])}
SELECT sha256(string_agg(language || ':' || id, chr(10) ORDER BY language || ':' || id)) AS word_ids_sha256,
  sha256('[' || string_agg(CAST(json_object({_BODY}, 'tags', tags) AS VARCHAR), ',' ORDER BY language || ':' || id) || ']') AS content_sha256,
  (SELECT digest FROM w_ids_d) AS ids_tree, (SELECT digest FROM w_all_d) AS content_tree FROM words""")
def manifest_digests(spark, sf):
    return stated_digests(b.words(spark, sf))


@query("corpus_levels", f"{W} SELECT language, level, count(*) AS words FROM words GROUP BY ALL")
def corpus_levels(spark, sf):
    return corpus.levels(b.words(spark, sf))


@query("content_search", f"""{W} SELECT id FROM words WHERE level = 'Brand#17' AND
  (contains(lower(headword), 'red') OR contains(lower(coalesce(reading, '')), 'red')
   OR contains(lower(coalesce(phonetic, '')), 'red') OR contains(lower(meaning), 'red'))""")
def content_search(spark, sf):
    return corpus.search(b.words(spark, sf), " Red ", "Brand#17").select("id")


@query("content_search_page", f"""{W} SELECT id FROM words WHERE
  (contains(lower(headword), 'widget') OR contains(lower(coalesce(reading, '')), 'widget')
   OR contains(lower(coalesce(phonetic, '')), 'widget') OR contains(lower(meaning), 'widget'))
ORDER BY id LIMIT 50""")
def content_search_page(spark, sf):
    found = corpus.search(b.words(spark, sf), "widget")
    return found.select("id").orderBy("id").limit(50)


@query("ring_options", f"""{W}, placed AS (SELECT language, id,
  row_number() OVER (PARTITION BY language ORDER BY id) - 1 AS place,
  count(*) OVER (PARTITION BY language) AS n FROM words),
asked AS (SELECT language, id AS item_id, off AS "offset", (place + off) % n AS place
  FROM placed, (SELECT unnest([0, 2, 4, 6]) AS off))
SELECT a.language, a.item_id, CAST(a."offset" AS BIGINT) AS "offset", p.id AS option_id
FROM asked a JOIN placed p ON p.language = a.language AND p.place = a.place""")
def ring_options(spark, sf):
    ring = corpus.ring_options(b.words(spark, sf).select("language", "id"), ["language"], ["id"])
    return ring.withColumn("offset", F.col("offset").cast("bigint"))


@query("starter_selection", f"""{W}, starters AS (
  SELECT 'w-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS id FROM supplier)
SELECT s.id, coalesce(w.headword, '') AS headword,
  w.id IS NOT NULL AND w.phonetic IS NOT NULL AS complete
FROM starters s LEFT JOIN words w ON w.id = s.id AND w.language = 'en'""")
def starter_selection(spark, sf):
    ids = table(spark, sf, "supplier").select(
        F.concat(F.lit("w-"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("id")
    )
    found = corpus.starter_selection(b.words(spark, sf), ids, "en")
    return found.select("id", F.coalesce("headword", F.lit("")).alias("headword"), "complete")
