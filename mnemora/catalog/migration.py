"""Reading, previewing, checking and activating migrations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions.hashing import fnv1a_hex
from ..operators import contracts, corpus, domains, outcomes, preview, sampling, verification
from ..session import durable, shared_dir
from ..sources import backups as bk
from ..sources import devices, redact, store
from .base import query, table
from .corpus import SET_DIGEST, W
from .domains import (
    CARD_SQL, STUDY_DISPOSED, STUDY_SQL, card_result, no_nulls, stored, stored_entries, study_records, word_records, word_result,
)
from .identity import IDENTITY_SQL
from .plans import FNV_SQL

# --- backups: one per customer --------------------------------------------------------------

BACKUP_SQL = """bk AS (SELECT c_custkey AS k, 'b-' || CAST(c_custkey AS VARCHAR) AS migration_id, c_mktsegment AS seg,
    CASE WHEN c_custkey % 11 = 3 THEN 'INVALID_JSON' WHEN c_custkey % 13 = 5 THEN 'UNKNOWN_FORMAT' ELSE '' END AS error,
    CASE WHEN c_custkey % 10 = 0 THEN 'legacy-v4' ELSE 'modern' END AS format FROM customer),
good AS (SELECT * FROM bk WHERE error = ''),
ow AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx FROM orders),
recs AS (
  SELECT migration_id, 'data.db[' || CAST(idx AS VARCHAR) || ']' AS source_ref, 'words' AS domain,
    CASE WHEN o_orderkey % 17 = 0 THEN 'number' ELSE 'object' END AS value_type FROM good JOIN ow USING (k)
  UNION ALL SELECT migration_id, 'data.folders[' || CAST(i AS VARCHAR) || ']', 'folders', 'string' FROM good, (SELECT unnest([0, 1]) AS i)
  UNION ALL SELECT migration_id, 'data.folderLangs["' || seg || '"]', 'folders', 'string' FROM good
  UNION ALL SELECT migration_id, CASE WHEN k % 7 = 0 THEN 'data.stars' ELSE 'data.stars[0]' END, 'favorites', 'string' FROM good
  UNION ALL SELECT migration_id, 'data.mtGroupClears["g ' || seg || '"]', 'groupProgress', 'number' FROM good
  UNION ALL SELECT migration_id, 'preferences["theme"]', 'preferences', 'string' FROM good
  UNION ALL SELECT migration_id, 'topLevel["extra"]', 'unknown', 'object' FROM good
  UNION ALL SELECT migration_id, CASE format WHEN 'modern' THEN 'data["odd"]' ELSE 'topLevel["odd"]' END, 'unknown', 'array' FROM good)"""


def backups(spark, sf):
    """One backup per customer: its orders as words, with damaged and legacy variants."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    k = F.col("c_custkey")
    ok = F.col("o_orderkey")
    word = F.when(ok % 17 == 0, F.lit("17")).otherwise(F.to_json(F.struct(
        F.concat(F.lit("w-"), (ok % 50).cast("string")).alias("_id"),
        F.when(ok % 23 != 0, F.concat(F.lit("head "), F.col("o_orderpriority"))).alias("word"),
    )))
    # The orders of one customer are the unit a backup holds.
    words = o.groupBy("o_custkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ok, word.alias("w")))), lambda x: x["w"]), ",").alias("db")
    )
    listed = F.concat(F.lit('"db":['), F.coalesce("db", F.lit("")), F.lit("],"))
    return c.join(words, F.col("o_custkey") == k, "left").select(
        F.concat(F.lit("b-"), k.cast("string")).alias("migration_id"), _backup_text(k, listed).alias("text")
    )


def bare_backups(spark, sf):
    """A second backup of some customers, without a list of words: the preview blocks it."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    # Without words a legacy backup has no known format.
    bare = c.where((k % 17 == 9) & (k % 10 != 0))
    return bare.select(F.concat(F.lit("n-"), k.cast("string")).alias("migration_id"), _backup_text(k, F.lit("")).alias("text"))


def _backup_text(k, listed):
    """The text of a customer's backup; ``listed`` is the part with its words."""
    seg = F.col("c_mktsegment")
    star = F.when(k % 7 == 0, F.lit('"lost"')).otherwise(F.concat(F.lit('["w-'), (k % 60).cast("string"), F.lit('"]')))
    data = F.concat(
        listed, F.lit('"folders":["'), seg, F.lit('","'), seg,
        F.lit('"],"folderLangs":{"'), seg, F.lit('":"ja"},"stars":'), star, F.lit(',"mtGroupClears":{"g '), seg,
        F.lit('":'), (k % 9).cast("string"), F.lit("}"),
    )
    tail = F.lit(',"preferences":{"theme":"dark"},"extra":{"b":1,"a":2}')
    modern = F.concat(
        F.lit('{"format":"demo-backup","backupVersion":10,"schemaVersion":8,"exportDate":"2026-07-20T00:00:00Z","data":{'),
        data, F.lit(',"odd":[1]}'), tail, F.lit("}"),
    )
    legacy = F.concat(F.lit("{"), data, tail, F.lit(',"odd":[1],"exportDate":"none"}'))
    return (
        F.when(k % 11 == 3, F.concat(F.lit("{"), modern))
        .when(k % 13 == 5, F.lit('{"format":"other"}'))
        .when(k % 10 == 0, legacy).otherwise(modern)
    )


def parsed(spark, sf):
    return stored(spark, sf, "parsed", lambda: durable(bk.parse_backups(durable(backups(spark, sf)))))


def backup_records(spark, sf):
    return stored(spark, sf, "records", lambda: durable(bk.source_records(parsed(spark, sf))))


@query("backup_headers", f"""WITH {BACKUP_SQL}
SELECT migration_id, error, CASE WHEN error = '' THEN format ELSE CASE WHEN error = 'INVALID_JSON' THEN '' ELSE '' END END AS source_format,
  CASE WHEN error = '' AND format = 'modern' THEN 10 ELSE 4 END AS backup_version FROM bk""")
def backup_headers(spark, sf):
    p = parsed(spark, sf)
    return p.select("migration_id", *no_nulls(p, "error", "source_format"), F.col("backup_version").cast("int").alias("backup_version"))


@query("source_records", f"WITH {BACKUP_SQL} SELECT migration_id, source_ref, domain, value_type FROM recs")
def source_records(spark, sf):
    return backup_records(spark, sf).select("migration_id", "source_ref", "domain", "value_type")


DOMAIN_LIST = ", ".join(f"('{d}', {i})" for i, d in enumerate(bk.DOMAIN_ORDER))


@query("source_domain_counts", f"""WITH {BACKUP_SQL}, wanted AS (SELECT * FROM (VALUES {DOMAIN_LIST}) AS t(domain, position))
SELECT g.migration_id, w.domain, CAST(w.position AS INTEGER) AS position, count(r.source_ref) AS n
FROM good g CROSS JOIN wanted w LEFT JOIN recs r ON r.migration_id = g.migration_id AND r.domain = w.domain GROUP BY ALL""")
def source_domain_counts(spark, sf):
    return bk.domain_counts(backup_records(spark, sf), parsed(spark, sf).where("error is null"))


@query("source_contract", f"""WITH {BACKUP_SQL}
SELECT migration_id, count(*) AS source, count(DISTINCT source_ref) AS distinct_refs,
  count(*) FILTER (WHERE domain = 'unknown') AS unknown, CAST(0 AS BIGINT) AS bad_digests FROM recs GROUP BY migration_id""")
def source_contract(spark, sf):
    return contracts.check_source_records(backup_records(spark, sf))


@query("reader_contract", f"""WITH {BACKUP_SQL}, per AS (SELECT migration_id, k, format, count(*) AS n FROM good JOIN recs USING (migration_id) GROUP BY ALL)
SELECT migration_id, n + CASE WHEN k % 5 = 1 THEN 1 ELSE 0 END AS source, array_to_string(list_filter([CASE WHEN k % 5 = 2 THEN 'DOMAIN_ORDER' END,
  CASE WHEN k % 5 = 2 OR k % 5 = 3 THEN 'DOMAIN_COUNT' END, CASE WHEN k % 5 = 1 OR k % 5 = 3 THEN 'SOURCE_SUM' END, CASE WHEN k % 5 = 1 THEN 'SOURCE_COUNT' END,
  CASE WHEN k % 5 = 4 THEN 'UNKNOWN_REFS' END], lambda x: x IS NOT NULL), ',') AS violations FROM per""")
def reader_contract(spark, sf):
    """What readers state of every backup; some state another total, order, domain count or number of unknown records."""
    records = backup_records(spark, sf)
    k = F.substring("migration_id", 3, 20).cast("bigint")
    counts = bk.domain_counts(records, records.select("migration_id").distinct())
    stated = counts.withColumn("n", F.col("n") + F.when((k % 5 == 3) & (F.col("domain") == "words"), 1).otherwise(0))
    listed = stated.groupBy("migration_id").agg(F.array_sort(F.collect_list(F.struct("position", "domain", "n"))).alias("x"))
    domains_of = F.transform("x", lambda x: F.struct(x["domain"].alias("domain"), x["n"].alias("n")))
    found = contracts.check_source_records(records).join(listed, "migration_id").select(
        "migration_id", (F.col("source") + F.when(k % 5 == 1, 1).otherwise(0)).alias("source"), (F.col("unknown") + F.when(k % 5 == 4, 1).otherwise(0)).alias("unknown"),
        F.when(k % 5 == 2, F.reverse(domains_of)).otherwise(domains_of).alias("domains"),
    )
    return contracts.check_reader_output(records, found).withColumn("violations", F.array_join("violations", ","))


@query("migration_ids", """SELECT c_custkey AS k, 'v1-v2:' || substr(sha256(c_name), 1, 24) || ':spec-1' AS migration_id FROM customer""")
def migration_ids(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), bk.migration_id(F.sha2("c_name", 256)).alias("migration_id"))


@query("exported_report", """SELECT 'm-' || CAST(o_custkey % 40 AS VARCHAR) AS migration_id, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL""")
def exported_report(spark, sf):
    """A report written for export and read back."""
    rows = table(spark, sf, "orders").groupBy(
        F.concat(F.lit("m-"), (F.col("o_custkey") % 40).cast("string")).alias("migration_id"), F.col("o_orderstatus").alias("status")
    ).agg(F.count(F.lit(1)).alias("n"))
    path = f"{shared_dir(spark)}/mnemora/{uuid.uuid4().hex}"
    store.write_report(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("record_digests", """SELECT source || '[' || CAST(doc_id AS VARCHAR) || ']' AS source_ref,
  sha256(CAST(json_object('schemaVersion', 1, 'sourceRef', source || '[' || CAST(doc_id AS VARCHAR) || ']',
    'domain', lang, 'serializedValue', sha256(text)) AS VARCHAR)) AS record_digest FROM documents""")
def record_digests(spark, sf):
    d = table(spark, sf, "documents")
    ref = F.concat("source", F.lit("["), F.col("doc_id").cast("string"), F.lit("]"))
    return d.select(ref.alias("source_ref"), bk.record_digest(ref, F.col("lang"), F.sha2("text", 256)).alias("record_digest"))


@query("redacted_documents", """SELECT doc_id, FALSE AS leaked, sha256(text) AS text_sha256, doc_id % 2 = 0 AS secret_present,
  CASE WHEN doc_id % 2 = 0 THEN '"[REDACTED]"' ELSE '1.0E30' END AS last_value FROM documents""")
def redacted_documents(spark, sf):
    """Every document as JSON, half of them with a nested secret: it must be gone, all else must stay as it is."""
    d = table(spark, sf, "documents")
    value = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"sk-'), F.col("doc_id").cast("string"), F.lit('"'))).otherwise("1.0E30")
    key = F.when(F.col("doc_id") % 2 == 0, "deepseek-API-key").otherwise("number")
    body = F.concat(F.lit('{"inner": {"text":'), F.to_json(F.array("text")), F.lit(', "'), key, F.lit('":'), value, F.lit("}}"))
    clean = redact.redact(body)
    return d.select(
        "doc_id", clean.contains(F.concat(F.lit("sk-"), F.col("doc_id").cast("string"), F.lit('"'))).alias("leaked"),
        F.sha2(F.get_json_object(clean, "$.inner.text[0]"), 256).alias("text_sha256"),
        redact.secret_presence(body).alias("secret_present"),
        F.regexp_extract(clean, r':([^:]+)\}\}$', 1).alias("last_value"),
    )


DEVICE_SQL = """dev AS (SELECT 'd-' || CAST(o_custkey AS VARCHAR) AS migration_id, o_orderstatus AS key, o_orderkey,
    CASE WHEN o_orderkey % 2 = 0 THEN 'indexed' ELSE 'local' END AS store, '"' || o_orderpriority || '"' AS json FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderkey % 2 ORDER BY o_orderkey) = 1)"""


def device_entries(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus", (k % 2).alias("side")).agg(
        F.min_by("o_orderpriority", "o_orderkey").alias("p")
    )
    return o.select(
        F.concat(F.lit("d-"), F.col("o_custkey").cast("string")).alias("migration_id"), F.col("o_orderstatus").alias("key"),
        F.when(F.col("side") == 0, "indexed").otherwise("local").alias("store"),
        F.concat(F.lit('"'), "p", F.lit('"')).alias("json"),
    )


@query("device_merge", f"""WITH {DEVICE_SQL}, both_sides AS (SELECT migration_id, key, max(json) FILTER (WHERE store = 'indexed') AS a,
  max(json) FILTER (WHERE store = 'local') AS b FROM dev GROUP BY ALL)
SELECT migration_id, key, coalesce(a, b) AS json, CASE WHEN a IS NOT NULL THEN 'indexed' ELSE 'local' END AS selected,
  coalesce(a <> b, FALSE) AS diverges, CASE WHEN a <> b THEN sha256(a) ELSE '' END AS indexed_digest,
  CASE WHEN a <> b THEN sha256(b) ELSE '' END AS local_digest FROM both_sides""")
def device_merge(spark, sf):
    merged = bk.merge_device_stores(device_entries(spark, sf))
    return merged.select("migration_id", "key", "json", "selected", "diverges", *no_nulls(merged, "indexed_digest", "local_digest"))


# --- device captures: one per customer --------------------------------------------------------

# Entries of a capture as (store, key, JSON text); what a customer's capture holds depends on its number.
CAPTURE_SQL = """cap AS (SELECT c_custkey AS k, 'v-' || CAST(c_custkey AS VARCHAR) AS migration_id, c_mktsegment AS seg, c_name AS name FROM customer),
fine AS (SELECT * FROM cap WHERE k % 11 <> 3),
split AS (SELECT * FROM fine WHERE k % 3 = 0)"""


def device_captures(spark, sf):
    """Both stores of every customer: a combined and at times a split word store, diverging stars, a secret, odd keys."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    words = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: F.concat(F.lit('{"_id":"w-'), x.cast("string"), F.lit('"}'))), ",").alias("db"))

    def text(value):
        """A value of a local store: JSON text of a string that holds JSON."""
        listed = F.to_json(F.array(value))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    stars = F.concat(F.lit('["'), seg, F.lit('"]'))
    entries = [
        ("indexed", "myWordDB_v3", F.concat(F.lit("[ "), F.coalesce("db", F.lit("")), F.lit("]")), F.lit(True)),
        ("local", "userWords_v1", text(F.lit('[{"_id": "own"}]')), k % 3 == 0),
        ("indexed", "starredWords", stars, F.lit(True)),
        # The same value in another form does not diverge.
        ("local", "starredWords", F.when(k % 2 == 0, text(F.lit('["other"]'))).otherwise(text(F.concat(F.lit(" "), stars))), F.lit(True)),
        ("local", "studyRecords", text(F.lit('{"odd": 1}')), k % 5 == 0),
        ("indexed", "mtWordClears_v3", F.concat(F.lit('{"ja:'), seg, F.lit('": {"kanji": true}}')), F.lit(True)),
        ("local", "theme", text(F.concat(F.lit("dark "), F.col("c_name"))), F.lit(True)),
        ("local", "volume", text(F.lit("7")), F.lit(True)),
        ("local", "deepseek-API-key", F.when(k % 4 == 0, F.lit('"sk-1"')).otherwise('"[REDACTED]"'), F.lit(True)),
        ("local", "migrationSafetySnapshot_v1", text(F.lit('{"b": 2, "a": 1}')), k % 7 == 0),
        ("local", "nativeStudyReminderEnabled", text(F.lit("true")), k % 6 == 0),
        ("indexed", "oddKey", F.lit("[1, 2]"), F.lit(True)),
        ("local", "oddKey", F.lit("3"), F.lit(True)),
        ("indexed", "wordStorageVersion", F.lit("2"), F.lit(True)),
        ("local", "demo_storage_probe", F.lit('"1"'), F.lit(True)),
        ("indexed", "broken", F.lit("{"), k % 11 == 3),
    ]
    made = F.array(*[
        F.struct(F.lit(s).alias("store"), F.lit(key).alias("key"), value.alias("json"), here.alias("here")) for s, key, value, here in entries
    ])
    return c.join(words, F.col("o_custkey") == k, "left").select(
        F.concat(F.lit("v-"), k.cast("string")).alias("migration_id"), F.inline(made)
    ).where("here").drop("here")


def device_record_table(spark, sf):
    return stored(spark, sf, "device_records", lambda: durable(devices.device_records(chosen_entries(spark, sf))))


def chosen_entries(spark, sf):
    return stored(spark, sf, "chosen", lambda: durable(devices.chosen_entries(devices.decoded_entries(device_captures(spark, sf)))))


DEVICE_RECORDS_SQL = f"""{CAPTURE_SQL},
dow AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx FROM orders),
dbs AS (SELECT o_custkey AS k, '[' || string_agg('{{"_id":"w-' || CAST(o_orderkey AS VARCHAR) || '"}}', ',' ORDER BY o_orderkey) || ']' AS json FROM orders GROUP BY o_custkey),
drecs AS (
  SELECT migration_id, 'device.indexedDb["myWordDB_v3"][' || CAST(idx AS VARCHAR) || ']' AS source_ref, 'words' AS domain, 'object' AS value_type,
    '{{"_id":"w-' || CAST(o_orderkey AS VARCHAR) || '"}}' AS json FROM fine JOIN dow USING (k) WHERE k % 3 <> 0
  UNION ALL SELECT migration_id, 'device.indexedDb["myWordDB_v3"]', 'unknown', 'array', coalesce(json, '[]') FROM split LEFT JOIN dbs USING (k)
  UNION ALL SELECT migration_id, 'device.localStorage["userWords_v1"][0]', 'words', 'object', '{{"_id":"own"}}' FROM split
  UNION ALL SELECT migration_id, 'device.indexedDb["starredWords"][0]', 'favorites', 'string', '"' || seg || '"' FROM fine
  UNION ALL SELECT migration_id, 'device.localStorage["studyRecords"]', 'studyRecords', 'object', '{{"odd":1}}' FROM fine WHERE k % 5 = 0
  UNION ALL SELECT migration_id, 'device.indexedDb["mtWordClears_v3"]["ja:' || seg || '"]', 'mastery', 'object', '{{"kanji":true}}' FROM fine
  UNION ALL SELECT migration_id, 'device.localStorage["theme"]', 'preferences', 'string', '"dark ' || name || '"' FROM fine
  UNION ALL SELECT migration_id, 'device.localStorage["volume"]', 'preferences', 'number', '7' FROM fine
  UNION ALL SELECT migration_id, 'device.localStorage["deepseek-API-key"]', 'preferences', 'string', CASE WHEN k % 4 = 0 THEN '"sk-1"' ELSE '"[REDACTED]"' END FROM fine
  UNION ALL SELECT migration_id, 'device.localStorage["migrationSafetySnapshot_v1"]', 'unknown', 'object', '{{"a":1,"b":2}}' FROM fine WHERE k % 7 = 0
  UNION ALL SELECT migration_id, 'device.localStorage["nativeStudyReminderEnabled"]', 'preferences', 'boolean', 'true' FROM fine WHERE k % 6 = 0
  UNION ALL SELECT migration_id, 'device.indexedDb["oddKey"]', 'unknown', 'array', '[1,2]' FROM fine)"""


@query("device_records", f"""WITH {DEVICE_RECORDS_SQL}
SELECT migration_id, source_ref, domain, value_type, json, CASE WHEN json = '"sk-1"' THEN 'SENSITIVE_VALUE_PRESENT' ELSE '' END AS error,
  sha256(CAST(json_object('schemaVersion', 1, 'sourceRef', source_ref, 'domain', domain, 'serializedValue', json) AS VARCHAR)) AS record_digest FROM drecs""")
def device_records(spark, sf):
    safe, refused = bk.refuse_plain_secrets(device_record_table(spark, sf))
    every = safe.withColumn("error", F.lit("")).unionByName(refused)
    return every.select("migration_id", "source_ref", "domain", "value_type", "json", "error", "record_digest")


@query("storage_divergences", f"""WITH {CAPTURE_SQL}, keys AS (
  SELECT migration_id, 'starredWords' AS key, '["' || seg || '"]' AS a, '["other"]' AS b FROM cap WHERE k % 2 = 0
  UNION ALL SELECT migration_id, 'oddKey', '[1,2]', '3' FROM cap)
SELECT migration_id, key, 'device.indexedDb["' || key || '"]' AS indexed_ref, 'device.localStorage["' || key || '"]' AS local_ref,
  sha256(a) AS indexed_digest, sha256(b) AS local_digest, 'indexed' AS selected FROM keys""")
def storage_divergences(spark, sf):
    return devices.storage_divergences(chosen_entries(spark, sf))


@query("device_headers", f"""WITH {CAPTURE_SQL}
SELECT migration_id, CASE WHEN k % 11 = 3 THEN 'INVALID_DEVICE_SOURCE' ELSE '' END AS error, CAST(10 AS BIGINT) AS backup_version,
  CASE WHEN k % 2 = 0 THEN CAST(7 AS BIGINT) ELSE 8 END AS data_schema_version, 'device' AS kind, CASE WHEN k % 2 = 0 THEN CAST(2 AS BIGINT) ELSE 1 END AS divergences FROM cap""")
def device_headers(spark, sf):
    k = F.col("c_custkey")
    captures = table(spark, sf, "customer").select(
        F.concat(F.lit("v-"), k.cast("string")).alias("migration_id"), F.when(k % 2 == 0, 7).alias("data_schema_version"), F.lit(2).alias("word_storage_version")
    )
    found = devices.device_headers(captures, chosen_entries(spark, sf))
    return found.select("migration_id", *no_nulls(found, "error"), "backup_version", "data_schema_version", "kind", "divergences")


@query("snapshot_fingerprints", f"""WITH {DEVICE_SQL}, hashed AS (SELECT migration_id, sha256(store || '|' || key || '|' || json) AS h FROM dev),
per AS (SELECT migration_id, count(*) AS entries, {SET_DIGEST} AS entries_digest FROM hashed GROUP BY migration_id)
SELECT migration_id, entries, entries_digest, sha256('v1-source-fingerprint|9|8||' || entries_digest || '|m|false') AS source_fingerprint FROM per""")
def snapshot_fingerprints(spark, sf):
    entries = device_entries(spark, sf)
    meta = entries.select("migration_id").distinct().select(
        "migration_id", F.lit("9").alias("app_version"), F.lit(8).alias("data_schema_version"),
        F.lit(None).cast("int").alias("word_storage_version"), F.lit("m").alias("manifest_digest"),
    )
    found = bk.snapshot_fingerprints(entries, meta)
    return found.select("migration_id", "entries", "entries_digest", "source_fingerprint")


@query("legacy_devices", """SELECT o_custkey AS device_id, bool_or(o_orderkey % 40 = 0 OR o_orderpriority IN ('1-URGENT')) AS detected
FROM orders GROUP BY o_custkey""")
def legacy_devices(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    keys = o.select(
        F.col("o_custkey").alias("device_id"), F.when(k % 40 == 0, "indexed").otherwise("local").alias("store"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "my_Word-DB.v3").otherwise("cache").alias("key"),
    )
    return contracts.detect_legacy_devices(keys)


@query("staging_preconditions", """SELECT 'p-' || CAST(doc_id AS VARCHAR) AS migration_id, CASE WHEN doc_id % 7 = 0 THEN 'BLOCKED_REPORT'
  WHEN doc_id % 5 = 0 THEN 'INVALID_SOURCE' WHEN doc_id % 4 = 0 THEN 'SOURCE_CHANGED' WHEN doc_id % 3 = 0 THEN 'SNAPSHOT_MISMATCH' ELSE '' END AS error FROM documents""")
def staging_preconditions(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    text = F.when(k % 5 == 0, F.concat(F.lit("{"), "text")).otherwise(F.to_json(F.struct("text")))
    mid = F.concat(F.lit("p-"), k.cast("string")).alias("migration_id")
    rows = d.withColumn("body", text)
    previews = rows.select(
        mid, F.when(k % 7 == 0, "blocked").otherwise("review").alias("status"), F.lit("file").alias("file_name"),
        F.when(k % 4 == 0, F.sha2("source", 256)).otherwise(F.sha2("body", 256)).alias("file_digest"),
    )
    clean = F.sha2(F.to_json(F.try_parse_json("body")), 256)
    sources = rows.select(
        mid, F.col("body").alias("text"), (k % 2 == 0).alias("has_snapshot") | (k % 3 == 0),
        F.lit("file").alias("snapshot_file_name"), F.sha2("body", 256).alias("snapshot_raw_digest"),
        F.when(k % 3 == 0, F.lit("x")).otherwise(clean).alias("snapshot_clean_digest"),
    ).toDF("migration_id", "text", "has_snapshot", "snapshot_file_name", "snapshot_raw_digest", "snapshot_clean_digest")
    found = bk.staging_preconditions(previews, sources)
    return found.select("migration_id", *no_nulls(found, "error"))


# --- preview --------------------------------------------------------------------------------

PREVIEW_SQL = f"""{BACKUP_SQL},
wordrow AS (SELECT g.migration_id, g.k, ow.idx, o_orderkey % 17 <> 0 AND o_orderkey % 23 <> 0 AS valid,
  CASE WHEN o_orderkey % 17 <> 0 THEN 'w-' || CAST(o_orderkey % 50 AS VARCHAR) END AS word_id FROM good g JOIN ow USING (k)),
idc AS (SELECT migration_id, word_id, count(*) AS n_all, count(*) FILTER (WHERE valid) AS n_valid FROM wordrow WHERE word_id IS NOT NULL GROUP BY ALL),
classed AS (SELECT w.migration_id, 'data.db[' || CAST(idx AS VARCHAR) || ']' AS source_ref, 'words' AS domain,
    CASE WHEN NOT valid THEN 'error' WHEN n_all > 1 THEN 'conflict' ELSE 'migratable' END AS class,
    CASE WHEN NOT valid THEN 'WORD_RECORD_INVALID' WHEN n_all > 1 THEN 'WORD_ID_DUPLICATE' END AS issue
    FROM wordrow w LEFT JOIN idc USING (migration_id, word_id)
  UNION ALL SELECT migration_id, 'data.folders[' || CAST(i AS VARCHAR) || ']', 'folders', CASE i WHEN 0 THEN 'migratable' ELSE 'conflict' END,
    CASE i WHEN 1 THEN 'FOLDER_DUPLICATE' END FROM good, (SELECT unnest([0, 1]) AS i)
  UNION ALL SELECT g.migration_id, CASE WHEN k % 7 = 0 THEN 'data.stars' ELSE 'data.stars[0]' END, 'favorites',
    CASE WHEN k % 7 = 0 THEN 'error' WHEN coalesce(n_valid, 0) = 0 THEN 'skipped' WHEN n_valid > 1 THEN 'conflict' ELSE 'migratable' END,
    CASE WHEN k % 7 = 0 THEN 'STARS_TYPE_INVALID' WHEN coalesce(n_valid, 0) = 0 THEN 'FAVORITE_WORD_ORPHAN' WHEN n_valid > 1 THEN 'FAVORITE_WORD_AMBIGUOUS' END
    FROM good g LEFT JOIN idc ON idc.migration_id = g.migration_id AND idc.word_id = 'w-' || CAST(k % 60 AS VARCHAR)
  UNION ALL SELECT migration_id, source_ref, domain, CASE domain WHEN 'unknown' THEN 'skipped' ELSE 'migratable' END,
    CASE domain WHEN 'unknown' THEN 'UNKNOWN_FIELDS_ARCHIVED' END FROM recs WHERE domain IN ('groupProgress', 'preferences', 'unknown')),
summary AS (SELECT g.migration_id, w.domain, count(c.class) AS source, count(*) FILTER (WHERE class = 'migratable') AS migratable,
  count(*) FILTER (WHERE class = 'skipped') AS skipped, count(*) FILTER (WHERE class = 'conflict') AS conflict,
  count(*) FILTER (WHERE class = 'error') AS error FROM good g CROSS JOIN (SELECT unnest({bk.DOMAIN_ORDER}) AS domain) w
  LEFT JOIN classed c ON c.migration_id = g.migration_id AND c.domain = w.domain GROUP BY g.migration_id, w.domain),
issue_rows AS (SELECT DISTINCT c.migration_id, domain, issue AS code, w.word_id AS ref FROM classed c
    JOIN wordrow w ON w.migration_id = c.migration_id AND c.source_ref = 'data.db[' || CAST(w.idx AS VARCHAR) || ']' WHERE issue = 'WORD_ID_DUPLICATE'
  UNION ALL SELECT migration_id, domain, issue, source_ref FROM classed WHERE issue IS NOT NULL AND issue <> 'WORD_ID_DUPLICATE'
  UNION ALL SELECT migration_id, 'unknown', 'LEGACY_V4_LIMITED_COVERAGE', NULL FROM good WHERE format = 'legacy-v4')"""


def classified(spark, sf):
    return stored(spark, sf, "classified", lambda: durable(
        preview.classify(backup_records(spark, sf), F.lit("2026-08-01").cast("timestamp"))))


# The issues and the status are those of all backups, also of second ones that have no list of words.
ALL_PREVIEW_SQL = f"""{PREVIEW_SQL},
bare AS (SELECT k, 'n-' || CAST(k AS VARCHAR) AS migration_id, migration_id AS listed_id FROM good WHERE k % 17 = 9 AND k % 10 <> 0),
bare_classed AS (SELECT b.migration_id, source_ref, domain, CASE WHEN domain = 'favorites' AND k % 7 <> 0 THEN 'skipped' ELSE class END AS class,
  CASE WHEN domain = 'favorites' AND k % 7 <> 0 THEN 'FAVORITE_WORD_ORPHAN' ELSE issue END AS issue
  FROM (SELECT DISTINCT * FROM bare) b JOIN classed c ON c.migration_id = b.listed_id WHERE domain <> 'words'),
all_issue_rows AS (SELECT * FROM issue_rows
  UNION ALL SELECT migration_id, domain, issue, source_ref FROM bare_classed WHERE issue IS NOT NULL
  UNION ALL SELECT migration_id, 'words', 'WORDS_REQUIRED', NULL FROM bare),
all_summary AS (SELECT migration_id, source, migratable, skipped, conflict, error FROM summary
  UNION ALL SELECT migration_id, count(*), count(*) FILTER (WHERE class = 'migratable'), count(*) FILTER (WHERE class = 'skipped'),
    count(*) FILTER (WHERE class = 'conflict'), count(*) FILTER (WHERE class = 'error') FROM bare_classed GROUP BY migration_id)"""


def bare_parsed(spark, sf):
    return stored(spark, sf, "bare_parsed", lambda: durable(bk.parse_backups(durable(bare_backups(spark, sf)))))


def all_headers(spark, sf):
    return parsed(spark, sf).unionByName(bare_parsed(spark, sf)).where("error is null")


def all_classified(spark, sf):
    bare = stored(spark, sf, "bare_classified", lambda: durable(
        preview.classify(durable(bk.source_records(bare_parsed(spark, sf))), F.lit("2026-08-01").cast("timestamp"))))
    return classified(spark, sf).unionByName(bare)


def merged_preview_issues(spark, sf):
    headers = all_headers(spark, sf).select("migration_id", "source_format", "has_words", "has_folders")
    return preview.merge_issues(preview.issues(all_classified(spark, sf), headers))


@query("preview_classes", f"WITH {PREVIEW_SQL} SELECT migration_id, source_ref, domain, class, coalesce(issue, '') AS issue FROM classed")
def preview_classes(spark, sf):
    c = classified(spark, sf)
    return c.select("migration_id", "source_ref", "domain", "class", *no_nulls(c, "issue"))


@query("preview_summary", f"WITH {PREVIEW_SQL} SELECT * FROM summary")
def preview_summary(spark, sf):
    return preview.domain_summary(classified(spark, sf), parsed(spark, sf).where("error is null"))


@query("preview_issues", f"""WITH {ALL_PREVIEW_SQL}, refs AS (SELECT migration_id, code, domain, ref,
  row_number() OVER (PARTITION BY migration_id, code, domain ORDER BY ref) AS rn FROM (SELECT DISTINCT * FROM all_issue_rows WHERE ref IS NOT NULL))
SELECT i.migration_id, i.code, i.domain, count(*) AS n, coalesce((SELECT string_agg(ref, ',' ORDER BY ref) FROM refs r
  WHERE r.migration_id = i.migration_id AND r.code = i.code AND r.domain = i.domain AND rn <= 3), '') AS sample_refs
FROM all_issue_rows i GROUP BY i.migration_id, i.code, i.domain""")
def preview_issues(spark, sf):
    return merged_preview_issues(spark, sf).select(
        "migration_id", "code", "domain", "n", F.array_join("sample_refs", ",").alias("sample_refs")
    )


@query("preview_status", f"""WITH {ALL_PREVIEW_SQL}, worst AS (SELECT migration_id, bool_or(code IN ('WORD_RECORD_INVALID', 'WORD_ID_DUPLICATE', 'WORDS_REQUIRED')) AS blocking FROM all_issue_rows GROUP BY migration_id)
SELECT s.migration_id, CAST(sum(source) AS BIGINT) AS source, CAST(sum(migratable) AS BIGINT) AS migratable, CAST(sum(skipped) AS BIGINT) AS skipped,
  CAST(sum(conflict) AS BIGINT) AS conflict, CAST(sum(error) AS BIGINT) AS error,
  CASE WHEN any_value(blocking) THEN 'blocked' ELSE 'review' END AS status FROM all_summary s JOIN worst USING (migration_id) GROUP BY s.migration_id""")
def preview_status(spark, sf):
    headers = all_headers(spark, sf)
    return preview.preview_status(preview.domain_summary(all_classified(spark, sf), headers), merged_preview_issues(spark, sf), headers)


@query("reference_matches", f"""{W}, ids AS (SELECT language, id, count(*) AS n FROM words GROUP BY ALL),
heads AS (SELECT language, headword, count(*) AS n FROM words GROUP BY ALL),
asked AS (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'ja' ELSE 'en' END AS language, CASE WHEN o_orderkey % 3 = 0 THEN p_name || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR)
  WHEN o_orderkey % 3 = 1 THEN 'w-' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') ELSE 'none' END AS reference FROM orders JOIN part ON p_partkey = o_custkey)
SELECT o_orderkey, coalesce(i.n, h.n, 0) AS matches FROM asked a LEFT JOIN ids i ON i.language = a.language AND i.id = a.reference
LEFT JOIN heads h ON h.language = a.language AND h.headword = a.reference""")
def reference_matches(spark, sf):
    words = b.words(spark, sf).select(F.col("language").alias("migration_id"), F.col("id").alias("word_id"), "headword")
    ids, heads = preview.reference_index(words)
    o, p = table(spark, sf, "orders"), table(spark, sf, "part")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    asked = o.join(p, F.col("p_partkey") == c).select(
        "o_orderkey", F.when(c % 2 == 0, "ja").otherwise("en").alias("migration_id"),
        F.when(k % 3 == 0, F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string")))
        .when(k % 3 == 1, F.concat(F.lit("w-"), F.lpad(c.cast("string"), 6, "0"))).otherwise("none").alias("reference"),
    )
    return preview.count_matches(asked, ids, heads).select("o_orderkey", "matches")


# --- dispositions, archives, samples --------------------------------------------------------


def study_parts(spark, sf):
    return stored(spark, sf, "study_parts", lambda: durable(domains.study_records(study_records(spark, sf))[1]))


@query("disposition_counts", f"""WITH {STUDY_SQL}, {STUDY_DISPOSED}
SELECT migration_id, count(*) AS source, count(*) FILTER (WHERE outcome = 'migrated') AS migrated, count(*) FILTER (WHERE outcome = 'deduped') AS deduped,
  count(*) FILTER (WHERE outcome = 'quarantined') AS quarantined, count(*) FILTER (WHERE outcome <> 'quarantined') AS raw_archived FROM disposed GROUP BY migration_id""")
def disposition_counts(spark, sf):
    return outcomes.disposition_counts(study_parts(spark, sf))


ARCHIVE_SQL = f"""{STUDY_SQL}, {STUDY_DISPOSED},
archived AS (SELECT *, CASE outcome WHEN 'quarantined' THEN 'quarantine' ELSE 'rawArchive' END AS archive_kind FROM disposed),
refs AS (SELECT *, CASE archive_kind WHEN 'quarantine' THEN 'quarantine-v1:' ELSE 'raw-v1:' END || sha256(CAST(json_object('migrationId', migration_id,
  'sourceRef', source_ref, 'sourceRecordDigestSha256', sha256(source_ref), 'archiveKind', archive_kind) AS VARCHAR)) AS archive_ref FROM archived)"""


@query("disposition_archives", f"WITH {ARCHIVE_SQL} SELECT migration_id, source_ref, archive_kind, archive_ref FROM refs")
def disposition_archives(spark, sf):
    return outcomes.with_archives(study_parts(spark, sf)).select("migration_id", "source_ref", "archive_kind", "archive_ref")


@query("archive_rows", f"""WITH {ARCHIVE_SQL} SELECT migration_id, source_ref, archive_ref, 'dataset:' || migration_id AS dataset_id,
  'stable-version-cycle' AS retention_policy, CASE WHEN ascii(substr(source_ref, 15, 1)) % 2 = 0 THEN 'CLEANUP_WITHOUT_RETENTION' ELSE '' END AS violations FROM refs""")
def archive_rows(spark, sf):
    found, _ = outcomes.archive_rows(study_parts(spark, sf), study_records(spark, sf))
    kept = outcomes.retained_archives(found, F.lit("2026-01-01").cast("timestamp"))
    # Some rows confirm a cleanup they may not confirm yet.
    early = F.ascii(F.substring("source_ref", 15, 1)) % 2 == 0
    kept = kept.withColumn("cleanup_confirmed_at", F.when(early, F.col("created_at")))
    return outcomes.check_archives(kept).select(
        "migration_id", "source_ref", "archive_ref", "dataset_id", "retention_policy", F.array_join("violations", ",").alias("violations")
    )


@query("report_digests", f"""WITH {STUDY_SQL}, {STUDY_DISPOSED}, hashed AS (SELECT migration_id, sha256(source_ref || '|studyRecords|' || sha256(source_ref) || '|' || outcome || '|' || severity || '|' || reason
  || '|' || coalesce(quarantine_code, '') || '|' || coalesce(target_ref, '') || '|' || coalesce(canonical_source_ref, '')) AS h FROM disposed)
SELECT migration_id, count(*) AS source, {SET_DIGEST} AS report_digest FROM hashed GROUP BY migration_id""")
def report_digests(spark, sf):
    return outcomes.report_digests(study_parts(spark, sf))


@query("disposition_contract", """SELECT o_orderkey AS k, array_to_string(list_filter([
  CASE WHEN o_orderstatus = 'O' AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) THEN 'MIGRATED_SHAPE' END,
  CASE WHEN o_orderstatus = 'F' AND (o_orderkey % 3 = 0 OR o_orderkey % 5 <> 0) THEN 'DEDUPED_SHAPE' END,
  CASE WHEN o_orderstatus = 'P' AND (o_orderkey % 3 <> 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 <> 0) THEN 'QUARANTINED_SHAPE' END,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'QUARANTINED_INFO' END,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN 'QUARANTINED_RAW' END,
  CASE WHEN o_orderkey % 3 = 2 THEN 'TARGET_DUPLICATE' END], lambda x: x IS NOT NULL), ',') AS violations
FROM (SELECT o_orderkey, o_orderstatus FROM orders)""")
def disposition_contract(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    quarantined = F.col("o_orderstatus") == "P"
    rows = o.select(
        k.alias("k"),
        F.when(F.col("o_orderstatus") == "O", "migrated").when(F.col("o_orderstatus") == "F", "deduped").otherwise("quarantined").alias("outcome"),
        F.when(k % 2 == 0, "info").otherwise("warning").alias("severity"), (k % 4 == 0).alias("raw_archive"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("t"))).otherwise(F.array(F.lit("t"), F.lit("t"))).alias("target_refs"),
        F.when(k % 5 == 0, "first").alias("canonical_source_ref"),
        F.when(quarantined & (k % 7 == 0), "CODE").alias("quarantine_code"),
    )
    return contracts.check_dispositions(rows).select("k", F.array_join("violations", ",").alias("violations"))


@query("plan_fingerprints", f"SELECT item_id, lpad(lower(hex({FNV_SQL.format(text='text')})), 8, '0') AS fingerprint FROM benchmark")
def plan_fingerprints(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", fnv1a_hex(F.col("text")).alias("fingerprint"))


SAMPLE_SQL = f"""cat AS (SELECT 'm-' || CAST(o_custkey % 5 AS VARCHAR) AS migration_id, 'r-' || CAST(o_orderkey AS VARCHAR) AS source_ref,
  CASE o_orderstatus WHEN 'O' THEN 'builtin-ja' WHEN 'F' THEN 'related-mastery' ELSE 'overrides' END AS category FROM orders),
scored AS (SELECT *, {FNV_SQL.format(text="'seed:' || category || ':' || source_ref")} AS score FROM cat),
ranked AS (SELECT *, row_number() OVER (PARTITION BY migration_id, category ORDER BY score, source_ref) AS position FROM scored)"""


@query("fixed_sample", f"""WITH {SAMPLE_SQL} SELECT migration_id, category, source_ref, position FROM ranked
WHERE position <= CASE WHEN category LIKE 'related-%' THEN 20 ELSE 30 END""")
def fixed_sample(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(
        F.concat(F.lit("m-"), (F.col("o_custkey") % 5).cast("string")).alias("migration_id"),
        F.concat(F.lit("r-"), F.col("o_orderkey").cast("string")).alias("source_ref"),
        F.when(F.col("o_orderstatus") == "O", "builtin-ja").when(F.col("o_orderstatus") == "F", "related-mastery")
        .otherwise("overrides").alias("category"), F.lit("seed").alias("source_fingerprint"),
    )
    return sampling.fixed_sample(rows).select("migration_id", "category", "source_ref", F.col("position").cast("bigint").alias("position"))


_CATEGORIES = ", ".join(f"('{c}', {i})" for i, c in enumerate(sampling.CATEGORIES))


@query("sampling_evidence", f"""{IDENTITY_SQL}, cats AS (SELECT e.migration_id, e.source_ref, r.n, CASE WHEN target_kind = 'canonical' THEN 'builtin-' || e.language ELSE 'user-words' END AS category
  FROM entries e JOIN refs r ON r.source_ref = e.source_ref WHERE source_kind = 'word'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY migration_id, category ORDER BY {FNV_SQL.format(text="'seed:' || category || ':' || source_ref")}, source_ref) AS position FROM cats),
per AS (SELECT migration_id, category, count(*) AS available, count(*) FILTER (WHERE position <= 30) AS sampled,
  count(*) FILTER (WHERE position <= 30 AND n % 10 = 3) AS mismatched, string_agg(source_ref, ',' ORDER BY position) FILTER (WHERE position <= 30) AS sampled_refs,
  string_agg(source_ref, ',' ORDER BY source_ref) FILTER (WHERE position <= 30 AND n % 10 = 3) AS mismatch_refs FROM ranked GROUP BY ALL)
SELECT m.migration_id, w.category, CAST(place AS BIGINT) AS place, coalesce(available, 0) AS available, coalesce(sampled, 0) AS sampled, coalesce(mismatched, 0) AS mismatched,
  coalesce(sampled_refs, '') AS sampled_refs, coalesce(mismatch_refs, '') AS mismatch_refs, coalesce(mismatched, 0) = 0 AS passed
FROM (SELECT DISTINCT migration_id FROM cats) m CROSS JOIN (SELECT * FROM (VALUES {_CATEGORIES}) AS t(category, place)) w LEFT JOIN per p ON p.migration_id = m.migration_id AND p.category = w.category""")
def sampling_evidence(spark, sf):
    """Dispositions of every tenth record are bound to another record digest, so they do not match."""
    records = word_records(spark, sf)
    payload, parts = word_result(spark, sf)
    parts = durable(outcomes.with_archives(parts))
    archives, _ = outcomes.archive_rows(parts.drop("archive_kind", "archive_ref"), records)
    rows = durable(sampling.categorize(records, stored_entries(spark, sf)).withColumn("source_fingerprint", F.lit("seed")))
    keys = payload.select("migration_id", F.lit("words").alias("domain"), "target_ref")
    damaged = parts.withColumn("record_digest", F.when(F.col("source_ref").rlike(r"3\]$"), "other").otherwise(F.col("record_digest")))
    found = sampling.sampling_evidence(rows, sampling.fixed_sample(rows), damaged, keys, archives)
    return found.select(
        "migration_id", "category", F.col("place").cast("bigint").alias("place"), "available", "sampled", "mismatched",
        F.array_join("sampled_refs", ",").alias("sampled_refs"), F.array_join("mismatch_refs", ",").alias("mismatch_refs"), "passed",
    )


# --- verification, staging, activation ------------------------------------------------------


@query("orphan_references", f"""{CARD_SQL}, owned AS (SELECT DISTINCT migration_id, target_word_id FROM entries WHERE source_kind = 'word' AND outcome = 'mapped'
    AND substr(target_word_id, length(target_word_id), 1) <> '7')
SELECT DISTINCT c.migration_id, 'fsrsCards' AS collection, c.target_word_id AS missing_ref, c.dimension FROM cards c
LEFT JOIN owned o ON o.migration_id = c.migration_id AND o.target_word_id = c.target_word_id WHERE c.target_ref IS NOT NULL AND o.target_word_id IS NULL""")
def orphan_references(spark, sf):
    # Words whose id ends in 7 are taken out, so the cards on them become orphans.
    words = word_result(spark, sf)[0].where("right(target_ref, 1) <> '7'")
    cards = card_result(spark, sf)[0]
    lost = verification.orphan_references({"words": words, "fsrsCards": cards})
    back = cards.select("migration_id", F.col("target_word_id").alias("missing_ref"), "dimension").distinct()
    return lost.distinct().join(back, ["migration_id", "missing_ref"]).select("migration_id", "collection", "missing_ref", "dimension")


@query("duplicate_keys", """SELECT 'm-' || CAST(o_custkey % 40 AS VARCHAR) AS migration_id, o_orderpriority || CAST(o_orderkey % 1000 AS VARCHAR) AS key,
  'words' AS collection, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("m-"), (F.col("o_custkey") % 40).cast("string")).alias("migration_id"),
        F.concat("o_orderpriority", (F.col("o_orderkey") % 1000).cast("string")).alias("target_ref"),
    )
    return verification.primary_key_duplicates({"words": rows})


@query("invalid_dates", """WITH d AS (SELECT 'm-' || CAST(o_custkey % 40 AS VARCHAR) AS migration_id, 's-' || CAST(o_orderkey AS VARCHAR) AS target_ref,
  CASE WHEN o_orderkey % 9 <> 0 THEN '2024-' || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 31 + 1 AS VARCHAR), 2, '0') END AS date_only FROM orders)
SELECT migration_id, target_ref, date_only FROM d WHERE date_only IS NOT NULL AND TRY_CAST(date_only AS DATE) IS NULL""")
def invalid_dates(spark, sf):
    k = F.col("o_orderkey")
    day = F.concat(F.lit("2024-"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((k % 31 + 1).cast("string"), 2, "0"))
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("m-"), (F.col("o_custkey") % 40).cast("string")).alias("migration_id"),
        F.concat(F.lit("s-"), k.cast("string")).alias("target_ref"), F.when(k % 9 != 0, day).alias("date_only"),
    )
    return verification.invalid_dates(rows)


# What is damaged in a migration depends on its number: one domain's dispositions lost, a payload key twice, a
# favorite of no word, a date that is none, lost reminders, evidence that is missing, foreign or failed.
_DOMAIN_LIST = verification.DOMAINS
_LOST = f"{_DOMAIN_LIST}[(k // 8) % {len(_DOMAIN_LIST)} + 1]"
VERIFY_SQL = f"""{BACKUP_SQL}, {DEVICE_RECORDS_SQL},
every AS (SELECT migration_id, domain, source_ref FROM recs UNION ALL SELECT migration_id, domain, source_ref FROM drecs),
migs AS (SELECT migration_id, k FROM good UNION ALL SELECT migration_id, k FROM fine),
counted AS (SELECT m.migration_id, m.k, bool_or(k % 8 = 1 AND domain = {_LOST}) AS lost, bool_or(domain = 'unknown' AND k % 2 <> 0) AS pending,
  bool_or(source_ref LIKE '%nativeStudyReminderEnabled%') AS reminder FROM migs m JOIN every e USING (migration_id) GROUP BY m.migration_id, m.k),
checks AS (SELECT migration_id, k, unnest(list_concat([
  {{'c': 'V01', 'status': 'passed', 'severity': 'blocking'}}, {{'c': 'V02', 'status': 'passed', 'severity': 'blocking'}},
  {{'c': 'V18', 'status': CASE WHEN NOT reminder THEN 'unverified' WHEN k % 12 <> 0 THEN 'passed' ELSE 'failed' END, 'severity': CASE WHEN reminder AND k % 12 = 0 THEN 'blocking' ELSE 'warning' END}},
  {{'c': 'V19', 'status': CASE WHEN k % 8 = 3 THEN 'failed' ELSE 'passed' END, 'severity': 'blocking'}},
  {{'c': 'V20', 'status': CASE WHEN k % 8 = 2 THEN 'failed' ELSE 'passed' END, 'severity': 'blocking'}},
  {{'c': 'V21', 'status': CASE WHEN pending THEN 'unverified' WHEN lost THEN 'failed' ELSE 'passed' END, 'severity': CASE WHEN lost AND NOT pending THEN 'blocking' ELSE 'warning' END}},
  {{'c': 'V22', 'status': CASE WHEN k % 8 = 4 THEN 'failed' ELSE 'passed' END, 'severity': CASE WHEN k % 8 = 4 THEN 'blocking' ELSE 'warning' END}},
  {{'c': 'V23', 'status': CASE WHEN k % 4 = 0 THEN 'unverified' WHEN k % 4 = 2 THEN 'passed' ELSE 'failed' END, 'severity': 'warning'}},
  {{'c': 'V24', 'status': CASE WHEN k % 5 = 0 THEN 'failed' WHEN k % 5 = 1 THEN 'unverified' ELSE 'passed' END, 'severity': CASE WHEN k % 5 = 0 THEN 'blocking' ELSE 'warning' END}},
  {{'c': 'V25', 'status': CASE WHEN k % 3 = 0 THEN 'unverified' WHEN k % 3 = 1 THEN 'passed' ELSE 'failed' END, 'severity': 'blocking'}}],
  [CASE WHEN lost AND {_LOST} = d.domain THEN {{'c': d.c, 'status': 'failed', 'severity': 'blocking'}} ELSE {{'c': d.c, 'status': 'passed', 'severity': 'info'}} END
    FOR d IN {[dict(c=c, domain=d) for c, d in verification.DOMAIN_CHECKS.items()]}])) AS x FROM counted)"""


def verification_checks(spark, sf):
    def build():
        part = whole_slice(spark, sf)
        n = F.substring("migration_id", 3, 20).cast("bigint")
        records = backup_records(spark, sf).unionByName(device_record_table(spark, sf)).where((F.col("domain") != "unknown") | (n % 2 != 0))
        migrations = records.select("migration_id").distinct().withColumn("source_fingerprint", F.sha2("migration_id", 256))
        lost = F.element_at(F.array(*[F.lit(d) for d in verification.DOMAINS]), (F.floor(n / 8) % len(verification.DOMAINS) + 1).cast("int"))
        parts = part.dispositions.where((n % 8 != 1) | (F.col("domain") != lost))
        payload = dict(part.payload)
        theme = payload["preferences"].where((n % 8 == 2) & (F.col("target_ref") == "theme"))
        payload["preferences"] = payload["preferences"].unionByName(theme)
        gone = migrations.where(n % 8 == 3).select("migration_id", F.lit("gone").alias("target_ref"))
        payload["favorites"] = payload["favorites"].unionByName(gone, allowMissingColumns=True)
        day = migrations.where(n % 8 == 4).select("migration_id", F.lit("odd").alias("target_ref"), F.lit("2024-02-31").alias("date_only"))
        payload["studyRecords"] = payload["studyRecords"].unionByName(day, allowMissingColumns=True)
        sampled = migrations.where(n % 4 != 0).select(
            "migration_id", F.when(n % 4 == 1, "other").otherwise(F.col("source_fingerprint")).alias("source_fingerprint"), (n % 4 == 2).alias("passed"),
        )
        runs = part.dispositions.where(n % 5 != 1).groupBy("migration_id").agg(F.count(F.lit(1)).cast("string").alias("digest")).withColumn("name", F.lit("dispositions"))
        again = runs.withColumn("digest", F.when(n % 5 == 0, "changed").otherwise(F.col("digest")))
        drill = migrations.where(n % 3 != 0).withColumn("passed", n % 3 == 1)
        total = b.words(spark, sf).agg(F.count(F.lit(1))).scalar()
        integrity = spark.range(1).select(total.alias("expected_total"), total.alias("actual_total"), F.lit(True).alias("languages_match"), F.lit(True).alias("valid"))
        return durable(verification.verify(
            migrations, records, parts, payload, integrity, reminders=part.reminders.where(n % 12 != 0), sampling=sampled,
            replay=verification.replay_equal(runs, again), rollback=drill,
        ))

    return stored(spark, sf, "checks", build)


@query("verification_checks", f"WITH {VERIFY_SQL} SELECT migration_id, x.c AS check_id, x.status AS status, x.severity AS severity FROM checks")
def verification_check_rows(spark, sf):
    """All 25 checks of every migration over its whole payload."""
    return verification_checks(spark, sf).select("migration_id", "check_id", "status", "severity")


@query("verification_reports", f"""WITH {VERIFY_SQL}
SELECT migration_id, bool_and(x.status = 'passed') AS passed, count(*) AS checks,
  coalesce(string_agg(x.c, ',' ORDER BY x.c) FILTER (WHERE x.status <> 'passed' AND x.severity = 'blocking'), '') AS blocking_check_ids FROM checks GROUP BY migration_id""")
def verification_reports(spark, sf):
    return verification.verification_reports(verification_checks(spark, sf)).select("migration_id", "passed", "checks", "blocking_check_ids")


@query("activation_gate", """SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN 'INVALID_VERIFICATION_REPORT'
  WHEN c_custkey % 7 = 0 THEN 'SOURCE_MISMATCH' WHEN c_custkey % 2 = 0 THEN 'VERIFICATION_FAILED' WHEN c_custkey % 5 = 0 THEN 'MIGRATION_NOT_STAGED'
  WHEN c_custkey % 3 = 0 THEN 'SOURCE_MISMATCH' WHEN c_custkey % 17 = 0 THEN 'ISOLATED_DATASET_REQUIRED' ELSE 'committed' END AS status FROM customer""")
def activation_gate(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    mid = k.cast("string").alias("migration_id")
    reports = c.where("c_custkey % 11 <> 0").select(
        mid, F.when(k % 7 == 0, "other").otherwise(k.cast("string")).alias("report_migration_id"), F.lit("fp").alias("source_fingerprint"),
        (k % 2 != 0).alias("passed"), F.when(k % 13 == 0, 24).otherwise(25).alias("checks"),
        F.when(k % 2 == 0, "V03").otherwise("").alias("blocking_check_ids"),
    )
    runs = c.where("c_custkey % 5 <> 0").select(mid, F.concat(F.lit("ds"), k.cast("string")).alias("dataset_id"), F.lit("fp").alias("run_fingerprint"))
    datasets = c.select(
        F.concat(F.lit("ds"), k.cast("string")).alias("dataset_id"), F.when(k % 3 == 0, "x").otherwise("fp").alias("dataset_fingerprint"),
        (k % 17 != 0).alias("has_payload"),
    )
    gate = verification.activation_gate(c.select(mid, k.alias("k")), reports, runs, datasets)
    return gate.select("k", "status")


@query("digest_bindings", """SELECT c_custkey AS k, array_to_string(list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'DISPOSITION_FINGERPRINT' END,
  CASE WHEN c_custkey % 5 = 0 THEN 'PAYLOAD_MAP_DIGEST' END, CASE WHEN c_custkey % 7 = 0 THEN 'PAYLOAD_REPORT_DIGEST' END], lambda x: x IS NOT NULL), ',') AS violations FROM customer""")
def digest_bindings(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    base = c.select(k.cast("string").alias("migration_id"), k.alias("k"))
    reports = base.withColumn("source_fingerprint", F.lit("fp"))
    ident = base.select("migration_id", F.lit("fp").alias("identity_fingerprint"), F.lit("map").alias("map_digest"))
    parts = base.select(
        "migration_id", F.when(F.col("k") % 3 == 0, "x").otherwise("fp").alias("disposition_fingerprint"),
        F.lit("map").alias("bound_map_digest"), F.lit("rep").alias("report_digest"),
    )
    payloads = base.select(
        "migration_id", F.lit("fp").alias("payload_fingerprint"), F.when(F.col("k") % 5 == 0, "x").otherwise("map").alias("payload_map_digest"),
        F.when(F.col("k") % 7 == 0, "x").otherwise("rep").alias("payload_report_digest"),
    )
    checked = verification.check_bindings(reports, ident, parts, payloads)
    return checked.select("k", F.array_join("violations", ",").alias("violations"))


@query("replay_differences", """WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders), b AS (SELECT o_orderkey,
  CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def replay_differences(spark, sf):
    left = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    changed = F.when(F.col("o_orderkey") % 50 == 0, "X").otherwise(F.col("o_orderstatus"))
    return verification.same_rows(left, left.select("o_orderkey", changed.alias("o_orderstatus")))


@query("stage_requests", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 5 <> 0 THEN 'staged' ELSE 'refused' END
  WHEN o_orderkey % 3 = 0 THEN 'conflict' WHEN o_orderstatus = 'F' THEN 'staged' ELSE 'replayed' END AS status FROM orders""")
def stage_requests(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    names = ["source_fingerprint", "snapshot_digest", "report_digest", "payload_digest"]
    mid = k.cast("string").alias("migration_id")
    requests = o.select(mid, k.alias("k"), (k % 5 != 0).alias("validated"), *[F.lit(n).alias(n) for n in names])
    runs = o.where("o_orderkey % 2 <> 0").select(
        mid, F.when(F.col("o_orderstatus") == "F", "ROLLED_BACK").otherwise("VALIDATING").alias("run_status"),
        *[F.lit(n).alias(n) for n in names[:3]], F.when(k % 3 == 0, "x").otherwise(names[3]).alias(names[3]),
    )
    return store.stage_status(requests, runs).select("k", "status")


@query("pointer_requests", """WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'commit' ELSE 'rollback' END AS action,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderstatus = 'O' THEN 'VALIDATING' WHEN o_orderstatus = 'F' THEN 'COMPLETED' ELSE 'ROLLED_BACK' END AS st,
  o_orderkey % 10 = 4 OR o_orderkey % 10 = 5 AS active FROM orders)
SELECT k, CASE WHEN st IS NULL THEN 'not-staged' WHEN action = 'commit' THEN CASE st WHEN 'COMPLETED' THEN CASE WHEN active THEN 'replayed' ELSE 'conflict' END
    WHEN 'VALIDATING' THEN CASE WHEN k % 3 <> 0 THEN 'committed' ELSE 'conflict' END ELSE 'conflict' END
  ELSE CASE st WHEN 'ROLLED_BACK' THEN CASE WHEN k % 4 = 1 THEN 'replayed' ELSE 'conflict' END
    WHEN 'COMPLETED' THEN CASE WHEN active THEN 'rolled-back' ELSE 'conflict' END ELSE 'conflict' END END AS status FROM r""")
def pointer_requests(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    mid = k.cast("string").alias("migration_id")
    requests = o.select(mid, k.alias("k"), F.when(k % 2 == 0, "commit").otherwise("rollback").alias("action"))
    runs = o.where("o_orderkey % 7 <> 0").select(
        mid, F.when((k % 10 == 4) | (k % 10 == 5), "active").otherwise(F.concat(F.lit("d"), k.cast("string"))).alias("dataset_id"),
        F.when(F.col("o_orderstatus") == "O", "VALIDATING").when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("ROLLED_BACK").alias("run_status"),
        (k % 3 != 0).alias("validated"), F.when(k % 4 == 1, "active").otherwise("old").alias("prior_dataset_id"),
    )
    pointer = o.agg(F.lit("active").alias("active_dataset_id"))
    return store.pointer_status(requests, runs, pointer).select("k", "status")


# --- whole texts and the whole plan ---------------------------------------------------------


@query("normalized_documents", """SELECT doc_id, sha256(lower(regexp_replace(nfc_normalize(text), '^\\s+|\\s+$', '', 'g'))) AS form FROM documents""")
def normalized_documents(spark, sf):
    from ..functions.text import corpus_headword

    return table(spark, sf, "documents").select("doc_id", F.sha2(corpus_headword(F.col("text")), 256).alias("form"))


@query("refused_records", """SELECT 'r-' || CAST(doc_id AS VARCHAR) AS source_ref FROM documents WHERE doc_id % 6 IN (1, 2)""")
def refused_records(spark, sf):
    """Only plain secrets are refused, not control characters, long numbers or texts about a key."""
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    body = (
        F.when(k % 6 == 0, F.lit('{"inner":{"DeepSeek_API_Key":"[REDACTED]","n":1.0E10}}'))
        .when(k % 6 == 1, F.lit('{"inner":{"DeepSeek_API_Key":"sk-plain"}}'))
        .when(k % 6 == 2, F.lit('{"inner":[{"\\u0064eepseekapikey":1}]}'))
        .when(k % 6 == 3, F.lit('{"a":"x\\u001Fy"}'))
        .when(k % 6 == 4, F.lit('{"a":1.0E30,"note":"deepseek api key"}'))
        .otherwise(F.lit('{"a":1234567890.123456789, "note":"deepseekApiKey\\u003a"}'))
    )
    records = d.select(F.concat(F.lit("r-"), k.cast("string")).alias("source_ref"), F.lit(None).cast("string").alias("key"), body.alias("json"))
    return bk.refuse_plain_secrets(records)[1].select("source_ref")


def whole_slice(spark, sf):
    """The whole plan over backups and device captures as one stream of records."""
    from ..plans import migration

    def build():
        records = backup_records(spark, sf).unionByName(device_record_table(spark, sf))
        captures = device_captures(spark, sf).select("migration_id").distinct()
        headers = parsed(spark, sf).select("migration_id", "error", "export_date").unionByName(
            captures.select("migration_id", F.lit(None).cast("string").alias("error"), F.lit(None).cast("timestamp").alias("export_date"))
        )
        return migration.transform(headers, *migration.safe_records(records), b.words(spark, sf))

    return stored(spark, sf, "slice", build)


@query("migration_conservation", f"""WITH {BACKUP_SQL}, {DEVICE_RECORDS_SQL},
every AS (SELECT migration_id, source_ref, domain, '' AS json FROM recs UNION ALL SELECT migration_id, source_ref, domain, json FROM drecs)
SELECT migration_id, domain, count(*) AS dispositions, count(DISTINCT source_ref) AS sources, count(*) FILTER (WHERE json = '"sk-1"') AS refused FROM every WHERE domain <> 'unknown' GROUP BY ALL""")
def migration_conservation(spark, sf):
    """The whole plan over every backup and capture: each known record ends in exactly one disposition, refused ones too."""
    return whole_slice(spark, sf).dispositions.groupBy("migration_id", "domain").agg(
        F.count(F.lit(1)).alias("dispositions"), F.count_distinct("source_ref").alias("sources"),
        F.count_if(F.col("reason") == "SENSITIVE_VALUE_PRESENT").alias("refused"),
    )


@query("migration_payload_rows")
def migration_payload_rows(spark, sf):
    """Payload rows per migration and collection of the whole plan."""
    from ..plans import migration

    return migration.payload_keys(whole_slice(spark, sf)).groupBy("migration_id", "domain").agg(F.count(F.lit(1)).alias("n"))
