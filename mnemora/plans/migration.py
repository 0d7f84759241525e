"""The whole migration of a table of backups, from text to verified payload."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import digest, set_digest
from ..operators import domains, identity, outcomes, sampling
from ..session import durable, shared_dir
from ..sources.backups import parse_backups, refuse_plain_secrets, source_records


@dataclass
class Slice:
    """Results of one run over all its migrations."""

    headers: DataFrame
    records: DataFrame
    refused: DataFrame
    entries: DataFrame
    payload: dict[str, DataFrame]
    dispositions: DataFrame
    reminders: DataFrame


def read_records(backups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers, safe records (stored once; every later stage reads them) and refused records."""
    parsed = parse_backups(backups)
    headers = durable(parsed.drop("root", "text"))
    return headers, *safe_records(source_records(parsed))


def safe_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Safe and refused records, tested for secrets once: every transform reads one domain of the stored rows."""
    safe, refused = refuse_plain_secrets(durable(records))
    return _by_domain(safe), durable(refused)


def _by_domain(records: DataFrame) -> DataFrame:
    """Stored in a folder per domain, so that a scan of one domain reads no other."""
    spark = records.sparkSession
    path = f"{shared_dir(spark)}/mnemora/{uuid.uuid4().hex}"
    records.write.partitionBy("domain").parquet(path)
    return spark.read.schema(records.schema).parquet(path)


def transform(headers: DataFrame, records: DataFrame, refused: DataFrame, corpus: DataFrame) -> Slice:
    entries = durable(identity.identity_map(domains.identity_inputs(records), corpus))
    index = identity.WordIndex(entries)
    payload, parts = {}, []

    def add(name: str, result: tuple[DataFrame, ...]) -> None:
        payload[name] = durable(result[0])
        parts.append(result[-1])

    add("words", domains.words(records, entries, corpus))
    add("overrides", domains.overrides(records, entries, payload["words"]))
    add("folders", domains.folders(records))
    add("favorites", domains.favorites(records, index))
    add("groupProgress", domains.group_progress(records))
    add("mastery", domains.mastery(records, index))
    add("studyRecords", domains.study_records(records))
    wrong = domains.wrong_book(records, index)
    add("wrongBook", wrong)
    payload["wrongBookAnswers"] = wrong[1]
    add("fsrsCards", domains.review_cards(records, index))
    add("fsrsLogs", domains.review_logs(records, index, payload["fsrsCards"]))
    talk = domains.conversations(records, index)
    add("aiConversations", talk)
    payload["aiMessages"] = durable(talk[1])
    quiz = domains.quizzes(records, index)
    add("aiQuizHistory", quiz)
    payload["aiQuizAnswers"] = quiz[1]
    add("recycleBin", domains.recycle_bin(records, index, headers))
    add("preferences", domains.preferences(records))

    dispositions = parts[0]
    for part in parts[1:]:
        dispositions = dispositions.unionByName(part)
    dispositions = durable(outcomes.with_archives(dispositions).unionByName(outcomes.refused_dispositions(refused)))
    payload["archives"] = outcomes.archive_rows(
        dispositions.where("archive_kind is not null").drop("archive_kind", "archive_ref"), records
    )[0]
    return Slice(headers, records, refused, entries, payload, dispositions, domains.reminder_settings(records))


def payload_digests(part: Slice) -> DataFrame:
    """Digest of every collection per migration, for replay and staging checks."""
    found = None
    for name, df in [*part.payload.items(), ("dispositions", part.dispositions)]:
        body = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns) if c != "migration_id"]))
        one = df.groupBy("migration_id").agg(set_digest(digest(body)).alias("digest")).withColumn(
            "name", F.lit(name)
        )
        found = one if found is None else found.unionByName(one)
    return found


def payload_keys(part: Slice) -> DataFrame:
    """(migration, domain, target) of every payload row."""
    found = None
    for name, df in part.payload.items():
        if name in ("archives", "wrongBookAnswers", "aiQuizAnswers", "aiMessages"):
            continue
        one = df.select("migration_id", F.lit(name).alias("domain"), "target_ref")
        found = one if found is None else found.unionByName(one)
    return found


def sample_evidence(part: Slice, fingerprints: DataFrame) -> DataFrame:
    """Sampling evidence per migration and category, seeded by the source fingerprint."""
    rows = durable(
        sampling.categorize(part.records, part.entries).join(fingerprints, "migration_id")
        .select("migration_id", "source_ref", "domain", "record_digest", "category", "source_fingerprint")
    )
    return sampling.sampling_evidence(
        rows, sampling.fixed_sample(rows), part.dispositions, payload_keys(part), part.payload["archives"]
    )
