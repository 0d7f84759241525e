"""Deterministic identity map of legacy words, and lookups through it.

Each rule is a set operation, so the map does not depend on the order of the records: counts
per raw id, the first row per generated id, and anti-checks on taken ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import digest, key_digest
from ..functions.text import (
    clean_columns, collapse_spaces, is_word_id, quoteless, relation_headword,
)
from ..session import compact
from ..skew import attach_by_key
from .corpus import resolve_distinct

# Resolution and quarantine code of each corpus status.
STATUS_RESOLUTION = {
    "exact": "canonical-exact",
    "candidate": "canonical-headword-candidate",
    "ambiguous": "canonical-headword-ambiguous",
    "language-conflict": "canonical-language-conflict",
    "not-found": "not-found",
}
STATUS_CODE = {
    "ambiguous": "CANONICAL_HEADWORD_AMBIGUOUS",
    "language-conflict": "CANONICAL_LANGUAGE_CONFLICT",
    "not-found": "CANONICAL_NOT_FOUND",
    "candidate": "CANONICAL_CONTEXT_REQUIRED",
    "exact": "BUILT_IN_UNRESOLVED",
}
GENERATED_ID = r"^user-v1-[0-9a-f]{24}"
OPTIONAL = ["headword", "reading", "phonetic", "folder", "source_id", "imported_at"]


def _lookup(names: dict[str, str]):
    pairs = []
    for key, value in names.items():
        pairs += [F.lit(key), F.lit(value)]
    return F.create_map(*pairs)


def normalize_identity(records: DataFrame) -> DataFrame:
    """Normal forms of the identity fields; a missing language becomes ja, marked as such."""
    have = set(records.columns)
    for name in [*OPTIONAL, "is_built_in", "raw_digest"]:
        if name not in have:
            kind = "boolean" if name == "is_built_in" else "string"
            records = records.withColumn(name, F.lit(None).cast(kind))
    names = ["word_id", *OPTIONAL]
    cleaned = clean_columns(records, {f"__{n}": F.col(n) for n in names})
    return cleaned.select(
        "migration_id", "source_ref", "source_kind",
        F.coalesce("language", F.lit("ja")).alias("language"),
        F.col("language").isNull().alias("language_defaulted"),
        F.col("__word_id").alias("raw_word_id"),
        F.col("__headword").alias("raw_headword"),
        quoteless(F.col("__headword")).alias("normalized_headword"),
        F.lower(collapse_spaces(F.col("__folder"))).alias("normalized_folder"),
        F.coalesce("__reading", "__phonetic").alias("sound"),
        F.col("__source_id").alias("source_id"),
        F.col("__imported_at").alias("imported_at"),
        F.coalesce("is_built_in", F.lit(False)).alias("is_built_in"),
        "raw_digest",
    )


def union_inputs(words: DataFrame, overrides: DataFrame) -> DataFrame:
    """Word and override rows as one identity input."""
    return words.unionByName(overrides, allowMissingColumns=True)


def identity_map(records: DataFrame, words: DataFrame) -> DataFrame:
    """One row per record: mapped to a corpus or user word id, or quarantined with a code.

    The distinct (migration, language, id, headword) references are resolved and counted once;
    their rows then get the result in one skew-safe join.
    """
    # Stored: the references are counted first, and the rows get their result in a second scan.
    rows = compact(normalize_identity(records).withColumn(
        "__ref",
        key_digest(F.col("migration_id"), F.col("language"), F.col("raw_word_id"), F.col("raw_headword")),
    ))
    is_word = F.col("source_kind") == "word"
    own_id = is_word & ~F.col("is_built_in") & is_word_id(F.col("raw_word_id"))
    # The columns of a key are grouped with it: first values of texts would make Spark sort all rows.
    distinct = compact(rows.groupBy("__ref", "migration_id", "language", "raw_word_id", "raw_headword").agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(own_id).alias("__own"),
    ))
    per_id = (
        distinct.where("raw_word_id is not null").groupBy("raw_word_id", "migration_id")
        .agg(F.sum("__own").alias("user_id_count"))
    )
    resolved = resolve_distinct(distinct, words, "raw_word_id", "raw_headword").join(
        per_id, ["raw_word_id", "migration_id"], "left"
    )
    rows = attach_by_key(
        rows, resolved, ["__ref"], "__n", ["corpus_status", "corpus_id", "user_id_count"]
    ).drop("__ref")

    has_id, status = F.col("raw_word_id").isNotNull(), F.col("corpus_status")
    count = F.coalesce("user_id_count", F.lit(0))
    conflict = F.coalesce(status == "language-conflict", F.lit(False)) & has_id
    kind = F.col("source_kind")
    preserved = (
        has_id & kind.isin("word", "relation") & ~F.col("is_built_in")
        & is_word_id(F.col("raw_word_id")) & (count == 1) & ~conflict
    )
    loose_code = F.when(kind == "override-reference", "OVERRIDE_ORPHAN").otherwise("RELATION_UNRESOLVED")
    heuristic = (status == "candidate") & F.col("normalized_folder").isNull()
    rule = (
        F.when(~has_id & F.col("normalized_headword").isNull(), "empty")
        .when((kind == "override-reference") & ~has_id, "orphan")
        .when(status == "exact", "exact")
        .when(preserved, "preserved")
        .when(~is_word, "loose")
        .when(F.col("is_built_in") & heuristic, "heuristic")
        .when(F.col("is_built_in"), "built-in")
        .when(F.col("normalized_headword").isNull(), "empty")
        .when(F.col("raw_digest").isNull(), "no-digest")
        .otherwise("generated")
    )
    cause = (
        F.when(~has_id, "USER_ID_GENERATED")
        .when(conflict, "CANONICAL_ID_CONFLICT_GENERATED")
        .when(count > 1, "USER_ID_DUPLICATE_GENERATED")
        .when(is_word_id(F.col("raw_word_id")), "USER_ID_GENERATED")
        .otherwise("INVALID_USER_ID")
    )
    base = F.concat(
        F.lit("user-v1-"),
        F.substring(
            digest(
                F.col("language"), F.col("normalized_headword"), F.col("sound"),
                F.col("normalized_folder"), F.col("source_id"), F.col("imported_at"),
                F.col("raw_digest"),
            ), 1, 24,
        ),
    )
    ruled = compact(
        rows.withColumn("rule", rule).withColumn("cause", cause)
        .withColumn("base_id", F.when(F.col("rule") == "generated", base))
    )
    reserved = per_id.join(
        words.select(F.col("id").alias("raw_word_id")), "raw_word_id", "left_anti"
    ).where((F.col("user_id_count") == 1) & F.col("raw_word_id").rlike(GENERATED_ID))
    return _outcomes(_generated_ids(ruled, reserved, words), loose_code)


def _generated_ids(ruled: DataFrame, reserved: DataFrame, words: DataFrame) -> DataFrame:
    """Pick the first free variant of each generated id; a later equal row is a duplicate.

    The preimage of a base id holds the raw digest, so equal base ids are repeats of one row,
    and only an id that itself looks generated can block one. Both tables are small.
    """
    keys = ["base_id", "migration_id"]
    made = ruled.where("base_id is not null")
    repeats = (
        made.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"), F.min("source_ref").alias("first_ref"))
        .where(F.col("__n") > 1)
    )
    base_of = F.substring("__id", 1, 32).alias("base_id")
    mine = reserved.select("migration_id", F.col("raw_word_id").alias("__id"))
    ours = words.where(F.col("id").rlike(GENERATED_ID)).select(F.col("id").alias("__id")).distinct()
    bases = made.select(*keys, "raw_digest").distinct()
    touched = bases.join(mine.select("migration_id", base_of), keys, "left_semi").unionByName(
        bases.join(ours.select(base_of), "base_id", "left_semi")
    ).distinct()
    raw = F.col("raw_digest")
    tails = [
        F.lit(""), F.concat(F.lit("-"), F.substring(raw, 1, 8)),
        F.concat(F.lit("-"), F.substring(raw, 1, 16)), F.concat(F.lit("-"), raw),
    ]
    variants = touched.select(
        *keys, F.posexplode(F.array(*[F.concat("base_id", t) for t in tails])).alias("__rank", "__id")
    )
    free = (
        variants.join(mine, ["migration_id", "__id"], "left_anti")
        .join(ours, "__id", "left_anti")
        .groupBy(*keys).agg(F.min_by("__id", "__rank").alias("free_id"))
    )
    choices = (
        touched.select(*keys).join(free, keys, "left").withColumn("touched", F.lit(True))
        .join(repeats, keys, "full")
    )
    out = attach_by_key(
        ruled, choices.withColumn("__n", F.coalesce("__n", F.lit(1))), keys, "__n",
        ["first_ref", "touched", "free_id"],
    )
    is_first = F.col("first_ref").isNull() | (F.col("first_ref") == F.col("source_ref"))
    chosen = F.when(F.col("touched"), F.col("free_id")).otherwise(F.col("base_id"))
    return out.withColumn("generated_id", F.when(is_first, chosen))


def _outcomes(placed: DataFrame, loose_code) -> DataFrame:
    rule, status = F.col("rule"), F.col("corpus_status")
    taken = (rule == "generated") & F.col("generated_id").isNull()
    mapped = rule.isin("exact", "preserved", "heuristic") | ((rule == "generated") & ~taken)
    resolution = (
        F.when(rule.isin("empty", "orphan"), "invalid")
        .when(rule == "exact", "canonical-exact")
        .when(rule == "preserved", "user-id-preserved")
        .when(rule.isin("generated", "no-digest"), "user-id-generated")
        .otherwise(_lookup(STATUS_RESOLUTION)[status])
    )
    code = (
        F.when(rule == "empty", "EMPTY_IDENTITY")
        .when(rule == "orphan", "OVERRIDE_ORPHAN")
        .when(rule == "loose", loose_code)
        .when(rule == "built-in", _lookup(STATUS_CODE)[status])
        .when(rule == "no-digest", "MISSING_RAW_RECORD_DIGEST")
        .when(taken, "DUPLICATE_TARGET_ID")
    )
    reason = (
        F.when(rule == "exact", "CANONICAL_ID_MATCH")
        .when(rule == "preserved", "USER_ID_PRESERVED")
        .when(rule == "heuristic", "CANONICAL_HEADWORD_HEURISTIC")
        .when((rule == "generated") & ~taken, F.col("cause"))
        .otherwise(code)
    )
    target = (
        F.when(rule.isin("exact", "heuristic"), F.col("corpus_id"))
        .when(rule == "preserved", F.col("raw_word_id"))
        .otherwise(F.col("generated_id"))
    )
    return placed.select(
        "migration_id", "source_ref", "source_kind", "language", "language_defaulted",
        "raw_word_id", "raw_headword", "normalized_headword", "normalized_folder", "raw_digest",
        F.when(mapped, "mapped").otherwise("quarantined").alias("outcome"),
        resolution.alias("resolution"),
        F.when(rule == "exact", "exact").when(rule == "heuristic", "heuristic")
        .when(rule == "preserved", "preserved").when(mapped, "generated").alias("confidence"),
        reason.alias("reason"),
        code.alias("quarantine_code"),
        F.when(mapped, target).alias("target_word_id"),
        F.when(rule.isin("exact", "heuristic"), "canonical").when(mapped, "user").alias("target_kind"),
    )


def identity_counts(entries: DataFrame) -> DataFrame:
    mapped = F.col("outcome") == "mapped"
    return entries.groupBy("migration_id").agg(
        F.count(F.lit(1)).alias("source"),
        F.count_if(mapped).alias("mapped"),
        F.count_if(~mapped).alias("quarantined"),
        F.count_if(F.col("target_kind") == "canonical").alias("canonical"),
        F.count_if(F.col("target_kind") == "user").alias("user_words"),
    )


def _unique_target():
    """The one mapped target of a group, null when there is none or more than one."""
    target = F.when(F.col("outcome") == "mapped", F.col("target_word_id"))
    return F.when(F.min(target) == F.max(target), F.min(target))


class WordIndex:
    """Lookup tables over the word entries of an identity map, one row per key."""

    def __init__(self, entries: DataFrame):
        slim = entries.where("source_kind = 'word'").select(
            "migration_id", "language", "raw_word_id", "outcome", "target_word_id",
            relation_headword(F.col("raw_headword")).alias("headword_key"),
        )
        words = compact(slim)
        by_id = words.where("raw_word_id is not null")
        by_head = words.where("headword_key is not null")
        key = F.col("raw_word_id").alias("__key")
        head = F.col("headword_key").alias("__head")
        self.ids = by_id.groupBy("migration_id", key).agg(_unique_target().alias("any_id_target"))
        self.ids = self.ids.withColumn("id_known", F.lit(True))
        self.id_targets = by_id.groupBy("migration_id", key, "language").agg(
            _unique_target().alias("id_target")
        )
        self.heads = by_head.groupBy("migration_id", head).agg(
            _unique_target().alias("any_head_target")
        )
        self.head_targets = by_head.groupBy("migration_id", head, "language").agg(
            _unique_target().alias("head_target")
        )


def resolve_relations(
    rows: DataFrame, index: WordIndex, any_language: bool = False, target: str = "target_word_id"
) -> DataFrame:
    """Add the word a (migration, language, raw_word_id) reference means, if exactly one.

    The raw id is tried first; the headword only when no entry has that raw id. Distinct
    references are resolved once and joined back skew-safe.
    """
    parts = [F.col("migration_id"), F.col("raw_word_id")]
    if not any_language:
        parts.append(F.col("language"))
    usable = F.col("raw_word_id").isNotNull()
    if not any_language:
        usable = usable & F.col("language").isNotNull()
    keyed = rows.withColumn("__rel", F.when(usable, key_digest(*parts)))
    # The columns of a key are grouped with it: first values of texts would make Spark sort all rows.
    columns = ["migration_id", F.col("raw_word_id").alias("__key"), *([] if any_language else ["language"])]
    distinct = (
        keyed.where("__rel is not null").groupBy("__rel", *columns).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__head", relation_headword(F.col("__key")))
        .join(index.ids, ["migration_id", "__key"], "left")
    )
    if any_language:
        found = distinct.join(index.heads, ["migration_id", "__head"], "left").withColumn(
            target, F.when(F.col("id_known"), F.col("any_id_target")).otherwise(F.col("any_head_target"))
        )
    else:
        found = (
            distinct.join(index.id_targets, ["migration_id", "__key", "language"], "left")
            .join(index.head_targets, ["migration_id", "__head", "language"], "left")
            .withColumn(
                target, F.when(F.col("id_known"), F.col("id_target")).otherwise(F.col("head_target"))
            )
        )
    return attach_by_key(
        keyed, found.select("__rel", "__n", target), ["__rel"], "__n", [target]
    ).drop("__rel")
