"""Corpus scans, integrity, digests and identity resolution."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..fold import fold_by_key
from ..functions.hashing import key_digest
from ..functions.text import corpus_headword, trim_all
from ..session import durable
from ..skew import attach_by_key, ordinal

# The acceptance target of the bilingual corpus.
ACCEPTANCE_TARGET = {"total": 9828, "ja": 5906, "en": 3922}


def write_corpus(words: DataFrame, path: str) -> None:
    words.write.mode("overwrite").partitionBy("language").parquet(path)


def read_corpus(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """Scan the corpus; a language reads only its own folder."""
    words = spark.read.parquet(path)
    return words.where(F.col("language") == language) if language else words


def language_counts(words: DataFrame, manifest_counts: DataFrame) -> DataFrame:
    """Actual against expected words per language; both sides keep their languages."""
    actual = words.groupBy("language").agg(F.count(F.lit(1)).alias("actual"))
    return (
        manifest_counts.select("language", F.col("word_count").alias("expected"))
        .join(actual, "language", "full")
        .select(
            "language",
            F.coalesce("expected", F.lit(0)).alias("expected"),
            F.coalesce("actual", F.lit(0)).alias("actual"),
        )
        .withColumn("matches", F.col("expected") == F.col("actual"))
    )


def duplicate_identities(words: DataFrame) -> DataFrame:
    return (
        words.groupBy("language", "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    )


_CONTENT = ["language", "id", "headword", "reading", "phonetic", "part_of_speech", "meaning", "level", "difficulty"]
#: Hex digits of a leaf that name its range, and of a range that name its parent.
RANGE_DIGITS = (5, 2)


def tree_digest(leaves: DataFrame, group: list[str]) -> DataFrame:
    """``group, digest`` of the multiset of ``leaf`` (SHA-256, hex) in each group, by a tree of hashes.

    Leaves fall into ranges by their first digits. A range is the hash of its leaves in order, its parent
    the hash of the ranges below it, and the digest that of the parents: a difference can be followed down
    to its range. Equal leaves are counted first, so a row that repeats costs one leaf. A list holds one
    2 ** 20th of the different leaves, or at most 4,096 hashes.
    """
    def joined(*parts) -> Column:
        return F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(*parts))), "\n"), 256)

    low, high = RANGE_DIGITS
    counted = leaves.groupBy(*group, "leaf").agg(F.count(F.lit(1)).alias("n"))
    at = F.substring("leaf", 1, low).alias("at")
    ranges = counted.groupBy(*group, at).agg(joined("leaf", F.lit(":"), F.col("n").cast("string")).alias("h"))
    parents = ranges.groupBy(*group, F.substring("at", 1, high).alias("top")).agg(joined("at", F.lit(":"), "h").alias("h"))
    return parents.groupBy(*group).agg(joined("top", F.lit(":"), "h").alias("digest"))


def _leaves(words: DataFrame) -> tuple[Column, Column]:
    """The leaves of a word's identity and of its content; a null and an empty text differ."""
    return key_digest(F.col("language"), F.col("id")), key_digest(*[F.col(c) for c in _CONTENT], F.to_json("tags"))


def corpus_digests(words: DataFrame) -> DataFrame:
    """Identity and content digest per language for a corpus of any size, as trees of hashes."""
    identity, content = _leaves(words)
    counted = words.groupBy("language").agg(F.count(F.lit(1)).alias("words"))
    ids = tree_digest(words.select("language", identity.alias("leaf")), ["language"])
    bodies = tree_digest(words.select("language", content.alias("leaf")), ["language"])
    return counted.join(ids.withColumnRenamed("digest", "ids_digest"), "language").join(
        bodies.withColumnRenamed("digest", "content_digest"), "language"
    )


def whole_digests(words: DataFrame) -> DataFrame:
    """One row ``ids_tree, content_tree`` for the whole corpus; null for an empty one."""
    identity, content = _leaves(words)
    kinds = words.select(F.explode(F.array(
        F.struct(F.lit("ids").alias("kind"), identity.alias("leaf")), F.struct(F.lit("content").alias("kind"), content.alias("leaf"))
    )).alias("x")).select("x.*")
    return tree_digest(kinds, ["kind"]).agg(
        *[F.max(F.when(F.col("kind") == k, F.col("digest"))).alias(f"{k}_tree") for k in ("ids", "content")]
    )


def manifest_digests(words: DataFrame) -> DataFrame:
    """One row ``word_ids_sha256, content_sha256``: the digests that a manifest states.

    Both are SHA-256 of one text over the sorted corpus, the identities by line and the words as a JSON array
    (fields in the order of the table, nulls kept). Such a hash has no parts, so one task reads the sorted
    corpus through it, holding one batch; ``whole_digests`` is the form for large ones. Identities sort in
    binary order.
    """
    identity = F.concat_ws(":", "language", "id")
    body = F.to_json(F.struct(*_CONTENT, "tags"), {"ignoreNullFields": "false"})
    rows = words.select(F.lit(1).alias("corpus"), identity.alias("identity"), body.alias("body"))

    def step(state, row):
        first = state is None
        ids, content = state or (sha256(), sha256(b"["))
        ids.update((b"" if first else b"\n") + row[0].encode())
        content.update((b"" if first else b",") + row[1].encode())
        return ids, content

    def finish(state):
        ids, content = state
        content.update(b"]")
        return ids.hexdigest(), content.hexdigest()

    found = fold_by_key(rows, ["corpus"], ["identity", "body"], ["identity", "body"], "word_ids_sha256 string, content_sha256 string", step, finish)
    return found.agg(
        F.coalesce(F.max("word_ids_sha256"), F.lit(sha256(b"").hexdigest())).alias("word_ids_sha256"),
        F.coalesce(F.max("content_sha256"), F.lit(sha256(b"[]").hexdigest())).alias("content_sha256"),
    )


def integrity_report(words: DataFrame, manifests: DataFrame) -> DataFrame:
    """Per manifest: totals, digests, its errors in order, and ``valid`` when there is none.

    ``manifests``: id, total_word_count, language_counts, word_ids_sha256, content_sha256, and where they are
    stated (else null or absent) ids_tree, content_tree, target_total and target_counts (the acceptance target).
    Digests and totals of the corpus are computed once, whatever the number of manifests.
    """
    for name, kind in (("ids_tree", "string"), ("content_tree", "string"), ("target_total", "bigint"),
                       ("target_counts", "array<struct<language:string,word_count:bigint>>")):
        if name not in manifests.columns:
            manifests = manifests.withColumn(name, F.lit(None).cast(kind))
    words = durable(words)
    counts = words.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("actual_total"), F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("actual")
    )
    twice = duplicate_identities(words).agg(F.count(F.lit(1)).alias("duplicates"))
    # One row each, computed once.
    facts = [durable(t) for t in (totals, twice, manifest_digests(words), whole_digests(words))]
    rows = manifests.select(
        "*", *[t.select(c).scalar().alias(f"__{c}") for t in facts for c in t.columns]
    )

    def counts_of(column: str) -> Column:
        return F.map_from_entries(F.transform(column, lambda x: F.struct(x["language"], x["word_count"])))

    def same(left: Column, right: Column) -> Column:
        languages = F.array_union(F.map_keys(left), F.map_keys(right))
        return F.forall(languages, lambda k: F.coalesce(left[k], F.lit(0)) == F.coalesce(right[k], F.lit(0)))

    expected = counts_of("language_counts")
    target = F.col("target_total").isNotNull()
    checks = {
        "TARGET_TOTAL": ~target | (F.col("target_total") == F.col("total_word_count")),
        "TARGET_LANGUAGES": F.col("target_counts").isNull() | same(expected, counts_of("target_counts")),
        "DUPLICATE_IDENTITY": F.col("__duplicates") == 0,
        "TOTAL_MISMATCH": F.col("__actual_total") == F.col("total_word_count"),
        "LANGUAGE_MISMATCH": same(expected, F.col("__actual")),
        "IDS_DIGEST": F.col("word_ids_sha256") == F.col("__word_ids_sha256"),
        "CONTENT_DIGEST": F.col("content_sha256") == F.col("__content_sha256"),
        "IDS_TREE": F.col("ids_tree").isNull() | (F.col("ids_tree") == F.col("__ids_tree")),
        "CONTENT_TREE": F.col("content_tree").isNull() | (F.col("content_tree") == F.col("__content_tree")),
    }
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in checks.items()]))
    return rows.select(
        "id", F.col("total_word_count").alias("expected_total"), F.col("__actual_total").alias("actual_total"), checks["LANGUAGE_MISMATCH"].alias("languages_match"),
        F.col("__duplicates").alias("duplicates"), errors.alias("errors"), (F.size(errors) == 0).alias("valid"),
    )


def identity_index(words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lookup tables of the corpus: by (language, id), by id, by (language, headword)."""
    by_identity = words.groupBy("language", "id").agg(F.count(F.lit(1)).alias("n_exact"))
    by_id = words.groupBy("id").agg(F.count(F.lit(1)).alias("n_any"))
    by_headword = words.groupBy(
        "language", corpus_headword(F.col("headword")).alias("headword_key")
    ).agg(F.count(F.lit(1)).alias("n_headword"), F.min("id").alias("headword_id"))
    return by_identity, by_id, by_headword


def resolve_distinct(
    distinct: DataFrame, words: DataFrame, id_col: str, headword_col: str
) -> DataFrame:
    """Add ``corpus_status`` and ``corpus_id`` to a table of distinct references."""
    by_identity, by_id, by_headword = identity_index(words)
    keyed = distinct.withColumn("__id", trim_all(F.col(id_col))).withColumn(
        "__headword_key", corpus_headword(F.col(headword_col))
    )
    joined = (
        keyed.join(by_identity.withColumnRenamed("id", "__id"), ["language", "__id"], "left")
        .join(by_id.withColumnRenamed("id", "__id"), "__id", "left")
        .join(
            by_headword.withColumnRenamed("headword_key", "__headword_key"),
            ["language", "__headword_key"], "left",
        )
    )
    status = (
        F.when(F.col("n_exact").isNotNull(), "exact")
        .when(F.col("n_any").isNotNull(), "language-conflict")
        .when(F.col("n_headword") == 1, "candidate")
        .when(F.col("n_headword") > 1, "ambiguous")
        .otherwise("not-found")
    )
    return joined.select(
        *distinct.columns, status.alias("corpus_status"),
        F.when(F.col("n_exact").isNotNull(), F.col("__id"))
        .when(F.col("n_any").isNull() & (F.col("n_headword") == 1), F.col("headword_id"))
        .alias("corpus_id"),
    )


def resolve_references(
    refs: DataFrame, words: DataFrame, id_col: str = "word_id", headword_col: str = "headword"
) -> DataFrame:
    """Resolve (language, id, headword) to exact, language-conflict, candidate, ambiguous or
    not-found; adds ``corpus_status`` and ``corpus_id``.

    Distinct references are resolved once, so the joins to the corpus never see a hot key.
    The result joins back on the reference itself, skew-safe.
    """
    keyed = refs.withColumn("__ref", key_digest(F.col("language"), F.col(id_col), F.col(headword_col)))
    distinct = keyed.groupBy("__ref").agg(
        F.count(F.lit(1)).alias("__n"),
        F.first("language").alias("language"),
        F.first(id_col).alias(id_col),
        F.first(headword_col).alias(headword_col),
    )
    per_ref = resolve_distinct(distinct, words, id_col, headword_col)
    return attach_by_key(
        keyed, per_ref, ["__ref"], "__n", ["corpus_status", "corpus_id"]
    ).drop("__ref")


def levels(words: DataFrame) -> DataFrame:
    """Distinct levels per language with their word counts."""
    return words.groupBy("language", "level").agg(F.count(F.lit(1)).alias("words"))


def search(words: DataFrame, text: str, level: str | None = None) -> DataFrame:
    """Case-folded substring over headword, reading, phonetic and meaning, within a level."""
    needle = text.strip().lower()
    hit = F.lit(False)
    for name in ("headword", "reading", "phonetic", "meaning"):
        hit = hit | F.coalesce(F.lower(F.col(name)).contains(needle), F.lit(False))
    found = words.where(hit) if needle else words
    return found.where(F.col("level") == level) if level else found


def ring_options(items: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """For each item the items at ring offsets 0, 2, 4 and 6 of its group."""
    placed = ordinal(items, group, order, "place")
    sizes = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("__size"))
    # The placement is a checkpointed table, so both sides read it without recomputing it.
    asked = placed.join(sizes, group).select(
        *group, F.col("id").alias("item_id"), "__size", "place",
        F.explode(F.array(*[F.lit(o) for o in (0, 2, 4, 6)])).alias("offset"),
    ).withColumn("place", F.pmod(F.col("place") + F.col("offset"), F.col("__size")))
    target = placed.select(*group, "place", F.col("id").alias("option_id"))
    return asked.join(target, [*group, "place"]).select(*group, "item_id", "offset", "option_id")


def starter_selection(words: DataFrame, starter_ids: DataFrame, language: str) -> DataFrame:
    """The listed ids as words, each with ``complete``; callers stop if any is not."""
    filled = F.lit(True)
    for name in ("headword", "meaning", "phonetic"):
        filled = filled & F.coalesce(F.trim(F.col(name)) != "", F.lit(False))
    of_language = words.where(F.col("language") == language)
    return starter_ids.join(of_language, "id", "left").withColumn("complete", filled)
