"""Digests, digest ids and the 32-bit sampling hash."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# FNV-1a, 32 bit.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
FNV_MASK = 4294967295


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points, as a number."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(
        codes,
        F.lit(FNV_OFFSET).cast("bigint"),
        lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME).cast("bigint")).bitwiseAND(
            F.lit(FNV_MASK).cast("bigint")
        ),
    )


def fnv1a_hex(text: Column) -> Column:
    return F.lpad(F.lower(F.hex(fnv1a(text))), 8, "0")


def digest(*parts: Column) -> Column:
    """SHA-256 over parts joined by ``|``; a null part counts as empty.

    Only for digests whose form is fixed from outside; keys of our own use ``key_digest``.
    """
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def key_digest(*parts: Column) -> Column:
    """SHA-256 that tells parts apart whatever they hold: separators, empty text and null differ."""
    cells = F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)])
    return F.sha2(F.to_json(cells, {"ignoreNullFields": "false"}), 256)


def digest_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and the first 24 hex digits of the digest."""
    return F.concat(F.lit(prefix), F.substring(digest(*parts), 1, 24))


def set_digest(row_digest: Column) -> Column:
    """Aggregate: digest of a multiset of row digests, free of order.

    Each SHA-256 is read as eight 32-bit words that are summed (the additive multiset hash of
    Bellare and Micciancio), then hashed with the row count. It combines map-side, so a set of
    any size costs one row per partition and is never collected.
    """
    words = [
        F.sum(F.conv(F.substring(row_digest, 1 + 8 * i, 8), 16, 10).cast("decimal(28,0)"))
        for i in range(8)
    ]
    texts = [F.coalesce(w.cast("string"), F.lit("0")) for w in words]
    return F.sha2(F.concat_ws("|", F.count(row_digest).cast("string"), *texts), 256)


def json_digest(**fields: Column) -> Column:
    """SHA-256 of a JSON object with the fields in the given order, nulls kept."""
    body = F.struct(*[c.alias(name) for name, c in fields.items()])
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def json_id(prefix: str, **fields: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(json_digest(**fields), 1, 24))
