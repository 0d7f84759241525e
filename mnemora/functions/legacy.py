"""Readers for loosely typed legacy JSON, held as VARIANT columns.

``Fields`` reads named fields; its readers take field names in order of preference. A field is
*present* when the object has the key, also with a JSON null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .text import clean_text

MAX_SAFE_INTEGER = 9007199254740991

# Fixed value: the accepted instant format (ISO-8601 date, optional time and offset).
ISO_INSTANT = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?)?$"
)
# First characters of a value's JSON text and the type they mean.
_KINDS = {
    '"': "string", "{": "object", "[": "array", "t": "boolean", "f": "boolean", "n": "null",
    **dict.fromkeys("-0123456789", "number"),
}


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def members(value: Column) -> Column:
    """The fields of an object as a map, null for other values: a path would be walked from the root for every field."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def kind_of_json(json: Column) -> Column:
    """JSON type name of a value given as JSON text: null, boolean, number, string, array or object."""
    pairs = []
    for start, name in _KINDS.items():
        pairs += [F.lit(start), F.lit(name)]
    return F.create_map(*pairs)[F.substring(json, 1, 1)]


def kind(value: Column) -> Column:
    """JSON type name; the schema of a value would be merged from all of its members."""
    return kind_of_json(F.to_json(value))


def text_of(value: Column) -> Column:
    """The value if it is a JSON string, cleaned; else null."""
    return clean_text(F.when(kind(value) == "string", F.try_variant_get(value, "$", "string")))


def as_text(value: Column, kind_of: Column) -> Column:
    """Scalars as they are, arrays and objects as JSON, null as null."""
    return (
        F.when(kind_of.isin("array", "object"), F.to_json(value))
        .when(kind_of != "null", F.try_variant_get(value, "$", "string"))
    )


def number_of(value: Column) -> Column:
    return F.when(kind(value) == "number", F.try_variant_get(value, "$", "double"))


def count_value(number: Column) -> Column:
    """Whole nonnegative count: missing or negative becomes 0, fractions are floored."""
    return F.when(number >= 0, F.floor(number)).otherwise(F.lit(0)).cast("bigint")


def count_defaulted(number: Column) -> Column:
    return number.isNull() | (number < 0)


def count_floored(number: Column) -> Column:
    return F.coalesce((number >= 0) & (number != F.floor(number)), F.lit(False))


def parse_instant(text: Column) -> Column:
    return F.when(text.rlike(ISO_INSTANT), F.try_to_timestamp(text))


def date_only(text: Column) -> Column:
    """Struct(value, flag): a plain date keeps its text; another instant keeps its date, flagged."""
    plain = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    parsed = parse_instant(text)
    return F.struct(
        F.when(plain, text).otherwise(F.date_format(parsed, "yyyy-MM-dd")).alias("value"),
        F.when(text.isNull(), "DATE_MISSING").when(~plain, "DATE_INVALID").alias("flag"),
    )


def review_dimension(language: Column, raw: Column) -> Column:
    name = F.lower(raw)
    return (
        F.when(name == "meaning", "meaning")
        .when((language == "ja") & name.isin("kanji", "spelling"), "spelling")
        .when((language == "ja") & name.isin("kana", "reading"), "reading")
        .when((language == "en") & name.isin("kanji", "word", "spelling"), "spelling")
        .when((language == "en") & name.isin("kana", "listening"), "listening")
    )


def relation_key(raw: Column) -> Column:
    """Parse ``lang:id`` or ``lang:id:dimension`` (the id may hold ``:``)."""
    parts = F.split(raw, ":")
    n = F.size(parts)
    head = F.element_at(parts, 1)
    language = F.when((n >= 2) & head.isin("ja", "en"), head)
    word = F.when(n == 2, F.element_at(parts, 2)).when(
        n >= 3, F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), ":")
    )
    return F.struct(
        language.alias("language"),
        F.when(word != "", word).alias("raw_word_id"),
        F.when(n >= 3, review_dimension(language, F.element_at(parts, -1))).alias("dimension"),
    )


def reminder_time(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), trimmed)


def reminder_weekdays(value: Column, kind_of: Column) -> Column:
    """Whole numbers 0..6 of the array, in order, repeats kept; null if not an array."""
    items = F.when(kind_of == "array", F.try_variant_get(value, "$", "array<variant>"))
    days = F.transform(items, lambda x: number_of(x))
    kept = F.filter(days, lambda x: (x == F.floor(x)) & x.between(0, 6))
    return F.transform(kept, lambda x: x.cast("int"))


def version_number(value: Column, default: int | None) -> Column:
    """Nonnegative whole number, else the default."""
    number = F.try_variant_get(value, "$", "double")
    good = (number >= 0) & (number == F.floor(number))
    fallback = F.lit(default).cast("bigint")
    return F.when(good, number.cast("bigint")).otherwise(fallback)


class Fields:
    """Fields of one VARIANT column, read once each into columns of their own.

    ``df`` carries, per field, its value, JSON text, string, number and (for ``texts``) cleaned text, as far as
    they are used. Each step is a projection over the one before, so no costly expression is computed twice.
    """

    def __init__(
        self, df: DataFrame, names: Sequence[str], texts: Sequence[str] = (), value: str = "v",
        tag: str = "f",
    ):
        names, texts = list(dict.fromkeys([*names, *texts])), list(dict.fromkeys(texts))
        self.tag, self.value = tag, value
        # Columns are numbered: names that differ only in case would clash.
        self.places = {n: i for i, n in enumerate(names)}
        at = self._at
        df = df.withColumn(at("m", ""), members(F.col(value)))
        df = df.withColumn(at("o", ""), F.col(at("m", "")).isNotNull())
        df = df.withColumns({at("v", n): F.col(at("m", ""))[n] for n in names}
                            | {at("j", n): F.to_json(F.col(at("m", ""))[n]) for n in names}).drop(at("m", ""))
        steps = {}
        for n in names:
            j = F.col(at("j", n))
            # Text without an escape is what stands between the quotes.
            bare = F.when(F.contains(j, F.lit("\\")), F.try_variant_get(F.try_parse_json(j), "$", "string"))
            steps[at("s", n)] = F.when(F.startswith(j, F.lit('"')), bare.otherwise(F.substring(j, F.lit(2), F.length(j) - 2)))
            steps[at("n", n)] = F.when(kind_of_json(j) == "number", j.cast("double"))
        df = df.withColumns(steps)
        if texts:
            df = df.withColumns({at("c", n): clean_text(F.col(at("s", n))) for n in texts})
        self.df = df

    def _at(self, part: str, name: str) -> str:
        return f"__{self.tag}{part}_{self.places.get(name, 'all')}"

    def column(self, name: str) -> str:
        """Column that holds the field's value."""
        return self._at("v", name)

    def raw(self, *names: str) -> Column:
        """The first present field."""
        return F.coalesce(*[F.col(self._at("v", n)) for n in names])

    def kind(self, name: str) -> Column:
        return kind_of_json(F.col(self._at("j", name)))

    def is_object(self) -> Column:
        return F.col(self._at("o", ""))

    def present(self, *names: str) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | F.col(self._at("j", n)).isNotNull()
        return out

    def _first(self, part: str, names: Sequence[str]) -> Column:
        """The given part of the first present field, also if that part is null."""
        out = None
        for n in names:
            seen, value = F.col(self._at("j", n)).isNotNull(), F.col(self._at(part, n))
            out = F.when(seen, value) if out is None else out.when(seen, value)
        return out

    def string(self, *names: str) -> Column:
        return self._first("s", names)

    def number(self, *names: str) -> Column:
        """The first present field as a double; null if missing or not a number."""
        return self._first("n", names)

    def text(self, *names: str) -> Column:
        """First field that holds a non-blank string, cleaned."""
        return F.coalesce(*[F.col(self._at("c", n)) for n in names])

    def identifier(self, *names: str) -> Column:
        """Like ``text``, and nonnegative whole numbers count as text."""
        found = []
        for n in names:
            number = F.col(self._at("n", n))
            whole = (number >= 0) & (number == F.floor(number)) & (number <= MAX_SAFE_INTEGER)
            found += [F.when(whole, number.cast("bigint").cast("string")), F.col(self._at("c", n))]
        return F.coalesce(*found)

    def any_text(self, *names: str) -> Column:
        """Text of the first field that is present, also if that is null."""
        out = None
        for n in names:
            v, j, k = F.col(self._at("v", n)), F.col(self._at("j", n)), self.kind(n)
            value = F.when(k == "string", F.col(self._at("s", n))).otherwise(as_text(v, k))
            out = F.when(j.isNotNull(), value) if out is None else out.when(j.isNotNull(), value)
        return out

    def boolean(self, name: str) -> Column:
        return F.when(self.kind(name) == "boolean", F.col(self._at("j", name)) == "true")

    def loose_bool(self, *names: str) -> Column:
        """A boolean, or the text true or false, of the first present field."""
        out = None
        for n in names:
            seen = F.col(self._at("j", n)).isNotNull()
            text = F.lower(F.trim(F.col(self._at("s", n))))
            value = F.coalesce(self.boolean(n), F.when(text.isin("true", "false"), text == "true"))
            out = F.when(seen, value) if out is None else out.when(seen, value)
        return out

    def language(self) -> Column:
        """``lang``, or ``language`` when that is missing or null, if it is ja or en."""
        lang = F.when(F.coalesce(self.kind("lang") != "null", F.lit(False)), F.col(self._at("c", "lang")))
        other = F.when(F.coalesce(self.kind("lang") == "null", F.lit(True)), F.col(self._at("c", "language")))
        text = F.coalesce(lang, other)
        return F.when(text.isin("ja", "en"), text)

    def instant(self, *names: str) -> Column:
        return parse_instant(self.string(*names))

    def instant_or_epoch(self, *names: str) -> Column:
        """An instant as text, or as milliseconds since the epoch."""
        number = self.number(*names)
        return F.coalesce(
            self.instant(*names), F.when(number >= 0, F.timestamp_millis(number.cast("bigint")))
        )

    def instant_invalid(self, *names: str, epoch_ms: bool = False) -> Column:
        """A field is present, not null and not empty, but is no instant."""
        text = self.string(*names)
        ok = (self._first("j", names) == "null") | (text == "") | parse_instant(text).isNotNull()
        if epoch_ms:
            ok = ok | (self.number(*names) >= 0)
        return self.present(*names) & ~F.coalesce(ok, F.lit(False))
