"""Reading a rule document held in a text column: strict JSON to typed parts.

Each document is parsed once into a variant; the parts used by the audit and by
routing are then taken with typed casts (``array<struct<..>>``), which give null
where the document holds something else.  A JSON ``null`` stays a variant and so
counts as present.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicework import fixed_values as fv
from sluicework.plans.findings import bind

DOCUMENT = "struct<location:variant,kind:variant,properties:variant,dataCollectionEndpointId:variant>"
PROPERTIES = (
    "struct<destinations:variant,streamDeclarations:variant,dataSources:variant,"
    "dataCollectionEndpointId:variant,dataFlows:variant>"
)
DESTINATIONS = "struct<logAnalytics:variant,azureMonitorMetrics:variant>"
LOG_DESTINATIONS = "array<struct<name:variant,workspaceResourceId:variant>>"
LOG_FILES = "array<struct<name:variant,streams:variant,filePatterns:variant,format:variant,settings:variant>>"
FLOWS = "array<struct<streams:variant,destinations:variant,transformKql:variant,outputStream:variant>>"
COLUMNS = "array<struct<name:variant,type:variant>>"


def part(value: Column, as_type: str, path: str = "$") -> Column:
    return F.try_variant_get(value, path, as_type)


def text_of(value: Column) -> Column:
    """The value of a JSON string; null for every other kind of value."""
    return F.when(F.schema_of_variant(value) == "STRING", part(value, "string"))


def strings_of(values: Column) -> Column:
    """The string members of an ``array<variant>``."""
    return F.filter(F.transform(values, text_of), lambda s: s.isNotNull())


def _lone_surrogate(text: Column) -> Column:
    whole = r"\\(?:[^u]|u(?![dD][89a-fA-F])|u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})"
    left = F.regexp_replace(text, whole, "")
    return (F.contains(text, F.lit("\\ud")) | F.contains(text, F.lit("\\uD"))) & F.contains(left, F.lit("\\u"))


def _without_strings(text: Column) -> Column:
    return F.regexp_replace(text, r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"', "")


def _number_overflow(text: Column) -> Column:
    may = F.rlike(text, F.lit(r"[\[:,\s]-?[0-9.]+[eE]\+?0*[1-9][0-9]{2}|[0-9]{309}"))
    numbers = F.regexp_extract_all(_without_strings(text), F.lit(r"[0-9][0-9.eE+-]*"), F.lit(0))
    return may & F.exists(numbers, lambda n: n.try_cast("double") == float("inf"))


def _too_deep(text: Column) -> Column:
    limit = fv.MAX_JSON_DEPTH
    may = (F.length(text) > 2 * limit) & F.rlike(
        text, F.lit(r"\A[^\[{]*+(?:[\[{][^\[{]*+){" + str(limit + 1) + "}"))
    signs = F.split(F.regexp_replace(_without_strings(text), r"[^\[\]{}]++", ""), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most"))

    def step(acc: Column, sign: Column) -> Column:
        depth = acc["depth"] + F.when(sign.isin("[", "{"), 1).when(sign.isin("]", "}"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.greatest(acc["most"], depth).alias("most"))

    return may & (F.aggregate(signs, start, step)["most"] > limit)


#: The parser takes names up to 50,000 characters; longer ones keep these many at either end, around a digest.
NAME_LIMIT, NAME_ENDS = 50_000, 64


def _long_names(text: Column) -> Column:
    """The quoted names of object members that are too long for the parser."""
    every = F.regexp_extract_all(text, F.lit(r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"\s*+:?+'), F.lit(0))
    names = F.filter(every, lambda x: (F.length(x) > NAME_LIMIT) & F.endswith(x, F.lit(":")))
    return F.array_distinct(F.transform(names, lambda x: F.regexp_replace(x, r"\s*+:\z", "")))


def _short_name(quoted: Column) -> Column:
    """A short name, without quotes and escapes, that stands for a quoted one."""
    ends = f"{{0,{NAME_ENDS}}}"
    return F.concat(F.regexp_extract(quoted, rf'\A"([^"\\]{ends})', 1), F.lit("~"), F.sha2(quoted, 256), F.regexp_extract(quoted, rf'([^"\\]{ends})"\z', 1))


def shortened(text: Column) -> Column:
    """The text with short names in place of those that are too long, wherever it has them as a string."""
    short = F.aggregate(_long_names(text), text, lambda t, name: F.replace(t, name, F.concat(F.lit('"'), _short_name(name), F.lit('"'))))
    return F.when(F.length(text) > NAME_LIMIT, short).otherwise(text)


def long_names(text: Column) -> Column:
    """The names that ``shortened`` replaces; null if there are none."""
    return F.when(F.length(text) > NAME_LIMIT, bind(_long_names(text), lambda names: F.when(F.size(names) > 0, names)))


def with_long_names(values: Column, names: Column) -> Column:
    """Strings that were taken from ``shortened(text)``, with the names that the text has."""
    def restored(value: Column, name: Column) -> Column:
        return F.replace(value, _short_name(name), F.get(F.from_json(F.concat(F.lit("["), name, F.lit("]")), "array<string>"), F.lit(0)))

    return F.transform(values, lambda v: F.aggregate(names, v, restored))


def strict_json(text: Column) -> Column:
    """Variant of a text that is exactly one JSON value, else null.

    Names that are too long for the parser are shortened; ``with_long_names`` brings them back.
    """
    return bind(shortened(text), _strict_json)


def _strict_json(text: Column) -> Column:
    """The same for a text without names that are too long.

    The parser stops after the first value, so the text is put into an array in
    front of a mark: text left over after the value hides or displaces the mark.
    The mark is the text's own digest, which the text cannot contain.
    """
    mark = F.sha2(text, 256)

    def checked(value: Column) -> Column:
        whole = (part(value, "string", "$[1]") == mark) & part(value, "variant", "$[2]").isNull()
        bad = _lone_surrogate(text) | _number_overflow(text) | _too_deep(text)
        return F.when(whole & ~bad, part(value, "variant", "$[0]"))

    return bind(F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]'))), checked)


def flows_of(properties: Column) -> Column:
    """Data flows with their parts typed; ``bad`` marks an entry that is no object."""

    def typed(flow: Column, index: Column) -> Column:
        def with_lists(lists: Column) -> Column:
            return F.struct(
                (index + 1).cast("string").alias("number"), flow.isNull().alias("bad"),
                F.size(lists["streams"]).alias("n_streams"), strings_of(lists["streams"]).alias("streams"),
                F.size(lists["destinations"]).alias("n_destinations"),
                strings_of(lists["destinations"]).alias("destinations"),
                text_of(flow["transformKql"]).alias("transform"),
                text_of(flow["outputStream"]).alias("output_stream"),
            )

        return bind(F.struct(part(flow["streams"], "array<variant>").alias("streams"),
                             part(flow["destinations"], "array<variant>").alias("destinations")), with_lists)

    return F.transform(part(properties["dataFlows"], FLOWS), typed)
