"""Arrays and dynamic (variant) values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicework.functions._args import col


def parse_json(x) -> Column:
    """Variant of a JSON text; null for any other text."""
    return F.try_parse_json(col(x))


todynamic = parse_json


def _members(x) -> Column:
    """The array in a variant; null for any other value."""
    return F.try_variant_get(col(x), "$", "array<variant>")


def item(array, index, dynamic: bool = False) -> Column:
    """``array[index]``, null when out of range; with ``dynamic`` of an array in a variant."""
    return F.get(_members(array) if dynamic else col(array), col(index))


def field(value, path: str, as_type: str = "string") -> Column:
    """``value.path`` of a dynamic value, null when missing or of another type."""
    return F.try_variant_get(col(value), f"$.{path}", as_type)


def array_concat(*arrays, dynamic: bool = False) -> Column:
    """Arrays one after the other; with ``dynamic`` arrays in variants, as one."""
    if dynamic:
        return F.flatten(F.array(*[_members(a) for a in arrays])).cast("variant")
    return F.flatten(F.array(*[col(a) for a in arrays]))  # refuses anything but arrays


def array_length(x, dynamic: bool = False) -> Column:
    """Length of an array; with ``dynamic`` of an array in a variant."""
    return F.size(_members(x) if dynamic else col(x))


def pack_array(*values, dynamic: bool = False) -> Column:
    """Array of values of one type; with ``dynamic`` a variant array of mixed types."""
    if dynamic:
        return F.array(*[col(v).cast("variant") for v in values]).cast("variant")
    return F.array(*[col(v) for v in values])


def pack(*names_and_values) -> Column:
    """Variant object from alternating names and values."""
    names, values = names_and_values[::2], names_and_values[1::2]
    return F.to_variant_object(F.struct(*[col(v).alias(n) for n, v in zip(names, values, strict=True)]))


def parse_xml(x, schema: str | None = None) -> Column:
    """Variant (or struct with ``schema``) of an XML text; null when malformed.

    The variant reader fails on malformed text, so texts are first read with a
    struct schema that only asks whether they are well formed.
    """
    broken = F.from_xml(col(x), "struct<_broken:string>",
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    fine = col(x).isNotNull() & broken["_broken"].isNull()
    return F.when(fine, F.from_xml(col(x), schema or "variant"))


def _zip(*arrays, dynamic: bool = False) -> Column:
    """Arrays of the first, second, ... members; with ``dynamic`` of arrays in variants, as a variant."""
    if dynamic:
        lists = [_members(a) for a in arrays]
        return F.transform(
            F.sequence(F.lit(0), F.greatest(*map(F.size, lists)) - 1) if len(lists) > 1 else F.sequence(F.lit(0), F.size(lists[0]) - 1),
            lambda i: F.array(*[F.get(x, i) for x in lists])).cast("variant")
    return F.arrays_zip(*[col(a) for a in arrays])
