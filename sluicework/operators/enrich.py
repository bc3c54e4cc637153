"""Enrichment of records from a table of address ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.operators.tabular import materialize

# Blocks have 16 ** level addresses; 16 levels make up all addresses of 63 bits.
LEVEL_BITS, LEVELS = 4, 16


def _blocks(low: Column, high: Column, level: int) -> Column:
    """Numbers of the level's blocks that lie in a range and aren't in a block of the next level that does."""
    def first(at: int) -> Column:
        return F.shiftright(low - 1, at) + 1 if at else low

    def last(at: int) -> Column:
        whole = high.bitwiseAND(F.lit((1 << at) - 1)) == (1 << at) - 1
        return F.shiftright(high, at) - F.when(whole, 0).otherwise(1) if at else high

    at, up = LEVEL_BITS * level, LEVEL_BITS * (level + 1)
    a, b = first(at), last(at)
    if level == LEVELS - 1:
        return F.when(a <= b, F.sequence(a, b))
    inner = first(up) <= last(up)
    c, d = F.shiftleft(first(up), LEVEL_BITS), F.shiftleft(last(up), LEVEL_BITS).bitwiseOR(F.lit((1 << LEVEL_BITS) - 1))
    none = F.array().cast("array<bigint>")
    both = F.concat(F.when(a < c, F.sequence(a, c - 1)).otherwise(none), F.when(d < b, F.sequence(d + 1, b)).otherwise(none))
    return F.when(inner, both).when(a <= b, F.sequence(a, b))


#: An address that holds this share of the records is hot, so that there are at most a thousand of them.
HOT = 0.001


def _checked(df: DataFrame, places: DataFrame) -> None:
    both = [c for c in places.columns if c in df.columns]
    if both:
        raise ValueError(f"records and places both have the columns: {', '.join(both)}")
    if df.isStreaming:
        raise ValueError("records have to be a batch")


def _counted(df: DataFrame, key: Column) -> DataFrame:
    """The different keys of the records and how many have each: _key, _count."""
    return materialize(df.select(key.alias("_key")).where("_key is not null").groupBy("_key").agg(F.count("*").alias("_count")))


def _attached(df: DataFrame, key: Column, found: DataFrame, counted: DataFrame, columns: list[str]) -> DataFrame:
    """The records with the place that was found for their key (found: _key, _count, _place).

    Places of hot keys are broadcast, at most ``1 / HOT`` rows, so that no task gets all records of one; records without a key
    aren't joined at all.
    """
    total = counted.agg(F.sum("_count")).first()[0] or 0
    hot = F.col("_count") >= HOT * total
    keyed = df.withColumn("_key", key)
    often = counted.where(hot).select("_key", F.lit(True).alias("_often"))
    marked = keyed.where("_key is not null").join(F.broadcast(often), "_key", "left")
    joined = marked.where("_often").join(F.broadcast(found.where(hot).select("_key", "_place")), "_key", "left").unionByName(
        marked.where("_often is null").join(found.where(~hot).select("_key", "_place"), "_key", "left")).drop("_often")
    every = joined.unionByName(keyed.where("_key is null").withColumn("_place", F.lit(None).cast(found.schema["_place"].dataType)))
    return every.select(*df.columns, *[F.col("_place").getField(c).alias(c) for c in columns])


def geo_location(df: DataFrame, address: str, ranges: DataFrame, low: str = "lo", high: str = "hi") -> DataFrame:
    """Left join of integer addresses to ranges (``low <= address <= high``); of nested or overlapping ranges the narrowest wins.

    A range is cut into aligned blocks of a power of 16 addresses, at most 30 of each size, and each
    distinct address names the block of each size that it is in.  So the range condition
    becomes an equality with a match per range that holds the address; of these the one with the fewest addresses is
    taken, then that with the least low, then the first by its other columns.  Every record comes out once:
    the records themselves are joined on the address.  Records outside all ranges, and those
    without an address, are kept with nulls; lows are taken to be above the least 64-bit number.  Columns of the ranges may not
    have names of the records' columns.
    """
    _checked(df, ranges)
    key = F.col(address).cast("bigint")
    bounds = ranges.filter(F.col(low) <= F.col(high)).select(
        F.struct(*ranges.columns).alias("_range"), F.col(low).cast("bigint").alias("_low"), F.col(high).cast("bigint").alias("_high"))
    levels = F.array(*[_blocks(F.col("_low"), F.col("_high"), k) for k in range(LEVELS)])
    width = F.col("_high").cast("decimal(20,0)") - F.col("_low").cast("decimal(20,0)")
    blocks = bounds.select("_range", F.struct(width.alias("width"), "_low", F.to_json("_range").alias("text")).alias("_order"),
                           F.posexplode(levels).alias("_level", "_numbers")).select(
        "_range", "_order", "_level", F.explode("_numbers").alias("_block"))
    counted = _counted(df, key)
    own = F.posexplode(F.array(*[F.shiftright(F.col("_key"), LEVEL_BITS * k) for k in range(LEVELS)]))
    found = counted.select("_key", "_count", own.alias("_level", "_block")).join(blocks, ["_level", "_block"]).groupBy(
        "_key", "_count").agg(F.min_by("_range", "_order").alias("_place"))
    return _attached(df, key, found, counted, ranges.columns)


_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"{_BYTE}(?:\.{_BYTE}){{3}}"


def _once(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ip_bits(text: Column) -> Column:
    """The bits of an IPv4 or IPv6 address as text, after ``4:`` or ``6:``; null for other texts.

    IPv6 may be shortened, end in an IPv4 address or name a zone, which is left out.  An IPv4 address in IPv6
    form (``::ffff:10.0.0.1``) is one of IPv4.
    """
    mapped = "0" * 80 + "1" * 16

    def four(plain: Column) -> Column:
        return F.concat(F.lit("4:"), F.array_join(F.transform(F.split(plain, r"\."), lambda x: F.lpad(F.conv(x, 10, 2), 8, "0")), ""))

    def groups(half: Column) -> Column:
        return F.filter(F.split(F.coalesce(half, F.lit("")), ":", -1), lambda x: F.coalesce(half, F.lit("")) != "")

    def hexadecimal(parts: Column, k: int) -> Column:
        return F.hex(F.get(parts, F.lit(k)).cast("int") * 256 + F.get(parts, F.lit(k + 1)).cast("int"))

    def with_tail(plain: Column) -> Column:
        tail = F.split(F.regexp_extract(plain, rf":({_IPV4})\z", 1), r"\.")
        return _once(tail, lambda parts: F.when(F.size(parts) == 4, F.lower(F.concat(
            F.regexp_replace(plain, rf"{_IPV4}\z", ""), hexadecimal(parts, 0), F.lit(":"), hexadecimal(parts, 2)))).otherwise(plain))

    def filled(sides: Column) -> Column:
        missing = 8 - F.size(sides["left"]) - F.size(sides["right"])
        return F.when(sides["n"] == 1, sides["left"]).when((sides["n"] == 2) & (missing >= 1), F.concat(
            sides["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), sides["right"]))

    def whole(halves: Column) -> Column:
        sides = F.struct(F.size(halves).alias("n"), groups(F.get(halves, F.lit(0))).alias("left"), groups(F.get(halves, F.lit(1))).alias("right"))
        return _once(sides, filled)

    def checked(all_: Column) -> Column:
        valid = (F.size(all_) == 8) & F.forall(all_, lambda x: F.rlike(x, F.lit(r"\A[0-9a-f]{1,4}\z")))
        return F.when(valid, F.array_join(F.transform(all_, lambda x: F.lpad(F.conv(x, 16, 2), 16, "0")), ""))

    def named(bits: Column) -> Column:
        return F.when(F.startswith(bits, F.lit(mapped)), F.concat(F.lit("4:"), F.substring(bits, 97, 32))).otherwise(F.concat(F.lit("6:"), bits))

    def six(plain: Column) -> Column:
        halves = F.split(with_tail(plain), "::", -1)
        return _once(_once(_once(halves, whole), checked), named)

    plain = F.lower(F.regexp_replace(F.trim(text), r"%[^%]*\z", ""))
    return _once(plain, lambda x: F.when(F.rlike(x, F.lit(rf"\A{_IPV4}\z")), four(x)).when(F.contains(x, F.lit(":")), six(x)))


def ip_location(df: DataFrame, address: str, networks: DataFrame, network: str = "network") -> DataFrame:
    """Left join of text addresses, IPv4 or IPv6, to networks such as ``10.0.0.0/8`` or ``2001:db8::/32``; the longest prefix wins.

    Each distinct address names its prefixes of the lengths that networks have, at most 162, so that the
    join is one of equal texts.  A network without a length is one address; one that isn't valid is left out.  Records, hot
    and missing addresses and column names are treated as by ``geo_location``; what is no address finds nothing.
    """
    _checked(df, networks)
    bits = ip_bits(F.substring_index(F.col(network), "/", 1))
    given = F.when(F.contains(F.col(network), F.lit("/")), F.substring_index(F.col(network), "/", -1).try_cast("int"))
    mapped = F.contains(F.col(network), F.lit(":")) & F.startswith(bits, F.lit("4:"))
    length = F.coalesce(F.when(mapped, given - 96).otherwise(given), F.when(~F.contains(F.col(network), F.lit("/")), F.length(bits) - 2))
    prefixes = networks.select(F.struct(*networks.columns).alias("_range"), bits.alias("_bits"), length.alias("_length")).where(
        "_length between 0 and length(_bits) - 2").select("_range", F.expr("substring(_bits, 1, _length + 2)").alias("_prefix"))
    lengths = sorted(r[0] for r in prefixes.select(F.length("_prefix")).distinct().collect())  # at most 33 and 129
    key = F.when(F.col(address).isNotNull(), ip_bits(F.col(address)))
    counted = _counted(df, key)
    own = F.array_compact(F.array(*[F.when(F.length("_key") >= n, F.substring("_key", 1, n)) for n in lengths or [0]]))
    best = F.struct(F.length("_prefix").alias("n"), F.to_json("_range").alias("text"))
    found = counted.select("_key", "_count", F.explode(own).alias("_prefix")).join(prefixes, "_prefix").groupBy("_key", "_count").agg(
        F.max_by("_range", best).alias("_place"))
    return _attached(df, key, found, counted, networks.columns)
