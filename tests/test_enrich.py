"""Places of addresses."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from sluicework import operators as op
from sluicework.operators import enrich


def test_ip_bits(spark):
    draw = random.Random(4)
    good = ["0.0.0.0", "255.255.255.255", "::", "::1", "1::", "fe80::1%eth0", "::ffff:10.1.2.3", "2001:DB8::8:800:200C:417A", "1:2:3:4:5:6:7:8",
            "1:2:3:4:5:6:1.2.3.4", "::1.2.3.4", "1::8:0:0:8"]
    good += [str(ipaddress.ip_address(draw.getrandbits(32))) for _ in range(20)]
    good += [str(ipaddress.IPv6Address(draw.getrandbits(128) & draw.getrandbits(128) & ~(0xFFFFFFFF << (16 * draw.randrange(7))))) for _ in range(60)]
    bad = ["", "1.2.3", "1.2.3.256", "1.2.3.4.5", "a.b.c.d", ":", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::", "::1.2.3", "1.2.3.4::", "01.2.3.4", None]

    def expected(text):
        try:
            address = ipaddress.ip_address(text.split("%")[0])
        except (ValueError, AttributeError):
            return None
        mapped = address.version == 6 and address.ipv4_mapped
        address = mapped or address
        return f"{address.version}:{int(address):0{address.max_prefixlen}b}"

    rows = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", op.ip_bits(F.col("t")).alias("b")).collect()
    assert {r.t: r.b for r in rows} == {t: expected(t) for t in good + bad} and all(expected(t) for t in good)


def test_ip_location(spark):
    nets = ["0.0.0.0/0", "10.0.0.0/8", "10.1.0.0/15", "10.1.2.3", "::/0", "2001:db8::/33", "2001:db8::1/128", "::ffff:192.168.0.0/112", "bad/8", "10.0.0.0/33", None]
    addresses = ["10.9.0.1", "10.1.2.3", "10.1.2.4", "11.0.0.0", "2001:db8::1", "2001:db8::2", "2001:db8:8000::1", "192.168.3.4", "192.169.0.1", "x", None]
    networks = spark.createDataFrame([(n,) for n in nets], "network string")
    found = op.ip_location(spark.createDataFrame([(a,) for a in addresses], "address string"), "address", networks).collect()
    assert dict(found) == {
        "10.9.0.1": "10.0.0.0/8", "10.1.2.3": "10.1.2.3", "10.1.2.4": "10.1.0.0/15", "11.0.0.0": "0.0.0.0/0", "2001:db8::1": "2001:db8::1/128",
        "2001:db8::2": "2001:db8::/33", "2001:db8:8000::1": "::/0", "192.168.3.4": "::ffff:192.168.0.0/112", "192.169.0.1": "0.0.0.0/0", "x": None, None: None}


def test_overlapping_ranges(spark):
    """Random nested, crossing and equal ranges against all pairs; every record comes out once, hot and missing addresses too."""
    draw = random.Random(5)
    ranges = [(lo, lo + draw.choice([0, 1, 5, 40, 300, -3]), k) for k, lo in enumerate(draw.randrange(-50, 400) for _ in range(80))]
    ranges += [(7, 9, 1000), (7, 9, 1000), (-(1 << 62), 1 << 62, 1001)]
    addresses = [draw.randrange(-60, 500) for _ in range(300)] + [8] * 500 + [None] * 200
    df = spark.createDataFrame([(i, a) for i, a in enumerate(addresses)], "id long, address long")
    found = op.geo_location(df, "address", spark.createDataFrame(ranges, "lo long, hi long, place int")).collect()
    assert sorted(r.id for r in found) == list(range(len(addresses)))
    for r in found:
        fits = [] if r.address is None else [(hi - lo, lo) for lo, hi, _ in ranges if lo <= r.address <= hi]
        assert (r.lo is None) == (not fits) and (not fits or (r.hi - r.lo, r.lo) == min(fits) and (r.lo, r.hi, r.place) in ranges)


def test_clashing_names_and_streams(spark):
    df = spark.createDataFrame([(1, "x")], "address long, place string")
    with pytest.raises(ValueError, match="place"):
        op.geo_location(df, "address", spark.createDataFrame([(1, 2, "y")], "lo long, hi long, place string"))
    with pytest.raises(ValueError, match="batch"):
        op.geo_location(spark.readStream.format("rate").load(), "value", spark.createDataFrame([(1, 2)], "lo long, hi long"))


def test_hot_addresses_are_not_shuffled_with_the_others(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("address"))
    out = op.geo_location(df, "address", spark.createDataFrame([(0, 10, "a"), (5, 5, "b")], "lo long, hi long, place string"))
    assert {r.place: r.n for r in out.groupBy("place").agg(F.count("*").alias("n")).collect()} == {"b": 6668, "a": 6, None: 13326}
    assert enrich.HOT <= 0.001


def test_let_function(spark):
    op.let_function(spark, "twice_of", {"x": "bigint"}, "bigint", "x * 2")
    op.let_function(spark, "up_to", {"n": "bigint"}, {"id": "bigint"}, "SELECT id FROM range(10) WHERE id < n")
    assert [r.y for r in spark.sql("SELECT twice_of(id) AS y FROM up_to(3) ORDER BY id").collect()] == [0, 2, 4]
    with pytest.raises(ValueError, match="no name"):
        op.let_function(spark, "f(x); DROP", {}, "int", "1")
