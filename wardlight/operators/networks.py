"""Addresses in networks: the longest prefix that holds an address, by one equality join over the prefix lengths that occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import IPV4, ipv4_number, ipv6_digits, let
from .needles import BROADCAST_BYTES, within_bound


def bits_of(ip: Column) -> Column:
    """An address as text of ones and zeros, behind its kind's digit (4 or 6); null for what is no address."""
    four = let(ipv4_number(ip), lambda n: F.concat(F.lit("4"), F.lpad(F.bin(n), 32, "0")))
    six = let(ipv6_digits(ip), lambda h: F.concat(F.lit("6"), F.lpad(F.conv(F.substring(h, 1, 16), 16, 2), 64, "0"), F.lpad(F.conv(F.substring(h, 17, 16), 16, 2), 64, "0")))
    return F.when(ip.rlike(IPV4), four).when(ip.contains(":"), six)


def networks(table: DataFrame, column: str) -> DataFrame:
    """``table`` with ``_prefix``, the bits that all addresses of the row's network share, behind the kind's digit; an address alone is a network of its own.  Rows that are none go."""
    text = F.trim(F.col(column))
    size = F.when(text.contains("/"), F.substring_index(text, "/", -1).try_cast("int"))
    bits = bits_of(F.substring_index(text, "/", 1))
    whole = F.length(bits) - 1
    n = F.when(~text.contains("/"), whole).otherwise(F.when(size.between(0, whole), size))
    return table.withColumn("_prefix", let(F.struct(bits.alias("b"), n.alias("n")), lambda x: F.substring(x["b"], F.lit(1), x["n"] + 1))).where("_prefix is not null")


def longest_match(rows: DataFrame, ip: str, table: DataFrame, column: str, name: str = "network", most: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with a struct ``name`` of the row of ``table`` whose network (``column``: ``ADDRESS/BITS`` or an address) holds ``ip`` and is the smallest such, or null.

    Of a network that comes twice the least row holds.  Each distinct address is looked up once, under one key for each prefix length that the table has (33 and 129 at
    most), so nested networks cost no more than single ones.
    """
    held = networks(table, column)
    one = held.groupBy("_prefix").agg(F.min(F.struct(*[F.col(c) for c in table.columns])).alias("_net"))
    lengths = [r[0] for r in one.select(F.length("_prefix")).distinct().collect()]  # at most 162
    each = rows.select(F.col(ip).alias("_ip")).where("_ip is not null").distinct().withColumn("_bits", bits_of(F.col("_ip"))).where("_bits is not null")
    cut_at = F.explode(F.array(*map(F.lit, sorted(lengths)))) if lengths else F.explode(F.array().cast("array<int>"))
    keyed = each.withColumn("_n", cut_at).where(F.col("_n") <= F.length("_bits")).withColumn("_prefix", F.substring(F.col("_bits"), F.lit(1), F.col("_n")))
    best = keyed.join(within_bound(one, "_prefix", most), "_prefix").groupBy("_ip").agg(F.max_by("_net", "_n").alias(name))
    return rows.withColumn("_at", F.col(ip)).join(best.withColumnRenamed("_ip", "_at"), "_at", "left").drop("_at")
