"""Which addresses may be fetched for a page: http(s) only, and private networks only from the same host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IPV4 = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"


def host(url: Column) -> Column:
    """Lower-case host without brackets, port, user and trailing dot."""
    authority = F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), "^[^@]*@", "")
    bare = F.when(authority.startswith("["), F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(authority, ":[0-9]*$", ""))
    return F.regexp_replace(bare, r"\.$", "")


def _private_ipv4(a: Column, b: Column) -> Column:
    return a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))


def private(name: Column) -> Column:
    """Whether a host is loopback, link-local or of a private range, also where IPv6 maps IPv4."""
    dotted = F.regexp_replace(name, "^::ffff:", "")
    octet = [F.regexp_extract(dotted, IPV4, k).try_cast("int") for k in (1, 2)]
    high = F.conv(F.regexp_extract(name, "^::ffff:([0-9a-f]{1,4}):[0-9a-f]{1,4}$", 1), 16, 10).try_cast("int")
    mapped = F.when(name.rlike("^::ffff:[0-9a-f]{1,4}:[0-9a-f]{1,4}$"), _private_ipv4(F.floor(high / 256).cast("int"), high % 256))
    plain = (name == "localhost") | name.endswith(".localhost") | name.isin("::", "::1") | name.rlike("^fe[89ab][0-9a-f:]*$") | name.rlike("^f[cd][0-9a-f:]*$")
    return F.when(dotted.rlike(IPV4), _private_ipv4(*octet)).otherwise(F.coalesce(mapped, plain))


def with_verdict(df: DataFrame, url: str, sender: str, name: str = "verdict") -> DataFrame:
    """df with why column url must not be fetched for the page in column sender, or null."""

    def own(host_name: Column) -> Column:
        return F.when(host_name.isin("localhost", "::1"), "127.0.0.1").otherwise(host_name)

    target, source, u = F.col("_target"), F.col("_source"), F.col(url)
    df = df.withColumn("_target", host(u)).withColumn("_source", F.coalesce(host(F.col(sender)), F.lit("")))
    df = df.withColumn("_private", private(target))
    local = F.col("_private") & ~own(source).eqNullSafe(own(target))
    why = F.when(u.isNull() | ~u.rlike("(?i)^[a-z][a-z0-9+.-]*:"), "invalid url").when(~u.rlike("(?i)^https?://"), "scheme").when(local, "local network")
    return df.withColumn(name, why).drop("_target", "_source", "_private")
