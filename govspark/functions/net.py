"""Set, region and address predicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from govspark.fixed_values import EU_REGIONS


def has_any(left: Column, right: Column) -> Column:
    return F.coalesce(F.arrays_overlap(left, right), F.lit(False))


def has_all(owned: Column, required: Column) -> Column:
    return F.size(F.array_except(required, owned)) == 0


def is_eu_region(region: Column) -> Column:
    return F.coalesce(region.isin(*EU_REGIONS), F.lit(False))


def _bits(number: Column, base: int, width: int) -> Column:
    return F.lpad(F.conv(number, base, 2), width, "0")


# Leading zeros are refused: some readers take them for octal digits.
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_MAPPED = "0" * 80 + "1" * 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ipv4_bits(address: Column) -> Column:
    valid = address.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$")
    return F.when(valid, F.array_join(F.transform(F.split(address, r"\."), lambda part: _bits(part, 10, 8)), ""))


def _undotted(address: Column) -> Column:
    """An IPv4 address at the end of an IPv6 one as its two groups of hex digits."""
    tail = F.substring_index(address, ":", -1)
    head = address.substr(F.lit(1), F.length(address) - F.length(tail))
    group = lambda bits, start: F.conv(bits.substr(start, 16), 2, 16)
    groups = _let(_ipv4_bits(tail), lambda bits: F.concat(group(bits, 1), F.lit(":"), group(bits, 17)))
    return F.when(address.contains("."), F.concat(head, groups)).otherwise(address)


def _ipv6_bits(address: Column) -> Column:
    """128 binary digits; null unless the text is eight groups of hex digits, or fewer around one ``::``.

    The last two groups may be written as an IPv4 address.
    """
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")

    def bits(text: Column, sides: Column) -> Column:
        left, right = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
        missing = F.lit(8) - F.size(left) - F.size(right)
        shape = (
            text.rlike(r"^[0-9A-Fa-f:]+$")
            & ~text.rlike(r":::|::.*::|^:[^:]|[^:]:$|[^:]{5}")
            & F.when(text.contains("::"), missing >= 1).otherwise(missing == 0)
        )
        filled = F.concat(left, F.array_repeat(F.lit("0"), missing), right)
        return F.when(shape, F.array_join(F.transform(filled, lambda g: _bits(g, 16, 16)), ""))

    def halved(text: Column) -> Column:
        parts = F.split(text, "::")
        sides = F.array(groups(F.get(parts, F.lit(0))), groups(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))))
        return _let(sides, lambda s: bits(text, s))

    return _let(_undotted(address), halved)


def _address_bits(address: Column) -> Column:
    return F.when(address.contains(":"), _ipv6_bits(address)).otherwise(_ipv4_bits(address))


def _in_block(cidr: Column, inner: Column) -> Column:
    """Does the block hold the address with these bits?"""

    def shares(base: Column) -> Column:
        width = F.length(base)
        asked = F.when(cidr.contains("/"), F.substring_index(cidr, "/", -1).try_cast("int")).otherwise(width)
        # Addresses share a block exactly when their leading bits agree.
        agree = lambda bits, n: (F.length(inner) == F.length(bits)) & (bits.substr(F.lit(1), n) == inner.substr(F.lit(1), n))
        mapped = base.startswith(_MAPPED) & (asked >= 96)
        return asked.between(0, width) & F.when(mapped, agree(base.substr(97, 32), asked - 96)).otherwise(agree(base, asked))

    return F.coalesce(_let(_address_bits(F.substring_index(cidr, "/", 1)), shares), F.lit(False))


def _plain_bits(address: Column) -> Column:
    """The bits of an address; of an IPv4 address mapped into IPv6 those of the IPv4 address."""
    mapped = lambda bits: F.when(bits.startswith(_MAPPED), bits.substr(97, 32)).otherwise(bits)
    return _let(_address_bits(address), mapped)


def cidr_contains(cidr: Column, address: Column) -> Column:
    """True when the IPv4 or IPv6 address lies in the block; a bare address is a block of one.

    Families don't mix, but an IPv4 address mapped into IPv6 (``::ffff:1.2.3.4``) is that IPv4 address, and a block of
    such addresses is an IPv4 block.
    """
    return _let(_plain_bits(address), lambda inner: _in_block(cidr, inner))


def ip_in_cidrs(address: Column, cidrs: Column) -> Column:
    return _let(_plain_bits(address), lambda inner: F.exists(cidrs, lambda cidr: _in_block(cidr, inner)))
