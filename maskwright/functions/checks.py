"""Checksums and address classes as native boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed
from .text import SPACE, as_column, let, trim_all

_SEPARATORS = f"(?:{SPACE}|[.-])"


def _compact(col) -> Column:
    return F.regexp_replace(as_column(col), _SEPARATORS, "")


def luhn_ok(col) -> Column:
    """Luhn checksum; spaces, dots and dashes are ignored."""

    def total(digits: Column) -> Column:
        doubled = F.transform(
            F.split(F.reverse(digits), ""),
            lambda c, i: let(
                c.try_cast("int") * (i % 2 + 1), lambda d: F.when(d > 9, d - 9).otherwise(d)
            ),
        )
        return F.aggregate(doubled, F.lit(0), lambda acc, d: acc + d)

    return let(
        _compact(col),
        lambda d: F.when(F.regexp_like(d, F.lit(r"^[0-9]+$")), total(d) % 10 == 0).otherwise(F.lit(False)),
    )


def iban_ok(col) -> Column:
    """ISO 7064 mod 97, folded over the characters."""
    clean = F.upper(F.regexp_replace(as_column(col), f"(?:{SPACE}|-)", ""))

    def remainder(text: Column) -> Column:
        turned = F.concat(F.substr(text, F.lit(5)), F.substring(text, 1, 4))
        return F.aggregate(
            F.split(turned, ""),
            F.lit(0),
            lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + c.try_cast("int")) % 97).otherwise(
                (acc * 100 + F.ascii(c) - 55) % 97
            ),
        )

    return let(
        clean,
        lambda t: F.when(
            F.regexp_like(t, F.lit(r"^[0-9A-Z]{15,34}$")), remainder(t) == 1
        ).otherwise(F.lit(False)),
    )


def nir_ok(col) -> Column:
    """French social security number: 13 characters, or 15 with a matching key."""

    def key_matches(text: Column) -> Column:
        base = F.regexp_replace(F.regexp_replace(F.substring(text, 1, 13), "2A", "19"), "2B", "18")
        number = base.try_cast("bigint")
        return F.coalesce(F.substring(text, 14, 2).try_cast("int") == 97 - number % 97, F.lit(False))

    return let(
        F.upper(_compact(col)),
        lambda t: F.when(~F.regexp_like(t, F.lit("^[12]")), F.lit(False))
        .when(F.length(t) == 13, F.lit(True))
        .when(F.length(t) == 15, key_matches(t))
        .otherwise(F.lit(False)),
    )


def ssn_ok(col) -> Column:
    """US social security number ranges."""
    return F.regexp_like(_compact(col), F.lit(r"^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"))


def nino_ok(col) -> Column:
    """UK national insurance number; the test prefix QQ always passes."""
    bad = "".join(fixed.NINO_BAD_LETTERS)
    prefixes = "|".join(fixed.NINO_BAD_PREFIXES)
    return F.regexp_like(
        F.upper(_compact(col)),
        F.lit(rf"^(?:QQ|(?!{prefixes})[^{bad}][^{bad}O])[0-9]{{6}}[A-D]$"),
    )


def private_ipv4(col) -> Column:
    """RFC 1918, loopback and link-local ranges."""

    def in_range(octets: Column) -> Column:
        first, second = octets[0], octets[1]
        return (
            (F.size(octets) == 4)
            & F.forall(octets, lambda o: F.coalesce(o.between(0, 255), F.lit(False)))
            & (
                first.isin(10, 127)
                | ((first == 172) & second.between(16, 31))
                | ((first == 192) & (second == 168))
                | ((first == 169) & (second == 254))
            )
        )

    octets = F.transform(F.split(as_column(col), r"\."), lambda o: o.try_cast("int"))
    return F.coalesce(let(octets, in_range), F.lit(False))


def private_ipv6(col) -> Column:
    """Mapped private IPv4, loopback, unique local and link-local addresses."""
    return let(
        F.lower(trim_all(col)),
        lambda t: F.when(t.startswith("::ffff:"), private_ipv4(F.substr(t, F.lit(8)))).otherwise(
            t.isin("::1", "0:0:0:0:0:0:0:1") | F.regexp_like(t, F.lit("^(?:fc|fd|fe[89ab])"))
        ),
    )


def card_issuer(digits: Column) -> Column:
    return (
        F.when(F.regexp_like(digits, F.lit("^4")), "VISA")
        .when(F.regexp_like(digits, F.lit("^5[1-5]|^2[2-7]")), "MASTERCARD")
        .when(F.regexp_like(digits, F.lit("^3[47]")), "AMEX")
        .when(F.regexp_like(digits, F.lit("^6")), "DISCOVER")
        .otherwise("UNKNOWN")
    )
