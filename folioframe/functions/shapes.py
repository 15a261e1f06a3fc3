"""Shape features of texts, for abstraction without their content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = {"has_digit": "[0-9]", "has_alpha": "[a-zA-Z]", "has_upper": "[A-Z]", "has_lower": "[a-z]", "has_dash": "-", "has_slash": "/", "has_dot": "[.]", "has_punct": "[^0-9A-Za-z_ \\t\\r\\n\\f]"}
DATE = "[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}"


def flags(text: Column) -> dict[str, Column]:
    plain = {"has_dash": "-", "has_slash": "/", "has_dot": "."}
    return {name: F.contains(text, F.lit(plain[name])) if name in plain else text.rlike(pattern) for name, pattern in FLAGS.items()}


def length_bucket(text: Column) -> Column:
    n = F.length(text)
    return F.when(n == 1, "1").when(n <= 3, "2-3").when(n <= 6, "4-6").when(n <= 12, "7-12").otherwise("13+")


def token_class(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike("^[0-9]+$"), "NUMBER").when(t.rlike(DATE), "DATE").when(t.rlike("^[A-Za-z]+$"), "TEXT_PATTERN").otherwise("CONTENT")


def token_shape(text: Column) -> Column:
    """Digits as 9, letters as A or a, codes as a fixed pattern; at most ten characters."""
    t = F.trim(text)
    n = F.least(F.length(t), F.lit(10))
    return (
        F.when(t.rlike("^[0-9]+$"), F.repeat(F.lit("9"), n)).when(t.rlike(DATE), "99/99/9999").when(t.rlike("^[A-Z]+$"), F.repeat(F.lit("A"), n)).when(t.rlike("^[a-z]+$"), F.repeat(F.lit("a"), n))
        .when(t.rlike("^[A-Za-z]+$"), F.concat(F.when(t.rlike("^[A-Z]"), "A").otherwise("a"), F.repeat(F.lit("a"), n - 1)))
        .when(t.rlike("^[A-Za-z0-9]+-[A-Za-z0-9]+"), "AA-99").when(t.rlike("^[A-Za-z0-9]+/[A-Za-z0-9]+"), "AA/99").when(t.rlike("^[A-Za-z0-9]+[.][A-Za-z0-9]+"), "AA.99").otherwise(F.repeat(F.lit("X"), n))
    )


def flag_bits(text: Column) -> Column:
    return F.concat(*[F.when(f, "1").otherwise("0") for f in flags(text).values()])


def placeholder(*features: Column) -> Column:
    """A stable name of a text's class, shape, length bucket and flag bits."""
    return F.concat(F.lit("PLACEHOLDER_"), F.substring(F.sha2(F.concat_ws("|", *features), 256), 1, 12))


def hmac_sha256(key: str, text: Column) -> Column:
    """HMAC with SHA-256 as hex, of built-in functions."""
    import hashlib

    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    raw = raw.ljust(64, b"\0")
    inner = F.unhex(F.lit(bytes(b ^ 0x36 for b in raw).hex()))
    outer = F.unhex(F.lit(bytes(b ^ 0x5C for b in raw).hex()))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256)
