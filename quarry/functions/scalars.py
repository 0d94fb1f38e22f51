"""Scalar functions as Columns, and their driver-side counterparts for reports."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_add(a: Column, b: Column) -> Column:
    """INT + INT that wraps at 32 bits instead of failing."""
    wide = a.cast("bigint") + b.cast("bigint")
    return (F.pmod(wide + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")


def int32(value: int) -> int:
    """A literal cut to 32 bits."""
    return (value + (1 << 31)) % (1 << 32) - (1 << 31)


def cents(value: Column) -> Column:
    """A value of two decimals as a whole number, so that sums don't depend on their order."""
    return F.round(value * 100).cast("bigint")


def hex_slice(text: Column, start: int, digits: int = 8) -> Column:
    """A number from hex digits of the MD5 of a text; the same in every SQL engine."""
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("bigint")


def double_hash(key: Column, k: int, m: int) -> Column:
    """k positions below m from two hashes of key: (h1 + i * h2) mod m."""
    text = key.cast("string")
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(hex_slice(text, 1) + i * hex_slice(text, 9), F.lit(m)))


def before_first(text: Column, sep: str) -> Column:
    """What stands before the first separator."""
    return F.substring_index(text, sep, 1)


def after_last(text: Column, sep: str) -> Column:
    """What stands after the last separator."""
    return F.substring_index(text, sep, -1)


def extension(path: Column) -> Column:
    """File extension: what follows the last dot; the whole name if there is none."""
    return after_last(path, ".")


def tenths(text: Column) -> Column:
    """A decimal text as a whole number of tenths."""
    return (text.cast("decimal(18,1)") * 10).cast("bigint")


def one_decimal(value: Column) -> Column:
    """Text of a value with one decimal, rounded half up on its decimal value."""
    return F.round(value, 1).cast("decimal(18,1)").cast("string")


def thousands(value: Column) -> Column:
    """A whole number with separators."""
    return F.format_number(value, 0)


def xml_escape(text: Column) -> Column:
    """Text that XML takes as it is."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


#: Marks at the end of a frame's name for kernel, waker, inlined and compiled code.
FRAME_MARKS = ("_[k]", "_[w]", "_[i]", "_[j]")


def strip_annotation(name: Column) -> Column:
    """A frame name without its mark."""
    marked = F.right(name, F.lit(4)).isin(*FRAME_MARKS)
    return F.when(marked, F.left(name, F.length(name) - 4)).otherwise(name)


def admission_ratio(err: Column, err_sum: Column, kp: float = 0.1, ki: float = 1.4) -> Column:
    """1 - exp(-kp * err - ki * sum of err), kept in [0, 1)."""
    return F.least(F.lit(0.999999), F.greatest(F.lit(0.0), 1 - F.exp(-kp * err - ki * err_sum)))


def limit_threshold(limit: Column, factor: float) -> Column:
    """-factor * log10(limit / 100), the covariance beyond which a concurrency limit moves."""
    return -factor * F.log10(limit / 100)


def queue_position(priority: Column, cohort: Column, cohorts: int = 128) -> Column:
    """Place of a message in the queue: priority first, then cohort."""
    return priority * cohorts + cohort


def service_time(normal: Column, inflight: Column, mean: float = 0.1, spread: float = 0.05, modifier: float = 10.0) -> Column:
    """Latency model in seconds: a normal base time, never negative, and a part that grows exponentially with what is in flight.

    normal: a standard normal number for each message, as generators.normal gives it.
    """
    return F.greatest(F.lit(0.0), mean + spread * normal) + F.exp(inflight / modifier) / 1000


#: Binary units of bytes, and units of time in seconds.
BYTE_UNITS = {"TiB": 2**40, "GiB": 2**30, "MiB": 2**20, "KiB": 2**10, "bytes": 1}
TIME_UNITS = {"hours": 3600, "minutes": 60, "seconds": 1}


def human_bytes(size: float) -> str:
    """Bytes in the largest binary unit that they fill, one decimal."""
    unit, scale = next(((u, x) for u, x in BYTE_UNITS.items() if size >= x), ("bytes", 1))
    return f"{size / scale:.1f} {unit}"


def human_seconds(seconds: float) -> str:
    """Elapsed time in the largest units that it fills; under a minute with milliseconds."""
    if seconds < TIME_UNITS["minutes"]:
        return f"{seconds:.3f} seconds"
    shown, rest = [], int(seconds)
    for unit, scale in TIME_UNITS.items():
        if scale <= seconds:
            shown.append(f"{rest // scale} {unit}")
        rest %= scale
    return " ".join(shown)


def fixed(x: Column, digits: int) -> Column:
    """A double with up to three decimals, rounded by its exact binary value, ties to even, as C and Python print it.

    format_string rounds ties up, and takes the shortest decimal for the value. Numbers that aren't in [0, 2^53) are left to it.
    """
    inside = (x >= 0) & (x < 2**53)
    value = F.when(inside, x).otherwise(F.lit(0.0))
    whole, one = F.floor(value), F.lit(str(2**63)).cast("decimal(20,0)")
    # below 2^-11, where bits are lost, all round to 0
    scaled = F.floor((value - whole) * F.lit(2.0**63)).cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(5,0)")
    down, twice = F.call_function("div", scaled, one), (scaled % one) * 2
    up = F.when((twice > one) | ((twice == one) & (down % 2 == 1)), 1).otherwise(0)
    parts = down + up
    shown = F.concat((whole + F.floor(parts / 10**digits)).cast("string"), F.lit("."), F.lpad((parts % 10**digits).cast("string"), digits, "0"))
    return F.when(inside, shown).otherwise(F.format_string(f"%.{digits}f", x))


def bytes_text(size: Column) -> Column:
    """human_bytes as a Column; null stays null."""
    text = F.lit(None).cast("string")
    for unit, scale in reversed(BYTE_UNITS.items()):
        text = F.when((size >= scale) | F.lit(scale == 1), F.concat(fixed(size / scale, 1), F.lit(f" {unit}"))).otherwise(text)
    return F.when(size.isNotNull(), text)


def seconds_text(seconds: Column) -> Column:
    """human_seconds as a Column; null stays null."""
    whole = F.floor(seconds)
    parts, rest = [], whole
    for unit, scale in TIME_UNITS.items():
        shown = F.concat(F.floor(rest / scale).cast("string"), F.lit(f" {unit}"))
        parts.append(F.when((whole >= scale) | F.lit(scale == 1), shown))
        rest = rest % scale
    short = F.concat(fixed(seconds.cast("double"), 3), F.lit(" seconds"))
    return F.when(seconds < TIME_UNITS["minutes"], short).when(seconds.isNotNull(), F.concat_ws(" ", *parts))


def bloom_size(n: int, fpr: float) -> tuple[int, int]:
    """(k, m): hash functions and bits of a filter for n keys at a rate: m = -n ln fpr / (ln 2)^2, k = m / n ln 2."""
    if not 0 < fpr < 1:
        raise ValueError(f"no size gives a rate of {fpr}")
    bits = math.ceil(-max(1, n) * math.log(fpr) / math.log(2) ** 2)
    return max(1, round(bits / max(1, n) * math.log(2))), bits


#: Offset basis and prime of the 64-bit FNV-1a hash (public domain).
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(key: Column, seed: int | None = None) -> Column:
    """64-bit FNV-1a of a text's or binary's bytes, signed; a seed is hashed as one more byte.

    The bytes are folded in an expression, so it stays in the JVM. 64-bit products wrap: the prime's two parts are
    multiplied by shifts, of which sums are taken without the check of ANSI mode.
    """
    data = key.cast("binary") if seed is None else F.concat(key.cast("binary"), F.unhex(F.lit(f"{seed % 256:02x}")))
    hexed = F.hex(data)
    places = F.sequence(F.lit(0), F.octet_length(data).cast("int"))  # one too many, so that an empty key has a sequence
    codes = F.transform(F.slice(places, F.lit(1), F.octet_length(data)), lambda i: F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint"))
    basis = F.lit(FNV_BASIS - (1 << 64))
    return F.when(key.isNotNull(), F.aggregate(codes, basis, lambda h, byte: _times_prime(h.bitwiseXOR(byte))))


def _times_prime(h: Column) -> Column:
    """h * FNV_PRIME modulo 2^64, as a signed number, from 32-bit halves that never overflow."""
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    small = FNV_PRIME & 0xFFFF  # the prime is 2^40 + small
    product = low * small
    top = (F.shiftrightunsigned(product, 32) + high * small + F.shiftleft(low, 8).bitwiseAND(F.lit(0xFFFFFFFF))).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(top, 32).bitwiseOR(product.bitwiseAND(F.lit(0xFFFFFFFF)))


def xx_double_hash(key: Column, k: int, m: int) -> Column:
    """k positions below m from the two halves of one 64-bit xxHash of key: (h1 + i * h2 mod 2^32) mod m."""
    h = F.xxhash64(key.cast("string"))
    h1, h2 = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod((h1 + i * h2).bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(m)))
