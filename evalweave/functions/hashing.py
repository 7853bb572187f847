"""Deterministic splits and pseudo-random numbers from digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX = 13
UNIT = float(1 << 52)


def _number(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def stable_split(identifier: Column, dev_buckets: int = 3, buckets: int = 10) -> Column:
    """"dev" or "test" by the first 32 bits of the id's SHA-1."""
    bucket = _number(F.sha1(identifier.cast("string").cast("binary")), 8) % buckets
    return F.when(bucket < dev_buckets, "dev").otherwise("test")


def md5_split(identifier: Column, parts: int = 2) -> Column:
    return (_number(F.md5(identifier.cast("string").cast("binary")), 8) % parts).cast("int")


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the parts joined by colons; the same on every run and for every partitioning."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return _number(F.md5(text.cast("binary")), HEX).cast("double") / F.lit(UNIT)


def uniform_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, {HEX}))::BIGINT::DOUBLE / {UNIT})"


#: The distribution function of a Poisson variable of mean 1 at 0, 1, ..., 12.
POISSON_ONE = [
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119,
    0.9999897508033253, 0.999998874797402, 0.9999998885745217, 0.9999999899522336, 0.9999999991683892, 0.9999999999364022,
]


def poisson_weight(*parts: Column | str | int) -> Column:
    """How often a resample draws a unit: Poisson of mean 1 at the unit's hashed number."""
    u = uniform(*parts)
    return F.size(F.filter(F.array(*map(F.lit, POISSON_ONE)), lambda c: c <= u))


def poisson_weight_sql(*parts: str) -> str:
    u = uniform_sql(*parts)
    return "(" + " + ".join(f"({u} >= {c!r})::int" for c in POISSON_ONE) + ")"


PRIME = (1 << 31) - 1


def key_seeds(*parts: Column | str | int) -> tuple[Column, Column]:
    """Two 28-bit numbers from one digest of the parts, from which :func:`replicate_uniform` makes a number for each replicate."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    digest = F.md5(text.cast("binary"))
    return _number(digest, 7), _number(F.substring(digest, 8, 7), 7)


def key_seeds_sql(*parts: str) -> tuple[str, str]:
    digest = f"md5(concat_ws(':', {', '.join(parts)}))"
    return f"('0x' || substr({digest}, 1, 7))::bigint", f"('0x' || substr({digest}, 8, 7))::bigint"


def replicate_number(a, b, r):
    """A number below :data:`PRIME` from two seeds and a replicate, in whole-number arithmetic that stays below 2**63; for columns and, as text, for SQL."""
    sql = isinstance(a, str)
    prime = str(PRIME) if sql else F.lit(PRIME).cast("long")
    step = (lambda x, y, z: f"(({x} * {y} + {z}) % {prime})") if sql else (lambda x, y, z: (x * y + z) % prime)
    text = (lambda n: str(n)) if sql else (lambda n: F.lit(n).cast("long"))
    x = step(r, text(1103515245), a)
    x = step(x, x, b)
    x = step(x, text(48271), f"{r} * 69621 + {b}" if sql else r * 69621 + b)
    x = step(x, x, a)
    return step(x, text(16807), b)


def replicate_uniform(a: Column, b: Column, replicate: Column) -> Column:
    """A number in [0, 1): one digest a unit serves all replicates, and the rest is compiled arithmetic."""
    return replicate_number(a, b, replicate.cast("long")).cast("double") / F.lit(float(PRIME))


def replicate_uniform_sql(a: str, b: str, replicate: str) -> str:
    return f"({replicate_number(a, b, replicate)}::double / {float(PRIME)!r}::double)"


def poisson_of(u: Column) -> Column:
    """The Poisson variable of mean 1 at a uniform number."""
    return sum(((u >= c).cast("int") for c in POISSON_ONE[1:]), (u >= POISSON_ONE[0]).cast("int"))


def poisson_of_sql(u: str) -> str:
    return "(" + " + ".join(f"({u} >= {c!r}::double)::int" for c in POISSON_ONE) + ")"


def group_prefix(identifier: Column, separator: str = ":") -> Column:
    """The part of an id before the first separator; the whole id without one."""
    return F.split_part(identifier, F.lit(separator), F.lit(1))
