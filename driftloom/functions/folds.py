"""Aggregates that Spark lacks, as column expressions over built-in ones: their state has a constant size, so they
combine on the map side, run in windows and are kept by streaming aggregations."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: An unsigned 64-bit number.
UNSIGNED = T.DecimalType(20, 0)

#: Residues are taken modulo 2 ** BITS.
BITS = 24
_MASK, _LEAST = (1 << BITS) - 1, -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _odd_parts(x: Column) -> Column:
    """(twos, minus, e) of a whole number other than 0: its power of two, and its odd part without sign, which is
    (-1) ** minus * 5 ** e modulo 2 ** BITS."""
    zero = F.lit(0).cast("long")
    # Powers of 5 that are 1 but for bit k take that bit away, from the lowest up.
    steps = F.array(*[F.struct(F.lit(1 << k).cast("long").alias("bit"), F.lit(1 << (k - 2)).cast("long").alias("e"), F.lit(pow(5, -(1 << (k - 2)), 1 << BITS)).cast("long").alias("power")) for k in range(2, BITS)])

    def strip(a: Column, s: Column) -> Column:
        return F.when(a["left"].bitwiseAND(s["bit"]) == 0, a).otherwise(F.struct((a["left"] * s["power"]).bitwiseAND(F.lit(_MASK)).alias("left"), (a["e"] + s["e"]).alias("e")))

    def exponents(twos: Column, rest: Column) -> Column:
        minus = rest % 4 == 3
        found = F.aggregate(steps, F.struct(F.when(minus, _MASK + 1 - rest).otherwise(rest).alias("left"), F.lit(0).cast("long").alias("e")), strip)
        return F.struct(twos.alias("twos"), minus.cast("long").alias("minus"), found["e"].alias("e"))

    def parts(size: Column) -> Column:
        twos = F.bit_count(F.bitwise_not(size).bitwiseAND(size - 1)).cast("int")
        return let(F.struct(twos.alias("n"), F.call_function("shiftrightunsigned", size, twos).bitwiseAND(F.lit(_MASK)).alias("rest")), lambda t: exponents(t["n"], t["rest"]))

    # The least number has no absolute value.
    return F.when(x == _LEAST, F.struct(F.lit(63).alias("twos"), zero.alias("minus"), zero.alias("e"))).when(x.isNotNull(), let(F.abs(x), parts))


def product(value: Column, kind: T.DataType, over: WindowSpec | None = None) -> Column:
    """Product of the values, exact for whole types; nulls do not count, of no values it is null. With a 0 among them it
    is 0; else one beyond 64 bits is an error.

    The state is a few numbers, however many factors there are: how many are 0 and below 0, the power of two in all,
    the odd part's residue as a sum of exponents, and the product in floating point. At most 63 factors other than 1 and
    -1 fit, so the latter is right to 46 bits, and the residue tells the odd number that is meant."""
    at = lambda c: c.over(over) if over is not None else c
    if not isinstance(kind, WHOLE):
        return at(F.product(value))
    x = value.cast("long")
    large = F.when((x > 1) | (x < -1), x)
    parts, zero = _odd_parts(large), F.lit(0).cast("long")
    state = F.struct(
        at(F.count_if(x == 0)).alias("zeros"), at(F.count(x)).alias("n"), at(F.count_if(x < 0)).alias("below"), F.abs(F.coalesce(at(F.product(large.cast("double"))), F.lit(1.0))).alias("near"),
        F.coalesce(at(F.sum(parts["twos"])), zero).alias("twos"), F.coalesce(at(F.sum(parts["minus"])), zero).alias("minus"), (F.coalesce(at(F.sum(parts["e"])), zero) % (1 << (BITS - 2))).alias("e"))
    powers = F.array(*[F.struct(F.lit(1 << k).cast("long").alias("bit"), F.lit(pow(5, 1 << k, 1 << BITS)).cast("long").alias("power")) for k in range(BITS - 2)])

    def residue(s: Column) -> Column:
        plus = F.aggregate(powers, F.lit(1).cast("long"), lambda a, p: F.when(s["e"].bitwiseAND(p["bit"]) == 0, a).otherwise((a * p["power"]).bitwiseAND(F.lit(_MASK))))
        return F.when(s["minus"] % 2 == 1, _MASK + 1 - plus).otherwise(plus)

    def exact(s: Column) -> Column:
        # The number of this residue that is next to the odd part in floating point; decimals, as it may be 2 ** 63.
        power = F.when(s["twos"] > 62, F.lit(Decimal(1 << 63)).cast("decimal(20,0)")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), s["twos"].cast("int")).cast("decimal(20,0)"))
        guess = F.round(s["near"] / F.pow(F.lit(2.0), s["twos"].cast("double"))).cast("decimal(20,0)")
        pair = F.struct(guess.alias("guess"), residue(s).cast("decimal(20,0)").alias("residue"), power.alias("power"))

        def whole(p: Column) -> Column:
            away = F.pmod(p["residue"] - p["guess"], F.lit(_MASK + 1).cast("decimal(20,0)"))
            return let(away, lambda d: (p["guess"] + F.when(d > (_MASK + 1) // 2, d - (_MASK + 1)).otherwise(d)) * p["power"])

        return (let(pair, whole) * F.when(s["below"] % 2 == 1, -1).otherwise(1)).cast("long")

    beyond = F.raise_error(F.lit("a product is beyond 64 bits")).cast("long")
    return let(state, lambda s: F.when(s["zeros"] > 0, zero).when(s["n"] == 0, F.lit(None).cast("long")).when(s["near"] > 9.3e18, beyond).otherwise(exact(s)))


_HALF = Decimal(1 << 32)


def _halves(value: Column, made: Callable[[Column, Column], Column]) -> Column:
    """made(high, low) of an unsigned number, each half a long."""
    low = F.pmod(value.cast(UNSIGNED), F.lit(_HALF).cast(UNSIGNED))
    return let(F.struct(value.cast(UNSIGNED).alias("v"), low.alias("low")), lambda s: made(((s["v"] - s["low"]) / F.lit(_HALF)).cast("long"), s["low"].cast("long")))


def _joined(high: Column, low: Column) -> Column:
    return (high.cast(UNSIGNED) * F.lit(_HALF) + low.cast(UNSIGNED)).cast(UNSIGNED)


def unsigned_bits(aggregate: Callable[[Column], Column], value: Column) -> Column:
    """bit_and, bit_or or bit_xor of unsigned 64-bit numbers, decimal(20, 0) as sums and extremes have them, too. Bits
    never leave the 64; sums and products beyond them are errors, not taken modulo 2 ** 64."""
    return _joined(aggregate(_halves(value, lambda high, low: high)), aggregate(_halves(value, lambda high, low: low)))


def unsigned_xor(a: Column, b: Column) -> Column:
    """a xor b of unsigned 64-bit numbers."""
    parts = lambda c: _halves(c, lambda high, low: F.struct(high.alias("h"), low.alias("l")))
    return let(F.struct(parts(a).alias("a"), parts(b).alias("b")), lambda s: _joined(s["a"]["h"].bitwiseXOR(s["b"]["h"]), s["a"]["l"].bitwiseXOR(s["b"]["l"])))
