"""Hosts as a URL holds them: international names in ASCII, numbers as IPv4 addresses.

Both follow published rules: Punycode (RFC 3492) and the URL standard's host
parser.  Characters are lower-cased but not composed (no NFC).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageflow.functions.bind import bind

# The parameters of Punycode, and its digits.
BASE, TMIN, TMAX, SKEW, DAMP, BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# Characters that end a label like a full stop.
STOPS = "。．｡"
#: No number that a label of 63 characters can make needs more digits, or more halvings of its delta.
_MOST_DIGITS, _MOST_ROUNDS = 13, 8


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _digits(delta: Column, bias: Column) -> Column:
    """A number as digits of falling weight, the last one below its threshold."""

    def digit(value: Column) -> Column:
        return F.substring(F.lit(DIGITS), value.cast("int") + 1, F.lit(1))

    def step(acc: Column, i: Column) -> Column:
        k = i * BASE
        t = F.greatest(_long(TMIN), F.least(_long(TMAX), k - bias))
        rest = acc["q"] - t
        last = rest < 0
        text = F.concat(acc["text"], digit(F.when(last, acc["q"]).otherwise(t + rest % (BASE - t))))
        open_step = F.struct(
            F.floor(rest / (BASE - t)).alias("q"), text.alias("text"), last.alias("done"),
        )
        return F.when(acc["done"], acc).otherwise(open_step)

    start = F.struct(delta.alias("q"), F.lit("").alias("text"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(_long(1), _long(_MOST_DIGITS)), start, step, lambda acc: acc["text"])


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias for the next number."""
    damped = F.floor(delta / F.when(first, DAMP).otherwise(2))
    start = F.struct((damped + F.floor(damped / points)).alias("d"), _long(0).alias("k"))
    limit = ((BASE - TMIN) * TMAX) // 2

    def step(acc: Column, _: Column) -> Column:
        smaller = F.struct(F.floor(acc["d"] / (BASE - TMIN)).alias("d"), (acc["k"] + BASE).alias("k"))
        return F.when(acc["d"] > limit, smaller).otherwise(acc)

    done = lambda acc: acc["k"] + F.floor((BASE - TMIN + 1) * acc["d"] / (acc["d"] + SKEW))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_MOST_ROUNDS)), start, step, done)


def punycode(label: Column) -> Column:
    """A label with other than ASCII characters, without the prefix that marks it."""

    def encoded(chars: Column) -> Column:
        points = F.transform(chars, lambda c: F.ascii(c).cast("bigint"))

        def written(at: Column) -> Column:
            basic = F.filter(chars, lambda c: F.ascii(c) < FIRST)
            n_basic = F.size(basic).cast("bigint")
            others = F.array_sort(F.array_distinct(F.filter(at, lambda p: p >= FIRST)))
            lead = F.concat(F.array_join(basic, ""), F.when(n_basic > 0, "-").otherwise(""))
            start = F.struct(
                lead.alias("text"), _long(0).alias("delta"), _long(BIAS).alias("bias"), _long(FIRST).alias("n"), n_basic.alias("h")
            )

            def insert(acc: Column, point: Column) -> Column:
                """All places of one character, in order; the count of characters passed goes on."""
                ready = F.struct(
                    acc["text"].alias("text"),
                    (acc["delta"] + (point - acc["n"]) * (acc["h"] + 1)).alias("delta"),
                    acc["bias"].alias("bias"),
                    point.alias("n"),
                    acc["h"].alias("h"),
                )

                def place(state: Column, p: Column) -> Column:
                    hit = F.struct(
                        F.concat(state["text"], _digits(state["delta"], state["bias"])).alias("text"),
                        _long(0).alias("delta"),
                        _adapted(state["delta"], state["h"] + 1, state["h"] == n_basic).alias("bias"),
                        state["n"].alias("n"),
                        (state["h"] + 1).alias("h"),
                    )
                    passed = state.withField("delta", state["delta"] + 1)
                    return F.when(p == point, hit).when(p < point, passed).otherwise(state)

                def onward(state: Column) -> Column:
                    return state.withField("delta", state["delta"] + 1).withField("n", state["n"] + 1)

                return F.aggregate(at, ready, place, onward)

            return F.aggregate(others, start, insert, lambda acc: acc["text"])

        return bind(points, written)

    places = F.sequence(F.lit(1), F.length(label))
    return bind(F.transform(places, lambda i: F.substring(label, i, F.lit(1))), encoded)


def _ipv4(labels: Column) -> Column:
    """The dotted address of one to four numbers, NULL if they are none."""

    def number(part: Column) -> Column:
        significant = lambda digits: F.regexp_replace(digits, r"^0+(?=.)", "")
        value = lambda digits, base: F.when(
            F.length(significant(digits)) <= 12, F.conv(significant(digits), base, 10).cast("bigint")
        )
        return (
            F.when(part.rlike("^0x$"), _long(0))
            .when(part.rlike("^0x[0-9a-f]+$"), value(F.substring(part, 3, F.length(part)), 16))
            .when(part.rlike("^0[0-7]+$"), value(part, 8))
            .when(part.rlike("^(0|[1-9][0-9]*)$"), value(part, 10))
        )

    def address(numbers: Column) -> Column:
        n = F.size(numbers)
        last = F.get(numbers, n - 1)
        head = F.slice(numbers, F.lit(1), n - 1)
        sound = (n <= 4) & F.forall(head, lambda x: F.coalesce(x <= 255, F.lit(False))) & (last < F.pow(F.lit(256), 5 - n))
        total = F.aggregate(
            F.transform(head, lambda x, i: x * F.pow(F.lit(256), 3 - i).cast("bigint")), last, lambda acc, x: acc + x
        )
        byte = lambda v, k: F.pmod(F.floor(v / 256**k), F.lit(256)).cast("string")
        return F.when(sound, bind(total, lambda v: F.concat_ws(".", *[byte(v, k) for k in (3, 2, 1, 0)])))

    return bind(F.transform(labels, number), address)


def ascii_host(host: Column) -> Column:
    """A decoded host as a URL holds it, NULL if it is a number that is no address."""
    dotted = F.regexp_replace(F.lower(host), f"[{STOPS}]", ".")

    def whole(name: Column) -> Column:
        labels = F.transform(
            F.split(name, r"\."), lambda p: F.when(p.rlike(r"[^\x00-\x7f]"), F.concat(F.lit("xn--"), punycode(p))).otherwise(p)
        )
        ascii_name = F.when(name.rlike(r"[^\x00-\x7f]"), F.array_join(labels, ".")).otherwise(name)

        def settled(done: Column) -> Column:
            numeric = done.rlike(r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?$")
            return F.when(numeric, _ipv4(F.split(F.regexp_replace(done, r"\.$", ""), r"\."))).otherwise(done)

        return bind(ascii_name, settled)

    return bind(dotted, whole)
