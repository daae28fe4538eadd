"""Distribution functions as SQL expressions over columns, which Spark and DuckDB both run.

Each function takes texts of expressions and gives one; `Dialect` says how loops over a list are written. Series have as
many terms as their arguments ask for, so a row costs some thousand steps at most and no row needs another. Nulls give null.
Searches (quantiles of t, power) are loops in loops, which Spark runs in milliseconds a row and DuckDB too slowly to use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count
from statistics import NormalDist

#: The rational approximation of the normal tail (Hart 1968, in the form of West 2005), highest power first.
TAIL_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
#: From these degrees of freedom on the t distribution is the normal one with a correction.
MANY = 2_000


@dataclass
class Dialect:
    """Writes a name for a value, and a loop that carries one number along."""

    duck: bool
    names: count = field(default_factory=count)

    def let(self, value: str, body: Callable[[str], str]) -> str:
        v = f"v{next(self.names)}"
        if self.duck:
            return f"list_transform([{value}], lambda {v}: {body(v)})[1]"
        return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"

    def fold(self, n: str, first: str, body: Callable[[str, str], str]) -> str:
        """first, after body(carried, k) for k from 1 to n."""
        a, k = (f"{x}{next(self.names)}" for x in "ak")
        if self.duck:
            return f"list_reduce(list_transform(range(1, CAST({n} AS BIGINT) + 1), lambda i: CAST(i AS DOUBLE)), lambda {a}, {k}: {body(a, k)}, CAST({first} AS DOUBLE))"
        return f"aggregate(transform(sequence(1, CAST({n} AS INT)), i -> CAST(i AS DOUBLE)), CAST({first} AS DOUBLE), ({a}, {k}) -> CAST({body(a, k)} AS DOUBLE))"

    # The functions below are alike in both.

    def normal_cdf(self, x: str) -> str:
        horner = lambda c, v: f"{'(' * (len(c) - 1)}{c[0]!r}" + "".join(f" * {v} + {k!r})" for k in c[1:])

        def tail(v: str, z: str) -> str:
            near = f"exp(-{z} * {z} / 2) * {horner(TAIL_ABOVE, z)} / {horner(TAIL_BELOW, z)}"
            far = f"exp(-{z} * {z} / 2) / 2.506628274631 / ({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65)))))"
            t = f"CASE WHEN {z} < 7.07106781186547 THEN {near} WHEN {z} < 37 THEN {far} WHEN {z} >= 37 THEN CAST(0.0 AS DOUBLE) END"
            return f"CASE WHEN {v} > 0 THEN 1 - {t} ELSE {t} END".replace("CASE WHEN " + v + " > 0 THEN 1 - " + t, f"CASE WHEN {v} > 0 THEN 1 - ({t})")

        return self.let(f"CAST({x} AS DOUBLE)", lambda v: self.let(f"abs({v})", lambda z: tail(v, z)))

    def normal_quantile(self, p: str) -> str:
        """By halving steps from 0, within 8 deviations."""
        found = lambda q: self.fold("58", "0.0", lambda a, k: f"{a} + CASE WHEN {self.normal_cdf(a)} < {q} THEN 8 ELSE -8 END * pow(2, -{k})")
        return self.let(f"CAST({p} AS DOUBLE)", lambda q: f"CASE WHEN {q} IS NOT NULL THEN {found(q)} END")

    def log_gamma(self, x: str) -> str:
        """Stirling's series at x + 8, less the factors between."""

        def series(v: str, w: str) -> str:
            less = " * ".join(f"({v} + {k})" if k else v for k in range(8))
            return f"(({w} - 0.5) * ln({w}) - {w} + 0.91893853320467274 + 1 / (12 * {w}) - 1 / (360 * pow({w}, 3)) + 1 / (1260 * pow({w}, 5)) - 1 / (1680 * pow({w}, 7)) + 1 / (1188 * pow({w}, 9)) - ln({less}))"

        return self.let(f"CAST({x} AS DOUBLE)", lambda v: self.let(f"{v} + 8", lambda w: series(v, w)))

    def beta_inc(self, a: str, b: str, x: str) -> str:
        """The regularised incomplete beta function by its continued fraction, from the last term to the first."""

        def fraction(a: str, b: str, x: str) -> str:
            def step(f: str, k: str, n: str) -> str:
                i = f"({n} - {k} + 1)"  # terms from the last on
                m = f"floor({i} / 2)"
                even = f"{m} * ({b} - {m}) * {x} / (({a} + 2 * {m} - 1) * ({a} + 2 * {m}))"
                odd = f"-({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2 * {m}) * ({a} + 2 * {m} + 1))"
                return f"1 + CASE WHEN {i} % 2 = 0 THEN {even} ELSE {odd} END / {f}"

            front = f"exp({self.log_gamma(f'{a} + {b}')} - {self.log_gamma(a)} - {self.log_gamma(b)} + {a} * ln({x}) + {b} * ln(1 - {x})) / {a}"
            # An even number of terms, which grows with the root of the larger argument.
            return self.let(f"2 * floor(20 + 2 * sqrt(greatest({a}, {b})))", lambda n: f"{front} / {self.fold(n, '1.0', lambda f, k: step(f, k, n))}")

        def sides(a: str, b: str, x: str) -> str:
            swapped = f"{x} > ({a} + 1) / ({a} + {b} + 2)"
            pick = lambda yes, no: f"CASE WHEN {swapped} THEN {yes} ELSE {no} END"
            inner = self.let(pick(b, a), lambda c: self.let(pick(a, b), lambda d: self.let(pick(f"1 - {x}", x), lambda y: fraction(c, d, y))))
            return f"CASE WHEN {x} <= 0 THEN CAST(0.0 AS DOUBLE) WHEN {x} >= 1 THEN CAST(1.0 AS DOUBLE) ELSE {self.let(inner, lambda r: pick(f'1 - {r}', r))} END"

        as_double = lambda v: f"CAST({v} AS DOUBLE)"
        return self.let(as_double(a), lambda p: self.let(as_double(b), lambda q: self.let(as_double(x), lambda y: sides(p, q, y))))

    def t_two_sided(self, t: str, df: str) -> str:
        """The chance of a value as far from 0 as t; null without degrees of freedom."""

        def far(t: str, v: str) -> str:
            many = f"2 * {self.normal_cdf(f'-abs({t}) * (1 - 1 / (4 * {v})) / sqrt(1 + {t} * {t} / (2 * {v}))')}"
            return f"CASE WHEN {v} > {MANY} THEN {many} WHEN {v} > 0 THEN {self.beta_inc(f'{v} / 2', '0.5', f'{v} / ({v} + {t} * {t})')} END"

        return self.let(f"CAST({t} AS DOUBLE)", lambda x: self.let(f"CAST({df} AS DOUBLE)", lambda v: far(x, v)))

    def t_quantile(self, p: str, df: str) -> str:
        """The upper quantile for p over one half: that of the normal with its correction, and then Newton's steps. One and two
        degrees of freedom have a closed form."""

        def near(q: str, v: str) -> str:
            constant = f"exp({self.log_gamma(f'({v} + 1) / 2')} - {self.log_gamma(f'{v} / 2')}) / sqrt({v} * 3.141592653589793)"
            start = self.let(self.normal_quantile(f"1 - {q} / 2"), lambda z: f"{z} + (pow({z}, 3) + {z}) / (4 * {v}) + (5 * pow({z}, 5) + 16 * pow({z}, 3) + 3 * {z}) / (96 * {v} * {v})")
            return self.let(constant, lambda c: self.fold("6", start, lambda x, _: f"{x} + ({self.t_two_sided(x, v)} - {q}) / (2 * {c} * pow(1 + {x} * {x} / {v}, -({v} + 1) / 2))"))

        def closed(q: str, v: str) -> str:
            return f"CASE WHEN {v} = 1 THEN 1 / tan({q} * 1.5707963267948966) WHEN {v} = 2 THEN (1 - {q}) * sqrt(2 / ({q} * (2 - {q}))) WHEN {v} > 2 THEN {near(q, v)} END"

        return self.let(f"CAST(2 * (1 - {p}) AS DOUBLE)", lambda q: self.let(f"CAST({df} AS DOUBLE)", lambda v: closed(q, v)))

    def _by_deviation(self, t: str, v: str, body: Callable[..., str]) -> str:
        """body(low, wide, nodes, total): where the sample's deviation s lies, how many steps over it are fine enough for values about
        t, and the sum of Simpson's weights by the density of s."""
        reach = f"9 / sqrt(2 * nullif({v}, 0))"
        total = lambda low, wide, nodes: self.fold(f"{nodes} + 1", "0.0", lambda a, k: f"{a} + {self._weight(k, low, wide, v, nodes)}")
        rest = lambda low, wide: self.let(f"2 * floor(30 + 3 * {wide} * abs({t}))", lambda nodes: f"CASE WHEN {nodes} > 0 THEN {self.let(total(low, wide, nodes), lambda sum: body(low, wide, nodes, sum))} END")
        return self.let(f"greatest(CAST(0.0 AS DOUBLE), 1 - {reach})", lambda low: self.let(f"1 + {reach} - {low}", lambda wide: rest(low, wide)))

    def _weight(self, k: str, low: str, wide: str, v: str, nodes: str) -> str:
        at = f"({low} + {wide} * ({k} - 1) / {nodes})"
        return f"CASE WHEN {k} = 1 OR {k} = {nodes} + 1 THEN 1 WHEN {k} % 2 = 0 THEN 4 ELSE 2 END * CASE WHEN {at} > 0 THEN exp(({v} - 1) * ln({at}) - {v} * ({at} * {at} - 1) / 2) WHEN {v} = 1 THEN exp(0.5) ELSE 0.0 END"

    def _beyond(self, t: str, v: str, d: str, low: str, wide: str, nodes: str, total: str) -> str:
        def one(k: str) -> str:
            at = f"({low} + {wide} * ({k} - 1) / {nodes})"
            return f"{self._weight(k, low, wide, v, nodes)} * ({self.normal_cdf(f'{d} - {t} * {at}')} + {self.normal_cdf(f'-{d} - {t} * {at}')})"

        return f"{self.fold(f'{nodes} + 1', '0.0', lambda a, k: f'{a} + {one(k)}')} / {total}"

    def t_power(self, t: str, df: str, shift: str) -> str:
        """The chance that a t value with non-centrality `shift` lies beyond t on either side: the normal chance given the sample's
        deviation s, over the distribution of s, by Simpson's rule. Both sums have the same nodes, so no constant is needed."""
        return self.let(f"CAST({t} AS DOUBLE)", lambda x: self.let(f"CAST({df} AS DOUBLE)", lambda v: self.let(f"CAST({shift} AS DOUBLE)", lambda d: self._by_deviation(x, v, lambda *at: self._beyond(x, v, d, *at)))))

    def power(self, effect: str, n: str, alpha: float = 0.05) -> str:
        """Of a two-sided one-sample t test for an effect in deviations."""
        return self.let(f"CAST({n} AS DOUBLE)", lambda m: self.let(self.t_quantile(repr(1 - alpha / 2), f"{m} - 1"), lambda c: self.t_power(c, f"{m} - 1", f"{effect} * sqrt({m})")))

    def detectable(self, n: str, target: float = 0.8, alpha: float = 0.05) -> str:
        """The least effect that the test finds with the chance `target`, up to 16, by halving steps to six decimals."""

        def step(m: str, c: str, v: str) -> str:
            beyond = lambda a, at: self.let(f"{a} * sqrt({m})", lambda d: self._beyond(c, v, d, *at))
            return self._by_deviation(c, v, lambda *at: self.fold("26", "8.0", lambda a, k: f"{a} + CASE WHEN {beyond(a, at)} < {target} THEN 8 ELSE -8 END * pow(2, -{k})"))

        found = lambda m, v: self.let(self.t_quantile(repr(1 - alpha / 2), v), lambda c: f"CASE WHEN {c} IS NOT NULL THEN {step(m, c, v)} END")
        return self.let(f"CAST({n} AS DOUBLE)", lambda m: self.let(f"{m} - 1", lambda v: found(m, v)))

    def required_n(self, effect: str, target: float = 0.8, alpha: float = 0.05, bits: int = 17) -> str:
        """The fewest rows with that chance; null beyond 2^bits. They are guessed by the normal quantiles: where the guess is enough
        and one row less is too few, that is all. Elsewhere the largest number that is too few is built bit by bit."""
        z, tail = NormalDist().inv_cdf(target) + NormalDist().inv_cdf(1 - alpha / 2), NormalDist().inv_cdf(1 - alpha / 2)
        most, add = f"pow(2, {bits})", lambda k: f"pow(2, {bits} - {k})"
        few = lambda d: self.fold(str(bits), "1.0", lambda a, k: f"{a} + CASE WHEN {self.power(d, f'{a} + {add(k)}', alpha)} < {target} THEN {add(k)} ELSE 0 END")
        guess = lambda d: f"least({most} + 1, greatest(CAST(2.0 AS DOUBLE), ceil({z * z!r} / pow(greatest(abs({d}), 1e-6), 2) + {tail * tail / 2!r})))"
        enough = lambda d, m: f"CASE WHEN {m} > {most} THEN 1 WHEN {m} < 2 THEN 0 WHEN {self.power(d, m, alpha)} < {target} THEN 0 ELSE 1 END"
        # Of the guess and the number before it, in one loop, how many are as they should be.
        right = lambda d, g: self.fold("2", "0.0", lambda a, k: self.let(f"{g} + 1 - {k}", lambda m: f"{a} + CASE WHEN {enough(d, m)} = 2 - {k} THEN 1 ELSE 0 END"))
        found = lambda d: self.let(guess(d), lambda g: f"CASE WHEN {right(d, g)} = 2 THEN {g} - 1 ELSE {few(d)} END")
        return self.let(f"CAST({effect} AS DOUBLE)", lambda d: self.let(f"CASE WHEN {d} IS NOT NULL THEN {found(d)} END", lambda n: f"CASE WHEN {n} < {most} THEN CAST({n} + 1 AS BIGINT) END"))


SPARK, DUCK = Dialect(False), Dialect(True)
