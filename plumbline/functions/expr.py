"""Column builders over probability arrays: decisions, correctness, entropy, divergences, bins, keyed draws."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 1e-12


def argmax(p: Column) -> Column:
    """Place of the largest entry, from 0; ties: the first."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def confidence(p: Column) -> Column:
    return F.array_max(p)


def soft_correctness(p: Column, dist: Column) -> Column:
    """Share of human votes for the decision."""
    return F.element_at(dist, argmax(p) + 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used, within lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalised(p: Column) -> Column:
    """Entries over their sum; a zero sum leaves them as they are."""
    return once(p, lambda p: once(total(p), lambda s: F.transform(p, lambda x: x / F.when(s == 0, 1.0).otherwise(s))))


def entropy_bits(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)))


def _clipped(p: Column) -> Column:
    c = F.transform(p, lambda x: F.greatest(x, F.lit(CLIP)))
    return F.transform(c, lambda x: x / total(c))


def _kl(p: Column, q: Column, log) -> Column:
    return total(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * log(a / F.when(b > 0, b).otherwise(1.0))).otherwise(0.0)))


def jsd_bits(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits, of entries clipped from below and normalised."""
    a, b = _clipped(p), _clipped(q)
    m = F.zip_with(a, b, lambda x, y: (x + y) / 2)
    return (_kl(a, m, F.log2) + _kl(b, m, F.log2)) / 2


def jsd_nats(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in nats with exact zeros, within 0 and ln 2."""
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return F.greatest(F.lit(0.0), F.least(F.lit(0.6931471805599453 + 1e-12), (_kl(p, m, F.ln) + _kl(q, m, F.ln)) / 2))


def tvd(p: Column, q: Column) -> Column:
    """Half the summed absolute differences."""
    return total(F.zip_with(p, q, lambda a, b: F.abs(a - b))) / 2


def cross_entropy(human: Column, p: Column) -> Column:
    return -total(F.zip_with(_clipped(human), _clipped(p), lambda h, x: h * F.ln(x)))


def margin(p: Column) -> Column:
    """Largest minus second largest."""
    s = F.sort_array(p, asc=False)
    return F.element_at(s, 1) - F.coalesce(F.try_element_at(s, F.lit(2)), F.lit(0.0))


def tempered(p: Column, t: Column) -> Column:
    """softmax(log p / t)."""
    raised = F.transform(p, lambda x: F.pow(F.greatest(x, F.lit(CLIP)), 1.0 / t))
    return F.transform(raised, lambda x: x / total(raised))


def uniform_edges(bins: int) -> list[float]:
    step = 1.0 / bins
    return [i * step for i in range(1, bins)]


def bin_digitize(x: Column, bins: int) -> Column:
    """Inner edges i * (1 / bins) that are at most x."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in uniform_edges(bins)]), lambda e: e <= x))


def bin_floor(x: Column, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.floor(x * bins).cast("int"))


def keyed(*parts: Column) -> Column:
    """A number from 0 to below 2 ** 32 by MD5 of the parts: the same on every run and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


#: P(Poisson(1) <= k) for k = 0, 1, ...; fixed values.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]
#: The same as eight hex digits: the least 32-bit numbers beyond each share.
POISSON_HEX = [f"{-int(-c * 2**32 // 1):08x}" for c in POISSON]


def poisson(hexes: Column) -> Column:
    """A Poisson(1) weight from eight hex digits of an MD5; digits of equal length compare as their numbers do."""
    out = F.when(hexes < POISSON_HEX[0], 0)
    for k, least in enumerate(POISSON_HEX[1:], 1):
        out = out.when(hexes < least, k)
    return out.otherwise(len(POISSON_HEX))


def distribution(values: Column, what: str = "probabilities") -> Column:
    """values over their sum; an error where one is negative or the sum isn't positive."""
    s = total(values)
    bad = F.exists(values, lambda x: x < 0) | (s <= 0)
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{what}: negative or without a positive sum: "), F.to_json(values)))).otherwise(F.transform(values, lambda x: x / s))


def tvd_normalised(p: Column, q: Column) -> Column:
    return tvd(distribution(p), distribution(q))


def entropy_ceiling(n: int) -> float:
    """The entropy in bits of n equal shares."""
    import math

    return math.log2(n)


def label_index(label: Column, order: list[str]) -> Column:
    """Place of a label in order, from 0; an error for a label that isn't there; null stays null."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), label)
    return F.when(place > 0, place - 1).when(label.isNotNull(), F.raise_error(F.concat(F.lit("unknown label: "), label))).cast("int")


#: A rational approximation of erfc (relative error below 1.2e-7), constant first.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
#: Rational approximations of the normal quantile (relative error below 1.2e-9): middle and tails.
MIDDLE = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239], [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
TAIL = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783], [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]


def _horner(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def erfc(x: Column) -> Column:
    t = 1.0 / (1.0 + 0.5 * F.abs(x))
    tail = t * F.exp(-x * x + _horner(ERFC[::-1], t))
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def normal_cdf(x: Column) -> Column:
    return 0.5 * erfc(-x / 1.4142135623730951)


def normal_quantile(p: Column) -> Column:
    """Of p within 0 and 1."""
    far = lambda q: _horner(TAIL[0], q) / _horner(TAIL[1], q)
    d = p - 0.5
    return F.when(p < 0.02425, far(F.sqrt(-2 * F.ln(p)))).when(p > 0.97575, -far(F.sqrt(-2 * F.ln(1 - p)))).otherwise(d * _horner(MIDDLE[0], d * d) / _horner(MIDDLE[1], d * d))


def chi2_tail(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return erfc(F.sqrt(F.greatest(x, F.lit(0.0)) / 2))


def p_display(p: Column, extreme: Column, draws: int) -> Column:
    """'p < 1/(draws + 1)' where no draw was as extreme, else p to four places."""
    return F.when(extreme == 0, F.lit(f"p < 1/{draws + 1}")).otherwise(F.concat(F.lit("p = "), F.format_string("%.4f", p)))


#: The Lanczos approximation of the gamma function, g = 7 (relative error below 1e-14).
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_gamma(x: Column) -> Column:
    """Of x from 0.5 on."""
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        series = series + c / (x + i)
    t = x + 6.5
    return 0.9189385332046727 + (x - 0.5) * F.ln(t) - t + F.ln(series)


def log_beta_half(a: Column) -> Column:
    """The logarithm of the beta function of a (from 0.5 on) and 1/2; far out by the series of the gamma functions' ratio,
    whose logarithms would cancel there."""
    ratio = 0.5 * F.ln(a) - 1 / (8 * a) + 1 / (192 * F.pow(a, 3)) - 1 / (640 * F.pow(a, 5))
    return 0.5723649429247001 - F.when(a > 100, ratio).otherwise(log_gamma(a + 0.5) - log_gamma(a))


def beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's method; it converges within some square roots of the
    larger parameter for x below (a + 1) / (a + b + 2)."""
    tiny = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def half(s: Column, top: Column) -> Column:
        d = 1.0 / tiny(1.0 + top * s["d"])
        c = tiny(1.0 + top / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    def turn(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # An array of one names the first half's values, which the second uses several times.
        return F.element_at(F.transform(F.array(half(s, even)), lambda u: half(u, odd)), 1)

    first = 1.0 / tiny(1.0 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    steps = F.sequence(F.lit(1), F.least(F.lit(20_000), (60 + 4 * F.sqrt(F.greatest(a, b))).cast("int")))
    return F.aggregate(F.transform(steps, lambda m: m.cast("double")), start, turn, lambda s: s["h"])


def t_tails(t: Column, df: Column) -> Column:
    """Both tails of Student's t beyond |t|: the incomplete beta function of df / (df + t * t) with df / 2 and 1/2, from
    the side where its fraction converges."""
    a, b = df / 2, F.lit(0.5)
    y = t * t / (df + t * t)
    front = F.exp(a * F.log1p(-y) + b * F.ln(y) - log_beta_half(a))
    far = front * beta_fraction(1 - y, a, b) / a
    near = 1 - front * beta_fraction(y, b, a) / b
    return F.when(t == 0, 1.0).otherwise(F.when(1 - y < (a + 1) / (a + b + 2), far).otherwise(near))


def spearman_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation of n rows by Student's t; null for fewer than four rows or a null correlation, 0
    of a perfect one."""
    free = 1 - rho * rho
    t = rho * F.sqrt((n - 2) / F.when(free > 0, free))
    return F.when((n < 4) | rho.isNull(), None).when(free <= 0, 0.0).otherwise(t_tails(t, (n - 2).cast("double")))


def sentinels(options: Column, seed: int, *key: Column, alphabet: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ") -> Column:
    """A letter for each option, in order of options: the first letters, permuted by keyed draws of (seed, key, place); an
    error for more options than letters."""
    letters = F.array(*[F.lit(c) for c in alphabet])
    drawn = F.transform(options, lambda _, i: F.struct(keyed(F.lit(seed), *key, i).alias("u"), i.alias("i")))
    order = F.transform(F.array_sort(drawn), lambda d: d["i"])
    named = F.transform(options, lambda _, i: F.get(letters, F.array_position(order, i).cast("int") - 1))
    return F.when(F.size(options) <= len(alphabet), named).otherwise(F.raise_error(F.lit(f"more than {len(alphabet)} options")).cast("array<string>"))


def by_option(options: Column, letters: Column, scores: Column) -> Column:
    """Scores keyed by letters (a map) as an array in order of options; null for a letter that has none. The inverse of
    sentinels(): letters name options, whatever the permutation."""
    return F.transform(options, lambda _, i: F.try_element_at(scores, F.get(letters, i)))


def softmax_logs(logs: Column) -> Column:
    """Probabilities of log-probabilities over the options asked for; null, NaN and infinite ones count as 0, and so do
    all where none is finite."""
    known = F.transform(logs, lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x))
    raised = F.transform(known, lambda x: F.coalesce(F.exp(x - F.array_max(known)), F.lit(0.0)))
    return F.transform(raised, lambda x: F.coalesce(x / F.nullif(total(raised), F.lit(0.0)), F.lit(0.0)))


def expected_score(p: Column, levels: Column) -> Column:
    """The mean level under the probabilities; a number, never rounded."""
    return total(F.zip_with(p, levels, lambda a, b: a * b))
