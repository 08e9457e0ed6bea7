"""Operators on order: running sums, average ranks, AUROC, average precision, risk and coverage, Spearman.

Running sums over a whole group would be one task's work; `cumulate` adds up equal values first, then cuts them at
approximate quantiles into CELLS of about as many distinct values, however they lie: sums of whole cells are a small
window, and only a cell's own values are ordered in one task. Exact quantiles are read off these sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.tables import stored

CELLS = 256  # a power of two: a value's cell is found by halving


def cumulate(df: DataFrame, by: list[str], x: str, sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """Per group and distinct x: each sum, and cum_<name>, the sum over all values up to x (from x where descending)."""
    values = df.groupBy(*by, x).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    borders = values.groupBy(*by).agg(F.percentile_approx(x, [i / CELLS for i in range(1, CELLS)], 1000).alias("__borders"))
    placed = values.join(borders, by) if by else values.crossJoin(F.broadcast(borders))
    placed = placed.withColumn("__cell", F.lit(0))
    step = CELLS // 2
    while step:  # the number of borders below x
        at = F.col("__cell") + step
        placed = placed.withColumn("__cell", F.when(F.element_at("__borders", at) < F.col(x), at).otherwise(F.col("__cell")))
        step //= 2
    placed = placed.drop("__borders")
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    before = Window.partitionBy(*by).orderBy(order("__cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy(*by, "__cell").agg(*[F.sum(n).alias(n) for n in sums])
    cells = cells.select(*by, "__cell", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    within = Window.partitionBy(*by, "__cell").orderBy(order(x)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(cells, [*by, "__cell"])
    return out.select(*by, x, *sums, *[(F.col(f"__{n}") + F.sum(n).over(within)).alias(f"cum_{n}") for n in sums])


def auroc(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Mann-Whitney area with half of ties; null where a class is missing."""
    c = cumulate(df, by, x, {"pos": F.col(y).cast("long"), "neg": 1 - F.col(y).cast("long")})
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return c.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.when(pairs > 0, wins / F.when(pairs > 0, pairs)).alias("auroc"))


def auprc(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Average precision over distinct thresholds, from the highest."""
    c = cumulate(df, by, x, {"pos": F.col(y).cast("long"), "n": F.lit(1).cast("long")}, descending=True)
    return c.groupBy(*by).agg((F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")) / F.nullif(F.sum("pos"), F.lit(0))).alias("auprc"))


def risk_coverage(df: DataFrame, by: list[str], x: str, correct: str) -> DataFrame:
    """Per threshold (each distinct score): coverage, and risk among the rows covered."""
    c = cumulate(df, by, x, {"hits": F.col(correct).cast("long"), "n": F.lit(1).cast("long")}, descending=True)
    size = df.groupBy(*by).agg(F.count("*").alias("size"))
    c = c.join(size, by) if by else c.crossJoin(F.broadcast(size))
    return c.select(*by, F.col(x).alias("threshold"), "cum_n", (F.col("cum_n") / F.col("size")).alias("coverage"), (1 - F.col("cum_hits") / F.col("cum_n")).alias("risk"))


def aurc(df: DataFrame, by: list[str], x: str, correct: str) -> DataFrame:
    """Area under risk over coverage by trapezoids, from coverage 0 at the first risk. Between neighbouring thresholds the last
    coverage and risk are the running sums less the threshold's own rows, so no order of the whole curve is needed."""
    c = cumulate(df, by, x, {"hits": F.col(correct).cast("long"), "n": F.lit(1).cast("long")}, descending=True)
    size = df.groupBy(*by).agg(F.count("*").alias("size"))
    c = c.join(size, by) if by else c.crossJoin(F.broadcast(size))
    before = F.col("cum_n") - F.col("n")
    risk = 1 - F.col("cum_hits") / F.col("cum_n")
    last = F.when(before > 0, 1 - (F.col("cum_hits") - F.col("hits")) / F.when(before > 0, before)).otherwise(risk)
    return c.groupBy(*by).agg(F.sum(F.col("n") / F.col("size") * (risk + last) / 2).alias("aurc"))


def quantiles(df: DataFrame, by: list[str], x: str, linear: dict[str, float] | None = None, nearest: dict[str, float] | None = None) -> DataFrame:
    """Per group n and exact quantiles by name: linear between neighbours, or the nearest rank (the ceil(q * n)-th)."""
    c = cumulate(df.where(F.col(x).isNotNull()), by, x, {"__n": F.lit(1).cast("long")})
    size = c.groupBy(*by).agg(F.sum("__n").alias("n"))
    c = c.join(size, by) if by else c.crossJoin(F.broadcast(size))
    at = lambda place: F.min(F.when(F.col("cum___n") > place, F.col(x)))  # noqa: E731  the value at a place from 0
    parts, out = [], []
    for name, q in (linear or {}).items():
        h = (F.col("n") - 1) * q
        parts += [at(F.floor(h)).alias(f"__{name}_a"), at(F.ceil(h)).alias(f"__{name}_b")]
        out.append((F.col(f"__{name}_a") + ((F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)) * (F.col(f"__{name}_b") - F.col(f"__{name}_a"))).alias(name))
    for name, q in (nearest or {}).items():
        parts.append(at(F.greatest(F.lit(0), F.ceil(F.col("n") * q) - 1)).alias(f"__{name}"))
        out.append(F.col(f"__{name}").alias(name))
    return c.groupBy(*by, "n").agg(*parts).select(*by, "n", *out)


def gate_sweep(df: DataFrame, x: str, correct: str, least: float = 0.5, most: float = 0.99, step: float = 0.01) -> DataFrame:
    """Per threshold: rows at or above it, their share, and their mean correctness. Rows are counted by the last threshold they
    pass, and added up from the highest."""
    n = int(round((most - least) / step)) + 1
    gates = [round(least + i * step, 10) for i in range(n)]
    passed = F.size(F.filter(F.array(*[F.lit(g) for g in gates]), lambda g: g <= F.col(x)))
    counts = df.groupBy(passed.alias("passed")).agg(F.count("*").alias("n"), F.sum(correct).alias("hits"))
    size = counts.agg(F.sum("n").alias("size"))
    table = df.sparkSession.createDataFrame([(i + 1, g) for i, g in enumerate(gates)], "gate int, threshold double")
    held = table.join(F.broadcast(counts), F.col("passed") >= F.col("gate"), "left").groupBy("gate", "threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("hits").alias("hits"))
    return held.crossJoin(F.broadcast(size)).select("threshold", "n", (F.col("n") / F.col("size")).alias("share"), (F.col("hits") / F.nullif(F.col("n"), F.lit(0))).alias("mean_correct"))


def coverage_at_quantiles(df: DataFrame, x: str, correct: str, n: int) -> DataFrame:
    """Risk and coverage at n quantiles of the scores as thresholds, instead of at every distinct score."""
    names = {f"t{i}": i / (n - 1) for i in range(n)}
    gates = quantiles(df, [], x, names).select(F.col("n").alias("size"), F.array_sort(F.array_distinct(F.array(*[F.col(c) for c in names]))).alias("gates"))
    rows = df.crossJoin(F.broadcast(gates)).withColumn("passed", F.size(F.filter("gates", lambda g: g <= F.col(x))))
    counts = rows.groupBy("passed").agg(F.count("*").alias("n"), F.sum(correct).alias("hits"))
    table = gates.select("size", F.posexplode("gates").alias("gate", "threshold"))
    held = table.join(F.broadcast(counts), F.col("passed") > F.col("gate")).groupBy("threshold", "size").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return held.select("threshold", (F.col("n") / F.col("size")).alias("coverage"), (1 - F.col("hits") / F.col("n")).alias("risk"))


def widest_gate(gates: DataFrame, required: float) -> DataFrame:
    """The gate of the largest share whose mean correctness is as required (ties: the lowest); nulls where none is."""
    return gates.agg(F.max_by(F.struct("threshold", "share", "mean_correct"), F.when(F.col("mean_correct") >= required, F.struct("share", -F.col("threshold")))).alias("g")).select("g.*")


def farthest(df: DataFrame, x: str, y: str, item: str) -> DataFrame:
    """The row where |x - y| is largest (ties: the smallest item)."""
    return df.agg(F.min_by(F.struct(item, x, y), F.struct(-F.abs(F.col(x) - F.col(y)), F.col(item))).alias("r")).select("r.*")


def macro_auroc(df: DataFrame, p: str, label: str) -> DataFrame:
    """Mean of the one-vs-rest areas of all classes; null where one has no row, or all."""
    rows = df.select(F.posexplode(p).alias("k", "x"), label).withColumn("y", (F.col("k") == F.col(label)).cast("int"))
    each = auroc(rows, ["k"], "x", "y")
    return each.agg(F.when(F.bool_and(F.col("auroc").isNotNull()), F.avg("auroc")).alias("auroc"))


def automation(curve: DataFrame, by: list[str], target: float) -> DataFrame:
    """Largest coverage whose accuracy reaches the target; coverage 0 and a null threshold where none does."""
    fit = (1 - F.col("risk")) + 1e-12 >= target
    return curve.groupBy(*by).agg(F.coalesce(F.max(F.when(fit, F.col("coverage"))), F.lit(0.0)).alias("coverage"), F.min(F.when(fit, F.col("threshold"))).alias("threshold"))


def average_ranks(df: DataFrame, by: list[str], x: str, name: str) -> DataFrame:
    """df with the rank of x in its group, ties averaged."""
    counts = stored(df.groupBy(*by, x).agg(F.count("*").alias("n")))  # its plan would be repeated for cells and ends
    c = cumulate(counts, by, x, {"n": F.col("n")}).select(*by, x, (F.col("cum_n") - (F.col("n") - 1) / 2).alias(name))
    return df.join(c, [*by, x])


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Pearson correlation of average ranks; null where a side is constant."""
    df = stored(df.select(*by, a, b))
    r = average_ranks(average_ranks(df, by, a, "__ra"), by, b, "__rb")
    spread = (F.stddev_pop("__ra") > 0) & (F.stddev_pop("__rb") > 0)
    top = F.avg(F.col("__ra") * F.col("__rb")) - F.avg("__ra") * F.avg("__rb")
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.when(spread, top / F.when(spread, F.stddev_pop("__ra") * F.stddev_pop("__rb"))).alias("rho"))


def partial_spearman(df: DataFrame, a: str, b: str, z: str, places: int = 6) -> DataFrame:
    """n and Spearman's correlation of the residuals of a's and b's ranks on z's (rounded to `places`); null for fewer than five rows."""
    r = stored(df.select(F.col(a).alias("__a"), F.col(b).alias("__b"), F.col(z).alias("__z")))
    for x in "abz":
        r = average_ranks(r, [], f"__{x}", x)
    r = stored(r.select("a", "b", "z"))
    fit = r.agg(*[f(x, "z").alias(f"{k}{x}") for x in "ab" for k, f in (("s", F.regr_slope), ("i", F.regr_intercept))])
    e = r.crossJoin(F.broadcast(fit)).select(*[(F.round(F.col(x) - F.col(f"i{x}") - F.col(f"s{x}") * F.col("z"), places) + 0.0).alias(x) for x in "ab"])
    return spearman(e, [], "a", "b").withColumn("rho", F.when(F.col("n") >= 5, F.col("rho")))


def ecdf(df: DataFrame, by: list[str], x: str) -> DataFrame:
    size = df.groupBy(*by).agg(F.count("*").alias("size"))
    c = cumulate(df, by, x, {"n": F.lit(1).cast("long")})
    return (c.join(size, by) if by else c.crossJoin(F.broadcast(size))).select(*by, x, (F.col("cum_n") / F.col("size")).alias("share"))


def rank_matrix(df: DataFrame, item: str, columns: list[str]) -> DataFrame:
    """(a, b, n, rho, p) of each pair of columns, a before b: Spearman's correlation over the rows without a null among
    the columns, and its two-sided p. Columns are ranked together: one row per column and item, one `cumulate` by column,
    one regrouping by item, and all cross products in one aggregate, whatever the number of columns. Items that repeat
    are rows of their own."""
    from plumbline.functions.expr import spearman_p

    whole = df.select(F.col(item).alias("__item"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=columns)
    same = whole.groupBy("__item", *columns).agg(F.count("*").alias("__n"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("__k"), F.col(c).alias("__x")) for i, c in enumerate(columns)]))
    long = stored(same.withColumn("__row", F.xxhash64("__item", *columns)).select("__item", "__row", "__n", each.alias("e")).select("__item", "__row", "__n", "e.*"))
    counts = stored(long.groupBy("__k", "__x").agg(F.sum("__n").alias("n")))
    c = cumulate(counts, ["__k"], "__x", {"n": F.col("n")}).select("__k", "__x", (F.col("cum_n") - (F.col("n") - 1) / 2).alias("__r"))
    # Ranks less the middle one keep their digits in sums of products.
    middle = same.agg(((F.sum("__n") + 1) / 2).alias("__m"))
    placed = long.join(c, ["__k", "__x"]).crossJoin(F.broadcast(middle)).withColumn("__r", F.col("__r") - F.col("__m"))
    wide = placed.groupBy("__item", "__row").agg(F.max("__n").alias("__n"), *[F.max(F.when(F.col("__k") == i, F.col("__r"))).alias(f"__{i}") for i in range(len(columns))])
    k = range(len(columns))
    sums = wide.agg(F.sum("__n").alias("n"), *[F.sum(F.col("__n") * F.col(f"__{i}") * F.col(f"__{j}")).alias(f"s{i}_{j}") for i in k for j in k if i <= j])
    pairs = F.explode(F.array(*[F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col(f"s{i}_{j}").alias("ab"), F.col(f"s{i}_{i}").alias("aa"), F.col(f"s{j}_{j}").alias("bb")) for i in k for j in k if i < j]))
    out = sums.where("n > 0").select("n", pairs.alias("p")).select("p.a", "p.b", "n", *[F.col(f"p.{c}") for c in ("ab", "aa", "bb")])
    spread = (F.col("aa") > 0) & (F.col("bb") > 0)
    rho = F.when(spread, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("ab") / F.sqrt(F.when(spread, F.col("aa") * F.col("bb"))))))
    return out.select("a", "b", "n", rho.alias("rho")).withColumn("p", spearman_p(F.col("rho"), F.col("n")))


def density(df: DataFrame, by: list[str], x: str, points: int = 100) -> DataFrame:
    """Per group `points` places from its least to its largest value, and a Gaussian kernel's density there, of Scott's width
    (deviation times n ** -0.2). Rows are counted on that grid, each at its nearest place, which merges over partitions;
    the kernel runs over the grid's counts, so no row is ordered. A group without spread is one place with a null density;
    null, NaN and infinite values are left out."""
    value = F.col(x).cast("double")
    rows = df.select(*by, value.alias("__x")).where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("__x").alias("__lo"), ((F.max("__x") - F.min("__x")) / (points - 1)).alias("__step"), (F.stddev_samp("__x") * F.pow(F.count("*"), -0.2)).alias("__h"))
    placed = rows.join(s, by) if by else rows.crossJoin(F.broadcast(s))
    at = F.when(F.col("__step") > 0, F.round((F.col("__x") - F.col("__lo")) / F.when(F.col("__step") > 0, F.col("__step")))).otherwise(0).cast("int")
    grid = ["n", "__lo", "__step", "__h"]
    counts = placed.groupBy(*by, *grid, at.alias("__at")).agg(F.count("*").alias("__in"))
    places = F.when(F.col("__step") > 0, F.sequence(F.lit(0), F.lit(points - 1))).otherwise(F.array(F.lit(0)))
    each = counts.withColumn("place", F.explode(places))
    width = F.when(F.col("__h") > 0, F.col("__h"))
    z = (F.col("place") - F.col("__at")) * F.col("__step") / width
    out = each.groupBy(*by, *grid, "place").agg(F.sum(F.col("__in") * F.exp(-z * z / 2)).alias("__k"))
    return out.select(*by, "n", "place", (F.col("__lo") + F.col("place") * F.col("__step")).alias("x"), (F.col("__k") / (2.5066282746310002 * F.col("n") * width)).alias("density"))
