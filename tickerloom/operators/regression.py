"""Least squares on three features for every group at once, from grouped moments.

The normal equations are solved in column expressions, so any number of models
is one aggregation (or one growing window) and no Python runs.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import FLAT

#: Correlation matrices and minors with a smaller determinant are treated as rank deficient.
SINGULAR = 1e-9


def moments(features, target, over=None):
    """Named aggregates the solver needs; with ``over`` they become running window values."""
    def agg(c):
        return c.over(over) if over is not None else c

    names = [*features, target]
    out = {f"m_{c}": agg(F.avg(c)) for c in names}
    out.update({f"s_{c}": agg(F.stddev_pop(c)) for c in names})
    for i, a in enumerate(features):
        for b in names[i + 1:]:
            out[f"c_{a}__{b}"] = agg(F.covar_pop(a, b))
    out["n_train"] = agg(F.count(target))
    return [expr.alias(name) for name, expr in out.items()]


def with_coefficients(df, features, target):
    """Add ``b_<feature>``, ``intercept`` and ``status`` to rows holding :func:`moments`.

    Features are standardised first (a date packed as yyyymmdd is near 2e7). A
    feature that does not vary gets coefficient 0. Collinear features get the solution of least
    norm in their own units, as a solver by singular values gives. Too few rows give NULL
    coefficients and say so in ``status``.
    """
    f1, f2, f3 = features

    def varies(c):
        return F.col(f"s_{c}") > FLAT * F.abs(F.col(f"m_{c}"))

    def r(a, b):
        value = F.try_divide(F.col(f"c_{a}__{b}"), F.col(f"s_{a}") * F.col(f"s_{b}"))
        return F.when(varies(a) & varies(b), value).otherwise(F.lit(0.0))

    # each step is bound to a lambda variable, so no later step repeats its expressions
    standard = F.array(F.struct(
        r(f1, f2).alias("a"), r(f1, f3).alias("b"), r(f2, f3).alias("c"),
        r(f1, target).alias("y1"), r(f2, target).alias("y2"), r(f3, target).alias("y3"),
    ))

    def solve(s):
        a, b, c, y1, y2, y3 = (s[k] for k in ("a", "b", "c", "y1", "y2", "y3"))
        # cofactors: of full rank they give the solution; of rank two a column of them is the null direction
        k11, k22, k33 = 1 - c * c, 1 - b * b, 1 - a * a
        k12, k13, k23 = b * c - a, a * c - b, a * b - c
        most = F.greatest(k11, k22, k33)
        zero = F.lit(0.0)
        case = (
            F.when(1 + 2 * a * b * c - a * a - b * b - c * c > SINGULAR, 3).when(most <= SINGULAR, 4)
            .when(k11 == most, 0).when(k22 == most, 1).otherwise(2))

        def triple(*columns):
            return F.array(*columns)

        solved = (
            F.when(case == 3, F.transform(
                triple(y1 * k11 + y2 * k12 + y3 * k13, y1 * k12 + y2 * k22 + y3 * k23, y1 * k13 + y2 * k23 + y3 * k33),
                lambda z: z / (1 + 2 * a * b * c - a * a - b * b - c * c)))
            # one feature left out, the other two solved
            .when(case == 0, triple(zero, (y2 - c * y3) / k11, (y3 - c * y2) / k11))
            .when(case == 1, triple((y1 - b * y3) / k22, zero, (y3 - b * y1) / k22))
            .when(case == 2, triple((y1 - a * y2) / k33, (y2 - a * y1) / k33, zero))
            # all alike up to sign
            .otherwise(F.transform(triple(F.lit(1.0), F.signum(a), F.signum(b)), lambda e: e * (y1 + F.signum(a) * y2 + F.signum(b) * y3) / 3)))
        null = (
            F.when(case == 0, triple(k11, k12, k13)).when(case == 1, triple(k12, k22, k23)).when(case == 2, triple(k13, k23, k33)))
        return F.struct(case.alias("case"), solved.alias("z"), null.alias("u"))

    spread = F.array(*[F.when(varies(f), F.col(f"s_{f}")) for f in (f1, f2, f3)])

    def dot(x, y):
        return sum(F.get(x, F.lit(i)) * F.get(y, F.lit(i)) for i in range(3))

    def unscale(s):
        def raw(values):
            return F.zip_with(values, spread, lambda v, w: F.coalesce(F.try_divide(v, w), F.lit(0.0)))

        return F.struct(s["case"].alias("case"), raw(s["z"]).alias("b"), raw(s["u"]).alias("n"))

    def shortest(s):
        """Of all solutions the one without a part along the null direction."""
        along = F.try_divide(dot(s["b"], s["n"]), dot(s["n"], s["n"]))
        flat = dot(spread, spread)
        least = (
            F.when(s["case"] == 3, s["b"])
            .when(s["case"] == 4, F.zip_with(s["b"], spread, lambda b, w: b * w * w / flat))
            .otherwise(F.zip_with(s["b"], s["n"], lambda b, n: b - along * n)))
        return F.transform(least, lambda b: b * F.col(f"s_{target}"))

    def named(b):
        return F.struct(*[F.get(b, F.lit(i)).alias(f"b{i + 1}") for i in range(3)])

    steps = standard
    for step in (solve, unscale, shortest, named):
        steps = F.transform(steps, step)
    df = df.withColumn("_b", F.get(steps, F.lit(0)))
    status = (
        F.when(F.coalesce("n_train", F.lit(0)) < len(features) + 1, "too_few_rows").otherwise("ok")
    )
    df = df.withColumn("status", status)
    usable = F.col("status") == "ok"
    intercept = F.col(f"m_{target}")
    for f, b in zip(features, ("b1", "b2", "b3")):
        df = df.withColumn(f"b_{f}", F.when(usable, F.col("_b").getField(b)))
        intercept = intercept - F.col("_b").getField(b) * F.col(f"m_{f}")
    return df.withColumn("intercept", F.when(usable, intercept)).drop("_b")


def predicted(features):
    """Prediction column for a row holding the features and the coefficients."""
    out = F.col("intercept")
    for f in features:
        out = out + F.col(f"b_{f}") * F.col(f)
    return out


def fitted(rows, groups, features, target, use, asked=None):
    """The asked rows (all without a condition) with their group's coefficients, trained on the rows where ``use`` holds.

    One aggregation per group takes the moments and gathers the asked rows, so a model is solved once. Groups
    are bounded, as every row of one is a week.
    """
    marked = rows.withColumns({f"t_{c}": F.when(use, F.col(c).cast("double")) for c in [*features, target]})
    names, goal = [f"t_{c}" for c in features], f"t_{target}"
    kept = [c for c in rows.columns if c not in groups]
    row = F.struct(*[F.col(c) for c in kept])
    gathered = F.collect_list(row if asked is None else F.when(asked, row)).alias("_asked")
    solved = with_coefficients(marked.groupBy(*groups).agg(*moments(names, goal), gathered), names, goal)
    every = solved.select(*[c for c in solved.columns if c != "_asked"], F.inline("_asked"))
    return _renamed(every, rows, features)


def fitted_so_far(rows, groups, order, features, target, use):
    """As :func:`fitted`, but each row's model is trained on the earlier rows only."""
    before = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumns({f"t_{c}": F.when(use, F.col(c).cast("double")) for c in [*features, target]})
    names, goal = [f"t_{c}" for c in features], f"t_{target}"
    return _renamed(with_coefficients(marked.select("*", *moments(names, goal, before)), names, goal), rows, features)


def _renamed(solved, rows, features):
    return solved.select(
        *rows.columns, F.coalesce("n_train", F.lit(0)).alias("n_train"), "status", "intercept",
        *[F.col(f"b_t_{f}").alias(f"b_{f}") for f in features],
    )
