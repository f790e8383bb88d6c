"""Interpretable per-row and per-entity scores as column expressions and grouped sums."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.lists import last_element
from tallyframe.functions.stats import array_mean, array_std, array_sum, dot, safe_div
from tallyframe.operators.joins import band_lookup
from tallyframe.operators.ranks import gini
from tallyframe.plans.session import GROUP_ROWS
from tallyframe.plans.skew import value_positions


def _vals(cols: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]) if cols else F.array().cast("array<double>")


def dft_magnitudes(a: Column, n: int) -> Column:
    """Magnitudes of the real Fourier components 1..n//2 of an array with n elements."""
    def mag(k: int) -> Column:
        c = F.array(*[F.lit(math.cos(2 * math.pi * k * t / n)) for t in range(n)])
        s = F.array(*[F.lit(math.sin(2 * math.pi * k * t / n)) for t in range(n)])
        return F.sqrt(F.pow(dot(a, c), 2.0) + F.pow(dot(a, s), 2.0))

    return F.array(*[mag(k) for k in range(1, n // 2 + 1)])


def economics(
    df: DataFrame, income: Sequence[str], spend: Sequence[str], stress: Sequence[str] = (), liquid: Sequence[str] = (), debt: Sequence[str] = (),
    invest: Sequence[str] = (), digital: Sequence[str] = (), cash: Sequence[str] = (), everything: Sequence[str] = (), prefix: str = "eco",
) -> DataFrame:
    """17 income and behaviour scores per row; NULL counts as 0 and a zero denominator gives 0."""
    means = df.agg(F.avg(array_sum(_vals(income))).alias("i"), F.avg(array_sum(_vals(spend))).alias("s")).first()
    out = df.select("*", _vals(income).alias("_inc"))
    out = out.select("*", array_sum(F.col("_inc")).alias("_is"), F.coalesce(array_mean(F.col("_inc")), F.lit(0.0)).alias("_im"), array_std(F.col("_inc")).alias("_isd"), array_sum(_vals(spend)).alias("_ss"))
    n, mid = len(income), len(income) // 2
    i_sum, i_mean, s_sum = F.col("_is"), F.col("_im"), F.col("_ss")

    def count(cols: Sequence[str]) -> Column:
        return F.size(F.filter(_vals(cols), lambda x: F.abs(x) > 1e-12)).cast("double")

    absum = F.aggregate("_inc", F.lit(0.0), lambda s, x: s + F.abs(x))
    scale = F.when(absum < 1e-12, 1.0).otherwise(absum)
    ent = F.aggregate("_inc", F.struct(F.lit(0.0).alias("e"), scale.alias("t")), lambda s, x: F.struct((s["e"] - F.when(F.abs(x) / s["t"] > 1e-12, F.abs(x) / s["t"] * F.ln(F.greatest(F.abs(x) / s["t"], F.lit(1e-300)))).otherwise(0.0)).alias("e"), s["t"].alias("t")), lambda s: s["e"])
    first, second = array_mean(F.slice("_inc", 1, max(mid, 1))), array_mean(F.slice("_inc", mid + 1, n - mid if n else 1))
    savings = F.greatest(i_sum - s_sum, F.lit(0.0))
    inv = count(invest)
    total = count(list(dict.fromkeys([*income, *spend, *invest])))
    z = F.lit(0.0)
    feats = {
        "salary_stability_index": safe_div(F.col("_isd"), i_mean),
        "income_trend_slope": (F.get("_inc", F.lit(n - 1)) - F.get("_inc", F.lit(0))) / n if n >= 2 else z,
        "income_seasonality": F.array_max(dft_magnitudes(F.col("_inc"), n)) if n >= 4 else z,
        "income_diversification": ent if n >= 2 else z,
        "disposable_income_ratio": safe_div(i_sum - 0.5 * s_sum, i_sum),
        "savings_rate": safe_div(savings, i_sum),
        "income_volatility": safe_div(F.col("_isd"), F.abs(i_mean)),
        "income_growth_rate": safe_div(second - first, F.abs(first)) if n >= 2 else z,
        "spending_elasticity": safe_div(s_sum - (means["s"] or 0.0), i_sum - (means["i"] or 0.0)),
        "budget_adherence": s_sum / max(means["s"] or 0.0, 1e-12),
        "financial_stress_index": safe_div(array_sum(_vals(stress)), i_sum),
        "liquidity_ratio": safe_div(array_sum(_vals(liquid)), s_sum),
        "debt_service_ratio": safe_div(array_sum(_vals(debt)), i_sum),
        "investment_propensity": safe_div(inv, total),
        "digital_payment_ratio": safe_div(count(digital), count(everything)),
        "cash_preference_index": safe_div(array_sum(_vals(cash)), s_sum),
        "financial_planning_score": F.when(savings > 1e-12, 0.5).otherwise(0.0) + F.when(inv > 0, 0.5).otherwise(0.0),
    }
    return out.select(*df.columns, *[e.alias(f"{prefix}_{c}") for c, e in feats.items()])


def cyclical(df: DataFrame, ts: str, periods: Sequence[str] = ("hour", "dayofweek", "month", "quarter"), prefix: str = "cyc") -> DataFrame:
    """sin and cos of hour/24, day of week/7 (0 = Monday), (month-1)/12 and (quarter-1)/4."""
    raw = {"hour": (F.hour(ts), 24), "dayofweek": (F.weekday(ts), 7), "month": (F.month(ts) - 1, 12), "quarter": (F.quarter(ts) - 1, 4)}
    new = {}
    for p in periods:
        angle = raw[p][0] * (2 * math.pi / raw[p][1])
        new[f"{prefix}_{p}_sin"], new[f"{prefix}_{p}_cos"] = F.sin(angle), F.cos(angle)
    return df.select("*", *[e.alias(c) for c, e in new.items()])


def merchant_hierarchy(txn: DataFrame, user: str, code: str, amount: str, day: str, l1: Column, l2: Column, parents: Sequence[int], n_l1: int, half_life: float = 180.0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per entity: weighted midpoints of the code hierarchy on a disk, spreads, loyalty, recency and Gini.

    Recency is 1 - (day of the last event / newest day), of the days as given: offsets that count up to
    the newest event make it 0, offsets that count days back make it 1.

    `l1` and `l2` map a row to its class index (negative = unknown), `parents[l2]` is the l1 class.
    Classes of a level sit at equal radius, so the weighted midpoint is a ratio of grouped sums.
    """
    radius1, radius2 = 0.8, 0.5

    def table(values: Sequence[float], i: Column) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for v in values]), i.cast("int"))

    angle = [2 * math.pi * i / max(n_l1, 1) for i in range(n_l1)]
    # The weight spend * exp(-(own newest day - day) / half_life) enters ratios only, so the own newest
    # day cancels and the table's newest day can stand in for it: no join back to the events.
    newest = txn.agg(F.max(F.col(day).cast("double"))).first()[0] or 0.0
    base = txn.select(F.col(user).alias("u"), F.col(code).alias("c"), F.greatest(F.col(amount).cast("double"), F.lit(0.0)).alias("spend"), F.col(day).cast("double").alias("d"), l1.cast("int").alias("a"), l2.cast("int").alias("b"))
    q = max(n_l1 // 4, 1)
    in1, in2 = F.col("a") >= 0, F.col("b") >= 0
    x1, y1 = table([radius1 * math.cos(t) for t in angle], F.col("a")), table([radius1 * math.sin(t) for t in angle], F.col("a"))
    x2, y2 = table([radius2 * math.cos(angle[p]) for p in parents], F.col("b")), table([radius2 * math.sin(angle[p]) for p in parents], F.col("b"))
    base = base.select("*", (F.col("spend") * F.exp((F.col("d") - newest) / half_life)).alias("w"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.least(F.floor(F.col("a") / q), F.lit(3)).alias("qq"))

    def sums(w: Column, tag: str) -> list[Column]:
        def s(v: Column, cond: Column, name: str) -> Column:
            return F.sum(F.when(cond, v).otherwise(0.0)).alias(f"{tag}_{name}")

        out = [F.sum(w).alias(f"{tag}_wt"), s(w, in1, "w1"), s(w * F.col("x1"), in1, "sx1"), s(w * F.col("y1"), in1, "sy1"), s(w, in2, "w2"), s(w * F.col("x2"), in2, "sx2"), s(w * F.col("y2"), in2, "sy2")]
        for i in range(4):
            here = in1 & (F.col("qq") == i)
            out += [s(w, here, f"q{i}"), s(w * F.col("x1"), here, f"qx{i}"), s(w * F.col("y1"), here, f"qy{i}")]
        return out

    g = base.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c").alias("nc"), F.max("d").alias("top"), *sums(F.col("w"), "s"), *sums(F.lit(1.0), "e"))
    # an entity without any weight counts every event alike
    none = F.col("s_wt") * F.exp((newest - F.col("top")) / half_life) < 1e-10
    names = ["wt", "w1", "sx1", "sy1", "w2", "sx2", "sy2", *[f"{p}{i}" for i in range(4) for p in ("q", "qx", "qy")]]
    g = g.select("u", "n", "nc", "top", *[F.when(none, F.col(f"e_{c}")).otherwise(F.col(f"s_{c}")).alias(c) for c in names])
    g = g.join(gini(base.select("u", "spend"), ["u"], "spend", "gini", group_rows), "u")
    g = g.withColumns({"l1_x": safe_div(F.col("sx1"), F.col("w1")), "l1_y": safe_div(F.col("sy1"), F.col("w1")), "l2_x": safe_div(F.col("sx2"), F.col("w2")), "l2_y": safe_div(F.col("sy2"), F.col("w2"))})
    r1, r2 = F.hypot("l1_x", "l1_y"), F.hypot("l2_x", "l2_y")
    cohere = (F.col("l1_x") * F.col("l2_x") + F.col("l1_y") * F.col("l2_y")) / ((r1 + 1e-8) * (r2 + 1e-8))
    spread = [safe_div(F.hypot(safe_div(F.col(f"qx{i}"), F.col(f"q{i}")), safe_div(F.col(f"qy{i}"), F.col(f"q{i}"))) * F.col(f"q{i}"), F.col("wt")).alias(f"spread_{i + 1}") for i in range(4)]
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return g.select(
        F.col("u").alias(user), "l1_x", "l1_y", r1.alias("l1_radius"), (F.atan2("l1_y", "l1_x") / math.pi).alias("l1_angle"), "l2_x", "l2_y", r2.alias("l2_radius"), (F.atan2("l2_y", "l2_x") / math.pi).alias("l2_angle"),
        clip(F.log1p(F.col("nc").cast("double")) / math.log1p(500)).alias("code_breadth"),
        F.when(F.col("n") > 1, clip((F.col("n") - F.col("nc")) / F.when(F.col("n") > 1, F.col("n") - 1))).otherwise(0.0).alias("revisit_rate"),
        F.when(F.col("top") > 0, clip(1.0 - F.col("top") / (F.col("top") + 1e-8))).otherwise(0.0).alias("recency"),
        clip(F.col("gini")).alias("spend_gini"), clip((cohere + 1) / 2).alias("coherence"), *spread,
    )


def bandit_scores(df: DataFrame, cols: Sequence[str], prefix: str = "bandit") -> DataFrame:
    """exploration = non-zero share, exploitation = largest share, ucb = mean + std, regret = largest size - mean."""
    v = _vals(cols)
    sizes = F.transform(v, lambda x: F.abs(x))
    top, total = F.array_max(sizes), array_sum(sizes)
    mean = array_sum(v) / len(cols)
    return df.select(
        "*",
        (F.size(F.filter(v, lambda x: x != 0)) / len(cols)).alias(f"{prefix}_exploration"),
        F.when(total > 1e-10, top / F.when(total > 1e-10, total)).otherwise(0.0).alias(f"{prefix}_exploitation"),
        (mean + array_std(v)).alias(f"{prefix}_ucb"),
        (top - mean).alias(f"{prefix}_regret"),
    )


def grouped_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float], group_rows: int = GROUP_ROWS) -> DataFrame:
    """Exact interpolated quantiles per key as an array `q`, with the count `n`, from the value table."""
    v = value_positions(df.where(F.col(col).isNotNull()), keys, col, {"_k": F.lit(1).cast("long")}, group_rows)
    n = v.groupBy(*[F.col(k).alias(f"_g_{k}") for k in keys]).agg(F.sum("_k").alias("n"))
    cond = reduce(lambda a, b: a & b, [v[k].eqNullSafe(n[f"_g_{k}"]) for k in keys])
    j = v.join(n, cond).drop(*[f"_g_{k}" for k in keys])

    def at(p: float) -> Column:
        s = (F.col("n") - 1) * F.lit(float(p))
        lo = F.min(F.when(F.col("cum__k") > F.floor(s), F.col(col)))
        hi = F.min(F.when(F.col("cum__k") > F.ceil(s), F.col(col)))
        frac = F.max(s - F.floor(s))
        return lo + frac * (hi - lo)

    return j.groupBy(*keys).agg(F.max("n").alias("n"), F.array(*[at(p) for p in probs]).alias("q"))


def phase_transition(df: DataFrame, keys: Sequence[str], window: str, value: str, window_size: int, threshold: float, grid: int = 11, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Change between consecutive windows of an entity: magnitude, direction, probability, frequency, confidence.

    The distance is the mean absolute difference of the windows' quantile functions (1-D Wasserstein),
    the direction the sign of the change in value range; the probability is measured against the mean
    distance over the whole table.
    """
    q = grouped_quantiles(df, [*keys, window], value, [i / (grid - 1) for i in range(grid)], group_rows)
    w = Window.partitionBy(*keys).orderBy(window)  # one row per window of an entity
    q = q.withColumn("_p", F.lag("q").over(w))
    diff = F.aggregate(F.zip_with("q", "_p", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / grid
    rng = lambda c: last_element(c) - F.get(c, F.lit(0))
    q = q.withColumns({"magnitude": F.when(F.col("_p").isNotNull(), diff), "_turn": F.when(F.col("_p").isNotNull(), rng("q") - rng("_p"))})
    base = q.agg(F.greatest(F.coalesce(F.avg("magnitude"), F.lit(1.0)), F.lit(1e-8))).scalar()
    q = q.withColumn("_base", base)
    seen = F.sum(F.col("magnitude").isNotNull().cast("int")).over(w)
    big = F.sum((F.col("magnitude") > threshold).cast("int")).over(w)
    return q.withColumns({"_seen": seen, "_big": big}).where(F.col("magnitude").isNotNull()).select(
        *keys, window, "n", "magnitude",
        F.signum("_turn").alias("direction"),
        (1.0 / (1.0 + F.exp(-(F.col("magnitude") / F.col("_base")) + 2.0))).alias("probability"),
        (F.col("_big") / F.col("_seen")).alias("frequency"),
        (1.0 - F.exp(-F.least(F.col("n"), F.lit(window_size)) / float(max(window_size, 1)))).alias("confidence"),
    )


def saturation_fit(df: DataFrame, substrate: str, velocity: str) -> tuple[float, float]:
    """(vmax, km) from the linear form s/v = s/vmax + km/vmax; positive rows only."""
    ok = df.where((F.col(substrate) > 0) & (F.col(velocity) > 0))
    y = F.col(substrate) / F.col(velocity)
    r = ok.select(F.col(substrate).alias("s"), y.alias("y")).agg(F.regr_slope("y", "s").alias("a"), F.regr_intercept("y", "s").alias("b")).first()
    if not r["a"] or r["a"] <= 0:
        m = df.agg(F.avg(substrate).alias("m"), F.stddev_pop(substrate).alias("s")).first()
        return m["m"] + 2 * m["s"], max(m["m"], 0.1)
    return 1.0 / r["a"], max(r["b"] / r["a"], 1e-6)


def saturation(df: DataFrame, cols: Sequence[str], vmax: float, km: float, prefix: str = "kin") -> DataFrame:
    """Michaelis-Menten position of the mean absolute value of the columns."""
    s = array_mean(F.transform(_vals(cols), lambda x: F.abs(x)))
    return df.select(
        "*",
        (vmax * s / (km + s + 1e-10)).alias(f"{prefix}_adoption_velocity"),
        (s / (km + s + 1e-10)).alias(f"{prefix}_saturation_ratio"),
        F.least(F.greatest(km / (s + 1e-10), F.lit(0.0)), F.lit(10.0)).alias(f"{prefix}_half_saturation_time"),
    )


def interference(df: DataFrame, cols: Sequence[str], freqs: Sequence[float], phases: Sequence[float], prefix: str = "wave") -> DataFrame:
    """Superposition amplitude and phase, constructive and destructive score, dominant frequency, spectral entropy."""
    n = len(cols)
    ch = min(n, len(freqs))
    out = df.select("*", _vals(cols).alias("_v"))
    v = [F.get("_v", F.lit(i)) for i in range(ch)]
    re = reduce(lambda a, b: a + b, [F.abs(x) * F.cos(f * x + p) for x, f, p in zip(v, freqs, phases)])
    im = reduce(lambda a, b: a + b, [F.abs(x) * F.sin(f * x + p) for x, f, p in zip(v, freqs, phases)])
    size = reduce(lambda a, b: a + b, [F.abs(x) for x in v])
    out = out.select("*", re.alias("_re"), im.alias("_im"), size.alias("_a"), (dft_magnitudes(F.col("_v"), n) if n >= 4 else F.array(F.lit(0.0))).alias("_m"))
    out = out.select("*", F.hypot("_re", "_im").alias(f"{prefix}_amplitude"), F.aggregate("_m", F.lit(0.0), lambda s, x: s + x * x).alias("_t"))
    amp = F.col(f"{prefix}_amplitude")
    con = F.when(F.col("_a") > 0, amp / F.when(F.col("_a") > 0, F.col("_a"))).otherwise(0.0)
    power = F.aggregate("_m", F.struct(F.lit(0.0).alias("e"), F.col("_t").alias("t")), lambda s, x: F.struct((s["e"] - x * x / s["t"] * F.ln(x * x / s["t"] + 1e-12)).alias("e"), s["t"].alias("t")), lambda s: s["e"])
    top = F.array_position("_m", F.array_max("_m"))
    return out.select(
        *df.columns, amp, F.atan2("_im", "_re").alias(f"{prefix}_phase"), con.alias(f"{prefix}_constructive"), F.when(F.col("_a") > 0, 1.0 - con).otherwise(0.0).alias(f"{prefix}_destructive"),
        (top / float(n) if n >= 4 else F.lit(0.0)).alias(f"{prefix}_dominant_frequency"), F.when(F.col("_t") > 0, power).otherwise(0.0).alias(f"{prefix}_spectral_entropy"),
    )


def repeat_event_scores(df: DataFrame, cols: Sequence[str], global_std: float, bandwidth: float, decay: float = 0.85, boost: float = 1.5, prefix: str = "rep") -> DataFrame:
    """flag, boost, clustering of steps, decay by count, kernel peak density and spread on a 50-point grid."""
    n = len(cols)
    h = max(bandwidth, 0.01)
    out = df.select("*", _vals(cols).alias("_v"))
    out = out.select("*", F.zip_with(F.slice("_v", 2, n - 1), F.slice("_v", 1, n - 1), lambda b, a: F.abs(b - a)).alias("_d"), F.array_min("_v").alias("_lo"), F.array_max("_v").alias("_hi"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / 49.0)
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    dens = F.transform(steps, lambda g: F.struct(g.alias("g"), (F.aggregate("_v", F.lit(0.0), lambda s, x: s + F.exp(-0.5 * F.pow((g - x) / h, F.lit(2.0)))) * norm).alias("p")))
    out = out.select("*", dens.alias("_k"))
    out = out.select("*", F.array_max(F.transform("_k", lambda k: k["p"])).alias("_peak"))
    above = F.filter("_k", lambda k: k["p"] > 0.5 * F.col("_peak"))
    jumps = F.transform("_d", lambda x: x + 1e-10)
    return out.select(
        *df.columns,
        (array_mean(F.transform("_v", lambda x: F.abs(x))) / (global_std + 1e-10)).alias(f"{prefix}_flag"),
        (array_mean(F.col("_d")) * boost).alias(f"{prefix}_boost"),
        (safe_div(array_std(jumps), array_mean(jumps)) if n > 2 else F.lit(0.0)).alias(f"{prefix}_clustering"),
        F.lit(decay**n).alias(f"{prefix}_decay"),
        F.col("_peak").alias(f"{prefix}_peak_density"),
        F.when(F.size(above) >= 2, F.get(above, F.size(above) - 1)["g"] - F.get(above, F.lit(0))["g"]).otherwise(0.0).alias(f"{prefix}_spread"),
    )


def interpret_domains(df: DataFrame, domains: dict[str, Sequence[str]], bands: dict[str, Sequence[tuple[float, float, str]]]) -> DataFrame:
    """Per domain the mean of its columns, confidence 1 - std, and the band label of the mean."""
    new = []
    for name, cols in domains.items():
        v = _vals(cols)
        score = array_mean(v)
        new += [F.round(score, 4).alias(f"{name}_score"), F.round(F.least(F.greatest(1.0 - array_std(v), F.lit(0.0)), F.lit(1.0)), 4).alias(f"{name}_confidence"), band_lookup(score, bands[name]).alias(f"{name}_label")]
    return df.select("*", *new)


def extract_facts(df: DataFrame, rules: Sequence[tuple[str, str, Sequence[str]]], name: str = "facts") -> DataFrame:
    """List of the names of all rules whose SQL condition holds; rules with missing columns are skipped."""
    hits = [F.when(F.expr(cond), label) for label, cond, needs in rules if all(c in df.columns for c in needs)]
    return df.withColumn(name, F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<string>"))


def classify_richness(df: DataFrame, products_min: int = 2, consultations_min: int = 1, idle_max: int = 180) -> DataFrame:
    """rich / moderate / sparse context and the queue priority 0 / 1 / 2."""
    def num(c: str, default: int) -> Column:
        return F.coalesce(F.col(c), F.lit(default)) if c in df.columns else F.lit(default)

    rich = (num("total_products", 0) >= products_min) & (num("recent_consultation_count", 0) >= consultations_min)
    level = F.when(rich, "rich").when(num("last_transaction_days", 999) <= idle_max, "moderate").otherwise("sparse")
    return df.withColumn("richness", level).withColumn("priority", F.when(F.col("richness") == "rich", 0).when(F.col("richness") == "moderate", 1).otherwise(2))


def sir_scores(df: DataFrame, col: str, mean: float, std: float, beta: float = 0.3, gamma: float = 0.1, prefix: str = "sir") -> DataFrame:
    """Adoption stage by logistic curves of the z-score, with reproduction number, peak time and duration."""
    z = (F.col(col) - mean) / (std if std > 1e-10 else 1.0)
    inf, rec = 1.0 / (1.0 + F.exp(-z)), 1.0 / (1.0 + F.exp(-(z - 1.0)))
    r0 = beta / (gamma + 1e-10)
    return df.select(
        "*", F.least(F.greatest(1.0 - inf - rec, F.lit(0.0)), F.lit(1.0)).alias(f"{prefix}_susceptible"), inf.alias(f"{prefix}_infected"), rec.alias(f"{prefix}_recovered"),
        F.lit(r0).alias(f"{prefix}_r0"), F.lit(math.log(r0 + 1) / (beta + 1e-10)).alias(f"{prefix}_peak_time"), F.lit(1.0 / (gamma + 1e-10)).alias(f"{prefix}_duration"),
    )


def group_ranges(columns: Sequence[str], groups: dict[str, Sequence[str]], logs: Sequence[str] = ()) -> dict[str, tuple[int, int]]:
    """Longest contiguous (start, end) of each group's columns; a `_log` copy belongs to its base's group."""
    at = {c: i for i, c in enumerate(columns)}
    out = {}
    for name, cols in groups.items():
        have = sorted(at[c] for c in [*cols, *[f"{c}_log" for c in cols if f"{c}_log" in logs]] if c in at)
        best, start = None, None
        for prev, i in zip([None, *have], have):
            start = i if prev is None or i != prev + 1 else start
            if best is None or i + 1 - start > best[1] - best[0]:
                best = (start, i + 1)
        if best:
            out[name] = best
    return out


def order_by_group(columns: Sequence[str], groups: dict[str, Sequence[str]]) -> list[str]:
    """Columns of the groups first, each group contiguous, the rest in their old order."""
    placed = list(dict.fromkeys(c for cols in groups.values() for c in cols if c in columns))
    return placed + [c for c in columns if c not in placed]


