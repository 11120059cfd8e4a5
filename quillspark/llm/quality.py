"""Quality rules: text statistics, and robust multivariate outliers among them. DataFrame functions only.

Base rules reject texts that are short or repeat themselves. Of the rest, each text's transformed statistics (mean word
length, symbols per word, share of repeated lines, share of repeated words) are held against the minimum-covariance-determinant
(MCD) estimate of its language and source: mean and covariance of the 75 % of rows whose covariance has the least determinant. A
text is rejected when its squared Mahalanobis distance exceeds CUTOFF.

The subset is searched for by concentration steps from three deterministic starts (medians with a fixed spread, medians with median
deviations, mean and covariance of all rows), each until its determinant falls by less than a thousandth; of the three, the least determinant counts. A
spread TOLERANCE is added to every covariance, also in the determinant, as in regularised MCD, so small or constant groups have one too.

Groups are of any size. An estimate of n rows counts n : PRIOR against the one above it, a group's against its language's, a
language's against that of all rows. With its share a, the spread between the two means adds a^2 (1 - a) of its square: a group of many
rows that lies apart is excused, a single row can't excuse itself.

Every step is one pass over a narrow table: rows are counted and their moments summed per group and distance bin, so that the
closest 75 % and their moments come from the same small result; rows of the bin at the limit count by the fraction that is missing.
Statistics are fixed-point integers, so sums are exact and the verdicts don't depend on how rows are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.workspace import discard, materialize

_SPACE, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
FEATURES = ("x_length", "x_symbols", "x_lines", "x_repeats")
_DIM = len(FEATURES)
_PAIRS = [(i, j) for i in range(_DIM) for j in range(i + 1)]
#: Thousandths; a floor on the spread of each statistic, squared and added to its variance, so that a group in which a
#: statistic hardly varies (no symbols at all, say) doesn't reject a text for its first one. Those of lines and words are a little over
#: the spread in groups of clean texts (medians on sf0.1: 503 and 426), so that 24 % of either are enough to reject alone.
TOLERANCE = (50, 500, 600, 600)
#: 0.99999 quantile of chi-square with 4 degrees of freedom.
CUTOFF = 28.47
SHARE = 0.75
#: Makes the covariance of the closest 75 % consistent for normal data of 4 dimensions.
CONSISTENCY = 1.485
#: Concentration steps at most, and the share of a determinant that a step must take off to be followed by another.
STEPS, SETTLED = 12, 1e-3
#: Rows by which an estimate is drawn to the one above it.
PRIOR = 40
#: Estimates (about 200 bytes a group) are broadcast up to so many groups, and joined by a shuffle beyond.
BROADCAST_GROUPS = 100_000
_STARTS = 3


def base_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """A row per row of docs: key, extra columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    Windows of three words are told apart by a 64-bit hash within their text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit(_WORD)))
    first = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        *[F.col(c) for c in extra],
        F.array_remove(F.split(t, _SPACE, -1), "").alias("words"),
        lines.alias("lines"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("words")
    window = lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i"))
    second = first.select(
        "doc_id",
        *extra,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.sort_array(F.transform(F.slice("words", F.lit(1), F.greatest(n - 2, F.lit(0))), window)).alias("sorted"),
    )
    same = lambda x, i: (F.get("sorted", i - 1)["h"] == x["h"]) | (F.get("sorted", i + 1)["h"] == x["h"])
    third = second.withColumn("at", F.sort_array(F.transform(F.filter("sorted", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))).drop("sorted")
    # sorted starts of repeated windows: each covers three words less what it shares with the next
    covered = F.aggregate(F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return third.select("doc_id", *extra, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _fixed(x: Column) -> Column:
    return F.round(1000 * x).cast("long")


def _features(stats: DataFrame) -> DataFrame:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    share = lambda a, b: F.log(1 + 100 * F.col(a) / b)
    values = (F.log(1 + F.col("word_chars") / words), share("n_symbols", words), share("n_dup_lines", lines), share("n_repeat_words", words))
    return stats.withColumns({c: _fixed(v) for c, v in zip(FEATURES, values)})


def _with_bound(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_GROUPS else df


def _written(df: DataFrame, groups: int, label: str) -> DataFrame:
    return materialize(df.coalesce(4) if groups <= BROADCAST_GROUPS else df, label)


def _sums() -> list[Column]:
    return [F.count("*").alias("n")] + [F.sum(c).alias(f"t{i}") for i, c in enumerate(FEATURES)] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}{j}") for i, j in _PAIRS]


def _from_moments(n: Column, t: list[Column], q: dict[tuple[int, int], Column], scale: float) -> dict[str, Column]:
    """Means and regularised covariances from sums."""
    out = {f"mu{i}": t[i] / n for i in range(_DIM)}
    for i, j in _PAIRS:
        out[f"s{i}{j}"] = scale * (q[i, j] / n - t[i] / n * t[j] / n) + (TOLERANCE[i] ** 2 if i == j else 0)
    return out


_ESTIMATE = [f"mu{i}" for i in range(_DIM)] + [f"s{i}{j}" for i, j in _PAIRS]


def _with_factor(e: DataFrame) -> DataFrame:
    """Adds l{i}{j}, the Cholesky factor of s{i}{j}."""
    for i, j in sorted(_PAIRS, key=lambda p: (p[0], p[1])):
        rest = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        e = e.withColumn(f"l{i}{j}", F.sqrt(F.col(f"s{i}{i}") - rest) if i == j else (F.col(f"s{i}{j}") - rest) / F.col(f"l{j}{j}"))
    return e


def _with_determinant(e: DataFrame) -> DataFrame:
    columns = e.columns
    product = F.lit(1.0)
    for i in range(_DIM):
        product = product * F.col(f"l{i}{i}") * F.col(f"l{i}{i}")
    return _with_factor(e).select(*columns, product.alias("det"))


def _whitener(e: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mu{i} and m{i}{j}, the inverse of the Cholesky factor of s{i}{j}, so that distances are sums of squares."""
    e = _with_factor(e)
    for j in range(_DIM):
        for i in range(j, _DIM):
            rest = sum((F.col(f"l{i}{k}") * F.col(f"m{k}{j}") for k in range(j, i)), F.lit(0.0))
            e = e.withColumn(f"m{i}{j}", (F.lit(1.0 if i == j else 0.0) - rest) / F.col(f"l{i}{i}"))
    return e.select(*keys, *[f"mu{i}" for i in range(_DIM)], *[f"m{i}{j}" for i, j in _PAIRS])


def _distance() -> Column:
    total = F.lit(0.0)
    for i in range(_DIM):
        y = sum((F.col(f"m{i}{j}") * (F.col(FEATURES[j]) - F.col(f"mu{j}")) for j in range(i + 1)), F.lit(0.0))
        total = total + y * y
    return total


def _members(rows: DataFrame) -> DataFrame:
    """Rows (grps, features) once for each of their groups."""
    return rows.select(F.explode("grps").alias("grp"), *FEATURES)


def _starts(rows: DataFrame) -> DataFrame:
    """(grp, start, det, mu, s): three starts of each group. Their determinants are infinite, as no subset has them."""
    rows = _members(rows)
    middle = [F.median(c).alias(f"md{i}") for i, c in enumerate(FEATURES)]
    whole = rows.groupBy("grp").agg(*_sums(), *middle)
    off = rows.join(whole.select("grp", *[f"md{i}" for i in range(_DIM)]), "grp")
    spread = off.groupBy("grp").agg(*[F.median(F.abs(F.col(c) - F.col(f"md{i}"))).alias(f"sp{i}") for i, c in enumerate(FEATURES)])
    both = whole.join(spread, "grp")
    median = {f"mu{i}": F.col(f"md{i}") for i in range(_DIM)}
    diagonal = lambda extra: {f"s{i}{j}": (TOLERANCE[i] ** 2 + extra(i) if i == j else F.lit(0.0)) for i, j in _PAIRS}
    kinds = [
        median | diagonal(lambda i: F.lit(0.0)),
        median | diagonal(lambda i: F.pow(1.4826 * F.col(f"sp{i}"), 2)),
        _from_moments(F.col("n"), [F.col(f"t{i}") for i in range(_DIM)], {p: F.col(f"q{p[0]}{p[1]}") for p in _PAIRS}, 1.0),
    ]
    one = lambda k, e: F.struct(F.lit(k).alias("start"), *[e[c].cast("double").alias(c) for c in _ESTIMATE])
    return both.select("grp", F.explode(F.array(*[one(k, e) for k, e in enumerate(kinds)])).alias("e")).select("grp", "e.*", F.lit(float("inf")).alias("det"))


def _concentrate(rows: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    """One step: mean, covariance and determinant of the closest SHARE of each group under each estimate that it has."""
    placed = _members(rows).join(_with_bound(_whitener(estimates, ["grp", "start"]), groups), "grp").withColumn("bin", F.floor(16 * F.log2(1 + _distance())).cast("int"))
    bins = placed.groupBy("grp", "start", "bin").agg(*_sums())
    w = Window.partitionBy("grp", "start")
    run = bins.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "h": SHARE * F.sum("n").over(w)})
    inside, part = F.col("upto") <= F.col("h"), (F.col("h") - F.col("upto") + F.col("n")) / F.col("n")
    at_limit = ~inside & (part > 0)
    names = [f"t{i}" for i in range(_DIM)] + [f"q{i}{j}" for i, j in _PAIRS]
    total = lambda c: F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)) + F.coalesce(F.max(F.when(at_limit, part * F.col(c))), F.lit(0.0))
    close = run.groupBy("grp", "start").agg(F.max("h").alias("h"), *[total(c).alias(c) for c in names])
    found = _from_moments(F.col("h"), [F.col(f"t{i}") for i in range(_DIM)], {p: F.col(f"q{p[0]}{p[1]}") for p in _PAIRS}, CONSISTENCY)
    return _with_determinant(close.select("grp", "start", *[found[c].alias(c) for c in _ESTIMATE]))


def least_determinants(rows: DataFrame, groups: int, steps: int = STEPS) -> DataFrame:
    """(grp, mu, s, det) of every group of rows (grps: array of groups, features): what the start with the least determinant settled on."""
    key = ["grp", "start"]
    now = _written(_starts(rows).withColumn("falls", F.lit(True)), groups, "quality-start")
    for _ in range(steps):
        new = _concentrate(rows, now.where("falls").drop("falls", "det"), groups)
        old = now.select(*key, F.struct(*_ESTIMATE, "det", "falls").alias("old"))
        both = old.join(new.select(*key, F.struct(*_ESTIMATE, "det").alias("new")), key, "left")
        better = F.coalesce(F.col("new.det") < F.col("old.det") * (1 - SETTLED), F.lit(False))
        chosen = [F.when(better, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in (*_ESTIMATE, "det")]
        after = _written(both.select(*key, *chosen, better.alias("falls")), groups, "quality-step")
        discard(now)
        now = after
        if now.where("falls").isEmpty():
            break
    best = now.groupBy("grp").agg(F.min(F.struct("det", "start", *_ESTIMATE)).alias("e"))
    return best.select("grp", *[F.col(f"e.{c}") for c in (*_ESTIMATE, "det")])


def _blend(own: str, n: str, above: str) -> list[Column]:
    """The estimate `own` of n rows, drawn to the one above; both are structs."""
    a = F.col(n) / (F.col(n) + PRIOR)
    d = [F.col(f"{own}.mu{i}") - F.col(f"{above}.mu{i}") for i in range(_DIM)]
    mean = [(a * F.col(f"{own}.mu{i}") + (1 - a) * F.col(f"{above}.mu{i}")).alias(f"mu{i}") for i in range(_DIM)]
    return mean + [(a * F.col(f"{own}.s{i}{j}") + (1 - a) * F.col(f"{above}.s{i}{j}") + a * a * (1 - a) * d[i] * d[j]).alias(f"s{i}{j}") for i, j in _PAIRS]


def group_estimates(scored: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """(estimates of every combination of by with its columns mu and s, how many there are), of rows (by..., base_failed, features)."""
    rows = scored.where(~F.col("base_failed")).select(*by, *FEATURES)
    outer, n_by = by[:1], [F.col(c) for c in by]
    # ids of groups, even, and of the first of by, odd; -1 is the group of all rows
    groups = materialize(rows.groupBy(*by).agg(F.count("*").alias("n")).withColumn("id", 2 * F.monotonically_increasing_id()), "quality-groups")
    count = groups.count()
    outers = materialize(groups.groupBy(*outer).agg(F.sum("n").alias("m")).withColumn("oid", 2 * F.monotonically_increasing_id() + 1), "quality-groups")
    same = lambda a, b, cs: [a[c].eqNullSafe(b[f"__{c}"]) for c in cs]
    alias = lambda df, cs, *rest: df.select(*[F.col(c).alias(f"__{c}") for c in cs], *rest)
    to_outer = alias(outers, outer, "oid", "m")
    groups = groups.join(_with_bound(to_outer, count), same(groups, to_outer, outer)).select(*by, "n", "m", "id", "oid")
    to_group = alias(groups, by, "id", "oid")
    placed = rows.join(_with_bound(to_group, count), same(rows, to_group, by)).select(F.array("id", "oid", F.lit(-1).cast("long")).alias("grps"), *FEATURES)
    found = least_determinants(materialize(placed, "quality-rows"), count).select("grp", F.struct(*_ESTIMATE).alias("e"))
    everything = found.where("grp = -1").select(F.col("e").alias("top"))
    middle = found.where("grp % 2 = 1").select(F.col("grp").alias("oid"), F.col("e").alias("mid"))
    own = found.where("grp % 2 = 0").select(F.col("grp").alias("id"), F.col("e").alias("own"))
    every = groups.crossJoin(F.broadcast(everything)).join(_with_bound(middle, count), "oid")  # everything is one row
    every = every.withColumn("mid", F.struct(*_blend("mid", "m", "top"))).join(_with_bound(own, count), "id")
    return _written(_whitener(every.select(*n_by, *_blend("own", "n", "mid")), by), count, "quality-estimates"), count


def _scored(docs: DataFrame, key: str, text: str, by: tuple[str, ...], carry: bool) -> DataFrame:
    """A written table: statistics and features of every row, its groups by0, by1 ..., and all its columns as `row` if carry."""
    own = docs.select(*[F.col(c).alias(f"by{i}") for i, c in enumerate(by)], F.col(key).alias("__key"), F.col(text).alias("__text"), *([F.struct(*docs.columns).alias("row")] if carry else []))
    extra = (*[f"by{i}" for i in range(len(by))], *(("row",) if carry else ()))
    stats = base_statistics(own, "__key", "__text", extra)
    return materialize(_features(stats.withColumn("base_failed", base_failed())), "quality")


def _judged(scored: DataFrame, by: tuple[str, ...]) -> DataFrame:
    names = [f"by{i}" for i in range(len(by))]
    estimates, count = group_estimates(scored, names)
    to_group = estimates.select(*[F.col(c).alias(f"__{c}") for c in names], *[c for c in estimates.columns if c not in names])
    joined = scored.join(_with_bound(to_group, count), [scored[c].eqNullSafe(to_group[f"__{c}"]) for c in names], "left")
    return joined.withColumn("distance", F.when(~F.col("base_failed"), _distance())).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= CUTOFF))


def judge_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance (null if so), kept.

    One row per row of docs, repeated rows too. Null texts have no words and fail the base rules. Null languages and sources
    are values like others. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    judged = _judged(_scored(docs, key, text, by, False), by)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def keep_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of docs that judge_quality keeps, with all their columns: each is judged by itself, whatever its key."""
    return _judged(_scored(docs, key, text, by, True), by).where("kept").select("row.*")
