"""Customer features from activities: period counts, level counts, points of interest, fills, centring, shares, deciles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, NumericType, StringType

EPOCH = "2014-01-01"


def day_number(day: Column, epoch: str = EPOCH) -> Column:
    """Days since the epoch."""
    return F.datediff(day.cast("date"), F.lit(epoch).cast("date"))


def in_period(day: Column, first: str, last: str) -> Column:
    """Inclusive range of days, compared as strings or dates alike."""
    return day.between(first, last)


def level_name(prefix: str, level: str) -> str:
    return f"{prefix}_{level.replace('-', 'na', 1)}"


def activity_counts(acts: DataFrame, user: str, levels: dict[str, list[str]], pois: list | None = None, poi: str = "poi_id") -> DataFrame:
    """(user, avt_cnt, one count for each level of each category, one for each point of interest), in one pass."""
    counts = [F.count(F.lit(1)).alias("avt_cnt")]
    counts += [F.count_if(F.col(c) == x).alias(level_name(f"a{c}_cnt", x)) for c, xs in levels.items() for x in xs]
    counts += [F.count_if(F.col(poi) == x).alias(f"poi_id_{x}") for x in pois or []]
    return acts.groupBy(user).agg(*counts)


def user_features(users: DataFrame, counts: DataFrame, user: str, missing_value: int = -1) -> DataFrame:
    """All users; those without activity get missing_value, but 0 for points of interest."""
    fill = {c: 0 if c.startswith("poi_id_") else missing_value for c in counts.columns if c != user}
    return users.join(counts, user, "left").fillna(fill)


def poi_shares(acts: DataFrame, poi: str = "poi_id") -> DataFrame:
    """(poi, share): the share of the activities at each point of interest; none for no activities."""
    n = acts.groupBy(poi).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select(poi, (F.col("n") / F.col("total")).alias("share"))  # one row


def poi_signed_scores(acts: DataFrame, windows: list[tuple[str, str, str]], poi: str = "poi_id", day: str = "day") -> DataFrame:
    """(poi, score): over (flag, first, last) windows, the shares among users with the flag minus those without.

    One pass: activities are counted by poi, and their numbers for each window and flag value divided by the totals.
    A window of None, None takes all days.
    """
    counted, total = [], []
    for k, (flag, first, last) in enumerate(windows):
        inside = in_period(F.col(day), first, last) if first else F.lit(True)
        for side, has in (("p", F.col(flag)), ("n", ~F.col(flag))):
            counted.append(F.count_if(inside & has).alias(f"{side}{k}"))
            total.append(F.sum(f"{side}{k}").alias(f"t{side}{k}"))
    n = acts.groupBy(poi).agg(*counted)
    held = n.crossJoin(F.broadcast(n.agg(*total)))  # one row
    part = lambda c: F.coalesce(F.try_divide(F.col(c), F.col(f"t{c}")), F.lit(0.0))
    score = sum((part(f"p{k}") - part(f"n{k}") for k in range(len(windows))), F.lit(0.0))
    return held.select(poi, F.round(score, 9).alias("score"))


def unpivoted(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, name, value): a row for each of the numeric columns."""
    return df.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(keys, columns, "name", "value")


def centred(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns minus their means."""
    means = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns))
    return df.crossJoin(F.broadcast(means)).select(*(c for c in df.columns if c not in columns), *(F.round(F.col(c) - F.col(f"m_{c}"), 6).alias(c) for c in columns))  # one row


def standardised(train: DataFrame, others: DataFrame, columns: list[str]) -> DataFrame:
    """others' columns minus train's means, divided by train's sample deviations; null where that is 0."""
    stats = train.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"s_{c}") for c in columns))
    z = lambda c: F.round(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), 6)
    return others.crossJoin(F.broadcast(stats)).select(*(c for c in others.columns if c not in columns), *(z(c).alias(c) for c in columns))  # one row


def level_shares(df: DataFrame, part: str, columns: list[str]) -> DataFrame:
    """(part, name, level, share) of categorical columns within each partition."""
    long = df.select(part, *columns).unpivot([part], columns, "name", "level")
    counts = long.groupBy(part, "name", "level").agg(F.count(F.lit(1)).alias("n"))
    sizes = df.groupBy(part).agg(F.count(F.lit(1)).alias("size"))
    return counts.join(sizes, part).select(part, "name", "level", F.round(F.col("n") / F.col("size"), 6).alias("share"))


def deciles(df: DataFrame, part: str, columns: list[str], approximate: bool = False) -> DataFrame:
    """(part, name, decile, value): 0, 10, ..., 100% quantiles by linear interpolation; approximate for huge partitions."""
    shares = F.array(*(F.lit(k / 10) for k in range(11)))
    how = F.percentile_approx("value", shares) if approximate else F.percentile("value", shares)
    held = unpivoted(df, [part], columns).groupBy(part, "name").agg(how.alias("d"))
    return held.select(part, "name", F.posexplode("d").alias("decile", "value")).withColumn("value", F.round("value", 6))


def with_level(df: DataFrame, column: str, level: str = "-") -> DataFrame:
    """df with null of a factor as a level of its own."""
    return df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit(level)))


def level_counts(df: DataFrame, column: str, levels: tuple[str, ...] = ("-",)) -> DataFrame:
    """(level, n) of a factor; levels are listed even where no row has them."""
    listed = df.sparkSession.createDataFrame([(x, 0) for x in levels], "level string, n bigint")
    own = with_level(df, column).groupBy(F.col(column).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return own.unionByName(listed).groupBy("level").agg(F.sum("n").alias("n"))


def drift(before: DataFrame, after: DataFrame, factors: list[str], numbers: list[str]) -> DataFrame:
    """(name, kind, place, before, after): counts of each level of the factors, and deciles of the numbers, of two tables side by side."""

    def side(df: DataFrame, name: str) -> DataFrame:
        levels = df.select(*(F.col(c).cast("string").alias(c) for c in factors)).unpivot([], factors, "name", "place").groupBy("name", "place").agg(F.count(F.lit(1)).cast("double").alias(name)).withColumn("kind", F.lit("level"))
        own = deciles(df.withColumn("part_", F.lit(1)), "part_", numbers).select("name", F.lpad(F.col("decile").cast("string"), 2, "0").alias("place"), F.col("value").alias(name), F.lit("decile").alias("kind"))
        return levels.unionByName(own)

    joined = side(before, "before").join(side(after, "after"), ["name", "kind", "place"], "full")
    return joined.select("name", "kind", "place", "before", "after")


def numeric_columns(df: DataFrame, leave_out: str = "^$") -> list[str]:
    """The names of the columns that are numbers by their type and don't match the pattern, in order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and not re.search(leave_out, f.name)]


def terms(df: DataFrame, label: str, few: int = 8, leave_out: str = "^$") -> DataFrame:
    """(name, kind, n, term) of all columns but the label, from schema and data: the term that each gets in a model.

    Numbers of under ``few`` different values are linear, others smooth; text columns are random effects. Columns of
    other types, or that match leave_out, get none.
    """
    held = [f for f in df.schema.fields if f.name != label and not re.search(leave_out, f.name) and isinstance(f.dataType, (NumericType, StringType))]
    kinds = {f.name: "number" if isinstance(f.dataType, NumericType) else "factor" for f in held}
    # one row per column and different value is exchanged, whatever the number of columns
    values = df.select(*(F.col(c).cast("string").alias(c) for c in kinds)).unpivot([], list(kinds), "name", "value").filter("value is not null").distinct()
    n = values.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    factors = [c for c, k in kinds.items() if k == "factor"]
    kind = F.when(F.col("name").isin(factors), "factor").otherwise("number")
    term = F.when(kind == "factor", F.concat(F.lit("s("), "name", F.lit(",bs='re')"))).when(F.col("n") < few, F.col("name")).otherwise(F.concat(F.lit("s("), "name", F.lit(",bs='cr',k=4)")))
    return n.select("name", kind.alias("kind"), "n", term.alias("term"))


def formula(df: DataFrame, label: str, few: int = 8, leave_out: str = "^$") -> str:
    """The model formula of terms(), by name."""
    return f"{label} ~ " + " + ".join(r["term"] for r in terms(df, label, few, leave_out).orderBy("name").collect())  # one row per column


def coerced(df: DataFrame, types: dict[str, str], missing: str = "-") -> DataFrame:
    """df with the type of the first pattern that a column's name matches; ``missing`` and what has no such type become null."""

    def one(name: str) -> Column:
        kind = next((t for p, t in types.items() if re.search(p, name)), None)
        return F.col(name) if kind is None else F.when(F.trim(F.col(name).cast("string")) != missing, F.col(name).cast("string").try_cast(kind)).alias(name)

    return df.select(*(one(c) for c in df.columns))


def inspection(df: DataFrame) -> DataFrame:
    """(name, type, n, n_null, n_distinct, least, most) of every column of plain type, values as text in order of the text."""
    types = dict(df.dtypes)
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, AtomicType)]
    long = df.select(*(F.col(c).cast("string").alias(c) for c in plain)).unpivot([], plain, "name", "value")
    counts = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("k")).groupBy("name").agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("k"))), F.lit(0)).alias("n_null"), F.count("value").alias("n_distinct"), F.min("value").alias("least"), F.max("value").alias("most"))
    kinds = F.create_map(*(F.lit(x) for c in plain for x in (c, types[c])))
    return counts.select("name", F.element_at(kinds, F.col("name")).alias("type"), "n", "n_null", "n_distinct", "least", "most")


def one_hot(df: DataFrame, key: str, levels: dict[str, list[str]]) -> DataFrame:
    """key and a 0/1 column for each level of each factor."""
    return df.select(key, *((F.coalesce(F.col(c) == x, F.lit(False))).cast("int").alias(level_name(c, x)) for c, xs in levels.items() for x in xs))


def seeded_split(df: DataFrame, key: str, ratio: float | None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, validation) by a hash of the key, the same on every run; a ratio outside 0 to 1 or none doesn't split."""
    if ratio is None or not 0 <= ratio <= 1:
        return df, df.limit(0)
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / 1_000_000
    return df.filter(u < ratio), df.filter(u >= ratio)
