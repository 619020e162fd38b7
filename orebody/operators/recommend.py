"""Rating prediction: neighbourhood models, alternating least squares, regression on features.

All of them take ratings as (user, item, rating), one row a pair, and keys to predict as
(user, item).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebody.functions.skew import split_join
from orebody.operators.explore import dense_index
from orebody.operators.metrics import clamp
from orebody.operators.user_blocks import neighbour_sums
from orebody.session import cut, written

BASE = 3.0
#: Most bytes of item names that are broadcast, and how many a name may take.
BROADCAST_BYTES, ID_BYTES = 32 << 20, 128


def one_rating_per_pair(df: DataFrame, user: str, item: str, rating: str) -> DataFrame:
    """(user, item, rating): the mean rating of each pair; rows with a null are left out."""
    kept = df.where(F.col(user).isNotNull() & F.col(item).isNotNull() & F.col(rating).isNotNull())
    return kept.groupBy(F.col(user).alias("user"), F.col(item).alias("item")).agg(F.avg(F.col(rating).cast("double")).alias("rating"))


def group_means(ratings: DataFrame, by: str) -> DataFrame:
    return ratings.groupBy(by).agg(F.avg("rating").alias("mean"), F.count("*").alias("n"))


def pearson(n: Column, x: Column, y: Column, xy: Column, xx: Column, yy: Column) -> Column:
    """Correlation from sums over co-rated pairs; 0 where it is undefined. Rounded, so that the order of summing cannot show."""
    vx, vy = F.greatest(n * xx - x * x, F.lit(0.0)), F.greatest(n * yy - y * y, F.lit(0.0))
    flat = (vx < 1e-9) | (vy < 1e-9)
    return F.round(F.when(flat, F.lit(0.0)).otherwise(F.try_divide(n * xy - x * y, F.sqrt(F.when(flat, F.lit(1.0)).otherwise(vx * vy)))), 9)


def pearson_pairs(ratings: DataFrame, *, of: str, over: str, left: DataFrame | None = None, min_common: int = 2) -> DataFrame:
    """(a, b, n, w) for ordered pairs of `of` with at least `min_common` values of `over` rated by both, and a = b.

    `left` may restrict a. The one value of `over` with the most ratings is not expanded into pairs:
    a pair that shares only it has correlation 0 anyway, and the others get its part by lookup. With
    min_common of 2 nothing is lost, and the largest group costs its own size, not its square; further
    large ones are worked off by many tasks. `ratings` is read several times: cut it before.
    """
    if min_common < 2:
        raise ValueError("min_common must be at least 2")
    rows = ratings.select(F.col(of).alias("a"), F.col(over).alias("k"), F.col("rating").alias("x"))
    most = rows.groupBy("k").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "k").limit(1).select("k")
    hub, rest = rows.join(F.broadcast(most), "k", "left_semi"), rows.join(F.broadcast(most), "k", "left_anti")
    mine = rest.join(left.select(F.col(of).alias("a")).distinct(), "a", "left_semi") if left is not None else rest
    pairs = split_join(mine, rest.select(F.col("a").alias("b"), "k", F.col("x").alias("y")), ["k"], ["a"]).groupBy("a", "b").agg(
        F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    pairs = pairs.join(hub.select("a", F.col("x").alias("hx")), "a", "left").join(hub.select(F.col("a").alias("b"), F.col("x").alias("hy")), "b", "left")
    has = F.col("hx").isNotNull() & F.col("hy").isNotNull()
    plus = lambda c, v: F.col(c) + F.when(has, v).otherwise(0)
    hx, hy = F.col("hx"), F.col("hy")
    n = plus("n", F.lit(1))
    return pairs.select("a", "b", n.alias("n"), pearson(n, plus("x", hx), plus("y", hy), plus("xy", hx * hy), plus("xx", hx * hx), plus("yy", hy * hy)).alias("w")).where(F.col("n") >= min_common)


def user_based(ratings: DataFrame, keys: DataFrame, *, clamped: bool = True) -> DataFrame:
    """(user, item, prediction) for every distinct key.

    The user's mean plus the weighted mean of how the item's raters deviate from theirs, weights
    being Pearson correlations; the user's mean if they sum to 0, the base rating for an unknown user.
    Pairs of users are worked off by blocks (`user_blocks`). `ratings` is read once and needs no cut.
    """
    keys = written(keys.select("user", "item").where(F.col("user").isNotNull() & F.col("item").isNotNull()).distinct())
    sums = neighbour_sums(ratings, keys)
    p = F.coalesce(F.col("mean") + F.coalesce(F.try_divide("top", "below"), F.lit(0.0)), F.lit(BASE))
    full = keys.withColumns({"u": F.xxhash64("user"), "i": F.xxhash64("item")}).join(sums, ["u", "i"], "left")
    return full.select("user", "item", (clamp(p) if clamped else p).alias("prediction"))


def item_based(ratings: DataFrame, keys: DataFrame, similar: DataFrame) -> DataFrame:
    """(user, item, prediction) from the user's own ratings of items similar to the key's.

    `similar` has pairs (id_1, id_2); weights are Pearson correlations over common users, of which
    only positive ones count; without any, the base rating. Only ratings of items that are similar to
    some other take part, so they are picked out first: `ratings` is read once and needs no cut.
    """
    keys = written(keys.select("user", "item").where(F.col("user").isNotNull() & F.col("item").isNotNull()).distinct())
    near = cut(similar.select(F.col("id_1").alias("a"), F.col("id_2").alias("b")).unionByName(similar.select(F.col("id_2").alias("a"), F.col("id_1").alias("b"))).distinct())
    items = near.select(F.col("a").alias("item")).distinct()
    ratings = cut(ratings.join(F.broadcast(items) if items.count() * ID_BYTES <= BROADCAST_BYTES else items, "item", "left_semi").select("user", "item", "rating"))
    both = near.join(ratings.select(F.col("item").alias("a"), "user", F.col("rating").alias("x")), "a").join(ratings.select(F.col("item").alias("b"), "user", F.col("rating").alias("y")), ["b", "user"])
    sums = both.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    w = sums.select(F.col("a").alias("item"), "b", pearson(*[F.col(c) for c in ("n", "x", "y", "xy", "xx", "yy")]).alias("w")).where(F.col("w") > 0)
    met = keys.join(w, "item").join(ratings.select("user", F.col("item").alias("b"), "rating"), ["user", "b"])
    got = met.groupBy("user", "item").agg((F.sum(F.col("w") * F.col("rating")) / F.sum(F.abs("w"))).alias("p"))
    return keys.join(got, ["user", "item"], "left").select("user", "item", clamp(F.coalesce("p", F.lit(BASE))).alias("prediction"))


def top_neighbours(ratings: DataFrame, k: int = 5) -> DataFrame:
    """(a, b, w): the k items of the largest correlation with each item, ties by id.

    Items without a common user weigh 0 and rank too: they push negative ones out, but add nothing
    themselves, so they are counted and not written.
    """
    w = pearson_pairs(ratings, of="item", over="user").where((F.col("a") != F.col("b")) & (F.col("w") != 0))
    counts = ratings.agg(F.count_distinct("item").alias("items"))
    below = w.groupBy("a").agg(F.count_if(F.col("w") < 0).alias("below"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))
    above = F.count_if(F.col("w") > 0).over(Window.partitionBy("a"))
    ranked = w.withColumn("place", place).withColumn("above", above).join(below, "a").join(F.broadcast(counts), F.lit(True))
    zeros = F.col("items") - 1 - F.col("above") - F.col("below")
    return ranked.where(F.when(F.col("w") > 0, F.col("place")).otherwise(F.col("place") + zeros) <= k).select("a", "b", "w")


def top_item_based(ratings: DataFrame, keys: DataFrame, *, k: int = 5, clamped: bool = False) -> DataFrame:
    """(user, item, prediction): weighted mean over the item's top neighbours of the user's rating, or else the user's mean.

    The base rating if the weights sum to 0 or the user is unknown; the user's mean for an unknown item.
    """
    keys = keys.select("user", "item").where(F.col("user").isNotNull() & F.col("item").isNotNull()).distinct()
    means = group_means(ratings, "user").select("user", "mean")
    known = ratings.select("item").distinct().withColumn("known", F.lit(True))
    near = top_neighbours(ratings, k).select(F.col("a").alias("item"), "b", "w")
    met = keys.join(means, "user").join(near, "item").join(ratings.select("user", F.col("item").alias("b"), "rating"), ["user", "b"], "left")
    sums = met.groupBy("user", "item").agg(F.sum(F.col("w") * F.coalesce("rating", "mean")).alias("top"), F.sum(F.abs("w")).alias("below"))
    full = keys.join(means, "user", "left").join(known, "item", "left").join(sums, ["user", "item"], "left")
    p = F.when(F.col("mean").isNull(), F.lit(BASE)).when(F.col("known").isNull(), F.col("mean")).otherwise(F.coalesce(F.try_divide("top", "below"), F.lit(BASE)))
    return full.select("user", "item", (clamp(p) if clamped else p).alias("prediction"))


def bias_prediction(ratings: DataFrame, keys: DataFrame) -> DataFrame:
    """(user, item, raw, prediction): user mean plus item mean less the mean of all, as it is and clamped.

    Only keys whose user and item are both known.
    """
    keys = keys.select("user", "item").distinct()
    u = group_means(ratings, "user").select("user", F.col("mean").alias("u"))
    i = group_means(ratings, "item").select("item", F.col("mean").alias("i"))
    raw = F.col("u") + F.col("i") - F.col("all")
    return keys.join(u, "user").join(i, "item").join(F.broadcast(ratings.agg(F.avg("rating").alias("all"))), F.lit(True)).select("user", "item", raw.alias("raw"), clamp(raw).alias("prediction"))


def with_default(predictions: DataFrame, keys: DataFrame, default: float = BASE) -> DataFrame:
    """Predictions, and the default for each key that has none."""
    got = predictions.select("user", "item", "prediction")
    return got.unionByName(keys.select("user", "item").distinct().join(got, ["user", "item"], "left_anti").withColumn("prediction", F.lit(default)))


def als(ratings: DataFrame, keys: DataFrame, *, rank: int = 2, rounds: int = 5, penalty: float = 0.25, seed: int = 42) -> DataFrame:
    """(user, item, prediction) by nonnegative matrix factorisation, clamped; the base rating for unknown keys."""
    from orebody.session import shared_dir
    from pyspark.ml.recommendation import ALS

    shared_dir(ratings.sparkSession)
    users, items = cut(dense_index(ratings, "user", "u").withColumn("u", F.col("u").cast("int"))), cut(dense_index(ratings, "item", "i").withColumn("i", F.col("i").cast("int")))
    rows = cut(ratings.join(users, "user").join(items, "item").select("u", "i", "rating"))
    model = ALS(rank=rank, maxIter=rounds, regParam=penalty, nonnegative=True, seed=seed, userCol="u", itemCol="i", ratingCol="rating").fit(rows)
    known = keys.select("user", "item").distinct().join(users, "user").join(items, "item")
    got = model.transform(known).where(~F.isnan("prediction")).select("user", "item", clamp(F.col("prediction").cast("double")).alias("prediction"))
    return with_default(got, keys)


def regression(train: DataFrame, test: DataFrame, features: list[str], label: str, *, degree: int = 3, penalty: float = 0.0) -> DataFrame:
    """`test` with a clamped `prediction` of a linear model over the polynomial expansion of scaled features.

    Scaler and model see `train` only; null features count as 0. `penalty` is the weight of an L2 term, none by default.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    fill = lambda df: df.fillna(0.0, subset=features)
    steps = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), PolynomialExpansion(degree=degree, inputCol="_scaled", outputCol="_poly"), LinearRegression(featuresCol="_poly", labelCol=label, predictionCol="_p", regParam=penalty)]
    model = Pipeline(stages=steps).fit(fill(train.where(F.col(label).isNotNull())))
    return model.transform(fill(test)).withColumn("prediction", clamp(F.col("_p"))).drop("_raw", "_scaled", "_poly", "_p")


#: A small valence lexicon of our own; scores differ from those of larger lexicons.
LEXICON = {
    "good": 1.9, "best": 3.2, "better": 1.9, "great": 3.1, "excellent": 2.7, "amazing": 2.8, "love": 3.2, "worth": 0.9, "spotless": 2.0, "friendlier": 2.0,
    "friendly": 2.2, "careful": 0.6, "miracle": 2.8, "surprisingly": 1.1, "loud": -1.0, "salty": -0.9, "slow": -1.1, "lukewarm": -1.2, "overpriced": -1.8, "missing": -1.2,
    "bad": -2.5, "worst": -3.1, "terrible": -2.1, "awful": -2.0, "complained": -1.6, "hard": -0.4, "fault": -1.7, "impossible": -1.4, "afterthought": -1.3, "sorry": -0.3,
}


def sentiment(text: Column, lexicon: dict[str, float] | None = None) -> Column:
    """s / sqrt(s^2 + 15) for the sum s of its words' valences; 0 for null."""
    words = lexicon or LEXICON
    table = F.create_map(*[F.lit(x) for pair in sorted(words.items()) for x in pair])
    s = F.aggregate(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), F.lit(0.0), lambda acc, w: acc + F.coalesce(F.element_at(table, w), F.lit(0.0)))
    return F.coalesce(s / F.sqrt(s * s + 15), F.lit(0.0))


#: LEXICON and common words of opinion, valences of our own.
OPINIONS = LEXICON | {
    "nice": 1.8, "fine": 0.8, "delicious": 2.7, "tasty": 2.2, "perfect": 2.7, "perfectly": 2.7, "awesome": 3.0, "fantastic": 2.8, "wonderful": 2.7, "superb": 3.0,
    "outstanding": 3.0, "lovely": 2.6, "loved": 2.9, "loves": 2.7, "like": 1.2, "liked": 1.6, "enjoy": 2.0, "enjoyed": 2.2, "enjoyable": 2.1, "favorite": 2.1,
    "favourite": 2.1, "happy": 2.5, "pleased": 1.9, "pleasant": 2.1, "recommend": 1.7, "recommended": 1.7, "fresh": 1.4, "clean": 1.6, "cozy": 1.7, "cosy": 1.7,
    "beautiful": 2.8, "helpful": 1.9, "kind": 2.0, "polite": 1.9, "welcoming": 2.0, "attentive": 1.8, "generous": 2.1, "fun": 2.2, "cool": 1.3, "quick": 0.9,
    "fast": 0.8, "cheap": 0.5, "affordable": 1.2, "impressed": 2.0, "impressive": 2.2, "incredible": 2.8, "brilliant": 2.7, "yummy": 2.4, "juicy": 1.3, "crispy": 1.2,
    "flavorful": 1.9, "solid": 1.0, "decent": 1.0, "reliable": 1.6, "professional": 1.4, "thanks": 1.6, "thank": 1.5, "win": 2.0, "winner": 2.3, "comfortable": 1.6,
    "horrible": -2.5, "disgusting": -2.8, "disappointing": -2.1, "disappointed": -2.0, "disappointment": -2.1, "rude": -2.1, "dirty": -1.9, "filthy": -2.4, "gross": -2.1, "nasty": -2.4,
    "poor": -1.9, "poorly": -1.9, "worse": -2.2, "hate": -2.7, "hated": -2.8, "dislike": -1.6, "disliked": -1.7, "mediocre": -1.1, "bland": -1.2, "stale": -1.5,
    "cold": -0.6, "burnt": -1.4, "soggy": -1.3, "greasy": -1.2, "dry": -0.6, "raw": -0.7, "undercooked": -1.5, "overcooked": -1.4, "expensive": -1.0, "pricey": -0.9,
    "noisy": -1.1, "crowded": -0.7, "unfriendly": -1.9, "unprofessional": -2.0, "careless": -1.6, "ignored": -1.5, "wrong": -1.9, "broken": -1.6, "mistake": -1.5, "problem": -1.5,
    "problems": -1.5, "annoying": -1.8, "annoyed": -1.7, "angry": -2.2, "sad": -2.0, "boring": -1.4, "tasteless": -1.6, "unacceptable": -2.1, "avoid": -1.5, "waste": -1.8,
    "wasted": -1.9, "scam": -2.6, "fail": -2.1, "failed": -2.1, "sick": -1.9, "smelly": -1.6, "ugly": -2.0, "complain": -1.5, "complaint": -1.4, "unhappy": -1.9,
}
NEGATORS = ["not", "no", "never", "nobody", "nothing", "none", "neither", "nor", "without", "hardly", "barely", "cannot", "aint", "cant", "didnt", "doesnt", "dont", "isnt", "wasnt", "werent", "wont"]
#: What a word adds to the size of the valence right behind it.
BOOSTERS = {
    "very": 0.3, "really": 0.3, "so": 0.3, "extremely": 0.3, "absolutely": 0.3, "incredibly": 0.3, "totally": 0.3, "super": 0.3, "most": 0.3, "too": 0.3,
    "slightly": -0.3, "somewhat": -0.3, "fairly": -0.3, "kinda": -0.3, "almost": -0.3, "partly": -0.3,
}


def opinion(text: Column) -> Column:
    """Like `sentiment` over OPINIONS, with negation, boosters and exclamation marks; 0 for null.

    A negator turns and weakens the valences of the three words behind it; a booster strengthens or
    weakens that of the next word; up to four exclamation marks add to the size of the sum.
    """
    table = lambda words: F.create_map(*[F.lit(x) for pair in sorted(words.items()) for x in pair])
    valence, boost = table(OPINIONS), table(BOOSTERS)

    def step(acc: Column, w: Column) -> Column:
        v = F.coalesce(F.element_at(valence, w), F.lit(0.0))
        v = F.when(v == 0, v).otherwise(v + F.signum(v) * acc["boost"]) * F.when(acc["negated"] > 0, F.lit(-0.74)).otherwise(F.lit(1.0))
        negated = F.when(w.isin(NEGATORS) | w.endswith("n't"), F.lit(3)).otherwise(F.greatest(acc["negated"] - 1, F.lit(0)))
        return F.struct((acc["sum"] + v).alias("sum"), negated.alias("negated"), F.coalesce(F.element_at(boost, w), F.lit(0.0)).alias("boost"))

    words = F.regexp_extract_all(F.replace(F.lower(text), F.lit("\u2019"), F.lit("'")), F.lit("[a-z]+(?:'[a-z]+)?"), F.lit(0))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("negated"), F.lit(0.0).alias("boost"))
    plain = F.aggregate(words, start, step, lambda acc: acc["sum"])
    marks = F.least(F.lit(4), F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))))
    s = plain + F.signum(plain) * 0.29 * marks
    return F.coalesce(s / F.sqrt(s * s + 15), F.lit(0.0))
