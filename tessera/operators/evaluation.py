"""Evaluation operators: rates by split, class metrics, percentiles, costs, caches with budgets, deltas, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import text as T
from tessera.session import checkpointed


def ratio(hits: Column, n: Column, otherwise: Column) -> Column:
    return F.when(n > 0, F.round(hits / n, 4)).otherwise(otherwise)


def rates_by_split(claims: DataFrame) -> DataFrame:
    """Rates over all and by split, in one pass: needs split, expected, actual, needs_primary, has_primary, least_sources, sources."""
    hit = lambda v: F.count_if((F.col("expected") == v) & (F.col("actual") == v))
    n = lambda v: F.count_if(F.col("expected") == v)
    supported, zero, none = F.col("actual") == "supported", F.lit(0.0), F.lit(None).cast("double")
    wants, counted = F.col("needs_primary"), F.col("least_sources").isNotNull()
    grouped = claims.groupingSets([[], [F.col("split")]], F.col("split"))
    return grouped.agg(
        F.count("*").alias("n"),
        ratio(hit("supported"), n("supported"), zero).alias("claim_support_rate"),
        ratio(hit("contradicted"), n("contradicted"), zero).alias("contradiction_detection_rate"),
        ratio(hit("insufficient_evidence"), n("insufficient_evidence"), zero).alias("insufficient_detection_rate"),
        ratio(F.count_if(supported & F.col("has_primary")), F.count_if(supported), zero).alias("primary_source_coverage"),
        ratio(F.count_if(wants & supported & F.col("has_primary")), F.count_if(wants), none).alias("primary_requirement_rate"),
        ratio(F.count_if(counted & supported & (F.col("sources") >= F.col("least_sources"))), F.count_if(counted), none).alias("source_requirement_rate"),
    )


def class_metrics(pairs: DataFrame, classes: list[str]) -> DataFrame:
    """Precision, recall and F1 of each class from rows of expected and predicted: every row counts for two classes at most."""
    e, p = F.col("expected"), F.col("predicted")
    own = F.array_distinct(F.array(e, p))
    rows = pairs.select(F.explode(own).alias("class"), (e == p).alias("same"), e.alias("e")).where(F.col("class").isin(*classes))
    c = rows.groupBy("class").agg(F.count_if("same").alias("tp"), F.count_if(~F.col("same") & (F.col("e") != F.col("class"))).alias("fp"), F.count_if(~F.col("same") & (F.col("e") == F.col("class"))).alias("fn"))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = c.withColumn("precision", part(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", part(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


#: A key's values between two bounds that one window may order, the accuracy of the first bounds, and ranges that they are refined by.
FEW, ACCURACY, RANGES, MOST_PASSES = 10_000, 1000, 512, 80


def percentiles(values: DataFrame, percent: list[int], few: int = FEW) -> DataFrame:
    """For each key and percent (key, value): the interpolated percentile and the value of the lower nearest rank.

    Nothing is sorted by key. A mergeable sketch gives bounds for each percent; a pass counts the values below and between
    them exactly; bounds that do not hold the ranks asked for give way to the key's least and largest value, and bounds
    with more than `few` values between them are refined by a histogram of ranges, until there are few or each range that
    holds a rank has one value, however often; then a window over few rows can select. Percents are distinct; null values are left out, and a key without others has no row.
    """
    some = values.where("value is not null").select("key", F.col("value").cast("double").alias("value"))
    asked = sorted(set(percent))
    wide = [x for p in asked for x in (max(0.0, p / 100 - 2 / ACCURACY), min(1.0, p / 100 + 2 / ACCURACY))]
    sketch = some.groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile_approx("value", wide, 10 * ACCURACY).alias("w"))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.get("w", F.lit(2 * k)).alias("low"), F.get("w", F.lit(2 * k + 1)).alias("high")) for k, p in enumerate(asked)]))
    at = F.col("percent") * (F.col("n") - 1) / 100
    ranks = {"first": F.floor(at) + 1, "second": F.least(F.floor(at) + 2, F.col("n")), "nearest": F.greatest(F.lit(1), F.floor(F.col("n") * F.col("percent") / 100)), "part": at - F.floor(at), "tight": F.lit(False)}
    bounds = checkpointed(sketch.select("key", "n", "least", "most", each.alias("b")).select("key", "n", "least", "most", "b.*").withColumns(ranks))
    from_rank, to_rank = F.least("first", "nearest"), F.greatest("second", "nearest")
    for _ in range(MOST_PASSES):
        met = some.join(_by_key(bounds), "key")
        below = F.transform("bounds", lambda b: F.struct(b["percent"].alias("percent"), (F.col("value") < b["low"]).alias("below"), F.col("value").between(b["low"], b["high"]).alias("inside")))
        told = [F.count_if(F.get(below, F.lit(k))[c]).alias(f"{c}{k}") for k in range(len(asked)) for c in ("below", "inside")]
        counts = met.groupBy("key").agg(*told).select("key", F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.col(f"below{k}").alias("below"), F.col(f"inside{k}").alias("inside")) for k, p in enumerate(asked)])).alias("c")).select("key", "c.*")
        known = checkpointed(bounds.join(counts, ["key", "percent"]))
        holds = (F.col("below") < from_rank) & (F.col("below") + F.col("inside") >= to_rank)
        ready = holds & ((F.col("inside") <= few) | (F.col("low") == F.col("high")) | F.col("tight"))
        if known.where(~ready).isEmpty():
            break
        again = known.withColumn("tight", F.col("tight") & holds).withColumn("low", F.when(holds, F.col("low")).otherwise(F.col("least"))).withColumn("high", F.when(holds, F.col("high")).otherwise(F.col("most")))
        bounds = checkpointed(_refined(some, again, holds & ~ready, from_rank, to_rank).drop("below", "inside"))
    near = some.join(_by_key(known), "key").select("key", "value", F.explode(F.filter("bounds", lambda b: F.col("value").between(b["low"], b["high"]))["percent"]).alias("percent"))
    upto = F.sum("times").over(Window.partitionBy("key", "percent").orderBy("value"))
    placed = near.groupBy("key", "percent", "value").agg(F.count("*").alias("times")).withColumn("upto", upto).join(known, ["key", "percent"]).withColumn("upto", F.col("upto") + F.col("below"))
    value_at = lambda rank: F.min(F.when(F.col("upto") >= F.col(rank), F.col("value")))
    found = placed.groupBy("key", "percent").agg(value_at("first").alias("one"), value_at("second").alias("two"), F.min("part").alias("part"), value_at("nearest").alias("lower_nearest"))
    return found.select("key", "percent", (F.col("one") + (F.col("two") - F.col("one")) * F.col("part")).alias("interpolated"), "lower_nearest")


def _by_key(bounds: DataFrame) -> DataFrame:
    """One row a key with its bounds in the order of percent."""
    return bounds.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("percent", "low", "high"))).alias("bounds"))


def _refined(values: DataFrame, bounds: DataFrame, wanted: Column, from_rank: Column, to_rank: Column) -> DataFrame:
    """Bounds, where wanted, drawn together to the ranges of a histogram that hold the ranks; all other bounds as they are."""
    marked = bounds.withColumn("refine", wanted)
    step = lambda low, high: (high - low) / RANGES
    inside = values.join(_by_key(marked.where("refine")), "key").select("key", "value", F.explode(F.filter("bounds", lambda b: F.col("value").between(b["low"], b["high"]))).alias("b"))
    place = F.least(F.floor((F.col("value") - F.col("b.low")) / step(F.col("b.low"), F.col("b.high"))), F.lit(RANGES - 1))
    ranges = inside.groupBy("key", F.col("b.percent").alias("percent"), place.alias("place")).agg(F.count("*").alias("times"), F.min("value").alias("a"), F.max("value").alias("z"))
    upto = F.sum("times").over(Window.partitionBy("key", "percent").orderBy("place"))
    held = ranges.withColumn("upto", upto).join(marked.select("key", "percent", "below", from_rank.alias("from_rank"), to_rank.alias("to_rank")), ["key", "percent"])
    own = held.where((F.col("below") + F.col("upto") >= F.col("from_rank")) & (F.col("below") + F.col("upto") - F.col("times") < F.col("to_rank")))
    drawn = own.groupBy("key", "percent").agg(F.min("a").alias("_low"), F.max("z").alias("_high"), F.bool_and(F.col("a") == F.col("z")).alias("_tight"))
    return marked.join(drawn, ["key", "percent"], "left").withColumn("low", F.coalesce("_low", "low")).withColumn("high", F.coalesce("_high", "high")).withColumn("tight", F.coalesce("_tight", "tight")).drop("_low", "_high", "_tight", "refine")


def search_cost(plans: DataFrame, runs: DataFrame) -> DataFrame:
    """The cost of each run: queries, a half for each claim, and a weight for each fetch plan (run_id, depth)."""
    w = K.SEARCH_COST
    depth = F.col("depth")
    weight = F.when(depth == "shallow", w["shallow"]).when(depth == "deep", w["deep"]).otherwise(w["snippet_only"])
    of_plans = plans.groupBy("run_id").agg(F.sum(weight).alias("plans"))
    cost = F.col("n_queries") + F.coalesce("plans", F.lit(0.0)) + w["claim"] * F.col("n_claims")
    return runs.join(of_plans, "run_id", "left").select("run_id", F.round(cost, 3).alias("cost"))


def cache_with_budget(requests: DataFrame, budget: int) -> DataFrame:
    """Each request (run_id, key, seq) as miss, hit or blocked: the first of a key calls while the run's budget lasts.

    A hit on a key whose call was blocked is blocked too. 0 is no limit. Windows are by run and key.
    """
    first = F.row_number().over(Window.partitionBy("run_id", "key").orderBy("seq")) == 1
    one = requests.withColumn("_first", first)
    calls = F.sum(F.when(F.col("_first"), 1).otherwise(0)).over(Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    numbered = one.withColumn("_call", F.when(F.col("_first"), calls))
    own = F.max("_call").over(Window.partitionBy("run_id", "key"))
    blocked = F.lit(False) if budget <= 0 else own > budget
    status = F.when(blocked, "blocked").when(F.col("_first"), "miss").otherwise("hit")
    return numbered.withColumn("status", status).drop("_first", "_call")


def metric_deltas(previous: DataFrame, current: DataFrame) -> DataFrame:
    """current minus previous for the metrics (name, value) that both have; null where one is null."""
    return previous.withColumnRenamed("value", "before").join(current.withColumnRenamed("value", "after"), "name").select("name", "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def answer_source_urls(answer: Column) -> Column:
    """What follows the last http:// (else https://) of each line that begins with a bracket."""
    lines = F.filter(F.transform(F.split(answer, "\n"), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("[")))
    url = lambda x: F.when(F.contains(x, F.lit("http://")), F.concat(F.lit("http://"), F.trim(F.regexp_extract(x, "^.*http://(.*)$", 1)))).when(F.contains(x, F.lit("https://")), F.concat(F.lit("https://"), F.trim(F.regexp_extract(x, "^.*https://(.*)$", 1))))
    return F.filter(F.transform(lines, url), lambda u: u.isNotNull())


def answer_bullets(answer: Column) -> Column:
    """The lines that begin with a dash from the first heading or dash line on, until a blank line."""
    lines = F.transform(F.split(answer, "\n"), lambda x: F.trim(x))
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    start = F.array_min(F.filter(places, lambda i: F.get(lines, i).isin("Ответ", "Answer") | F.startswith(F.get(lines, i), F.lit("- "))))
    head = F.get(lines, start).isin("Ответ", "Answer").cast("int")
    stop = F.coalesce(F.array_min(F.filter(places, lambda i: (i >= start + head) & (F.get(lines, i) == ""))), F.size(lines))
    return F.when(start.isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.slice(lines, start + head + 1, F.greatest(stop - start - head, F.lit(0))), lambda x: F.startswith(x, F.lit("- "))))


def is_guardrail(bullet: Column) -> Column:
    return T.any_in(T.fold(bullet), K.GUARDRAIL_PHRASES)
