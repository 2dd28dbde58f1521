"""Search profiles as a small table, and the settings that follow from one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = "profile string, categories array<string>, language string, time_range string, fetch_top_n int, max_results int, hints array<string>, engines array<string>, region string"
#: The profiles. Name, categories, language, time range, pages to fetch, results, hint words, engines, region.
PROFILES = (
    ("web", ["general"], "auto", None, 3, 20, [], [], None),
    ("ru", ["general"], "ru", None, 3, 20, [], [], "ru-ru"),
    ("news", ["news"], "auto", "week", 2, 15, [], [], None),
    ("news_fresh", ["news"], "auto", "day", 2, 15, [], [], None),
    ("ru_news", ["news"], "ru", "week", 2, 15, [], [], None),
    ("ru_news_fresh", ["news"], "ru", "day", 2, 15, [], [], None),
    ("science", ["science"], "auto", None, 0, 20, ["(arxiv OR site:arxiv.org)"], [], None),
    ("tech", ["it"], "auto", None, 3, 20, ["(programming OR software OR documentation)"], [], None),
    ("it_qa", ["it"], "auto", None, 3, 20, ["(stackoverflow OR stack exchange)"], [], None),
    ("it_repos", ["it"], "auto", None, 3, 20, ["(github OR gitlab OR pypi OR npm OR crates.io)"], [], None),
    ("deep", ["general", "news", "science"], "auto", None, 5, 30, [], [], None),
    ("reference", ["general"], "auto", None, 2, 12, [], ["wikipedia", "wikidata"], None),
    ("reddit", ["general"], "auto", None, 3, 20, [], ["reddit"], None),
    ("arxiv", ["science"], "auto", None, 0, 20, [], ["arxiv"], None),
    ("wikipedia", ["general"], "auto", None, 3, 15, [], ["wikipedia", "wikidata"], None),
)


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROFILES), KINDS)


def with_profile(queries: DataFrame) -> DataFrame:
    """Rows with a profile name beside that profile's columns; a name that is unknown fails the job."""
    known = profiles(queries.sparkSession)
    joined = queries.join(F.broadcast(known), "profile", "left")
    return joined.where(F.assert_true(F.col("categories").isNotNull(), F.concat(F.lit("unknown profile "), F.coalesce("profile", F.lit("null")))).isNull())


def is_news(categories: Column) -> Column:
    return (F.get(categories, F.lit(0)) == "news") & ~F.array_contains(categories, "general")


def gate_limit(max_results: Column) -> Column:
    return F.least(F.lit(20), F.greatest(F.lit(10), max_results))


def fetch_limits(fetch_top_n: Column, iteration: Column) -> tuple[Column, Column]:
    """How many pages a round reads shallowly and deeply; none deeply where the profile fetches none."""
    deep = F.when(fetch_top_n == 0, 0).otherwise(F.least(F.lit(2), F.greatest(fetch_top_n, F.lit(4))))
    return F.when(iteration == 1, 5).otherwise(10), deep


def time_limit(own: Column, time_range: Column) -> Column:
    """The provider's letter for a time range, unless the profile has one of its own; blank is none."""
    letters = F.create_map(*[F.lit(x) for x in ("day", "d", "week", "w", "month", "m", "year", "y")])
    return F.when(own.isNotNull(), F.nullif(F.trim(own), F.lit(""))).otherwise(F.element_at(letters, time_range))


def rule_list(raw: Column) -> Column:
    """A setting that is a JSON list, or parts between semicolons or lines, as trimmed parts that are not empty; in order, once."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    parts = F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<string>")).otherwise(F.split(F.replace(text, F.lit(";"), F.lit("\n")), "\n"))
    return F.array_distinct(F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda p: F.trim(p)), lambda p: p != ""))


def merged_rules(setting: Column, own: Column) -> Column:
    """The rules of the settings before those of the profile, trimmed, each once."""
    mine = F.filter(F.transform(F.coalesce(own, F.array().cast("array<string>")), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.concat(rule_list(setting), mine))


def safe_search(own: Column, setting: Column) -> Column:
    """A profile's own level, even a blank one; else that of the settings."""
    return F.coalesce(own, setting)


def provider(override: Column, setting: Column) -> Column:
    """The provider's name: an override that is not blank, else the setting, else brave; in lower case."""
    said = lambda x: F.lower(F.trim(x))
    return F.coalesce(F.nullif(said(override), F.lit("")), F.when(F.coalesce(setting, F.lit("")) == "", "brave").otherwise(said(setting)))
