"""Operators on addresses and hosts over the pages table, with some well-known hosts put in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import urls as U
from tessera.functions.text import any_in_sql, quoted
from tessera.plans.registry import query
from tessera.session import table

#: Hosts and addresses that stand in for those that the pages table lacks, dealt to pages by id.
HOSTS = (
    "docs.python.org", "www.microsoft.com", "blog.openai.com", "press.example.com", "community.example.org", "news.bbc.co.uk", "arxiv.org", "m.reddit.com", "irs.gov", "help.docs.example.net",
    "ft.com", "en.wikipedia.org", "x.com", "tengrinews.kz", "shop.best", "who.int", "stanford.edu", "localhost", "ir.apple.com", "developer.mozilla.org",
)
ADDRESSES = (
    "https://github.com/owner/repo.git", "https://github.com/topics/python", "https://arxiv.org/pdf/2312.12345v2.pdf", "https://www.arxiv.org/abs/hep-th/9901001", "https://doi.org/10.1000/182", "https://dx.doi.org/abc",
    "https://www.semanticscholar.org/paper/Name/0123456789abcdef0123456789abcdef01234567", "https://api.semanticscholar.org/arXiv:2312.12345v3", "https://www.reddit.com/r/spark/comments/abc1/title/", "https://old.reddit.com/r/spark/", "https://vc.ru/tech/1", "https://docs.python.org/3/whatsnew",
)


def _deal(values: tuple[str, ...]):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col("page_id"), F.lit(len(values))) + 1).cast("int"))


def _deal_sql(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(quoted, values)) + f"][(page_id % {len(values)}) + 1]"


@query(f"select page_id, {U.canonical_sql('url')} as canonical_url, {U.host_sql('url')} as host from pages")
def pages_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.canonical(url).alias("canonical_url"), U.host(url).alias("host"))


@query(
    f"select canonical_url, page_id, url, n from (select page_id, url, {U.canonical_sql('url')} as canonical_url, length(html) as score, row_number() over (partition by {U.canonical_sql('url')} order by length(html) desc, page_id) as r, "
    f"count(*) over (partition by {U.canonical_sql('url')}) as n from pages) where r = 1"
)
def merge_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union by canonical address: the row of the higher score stays, the earlier one where scores tie."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", U.canonical(F.col("url")).alias("canonical_url"), F.length("html").alias("score"))
    best = F.max_by(F.struct("page_id", "url"), F.struct("score", -F.col("page_id")))
    return p.groupBy("canonical_url").agg(best.alias("best"), F.count("*").alias("n")).select("canonical_url", "best.page_id", "best.url", "n")


@query(
    f"select page_id, h as host, {U.last_labels_sql('h')} as last_labels, {U.registered_root_sql('h')} as registered_root, {U.domain_type_sql('h')} as domain_type, {U.is_official_sql('h')} as official, "
    f"case when contains(lower(h), '.kz') then 1e0 when {any_in_sql('lower(h)', K.LOCAL_NEWS_HINTS)} then 0.7e0 else 0e0 end as local_bonus, "
    + ", ".join(f"{('round(' + U.source_prior_sql('h', f) + ', 6)') if f not in ('domain_type', 'labels') else U.source_prior_sql('h', f)} as prior_{f}" for f in ("source_prior", "primary_boost", "spam_penalty", "verification_bonus", "domain_type", "labels"))
    + f" from (select page_id, case when page_id % 2 = 0 then {_deal_sql(HOSTS)} else {U.host_sql('url')} end as h from pages)"
)
def host_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots, kind and prior of hosts; every second host is a well-known one."""
    h = F.col("host")
    p = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, _deal(HOSTS)).otherwise(U.host(F.col("url"))).alias("host"))
    facts = p.select("*", U.last_labels(h).alias("last_labels"), U.registered_root(h).alias("registered_root"), U.domain_type(h).alias("domain_type"), U.is_official(h).alias("official"), U.local_news_bonus(h).alias("local_bonus"), U.source_prior(h).alias("prior"))
    priors = [F.round(f"prior.{f}", 6).alias(f"prior_{f}") for f in ("source_prior", "primary_boost", "spam_penalty", "verification_bonus")]
    return facts.select("page_id", "host", "last_labels", "registered_root", "domain_type", "official", "local_bonus", *priors, F.col("prior.domain_type").alias("prior_domain_type"), F.col("prior.labels").alias("prior_labels"))


_SEG = U.segments_sql("u")
_REPO = f"case when {U.bare_host_sql('u')} = 'github.com' and len({_SEG}) >= 2 and not list_has_any([lower({_SEG}[1]), lower({_SEG}[2])], {list(K.REPOSITORY_RESERVED)}) then {_SEG}[1] || '/' || regexp_replace({_SEG}[2], '\\.git$', '') end"
_ARXIV = f"case when {U.bare_host_sql('u')} = 'arxiv.org' and len({_SEG}) >= 2 and lower({_SEG}[1]) in ('abs', 'pdf') then nullif(regexp_replace(array_to_string({_SEG}[2:], '/'), '(?i)\\.pdf$', ''), '') end"
_DOI = f"case when ends_with({U.bare_host_sql('u')}, 'doi.org') and starts_with(array_to_string({_SEG}, '/'), '10.') then array_to_string({_SEG}, '/') end"
_JOINED = f"('/' || array_to_string({_SEG}, '/'))"
_PAPER = f"case when contains({U.bare_host_sql('u')}, 'semanticscholar.org') then coalesce(list_filter({_SEG}, lambda p: regexp_full_match(p, '[0-9a-fA-F]{{40}}'))[1], 'ARXIV:' || nullif(regexp_extract({_JOINED}, '(?i)/arxiv[:/]([0-9.]+)(?:v[0-9]+)?(?:/|$)', 1), ''), 'DOI:' || nullif(regexp_extract({_JOINED}, '(?i)/doi(?::|/)(10\\..*)$', 1), '')) end"
_THREAD = f"(regexp_replace({U.bare_host_sql('u')}, '^m\\.', '') = 'reddit.com' and regexp_matches({U.path_sql('u')}, '^/+r/+[^/]+/+comments/+[^/]+'))"


@query(
    f"select page_id, u as url, {_REPO} as repository, {_ARXIV} as arxiv_id, {_DOI} as doi, {_PAPER} as paper_id, {_THREAD} as is_thread, "
    f"case when {_THREAD} then 'thread' when {_ARXIV} is not null then 'arxiv' when {_DOI} is not null then 'doi' when {_PAPER} is not null then 'paper' when {_REPO} is not null then 'repository' else 'page' end as handler, "
    f"({U.bare_host_sql('u')} = 'vc.ru' or ends_with({U.bare_host_sql('u')}, '.vc.ru')) as browser_first, case when page_id % 3 = 0 and {any_in_sql(U.netloc_sql('u'), K.AUTHORITY_HOSTS)} then 15000 else 4000 end as cap "
    f"from (select page_id, case when page_id % 2 = 0 then {_deal_sql(ADDRESSES)} else url end as u from pages)"
)
def source_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source handler takes an address, the ids in it, and the limit on its text."""
    u = F.col("url")
    p = table(spark, sf_dir, "pages").select("page_id", F.when((F.col("page_id") % 2) == 0, _deal(ADDRESSES)).otherwise(u).alias("url"))
    intent = F.when(F.col("page_id") % 3 == 0, "synthesis").otherwise("factual")
    return p.select(
        "page_id", "url", U.repository(u).alias("repository"), U.arxiv_id(u).alias("arxiv_id"), U.doi(u).alias("doi"), U.paper_id(u).alias("paper_id"),
        U.is_thread(u).alias("is_thread"), U.handler(u).alias("handler"), U.browser_first(u).alias("browser_first"), U.extract_cap(u, intent).alias("cap"),
    )
