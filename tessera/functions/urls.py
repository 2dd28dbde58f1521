"""Addresses and hosts as column expressions, with their SQL text.

Percent escapes in queries are kept as they are written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions.text import any_in, any_in_sql, compact, quoted, strings, strings_sql

_NETLOC = "^[^:/?#]+://([^/?#]*)"
_PATH = "^(?:[^:/?#]+://[^/?#]*)?([^?#]*)"


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _NETLOC, 1))


def netloc_sql(url: str) -> str:
    return f"lower(regexp_extract(coalesce({url}, ''), '{_NETLOC}', 1))"


def host(url: Column) -> Column:
    """Lower case, without www."""
    return F.regexp_replace(netloc(url), r"^www\.", "")


def host_sql(url: str) -> str:
    return f"regexp_replace({netloc_sql(url)}, '^www\\.', '')"


def bare_host(url: Column) -> Column:
    """The host without user, port and www."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(netloc(F.trim(url)), "^.*@", ""), ":.*$", ""), r"^www\.", "")


def bare_host_sql(url: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({netloc_sql(f'trim({url})')}, '^.*@', ''), ':.*$', ''), '^www\\.', '')"


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)


def path_sql(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), '{_PATH}', 1)"


def segments(url: Column) -> Column:
    return F.filter(F.split(path(F.trim(url)), "/"), lambda p: p != "")


def segments_sql(url: str) -> str:
    return f"list_filter(string_split({path_sql(f'trim({url})')}, '/'), lambda p: p <> '')"


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no www., no closing slashes, tracking keys, parameters or fragment."""
    scheme = F.coalesce(F.nullif(F.lower(F.regexp_extract(url, "^([^:/?#]+)://", 1)), F.lit("")), F.lit("https"))
    own_path = F.regexp_replace(F.regexp_replace(path(url), ";[^/]*$", ""), "/+$", "")
    pairs = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*K.TRACKING_KEYS))
    query = F.array_join(F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))), "&")
    return F.concat(scheme, F.lit("://"), host(url), F.coalesce(F.nullif(own_path, F.lit("")), F.lit("/")), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def canonical_sql(url: str) -> str:
    scheme = f"coalesce(nullif(lower(regexp_extract({url}, '^([^:/?#]+)://', 1)), ''), 'https')"
    own_path = f"coalesce(nullif(regexp_replace(regexp_replace({path_sql(url)}, ';[^/]*$', ''), '/+$', ''), ''), '/')"
    pairs = f"list_filter(string_split(regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' and not list_contains({strings_sql(K.TRACKING_KEYS)}, lower(split_part(p, '=', 1))))"
    query = f"array_to_string(list_transform({pairs}, lambda p: case when contains(p, '=') then p else p || '=' end), '&')"
    return f"({scheme} || '://' || {host_sql(url)} || {own_path} || case when {query} <> '' then '?' || {query} else '' end)"


def last_labels(h: Column) -> Column:
    """The last two labels; a host with one stays."""
    parts = F.split(h, r"\.")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")).otherwise(h)


def last_labels_sql(h: str) -> str:
    return f"case when len(string_split({h}, '.')) >= 2 then array_to_string(string_split({h}, '.')[-2:], '.') else {h} end"


def registered_root(h: Column) -> Column:
    """The last two labels, or three under names like co.uk; empty labels do not count; short hosts stay."""
    parts = F.filter(F.split(h, r"\."), lambda p: p != "")
    n = F.size(parts)
    wide = F.element_at(parts, -2).isin("co", "com", "org", "net") & (F.length(F.element_at(parts, -1)) == 2)
    take = F.when(wide, 3).otherwise(2)
    return F.when(n <= 2, h).otherwise(F.array_join(F.slice(parts, n - take + 1, take), "."))


def registered_root_sql(h: str) -> str:
    parts = f"list_filter(string_split({h}, '.'), lambda p: p <> '')"
    wide = f"({parts}[-2] in ('co', 'com', 'org', 'net') and length({parts}[-1]) = 2)"
    return f"case when len({parts}) <= 2 then {h} when {wide} then array_to_string({parts}[-3:], '.') else array_to_string({parts}[-2:], '.') end"


def domain_type(h: Column) -> Column:
    out = F.lit("unknown")
    for kind, markers in reversed(K.HOST_MARKERS.items()):
        out = F.when(any_in(h, markers), kind).otherwise(out)
    return out


def domain_type_sql(h: str) -> str:
    return "case " + " ".join(f"when {any_in_sql(h, markers)} then '{kind}'" for kind, markers in K.HOST_MARKERS.items()) + " else 'unknown' end"


def is_official(h: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(h, F.lit(""))), r"^www\.", "")
    out = low.isin(*K.OFFICIAL_HOSTS)
    for suffix in K.OFFICIAL_SUFFIXES:
        out = out | F.endswith(low, F.lit(suffix))
    return out


def is_official_sql(h: str) -> str:
    low = f"regexp_replace(lower(coalesce({h}, '')), '^www\\.', '')"
    return "(" + " or ".join([f"{low} in {K.OFFICIAL_HOSTS}", *(f"ends_with({low}, '{s}')" for s in K.OFFICIAL_SUFFIXES)]) + ")"


_PRIOR = ("source_prior", "primary_boost", "spam_penalty", "verification_bonus")


def source_prior(h: Column) -> Column:
    """What is known of a host: the exact host, else its root, else the sum over its labels; a struct."""
    low = F.lower(F.trim(F.coalesce(h, F.lit(""))))
    names = (*_PRIOR, "domain_type", "labels")
    struct = lambda values: F.struct(*[F.lit(v).cast("double" if k < 4 else "string").alias(n) for k, (n, v) in enumerate(zip(names, values, strict=True))])
    roots = F.create_map(*[c for row in K.ROOT_PRIORS for c in (F.lit(row[0]), struct(row[1:]))])
    label = F.split(low, r"\.")
    met = F.filter(F.array(*[F.when(F.arrays_overlap(label, strings(some)), struct(row)) for some, *row in K.LABEL_PRIORS]), lambda p: p.isNotNull())
    total = lambda n: F.aggregate(met, F.lit(0.0), lambda s, p: s + p[n]).alias(n)
    kinds = F.filter(F.transform(met, lambda p: p["domain_type"]), lambda k: k.isNotNull())
    merged = F.struct(*[total(n) for n in _PRIOR], F.get(kinds, F.size(kinds) - 1).alias("domain_type"), F.array_join(F.transform(met, lambda p: p["labels"]), ",").alias("labels"))
    return F.coalesce(F.element_at(roots, low), F.element_at(roots, registered_root(low)), merged)


def source_prior_sql(h: str, name: str) -> str:
    """One field of the prior."""
    low = f"lower(trim(coalesce({h}, '')))"
    root, labels = registered_root_sql(low), f"string_split({low}, '.')"
    position = {**{n: k for k, n in enumerate(_PRIOR, 1)}, "domain_type": 5, "labels": 6}[name]
    lit = lambda v: "null" if v is None else f"{v!r}e0" if isinstance(v, float) else quoted(v)
    has = [f"list_has_any({labels}, {strings_sql(row[0])})" for row in K.LABEL_PRIORS]
    if position <= 4:
        other = "(" + " + ".join(["0e0", *(f"case when {x} then {row[position]!r}e0 else 0e0 end" for x, row in zip(has, K.LABEL_PRIORS, strict=True))]) + ")"
    elif position == 5:
        other = "case " + " ".join(f"when {x} then {lit(row[5])}" for x, row in reversed([*zip(has, K.LABEL_PRIORS, strict=True)]) if row[5]) + " end"
    else:
        other = "array_to_string(list_filter([" + ", ".join(f"case when {x} then {lit(row[6])} end" for x, row in zip(has, K.LABEL_PRIORS, strict=True)) + "], lambda x: x is not null), ',')"
    arms = " ".join(f"when {key} = '{row[0]}' then {lit(row[position])}" for key in (low, root) for row in K.ROOT_PRIORS)
    return f"(case {arms} else {other} end)"


def local_news_bonus(h: Column) -> Column:
    low = F.lower(F.coalesce(h, F.lit("")))
    return F.when(F.contains(low, F.lit(".kz")), 1.0).when(any_in(low, K.LOCAL_NEWS_HINTS), 0.7).otherwise(0.0)


def extract_cap(url: Column, intent: Column, base: int = 4000, wide: int = 15000) -> Column:
    return F.when((intent == "synthesis") & any_in(netloc(url), K.AUTHORITY_HOSTS), max(base, wide)).otherwise(base)


def browser_first(url: Column) -> Column:
    h = bare_host(url)
    out = F.lit(False)
    for suffix in K.BROWSER_FIRST:
        out = out | (h == suffix.lstrip(".")) | F.endswith(h, F.lit(suffix))
    return out


def repository(url: Column) -> Column:
    """owner/name of a code host's repository address; else null."""
    parts = segments(url)
    owner, name = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    ok = (bare_host(url) == "github.com") & (F.size(parts) >= 2) & ~F.lower(owner).isin(*K.REPOSITORY_RESERVED) & ~F.lower(name).isin(*K.REPOSITORY_RESERVED)
    return F.when(ok, F.concat_ws("/", owner, F.regexp_replace(name, r"\.git$", "")))


def arxiv_id(url: Column) -> Column:
    parts = segments(url)
    ok = (bare_host(url) == "arxiv.org") & (F.size(parts) >= 2) & F.lower(F.get(parts, F.lit(0))).isin("abs", "pdf")
    own = F.regexp_replace(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "/"), r"(?i)\.pdf$", "")
    return F.when(ok, F.nullif(own, F.lit("")))


def doi(url: Column) -> Column:
    own = F.array_join(segments(url), "/")
    return F.when(F.endswith(bare_host(url), F.lit("doi.org")) & F.startswith(own, F.lit("10.")), own)


def paper_id(url: Column) -> Column:
    """A forty-digit hexadecimal id, or ARXIV: and DOI: forms, of a scholarly graph's paper address; else null."""
    parts = segments(url)
    joined = F.concat(F.lit("/"), F.array_join(parts, "/"))
    hexes = F.get(F.filter(parts, lambda p: p.rlike("^[0-9a-fA-F]{40}$")), F.lit(0))
    preprint = F.nullif(F.regexp_extract(joined, r"(?i)/arxiv[:/]([0-9.]+)(?:v[0-9]+)?(?:/|$)", 1), F.lit(""))
    object_id = F.nullif(F.regexp_extract(joined, r"(?i)/doi(?::|/)(10\..*)$", 1), F.lit(""))
    found = F.coalesce(hexes, F.concat(F.lit("ARXIV:"), preprint), F.concat(F.lit("DOI:"), object_id))
    return F.when(F.contains(bare_host(url), F.lit("semanticscholar.org")), found)


def is_thread(url: Column) -> Column:
    """A discussion thread's address: /r/NAME/comments/ID on the forum host."""
    return F.regexp_replace(bare_host(url), r"^m\.", "").isin("reddit.com") & path(url).rlike("^/+r/+[^/]+/+comments/+[^/]+")


def handler(url: Column) -> Column:
    """The first source handler that takes an address."""
    return (
        F.when(is_thread(url), "thread").when(arxiv_id(url).isNotNull(), "arxiv").when(doi(url).isNotNull(), "doi")
        .when(paper_id(url).isNotNull(), "paper").when(repository(url).isNotNull(), "repository").otherwise("page")
    )


def host_labels(h: Column) -> Column:
    return F.transform(F.filter(F.split(h, r"\."), lambda p: (p != "") & (F.lower(p) != "www")), compact)
