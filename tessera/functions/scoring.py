"""Scores of results and passages as column expressions over prepared columns, with their SQL text.

Token arrays are made once for each text before texts meet; nothing here tokenises inside a pair.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions.text import any_in, any_in_sql, compact, compact_sql, fold, fold_sql


def num(x: float) -> str:
    """A double literal in SQL."""
    return f"{float(x)!r}e0"


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def clamp_sql(x: str) -> str:
    return f"least(greatest({x}, 0e0), 1e0)"


def overlap(asked: Column, found: Column) -> Column:
    """Share of the asked distinct tokens that are found; 0 when none is asked."""
    n = F.size(F.array_distinct(asked))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(asked, found)) / n)


def overlap_sql(asked: str, found: str) -> str:
    n = f"len(list_distinct({asked}))"
    return f"case when {n} = 0 then 0e0 else len(list_distinct(list_intersect({asked}, {found}))) / {n} end"


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def entity_keys(entities: Column) -> Column:
    """What is looked for of each entity: its folded and its compacted form."""
    return F.transform(entities, lambda e: F.struct(fold(e).alias("low"), compact(e).alias("own")))


def entity_overlap(entities: Column, text: Column, low: Column | None = None, tight: Column | None = None, keys: Column | None = None) -> Column:
    """Mean over entities of 1 (stands in the text, also compacted), 0.75 (its first five characters do) or 0.

    low and tight are the folded and the compacted text, keys the entity_keys, where columns hold them already.
    """
    low, tight, keys = fold(text) if low is None else low, compact(text) if tight is None else tight, entity_keys(entities) if keys is None else keys

    def hit(e: Column) -> Column:
        own = e["own"]
        whole = F.contains(low, e["low"]) | ((own != "") & F.contains(tight, own))
        return F.when(whole, 1.0).when((F.length(own) >= 5) & F.contains(tight, F.substr(own, F.lit(1), F.lit(5))), 0.75).otherwise(0.0)

    return F.when(F.size(entities) == 0, 0.0).otherwise(clamp(F.aggregate(F.transform(keys, hit), F.lit(0.0), lambda s, x: s + x) / F.size(entities)))


def entity_overlap_sql(entities: str, text: str) -> str:
    low, tight, own = fold_sql(text), compact_sql(text), compact_sql("e")
    hit = f"case when contains({low}, {fold_sql('e')}) or ({own} <> '' and contains({tight}, {own})) then 1e0 when length({own}) >= 5 and contains({tight}, left({own}, 5)) then 0.75e0 else 0e0 end"
    return f"case when len({entities}) = 0 then 0e0 else {clamp_sql(f'list_sum(list_transform({entities}, lambda e: {hit})) / len({entities})')} end"


def spam_risk(host: Column, domain: Column, title: Column, snippet: Column, title_tokens: Column, penalty: Column) -> Column:
    text = fold(F.concat_ws(" ", title, snippet))
    risk = F.when(F.endswith(host, F.lit(".top")) | F.endswith(host, F.lit(".best")), 0.6).otherwise(0.0)
    risk = risk + F.when(any_in(text, K.SPAM_CUES), 0.25).otherwise(0.0)
    risk = risk + F.when((F.regexp_count(text, F.lit(r"\|")) >= 2) | (F.regexp_count(text, F.lit(" - ")) >= 3), 0.2).otherwise(0.0)
    risk = risk + F.when(F.size(title_tokens) > 14, 0.1).otherwise(0.0)
    risk = risk - F.when(domain.isin("official", "academic"), 0.2).otherwise(0.0)
    return clamp(risk + penalty)


def spam_risk_sql(host: str, domain: str, title: str, snippet: str, title_tokens: str, penalty: str) -> str:
    text = fold_sql(f"concat_ws(' ', {title}, {snippet})")
    parts = [
        f"case when ends_with({host}, '.top') or ends_with({host}, '.best') then 0.6e0 else 0e0 end",
        f"case when {any_in_sql(text, K.SPAM_CUES)} then 0.25e0 else 0e0 end",
        f"case when len(regexp_extract_all({text}, '\\|')) >= 2 or len(regexp_extract_all({text}, ' - ')) >= 3 then 0.2e0 else 0e0 end",
        f"case when len({title_tokens}) > 14 then 0.1e0 else 0e0 end",
    ]
    return clamp_sql(f"{' + '.join(parts)} - case when {domain} in ('official', 'academic') then 0.2e0 else 0e0 end + {penalty}")


def by_kind(kind: Column, values: dict[str, float]) -> Column:
    out = F.lit(values["unknown"])
    for name, value in values.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def by_kind_sql(kind: str, values: dict[str, float]) -> str:
    return f"case {kind} " + " ".join(f"when '{k}' then {num(v)}" for k, v in values.items()) + f" else {num(values['unknown'])} end"


def primary_likelihood(kind: Column, title: Column, snippet: Column, url: Column, host_match: Column, boost: Column) -> Column:
    text = fold(F.concat_ws(" ", title, snippet, url))
    base = by_kind(kind, K.PRIMARY_BASE) + F.when(any_in(text, K.PRIMARY_CUES), 0.1).otherwise(0.0) + 0.18 * host_match
    base = base + F.when(any_in(text, K.PRIMARY_PATHS), 0.08).otherwise(0.0) - F.when(kind == "forum", 0.12).otherwise(0.0)
    return clamp(base + boost)


def primary_likelihood_sql(kind: str, title: str, snippet: str, url: str, host_match: str, boost: str) -> str:
    text = fold_sql(f"concat_ws(' ', {title}, {snippet}, {url})")
    cue, place = any_in_sql(text, K.PRIMARY_CUES), any_in_sql(text, K.PRIMARY_PATHS)
    return clamp_sql(f"{by_kind_sql(kind, K.PRIMARY_BASE)} + case when {cue} then 0.1e0 else 0e0 end + 0.18e0 * {host_match} + case when {place} then 0.08e0 else 0e0 end - case when {kind} = 'forum' then 0.12e0 else 0e0 end + {boost}")


def verification_bonus(kind: Column, title: Column, url: Column, bonus: Column) -> Column:
    text = fold(F.concat_ws(" ", title, url))
    return by_kind(kind, K.VERIFICATION_BASE) + F.when(any_in(text, K.RELEASE_CUES), 0.14).otherwise(0.0) - F.when(any_in(text, K.FORUM_CUES), 0.12).otherwise(0.0) + bonus


def verification_bonus_sql(kind: str, title: str, url: str, bonus: str) -> str:
    text = fold_sql(f"concat_ws(' ', {title}, {url})")
    return f"({by_kind_sql(kind, K.VERIFICATION_BASE)} + case when {any_in_sql(text, K.RELEASE_CUES)} then 0.14e0 else 0e0 end - case when {any_in_sql(text, K.FORUM_CUES)} then 0.12e0 else 0e0 end + {bonus})"


def freshness(needed: Column, published: Column, as_of: str) -> Column:
    """1 falling to 0 over 45 days where freshness is needed, else 365; fixed values where no date can be read."""
    day = F.try_to_timestamp(published).cast("date")
    age = F.greatest(F.datediff(F.lit(as_of).cast("date"), day), F.lit(0))
    window = F.when(needed, 45).otherwise(365)
    return F.when(day.isNotNull(), clamp(1 - age / window)).when(needed, 0.2).when(published.isNull(), 0.5).otherwise(0.35)


def freshness_sql(needed: str, published: str, as_of: str) -> str:
    day = f"try_cast({published} as date)"
    return f"case when {day} is not null then {clamp_sql(f'''1e0 - greatest(date_diff('day', {day}, date '{as_of}'), 0) / case when {needed} then 45 else 365 end''')} when {needed} then 0.2e0 when {published} is null then 0.5e0 else 0.35e0 end"


def time_alignment(scope: Column, title: Column, snippet: Column, url: Column, published: Column) -> Column:
    text = fold(F.concat_ws(" ", title, snippet, url))
    month = scope.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (F.substr(published, F.lit(1), F.lit(7)) == F.substr(scope, F.lit(1), F.lit(7)))
    return F.when(scope.isNull() | (scope == ""), 0.0).when(F.contains(text, fold(scope)) | F.startswith(published, scope), 1.0).when(month, 0.45).otherwise(0.0)


def time_alignment_sql(scope: str, title: str, snippet: str, url: str, published: str) -> str:
    text = fold_sql(f"concat_ws(' ', {title}, {snippet}, {url})")
    month = f"(regexp_full_match({scope}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and left({published}, 7) = left({scope}, 7))"
    return f"case when {scope} is null or {scope} = '' then 0e0 when contains({text}, {fold_sql(scope)}) or starts_with({published}, {scope}) then 1e0 when {month} then 0.45e0 else 0e0 end"


def host_match(entity_keys: Column, token_keys: Column, labels: Column) -> Column:
    """1 where an entity, compacted, is a label of the host; 0.95 where one of its words is; short ones do not count."""
    long = lambda keys: F.filter(keys, lambda k: F.length(k) >= 4)
    return F.when(F.arrays_overlap(long(entity_keys), labels), 1.0).when(F.arrays_overlap(long(token_keys), labels), 0.95).otherwise(0.0)
