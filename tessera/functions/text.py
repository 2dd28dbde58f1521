"""Text functions as column expressions, each with the SQL text that says the same.

Functions named `x` build Spark columns; `x_sql` builds the expression in the dialect of the checking engine. Case is
folded as lower case with the sharp s written out; other special foldings are not made.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import constants as K

WORD = r"[\p{L}\p{N}][\p{L}\p{N}.+/\-_']*"
#: A word without the marks at its end.
BARE_WORD = r"[\p{L}\p{N}](?:[\p{L}\p{N}.+/\-_']*[\p{L}\p{N}])?"
DAY = r"^(0?[1-9]|[12][0-9]|3[01])$"


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strings_sql(values: Sequence[str]) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, wherever body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_in(text: Column, values: Sequence[str]) -> Column:
    """Any of the values stands in the text."""
    out = F.contains(text, F.lit(values[0]))
    for v in values[1:]:
        out = out | F.contains(text, F.lit(v))
    return out


def any_in_sql(text: str, values: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains({text}, {quoted(v)})" for v in values) + ")"


def fold(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def fold_sql(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def normalized(x: Column) -> Column:
    """White space runs to one space, none at the ends; null to empty. Single spaces, which most are, are passed over."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U) \s+|[\s&&[^ ]]\s*", " "))


def normalized_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def compact(x: Column) -> Column:
    return F.regexp_replace(fold(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def compact_sql(x: str) -> str:
    return f"regexp_replace({fold_sql(f'''coalesce({x}, '')''')}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def is_cyrillic(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).rlike("[а-яА-ЯёЁ]")


def is_cyrillic_sql(x: str) -> str:
    return f"regexp_matches(coalesce({x}, ''), '[а-яА-ЯёЁ]')"


def words(x: Column) -> Column:
    """Word spans cleaned at their ends, case kept."""
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(BARE_WORD), F.lit(0))


def words_sql(x: str) -> str:
    word = WORD.replace("'", "''")
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '{word}'), lambda t: regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+$', ''))"


def folded_words(w: Column) -> Column:
    """A word array in folded case; one empty word where it is empty. All are folded at once, behind a sign that no word holds."""
    return F.split(fold(F.array_join(w, "\u0001")), "\u0001")


def is_token(t: Column) -> Column:
    return (F.length(t) > 1) & ~t.isin(*K.STOP_WORDS)


def tokens_of(w: Column) -> Column:
    """The tokens among the words of a text, where a column holds these."""
    return F.filter(folded_words(w), is_token)


def tokens(x: Column) -> Column:
    """Folded words of two characters and more that are no stop words; order and repeats stay."""
    return tokens_of(words(x))


def tokens_sql(x: str) -> str:
    return f"list_filter(list_transform({words_sql(x)}, lambda t: {fold_sql('t')}), lambda t: length(t) > 1 and not list_contains({strings_sql(K.STOP_WORDS)}, t))"


def numbers_of(w: Column) -> Column:
    """The numbers among the words of a text, where a column holds these."""
    return F.filter(w, lambda t: (t < ":") & t.rlike(r"^[0-9]*[.,]?[0-9]*$") & t.rlike("[0-9]"))  # most words end at the first test


def numbers(x: Column) -> Column:
    return numbers_of(words(x))


def numbers_sql(x: str) -> str:
    return f"list_filter({words_sql(x)}, lambda t: regexp_full_match(t, '[0-9]*[.,]?[0-9]*') and regexp_matches(t, '[0-9]'))"


def sentences(x: Column, collapsed: bool = False) -> Column:
    """Split behind runs of . ! ? (not at a dot between digits); pieces are normalised and empty ones dropped.

    collapsed says that the text is normalised, so its pieces need only be trimmed.
    """
    marked = F.regexp_replace(F.coalesce(x, F.lit("")), r"((?:(?<![0-9])\.|\.(?![0-9])|[!?])[.!?]*+)\s*", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), (lambda s: F.trim(s)) if collapsed else normalized), lambda s: s != "")


def sentences_sql(x: str) -> str:
    held = f"coalesce({x}, '')"
    for _ in range(2):
        held = f"regexp_replace({held}, '([0-9])\\.([0-9])', '\\1' || chr(2) || '\\2', 'g')"
    marked = f"regexp_replace({held}, '([.!?][.!?' || chr(2) || ']*)\\s*', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {normalized_sql('''replace(s, chr(2), '.')''')}), lambda s: s <> '')"


def is_year(t: Column) -> Column:
    return F.startswith(t, F.lit("20")) & t.rlike("^20[0-9]{2}$")


def time_scope(words: Column) -> Column:
    """The first date-like words of a word array: an ISO day, a quarter, a named day, or a year; else null."""

    def read(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 1)

        def at(i: Column, k: int) -> Column:
            return F.get(w, i + k)

        def quarter(i: Column) -> Column:
            return F.when(fold(at(i, 0)).isin("q1", "q2", "q3", "q4") & is_year(at(i, 1)), F.concat_ws(" ", at(i, 0), at(i, 1)))

        def day(i: Column) -> Column:
            a, b = at(i, 0), at(i, 1)
            dated = (a.rlike(DAY) & fold(b).isin(*K.MONTHS)) | (fold(a).isin(*K.MONTHS) & b.rlike(DAY))
            return F.when(is_year(at(i, 2)) & dated, F.concat_ws(" ", a, b, at(i, 2)))

        def first(found: Column) -> Column:
            return F.get(F.filter(found, lambda t: t.isNotNull()), F.lit(0))

        # quarters and named days end in a year
        by_year = F.when(F.exists(w, is_year), F.coalesce(first(F.transform(places, quarter)), first(F.transform(places, day)), first(F.filter(w, is_year))))
        return F.coalesce(first(F.filter(w, lambda t: (t < ":") & t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))), by_year)

    return let(words, read)


def time_scope_sql(w: str) -> str:
    day = DAY.strip("^$")
    months = strings_sql(K.MONTHS)
    quarter = f"list_filter(list_transform(generate_series(1, len({w})), lambda i: case when lower({w}[i]) in ('q1', 'q2', 'q3', 'q4') and regexp_full_match({w}[i + 1], '20[0-9]{{2}}') then {w}[i] || ' ' || {w}[i + 1] end), lambda t: t is not null)[1]"
    dated = f"((regexp_full_match({w}[i], '{day}') and list_contains({months}, {fold_sql(w + '[i + 1]')})) or (list_contains({months}, {fold_sql(w + '[i]')}) and regexp_full_match({w}[i + 1], '{day}')))"
    named = f"list_filter(list_transform(generate_series(1, len({w})), lambda i: case when {dated} and regexp_full_match({w}[i + 2], '20[0-9]{{2}}') then {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2] end), lambda t: t is not null)[1]"
    iso = f"list_filter({w}, lambda t: regexp_full_match(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'))[1]"
    year = f"list_filter({w}, lambda t: regexp_full_match(t, '20[0-9]{{2}}'))[1]"
    return f"coalesce({iso}, {quarter}, {named}, {year})"


def needs_freshness(x: Column) -> Column:
    return any_in(fold(F.coalesce(x, F.lit(""))), K.FRESH_MARKERS)


def should_decompose(x: Column) -> Column:
    text = F.coalesce(x, F.lit(""))
    low = fold(text)
    return any_in(low, (*K.COMPARISON_MARKERS, " and ", " и ")) | (F.length(text) > 90) | (F.regexp_count(text, F.lit(r"\?")) > 1)


def looks_like_synthesis(x: Column) -> Column:
    text = F.trim(fold(F.coalesce(x, F.lit(""))))
    return F.exists(strings(K.SYNTHESIS_OPENINGS), lambda p: F.startswith(text, p))


def has_negation(x: Column, folded_tokens: Column) -> Column:
    return F.arrays_overlap(folded_tokens, strings(K.NEGATION_TOKENS)) | any_in(fold(F.coalesce(x, F.lit(""))), ("debunked", "contradict"))


#: Words and what stands between them; together the whole text.
PIECE = WORD + r"|[^\p{L}\p{N}]+"
#: The same with a word and what stands before it as one piece, and such a piece with a day word in any case and marks behind it.
_GAP = r"[^\p{L}\p{N}]*+"
_GAP_WORD = _GAP + WORD + r"|[^\p{L}\p{N}]+"
_DAY_WORD = "^" + _GAP + "(?:" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in K.RELATIVE_DAYS) + r")[.+/\-_']*$"


def relative_days(x: Column, as_of: Column) -> Column:
    """Day words replaced by ISO dates relative to the day as_of: a struct of the text and of spans (start from 0, length, day).

    A text is read once as words and what stands between them; a word with marks behind it keeps none of them. Places and
    lengths are those of the text before, in code points. Only day words are gone through one by one, with what stands before each.
    """
    days = F.create_map(*[F.lit(v) for pair in K.RELATIVE_DAYS.items() for v in pair])
    day = lambda word: F.date_format(F.date_add(as_of.cast("date"), F.element_at(days, fold(F.regexp_replace(word, r"[^\p{L}\p{N}]+", "")))), "yyyy-MM-dd")
    none = F.array().cast("array<struct<start: int, length: int, day: string>>")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"), none.alias("spans"))

    def read(pieces: Column) -> Column:
        def put(a: Column, met: Column) -> Column:
            gap = F.regexp_extract(met["p"], "^" + _GAP, 0)
            before = F.concat(F.array_join(F.slice(pieces, a["i"] + 1, met["i"] - a["i"]), ""), gap)
            known = F.struct(before.alias("before"), (a["at"] + F.length(before)).alias("at"), (F.length(met["p"]) - F.length(gap)).alias("n"), day(met["p"]).alias("day"))
            return let(
                known,
                lambda k: F.struct(
                    (met["i"] + 1).alias("i"), (k["at"] + k["n"]).alias("at"), F.concat(a["out"], F.array(F.concat(k["before"], k["day"]))).alias("out"),
                    F.concat(a["spans"], F.array(F.struct(k["at"].alias("start"), k["n"].alias("length"), k["day"].alias("day")))).alias("spans"),
                ),
            )

        def end(a: Column) -> Column:
            return F.struct(F.concat(F.array_join(a["out"], ""), F.array_join(F.slice(pieces, a["i"] + 1, F.size(pieces) - a["i"]), "")).alias("text"), a["spans"].alias("spans"))

        met = F.filter(F.transform(pieces, lambda p, i: F.when(p.rlike(_DAY_WORD), F.struct(i.alias("i"), p.alias("p")))), lambda d: d.isNotNull())
        return F.aggregate(met, start, put, end)

    return let(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(_GAP_WORD), F.lit(0)), read)


def relative_days_sql(x: str, as_of: str) -> str:
    """SQL: the pieces of a text as structs of at (from 0), p and day (null: kept)."""
    bare = fold_sql("regexp_replace(p, '[^\\p{L}\\p{N}]+$', '')")
    day = " ".join(f"when {quoted(k)} then strftime({as_of} + {v}, '%Y-%m-%d')" for k, v in K.RELATIVE_DAYS.items())
    pieces = f"regexp_extract_all(coalesce({x}, ''), {quoted(PIECE)})"
    return f"list_transform([{{'m': {pieces}}}], lambda y: list_transform(y.m, lambda p, i: {{'at': coalesce(list_sum(list_transform(y.m[1:i - 1], lambda q: length(q))), 0)::bigint, 'p': p, 'day': case {bare} {day} end}}))[1]"


def author(x: Column) -> Column:
    """What stands behind the first author mark that begins a line within the first 600 characters; else null."""
    lines = F.transform(F.split(F.substr(F.coalesce(x, F.lit("")), F.lit(1), F.lit(600)), "\r\n|\r|\n"), lambda line: F.trim(line))
    marked = F.filter(lines, lambda line: F.exists(strings(K.AUTHOR_MARKERS), lambda m: F.startswith(fold(line), m)))
    return normalized_or_null(F.regexp_replace(F.get(marked, F.lit(0)), "^[^:]*:", ""))


def normalized_or_null(x: Column) -> Column:
    return F.when(x.isNotNull(), normalized(x))


def markdown_title(x: Column) -> Column:
    """The first line that begins with #, without its marks; else null."""
    lines = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "\r\n|\r|\n"), lambda line: F.trim(line)), lambda line: F.startswith(line, F.lit("#")))
    return normalized_or_null(F.regexp_replace(F.get(lines, F.lit(0)), "^#+", ""))


def slug(x: Column, limit: int = 64) -> Column:
    dashed = F.regexp_replace(fold(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "-")
    cut = F.substr(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(1), F.lit(limit))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("query"))


def citation_groups(x: Column) -> Column:
    """`[1, 2; 3]` to `[1][2][3]` where a bracket holds two numbers or more and only digits, commas, semicolons, spaces."""
    parts = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\[[^\]]*\]|[^\[]+|\["), F.lit(0))
    numbers_of = lambda p: F.regexp_extract_all(p, F.lit("([0-9]+)"), F.lit(1))
    split_up = F.transform(parts, lambda p: F.when(p.rlike(r"^\[[0-9,; ]*\]$") & (F.size(numbers_of(p)) > 1), F.array_join(F.transform(numbers_of(p), lambda n: F.concat(F.lit("["), n, F.lit("]"))), "")).otherwise(p))
    return F.array_join(split_up, "")


def citation_indices(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda n: n.cast("long"))))


def match_tokens(x: Column) -> Column:
    stop = strings(K.MATCH_STOP_WORDS)
    return F.filter(F.split(fold(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & ~F.array_contains(stop, t))


def simplified_query(x: Column) -> Column:
    """Quotes and question marks to spaces, the words or/and dropped; the query itself where nothing is left."""
    kept = F.filter(F.split(normalized(F.translate(F.coalesce(x, F.lit("")), '"“”?', "    ")), " "), lambda t: ~fold(t).isin("or", "and"))
    return F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), x)


def suggested_profile(x: Column) -> Column:
    low, cyrillic = F.lower(F.coalesce(x, F.lit(""))), is_cyrillic(x)
    has = {k: any_in(low, v) for k, v in K.PROFILE_WORDS.items()}
    return (
        F.when(has["news"] & has["fresh"], F.when(cyrillic, "ru_news_fresh").otherwise("news_fresh"))
        .when(has["news"], F.when(cyrillic, "ru_news").otherwise("news"))
        .when(has["science"], "science")
        .when(has["qa"], "it_qa")
        .when(has["repos"], "it_repos")
        .when(has["tech"] & has["release"], "web")
        .when(has["tech"], "tech")
        .when(cyrillic, "ru")
        .otherwise("web")
    )


def keyword_intent(x: Column) -> Column:
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.when(any_in(low, K.INTENT_NEWS), "news_digest").when(any_in(low, K.INTENT_SYNTHESIS), "synthesis").otherwise("factual")


def preview(x: Column, limit: int) -> Column:
    text = normalized(x)
    return F.when(text == "", "(empty)").when(F.length(text) <= limit, text).otherwise(F.concat(F.substr(text, F.lit(1), F.lit(limit - 1)), F.lit("…")))
