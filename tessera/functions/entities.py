"""Entities and regions in a text: a grammar over its words as column expressions, with the SQL that says the same.

A text is read as an array of words and of what else stands between them; a run of names ends where anything but white
space stands between two words. Whether a run goes on is said for each word from the next two, so every run, at most `RUN`
words from each of its words, is a slice of that array. Arrays are bound once (`T.let`), whatever is said about them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import text as T

RUN, MOST, PLACES, QUOTE_CHARS = 4, 6, 3, (2, 80)
_SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Words, or signs that are neither white space nor part of a word.
_PIECE = T.WORD + "|[^" + r"\p{L}\p{N}" + _SPACE + "]+"
_QUOTED = '"[^"]*"|“[^”]*”|«[^»]*»'
_TAIL = r"[.+/\-_']+$"
_NAME = r"^\p{Lu}|^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$|^\p{Nd}.*\p{Lu}"


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, _TAIL, "")


def _is_word(piece: Column) -> Column:
    return F.coalesce(piece.rlike(r"^[\p{L}\p{N}]"), F.lit(False))


def _is_name(piece: Column) -> Column:
    """A name has a capital letter, which most pieces lack."""
    return F.when(piece.rlike(r"\p{Lu}"), _is_word(piece) & T.let(_bare(piece), lambda w: ~T.fold(w).isin(*K.NO_ENTITIES) & w.rlike(_NAME))).otherwise(F.lit(False))


def _joins(piece: Column) -> Column:
    return _is_word(piece) & T.fold(_bare(piece)).isin(*K.ENTITY_JOINERS)


def _good(candidate: Column) -> Column:
    """Whether a candidate is more than one character and has a word of two that is neither a stop word nor no entity."""
    no = K.NO_ENTITIES
    own = F.transform(F.regexp_extract_all(candidate, F.lit(T.WORD), F.lit(0)), lambda w: T.fold(_bare(w)))
    told = lambda w: T.is_token(w) & ~w.isin(*no)
    return (F.length(candidate) > 1) & ~T.fold(candidate).isin(*no) & F.exists(own, told)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECE), F.lit(0))


def _runs(text: Column) -> Column:
    """The runs of name words of a text, one from each name word, in order."""
    marked = F.transform(_pieces(text), lambda p: F.struct(p.alias("p"), _is_name(p).alias("name")))

    def read(m: Column) -> Column:
        def goes_on(i: Column) -> Column:
            after = F.get(m, i)
            return F.coalesce(F.when(_joins(after["p"]), F.get(m, i + 1)["name"]).otherwise(after["name"]), F.lit(False))

        def run(i: Column) -> Column:
            n = F.lit(1)
            steps = [goes_on(i + k) for k in range(1, RUN)]
            for k in range(RUN - 1, 0, -1):
                n = F.when(steps[k - 1], n + 1).otherwise(F.lit(1)) if k < RUN - 1 else F.when(steps[k - 1], 2).otherwise(1)
            return F.when(F.get(m, i)["name"], F.array_join(F.slice(m, i + 1, n)["p"], " "))

        places = F.when(F.size(m) > 0, F.sequence(F.lit(0), F.size(m) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(places, run), lambda c: c.isNotNull() & _good(c))

    return T.let(marked, read)


def entities(text: Column) -> Column:
    """Quoted segments, then runs of up to four name words with joining words inside; the first of equal ones, at most six."""
    quotes = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_QUOTED), F.lit(0)), lambda q: T.normalized(F.substr(q, F.lit(2), F.length(q) - 2)))
    some = F.filter(quotes, lambda q: F.length(q).between(*QUOTE_CHARS))
    keyed = T.let(F.concat(some, _runs(text)), lambda f: F.struct(f.alias("e"), F.transform(f, T.fold).alias("keys")))
    return T.let(keyed, lambda f: F.transform(F.slice(F.array_distinct(f["keys"]), 1, MOST), lambda k: F.get(f["e"], (F.array_position(f["keys"], k) - 1).cast("int"))))


def region_hint(text: Column) -> Column:
    """Up to three capitalised words behind a preposition of place, the first such run; else null."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(T.WORD), F.lit(0)), _bare)
    marked = F.transform(words, lambda w: F.struct(w.alias("w"), F.array_contains(T.strings(K.REGION_PREPOSITIONS), T.fold(w)).alias("place"), (w.rlike(r"^\p{Lu}") & ~F.array_contains(T.strings(K.STOP_WORDS), T.fold(w))).alias("up")))

    def read(m: Column) -> Column:
        def up(i: Column) -> Column:
            return F.coalesce(F.get(m, i)["up"], F.lit(False))

        def run(i: Column) -> Column:
            n = F.when(up(i + 1) & up(i + 2), F.when(up(i + 3), 3).otherwise(2)).otherwise(1)
            return F.when(F.get(m, i)["place"] & up(i + 1), F.array_join(F.slice(m, i + 2, n)["w"], " "))

        places = F.when(F.size(m) > 0, F.sequence(F.lit(0), F.size(m) - 1)).otherwise(F.array().cast("array<int>"))
        return F.get(F.filter(F.transform(places, run), lambda r: r.isNotNull()), F.lit(0))

    return T.let(marked, read)


def _re(pattern: str) -> str:
    return T.quoted(pattern)


def entities_sql(text: str) -> str:
    """The same as `entities`, as one expression."""
    bare = lambda w: f"regexp_replace({w}, {_re(_TAIL)}, '')"
    no, stop = T.strings_sql(K.NO_ENTITIES), T.strings_sql(K.STOP_WORDS)
    word = lambda p: f"regexp_matches({p}, {_re(r'^[\p{L}\p{N}]')})"
    marked = f"list_transform(regexp_extract_all(coalesce({text}, ''), {_re(_PIECE)}), lambda p: {{'p': p, 'n': {word('p')} and not list_contains({no}, {T.fold_sql(bare('p'))}) and regexp_matches({bare('p')}, {_re(_NAME)}), 'j': {word('p')} and list_contains({T.strings_sql(K.ENTITY_JOINERS)}, {T.fold_sql(bare('p'))})}})"
    on = lambda k: f"coalesce(case when y.m[i + {k}].j then y.m[i + {k + 1}].n else y.m[i + {k}].n end, false)"
    length = "1"
    for k in range(RUN - 1, 0, -1):
        length = f"case when {on(k)} then 1 + {length} else 1 end"
    runs = f"list_transform(list_filter(range(1, len(y.m) + 1), lambda i: y.m[i].n), lambda i: array_to_string(list_transform(y.m[i:i + {length} - 1], lambda z: z.p), ' '))"
    own = f"list_transform(regexp_extract_all(c, {_re(T.WORD)}), lambda w: {T.fold_sql(bare('w'))})"
    good = f"length(c) > 1 and not list_contains({no}, {T.fold_sql('c')}) and len(list_filter({own}, lambda w: length(w) > 1 and not list_contains({stop}, w) and not list_contains({no}, w))) > 0"
    names = f"list_transform([{{'m': {marked}}}], lambda y: list_filter({runs}, lambda c: {good}))[1]"
    quotes = f"list_filter(list_transform(regexp_extract_all(coalesce({text}, ''), {_re(_QUOTED)}), lambda q: {T.normalized_sql('q[2:-2]')}), lambda q: length(q) between {QUOTE_CHARS[0]} and {QUOTE_CHARS[1]})"
    unique = f"list_filter(f.all, lambda e, i: list_position(list_transform(f.all, lambda o: {T.fold_sql('o')}), {T.fold_sql('e')}) = i)"
    return f"list_transform([{{'all': list_concat({quotes}, {names})}}], lambda f: {unique})[1][1:{MOST}]"


def region_hint_sql(text: str) -> str:
    """The same as `region_hint`, as one expression."""
    bare = f"regexp_replace(p, {_re(_TAIL)}, '')"
    marked = f"list_transform(list_transform(regexp_extract_all(coalesce({text}, ''), {_re(T.WORD)}), lambda p: {bare}), lambda w: {{'w': w, 'p': list_contains({T.strings_sql(K.REGION_PREPOSITIONS)}, {T.fold_sql('w')}), 'u': regexp_matches(w, {_re(r'^\p{Lu}')}) and not list_contains({T.strings_sql(K.STOP_WORDS)}, {T.fold_sql('w')})}})"
    up = lambda k: f"coalesce(y.m[i + {k}].u, false)"
    n = f"case when {up(1)} and {up(2)} then case when {up(3)} then 3 else 2 end else 1 end"
    return f"list_transform([{{'m': {marked}}}], lambda y: list_transform(list_filter(range(1, len(y.m) + 1), lambda i: y.m[i].p and {up(1)}), lambda i: array_to_string(list_transform(y.m[i + 1:i + {n}], lambda z: z.w), ' ')))[1][1]"
