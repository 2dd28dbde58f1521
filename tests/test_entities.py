"""Entities and regions as column expressions against a loop over the words of one text."""

import random
import re

import duckdb
import pandas as pd

from tessera.functions import constants as K
from tessera.functions import entities as N

_WORD = re.compile(r"[^\W_][^\W_]*(?:[.+/\-_']*[^\W_]+)*[.+/\-_']*")
_QUOTED = re.compile(r'"([^"]*)"|“([^”]*)”|«([^»]*)»')
_STOP, _NO, _JOIN, _PLACE = frozenset(K.STOP_WORDS), frozenset(K.NO_ENTITIES), frozenset(K.ENTITY_JOINERS), frozenset(K.REGION_PREPOSITIONS)


def _bare(word: str) -> str:
    return word.rstrip(".+/-_'")


def _is_name(word: str) -> bool:
    w = _bare(word)
    if not w or w.casefold() in _NO:
        return False
    return w.isupper() or w[0].isupper() or (w[0].isdigit() and any(c.isupper() for c in w))


def _good(candidate: str) -> bool:
    own = [w for w in (_bare(x).casefold() for x in _WORD.findall(candidate)) if len(w) > 1 and w not in _STOP]
    return len(candidate) > 1 and candidate.casefold() not in _NO and any(w not in _NO for w in own)


def find_entities(text: str | None, most: int = 6) -> list[str]:
    """Quoted segments, then runs of up to four name words with joining words inside; each run from each of its words."""
    text = text or ""
    found = [s for s in (" ".join("".join(m.groups("")).split()) for m in _QUOTED.finditer(text)) if 2 <= len(s) <= 80]
    spans = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text)]
    near = [k + 1 < len(spans) and not text[spans[k][2] : spans[k + 1][1]].strip() for k in range(len(spans))]
    for first, (word, *_) in enumerate(spans):
        if not _is_name(word):
            continue
        run, k = [word], first
        while len(run) < 4 and near[k]:
            following = spans[k + 1][0]
            if _bare(following).casefold() in _JOIN:
                if not (near[k + 1] and _is_name(spans[k + 2][0])):
                    break
            elif not _is_name(following):
                break
            run.append(following)
            k += 1
        candidate = " ".join(run)
        if _good(candidate):
            found.append(candidate)
    first: dict[str, str] = {}
    for e in found:
        first.setdefault(e.casefold(), e)
    return list(first.values())[:most]


def find_region(text: str | None) -> str | None:
    """Up to three capitalised words behind a preposition of place, the first such run; else null."""
    words = [_bare(w) for w in _WORD.findall(text or "")]
    for k, w in enumerate(words):
        if w.casefold() in _PLACE:
            run = []
            for v in words[k + 1 : k + 4]:
                if not v or v.casefold() in _STOP or not v[0].isupper():
                    break
                run.append(v)
            if run:
                return " ".join(run)
    return None


def some():
    r = random.Random(6)
    words = ["Bank", "of", "America", "and", "the", "Goldman", "met", "in", "New", "York", "X1", "GPT-4.1", "4K", "U.S.", "what", "What", "for", "Astana", "в", "Алматы", "и", "Банк", "Ünited", "a", "I", "2026", "March", "OpenAI", "rock-n-roll", "C++"]
    between = [" ", " ", " ", "  ", ", ", ". ", " (", "\n", " — ", '" ', ' "', " «", "» ", "/"]
    texts = ["".join(r.choice(words) + r.choice(between) for _ in range(r.randint(0, 30))) for _ in range(400)]
    return [None, "", "   ", '""', '"x"', '"  a  b "', '"' + "long " * 30 + '"', *texts, "Name " * 3000]


def test_against_a_loop_over_words(spark):
    rows = list(enumerate(some()))
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    got = {r.id: (r.e, r.g) for r in df.select("id", N.entities(df.text).alias("e"), N.region_hint(df.text).alias("g")).collect()}
    for k, text in rows:
        assert got[k] == (find_entities(text), find_region(text)), text
    t = pd.DataFrame(rows[:-1], columns=["id", "text"])  # noqa: F841  (the SQL reads it)
    for k, e, g in duckdb.sql(f"select id, {N.entities_sql('text')}, {N.region_hint_sql('text')} from t").fetchall():
        assert (e, g) == got[k], rows[k]


def test_known_texts():
    assert {"OpenAI", "GPT-4.1"} <= set(find_entities('What did OpenAI announce about "GPT-4.1" in March 2026?'))
    assert find_entities("Bank of America and Goldman Sachs met")[0].startswith("Bank of America")
    assert find_region("what happened in Astana today") == "Astana" and find_region("latest developments in artificial intelligence") is None
