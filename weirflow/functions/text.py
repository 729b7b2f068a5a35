"""Keywords, topics and sentiment of short texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weirflow.config import NOISE_TOPICS, SEED_TERMS, STOP_WORDS


def of_title_and_body(title: Column, body: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))


def title_else_body(title: Column, body: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), body, F.lit(""))


def first_distinct(words: Column, n: int) -> Column:
    return F.slice(F.array_distinct(words), 1, n)


def keywords(text: Column, most: int = 10) -> Column:
    """Words of letters, over 3 long and not on the stop list, in order of appearance."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return first_distinct(F.filter(F.split(F.lower(text), "\\s+"), lambda w: (F.length(w) > 3) & w.rlike("^\\p{L}+$") & ~F.array_contains(stop, w)), most)


def legacy_keywords(title: Column, most: int = 10) -> Column:
    """Words over 3 long, repeats included."""
    return F.slice(F.filter(F.split(F.lower(title), "\\s+"), lambda w: F.length(w) > 3), 1, most)


def clean_topics(topics: Column, most: int = 8) -> Column:
    """Trimmed, lower-cased, without noise, numbers and single characters; in order, once each."""
    noise = F.array(*map(F.lit, NOISE_TOPICS))
    plain = F.transform(topics, lambda t: F.lower(F.trim(t)))
    return first_distinct(F.filter(plain, lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$") & ~F.array_contains(noise, t)), most)


def seed_topics(text: Column, terms: tuple[str, ...] = SEED_TERMS, most: int = 8) -> Column:
    """Seed terms among the tokens, in order of appearance; a phrase of two tokens wins over its first."""
    single, pairs = F.array(*[F.lit(t) for t in terms if " " not in t]), F.array(*[F.lit(t) for t in terms if " " in t]).cast("array<string>")
    tokens = F.split(F.lower(text), "[^\\p{L}\\p{N}]+")

    def found(all_tokens: Column) -> Column:
        def of(w: Column, i: Column) -> Column:
            pair = F.concat_ws(" ", w, F.get(all_tokens, i + 1))
            return F.when(F.array_contains(pairs, pair), pair).when(F.array_contains(single, w), w)

        return F.array_compact(F.transform(all_tokens, of))

    return first_distinct(F.element_at(F.transform(F.array(tokens), found), 1), most)


def parsed_topics(text: Column) -> Column:
    """A JSON list of topics; empty where it can't be read."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


#: A small English lexicon with its boosters and negations; a caller passes a fuller one.
LEXICON = {"good": 1.9, "great": 3.1, "love": 3.2, "best": 3.2, "happy": 2.7, "win": 2.8, "nice": 1.8, "bad": -2.5, "terrible": -2.1, "hate": -2.7, "worst": -3.1, "sad": -2.1, "fail": -2.5, "worthless": -1.9, "idiot": -2.3}
BOOSTERS = {"very": 0.293, "really": 0.293, "extremely": 0.293, "slightly": -0.293, "barely": -0.293}
NEGATIONS = frozenset({"not", "no", "never", "isn't", "don't", "won't", "can't", "without"})


PUNCTUATION = ".,;:!?\"()"
#: What a booster adds one, two and three words before; what a negation turns a valence by; words that are looked back on.
FADE, TURN, REACH = (1.0, 0.95, 0.9), -0.74, 3


def compound(text: str | None, lexicon: dict[str, float]) -> float:
    """The score of one text in plain Python, for a caller's scorer to build on."""
    words, total = [w.strip(PUNCTUATION) for w in (text or "").lower().split()], 0.0
    for i, w in enumerate(words):
        v = lexicon.get(w, 0.0)
        if v:
            before = words[max(0, i - REACH) : i][::-1]
            for b, fade in zip(before, FADE, strict=False):
                v += BOOSTERS.get(b, 0.0) * fade * (1 if v > 0 else -1)
            total += v * (TURN if NEGATIONS & set(before) else 1)
    return round(total / (total * total + 15) ** 0.5, 4)


def scored(text: Column, scorer) -> Column:
    """The scores of ``scorer`` (text -> float)."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(scorer).astype("float64")

    return of(F.coalesce(text, F.lit("")))


def sentiment(text: Column, lexicon: dict[str, float] | None = None, scorer=None) -> Column:
    """Compound score in [-1, 1] of the whole text: summed valences, raised by boosters and turned by negations up to three
    words before, as s / sqrt(s^2 + 15), rounded to 4. Functions only; a ``scorer`` (text -> float) takes their place."""
    if scorer:
        return scored(text, scorer)
    lexicon = lexicon or LEXICON
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    tokens = F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "\\s+"), ""), lambda w: F.btrim(w, F.lit(PUNCTUATION)))

    def total(w: Column) -> Column:
        hits = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("at"), F.element_at(table(lexicon), x).alias("v"))), lambda h: h["v"].isNotNull())

        def turned(h: Column) -> Column:
            before = [F.coalesce(F.get(w, h["at"] - 1 - d), F.lit("")) for d in range(REACH)]
            v = h["v"]
            for word, fade in zip(before, FADE, strict=True):
                v = v + F.coalesce(F.element_at(table(BOOSTERS), word), F.lit(0.0)) * F.lit(fade) * F.signum(h["v"])
            negated = F.arrays_overlap(F.array(*before), F.array(*map(F.lit, sorted(NEGATIONS))))
            return v * F.when(negated, F.lit(TURN)).otherwise(F.lit(1.0))

        return F.aggregate(F.transform(hits, turned), F.lit(0.0), lambda a, v: a + v)

    s = F.element_at(F.transform(F.array(tokens), total), 1)
    return F.element_at(F.transform(F.array(s), lambda x: F.round(x / F.sqrt(x * x + 15), 4)), 1)


def sentiment_sql(lexicon: dict[str, float]) -> str:
    """A DuckDB twin over ``documents``, by words as rows."""
    quoted = lambda w: "'" + w.replace("'", "''") + "'"
    values = lambda d: ", ".join(f"({quoted(k)}, {v}::DOUBLE)" for k, v in d.items())
    steps = " + ".join(f"coalesce(b{d + 1}.v, 0.0) * {fade}::DOUBLE * sign(l.v)" for d, fade in enumerate(FADE))
    return f"""SELECT doc_id, compound AS sentiment_compound, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM (
  SELECT d.doc_id, round(coalesce(s, 0.0) / sqrt(coalesce(s, 0.0) * coalesce(s, 0.0) + 15), 4) AS compound FROM documents d LEFT JOIN (
    SELECT doc_id, list_sum(list((l.v + {steps}) * CASE WHEN list_has_any([p1, p2, p3], [{", ".join(map(quoted, sorted(NEGATIONS)))}]) THEN {TURN}::DOUBLE ELSE 1.0::DOUBLE END ORDER BY place)) AS s
    FROM (SELECT *, lag(word, 1, '') OVER w AS p1, lag(word, 2, '') OVER w AS p2, lag(word, 3, '') OVER w AS p3 FROM (
      SELECT doc_id, i AS place, trim(words[i], '{PUNCTUATION}') AS word FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS words FROM documents))) WINDOW w AS (PARTITION BY doc_id ORDER BY place)) t
    JOIN (VALUES {values(lexicon)}) l(word, v) ON l.word = t.word LEFT JOIN (VALUES {values(BOOSTERS)}) b1(word, v) ON b1.word = p1 LEFT JOIN (VALUES {values(BOOSTERS)}) b2(word, v) ON b2.word = p2 LEFT JOIN (VALUES {values(BOOSTERS)}) b3(word, v) ON b3.word = p3
    GROUP BY doc_id) USING (doc_id))"""


def model_topics(text: Column, load_model, most: int = 8) -> Column:
    """Topics of a caller's entity model: ``load_model()`` gives a function from a list of texts to lists of names, once a worker."""

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for batch in batches:
            yield pd.Series(model([t[:1000] for t in batch]))

    return clean_topics(found(F.coalesce(text, F.lit(""))), most)
