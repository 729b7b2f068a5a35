"""Quality rules at host level.

Every document is measured on its whole text; the base rules fail it for too few words or too much repetition. Failures are
aggregated by host, each host's rate is shrunk by a beta prior fitted to all hosts (moments, weighted by documents), and a
host whose shrunk rate is over ``max_rate`` is rejected with all its documents; its verdict is joined back to them.

DataFrame functions only. The measures are expressions inside a row, so repeated windows are found without exploding the
text; per-host sums are built on the map side, so a hot host costs one row a task; the measures are checkpointed narrow
(no text) and read twice. The host table is counted and broadcast below a limit; beyond, Spark joins it by shuffle and splits
hot hosts.

Defined results: a null or empty text has no words and fails; a null host is a host of its own; repeated rows count each;
an empty table gives an empty result; extra columns are not looked at; ties cannot arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import SPACE, bind, reliable, text_of, unused, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Hosts up to which a table of them is broadcast (some 50 MB); beyond, it joins by shuffle and hot hosts are split.
BROADCAST_HOSTS = 500_000


def repeated_words(w: Column) -> Column:
    """Words that lie in a window of WINDOW words which the text holds twice or more."""
    windows = bind(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, WINDOW)])))

    def covered(g: Column) -> Column:
        by_hash = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        again = bind(by_hash, lambda s: F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))))
        places = F.sort_array(F.transform(again, lambda e: e["at"]))
        parts = bind(places, lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1), x + WINDOW) - x)))
        return F.aggregate(parts, F.lit(0), lambda a, b: a + b)

    return bind(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))


def measures(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    t = text_of(text)
    lines = F.filter(F.split(t, "\n"), lambda line: F.translate(line, SPACE, "") != "")
    counts = bind(words(t), lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    return {
        "counts": counts,
        "word_chars": F.length(F.translate(t, SPACE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def failed(n_words: Column, n_repeat_words: Column, least_words: int = 20, most_repeated: int = 30) -> Column:
    """The base rules."""
    return (n_words < least_words) | (100 * n_repeat_words > most_repeated * n_words)


def host_verdicts(rows: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """host, docs, failures, rate (shrunk) and host_kept, from rows of (host, base_failed)."""
    hosts = reliable(rows.groupBy("host").agg(F.count("*").alias("docs"), F.count_if("base_failed").alias("failures")))
    mean = F.sum("failures") / F.sum("docs")
    mean, total = hosts.agg(mean.cast("double"), F.sum("docs")).first()
    if not total:
        return hosts.withColumns({"rate": F.lit(0.0), "host_kept": F.lit(True)})
    off = F.col("failures") / F.col("docs") - F.lit(float(mean))
    spread = hosts.agg(F.sum(F.col("docs") * off * off) / F.lit(float(total))).first()[0]
    strength = min(1e6, max(1.0, mean * (1 - mean) / spread - 1)) if spread else 1e6
    rate = (F.col("failures") + F.lit(mean * strength)) / (F.col("docs") + F.lit(strength))
    return hosts.withColumn("rate", rate).withColumn("host_kept", F.col("rate") <= max_rate)


def sized(hosts: DataFrame) -> DataFrame:
    """The table, marked for broadcast if it is counted small."""
    return F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts


def assess(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """doc_id, host, the measures, base_failed, the host's shrunk failure rate, and kept."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), *[c.alias(k) for k, c in measures(F.col(text)).items()])
    rows = rows.select("doc_id", "host", F.col("counts.n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("counts.n_repeat_words").cast("long").alias("n_repeat_words"))
    rows = reliable(rows.withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words"))))
    verdicts = host_verdicts(rows, max_rate).select(F.col("host").alias("of"), F.col("rate").alias("host_rate"), "host_kept")
    joined = rows.join(sized(verdicts), F.col("host").eqNullSafe(F.col("of")), "left").drop("of")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("host_kept")


def keep_good(docs: DataFrame, *, text: str = "text", host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The documents that pass, with their own columns. Texts are measured once for the hosts and once for themselves, in place
    of a shuffle of the texts; rejected hosts are taken out by an anti join."""
    counts, bad, of = unused(docs, "counts", "failed", "of_host")
    flagged = docs.withColumn(counts, measures(F.col(text))["counts"])
    flagged = flagged.withColumn(bad, failed(F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")))
    verdicts = host_verdicts(flagged.select(F.col(host).alias("host"), F.col(bad).alias("base_failed")), max_rate)
    rejected = verdicts.where(~F.col("host_kept")).select(F.col("host").alias(of))
    return flagged.where(~F.col(bad)).join(sized(rejected), F.col(host).eqNullSafe(F.col(of)), "left_anti").select(*docs.columns)


#: DuckDB twin of op7.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) CROSS JOIN range(0, 8) r(j) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, count_if(base_failed)::DOUBLE AS k FROM f GROUP BY source),
p AS (SELECT sum(k) / sum(n) AS mu FROM h),
s AS (SELECT mu, sum(n * (k / n - mu) * (k / n - mu)) / sum(n) AS v FROM h, p GROUP BY mu),
b AS (SELECT mu, CASE WHEN v = 0 THEN 1e6 ELSE least(1e6, greatest(1.0, mu * (1 - mu) / v - 1)) END AS q FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (k + mu * q) / (n + q) <= 0.5 AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, b
"""
