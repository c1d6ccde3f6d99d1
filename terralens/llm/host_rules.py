"""Quality rules judged by host: each document's own failures, and the shrunk failure rate of its host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm._tables import texts, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = ", ".join(f"{c} long" for c in _COUNTS)


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that stand in a 3-word window which occurs twice or more; each counts once."""
    if len(ids) < 4:
        return 0
    if distinct < 2_000_000:
        windows = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:  # ids of pairs first, so that no product passes 64 bits
        _, pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)
        windows = pairs[:-1] * distinct + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    often = np.zeros(len(windows), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    inside = np.zeros(len(ids), bool)
    inside[:-2] |= often
    inside[1:-1] |= often
    inside[2:] |= often
    return int(inside.sum())


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    raw = text.encode()
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    full = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(full) - len(set(full)),
        repeated_words(ids, len(seen)),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([measures(t) for t in b.column("text").to_pylist()], np.int64).reshape(-1, len(_COUNTS))
        yield pa.RecordBatch.from_arrays([*b.drop_columns("text").columns, *map(pa.array, found.T)], [*b.drop_columns("text").schema.names, *_COUNTS])


def host_rates(judged: DataFrame) -> DataFrame:
    """Each host's failure rate under an empirical beta prior.

    The prior's mean is the corpus's failure rate and its strength comes from the spread of the hosts' rates by
    the method of moments (2 to 10,000 pseudo documents). Columns: host, n_docs, n_failed, prior_a, prior_b,
    rate = (n_failed + a) / (n_docs + a + b). Sums are partial before the shuffle, so one host with most rows is
    no hot key.
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    share = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(
        F.sum("n_docs").alias("docs"), F.sum("n_failed").alias("fails"), F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("n_docs") * share * share).alias("square"), F.sum(F.lit(1.0) / F.col("n_docs")).alias("inverse"),
    ).select(
        (F.col("fails") / F.col("docs")).alias("mean"),
        (F.col("square") / F.col("docs")).alias("second"),
        (F.col("hosts") / F.col("inverse")).alias("typical"),  # harmonic mean of the hosts' sizes
    )
    mean, within = F.col("mean"), F.col("mean") * (1 - F.col("mean"))
    between = F.col("second") - mean * mean - within / F.col("typical")  # the spread beyond binomial noise
    strength = F.when(between > 0, F.least(F.lit(10000.0), F.greatest(F.lit(2.0), within / between - 1))).otherwise(F.lit(10000.0))
    prior = moments.select((mean * strength).alias("prior_a"), ((1 - mean) * strength).alias("prior_b"))
    return hosts.crossJoin(F.broadcast(prior)).withColumn("rate", (F.col("n_failed") + F.col("prior_a")) / (F.col("n_docs") + F.col("prior_a") + F.col("prior_b")))


def judge(docs: DataFrame, host: str = "source", min_words: int = 50, max_repeat_percent: int = 50, max_host_rate: float = 0.5, broadcast_hosts: int = 200_000) -> DataFrame:
    """Rule failures of each document and the verdict of its host, one row per input row.

    A document fails on fewer than `min_words` words, or with more than `max_repeat_percent` percent of its words
    in repeated 3-word windows. Failures are summed by host, rates shrink towards the corpus's (host_rates), and a
    host whose shrunk rate exceeds `max_host_rate` takes all its documents out. kept: neither failed.

    Null or empty texts have zero counts and fail; null hosts form one host; repeated rows each count; an empty
    table gives an empty result; other columns are ignored. Host verdicts join by broadcast up to
    `broadcast_hosts` rejected hosts (counted first), else by shuffle.
    """
    base = texts(docs, "doc_id", F.col(host).cast("string").alias("host"))
    measured = base.mapInArrow(_measure, f"doc_id {dict(docs.dtypes)['doc_id']}, host string, {_SCHEMA}")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    judged = written(measured.withColumn("failed", failed), "host-rules")
    bad = written(host_rates(judged).filter(F.col("rate") > max_host_rate).select(F.col("host").alias("bad_host"), F.lit(True).alias("host_failed")), "bad-hosts")
    bad = F.broadcast(bad) if bad.count() <= broadcast_hosts else bad
    return (
        judged.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left")
        .withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
        .select("doc_id", *_COUNTS, F.col("failed").alias("base_failed"), "host", "host_failed", (~F.col("failed") & ~F.col("host_failed")).alias("kept"))
    )


def op5_host_rules(spark, sf_dir: str) -> DataFrame:
    """Counts, base_failed, host_failed and kept of each row of `documents`, see judge."""
    from terralens.llm._tables import table

    return judge(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS id, doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
words AS (SELECT id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM texts),
triples AS (SELECT id, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM words WINDOW o AS (PARTITION BY id ORDER BY i)),
windows AS (SELECT id, i, count(*) OVER (PARTITION BY id, x, y, z) AS times FROM triples WHERE z IS NOT NULL),
inside AS (SELECT DISTINCT id, unnest([i, i + 1, i + 2]) AS i FROM windows WHERE times > 1),
repeated AS (SELECT id, count(*) AS n FROM inside GROUP BY id),
measured AS (
  SELECT doc_id, host, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM texts LEFT JOIN repeated USING (id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
hosts AS (SELECT host, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM judged GROUP BY host),
moments AS (SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) AS second, count(*) / sum(1 / n) AS typical FROM hosts),
spread AS (SELECT mean, mean * (1 - mean) AS within, second - mean * mean - mean * (1 - mean) / typical AS between_hosts FROM moments),
prior AS (SELECT mean, CASE WHEN between_hosts > 0 THEN least(10000.0, greatest(2.0, within / between_hosts - 1)) ELSE 10000.0 END AS strength FROM spread),
verdicts AS (SELECT host, (f + mean * strength) / (n + strength) > 0.5 AS host_failed FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, j.host, host_failed, NOT base_failed AND NOT host_failed AS kept
FROM judged j JOIN verdicts v ON j.host IS NOT DISTINCT FROM v.host"""
