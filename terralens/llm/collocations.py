"""Phrases that hold together: n-grams by language, scored by their weakest cut against the counts of its two parts.

Texts are folded (A-Z) and cut into pieces at . , ; : ! ? and line ends, pieces into words at spaces and tabs. Orders
ascend from words: the n-grams of an order become rows (language, phrase, count) and are summed by Spark. An n-gram is as
frequent as its rarer part at most, so from the second order on only those n-grams become rows whose two parts of one word
less may have reached the least count. Which ones these are, each task knows from a bitmap of fixed size, made of all
frequent parts: it never misses one, and parts that share a bit with a frequent one only cost rows. What is left out is
below the least count and is no candidate, no part of one and no extension that drops one, so results are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralens.llm import _text
from terralens.llm._tables import Scratch, table

_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_CUT = np.zeros(256, bool)
_CUT[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _CUT.copy()
_GAP[list(b" \t")] = True
_ODD = np.random.default_rng(11).integers(1, 2**63, 16, dtype=_U) * _U(2) + _U(1)
_BUCKET = 32768  # bits that one row of a bitmap holds, fixed by Spark's bitmap functions


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie one behind the other, their texts' numbers, and whether each goes on in its piece."""
    gap, n = _GAP[data], len(data)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    opens, closes = ~gap, ~gap
    opens[1:] &= gap[:-1] | edge[1:n]
    closes[:-1] &= gap[1:] | edge[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    owner = np.searchsorted(at, starts, "right") - 1
    cuts = np.searchsorted(np.flatnonzero(_CUT[data]), starts)
    goes_on = np.zeros(len(starts), bool)
    goes_on[:-1] = (owner[1:] == owner[:-1]) & (cuts[1:] == cuts[:-1])
    return starts, ends, owner, goes_on


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs from each start to its end, as strings."""
    sizes = ends - starts
    at = np.zeros(len(starts) + 1, np.int32 if int(sizes.sum()) < 2**31 else np.int64)
    np.cumsum(sizes, out=at[1:])
    take = np.arange(int(at[-1]), dtype=at.dtype)
    take += np.repeat((starts - at[:-1]).astype(at.dtype), sizes)
    kind = pa.string() if at.dtype == np.int32 else pa.large_string()
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[take]))])


def _hashes(strings: pa.Array) -> np.ndarray:
    data, at = _text.buffers(strings)
    return _text.run_hashes(data, at[:-1], at[1:])


def _bits(lang: np.ndarray, words: list[np.ndarray], size: int) -> np.ndarray:
    """The bit of each n-gram, from the hashes of its language and its words."""
    h = lang.copy()
    for k, w in enumerate(words):
        h += w * _ODD[k]
    return (_text.mix(h) >> _U(64 - size)).astype(np.int64)


def _counter(order: int, size: int, known):
    """The task that turns (lang, text) into rows of one order, summed within each two megabytes of text.

    Order one also gives each language's number of words, as the phrase ''.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _text.pieces(batch, most=2 << 20):
                data, at = _text.buffers(piece.column("text"))
                data = _FOLD[data]
                starts, ends, owner, goes_on = words_of(data, at)
                if not len(starts):
                    continue
                langs = piece.column("lang").dictionary_encode()
                lang = langs.indices.to_numpy()[owner].astype(np.int64)
                coded = _strings(data, starts, ends).dictionary_encode()
                ids, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
                n = len(ids) - order + 1
                if n <= 0:
                    continue
                here = np.ones(n, bool)
                for j in range(order - 1):
                    here &= goes_on[j : j + n]
                if order > 1:
                    marks, lang_hash, word_hash = known.value, _hashes(langs.dictionary), _hashes(words)
                    for first in (0, 1):
                        at_ = np.flatnonzero(here)
                        bit = _bits(lang_hash[lang[at_]], [word_hash[ids[at_ + first + j]] for j in range(order - 1)], size)
                        here[at_] = (marks[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                at_ = np.flatnonzero(here)
                # the n-gram as one number; where products would pass 63 bits, numbers seen so far are numbered anew
                code, room, steps = lang[at_], len(langs.dictionary), []
                for j in range(order):
                    if room * len(words) >= 2**63:
                        seen, code = np.unique(code, return_inverse=True)
                        steps.append((j, seen))
                        room = len(seen)
                    code = code * len(words) + ids[at_ + j]
                    room *= len(words)
                code, counts = np.unique(code, return_counts=True)
                columns = []
                for j in range(order - 1, -1, -1):
                    columns.append(words.take(pa.array(code % len(words))))
                    code = code // len(words)
                    if steps and steps[-1][0] == j:
                        code = steps.pop()[1][code]
                spoken = langs.dictionary.take(pa.array(code))
                phrase = columns[0] if order == 1 else pc.binary_join_element_wise(*reversed(columns), " ")
                out = [spoken, phrase.cast(pa.string()), pa.array(counts.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(out, ["lang", "phrase", "f"])
                if order == 1:
                    many = np.bincount(lang, minlength=len(langs.dictionary)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([langs.dictionary, pa.array([""] * len(many), pa.string()), pa.array(many)], ["lang", "phrase", "f"])

    return _text.tidied(run, every=1)


def _marks(parts: DataFrame, order: int, size: int) -> np.ndarray:
    """The bitmap of the phrases of `order` words: 2 ** size bits at most reach the driver, however many phrases there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("lang").dictionary_encode()
            words = pc.split_pattern(b.column("phrase"), " ").flatten()
            hashes = _hashes(words).reshape(-1, order) if b.num_rows else np.zeros((0, order), _U)
            lang = _hashes(langs.dictionary)[langs.indices.to_numpy()] if b.num_rows else np.zeros(0, _U)
            yield pa.RecordBatch.from_arrays([pa.array(_bits(lang, list(hashes.T), size))], ["bit"])

    found = parts.select("lang", "phrase").mapInArrow(run, "bit long").select((F.col("bit") / _BUCKET).cast("long").alias("bucket"), (F.col("bit") % _BUCKET).alias("bit"))
    rows = found.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(max(1 << size, _BUCKET) // 8, np.uint8)
    for bucket, bits in rows:
        out[bucket * _BUCKET // 8 : (bucket + 1) * _BUCKET // 8] = np.frombuffer(bytes(bits), np.uint8)
    return out


def counted(docs: DataFrame, scratch: Scratch, max_n: int = 3, min_count: int = 10, marks_bits: int = 27) -> DataFrame:
    """(lang, size, phrase, f): all phrases of 1 to max_n words that stand min_count times or more, and with size 0 and the phrase '' each language's words.

    A bitmap takes 2 ** marks_bits bits (16 MB); it is the only thing that each task gets whole.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark, known, parts = docs.sparkSession, None, []
    for order in range(1, max_n + 1):
        if order > 1:
            known = spark.sparkContext.broadcast(_marks(parts[-1].filter("phrase <> ''"), order - 1, marks_bits))
        rows = texts.mapInArrow(_counter(order, marks_bits, known), "lang string, phrase string, f long")
        kept = rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= min_count) | (F.col("phrase") == ""))
        parts.append(scratch.put(kept, f"order-{order}"))
        if known:
            known.destroy()
    sized = [p.select("lang", F.when(F.col("phrase") == "", 0).otherwise(k).alias("size"), "phrase", "f") for k, p in enumerate(parts, 1)]
    out = sized[0]
    for p in sized[1:]:
        out = out.unionByName(p)
    return out


def _parts(phrases: DataFrame, salts: int) -> DataFrame:
    """(lang, phrase, size, a, cut, first, rest, first_salt, rest_salt): a row for each cut; single words are asked for under one of `salts` numbers."""
    cut = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    words = F.split("phrase", " ", -1)
    cut = cut.withColumn("first", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " "))
    cut = cut.withColumn("rest", F.array_join(F.slice(words, F.col("cut") + 1, F.col("size") - F.col("cut")), " "))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts)).cast("int")
    return cut.withColumn("first_salt", F.when(F.col("cut") == 1, salt).otherwise(0)).withColumn("rest_salt", F.when(F.col("size") - F.col("cut") == 1, salt).otherwise(0))


def weak_score() -> Column:
    """floor(1000000 a² / (l r)), exact for counts up to 10^15."""
    whole = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"{whole('a')} * {whole('a')} * cast(1000000 as decimal(7,0)) div ({whole('l')} * {whole('r')})")


def mine(docs: DataFrame, max_n: int = 3, min_count: int = 10, top: int = 2000, cover_percent: int = 50, salts: int = 16) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to max_n words that stands a >= min_count times scores floor(1000000 a² / (l r)) at its weakest cut, where
    l and r count the cut's parts; ties go to the first cut. A phrase goes when a phrase of one word more holds it and
    stands cover_percent percent as often or more; a longer one that covers it has such a one inside, so one word is enough.
    Products are Decimal (exact for counts up to 10^15). Ranked by score and a, descending, then by phrase in byte order.

    Null texts count as empty and give nothing, null languages are `und`; repeated rows count each; an empty table, or one
    without frequent phrases, gives no rows; columns other than text and lang are ignored. One language may hold most rows:
    counts are summed before they are shuffled, phrases are keyed by themselves, single words (which many phrases ask for)
    are dealt to `salts` numbers, and each language is cut to `top` in `salts` parts before the last ranking.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    counts = counted(docs, scratch, max_n, min_count)
    phrases = counts.filter("size > 1").withColumnRenamed("f", "a")
    # the longest extension's count for each phrase that one word more holds
    longer = _parts(phrases.filter("size > 2"), 1)
    holds = longer.filter("cut = 1").select("lang", F.col("rest").alias("phrase"), "a").unionByName(longer.filter("cut = size - 1").select("lang", F.col("first").alias("phrase"), "a"))
    holds = holds.groupBy("lang", "phrase").agg(F.max("a").alias("most")).select(F.col("lang").alias("in_lang"), F.col("phrase").alias("held"), "most")
    covered = (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("held")) & (100 * F.col("most") >= cover_percent * F.col("a"))
    free = phrases.join(holds, covered, "left_anti")
    single = F.explode(F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    part = counts.filter(f"size between 1 and {max_n - 1}").withColumn("salt", single)
    left = part.select("lang", F.col("phrase").alias("first"), F.col("salt").alias("first_salt"), F.col("f").alias("l"))
    right = part.select("lang", F.col("phrase").alias("rest"), F.col("salt").alias("rest_salt"), F.col("f").alias("r"))
    cuts = _parts(free, salts).join(left, ["lang", "first", "first_salt"]).join(right, ["lang", "rest", "rest_salt"])
    scored = cuts.withColumn("score", weak_score())
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w")).select("lang", "phrase", "a", "w.l", "w.r", "w.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = weakest.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    out = best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    out = scratch.put(out, "best")
    scratch.drop_all_but("best")
    return out


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first 2000 phrases of `documents`, see mine."""
    return mine(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
listed AS (SELECT p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
words AS (SELECT p, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM listed),
nexts AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY p ORDER BY i)),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS f FROM nexts GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM nexts WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM nexts WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
most AS (SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 c JOIN f1 x ON (x.lang, x.w1) = (c.lang, c.w1) JOIN f1 y ON (y.lang, y.w1) = (c.lang, c.w2)
  LEFT JOIN most m ON (m.lang, m.w1, m.w2) = (c.lang, c.w1, c.w2) WHERE 100 * coalesce(most, 0) < 50 * c.f
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 1, x.f, y.f
  FROM f3 c JOIN f1 x ON (x.lang, x.w1) = (c.lang, c.w1) JOIN f2 y ON (y.lang, y.w1, y.w2) = (c.lang, c.w2, c.w3)
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, x.f, y.f
  FROM f3 c JOIN f2 x ON (x.lang, x.w1, x.w2) = (c.lang, c.w1, c.w2) JOIN f1 y ON (y.lang, y.w1) = (c.lang, c.w3)),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
