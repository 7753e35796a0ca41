"""Periodic runs of words, found on harmonic grids.

A run is a stretch of words with smallest period q (words q apart are identical) that holds at
least four periods and six words and that no neighbouring word extends. For each period p
the words at jp and (j+1)p are compared, which takes n/p tests; a run of period p holds three such matches in a
row at least. Where three are found, and sample words between them match as well, the
stretch is extended to both sides by comparing chunks of the arrays, each twice as long as
the last.

Grid points within a run that is known already are skipped. That loses nothing: three matches inside a run of
period q < p overlap it by more than p + q words, so a stretch of period p there would have the period gcd(p, q)
and be that very run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, doc_text, documents

PERIODS, WORDS = 4, 6
#: Words compared first; each further chunk is twice as long.
CHUNK = 32
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Each word's number within its text; equal words, and no others, have equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def matched_until(w: np.ndarray, p: int, at: int) -> int:
    """The first place from `at` on where w[i] != w[i + p]."""
    end, step = len(w) - p, CHUNK
    while at < end:
        stop = min(end, at + step)
        differ = w[at:stop] != w[at + p : stop + p]
        if differ.any():
            return at + int(differ.argmax())
        at, step = stop, 2 * step
    return end


def matched_from(w: np.ndarray, p: int, at: int) -> int:
    """The place from which on w[i] == w[i + p] up to `at`."""
    step = CHUNK
    while at > 0:
        stop = max(0, at - step)
        differ = w[stop:at] != w[stop + p : at + p]
        if differ.any():
            return at - int(differ[::-1].argmax())
        at, step = stop, 2 * step
    return 0


def grid_points(n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, periods): the grid points jp with (j + 3)p < n of the periods from low to high - 1, by period."""
    periods = np.arange(low, high)
    counts = (n - 1) // periods - 2
    ends = np.cumsum(counts)
    every = np.repeat(periods, counts)
    return (np.arange(ends[-1]) - np.repeat(ends - counts, counts)) * every, every


def survivors(w: np.ndarray, low: int, high: int, reach: np.ndarray) -> Iterator[tuple[int, int]]:
    """(place, period) of three matches in a row on a grid outside known runs, with sample words between them that match too."""
    at, p = grid_points(len(w), low, high)
    for k in range(3):
        same = w[at + k * p] == w[at + (k + 1) * p]
        at, p = at[same], p[same]
    for k in range(3):
        off = p // (k + 1) if k else np.minimum(1, p - 1)
        same = (w[at + off] == w[at + off + p]) & (w[at + off + p] == w[at + off + 2 * p])
        at, p = at[same], p[same]
        if not len(at):
            return iter(())
    out = reach[at] <= at + 3 * p
    return zip(at[out].tolist(), p[out].tolist(), strict=True)


def find_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    n = len(w)
    found: list[tuple[int, int, int]] = []
    # The furthest end of a known run that begins before each word and holds it.
    reach = np.zeros(n + 1, np.int64)
    low = 1
    while low <= n // PERIODS:
        # One period, then the next six, then eight times as many each time: a known run counts from the next lot on.
        high, now, beyond = min(low * 8 if low > 1 else 2, n // PERIODS + 1), 0, 0
        for at, p in survivors(w, low, high, reach):
            if p == now and at < beyond or reach[at] > at + 3 * p:
                continue
            now, beyond = p, matched_until(w, p, at)
            if beyond <= at + 2 * p:
                continue
            first = matched_from(w, p, at)
            length = beyond - first + p
            # A known run with these ends has a period that divides p.
            if length >= max(WORDS, PERIODS * p) and reach[first] < first + length:
                found.append((first, length, p))
                np.maximum(reach[first : first + length], first + length, out=reach[first : first + length])
        low = high
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed), one row per input row.

    Words are what stands between ASCII white space, compared as they are. runs is a list of (start, length, period), by
    start and period, numbered in words from 0; overlapping runs are all listed. collapsed is the text without the words that repeat
    a period, joined by single spaces. A null, empty or blank text has no words, no runs and an empty
    collapsed text. Ids are carried, null and repeated ones too; texts are taken whole, whatever their length. An empty
    table gives no rows, columns other than those named are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            counts, runs, texts = [], [], []
            for text in b.column("text"):
                words = text.as_py().encode("utf-8").split()
                own = find_runs(word_numbers(words))
                if own:
                    stay = kept_words(len(words), own)
                    words_left = [words[k] for k in np.flatnonzero(stay).tolist()]
                else:
                    words_left = words
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                texts.append(b" ".join(words_left).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return doc_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equal ones; null without runs."""
    first = F.try_element_at(runs, F.lit(1))
    return F.aggregate(runs, first, lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns for rows of periodic_runs."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    best = found.withColumn("best", strongest(F.col("runs")))
    exponent = F.call_function("div", F.lit(1000).cast("long") * F.col("best.length"), F.col("best.period"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"), exponent.alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the contract's documents. With h the crc32 of the id and g = h div 10, a text with h % 10 = 0 repeats
    its words from a = g % n on with the period 1 + (n - a) div (3 + g % 8). A null id counts as the empty text."""
    h = crc32_of_id(F.col("doc_id"))
    words = F.filter(F.split("text", r"[ \t-\r]+", -1), lambda x: x != "")
    rows = doc_text(docs).withColumn("_g", F.floor(h / 10)).withColumn("_words", F.when(h % 10 == 0, words))
    n, g = F.size("_words"), F.col("_g")
    rows = rows.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", 1 + F.call_function("div", n.cast("long") - F.col("_a"), 3 + g % 8))
    at = lambda i: F.when(i >= F.col("_a"), F.col("_a") + (i - F.col("_a")) % F.col("_p")).otherwise(i).cast("int") + 1
    looped = F.array_join(F.transform("_words", lambda x, i: F.element_at(F.col("_words"), at(i))), " ")
    return rows.select("doc_id", F.when(n > 0, looped).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(with_loops(documents(spark, sf_dir))))
