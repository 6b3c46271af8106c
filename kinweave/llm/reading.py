"""Reading level of each document (problem 9)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, spread
from .prose import LEAST_WORDS, prose

BANDS = ("basic", "plain", "skilled", "expert")
SHARES = (0.5, 0.75, 0.9)  #: shares of a document's words that its smallest vocabulary has to cover
RANKS = tuple(f"rank_{int(s * 100)}" for s in SHARES)
BUILT = ("length", "clause", "commas", "letters")  #: how sentences and words are built
FEATURES = (*RANKS, *BUILT)
POOLED = 0.5  #: weight of the covariance within all bands beside that of a band alone
RIDGE = 0.03  #: added to each variance, in units of the feature's variance over all samples
SIZES = ("n_words", "n_sentences", "n_commas", "n_letters")
COUNTED = f"id bigint, digest string, {', '.join(f'{c} bigint' for c in SIZES)}, words array<string>, counts array<int>"


def prose_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of the running English prose of each text, with their counts; texts without prose and rows without an id are left out.

    A repeated row counts once. Rows are told apart by a digest of the text, so no text is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest(), p) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if i is not None and (p := prose(t)) is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _, _ in rows], pa.int64()), pa.array([d for _, d, _ in rows], pa.string()), *(pa.array([getattr(p, c) for _, _, p in rows], pa.int64()) for c in SIZES),
                    pa.array([list(p.words) for _, _, p in rows], pa.list_(pa.string())), pa.array([list(p.words.values()) for _, _, p in rows], pa.list_(pa.int32())),
                ],
                names=["id", "digest", *SIZES, "words", "counts"],
            )

    return spread(docs.select(F.col(id_col).cast("bigint"), F.col(text_col))).mapInArrow(run, COUNTED).dropDuplicates(["id", "digest"])


def word_ranks(counted: DataFrame) -> DataFrame:
    """``word, rank`` over all counted prose: the number of words that are at least as frequent.

    Ranks come from the histogram of frequencies, which has at most the square root of twice the number of words as
    rows, so the vocabulary is never sorted in one task.
    """
    totals = counted.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("n"))
    histogram = totals.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    down = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return totals.join(histogram.select("n", F.sum("k").over(down).alias("rank")), "n").select("word", "rank")


def _covering(ranked: Column, need: Column) -> Column:
    """The rank at which the running count of ``(rank, k)`` in order of rank first reaches ``need``."""
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("rank"))

    def step(a: Column, x: Column) -> Column:
        return F.struct((a["sum"] + x["k"]).alias("sum"), F.when(a["sum"] >= need, a["rank"]).otherwise(x["rank"]).alias("rank"))

    return F.aggregate(ranked, start, step)["rank"]


def measured(counted: DataFrame, ranks: DataFrame) -> DataFrame:
    """``id, n_words`` and the features: coverage ranks, and how sentences and words are built.

    A coverage rank is the logarithm of the size of the smallest frequency-ranked vocabulary that covers a share of the
    words. A word that the corpus lacks comes after all others. ``length`` and ``clause`` are logarithms of the words
    between full stops and between marks of any kind, ``commas`` stands for a sentence, ``letters`` for a word.
    """
    last = ranks.agg((F.coalesce(F.max("rank"), F.lit(0)) + 1).alias("last"))
    key = ("id", "digest", *SIZES)
    each = counted.select(*key, F.explode(F.arrays_zip("words", "counts")).alias("x")).select(*key, F.col("x.words").alias("word"), F.col("x.counts").alias("k"))
    ranked = each.join(ranks, "word", "left").crossJoin(F.broadcast(last)).withColumn("rank", F.coalesce("rank", "last"))  # one row
    docs = ranked.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "k"))).alias("v"))
    cover = {name: F.log(_covering(F.col("v"), F.col("n_words") * F.lit(s)).cast("double")) for name, s in zip(RANKS, SHARES)}
    built = {
        "length": F.log(F.col("n_words") / F.col("n_sentences")), "clause": F.log(F.col("n_words") / (F.col("n_sentences") + F.col("n_commas"))),
        "commas": F.col("n_commas") / F.col("n_sentences"), "letters": F.col("n_letters") / F.col("n_words"),
    }
    return docs.select("id", "n_words", *(c.alias(k) for k, c in (cover | built).items()))


def calibrated(features: DataFrame, bands: DataFrame, names: tuple[str, ...] = FEATURES) -> dict[str, tuple[np.ndarray, np.ndarray, float]]:
    """Centre, inverse covariance and logarithm of its determinant for each band, of the named features.

    Means and covariances are SQL aggregates over the labelled samples; the driver gets one row a band. The covariance of a band
    is drawn half way to the one within all bands, as a band has few samples.
    """
    x = features.join(bands, "id")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[: i + 1]]
    rows = x.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *(F.avg(f).alias(f) for f in names), *(F.covar_pop(a, b).alias(f"{a}|{b}") for a, b in pairs)).orderBy("band").collect()
    if not rows:
        return {}
    total = sum(r["n"] for r in rows)
    centre = {r["band"]: np.array([r[f] for f in names]) for r in rows}
    own = {r["band"]: np.array([[r[f"{a}|{b}"] if (a, b) in pairs else r[f"{b}|{a}"] for b in names] for a in names]) for r in rows}
    pooled = sum(own[r["band"]] * r["n"] for r in rows) / total
    middle = sum(centre[r["band"]] * r["n"] for r in rows) / total
    whole = np.diag(pooled) + sum((centre[r["band"]] - middle) ** 2 * r["n"] for r in rows) / total
    found = {}
    for b in centre:
        c = POOLED * pooled + (1 - POOLED) * own[b] + np.diag(RIDGE * whole + 1e-9)
        found[b] = centre[b], np.linalg.inv(c), float(np.linalg.slogdet(c)[1])
    return found


def _distance(names: tuple[str, ...], centre: np.ndarray, inverse: np.ndarray, offset: float) -> Column:
    """Squared distance from a centre in units of a covariance, plus the logarithm of its determinant."""
    off = [F.col(f) - F.lit(float(c)) for f, c in zip(names, centre)]
    terms = [off[i] * off[j] * F.lit(float(inverse[i, j] * (1 if i == j else 2))) for i in range(len(names)) for j in range(i + 1)]
    return sum(terms, F.lit(offset))


def levels(docs: DataFrame, samples: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """``doc_id, band, n_words`` and the features of each document with enough running English prose.

    Word frequencies come from the prose of all documents. The labelled samples (a fixed table; its bands are the only
    fitted part) give centre and covariance of each band, from which a document takes the likeliest; among equals the
    first by name. Null, empty and blank texts, and those with fewer than ``LEAST_WORDS`` words of prose, are
    left out; repeated rows count once; extra columns are ignored; without samples there is no level. ``names`` may leave features out.
    """
    counted = cut(prose_counts(docs))
    ranks = cut(word_ranks(counted))
    known = samples.select(F.col("sample_id").cast("bigint").alias("id"), F.lower(F.trim("band")).alias("band")).where("band is not null").distinct()
    bands = calibrated(measured(prose_counts(samples, "sample_id"), ranks), known, names)
    x = measured(counted.where(F.col("n_words") >= LEAST_WORDS), ranks)
    likely = F.array_sort(F.array(*(F.struct(_distance(names, *fit).alias("distance"), F.lit(b).alias("band")) for b, fit in sorted(bands.items())))) if bands else None
    found = x.withColumn("band", F.get(likely, F.lit(0))["band"]) if bands else x.withColumn("band", F.lit(None).cast("string")).where("false")
    return found.select(F.col("id").alias("doc_id"), "band", "n_words", *FEATURES)
