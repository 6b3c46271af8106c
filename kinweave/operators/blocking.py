"""The k most similar targets of each record by weighted character trigrams, within a country."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint_dir, cut, shuffle_partitions


def search_text(name: str = "name_norm", address: str = "address_norm") -> Column:
    return F.concat(F.col(name), F.lit(" "), F.col(address))


def word_grams(text: Column, n: int = 3) -> Column:
    """Grams of each word with a blank on either side; a word too short for one gram counts once as it is."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - (n - 1), F.lit(1))), lambda i: F.substring(p, i, F.lit(n)))

    return F.flatten(F.transform(words, grams))


def gram_counts(records: DataFrame, text: Column, n: int = 3) -> DataFrame:
    """``country, entity_id, gram, tf``; nothing is left of an empty text. The texts are shuffled by record, not their grams."""
    texts = records.select("country", "entity_id", text.alias("text")).repartition(shuffle_partitions(records.sparkSession), "country", "entity_id")
    rows = texts.select("country", "entity_id", F.explode(word_grams(F.col("text"), n)).alias("gram"))
    return rows.groupBy("country", "entity_id", "gram").agg(F.count(F.lit(1)).alias("tf"))


def inverse_frequencies(counts: DataFrame, n_docs: int, max_df: float = 0.05) -> DataFrame:
    """``gram, df, idf`` over all countries; grams in more than a share of the documents are left out."""
    df = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    kept = df.where(F.col("df") <= F.lit(max_df) * F.lit(n_docs)) if max_df < 1 else df
    return kept.select("gram", "df", (F.log((1 + F.lit(float(n_docs))) / (1 + F.col("df"))) + 1).alias("idf"))


def unit_vectors(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """``country, entity_id, gram, w``: sublinear counts times rarity, scaled to length one over the grams that are kept."""
    raw = counts.join(idf, "gram").select("country", "entity_id", "gram", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norms = raw.groupBy("country", "entity_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, ["country", "entity_id"]).select("country", "entity_id", "gram", (F.col("w") / F.col("norm")).alias("w"))


def blocked_texts(records: DataFrame, text: Column, size: int) -> DataFrame:
    """``country, block, n_blocks, entity_id, text``: the records of a country dealt into blocks of about ``size`` by a hash of their ids."""
    rows = records.select("country", "entity_id", text.alias("text"))
    numbers = rows.groupBy("country").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("n_blocks"))  # one row a country
    return rows.join(F.broadcast(numbers), "country").withColumn("block", F.pmod(F.xxhash64("entity_id"), F.col("n_blocks")).cast("int"))


def packed_vectors(texts: DataFrame, idf: DataFrame, n: int = 3) -> DataFrame:
    """``country, block, entity_id, grams, tfs, idfs, norm``: a record's grams, by number, in one row; parted by country and block.

    Only the texts are shuffled. ``idf`` has a row for each gram of the alphabet in use, not for each record, and goes to all tasks.
    """
    by = ("country", "block", "entity_id")
    parted = texts.select(*by, "text").repartition(shuffle_partitions(texts.sparkSession), "country", "block")
    tf = parted.select(*by, F.explode(word_grams(F.col("text"), n)).alias("gram")).groupBy(*by, "gram").agg(F.count(F.lit(1)).alias("tf"))
    w = (1 + F.log("tf")) * F.col("idf")
    rows = tf.join(F.broadcast(idf), "gram").groupBy(*by).agg(F.collect_list(F.struct("number", "tf", "idf")).alias("x"), F.sqrt(F.sum(w * w)).alias("norm"))
    return rows.select(*by, F.col("x.number").alias("grams"), F.col("x.tf").alias("tfs"), F.col("x.idf").alias("idfs"), "norm")


SLACK = 2e-6  #: scores are compared on six decimals later, so what ties with the k-th stays
CHUNK = 1 << 21  #: scores that are held at once
TINY = np.finfo(float).tiny  #: the least score of a pair that has a gram in common
DENSE = 8  #: a gram that more than one in so many targets of a block have is multiplied as part of a matrix, of the commonest
MOST_DENSE = 512
LISTS = {"known": "<i8", "idfs": "<f8", "ends": "<i8", "rows": "<i4", "tfs": "<i4", "norms": "<f8"}  #: of a block of targets, as bytes


def _flat(side: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and lengths of the vectors, and for every gram of every row its number, count, rarity and the row."""
    ids, grams, tfs, idfs, norms = (side.column(c).combine_chunks() for c in ("entity_id", "grams", "tfs", "idfs", "norm"))
    rows = np.repeat(np.arange(len(ids)), np.diff(np.asarray(grams.offsets)))
    return ids, np.asarray(norms), np.asarray(grams.flatten()), np.asarray(tfs.flatten()), np.asarray(idfs.flatten()), rows


def posting_lists(targets: pa.Table) -> pa.Table:
    """One row for a block of targets: its ids, and for each gram which of them have it how often."""
    ids, norms, grams, tfs, idfs, rows = _flat(targets)
    order = np.argsort(grams, kind="stable")
    known, starts = np.unique(grams[order], return_index=True)
    lists = {"known": known, "idfs": idfs[order][starts], "ends": np.append(starts[1:], len(order)), "rows": rows[order], "tfs": tfs[order], "norms": norms}
    return pa.table({"country": targets.column("country").slice(0, 1).combine_chunks(), "ids": pa.array([ids.to_pylist()], pa.list_(pa.string())), **{k: pa.array([lists[k].astype(t).tobytes()], pa.binary()) for k, t in LISTS.items()}})


POSTINGS = "country string, ids array<string>, " + ", ".join(f"{k} binary" for k in LISTS)


def _stored(folder: str, country: str) -> Iterator[dict]:
    """The blocks of a country from the shared folder, one at a time."""
    where = (fs.LocalFileSystem(), unquote(urlparse(folder).path)) if folder.startswith(("/", "file:")) else fs.FileSystem.from_uri(folder)
    files = ds.dataset(where[1], filesystem=where[0], format="parquet")
    for batch in files.to_batches(filter=pc.field("country") == country, batch_size=1, batch_readahead=1, fragment_readahead=1):
        for i in range(batch.num_rows):
            yield {"ids": batch.column("ids").slice(i, 1).flatten(), **{k: np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in LISTS.items()}}


def best_of_blocks(queries: pa.Table, blocks: Iterable[dict], k: int) -> pa.Table:
    """``s1_id, cand_id, score``: for each query the ``k`` nearest targets of all blocks, with all that tie with the last.

    Few common grams make most of the products; they are one product of matrices, of queries and grams with grams and targets. Those of the
    other grams are added up query by query, while an array of one query's targets stays near the core. What the blocks so far
    have given stays, as far as it is among the best of them; a block only adds what is not below that.
    """
    q_ids, q_norms, q_grams, q_tfs, q_idfs, q_rows = _flat(queries)
    q_weights = (1 + np.log(q_tfs)) * q_idfs / q_norms[q_rows]
    rows, scores, cands = np.empty(0, np.int64), np.empty(0), pa.array([], pa.string())
    floor = np.full(len(q_ids), -np.inf)
    for b in blocks:
        known, t_rows, n = b["known"], b["rows"].astype(np.intp), len(b["ids"])
        starts = np.append(0, b["ends"][:-1])
        lengths = b["ends"] - starts
        t_weights = (1 + np.log(b["tfs"])) * np.repeat(b["idfs"], lengths) / b["norms"][t_rows]
        column = np.full(len(known), -1)
        common = np.flatnonzero(lengths * DENSE > n)
        common = common[np.argsort(-lengths[common], kind="stable")][:MOST_DENSE]
        column[common] = np.arange(len(common))
        matrix = np.zeros((len(common), n))
        for i, g in enumerate(common):
            matrix[i, t_rows[starts[g] : b["ends"][g]]] = t_weights[starts[g] : b["ends"][g]]
        at = np.minimum(np.searchsorted(known, q_grams), len(known) - 1)
        there = known[at] == q_grams
        dense = there & (column[at] >= 0)
        left = np.zeros((len(q_ids), len(common)))
        left[q_rows[dense], column[at[dense]]] = q_weights[dense]
        sparse = there & ~dense
        rest, rest_weights = at[sparse], q_weights[sparse].tolist()
        begins, stops = starts[rest].tolist(), b["ends"][rest].tolist()
        edges = np.searchsorted(q_rows[sparse], np.arange(len(q_ids) + 1)).tolist()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, min(CHUNK // n, len(q_ids)))
        # these are used again and again, as fresh memory costs more than the sums
        scored, mask = np.empty((step, n)), np.empty((step, n), bool)
        most = int(np.bincount(q_rows[sparse], weights=lengths[rest], minlength=1).max())
        where, weights = np.empty(most, np.intp), np.empty(most)
        for begin in range(0, len(q_ids), step):
            end = min(begin + step, len(q_ids))
            found = np.matmul(left[begin:end], matrix, out=scored[: end - begin])
            for i in range(begin, end):
                x, y = edges[i], edges[i + 1]
                if x < y:
                    lists = [slice(u, v) for u, v in zip(begins[x:y], stops[x:y])]
                    total = sum(v.stop - v.start for v in lists)
                    np.concatenate([t_rows[v] for v in lists], out=where[:total])
                    put = 0
                    for v, w in zip(lists, rest_weights[x:y]):
                        np.multiply(t_weights[v], w, out=weights[put : put + v.stop - v.start])
                        put += v.stop - v.start
                    found[i - begin] += np.bincount(where[:total], weights=weights[:total], minlength=n)
            least = floor[begin:end]
            if n > k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(found, n - k, axis=1)[:, n - k] - SLACK)
            cell = np.flatnonzero(np.greater_equal(found, np.maximum(least, TINY)[:, None], out=mask[: end - begin]))
            row, col = np.divmod(cell, n)
            out.append((row + begin, col, found.ravel()[cell]))
        if out:
            new_rows, new_cols, new_scores = (np.concatenate([o[i] for o in out]) for i in range(3))
            rows, scores = np.concatenate([rows, new_rows]), np.concatenate([scores, new_scores])
            cands = pa.concat_arrays([cands, b["ids"].take(pa.array(new_cols))])
            order = np.lexsort((-scores, rows))
            rows, scores = rows[order], scores[order]
            last = np.searchsorted(rows, np.arange(len(q_ids))) + k - 1  # where a query has its k-th best
            full = last < np.searchsorted(rows, np.arange(len(q_ids)), side="right")
            floor[full] = scores[last[full]] - SLACK
            kept = scores >= floor[rows]
            rows, scores, cands = rows[kept], scores[kept], cands.take(pa.array(order[kept]))
    return pa.table({"s1_id": q_ids.take(pa.array(rows)), "cand_id": cands, "score": pa.array(scores)})


class TrigramBlocker:
    """Fitted on targets, queried with records; scores are cosines, ranked on six decimals and then by id.

    Records and targets of a country are dealt into blocks of bounded size by a hash of their ids. A block of targets is stored once, as posting lists in a
    folder beside the checkpoints; a task scores a block of records against the stored blocks of the country one after the other and keeps
    the ``k`` best of each record. So neither side is copied for the other, and no pair of records is shuffled
    but the best. A window ranks these, as an id may stand in several countries.
    """

    def __init__(self, max_df: float = 0.05, n: int = 3, text: Column | None = None, target_block: int = 25_000, query_block: int = 4_000):
        self.max_df, self.n, self.target_block, self.query_block = max_df, n, target_block, query_block
        self.text = search_text() if text is None else text

    def fit(self, targets: DataFrame) -> TrigramBlocker:
        self.counts = gram_counts(targets, self.text, self.n)
        self.idf = cut(inverse_frequencies(self.counts, targets.count(), self.max_df).withColumn("number", F.monotonically_increasing_id()))
        self.folder = f"{checkpoint_dir(targets.sparkSession)}/blocks-{uuid.uuid4().hex}"
        packed = packed_vectors(blocked_texts(targets, self.text, self.target_block), self.idf, self.n)
        lists = packed.groupBy("country", "block").applyInArrow(posting_lists, POSTINGS)
        lists.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(self.folder)
        return self

    @property
    def vectors(self) -> DataFrame:
        return unit_vectors(self.counts, self.idf.drop("number"))

    def query(self, records: DataFrame, k: int = 20) -> DataFrame:
        """``s1_id, cand_id, score, rank`` with rank from 0; records of a country without targets have none."""
        cores, folder = records.sparkSession.sparkContext.defaultParallelism, self.folder
        query_block = min(self.query_block, max(100, records.count() // (2 * cores)))  # enough blocks for all cores; the result is the same
        queries = packed_vectors(blocked_texts(records, self.text, query_block), self.idf, self.n)

        def best(group: pa.Table) -> pa.Table:
            return best_of_blocks(group, _stored(folder, group.column("country")[0].as_py()), k)

        score = queries.groupBy("country", "block").applyInArrow(best, "s1_id string, cand_id string, score double")
        order = Window.partitionBy("s1_id").orderBy(F.round("score", 6).desc(), "cand_id")
        return score.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", (F.col("rank") - 1).cast("int"))
