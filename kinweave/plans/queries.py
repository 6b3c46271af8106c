"""Queries over the operators of the core, and the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..functions.transliterate import transliterate
from ..operators import blocking, errors, evaluate, features, matching, split, validate
from ..sources import sinks, tables
from . import normal_sql, pipeline
from .lineage import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LEGAL_WORDS = ("co", "company", "corp", "corporation", "inc", "incorporated", "limited", "llc", "llp", "ltd", "pc", "private", "pvt", "sa", "sarl", "sas")
N_SETS = 5


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def s1_of(spark: SparkSession, sf: str) -> DataFrame:
    return tables.records(table(spark, sf, "source1"))


def targets_of(spark: SparkSession, sf: str) -> DataFrame:
    return tables.targets(*(tables.records(table(spark, sf, f"source{i}")) for i in (2, 3)))


def simple(df: DataFrame) -> DataFrame:
    """A plain normal form; the rules proper are in ``normalized_records`` and in what is built on it."""
    clean = lambda c, kept: F.trim(F.regexp_replace(F.lower(c), f"[^a-z0-9{kept}]+", " "))
    legal = F.filter(F.split("name_norm", " "), lambda w: w.isin(*LEGAL_WORDS))
    return df.withColumns({"name_norm": clean("business_name", ""), "address_norm": clean("business_address", ",/-")}).withColumn("legal_form", F.array_join(F.array_sort(F.array_distinct(legal)), " "))


def truth_of(spark: SparkSession, sf: str) -> DataFrame:
    return tables.id_lists(table(spark, sf, "match_labels"), "source1_entity_id", "matched_entity_ids")


def candidates_of(spark: SparkSession, sf: str) -> DataFrame:
    """The given candidates, each pair once with its best score, ranked."""
    p = table(spark, sf, "candidate_pairs").where("s1_id is not null and cand_id is not null and score is not null and not isnan(score)")
    return features.ranked(p.groupBy("s1_id", "cand_id").agg(F.max(F.col("score").cast("double")).alias("score")))


def scored_of(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates with a made-up probability that any engine can repeat."""
    return candidates_of(spark, sf).withColumn("match_proba", F.round("score", 4))


def r(c: str | Column, name: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)


REC = "SELECT DISTINCT coalesce(entity_id, '') AS entity_id, coalesce(business_name, '') AS business_name, coalesce(business_address, '') AS business_address, coalesce(country, '') AS country FROM source"
BASE = f"s1 AS ({REC}1), t AS ({REC}2 UNION ALL {REC}3)"


def _simple_sql(name: str, of: str) -> str:
    words = ", ".join(f"'{w}'" for w in LEGAL_WORDS)
    return (
        f"{name}_a AS (SELECT *, trim(regexp_replace(lower(business_name), '[^a-z0-9]+', ' ', 'g')) AS name_norm, trim(regexp_replace(lower(business_address), '[^a-z0-9,/-]+', ' ', 'g')) AS address_norm FROM {of}), "
        f"{name} AS (SELECT *, coalesce(array_to_string(list_sort(list_distinct(list_filter(string_split(name_norm, ' '), lambda w: w IN ({words})))), ' '), '') AS legal_form FROM {name}_a)"
    )


TRUTH = (
    "truth_rows AS (SELECT source1_entity_id AS s1_id, unnest(string_split(coalesce(matched_entity_ids, ''), ',')) AS cand_id FROM match_labels WHERE source1_entity_id IS NOT NULL), "
    "truth AS (SELECT DISTINCT s1_id, cand_id FROM truth_rows WHERE cand_id <> ''), spine AS (SELECT DISTINCT s1_id FROM truth_rows)"
)
CAND = (
    "cand_a AS (SELECT s1_id, cand_id, max(CAST(score AS DOUBLE)) AS score FROM candidate_pairs WHERE s1_id IS NOT NULL AND cand_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL), "
    "cand AS (SELECT *, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY round(score, 6) DESC, cand_id) - 1 AS INT) AS rank, score - max(score) OVER (PARTITION BY s1_id) AS score_gap, round(score, 4) AS match_proba FROM cand_a)"
)
CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(X, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), "
    "lambda c, e: xor(xor(c, e) >> 1, 3988292384::BIGINT * (xor(c, e) & 1))), 4294967295::BIGINT)"
)


def _entity_sql(pred: str) -> str:
    """Counts and F0.5 of each record of the truth against ``pred``."""
    return (
        f"pairs AS (SELECT DISTINCT s1_id, cand_id FROM {pred}), nt AS (SELECT s1_id, count(*) AS n FROM truth GROUP BY 1), np AS (SELECT s1_id, count(*) AS n FROM pairs GROUP BY 1), "
        "nh AS (SELECT s1_id, count(*) AS n FROM truth JOIN pairs USING (s1_id, cand_id) GROUP BY 1), "
        "counts AS (SELECT s1_id, coalesce(nt.n, 0) AS n_true, coalesce(np.n, 0) AS n_pred, coalesce(nh.n, 0) AS hits FROM spine LEFT JOIN nt USING (s1_id) LEFT JOIN np USING (s1_id) LEFT JOIN nh USING (s1_id)), "
        "entity AS (SELECT *, CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN hits = 0 THEN 0.0::DOUBLE "
        "ELSE 1.25::DOUBLE * hits / n_pred * hits / n_true / (0.25::DOUBLE * hits / n_pred + hits / n_true) END AS f0_5 FROM counts)"
    )


DECIDED = (
    "kept AS (SELECT * FROM (SELECT *, max(match_proba) OVER (PARTITION BY s1_id) AS best FROM cand WHERE match_proba >= {t}) WHERE match_proba >= best - {m}), "
    "final AS (SELECT s1_id, cand_id, match_proba FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY match_proba DESC, s1_id) AS n FROM kept) WHERE n = 1)"
)


@query(f"WITH {BASE} SELECT * FROM s1")
def scan_records(spark: SparkSession, sf: str) -> DataFrame:
    return s1_of(spark, sf)


@query(f"WITH {BASE} SELECT * FROM t")
def union_targets(spark: SparkSession, sf: str) -> DataFrame:
    return targets_of(spark, sf)


@query(f"WITH {BASE}, {_simple_sql('n', 's1')} SELECT entity_id, name_norm || ' ' || address_norm AS text, legal_form FROM n")
def text_projection(spark: SparkSession, sf: str) -> DataFrame:
    return simple(s1_of(spark, sf)).select("entity_id", blocking.search_text().alias("text"), "legal_form")


@query(f"SELECT source1_entity_id AS s1_id, coalesce(string_agg(DISTINCT x, ',' ORDER BY x) FILTER (x <> ''), '') AS ids FROM (SELECT source1_entity_id, unnest(string_split(coalesce(matched_entity_ids, ''), ',')) AS x FROM match_labels WHERE source1_entity_id IS NOT NULL) GROUP BY 1")
def truth_lists(spark: SparkSession, sf: str) -> DataFrame:
    return truth_of(spark, sf).select("s1_id", F.array_join(F.array_sort("ids"), ",").alias("ids"))


@query(f"WITH {BASE} SELECT entity_id, CAST({CRC.replace('X', 'entity_id')} % {N_SETS} AS INT) AS set_id FROM (SELECT DISTINCT entity_id FROM s1)")
def split_assign(spark: SparkSession, sf: str) -> DataFrame:
    return s1_of(spark, sf).select("entity_id").distinct().select("entity_id", split.set_of(F.col("entity_id"), N_SETS).alias("set_id"))


def _split(spark: SparkSession, sf: str) -> DataFrame:
    ids = s1_of(spark, sf).select("entity_id", F.lit("s1").alias("source")).union(targets_of(spark, sf).select("entity_id", F.lower(F.substring("entity_id", 1, 2)).alias("source"))).distinct()
    return split.assigned(ids, truth_of(spark, sf), N_SETS)


SPLIT = (
    f"{BASE}, {TRUTH}, ids AS (SELECT DISTINCT entity_id, 's1' AS source FROM s1 UNION SELECT DISTINCT entity_id, lower(substring(entity_id, 1, 2)) AS source FROM t), "
    f"own AS (SELECT cand_id AS entity_id, min(s1_id) AS owner FROM truth GROUP BY 1), placed AS (SELECT entity_id, source, CAST({CRC.replace('X', 'coalesce(owner, entity_id)')} % {N_SETS} AS INT) AS set_id FROM ids LEFT JOIN own USING (entity_id))"
)


@query(f"WITH {SPLIT} SELECT entity_id, source, set_id FROM placed")
def split_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf).select("entity_id", "source", "set_id")


@query(f"WITH {SPLIT} SELECT CAST(s AS INT) AS set_id, source, (SELECT count(*) FROM placed p WHERE p.set_id = s AND p.source = q.source) AS n FROM range({N_SETS}) g(s), (SELECT DISTINCT source FROM placed) q")
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return split.counts(spark, _split(spark, sf), N_SETS)


EVERY = f"{BASE}, every AS (SELECT * FROM s1 UNION ALL SELECT * FROM t), {normal_sql.latin_cte('l', 'every')}, {normal_sql.names_sql('n', 'l')}, {normal_sql.addresses_sql('norm', 'n')}"
NORMAL = f"{EVERY}, n1 AS (SELECT * FROM norm SEMI JOIN s1 USING (entity_id)), nt AS (SELECT * FROM norm SEMI JOIN t USING (entity_id))"


def _grams_sql(name: str, of: str) -> str:
    return (
        f"{name}_w AS (SELECT country, entity_id, ' ' || w || ' ' AS p FROM (SELECT country, entity_id, unnest(regexp_split_to_array(lower(name_norm || ' ' || address_norm), '\\s+')) AS w FROM {of}) WHERE w <> ''), "
        f"{name}_g AS (SELECT country, entity_id, unnest(list_transform(range(1, greatest(length(p) - 2, 1) + 1), lambda i: substring(p, i, 3))) AS gram, p FROM {name}_w), "
        f"{name} AS (SELECT country, entity_id, gram, count(*) AS tf FROM {name}_g GROUP BY ALL)"
    )


def _vectors_sql(name: str, of: str) -> str:
    return (
        f"{name}_r AS (SELECT country, entity_id, gram, (1 + ln(tf)) * idf AS w FROM {of} JOIN idf USING (gram)), "
        f"{name} AS (SELECT country, entity_id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY country, entity_id)) AS w FROM {name}_r)"
    )


def _idf_sql(base: str) -> str:
    """``base`` has to hold the targets in normal form as ``nt``."""
    return (
        f"{base}, {_grams_sql('gt', 'nt')}, docs AS (SELECT count(*) AS n FROM t), dfs AS (SELECT gram, count(*) AS df FROM gt GROUP BY 1), "
        "idf AS (SELECT gram, df, ln((1 + n::DOUBLE) / (1 + df)) + 1 AS idf FROM dfs, docs WHERE df <= 0.05 * n)"
    )


def _topk_sql(base: str) -> str:
    return (
        f"{_idf_sql(base)}, {_vectors_sql('vt', 'gt')}, {_grams_sql('gq', 'n1')}, {_vectors_sql('vq', 'gq')}, dots AS (SELECT q.entity_id AS s1_id, v.entity_id AS cand_id, sum(q.w * v.w) AS score FROM vq q JOIN vt v USING (country, gram) GROUP BY 1, 2), "
        "top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY round(score, 6) DESC, cand_id) - 1 AS INT) AS rank FROM dots) WHERE rank < 20)"
    )


SIMPLE = f"{BASE}, {_simple_sql('n1', 's1')}, {_simple_sql('nt', 't')}"
IDF, TOPK = _idf_sql(SIMPLE), _topk_sql(SIMPLE)


@query(f"WITH {IDF} SELECT gram, df, round(idf, 9) AS idf FROM idf")
def trigram_idf(spark: SparkSession, sf: str) -> DataFrame:
    t = simple(targets_of(spark, sf))
    return blocking.inverse_frequencies(blocking.gram_counts(t, blocking.search_text()), t.count()).select("gram", "df", r("idf", "idf", 9))


@query(f"WITH {IDF}, {_vectors_sql('vt', 'gt')} SELECT country, entity_id, gram, round(w, 7) AS w FROM vt")
def tfidf_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return blocking.TrigramBlocker().fit(simple(targets_of(spark, sf))).vectors.select("country", "entity_id", "gram", r("w", "w", 7))


def _topk(spark: SparkSession, sf: str) -> DataFrame:
    return blocking.TrigramBlocker().fit(simple(targets_of(spark, sf))).query(simple(s1_of(spark, sf)), 20)


@query(f"WITH {TOPK} SELECT s1_id, cand_id, rank, round(score, 4) AS score FROM top")
def block_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _topk(spark, sf).select("s1_id", "cand_id", "rank", r("score", "score", 4))


@query(f"WITH {TOPK}, {TRUTH}, ks AS (SELECT CAST(unnest([1, 5, 10, 20]) AS INT) AS k) SELECT k, round((SELECT count(*) FROM truth JOIN top USING (s1_id, cand_id) WHERE rank < k) / (SELECT count(*) FROM truth), 6) AS recall FROM ks")
def block_recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.recall_at(truth_of(spark, sf), _topk(spark, sf), (1, 5, 10, 20)).select("k", r("recall", "recall"))


@query(f"WITH {_topk_sql(NORMAL)} SELECT s1_id, cand_id, rank, round(score, 4) AS score FROM top")
def block_topk_normalized(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates after transliteration and the full rules."""
    s1, t = pipeline.prepare(s1_of(spark, sf), targets_of(spark, sf), columns=("entity_id", "country", "name_norm", "address_norm"))
    return blocking.TrigramBlocker().fit(t).query(s1, 20).select("s1_id", "cand_id", "rank", r("score", "score", 4))


@query(f"WITH {BASE}, {normal_sql.latin_cte('l', 't')} SELECT * FROM l")
def transliterated(spark: SparkSession, sf: str) -> DataFrame:
    return transliterate(targets_of(spark, sf))


@query(f"WITH {EVERY} SELECT entity_id, name_norm, legal_form, address_norm FROM norm")
def normalized_records(spark: SparkSession, sf: str) -> DataFrame:
    return nz.normalize(transliterate(tables.targets(s1_of(spark, sf), targets_of(spark, sf)))).select("entity_id", "name_norm", "legal_form", "address_norm")


@query(f"WITH {CAND} SELECT s1_id, cand_id, rank, round(score_gap, 6) AS score_gap FROM cand")
def pair_rank_gap(spark: SparkSession, sf: str) -> DataFrame:
    return candidates_of(spark, sf).select("s1_id", "cand_id", "rank", r("score_gap", "score_gap"))


PAIRS = (
    f"{NORMAL}, {CAND}, x AS (SELECT c.s1_id, c.cand_id, list_distinct(list_filter(string_split(a.name_norm, ' '), lambda w: w <> '')) AS an, "
    "list_distinct(list_filter(string_split(b.name_norm, ' '), lambda w: w <> '')) AS bn, list_distinct(list_filter(string_split(a.address_norm, ' '), lambda w: w <> '')) AS aa, list_distinct(list_filter(string_split(b.address_norm, ' '), lambda w: w <> '')) AS ba, "
    "list_distinct(list_filter(string_split(translate(a.address_norm, '/-', '  '), ' '), lambda w: regexp_full_match(w, '[0-9]+'))) AS ad, list_distinct(list_filter(string_split(translate(b.address_norm, '/-', '  '), ' '), lambda w: regexp_full_match(w, '[0-9]+'))) AS bd, "
    "a.legal_form AS al, b.legal_form AS bl, a.address_norm AS aat, b.address_norm AS bat FROM cand c JOIN n1 a ON a.entity_id = c.s1_id JOIN nt b ON b.entity_id = c.cand_id)"
)


def _j(a: str, b: str) -> str:
    both = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {both} = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / {both} END"


def _features(spark: SparkSession, sf: str, fuzzy: bool = False) -> DataFrame:
    return features.pair_features(candidates_of(spark, sf).select("s1_id", "cand_id", "score"), *pipeline.prepare(s1_of(spark, sf), targets_of(spark, sf)), fuzzy)


@query(f"WITH {PAIRS} SELECT s1_id, cand_id, round({_j('an', 'bn')}, 6) AS name_jaccard, round({_j('aa', 'ba')}, 6) AS addr_jaccard, (len(list_distinct(list_concat(an, bn))) - len(list_intersect(an, bn)))::DOUBLE AS name_extra_tokens FROM x")
def pair_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("s1_id", "cand_id", r("name_jaccard", "name_jaccard"), r("addr_jaccard", "addr_jaccard"), "name_extra_tokens")


@query(f"WITH {PAIRS} SELECT s1_id, cand_id, round({_j('ad', 'bd')}, 6) AS num_jaccard, (len(list_intersect(ad, bd)) > 0)::INT::DOUBLE AS num_overlap FROM x")
def pair_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("s1_id", "cand_id", r("num_jaccard", "num_jaccard"), "num_overlap")


@query(f"WITH {PAIRS} SELECT s1_id, cand_id, (al <> '' AND al = bl)::INT::DOUBLE AS legal_agree, (al = '' OR bl = '')::INT::DOUBLE AS legal_missing, (aat = '')::INT::DOUBLE AS s1_addr_empty, (bat = '')::INT::DOUBLE AS cand_addr_empty FROM x")
def pair_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("s1_id", "cand_id", "legal_agree", "legal_missing", "s1_addr_empty", "cand_addr_empty")


@query()
def pair_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """The ratios that SQL can't express; unit tests hold them against brute force."""
    return _features(spark, sf, True).select("s1_id", "cand_id", *(r(c, c) for c in ("name_token_set", "name_partial", "addr_token_set")))


@query(f"WITH {CAND}, {TRUTH} SELECT c.s1_id, c.cand_id, (t.cand_id IS NOT NULL)::INT AS label FROM cand c LEFT JOIN truth t USING (s1_id, cand_id)")
def label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return matching.labeled_pairs(candidates_of(spark, sf), truth_of(spark, sf)).select("s1_id", "cand_id", "label")


@query(f"WITH {CAND}, {TRUTH}, l AS (SELECT count(*) AS n, count(t.cand_id) AS p FROM cand c LEFT JOIN truth t USING (s1_id, cand_id)), a AS (SELECT count(*) AS m FROM truth) SELECT p AS positives, n - p AS negatives, round((n - p)::DOUBLE / n, 6) AS negative_rate, m AS true_pairs, p AS recovered, m - p AS missed FROM l, a")
def label_summary(spark: SparkSession, sf: str) -> DataFrame:
    truth = truth_of(spark, sf)
    return matching.label_summary(matching.labeled_pairs(candidates_of(spark, sf), truth), truth).withColumn("negative_rate", F.round("negative_rate", 6))


@query(f"WITH {CAND}, {DECIDED.format(t=0.3, m=9)} SELECT * FROM final")
def decide_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return matching.decide(scored_of(spark, sf), 0.3).select("s1_id", "cand_id", "match_proba")


@query(f"WITH {CAND}, {DECIDED.format(t=0.3, m=0.1)} SELECT * FROM final")
def decide_margin(spark: SparkSession, sf: str) -> DataFrame:
    return matching.decide(scored_of(spark, sf), 0.3, 0.1).select("s1_id", "cand_id", "match_proba")


TUNE = (
    f"{CAND}, {TRUTH}, {DECIDED.format(t=0.05, m=9)}, grid AS (SELECT round(i * 0.05, 2)::DOUBLE AS threshold FROM range(1, 20) g(i)), nt AS (SELECT s1_id, count(*) AS n FROM truth GROUP BY 1), "
    "hit AS (SELECT threshold, f.s1_id, count(*) AS np, count(t.cand_id) AS nh FROM grid JOIN final f ON f.match_proba >= threshold LEFT JOIN truth t USING (s1_id, cand_id) GROUP BY 1, 2), "
    "e AS (SELECT g.threshold, s.s1_id, coalesce(nt.n, 0) AS n_true, coalesce(np, 0) AS n_pred, coalesce(nh, 0) AS hits FROM grid g CROSS JOIN spine s LEFT JOIN nt USING (s1_id) LEFT JOIN hit h ON h.threshold = g.threshold AND h.s1_id = s.s1_id), "
    "curve AS (SELECT threshold, avg(CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN hits = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * hits / n_pred * hits / n_true / (0.25::DOUBLE * hits / n_pred + hits / n_true) END) AS f0_5 FROM e GROUP BY 1)"
)


@query(f"WITH {TUNE} SELECT threshold, round(f0_5, 6) AS f0_5 FROM curve")
def threshold_curve(spark: SparkSession, sf: str) -> DataFrame:
    return matching.threshold_scores(scored_of(spark, sf), truth_of(spark, sf)).select("threshold", r("f0_5", "f0_5"))


@query(f"WITH {TUNE} SELECT threshold, round(f0_5, 6) AS f0_5 FROM curve ORDER BY round(f0_5, 12) DESC, threshold LIMIT 1")
def tune_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return matching.tune_threshold(scored_of(spark, sf), truth_of(spark, sf)).select("threshold", r("f0_5", "f0_5"))


@query()
def gbt_match_proba(spark: SparkSession, sf: str) -> DataFrame:
    """Probabilities of boosted trees, fitted as the operator does by default."""
    truth = truth_of(spark, sf)
    pairs = matching.labeled_pairs(candidates_of(spark, sf).select("s1_id", "cand_id", "score"), truth)  # joined while the rows are narrow
    pairs = pairs.join(truth.select("s1_id", F.lit(True).alias("known")), "s1_id", "left")
    labeled = stored(features.pair_features(pairs, *pipeline.prepare(s1_of(spark, sf), targets_of(spark, sf)), keep=("label", "known")))
    return matching.Matcher().fit(labeled.where("known")).predict(labeled).select("s1_id", "cand_id", r("match_proba", "match_proba"))


ENTITY = f"WITH {CAND}, {TRUTH}, {DECIDED.format(t=0.3, m=9)}, {_entity_sql('final')}"


def _final(spark: SparkSession, sf: str) -> DataFrame:
    return matching.decide(scored_of(spark, sf), 0.3)


@query(f"{ENTITY} SELECT s1_id, round(f0_5, 6) AS f0_5, n_true::INT AS n_true, n_pred::INT AS n_pred, (n_pred - hits)::INT AS false_pos, (n_true - hits)::INT AS false_neg FROM entity")
def f05_entity(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.entity_scores(truth_of(spark, sf), _final(spark, sf)).withColumn("f0_5", F.round("f0_5", 6))


@query(f"{ENTITY} SELECT round(avg(f0_5), 6) AS f0_5 FROM entity")
def f05_macro(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.macro_score(truth_of(spark, sf), _final(spark, sf)).select(r("f0_5", "f0_5"))


@query(f"{ENTITY} SELECT round(avg((f0_5 = 1)::INT), 6) AS perfect, round(avg((f0_5 = 0)::INT), 6) AS zero, round(avg((f0_5 > 0 AND f0_5 < 1)::INT), 6) AS partial FROM entity")
def error_distribution(spark: SparkSession, sf: str) -> DataFrame:
    d = errors.distribution(truth_of(spark, sf), _final(spark, sf))
    return d.select(*(r(c, c) for c in d.columns))


@query(f"WITH {CAND}, {TRUTH}, n AS (SELECT s1_id, count(*) AS n FROM cand GROUP BY 1) SELECT round(avg(coalesce(n, 0)), 6) AS mean_candidates FROM spine LEFT JOIN n USING (s1_id)")
def mean_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.mean_candidates(truth_of(spark, sf), candidates_of(spark, sf)).select(r("mean_candidates", "mean_candidates"))


@query(f"WITH {TRUTH}, n AS (SELECT s1_id, count(*) AS n FROM truth GROUP BY 1) SELECT round(avg((n IS NULL)::INT), 6) AS singleton_rate FROM spine LEFT JOIN n USING (s1_id)")
def singleton_rate(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.singleton_rate(truth_of(spark, sf)).select(r("singleton_rate", "singleton_rate"))


@query("WITH parts AS (SELECT source1_entity_id AS s1_id, loaded_at, coalesce(matched_entity_ids, '') AS ids FROM match_labels WHERE source1_entity_id IS NOT NULL), last AS (SELECT s1_id, max(loaded_at) AS loaded_at FROM parts GROUP BY 1), "
       "one AS (SELECT s1_id, max(ids) AS ids FROM parts JOIN last USING (s1_id, loaded_at) GROUP BY 1) SELECT s1_id, array_to_string(list_sort(list_distinct(list_filter(string_split(ids, ','), lambda x: x <> ''))), ',') AS ids FROM one")
def truth_lists_last(spark: SparkSession, sf: str) -> DataFrame:
    """Of the rows of one record the last that arrived."""
    lists = tables.id_lists(table(spark, sf, "match_labels").withColumn("matched_entity_ids", F.coalesce("matched_entity_ids", F.lit(""))), "source1_entity_id", "matched_entity_ids", "loaded_at")
    return lists.select("s1_id", F.array_join(F.array_sort("ids"), ",").alias("ids"))


@query(f"WITH {CAND}, {TRUTH}, ks AS (SELECT CAST(unnest([1, 5, 10, 20]) AS INT) AS k) SELECT k, round((SELECT count(*) FROM truth JOIN cand USING (s1_id, cand_id) WHERE rank < k) / (SELECT count(*) FROM truth), 6) AS recall FROM ks")
def given_recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.recall_at(truth_of(spark, sf), candidates_of(spark, sf), (1, 5, 10, 20)).select("k", r("recall", "recall"))


@query(f"WITH {CAND}, {BASE} SELECT round((SELECT count(*) FROM cand)::DOUBLE / (SELECT count(*) FROM s1), 6) AS pairs_per_record")
def pairs_per_record(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.candidates_per_record(candidates_of(spark, sf), s1_of(spark, sf)).select(r("pairs_per_record", "pairs_per_record"))


@query(f"WITH {CAND}, {TRUTH}, {_entity_sql('(SELECT * FROM cand WHERE rank = 0)')}, z AS (SELECT s1_id FROM spine WHERE s1_id NOT IN (SELECT s1_id FROM truth)) SELECT 'nothing' AS baseline, round((SELECT count(*) FROM z)::DOUBLE / (SELECT count(*) FROM spine), 6) AS f0_5 UNION ALL SELECT 'top1', round(avg(f0_5), 6) FROM entity")
def baseline_scores(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.baselines(truth_of(spark, sf), candidates_of(spark, sf)).select("baseline", r("f0_5", "f0_5"))


@query(f"WITH {CAND}, {TRUTH}, {_entity_sql('cand')} SELECT count(*) AS entities, count(*) FILTER (hits = 0) AS fully, count(*) FILTER (hits > 0 AND hits < n_true) AS partially FROM entity WHERE n_true > 0")
def block_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    return errors.ceiling(truth_of(spark, sf), candidates_of(spark, sf))


WRONG = f"WITH {CAND}, {TRUTH}, {DECIDED.format(t=0.3, m=9)}, own AS (SELECT cand_id, min(s1_id) AS owner FROM truth GROUP BY 1), wrong AS (SELECT f.s1_id, f.cand_id, owner, CASE WHEN owner IS NULL THEN 'unclaimed' ELSE 'stolen' END AS \"case\" FROM final f SEMI JOIN spine USING (s1_id) ANTI JOIN truth USING (s1_id, cand_id) LEFT JOIN own USING (cand_id))"


@query(f"{WRONG} SELECT * FROM wrong")
def false_positives(spark: SparkSession, sf: str) -> DataFrame:
    return errors.wrong_pairs(truth_of(spark, sf), _final(spark, sf))


@query(f"{WRONG} SELECT \"case\", count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM wrong), 6) AS share FROM wrong GROUP BY 1")
def fp_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    return errors.wrong_cases(truth_of(spark, sf), _final(spark, sf)).withColumn("share", F.round("share", 6))


@query(f"WITH {CAND}, {TRUTH} SELECT s1_id, cand_id, match_proba FROM cand SEMI JOIN truth USING (s1_id, cand_id) WHERE match_proba < 0.3")
def fn_below_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return errors.lost_below(matching.labeled_pairs(scored_of(spark, sf), truth_of(spark, sf)), 0.3).select("s1_id", "cand_id", "match_proba")


@query(f"WITH {BASE}, {CAND}, l AS (SELECT s1_id, string_agg(cand_id, ',' ORDER BY rank) AS ids FROM cand WHERE rank < 20 GROUP BY 1) SELECT entity_id AS source1_entity_id, coalesce(ids, '') AS candidate_entity_ids FROM (SELECT DISTINCT entity_id FROM s1) LEFT JOIN l ON s1_id = entity_id")
def id_lists(spark: SparkSession, sf: str) -> DataFrame:
    spine = s1_of(spark, sf).select(F.col("entity_id").alias("s1_id")).distinct()
    return sinks.id_list_table(candidates_of(spark, sf).where("rank < 20"), spine, "candidate_entity_ids", "rank")


VAL = (
    f"{BASE}, vr AS (SELECT trim(source1_entity_id) AS s1_id, CASE WHEN trim(coalesce(matched_entity_ids, '')) = '' THEN []::VARCHAR[] ELSE list_transform(string_split(matched_entity_ids, ','), lambda x: trim(x)) END AS ids FROM match_labels), "
    "ve AS (SELECT s1_id, unnest(ids) AS id FROM vr), known AS (SELECT DISTINCT entity_id AS id FROM t), req AS (SELECT DISTINCT entity_id AS s1_id FROM s1)"
)


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return validate.rows_of(table(spark, sf, "match_labels"), "source1_entity_id", "matched_entity_ids")


def _required(spark: SparkSession, sf: str) -> DataFrame:
    return s1_of(spark, sf).select(F.col("entity_id").alias("s1_id"))


@query(f"WITH {VAL} SELECT s1_id FROM vr GROUP BY 1 HAVING count(*) > 1")
def validate_duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return validate.duplicate_rows(_rows(spark, sf))


@query(f"WITH {VAL} SELECT DISTINCT s1_id FROM vr WHERE len(ids) <> len(list_distinct(ids))")
def validate_repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    return validate.repeated_ids(_rows(spark, sf))


@query(f"WITH {VAL} SELECT DISTINCT s1_id FROM ve WHERE starts_with(id, 'S1-')")
def validate_own_ids(spark: SparkSession, sf: str) -> DataFrame:
    return validate.own_ids(_rows(spark, sf))


@query(f"WITH {VAL} SELECT DISTINCT s1_id FROM ve WHERE NOT (starts_with(id, 'S1-') OR starts_with(id, 'S2-') OR starts_with(id, 'S3-'))")
def validate_bad_ids(spark: SparkSession, sf: str) -> DataFrame:
    return validate.bad_ids(_rows(spark, sf))


@query(f"WITH {VAL} SELECT DISTINCT s1_id FROM ve ANTI JOIN known USING (id) WHERE starts_with(id, 'S2-') OR starts_with(id, 'S3-')")
def validate_unknown_ids(spark: SparkSession, sf: str) -> DataFrame:
    return validate.unknown_ids(_rows(spark, sf), targets_of(spark, sf).select(F.col("entity_id").alias("id")))


@query(f"WITH {VAL} SELECT s1_id FROM req ANTI JOIN vr USING (s1_id)")
def validate_missing_rows(spark: SparkSession, sf: str) -> DataFrame:
    return validate.missing_rows(_rows(spark, sf), _required(spark, sf))


@query(f"WITH {VAL} SELECT DISTINCT s1_id FROM vr ANTI JOIN req USING (s1_id)")
def validate_extra_rows(spark: SparkSession, sf: str) -> DataFrame:
    return validate.extra_rows(_rows(spark, sf), _required(spark, sf))


@query(f"WITH {VAL}, {CAND} SELECT DISTINCT s1_id FROM ve ANTI JOIN cand ON cand.s1_id = ve.s1_id AND cand.cand_id = ve.id")
def validate_subset(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates_of(spark, sf).groupBy("s1_id").agg(F.collect_list("cand_id").alias("ids"))
    return validate.not_among_candidates(_rows(spark, sf), c)


@query(f"WITH {VAL} SELECT count(*) AS n_rows, count(*) FILTER (len(ids) = 0) AS n_empty, count(*) FILTER (len(ids) > 0) AS n_filled FROM vr")
def validate_summary(spark: SparkSession, sf: str) -> DataFrame:
    return validate.summary(_rows(spark, sf))


@query()
def validate_findings(spark: SparkSession, sf: str) -> DataFrame:
    """All rules in one table; each has its own query with SQL above."""
    return validate.findings(_rows(spark, sf), _required(spark, sf), targets_of(spark, sf).select(F.col("entity_id").alias("id")))
