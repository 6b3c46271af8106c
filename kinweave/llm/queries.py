"""Queries over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grouped_split, linkage, lookalike, mixing, places, reading, tokenize, topn, variants


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return grouped_split.shared_groups(table(spark, sf, "match_labels"))


def p1_splits(spark: SparkSession, sf: str) -> DataFrame:
    return grouped_split.grouped_splits(table(spark, sf, "match_labels"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    others = table(spark, sf, "source2").unionByName(table(spark, sf, "source3"))
    return linkage.unlabelled_links(table(spark, sf, "source1"), others, table(spark, sf, "match_labels")).select("s1_id", "cand_id")


def p2_links(spark: SparkSession, sf: str) -> DataFrame:
    others = table(spark, sf, "source2").unionByName(table(spark, sf, "source3"))
    return linkage.linked(table(spark, sf, "source1"), others).withColumn("confidence", F.round("confidence", 6))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return topn.top_items(table(spark, sf, "candidate_pairs"), 5).select("s1_id", "cand_id")


def p3_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return topn.top_items(table(spark, sf, "candidate_pairs"), 5)


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, sf, "documents"))


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p8_reached(spark: SparkSession, sf: str) -> DataFrame:
    """The shares reached to three decimals: those wanted, where each source has documents enough for the total."""
    return p8_shares(spark, sf).select("source", F.round("share", 3).alias("share"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return variants.variant_pairs(table(spark, sf, "source1"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return places.same_place_pairs(table(spark, sf, "source1"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.same_looking_pairs(table(spark, sf, "source1"))


def p6_forms(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.one_form(table(spark, sf, "source1"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return reading.levels(table(spark, sf, "documents"), table(spark, sf, "reading_samples")).select("doc_id", "band")


def p9_profile(spark: SparkSession, sf: str) -> DataFrame:
    found = reading.levels(table(spark, sf, "documents"), table(spark, sf, "reading_samples"))
    return found.groupBy("band").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_words").alias("words"), F.round(F.avg("rank_50"), 4).alias("mean_rank_50"), F.round(F.avg("length"), 4).alias("mean_length"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_splits, p2_found, p2_links, p3_found, p3_ranked, p4_found, p5_found, p6_found, p6_forms, p7_ids, p8_mixture, p8_shares, p8_reached, p9_found, p9_profile)
}

_ID = "regexp_replace(upper({x}), '[^0-9A-Z]', '', 'g')"


def _record(x: str) -> str:
    t = _ID.format(x=x)
    digits = f"regexp_extract({t}, '^S[123]0*([0-9]+)$', 1)"
    return f"CASE WHEN {digits} = '' THEN NULL ELSE 'S' || substring({t}, 2, 1) || '-' || lpad({digits}, greatest(length({digits}), 9)::INT, '0') END"


_OWNER = f"regexp_extract({_ID.format(x='entity_id')}, '^BE0*([0-9]+)$', 1)"
_TOP = (
    "WITH best AS (SELECT s1_id, cand_id, max(score) AS score FROM candidate_pairs WHERE s1_id IS NOT NULL AND cand_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL), "
    "top AS (SELECT *, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS INT) AS rank FROM best) "
)


def _translated(x: str) -> str:
    """SQL for a text with every look-alike as the plain character, marks joined to their letters."""
    pairs = [(o, plain) for plain, others in lookalike.LOOK_ALIKES.items() for o in others] + [(chr(c + 0xFEE0), chr(c)) for c in range(0x21, 0x7F)]
    pairs += [("ё", "ë"), ("Ё", "Ë"), ("ї", "ï"), ("Ї", "Ï")]
    gone = f"regexp_replace({x}, '[\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}\\x{{AD}}\\x{{34F}}\\x{{FE00}}-\\x{{FE0F}}\\x{{180E}}]', '', 'g')"
    blanks = f"trim(regexp_replace({gone}, '[\\s\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{2800}}\\x{{3164}}]+', ' ', 'g'))"
    for ch, plain in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        blanks = f"replace({blanks}, '{ch}', '{plain}')"
    quoted = lambda i: "".join(p[i] for p in pairs).replace("'", "''")
    return f"nfc_normalize(translate(nfc_normalize({blanks}), '{quoted(0)}', '{quoted(1)}'))"


_MISSING = ", ".join(f"'{w}'" for w in sorted(lookalike.PLACEHOLDERS))
ORACLES: dict[str, str] = {
    "p6_found": (
        "WITH texts AS (SELECT DISTINCT entity_id, 'business_name' AS field_name, business_name AS raw FROM source1 WHERE entity_id IS NOT NULL AND business_name IS NOT NULL "
        "UNION SELECT DISTINCT entity_id, 'business_address', business_address FROM source1 WHERE entity_id IS NOT NULL AND business_address IS NOT NULL), "
        f"forms AS (SELECT *, {_translated('raw')} AS form FROM texts), kept AS (SELECT * FROM forms WHERE lower(form) NOT IN ({_MISSING})) "
        "SELECT DISTINCT a.entity_id AS entity_id_1, b.entity_id AS entity_id_2, field_name FROM kept a JOIN kept b USING (field_name, form) WHERE a.entity_id < b.entity_id AND a.raw <> b.raw"
    ),
    "p8_reached": (
        "WITH held AS (SELECT DISTINCT lower(trim(source)) AS source FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL AND text <> ''), "
        "goal AS (SELECT lower(trim(source)) AS source, target_share FROM mix_targets) "
        "SELECT source, round(CASE WHEN source IN (SELECT source FROM held) THEN target_share / (SELECT sum(target_share) FROM goal SEMI JOIN held USING (source)) ELSE 0 END, 3) AS share FROM goal"
    ),
    "p1_found": (
        f"WITH RECURSIVE raw AS (SELECT DISTINCT {_record('source1_entity_id')} AS s1, CASE WHEN {_OWNER} IN ('', '0') THEN NULL ELSE 'BE-' || lpad({_OWNER}, greatest(length({_OWNER}), 8)::INT, '0') END AS owner, matched_entity_ids AS ids FROM match_labels), "
        f"listed AS (SELECT s1, owner, {_record('x')} AS id FROM (SELECT s1, owner, unnest(regexp_split_to_array(coalesce(ids, ''), '[,;|]')) AS x FROM raw)), "
        "half AS (SELECT s1 AS a, s1 AS b FROM raw WHERE s1 IS NOT NULL UNION SELECT s1, owner FROM raw WHERE s1 IS NOT NULL AND owner IS NOT NULL UNION SELECT s1, id FROM listed WHERE s1 IS NOT NULL AND id IS NOT NULL UNION SELECT owner, id FROM listed WHERE owner IS NOT NULL AND id IS NOT NULL), "
        "edges AS (SELECT a, b FROM half UNION SELECT b, a FROM half), reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a), "
        "parts AS (SELECT a AS node, min(b) AS part, min(b) FILTER (starts_with(b, 'BE-')) AS group_id, count(DISTINCT b) FILTER (starts_with(b, 'S1-')) AS n FROM reach GROUP BY 1) "
        "SELECT node AS source1_entity_id, group_id FROM parts WHERE starts_with(node, 'S1-') AND n > 1 AND group_id IS NOT NULL"
    ),
    "p3_found": _TOP + "SELECT s1_id, cand_id FROM top WHERE rank <= 5",
    "p3_ranked": _TOP + "SELECT * FROM top WHERE rank <= 5",
}
