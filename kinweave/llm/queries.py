"""The queries opN_<name> and pipeline: thin applications of the operators to whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import collocations, embedding_dedup, filter_audit, fingerprints, licenses, minhash, packing, pii, piece_codec, quality, secret_scan, token_counts, toxicity
from kinweave.llm.common import documents


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = minhash.near_duplicates(documents(spark, sf_dir))
    return members.select("doc_id", "class_id", "n_copies", "kept", "root")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_secret_scan": op5_secret_scan,
    "op6_license_scan": op6_license_scan,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_piece_codec": op8_piece_codec,
    "op9_token_counts": op9_token_counts,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": pipeline,
}
ORACLE: dict[str, str] = {
    "op7_embedding_near_dedup": """WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id, vec_id AS seen FROM embeddings UNION SELECT r.vec_id, l.y FROM r JOIN l ON l.x = r.seen),
c AS (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY 1),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op11_phrase_collocations": r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
g AS (SELECT lang, k, list_slice(ws, i, i + k - 1) AS p FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, array_to_string(p, ' ') AS phrase, p, count(*) AS f FROM g GROUP BY lang, k, p),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 30),
s AS (SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, c.cut, ((2000000::HUGEINT * c.f) // (x.f + y.f))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
    JOIN f x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, c.cut) JOIN f y ON y.lang = c.lang AND y.p = list_slice(c.p, c.cut + 1, c.k)),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(list_slice(p, i, i + j - 1), ' ') AS phrase, max(f) AS longer
    FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM c), (SELECT unnest([2, 3]) AS j) WHERE j < k AND i + j - 1 <= k GROUP BY 1, 2)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score, cut
FROM m LEFT JOIN i USING (lang, phrase) JOIN n USING (lang) WHERE longer IS NULL OR 100 * longer < 80 * a
QUALIFY rank <= 2000""",
    "op13_filter_audit": r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails
    FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
x AS (SELECT c.*, s.*, fails[instr('ABCDE', filter)] AS now, len(list_filter(range(1, step), lambda i: fails[instr('ABCDE', substr(filter_order, i, 1))])) = 0 AS alive, len(list_filter(fails, lambda b: b)) = 1 AS alone FROM c, s),
r AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (alive AND NOT now), 0) AS kept, coalesce(sum(n) FILTER (alive AND now), 0) AS removed, coalesce(sum(n) FILTER (NOT alive AND now), 0) AS redundant,
    coalesce(sum(n) FILTER (now AND alone), 0) AS unique_fails, coalesce(sum(good) FILTER (alive AND now), 0) AS good_lost, coalesce(sum(toxic) FILTER (alive AND now), 0) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r""",
}
