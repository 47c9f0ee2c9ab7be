"""One query for each operator, over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import contained_items
from .drake_kmeans import CLUSTERS, ROUNDS, SEED, WIDTH, cluster
from .exact_dedup import group_report
from .filter_audit import audit
from .jaccard_join import jaccard_join
from .langid import identify
from .packing import pack
from .quality import quality
from .shared import table
from .sharding import shard
from .shingles import WORD
from .substring_dedup import remove_repeats
from .suffix_dedup import COVER, PERIOD, TIE, remove_repeated_bytes
from .toxicity import toxicity
from .warc import round_trip


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = group_report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(spark, table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    return out.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_packing": op6_packing,
    "op7_warc": op7_warc,
    "op8_sharding": op8_sharding,
    "op9_language_id": op9_language_id,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_filter_audit": op13_filter_audit,
}


def _strings(n: int) -> str:
    """SQL that names all strings of up to ``n`` units by doubling: CTEs m2, m4, .. after m1 (doc_id, i, h1)."""
    steps, k = [], 1
    while 2 * k <= n:
        steps.append(f"m{2 * k} AS (SELECT *, md5(h{k} || lead(h{k}, {k}) OVER (PARTITION BY doc_id ORDER BY i)) AS h{2 * k} FROM m{k})")
        k *= 2
    return ", ".join(steps)


def _name(n: int) -> str:
    """The name of the ``n`` units from a position on, null where the text ends before; over a window w."""
    parts, at = [], 0
    for k in (1 << b for b in reversed(range(n.bit_length()))):
        if n & k:
            parts.append(f"lead(h{k}, {at}) OVER w")
            at += k
    return " || ".join(parts)


def _rounds(n: int) -> str:
    """SQL of ``n`` rounds from the centroids c0 (cluster, c): assignments a1, a2, .. and centroids c1, c2, .."""
    steps = []
    for r in range(1, n + 2):
        steps.append(f"a{r} AS MATERIALIZED (SELECT row, arg_min(cluster, d * {CLUSTERS} + cluster) AS cluster, min(d) AS d FROM (SELECT row, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM x, c{r - 1}) GROUP BY row)")
        if r <= n:
            steps.append(
                f"c{r} AS MATERIALIZED (SELECT c{r - 1}.cluster, coalesce(m, c) AS c FROM c{r - 1} LEFT JOIN (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS m FROM "
                f"(SELECT cluster, k, sum(v[k]) AS s, count(*) AS n FROM a{r} JOIN x USING (row), range(1, {WIDTH + 1}) AS t(k) GROUP BY ALL) GROUP BY cluster) USING (cluster))"
            )
    return ", ".join(steps)


ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""
        WITH w AS (
            SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '{WORD}') AS ws FROM documents
            UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '{WORD}') FROM benchmark
        ), s AS (
            SELECT DISTINCT kind, id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) AS t(i)
        ), n AS (
            SELECT id, count(*) AS n_shingles FROM s WHERE kind = 'i' GROUP BY id
        )
        SELECT d.id AS doc_id, i.id AS item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
        FROM s i JOIN s d ON d.kind = 'd' AND i.g = d.g JOIN n ON n.id = i.id
        WHERE i.kind = 'i' GROUP BY d.id, i.id, n_shingles HAVING count(*) >= 0.8 * n_shingles - 1e-9
    """,
    "op4_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op7_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), q AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
        FROM q
    """,
    "op2_suffix_dedup": f"""
        WITH d AS (
            SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n,
                   count(*) OVER (PARTITION BY coalesce(text, '')) > 1 AS copied, min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id AS copy FROM documents
        ), m1 AS (
            SELECT doc_id, n, copied, copy, unnest(hs) AS h1, generate_subscripts(hs, 1) - 1 AS i FROM (SELECT *, regexp_extract_all(hex(b), '..') AS hs FROM d)
        ), {_strings(400)}, x AS (
            SELECT doc_id, i, n, copied, copy, h1, {_name(400)} AS h, CASE WHEN NOT copy AND i % {PERIOD} IN ({', '.join(map(str, COVER))}) THEN {_name(TIE)} END AS s
            FROM m256 WINDOW w AS (PARTITION BY doc_id ORDER BY i)
        ), y AS (
            SELECT doc_id, i, n, copy, h1, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS hit, s IS NOT NULL AND sum(1 + copied::INT) OVER (PARTITION BY s) > 1 AS tie FROM x
        ), z AS (
            SELECT doc_id, i, n, copy, h1, coalesce(i - max(CASE WHEN hit THEN i END) OVER w < 400, false) AS gone,
                   coalesce(i - max(CASE WHEN tie THEN i END) OVER w < {TIE}, false) AS tied FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY i)
        ), g AS (
            SELECT doc_id, i, h1, gone, gone OR tied OR (copy AND n >= {TIE}) AS shared, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM z
        ), k AS (
            SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, count(*) FILTER (WHERE shared) AS n_shared,
                   string_agg(h1, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id
        )
        SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256, coalesce(n_shared, 0) AS n_shared
        FROM d LEFT JOIN k USING (doc_id)
    """,
    "op5_jaccard_join": f"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS ws FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i) WHERE len(ws) > 0
        ), c AS (
            SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS v FROM s GROUP BY doc_id
        ), t AS (
            SELECT v, n, min(doc_id) AS text_id, count(*) AS n_copies FROM c GROUP BY v, n
        ), ts AS (
            SELECT v, n, n_copies, g FROM t JOIN s ON s.doc_id = t.text_id
        ), pairs AS (
            SELECT a.v AS v, b.v AS u, b.n_copies FROM ts a JOIN ts b ON a.g = b.g AND a.v <> b.v
            GROUP BY a.v, b.v, a.n, b.n, b.n_copies HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9
        ), reached AS (
            WITH RECURSIVE r AS (SELECT v, v AS u FROM t UNION SELECT r.v, pairs.u FROM r JOIN pairs ON pairs.v = r.u) SELECT * FROM r
        ), classes AS (
            SELECT reached.v, min(text_id) AS class_id FROM reached JOIN t ON t.v = reached.u GROUP BY reached.v
        ), links AS (
            SELECT v, sum(n_copies)::BIGINT AS n_links, count(*) AS n_text_links FROM pairs GROUP BY v
        )
        SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(text_id, d.doc_id) AS text_id, coalesce(n_copies, 1) AS n_copies,
               coalesce(n_links, 0) + coalesce(n_copies, 1) - 1 AS n_links, coalesce(n_text_links, 0) AS n_text_links
        FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN t ON t.v = c.v LEFT JOIN classes ON classes.v = c.v LEFT JOIN links ON links.v = c.v
    """,
    "op10_substring_dedup": f"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
        ), m1 AS (
            SELECT doc_id, i, word, md5(word) AS h1 FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w)
        ), {_strings(50)}, x AS (
            SELECT doc_id, i, word, {_name(50)} AS h FROM m32 WINDOW w AS (PARTITION BY doc_id ORDER BY i)
        ), g AS (
            SELECT doc_id, i, word, h IS NOT NULL AND min(doc_id) OVER (PARTITION BY h) < doc_id AS hit FROM x
        ), p AS (
            SELECT doc_id, i, word, coalesce(i - max(CASE WHEN hit THEN i END) OVER (PARTITION BY doc_id ORDER BY i) < 50, false) AS gone FROM g
        ), k AS (
            SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM p GROUP BY doc_id
        )
        SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN k USING (doc_id)
    """,
    "op11_centroid_clustering": f"""
        WITH x AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {WIDTH}
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('{SEED}' || vec_id), v) - 1 AS cluster, v AS c FROM x QUALIFY cluster < {CLUSTERS}
        ), {_rounds(ROUNDS)}, i AS (
            SELECT cluster, sum(d)::BIGINT AS cluster_inertia FROM a{ROUNDS + 1} GROUP BY cluster
        )
        SELECT vec_id, cluster::INT AS cluster, d AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM a{ROUNDS + 1}) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM x JOIN a{ROUNDS + 1} USING (row) JOIN i USING (cluster) JOIN c{ROUNDS} USING (cluster)
    """,
    "op13_filter_audit": """
        WITH t AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
        ), l AS (
            SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
        ), f AS MATERIALIZED (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN coalesce(min(doc_id) OVER (PARTITION BY text) < coalesce(doc_id, 9223372036854775807), false) THEN 'E' ELSE '' END AS fails
            FROM t LEFT JOIN l USING (doc_id)
        ), e AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), o AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM e a, e b, e c, e d, e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), r AS (
            SELECT part, good, toxic, fails, filter_order, coalesce(list_min(list_filter([instr(filter_order, z) FOR z IN regexp_extract_all(fails, '.')], lambda p: p > 0)), 6) AS first FROM f, o
        ), s AS (
            SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, count(*) FILTER (WHERE first > step) AS kept, count(*) FILTER (WHERE first = step) AS removed,
                   count(*) FILTER (WHERE first < step AND contains(fails, substr(filter_order, step, 1))) AS redundant, count(*) FILTER (WHERE fails = substr(filter_order, step, 1)) AS unique_fails,
                   count(*) FILTER (WHERE first = step AND good) AS good_lost, count(*) FILTER (WHERE first = step AND toxic) AS toxic_lost
            FROM r, (SELECT unnest(range(1, 6))::INT AS step) GROUP BY ALL
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM s
    """,
}
