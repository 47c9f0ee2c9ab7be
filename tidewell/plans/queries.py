"""Queries over the standard tables, and SQL that says the same to another engine."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..functions import text as X
from ..functions import vectors as V
from ..functions.embed import embed, embed_chunks
from ..operators import metrics as M
from ..operators import pooling as P
from ..operators import tables as T
from ..operators.kmeans import minibatch_kmeans
from ..sources import datasets as S
from ..sources.segments import Segments, in_batches
from . import estimate, plasmode, runner, scm
from .plasmode import Scenario

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str, digits: int = 6):
    # adding 0 turns a rounded -0.0 into 0.0
    return (F.round(c, digits) + 0.0).alias(name)


def s6(sql: str, name: str, digits: int = 6) -> str:
    return f"round({sql}, {digits}) + 0.0 AS {name}"


# --- SQL pieces -------------------------------------------------------------

U = lambda seed, tag, i: f"(('0x' || substr(md5('{seed}:{tag}:' || {i}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
N = lambda seed, tag, i, mean=0.0, std=1.0: f"({mean} + {std} * sqrt(-2 * ln(1 - {U(seed, tag + ':u', i)})) * cos({2 * math.pi!r} * {U(seed, tag + ':v', i)}))"
SIG = lambda x: f"(1 / (1 + exp(-({x}))))"
BCE = lambda x, y: f"(greatest({x}, 0.0) - ({x}) * ({y}) + ln(1 + exp(-abs({x}))))"

CHUNKS = """
    w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS ws FROM documents),
    c0 AS (SELECT doc_id, i, array_to_string(ws[i * 96 + 1 : i * 96 + 128], ' ') AS chunk
           FROM w, unnest(range(0, greatest(0, ceil((len(ws) - 128) / 96.0))::INT + 1)) AS t(i) WHERE len(ws) > 0),
    c1 AS (SELECT doc_id, chunk, min(i) AS i FROM c0 GROUP BY ALL),
    chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, chunk FROM c1)"""
EMBEDDED = (
    CHUNKS
    + """,
    tok AS (SELECT doc_id, pos, ('0x' || substr(md5(x), 1, 8))::BIGINT AS h FROM (SELECT doc_id, pos, unnest(string_split(lower(chunk), ' ')) AS x FROM chunks)),
    raw AS (SELECT doc_id, pos, h % 64 AS k, sum(CASE WHEN h % 128 >= 64 THEN 1.0e0 ELSE -1.0e0 END) AS v FROM tok GROUP BY ALL),
    nrm AS (SELECT doc_id, pos, greatest(sqrt(sum(v * v)), 1e-12) AS n FROM raw GROUP BY ALL),
    emb AS (SELECT doc_id, pos, k, v / n AS v FROM raw JOIN nrm USING (doc_id, pos))"""
)
VECTORS = """
    v AS (SELECT vec_id // 10 AS doc_id, vec_id % 10 AS pos, embedding::DOUBLE[] AS e FROM embeddings)"""
BANK = """
    bk AS (SELECT label AS conf_idx, k, avg(embedding[k]::DOUBLE) AS x FROM embeddings, range(1, 65) AS t(k) GROUP BY ALL),
    bank AS (SELECT conf_idx, list(x ORDER BY k) AS vec FROM bk GROUP BY conf_idx)"""
COS = "(list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))))"
MATCHES = VECTORS + "," + BANK + f""",
    m AS (SELECT doc_id, pos, conf_idx, {COS.format("e", "vec")} AS s FROM v, bank)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as chunks of made-up documents of ten."""
    return read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("doc_id"), (F.col("vec_id") % 10).alias("pos"), V.doubles("embedding").alias("emb"))


def bank(spark: SparkSession, d: str) -> DataFrame:
    """Mean vectors of the labels, as confounders."""
    long = read(spark, d, "embeddings").select("label", F.posexplode(V.doubles("embedding")).alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("x"))
    vec = F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"])
    return long.groupBy("label").agg(vec.alias("vec")).select(F.col("label").alias("conf_idx"), F.lit(0).alias("head"), "vec")


def matches(spark: SparkSession, d: str) -> DataFrame:
    return P.match(vectors(spark, d), bank(spark, d))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Labels with drawn logits: material for the metrics, without meaning."""
    draw = lambda tag: rng.normal(7, tag, "doc_id")
    rows = read(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("t"), F.col("toxic").cast("double").alias("y"))
    return rows.withColumns({"y0_logit": draw("y0"), "y1_logit": draw("y1"), "propensity_logit": draw("p"), "true_ite": draw("true")}).withColumn("estimated_ite", F.col("true_ite") * 0.8 + draw("est") * 0.5)


PREDICTIONS = f"""
    p AS (SELECT doc_id, quality::DOUBLE AS t, toxic::DOUBLE AS y, {N(7, "y0", "doc_id")} AS y0_logit, {N(7, "y1", "doc_id")} AS y1_logit,
                 {N(7, "p", "doc_id")} AS propensity_logit, {N(7, "true", "doc_id")} AS true_ite,
                 {N(7, "true", "doc_id")} * 0.8 + {N(7, "est", "doc_id")} * 0.5 AS estimated_ite FROM labels)"""


# --- scans, contracts, projections ---------------------------------------------


@query("SELECT doc_id, lang, source, n_chars, length(text) AS length FROM documents")
def scan_parquet(spark, d):
    return read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.length("text").alias("length").cast("long"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS null_text, count(*) FILTER (WHERE quality IS NULL) AS null_treatment, count(*) FILTER (WHERE toxic IS NULL) AS null_outcome FROM documents LEFT JOIN labels USING (doc_id)")
def validate_nulls(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return rows.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(n) for c, n in (("text", "null_text"), ("quality", "null_treatment"), ("toxic", "null_outcome"))])


@query("SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS treatment FROM documents")
def category_index(spark, d):
    return T.category_index(read(spark, d, "documents").select("doc_id", "source"), "source", "treatment")


@query(f"WITH {PREDICTIONS} SELECT doc_id, {s6('CASE WHEN t > 0.5 THEN y1_logit ELSE y0_logit END', 'factual')}, {s6('y1_logit - y0_logit', 'ite')}, {s6(SIG('propensity_logit'), 'propensity')}, {s6('y0_logit + 0.5 * (y1_logit - y0_logit)', 'recomposed')}, 1 AS cv_fold FROM p")
def factual_and_effect(spark, d):
    ite = F.col("y1_logit") - F.col("y0_logit")
    return predictions(spark, d).select("doc_id", r6(F.when(F.col("t") > 0.5, F.col("y1_logit")).otherwise(F.col("y0_logit")), "factual"), r6(ite, "ite"), r6(V.sigmoid("propensity_logit"), "propensity"), r6(F.col("y0_logit") + 0.5 * ite, "recomposed"), F.lit(1).alias("cv_fold"))


# --- text ---------------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT doc_id, pos, md5(chunk) AS chunk_md5, length(chunk) AS length FROM chunks")
def chunk_documents(spark, d):
    return X.explode_chunks(read(spark, d, "documents")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("chunk").alias("chunk_md5"), F.length("chunk").cast("long").alias("length"))


@query("SELECT doc_id, sha1(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_sha1, substr(md5(lang || source), 1, 12) AS config_hash FROM documents")
def text_hashes(spark, d):
    return read(spark, d, "documents").select("doc_id", X.text_hash("text").alias("text_sha1"), F.substring(F.md5(F.concat("lang", "source")), 1, 12).alias("config_hash"))


@query("SELECT page_id, substr(regexp_replace(url, '[^\\p{L}\\p{N}\\-._]', '_', 'g'), 1, 100) AS name, CASE WHEN length(url) > 30 THEN substr(url, 1, 30) || '...' ELSE url END AS label FROM pages")
def safe_names(spark, d):
    return read(spark, d, "pages").select("page_id", X.safe_filename("url").alias("name"), X.shortened("url", 30).alias("label"))


@query("SELECT conv_id, turn, md5(trim(CASE WHEN strpos(lower(text), ' the ') > 0 THEN substr(text, strpos(lower(text), ' the ') + 5) ELSE text END)) AS answer_md5, length(CASE WHEN strpos(lower(text), 'json') = 0 THEN text || repeat('x', 30) ELSE text END) AS asked FROM conversations")
def strip_and_ask(spark, d):
    rows = read(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.md5(X.strip_reasoning("text", " the ")).alias("answer_md5"), F.length(X.ask_for_json("text")).cast("long").alias("asked"))


@query("SELECT event_id, CASE WHEN json_valid(props) THEN props END AS found FROM events")
def embedded_json(spark, d):
    wrapped = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))
    return read(spark, d, "events").select("event_id", X.embedded_json(wrapped).alias("found"))


@query("SELECT event_id, CASE WHEN json_valid(props) THEN '{\"k\": ' || json_extract_string(props, '$.k') || '}' END AS found FROM events")
def final_json(spark, d):
    wrapped = F.concat(F.lit('First {\"draft\": {\"k\": -1}} but {not json} then '), "props", F.lit(" and so on"))
    return read(spark, d, "events").select("event_id", X.final_json(wrapped).alias("found"))


_K = "json_extract_string(props, '$.k')"


@query(
    f"""SELECT event_id, '{{"k": ' || {_K} || ', "tags": ["x", "y"]}}' AS cut_off, '{{"a": 1, "k": ' || {_K} || '}}' AS nested, '{{"k": ' || {_K} || ', "note": "a }} or {{ \\"b\\""}}' AS quoted
    FROM events WHERE json_valid(props)"""
)
def keyed_json(spark, d):
    """Replies that end too early, that hold the object inside others after prose with braces, and that have braces in strings."""
    rows = read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")).where("k IS NOT NULL")
    given = lambda text: F.regexp_replace(F.lit(text), "<k>", F.col("k"))
    cut = given('Well {maybe} so: {"meta": {"note": "no } here"}, "result": {"k": <k>, "tags": ["x", "y')
    nested = given('First {"draft": {"j": -1}} and {not json}, then {"out": [{"j": 2}, {"k": <k>, "a": 1,},], "more": tr')
    quoted = given('```json\n{"k": <k>, "note": "a } or { \\"b\\""}\n``` as asked')
    return rows.select("event_id", *[X.keyed_json(c, ["k"]).alias(n) for c, n in ((cut, "cut_off"), (nested, "nested"), (quoted, "quoted"))])


@query(f"SELECT count(*) AS n, {s6('avg(length(text))', 'mean_length')}, count(*) FILTER (WHERE length(text) > 0) AS non_empty FROM documents")
def text_statistics(spark, d):
    return read(spark, d, "documents").agg(F.count("*").alias("n"), r6(F.avg(F.length("text")), "mean_length"), F.count_if(F.length("text") > 0).alias("non_empty"))


# --- vectors, matching, pooling ---------------------------------------------------


@query(f"WITH {VECTORS} SELECT doc_id, pos, {s6('sqrt(list_dot_product(e, e))', 'norm')}, {s6('e[1] / sqrt(list_dot_product(e, e))', 'first')}, {s6(SIG('e[1]'), 'sigmoid')}, {s6('atanh(least(greatest(e[2] * 10, -0.999), 0.999))', 'stretched')}, {s6('exp(e[1]) / (exp(e[1]) + exp(e[2]) + exp(e[3]))', 'share')} FROM v")
def vector_functions(spark, d):
    e = lambda i: F.element_at("emb", i)
    return vectors(spark, d).select("doc_id", "pos", r6(V.norm("emb"), "norm"), r6(F.element_at(V.normalised("emb"), 1), "first"), r6(V.sigmoid(e(1)), "sigmoid"), r6(V.stretched(e(2) * 10), "stretched"), r6(F.element_at(V.softmax(F.slice("emb", 1, 3)), 1), "share"))


@query(f"WITH {VECTORS} SELECT a.doc_id, a.pos FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.doc_id = a.doc_id AND b.pos < a.pos AND {COS.format('a.e', 'b.e')} > 0.2)")
def near_duplicate_vectors(spark, d):
    return P.drop_near_duplicates(vectors(spark, d), 0.2).select("doc_id", "pos")


@query(f"WITH {MATCHES} SELECT doc_id, pos, conf_idx, {s6('s', 's')} FROM m")
def match_bank(spark, d):
    return matches(spark, d).select("doc_id", "pos", "conf_idx", r6(F.col("s"), "s"))


_G = 1 + math.log(2)
_POOLED = {
    "max": "max(s)",
    "lsep": "ln(sum(exp(s)))",
    "gem": f"pow(avg(pow(greatest(s, 0) + 1e-6, {_G!r})), {1 / _G!r})",
    "topk": "list_avg(list(s ORDER BY s DESC)[1:3])",
    "attn": "sum(exp(s) * s) / sum(exp(s))",
    "noisyor": "ln((1 - exp(sum(ln(1 - 1 / (1 + exp(-s)))))) / exp(sum(ln(1 - 1 / (1 + exp(-s))))))",
}


def _pool(mode: str):
    def run(spark, d):
        made = P.pooled_features(vectors(spark, d), bank(spark, d), mode)
        return P.long_features(made).select("doc_id", "feat_idx", r6(F.col("value"), "value"))

    run.__name__ = f"pool_{mode}"
    return run


for _mode, _sql in _POOLED.items():
    query(f"WITH {MATCHES} SELECT doc_id, conf_idx AS feat_idx, {s6(_sql, 'value')} FROM m GROUP BY ALL")(_pool(_mode))
query(f"WITH {MATCHES}, g AS (SELECT doc_id, conf_idx, avg(s) AS a, sqrt(var_pop(s) + 1e-6) AS b FROM m GROUP BY ALL) SELECT doc_id, conf_idx AS feat_idx, {s6('a', 'value')} FROM g UNION ALL SELECT doc_id, conf_idx + 10, {s6('b', 'value')} FROM g")(_pool("stats"))


@query(f"WITH {VECTORS} SELECT doc_id, k - 1 AS feat_idx, {s6('avg(e[k])', 'value')} FROM v, range(1, 65) AS t(k) GROUP BY ALL")
def pool_without_bank(spark, d):
    return P.mean_vectors(vectors(spark, d)).select("doc_id", "feat_idx", r6(F.col("value"), "value"))


def document_features(spark, d, mode: str = "attn", threshold: float = 0.9) -> DataFrame:
    """Documents to pooled features: chunk, embed, drop near-duplicates, match, pool, standardise."""
    chunks = embed_chunks(read(spark, d, "documents"))
    return P.standardise(P.long_features(P.pooled_features(chunks, bank(spark, d), mode, distinct=threshold)))


@query(
    f"""WITH {EMBEDDED},{BANK},
    near AS (SELECT DISTINCT b.doc_id, b.pos FROM emb a JOIN emb b ON a.doc_id = b.doc_id AND a.k = b.k AND a.pos < b.pos GROUP BY b.doc_id, b.pos, a.pos HAVING sum(a.v * b.v) > 0.9),
    kept AS (SELECT doc_id, pos FROM chunks ANTI JOIN near USING (doc_id, pos)),
    unit AS (SELECT conf_idx, k - 1 AS k, x / sqrt(sum(x * x) OVER (PARTITION BY conf_idx)) AS x FROM bk),
    hit AS (SELECT e.doc_id, e.pos, u.conf_idx, sum(e.v * u.x) AS s FROM emb e JOIN kept USING (doc_id, pos) JOIN unit u USING (k) GROUP BY ALL),
    f AS (SELECT doc_id, conf_idx, sum(exp(s) * s) / sum(exp(s)) AS x FROM hit GROUP BY ALL)
    SELECT doc_id, conf_idx AS feat_idx, {s6("(x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5)", "value", 5)} FROM f WINDOW w AS (PARTITION BY conf_idx)"""
)
def document_features_attn(spark, d):
    return document_features(spark, d).select("doc_id", "feat_idx", r6(F.col("value"), "value", 5))


@query(
    f"""WITH {EMBEDDED},{BANK}, unit AS (SELECT conf_idx, k - 1 AS k, x / sqrt(sum(x * x) OVER (PARTITION BY conf_idx)) AS x FROM bk),
    hit AS (SELECT e.doc_id, e.pos, u.conf_idx, round(sum(e.v * u.x), 9) + 0.0 AS s FROM emb e JOIN unit u USING (k) GROUP BY ALL),
    r AS (SELECT conf_idx, row_number() OVER w AS rank, s, doc_id, pos FROM hit WINDOW w AS (PARTITION BY conf_idx ORDER BY s DESC, doc_id, pos) QUALIFY rank <= 10)
    SELECT conf_idx, CASE WHEN conf_idx < 3 THEN 'explicit' ELSE 'latent' END AS confounder_type, rank, {s6('s', 'activation')}, doc_id, pos, md5(chunk) AS chunk_md5 FROM r JOIN chunks USING (doc_id, pos)"""
)
def interpret_top_chunks(spark, d):
    """The documents' chunks that speak most for each of the bank's vectors; sums of floating numbers are rounded before they are ordered."""
    chunks = X.explode_chunks(read(spark, d, "documents"))
    found = P.closest(embed(chunks.withColumn("_text", F.col("chunk")), text="_text"), bank(spark, d), digits=9)
    top = M.top_chunks(found, explicit=3)
    return top.select("conf_idx", "confounder_type", "rank", r6(F.col("activation"), "activation"), "doc_id", F.col("pos").cast("long").alias("pos"), F.md5("chunk_text").alias("chunk_md5"))


@query(f"WITH {MATCHES} SELECT doc_id, conf_idx AS feat_idx, conf_idx // 2 AS confounder, conf_idx % 2 AS head, {s6('max(s)', 'value')} FROM m GROUP BY ALL")
def pool_two_heads(spark, d):
    """The bank's vectors as two heads of half as many confounders."""
    heads = bank(spark, d).select(F.floor(F.col("conf_idx") / 2).cast("int").alias("conf_idx"), (F.col("conf_idx") % 2).cast("int").alias("head"), "vec")
    out = P.long_features(P.pooled_features(vectors(spark, d), heads, "max"))
    return out.select("doc_id", "feat_idx", F.floor(F.col("feat_idx") / 2).alias("confounder"), (F.col("feat_idx") % 2).alias("head"), r6(F.col("value"), "value"))


@query(f"WITH {VECTORS} SELECT doc_id, pos, 70 AS n, {s6('list_sum(e)', 'total')}, 0.0e0 AS last FROM v")
def padded_features(spark, d):
    p = V.padded("emb", 64, 70)
    return vectors(spark, d).select("doc_id", "pos", F.size(p).alias("n"), r6(F.aggregate(p, F.lit(0.0), lambda s, x: s + x), "total"), F.element_at(p, 70).alias("last"))


@query(f"WITH {BANK} SELECT n.vec_id AS conf_idx, {s6('coalesce(b.vec, n.embedding::DOUBLE[])[1]', 'first')}, b.vec IS NOT NULL AS taken FROM embeddings n LEFT JOIN bank b ON b.conf_idx = n.vec_id")
def transferred_bank(spark, d):
    """A pretrained bank carried into a longer one."""
    new = read(spark, d, "embeddings").select(F.col("vec_id").alias("conf_idx"), F.lit(0).alias("head"), V.doubles("embedding").alias("vec"))
    old = bank(spark, d)
    out = estimate.transferred_bank(old, new).join(old.select("conf_idx", F.lit(True).alias("_t")), "conf_idx", "left")
    return out.select("conf_idx", r6(F.element_at("vec", 1), "first"), F.coalesce("_t", F.lit(False)).alias("taken"))


@query("SELECT doc_id, length(text) AS length, doc_id % 2 = 0 AS held FROM documents")
def cached_lengths(spark, d):
    """Half of the results are in a cache of segments, the others are made and added; all come from it."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    make = lambda rows, held: rows.select("doc_id", F.length("text").cast("long").alias("length"), F.lit(held).alias("held"))
    cache = Segments(spark, S.scratch(spark), "doc_id")
    cache.get_or_make(docs.where("doc_id % 2 = 0"), lambda rows: make(rows, True))
    return cache.get_or_make(docs, lambda rows: make(rows, False))


@query("SELECT doc_id, length(text) AS length, sha1(text) AS text_sha1 FROM documents")
def resumed_lengths(spark, d):
    """Made in batches with a log; the second call finds all of them in it."""
    docs, path = read(spark, d, "documents").select("doc_id", "text"), S.scratch(spark)
    make = lambda rows: rows.select("doc_id", F.length("text").cast("long").alias("length"), F.sha1("text").alias("text_sha1"))
    in_batches(docs, path, make, "doc_id", 3)
    return in_batches(docs, path, lambda rows: make(rows).where("false"), "doc_id", 3)


FEATURES = MATCHES + ", f AS (SELECT doc_id, conf_idx AS feat_idx, sum(exp(s) * s) / sum(exp(s)) AS value FROM m GROUP BY ALL)"


def features(spark, d):
    return P.long_features(P.pooled_features(vectors(spark, d), bank(spark, d), "attn"))


@query(f"WITH {FEATURES} SELECT feat_idx // 2 AS confounder_idx, feat_idx % 2 AS sub_feature_idx, {', '.join(s6(f'{f}(value)', n) for f, n in (('avg', 'mean'), ('stddev_pop', 'std'), ('min', 'min'), ('max', 'max')))}, {s6('max(value) - min(value)', 'range')} FROM f GROUP BY feat_idx")
def feature_stats(spark, d):
    s = M.feature_stats(features(spark, d), heads=2)
    return s.select("confounder_idx", "sub_feature_idx", *[r6(F.col(c), c) for c in ("mean", "std", "min", "max", "range")])


@query(f"WITH {FEATURES}, g AS (SELECT feat_idx, avg(value) AS a, stddev_pop(value) AS b, max(value) - min(value) AS c FROM f GROUP BY 1) SELECT feat_idx // 2 AS confounder_idx, {s6('avg(a)', 'mean')}, {s6('avg(b)', 'std')}, {s6('avg(c)', 'range')}, CASE WHEN feat_idx // 2 = 0 THEN 'age' WHEN feat_idx // 2 = 1 THEN 'stage' ELSE 'latent_' || (feat_idx // 2 - 2) END AS confounder_name FROM g GROUP BY ALL")
def confounder_summary(spark, d):
    return M.confounder_summary(M.feature_stats(features(spark, d), heads=2), ["age", "stage"]).select("confounder_idx", "confounder_name", *[r6(F.col(c), c) for c in ("mean", "std", "range")])


@query(f"WITH {FEATURES} SELECT a.feat_idx AS feature_i, b.feat_idx AS feature_j, {s6('corr(a.value, b.value)', 'correlation', 5)}, {s6('avg(a.value)', 'mean_i')}, {s6('avg(b.value)', 'mean_j')}, {s6('stddev_pop(a.value)', 'std_i', 5)}, {s6('stddev_pop(b.value)', 'std_j', 5)} FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.feat_idx < b.feat_idx GROUP BY ALL HAVING abs(corr(a.value, b.value)) > 0.1")
def feature_correlations(spark, d):
    return M.correlations(features(spark, d), 0.1).select("feature_i", "feature_j", r6(F.col("correlation"), "correlation", 5), *[r6(F.col(c), c, 6 if c[0] == "m" else 5) for c in ("mean_i", "mean_j", "std_i", "std_j")])


DRIFT = f"""
    hk AS (SELECT label AS latent_idx, vec_id % 2 AS half, k, avg(embedding[k]::DOUBLE) AS x FROM embeddings, range(1, 65) AS t(k) GROUP BY ALL),
    hb AS (SELECT latent_idx, half, list(x ORDER BY k) AS vec FROM hk GROUP BY ALL),
    z AS (SELECT a.latent_idx, {COS.format('a.vec', 'b.vec')} AS c FROM hb a JOIN hb b ON a.latent_idx = b.latent_idx AND a.half = 0 AND b.half = 1)"""


def _drift(spark, d) -> DataFrame:
    """Mean vectors of the labels over rows of even ids, and over those of odd ones, as a bank before and after training."""
    long = read(spark, d, "embeddings").select(F.col("label").alias("latent_idx"), (F.col("vec_id") % 2).alias("half"), F.posexplode(V.doubles("embedding")).alias("k", "x"))
    means = long.groupBy("latent_idx", "half", "k").agg(F.avg("x").alias("x")).groupBy("latent_idx", "half").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("vec"))
    first, last = (means.where(F.col("half") == h).select("latent_idx", "vec") for h in (0, 1))
    return M.latent_drift(first, last)


@query(f"WITH {DRIFT} SELECT latent_idx, {s6('c', 'cosine_similarity')}, {s6('1 - c', 'drift')}, c < 0.95 AS drifted FROM z")
def latent_drift(spark, d):
    return _drift(spark, d).select("latent_idx", r6(F.col("cosine_similarity"), "cosine_similarity"), r6(F.col("drift"), "drift"), (F.col("cosine_similarity") < 0.95).alias("drifted"))


@query(f"WITH {DRIFT} SELECT {s6('avg(c)', 'mean')}, {s6('min(c)', 'min')}, {s6('max(c)', 'max')}, count(*) FILTER (WHERE c < 0.95) AS n_drifted FROM z")
def drift_summary(spark, d):
    return M.drift_summary(_drift(spark, d)).select(*[r6(F.col(c), c) for c in ("mean", "min", "max")], "n_drifted")


# --- metrics, losses, splits ------------------------------------------------------


@query(
    f"""WITH {PREDICTIONS}, s AS (SELECT 'y0' AS head, y0_logit AS x, y AS l FROM p WHERE t < 0.5 UNION ALL SELECT 'y1', y1_logit, y FROM p WHERE t > 0.5 UNION ALL SELECT 'prop', propensity_logit, t FROM p),
    r AS (SELECT *, rank() OVER (PARTITION BY head ORDER BY x) + (count(*) OVER (PARTITION BY head, x) - 1) / 2.0e0 AS rk FROM s)
    SELECT head, {s6("(sum(CASE WHEN l = 1 THEN rk ELSE 0 END) - sum(l) * (sum(l) + 1) / 2) / nullif(sum(l) * sum(1 - l), 0)", "auroc")} FROM r GROUP BY head"""
)
def treatment_aurocs(spark, d):
    return M.treatment_aurocs(predictions(spark, d)).select("head", r6(F.col("auroc"), "auroc"))


_SCORES = f"{s6('avg(true_ite)', 'true_ate')}, {s6('avg(estimated_ite)', 'estimated_ate')}, {s6('avg(estimated_ite) - avg(true_ite)', 'ate_bias')}, {s6('sqrt(avg(pow(estimated_ite - true_ite, 2)))', 'ate_rmse')}, {s6('corr(true_ite, estimated_ite)', 'ite_correlation')}, {s6('covar_samp(true_ite, estimated_ite) / var_pop(true_ite)', 'ite_regression_slope')}"


@query(f"WITH {PREDICTIONS} SELECT t, {_SCORES} FROM p GROUP BY t")
def recovery_scores(spark, d):
    out = M.recovery_scores(predictions(spark, d), ["t"])
    return out.select("t", *[r6(F.col(c), c) for c in out.columns[1:]])


@query(f"WITH {PREDICTIONS} SELECT t, y, count(*) AS n, {s6('avg(estimated_ite)', 'mean_ite', 4)}, {s6('stddev_samp(estimated_ite)', 'std_ite', 4)}, {s6('avg(' + SIG('propensity_logit') + ')', 'mean_propensity', 4)} FROM p GROUP BY t, y")
def prediction_summary(spark, d):
    return predictions(spark, d).groupBy("t", "y").agg(F.count("*").alias("n"), r6(F.avg("estimated_ite"), "mean_ite", 4), r6(F.stddev_samp("estimated_ite"), "std_ite", 4), r6(F.avg(V.sigmoid("propensity_logit")), "mean_propensity", 4))


_F = "(CASE WHEN t > 0.5 THEN y1_logit ELSE y0_logit END)"
_E = f"least(greatest({SIG('propensity_logit')}, 0.001), 0.999)"


@query(
    f"""WITH {PREDICTIONS}, l AS (SELECT avg({BCE(_F, "y")}) AS a, avg({BCE("propensity_logit", "t")}) AS b, pow(avg((y - {SIG(_F)}) * (t / {_E} - (1 - t) / (1 - {_E}))), 2) AS c FROM p)
    SELECT {s6("a", "outcome_loss")}, {s6("b", "propensity_loss")}, {s6("c", "targeted_loss")}, {s6("a + b + 0.1 * c", "loss")} FROM l"""
)
def targeted_loss(spark, d):
    out = predictions(spark, d).agg(*M.targeted_loss())
    return out.select(*[r6(F.col(c), c) for c in out.columns])


_LSE = "ln(exp(y0_logit) + exp(y1_logit) + exp(propensity_logit))"
_P = [SIG("true_ite"), SIG("estimated_ite"), SIG("y0_logit")]
_MEAN = f"(({' + '.join(_P)}) / 3)"


@query(
    f"""WITH {PREDICTIONS}, q AS (SELECT *, (doc_id % 3)::INT AS arm FROM p),
    l AS (SELECT avg({_LSE} - CASE arm WHEN 0 THEN y0_logit WHEN 1 THEN y1_logit ELSE propensity_logit END) AS a,
                 avg({BCE("CASE arm WHEN 0 THEN true_ite WHEN 1 THEN estimated_ite ELSE y0_logit END", "y")}) AS b,
                 -avg(({" + ".join(f"pow({p} - {_MEAN}, 2)" for p in _P)}) / 2) AS c FROM q)
    SELECT {s6("a", "arm_loss")}, {s6("b", "outcome_loss")}, {s6("c", "spread_loss")}, {s6("b + a + 0.1 * c", "loss")} FROM l"""
)
def multi_arm_loss(spark, d):
    rows = predictions(spark, d).select((F.col("doc_id") % 3).cast("int").alias("arm"), "y", F.array("y0_logit", "y1_logit", "propensity_logit").alias("arm_logits"), F.array("true_ite", "estimated_ite", "y0_logit").alias("outcome_logits"))
    out = rows.agg(*M.multi_arm_loss())
    return out.select(*[r6(F.col(c), c) for c in out.columns])


@query("SELECT doc_id, ntile(7) OVER (ORDER BY md5('42:fold:' || doc_id), doc_id) AS cv_fold FROM documents")
def exact_folds(spark, d):
    return T.exact_folds(read(spark, d, "documents").select("doc_id"), 7)


@query(f"SELECT doc_id, CASE WHEN {U(3, 'split', 'doc_id')} < 0.8 THEN 'train' ELSE 'eval' END AS split, (floor({U(42, 'fold', 'doc_id')} * 5) + 1)::INT AS cv_fold FROM documents")
def hash_splits(spark, d):
    return T.folds(T.split_rows(read(spark, d, "documents").select("doc_id"), 0.8, 3), 5)


@query(f"SELECT doc_id, {U(42, 'validation', 'doc_id')} < 0.1 AS validates FROM documents")
def inner_validation(spark, d):
    return read(spark, d, "documents").select("doc_id", (rng.uniform(42, "validation", "doc_id") < 0.1).alias("validates"))


@query(f"SELECT c_custkey, {s6(N(5, 'n', 'c_custkey', 1.0, 2.0), 'normal')}, ({U(5, 'b', 'c_custkey')} < 0.3)::INT AS flag, CASE WHEN {U(5, 'c', 'c_custkey')} < 0.5 THEN 'a' WHEN {U(5, 'c', 'c_custkey')} < 0.75 THEN 'b' ELSE 'c' END AS level FROM customer")
def keyed_draws(spark, d):
    return read(spark, d, "customer").select("c_custkey", r6(rng.normal(5, "n", "c_custkey", 1.0, 2.0), "normal"), rng.bernoulli(0.3, 5, "b", "c_custkey").alias("flag"), rng.categorical(["a", "b", "c"], [2.0, 1.0, 1.0], 5, "c", "c_custkey").alias("level"))


@query("SELECT doc_id FROM documents ORDER BY md5('42:sample:' || doc_id), doc_id LIMIT 100")
def sample_rows(spark, d):
    return T.sampled(read(spark, d, "documents").select("doc_id"), 100)


@query("SELECT range AS patient_id FROM range(2000) ANTI JOIN labels ON range = doc_id")
def remaining_ids(spark, d):
    return T.remaining(2000, read(spark, d, "labels").withColumnRenamed("doc_id", "patient_id"))


@query(
    f"""WITH s AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INT AS scenario_idx FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
    g AS (SELECT *, 1000 * scenario_idx + repeat_idx AS model FROM s, (SELECT unnest(range(3))::INT AS repeat_idx))
    SELECT doc_id, scenario_idx, repeat_idx, model, CASE WHEN {U("' || model || '", "split", "doc_id")} < 0.8 THEN 'train' ELSE 'eval' END AS sim_split FROM labels, g"""
)
def experiment_rows(spark, d):
    """The labelled rows in every experiment: a scenario for each language, three repeats, each with its own split."""
    langs = read(spark, d, "documents").where("lang IS NOT NULL").select("lang").distinct()
    scenarios = T.category_index(langs, "lang", "scenario_idx").drop("lang")
    return T.experiments(read(spark, d, "labels").select("doc_id"), scenarios, 3, 0.8).select("doc_id", F.col("scenario_idx").cast("int").alias("scenario_idx"), "repeat_idx", "model", "sim_split")


# --- simulation -------------------------------------------------------------------


def _plasmode_rows(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), V.doubles("embedding").alias("features"), (F.col("label") % 2).cast("double").alias("t"))


def _plasmode_sql(linear: bool) -> str:
    dots = [f"list_dot_product(embedding::DOUBLE[], {plasmode.direction(k, 64)!r}::DOUBLE[])" for k in (0, 1)]
    z = lambda c: f"(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ())"
    base = math.log(0.2 / 0.8)
    return f"""WITH a AS (SELECT vec_id AS doc_id, (label % 2)::DOUBLE AS t, {dots[0]} AS d0, {dots[1]} AS d1 FROM embeddings),
    b AS (SELECT doc_id, t, {base!r} + {z("d0") if linear else "d0"} AS y0, 0.5 + {z("d1")} AS ite FROM a)
    SELECT doc_id, t, {s6("y0", "true_y0_logit")}, {s6("y0 + ite", "true_y1_logit")}, {s6("ite", "true_ite")}, ({U(0, "outcome", "doc_id")} < {SIG("y0 + ite * t")})::DOUBLE AS y FROM b"""


def _plasmode(spark, d, scenario):
    out = plasmode.simulate(_plasmode_rows(spark, d), 64, scenario)
    return out.select("doc_id", "t", r6(F.col("true_y0_logit"), "true_y0_logit"), r6(F.col("true_y1_logit"), "true_y1_logit"), r6(F.col("true_ite"), "true_ite"), "y")


@query(_plasmode_sql(True))
def plasmode_phi_linear(spark, d):
    return _plasmode(spark, d, Scenario())


@query(_plasmode_sql(False))
def plasmode_uplift_linear(spark, d):
    return _plasmode(spark, d, Scenario("uplift_nonlinear"))


def _layered_sql(scenario: Scenario) -> str:
    """One layer a CTE: every layer's list is named before the next one reads it."""
    deep = scenario.generation_mode == "deep_nonlinear"
    runs = {"n0": "e || [0.0::DOUBLE]", "n1": "e || [1.0::DOUBLE]"} if deep else {"n0": "e"}
    layers = plasmode._layers(2 if deep else 3, [65 if deep else 64, *(scenario.deep_nonlinear_hidden_dims if deep else scenario.uplift_hidden_dims), 1])
    ctes = [f"l0 AS (SELECT vec_id, label, e, {', '.join(f'{x} AS {n}' for n, x in runs.items())} FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))"]
    for i, w in enumerate(layers):
        units = lambda n, w=w: [f"list_dot_product({n}, {w[:, j].tolist()!r}::DOUBLE[])" for j in range(w.shape[1])]
        last = i == len(layers) - 1
        made = ", ".join(f"{units(n)[0]} AS {n}" if last else f"[{', '.join(f'greatest({u}, 0.0)' for u in units(n))}] AS {n}" for n in runs)
        ctes.append(f"l{i + 1} AS (SELECT vec_id, label, e, {made} FROM l{i})")
    z = lambda c: f"(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ())"
    base = math.log(0.2 / 0.8)
    y, tau = (z("n0"), z("(n1 - n0)")) if deep else (f"list_dot_product(e, {plasmode.direction(0, 64)!r}::DOUBLE[])", z("n0"))
    t = "(label % 2)::DOUBLE" if scenario.preserve_observed_treatments else f"({U(0, 'treatment', 'vec_id')} < 0.5)::DOUBLE"
    return f"""WITH {", ".join(ctes)},
    b AS (SELECT vec_id AS doc_id, {t} AS t, {base!r} + {y} AS y0, 0.5 + {tau} AS ite FROM l{len(layers)})
    SELECT doc_id, t, {s6("y0", "true_y0_logit")}, {s6("y0 + ite", "true_y1_logit")}, {s6("ite", "true_ite")}, ({U(0, "outcome", "doc_id")} < {SIG("y0 + ite * t")})::DOUBLE AS y FROM b"""


DEEP = Scenario("deep_nonlinear", preserve_observed_treatments=False, deep_nonlinear_hidden_dims=(8, 4))
UPLIFT = Scenario("uplift_nonlinear", uplift_hidden_dims=(6,))


@query(_layered_sql(DEEP))
def plasmode_deep_nonlinear(spark, d):
    return _plasmode(spark, d, DEEP)


@query(_layered_sql(UPLIFT))
def plasmode_uplift_hidden(spark, d):
    return _plasmode(spark, d, UPLIFT)


#: A model as a user's file states it.
SPEC = {
    "confounders": [{"name": "age", "type": "continuous", "unit": "years"}, {"name": "ward", "type": "categorical", "categories": ["a", "b", "c"]}, {"name": "score", "type": "continuous"}],
    "treatment_equation": {"intercept": 0.2, "coefficients": {"age": 1.5, "ward_b": -1.0}, "interactions": [{"terms": ["age", "score"], "coefficient": 2.0}]},
    "outcome_equation": {"intercept": -1.0, "coefficients": {"age": 1.0, "ward_c": 2.0, "score": -0.5}},
    "summary_statistics": {"age": {"mean": 60.0, "std": 10.0}, "ward": {"proportions": {"a": 0.5, "b": 0.3, "c": 0.2}}},
}


def _scm_sql(m: scm.Model) -> str:
    columns, terms, below = [], {}, 0.0  # the same draws as the columns of plans.scm
    for v in m.variables:
        if v.type == "continuous":
            columns.append(f"{N(m.seed, v.name, 'c_custkey', v.mean, v.std)} AS {v.name}")
            terms[v.name] = f"(({v.name} - {v.mean}) / {v.std})"
        else:
            u, cases, below = U(m.seed, v.name, "c_custkey"), "", 0.0
            for c, share in zip(v.categories[:-1], v.shares, strict=False):
                below += share
                cases += f" WHEN {u} < {below / sum(v.shares)!r} THEN '{c}'"
            columns.append(f"CASE{cases} ELSE '{v.categories[-1]}' END AS {v.name}")
            terms |= {f"{v.name}_{c}": f"(CASE WHEN {v.name} = '{c}' THEN 1.0 ELSE 0.0 END)" for c in v.categories[1:]}

    def logit(e: scm.Equation, arm: int | None) -> str:
        parts = [str(e.intercept), *(f"{c} * {terms[k]}" for k, c in e.coefficients.items()), *(f"{c} * {' * '.join(terms[n] for n in ns)}" for ns, c in e.interactions)]
        if arm:
            parts += [str(e.treatment), *(f"{c} * {terms[k]}" for k, c in e.treatment_interactions.items())]
        return "(" + " + ".join(f"({x})" for x in parts) + ")"

    return f"""WITH a AS (SELECT c_custkey, {", ".join(columns)} FROM customer),
    b AS (SELECT *, {logit(m.treatment, None)} AS tl, {logit(m.outcome, 0)} AS l0, {logit(m.outcome, 1)} AS l1 FROM a),
    c AS (SELECT *, ({U(m.seed, "treatment", "c_custkey")} < {SIG("tl")})::INT AS treatment_indicator FROM b)
    SELECT c_custkey AS patient_id, {", ".join(s6(v.name, v.name) if v.type == "continuous" else v.name for v in m.variables)}, {s6("tl", "true_treatment_logit")}, {s6("l0", "outcome_logit_0")}, {s6("l1", "outcome_logit_1")}, {s6("l1 - l0", "true_ite")},
           treatment_indicator, ({U(m.seed, "outcome", "c_custkey")} < {SIG("CASE WHEN treatment_indicator = 1 THEN l1 ELSE l0 END")})::INT AS outcome_indicator FROM c"""


def _patients(spark, d, model=None):
    return scm.patients(read(spark, d, "customer").select(F.col("c_custkey").alias("patient_id")), model or scm.default_model())


def _shown(p: DataFrame, model: scm.Model) -> DataFrame:
    variables = [r6(F.col(v.name), v.name) if v.type == "continuous" else F.col(v.name) for v in model.variables]
    return p.select("patient_id", *variables, *[r6(F.col(c), c) for c in ("true_treatment_logit", "outcome_logit_0", "outcome_logit_1", "true_ite")], "treatment_indicator", "outcome_indicator")


@query(_scm_sql(scm.default_model()))
def scm_patients(spark, d):
    return _shown(_patients(spark, d), scm.default_model())


@query(_scm_sql(scm.model_from_spec(SPEC)))
def scm_from_spec(spark, d):
    model = scm.model_from_spec(SPEC)
    return _shown(_patients(spark, d, model), model)


@query()
def scm_calibrated_statistics(spark, d):
    return scm.dataset_statistics(_patients(spark, d, scm.calibrated(scm.rescaled(scm.default_model(), spark), spark)))


# --- estimation (learned: rows only) ----------------------------------------------


def analysis_rows(spark, d) -> DataFrame:
    """Features of the documents that have labels, not standardised, with quality as treatment and toxicity as outcome: a test convenience without causal meaning.

    Written once: what trains on them reads them many times.
    """
    labels = read(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("t"), F.col("toxic").cast("double").alias("y"))
    docs = read(spark, d, "documents").join(labels, "doc_id", "left_semi")  # a document's features are its own, whatever the others
    feats = P.pooled_features(embed_chunks(docs), bank(spark, d), "attn", distinct=0.9)
    return S.write_table(feats.join(labels, "doc_id"), S.scratch(spark))


@query()
def cross_fitted_effects(spark, d):
    """Each fold is standardised by the other folds' moments and predicted by a network of theirs; all are trained together."""
    rows = estimate.fold_models(T.folds(analysis_rows(spark, d), 3), 3)
    fitted = estimate.train(rows.where("cv_fold <> model"), estimate.Design(10, trunk=(16, 16), outcome=(8,)), models=[1, 2, 3], steps=10, beta=0.1, validation=0.1, batch_size=64)
    return estimate.predict(rows.where("cv_fold = model"), fitted, model_col="model").drop("features", "model")


@query()
def plasmode_recovery(spark, d):
    """Known effects, estimated on the features that made them, scored on the rows held out; one training serves all modes."""
    parts = []
    for i, mode in enumerate(plasmode.MODES):
        rows = T.split_rows(_plasmode_rows(spark, d), 0.8, i).withColumn("in_train", F.col("split") == "train")
        made = plasmode.simulate(rows, 64, Scenario(mode, deep_nonlinear_hidden_dims=(8, 4)), i, 0, F.col("in_train"))
        parts.append(made.withColumns({"generation_mode": F.lit(mode), "model": F.lit(i)}))
    rows = reduce(DataFrame.unionByName, parts)
    fitted = estimate.train(rows.where("in_train"), estimate.Design(64, "uplift", trunk=(16,), outcome=(8,)), steps=10, models=list(range(len(parts))), id_col="doc_id")
    out = estimate.predict(rows.where("NOT in_train"), fitted, model_col="model").withColumn("estimated_ite", F.col("ite_logit"))
    return M.recovery_scores(out, ["generation_mode"])


@query()
def multi_arm_pretraining(spark, d):
    """A network with an arm for each language, then its trunk in a wider binary design that is trained on: the losses of both."""
    arms = T.category_index(read(spark, d, "documents").select("doc_id", "lang"), "lang", "t")
    raw = analysis_rows(spark, d)
    rows = runner.standardised(raw, runner.feature_moments(raw)).drop("t").join(arms, "doc_id")
    n = arms.agg(F.max("t")).first()[0] + 1
    fitted = estimate.train(rows, estimate.Design(10, "arms", trunk=(16, 16), outcome=(8,), arms=int(n)), steps=8, beta=0.1)
    validates = rng.uniform(42, "validation", "doc_id") < 0.1
    wider = runner.standardised(raw, runner.feature_moments(raw.where(~validates))).withColumn("features", V.padded("features", 10, 12))
    moved = estimate.train(wider, estimate.Design(12, trunk=(16, 16), outcome=(8,)), steps=4, beta=0.1, validation=validates, start=fitted.weights[0])
    logs = [estimate.log_table(f, spark).withColumn("phase", F.lit(p)) for p, f in (("pretraining", fitted), ("transferred", moved))]
    return logs[0].unionByName(logs[1]).drop("fold")


@query()
def kmeans_bank(spark, d):
    """Centres of all vectors of the table, by mini-batches that their ids draw."""
    centres = minibatch_kmeans(vectors(spark, d), 5, id_cols=["doc_id", "pos"])
    return spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "conf_idx int, vec array<double>")


@query()
def bank_coordinates(spark, d):
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = bank(spark, d).select("conf_idx", array_to_vector("vec").alias("v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(rows).transform(rows)
    out = PCA(k=2, inputCol="c", outputCol="p").fit(centred).transform(centred).select("conf_idx", vector_to_array("p").alias("p"))
    return out.select("conf_idx", F.element_at("p", 1).alias("x"), F.element_at("p", 2).alias("y"))
