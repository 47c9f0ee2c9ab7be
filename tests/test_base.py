import hashlib
import json
import math
import shutil
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell import cli
from tidewell.functions import text as X
from tidewell.operators import metrics as M
from tidewell.operators import kmeans, nets
from tidewell.operators import pooling as P
from tidewell.operators import tables as T
from tidewell.plans import batches, estimate, queries, runner
from tidewell.plans.config import Architecture, Experiment, create_default_config
from tidewell.plans.runner import ExperimentRunner
from tidewell.sources import datasets as S
from tidewell.sources.segments import Segments, in_batches

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None else round(v, 4) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, sql, name):
    out = queries.QUERIES[name](spark, sf_dir)
    found = sql.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in found.description]
    assert set(cols) == set(out.columns)
    assert Counter(tuple(map(plain, r)) for r in out.select(cols).collect()) == Counter(tuple(map(plain, r)) for r in found.fetchall())


def test_calibrated_statistics_meet_the_targets(spark, sf_dir):
    r = queries.QUERIES["scm_calibrated_statistics"](spark, sf_dir).first()
    assert r.n_patients == r.texts == 150 and abs(r.treatment_rate - 0.5) < 0.15 and abs(r.treatment_logit_std - 2) < 0.4


def plain_kmeans(rows, k, seed, batch, steps, starts):
    """Mini-batch k-means in one loop, from draws made here: the centres."""
    u = lambda start, p, key: int(hashlib.md5(f"{seed}:batch-{p}:{start}:{key}".encode()).hexdigest()[:8], 16) / 2**32
    n = len(rows)
    per = max(1, n // batch)
    best = (math.inf, None)
    x = np.array([v for _, v in rows])
    for start in range(starts):
        of = {}
        for key, v in rows:
            for p in range(-(-steps // per)):
                step = math.floor(u(start, p, key) * (n / min(batch, n))) + p * per
                if step < (p + 1) * per and step < steps:
                    of.setdefault(step, []).append((key, v))
        centres = None
        for step in sorted(of):
            some = np.array([v for _, v in sorted(of[step])])
            if centres is None:
                centres, counts = kmeans.seeded(some, k, seed * 1000 + start), np.zeros(k)
            own = [min((((v - c) ** 2).sum(), j) for j, c in enumerate(centres))[1] for v in some]
            for j in range(k):
                mine = some[[o == j for o in own]]
                if len(mine):
                    centres[j] = (centres[j] * counts[j] + mine.sum(0)) / (counts[j] + len(mine))
                    counts[j] += len(mine)
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        if d.min(1).sum() < best[0]:
            best = (d.min(1).sum(), np.array([x[d.argmin(1) == j].mean(0) if (d.argmin(1) == j).any() else centres[j] for j in range(k)]))
    return best[1]


@pytest.mark.parametrize(("n", "batch"), [(300, 40), (25, 1000)])
def test_minibatch_kmeans_equals_a_plain_loop(spark, n, batch):
    """On any partitioning, with null vectors beside; batches of part of the rows, or of all."""
    r = np.random.default_rng(8)
    rows = [(f"{i}:0", (r.normal(size=4) * 0.2 + (i % 4)).tolist()) for i in range(n)]
    want = plain_kmeans(rows, 4, 3, batch, 6, 2)
    df = spark.createDataFrame([(i, 0, v) for i, (_, v) in enumerate(rows)] + [(999, 0, None)], "doc_id long, pos int, emb array<double>")
    for parts in (1, 5):
        got = kmeans.minibatch_kmeans(df.repartition(parts), 4, id_cols=["doc_id", "pos"], seed=3, batch=batch, steps=6, starts=2)
        assert np.allclose(got, want, atol=1e-9)
    assert kmeans.minibatch_kmeans(df.where("false"), 4, id_cols=["doc_id"]).size == 0
    same = kmeans.minibatch_kmeans(df.where("doc_id < 2").withColumn("emb", F.array(F.lit(1.0), F.lit(2.0))), 3, id_cols=["doc_id"])
    assert np.allclose(same, [[1.0, 2.0]] * 3)


def test_centres_divide_the_vectors_well(spark, sf_dir):
    vecs = np.array([r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("embedding").collect()], float)
    centres = np.array([r.vec for r in queries.QUERIES["kmeans_bank"](spark, sf_dir).collect()])
    inertia = lambda c: ((vecs[:, None] - c[None]) ** 2).sum(2).min(1).sum()
    best = math.inf  # of full passes from several starts
    for seed in range(3):
        c = vecs[np.random.default_rng(seed).choice(len(vecs), 5, replace=False)]
        for _ in range(20):
            own = ((vecs[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([vecs[own == j].mean(0) if (own == j).any() else c[j] for j in range(5)])
        best = min(best, inertia(c))
    assert centres.shape == (5, 64) and inertia(centres) < 1.02 * best


def test_coordinates_are_principal_components(spark, sf_dir):
    got = {r.conf_idx: (r.x, r.y) for r in queries.QUERIES["bank_coordinates"](spark, sf_dir).collect()}
    rows = sorted(queries.bank(spark, sf_dir).collect(), key=lambda r: r.conf_idx)
    x = np.array([r.vec for r in rows])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want, have = np.abs(u[:, :2] * s[:2]), np.abs(np.array([got[r.conf_idx] for r in rows]))
    assert np.allclose(want, have, atol=1e-6)


def test_cross_fitted_effects(spark, sf_dir):
    rows = queries.QUERIES["cross_fitted_effects"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/labels.parquet").count() and {r.cv_fold for r in rows} == {1, 2, 3}
    assert all(abs(r.y1_logit - r.y0_logit - r.ite_logit) < 1e-9 and 0 < r.propensity_prob < 1 for r in rows)


def test_pretraining_lowers_its_loss(spark, sf_dir):
    log = queries.QUERIES["multi_arm_pretraining"](spark, sf_dir).collect()
    of = {p: [r.train_loss for r in sorted(log, key=lambda r: r.epoch) if r.phase == p] for p in ("pretraining", "transferred")}
    assert len(of["pretraining"]) == 8 and of["pretraining"][-1] < of["pretraining"][0] and all(r.val_loss is not None for r in log if r.phase == "transferred")


def test_plasmode_recovery(spark, sf_dir):
    rows = queries.QUERIES["plasmode_recovery"](spark, sf_dir).collect()
    assert {r.generation_mode for r in rows} == {"phi_linear", "deep_nonlinear", "uplift_nonlinear"} and all(abs(r.true_ate - 0.5) < 0.5 and r.ate_rmse > 0 for r in rows)


def test_kmeans_bank_reads_all_vectors(spark, tmp_path):
    ids = spark.range(6000).withColumnRenamed("id", "vec_id")
    near = {r.vec_id for r in T.sampled(ids, 5000, id_col="vec_id").collect()}
    rows = [(i, [i % 7 / 100, 0.0] if i in near else [100.0, 100.0 + i % 3 / 100], 0) for i in range(6000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    centres = [r.vec for r in queries.QUERIES["kmeans_bank"](spark, str(tmp_path)).collect()]
    assert len(centres) == 5 and any(math.dist(c, (100, 100)) < 1 for c in centres)


def test_confounder_bank_bound_is_a_parameter(spark):
    ids = spark.range(40).withColumnRenamed("id", "doc_id")
    near = {r.doc_id for r in T.sampled(ids, 20).collect()}
    chunks = spark.createDataFrame([(i, 0, [i % 7 / 100, 1.0] if i in near else [50.0, 50.0]) for i in range(40)], "doc_id long, pos int, emb array<double>")
    far = [any(r.vec[0] > 40 for r in runner.confounder_bank(chunks, Architecture(num_latent_confounders=2), documents=n).collect()) for n in (20, 40, None)]
    assert far == [False, True, True]


def test_calibration_meets_the_rates(spark, sf_dir):
    from tidewell.plans import scm

    model = scm.calibrated(scm.rescaled(scm.default_model(), spark), spark, 0.3, 0.2)
    rows = scm.patients(spark.range(20_000).withColumnRenamed("id", "patient_id"), model)
    t, y = rows.agg(F.avg("treatment_indicator"), F.avg(1 / (1 + F.exp(-F.col("outcome_logit_0"))))).first()
    assert abs(t - 0.3) < 0.02 and abs(y - 0.2) < 0.02


def test_chunks_of_edge_texts(spark):
    def plain_chunks(text, size=8, overlap=3):
        w = (text or "").split()
        at = [0]
        while at[-1] + size < len(w):
            at.append(at[-1] + size - overlap)
        return list(dict.fromkeys(" ".join(w[a : a + size]) for a in at)) if w else []

    texts = [None, "", " \n\t", "one", " ".join(map(str, range(8))), " ".join(map(str, range(9))), " ".join(map(str, range(50))), "same " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.c for r in df.select("doc_id", X.chunks("text", 8, 3).alias("c")).collect()}
    assert got == {i: plain_chunks(t) for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        X.chunks("text", 8, 8)


def test_near_duplicates_strict_and_not_greedy(spark):
    e = lambda a: [math.cos(a), math.sin(a)]
    rows = [(1, 0, e(0)), (1, 1, e(0.4)), (1, 2, e(0.8)), (2, 0, e(0)), (2, 1, e(0)), (3, 0, [0.0, 0.0]), (3, 1, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "doc_id long, pos int, emb array<double>")
    kept = Counter(tuple(r) for r in P.drop_near_duplicates(df, 0.9).select("doc_id", "pos").collect())
    assert kept == Counter([(1, 0), (2, 0), (3, 0), (3, 1)])  # 1:2 falls to 1:1, though that falls too
    assert P.drop_near_duplicates(df, None).count() == 7
    with pytest.raises(ValueError):
        P.pooled("median")


def test_cosines_at_the_threshold_are_kept(spark, sf_dir, tmp_path, monkeypatch):
    """Chunks of 96 equal words and 32 others have a cosine of exactly 0.9 if the 96 are the same in both, so do 72 of 96: none is dropped, by blocks, by the grid or by the SQL."""
    bucket = {int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64: w for w in (f"w{i}" for i in range(2000))}
    runs = lambda *parts: " ".join(w for w, n in parts for _ in range(n))
    four = [[bucket[(i + j) % 64] for j in (0, 1, 2, 3)] for i in range(64)]
    docs = [(i, runs((a, 96), (b, 32), (x, 64), (c, n // 3), (a, n))) for n in (96, 72) for i, (a, b, c, x) in enumerate(four, n * 100)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copy(f"{sf_dir}/embeddings.parquet", tmp_path)
    vectors = queries.embed_chunks(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    kept = lambda rows: {(r.doc_id, r.pos) for r in rows.select("doc_id", "pos").collect()}
    assert kept(P.drop_near_duplicates(vectors, 0.9)) == kept(vectors) == {(i, p) for i, _ in docs for p in range(3)}
    assert len(kept(P.drop_near_duplicates(vectors, 0.9 - 1e-9))) == 2 * len(docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'; CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    found = con.execute(queries.ORACLE_SQL["document_features_attn"]).fetchall()
    assert Counter(tuple(map(plain, r)) for r in queries.document_features_attn(spark, str(tmp_path)).collect()) == Counter(tuple(map(plain, r)) for r in found)
    monkeypatch.setattr(P, "LARGE", 2)
    assert kept(P.drop_near_duplicates(vectors, 0.9, large=P.large_groups(vectors))) == kept(vectors)


def test_auroc_of_ties_and_single_classes(spark):
    rows = [("a", 0.5, 1.0), ("a", 0.5, 0.0), ("a", 0.9, 1.0), ("b", 0.1, 1.0)]
    got = {r.g: r.auroc for r in M.auroc(spark.createDataFrame(rows, "g string, s double, y double"), "s", "y", ["g"]).collect()}
    assert got == {"a": 0.75, "b": None}


def test_auroc_of_skewed_and_tied_scores(spark):
    """Nearly all scores in a tiny range, one score that a third of the rows tie in, a head of few rows, a null score: equal to the pairs' count."""
    r = np.random.default_rng(4)
    rows = [("a", 0.5 + x * 1e-9, float(r.random() < 0.4 + x / 4)) for x in r.random(3000).tolist()] + [("a", 0.5, float(i % 3 == 0)) for i in range(1500)]
    rows += [("b", float(i), float(i > 2)) for i in range(4)] + [("c", None, 1.0), ("c", 1.0, 1.0), (None, 1.0, 1.0), (None, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "head string, score double, label double").repartition(7)
    got = {r.head: r.auroc for r in M.auroc(df, "score", "label", ["head"]).collect()}
    x, y = (np.array([row[k] for row in rows if row[0] == "a"]) for k in (1, 2))
    up, down = x[y > 0.5][:, None], x[y < 0.5][None]
    assert abs(got["a"] - ((up > down).mean() + (up == down).mean() / 2)) < 1e-12 and got["b"] == 1.0 and got["c"] is None and got[None] == 0.5
    assert abs(M.auroc(df.where("head = 'a'"), "score", "label").first().auroc - got["a"]) < 1e-12
    plan = M.auroc(df, "score", "label", ["head"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(head" in plan and plan.count("Window") <= 3


@pytest.mark.parametrize("mode", P.MODES)
def test_fused_pooling_equals_pooled_matches(spark, monkeypatch, mode):
    """Documents over several tasks and batches, a long one, null vectors and ids, ties, one chunk: the states merge to what the rows give."""
    monkeypatch.setattr(P, "_BLOCK", 7)
    r = np.random.default_rng(2)
    rows = [(i % 5, i, r.normal(size=3).tolist()) for i in range(40)] + [(9, i, [1.0, 2.0, 2.0]) for i in range(30)] + [(7, 0, [0.0, 0.0, 0.0]), (8, 0, None), (1, 99, None), (None, 0, [1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "doc_id long, pos int, emb array<double>").repartition(6)
    bank = spark.createDataFrame([(i, h, r.normal(size=3).tolist()) for i in range(3) for h in range(2)], "conf_idx int, head int, vec array<double>")
    plainly = P.pool(P.match(vectors.where("emb IS NOT NULL"), bank), mode)
    want = {(r.doc_id, r.feat_idx): r.value for r in plainly.collect()}
    got = {(r.doc_id, r.feat_idx): r.value for r in P.long_features(P.pooled_features(vectors, bank, mode)).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert P.pooled_features(vectors.where("false"), bank, mode).count() == 0
    stretched = P.pool(P.match(vectors.where("emb IS NOT NULL"), bank).withColumn("s", queries.V.stretched("s")), mode)
    want = {(r.doc_id, r.feat_idx): r.value for r in stretched.collect()}
    got = {(r.doc_id, r.feat_idx): r.value for r in P.long_features(P.pooled_features(vectors, bank, mode, stretch=True)).collect()}
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_validation_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\nc', 1, 0, "train"), (2, "d", 0, 1, "test")], "id long, text string, y int, t int, split string")
    assert T.validate(df, "text", "y", "t", "split").count() == 2
    with pytest.raises(ValueError, match="missing columns: nope"):
        T.validate(df, "nope", "y", "t")
    with pytest.raises(ValueError, match="null values"):
        T.validate(df.withColumn("t", F.lit(None)), "text", "y", "t")
    df.write.parquet(f"{tmp_path}/x.parquet")
    df.write.option("header", True).option("escape", '"').csv(f"{tmp_path}/x.csv")
    for name in ("x.parquet", "x.csv"):
        assert {r.text for r in S.load_dataset(spark, f"{tmp_path}/{name}").collect()} == {'a,"b"\nc', "d"}
        assert S.load_dataset(spark, f"{tmp_path}/{name}", "test").count() == 1
    for bad in (f"{tmp_path}/x.xlsx", f"{tmp_path}/x"):
        with pytest.raises(ValueError):
            S.load_dataset(spark, bad)
    S.write_json({"a": [1, None]}, f"{tmp_path}/j", spark)
    assert S.read_json(f"{tmp_path}/j", spark) == {"a": [1, None]}


@pytest.mark.parametrize("kind", ["dragon", "uplift", "arms"])
def test_gradients_equal_differences(kind):
    rng = np.random.default_rng(0)
    design = nets.Design(3, kind, trunk=(4, 3), outcome=(3,), arms=3)
    w = nets.initial(design, 1)
    x, t, y = rng.normal(size=(20, 3)), rng.integers(0, 3 if kind == "arms" else 2, 20).astype(float), rng.integers(0, 2, 20).astype(float)
    beta, n = 0.7, len(y)
    grads, moment, sums, out = nets.gradients(design, w, x, t, y, 1.0, beta)
    for k in w:
        at = tuple(0 for _ in w[k].shape)
        losses = []
        for d in (1e-5, -1e-5):
            moved = {m: v.copy() for m, v in w.items()}
            moved[k][at] += d
            made = nets.forward(design, moved, x)
            found = nets.losses(design, made, t, y)
            if kind != "arms":  # the propensity's weight is held fixed
                found[3] = ((y - nets._sigmoid(np.where(t > 0.5, made["y1"], made["y0"]))) * nets._weight(out["propensity"], t)).sum()
            losses.append(nets.total_loss(design, found, 1.0, beta) * n)
        want = grads[k][at] + (0 if kind == "arms" else 2 * beta * sums[3] / n * moment[k][at])
        assert abs((losses[0] - losses[1]) / 2e-5 - want) < 1e-4


def test_training_sums_do_not_depend_on_partitions(spark):
    r = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, r.normal(size=3).tolist(), float(i % 2), float(r.integers(0, 2)), i % 3 + 1) for i in range(90)], "doc_id long, features array<double>, t double, y double, cv_fold int")
    a, b = (estimate.train(rows.repartition(n), nets.Design(3, trunk=(4,), outcome=(3,)), 3, steps=3, beta=0.5, validation=0.2) for n in (1, 20))
    assert [x["fold"] for x in a.log] == [1, 1, 1, 2, 2, 2, 3, 3, 3] and set(a.log[0]) == {c.split()[0] for c in estimate.LOG_SCHEMA.split(", ")}
    assert all(abs(x[k] - y[k]) < 1e-9 for x, y in zip(a.log, b.log, strict=True) for k in ("train_loss", "val_loss", "train_auroc_prop", "val_auroc_prop"))
    best = estimate.predict(rows, a, phi=True).first()
    assert len(best.phi) == 4
    # rows that validate teach nothing
    other = rows.withColumn("y", F.when(queries.rng.uniform(42, "validation", "doc_id") < 0.2, 1 - F.col("y")).otherwise(F.col("y")))
    c = estimate.train(other, nets.Design(3, trunk=(4,), outcome=(3,)), 3, steps=3, beta=0.5, validation=0.2)
    assert all(abs(x["train_loss"] - y["train_loss"]) < 1e-9 for x, y in zip(a.log, c.log, strict=True)) and any(abs(x["val_loss"] - y["val_loss"]) > 1e-6 for x, y in zip(a.log, c.log, strict=True))


def batch_rows(spark, n=75):
    r = np.random.default_rng(3)
    rows = [(i * 7, r.normal(size=3).tolist(), float(r.integers(0, 2)), float(r.integers(0, 2)), i % 3 + 1) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, features array<double>, t double, y double, cv_fold int")


def plain_batches(rows, design, size, epochs, rate, beta, seed, validates, by_epoch=False, validation_beta=None):
    """Mini-batch training in one loop: losses by epoch, and the weights of the least validation loss."""
    learn, check = [r for r in rows if not validates(r[0])], [r for r in rows if validates(r[0])]
    learn.sort(key=lambda r: hashlib.md5(f"{seed}:number:{r[0]}".encode()).hexdigest())
    columns = lambda some: tuple(np.array([r[k] for r in some]) for k in (1, 2, 3))
    n = len(learn)
    weights, per = nets.initial(design, seed), -(-n // size)
    optimiser = nets.AdamW(rate, 1e-4, (epochs if by_epoch else epochs * per) + 1)
    found, best = [], (math.inf, None)
    for epoch in range(epochs):
        order = np.argsort(batches.permuted(np.arange(n), n, seed + 7919 * epoch))
        losses = []
        for i in range(0, n, size):
            x, t, y = columns([learn[k] for k in order[i : i + size]])
            grads, moment, sums, _ = nets.gradients(design, weights, x, t, y, 1.0, beta)
            losses.append(nets.total_loss(design, sums, 1.0, beta))
            m = len(y)
            step = {k: g / m + (2 * beta * sums[3] / m * moment[k] / m if moment else 0) for k, g in grads.items()}
            optimiser.step(weights, step, epoch if by_epoch else None)
        x, t, y = columns(check)
        val = nets.total_loss(design, nets.losses(design, nets.forward(design, weights, x), t, y), 1.0, beta if validation_beta is None else validation_beta)
        found.append((np.mean(losses), val))
        if val < best[0]:
            best = (val, {k: w.copy() for k, w in weights.items()})
    return found, best[1]


def test_permutations_are_whole():
    for n in (1, 2, 3, 10, 64, 1000):
        places = [batches.permuted(np.arange(n), n, seed).tolist() for seed in (1, 2)]
        assert all(sorted(p) == list(range(n)) for p in places) and (n < 10 or places[0] != places[1])
    assert batches.permuted(np.zeros(0, np.int64), 0, 1).tolist() == []


@pytest.mark.parametrize(("size", "heads"), [(7, False), (40, False), (7, True), (1000, False)])
def test_batches_equal_a_plain_trainer(spark, size, heads):
    """Of rows or of gradients, whatever the tasks: the same steps as one loop; the rate falls by the batch, or the epoch for heads alone."""
    rows, df = batch_rows(spark)
    design = nets.Design(3, trunk=() if heads else (4,), outcome=(3,))
    more = {"by_epoch": True, "validation_beta": 0.0} if heads else {}
    share = {r.doc_id: r.u for r in df.select("doc_id", queries.rng.uniform(5, "validation", "doc_id").alias("u")).collect()}
    want, weights = plain_batches(rows, design, size, 3, 0.02, 0.5, 5, lambda i: share[i] < 0.2, **more)
    for tasks in (1, 2, 4):
        got = estimate.train(df.repartition(tasks), design, steps=3, rate=0.02, beta=0.5, seed=5, validation=0.2, batch_size=size, tasks=tasks, **more)
        assert np.allclose([(x["train_loss"], x["val_loss"]) for x in got.log], want, atol=1e-9)
        assert all(np.allclose(got.weights[0][k], w, atol=1e-9) for k, w in weights.items())


def test_batch_size_has_its_effect_and_is_checked(spark):
    _, df = batch_rows(spark)
    design = nets.Design(3, trunk=(4,), outcome=(3,))
    losses = [estimate.train(df, design, steps=2, rate=0.02, batch_size=b).log[-1]["train_loss"] for b in (5, 25, None)]
    assert len({round(x, 6) for x in losses}) == 3
    with pytest.raises(ValueError, match="batch_size"):
        estimate.train(df, design, batch_size=0)
    assert estimate.train(df.where("false"), design, steps=2, batch_size=5).log == []


@pytest.mark.parametrize("size", [None, 9])
def test_models_trained_together_equal_each_alone(spark, size):
    """Networks keyed by a column, one of few rows and one without any, in the jobs of one: as each by itself; folds likewise."""
    _, df = batch_rows(spark)
    rows = df.withColumn("model", F.when(F.col("doc_id") < 40, 3).otherwise(1000))
    design = nets.Design(3, trunk=(4,), outcome=(3,))
    more = {"steps": 3, "rate": 0.02, "beta": 0.5, "validation": F.col("doc_id") % 5 == 0, "batch_size": size}
    both = estimate.train(rows, design, models=[3, 1000, 7], seed=2, **more)
    for m in (3, 1000):
        alone = estimate.train(rows.where(F.col("model") == m), design, models=[m], seed=2, **more)
        assert [x for x in both.log if x["fold"] == m] == [pytest.approx(x) for x in alone.log] and len(alone.log) == 3
        assert all(np.allclose(both.weights[m][k], w, atol=1e-9) for k, w in alone.weights[m].items())
    assert not [x for x in both.log if x["fold"] == 7] and set(both.weights) == {3, 7, 1000}
    folds = estimate.train(df, design, 3, **more)
    assert {x["fold"] for x in folds.log} == {1, 2, 3}
    found = {r.doc_id: r.ite_logit for r in estimate.predict(rows, both, model_col="model").collect()}
    assert len(found) == 75


def test_jobs_grow_with_epochs_not_with_models(spark):
    _, df = batch_rows(spark)
    design, tracker = nets.Design(3, trunk=(4,), outcome=(3,)), spark.sparkContext.statusTracker()
    counts = []
    for k in (1, 6):
        rows = df.withColumn("model", (F.col("doc_id") % k).cast("int"))
        spark.sparkContext.setJobGroup(f"models-{k}", "count")
        estimate.train(rows, design, models=list(range(k)), steps=4, batch_size=10)
        counts.append(len(tracker.getJobIdsForGroup(f"models-{k}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1]


def test_fold_models_see_no_row_of_their_own(spark):
    rows, df = batch_rows(spark)
    got = estimate.fold_models(df, 3).collect()
    assert Counter((r.doc_id, r.model) for r in got) == Counter((r[0], m) for r in rows for m in (1, 2, 3))
    x = {r[0]: (np.array(r[1]), r[4]) for r in rows}
    for r in got:
        others = np.array([v for v, f in x.values() if f != r.model])
        assert np.allclose(r.features, (x[r.doc_id][0] - others.mean(0)) / np.sqrt(others.var(0) + 1e-5))


def test_numbers_have_no_gaps(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("g"))
    got = {}
    for r in T.numbered(df, "g", "n").collect():
        got.setdefault(r.g, []).append(r.n)
    assert {g: sorted(n) for g, n in got.items()} == {0: list(range(167)), 1: list(range(167)), 2: list(range(166))}


def test_model_from_a_checkpoint(spark, tmp_path):
    design = nets.Design(4, trunk=(3, 3), outcome=(2,))
    bank = spark.createDataFrame([(i, 0, [1.0, 2.0]) for i in range(4)], "conf_idx int, head int, vec array<double>")
    path = estimate.save_network(estimate.Fitted(design, {0: nets.initial(design, 1)}, []), f"{tmp_path}/n", spark, bank, aggregator_mode="max")
    old = estimate.load_network(path, spark).fitted.weights[0]
    wide = estimate.model_from_checkpoint(path, spark, 6, kind="uplift")
    assert wide.fitted.design.inputs == 6 and wide.fitted.design.kind == "uplift" and wide.meta["load_strategy"] == "partial_load"
    assert (wide.fitted.weights[0]["trunk.0.w"][:4] == old["trunk.0.w"]).all() and (wide.fitted.weights[0]["trunk.1.w"] == old["trunk.1.w"]).all()
    narrow = estimate.model_from_checkpoint(path, spark, 2)
    assert narrow.fitted.design.inputs == 4 and narrow.meta["phantom_features_needed"] == 2 and "tau.0.w" in wide.fitted.weights[0]
    assert nets.count_parameters(old) == sum(w.size for w in old.values()) == 4 * 3 + 3 + 3 * 3 + 3 + 3 + 1 + 2 * (3 * 2 + 2 + 2 + 1)
    with pytest.raises(ValueError, match="incompatible"):
        estimate.model_from_checkpoint(path, spark, 4, embedding_dim=9)


def test_saved_network_and_bank(spark, tmp_path):
    fitted = estimate.Fitted(nets.Design(4, trunk=(3, 3), outcome=(2,)), {0: nets.initial(nets.Design(4, trunk=(3, 3), outcome=(2,)), 1)}, [])
    old = spark.createDataFrame([(i, 0, [float(i), 1.0]) for i in range(4)], "conf_idx int, head int, vec array<double>")
    again = estimate.load_network(estimate.save_network(fitted, f"{tmp_path}/n", spark, old, num_explicit_confounders=1), spark)
    assert again.fitted.design == fitted.design and all((again.fitted.weights[0][k] == w).all() for k, w in fitted.weights[0].items())
    assert estimate.extractor_config(again) == {"embedding_dim": 2, "num_latent_confounders": 3, "num_explicit_confounders": 1, "features_per_confounder": 1, "aggregator_mode": "attn", "num_total_confounders": 4, "aggregator_features_per_conf": 1, "total_output_dim": 4}
    assert [estimate.compatibility(again, n)["load_strategy"] for n in (4, 3, 6)] == ["direct", "phantom_padding", "partial_load"]
    assert not estimate.compatibility(again, 4, embedding_dim=3)["compatible"]
    new = spark.createDataFrame([(i, 0, [9.0, 9.0]) for i in range(6)] + [(3, 1, [8.0, 8.0])], "conf_idx int, head int, vec array<double>")
    got = {(r.conf_idx, r.head): r.vec for r in estimate.transferred_bank(again.bank, new).collect()}
    assert got == {**{(i, 0): [float(i), 1.0] for i in range(4)}, (4, 0): [9.0, 9.0], (5, 0): [9.0, 9.0], (3, 1): [8.0, 8.0]}


def test_cached_vectors_are_made_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "d")], "doc_id long, text string")
    first = {(r.doc_id, tuple(r.emb)) for r in runner.chunk_vectors(docs.where("doc_id < 3"), Architecture(), cache_dir=str(tmp_path)).collect()}
    every = {(r.doc_id, tuple(r.emb)) for r in runner.chunk_vectors(docs, Architecture(), cache_dir=str(tmp_path)).collect()}
    plain_ = {(r.doc_id, tuple(r.emb)) for r in runner.chunk_vectors(docs, Architecture()).collect()}
    assert first < every == plain_
    cache = runner.cache_of(spark, str(tmp_path), Architecture(), runner.EMBEDDERS["hash"]())
    assert runner.cache_statistics(cache).first().entries == 2
    assert cache.path.endswith("/hash_d64_cs128_co32") and cache.path != runner.cache_of(spark, str(tmp_path), Architecture(), runner.hash_embedder(32)).path
    with pytest.raises(ValueError, match="no embedder"):
        runner.chunk_vectors(docs, Architecture(embedding_model_name="elsewhere"))


def test_segments_hit_miss_interrupt_and_clear(spark, tmp_path):
    """Keys are made once; what an interrupted writer left is not read; clearing leaves nothing."""
    made = []

    def make(rows, tag="a"):
        made.append(sorted(r.k for r in rows.collect() if r.k is not None))
        return rows.select("k", F.lit(tag).alias("tag"))

    store = Segments(spark, f"{tmp_path}/s", "k", buckets=8)
    rows = lambda ks: spark.createDataFrame([(k, k * 2 if k is not None else None) for k in ks], "k long, v long")
    assert store.read() is None and {r.k for r in store.get_or_make(rows([1, 2, 2, None]), make).collect()} == {1, 2}
    assert {(r.k, r.tag) for r in store.get_or_make(rows([2, 3, 4]), lambda r: make(r, "b")).collect()} == {(2, "a"), (3, "b"), (4, "b")}
    assert store.get_or_make(rows([1, 4]), make).count() == 2 and made == [[1, 2], [3, 4]] and store._manifest()[0] == 2
    store._write(rows([9]).select("k", F.lit("lost").alias("tag")))  # interrupted before its commit
    assert {r.k for r in store.read().collect()} == {1, 2, 3, 4} and len(store.folders.names()) == 3
    with pytest.raises(Exception, match="division|by zero|DIVIDE"):
        store.get_or_make(rows([11]), lambda r: r.select("k", F.raise_error(F.lit("division")).cast("string").alias("tag")))
    assert {r.k for r in store.read().collect()} == {1, 2, 3, 4}
    plan = store.read(rows([1]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:80]
    store.sweep()
    assert len(store.folders.names()) == 2 and store.read().count() == 4
    store.clear()
    assert store.read() is None and store.folders.names() == [] and store.get_or_make(rows([1]), make).count() == 1


def test_segments_of_two_writers(spark, tmp_path):
    """Another writer commits while this one makes: keys of both are kept once, the first's."""
    rows = lambda ks: spark.createDataFrame([(k,) for k in ks], "k long")
    tagged = lambda tag: lambda r: r.select("k", F.lit(tag).alias("tag"))
    one, two = (Segments(spark, f"{tmp_path}/s", "k", buckets=4) for _ in range(2))

    def slow(r):
        two.get_or_make(rows([2, 3]), tagged("two"))
        return tagged("one")(r)

    assert {(r.k, r.tag) for r in one.get_or_make(rows([1, 2]), slow).collect()} == {(1, "one"), (2, "two")}
    assert sorted((r.k, r.tag) for r in one.read().collect()) == [(1, "one"), (2, "two"), (3, "two")] and len(one.folders.names()) == 2


def test_batches_resume_where_they_stopped(spark, tmp_path):
    """A run that fails half way leaves its batches; the next one makes the rest, and what the failed one left unfinished again."""
    ids, calls = spark.range(200).withColumnRenamed("id", "k"), []

    def make(rows, fails_at=None):
        calls.append(1)
        if len(calls) == fails_at:
            rows.select("k").write.mode("overwrite").parquet(f"{tmp_path}/t/rows/00000002-of-00000005")  # half written, not logged
            raise RuntimeError("stopped")
        return rows.withColumn("made", F.lit(len(calls)))

    with pytest.raises(RuntimeError):
        in_batches(ids, f"{tmp_path}/t", lambda r: make(r, 3), "k", 5)
    out = in_batches(ids, f"{tmp_path}/t", make, "k", 5)
    assert out.count() == out.select("k").distinct().count() == 200 and len(calls) == 6
    assert {r.made for r in out.collect()} == {1, 2, 4, 5, 6}
    in_batches(ids, f"{tmp_path}/t", make, "k", 5)
    assert len(calls) == 6


def test_broken_replies_are_repaired():
    """Every cut of a reply gives what is whole up to there; all else is JSON as a parser reads it."""
    made = {"a": [1, -2.5e3, {"b": "x, } ] \\ \" y", "é": None}], "c": {"d": True, "e": {}}, "f": []}
    text = json.dumps(made)
    assert X.repaired_object(text, 0) == (made, len(text))
    for i in range(1, len(text)):
        cut, end = X.repaired_object(text[:i], 0)
        assert end == i and list(cut) == list(made)[: len(cut)] and json.dumps(cut)
        for k, v in list(cut.items())[:-1]:
            assert v == made[k]
    for bad in ("{not json}", "{a: 1}", '{"a" 1}', '{"a": 1 "b": 2}', '{"a": nul}', "{]", '{"a": [1}'):
        assert X.repaired_object(bad, 0) is None, bad
    assert X.object_with('x {"p": {"q": 1}, "r": [{"q": 2, "s": 3}]} {"s": 4}', ["q", "s"]) == {"q": 2, "s": 3}
    assert X.object_with('{"s": 4,} and', ["s"]) == {"s": 4} and X.object_with(None, ["s"]) is None and X.object_with("{" * 500, ["s"]) is None
    assert X.object_with("no object", []) is None and X.object_with('{"s": "' + "x" * 100_000, ["s"]) == {"s": "x" * 100_000}


def test_model_from_a_spec(spark, tmp_path):
    from tidewell.plans import scm

    spec = queries.SPEC
    m = scm.model_from_spec(spec, 0.7)
    assert m.outcome.treatment == 0.7 and m.treatment.coefficients == {"age": 1.5 * 0.3, "ward_b": -0.3} and m.treatment.interactions[0] == (("age", "score"), 2.0 * 0.1)
    assert {tuple(sorted(t)) for t, _ in m.treatment.interactions} == {tuple(sorted(p)) for p in [("age", "ward_b"), ("age", "ward_c"), ("age", "score"), ("ward_b", "ward_c"), ("ward_b", "score"), ("ward_c", "score")]}
    assert set(m.outcome.treatment_interactions) == {"age", "ward_b", "ward_c", "score"} and all(abs(c) <= 0.1 for c in m.outcome.treatment_interactions.values())
    for bad in ({"confounders": [{"name": "x", "type": "odd"}]}, {"confounders": [{"name": "x", "type": "categorical"}]}, {"confounders": [{"name": "x", "type": "continuous"}] * 2}):
        with pytest.raises(ValueError):
            scm.model_from_spec(bad)
    c = scm.GeneratorConfig(num_confounders=3)
    c.to_json(f"{tmp_path}/g.json")
    assert scm.GeneratorConfig.from_json(f"{tmp_path}/g.json") == c and len(c.model(lambda q, n: spec).variables) == 3
    for wrong in ({"dataset_size": 0}, {"question": " "}, {"target_treatment_rate": 1.0}, {"target_logit_std": 0.0}):
        with pytest.raises(ValueError):
            scm.GeneratorConfig(**wrong).validate()


def test_vector_functions_of_long_vectors(spark):
    from tidewell.functions import vectors as V

    x = np.random.default_rng(0).normal(size=1024)
    r = spark.createDataFrame([(x.tolist(),)], "v array<double>").select(V.softmax("v").alias("s"), V.normalised("v").alias("n")).first()
    assert np.allclose(r.s, np.exp(x) / np.exp(x).sum()) and np.allclose(r.n, x / np.linalg.norm(x))


def test_near_duplicates_across_batches_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "_BLOCK", 3)
    r = np.random.default_rng(2)
    rows = [(g, p, r.normal(size=3).tolist()) for g in range(6) for p in range(25)] + [(None, 0, [1.0, 0.0, 0.0]), (7, 0, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        kept = {tuple(x) for x in P.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, pos int, emb array<double>"), 0.8).select("doc_id", "pos").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    want = {(g, p) for g, p, e in rows if g is None or e is None or not any(h == g and q < p and f is not None and cos(e, f) > 0.8 for h, q, f in rows)}
    assert kept == want


def test_near_duplicates_of_a_huge_document(spark, monkeypatch):
    """Large groups go by pairs of blocks: equal to the plain rule, with equal positions, null vectors and small groups beside; no task holds the group."""
    r = np.random.default_rng(6)
    monkeypatch.setattr(P, "LARGE", 40)
    rows = [(1, i, (r.normal(size=3) * 0.3 + [1, i % 3, 0]).tolist()) for i in range(150)] + [(1, 150, None), (1, 20, [9.0, -9.0, 1.0]), (1, 20, [1.0, 0.0, 0.0])]
    rows += [(2, i, r.normal(size=3).tolist()) for i in range(12)] + [(None, 0, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "doc_id long, pos int, emb array<double>").repartition(5)
    large = P.large_groups(df)
    assert [r.doc_id for r in large.collect()] == [1]
    sizes = []
    cos = lambda a, b: np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))
    want = Counter((d, p) for d, p, v in rows if v is None or d is None or not any(e == d and q < p and w is not None and cos(v, w) > 0.97 for e, q, w in rows))
    plan = P.drop_near_duplicates(df, 0.97, large=large)
    assert Counter((r.doc_id, r.pos) for r in plan.collect()) == want and 20 < sum(want.values()) < len(rows)
    assert Counter((r.doc_id, r.pos) for r in P.drop_near_duplicates(df, 0.97).collect()) == want
    grid = df.join(large, "doc_id").withColumn("_blocks", F.lit(8))
    sizes = [r["count"] for r in grid.groupBy(F.pmod(F.xxhash64("pos"), F.lit(8))).count().collect()]
    assert max(sizes) < 40 and plan.columns == df.columns


def test_correlations_go_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(M, "_SUMMED", 2)
    x = np.random.default_rng(3).normal(size=(40, 5))
    rows = spark.createDataFrame([(d, f, float(x[d, f])) for d in range(40) for f in range(5)], "doc_id long, feat_idx int, value double")
    got = {(r.feature_i, r.feature_j): r.correlation for r in M.correlations(rows, -1.0).collect()}
    want = np.corrcoef(x.T)
    assert set(got) == {(i, j) for i in range(5) for j in range(i + 1, 5)} and all(abs(got[i, j] - want[i, j]) < 1e-9 for i, j in got)


def test_transfer_of_weights():
    names = [estimate.transfer_strategy(*a) for a in ((5, 5), (7, 5), (5, 7), (0, 5), (5, 5, 64, 32))]
    assert names == ["direct", "phantom_padding", "partial_load", "incompatible", "incompatible_dimensions"]
    old = nets.initial(nets.Design(4, trunk=(3, 3)), 1)
    new = estimate.transferred(old, nets.Design(6, trunk=(3, 3)))
    assert (new["trunk.0.w"][:4] == old["trunk.0.w"]).all() and (new["trunk.1.w"] == old["trunk.1.w"]).all()


def test_configuration(tmp_path):
    made = create_default_config(f"{tmp_path}/c.json")
    again = Experiment.from_json(f"{tmp_path}/c.json")
    assert again == made and again.get_hash() == made.get_hash() and len(again.get_hash()) == 12
    again.validate()
    old = Experiment.from_dict({"plasmode_experiments": {"evaluator_use_generator_confounders": True, "plasmode_scenarios": [{"generation_mode": "phi_linear"}]}})
    assert old.plasmode_experiments.oracle_mode
    with pytest.raises(ValueError, match="unknown settings: applied_inference.typo"):
        Experiment.from_dict({"applied_inference": {"typo": 1}})
    for bad in ({"architecture": {"aggregator_mode": "median"}}, {"architecture": {"chunk_overlap": 200}}, {"dataset_path": ""}):
        with pytest.raises(ValueError):
            Experiment.from_dict({"applied_inference": {"dataset_path": "x", **bad}}).validate()


def test_experiment_end_to_end(spark, sf_dir, tmp_path):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").limit(60).select(F.col("text").alias("clinical_text"), F.col("toxic").alias("outcome_indicator"), F.col("quality").alias("treatment_indicator"), "lang", F.element_at(F.array(F.lit("test"), F.lit("val"), F.lit("train"), F.lit("train")), (F.crc32("text") % 4 + 1).cast("int")).alias("split"))
    rows.write.parquet(f"{tmp_path}/d.parquet")
    arch = {"num_latent_confounders": 3, "dragonnet_representation_dim": 4, "dragonnet_hidden_outcome_dim": 3, "explicit_confounder_texts": ["der die das"]}
    training = {"epochs": 2, "learning_rate": 0.01}
    both = {"architecture": arch, "training": training}
    data = {
        "output_dir": f"{tmp_path}/out",
        "pretraining": {"enabled": True, "dataset_path": f"{tmp_path}/d.parquet", "treatment_column": "lang", **both},
        "cache_dir": f"{tmp_path}/cache",
        "applied_inference": {"dataset_path": f"{tmp_path}/d.parquet", "cv_folds": 0, **both},
        "plasmode_experiments": {"enabled": True, "oracle_mode": True, "save_datasets": True, "generator_architecture": arch, "generator_training": training, "evaluator_architecture": arch, "evaluator_training": training, "plasmode_scenarios": [{"generation_mode": "uplift_nonlinear"}, {"generation_mode": "uplift_nonlinear", "uplift_activation": None, "uplift_hidden_dims": [-1]}]},
    }
    ran = ExperimentRunner(spark, Experiment.from_dict(data))
    done = ran.run()
    made = spark.read.parquet(done["applied_inference"]["predictions"])
    assert made.count() == rows.where("split = 'test'").count() and {"y0_logit", "ite_prob", "propensity_prob"} <= set(made.columns)
    assert done["plasmode_experiments"]["experiments"] == 1 and done["plasmode_experiments"]["failed"] == 1 and done["pretraining"]["arms"] > 1
    status = {r.scenario_idx: r.status for r in spark.read.option("header", True).csv(done["plasmode_experiments"]["status"]).collect()}
    assert status == {"0": "done", "1": "failed"}
    assert S.read_json(f"{tmp_path}/out/plasmode/params/0-0", spark)["generation_mode"] == "uplift_nonlinear"
    log = spark.read.option("header", True).csv(f"{tmp_path}/out/applied_inference/training_log").collect()
    assert len(log) == 2 and all(r.val_loss for r in log)
    top = ran.interpret(k=2).collect()
    assert {r.confounder_type for r in top} == {"explicit", "latent"} and all(r.chunk_text for r in top)
    data["output_dir"], data["applied_inference"]["cv_folds"] = f"{tmp_path}/crossed", 2
    data["pretraining"]["enabled"] = data["plasmode_experiments"]["enabled"] = False
    crossed = ExperimentRunner(spark, Experiment.from_dict(data)).run()
    assert spark.read.parquet(crossed["applied_inference"]["predictions"]).groupBy("cv_fold").count().count() == 2
    assert Architecture().chunk_size == 128


def test_generate_command(spark, tmp_path):
    args = cli.parser().parse_args(["generate", "--dataset-size", "300", "--output-dir", str(tmp_path)])
    got = cli.generate(spark, cli.generator_config(args))
    assert got["n_patients"] == 300 and abs(got["treatment_rate"] - 0.5) < 0.12
    assert cli.main(["init", "--output", f"{tmp_path}/c.json"])["seed"] == 42


def test_analysis_rows_are_made_once(spark, sf_dir):
    """What trains on them reads a table, with the features that the whole documents table gives."""
    rows = queries.analysis_rows(spark, sf_dir)
    assert rows.inputFiles() and "MapInArrow" not in rows._jdf.queryExecution().executedPlan().toString()
    chunks = P.drop_near_duplicates(queries.embed(queries.X.explode_chunks(queries.read(spark, sf_dir, "documents"))), 0.9)
    want = P.pooled_features(chunks, queries.bank(spark, sf_dir), "attn").join(queries.read(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    want = {r.doc_id: r.features for r in want.collect()}
    got = {r.doc_id: r.features for r in rows.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-12) for i in want)


def test_gathers_of_an_epoch_are_few():
    """A gather takes a second: an epoch of three small networks over 136,000 rows each takes at most four."""
    plan = batches.Plan(nets.Design(10), {}, {1: 136_000}, 64, 1.0, 0.1, 42)
    assert -(-plan.batches(1) // plan.together(10, 3)) <= 4


def test_closest_keeps_each_tasks_own(spark):
    """What reaches the ranks is bounded by tasks, and ranks as all matches do; ties go by document and position."""
    draw = np.random.default_rng(3)
    few = draw.normal(size=(40, 4)).tolist()
    rows = [(None if i == 7 else i // 5, i % 5, None if i == 11 else few[i * 7 % 40], f"chunk {i}") for i in range(3000)]
    vectors = spark.createDataFrame(rows, "doc_id long, pos int, emb array<double>, chunk string").repartition(3)
    bank = spark.createDataFrame([(c, h, draw.normal(size=4).tolist()) for c in range(3) for h in range(2)], "conf_idx int, head int, vec array<double>")
    found = P.closest(vectors, bank, 6, digits=9)
    assert found.columns == ["doc_id", "pos", "chunk", "conf_idx", "head", "s"] and found.count() == 3 * 6 * 6
    want = M.top_chunks(P.match(vectors.where("emb IS NOT NULL"), bank).withColumn("s", F.round("s", 9) + 0.0), 6, 1)
    key = lambda df: sorted((r.conf_idx, r.head, r["rank"], r.confounder_type, r.doc_id or -1, r.pos, r.chunk_text, round(r.activation, 8)) for r in df.collect())
    assert key(M.top_chunks(found, 6, 1)) == key(want)
    assert P.closest(vectors.where("false"), bank).count() == 0 and P.closest(vectors, bank.where("false")).count() == 0


def test_embedding_and_features_work_in_blocks(spark):
    """However many rows a batch of Arrow has, few texts are embedded at once; dropping, matching and merging are one Python process's."""
    from tidewell.functions.embed import embed

    sizes = lambda texts: np.full((len(texts), 1), float(len(texts)))
    texts = spark.range(0, 3000, 1, 1).select("id", F.lit("a b").alias("chunk"))
    assert max(r.emb[0] for r in embed(texts, sizes).collect()) <= 512
    draw = np.random.default_rng(4)
    few = draw.normal(size=(9, 4)).tolist()
    rows = [(None if i % 50 == 7 else i % 40, i // 40, None if i % 30 == 11 else few[int(draw.integers(9))]) for i in range(400)]
    vectors = spark.createDataFrame(rows, "doc_id long, pos int, emb array<double>")
    bank = spark.createDataFrame([(c, 0, draw.normal(size=4).tolist()) for c in range(3)], "conf_idx int, head int, vec array<double>")
    made = P.pooled_features(vectors, bank, "attn", distinct=0.9)
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = {r.doc_id: r.features for r in P.pooled_features(P.drop_near_duplicates(vectors, 0.9), bank, "attn").collect()}
    got = {r.doc_id: r.features for r in made.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-12) for i in want)


def test_chunks_are_embedded_from_texts_split_once(spark):
    """As ``embed`` of ``explode_chunks``, bit by bit, on odd texts too; no text of a chunk is made."""
    from tidewell.functions.embed import embed, embed_chunks

    word = lambda i: f"{'Wörd' if i % 3 else 'ΣΟΦΟΣ'}{i % 41}"
    texts = [None, "", " \t\n\v\f\r ", "\u00a0", "a\u00a0b c\u2003\u3000 d\x1c\x1de \x85 f", "\u00a0 a\u00a0b", "The the THE", "\u0130stanbul \u0391\u03a3 \u03a3\u0391", "x " * 5000, "X x " * 500 + "X", "  one"]
    texts += [" ".join(map(word, range(n))) for n in (1, 127, 128, 129, 224, 225, 2000)] + ["\n\n ".join(map(word, range(500))) + "\t"] * 2
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(spark.sql("SELECT 99L AS doc_id, CAST(X'61FF6220C3' AS STRING) AS text"))
    shown = lambda made: Counter((r.doc_id, r.pos, tuple(r.emb)) for r in made.select("doc_id", "pos", "emb").collect())
    for size, overlap in ((128, 32), (7, 0), (5, 4)):
        want = embed(X.explode_chunks(docs, size=size, overlap=overlap))
        got = embed_chunks(docs, size=size, overlap=overlap)
        assert got.schema["emb"].dataType == want.schema["emb"].dataType and shown(got) == shown(want)
    plan = queries.document_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "array_join" not in plan
    with pytest.raises(ValueError, match="overlap"):
        embed_chunks(docs, size=3, overlap=3)
