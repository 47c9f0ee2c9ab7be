"""Whole experiments: features from texts, cross-fitted effects, plasmode recovery, pretraining."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..functions import text as X
from ..functions import vectors as V
from ..functions.embed import Embedder, embed, hash_embedder
from ..operators import metrics as M
from ..operators import pooling as P
from ..operators import tables as T
from ..operators.kmeans import minibatch_kmeans
from ..operators.nets import Design, Weights
from ..sources import datasets as S
from ..sources.segments import Segments
from . import estimate, plasmode
from .config import Architecture, Experiment, PlasmodeScenario, Training

#: Embedders by the name that a configuration gives (``embedding_model_name``); add your own.
EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hash": hash_embedder}


def embedder_of(arch: Architecture, given: Embedder | None) -> Embedder:
    if given is not None:
        return given
    if arch.embedding_model_name not in EMBEDDERS:
        raise ValueError(f"no embedder {arch.embedding_model_name!r}; known: {', '.join(EMBEDDERS)}")
    return EMBEDDERS[arch.embedding_model_name]()


def chunk_vectors(docs: DataFrame, arch: Architecture, embedder: Embedder | None = None, threshold: float | None = 0.9, cache_dir: str | None = None) -> DataFrame:
    """``doc_id, pos, chunk, emb`` of each document's chunks without near-duplicates; vectors come from ``cache_dir`` where it has the chunk."""
    chunks = X.explode_chunks(docs, size=arch.chunk_size, overlap=arch.chunk_overlap)
    used = embedder_of(arch, embedder)
    make = lambda rows: embed(rows.withColumn("_text", F.col("chunk")), used, "_text")
    made = make(chunks) if cache_dir is None else cached_vectors(chunks, make, cache_of(chunks.sparkSession, cache_dir, arch, used))
    return P.drop_near_duplicates(made, threshold, large=P.large_groups(chunks))


def cache_of(spark: SparkSession, cache_dir: str, arch: Architecture, embedder: Embedder) -> Segments:
    """The cache of a model's vectors: apart by model, width of its vectors, and size and overlap of chunks. It holds vectors of chunks before any is dropped, so no threshold bears on it."""
    name = f"{X.file_name(arch.embedding_model_name)}_d{embedder(['']).shape[1]}_cs{arch.chunk_size}_co{arch.chunk_overlap}"
    return Segments(spark, f"{cache_dir.rstrip('/')}/{name}", "chunk_sha1")


def cached_vectors(chunks: DataFrame, make: Callable[[DataFrame], DataFrame], cache: Segments) -> DataFrame:
    """``chunks`` with ``emb``, keyed by the chunk's hash: what the cache lacks is made and added."""
    keyed = chunks.withColumn("chunk_sha1", F.sha1("chunk"))
    held = cache.get_or_make(keyed.select("chunk_sha1", "chunk"), lambda new: make(new).select("chunk_sha1", "emb"))
    return keyed.join(held, "chunk_sha1").drop("chunk_sha1")


def cache_statistics(cache: Segments) -> DataFrame:
    """One row: entries of a cache of vectors, and the MB that their numbers take."""
    rows = cache.read()
    rows = cache.spark.createDataFrame([], "emb array<double>") if rows is None else rows
    return rows.agg(F.count("*").alias("entries"), (F.coalesce(F.sum(F.size("emb")), F.lit(0)) * 8 / 1e6).alias("mb"))


def confounder_bank(chunks: DataFrame, arch: Architecture, seed: int = 42, embedder: Embedder | None = None, documents: int | None = None, kmeans: bool = True) -> DataFrame:
    """``conf_idx, head, vec``: embedded explicit texts first, then cluster centres of the chunks of all documents, or of ``documents`` sampled ones.

    Without ``kmeans`` the latent ones are seeded unit vectors instead.
    """
    spark = chunks.sparkSession
    texts = arch.explicit_confounder_texts or []
    heads = arch.features_per_confounder
    vectors = []
    if texts:
        rows = embed(spark.createDataFrame(list(enumerate(texts)), "i int, chunk string"), embedder_of(arch, embedder)).orderBy("i").collect()
        vectors = [(r.i, h, [float(x) for x in r.emb]) for r in rows for h in range(heads)]
    if arch.num_latent_confounders and not kmeans:
        dim = chunks.agg(F.max(F.size("emb"))).first()[0] or 1
        vectors += [(len(texts) + i // heads, i % heads, plasmode.direction(seed * 1000 + i, dim)) for i in range(arch.num_latent_confounders * heads)]
    elif arch.num_latent_confounders:
        if documents is not None:
            some = T.sampled(chunks.select("doc_id").distinct(), documents, seed)
            chunks = chunks.join(some, "doc_id")
        centres = minibatch_kmeans(chunks, arch.num_latent_confounders * heads, id_cols=["doc_id", "pos"], seed=seed)
        vectors += [(len(texts) + i // heads, i % heads, [float(x) for x in c]) for i, c in enumerate(centres)]
    return spark.createDataFrame(vectors, "conf_idx int, head int, vec array<double>")


def feature_rows(docs: DataFrame, chunks: DataFrame, bank: DataFrame, arch: Architecture) -> tuple[DataFrame, int]:
    """``docs`` with ``features`` (array of doubles; zeros for documents without words), and their number; not standardised."""
    n = bank.count() * (2 if arch.aggregator_mode == "stats" else 1)
    wide = P.pooled_features(chunks, bank, arch.aggregator_mode, stretch=arch.arctanh_transform)
    return docs.join(wide, "doc_id", "left").withColumn("features", F.coalesce("features", F.array_repeat(F.lit(0.0), n))), n


def feature_moments(rows: DataFrame) -> tuple[list[float], list[float]]:
    """Mean and standard deviation (with the batch-norm epsilon) of each feature over ``rows``, as many numbers as the bank has."""
    long = rows.select(F.posexplode("features").alias("feat_idx", "value"))
    found = P.moments(long).orderBy("feat_idx").collect()
    return [r.mu for r in found], [(r["var"] + 1e-5) ** 0.5 for r in found]


def standardised(rows: DataFrame, moments: tuple[list[float], list[float]]) -> DataFrame:
    mean, std = (F.array(*[F.lit(float(v)) for v in x]) for x in moments)
    scaled = F.zip_with(F.zip_with("features", mean, lambda a, b: a - b), std, lambda a, b: a / b)
    return rows.withColumn("features", scaled) if moments[0] else rows


def design_of(arch: Architecture, inputs: int, arms: int | None = None) -> Design:
    """Six layers of trunk; the binary network's propensity is one layer and its heads have two hidden ones, the others three and five."""
    width, hidden = arch.dragonnet_representation_dim, arch.dragonnet_hidden_outcome_dim
    kind = "arms" if arms else {"dragonnet": "dragon", "uplift": "uplift"}[arch.model_type]
    deep = kind != "dragon"
    return Design(inputs, kind, (width,) * 6, (width,) * 3 if deep else (), (hidden,) * (5 if deep else 2), arms or 2)


#: Weight decay of pretraining with AdamW, and of all other training.
PRETRAINING_DECAY, DECAY = 0.01, 1e-4
#: Share of the training rows that validates where no split says which.
INNER_VALIDATION = 0.1


def fit(rows: DataFrame, design: Design, training: Training, folds: int = 0, seed: int = 42, start: Weights | None = None, validation: Column | float | None = None, optimizer: str = "adamw", decay: float = DECAY, **more) -> estimate.Fitted:
    return estimate.train(
        rows, design, folds, steps=training.epochs, rate=training.learning_rate, alpha=training.alpha_propensity, beta=training.beta_targreg, seed=seed,
        start=start, validation=validation, optimizer=optimizer, decay=decay, schedule=training.lr_schedule, batch_size=training.batch_size, **more,
    )


class ExperimentRunner:
    """Runs a validated configuration; tables go below its ``output_dir``."""

    def __init__(self, spark: SparkSession, config: Experiment, embedder: Embedder | None = None, kmeans_documents: int | None = None):
        config.validate()
        self.spark, self.config, self.embedder, self.kmeans_documents = spark, config, embedder, kmeans_documents
        self.out = config.output_dir.rstrip("/")
        self._pretrained: estimate.Network | None = None

    def run(self) -> dict:
        """Where each phase's tables are; also written as ``summary``."""
        S.write_json(self.config.to_dict(), f"{self.out}/config", self.spark)
        done = {}
        if self.config.pretraining.enabled:
            done["pretraining"] = self.pretrain()
        if not self.config.applied_inference.skip:
            done["applied_inference"] = self.infer()
        if self.config.plasmode_experiments.enabled:
            done["plasmode_experiments"] = self.plasmode()
        S.write_json(done, f"{self.out}/summary", self.spark)
        return done

    def _rows(self, path: str, text: str, outcome: str, treatment: str, split: str | None, name: str) -> DataFrame:
        rows = S.with_row_ids(S.load_dataset(self.spark, path), f"{self.out}/{name}/rows")
        rows = T.validate(rows, text, outcome, treatment, split)
        more = [F.col(split).alias("split")] if split else []
        return rows.select("doc_id", F.col(text).alias("text"), F.col(outcome).cast("double").alias("y"), F.col(treatment).alias("t"), *more)

    def _chunks(self, docs: DataFrame, arch: Architecture, name: str) -> DataFrame:
        return S.write_table(chunk_vectors(docs, arch, self.embedder, cache_dir=self.config.cache_dir), f"{self.out}/{name}/chunks")

    def _features(self, docs: DataFrame, chunks: DataFrame, arch: Architecture, name: str, training: Training, fitted_on: Column | None = None) -> tuple[DataFrame, int, DataFrame]:
        """Features of the documents, written once, their number, and the bank, clustered from the documents that ``fitted_on`` marks."""
        own = chunks if fitted_on is None else chunks.join(docs.where(fitted_on).select("doc_id"), "doc_id", "left_semi")
        bank = confounder_bank(own, arch, self.config.seed, self.embedder, self.kmeans_documents, training.init_latents_from_kmeans)
        if self._pretrained is not None and self._pretrained.bank is not None and name != "pretraining":
            bank = estimate.transferred_bank(self._pretrained.bank, bank)
        bank = S.write_table(bank, f"{self.out}/{name}/bank")
        rows, n = feature_rows(docs, chunks, bank, arch)
        rows = S.write_table(rows.drop("text"), f"{self.out}/{name}/features")
        have = self._pretrained.fitted.design.inputs if self._pretrained is not None else n
        if name != "pretraining" and estimate.transfer_strategy(have, n) == "phantom_padding":
            rows, n = rows.withColumn("features", V.padded("features", n, have)), have
        return rows, n, bank

    def _meta(self, arch: Architecture) -> dict:
        return {"aggregator_mode": arch.aggregator_mode, "num_explicit_confounders": len(arch.explicit_confounder_texts or [])}

    def pretrain(self) -> dict:
        """A network with an arm for each treatment; its weights and the arms' names."""
        c = self.config.pretraining
        docs = self._rows(c.dataset_path, "clinical_text", "outcome_indicator", c.treatment_column, None, "pretraining")
        docs = T.category_index(docs.withColumnRenamed("t", "treatment"), "treatment", "t")
        arms = docs.select("treatment", "t").distinct()
        k = arms.count()
        rows, n, bank = self._features(docs, self._chunks(docs, c.architecture, "pretraining"), c.architecture, "pretraining", c.training)
        moments = feature_moments(rows)
        fitted = fit(standardised(rows, moments), design_of(c.architecture, n, k), c.training, seed=self.config.seed, optimizer=c.training.optimizer, decay=PRETRAINING_DECAY)
        S.write_table(arms, f"{self.out}/pretraining/arms")
        path = estimate.save_network(fitted, f"{self.out}/pretraining/network", self.spark, bank, moments=moments, **self._meta(c.architecture))
        S.write_log(estimate.log_table(fitted, self.spark), f"{self.out}/pretraining/training_log")
        self._pretrained = estimate.load_network(path, self.spark)
        return {"arms": k, "final_loss": fitted.log[-1]["train_loss"] if fitted.log else None, "network": path}

    def infer(self) -> dict:
        """Cross-fitted with ``cv_folds`` above 1, else trained on split train, validated on split val and applied to split test.

        In cross-fitting each fold's features are clustered and standardised from the other folds' rows alone.
        """
        c = self.config.applied_inference
        crossed = c.cv_folds > 1
        docs = self._rows(c.dataset_path, c.text_column, c.outcome_column, c.treatment_column, None if crossed else c.split_column, "applied_inference")
        keep, self._pretrained = self._pretrained, self._pretrained if c.use_pretrained_weights else None
        parts, logs = [], []
        if crossed:
            docs = T.folds(docs, c.cv_folds, self.config.seed)
        chunks = self._chunks(docs, c.architecture, "applied_inference")
        for fold in range(1, c.cv_folds + 1) if crossed else [0]:
            taught = F.col("cv_fold") != fold if crossed else F.col("split") == "train"
            name = f"applied_inference/fold-{fold}" if crossed else "applied_inference"
            rows, n, bank = self._features(docs, chunks, c.architecture, name, c.training, taught)
            moments = feature_moments(rows.where(taught))
            rows = standardised(rows, moments)
            learnt, validation = rows.where(taught if crossed else F.col("split").isin("train", "val")), INNER_VALIDATION if crossed else F.col("split") == "val"
            start = self._pretrained.fitted.weights[0] if self._pretrained is not None else None
            fitted = fit(learnt, design_of(c.architecture, n), c.training, 0, self.config.seed, start, validation)
            parts.append(estimate.predict(rows.where(~taught if crossed else F.col("split") == "test"), fitted).drop("features"))
            logs.append(estimate.log_table(fitted, self.spark).withColumn("fold", F.lit(fold)))
            estimate.save_network(fitted, f"{self.out}/{name}/network", self.spark, bank, moments=moments, **self._meta(c.architecture))
        self._pretrained = keep
        made = S.write_table(reduce(DataFrame.unionByName, parts), f"{self.out}/applied_inference/predictions")
        S.write_log(reduce(DataFrame.unionByName, logs).orderBy("fold", "epoch"), f"{self.out}/applied_inference/training_log")
        got = made.agg(F.count("*").alias("n"), F.avg("ite_logit").alias("mean_ite_logit"), F.stddev_samp("ite_logit").alias("std_ite_logit"), F.avg("propensity_prob").alias("mean_propensity")).first().asDict()
        aurocs = {r["head"]: r["auroc"] for r in M.treatment_aurocs(made).collect()}
        return got | {"auroc": aurocs, "predictions": f"{self.out}/applied_inference/predictions"}

    def plasmode(self) -> dict:
        """Known effects put onto the data's features and estimated again, for each scenario and repeat.

        A generator network is trained on the data as they are, without validation. Effects come from the features that it
        sees; the evaluator sees those too (``oracle_mode``), or its own of the texts. A scenario and repeat that can't be simulated is a row of
        ``status`` with its error; the others go on. All evaluators are trained together, so jobs grow with the epochs, not with the experiments.
        """
        c, a = self.config.plasmode_experiments, self.config.applied_inference
        docs = self._rows(a.dataset_path, a.text_column, a.outcome_column, a.treatment_column, None, "plasmode")
        made_by, n, bank = self._features(docs, self._chunks(docs, c.generator_architecture, "plasmode/generator"), c.generator_architecture, "plasmode/generator", c.generator_training)
        made_by = S.write_table(standardised(made_by, feature_moments(made_by)), f"{self.out}/plasmode/generator/standardised")
        start = self._pretrained.fitted.weights[0] if self._pretrained is not None else None
        generator = fit(made_by, design_of(c.generator_architecture, n), c.generator_training, seed=self.config.seed, start=start)
        estimate.save_network(generator, f"{self.out}/plasmode/generator/network", self.spark, bank, **self._meta(c.generator_architecture))
        S.write_log(estimate.log_table(generator, self.spark), f"{self.out}/plasmode/generator/training_log")
        seen, m = (made_by, n) if c.oracle_mode else self._features(docs, self._chunks(docs, c.evaluator_architecture, "plasmode/evaluator"), c.evaluator_architecture, "plasmode/evaluator", c.evaluator_training)[:2]
        done, status = [], []
        for i, s in enumerate(c.plasmode_scenarios):
            for r in range(c.num_repeats):
                try:
                    done.append((i, r, 1000 * i + r, s.generation_mode, float(s.target_ate_logit), self._simulated(made_by, n, seen, s, i, r)))
                    status.append((i, r, "done", None))
                except Exception as e:  # told in the status table, so that one scenario doesn't stop the others
                    status.append((i, r, "failed", f"{type(e).__name__}: {e}"[:2000]))
        S.write_log(self.spark.createDataFrame(status, "scenario_idx int, repeat_idx int, status string, error string"), f"{self.out}/plasmode/status")
        failed = sum(x[2] == "failed" for x in status)
        if not done:
            return {"experiments": 0, "failed": failed, "status": f"{self.out}/plasmode/status"}
        grid = self.spark.createDataFrame([x[:5] for x in done], "scenario_idx int, repeat_idx int, model int, generation_mode string, target_ate double")
        results = self._evaluated(self.spark.read.parquet(*(x[5] for x in done)), m, grid)
        S.write_log(results, f"{self.out}/plasmode/results")
        measures = ["ate_bias", "ate_rmse", "ite_correlation", "ite_regression_slope"]
        summary = results.groupBy("generation_mode").agg(*[f(x).alias(f"{x}_{k}") for x in measures for k, f in (("mean", F.avg), ("std", F.stddev_samp))])
        summary = summary.select("generation_mode", *[F.round(x, 4).alias(x) for x in summary.columns[1:]])
        return {"experiments": len(done), "failed": failed, "results": f"{self.out}/plasmode/results", "status": f"{self.out}/plasmode/status", "summary": [x.asDict() for x in summary.collect()]}

    def _simulated(self, made_by: DataFrame, n: int, seen: DataFrame, s: PlasmodeScenario, i: int, r: int) -> str:
        """The rows of one scenario and repeat, written: ``model``, what the evaluator sees, the simulated columns, and which rows validate."""
        c, seed = self.config.plasmode_experiments, 1000 * i + r
        rows = T.split_rows(made_by, c.train_fraction, seed, name="sim_split")
        data = plasmode.simulate(rows, n, s.scenario(), i, r, F.col("sim_split") == "train")
        if c.save_datasets:
            S.write_json({"scenario_idx": i, "repeat_idx": r, "train_fraction": c.train_fraction, "oracle_mode": c.oracle_mode, **dataclasses.asdict(s)}, f"{self.out}/plasmode/params/{i}-{r}", self.spark)
        if not c.oracle_mode:
            data = data.drop("features").join(seen.select("doc_id", "features"), "doc_id")
            data = standardised(data, feature_moments(data.where("sim_split = 'train'")))
        data = data.withColumns({"model": F.lit(seed), "validates": rng.uniform(seed, "validation", "doc_id") < INNER_VALIDATION})
        path = f"{self.out}/plasmode/data/{i}-{r}"
        S.write_table(data, path)
        return path

    def _evaluated(self, rows: DataFrame, m: int, grid: DataFrame) -> DataFrame:
        """Scores of all experiments, whose networks are trained in the same jobs: ``rows`` by ``model``, of which ``grid`` has a row each.

        In ``oracle_mode`` networks are heads on the true features alone, their rate falls by the epoch and validation leaves the targeted term out.
        """
        c = self.config.plasmode_experiments
        design, more = design_of(c.evaluator_architecture, m), {}
        if c.oracle_mode:
            design, more = dataclasses.replace(design, trunk=()), {"by_epoch": True, "validation_beta": 0.0}
        models = [x.model for x in grid.select("model").collect()]
        fitted = fit(rows.where("sim_split = 'train'"), design, c.evaluator_training, seed=0, validation=F.col("validates"), models=models, **more)
        log = estimate.log_table(fitted, self.spark).withColumnRenamed("fold", "model").join(grid.drop("target_ate"), "model").withColumns({"model_type": F.lit("evaluator"), "oracle_mode": F.lit(c.oracle_mode)})
        S.write_log(log.orderBy("model", "epoch").drop("model"), f"{self.out}/plasmode/training_log")
        found = estimate.predict(rows.where("sim_split = 'eval'").join(F.broadcast(grid), "model"), fitted, model_col="model").withColumn("estimated_ite", F.col("ite_logit"))
        scores = M.recovery_scores(found, ["generation_mode", "scenario_idx", "repeat_idx", "target_ate"])
        return S.write_table(scores.withColumns({"oracle_mode": F.lit(c.oracle_mode), "train_fraction": F.lit(c.train_fraction)}), f"{self.out}/plasmode/scores")

    def interpret(self, fold: int | None = None, k: int = 10) -> DataFrame:
        """The chunks that speak most for each confounder of the inference that ran (of a fold's, if it was crossed), with their texts."""
        name = f"{self.out}/applied_inference"
        chunks, bank = self.spark.read.parquet(f"{name}/chunks"), self.spark.read.parquet(f"{name}/bank" if fold is None else f"{name}/fold-{fold}/bank")
        arch = self.config.applied_inference.architecture
        return M.top_chunks(P.closest(chunks, bank, k), k, len(arch.explicit_confounder_texts or []))


def run_applied_inference(spark: SparkSession, config: Experiment, embedder: Embedder | None = None) -> dict:
    """The inference phase alone."""
    return ExperimentRunner(spark, dataclasses.replace(config), embedder).infer()
