"""The registered queries over whole small tables, against SQL or plain versions."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewell.llm.shared import table

TABLES = ("documents", "pages", "benchmark", "labels", "embeddings")


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]


def run(spark, sf_dir, name):
    return entry.queries()[name](spark, sf_dir)


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_suffix_dedup", "op4_exact_dedup", "op5_jaccard_join", "op7_warc", "op10_substring_dedup", "op11_centroid_clustering", "op13_filter_audit"])
def test_query_equals_sql(spark, sf_dir, sql, name):
    out = run(spark, sf_dir, name)
    found = sql.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in found.description]
    assert set(cols) == set(out.columns)
    rounded = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert Counter(rounded(r) for r in out.select(cols).collect()) == Counter(rounded(r) for r in found.fetchall())


def test_suffix_dedup_query(spark, sf_dir, documents):
    out = run(spark, sf_dir, "op2_suffix_dedup").collect()
    assert Counter(tuple(r)[:5] for r in out) == plain.removed_bytes(documents)
    assert all(r.n_removed <= r.n_shared <= r.n_bytes for r in out)


def test_substring_dedup_query(spark, sf_dir, documents):
    assert Counter(tuple(r) for r in run(spark, sf_dir, "op10_substring_dedup").collect()) == plain.removed_words(documents)


def test_jaccard_query(spark, sf_dir, documents):
    out = run(spark, sf_dir, "op5_jaccard_join").select("doc_id", "class_id", "text_id", "n_copies", "n_links", "n_text_links").collect()
    assert {r[0]: tuple(r[1:]) for r in out} == plain.near_classes(documents)


def test_toxicity_query(spark, sf_dir, documents):
    out = run(spark, sf_dir, "op3_toxicity")
    assert dict(out.dtypes) | {"score": "double", "predicted": "int", "held_out": "boolean"} == dict(out.dtypes)
    assert {r.doc_id for r in out.collect()} == {i for i, _ in documents}


def test_quality_query(spark, sf_dir, documents):
    out = run(spark, sf_dir, "op12_quality_classifier").collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in out)
    known = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    held = [(r.predicted, known[r.doc_id]) for r in out if r.held_out and r.doc_id in known]
    assert len(held) > 5 and sum(a == b for a, b in held) >= 0.8 * len(held)


def test_packing_query(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    rows = run(spark, sf_dir, "op6_packing").collect()
    tokenizer = Tokenizer.from_file(entry.import_module("tidewell.llm.queries").tokenizer_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in documents}
    for i, text in documents:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    fill = []
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        fill.append(at)
    assert max(fill) <= 1024 and sum(fill) / (1024 * len(fill)) > 0.97


def test_sharding_query(spark, sf_dir, documents):
    rows = run(spark, sf_dir, "op8_sharding").collect()
    slots, bytes_of = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        bytes_of[r.shard] += r.size
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "bytes", None) for i, t in documents)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in rows) == want
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    # rows are whole: each splitter misses its place by half a row and the tolerance at most
    mean, most = sum(bytes_of.values()) / 40, max(r.size for r in rows)
    assert max(abs(bytes_of[k] - mean) for k in range(40)) <= most + 0.004 * mean


def test_language_query(spark, sf_dir):
    rows = run(spark, sf_dir, "op9_language_id").collect()
    assert len(rows) == table(spark, sf_dir, "pages").count() and all(r.lang for r in rows)


def test_pipeline_equals_plain_stages(spark, sf_dir, documents):
    """Scores come from the toxicity query; every later stage is done anew on what the one before kept."""
    toxic = {r.doc_id for r in run(spark, sf_dir, "op3_toxicity").where("predicted = 1").collect()}
    docs = [(i, t) for i, t in documents if i not in toxic]
    groups = defaultdict(list)
    for i, t in docs:
        groups[plain.lowered(t)].append(i)
    stays = {max(g) for g in groups.values()}
    docs = [(i, t) for i, t in docs if i in stays]
    classes = plain.near_classes(docs)
    docs = [(i, t) for i, t in docs if classes[i][0] == i]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    leaks = {i for i, *_ in plain.contained(docs, items)}
    docs = [i for i, _ in docs if i not in leaks]
    out = run(spark, sf_dir, "pipeline")
    rows = out.collect()
    assert {r.doc_id for r in rows} == set(docs)
    whole = defaultdict(int)
    for r in rows:
        whole[r.doc_id, r.doc_tokens] += r.length
    assert all(n == v for (_, n), v in whole.items())
    assert toxic and leaks


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents").withColumns({"shard": F.lit(1), "score": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_scores_do_not_depend_on_partitions(spark, sf_dir):
    from tidewell.llm.toxicity import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    a, b = ({r.doc_id: r.score for r in toxicity(docs.repartition(n), labels.repartition(n)).collect()} for n in (1, 7))
    assert np.allclose([a[i] for i in a], [b[i] for i in a], atol=1e-6)
