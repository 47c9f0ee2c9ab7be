import gzip
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import pyarrow.fs as pafs
import pytest
from collisions import twins
from pyspark.sql import functions as F

from tidewell.llm import decontam, deobfuscate, drake_kmeans, exact_dedup, filter_audit, fusefilter, jaccard_join, langid, packing, quality, queries, sharding, shared, substring_dedup, suffix_dedup, toxicity, warc
from tidewell.llm.components import components
from tidewell.llm.textarrays import BYTE_VALUES

ROWS = plain.corpus()
#: Names that clash with what the operators call things inside.
CLASHES = ["batch", "bucket", "size", "shard", "slot", "law", "v", "n", "score", "digest", "kept", "class_id", "copied", "_key", "_row", "payload"]


def frame(spark, rows, clashes=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id")
    return df.withColumns({c: F.lit(7) for c in CLASHES}) if clashes else df


def got(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture
def small_batches(monkeypatch):
    """Many batches and buckets, so that everything crosses between them."""
    for module in (suffix_dedup, substring_dedup):
        monkeypatch.setattr(module, "BATCH_BYTES", 6000)
        monkeypatch.setattr(module, "BUCKET_BYTES", 9000)


# --- suffix and substring dedup -------------------------------------------------


def test_cover_reaches_every_difference():
    v, cover = suffix_dedup.PERIOD, suffix_dedup.COVER
    assert {(a - b) % v for a in cover for b in cover} == set(range(v)) and suffix_dedup.DEPTH > 0


@pytest.mark.parametrize("many", [False, True])
def test_suffix_dedup_equals_plain(spark, many, request):
    if many:
        request.getfixturevalue("small_batches")
    out = suffix_dedup.remove_repeated_bytes(frame(spark, ROWS)).withColumn("sha", F.sha2("kept", 256))
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == plain.removed_bytes(ROWS)


def test_suffix_dedup_repeated_rows_and_null_ids(spark):
    rng = random.Random(3)
    text = plain.words(rng, 100)
    rows = [(1, text), (1, text), (None, text + " tail"), (None, None), (2, plain.words(rng, 100))]
    out = suffix_dedup.remove_repeated_bytes(frame(spark, rows)).withColumn("sha", F.sha2("kept", 256))
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == plain.removed_bytes(rows)


@pytest.mark.parametrize("many", [False, True])
def test_substring_dedup_equals_plain(spark, many, request):
    if many:
        request.getfixturevalue("small_batches")
    rows = [*ROWS, (None, ROWS[-1][1]), (None, ROWS[-2][1])]
    out = substring_dedup.remove_repeats(frame(spark, rows)).withColumn("sha", F.sha2(F.encode("kept_text", "UTF-8"), 256))
    assert got(out, "doc_id", "n_words", "n_removed", "sha") == plain.removed_words(rows)


def test_substring_dedup_inside_one_document_only_smaller_ids_remove(spark):
    w = plain.words(random.Random(5), 50)
    out = substring_dedup.remove_repeats(frame(spark, [(1, f"{w} {w}"), (2, w), (2, w)]))
    assert got(out, "doc_id", "n_removed") == Counter({(1, 0): 1, (2, 50): 2})


# --- exact dedup ------------------------------------------------------------------


def test_exact_dedup_equals_plain(spark):
    rows = [*ROWS, (100, "ONE"), (101, None), (102, "Ä"), (103, "ä")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain.lowered(t)].append(i)
    want = Counter((i, max(g := groups[plain.lowered(t)]), len(g), i == max(g), plain.sha(plain.lowered(t).encode())) for i, t in rows)
    out = exact_dedup.group_report(frame(spark, rows)).withColumn("sha", F.lower(F.hex("digest")))
    assert got(out, "doc_id", "keep_id", "group_size", "kept", "sha") == want
    stays = exact_dedup.drop_exact_copies(frame(spark, rows))
    assert got(stays, "doc_id") == Counter((max(g),) for g in groups.values())
    assert set(CLASHES) <= set(stays.columns)


def test_exact_dedup_repeated_rows_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")]
    assert got(exact_dedup.drop_exact_copies(frame(spark, rows)), "doc_id", "text") == Counter([(1, "a"), (None, "b")])


def test_exact_dedup_null_ids_meet_the_stored_half(spark):
    rows = [(1, "x"), (2, "y"), (9, "a"), (10, "b"), (None, "A"), (None, "a"), (None, "c"), (None, "c")]
    out = exact_dedup.group_report(frame(spark, rows))
    assert got(out, "doc_id", "keep_id", "group_size", "kept") == Counter(
        [(1, 1, 1, True), (2, 2, 1, True), (9, 9, 3, True), (10, 10, 1, True), (None, 9, 3, False), (None, 9, 3, False), (None, None, 2, True), (None, None, 2, True)]
    )
    assert got(exact_dedup.drop_exact_copies(frame(spark, rows)), "doc_id", "text") == Counter([(1, "x"), (2, "y"), (9, "a"), (10, "b"), (None, "c")])
    stored = exact_dedup.build_snapshot(frame(spark, [(None, "p"), (None, "p"), (None, "q"), (7, "q"), (None, "r")]))
    found = exact_dedup.exact_dedup(frame(spark, [(None, "p"), (3, "Q"), (4, "R"), (None, "s")]), [stored])
    assert got(found, "keep_id", "n", "old_id", "old_n") == Counter([(None, 1, None, 2), (3, 1, 7, 2), (4, 1, None, 1), (None, 1, None, None)])


def test_later_batches_meet_several_snapshots(spark):
    old = [exact_dedup.build_snapshot(frame(spark, r), bucket_rows=3) for r in (ROWS[:20], ROWS[20:40])]
    new = frame(spark, [(900, ROWS[10][1]), (901, ROWS[30][1]), (902, "never seen"), (903, "never seen")])
    rows = exact_dedup.exact_dedup(new, old).collect()
    found = {r.keep_id: (r.n, r.old_id) for r in rows}
    assert found == {900: (1, ROWS[10][0]), 901: (1, ROWS[30][0]), 903: (2, None)}


def test_fuse_filter_holds_all_and_little_else():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        keys = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
        made = fusefilter.build(keys)
        assert fusefilter.contains(made, keys).all()
        other = rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
        assert fusefilter.contains(made, other).mean() < 0.01 and len(made) < 64 + 2.4 * n + 100


# --- joins on shingles ----------------------------------------------------------------


def near_rows(seed=11):
    """Texts at all similarities around the threshold, chains, and many copies."""
    rng = random.Random(seed)
    rows, i = [*ROWS], 1000
    for _ in range(12):
        w = plain.words(rng, 60).split()
        for k in (0, 1, 2, 3, 5):
            c = w[:]
            for at in rng.sample(range(60), k):
                c[at] = "z" + str(at)
            rows.append((i, " ".join(c)))
            i += 1
    chain = plain.words(rng, 80).split()
    for _ in range(10):
        rows.append((i, " ".join(chain)))
        chain = chain[3:] + plain.words(rng, 3).split()
        i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [256, 4])
def test_jaccard_join_equals_plain(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_rows()
    out = jaccard_join.jaccard_join(frame(spark, rows))
    found = {r[0]: tuple(r[1:]) for r in out.select("doc_id", "class_id", "text_id", "n_copies", "n_links", "n_text_links").collect()}
    assert found == plain.near_classes(rows)
    if block == 256:
        stays = jaccard_join.drop_near_copies(frame(spark, rows))
        assert got(stays, "doc_id") == Counter((c[0],) for i, c in found.items() if c[0] == i) and set(CLASHES) <= set(stays.columns)


def test_jaccard_join_null_ids_and_repeated_rows(spark):
    text = plain.words(random.Random(2), 40)
    rows = [(None, text), (5, text), (5, text), (None, None), (None, None), (6, "")]
    out = got(jaccard_join.jaccard_join(frame(spark, rows)), "doc_id", "n_copies", "n_links")
    assert out == Counter({(None, 3, 2): 1, (5, 3, 2): 2, (None, 1, 0): 2, (6, 1, 0): 1})


def test_prefix_meets_the_recall():
    d = jaccard_join.prefix_length()
    assert 1 - (1 - 0.8**d) ** jaccard_join.TREES >= jaccard_join.RECALL
    with pytest.raises(ValueError):
        jaccard_join.prefix_length(0.1, trees=2)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3), (300, 301), (301, 300)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**dict.fromkeys(range(1, 61), 1), **dict.fromkeys(range(100, 140), 100), 300: 300, 301: 300}


def test_decontamination_equals_plain(spark):
    rng = random.Random(8)
    items = [(i, plain.words(rng, rng.choice([5, 6, 8, 12, 40, 200]))) for i in range(40)] + [(90, None), (91, ""), (92, "too short"), (93, ROWS[12][1])]
    docs = [*ROWS]
    for n, (_, t) in enumerate(items[:40]):
        w = t.split()
        docs.append((2000 + n, f"{plain.words(rng, rng.choice([0, 30, 3000]))} {t.upper()} {plain.words(rng, 20)}"))
        w[len(w) // 2] = "changed"
        docs.append((3000 + n, f"{plain.words(rng, 30)} {' '.join(w)}"))
    docs.append((None, items[0][1]))
    df = frame(spark, docs)
    its = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    want = plain.contained(docs, items)
    cols = ("doc_id", "item_id", "n_shingles", "n_shared")
    assert got(decontam.contained_items(df, its), *cols) == want
    assert got(decontam.contained_items(df, its, block_shingles=100), *cols) == want  # many blocks
    clean = got(decontam.drop_contaminated(df, its), "doc_id")
    hit = {i for i, *_ in want}
    assert clean == Counter((i,) for i, _ in docs if i not in hit)


def test_decontamination_blocks_are_bounded_whatever_the_ids(spark, monkeypatch):
    rng = random.Random(5)
    items = [(None if i % 2 else 7, plain.words(rng, 60)) for i in range(30)] + [(None, "one two three four five " * 2000)]
    docs = [(i, f"{plain.words(rng, 30)} {t}") for i, (_, t) in enumerate(items)]
    held, steps = [], []
    made, stage = decontam.Items.__post_init__, decontam.staged

    def noted(self):
        made(self)
        held.append((len(self.hashes), sum(map(len, self.texts))))
        steps.append("block")

    def noted_stage(df, name):
        steps.append(name)
        return stage(df, name)

    monkeypatch.setattr(decontam.Items, "__post_init__", noted)
    monkeypatch.setattr(decontam, "staged", noted_stage)
    found = decontam.contained_items(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_shingles=200)
    assert got(found, "doc_id", "item_id", "n_shingles", "n_shared") == plain.contained(docs, items)
    assert len(held) > 5 and max(n for n, _ in held) < 200 + 60
    assert steps[1:-1:2] == ["block"] * (len(held) - 1) and set(steps[2:-1:2]) == {"item-matches"} and steps[-1] == "block"


def test_decontamination_with_a_shingle_that_all_items_share(spark, tmp_path):
    """A thousand items that begin alike against documents with that phrase: pairs that share no more aren't tried, and the result equals SQL."""
    import duckdb

    rng = random.Random(3)
    phrase = "which of the following is"
    items = [(i, f"{phrase} {plain.words(rng, rng.choice([1, 3, 12, 12, 12, 30]))}") for i in range(1000)] + [(i, phrase) for i in (5000, 5001)] + [(i, items_end) for i, items_end in enumerate(["x y " + phrase + " so far"] * 40, 6000)]
    docs = [(i, f"{plain.words(rng, 4)} {phrase} {plain.words(rng, 6)}") for i in range(1500)]
    docs += [(3000 + i, f"{plain.words(rng, 9)} {items[i][1].upper()} {phrase}, {plain.words(rng, 6)}") for i in range(0, 1000, 25)] + [(None, f"x y {phrase} so far")]
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        spark.createDataFrame(rows, f"{key} long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    df, its = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("documents", "benchmark"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    want = Counter((a, b, n, m) for a, b, n, m in con.execute(f"SELECT doc_id, item_id, n_shingles, n_shared FROM ({queries.ORACLE_SQL['op1_decontamination']})").fetchall())
    assert got(decontam.contained_items(df.where("doc_id IS NOT NULL"), its), "doc_id", "item_id", "n_shingles", "n_shared") == Counter({k: v for k, v in want.items() if k[0] is not None})
    assert sum(n > 1 for (_, _, n, _) in want) > 40 and got(decontam.contained_items(df.where("doc_id IS NULL"), its), "item_id") == Counter([(i,) for i in [5000, 5001, *range(6000, 6040)]])


# --- packing ----------------------------------------------------------------------------


def packed_is_whole(rows, docs, ids_of, length=1024):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {i for i, _ in docs}
    for i, t in docs:
        want, at = [*ids_of(t), 0], 0
        own = sorted(pieces[i], key=lambda r: r.start)
        for r in own:
            assert r.start == at and r.doc_tokens == len(want)
            assert np.frombuffer(r.ids, "<u4").tolist() == want[at : at + r.length]
            at += r.length
        assert at == len(want)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and sum(r.length for r in own) <= length
    return len(sequences)


def test_packing_is_whole_and_full(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    ids_of = lambda t: tok.encode(t or "", add_special_tokens=False).ids
    rows = [*ROWS, (5000, "it's we'll they've I'd 'quoted' can't''s 12345 3.14  two  spaces \n\n new\r\nline\ttab "), (5001, "<|endoftext|> x"), (5002, "🙂 𝒳 \U000e0001 é"), (5003, "   "), (5004, "'s's 'S don't 'lll")]
    out = packing.pack(frame(spark, rows), path).collect()
    n = packed_is_whole(out, rows, ids_of)
    total = sum(len(ids_of(t)) + 1 for _, t in rows)
    assert n <= math.ceil(total / 1024 * 1.03) + 1
    small = packing.pack(frame(spark, rows), path, length=64, most_open=2, slack=4).collect()
    packed_is_whole(small, rows, ids_of, 64)


def test_packing_merges_leftovers_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 3)
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    rows = [(i, f"text {i}") for i in range(300)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(20), path, length=32, slack=2).collect()
    n = packed_is_whole(out, rows, lambda t: tok.encode(t or "", add_special_tokens=False).ids, 32)
    assert n <= math.ceil(sum(r.length for r in out) / 32 * 1.1) + 1


# --- WARC -----------------------------------------------------------------------------


def test_warc_round_trip(spark):
    long = "<p>" + "é" * 100 + "</p>"
    pages = [(1, "http://a/ b\n", long), (2, "http://b", long), (3, None, long), (None, "http://c", long), (4, "http://d", None), (5, "http://e", ""), (6, "u", "short"), (7, "v", "short"), (8, "w", "x" * 3_000_000), (9, "x", "x" * 3_000_000), (10, "y", "\r\n\r\nWARC/1.1\r\n" * 20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in CLASHES})
    rows = warc.round_trip(spark, df).collect()
    first = {long: 1, "x" * 3_000_000: 8}
    want = Counter()
    for i, _, h in pages:
        body = (h or "").encode()
        kept = h not in first or first[h] == i
        want[i, len(body), plain.sha(body), "response" if kept else "revisit", None if kept else first[h]] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    body = {r.page_id: bytes(r.payload) for r in rows if r.payload is not None}
    assert all(body[i] == (h or "").encode() for i, _, h in pages if i in body)
    assert {r.page_id: r.url for r in rows}[1] == "http://a/%20b%0A"


def test_normaliser_rewrites_any_gzip_stream(tmp_path):
    records = [warc.warc_record({"page_id": i, "url": f"u{i}", "payload": bytes([i]) * (i * 1000), "payload_digest": "d", "is_revisit": False, "refers_to": None}) for i in range(40)]
    one, many = b"".join(records), b"".join(gzip.compress(r) for r in records[:7]) + gzip.compress(b"".join(records[7:])) + b"\0" * 20
    for name, data in (("one.warc.gz", gzip.compress(one)), ("many.warc.gz", many)):
        (tmp_path / name).write_bytes(data)
        index = warc.normalise_archive(f"file://{tmp_path}/{name}", f"file://{tmp_path}/out")
        made = (tmp_path / "out" / name).read_bytes()
        assert gzip.decompress(made) == one and len(index) == 40
        for (_, at, n, *_), r in zip(index, records, strict=True):
            assert gzip.decompress(made[at : at + n]) == r
        assert len((tmp_path / "out" / f"{name}.idx.jsonl").read_text().splitlines()) == 40
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(one[:-100]))
    with pytest.raises(ValueError):
        warc.normalise_archive(f"file://{tmp_path}/cut.warc.gz", f"file://{tmp_path}/out")
    assert pafs.LocalFileSystem()  # archives go through pyarrow's file systems


# --- sharding ---------------------------------------------------------------------------


@pytest.mark.parametrize("part_bytes", [32 << 20, 4000])
def test_sharding_is_even_and_gapless(spark, part_bytes):
    rng = random.Random(4)
    rows = [(i, plain.words(rng, rng.randint(1, 60))) for i in range(2000)] + [(5000 + i, "the same text " * 10) for i in range(1000)] + [(None, "x"), (1, None), (2, "")]
    out = sharding.shard(frame(spark, rows), part_bytes=part_bytes).collect()
    assert Counter((r.doc_id, r.text, r.size) for r in out) == Counter((i, t, len((t or "").encode()) + 16) for i, t in rows)
    slots, size = defaultdict(list), Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 40
    assert max(abs(x - mean) for x in size.values()) <= 2 * 500 + 0.01 * mean
    assert {r.law for r in out} == {"bytes"} and all(r.grown_shard is None and r.batch == 7 for r in out)


# --- toxicity and language ------------------------------------------------------------------


def test_decoder_restores_disguises():
    text = "the idiot is a moron and the people of the stupid town were idiots too " * 200
    buf = np.frombuffer(text.encode(), np.uint8)
    decoder = deobfuscate.Decoder(deobfuscate.trigram_counts(buf, np.array([0, len(buf)])))
    for span, want in (("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("iiidiooot", "idiot"), ("m0r*n", "moron"), ("s t u p i d", "stupid"), ("$tup1d", "stupid")):
        assert decoder.restore(span) == want
    line = "see 1d10t and m o r o n here\nplain words".encode()
    _, starts, ends = deobfuscate.suspicious_spans(np.frombuffer(line, np.uint8), np.array([0, len(line)]))
    assert [line[a:b] for a, b in zip(starts, ends, strict=True)] == [b"1d10t", b"m o r o n"]


def test_toxicity_learns_and_keeps_to_the_held_in_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = shared.table(spark, d, "documents"), shared.table(spark, d, "labels")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    auc = np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean])
    assert auc > 0.95
    caught, wrong = sum(r.predicted for r in rows if r.toxic), sum(r.predicted for r in rows if not r.toxic)
    assert caught > 0.8 * len(toxic) and wrong < 0.01 * len(clean)
    # held-out labels change nothing
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    some = docs.where("doc_id < 50")
    assert got(toxicity.score(some, toxicity.fit(docs, labels)), "doc_id", "score") == got(toxicity.score(some, toxicity.fit(docs, flipped)), "doc_id", "score")


def test_toxicity_of_edge_rows(spark):
    rows = [*ROWS, (None, "x"), (None, None), (4, "one")]
    labels = spark.createDataFrame([(10 + i, i % 2) for i in range(20)] + [(None, 1), (11, None)], "doc_id long, toxic int")
    out = toxicity.toxicity(frame(spark, rows), labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    kept = toxicity.drop_toxic(frame(spark, rows), labels)
    assert got(kept, "doc_id") == Counter((r.doc_id,) for r in out if not r.predicted)
    one_sided = spark.createDataFrame([(10, 0)], "doc_id long, toxic int")
    assert not toxicity.toxicity(frame(spark, rows), one_sided).where("predicted = 1").count()


def test_language_by_text_host_and_markup(spark):
    docs = shared.table(spark, "/root/testdata/sf0.01", "documents")
    held = docs.where("doc_id % 7 = 0 AND n_chars > 200").select("doc_id", "text", "lang").collect()
    teach = docs.where("doc_id % 7 <> 0")
    langs = sorted({r.lang for r in held})
    pages = [(r.doc_id, f"https://www.site-{r.lang}.com/{r.doc_id}", f"<html><body><p>{r.text}</p><script>var x</script>") for r in held]
    empty = [(-1 - k, f"https://www.site-{x}.com/e", "<html><body></body>") for k, x in enumerate(langs)]
    declared = [(-100, "https://elsewhere.org/", f"<html lang='{langs[0]}'>"), (-101, None, None), (-102, "", ""), (-103, "::", "<" * 5000)]
    df = spark.createDataFrame(pages + empty + declared, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in CLASHES})
    out = {r.page_id: r for r in langid.identify(df, teach).collect()}
    assert len(out) == len(pages) + len(empty) + len(declared)
    assert np.mean([out[r.doc_id].lang == r.lang for r in held]) > 0.97
    assert all(out[-1 - k].lang == x for k, x in enumerate(langs))
    assert out[-100].declared == langs[0] and all(0 < r.probability <= 1 for r in out.values())
    assert langid.host_of("https://u:p@Sub.Example.CO.UK:80/x?q") == "sub.example.co.uk"


# --- empty tables --------------------------------------------------------------------------


def test_empty_tables_give_empty_results(spark):
    docs = frame(spark, ROWS[:8]).where("false")
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    taught = frame(spark, ROWS[:8]).withColumn("lang", F.lit(None).cast("string"))
    for out in (
        suffix_dedup.remove_repeated_bytes(docs),
        substring_dedup.remove_repeats(docs),
        exact_dedup.group_report(docs),
        exact_dedup.drop_exact_copies(docs),
        jaccard_join.jaccard_join(docs),
        jaccard_join.drop_near_copies(docs),
        decontam.contained_items(docs, items),
        decontam.contained_items(frame(spark, ROWS[:8]), items),
        toxicity.toxicity(docs, labels),
        packing.pack(docs, queries.tokenizer_path()),
        sharding.shard(docs),
        warc.round_trip(spark, pages),
        langid.identify(pages, taught),
    ):
        assert out.count() == 0
    assert decontam.drop_contaminated(frame(spark, ROWS[:8]), items).count() == 8


# --- edges ---------------------------------------------------------------------------------


def test_exact_dedup_one_row_of_a_group_and_id(spark):
    rows = [(1, "a"), (1, "A"), (2, None), (2, ""), (3, "b")]
    stays = got(exact_dedup.drop_exact_copies(frame(spark, rows)), "doc_id")
    assert stays == Counter([(1,), (2,), (3,)])


def test_near_dedup_one_row_of_a_class_and_id(spark):
    w = plain.words(random.Random(9), 40)
    rows = [(5, w), (5, w), (5, w + " more"), (6, w), (7, ""), (7, ""), (7, None), (5, plain.words(random.Random(10), 30))]
    stays = got(jaccard_join.drop_near_copies(frame(spark, rows)), "doc_id")
    assert stays == Counter({(5,): 2, (7,): 1})  # a class, and another text with the same id; null and empty are one text here


def test_fates_follow_id_and_text(spark):
    item = plain.words(random.Random(3), 30)
    rows = [(1, item), (1, "clean text of some more words here"), (None, item), (None, "clean")]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert got(decontam.drop_contaminated(frame(spark, rows), items), "doc_id", "text") == Counter([rows[1], rows[3]])


def test_signatures_of_documents_are_their_bins_smallest():
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.choice(1 << 48, n, replace=False).astype(np.uint64)) for n in (0, 1, 30, 3000)]
    bounds, keys = np.concatenate([[0], np.cumsum([len(s) for s in sets])]), np.concatenate(sets)
    for load in (0.05, 1.0, 10.0):
        at, bits = decontam.document_signatures(bounds, keys, load)
        want = [int(min(s[s >> np.uint64(48 - int(b)) == p])) for s, b in zip(sets, bits, strict=True) for p in sorted(set((s >> np.uint64(48 - int(b))).tolist()))]
        assert keys[at].tolist() == want
    assert len(decontam.document_signatures(bounds, keys, 10.0)[0]) < len(keys) / 4  # long items look few shingles up


def test_forest_stretches_join(spark, monkeypatch):
    """Nodes that the ranges of many small tasks cut apart have one hub."""
    rng = random.Random(6)
    w = plain.words(rng, 200).split()
    rows = [(i, " ".join([*w[:k], f"x{i}", *w[k + 1 :]])) for i, k in enumerate(rng.choices(range(200), k=60))]
    want = plain.near_classes(rows)
    for walk in (500_000, 40):
        monkeypatch.setattr(jaccard_join, "WALK", walk)
        out = jaccard_join.jaccard_join(frame(spark, rows))
        assert {r[0]: tuple(r[1:]) for r in out.select("doc_id", "class_id", "text_id", "n_copies", "n_links", "n_text_links").collect()} == want


def test_depths_follow_the_least_similarity_of_a_size():
    for n in (1, 4, 5, 6, 10, 50, 200):
        pairs = [s / (n + m - s) for m in range(1, 2 * n) for s in range(min(n, m) + 1) if not (n == m == s) and s / (n + m - s) >= 0.8 - 1e-12]
        assert jaccard_join.least_similarity(n, 0.8) == pytest.approx(min(pairs, default=1.0))
    d = jaccard_join.own_depths(np.array([1, 6, 5000]), 0.8, jaccard_join.RECALL)
    assert d[0] == jaccard_join.LONGEST and d[2] == jaccard_join.prefix_length() and d[1] >= d[2]


def test_decoder_finds_the_best_reading():
    """Against all readings of a lattice."""
    from itertools import product

    text = "the cat sat on a mat and the dog ate it " * 50
    counts = deobfuscate.trigram_counts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    decoder = deobfuscate.Decoder(counts)
    logp = decoder.logp

    def value(path):
        a = b = 0
        total, chars = 0.0, ""
        for symbol, char, cost in path:
            total -= cost
            if not (symbol < 0 or (symbol == 0 and b == 0)):
                total += logp[a][b][symbol]
                a, b, chars = b, symbol, chars + char
        return total + (logp[a][b][0] if b else 0), chars

    for span in ("c4t", "d.0.g", "m@tt", "s*t", "7h3", "f**k", "a-t e"):
        best = max(value(p)[0] for p in product(*decoder.options(span)))
        readings = {value(p)[1] for p in product(*decoder.options(span)) if value(p)[0] > best - 1e-9}
        assert decoder.restore(span) in readings, span


def test_long_spans_are_decoded_whole():
    """A disguised word is read alike wherever it stands in a span."""
    text = "the idiot and a stupid moron said that all of it is idiotic"
    buf = np.frombuffer((text * 20).encode(), np.uint8)
    decoder = deobfuscate.Decoder(deobfuscate.trigram_counts(buf, np.array([0, len(buf)])))
    for n in range(40, 80):
        assert decoder.restore("the-" * (n // 4) + "." * (n % 4) + "1d10t").endswith("idiot"), n


def test_marks_side_by_side_are_spans():
    line = b"so a$$ and sh!+ and f**k but hello!! stays and idio+ too"
    _, starts, ends = deobfuscate.suspicious_spans(np.frombuffer(line, np.uint8), np.array([0, len(line)]))
    assert [line[a:b] for a, b in zip(starts, ends, strict=True)] == [b"a$$", b"sh!+", b"f**k", b"idio+"]
    assert deobfuscate.Decoder(np.ones(28**3, np.int64)).restore("1" * 500)


def test_equal_texts_with_unlike_labels(spark):
    docs = spark.createDataFrame([(i, "same text" if i < 9 else f"other {i}") for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(12)], "doc_id long, toxic int")
    rows = {r.text: r.label for n in (1, 5) for r in toxicity._training_rows(docs.repartition(n), labels, 10**9).collect()}
    assert rows["same text"] == 0


def test_samples_keep_their_share_at_any_size(spark):
    n = spark.range(20_000).where(shared.in_share("id", 5 * 10**4, 10**5)).count()
    assert abs(n - 10_000) < 400
    tiny = shared.in_share("id", 40_000, 10**14)
    assert "3602879" in str(tiny._jc.toString())  # 2**53 * 4e-10: not rounded to nothing


def test_language_sums_of_hot_names(spark, monkeypatch):
    docs = shared.table(spark, "/root/testdata/sf0.001", "documents")
    pages = shared.table(spark, "/root/testdata/sf0.001", "pages")
    pages = pages.withColumn("url", F.when(F.col("page_id") % 3 == 0, "http://hot.example.org/x").otherwise(F.col("url")))
    cols = ("page_id", "lang", F.round("probability", 9))
    a = got(langid.identify(pages, docs), *cols)
    monkeypatch.setattr(langid, "BROADCAST_NUMBERS", 0)
    monkeypatch.setattr(langid, "HOT", 7)
    assert got(langid.identify(pages, docs), *cols) == a


def test_host_and_markup_change_the_answer(spark):
    """Against Bayes' rule by hand: short texts that two languages share go the way of their host and markup."""
    docs = spark.createDataFrame([(i, "aaa bbb ccc ddd", "xx") for i in range(40)] + [(100 + i, "aaa bbb ccc eee", "yy") for i in range(40)], "doc_id long, text string, lang string")
    pages = [(i, "http://h1.com/a", "<p>ddd ddd ddd") for i in range(30)] + [(50 + i, "http://h2.net/a", "<p>eee eee eee") for i in range(30)]
    pages += [(100, "http://h1.com/b", "<p>aaa"), (101, "http://h2.net/b", "<p>aaa"), (102, "http://new.org/b", "<html lang='yy'><p>aaa"), (103, "http://new.org/c", "<html lang='xx'><p>aaa")]
    out = {r.page_id: r for r in langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert [out[i].lang for i in (100, 101, 102, 103)] == ["xx", "yy", "yy", "xx"]
    languages, models = langid.fit_models(docs)
    seen = langid.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string"), models).collect()
    soft = {r.page_id: np.exp(np.array(r.text_logs) - max(r.text_logs)) for r in seen}
    soft = {i: p / p.sum() for i, p in soft.items()}
    overall = sum(soft.values()) + 1
    prior = overall / overall.sum()
    for level in ("suffix", "domain", "host"):
        own = {r.page_id: r[level] for r in seen}
        others = sum((p for i, p in soft.items() if own[i] == own[100] and i != 100), np.zeros(2))
        prior = (others + langid.LEAN * prior) / (others + langid.LEAN * prior).sum()
    logs = next(np.array(r.text_logs) for r in seen if r.page_id == 100) + np.log(prior)
    share = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
    assert out[100].probability == pytest.approx(share.max(), rel=1e-9) and languages[int(share.argmax())] == "xx"


def test_long_texts_pass_the_piece_limit(spark):
    rng = random.Random(12)
    long = plain.words(rng, 420_000)  # above 2 MB
    passage = plain.words(rng, 90)
    rows = [(1, f"{long} {passage}"), (2, f"{passage} tail"), (3, f"{long} {passage}"), (4, "short")]
    assert len(rows[0][1]) > 2_000_000
    df = frame(spark, rows)
    repeats = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df).collect()}
    assert repeats == {1: 0, 2: 90, 3: 420_090, 4: 0}
    gone = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeated_bytes(df).collect()}
    assert gone[1] == gone[3] == len(rows[0][1]) and gone[2] == len(passage.encode()) + (passage[-1:] == " ")
    assert {r.doc_id: r.n_copies for r in jaccard_join.jaccard_join(df).collect()} == {1: 2, 2: 1, 3: 2, 4: 1}
    assert got(decontam.contained_items(df, spark.createDataFrame([(9, passage)], "item_id long, text string")), "doc_id") == Counter([(1,), (2,), (3,)])


def test_other_tokenizer_files_encode_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from tidewell.llm.tokens import Encoder

    made = Tokenizer(models.WordLevel({"a": 1, "b": 2, "?": 3}, unk_token="?"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    made.save(f"{tmp_path}/t.json")
    import pyarrow as pa

    assert not Encoder(f"{tmp_path}/t.json").parted and Encoder(queries.tokenizer_path()).parted
    assert [x.tolist() for x in Encoder(f"{tmp_path}/t.json").encode(pa.array(["a b", None, "b c"]))] == [[1, 2], [], [2, 3]]


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace as N

    class Conf(dict):
        def get(self, k, default):
            return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(N(conf=Conf(), sparkContext=N(master="spark://host:7077")))


def test_shared_folder_without_a_scheme_is_on_the_default_file_system(spark, tmp_path):
    from types import SimpleNamespace as N

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    was = conf.get("fs.defaultFS")
    fake = N(conf={"spark.checkpoint.dir": f"{tmp_path}/shared"}, sparkContext=spark.sparkContext, _jvm=spark._jvm, _jsc=spark._jsc)
    assert shared.shared_dir(fake) == f"file:{tmp_path}/shared"
    conf.set("fs.defaultFS", "viewfs://store/")
    conf.set("fs.viewfs.mounttable.store.link./a", f"file://{tmp_path}")
    try:
        fake.conf = {"spark.checkpoint.dir": "/a/shared"}
        assert shared.shared_dir(fake) == "viewfs://store/a/shared"
        fake.conf = {"spark.checkpoint.dir": f"file://{tmp_path}/x"}
        assert shared.shared_dir(fake).startswith("file:/")
    finally:
        conf.set("fs.defaultFS", was)


@pytest.mark.parametrize("name", ["same", "ids"])
def test_sharding_keeps_its_law_for_repeated_rows(spark, name):
    """A third of the rows are one text, with one id or a few: sizes stay near equal, slots gapless, nothing is lost."""
    rows = [(i, f"w{i} " * 20, i % 3) for i in range(2600)] + [(7777 if name == "same" else 7777 + k % 3, "same text here " * 10, k % 2) for k in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    out = sharding.shard(docs).collect()
    assert Counter((r.doc_id, r.text, r.extra) for r in out) == Counter(rows)
    sizes, slots = Counter(), {}
    for r in out:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and all(abs(x - mean) <= 200 + 0.01 * mean for x in sizes.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_language_counts_all_labelled_rows(spark):
    """Few labelled rows among many, null ids and repeated ones: every one counts."""
    labelled = [(None, "der die das und nicht", "de")] * 20 + [(5, "the and of this that", "en")] * 20
    docs = spark.createDataFrame(labelled + [(100 + i, "x y z", None) for i in range(5000)], "doc_id long, text string, lang string")
    languages, logs = langid.fit_models(docs)
    assert languages == ["de", "en"] and logs.shape[0] == 2
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>the and this</p>"), (2, "http://c.d/", "<p>und nicht das</p>")], "page_id long, url string, html string")
    assert {r.page_id: r.lang for r in langid.identify(pages, docs).collect()} == {1: "en", 2: "de"}


def test_staged_tables_can_be_cleared(spark):
    out = shared.staged(spark.range(3).toDF("x"), "clearing")
    assert out.count() == 3 and out.inputFiles()[0].startswith("file:") and f"/{spark.sparkContext.applicationId}/" in out.inputFiles()[0]


# --- equal keys, unlike bytes ------------------------------------------------------


@pytest.fixture(scope="module")
def alike():
    """Two unlike words of 384 letters and digits under one key."""
    signs = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
    one, two = twins(signs, BYTE_VALUES[signs])
    one, two = one.tobytes().decode(), two.tobytes().decode()
    assert one != two and len(one) == len(two) == 384
    return one, two


def test_suffix_dedup_compares_bytes(spark, alike):
    """Strings of 400 bytes under one key that are unlike stay; those that do repeat go, beside them and across batches."""
    one, two = (f"{x} and it ends"[:400].ljust(400, ".") for x in alike)
    rows = [(1, one), (2, two)]
    assert got(suffix_dedup.remove_repeated_bytes(frame(spark, rows, False)), "doc_id", "n_removed") == Counter([(1, 0), (2, 0)])
    rows += [(3, "before " + one), (4, two + " after"), (5, f"{one}{two} here"), (6, "q" * 500), (7, None)]
    for size in (900, 100_000):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(suffix_dedup, "BATCH_BYTES", size)
            out = suffix_dedup.remove_repeated_bytes(frame(spark, rows, False))
            assert got(out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)), "*") == plain.removed_bytes(rows)


def test_runs_name_their_claims(spark):
    """The numbers of claims are read back as they were written, whatever bytes they have."""
    import pyarrow as pa

    from tidewell.llm import agreement

    n = 3 * 5000
    hit = np.arange(n) % 3 == 0
    piece = agreement.Piece(0, np.array([0, n]), np.arange(n), np.arange(n).astype(np.uint64), lambda i: b"%d" % i)
    made = agreement.claims(0, pa.table({"nth": pa.array([0], pa.int64())}), iter([(piece, hit)]), 10)
    runs = spark.createDataFrame(made.filter(made.column("no").is_null()).select(["start", "refs"]))
    read = {r.start: r.no for r in runs.select("start", agreement.claim_numbers("refs").alias("no")).collect()}
    assert read == {3 * i: [i] for i in range(n // 3)}


def test_substring_dedup_compares_words(spark, alike):
    one, two = (f"{x} " + " ".join(f"w{i}" for i in range(49)) for x in alike)
    rows = [(1, one), (2, two)]
    assert got(substring_dedup.remove_repeats(frame(spark, rows, False)), "doc_id", "n_removed") == Counter([(1, 0), (2, 0)])
    rows += [(3, "x y " + two), (4, one + " more"), (None, two), (6, " ".join(["z"] * 60))]
    for size in (900, 100_000):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(substring_dedup, "BATCH_BYTES", size)
            out = substring_dedup.remove_repeats(frame(spark, rows, False))
            assert got(out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256)), "*") == plain.removed_words(rows)


def test_jaccard_join_compares_shingles(spark, alike):
    """Unlike sets under one name are no copies, and unlike shingles under one hash are not shared."""
    one, two = alike
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{one} b c d e"), (2, f"{two} b c d e"), (3, f"{two}, B c d e!"), (4, f"{one} {long}"), (5, f"{two} {long}"), (6, " ".join(f"{one} t{i}" for i in range(20))), (7, " ".join(f"{two} t{i}" for i in range(20)))]
    out = jaccard_join.jaccard_join(frame(spark, rows, False)).collect()
    assert {r.doc_id: (r.class_id, r.text_id, r.n_copies, r.n_links, r.n_text_links) for r in out} == plain.near_classes(rows)
    assert {r.doc_id: r.class_id for r in out} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 7}


def test_exact_sets_equal_plain():
    import pyarrow as pa

    from tidewell.llm.shingles import exact_sets

    texts = [t for _, t in ROWS[:60]] + ["a b c d", "a b c d 0", "d c b a", ""]
    sets, wanted = exact_sets(pa.array(texts, pa.string())), [plain.shingles(t, short=True) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in wanted]
    assert all(len(np.intersect1d(a, b)) == len(x & y) for a, x in zip(sets, wanted, strict=True) for b, y in zip(sets, wanted, strict=True))
    assert exact_sets(pa.array([], pa.string())) == []


def test_encoder_compares_pieces():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tidewell.llm import tokens

    letters = np.array([c for c in range(0x4E00, 0x9000)], np.uint32)
    one, two = (x.astype("<u4").tobytes().decode("utf-32-le") for x in twins(letters, tokens._values()[letters]))
    path = queries.tokenizer_path()
    plainly = Tokenizer.from_file(path)
    wanted = lambda t: plainly.encode(t, add_special_tokens=False).ids
    assert one != two and wanted(one) != wanted(two)
    texts = [f"a {one}", "b", f"c {two} d", f"{one} {two}", two]
    made = tokens.Encoder(path)
    for some in (texts, texts[::-1], texts[2:3]):
        assert [x.tolist() for x in made.encode(pa.array(some))] == [wanted(t) for t in some]


# --- centroid clustering ---------------------------------------------------------------


def plain_kmeans(rows, k=8, rounds=10):
    """By exact integers, one vector at a time: vec_id, vector, cluster, distance; and the centroids."""
    x = [(i, tuple(max(-(1 << 27), min(1 << 27, math.floor(1024 * float(np.float32(c))) if abs(c) < 1e9 else int(math.copysign(1 << 27, c)))) for c in v)) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    start = sorted(x, key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in x]
        for j in range(len(c)):
            some = [v for (_, v), o in zip(x, own, strict=True) if o == j]
            if some:
                c[j] = [sum(col) // len(some) for col in zip(*some, strict=True)]
    return [(i, j, d) for (i, v) in x for d, j in [nearest(v)]], c


def vectors_frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts).withColumns({c: F.lit(1) for c in ("block", "state", "cluster", "x", "v", "ids")})


def held_to_plain(spark, rows, **options):
    got_rows = drake_kmeans.cluster(vectors_frame(spark, rows), **options).collect()
    want, c = plain_kmeans(rows, options.get("clusters", 8), options.get("rounds", 10))
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got_rows) == Counter(want)
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    for r in got_rows:
        own = sum(d for _, j, d in want if j == r.cluster)
        most = (1 << 63) - 1
        assert (r.cluster_inertia, r.inertia, r.centroid_sha256) == (min(own, most), min(sum(d for *_, d in want), most), names[r.cluster])


def test_clustering_equals_plain(spark, monkeypatch):
    """Groups, ties, equal vectors that fill a third, repeated and null ids, and vectors that are not kept."""
    monkeypatch.setattr(drake_kmeans, "BLOCK", 64)
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=64) * 0.05 + (i % 11) / 8]) for i in range(300)]
    rows += [(1000 + i, [0.25] * 64) for i in range(150)] + [(5, rows[5][1]), (5, [1.0] * 64), (None, [0.5] * 64), (None, [0.5] * 64)]
    rows += [(2000, None), (2001, [1.0] * 63), (2002, [1.0] * 63 + [None]), (2003, [float("nan")] + [0.0] * 63), (2004, [float("inf")] + [0.0] * 63), (2005, [])]
    held_to_plain(spark, rows)
    held_to_plain(spark, rows, clusters=20, rounds=4)
    held_to_plain(spark, rows, clusters=1, rounds=2)


def test_clustering_of_few_and_huge_vectors(spark):
    rng = np.random.default_rng(6)
    held_to_plain(spark, [(i, [float(i)] * 64) for i in range(3)])
    held_to_plain(spark, [(i, [0.5] * 64) for i in range(20)])  # one centroid takes all, the others stay empty
    held_to_plain(spark, [(i, [float(c) for c in rng.normal(size=64) * 10.0 ** (i % 9)]) for i in range(40)] + [(99, [3e38] * 64), (98, [-3e38] * 64)], rounds=3)
    empty = drake_kmeans.cluster(vectors_frame(spark, [(1, None)]))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidewell")]


def test_bounds_never_miss_a_nearer_centroid():
    """Random walks of centroids: certified or not, assignments equal a full scan's, and certified ones cost no distance."""
    rng = np.random.default_rng(7)
    x = rng.integers(-500, 500, (400, 64))
    c = rng.integers(-500, 500, (12, 64))
    state = drake_kmeans.scanned(x, c, 4)
    for step in (0, 1, 2, 40, 200, 1, 0):
        moved = c + rng.integers(-step, step + 1, c.shape)
        by = np.sqrt(((moved - c) ** 2).sum(1).astype(float)) * (1 + 1e-9)
        c = moved
        state, used = drake_kmeans.moved_on(x, c, drake_kmeans.Bounds.of(state.packed(), len(x)), by, 3)
        d = drake_kmeans.squares(x, c)
        assert (state.own == d.argmin(1)).all() and (state.upper.astype(float) ** 2 >= d.min(1) * (1 - 1e-12)).all()
        near = np.take_along_axis(d, state.near.astype(int), 1)
        assert ((state.low.astype(float) ** 2 <= near) | (state.low < 0)).all()
        rest = np.where((np.arange(12) == state.own[:, None]) | (state.near[:, :, None] == np.arange(12)).any(1), np.iinfo(np.int64).max, d).min(1)
        assert ((state.rest.astype(float) ** 2 <= rest) | (state.rest < 0)).all() and used <= 3


# --- quality -----------------------------------------------------------------------------


def test_quality_learns_and_keeps_to_the_held_in_rows(spark):
    rng = random.Random(11)
    good = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(rng.randint(20, 120)))
    bad = lambda: " ".join(f"{w}###" for w in good().split()) if rng.random() < 0.5 else " | ".join(good().upper().split())
    rows = [(i, good() if i % 3 else bad()) for i in range(240)]
    labels = [(i, int(bool(i % 3)), 0) for i in range(240)]
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.quality(docs, known).collect()}
    held = {i for i in out if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, r in out.items() if r.held_out} == held and len(held) > 20
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in out.values())
    assert sum(out[i].predicted == bool(i % 3) for i in held) >= 0.97 * len(held)
    # labels of held-out rows, and columns beside the text, change nothing
    turned = spark.createDataFrame([(i, 1 - q if i in held else q, 1) for i, q, _ in labels], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in quality.quality(docs.withColumn("lang", F.lit("zz")).repartition(2), turned).collect()}
    assert again == {i: r.score for i, r in out.items()}


def test_quality_votes_equal_plain(spark):
    """Scores from the space and the voters, one document at a time: all cosines, the nearest by weight, ties at the edge in part."""
    docs = frame(spark, [(i, t) for i, t in ROWS if i != 90])
    labels = spark.createDataFrame([(i, int(i is not None and i % 3 > 0), 0) for i, _ in ROWS if i != 90], "doc_id long, quality int, toxic int")
    space = quality.latent_space(docs)
    assert np.allclose(space.axes.T @ space.axes, np.eye(quality.AXES), atol=1e-9)
    voters = quality.voters(docs, labels, space)
    import pyarrow as pa

    out = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    texts = dict(ROWS)
    for i, score in out.items():
        (_, x), = space.vectors(pa.array([texts[i]], pa.string()))
        cos = sorted(((float(np.float32(x[0]) @ v), y) for v, y in zip(voters.vectors, voters.labels, strict=True)), reverse=True)
        edge = cos[min(quality.NEAREST, len(cos)) - 1][0]
        above = [c for c in cos if c[0] > edge + 1e-6]
        tied = [c for c in cos if abs(c[0] - edge) <= 1e-6]
        part = (min(quality.NEAREST, len(cos)) - len(above)) / len(tied)
        w = [(max(c, 0) ** quality.SHARPNESS, y) for c, y in above] + [(part * max(c, 0) ** quality.SHARPNESS, y) for c, y in tied]
        want = (sum(a * y for a, y in w) + quality.PRIOR * voters.labels.mean()) / (sum(a for a, _ in w) + quality.PRIOR)
        assert abs(score - want) < 1e-4, i


def test_latent_axes_are_those_of_all_terms(spark):
    """The axes span what a dense decomposition of the whole weighted matrix finds."""
    import pyarrow as pa

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma"] if i % 3 == 0 else ["one", "two", "THREE", "four"] if i % 3 == 1 else ["x1", "y2###", "z3"], k=30))) for i in range(90)]
    space = quality.latent_space(frame(spark, rows), axes=3)
    dense = np.zeros((90, quality.TERMS))
    for first, _, row, col, w in quality._weighted(pa.array([t for _, t in rows]), space.idf):
        dense[first + row, col] = w
    top = np.linalg.svd(dense, full_matrices=False)[2][:3]
    assert np.linalg.svd(top @ space.axes)[1].min() > 0.999


def test_quality_of_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (None, "a b"), (4, "a b"), (4, "a b"), (5, "ä " * 20000)]
    docs = frame(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality(docs, none).collect()} == {0.5}
    odd = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0), (4, 0, 0), (4, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality(docs, odd).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows) and len({r.score for r in out if r.doc_id in (1, 2, 3)}) == 1
    assert all(not r.held_out for r in out if r.doc_id is None) and quality.quality(docs.where("false"), odd).collect() == []


# --- filter audit ----------------------------------------------------------------------------


def plain_audit(rows, labels):
    """(part, order, step): the seven counts, by replaying every document through every order."""
    from itertools import permutations

    inf = float("inf")
    first: dict = {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", inf), inf if i is None else i)
    seen = []
    for i, t, part in rows:
        t = t or ""
        w = plain.PLAIN_WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": first[t] < (inf if i is None else i)}
        seen.append((part or "", fails, any(q == 1 for j, q, _ in labels if j == i and i is not None), any(x == 1 for j, _, x in labels if j == i and i is not None)))
    out: dict = {}
    for part in {s[0] for s in seen}:
        for p in permutations("ABCDE"):
            left = [s for s in seen if s[0] == part]
            gone = []
            for step, k in enumerate(p, 1):
                here = [s for s in left if s[1][k]]
                left = [s for s in left if not s[1][k]]
                out[part, "".join(p), step] = [len(left), len(here), sum(s[1][k] for s in gone), sum(s[1][k] and sum(s[1].values()) == 1 for s in seen if s[0] == part), sum(s[2] for s in here), sum(s[3] for s in here)]
                gone += here
    shapley = Counter()
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] += v[1]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def audit_rows():
    rng = random.Random(9)
    long = " ".join(f"w{i}" for i in range(120))
    rows = [(i, plain.words(rng, rng.randint(80, 130)), rng.choice(["en", "de", None, ""])) for i in range(30)]
    rows += [(100 + i, long, "en" if i % 2 else "fr") for i in range(6)] + [(200, long.upper(), "en"), (201, f"{long} $", "en"), (202, "w " * 150, "de"), (203, "É" * 10 + long, "fr")]
    rows += [(300, None, "en"), (301, "", None), (None, long, "en"), (None, "nobody has this", "de"), (None, "nobody has this", "de"), (400, long, "zz"), (400, long, "zz"), (10, rows[10][1], "en")]
    return rows, [(i, int(i % 2), int(i % 5 == 0)) for i in range(0, 400, 3)] + [(100, 1, 0), (100, 0, 1), (101, None, 1), (None, 1, 1)]


@pytest.mark.parametrize("hot", [10_000, 2])
def test_filter_audit_equals_plain(spark, monkeypatch, hot):
    """Nulls, repeated ids and texts, hot texts and others, clashing names."""
    monkeypatch.setattr(filter_audit, "HOT_ROWS", hot)
    rows, labels = audit_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).withColumns({c: F.lit(3) for c in ("part", "flags", "words", "step", "good", "salt", "digest", "first")})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("no"))
    out = filter_audit.audit(docs, known)
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got_rows = {(r.part, r.filter_order, r.step): tuple(r[c] for c in names) for r in out.collect()}
    assert got_rows == plain_audit(rows, labels) and len(got_rows) == 5 * 600


def test_filter_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, none).collect() == []
    one = filter_audit.audit(spark.createDataFrame([(1, "a", None)], docs.schema), none).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and sum(r.removed for r in one) == 120 and {r.good_lost for r in one} == {0}


def test_filter_audit_combines_before_the_shuffle(spark):
    """The replay sends partial counts, not documents: aggregates stand on both sides of its exchange, and no order is shuffled."""
    rows, labels = audit_rows()
    flags = filter_audit.document_flags(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    plan = filter_audit.replay(flags)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count_if" in plan.replace("partial_count(if", "partial_count_if") and "BroadcastNestedLoopJoin" in plan and "CartesianProduct" not in plan
