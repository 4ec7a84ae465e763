"""Training-data operators against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tickweave.llm")
import corpus_pipeline  # noqa: E402
from tickweave.llm import (  # noqa: E402
    ann_multi_index, chat_format, graph, hnsw_dedup, langid, minhash_dedup, packing, queries, sentencepiece_lattice, toxicity, url_filter, warc,
)

DOCS = "doc_id long, text string, digest string, row int, id long, score double, component_id long"
LONG = "far " * 40_000


def docs(spark, rows):
    """Documents with extra columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, "x", 1, 7, 0.5, 3) for i, t in rows], DOCS)


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def closure(ids, linked):
    top = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(top[a], top[b])
            if top[a] != low or top[b] != low:
                top[a] = top[b] = low
                changed = True
    return top


def test_minhash_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    base = [[rng.choice(words) for _ in range(rng.randint(20, 60))] for _ in range(12)]
    texts = []
    for i in range(160):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (502, " \t\n"), (503, "One two"), (504, "one TWO"), (505, LONG)]
    for short in (64, 3):  # the second sends every list through blocks
        monkeypatch.setattr(minhash_dedup, "SHORT_LIST", short)
        out = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs(spark, rows), width=4).collect()}
        sets = {i: shingles(t, 4) for i, t in rows}
        linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        want = closure(sets, linked)
        assert {i: r.component_id for i, r in out.items()} == want
        assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in out.items())
    left = minhash_dedup.deduplicate(docs(spark, rows + [(0, texts[0]), (None, "lonely")]), width=4)
    assert left.columns == docs(spark, []).columns
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == sorted(i for i in want if want[i] == i)
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_minhash_compares_rows_without_id(spark):
    base = [f"w{i}" for i in range(60)]
    near, far = list(base), [f"v{i}" for i in range(40)]
    near[3] = "other"
    schema = "doc_id long, text string, text_hash string, times int, digest binary, row string"
    text = {"base": " ".join(base), "near": " ".join(near), "far": " ".join(far), "far2": " ".join([*far, "end"])}
    rows = [(None, text["base"]), (None, text["near"]), (7, text["near"]), (None, text["base"]), (None, text["far"]), (None, text["far2"]), (None, text["far"]), (None, None), (None, " "), (7, text["near"]), (None, "alone in the world of words")]
    table = spark.createDataFrame([(i, t, "h", 1, b"d", "r") for i, t in rows], schema)
    for short in (64, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(minhash_dedup, "SHORT_LIST", short)
            out = minhash_dedup.near_duplicates(table).collect()
            left = minhash_dedup.deduplicate(table)
        assert sorted((r.doc_id is None, r.n_shingles, r.component_id or 0, r.kept, r.copies) for r in out) == sorted(
            [(True, 56, 7, False, 2)] * 2 + [(True, 56, 7, False, 3)] + [(False, 56, 7, True, 3)] * 2 + [(True, 36, 0, False, 2)] * 2 + [(True, 37, 0, False, 1)]
            + [(True, 0, 0, True, 1)] * 2 + [(True, 2, 0, True, 1)]
        )
        assert left.columns == table.columns
        kept = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
        assert len(kept) == 5 and (7, text["near"]) in kept and (None, None) in kept and (None, " ") in kept and (None, rows[-1][1]) in kept
        assert sum(t in (text["far"], text["far2"]) for _, t in kept) == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7), (None, 3)] + [(200, i) for i in range(201, 260)]
    out = dict(graph.connected_components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert all(out[i] == 1 for i in range(1, 61)) and out[101] == 100 and out[259] == 200 and len(out) == 122


def test_components_of_few_links_are_short_jobs(spark):
    setting, context = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context.setJobGroup("components", "")
    try:
        out = graph.connected_components(chain).collect()
        tracker = context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(s.numTasks for s in map(tracker.getStageInfo, stages) if s and s.numCompletedTasks)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", setting)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == 201 and {c for _, c in out} == {0}
    assert tasks < 400  # a table of 64 partitions a step made some thousands


def test_url_filter(spark):
    rules = [*queries.URL_RULES, ("a.com", "allow"), ("a.com/", "block"), ("b.com/x", "allow"), ("b.com/x", "block")]
    urls = [
        "http://WWW.example.com/en/7?x", "https://example.com/en/8", "http://x.net/de/1", "http://example.net/de/8/9", "http://a.org/es/", "http://org/es/a#b", "nothing", None, "",
        "ftp://a.com", "ftp://a.com/z", "http://b.com/xy", "http://notexample.com/de/", "//x", "a://b://c/en/", "http://com/en", "http://EXAMPLE.COM/EN/7",
    ]
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string"), rules).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = (re.match(r"[^/?#]*", rest)[0].lower(), re.match(r"[^/?#]*([^?#]*)", rest)[1])
        fit = [(len(r), len(r.split("/")[0]), v == "block", r, v) for r, v in rules if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
        best = max(fit, default=(0, 0, 0, None, "allow"))
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == (host, path, best[3], best[4]), u


def test_links_between_shards_alone_are_audited(spark, monkeypatch):
    """No shard holds a link of its own, and the walk is as narrow as it gets."""
    for name, value in (("SHARD_ROWS", 150), ("QUERY_ROWS", 100), ("FIRST_BEAM", 1), ("DEGREE", 2), ("BUILD_BEAM", 2)):
        monkeypatch.setattr(hnsw_dedup, name, value)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(900, 12))
    near = base + rng.normal(size=base.shape) * 0.05
    both = [(2 * i + k, [float(x) for x in v], 1) for i, pair in enumerate(zip(base, near)) for k, v in enumerate(pair)]
    table = spark.createDataFrame(both, VECTORS)
    for kept in range(3):  # the number of shards follows the rows that stay
        shards = -(-table.count() // 150)
        at = {r.vec_id: r.s for r in table.select("vec_id", F.pmod(F.xxhash64("embedding"), F.lit(shards)).alias("s")).collect()}
        table = table.where(F.col("vec_id").isin([i for i in at if at.get(i - i % 2) is not None and at.get(i - i % 2) != at.get(i - i % 2 + 1, at[i])]))
        table = spark.createDataFrame(table.collect(), VECTORS)
    rows = {r.vec_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in table.collect()}
    ids = sorted(rows)
    unit = np.array([rows[i] for i in ids])
    close = unit @ unit.T >= 0.93
    out = {r.vec_id: r.n_links for r in hnsw_dedup.near_duplicates(table).collect()}
    found, true = sum(out.values()), int(close.sum() - len(ids))
    assert true > 300 and found >= 0.99 * true
    monkeypatch.setattr(hnsw_dedup, "foreign_beam", lambda graph, threshold, queries, beam: beam)
    assert sum(r.n_links for r in hnsw_dedup.near_duplicates(table).collect()) < found


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    rng = random.Random(5)
    texts = [None, "", " ", "   ", "Hello world", "a  b   c", "tab\tline\n\nend ", "ÄÖ…☃ 日本語 ①②", "aaaaaaaaaaaaaaaaaaaaaaa", "x" * 700, "▁mark", "-" * 60, "word " * 3000]
    texts += ["".join(rng.choice("abcdetnrsi  ßé") for _ in range(rng.randint(1, 80))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(4, "Hello world")]
    encoded = sentencepiece_lattice.encode(docs(spark, rows), queries.piece_model())
    back = sentencepiece_lattice.decode(encoded, queries.piece_model()).collect()
    assert len(back) == len(rows)
    for r in back:
        text = texts[r.doc_id] or ""
        assert r.ids == model.encode(text), text
        assert r.decoded == text.replace("▁", " ") and r.text_crc32 == zlib.crc32(text.encode())
    assert sentencepiece_lattice.encode(docs(spark, []), queries.piece_model()).count() == 0


def test_sentencepiece_of_long_texts_and_small_tables(spark, monkeypatch):
    """Texts of many blocks and windows, and a task that forgets its stretches several times."""
    model = sentencepiece_lattice.load(queries.piece_model())
    rng = random.Random(8)
    dense = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(20_000))
    long = ["a" * 20_000, dense, " " * 2_000, "=" * 3_000, "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(5_000))]
    for r in sentencepiece_lattice.encode(docs(spark, list(enumerate(long))), queries.piece_model()).collect():
        assert r.ids == model.encode(long[r.doc_id])
    for name, small in (("HELD_STRETCHES", 20), ("SLICE_CHARS", 60), ("SLICE_IDS", 40)):
        monkeypatch.setattr(sentencepiece_lattice, name, small)
    table = sentencepiece_lattice.Pieces(queries.piece_model())

    class Value:
        def __init__(self, value):
            self.value = value

    texts = [" ".join(rng.choice(["alpha", "beta", "x1", "Ünder", "day.", "##", "☃"]) + rng.choice("abcdef") for _ in range(rng.randint(0, 12))) for _ in range(120)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(120), pa.int64()), pa.array(texts)], names=["id", "text"])
    read = pa.Table.from_batches(sentencepiece_lattice._read(Value(sentencepiece_lattice.Bonds(table)), table.longest)(iter([batch])))
    assert sum(n == 0 for n in read.column("no").to_pylist()) > 3 and sum(d is not None for d in read.column("doc").to_pylist()) == 120


def vectors(seed, n, size=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    rows = [(i, [float(x) for x in np.float32(centres[i % 12] + rng.normal(size=size) * rng.choice([0.05, 0.3, 1.0]))], int(i % 2)) for i in range(n)]
    return rows + [(n + k, list(rows[0][1]), 0) for k in range(30)] + [(9001, None, 0), (9002, [0.0] * size, 0), (9003, [math.nan] * size, 0), (9004, [math.inf] * size, 1), (9005, [None] * size, 1), (9006, rows[0][1], None)]


VECTORS = "vec_id long, embedding array<float>, label int"


def test_neighbours_recall_and_order(spark):
    rows = vectors(1, 600)
    df = spark.createDataFrame([(*r, 1) for r in rows], VECTORS + ", cell int")
    found: dict = {}
    for r in ann_multi_index.search(df, F.col("vec_id") % 20 == 0, k=20).collect():
        found.setdefault(r.query_id, []).append(r)
    good = {i: np.array(v, float) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    assert set(found) == {i for i in good if i % 20 == 0}
    hits = 0
    for q, got in found.items():
        got.sort(key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 21)) and all(r.vec_id != q for r in got)
        assert all(r.score == pytest.approx(float(good[q] @ good[r.vec_id]), rel=1e-9) for r in got)
        true = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:20]
        hits += len({i for _, i in true} & {r.vec_id for r in got})
    assert hits >= 0.9 * 20 * len(found)
    assert ann_multi_index.search(df.limit(0), F.lit(True)).count() == 0


def test_neighbours_recall_where_the_index_prunes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    data = np.float32(rng.normal(size=(3000, 16)))  # no clusters, so neighbours lie in many cells
    data[:40] = data[0]  # more copies of a query than a query wants
    df = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(data)], VECTORS)
    monkeypatch.setattr(ann_multi_index, "CANDIDATES", 50)
    walks = []
    whole = ann_multi_index.audited_walk
    monkeypatch.setattr(ann_multi_index, "audited_walk", lambda *a: walks.append(whole(*a)) or walks[-1])
    found: dict = {}
    for r in ann_multi_index.search(df, F.col("vec_id") % 20 == 0, k=20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 3000, 20):
        scores = data.astype(float) @ data[q].astype(float)
        scores[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(3000), -scores))[:20].tolist()) & found[q])
    assert hits >= 0.9 * 20 * 150
    assert 50 < walks[0][0] and walks[0][1] >= 0.95


def test_embedding_links(spark, monkeypatch):
    rows = vectors(2, 500)
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, g in rows if g is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    group = {i: g for i, _, g in rows}
    linked = [(a, b) for a in unit for b in unit if a < b and group[a] == group[b] and unit[a] @ unit[b] >= 0.93]
    want = closure(group, linked)
    count = {i: sum(i in p for p in linked) for i in group}
    for shard, block in ((8192, 2048), (60, 40)):  # the second spreads each group over shards
        monkeypatch.setattr(hnsw_dedup, "SHARD_ROWS", shard)
        monkeypatch.setattr(hnsw_dedup, "QUERY_ROWS", block)
        out = {r.vec_id: r for r in hnsw_dedup.near_duplicates(spark.createDataFrame([(*r, 5) for r in rows], VECTORS + ", class int")).collect()}
        assert {i: r.component_id for i, r in out.items()} == want
        assert {i: r.n_links for i, r in out.items()} == count and all(r.kept == (want[i] == i) for i, r in out.items())
    assert hnsw_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_beam_audit_sees_sparse_links_beside_a_hot_group():
    rng = np.random.default_rng(4)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    centre = rng.normal(size=(1, 16))
    hot = unit(centre + rng.normal(size=(700, 16)) * 0.001)
    single = unit(rng.normal(size=(650, 16)))
    pairs = np.concatenate([unit(single + rng.normal(size=single.shape) * 0.001), single])

    class Blind(hnsw_dedup.Graph):
        """Walks narrower than 128 see nothing but the row itself outside the hot group."""

        def search(self, queries, beam, down_to=0):
            near = queries @ self.unit.T
            if beam < 128:
                near = np.where((near < 1 - 1e-9) & ~((near[:, :700] > 0.9).all(axis=1))[:, None], -2.0, near)
            ids = np.argsort(-near, axis=1, kind="stable")[:, :beam]
            return ids, np.take_along_axis(near, ids, axis=1)

    graph = Blind.__new__(Blind)
    graph.unit = np.concatenate([hot, pairs])
    graph.layers = []
    assert hnsw_dedup.audited_beam(graph, 0.93) >= 128
    # few rows with links: the audit draws on until it has met them
    graph.unit = np.concatenate([unit(rng.normal(size=(4000, 16))), pairs[:3], pairs[650:653]])
    graph.unit = graph.unit[((graph.unit @ graph.unit.T >= 0.93).sum(1) == 1) | (np.arange(len(graph.unit)) >= 4000)]
    graph.search = lambda queries, beam, down_to=0: Blind.search(graph, queries, beam) if beam >= 128 else (np.zeros((len(queries), beam), int), np.full((len(queries), beam), -2.0))
    assert hnsw_dedup.audited_beam(graph, 0.93) >= 128


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "größe " * 5000
    pages = [(1, "http://a/\r\nx", big), (2, "http://b", big), (3, None, None), (4, "", ""), (5, "http://c", "x" * 99), (6, "http://d", "x" * 99), (7, "u", "a\r\n\r\nb" * 40), (8, "u", "a\r\n\r\nb" * 40), (0, "v", big), (None, "n", big)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, payload string")
    folder = f"file://{tmp_path}/w"
    index = warc.write(df, folder)
    got = {r.page_id: r for r in warc.read_records(index, folder).collect()}
    for i, u, h in pages:
        data = (h or "").encode()
        same = [j for j, _, t in pages if j is not None and (t or "").encode() == data]
        again = len(data) >= 100 and (i is None or i != min(same))
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response")
        assert r.refers_to == (min(same) if again else None) and (again or bytes(r.payload) == data)
    some = warc.read_records(index.where("page_id in (4, 7)"), folder).collect()
    assert sorted(r.page_id for r in some) == [4, 7]
    assert warc.read_records(index.limit(0), folder).count() == 0
    assert warc.write(df.limit(0), f"file://{tmp_path}/e").count() == 0


def test_warc_keeps_no_shuffle_of_all_payloads(spark, tmp_path):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {f.getPath(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}

    pages = spark.range(2_000).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "array_join(transform(sequence(1, 30), i -> sha2(concat(id, '-', i), 256)), '') AS html")
    known, folder = set(shuffles()), f"file://{tmp_path}/w"
    index = warc.write(pages, folder)
    left = sum(n for f, n in shuffles().items() if f not in known)  # removal goes on after the write, so the last turn's may be there
    records = sum(r.length for r in index.select("length").collect())
    assert records > 3_000_000 and left < records / 2
    assert spark.conf.get(warc.REMOVE_SHUFFLES) == "false"
    got = warc.read_records(index, folder)
    assert (got.count(), got.where("sha2(payload, 256) = payload_digest").count(), got.agg({"payload_bytes": "sum"}).first()[0]) == (2_000, 2_000, 2_000 * 30 * 64)


def test_warc_paths_and_openers(spark, tmp_path):
    from pyarrow import fs

    assert warc.file_system(f"file://{tmp_path}/x")[1] == f"{tmp_path}/x" and warc.file_system("dbfs:/a/b")[1] == "/dbfs/a/b"
    folder = f"file://{tmp_path}/w"
    index = warc.write(spark.createDataFrame([(1, "http://a/", "x" * 200), (2, None, "y")], "page_id long, url string, html string"), folder)
    rows = warc.read_records(index, folder, lambda path: (fs.LocalFileSystem(), path.removeprefix("file:"))).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in rows) == [(1, 200), (2, 1)]


def test_toxicity(spark):
    rng = random.Random(7)
    clean = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(clean) for _ in range(25)) + (" you vile scum" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(500)]
    train = spark.createDataFrame([r for r in rows if r[0] < 350], "doc_id long, text string, toxic int")
    weights = toxicity.fit(train.union(spark.createDataFrame([(999, None, 1), (998, "x", None)], train.schema)))
    assert 0 < weights.count() <= toxicity.BUCKETS
    out = {r.doc_id: r.score for r in toxicity.score(docs(spark, [(i, t) for i, t, _ in rows if i >= 350] + [(700, None), (701, ""), (702, LONG)]), weights).collect()}
    assert all((out[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows if i >= 350)
    assert all(0 <= s <= 1 for s in out.values()) and out[700] == out[701] < toxicity.THRESHOLD
    assert {r.score for r in toxicity.score(docs(spark, [(1, "a")]), toxicity.fit(train.limit(0))).collect()} == {0.5}


def _plain_buckets(text):
    """Buckets of words, pairs and skip-pairs by whole-number arithmetic."""
    import xxhash

    words = re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    h, prime, most = [xxhash.xxh64_intdigest(w) for w in words], 0x9E3779B97F4A7C15, 2**64
    grams = h + [((a * prime) % most) ^ (b + 1) % most for a, b in zip(h, h[1:])] + [((a * prime) % most) ^ (b + 2) % most for a, b in zip(h, h[2:])]
    return {(g * prime % most) >> 44 for g in grams}


def test_toxicity_equals_plain_ftrl(spark):
    """The fit and the scores against follow-the-regularised-leader over dictionaries."""
    rng = random.Random(17)
    rows = [(i, " ".join(rng.choice(["ab", "Cd", "e-f", "gé", "h1"]) for _ in range(rng.randint(0, 9))) + (" bad" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)]
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    order = {r.doc_id: r.h for r in train.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    samples = [(sorted(_plain_buckets(t)) + ["bias"], y) for i, t, y in sorted(rows, key=lambda r: order[r[0]])]
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, z[k]) - z[k]) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    for epoch in range(toxicity.EPOCHS):
        for at in np.random.default_rng(epoch).permutation(len(samples)):
            keys, label = samples[at]
            w = {k: weight(k) for k in keys}
            gap = (1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - label) * (toxicity.TOXIC_WEIGHT if label else 1)
            for k in keys:
                before = n.get(k, 0.0)
                n[k] = before + gap * gap
                z[k] = z.get(k, 0.0) + gap - (math.sqrt(n[k]) - math.sqrt(before)) / toxicity.ALPHA * w[k]
    plain = {toxicity.BIAS if k == "bias" else k: weight(k) for k in z if weight(k)}
    fitted = toxicity.fit(train)
    found = {r.bucket: r.weight for r in fitted.collect()}
    assert plain and set(found) == set(plain) and all(abs(found[k] - plain[k]) < 1e-9 for k in plain)
    for r in toxicity.score(train.select("doc_id", "text"), fitted).collect():
        total = plain.get(toxicity.BIAS, 0.0) + sum(plain.get(k, 0.0) for k in _plain_buckets(r.text))
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9
    nested = train.select(F.struct("doc_id", "text").alias("doc"))
    assert {r.doc.doc_id: r.score for r in toxicity.score(nested, fitted, ("doc", "text")).collect()} == {r.doc_id: r.score for r in toxicity.score(train, fitted).collect()}


def test_language_equals_plain_backoff(spark):
    """Predictions and scores against counts kept in dictionaries; more languages than 64, and words never seen."""
    rng = random.Random(18)
    words = {f"l{g:02}": ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(6)] for g in range(70)}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(8)), g) for i in range(700) for g in [f"l{i % 70:02}"]]
    table, totals = {}, {}
    for _, text, lang in rows:
        for word in text.split():
            padded = f" {word} "
            for key in [(0, word)] + [(s, padded[i : i + s]) for s in range(1, langid.LONGEST + 1) for i in range(len(padded) - s + 1)]:
                own = table.setdefault(key, {})
                own[lang] = own.get(lang, 0) + 1
                totals[lang, key[0]] = totals.get((lang, key[0]), 0) + 1
    table = {k: {g: n for g, n in v.items() if n >= langid.LEAST} for k, v in table.items()}
    table = {k: v for k, v in table.items() if v}
    many = [sum(k[0] == s for k in table) for s in range(langid.LONGEST + 1)]

    def score(word, lang):
        padded = f" {word} "
        for size in [0, *range(langid.LONGEST, 0, -1)]:
            grams = [word] if size == 0 else [padded[i : i + size] for i in range(len(padded) - size + 1)]
            known = [math.log((table[size, g].get(lang, 0) + langid.SMOOTH) / (totals.get((lang, size), 1) + langid.SMOOTH * (many[size] + 1))) for g in grams if (size, g) in table]
            if known:
                return sum(known) / len(known)
        return 0.0

    counts = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert counts.select("lang").distinct().count() == 70
    asked = [(i, " ".join(rng.choice([*words[f"l{i % 70:02}"], "hgfedcba" * 8, "zzz", "abcx"]) for _ in range(rng.randint(1, 6)))) for i in range(100)]
    out = {r.doc_id: r for r in langid.predict(docs(spark, asked), counts).collect()}
    for i, text in asked:
        totals_by = {g: sum(score(w, g) for w in text.split()) / max(1, len(text.split()) ** 0.5) for g in sorted(words)}
        best = max(totals_by, key=lambda g: totals_by[g])
        share = 1 / sum(math.exp(v - totals_by[best]) for v in totals_by.values())
        assert abs(totals_by[out[i].lang_pred] - totals_by[best]) < 1e-9 and abs(out[i].score - share) < 1e-6


def test_language_model_bounds_raise(spark, monkeypatch):
    train = spark.createDataFrame([(i, "some words here", g) for i in range(8) for g in [f"l{i}"]], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MOST_ENTRIES", 5)
    with pytest.raises(ValueError, match="more than 5 counts"):
        langid.predict(train, langid.fit(train, least=1))
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 7)
    with pytest.raises(ValueError, match="more than 7 languages"):
        langid.fit(train)


def test_language(spark):
    rng = random.Random(8)
    words = {"xx": ["kala", "maja", "taevas", "puu"], "yy": ["strom", "zrcadlo", "prst", "vlk"]}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(12)), g) for i in range(80) for g in [("xx", "yy")[i % 2]]]
    counts = langid.fit(spark.createDataFrame([*rows, (900, None, "xx"), (901, "kala", None)], "doc_id long, text string, lang string"))
    asked = [(1, "kala puu"), (2, "zrcadla vlkem"), (3, None), (4, ""), (5, "123 !?"), (6, "kala " * 50_000), (1, "kala puu")]
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs(spark, asked), counts).collect()}
    assert [out[i][0] for i in range(1, 7)] == ["xx", "yy", "und", "und", "und", "xx"]
    assert all(0 <= s <= 1 for _, s in out.values())
    assert langid.predict(docs(spark, []), counts).count() == 0


def test_packing_remembers_chunks_within_bounds(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 20)
    tokenizer = packing.load_tokenizer(queries.word_tokenizer())
    rng = random.Random(12)
    chunks = packing.ChunkIds(tokenizer)
    for _ in range(40):
        text = " ".join(rng.choice(["often", "Again,"]) if rng.random() < 0.5 else f"rare{rng.randrange(500)}x" for _ in range(30))
        assert chunks.of([text.encode()])[0].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID]
        assert len(chunks.known) <= 60 and len(chunks.before) <= 60


def test_packing_takes_the_whole_tokenizer_where_chunks_would_differ():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.splits_at_spaces(queries.word_tokenizer()) and not packing.splits_at_spaces(path)
    spanning = packing.WholeIds(packing.load_tokenizer(path))
    ids = spanning.tokenizer.encode("two  words", add_special_tokens=False).ids
    assert spanning.of([b"two  words", None])[0].tolist() == [*ids, packing.END_ID] and spanning.of([None])[0].tolist() == [packing.END_ID]


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.word_tokenizer())
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["one", "two.", "Three!", "naïve", "don't", "<|endoftext|>", "x9y", "日本"]) for _ in range(rng.randint(0, 900)))) for i in range(60)] + [(100, None), (101, ""), (102, LONG), (None, "no id")]
    out = packing.pack(docs(spark, rows).coalesce(2), queries.word_tokenizer()).collect()
    text = dict(rows)
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(text)
    for i, pieces in by_doc.items():
        ids = np.array([*tok.encode(text[i] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    pad = total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SEQUENCE
        pad, total = pad + packing.padding(at), total + at
    assert pad < 0.05 * total
    assert packing.pack(docs(spark, []), queries.word_tokenizer()).count() == 0


def test_packing_cuts_are_the_cheapest(monkeypatch):
    monkeypatch.setattr(packing, "SEQUENCE", 16)
    monkeypatch.setattr(packing, "POWERS", (1, 2, 4, 8))
    rng = np.random.default_rng(10)
    for _ in range(200):
        places = np.cumsum(rng.integers(1, 6, 14))
        cost = rng.integers(0, 4, 14)
        at = [0, *places.tolist()]
        pay = packing.padding
        best = [0.0] + [math.inf] * 14
        for i in range(1, 15):
            best[i] = min(best[j] + pay(at[i] - at[j]) + int(cost[i - 1]) + packing.SEQUENCE_COST for j in range(i) if at[i] - at[j] <= 16)
        cuts = packing.best_cuts(places, cost, last=True)
        assert cuts[-1] == at[-1]
        price = sum(pay(b - a) + int(cost[at.index(b) - 1]) + packing.SEQUENCE_COST for a, b in zip([0, *cuts], cuts))
        assert price == best[14]


def test_chats(spark):
    turns = []
    talks = {1: ["a"], 2: ["a", "b"], 3: ["a", "b", "c"], 4: ["a", "b", "c"], 5: ["a", "x"], 6: [None], 7: [""], 8: ["b"]}
    for c, ts in talks.items():
        turns += [(c, k, "user", t, 1) for k, t in enumerate(ts)]
    df = spark.createDataFrame([*turns, (None, 0, "user", "lost", 1), (9, None, None, "t", 1), (9, None, None, "t", 1)], "conv_id long, turn long, role string, text string, h1 int")
    out = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    assert {i: (r.n_turns, r.n_collapsed) for i, r in out.items()} == {3: (3, 2), 5: (2, 1), 6: (1, 1), 7: (1, 1), 8: (1, 1), 9: (2, 1)}
    assert out[5].chat == "<|im_start|>user\na<|im_end|>\n<|im_start|>user\nx<|im_end|>\n"
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(11)
    plain = ["house", "tree", "river", "stone", "cloud", "green", "small", "walks", "under", "again"]
    text = lambda: " ".join(rng.choice(plain) for _ in range(30))
    rows = [(i, text() + (" you vile scum" if i % 6 == 0 else ""), "en", "s", 1) for i in range(240)]
    rows += [(500, rows[1][1], "en", "s", 1), (501, "12345 67", None, "s", 1), (502, None, None, None, None), (1, rows[1][1], "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, df, str(tmp_path))
        assert after.columns == df.columns
        path = f"{tmp_path}/out-{name}"
        after.write.parquet(path)
        df = spark.read.parquet(path)
        seen.append(sorted(r.doc_id for r in df.collect()))
    assert seen[0] == sorted([i for i in range(240) if i % 6] + [1, 500, 501, 502])
    assert seen[1] == [i for i in seen[0] if i not in (501, 502)]
    sets = {i: shingles(t, 5) for i, t, *_ in rows if i in set(seen[1])}
    want = closure(sets, [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    assert seen[2] == sorted(i for i in want if want[i] == i)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen[2])


def test_url_filter_of_an_empty_table_and_clashing_columns(spark):
    clash = "page_id long, url string, row int, host string, path string, rule string, verdict string"
    df = spark.createDataFrame([(1, "http://www.example.com/en/7x", 1, "h", "p", "r", "v"), (1, "http://www.example.com/en/7x", 1, "h", "p", "r", "v"), (2, None, 1, "h", "p", "r", "v")], clash)
    out = url_filter.judge(df, queries.URL_RULES)
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.select("page_id", "host", "path", "rule", "verdict").collect()) == [
        (1, "www.example.com", "/en/7x", "example.com/en/7", "allow"), (1, "www.example.com", "/en/7x", "example.com/en/7", "allow"), (2, "", "", None, "allow")
    ]
    assert url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_neighbours_of_equal_scores_and_repeated_ids(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(1, 40)] + [(20, [1.0, 0.0], 0), (100, [0.5, 0.5], 0)]
    out = ann_multi_index.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 100, k=5).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(out, key=lambda r: r.rank)] == [(k, k, 0.5) for k in range(1, 6)]


def test_long_unseen_words_and_a_pipeline_without_rows(spark, tmp_path):
    train = spark.createDataFrame([(i, "kala maja" if i % 2 else "strom prst", "xx" if i % 2 else "yy") for i in range(40)], "doc_id long, text string, lang string")
    out = langid.predict(docs(spark, [(1, "kalamaja" * 5_000), (2, "\u65e5" * 5_000)]), langid.fit(train)).collect()
    assert {r.doc_id: r.lang_pred for r in out}[1] == "xx" and all(0 <= r.score <= 1 for r in out)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
