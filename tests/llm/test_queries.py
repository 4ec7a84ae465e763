"""Every registered query with SQL, on the smallest tables, against DuckDB."""

import math

import pytest

pytest.importorskip("tickweave.llm")
duckdb = pytest.importorskip("duckdb")
from tickweave.llm import oracles, queries, toxicity  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_its_sql(spark, name):
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    want = base.execute(oracles.ORACLES[name])
    names = [c[0] for c in want.description]
    wanted = sorted((tuple(_plain(v) for v in (r[names.index(c)] for c in sorted(names))) for r in want.fetchall()), key=repr)
    found = queries.QUERIES[name](spark, FOLDER)
    assert sorted(found.columns) == sorted(names)
    assert sorted((tuple(_plain(r[c]) for c in sorted(names)) for r in found.collect()), key=repr) == wanted


def test_classifier_queries_keep_their_contract(spark):
    docs = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    for name, columns, modulus, rest in (("op7_toxicity", ["doc_id", "held_out", "score", "predicted"], 3, 1), ("op9_language_id", ["doc_id", "held_out", "lang_pred", "score"], 4, 2)):
        out = queries.QUERIES[name](spark, FOLDER)
        assert out.columns == columns
        rows = out.collect()
        assert {r.doc_id for r in rows} == docs and all(0 <= r.score <= 1 for r in rows)
        import zlib

        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
        if name == "op7_toxicity":
            assert all(r.predicted == int(r.score >= toxicity.THRESHOLD) for r in rows)


def _texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


def test_sentencepiece_query_equals_the_library(spark):
    import sentencepiece

    out = queries.QUERIES["op3_sentencepiece"](spark, FOLDER)
    assert out.columns == ["doc_id", "ids", "n_pieces", "round_trip"]
    texts, rows = _texts(spark), out.collect()
    model = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(list(r.ids) == model.encode(texts[r.doc_id]) and r.n_pieces == len(r.ids) for r in rows)
    assert sum(r.round_trip for r in rows) > 0.9 * len(rows)


def test_neighbours_query_keeps_its_contract(spark):
    import numpy as np

    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    good = {r.vec_id: np.array(r.embedding, float) for r in rows if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)}
    ids = sorted(good)
    matrix = np.array([good[i] for i in ids])
    found: dict = {}
    out = queries.QUERIES["op4_approximate_neighbours"](spark, FOLDER)
    assert out.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    for r in out.collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    asked = [i for i in ids if i % 20 == 0]
    assert sorted(found) == asked
    hits = 0
    for i in asked:
        near = matrix @ good[i]
        want = sorted((j for j in ids if j != i), key=lambda j: (-near[ids.index(j)], j))[:20]
        own = found[i]
        assert sorted(own) == list(range(1, len(want) + 1)) and all(abs(s - good[j] @ good[i]) < 1e-9 for j, s in own.values())
        assert [own[k] for k in sorted(own)] == sorted(own.values(), key=lambda p: (-p[1], p[0]))
        hits += len({j for j, _ in own.values()} & set(want))
    assert hits >= 0.9 * sum(len(found[i]) for i in asked)


def _packed(rows, texts):
    """Every id of every document in one piece, in sequences without gaps."""
    import struct
    import zlib

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.word_tokenizer())
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            part = ids[i][r.start : r.start + r.length]
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i]) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids[i])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    used = sum(map(len, ids.values()))
    return used, sum(1 if (n := sum(r.length for r in own)) & (n - 1) == 0 else 2048 / n for own in sequences.values()) / len(sequences)


def test_packing_query_keeps_its_contract(spark):
    out = queries.QUERIES["op10_packing"](spark, FOLDER)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    used, padding = _packed(out.collect(), _texts(spark))
    assert used and padding < 1.1


def test_registered_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import __spark_entry__

    rows = __spark_entry__.queries()["pipeline"](spark, FOLDER).collect()
    texts = _texts(spark)
    kept = {r.doc_id for r in rows}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "minhash_near_dedup", "packing"]
    assert 0.5 * len(texts) < len(kept) < len(texts)
    _packed(rows, {i: texts[i] for i in kept})
