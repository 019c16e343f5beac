import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from conftest import SF0001
from llm_fixture import duck, edge_docs
from pdcspark.llm import bpe, pii, quality_knn
from pdcspark.llm.oracles import mixed
from pdcspark.llm.queries import PII_KEY
from test_simhash import brute_fingerprint, brute_groups


def test_stages_are_declared():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pseudonyms", "mix", "encode"]


def test_run_against_brute_force(spark):
    documents = spark.read.parquet(f"{SF0001}/documents.parquet")
    rows = documents.collect()
    model = quality_knn.train(documents, spark.read.parquet(f"{SF0001}/labels.parquet"))
    terms = quality_knn.Terms()
    scores = model.scores([terms.row(r.text) for r in rows])
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= quality_knn.THRESHOLD]
    groups = brute_groups([(r.doc_id, brute_fingerprint(r.text)) for r in rows])
    rows = [r for r, g in zip(rows, groups, strict=True) if r.doc_id == g]
    worker = pii.Pseudonyms(PII_KEY)
    texts = {r.doc_id: worker.text(r.text)[0] for r in rows}
    con = duck(SF0001)
    con.execute("CREATE TABLE kept (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO kept VALUES (?, ?, ?)", [(r.doc_id, texts[r.doc_id], r.source) for r in rows])
    times = con.execute(f"WITH {mixed('kept')} SELECT doc_id, times FROM mixed").fetchall()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    want = []
    for i, n in times:
        ids = library.encode_ordinary(texts[i] or "")
        want += [(i, ids, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((texts[i] or "").encode()).hexdigest())] * n
    got = corpus_pipeline.run(spark, SF0001)
    assert got.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert want


def test_stages_keep_columns_and_take_edges(spark):
    docs = edge_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF0001)
        assert out.count() > 0
        if name != "encode":
            assert out.columns == docs.columns
            docs = out.cache()
    docs = edge_docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF0001).count() == 0
