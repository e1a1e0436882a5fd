import corpus_pipeline as C
from peakframe.llm import jaccard_join, packing, quality, secret_scan, toxicity
from peakframe.llm.queries import ORACLES, QUERIES

from ..conftest import SMALL
from .test_jaccard_join import brute


def test_run_equals_the_stages_one_by_one(spark):
    docs, marks = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.fit(docs, marks)
    known = {}
    rows = [r for r in docs.collect() if model.probability(model.token_scores(r.text or "", known)) < 0.5]
    rows_df = spark.createDataFrame(rows, docs.schema)
    forest, least = quality.fit(rows_df, marks)
    kept = []
    for r in rows:
        counts, stats = quality.measure(r.text or "")
        if not quality.base_fails(counts[0], counts[4]) and forest.score(__import__("numpy").array([stats]))[0] < least:
            kept.append(r)
    classes = brute([(r.doc_id, r.text) for r in kept])
    single = [r for r, (d, c, _) in zip(kept, classes, strict=True) if d == c]
    masked = secret_scan.redact(spark.createDataFrame(single, docs.schema))
    want = packing.pack(masked, C.vocabulary("byte_bpe_50k.json"))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = C.run(spark, SMALL)
    assert 0 < len({r.doc_id for r in got.collect()}) < docs.count()
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "quality_rules", "jaccard_join", "secret_scans", "packing"]
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
    assert jaccard_join.keep_one(docs).count() < docs.count()


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
