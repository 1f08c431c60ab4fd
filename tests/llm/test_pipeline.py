import cases
import corpus_pipeline as pipeline
import test_jaccard
import test_linededup
import test_packing
import test_quality
import test_winnow
from lexstrata.llm import quality


def test_against_brute_force(spark, sf, tmp_path):
    """Each stage, on what the stage before it kept, against its own brute force."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, sf)
        out.write.parquet(path := str(tmp_path / str(k)))
        after = spark.read.parquet(path)
        if k < 4:
            assert after.columns == docs.columns
            got = sorted((tuple(r) for r in after.select("doc_id", "text").collect()), key=str)
        if name == "quality rules":
            kept = {r.doc_id for r in quality.judged(docs).where("kept").select("r.doc_id").collect()}
            want = [d for d in before if d[0] in kept]
            assert kept <= {i for i, t in before if not test_quality.naive(t)[5]}
        elif name == "line dedup":
            want = test_linededup.naive(before)
        elif name == "n-gram Jaccard join":
            keep = {d for d, _, c in test_jaccard.naive(before, percent=80, shingle=5) if d == c}
            want = [d for d in before if d[0] in keep]
        elif name == "benchmark decontamination":
            bad = {r[0] for r in test_winnow.naive(before, bench) if r[5]}
            want = [d for d in before if d[0] not in bad]
            assert bad
        else:
            test_packing.check(before, after.collect())
            break
        assert got == sorted(want, key=str)
        docs = after


def test_edge_cases(spark, sf):
    for rows in (cases.table(spark), cases.table(spark).limit(0)):
        docs = rows
        for _, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == rows.columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        pipeline.STAGES[-1][1](spark, docs, sf).collect()
