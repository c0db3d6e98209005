"""The pipeline: every stage against what it should do with its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from pulseframe.llm import pieces, simhash, toxicity
from pulseframe.llm.common import materialise, table

from ..conftest import DATA


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, seen[-1], DATA), "stage")
        seen.append(docs)
        assert docs.columns == columns or name == "encoding"
        assert 0 < docs.count() <= seen[-2].count()
    machine = toxicity.train(seen[0], table(spark, DATA, "labels"))
    ids = [{r["doc_id"]: r for r in s.collect()} for s in seen]
    rejected = {d for d, r in ids[0].items() if machine.score(r["text"].encode()) >= toxicity.THRESHOLD}
    assert set(ids[0]) - set(ids[1]) == rejected
    bare = lambda t: "".join(t.split(" ")).translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r")))
    assert len({bare(r["text"]) for r in ids[1].values()}) == len(ids[2])
    found = simhash.near_duplicates(seen[2]).collect()
    assert set(ids[3]) == {r["component_id"] for r in found}
    v = pieces.Vocabulary.load(pieces.MODEL)
    assert set(ids[5]) == set(ids[4]) and all(pieces.decode(r["ids"], v.raw) == ids[4][d]["text"] for d, r in ids[5].items())


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


AWKWARD = [(1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", "en", "s"), (None, "no id", "en", "s"), (4, "long words and more of them " * 30_000, "en", "s"), (5, "same text here", "en", "s"), (5, "same text here", "en", "s"), (6, "same  text here", "de", "t"), (7, "é漢字😀 ▁ \\u0041", "fr", None)]


def written(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for name in ("row_key", "row_rank", "fp", "domain", "score", "n_ids", "a.b"):
        docs = docs.withColumn(name, F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(2, 8)] + [(4, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return table(spark, tmp_path, "documents")


def test_awkward_rows_in_every_stage(spark, tmp_path):
    docs = written(spark, tmp_path, AWKWARD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        if name == "encoding":
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((d is None, d or 0) for d, *_ in AWKWARD)
        else:
            assert out.columns == docs.columns and all(r["domain"] == r["row_key"] == r["a.b"] == 1 for r in rows)
            kept = {"toxicity": 9, "exact dedup": 5, "near dedup": 5}.get(name)
            assert kept is None or len(rows) == kept, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_empty_tables_in_every_stage(spark, tmp_path):
    docs = written(spark, tmp_path, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
