import re

import corpus_pipeline

from glyphlake.llm import registry

from .conftest import prose


def test_stages_take_effect(spark, tmp_path, documents):
    passage = prose("passage", 60)
    rows = [(k, prose(("d", k), 80)) for k in range(40)]
    rows += [(k, prose(("d", k), 60) + (" scum you idiot " if k % 2 else " idiot you scum ") + prose(("e", k), 10)) for k in range(100, 160)]
    rows += [(200, rows[0][1]), (201, rows[1][1].replace(" ", "  ")), (202, rows[2][1] + " zebra")]
    rows += [(k, prose(("p", k), 40) + " " + passage + " " + prose(("q", k), 40)) for k in range(300, 305)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, int(k >= 100)) for k, _ in rows if k < 160]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    clean = set(range(40)) | {200, 201, 202} | set(range(300, 305))
    assert set(seen["toxicity"]) == clean
    assert set(seen["exact_dedup"]) == clean - {200, 201}
    assert set(seen["near_dedup"]) == clean - {200, 201, 202}
    for k in range(300, 305):
        r = seen["suffix_dedup"][k]
        assert passage[10:-10] not in r.text and r.n_chars == len(r.text)
        assert re.sub(r"\s+", " ", r.text).startswith(prose(("p", k), 39))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen["near_dedup"])


def test_registry_names_every_operator():
    assert sorted({int(n[2:].split("_")[0]) for n in registry.queries()}) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())
