import hashlib
import re

import pytest
from pyspark.sql import functions as F

from glyphlake.llm import exact_dedup, store
from glyphlake.llm.exact_dedup import DigestIndex, deduplicate, keep_first


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_equal_texts_after_collapsing_space(spark, documents):
    rows = [(k, t) for k, t in enumerate(["a b", "a  b", "a\tb", " a b", "A b", "", None, "a b"])]
    got = {r.doc_id: r for r in deduplicate(documents(rows)).collect()}
    for k, t in rows:
        same = [i for i, o in rows if plain(o) == plain(t)]
        assert (got[k].keep_id, got[k].group_size, got[k].kept) == (min(same), len(same), k == min(same))
        assert bytes(got[k].digest).hex() == hashlib.sha256(plain(t).encode()).hexdigest()


def test_awkward_rows_and_empty_table(awkward, nothing):
    out = deduplicate(awkward).collect()
    assert len(out) == awkward.count()
    assert {r.keep_id for r in out if r.doc_id is None} == {1, 4}
    assert sum(r.kept for r in out if r.doc_id == 4) == 2  # repeated rows are told apart only when rows are kept
    assert deduplicate(nothing).count() == 0 and keep_first(nothing).count() == 0


def test_keep_first_keeps_one_row_each(awkward):
    kept = keep_first(awkward)
    assert kept.columns == awkward.columns
    texts = [plain(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({plain(r.text) for r in awkward.collect()})


def test_equal_rows_without_an_id_keep_one(documents):
    rows = [(None, "same"), (None, "same"), (None, "same"), (1, "other"), (None, "other")]
    assert sorted(r.text for r in keep_first(documents(rows)).collect()) == ["other", "same"]


def test_index_persists_and_grows(spark, documents):
    first = DigestIndex(spark)
    deduplicate(documents([(5, "x"), (6, "y")]), first)
    first.close()
    again = DigestIndex(spark, first.location)  # another session's view of the same folder
    spark.sql(f"REFRESH TABLE {again.name}")
    got = {r.doc_id: (r.keep_id, r.kept) for r in deduplicate(documents([(1, "x"), (2, "z"), (3, "z")]), again).collect()}
    assert got == {1: (5, False), 2: (2, True), 3: (2, False)}
    assert again.rows().count() == 3


@pytest.mark.parametrize("partitions", [4, 8, 16])
def test_index_reopens_with_the_buckets_it_was_written_with(spark, documents, monkeypatch, partitions):
    rows = documents([(k, f"text {k}") for k in range(2000)])
    with DigestIndex(spark, buckets=8) as first:
        deduplicate(rows, first)
    monkeypatch.setattr(store, "parallelism", lambda spark: partitions)
    with DigestIndex(spark, first.location) as again:
        assert again.buckets == 8
        groups = rows.select(exact_dedup.digest().alias("digest"), F.col("doc_id").alias("keep_id"))
        assert again.fresh(groups).count() == 0
        assert not any(r.kept for r in deduplicate(documents([(k + 5000, f"text {k}") for k in range(2000)]), again).collect())
        assert again.rows().count() == 2000
    with pytest.raises(ValueError):
        DigestIndex(spark, first.location, buckets=16)


def test_index_without_layout_is_refused(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/digests")
    with pytest.raises(ValueError):
        DigestIndex(spark, str(tmp_path))


def test_closed_index_leaves_the_catalogue(spark, documents):
    before = len(spark.catalog.listTables())
    deduplicate(documents([(1, "x")])).collect()
    assert len(spark.catalog.listTables()) == before


def test_index_side_is_not_shuffled_but_sorted(spark, documents):
    index = DigestIndex(spark, buckets=4)
    deduplicate(documents([(1, "x")]), index)
    groups = documents([(2, "q")]).select(exact_dedup.digest().alias("digest"), F.col("doc_id").alias("keep_id"))
    plan = index.fresh(groups)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    right = plan[plan.rindex("Sort [") :]  # the index side comes last
    assert "Exchange" not in right and "Bucketed: true" in right


def test_compacted_index_holds_the_same(spark, documents):
    index = DigestIndex(spark, buckets=4)
    for k in range(3):
        deduplicate(documents([(i, f"t{i}") for i in range(k, k + 40)]), index)
    small = index.compact()
    assert sorted(map(tuple, small.rows().collect())) == sorted(map(tuple, index.rows().collect())) and small.rows().count() == 42
    assert len(small.rows().inputFiles()) <= 4 < len(index.rows().inputFiles())


def test_columns_with_clashing_names(documents):
    rows = documents([(1, "a b"), (2, "a  b"), (3, "c")])
    clash = rows.withColumns({n: F.lit(n) for n in ("digest", "keep_id", "copies", "kept", "n", "none")})
    assert {r.doc_id: r.keep_id for r in deduplicate(clash).collect()} == {1: 1, 2: 1, 3: 3}
    out = keep_first(clash)
    assert out.columns == clash.columns and sorted(r.doc_id for r in out.collect()) == [1, 3] and {r.kept for r in out.collect()} == {"kept"}


def test_hot_groups_are_attached_without_loss(spark, documents, monkeypatch):
    monkeypatch.setattr(store, "HOT_SHARE", 0.4)
    rows = [(k, "same" if k % 2 else str(k)) for k in range(600)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in deduplicate(documents(rows)).collect()}
    assert got == {k: ((1, 300) if k % 2 else (k, 1)) for k in range(600)}
