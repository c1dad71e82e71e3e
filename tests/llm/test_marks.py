"""Rows are told apart where they are; only texts that are needed are shuffled."""

import pytest
from pyspark.sql import functions as F

from frameloom.llm import components
from frameloom.llm.common import prepare
from frameloom.llm.ngram_join import ngram_groups
from frameloom.llm.suffix_dedup import remove_repeated_bytes


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_rows_are_parted(spark, monkeypatch, most):
    monkeypatch.setattr(components, "MARKS", most)
    prepare(spark)
    rows = spark.range(0, 3000, 1, 7).select(F.monotonically_increasing_id().alias("rid"), F.col("id").alias("_Word"))
    rids = rows.filter("_Word % 5 = 1 or _Word between 600 and 900").select("rid").checkpoint()
    some, others = components.parted(rows, rids)
    wanted = {x for x in range(3000) if x % 5 == 1 or 600 <= x <= 900}
    assert sorted(r["_Word"] for r in some.collect()) == sorted(wanted)
    assert sorted(r["_Word"] for r in others.collect()) == sorted(set(range(3000)) - wanted)
    assert some.columns == others.columns == ["rid", "_Word"]
    assert components.parted(rows, rids.limit(0))[0].count() == 0
    assert components.parted(rows, rids.limit(0))[1].count() == 3000


def test_texts_without_repeats_are_not_shuffled(spark, tmp_path):
    own = [(k, " ".join(f"w{k}x{j}" for j in range(40))) for k in range(30)]
    spark.createDataFrame([*own, (30, own[3][1] + " more")], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = remove_repeated_bytes(docs)
    rows = out.collect()
    assert {r["doc_id"] for r in rows if r["n_removed"]} == {30} and len(rows) == 31
    # The texts of which nothing goes come by a branch without an exchange.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan
    found = ngram_groups(docs, 5, 80).collect()
    assert len(found) == 31 and sum(r["group"] != r["rid"] for r in found) == 1
