"""What the driver holds does not grow with the documents: joins of token files, sizes of the component search's tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from gaugemill.llm import token_files
from gaugemill.llm.common import fresh_path
from gaugemill.llm.components import components


def _broadcasts(node):
    """The rows that each broadcast of an executed plan gathered."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _broadcasts(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return _broadcasts(node.plan())
    own = [node.metrics().get("numOutputRows").get().value()] if name == "BroadcastExchangeExec" else []
    return own + [x for k in range(node.children().size()) for x in _broadcasts(node.children().apply(k))]


def test_starts_of_documents_gather_a_row_for_each_file(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.col("id").cast("string")).alias("text"))
    path = fresh_path(spark, "ids")
    files = token_files.write_tokens(docs, path)
    out = token_files.with_starts(token_files.read_tokens(files, path), files)
    assert len(out.collect()) == 4000
    gathered = _broadcasts(out._jdf.queryExecution().executedPlan())
    assert gathered and max(gathered) <= files.count()


def test_components_of_a_long_chain_keep_sizes_small(spark):
    ids = list(range(200))
    random.Random(5).shuffle(ids)
    out = components(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long"))
    assert [tuple(r) for r in out.groupBy("component").count().collect()] == [(0, 200)]
    size = out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert len(str(size)) < 9
