"""The pipeline against what its stages say one by one."""

from __future__ import annotations

import hashlib
import re

import numpy as np


def test_stages(spark, sf_dir):
    import corpus_pipeline
    from gaugemill.llm.common import settle_table, table

    docs = table(spark, sf_dir, "documents")
    columns, states = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = settle_table(stage(spark, docs, sf_dir), f"test-{name}")
        states.append(docs)
    assert all(s.columns == columns for s in states[:-1])
    rows = [[r.asDict() for r in s.collect()] for s in states]
    scored = {r["doc_id"] for r in rows[1]}
    bad = {r.doc_id for r in table(spark, sf_dir, "labels").where("quality = 0").collect()}
    assert len(bad & scored) <= 0.2 * len(bad)
    digest = lambda r: hashlib.sha256(re.sub(r"[ \t-\r]+", " ", r["text"] or "").encode()).hexdigest()
    first: dict = {}
    for r in sorted(rows[1], key=lambda r: r["doc_id"]):
        first.setdefault(digest(r), r["doc_id"])
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(first.values())
    from test_llm import brute_components, shingle_sets

    comp = brute_components(shingle_sets([(r["doc_id"], (r["text"] or "").encode()) for r in rows[2]]))
    assert sorted(r["doc_id"] for r in rows[3]) == sorted(int(i) for i, _, c in comp if i == c)
    size = lambda rs: sum(len((r["text"] or "").encode().split()) for r in rs)
    assert {r["doc_id"] for r in rows[4]} <= {r["doc_id"] for r in rows[3]} and abs(size(rows[4]) / size(rows[3]) - 1) < 0.1
    used: dict = {}
    for p in rows[5]:
        used.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in used.values():
        own.sort()
        assert [o for o, _ in own] == np.concatenate(([0], np.cumsum([n for _, n in own])[:-1])).tolist()
    assert len(rows[4]) == sum(p["start"] == 0 for p in rows[5])
