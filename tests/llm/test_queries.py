"""The registered queries and the pipeline on the smallest tables."""

import collections

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest

from tessera.llm import classify, jaccard, packing, queries, rules, suffixes
from tessera.llm.common import written

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    cells = lambda names, rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for _, v in sorted(zip(names, r, strict=True))) for r in rows)
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got.columns, [tuple(r) for r in got.collect()]) == cells(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [q for q in queries.queries() if q not in queries.oracle_sql()])
def test_a_row_for_each_input_row(spark, name):
    table = "pages" if name.startswith("op6") else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    df = queries.queries()[name](spark, SF)
    rows = df.collect()
    assert len(rows) == n or name.startswith("op9") and len({r.doc_id for r in rows}) == n


def test_pipeline_stage_by_stage(spark):
    """Each stage against what its operator says of the stage's own input."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "ngram_jaccard", "suffix_dedup", "best_fit_packing"]
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)

    first = written(stages["quality_classifier"](spark, docs, SF))
    assert first.columns == COLUMNS and ids(first) == ids(classify.classify(docs, labels).where("predicted = 1"))
    second = written(stages["quality_rules"](spark, first, SF))
    assert second.columns == COLUMNS and ids(second) == ids(rules.host_rules(first).where("kept"))
    third = written(stages["ngram_jaccard"](spark, second, SF))
    assert third.columns == COLUMNS and ids(third) == ids(jaccard.jaccard_join(second).where("doc_id = component_id"))
    fourth = written(stages["suffix_dedup"](spark, third, SF))
    removed = {r.doc_id: r for r in suffixes.remove_repeats(third).collect()}
    before = {r.doc_id: r.text.encode() for r in third.collect()}
    assert fourth.columns == COLUMNS and ids(fourth) == ids(third)
    for r in fourth.collect():
        raw, at = b"", 0
        for s in removed[r.doc_id].spans:
            raw, at = raw + before[r.doc_id][at : s.start], s.end
        assert r.text == (raw + before[r.doc_id][at:]).decode("utf-8", "ignore")
    last = stages["best_fit_packing"](spark, fourth, SF).collect()
    want = packing.pieces(fourth, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in last) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in want)
    fill = collections.Counter()
    for r in last:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and np.sum([r.length for r in last]) == sum(fill.values())
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in last)
