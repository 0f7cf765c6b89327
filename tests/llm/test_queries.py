"""The queries of this subpackage: names, columns and SQL on the smallest tables; the pipeline against its parts."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from siftlake.llm import oracles, queries
from siftlake.llm.shared import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")

COLUMNS = {
    "op1": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op2": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op3": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op4": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op5": {"doc_id", "n_tokens", "round_trip"},
    "op6": {"pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask"},
    "op7": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op8": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op9": {"doc_id", "held_out", "lang_pred", "score"},
    "op10": {"doc_id", "n_shingles", "component_id"},
}


def test_all_ten_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == set(COLUMNS)
    assert set(oracles.ORACLES) <= set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert COLUMNS[name.split("_")[0]] <= set(df.columns)
    rows = df.collect()
    key = {"op8": "page_id", "op6": "pair_id"}.get(name.split("_")[0], "doc_id")
    source = {"op8": "pages", "op6": "conversations"}.get(name.split("_")[0], "documents")
    if source != "conversations":
        assert sorted(r[key] for r in rows) == sorted(r[0] for r in table(spark, DATA, source).select(key).collect())
    if name in oracles.ORACLES:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for t in ("documents", "benchmark", "pages", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
        found = con.execute(oracles.ORACLES[name])
        names = [d[0] for d in found.description]
        want = {tuple(r) for r in found.fetchall()}
        assert {tuple(r[n] for n in names) for r in rows} == want


def test_language_accuracy_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in table(spark, DATA, "documents").select("doc_id", "lang").collect()}
    held = [r for r in queries.QUERIES["op9_language"](spark, DATA).collect() if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, DATA, "documents")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, DATA)
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= before
        if k + 1 < len(corpus_pipeline.STAGES):
            assert after.columns == docs.columns
            docs, before = after, ids
        else:
            assert ids == before
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == before
