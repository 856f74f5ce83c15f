"""Each registered query of the subpackage: its contract's columns and rules, and its SQL where there is one."""

import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from bazaarlens.llm import queries

SF = "/root/testdata/sf0.001"


def remainder(doc_id, divisor):
    return zlib.crc32(str(doc_id).encode()) % divisor


@pytest.fixture(scope="module")
def results(spark):
    return {name: run(spark, SF).toPandas() for name, run in queries.QUERIES.items()}


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet'").df()


def test_all_rows_are_there(results, documents):
    for name in ("op1_simhash", "op2_language", "op3_quality", "op4_exact_dedup", "op5_substring_dedup", "op6_mixing", "op8_line_dedup", "op9_maxent_lm", "op12_secret_scan"):
        assert sorted(results[name].doc_id) == sorted(documents.doc_id), name
    assert set(results["op7_packing"].doc_id) == set(documents.doc_id)


@pytest.mark.parametrize(("name", "divisor", "held"), [("op2_language", 5, 0), ("op3_quality", 3, 1), ("op9_maxent_lm", 7, 2)])
def test_held_out(results, name, divisor, held):
    rows = results[name]
    assert (rows.held_out == [remainder(i, divisor) == held for i in rows.doc_id]).all()


def test_language_and_quality_tell_held_out_rows_apart(results, documents):
    known = results["op2_language"].merge(documents[["doc_id", "lang", "text"]], on="doc_id").query("held_out and lang.notna() and lang_pred != 'und'")
    assert len(known) and (known.lang == known.lang_pred).mean() > 0.9
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet' WHERE quality IS NOT NULL").df()
    rows = results["op3_quality"].merge(labels, on="doc_id").query("held_out")
    good, bad = rows[rows.quality == 1].score.to_numpy(), rows[rows.quality == 0].score.to_numpy()
    assert len(good) and len(bad) and (good[:, None] > bad[None, :]).mean() > 0.9
    assert (results["op3_quality"].predicted == (results["op3_quality"].score >= 0.5)).all()


def test_packing_fills_sequences(results, documents):
    rows = results["op7_packing"]
    assert (rows.length > 0).all()
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.concatenate([[0], np.cumsum(s.length.to_numpy())[:-1]])).all() and s.length.sum() <= 2048
    for _, d in rows.sort_values("start").groupby("doc_id"):
        assert (d.start.to_numpy() == np.concatenate([[0], np.cumsum(d.length.to_numpy())[:-1]])).all() and d.length.sum() == d.doc_tokens.iloc[0]
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 2048) + 1


def test_scores_of_the_language_model(results):
    rows = results["op9_maxent_lm"]
    held = rows[rows.held_out]
    assert (rows.score < 0).all() and held.score.sum() > held.base_score.sum() and rows.train_tokens.nunique() == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(results, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(results[name].columns) == columns
    # a column of integers with nulls is one of floats on either side
    word = lambda v: "null" if pd.isna(v) else str(int(v)) if isinstance(v, (float, np.integer, np.floating)) and v == int(v) else str(v)
    plain = lambda df: sorted(tuple(map(word, r)) for r in df[columns].itertuples(index=False, name=None))
    assert plain(results[name]) == plain(want)
