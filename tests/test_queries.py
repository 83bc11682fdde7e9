"""Every registered query of the library against its SQL on DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from ringsight.plans import catalog

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
            return "null"
        if isinstance(v, float):
            return f"{v:.6g}" if v != int(v) else str(int(v))
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


def count(duck, where="true"):
    return duck.sql(f"SELECT count(*) FROM events WHERE {where}").fetchall()[0][0]


def areas(rows, duck):
    assert len(rows) == 1 and 0 < rows[0]["pr_auc"] <= 1 and 0.5 < rows[0]["roc_auc"] <= 1  # amounts tell frauds from others in these rows


def scores(rows, duck):
    assert len(rows) == len({r["txn_id"] for r in rows}) == count(duck) and all(0 <= r["score"] <= 1 for r in rows) and len({r["score"] for r in rows}) > 10


def ranked(rows, duck):
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)
    assert rows[0]["feature"] == "amount" and sum(r["importance"] for r in rows) == pytest.approx(1)


def falling(rows, duck):
    rows = sorted(rows, key=lambda r: r["round"])
    assert [r["round"] for r in rows] == list(range(1, rows[0]["of"] + 1)) and rows[-1]["val_loss"] == min(r["val_loss"] for r in rows)


def same(rows, duck):
    assert rows == [{"n": count(duck), "gap": 0.0}]


def two_arms(rows, duck):
    assert sorted(r["arm"] for r in rows) == ["base", "entity"] and all(0 < r["pr_auc"] <= 1 and 0 <= r["roc_auc"] <= 1 for r in rows)


def arms(rows, duck):
    by = {r["arm"]: r for r in rows}
    assert len(by) == 11 and all(0 <= r["val"] <= 1 for r in rows) and by["plain"]["rejected"] == 0
    for attack in ("sign_flip", "flip"):  # robust above plain under attack, but for ties
        assert by[f"{attack}_defended"]["val"] >= by[f"{attack}_undefended"]["val"] - 0.01
    assert by["sign_flip_defended"]["val"] > by["sign_flip_undefended"]["val"] and by["sign_flip_defended"]["rejected"] >= 3 <= by["last_mover_defended"]["rejected"]


def one_best(rows, duck):
    assert sum(r["best"] for r in rows) == 1 and max(rows, key=lambda r: r["pr_auc"])["pr_auc"] == next(r["pr_auc"] for r in rows if r["best"])


#: What holds for the queries without SQL; tests/test_models.py compares their parts with plain versions.
PLAIN = {"train_scorer": areas, "score_batch": scores, "top_features": ranked, "scorer_rounds": falling, "model_save_load": same, "feature_lift": two_arms, "central_fit": one_best, "fed_rounds": one_best, "fed_arms": arms}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLES:
        return PLAIN[name]([r.asDict() for r in got.collect()], duck)
    want = duck.sql(catalog.ORACLES[name])
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: KINDS[t] for c, t in got.dtypes} == {c: k if k in KINDS.values() else KINDS[dict(got.dtypes)[c]] for c, k in kinds.items()}
    assert canonical(got.toPandas()) == canonical(want.df())
