"""Table contract checks K1-K5."""

import datetime as dt

from kinsum.operators import contracts as K

C = K.TableContract(
    "t",
    (
        K.ColumnSpec("id", "int unsigned", required=True),
        K.ColumnSpec("code", "varchar(3)", required=True, default="n/a"),
        K.ColumnSpec("amount", "decimal(5,2)"),
        K.ColumnSpec("flag", "boolean"),
        K.ColumnSpec("created", "datetime", default="CURRENT_TIMESTAMP"),
    ),
    primary_key=("id",),
)


def _df(spark):
    return spark.createDataFrame(
        [("1", "abc", "12.50", None, None), ("2", "toolong", "1000.00", True, None),
         ("x", None, "3", False, None), (None, "ab", None, None, None), ("2", "q", "1", None, None)],
        "id string, code string, amount string, flag boolean, created timestamp_ntz",
    )


def test_conform(spark):
    _, fails = K.conform(_df(spark), C)
    got = {r["column_name"]: r["violations"] for r in fails.collect()}
    assert got == {"id": 1, "code": 1, "amount": 1, "flag": 0, "created": 0}


def test_not_null(spark):
    got = {r["column_name"]: r["violations"] for r in K.not_null_violations(_df(spark), C).collect()}
    assert got == {"id": 1, "code": 1}


def test_defaults(spark):
    now = dt.datetime(2025, 1, 1, 12)
    rows = K.apply_defaults(_df(spark), C, now).collect()
    assert rows[2]["code"] == "n/a" and rows[0]["flag"] is False and rows[0]["created"] == now


def test_unique_ignores_null_keys(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2), (1, 2), (3, 4)], "a int, b int")
    assert [tuple(r) for r in K.unique_violations(df, ["a", "b"]).collect()] == [(1, 2, 2)]


def test_fk(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,), (9,)], "p int")
    parent = spark.createDataFrame([(1,), (9,)], "id int")
    assert [tuple(r) for r in K.fk_violations(child, "p", parent, "id").collect()] == [(2, 2)]


def test_checks_in_the_pass_that_writes(spark, tmp_path):
    contract = K.TableContract(
        "t",
        (K.ColumnSpec("id", "int", required=True), K.ColumnSpec("code", "char(2)", required=True, default="zz"), K.ColumnSpec("n", "decimal(3,1)"),
         K.ColumnSpec("on", "boolean"), K.ColumnSpec("p", "bigint")),
        primary_key=("id",), unique=(("code", "n"),), foreign_keys=(("p", "parent", "k"), ("p", "absent", "k")),
    )
    rows = [("1", "ab", "1.0", None, 7), ("2", None, "2.0", True, None), ("2", "cd", "99999", None, 8), (None, "toolong", None, None, 7), ("x", "ab", "1.0", False, 9), ("5", "ef", None, None, 9)]
    df = spark.createDataFrame(rows, "id string, code string, n string, on boolean, p long")
    report = K.write_checked(df, contract, str(tmp_path / "t"), {"parent": spark.createDataFrame([(7,), (9,), (None,)], "k long")})
    bad = {(r["id"], r["code"], r["p"]): r["_errors"] for r in K.quarantined_rows(spark, str(tmp_path / "t")).collect()}
    assert bad == {
        (1, "ab", 7): ["unique:code,n"],
        (2, "zz", None): ["unique:id"],
        (2, "cd", 8): ["type:n", "unique:id", "foreign:p"],
        (None, None, 7): ["type:code", "null:id"],
        (None, "ab", 9): ["type:id", "unique:code,n"],
    }
    assert [tuple(r) for r in K.sound_rows(spark, str(tmp_path / "t")).collect()] == [(5, "ef", None, False, 9)]
    assert (report.rows, report.quarantined) == (6, 5)
    assert report.violations == {"type:id": 1, "type:code": 1, "type:n": 1, "type:on": 0, "type:p": 0, "null:id": 1, "null:code": 0, "unique:id": 2, "unique:code,n": 2, "foreign:p": 1}
    raw = [r["_row"] for r in K.quarantined_rows(spark, str(tmp_path / "t")).collect() if r["p"] == 8]
    assert raw == ['{"id":"2","code":"cd","n":"99999","p":8}']
