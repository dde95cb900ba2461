import io as text_io

import pandas as pd
import pytest

from sparkdq.sources import io

COLUMNS = {
    "ints": ["1", "-2", "+3"], "ints_gap": ["1", "", "3"], "big": ["9223372036854775807", "-9223372036854775808", "0"], "unsigned": ["9223372036854775808", "1", "0"],
    "huge": ["18446744073709551616", "1", "2"], "mixed_sign": ["9223372036854775808", "-1", "2"], "floats": ["1.5", "2", "1e3"], "dots": ["1.", ".5", "-.5e-2"],
    "inf": ["inf", "-Infinity", "1"], "bools": ["True", "false", "TRUE"], "bools_gap": ["True", "NA", "False"], "bool_int": ["True", "1", "0"],
    "empty": ["", "NaN", "null"], "text": ["a", "1", "2"], "dates": ["2024-01-01", "2024-01-02", ""], "spaced": [" 1", "2 ", "3"], "spaced_na": [" NA", "1", "2"],
    "suffix": ["1d", "2f", "3"], "under": ["1_000", "2", "3"], "hex": ["0x10", "1", "2"], "zeros": ["007", "08", "9"], "quoted": ['say "hi"', "a,b", "c\nd"], "plus": ["+1.5", "-2", ""],
}


def written(tmp_path, columns):
    frame = pd.DataFrame(columns)
    frame.to_csv(f"{tmp_path}/x.csv", index=False, quoting=1)
    return f"{tmp_path}/x.csv"


def test_types_and_values_equal_pandas(spark, tmp_path):
    path = written(tmp_path, COLUMNS)
    want = pd.read_csv(path)
    raw = spark.read.options(**io.CSV_CELLS).option("header", True).csv(path)
    got = {r["column"]: r for r in io.column_types(raw).collect()}
    assert {c: got[c]["dtype"] for c in COLUMNS} == {c: str(want[c].dtype) for c in COLUMNS}
    assert [r["position"] for r in sorted(got.values(), key=lambda r: r["position"])] == list(range(len(COLUMNS)))
    rows = io.read_csv_inferred(spark, path).collect()
    assert len(rows) == len(want)
    for c in COLUMNS:
        assert got[c]["missing"] == int(want[c].isna().sum())
        for mine, theirs in zip([r[c] for r in rows], want[c].tolist(), strict=True):
            assert (mine is None) if pd.isna(theirs) else (mine == theirs), (c, mine, theirs)


@pytest.mark.parametrize("text", ["a,b\n", "a\n1\n"])
def test_empty_and_single_column_tables(spark, tmp_path, text):
    (tmp_path / "x.csv").write_text(text)
    want = pd.read_csv(text_io.StringIO(text))
    raw = spark.read.options(**io.CSV_CELLS).option("header", True).csv(f"{tmp_path}/x.csv")
    assert {r["column"]: r["dtype"] for r in io.column_types(raw).collect()} == {c: str(t) for c, t in want.dtypes.items()}
    assert io.read_csv_inferred(spark, f"{tmp_path}/x.csv").count() == len(want)


def test_one_scan_for_all_columns(spark, tmp_path):
    raw = spark.read.options(**io.CSV_CELLS).option("header", True).csv(written(tmp_path, COLUMNS))
    plan = io.column_types(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation[") == 1 and plan.count("Aggregate [") == 1
