import json

import pytest
from pyspark.sql import functions as F

from rxlattice import schema
from rxlattice.sources import files


def test_optional_and_bound(spark, tmp_path):
    empty = files.read_optional(spark, f"{tmp_path}/none", schema.ELIGIBILITY)
    assert empty.count() == 0 and empty.columns == schema.ELIGIBILITY.names
    df = spark.createDataFrame([("1", "1950")], "ID string, BYEAR string")
    row = schema.bind(df, schema.ELIGIBILITY, {"ID": "INDI_DSCM_NO"}, ("INDI_DSCM_NO",)).first()
    assert (row.INDI_DSCM_NO, row.BYEAR, row.SEX_TYPE) == ("1", 1950, None)
    with pytest.raises(ValueError):
        schema.bind(df, schema.ELIGIBILITY, required=("STD_YYYY",))


def test_dated_files(spark, tmp_path):
    import shutil

    for name in ("records_20240101.parquet", "records_20240105.parquet", "records_x.parquet"):
        spark.createDataFrame([("p",)], "patient_id string").coalesce(1).write.parquet(f"{tmp_path}/one")
        (part,) = (tmp_path / "one").glob("part-*")
        (tmp_path / "in").mkdir(exist_ok=True)
        shutil.copy(part, tmp_path / "in" / name)
        shutil.rmtree(tmp_path / "one")
    got = files.read_dated(spark, f"{tmp_path}/in", schema.struct("patient_id string"), "2024-01-02", "2024-01-31")
    assert [str(r.dt) for r in got.collect()] == ["2024-01-05"]


def test_missing_days(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-03",)], "d string")
    assert [str(r.day) for r in files.missing_days(df, "d", "2024-01-01", "2024-01-04").orderBy("day").collect()] == ["2024-01-02", "2024-01-04"]


def test_feature_store(spark, tmp_path):
    df = spark.range(3)
    files.write_features(df, f"{tmp_path}/fs", "202401")
    with pytest.raises(Exception, match="exist"):
        files.write_features(df, f"{tmp_path}/fs", "202401")
    files.write_features(df.limit(2), f"{tmp_path}/fs", "202401", overwrite=True)
    assert files.read_features(spark, f"{tmp_path}/fs", "202401").count() == 2
    assert not files.write_if_any(df.limit(0), f"{tmp_path}/none")


def test_log_skips_bad_lines(spark, tmp_path):
    lines = [json.dumps({"timestamp": "2024-01-02 00:30:00", "patient_id": "a"}), "{oops", json.dumps({"timestamp": "2024-01-01T00:00:00+00:00", "patient_id": "b"})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    assert files.read_log(spark, f"{tmp_path}/log.jsonl", schema.PREDICTION_LOG).count() == 2
    got = files.read_log(spark, f"{tmp_path}/log.jsonl", schema.PREDICTION_LOG, hours=2, now="2024-01-02 01:00:00")
    assert [r.patient_id for r in got.collect()] == ["a"]


def test_landed_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"body": {"items": [{"item": {"X": "1"}}, {"item": {"X": "2"}}]}}))
    (tmp_path / "b.json").write_text(json.dumps({"body": {"items": [{"X": "3"}]}}))
    got = files.standard_fields(files.read_landed_json(spark, str(tmp_path)), {"X": "code"})
    assert sorted(r.code for r in got.collect()) == ["1", "2", "3"]


XML = """<drugs>
<drug><drugbank-id primary="true">D1</drugbank-id><drugbank-id>OLD1</drugbank-id><name> Alpha </name><groups><group>approved</group><group> withdrawn</group></groups>
 <atc-codes><atc-code code="B01AA03"/><atc-code code=" "/><atc-code code="C01"/></atc-codes>
 <drug-interactions><drug-interaction><drugbank-id>D2</drugbank-id><name>b</name><description>fatal</description></drug-interaction><drug-interaction><drugbank-id></drugbank-id><name>x</name></drug-interaction></drug-interactions>
 <enzymes><enzyme><name>Cytochrome P450 3A4</name><actions><action>substrate</action></actions></enzyme>
  <enzyme><name>CYP2C9 (liver)</name><known-action>yes</known-action><actions><action>substrate</action><action>inhibitor</action></actions></enzyme><enzyme><name>CYP1A2</name><actions/></enzyme></enzymes>
 <transporters><transporter><name>P-glycoprotein 1</name><known-action>no</known-action><actions><action>inhibitor</action></actions></transporter></transporters>
 <carriers><carrier><name>Albumin</name><actions><action>binder</action></actions></carrier></carriers></drug>
<drug><drugbank-id>D2</drugbank-id><name>b</name></drug><drug><name>no id</name></drug></drugs>"""


@pytest.mark.parametrize("save", [False, True])
def test_drug_xml(spark, tmp_path, save):
    (tmp_path / "d.xml").write_text(XML)
    drugs, pairs, enzymes = files.read_drug_xml(spark, f"{tmp_path}/d.xml", save=f"{tmp_path}/rows" if save else None)
    assert {(r.drug_id, r["name"], r.groups, r.atc_codes) for r in drugs.collect()} == {("D1", "Alpha", "approved|withdrawn", "B01AA03|C01"), ("D2", "b", None, None)}
    assert [(r.a_id, r.b_id, r.description) for r in pairs.collect()] == [("D1", "D2", "fatal")]
    got = {(r.drug_id, r.enzyme, r.action, r.known_action, r.section) for r in enzymes.collect()}
    assert got == {("D1", "CYP2C9 (liver)", "substrate", "yes", "enzymes"), ("D1", "CYP2C9 (liver)", "inhibitor", "yes", "enzymes"), ("D1", "P-glycoprotein 1", "inhibitor", "no", "transporters")}
    keys = spark.createDataFrame([("CYP2C9 (liver)",), ("Cytochrome P450 3A4",), ("Albumin",)], "n string").select(files.enzyme_key(F.col("n")).alias("k"))
    assert [r.k for r in keys.collect()] == ["cyp2c9", "cyp3a4", None]


def test_review_csv_and_kinds(spark, tmp_path):
    files.write_review_csv(spark.createDataFrame([("a", "secret")], "id string, name string"), f"{tmp_path}/csv", ["id"], ["expert"])
    row = spark.read.csv(f"{tmp_path}/csv", header=True).first()
    assert row.asDict() == {"id": "a", "expert": None}
    kinds = spark.createDataFrame([("x_T30_1",), ("yoyang",), ("zz",)], "n string").select(files.table_kind(F.col("n")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["line", "institution", "unknown"]


def test_range_gate():
    files.check_range("2024-01-01", "2024-02-01", "2023-01-01", "2024-12-31", "research", ("research",))
    with pytest.raises(PermissionError):
        files.check_range("2022-01-01", "2024-02-01", "2023-01-01", "2024-12-31", "research", ("research",))
    with pytest.raises(PermissionError):
        files.check_range("2024-01-01", "2024-02-01", "2023-01-01", "2024-12-31", "sale", ("research",))
