"""Declared schemas of the canonical tables and the checks that bind tables to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def struct(text: str) -> T.StructType:
    """A schema from "name type, .."; needs no session."""
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in (c.split() for c in text.split(", "))])


CLAIM_HEADER = struct("CMN_KEY string, INDI_DSCM_NO string, MDCARE_SYM string, MDCARE_STRT_DT string, MDCARE_STRT_YYYYMM string, SICK_SYM1 string, SICK_SYM2 string, SEX_TYPE string, SUJIN_POTM_AGE_ID string, YOYANG_CLSFC_CD string, TOT_PRSC_DD_CNT int, FORM_CD string, PAY_YN string")
DRUG_LINE = struct("CMN_KEY string, WK_COMPN_CD string, RVSN_WK_COMPN_CD string, MCARE_DIV_CD string, EFMDC_CLSF_NO string, TIME1_MDCT_CPCT double, DD1_MQTY_FREQ double, TOT_MCNT int, UPRC double, AMT double")
DIAGNOSIS_LINE = struct("CMN_KEY string, SICK_DESC_SEQ_NO string, MCEX_SICK_SYM string, SICK_CLSF_TYPE string")
OUTPATIENT_LINE = struct("CMN_KEY string, MPRSC_GRANT_NO string, GNL_NM_CD string, RVSN_WK_COMPN_CD string, MCARE_DIV_CD string, TOT_MCNT int")
INSTITUTION = struct("STD_YYYY string, MDCARE_SYM string, YOYANG_CLSFC_CD string, INST_NM string, ADDR_SGG_CD string")
ELIGIBILITY = struct("INDI_DSCM_NO string, BYEAR int, SEX_TYPE string, STD_YYYY string, RVSN_ADDR_CD string")
DAILY_RECORD = struct("patient_id string, institution_id string, bill_no string, wk_compn_cd string, edi_code string, gnl_nm_cd string, efmdc_clsf_no string, start_date string, end_date string, total_days int, dose_once double, dose_freq int, sick_code string, sex string, age_id string, institution_type string, source string")
INTERACTIONS = struct("drug_a_name string, drug_b_name string, drug_a_id string, drug_b_id string, severity string, description string, source string")
PREDICTION_LOG = struct("timestamp string, partition string, patient_id string, risk_level string, rule_level string, ml_level string, disagree boolean, latency_ms double, source string")


def bind(df: DataFrame, schema: T.StructType, renames: dict[str, str] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """`df` with the columns and types of `schema`: renamed, missing optional ones as typed nulls."""
    df = df.withColumnsRenamed(renames or {})
    if gone := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))
