"""Clinical constants of the forecasting study.

Everything in this module is a fixed value: the pipeline must use these exact
values to give the same results as the original study. They are stated here as
plain data, in their natural order.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the original study's values)
# ---------------------------------------------------------------------------

# Item id of the anchor measurement (serum creatinine).
ANCHOR_ITEM = 220615

# ICD-9 codes whose presence excludes a stay: ESRD, kidney transplant.
EXCLUDED_CODES = ["5856", "V420", "99681"]

# Inclusion thresholds.
MIN_AGE_YEARS = 15.0
MIN_STAY_HOURS = 48.0

# Hours of day kept for anchors (inclusive), and the label band.
ANCHOR_HOURS = (0, 5)
LABEL_BAND = 0.15

# Missing-rate limit for sparse columns.
MAX_MISSING = 0.3

# Seeds of the study (splits / backups).
SEED_SPLIT = 44
SEED_BACKUP = 42

# Feature spec: name, table, variable, item ids.
FEATURE_SPEC_CSV = """name,table,variable,item_id,item_id_2,item_id_3,item_id_4,item_id_5,item_id_6
Arterial_pressure_systolic,chartevents,valuenum,6,51,455,220050,220179,225309
Arterial_pressure_diastolic,chartevents,valuenum,8364,8368,8441,220051,220180,225310
Heart_rate,chartevents,valuenum,211,220045,,,,
Weight_daily,chartevents,valuenum,763,224639,,,,
Temperature,chartevents,valuenum,223761,678,645,,,
Urine_output,chartevents,valuenum,43966,44706,,,,
day_urine_output,chartevents,valuenum,43372,,,,,
SCr,chartevents,valuenum,1525,,,,,
Urea,chartevents,valuenum,,,,,,
Sodium,chartevents,valuenum,226534,,,,,
Potassium,chartevents,valuenum,226535,,,,,
Calcium,chartevents,valuenum,1512,,,,,
Phosphor,chartevents,valuenum,1534,,,,,
Leukocytes,chartevents,valuenum,,,,,,
Hemoglobine,chartevents,valuenum,814,,,,,
Bicarbonate,chartevents,valuenum,,,,,,
Lactate,chartevents,valuenum,,,,,,
Uric_acid,chartevents,valuenum,1541,,,,,
Chloride,chartevents,valuenum,1523,,,,,
Neutrophils,chartevents,valuenum,,,,,,
Lymphocytes,chartevents,valuenum,,,,,,
Platelet_count,chartevents,valuenum,828,,,,,
pH_blood,chartevents,valuenum,223830,,,,,
pH_urine,chartevents,valuenum,,,,,,
Monocytes,chartevents,valuenum,,,,,,
fibrinogen,chartevents,valuenum,1528,,,,,
urinary_sodium,chartevents,valuenum,2692,,,,,
urinary_potassium,chartevents,valuenum,2691,,,,,
urine_urea,chartevents,valuenum,,,,,,
urine_creatinin,chartevents,valuenum,5811,,,,,
alkaline_phospatase,chartevents,valuenum,3728,,,,,
Total_protein_blood,chartevents,valuenum,220650,,,,,
albumin,chartevents,valuenum,1521,,,,,
Total_protein_urine,chartevents,valuenum,3822,,,,,
bilirubin,chartevents,valuenum,50885,,,,,
C_reactive_protein,chartevents,valuenum,227444,,,,,
"""

# Ethnicity text -> group (unmapped values become NULL).
ETHNICITY_GROUPS = {
    "BLACK/AFRICAN AMERICAN": "BLACK",
    "WHITE": "WHITE",
    "UNKNOWN/NOT SPECIFIED": "UNKNOWN",
    "HISPANIC/LATINO - DOMINICAN": "OTHER",
    "UNABLE TO OBTAIN": "UNKNOWN",
    "PATIENT DECLINED TO ANSWER": "UNKNOWN",
    "ASIAN - CHINESE": "ASIAN",
    "AMERICAN INDIAN/ALASKA NATIVE": "OTHER",
    "MULTI RACE ETHNICITY": "OTHER",
    "WHITE - OTHER EUROPEAN": "WHITE",
    "OTHER": "OTHER",
    "PORTUGUESE": "WHITE",
    "HISPANIC OR LATINO": "OTHER",
    "ASIAN": "ASIAN",
    "HISPANIC/LATINO - PUERTO RICAN": "OTHER",
    "MIDDLE EASTERN": "OTHER",
    "ASIAN - KOREAN": "ASIAN",
    "BLACK/HAITIAN": "BLACK",
    "ASIAN - OTHER": "ASIAN",
    "HISPANIC/LATINO - CUBAN": "OTHER",
    "ASIAN - FILIPINO": "ASIAN",
    "BLACK/CAPE VERDEAN": "BLACK",
    "WHITE - BRAZILIAN": "WHITE",
    "ASIAN - ASIAN INDIAN": "ASIAN",
    "WHITE - EASTERN EUROPEAN": "WHITE",
    "HISPANIC/LATINO - GUATEMALAN": "OTHER",
    "ASIAN - VIETNAMESE": "ASIAN",
    "HISPANIC/LATINO - MEXICAN": "OTHER",
    "WHITE - RUSSIAN": "WHITE",
    "BLACK/AFRICAN": "BLACK",
    "ASIAN - CAMBODIAN": "ASIAN",
    "AMERICAN INDIAN/ALASKA NATIVE FEDERALLY RECOGNIZED TRIBE": "OTHER",
}

# Variant used by the older model-selection scripts: the UNKNOWN kinds become
# the literal text "NaN".
ETHNICITY_GROUPS_TEXT_NULL = {
    k: ("NaN" if v == "UNKNOWN" else v) for k, v in ETHNICITY_GROUPS.items()
}

# Substring recodes of the admission diagnosis, first match wins.
DIAGNOSIS_SUBSTRING_RECODES = [
    (["FEVER"], "SEPSIS"),
    (["DYSPNEA", "SHORTNESS OF BREATH"], "RESPIRATORY FAILURE"),
]

# Diagnoses kept as they are; everything else becomes OTHER.
DIAGNOSES_KEPT = [
    "PNEUMONIA", "CONGESTIVE HEART FAILURE", "SUBARACHNOID HEMORRHAGE",
    "INTRACRANIAL HEMORRHAGE", "ALTERED MENTAL STATUS", "CORONARY ARTERY DISEASE",
    "ABDOMINAL PAIN", "CHEST PAIN", "HYPOTENSION", "ACUTE RENAL FAILURE",
    "RESPIRATORY FAILURE", "GASTROINTESTINAL BLEED", "PANCREATITIS", "SEPSIS",
]

# Open-interval plausibility ranges: keep min < x < max.
FEATURE_RANGES = {
    "creatinine": (0.0, 20.0),
    "creatinine_yesterday": (0.0, 20.0),
    "creatinine_before_yesterday": (0.0, 20.0),
    "potassium": (1.2, 7.0),
    "ph_blood": (0.0, 14.0),
    "age": (0.0, 110.0),
    "bilirubin": (0.0, 20.0),
}

# One-sided outlier rules of the older scripts.
ONE_SIDED_LIMITS = [("creatinine", "<", 20.0), ("age", "<", 110.0), ("ph_blood", ">", 6.0)]

# Columns standardised one by one (dense path), and in the null-kept path.
NUMERIC_SCALED = ["creatinine", "age", "arterial_pressure_systolic", "arterial_pressure_diastolic",
                  "heart_rate", "temperature", "ph_blood"]
NUMERIC_SCALED_WITH_NULLS = [
    "creatinine", "age", "arterial_pressure_systolic", "arterial_pressure_diastolic", "heart_rate",
    "weight_daily", "temperature", "scr", "sodium", "phosphor", "hemoglobine", "uric_acid",
    "chloride", "platelet_count", "ph_blood", "fibrinogen", "total_protein_blood", "albumin",
    "c_reactive_protein", "creatinine_yesterday", "creatinine_before_yesterday",
]

# Categorical columns turned into dummies.
DUMMY_COLUMNS = ["ethnicity", "diagnosis", "gender"]

# Binary gender map of the older scripts.
GENDER_BINARY = {"F": 1, "M": 0}

# Hyper-parameter grids (lists of the study).
SVM_ALPHAS = [0.000001, 0.000003, 0.00001, 0.00003, 0.0001, 0.0003, 0.001, 0.003, 0.1, 0.3, 1.0]
LOGREG_ALPHAS = SVM_ALPHAS
ENET_ALPHAS = [0.000001, 0.000003, 0.00001, 0.00005, 0.0001, 0.0005, 0.001]
ENET_L1_RATIOS = [0.15, 0.3, 0.6, 1.0]
BOOST_RATES = [0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0]
BOOST_MIN_CHILD_WEIGHTS = [0.1, 0.3, 1, 3]
BOOST_DEPTHS = [3, 6, 8, 10, 12]
MLP1_UNITS = [10, 20, 30, 40]
MLP1_DROPOUT = [0.0, 0.1, 0.3, 0.5]
MLP2_UNITS_1 = [10, 20, 40]
MLP2_DROPOUT_1 = [0.0, 0.2]
MLP2_UNITS_2 = [10, 20, 40]
MLP2_DROPOUT_2 = [0.0, 0.2]
ADABOOST_RATES = [0.2, 0.5]
ADABOOST_ROUNDS = 50
