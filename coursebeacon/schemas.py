"""Table schemas and the fixed names and constants shared by the package."""

COURSE = ["code_module", "code_presentation"]
ENROLMENT = ["id_student", *COURSE]

# They must equal the established data set conventions.
MAX_WEEKS = 20
PASS_RESULTS = ("Pass", "Distinction")
DEFAULT_RISK_THRESHOLD = 0.94
DEFAULT_INDEX_THRESHOLD = 50.0

# The five aggregate metrics, in display order.
METRICS = ["total_clicks", "n_submitted", "mean_score", "completion", "active_weeks"]
# Names of the metric means in the snapshot log.
SNAPSHOT_NAMES = {"total_clicks": "mean_click", "mean_score": "mean_score", "completion": "mean_completion",
                  "n_submitted": "mean_submits", "active_weeks": "mean_weeks"}

# Column names used by existing CSV extracts -> names used here.
EXTRACT_NAMES = {
    "so_bai_nop": "n_submitted",
    "diem_tb": "mean_score",
    "tong_bai": "n_assessments",
    "ti_le_hoan_thanh": "completion",
    "tong_click": "total_clicks",
    "so_tuan_hoat_dong": "active_weeks",
}

# Column names of existing evaluation logs -> names used here.
EVALUATION_NAMES = {
    "AUC_PR": "auc_pr",
    "AUC_ROC": "auc_roc",
    "F1": "f1",
    "Precision": "precision",
    "Recall": "recall",
    "Brier": "brier",
    "TP": "tp",
    "FP": "fp",
}


# Schemas are DDL strings: readers and writers take them as they are.
STUDENT_INFO = (
    "id_student BIGINT, code_module STRING, code_presentation STRING, final_result STRING"
)
STUDENT_VLE = (
    "id_student BIGINT, code_module STRING, code_presentation STRING, "
    "id_site BIGINT, date INT, sum_click BIGINT"
)
ASSESSMENTS = (
    "id_assessment BIGINT, code_module STRING, code_presentation STRING, date INT, weight DOUBLE"
)
STUDENT_ASSESSMENT = (
    "id_assessment BIGINT, id_student BIGINT, score DOUBLE"
)

SCALER = (
    "week INT, min DOUBLE, max DOUBLE"
)
PREDICTIONS = (
    "student_uid STRING, predicted_label INT, prob_pass DOUBLE"
)
REAL_LABELS = (
    "student_uid STRING, label INT, final_result STRING"
)
EVALUATION_LOG = (
    "timestamp TIMESTAMP, week INT, auc_pr DOUBLE, auc_roc DOUBLE, f1 DOUBLE, precision DOUBLE, "
    "recall DOUBLE, brier DOUBLE, theta_t DOUBLE, warn_count BIGINT, tp BIGINT, fp BIGINT"
)
SNAPSHOT_LOG = (
    "timestamp TIMESTAMP, scenario STRING, mean_click DOUBLE, mean_score DOUBLE, "
    "mean_completion DOUBLE, mean_submits DOUBLE, mean_weeks DOUBLE"
)
STATUS = (
    "timestamp STRING, scenario STRING, affected_fraction DOUBLE, rows BIGINT, test_csv_mtime DOUBLE"
)
# completion is kept as a percentage in this log, and prob_risk is absent in old rows
WHATIF_HISTORY = (
    "timestamp TIMESTAMP, id_student STRING, n_submitted DOUBLE, mean_score DOUBLE, "
    "completion DOUBLE, total_clicks DOUBLE, active_weeks DOUBLE, prob_pass DOUBLE, prob_risk DOUBLE"
)


def week_columns(max_weeks: int = MAX_WEEKS) -> list[str]:
    return [f"w{k}_clicks" for k in range(max_weeks)]
