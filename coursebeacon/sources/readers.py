"""Readers: explicit schemas, optional sources, logs with rows of differing width, file times."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursebeacon import schemas
from coursebeacon.functions.scalars import format_timestamp, null_if_nan
from coursebeacon.operators.enrolments import require_columns
from coursebeacon.operators.features import Inputs
from coursebeacon.schemas import EXTRACT_NAMES

CORRUPT = "_unparsed"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN sorts above every number here, so missing values are NULL from the start."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: null_if_nan(c) for c in floats})


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return nan_to_null(spark.read.schema(schema).option("header", header).csv(path))


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return nan_to_null(reader.parquet(path))


def read_inputs(spark: SparkSession, folder: str) -> Inputs:
    """The four raw CSV tables by header name, so column order and extra columns do not matter."""

    def table(name: str, schema: str, optional: tuple[str, ...] = ()) -> DataFrame:
        raw = spark.read.option("header", True).option("inferSchema", False).csv(f"{folder}/{name}.csv")
        columns = [part.strip().split(" ") for part in schema.split(",")]
        wanted = [(c, t) for c, t in columns if c in raw.columns or c not in optional]
        require_columns(raw, [c for c, _ in wanted], name)
        # dirty numbers become NULL instead of failing the job
        typed = [(F.col(c) if t == "STRING" else F.col(c).try_cast(t)).alias(c) for c, t in wanted]
        return nan_to_null(raw.select(*typed))

    return Inputs(
        table("studentInfo", schemas.STUDENT_INFO),
        table("studentVle", schemas.STUDENT_VLE, ("code_module", "code_presentation", "id_site")),
        table("assessments", schemas.ASSESSMENTS, ("id_assessment", "date", "weight")),
        table("studentAssessment", schemas.STUDENT_ASSESSMENT, ("id_assessment",)),
    )


def read_tolerant_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log whose rows may be shorter or longer than the header.

    Short rows keep what they have; rows with more fields than the schema are left out.
    """
    rows = (
        spark.read.schema(f"{schema}, {CORRUPT} STRING")
        .option("header", True).option("enforceSchema", True)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )
    names = [c for c in rows.columns if c != CORRUPT]
    unquoted = F.regexp_replace(F.coalesce(F.col(CORRUPT), F.lit("")), r'"(?:[^"]|"")*"', "")
    fields = F.size(F.split(unquoted, ","))
    return nan_to_null(rows.filter(fields <= len(names)).select(*names))


def read_optional(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """An empty table with the schema when the source does not exist."""
    found = read_first(spark, [path], schema, kind)
    return spark.createDataFrame([], schema) if found is None else found


def read_first(spark: SparkSession, paths: list[str], schema: str, kind: str = "parquet") -> DataFrame | None:
    """The first source that exists, e.g. the evaluation log before the snapshot log."""
    for path in paths:
        try:
            if kind == "csv":
                return read_tolerant_csv(spark, path, schema)
            return read_table(spark, path, schema)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """The status document; empty when there is none or it is not readable."""
    try:
        return (spark.read.schema(schemas.STATUS).option("multiLine", True).option("mode", "DROPMALFORMED")
                .json(path).filter("timestamp is not null"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.STATUS)


def file_times(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Latest modification per source file, with its clock time as text."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", True)
        .load(path).select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"))
    )
    return files.withColumn("clock", format_timestamp("modified", "HH:mm:ss"))


def from_extract_names(df: DataFrame, names: dict[str, str] = EXTRACT_NAMES) -> DataFrame:
    """Column names of existing extracts to the names used here; columns it lacks are ignored."""
    return df.withColumnsRenamed(names)


def with_missing_columns(df: DataFrame, columns: list[str], value=None, type_: str = "double") -> DataFrame:
    """Absent columns filled with NULL or a constant."""
    return df.withColumns({c: F.lit(value).cast(type_) for c in columns if c not in df.columns})
