import json
import sys
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from builders import extraction, measurement  # noqa: E402

from assaylake import schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("assaylake-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(folder / "shared"))
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column over one row of named values: ``one(column, a=(1.0, "double"))``."""

    def evaluate(column, **values):
        row = spark.range(1).select(
            *[F.lit(v).cast(kind).alias(n) for n, (v, kind) in values.items()]
        )
        return row.select(column).first()[0]

    return evaluate


@pytest.fixture
def raw_rows(spark):
    """Raw measurement rows from dicts; what is not given has a default."""

    def build(*rows):
        base = {
            "source_file": "a.pdf",
            "extracted_at": "2025-01-01 00:00:00",
            "extraction_method": "api",
            "report_date": "2025-01-01",
            "provider": "Quest",
            "biomarker_name_raw": "Glucose",
            "value_raw": "1",
            "unit_raw": "mg/dL",
        }
        full = [{"id": f"r{i}", **base, **row} for i, row in enumerate(rows)]
        names = schemas.LAB_RESULTS.names
        text = spark.createDataFrame(
            [tuple(r.get(n) for n in names) for r in full],
            ", ".join(f"{n} string" for n in names),
        )
        return text.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.LAB_RESULTS.fields]
        )

    return build


@pytest.fixture
def meta_rows(spark):
    """Reference dimension rows as tuples in column order."""
    return lambda *rows: spark.createDataFrame(list(rows), schemas.REFERENCE_DIMENSION)


@pytest.fixture
def fact_rows(spark):
    """Fact rows from dicts with the columns that reports and the diff read."""
    kinds = {
        "lab_result_id": "string",
        "biomarker_key": "string",
        "value_raw": "string",
        "value_si": "double",
        "unit_si": "string",
        "value_original": "double",
        "unit_original": "string",
        "report_date": "date",
        "provider": "string",
        "category": "string",
        "is_within_ref_range": "boolean",
        "is_within_optimal_range": "boolean",
        "is_below_detection_limit": "boolean",
        "source_file": "string",
    }

    def build(*rows):
        values = [
            tuple(
                date.fromisoformat(r[n]) if kinds[n] == "date" and r.get(n) else r.get(n)
                for n in kinds
            )
            for r in [{"lab_result_id": f"f{i}", **row} for i, row in enumerate(rows)]
        ]
        return spark.createDataFrame(values, ", ".join(f"{n} {k}" for n, k in kinds.items()))

    return build


@pytest.fixture
def document_rows(spark):
    kinds = {
        "source_file": "string",
        "report_date": "date",
        "provider": "string",
        "report_type": "string",
        "biomarker_count": "bigint",
        "tags": "string",
        "markdown_path": "string",
        "document_summary": "string",
        "baseline_candidates": "string",
    }

    def build(*rows):
        values = [
            tuple(
                date.fromisoformat(r[n]) if kinds[n] == "date" and r.get(n) else r.get(n)
                for n in kinds
            )
            for r in rows
        ]
        return spark.createDataFrame(values, ", ".join(f"{n} {k}" for n, k in kinds.items()))

    return build


@pytest.fixture
def in_dir(tmp_path):
    """Three reports with 5, 6 and 2 measurements."""
    folder = tmp_path / "in"
    folder.mkdir()
    first = [
        measurement("Glucose (Fasting)", "102", "LabCorp", "2025-06-01", unit="mg/dL",
                    reference_range_low="65", reference_range_high="99"),
        measurement("HbA1c", "5.4", "LabCorp", "2025-06-01", unit="%"),
        measurement("TSH", "2.1", "LabCorp", "2025-06-01", unit="mIU/L"),
        measurement("Vitamin D (25-OH)", "28", "LabCorp", "2025-06-01", unit="ng/mL",
                    reference_range_low="30", reference_range_high="100"),
        measurement("Ferritin", "85", "LabCorp", "2025-06-01", unit="ng/mL"),
    ]
    second = [
        measurement("Glucose (Fasting)", "95", unit="mg/dL", reference_range_low="65",
                    reference_range_high="99"),
        measurement("Total Cholesterol", "195", unit="mg/dL"),
        measurement("LDL Cholesterol", "145", unit="mg/dL", reference_range_high="100"),
        measurement("HDL Cholesterol", "55", unit="mg/dL", reference_range_low="40"),
        measurement("Vitamin D (25-OH)", "22", unit="ng/mL", reference_range_low="30",
                    reference_range_high="100"),
        measurement("CRP (hs)", "<0.1", unit="mg/L", reference_range_high="3.0"),
    ]
    third = [
        measurement("TNF-alpha", "8.5", "Gene Lab", "2026-01-15", unit="pg/mL",
                    reference_range_high="8.1"),
        measurement("IL-6", "3.2", "Gene Lab", "2026-01-15", unit=None,
                    reference_range_high="7"),
    ]
    documents = [
        extraction("labcorp.pdf", first, metadata={
            "report_type": "blood_panel", "tags": ["thyroid"],
            "baseline_candidates": ["Low vitamin D", "café"]}),
        extraction("quest.pdf", second),
        extraction("genes.pdf", third, metadata={"report_type": "genetics"}),
    ]
    for n, document in enumerate(documents):
        (folder / f"{n}.json").write_text(json.dumps(document))
    return folder
