"""Extraction documents for tests, importable under a name of its own."""


def measurement(name, value, provider="Quest", day="2025-11-15", **more):
    return {
        "report_date": day,
        "provider": provider,
        "biomarker_name": name,
        "value": value,
        **more,
    }


def extraction(source, rows, **more):
    document = {
        "biomarkers": rows,
        "document_summary": f"# Report {source}\nwith two lines",
        "metadata": {"report_type": "blood_panel", "tags": ["lipid", "metabolic"]},
        "source_file": source,
        "extracted_at": "2025-11-16T08:30:00",
        "extraction_method": "manual",
    }
    document.update(more)
    return document
