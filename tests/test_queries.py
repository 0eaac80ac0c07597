"""The contract: every query has a SQL twin and agrees with it."""

import pytest

import __spark_entry__ as contract
from checks.compare import compare, connect
from checks.oracles import ORACLES
from checks.queries import QUERIES
from tests.conftest import SF

FAST = [
    "first_slice", "targets_clean", "targets_rejected", "probe_coverage", "probe_documents", "source_findings", "js_inputs",
    "secrets_scan", "error_pages", "git_exposure", "cloud_refs", "pdf_metadata", "office_metadata", "dns_txt", "tech_summary",
    "entropy", "url_resolve", "private_ip", "new_findings", "findings_rollup", "scan_stats", "report_rows_md", "findings_roundtrip",
    "stream_findings", "stream_counts", "stream_scripts", "detect_all",
]


def test_every_query_has_a_twin():
    # of the optional training-data queries only some can be said in SQL
    assert set(QUERIES) == set(ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "fingerprint" in df.columns


@pytest.mark.parametrize("name", FAST)
def test_agrees_with_sql(spark, name):
    outcome = compare(spark, connect(SF), name, contract.queries()[name], contract.oracle_sql()[name], SF)
    assert outcome.startswith("ok"), outcome
