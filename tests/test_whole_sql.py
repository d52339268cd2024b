"""The SQL of the queries asks every rule, and takes up every list, that it had before some were taken out (commit 1557816)."""

import pytest

from vellum.plans import catalog as C

#: Parts of the SQL as it was at 09f9b53.
RULES = [r"|(?:\$\$\$)'", "'(?is)(?:[0-9]{13,19})') THEN 'long_digits'", "'(?is)(?:thereon|withthe)') THEN 'run_on'",
         r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", "(?:avec|pour)", "(?:und|nicht)", "(?:para|como|del)"]
PRIORITY, DIRECT = "['license', 'claim', 'table_text', 'french', 'german', 'spanish']", "['license', 'table_text', 'french']"
LANGUAGE_HELP = ["THEN 'language_help'", "A faithful translation keeps"]

ASKED = {
    "category_counts": RULES,
    "unsafe_documents": RULES,
    "quality_flags": [*RULES, PRIORITY, DIRECT],
    "quality_counts": [*RULES, PRIORITY, DIRECT],
    "benign_tasks": [*RULES, DIRECT],
    "guarded_select": [*RULES, PRIORITY, DIRECT, *LANGUAGE_HELP],
    "cascade_counters": [*RULES, PRIORITY, DIRECT, *LANGUAGE_HELP],
    "report_by_route": [*RULES, DIRECT],
    "guarded_select_preserving": [*RULES, PRIORITY, DIRECT, *LANGUAGE_HELP],
    "respond_decisions": [*RULES, PRIORITY, DIRECT, *LANGUAGE_HELP],
    "respond_diagnostics": [*RULES, PRIORITY, DIRECT, *LANGUAGE_HELP],
    "respond_counts": [*RULES, PRIORITY, DIRECT, *LANGUAGE_HELP],
    "respond_stage_counts": [*RULES, PRIORITY, DIRECT, *LANGUAGE_HELP],
}


@pytest.mark.parametrize("name", list(ASKED))
def test_sql_has_every_rule(name):
    assert [part for part in ASKED[name] if part not in C.ORACLE[name]] == []
