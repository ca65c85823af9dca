import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 70


def test_entry_is_the_report(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and "avg_total" in rows.columns


def test_nothing_else_imports_the_llm_subpackage():
    for path in (ROOT / "toolloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"toolloom\.llm|corpus_pipeline", path.read_text()), path
