"""The package's structure: what may import what, and the entry's contract."""

import re
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_training_data_package():
    for path in (ROOT / "quillspark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"quillspark[. ]+(import )?llm|corpus_pipeline", path.read_text()), path


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"tag", "n_reviews", "n_toxic", "toxicity_rate", "toxicity_pct"}


def test_no_local_checkpoints():
    for path in [*(ROOT / "quillspark").rglob("*.py"), *ROOT.glob("*.py")]:
        assert "localCheckpoint(" not in path.read_text(), path
