import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from texts, or from (id, text) or (id, text, source) tuples."""

    def make(rows, source="s"):
        full = []
        for k, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (k, row)
            text = row[1]
            full.append(
                (row[0], text, "en", row[2] if len(row) > 2 else source, len(text or ""))
            )
        return spark.createDataFrame(full, DOCUMENTS)

    return make
