import pyarrow as pa

from crateline.llm import jaccard_join
from crateline.llm.common import kept, let_go

from .conftest import prose


def test_near_copies_let_go_what_workers_kept_for_languages():
    made = []
    kept("table", lambda: made.append(1) or object(), "language")
    kept("table", lambda: made.append(1) or object(), "language")
    assert len(made) == 1 and "table" in let_go("language")
    jaccard_join._sketch(pa.RecordBatch.from_pydict({"doc_id": [1], "text": [prose(1, 50)]}), 5)
    assert "table" not in let_go("near")
