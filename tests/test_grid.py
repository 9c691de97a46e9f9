"""F4 of round 4: the grid splits and stems its texts once."""

import pytest

from lodestone.plans import registry

from .conftest import TINY
from .test_growth import plan
from .test_round3 import against_sql


@pytest.mark.parametrize("name", ["bm25_grid", "bm25_grid48"])
def test_grid_splits_texts_once(spark, name):
    """What scores the documents of each variant reads their words as numbers, and neither splits nor stems a text again."""
    p = plan(spark, name, TINY)
    assert "regexp_extract_all" not in p and "ArrowEvalPython" not in p


def test_grid_of_odd_texts(spark, tmp_path):
    """Texts that are null, empty or of stopwords alone, against SQL; words that only share their stem with a stopword (ands) count, whatever is stemmed."""
    texts = ["the and of", None, "", "ands running dogs", "dog runs", "The dogs ran and ran", "a cat", "cats cat catty", "x y z"] * 3
    tables = {
        "documents": {"doc_id": list(range(len(texts))), "text": texts},
        "benchmark": {"item_id": [1, 2, 3, 4, 5], "text": ["ands dog", "the cat", None, "running dogs and cats", "of the"]},
        "labels": {"doc_id": list(range(0, len(texts), 2)), "quality": [k % 3 % 2 for k in range(0, len(texts), 2)], "toxic": [0] * len(range(0, len(texts), 2))},
    }
    got, want = against_sql(spark, tmp_path, "bm25_grid", **tables)
    assert got == want and len(got) == 24
    whole = registry.QUERIES["bm25_grid48"](spark, str(tmp_path)).collect()
    key = lambda r: (r.stop, r.k1, r.b)
    plain = {(r[0], r[2], r[3]): r[4:6] for r in got}
    assert {key(r): (r.at1, r.at3) for r in whole if not r.stem} == plain and len(whole) == 48
