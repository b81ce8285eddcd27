import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from odd_rows import ODD

CLASHES = ["row", "key", "n", "ids", "fp", "window", "at", "line", "doc", "hash", "guest", "side", "rank", "a", "b", "_row", "_doc", "_p", "spans", "node", "root"]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows of ODD with further columns whose names the operators use themselves."""
    columns = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else "s", None, *["z"] * len(CLASHES)) for k, (i, t) in enumerate(ODD)]
    kinds = ["long", "string", "string", "string", "long", *["string"] * len(CLASHES)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` {k}" for c, k in zip(columns, kinds, strict=True)))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
