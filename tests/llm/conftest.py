"""Rows that every operator has to bear."""

import random
from pathlib import Path

import pytest
from odd_rows import ODD, PROSE

DATA = Path("/root/testdata/sf0.001")

@pytest.fixture(scope="session")
def docs(spark):
    """Rows with null and repeated ids, repeated rows, ties, odd texts, and columns whose names clash with the operators' own."""
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "Omega", "it", "is", "ß", "ñu", "7"]
    texts = ODD + PROSE * 3 + [" ".join(rng.choice(words) for _ in range(rng.randint(5, 90))) for _ in range(60)]
    rows = [(i, t, "en", f"ids{i}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, "foo bar", None, None, None), (None, None, None, None, None), (3, "another x", "en", "s", 9), rows[5], rows[5]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string, n_chars long")


@pytest.fixture
def sf0001():
    if not DATA.is_dir():
        pytest.skip("no driver tables")
    return str(DATA)
