import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; as extra columns they must not disturb.
CLASHING = ["sha", "rid", "k", "again", "sig", "sigs", "grp", "n", "size", "u", "pre", "source_size", "target", "kept", "label", "keys", "unit", "bucket", "base", "met", "found", "x", "toxic", "part", "tokens", "ids", "sample", "v", "root", "_sha", "_again", "_mix", "_drop_id"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """Null ids and texts, empty, blank and very long texts, repeated rows, ties, clashing extra columns."""
    base = prose(1, 60)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " extra words here", "en", None, 1), (4, None, None, "b", None), (5, "", "de", "b", 0),
        (6, " \n\t ", "de", "c", 3), (None, base, "en", "c", 1), (None, None, None, None, None), (7, prose(2, 30_000), "de", "a", 1), (8, "x" * 20_000, "fr", "a", 1),
        (9, "word", "fr", "d", 4), (10, "é ß 漢字 😀   ▁ <|endoftext|>", "fr", "d", 4), (11, "MIT license 4111 1111 1111 1111 on 2020-02-30", "en", "d", 4), (5, "", "de", "b", 0), (12, prose(3, 40), "de", "b", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"{c}!") for c in CLASHING if c not in df.columns})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
