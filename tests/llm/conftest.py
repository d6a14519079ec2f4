import hashlib
import os
import re
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_package(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


@pytest.fixture(scope="session")
def sha():
    return lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


@pytest.fixture(scope="session")
def words():
    return lambda s: re.findall(r"[^\x20\x09-\x0D]+", s or "")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, _id string, key int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with extra columns whose names clash with those that operators use."""

    def build(rows):
        full = [(i, t, lang, source, len(t) if t is not None else None, "r", None, "x", 1) for i, t, lang, source in ((*r, "en", "a")[:4] if len(r) < 4 else r for r in rows)]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids, null and empty texts, blanks, repeated rows, one id with two texts, and a very long text."""
    long = " ".join(f"w{i * i % 977}" for i in range(60_000))
    line = "one two three four five six seven eight nine ten"
    return [(None, line), (1, None), (2, ""), (3, " \n\t "), (4, line), (4, line), (4, line + "\nanother line of the same id that is long enough"), (5, long), (None, None), (6, "é 中 😀"), (7, line.replace("three", "3"))]
