from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, row int, cut string, p string, held_out int, group string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang]), with columns whose names operators use themselves."""

    def build(rows, parts=2):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, "x", 1, "c", "p", 7, "g") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, a null id, one word, very long texts and runs of blanks, copies and repeated rows."""
    base = "The quick brown fox jumps over the lazy dog while seven other animals watch it closely."
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, base), (6, base), (5, base), (None, base), (7, long), (8, "é" * 5000), (9, base + "\n" + base), (9, "another text under the same id, which is allowed"), (10, "a,b;c!" * 50), (11, "0123 4567\x00\x01 <|endoftext|> x"), (12, "a" + " " * 1_000_000 + "b\n" + "\n" * 5000 + "<|endoftext|>" + "\t" * 3000)]


@pytest.fixture(scope="session")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
