from __future__ import annotations

import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
KINDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def pairs(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or whole rows, with a further column that has an awkward name."""

    def make(rows):
        full = [(*r, "en", "s", len(r[1] or ""))[:5] if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(full, KINDS)

    return make


@pytest.fixture(scope="session")
def table_dir(spark, tmp_path_factory, sf_dir):
    """A folder with the given documents as a table and other tables as they are."""

    def make(docs, **tables):
        d = tmp_path_factory.mktemp("tables")
        docs.write.parquet(f"file://{d}/documents.parquet")
        for name in ("benchmark", "labels", "embeddings"):
            df = tables.get(name)
            df = spark.read.parquet(f"{sf_dir}/{name}.parquet") if df is None else df
            df.write.parquet(f"file://{d}/{name}.parquet")
        return f"file://{d}"

    return make


LONG = "lorem ipsum dolor " * 6000

#: Nulls, empty and blank texts, one word, long text, repeated rows, null ids.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, LONG), (6, "same text here with several words"), (6, "same text here with several words"), (7, "same text here with several words"), (None, "null id text"), (None, None), (8, "123 456 !!!"), (9, "naïve café Ünïcode ñandú   line")]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)


def kept_all(df, docs):
    """Whether df has docs' columns first, in order and unambiguous."""
    names = [c.lower() for c in df.columns]
    return df.columns[: len(docs.columns)] == docs.columns and len(names) == len(set(names))
