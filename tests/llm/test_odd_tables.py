"""Every query and the pipeline over tables full of nulls, repeats, extremes and clashing names."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

NAMES = [n for n in entry.queries() if n == "pipeline" or n[:2] == "op" and n[2].isdigit()]
CLASHES = "score predicted held_out n_tokens n_bytes fp fingerprint n_near component_id id row group n cluster kept failures spans base_spans rejected lang_pred ids decoded bin_id piece __label __out __text a b"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    body = " ".join(f"word{i}" for i in range(90))
    rows = [(None, None, None, None, None), (1, None, "en", "a", 3), (2, "", "fr", None, 0), *[(3, body, None, "a", 9)] * 3, (4, body + " x@y.zz 1.2.3.4", "de", "b", None)]
    rows += [(5, "lorem ipsum " * 190_000, "en", "c", 1), (6, "1" * 100_000, "en", "c", 1), (7, "a@" * 30_000, "es", "c", 1), (8, "\x00\x0b\x1c 漢字 \U0001f600 ÿ", "xx", "d", 2), (None, "no id at all", "en", "a", 1)]
    rows += [(100 + i, f"{body} {i % 3}", "en", "hot", 5) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("clash") for c in CLASHES.split()})
    labels = spark.createDataFrame([(None, 1, 1), (1, None, 0), (3, 1, 0), (3, 0, 1), (4, 1, 1), (5, 0, 0), (6, 0, None), (100, 1, 0), (101, 0, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    labels = labels.withColumns({"text": F.lit("clash"), "__label": F.lit(3)})
    vectors = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [0.5, None]), (100, [float("nan"), 1.0]), (150, None), (None, [1.0, 1.0]), (200, [3.0, 4.0]), (201, [3.0, 4.0]), (202, []), (250, [1e3, 2e3, 3e3])]
    vectors = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({"score": F.lit("clash"), "id": F.lit("clash"), "v": F.lit(1)})
    base = tmp_path_factory.mktemp("odd")
    for name, cut in (("odd", None), ("empty", 0)):
        for t, df in (("documents", docs), ("labels", labels), ("embeddings", vectors)):
            (df if cut is None else df.limit(cut)).write.parquet(f"{base}/{name}/{t}.parquet")
    return base, len(rows)


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, folders, name):
    base, n = folders
    rows = entry.queries()[name](spark, f"{base}/odd").collect()
    if name.startswith("op10"):
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in rows) == [(0, 1, 200), (0, 2, 201), (200, 1, 201), (200, 2, 0), (200, 3, 0)]
    elif name.startswith("op5"):
        assert sum(r.piece == 0 for r in rows) == n
    elif name != "pipeline":
        assert len(rows) == n


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(spark, folders, name):
    assert entry.queries()[name](spark, f"{folders[0]}/empty").count() == 0
