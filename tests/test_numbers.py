"""Transcribed cases over the numbers schema, read from FIXTURES.md."""

from __future__ import annotations

import json
import re

import pytest
from conftest import ROOT

from vertexloom.api import execute_query
from vertexloom.sources.numbers import numbers_source

FIXTURES = ROOT / "FIXTURES.md"
_CASE = re.compile(r"\*\*`(\w+)`\*\* \(\d+ rows\)\n```graphql\n(.*?)\n```\nargs `(.*?)` → `(.*?)`\n", re.S)


def _arguments(text: str) -> dict:
    text = re.sub(r"(?:U?[Ii]nt64|String|List)\(", "(", text)
    text = re.sub(r",\s*([\]})])", r"\1", text.replace("(", "").replace(")", ""))
    return json.loads(text or "{}")


def cases():
    found = _CASE.findall(FIXTURES.read_text() + "\n") if FIXTURES.exists() else []
    return [pytest.param(q, _arguments(a), json.loads(r), id=n) for n, q, a, r in found]


def canonical(rows) -> list[str]:
    return sorted(json.dumps(r, sort_keys=True) for r in rows)


@pytest.fixture(scope="module")
def source(spark):
    return numbers_source(spark)


@pytest.mark.parametrize("query,arguments,wanted", cases())
def test_transcribed(source, query, arguments, wanted):
    df = execute_query(source, query, arguments)
    assert df.columns == sorted(df.columns)
    assert canonical(r.asDict(recursive=True) for r in df.collect()) == canonical(wanted)
