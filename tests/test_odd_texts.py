"""Texts with odd white space, line ends and letters: queries against their SQL."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quadrille.queries import registry
from tests.test_parity import rows

ODD = ("\x09", "\x0d", "\x0b", "\x0c", "\x00", "\x1f", "\x85", "\xa0", "\u2028", "\u2029", "\u200b", "\u1680", "\u2003", "\u3000", "\ufeff")
TEXTS = [
    "", " ", "\n", ". ", "\u3000. \xa0", "\t", None,
    *(f"a{x}b{x}. {x}c. {x}\n{x}d\n# {x}\n第2條{x}if\n1. |{x}|\n1. A.{x}B.{x}C.\n==={x}\nx{x}\n---\nend{x}" for x in ODD),
    "par èlet anhash\nforé éfor. par èlet\nlet. par èlet. " * 8, "éx 👨‍👩‍👧\n" * 9, "\n".join(["a. b", "temp", "İ", "log", "x.tmp"] * 8) + ". public. c. d. temp. " * 3,
]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    duckdb = pytest.importorskip("duckdb")
    d = str(tmp_path_factory.mktemp("odd"))
    pq.write_table(pa.table({"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": pa.array(TEXTS, pa.string()), "source": ["src1"] * len(TEXTS)}), f"{d}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    return d, con


@pytest.mark.parametrize("name", ["heading_lines", "asof_heading", "split_paragraph", "merge_by_length", "merge_fixed_groups", "heading_filtered", "heading_fallback", "segment_tags", "chunks_by_tree"])
def test_odd_texts(spark, odd, name):
    df = registry.queries()[name](spark, odd[0])
    found = odd[1].execute(registry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in found.description], found.fetchall())
