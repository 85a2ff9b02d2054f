"""Queries against their SQL on lines where Java's and Python's ideas of white space, words and case part from RE2's."""

import duckdb
import pytest

import __spark_entry__ as driver
from leafmill import catalogue
from leafmill.operators import structure
from leafmill.plans.text_queries import KIND

LINES = ["To José", "to été, moi", "For a friend", "For you", "  indented", "\tTabbed line.\x0b", "ends\x85", "ends\x1f", "\x0bContents", "Contents ", "CONTENTS", "ÍNDICE", "Part mé", "Chapter 1é", "chapter\x0b2", "Part ii", "part ſ", "colopHon", "ıSBN", "IſBN 1", "*　*", "* *", "table\x0b1", "Inhalt", "a) x", "a)\x0bx", "12\x85", "", " ", "plain.\x85", "heading; \x85", "index\x0b"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    texts = ["\n".join(LINES[k:] + LINES[:k]) for k in range(len(LINES))] + LINES + ["", None]
    rows = [(k if k else None, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["matter_as_shipped", "toc_sticky_matter", "retry_ladder"])
def test_odd_lines(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{odd}/documents.parquet/*.parquet')")
    df = driver.queries()[name](spark, odd)
    done = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in done.description]
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in done.fetchall()), key=str)
    assert sorted((tuple(r) for r in df.collect()), key=str) == want


def test_kinds_of_odd_lines(spark):
    con = duckdb.connect()
    con.execute("create table lines (k int, text varchar)")
    con.executemany("insert into lines values (?, ?)", list(enumerate(LINES)))
    got = spark.createDataFrame(list(enumerate(LINES)), "k int, text string").select("k", structure.kind_by_text("text")).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"select k, {KIND} from lines").fetchall())
