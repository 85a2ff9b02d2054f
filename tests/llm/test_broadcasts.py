"""Tables that grow with the input are never broadcast on Spark's own estimate."""

import pytest

from leafmill.llm import common, graph, minhash, mixing, simhash


@pytest.fixture
def plans(monkeypatch):
    """Plans of all that is materialised."""
    seen = []

    def watched(df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return common.materialize(df, name)

    for module in (graph, minhash, mixing, simhash):
        monkeypatch.setattr(module, "materialize", watched)
    return seen


def test_near_duplicates_broadcast_nothing(docs, plans):
    assert minhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert len(plans) > 20 and not [p for p in plans if "BroadcastHashJoin" in p]


def test_copies_of_the_mix_are_not_broadcast(docs, plans):
    plan = mixing.mix_documents(docs)._jdf.queryExecution().executedPlan().toString()
    # The sources' targets are few; the copies, exploded, are joined by sorting.
    assert "SortMergeJoin [_leafmill_row" in plan
