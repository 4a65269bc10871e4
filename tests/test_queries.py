"""Every registered query gives the rows of its SQL, and operators change something."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect
from checks import inputs
from checks.oracles import ORACLES
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    outcome = compare(spark, con, name, sf_dir)
    assert outcome.startswith("OK" if name in ORACLES else "ROWS"), outcome


def test_only_topic_finding_has_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"identify_topics"}
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["language", "type", "word", "count"] and df.count() > 0


def test_operators_are_not_idle(spark, sf_dir):
    words = inputs.words(spark, sf_dir).count()

    def count(name):
        return entry.queries()[name](spark, sf_dir).count()

    assert count("remove_blacklisted") < words < count("map_lexicon")
    assert count("clean_words") < words and count("clean_words_changes") > 0
    assert count("dedupe_docs") < count("prepare_docs")
    assert count("unseen_docs") < count("prepare_docs")
    plain = inputs.table(spark, sf_dir, "documents").select("text").distinct()
    repaired = entry.queries()["prepare_docs"](spark, sf_dir).select("text")
    assert repaired.join(plain, "text", "left_anti").count() > 0
