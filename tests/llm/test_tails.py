"""Quality rules by tails: limits are learnt, and a dirty source doesn't set its own."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import connect, difference

import __spark_entry__ as driver
from lagweave.llm import quality_rules

DOCS = "doc_id long, text string, lang string, source string"
SF = "/root/testdata/sf0.001"


def text(rng, symbols, repeated=0):
    """120 words of 600 letters in 40 lines; so many characters more are symbols, so many lines a copy of the first."""
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(120)]
    lines = [" ".join(words[i:i + 3]) for i in range(0, 120, 3)]
    lines[1:1 + repeated] = [lines[0]] * repeated
    return "\n".join(lines) + "\n" + "#" * symbols


def test_limits_are_learnt_and_a_dirty_source_has_no_say(spark):
    rng, rows = np.random.default_rng(4), []
    add = lambda symbols, lang, source, repeated=0: rows.append((len(rows), text(rng, symbols, repeated), lang, source)) or len(rows) - 1
    clean = [add(i % 4, "en", f"s{k}") for k in range(4) for i in range(60)]
    code = [add(20 + i % 4, "en", "code") for i in range(60)]
    odd = [add(15, "en", "s0"), add(3, "en", "s1", 1), add(40, "en", "code")]
    junk = [add(20 if i % 10 < 3 else i % 4, "en", "hot") for i in range(600)]
    tiny = [add(2, "en", "tiny"), add(20, "en", "tiny")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.adaptive_rules(spark.createDataFrame(rows, DOCS), least_rows=50).collect()}
    assert all(got[i] for i in clean + code)
    assert not any(got[i] for i in odd)
    assert [got[i] for i in junk] == [i % 10 >= 3 for i in range(600)]
    assert [got[i] for i in tiny] == [True, False]
    fixed = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, DOCS), least_rows=50).collect()}
    assert all(fixed[i] for i in [*odd[:2], *junk])  # what the floors let pass: less than 5 symbols in a hundred characters


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")
def test_tails_match_sql(spark):
    name = "op10_quality_rules_tails"
    problem, rows = difference(spark, connect(SF), driver.queries()[name], driver.oracle_sql()[name], SF)
    assert problem is None and rows > 0, problem
