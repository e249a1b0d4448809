"""Texts whose high levels have next to no names: runs and short periods of any length."""

import random

import pytest

from tidewell.llm import parsing

RNG = random.Random(1)
PROSE = " ".join("".join(RNG.choice("etaoinshrdlu") for _ in range(RNG.randint(2, 9))) for _ in range(900))


@pytest.mark.parametrize("text", ["a" * 1000, "word " * 30_000, "----|" * 500, ("-" * 79 + "\n") * 50])
def test_repetitive_text_is_like_its_edit_and_unlike_others(text):
    own, edit, prose, empty, shorter = parsing.fingerprints([text, parsing.edited(text, PROSE), PROSE, "", text[:-7]], pairs=[(0, 1), (0, 2), (0, 3), (0, 4)])
    assert parsing.likeness(own, edit) > 0.4 and parsing.likeness(own, shorter) > 0.9
    assert parsing.likeness(own, prose) < 0.1 and parsing.likeness(own, empty) == 0.0 and parsing.text_of(own, len(text)) != "."


def test_different_runs_differ_and_a_pair_changes_no_fingerprint(spark):
    rows = [(1, "a" * 1000), (2, "b" * 2000), (3, ""), (4, PROSE), (5, "word " * 3000)]
    got = {r.doc_id: r for r in parsing.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].near_next for i in (1, 2, 3)] == [0.0, 0.0, 0.0] and got[5].near_edited > 0.5
    assert len({r.fingerprint for r in got.values()}) == 5
    assert got[4].fingerprint == parsing.text_of(parsing.fingerprints([PROSE])[0], len(PROSE))
