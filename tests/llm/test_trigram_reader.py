"""Operator 1's reading of regexes: a match holds all trigrams of one clause."""

import re

import pytest

from tidewell.llm import secretscan

CASES = {
    r"a?bc?": ["b", "abc"],
    r"[0-9a-f]{24,}": ["0123456789abcdef01234567"],
    r"abc{2}def": ["abccdef"],
    r"(foo|bar)baz": ["foobaz", "barbaz"],
    r"x{0,3}hello": ["hello", "xxhello"],
    r"[]ab]cde": ["]cde", "acde"],
    r"[^a-z]key[a-c]{2}value": ["1keyabvalue"],
    r"\d+secret\b": ["12secret"],
    r"foo(?:bar)?baz|qux\x41end": ["foobarbaz", "foobaz", "quxAend"],
    r"(?i:Token)\.[Vv]alue+": ["TOKEN.valueee"],
    r"(abcd)*wxyz": ["wxyz", "abcdabcdwxyz"],
    r"tail-[a\]-]+ing": ["tail-a]-ing"],
}


@pytest.mark.parametrize("regex", CASES)
def test_every_match_holds_a_clause(regex):
    query = secretscan.trigram_query(regex)
    for hit in CASES[regex]:
        assert re.fullmatch(regex, hit)
        assert query is None or any(all(g in hit.lower() for g in clause) for clause in query)


def test_clauses_of_plain_regexes():
    assert secretscan.trigram_query("abc{2}def") == [["abc", "def"]]
    assert secretscan.trigram_query(r"\d+secret\b") == [["sec", "ecr", "cre", "ret"]]
    assert secretscan.trigram_query("[0-9a-f]{24,}") is None
    with pytest.raises(ValueError, match="no trigrams"):
        secretscan.trigram_query("(?!abc)def")
