"""The terms of the problems in SQL, for the statements that check the operators on small tables."""

from __future__ import annotations

_INVISIBLE = "[" + "".join(f"\\x{{{c:X}}}" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFE0E, 0xFE0F, 0xFEFF)) + "]"
_SPACES = "[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+"


def key(x: str) -> str:
    """The entity key, null if blank."""
    return f"nullif(trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '')"


def words(x: str) -> str:
    """The plain words with one space between."""
    composed = f"regexp_replace(nfc_normalize({x}), '{_INVISIBLE}', '', 'g')"
    folded = f"replace(replace(lower({composed}), 'ß', 'ss'), 'ς', 'σ')"
    bare = f"regexp_replace(regexp_replace({folded}, '[;|]', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s\\x0B\\x1C-\\x1F\\x85\\p{{Z}}\\x{{900}}-\\x{{E7F}}]+', '', 'g')"
    return f"trim(regexp_replace({bare}, '{_SPACES}', ' ', 'g'))"


def count(words_: str) -> str:
    return f"(length({words_}) - length(replace({words_}, ' ', '')) + 1)"


def canonical(x: str) -> str:
    """The plain words; of a list of labelled fields the fields' words in sorted order."""
    fields = f"list_filter(regexp_split_to_array({x}, '[|;\\n\\r\\x85\\x{{2028}}\\x{{2029}}]+'), lambda f: regexp_replace(f, '{_SPACES}', '', 'g') <> '')"
    labelled = f"(len({fields}) > 1 AND len(list_filter({fields}, lambda f: NOT regexp_matches(f, '^[\\s\\x0B\\p{{Z}}]*\\p{{L}}[\\p{{L}}\\p{{N}}_ ]{{0,30}}[\\s\\x0B\\p{{Z}}]*:'))) = 0)"
    return f"CASE WHEN {labelled} THEN array_to_string(list_sort(list_transform({fields}, lambda f: {words('f')})), ' ') ELSE {words(x)} END"


SAMPLE = "orchestrator_hotel_sample"
#: Entities and the different plain texts they have.
MEMBERS = f"(SELECT DISTINCT {key('entity_id')} AS e, {words('review_text')} AS w FROM {SAMPLE} WHERE {key('entity_id')} IS NOT NULL AND review_text IS NOT NULL AND {count(words('review_text'))} >= 4)"
TIES = f"(SELECT DISTINCT a.e AS a, b.e AS b FROM {MEMBERS} a JOIN {MEMBERS} b USING (w) WHERE a.e < b.e)"
