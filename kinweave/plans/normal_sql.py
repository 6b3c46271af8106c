"""SQL for transliteration and normal forms, written apart from the column expressions it is held against.

The scripts of India share the layout of one block, so a letter's place in its block tells its sound whatever the script. Names and
addresses are taken apart into lists; where the SQL engine has no lookaround, a step runs until neighbours no longer overlap.
"""

from __future__ import annotations

from ..functions import rules
from ..functions.transliterate import EXPLICIT

# Places in a block of 128 and the Latin letters for them; other places have none.
PLACES = {
    "m": "01 02", "a": "05 06 3E", "i": "07 08 3F 40", "u": "09 0A 41 42", "r": "0B 30 31 43", "e": "0D 0E 0F 45 46 47", "ai": "10 48", "o": "11 12 13 49 4A 4B", "au": "14 4C",
    "k": "15", "kh": "16", "g": "17", "gh": "18", "n": "19 1E 23 28 29", "c": "1A", "ch": "1B", "j": "1C", "jh": "1D", "t": "1F 24", "th": "20 25", "d": "21 26", "dh": "22 27",
    "p": "2A", "ph": "2B", "b": "2C", "bh": "2D", "m ": "2E", "y": "2F", "l": "32 33 34", "v": "35", "s": "36 37 38", "h": "39", "'": "3C",
}
INDIC = {int(at, 16): to.strip() for to, places in PLACES.items() for at in places.split()} | {0x66 + d: str(d) for d in range(10)}
WIDE = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "\u00a0": " ", "\u2002": " ", "\u2003": " ", "\u2007": " ", "\u2009": " ", "\u200a": " ", "\u202f": " ", "\u3000": " ", "\u2005": " ", "\u2004": " ", "\u2006": " ", "\u2008": " ", "\u205f": " "}


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mapping(d: dict) -> str:
    keys = ", ".join(quote(k) if isinstance(k, str) else str(k) for k in d)
    return f"map([{keys}], [{', '.join(quote(v) for v in d.values())}])"


def latin_sql(x: str) -> str:
    """``x`` in ASCII."""
    n = "unicode(c)"
    one = (
        f"CASE WHEN {n} < 128 THEN c WHEN {n} BETWEEN 2304 AND 3455 THEN coalesce(indic[({n} - 2304) % 128], '') WHEN special[c] IS NOT NULL THEN special[c] "
        f"WHEN {n} BETWEEN 65281 AND 65374 THEN chr(({n} - 65248)::INT) WHEN regexp_full_match(strip_accents(c), '[ -~]') THEN strip_accents(c) ELSE '' END"
    )
    return f"array_to_string(list_transform(list_transform(range(1, length({x}) + 1), lambda i: substring({x}, i, 1)), lambda c: {one}), '')"


def latin_cte(name: str, of: str) -> str:
    tables = f"(SELECT {mapping(INDIC)} AS indic, {mapping(EXPLICIT | WIDE)} AS special)"
    return f"{name} AS (SELECT entity_id, {latin_sql('business_name')} AS business_name, {latin_sql('business_address')} AS business_address, country FROM {of}, {tables} AS tables)"


def _again(pattern: str, to: str, x: str, times: int) -> str:
    for _ in range(times):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


def _words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def _by_country(general: dict, **special: dict) -> str:
    cases = " ".join(f"WHEN country = '{c}' THEN {mapping(general | more)}" for c, more in special.items())
    return f"CASE {cases} ELSE {mapping(general)} END"


def names_sql(name: str, of: str) -> str:
    """CTEs that end in ``name``, with ``entity_id, country, business_address, name_norm, legal_form``."""
    s = "regexp_replace(lower(business_name), '[^a-z0-9&+./ ]+', ' ', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '^www[.]', ' '), '[.](?:com|net|org|co[.]in|in|fr)\\b', ' ', 'g')"
    s = f"regexp_replace({s}, '\\bpra(?:[.] *| +)li\\b', ' pvt ltd ', 'g')"
    s = _again("(^|[^a-z0-9])([a-z])[.]([a-z])([^a-z]|$)", "\\1\\2~\\3\\4", s, 8)  # a mark where initials are joined
    s = f"replace(regexp_replace({s}, '~([a-z])[.]([0-9])', '~\\1\\2', 'g'), '~', '')"
    parts = f"list_filter(string_split_regex(replace({s}, '.', ' '), '\\b(?:dba|d/b/a|trading as|t/a)\\b'), lambda p: regexp_matches(p, '[a-z0-9]'))"
    t = _again("([a-z])1([a-z])", "\\1l\\2", _again("([a-z])0([a-z])", "\\1o\\2", "coalesce(part, '')", 2), 2)
    t = f"regexp_replace(replace(replace({t}, '&', ' and '), '+', ' and '), '[^a-z0-9]+', ' ', 'g')"
    join = lambda x: f"coalesce(array_to_string({x}, ' '), '')"
    core = join("list_filter(w, lambda x: legal[x] IS NULL)")
    core = f"regexp_replace(regexp_replace({core}, '^(and( |$))+', ''), '(^| )and( and)*$', '')"
    return (
        f"{name}_a AS (SELECT *, {parts}[-1] AS part, {_by_country(rules.NAME_WORDS, France=rules.NAME_WORDS_FRANCE)} AS known, {_by_country(rules.LEGAL, France=rules.LEGAL_FRANCE)} AS legal FROM {of}), "
        f"{name}_b AS (SELECT *, list_transform({_words(t)}, lambda x: coalesce(known[x], x)) AS w FROM {name}_a), "
        f"{name}_c AS (SELECT *, {core} AS core, {join('list_sort(list_distinct(list_transform(list_filter(w, lambda x: legal[x] IS NOT NULL), lambda x: legal[x])))')} AS legal_form FROM {name}_b), "
        f"{name} AS (SELECT entity_id, country, business_address, CASE WHEN core = '' AND legal_form <> '' THEN {join('list_transform(w, lambda x: coalesce(legal[x], x))')} ELSE core END AS name_norm, legal_form FROM {name}_c)"
    )


def addresses_sql(name: str, of: str) -> str:
    """CTEs that end in ``name``, with ``entity_id, country, name_norm, legal_form, address_norm``; ``of`` keeps one row an id."""
    listed = lambda words: "(" + ", ".join(map(quote, words)) + ")"
    p = _again("(^|[^0-9])[-/]", "\\1 ", _again("[-/]([^0-9]|$)", " \\1", "part", 2), 2)
    p = f"regexp_replace(regexp_replace({p}, '[^a-z0-9/-]+', ' ', 'g'), '\\bndeg([0-9 ]|$)', 'no \\1', 'g')"
    street = f"(n IS NULL OR n IN {listed(rules.AFTER_STREET)} OR regexp_matches(n, '^[0-9]') OR length(n) = 1)"
    full = f"CASE WHEN t = 'st' THEN CASE WHEN {street} THEN 'street' ELSE 'saint' END WHEN t = 'ste' THEN CASE WHEN {street} THEN %s ELSE 'sainte' END WHEN regexp_full_match(t, '[0-9]+') THEN CASE WHEN ltrim(t, '0') = '' THEN '0' ELSE ltrim(t, '0') END ELSE coalesce(streets[t], t) END"
    short = f"CASE WHEN t IN {listed(rules.DROPPED)} THEN NULL ELSE {full % 'NULL'} END"
    whole = "string_agg({x}, ' ' ORDER BY i)"
    return (
        f"{name}_p AS (SELECT entity_id, country, nr, {_words(p)} AS ws FROM (SELECT entity_id, country, unnest(string_split(lower(business_address), ',')) AS part, generate_subscripts(string_split(lower(business_address), ','), 1) AS nr FROM {of})), "
        f"{name}_t AS (SELECT entity_id, country, nr, array_to_string(ws, ' ') AS raw, unnest(ws) AS t, unnest(list_append(ws[2:], NULL)) AS n, generate_subscripts(ws, 1) AS i FROM {name}_p), "
        f"{name}_u AS (SELECT *, {_by_country(rules.STREETS, France=rules.STREETS_FRANCE, India=rules.STREETS_INDIA)} AS streets FROM {name}_t), "
        f"{name}_v AS (SELECT entity_id, nr, raw, i, {short} AS short, {full % quote('suite')} AS longer FROM {name}_u), "
        f"{name}_w AS (SELECT entity_id, nr, raw, coalesce({whole.format(x='short')}, '') AS short, {whole.format(x='longer')} AS longer FROM {name}_v GROUP BY 1, 2, 3), "
        f"{name}_x AS (SELECT *, regexp_replace(short, '^(?:(?:city|town|village) )?of ([^ ])', '\\1') AS bare, {mapping(rules.STATES)} AS states FROM {name}_w), "
        f"{name}_y AS (SELECT entity_id, nr, coalesce(states[raw], CASE WHEN raw IN {listed(rules.STATE_CODES)} THEN raw END, CASE WHEN states[bare] IS NOT NULL THEN longer ELSE bare END) AS c FROM {name}_x), "
        f"{name}_z AS (SELECT entity_id, c, min(nr) AS nr FROM {name}_y WHERE c <> '' AND c NOT IN {listed(rules.NULL_PARTS)} GROUP BY 1, 2), "
        f"{name}_s AS (SELECT entity_id, string_agg(c, ', ' ORDER BY nr) AS address_norm FROM {name}_z GROUP BY 1), "
        f"{name} AS (SELECT entity_id, country, name_norm, legal_form, coalesce(address_norm, '') AS address_norm FROM {of} LEFT JOIN {name}_s USING (entity_id))"
    )
