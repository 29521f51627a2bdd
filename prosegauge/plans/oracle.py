"""SQL for DuckDB that computes the named queries by other means: relational steps instead of array functions.

Its regular expressions have no look-around, so sentence chunks are cut by inserting marks, and syllable rules consume
what the column builders only look at.
"""

from __future__ import annotations

from ..functions import lexicons as lx

SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WORD = r"\p{L}[\p{L}\p{N}]*(?:[''’\-][\p{L}\p{N}]+)*|\p{N}+(?:[.,]\p{N}+)*"
CLOSERS, OPENERS = r"""["''’”)\]}»]""", r"""["''‘“(\[«]"""
MARK = "\uffff"


def among(c: str, words: list[str]) -> str:
    return f"{c} IN ({', '.join(repr(w) if chr(39) not in w else chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in words)})"


def half_up(x: str, places: int = 0) -> str:
    scale = f"{10**places}.0::DOUBLE"
    return f"(sign({x}) * floor(abs({x}) * {scale} + 0.5) / {scale} + 0.0::DOUBLE)"  # no negative zero


def div(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')"


def norm(x: str) -> str:
    return rf"regexp_replace(replace(lower({x}), '’', ''''), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}'']+$', '', 'g')"


NUMERAL = r"regexp_matches(word, '^\p{N}+(?:[.,]\p{N}+)*$')"

DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
TWICE = "d AS (SELECT doc_id, text || chr(10) || ' ' || chr(9) || chr(10) || chr(10) || text AS text FROM documents)"
HEDGING = "d AS (SELECT doc_id, replace(replace(replace(text, ' the ', ' very '), ' of ', ' Perhaps '), ' de ', ' quite ') AS text FROM documents)"
WORDS = f"w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS l FROM d))"
TOKENS = f"tk AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos FROM (SELECT doc_id, pos, {norm('word')} AS token FROM w) WHERE token <> '')"
PARAGRAPHS = rf"p AS (SELECT doc_id, unnest(l) AS para, generate_subscripts(l, 1) - 1 AS para_idx FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n+'), lambda x: {trim('x')}), lambda x: x <> '') AS l FROM d))"

_RAW = rf"regexp_replace(regexp_extract(body, '([\p{{L}}.]*)$', 1), '^\.+', '')"
_WORD = rf"lower(regexp_extract(follows, '^{OPENERS}*(\p{{L}}*)', 1))"
_DIGIT = rf"regexp_matches(follows, '^{OPENERS}*\p{{N}}')"
_ABBREVIATED = rf"""CASE WHEN {among('lower(raw)', lx.ABBREVIATIONS)} THEN true WHEN {among('lower(raw)', lx.BEFORE_NUMBER)} THEN digit
 WHEN {among('lower(raw)', lx.DATE_ABBREVIATIONS)} THEN digit OR {among('word', lx.DATE_WORDS)} WHEN {among('lower(raw)', lx.CAPITALIZED_ONLY)} THEN regexp_matches(raw, '^\p{{Lu}}')
 WHEN {among('lower(raw)', lx.LOWERCASE_ONLY)} THEN regexp_matches(raw, '^\p{{Ll}}') WHEN lower(raw) = 'al' THEN regexp_matches(body, '(?i)(?:^|\P{{L}})et +\.*al$') ELSE false END"""
SENTENCES = rf"""{PARAGRAPHS},
ch AS (SELECT doc_id, para_idx, unnest(l) AS chunk, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, para_idx, str_split(regexp_replace(para, '([.!?…]+{CLOSERS}*)([{SPACE}])', '\1{MARK}\2', 'g'), '{MARK}') AS l FROM p)),
pr AS (SELECT *, lead(chunk) OVER (PARTITION BY doc_id, para_idx ORDER BY i) AS after FROM ch),
pt AS (SELECT *, regexp_replace(after, '^[{SPACE}]+', '') AS follows, regexp_extract(chunk, '([.!?…]+)({CLOSERS}*)$', 1) AS run, regexp_extract(chunk, '([.!?…]+)({CLOSERS}*)$', 2) AS closed, regexp_replace(chunk, '([.!?…]+)({CLOSERS}*)$', '') AS body FROM pr),
rw AS (SELECT *, {_RAW} AS raw, {_WORD} AS word, {_DIGIT} AS digit, regexp_matches(follows, '^{OPENERS}*\p{{Lu}}\.') AS next_initial, regexp_matches(body, '(?:^|[{SPACE}("''‘“])\p{{Lu}}(?:\.\p{{Lu}})*$') AS initial FROM pt),
ed AS (SELECT doc_id, para_idx, i, chunk, CASE WHEN after IS NULL THEN false
 WHEN NOT regexp_matches(follows, '^[\p{{Lu}}\p{{N}}"''‘“(\[«—-]') THEN closed = '' AND regexp_matches(follows, '^\p{{Ll}}') AND regexp_matches(run, '^[?!]+$')
 WHEN run[1] <> '.' OR raw = '' THEN true
 ELSE NOT ((initial AND (next_initial OR (raw <> 'I' AND NOT {among('word', lx.SENTENCE_STARTERS)}))) OR {_ABBREVIATED}) END AS ends FROM rw),
gr AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, para_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM ed),
sn AS (SELECT doc_id, para_idx, g, {trim("string_agg(chunk, '' ORDER BY i)")} AS sentence FROM gr GROUP BY doc_id, para_idx, g),
s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, g) - 1 AS sent_idx, sentence FROM sn WHERE sentence <> '')"""
SENTENCE_WORDS = f"sw AS (SELECT doc_id, sent_idx, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, sent_idx, regexp_extract_all(sentence, '{WORD}') AS l FROM s)), sl AS (SELECT doc_id, sent_idx, sentence, len(regexp_extract_all(sentence, '{WORD}')) AS length FROM s)"


def syllables_of(table: str) -> str:
    """CTEs that end in sy (raw, syl) for all distinct strings in ``table`` (raw)."""
    known = ", ".join(f"('{k}', {v})" for k, v in lx.SYLLABLE_EXCEPTIONS.items())
    marked = "w"
    for pattern, by in ((r"([tcsx])io(n)", r"\1A\2"), (r"([tc])ia([ln])", r"\1A\2"), (r"([cst])iou", r"\1A"), (r"([gd])eou", r"\1A"), (r"([gd])iou", r"\1A"), (r"([tc])ie(nt)", r"\1A\2")):
        marked = f"regexp_replace({marked}, '{pattern}', '{by}', 'g')"
    broken = rf"regexp_replace({marked}, '(i)([aou])|(e)(o)|(u)([ao])|(a)(o)', '\1\3\5\7-\2\4\6\8', 'g')"
    groups = rf"len(regexp_extract_all(regexp_replace(regexp_replace({broken}, '^y', 'Y'), 'y([aeiou])', 'Y\1', 'g'), '[aeiouyA]+'))"
    return rf"""ex(raw, syl) AS (VALUES {known}),
s0 AS (SELECT DISTINCT raw, regexp_replace(raw, '([^aeiou])e((?:ment|ness|less|ful|ly|ty)s?)$', '\1\2') AS w FROM {table} WHERE raw <> ''),
s1 AS (SELECT raw, w, {groups} AS n FROM s0),
s2 AS (SELECT raw, w, n - CASE WHEN n > 1 AND ((regexp_matches(w, '[^aeiou]e$') AND (NOT regexp_matches(w, '[^aeiou][lr]e$') OR w LIKE '%lle'))
 OR (regexp_matches(w, '[^aeiou]es$') AND NOT regexp_matches(w, '([sxz]|ch|sh|ce|ge)es$') AND NOT regexp_matches(w, '[^aeiou][lr]es$'))
 OR (regexp_matches(w, '[^aeiou]ed$') AND NOT regexp_matches(w, '[td]ed$') AND NOT regexp_matches(w, '[^aeiou][lr]ed$'))) THEN 1 ELSE 0 END
 + CASE WHEN regexp_matches(w, '[^aeiou]ism$') OR w LIKE '%thm' THEN 1 ELSE 0 END AS n FROM s1),
sy AS (SELECT s2.raw, coalesce(ex.syl, greatest(1, n)) AS syl FROM s2 LEFT JOIN ex ON s2.raw = ex.raw)"""


SYLLABLES = rf"""dw AS (SELECT word, regexp_replace(lower(word), '[^a-z]', '', 'g') AS raw FROM (SELECT DISTINCT word FROM w)),
b0 AS (SELECT DISTINCT raw, regexp_extract(raw, '^(.{{2,}})(ing|ed|es)$', 1) AS base, raw[-1] AS last FROM dw WHERE regexp_matches(raw, '^(.{{2,}})(ing|ed|es)$')),
st AS (SELECT raw, base AS stem FROM b0 UNION SELECT raw, base || 'e' FROM b0 UNION SELECT raw, base[:-2] FROM b0 WHERE base[-1] = base[-2] AND regexp_matches(base, '[^aeiou]$')
 UNION SELECT raw, base[:-2] || 'y' FROM b0 WHERE base LIKE '%i' UNION SELECT raw, raw[:-2] FROM b0 WHERE raw LIKE '%es'),
un AS (SELECT raw FROM dw UNION SELECT stem FROM st),
{syllables_of('un')},
cx AS (SELECT DISTINCT st.raw FROM st JOIN sy a ON a.raw = st.raw JOIN sy b ON b.raw = st.stem WHERE b.syl <= 2 AND a.syl - b.syl <= 1),
wf AS (SELECT dw.word, coalesce(sy.syl, 0) AS syl, coalesce(sy.syl, 0) >= 3 AND dw.raw NOT IN (SELECT raw FROM cx) AS complex FROM dw LEFT JOIN sy ON dw.raw = sy.raw)"""

INPUTS = rf"""{DOCS}, {WORDS}, {SENTENCES}, {SYLLABLES},
a AS (SELECT doc_id, count(*) AS words, count(*) FILTER ({NUMERAL}) AS numerals FROM w GROUP BY doc_id),
b AS (SELECT doc_id, sum(syl) AS syllables, count(*) FILTER (syl >= 3) AS polysyllables, count(*) FILTER (syl = 1) AS monosyllables, count(*) FILTER (complex) AS complex_words FROM w JOIN wf USING (word) WHERE NOT {NUMERAL} GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS sentences FROM s GROUP BY doc_id),
i AS (SELECT d.doc_id, coalesce(words, 0)::BIGINT AS words, coalesce(sentences, 0)::BIGINT AS sentences, coalesce(numerals, 0)::BIGINT AS numerals, (coalesce(words, 0) - coalesce(numerals, 0))::BIGINT AS alphabetic_words,
 len(regexp_extract_all(text, '\p{{L}}'))::BIGINT AS letters, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]'))::BIGINT AS characters, coalesce(syllables, 0)::BIGINT AS syllables, coalesce(polysyllables, 0)::BIGINT AS polysyllables, coalesce(monosyllables, 0)::BIGINT AS monosyllables, coalesce(complex_words, 0)::BIGINT AS complex_words
 FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id))"""

_WPS, _SPW = div("words", "sentences"), div("syllables", "alphabetic_words")
FORMULAS = {
    "flesch_reading_ease": f"206.835::DOUBLE - 1.015::DOUBLE * {_WPS} - 84.6::DOUBLE * {_SPW}",
    "flesch_kincaid": f"0.39::DOUBLE * {_WPS} + 11.8::DOUBLE * {_SPW} - 15.59::DOUBLE",
    "gunning_fog": f"0.4::DOUBLE * ({_WPS} + {div('complex_words', 'alphabetic_words')} * 100)",
    "smog": f"1.0430::DOUBLE * sqrt(polysyllables * {div('30', 'sentences')}) + 3.1291::DOUBLE",
    "coleman_liau": f"0.0588::DOUBLE * ({div('letters', 'alphabetic_words')} * 100) - 0.296::DOUBLE * ({div('sentences', 'words')} * 100) - 15.8::DOUBLE",
    "ari": f"4.71::DOUBLE * {div('characters', 'words')} + 0.5::DOUBLE * {_WPS} - 21.43::DOUBLE",
}
USABLE = "words > 0 AND sentences > 0 AND alphabetic_words > 0"
METRIC_IDS = {"flesch_reading_ease": "flesch-reading-ease", "flesch_kincaid": "flesch-kincaid-grade", "gunning_fog": "gunning-fog", "smog": "smog", "coleman_liau": "coleman-liau", "ari": "automated-readability-index"}
FREQUENCIES = f"{DOCS}, {WORDS}, {TOKENS}, fq AS (SELECT doc_id, token AS word, count(*) AS n FROM tk GROUP BY ALL)"
RANKED = f"{FREQUENCIES}, rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word COLLATE en, word) AS rank FROM fq)"


def fit(points: str, keys: str = "doc_id") -> str:
    """A CTE ft (keys, n, slope, intercept, r2) of least squares over ``points`` (keys, x, y)."""
    return f"""ag AS (SELECT {keys}, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM {points} GROUP BY {keys}),
ft AS (SELECT {keys}, n, CASE WHEN n < 2 OR sxx = 0 THEN 0 ELSE sxy / sxx END AS slope, CASE WHEN n < 2 THEN 0 ELSE my - (CASE WHEN sxx = 0 THEN 0 ELSE sxy / sxx END) * mx END AS intercept, CASE WHEN n < 2 OR syy = 0 OR sxx = 0 THEN 0 ELSE sxy * sxy / (sxx * syy) END AS r2 FROM ag)"""


HEAPS = f"""{DOCS}, {WORDS}, {TOKENS}, hf AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS total, (row_number() OVER (PARTITION BY doc_id, token ORDER BY pos) = 1)::INT AS new FROM tk),
hv AS (SELECT doc_id, pos + 1 AS n, total, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS v FROM hf),
hc AS (SELECT doc_id, n, v FROM hv WHERE total >= 20 AND (n % greatest(1, total // 200) = 0 OR n = total))"""
LOW = f"{WORDS}, lw AS (SELECT doc_id, lower(word) AS word FROM w), al AS (SELECT doc_id, count(*) AS words FROM w GROUP BY doc_id)"
NOMINAL = f"(len(word) > 5 AND regexp_matches(word, '(tion|sion|ment|ance|ence|ity|ness|ancy|ency|ism|ure|al)s?$') AND NOT {among('word', lx.NOT_NOMINALISATIONS)})"
ADVERB = "(len(word) > 4 AND word LIKE '%ly')"
PASSIVES = rf"""{DOCS}, {SENTENCES}, {SENTENCE_WORDS},
pw AS (SELECT *, replace(lower(word), '’', '''') AS f FROM sw),
pn AS (SELECT *, lead(f, 1) OVER o AS f1, lead(f, 2) OVER o AS f2, lead(f, 3) OVER o AS f3, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3 FROM pw WINDOW o AS (PARTITION BY doc_id, sent_idx ORDER BY pos)),
pc AS (SELECT doc_id, sent_idx, pos, word, CASE WHEN NOT {among('f1', lx.INTERVENING)} THEN f1 WHEN NOT {among('f2', lx.INTERVENING)} THEN f2 WHEN NOT {among('f3', lx.INTERVENING)} THEN f3 END AS pf,
 CASE WHEN NOT {among('f1', lx.INTERVENING)} THEN w1 WHEN NOT {among('f2', lx.INTERVENING)} THEN w2 WHEN NOT {among('f3', lx.INTERVENING)} THEN w3 END AS pw FROM pn WHERE {among('f', lx.BE_FORMS)}),
ph AS (SELECT doc_id, sent_idx, pos, word, pw FROM pc WHERE {among('pf', lx.IRREGULAR_PARTICIPLES)} OR (pf LIKE '%ed' AND len(pf) > 3))"""


def percent(a: str, b: str) -> str:
    return f"coalesce({half_up(f'({div(a, b)} * 100)', 1)}, 0.0)"


def top_of(rule: str, docs: str = DOCS) -> str:
    return f"WITH {docs}, {LOW}, n AS (SELECT doc_id, word, count(*) AS n FROM lw WHERE {rule} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word COLLATE en, word) AS rank FROM n) SELECT doc_id, word, n::BIGINT AS count, rank::BIGINT AS rank FROM r WHERE rank <= 12"


def char_map(x: str, table: dict[str, str]) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return f"translate({x}, {quote(''.join(table))}, {quote(''.join(table.values()))})"


#: ``documents`` with signs and look-alikes put in, so that the stages of the normal form have something to do.
SPICED = "sp AS (SELECT doc_id, replace(replace(replace(replace(replace(coalesce(text, ''), 'ti', 't1'), 'on', 'о' || chr(8203) || 'n'), 'as', '@$'), 'in', 'ｉｎ'), 'er', 'e' || chr(769) || 'r') AS text FROM documents)"
TERMS = ("the", "ing", "tion", "of")


def word_matches(term: str) -> str:
    """Whole-word matches counted without look-around: words are parted, then compared."""
    return rf"len(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x = '{term}'))"


def _grade_median() -> str:
    grades = ", ".join(half_up(f"({f})", 1) for k, f in FORMULAS.items() if k != "flesch_reading_ease")
    return f"list_sort([{grades}])"


MTLD = f"""{DOCS}, {WORDS}, {TOKENS}, tl AS (SELECT doc_id, list(token ORDER BY pos) AS f, list(token ORDER BY pos DESC) AS b FROM tk GROUP BY doc_id)"""


def mtld_pass(tokens: str, threshold: str) -> str:
    """A fold with the state [factors, n] beside the open factor's tokens, which are a window of the list."""
    state = f"list_reduce(list_prepend({{'k': 0.0::DOUBLE, 'seen': []::VARCHAR[], 'n': 0, 't': ''}}, list_transform({tokens}, lambda x: {{'k': 0.0::DOUBLE, 'seen': []::VARCHAR[], 'n': 0, 't': x}})), lambda a, x: CASE WHEN len(CASE WHEN list_contains(a.seen, x.t) THEN a.seen ELSE list_append(a.seen, x.t) END)::DOUBLE / (a.n + 1) <= {threshold}::DOUBLE THEN {{'k': a.k + 1, 'seen': []::VARCHAR[], 'n': 0, 't': ''}} ELSE {{'k': a.k, 'seen': CASE WHEN list_contains(a.seen, x.t) THEN a.seen ELSE list_append(a.seen, x.t) END, 'n': a.n + 1, 't': ''}} END)"
    return state


def sql() -> dict[str, str]:
    """The SQL of each query, by the query's name."""
    out: dict[str, str] = {}
    out["sentences_of_paragraphs"] = f"WITH {TWICE}, {SENTENCES} SELECT doc_id, sent_idx::BIGINT AS sent_idx, sentence FROM s"
    out["paragraphs"] = f"WITH {TWICE}, {PARAGRAPHS} SELECT doc_id, para_idx::BIGINT AS para_idx, para AS paragraph FROM p"
    out["sentences"] = f"WITH {DOCS}, {SENTENCES} SELECT doc_id, sent_idx::BIGINT AS sent_idx, sentence FROM s"
    out["words"] = f"WITH {DOCS}, {WORDS} SELECT doc_id, pos::BIGINT AS pos, word FROM w"
    out["numerals"] = f"WITH {DOCS}, {WORDS} SELECT doc_id, pos::BIGINT AS pos, word FROM w WHERE {NUMERAL}"
    out["normalize_word"] = f"WITH {DOCS}, {WORDS}, {TOKENS} SELECT doc_id, pos::BIGINT AS pos, token FROM tk"
    out["types"] = f"WITH {DOCS}, {WORDS}, {TOKENS} SELECT doc_id, token, (row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) - 1)::BIGINT AS type_idx FROM tk GROUP BY doc_id, token"
    out["graphemes"] = f"WITH {DOCS} SELECT doc_id, length_grapheme(text)::BIGINT AS graphemes FROM d"
    out["letters"] = rf"WITH {DOCS} SELECT doc_id, len(regexp_extract_all(text, '\p{{L}}'))::BIGINT AS letters FROM d"
    out["chars_alnum"] = rf"WITH {DOCS} SELECT doc_id, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]'))::BIGINT AS chars_alnum FROM d"
    out["chars_no_space"] = f"WITH {DOCS} SELECT doc_id, (length_grapheme(text) - len(regexp_extract_all(text, '[{SPACE}]')))::BIGINT AS chars_no_space FROM d"
    out["reading_time"] = f"WITH {DOCS}, {WORDS} SELECT d.doc_id, {half_up('(count(word)::DOUBLE / 238)', 1)} AS reading_minutes, {half_up('(count(word)::DOUBLE / 183)', 1)} AS aloud_minutes FROM d LEFT JOIN w USING (doc_id) GROUP BY d.doc_id"
    out["counts"] = rf"""WITH {INPUTS}, q AS (SELECT doc_id, count(*) AS paragraphs FROM p GROUP BY doc_id), {TOKENS}, t AS (SELECT doc_id, count(DISTINCT token) AS types FROM tk GROUP BY doc_id)
SELECT i.doc_id, length_grapheme(text)::BIGINT AS characters, (length_grapheme(text) - len(regexp_extract_all(text, '[{SPACE}]')))::BIGINT AS characters_no_spaces, letters, words, numerals, sentences, coalesce(paragraphs, 0)::BIGINT AS paragraphs, coalesce(types, 0)::BIGINT AS types,
{half_up('(words::DOUBLE / 238)', 1)} AS reading_minutes, {half_up('(words::DOUBLE / 183)', 1)} AS aloud_minutes FROM i JOIN d USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN t USING (doc_id)"""
    out["segment"] = f"WITH {INPUTS}, q AS (SELECT doc_id, count(*) AS paragraphs FROM p GROUP BY doc_id), {TOKENS}, t AS (SELECT doc_id, count(DISTINCT token) AS types FROM tk GROUP BY doc_id) SELECT i.doc_id, words, numerals, sentences, letters, length_grapheme(text)::BIGINT AS graphemes, coalesce(paragraphs, 0)::BIGINT AS paragraphs, coalesce(types, 0)::BIGINT AS types FROM i JOIN d USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN t USING (doc_id)"
    out["syllables"] = f"WITH {DOCS}, {WORDS}, {SYLLABLES} SELECT word, syl::BIGINT AS syllables FROM wf"
    out["complex_word"] = f"WITH {DOCS}, {WORDS}, {SYLLABLES} SELECT word, complex FROM wf"
    for name in ("syllables_total", "polysyllables", "monosyllables", "complex_words"):
        out[name] = f"WITH {INPUTS} SELECT doc_id, {'syllables' if name == 'syllables_total' else name} AS {name} FROM i"
    for name, formula in FORMULAS.items():
        out[name] = f"WITH {INPUTS} SELECT doc_id, {half_up(f'({formula})', 1)} AS {name} FROM i WHERE {USABLE}"
    out["readability"] = f"WITH {INPUTS} " + " UNION ALL ".join(f"SELECT doc_id, '{METRIC_IDS[k]}' AS metric, {half_up(f'({f})', 1)} AS value FROM i WHERE {USABLE}" for k, f in FORMULAS.items())
    rate = lambda a, b, p, f="": f"CASE WHEN {USABLE} THEN {half_up(f'({div(a, b)}{f})', p)} END"
    out["readability_basis"] = f"""WITH {INPUTS} SELECT i.*, {half_up(_WPS, 2)} AS words_per_sentence, {rate('syllables', 'alphabetic_words', 3)} AS syllables_per_word, {rate('letters', 'alphabetic_words', 3)} AS letters_per_word,
{rate('polysyllables', 'alphabetic_words', 2, ' * 100')} AS percent_polysyllabic, {rate('complex_words', 'alphabetic_words', 2, ' * 100')} AS percent_complex, words = 0 OR sentences = 0 AS empty, words > 0 AND sentences > 0 AND alphabetic_words = 0 AS numerals_only FROM i"""
    grade = f"({FORMULAS['flesch_kincaid']})"
    shown = f"'US grade ' || {half_up(grade)}::BIGINT || "
    out["grade_text"] = f"WITH {INPUTS} SELECT doc_id, CASE WHEN {grade} < 1 THEN 'Below the first grade.' WHEN {grade} <= 6 THEN {shown}': plain prose.' WHEN {grade} <= 9 THEN {shown}': newspapers and general non-fiction.' WHEN {grade} <= 12 THEN {shown}': high school.' WHEN {grade} <= 16 THEN {shown}': undergraduate.' ELSE 'Beyond grade 16, where the formula was never fitted.' END AS grade_text FROM i WHERE {USABLE}"
    ease = f"({FORMULAS['flesch_reading_ease']})"
    bands = ((90, "Very easy."), (80, "Easy."), (70, "Fairly easy."), (60, "Plain English."), (50, "Fairly difficult."), (30, "Difficult."), (0, "Very difficult."))
    out["ease_text"] = f"WITH {INPUTS} SELECT doc_id, CASE {' '.join(f'WHEN {ease} >= {n} THEN {chr(39)}{s}{chr(39)}' for n, s in bands)} ELSE 'Below the scale.' END AS ease_text FROM i WHERE {USABLE}"
    short, note = "CASE WHEN words < 100 THEN 'Under 100 words: indicative only.' END", "CASE WHEN numerals > 0 THEN numerals || CASE WHEN numerals = 1 THEN ' numeral is a word' ELSE ' numerals are words' END || ' of a sentence but not measured themselves.' END"
    out["warnings"] = f"WITH {INPUTS} SELECT doc_id, nullif(concat_ws(' ', {short}, {note}), '') AS numeral_warning, CASE WHEN sentences < 30 THEN 'Defined for 30 sentences; this text has ' || sentences || '.' ELSE {short} END AS smog_warning, {short} AS short_warning FROM i WHERE {USABLE}"
    g = _grade_median()
    out["grade_consensus"] = f"WITH {INPUTS}, gg AS (SELECT doc_id, {g} AS g FROM i WHERE {USABLE}) SELECT doc_id, g[1] AS low, g[5] AS high, g[3] AS median, {half_up('(g[5] - g[1])', 1)} AS spread, CASE WHEN {half_up('(g[5] - g[1])', 1)} > 3 THEN 'disagree' ELSE 'agree' END AS note FROM gg"
    stats = f"{FREQUENCIES}, lx AS (SELECT doc_id, sum(n)::BIGINT AS tokens, count(*)::BIGINT AS types, count(*) FILTER (n = 1)::BIGINT AS hapax, count(*) FILTER (n = 2)::BIGINT AS dis_legomena FROM fq GROUP BY doc_id)"
    ratios = {"ttr": half_up(div("types", "tokens"), 3), "herdan_c": f"CASE WHEN tokens >= 2 AND types >= 2 THEN {half_up('(ln(types::DOUBLE) / ln(tokens::DOUBLE))', 3)} END", "hapax_ratio": half_up(div("hapax", "types"), 3)}
    out["lexical_profile"] = f"WITH {stats} SELECT doc_id, tokens, types, hapax, dis_legomena, {', '.join(f'{v} AS {k}' for k, v in ratios.items())} FROM lx"
    for name, column in (("ttr", "ttr"), ("herdan_c", "herdan_c")):
        out[name] = f"WITH {stats} SELECT doc_id, {ratios[column]} AS {column} FROM lx"
    out["hapax"] = f"WITH {stats} SELECT doc_id, hapax, {ratios['hapax_ratio']} AS hapax_ratio FROM lx"
    out["dis_legomena"] = f"WITH {stats} SELECT doc_id, dis_legomena FROM lx"
    out["frequencies"] = f"WITH {RANKED} SELECT doc_id, word, n::BIGINT AS count, rank::BIGINT AS rank FROM rk"
    out["top_words"] = f"WITH {RANKED} SELECT doc_id, word, n::BIGINT AS count, rank::BIGINT AS rank FROM rk WHERE rank <= 40"
    for name, k in (("mattr", 50), ("mattr_of_20", 20)):
        out[name] = f"""WITH {DOCS}, {WORDS}, {TOKENS}, sz AS (SELECT doc_id, count(*) AS n FROM tk GROUP BY doc_id), win AS (SELECT a.doc_id, a.pos AS p, count(DISTINCT b.token) AS v FROM tk a JOIN tk b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - {k - 1} AND a.pos WHERE a.pos >= {k - 1} GROUP BY a.doc_id, a.pos),
lg AS (SELECT doc_id, sum(v) AS s FROM win GROUP BY doc_id), sh AS (SELECT doc_id, count(DISTINCT token) AS v FROM tk GROUP BY doc_id), al AS (SELECT d.doc_id, coalesce(n, 0) AS n, v, s FROM d LEFT JOIN sz USING (doc_id) LEFT JOIN sh USING (doc_id) LEFT JOIN lg USING (doc_id))
SELECT doc_id, {half_up(f"(CASE WHEN n <= {k} THEN {div('v', 'n')} ELSE {div('s', f'{k} * (n - {k - 1})')} END)", 3)} AS value, CASE WHEN n = 0 THEN 0 WHEN n <= {k} THEN 1 ELSE n - {k - 1} END::BIGINT AS windows, CASE WHEN n BETWEEN 1 AND {k} THEN n ELSE {k} END::BIGINT AS "window",
CASE WHEN n = 0 THEN 'no words' WHEN n <= {k} THEN 'the plain ratio of a text no longer than the window' END AS note FROM al"""
    for name, threshold in (("mtld", "0.72"), ("mtld_at_half", "0.5")):
        left = f"(1 - {threshold}::DOUBLE)"
        passes = f"""WITH {MTLD}, ps AS (SELECT doc_id, len(f) AS n, {mtld_pass('f', threshold)} AS f, {mtld_pass('b', threshold)} AS b FROM tl),
fc AS (SELECT doc_id, n, f.k + CASE WHEN f.n > 0 THEN (1 - len(f.seen)::DOUBLE / f.n) / {left} ELSE 0 END AS kf, b.k + CASE WHEN b.n > 0 THEN (1 - len(b.seen)::DOUBLE / b.n) / {left} ELSE 0 END AS kb FROM ps),
v AS (SELECT d.doc_id, coalesce(n, 0) AS n, CASE WHEN kf <> 0 THEN n / kf END AS f, CASE WHEN kb <> 0 THEN n / kb END AS b FROM d LEFT JOIN fc USING (doc_id))"""
        both = "f IS NOT NULL AND b IS NOT NULL"
        shown = "" if name != "mtld" else f"{half_up('f', 1)} AS forward, {half_up('b', 1)} AS backward, "
        out[name] = f"{passes} SELECT doc_id, {shown}CASE WHEN {both} THEN {half_up('((f + b) / 2)', 1)} END AS value, CASE WHEN n = 0 THEN 'no words' WHEN NOT ({both}) THEN 'no factor was completed' WHEN n < 100 THEN 'unreliable under 100 words' END AS note FROM v"
    for name, used, least in (("zipf", "many < 5 OR n >= 2", "CASE WHEN many >= 5 THEN 2 ELSE 1 END"), ("zipf_of_50_ranks", "rank <= 50", "1"), ("zipf_of_any_series", "many < 5 OR n >= 2", "CASE WHEN many >= 5 THEN 2 ELSE 1 END")):
        out[name] = f"""WITH {RANKED}, mm AS (SELECT *, count(*) FILTER (n >= 2) OVER (PARTITION BY doc_id) AS many FROM rk), us AS (SELECT * FROM mm WHERE {used}), pts AS (SELECT doc_id, log10(rank) AS x, log10(n) AS y FROM us), {fit('pts')}, fx AS (SELECT doc_id, max(rank) AS top, max({least}) AS least FROM us GROUP BY doc_id)
SELECT doc_id, CASE WHEN n >= 5 THEN {half_up('(-slope)', 3)} END AS alpha, CASE WHEN n >= 5 THEN {half_up('intercept', 4)} END AS intercept, CASE WHEN n >= 5 THEN {half_up('r2', 3)} END AS r2, n::BIGINT AS fitted, top::BIGINT AS fit_max_rank, least::BIGINT AS fit_min_count,
CASE WHEN n < 5 THEN 'too few words' WHEN r2 < 0.7 THEN 'poor fit' WHEN slope > -0.7 OR slope < -1.5 THEN 'outside 0.7 to 1.5' ELSE 'within 0.7 to 1.5' END AS note FROM ft JOIN fx USING (doc_id)"""
    out["zipf_points"] = f"WITH {RANKED} SELECT doc_id, rank::BIGINT AS rank, {half_up('log10(rank)', 6)} AS x, {half_up('log10(n)', 6)} AS y FROM rk"
    out["linear_fit"] = f"WITH pts AS (SELECT source, length(text)::DOUBLE AS x, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS y FROM documents), {fit('pts', 'source')} SELECT source, n::BIGINT AS n, {half_up('slope', 6)} AS slope, {half_up('intercept', 3)} AS intercept, {half_up('r2', 6)} AS r2 FROM ft"
    out["heaps_curve"] = f"WITH {HEAPS} SELECT doc_id, n::BIGINT AS n, v::BIGINT AS v FROM hc"
    out["heaps"] = f"WITH {HEAPS}, pts AS (SELECT doc_id, log10(n) AS x, log10(v) AS y FROM hc WHERE n >= 10), {fit('pts')} SELECT doc_id, n::BIGINT AS points, CASE WHEN n >= 5 THEN {half_up('slope', 3)} END AS beta, CASE WHEN n >= 5 THEN {half_up('pow(10::DOUBLE, intercept)', 3)} END AS k, CASE WHEN n >= 5 THEN {half_up('r2', 3)} END AS r2, CASE WHEN n < 5 THEN 'too few words' WHEN slope BETWEEN 0.35 AND 0.75 THEN 'usual for prose' ELSE 'not usual for prose' END AS note FROM ft"
    out["passive_hits"] = f"WITH {PASSIVES} SELECT doc_id, sent_idx::BIGINT AS sent_idx, pos::BIGINT AS \"index\", word AS auxiliary, pw AS participle FROM ph"
    out["passive"] = f"WITH {PASSIVES}, hs AS (SELECT doc_id, count(DISTINCT sent_idx) AS sentences, count(*) AS total FROM ph GROUP BY doc_id), ns AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id) SELECT d.doc_id, coalesce(sentences, 0)::BIGINT AS sentences, coalesce(total, 0)::BIGINT AS total, {percent('coalesce(sentences, 0)', 'n')} AS share_of_sentences, least(8, coalesce(sentences, 0))::BIGINT AS examples FROM d LEFT JOIN hs USING (doc_id) LEFT JOIN ns USING (doc_id)"
    out["passive_examples"] = f"""WITH {PASSIVES}, nr AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY sent_idx) - 1 AS example FROM ph)
SELECT doc_id, example::BIGINT AS example, sentence, pos::BIGINT AS "index", word AS auxiliary, pw AS participle FROM nr JOIN s USING (doc_id, sent_idx) WHERE example < 8"""
    hedge = among("word", lx.HEDGES)
    for name, rule, docs in (("nominalisations", NOMINAL, DOCS), ("hedges", hedge, HEDGING), ("adverbs", ADVERB, DOCS)):
        out[name] = f"WITH {docs}, {LOW}, hit AS (SELECT doc_id, count(*) AS n FROM lw WHERE {rule} GROUP BY doc_id) SELECT d.doc_id, coalesce(n, 0)::BIGINT AS {name}, {percent('coalesce(n, 0)', 'words')} AS {name}_percent FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN al USING (doc_id)"
    out["top_nominalisations"], out["top_hedges"] = top_of(NOMINAL), top_of(hedge, HEDGING)
    out["rhythm"] = f"""WITH {DOCS}, {SENTENCES}, {SENTENCE_WORDS}, li AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) - 1 AS k FROM sl WHERE length > 0),
rh AS (SELECT doc_id, count(*) AS n, avg(length) AS m, median(length) AS md, stddev_pop(length) AS sd, min(length) AS lo, max(length) AS hi, min_by(k, (-length, k)) AS longest FROM li GROUP BY doc_id)
SELECT rh.doc_id, n::BIGINT AS count, {half_up('m', 1)} AS mean, md::DOUBLE AS median, {half_up('sd', 1)} AS sd, lo::BIGINT AS min, hi::BIGINT AS max, longest::BIGINT AS longest_index, s.sentence AS longest_sentence, CASE WHEN n < 4 THEN 'few sentences' WHEN sd < 4 THEN 'uniform' WHEN sd > 14 THEN 'varied' ELSE 'normal' END AS note FROM rh JOIN s ON s.doc_id = rh.doc_id AND s.sent_idx = rh.longest"""
    out["rhythm_histogram"] = f"""WITH {DOCS}, {SENTENCES}, {SENTENCE_WORDS}, lb AS (SELECT doc_id, length, greatest(1, ceil(max(length) OVER (PARTITION BY doc_id) / 14.0))::BIGINT AS size FROM sl WHERE length > 0),
bn AS (SELECT doc_id, size, length // size AS bin, count(*) AS n FROM lb GROUP BY ALL), fr AS (SELECT doc_id, size, unnest(range(max(bin) + 1)) AS bin FROM bn GROUP BY doc_id, size)
SELECT doc_id, bin::BIGINT AS bin, (bin * size)::BIGINT AS low, ((bin + 1) * size - 1)::BIGINT AS high, coalesce(n, 0)::BIGINT AS sentences FROM fr LEFT JOIN bn USING (doc_id, size, bin)"""
    out["norm_invisible"] = rf"WITH {SPICED} SELECT doc_id, regexp_replace(text, '[\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{2064}}\x{{FEFF}}\x{{00AD}}]', '', 'g') AS text FROM sp"
    out["norm_confusables"] = f"WITH {SPICED} SELECT doc_id, {char_map('text', lx.CONFUSABLES)} AS text FROM sp"
    out["norm_lower"] = f"WITH {SPICED} SELECT doc_id, lower(text) AS text FROM sp"
    out["norm_diacritics"] = "SELECT doc_id, strip_accents(lower(text)) AS text FROM documents"
    out["norm_leet"] = f"WITH {SPICED} SELECT doc_id, {char_map('text', lx.LEET)} AS text FROM sp"
    counted = lambda f: " UNION ALL ".join(f"SELECT doc_id, '{x}' AS term, {f(x)}::BIGINT AS matches FROM documents" for x in TERMS)
    out["screen_substring"] = counted(lambda x: f"(length(text) - length(replace(lower(text), '{x}', ''))) // {len(x)}")
    out["screen_word"] = counted(word_matches)
    pairs = [(t, w) for t, some in lx.COLLATERAL.items() for w in some]
    out["collateral"] = "WITH c(term, word) AS (VALUES " + ", ".join(f"('{t}', '{w}')" for t, w in pairs) + ") SELECT term, word, contains(lower(word), term) AS contained FROM c"
    out["demo_terms"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{t}')" for i, t in enumerate(lx.DEMO_TERMS)) + ") AS v(idx, term)"
    out["terms_parse"] = f"WITH l AS (SELECT doc_id, regexp_split_to_array(text, '[,{SPACE}]+') AS l FROM documents) SELECT doc_id, len(list_filter(l, lambda x: x <> ''))::BIGINT AS terms, list_filter(l, lambda x: x <> '')[1] AS first_term FROM l"
    out["every_kth"] = "SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark) WHERE i % 7 = 0"
    return out
