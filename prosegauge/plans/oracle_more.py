"""SQL for DuckDB of the queries that put others together, and of screening: normal forms, matches, evasions, evaluations.

What the column builders find by looking around a match is found here by doubling every character that is no letter or
digit, so that neighbouring matches need not share one, or by locating matches between the pieces of a split text.
"""

from __future__ import annotations

from ..functions import lexicons as lx
from ..operators.citations import CITATIONS
from ..sources.samples import SAMPLES
from .oracle import DOCS, FORMULAS, INPUTS, METRIC_IDS, SENTENCES, SPACE, SPICED, TERMS, USABLE, WORD, WORDS, among, char_map, div, half_up, percent, sql, syllables_of, trim

MARK = "￿"
LN, NOT_LN, SEPARATOR = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]", rf"[{SPACE}._\-*+]"


def quoted(x: str | int | None) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def number(x: str) -> str:
    """As text, without a fraction of zero."""
    return rf"regexp_replace(printf('%.4f', ({x})::DOUBLE), '\.?0+$', '')"


# --- normal forms --------------------------------------------------------------------------------------------------


def invisible(x: str) -> str:
    return rf"regexp_replace({x}, '[\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{2064}}\x{{FEFF}}\x{{00AD}}]', '', 'g')"


def nfkc(x: str) -> str:
    """Full-width letters are the only compatibility characters in the texts; the rest is composition."""
    return f"nfc_normalize(translate({x}, 'ｉｎ', 'in'))"


def leet_inner(x: str) -> str:
    for sign, letter in lx.LEET.items():
        if not sign.isdigit():
            for _ in range(2):  # neighbours share a letter
                x = rf"regexp_replace({x}, '({LN})[{sign}]({LN})', '\1{letter}\2', 'g')"
    digits = {k: v for k, v in lx.LEET.items() if k.isdigit()}
    return char_map(x, digits)


def doubled(x: str) -> str:
    return rf"regexp_replace({x}, '({NOT_LN})', '\1\1', 'g')"


def joined(x: str) -> str:
    marked = rf"regexp_replace({doubled(x)}, '(^|{NOT_LN})((?:\p{{L}}{SEPARATOR}{SEPARATOR}){{2,}}\p{{L}})($|{NOT_LN})', '\1{MARK}\2{MARK}\3', 'g')"
    return rf"array_to_string(list_transform(str_split({marked}, '{MARK}'), lambda p, i: CASE WHEN i % 2 = 0 THEN regexp_replace(p, '{SEPARATOR}', '', 'g') ELSE regexp_replace(p, '({NOT_LN}){NOT_LN}', '\1', 'g') END), '')"


def collapsed(x: str, table: str) -> str:
    """Over all letters of ``table`` (text)."""
    letters = rf"(SELECT list(DISTINCT c) FROM (SELECT unnest(regexp_extract_all(text, '\p{{L}}')) AS c FROM {table}))"
    return f"list_reduce(list_prepend({x}, {letters}), lambda a, c: regexp_replace(a, c || '{{3,}}', c, 'g'))"


def stages(table: str, out: str, *, inner: bool, confusables: bool = True, leet: bool = True, collapse: bool = True) -> str:
    """CTEs from ``table`` (doc_id, text) to ``out``, whose ``text`` is the last stage and ``changed`` how many stages
    changed anything."""
    steps = [invisible, nfkc, *[lambda x: char_map(x, lx.CONFUSABLES)] * confusables, lambda x: f"lower({x})", lambda x: f"strip_accents({x})"]
    if leet:
        steps += [leet_inner if inner else lambda x: char_map(x, lx.LEET), joined]
    ctes, last = [f"{out}_0 AS MATERIALIZED (SELECT *, 0 AS changed FROM {table})"], f"{out}_0"
    for i, step in enumerate(steps, 1):
        ctes.append(f"{out}_{i} AS MATERIALIZED (SELECT * EXCLUDE (text, changed, new), new AS text, changed + (new <> text)::INT AS changed FROM (SELECT *, {step('text')} AS new FROM {last}))")
        last = f"{out}_{i}"
    if collapse:
        ctes.append(f"{out}_c AS MATERIALIZED (SELECT * EXCLUDE (text, changed, new), new AS text, changed + (new <> text)::INT AS changed FROM (SELECT *, {collapsed('text', last)} AS new FROM {last}))")
        last = f"{out}_c"
    return ", ".join([*ctes, f"{out} AS (SELECT * FROM {last})"])


def tolerant(term: str) -> str:
    """The term with longer runs of letters, or of signs that stand for them."""
    signs: dict[str, str] = {}
    for sign, letter in lx.LEET.items():
        if not sign.isdigit():
            signs[letter] = signs.get(letter, "") + sign
    out, i = "", 0
    while i < len(term):
        k = len(term[i:]) - len(term[i:].lstrip(term[i]))
        out += f"[{term[i]}{signs.get(term[i], '')}]{{{k},}}"
        i += k
    return out


def bounded(x: str, pattern: str) -> str:
    """How often ``pattern`` stands in the lower-cased text between characters that are no letters or digits."""
    return f"len(regexp_extract_all({doubled(f'lower({x})')}, '(^|{NOT_LN})({pattern})($|{NOT_LN})'))"


def substring_matches(table: str, terms: tuple[str, ...], out: str) -> str:
    """CTEs that end in ``out`` (doc_id, text, term, order, index, length, whole_word): where terms stand in lower-cased texts."""
    listed = ", ".join(f"({i}, '{x}')" for i, x in enumerate(terms))
    return f"""{out}_t("order", term) AS (VALUES {listed}),
{out}_p AS (SELECT doc_id, text, term, "order", unnest(str_split(lower(text), term)) AS part, generate_subscripts(str_split(lower(text), term), 1) AS k, len(str_split(lower(text), term)) AS parts FROM {table}, {out}_t),
{out}_i AS (SELECT *, (sum(len(part)) OVER (PARTITION BY doc_id, "order" ORDER BY k) + (k - 1) * len(term))::BIGINT AS "index" FROM {out}_p),
{out} AS (SELECT doc_id, text, term, "order", "index", len(term) AS length, NOT (regexp_matches(CASE WHEN "index" > 0 THEN substring(lower(text), "index", 1) ELSE '' END, '{LN}') OR regexp_matches(substring(lower(text), "index" + len(term) + 1, 1), '{LN}')) AS whole_word FROM {out}_i WHERE k < parts)"""


CONTEXT = 'substring(text, greatest(0, "index" - 24) + 1, "index" + length + 24 - greatest(0, "index" - 24))'
PLAIN = "pl AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def evasion_ctes() -> str:
    """CTEs that end in ev (term, technique, text, family)."""
    terms = ", ".join(f"('{x}')" for x in lx.DEMO_TERMS)
    second = "coalesce(c[2], '')"
    filler = f"CASE WHEN 'x' NOT IN ({second}, coalesce(c[3], '')) THEN 'x' WHEN 'z' NOT IN ({second}, coalesce(c[3], '')) THEN 'z' ELSE 'q' END"
    swapped = "CASE WHEN spot IS NULL THEN term ELSE array_to_string(c[:spot] || [c[spot + 2], c[spot + 1]] || c[spot + 3:], '') END"
    made = {
        "leetspeak": char_map("term", lx.LEET_FOR), "Cyrillic homoglyphs": char_map("term", lx.HOMOGLYPH_FOR), "internal spacing": "array_to_string(c, ' ')", "punctuation infix": "array_to_string(c, '.')",
        "zero-width joiner": "array_to_string(c, chr(8203))", "repeated letters": "c[1] || repeat(c[2], 3) || array_to_string(c[3:], '')", "diacritics": char_map("term", lx.ACCENT_FOR),
        "adjacent swap": swapped, "inserted letter": f"c[1] || c[2] || {filler} || array_to_string(c[3:], '')", "unlisted homoglyphs": char_map("term", lx.UNLISTED_LOOKALIKES),
    }
    rows = " UNION ALL ".join(f"SELECT term, '{k}' AS technique, {v} AS text, '{'independent' if k in ('adjacent swap', 'inserted letter', 'unlisted homoglyphs') else 'designed-for'}' AS family FROM pt" for k, v in made.items())
    return f"""tm(term) AS (VALUES {terms}), ch AS (SELECT term, list_filter(str_split(term, ''), lambda x: x <> '') AS c FROM tm),
pc AS (SELECT *, list_filter(range(0, len(c) - 1), lambda i: c[i + 1] <> c[i + 2]) AS places FROM ch), pt AS (SELECT *, coalesce(list_filter(places, lambda i: i >= 1)[1], places[1]) AS spot FROM pc),
ev AS (SELECT * FROM ({rows}) WHERE text <> term)"""


def report_ctes() -> str:
    """CTEs that end in rp: evasions and whether they are caught in a sentence."""
    either = lambda f: "CASE " + " ".join(f"WHEN term = '{x}' THEN regexp_matches(lower(text), '(^|{NOT_LN}){f(x)}($|{NOT_LN})')" for x in lx.DEMO_TERMS) + " END"
    carried = "cr AS (SELECT row_number() OVER () AS doc_id, term, technique, text AS made, family, 'you are ' || text || ' today' AS text FROM ev)"
    return f"{evasion_ctes()}, {carried}, {stages('cr', 'nf', inner=True, collapse=False)}, rp AS (SELECT term, technique, cr.made AS text, family, {either(lambda x: x).replace('term =', 'cr.term =').replace('lower(text)', 'lower(cr.text)')} AS word, {either(tolerant).replace('term =', 'cr.term =').replace('lower(text)', 'lower(nf.text)')} AS normalized FROM cr JOIN nf USING (doc_id, term, technique, made, family))"


# --- readability ---------------------------------------------------------------------------------------------------


def terms_of(metric: str) -> tuple[list[tuple[str, str, str]], str]:
    """(label, value, detail) of each input and the formula with the numbers put in."""
    whole = lambda a, b, more="": f"{a} || ' / ' || {b} || '{more}'"
    wps, spw = half_up(div("words", "sentences"), 2), half_up(div("syllables", "alphabetic_words"), 3)
    a, b = ("words per sentence", wps, whole("words", "sentences")), ("syllables per word", spw, whole("syllables", "alphabetic_words"))
    if metric == "flesch_reading_ease":
        return [a, b], f"'206.835 − 1.015 × ' || {number(wps)} || ' − 84.6 × ' || {number(spw)}"
    if metric == "flesch_kincaid":
        return [a, b], f"'0.39 × ' || {number(wps)} || ' + 11.8 × ' || {number(spw)} || ' − 15.59'"
    if metric == "gunning_fog":
        share = half_up(f"({div('complex_words', 'alphabetic_words')} * 100)", 2)
        return [a, ("% complex words", share, whole("complex_words", "alphabetic_words"))], f"'0.4 × (' || {number(wps)} || ' + ' || {number(share)} || ')'"
    if metric == "smog":
        return [("polysyllabic words", "polysyllables", "NULL"), ("sentences", "sentences", "NULL")], "'1.0430 × √(' || polysyllables || ' × 30/' || sentences || ') + 3.1291'"
    if metric == "coleman_liau":
        letters, per = half_up(f"({div('letters', 'alphabetic_words')} * 100)", 2), half_up(f"({div('sentences', 'words')} * 100)", 2)
        return [("letters per 100 words", letters, whole("letters", "alphabetic_words", " × 100")), ("sentences per 100 words", per, whole("sentences", "words", " × 100"))], f"'0.0588 × ' || {number(letters)} || ' − 0.296 × ' || {number(per)} || ' − 15.8'"
    cpw = half_up(div("characters", "words"), 3)
    return [("characters per word", cpw, whole("characters", "words")), a], f"'4.71 × ' || {number(cpw)} || ' + 0.5 × ' || {number(wps)} || ' − 21.43'"


def citation_values() -> str:
    return "ci(id, authors, year, title, source, locator, url, verified) AS (VALUES " + ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in CITATIONS) + ")"


LINE = "concat_ws(', ', authors || ' (' || year || '). ' || title || '.', source, locator) || '.'"


def more_sql() -> dict[str, str]:
    """The SQL of each query of this module, by the query's name."""
    known, out = sql(), {}
    part = lambda name: f"({known[name]})"
    # readability, style and whole analyses
    rows = []
    for metric in FORMULAS:
        terms, said = terms_of(metric)
        rows += [f"SELECT doc_id, '{METRIC_IDS[metric]}' AS metric, {said} AS substituted, '{label}' AS label, ({value})::DOUBLE AS value, ({detail})::VARCHAR AS detail FROM i WHERE {USABLE}" for label, value, detail in terms]
    out["readability_terms"] = f"WITH {INPUTS} " + " UNION ALL ".join(rows)
    hedges = f"(WITH {DOCS}, {WORDS}, hw AS (SELECT doc_id, count(*) FILTER ({among('lower(word)', lx.HEDGES)}) AS n, count(*) AS words FROM w GROUP BY doc_id) SELECT d.doc_id, coalesce(n, 0)::BIGINT AS hedges, {percent('coalesce(n, 0)', 'words')} AS hedges_percent FROM d LEFT JOIN hw USING (doc_id))"
    out["style_profile"] = f"""SELECT c.doc_id, c.words, n.nominalisations, n.nominalisations_percent, h.hedges, h.hedges_percent, a.adverbs, a.adverbs_percent, p.sentences, p.total, p.share_of_sentences, coalesce(r.count, 0)::BIGINT AS worded_sentences, r.mean, r.median, r.sd, r.min, r.max, r.longest_index, r.longest_sentence, r.note, coalesce(t.top, '') AS top_nominalisations
FROM {part('counts')} c JOIN {part('nominalisations')} n USING (doc_id) JOIN {hedges} h USING (doc_id) JOIN {part('adverbs')} a USING (doc_id) JOIN {part('passive')} p USING (doc_id) LEFT JOIN {part('rhythm')} r USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(word || ':' || count, ' ' ORDER BY rank) AS top FROM {part('top_nominalisations')} GROUP BY doc_id) t USING (doc_id)"""
    found = f"(SELECT doc_id, {' + '.join(bounded('text', x) for x in TERMS)} AS n FROM (WITH {PLAIN} SELECT * FROM pl))"
    out["analyze_profile"] = f"""SELECT c.doc_id, c.words = 0 AS empty, c.words, c.sentences, e.flesch_reading_ease AS reading_ease, g.median, l.ttr, m.value AS mattr, k.value AS mtld, z.alpha, h.beta, p.total AS passives, r.sd AS rhythm_sd, w.n::BIGINT AS word_matches
FROM {part('counts')} c LEFT JOIN {part('flesch_reading_ease')} e USING (doc_id) LEFT JOIN {part('grade_consensus')} g USING (doc_id) LEFT JOIN {part('ttr')} l USING (doc_id) LEFT JOIN {part('mattr')} m USING (doc_id) LEFT JOIN {part('mtld')} k USING (doc_id) LEFT JOIN {part('zipf')} z USING (doc_id) LEFT JOIN {part('heaps')} h USING (doc_id) LEFT JOIN {part('passive')} p USING (doc_id) LEFT JOIN {part('rhythm')} r USING (doc_id) LEFT JOIN {found} w USING (doc_id)"""
    names = {"flesch-reading-ease": "Flesch Reading Ease", "flesch-kincaid-grade": "Flesch–Kincaid Grade Level", "gunning-fog": "Gunning Fog Index", "smog": "SMOG Grade", "coleman-liau": "Coleman–Liau Index", "automated-readability-index": "Automated Readability Index"}
    listed = " UNION ALL ".join(f"SELECT doc_id, {i} AS k, '  {names[METRIC_IDS[m]]}: ' || {number(half_up(f'({f})', 1))} || '  [' || {terms_of(m)[1]} || ']' AS line FROM i WHERE {USABLE}" for i, (m, f) in enumerate(FORMULAS.items()))
    shown = lambda x: f"coalesce({number(x)}, '-')"
    out["report_text"] = f"""WITH ml AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS lines FROM (WITH {INPUTS} {listed}) GROUP BY doc_id)
SELECT c.doc_id, CASE WHEN ml.lines IS NOT NULL THEN concat_ws(chr(10), 'Text report', c.words || ' words, ' || c.sentences || ' sentences, ' || c.paragraphs || ' paragraphs', 'Readability', ml.lines, 'Vocabulary', '  distinct words: ' || c.types,
'  TTR: ' || {shown('l.ttr')} || '   MATTR: ' || {shown('m.value')} || '   MTLD: ' || {shown('k.value')}, 'Style', '  passive candidates: ' || p.sentences || ' sentences', '  nominalisations: ' || {shown('n.nominalisations_percent')} || '%',
'  sentence length: mean ' || {shown('r.mean')} || ', sd ' || {shown('r.sd')} || ', max ' || coalesce(r.max::VARCHAR, '-')) END AS report
FROM {part('counts')} c LEFT JOIN ml USING (doc_id) LEFT JOIN {part('ttr')} l USING (doc_id) LEFT JOIN {part('mattr')} m USING (doc_id) LEFT JOIN {part('mtld')} k USING (doc_id) LEFT JOIN {part('passive')} p USING (doc_id) LEFT JOIN {part('nominalisations')} n USING (doc_id) LEFT JOIN {part('rhythm')} r USING (doc_id)"""
    # normal forms and screening
    out["norm_nfkc"] = f"WITH {SPICED} SELECT doc_id, {nfkc('text')} AS text FROM sp"
    out["norm_leet_inner"] = f"WITH {SPICED} SELECT doc_id, {leet_inner('text')} AS text FROM sp"
    out["norm_join_spaced"] = f"WITH {SPICED}, x AS (SELECT doc_id, replace(text, 'the', 't h e') AS text FROM sp) SELECT doc_id, {joined('text')} AS text FROM x"
    out["norm_collapse"] = f"WITH {SPICED}, x AS (SELECT doc_id, replace(text, 'e', 'eee') AS text FROM sp) SELECT doc_id, {collapsed('text', 'x')} AS text FROM x"
    out["normalize_text"] = f"WITH {SPICED}, {stages('sp', 'nf', inner=False)} SELECT doc_id, text AS output, changed::BIGINT AS changed_steps FROM nf"
    out["normalize_without_leet"] = f"WITH {SPICED}, {stages('sp', 'nf', inner=False, leet=False, confusables=False, collapse=False)} SELECT doc_id, text AS output FROM nf"
    normal = f"{SPICED}, {stages('sp', 'nf', inner=True, collapse=False)}"
    out["screen_normalized"] = f"WITH {normal} " + " UNION ALL ".join(f"SELECT doc_id, '{x}' AS term, {bounded('text', tolerant(x))}::BIGINT AS matches FROM nf" for x in TERMS)
    out["screen_matches"] = f'WITH {PLAIN}, {substring_matches("pl", TERMS, "sm")} SELECT doc_id, term, substring(text, "index" + 1, length) AS matched, "index", whole_word, {CONTEXT} AS context, "order"::BIGINT AS "order" FROM sm'
    inside = f"""{substring_matches("sp", TERMS, "sm")}, sb AS (SELECT doc_id, count(*) AS total, count(*) FILTER (whole_word) AS whole FROM sm GROUP BY doc_id),
sx AS (SELECT doc_id, string_agg({trim(CONTEXT)}, chr(10) ORDER BY "index", "order") AS examples FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "index", "order") AS k FROM sm WHERE NOT whole_word) WHERE k <= 10 GROUP BY doc_id),
md AS (SELECT sp.doc_id, coalesce(total, 0)::BIGINT AS substring_total, coalesce(whole, 0)::BIGINT AS substring_whole, coalesce(examples, '') AS examples, ({' + '.join(bounded('sp.text', x) for x in TERMS)})::BIGINT AS words, ({' + '.join(bounded('nf.text', tolerant(x)) for x in TERMS)})::BIGINT AS normal FROM sp JOIN nf USING (doc_id) LEFT JOIN sb USING (doc_id) LEFT JOIN sx USING (doc_id))"""
    out["compare_modes"] = f"""WITH {normal}, {inside} SELECT doc_id, 'substring' AS mode, substring_total AS total, substring_whole AS whole, substring_total - substring_whole AS collateral, examples FROM md
UNION ALL SELECT doc_id, 'word', words, words, 0::BIGINT, '' FROM md UNION ALL SELECT doc_id, 'normalized', normal, normal, 0::BIGINT, '' FROM md"""
    out["compare_modes_summary"] = f"WITH {normal}, {inside} SELECT doc_id, substring_total || ' as substrings, ' || (substring_total - substring_whole) || ' of them inside other words; ' || words || ' as words; ' || normal || ' as words of the normal form' AS summary FROM md"
    html = """replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""
    for _ in range(2):  # neighbours share a character
        html = rf"regexp_replace({html}, '(?i)(^|[^\p{{L}}\p{{N}}>])({'|'.join(TERMS)})($|[^\p{{L}}\p{{N}}<])', '\1<mark>\2</mark>\3', 'g')"
    out["highlight"] = f"WITH {PLAIN} SELECT doc_id, {html} AS html FROM pl"
    out["evasions"] = f"WITH {evasion_ctes()} SELECT * FROM ev"
    out["evasion_report"] = f"WITH {report_ctes()} SELECT * FROM rp"
    out["evasion_tally"] = f"WITH {report_ctes()} SELECT family, technique, count(*)::BIGINT AS total, (count(*) FILTER (word))::BIGINT AS word, (count(*) FILTER (normalized))::BIGINT AS normalized FROM rp GROUP BY ROLLUP (family, technique) HAVING family IS NOT NULL"
    # evaluations
    gold = f"{DOCS}, {WORDS}, bw AS (SELECT DISTINCT lower(word) AS word FROM w), un AS (SELECT DISTINCT regexp_replace(word, '[^a-z]', '', 'g') AS raw FROM bw), {syllables_of('un')}, er AS (SELECT word, greatest(1, len(regexp_extract_all(word, '[aeiouy]+'))) AS gold, coalesce(syl, 0) AS predicted, predicted - gold AS e FROM bw LEFT JOIN sy ON sy.raw = regexp_replace(word, '[^a-z]', '', 'g'))"
    share = lambda c: half_up(f"((count(*) FILTER ({c}))::DOUBLE / count(*)::DOUBLE * 100)", 2)
    out["syllable_eval"] = f"WITH {gold} SELECT count(*)::BIGINT AS words, {share('e = 0')} AS exact_percent, {share('abs(e) <= 1')} AS within_one_percent, {half_up('avg(abs(e))', 4)} AS mean_absolute, {half_up('avg(e)', 4)} AS mean_signed FROM er"
    out["syllable_histogram"] = f"WITH {gold} SELECT gold::BIGINT AS gold, e::BIGINT AS error, count(*)::BIGINT AS words FROM er GROUP BY gold, e"
    out["worst_syllables"] = f"WITH {gold} SELECT word, predicted::BIGINT AS predicted, gold::BIGINT AS gold, e::BIGINT AS error FROM er ORDER BY abs(e) DESC, word LIMIT 20"
    lines = rf"g AS (SELECT doc_id, list_filter(list_transform(str_split(coalesce(text, ''), chr(10)), lambda x: {trim('x')}), lambda x: x <> '') AS l FROM documents), d AS (SELECT doc_id, array_to_string(l, ' ') AS text FROM g)"
    size = lambda c: rf"len(regexp_replace({c}, '[{SPACE}]+', '', 'g'))"
    out["sentence_eval"] = f"""WITH {lines}, {SENTENCES},
gl AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k, len(l) AS n FROM g), go AS (SELECT doc_id, sum({size('line')}) OVER (PARTITION BY doc_id ORDER BY k) AS spot, k, n FROM gl), gb AS (SELECT DISTINCT doc_id, spot FROM go WHERE k < n),
po AS (SELECT doc_id, sum({size('sentence')}) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS spot, sent_idx, max(sent_idx) OVER (PARTITION BY doc_id) AS last FROM s), pb AS (SELECT DISTINCT doc_id, spot FROM po WHERE sent_idx < last),
al AS (SELECT coalesce(gb.doc_id, pb.doc_id) AS doc_id, gb.spot IS NOT NULL AND pb.spot IS NOT NULL AS tp, gb.spot IS NULL AS fp, pb.spot IS NULL AS fn FROM gb FULL JOIN pb ON gb.doc_id = pb.doc_id AND gb.spot = pb.spot),
un AS (SELECT doc_id, coalesce(bool_or(fp OR fn), false) AS wrong FROM d LEFT JOIN al USING (doc_id) GROUP BY doc_id),
tt AS (SELECT count(*) FILTER (tp) AS tp, count(*) FILTER (fp) AS fp, count(*) FILTER (fn) AS fn FROM al), rt AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS p, tp::DOUBLE / nullif(tp + fn, 0) AS r FROM tt)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, {half_up('(p * 100)', 2)} AS precision, {half_up('(r * 100)', 2)} AS recall, {half_up('(p * r * 2 / nullif(p + r, 0) * 100)', 2)} AS f1, (SELECT {share('NOT wrong')} FROM un) AS exact_units_percent FROM rt"""
    scores = lambda d: "(WITH " + INPUTS.replace(DOCS, d) + " " + " UNION ALL ".join(f"SELECT doc_id, '{METRIC_IDS[k]}' AS metric, {half_up(f'({f})', 1)} AS value FROM i WHERE {USABLE}" for k, f in FORMULAS.items()) + ")"
    low = DOCS.replace("coalesce(text, '')", "lower(coalesce(text, ''))")
    out["cross_check"] = f"SELECT metric, count(*)::BIGINT AS samples, {half_up('avg(abs(a.value - b.value))', 2)} AS mean_difference, {half_up('max(abs(a.value - b.value))', 2)} AS largest_difference FROM {scores(DOCS)} a JOIN {scores(low)} b USING (doc_id, metric) GROUP BY metric"
    # citations
    out["citations"] = f"WITH {citation_values()} SELECT id, authors, year::BIGINT AS year, title, source, locator, url, verified FROM ci"
    asked = "q(id) AS (VALUES ('zipf1949'), ('sap2019'), ('nobody1900'))"
    out["format_citation"] = f"WITH {citation_values()}, {asked} SELECT q.id, coalesce({LINE}, q.id) AS reference FROM q LEFT JOIN ci USING (id)".replace("coalesce(concat_ws", "coalesce(CASE WHEN authors IS NOT NULL THEN concat_ws").replace("|| '.', q.id)", "|| '.' END, q.id)")
    out["cite"] = f"WITH {citation_values()}, {asked} SELECT id, authors, year::BIGINT AS year, title, source, locator, url, verified FROM q JOIN ci USING (id)"
    out["references"] = f"WITH {citation_values()} SELECT row_number() OVER (ORDER BY year, authors COLLATE en, id)::BIGINT AS place, id, {LINE} AS line, CASE WHEN verified = 'primary' THEN 'source read' ELSE 'cross-checked' END AS checked FROM ci"
    out["references_by_check"] = f"WITH {citation_values()} SELECT verified, count(*)::BIGINT AS records FROM ci GROUP BY verified"
    # sources and sinks
    bench = "d AS (SELECT item_id AS doc_id, text FROM benchmark)"
    out["text_files"] = "SELECT item_id, length(text || chr(10))::BIGINT AS chars, text || chr(10) AS text FROM benchmark"
    out["text_column"] = f"WITH c AS (SELECT conv_id, len(regexp_extract_all(text, '{WORD}')) AS n FROM conversations) SELECT conv_id AS doc_id, count(*)::BIGINT AS turns, sum(n)::BIGINT AS words FROM c GROUP BY conv_id"
    out["sample_texts"] = "SELECT * FROM (VALUES " + ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in SAMPLES.items()) + ") AS v(doc_id, text)"
    out["json_sink"] = f"SELECT doc_id, characters, words, sentences, reading_minutes FROM {part('counts')}"
    out["dictionary_source"] = f"WITH {bench}, {WORDS}, x AS (SELECT DISTINCT lower(word) AS word FROM w WHERE regexp_matches(lower(word), '^[a-z]+$')), n AS (SELECT word, len(regexp_extract_all(word, '[aeiouy]+')) AS n FROM x), c AS (SELECT word, n FROM n WHERE n > 0 UNION SELECT word, n + 1 FROM n WHERE len(word) > 7) SELECT word, string_agg(n::VARCHAR, ',' ORDER BY n) AS counts FROM c GROUP BY word"
    out["treebank_source"] = rf"WITH {bench}, {SENTENCES} SELECT doc_id AS item_id, count(*)::BIGINT AS sentences, string_agg(trim(regexp_replace(sentence, '\s+', ' ', 'g')), '|' ORDER BY sent_idx) AS joined FROM s GROUP BY doc_id"
    return out


def all_sql() -> dict[str, str]:
    return sql() | more_sql()
