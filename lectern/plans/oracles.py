"""DuckDB SQL for the engine's queries, written for DuckDB from the semantics."""

from __future__ import annotations

from lectern.plans import fixtures

# The tables of the SQL, written out.  They were taken from the
# engine's: a later change there shows, a mistake common to both does not.
# Intensities in ten-thousandths.
ONES = (
    "", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
    "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
)
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
NO_END = (
    "mr", "mrs", "ms", "dr", "prof", "rev", "gen", "sgt", "cpl", "pvt", "lt", "capt", "cmdr", "adm", "pres", "gov", "sen", "rep",
    "atty", "supt", "insp", "sr", "jr", "vs", "etc", "fig", "vol", "no", "op", "pp", "est", "approx", "dept", "co", "corp", "inc",
    "ltd", "llc", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec", "mon", "tue", "wed", "thu",
    "fri", "sat", "sun", "st", "ave", "blvd", "rd", "ln", "ct", "pl", "sq", "ch", "p", "pg", "ref", "ed", "eds",
)
ATTRIBUTION_VERBS = (
    "said", "says", "say", "asked", "asks", "ask", "replied", "replies", "reply", "answered", "answers", "answer",
    "called", "calls", "call", "cried", "cries", "cry", "shouted", "shouts", "shout", "yelled", "yells", "yell",
    "whispered", "whispers", "whisper", "murmured", "murmurs", "murmur", "muttered", "mutters", "mutter",
    "growled", "growls", "growl", "snapped", "snaps", "snap", "hissed", "hisses", "hiss", "breathed", "breathes", "breathe",
    "laughed", "laughs", "laugh", "sobbed", "sobs", "sob", "sighed", "sighs", "sigh", "groaned", "groans", "groan",
    "screamed", "screams", "scream", "declared", "declares", "declare", "announced", "announces", "announce",
    "exclaimed", "exclaims", "exclaim", "demanded", "demands", "demand", "ordered", "orders", "order",
    "pleaded", "pleads", "plead", "begged", "begs", "beg", "suggested", "suggests", "suggest",
    "admitted", "admits", "admit", "agreed", "agrees", "agree", "argued", "argues", "argue",
    "insisted", "insists", "insist", "interrupted", "interrupts", "interrupt", "continued", "continues", "continue",
    "added", "adds", "add", "noted", "notes", "note", "observed", "observes", "observe", "thought", "thinks", "think",
    "wondered", "wonders", "wonder", "realized", "realises", "realize", "remembered", "remembers", "remember",
    "told", "tells", "tell", "warned", "warns", "warn", "promised", "promises", "promise", "lied", "lies", "lie",
    "teased", "teases", "tease", "confessed", "confesses", "confess", "repeated", "repeats", "repeat",
    "echoed", "echoes", "echo", "grumbled", "grumbles", "grumble", "whimpered", "whimpers", "whimper",
    "stuttered", "stutters", "stutter",
)
VERB_EMOTIONS = (
    ("whispered", "whispered", 5000), ("murmured", "whispered", 5000), ("breathed", "whispered", 5000),
    ("shouted", "excited", 6000), ("screamed", "excited", 6000), ("yelled", "excited", 6000), ("bellowed", "excited", 6000),
    ("sobbed", "sad", 5000), ("wept", "sad", 5000), ("cried", "sad", 5000),
    ("snapped", "tense", 5000), ("growled", "tense", 5000), ("snarled", "tense", 5000),
    ("laughed", "excited", 4000), ("chuckled", "excited", 4000), ("giggled", "excited", 4000),
    ("asked", "curious", 3000), ("wondered", "curious", 3000), ("inquired", "curious", 3000),
)
STRONG_WORDS = (
    "terrified", "terror", "petrified", "ecstatic", "euphoric", "elated", "heartbroken", "devastated", "shattered",
    "furious", "enraged", "livid", "anguish", "despair", "hopeless", "triumphant", "exhilarating", "overwhelming",
    "horrified", "panic", "dread", "grief", "mourning", "bereavement", "betrayed", "humiliated", "ashamed",
)
TAG_WORDS = (
    ("neutral", ""), ("calm", "calm narrator voice"), ("curious", "curious tone"), ("tense", "tense, urgent"),
    ("excited", "excited"), ("sad", "sad, melancholic"), ("whispered", "whispering"), ("angry", "angry"),
)
SPEED_FACTORS = (
    ("neutral", 1.0), ("calm", 0.95), ("curious", 1.0), ("tense", 1.05), ("excited", 1.05), ("sad", 0.95),
    ("whispered", 0.85), ("angry", 1.1),
)

ORACLE_SQL: dict[str, str] = {}


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _below_thousand(n: str) -> str:
    low = f"CASE WHEN ({n}) % 100 = 0 THEN NULL WHEN ({n}) % 100 < 20 THEN {_list(ONES)}[CAST(({n}) % 100 AS INT) + 1] ELSE {_list(TENS)}[CAST(({n}) // 10 % 10 AS INT) + 1] || CASE WHEN ({n}) % 10 > 0 THEN '-' || {_list(ONES)}[CAST(({n}) % 10 AS INT) + 1] ELSE '' END END"
    return f"concat_ws(' ', CASE WHEN ({n}) // 100 > 0 THEN {_list(ONES)}[CAST(({n}) // 100 AS INT) + 1] || ' hundred' END, {low})"


def cardinal(n: str) -> str:
    """Words of 0 .. 999,999,999."""
    parts = [f"CASE WHEN ({n}) // {k} % 1000 > 0 THEN {_below_thousand(f'({n}) // {k} % 1000')} || '{name}' END" for k, name in ((1_000_000, " million"), (1000, " thousand"), (1, ""))]
    return f"CASE WHEN ({n}) = 0 THEN 'zero' ELSE concat_ws(' ', {', '.join(parts)}) END"


def year(n: str) -> str:
    century = _below_thousand(f"({n}) // 100")
    return f"CASE WHEN ({n}) = 2000 THEN 'two thousand' WHEN ({n}) % 100 = 0 THEN {century} || ' hundred' WHEN ({n}) % 100 < 10 THEN {century} || ' oh ' || {_below_thousand(f'({n}) % 100')} ELSE {century} || ' ' || {_below_thousand(f'({n}) % 100')} END"


def ordinal(words: str) -> str:
    return f"CASE WHEN {words} LIKE '%one' THEN left({words}, -3) || 'first' WHEN {words} LIKE '%two' THEN left({words}, -3) || 'second' WHEN {words} LIKE '%three' THEN left({words}, -5) || 'third' WHEN {words} LIKE '%five' THEN left({words}, -2) || 'fth' WHEN {words} LIKE '%eight' THEN {words} || 'h' WHEN {words} LIKE '%nine' THEN left({words}, -1) || 'th' WHEN {words} LIKE '%twelve' THEN left({words}, -2) || 'fth' ELSE {words} || 'th' END"


ORACLE_SQL["number_words"] = f"""
WITH w AS (SELECT o_orderkey, {cardinal('CAST(floor(o_totalprice) AS BIGINT)')} AS cardinal, {cardinal('o_orderkey')} AS k, {year('(o_orderkey % 1100 + 1000)')} AS year_words FROM orders)
SELECT o_orderkey, cardinal, year_words, {ordinal('k')} AS ordinal FROM w
"""

_PRICE, _CENTS = "CAST(floor(o_totalprice) AS BIGINT)", "(o_orderkey % 100)"
ORACLE_SQL["figures_normalized"] = f"""
WITH w AS (SELECT *, {cardinal('(o_orderkey % 17 + 4)')} AS rank_words FROM orders)
SELECT o_orderkey, 'Order ' || CASE WHEN o_orderkey BETWEEN 1000 AND 2099 THEN {year('o_orderkey')} ELSE {cardinal('o_orderkey')} END
  || ' of ' || {year('year(o_orderdate)')} || ' cost ' || {cardinal(_PRICE)} || CASE WHEN {_PRICE} = 1 THEN ' dollar' ELSE ' dollars' END
  || ' and ' || {cardinal(_CENTS)} || CASE WHEN {_CENTS} = 1 THEN ' cent' ELSE ' cents' END || ', ' || {cardinal('(o_orderkey % 101)')} || ' percent paid, ranked '
  || {ordinal('rank_words')} || ' by Doctor No.' AS text
FROM w
"""

_TIDY = r"array_to_string(list_filter(list_transform(string_split({t}, chr(10) || chr(10)), lambda p: trim(replace(regexp_replace(p, '[ \t]+', ' ', 'g'), chr(10), ' '), ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> ''), chr(10) || chr(10))"
ORACLE_SQL["marks_normalized"] = f"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(replace(text, chr(8220), '"'), chr(8221), '"'), chr(8217), ''''), chr(8203), ''), '\\s*[–—]\\s*', ' — ', 'g'), '\\s*--\\s*', ' — ', 'g') AS text FROM ({fixtures.MARKED})),
b AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(8230), '...'), '\\.{{4,}}', '...', 'g'), '\\.\\s\\.\\s\\.', '...', 'g') AS text FROM a)
SELECT doc_id, {_TIDY.format(t='text')} AS text FROM b
"""

_PARAGRAPHS = r"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')"
ORACLE_SQL["paragraphs"] = f"""
SELECT book_id, chapter_index, CAST(unnest(range(len(p))) AS INT) AS paragraph_index, unnest(p) AS text FROM (SELECT book_id, chapter_index, {_PARAGRAPHS} AS p FROM ({fixtures.NARRATIVE}))
"""

_ABBREVIATION = r"(^|[^\p{L}\p{N}_])((?i:" + "|".join(NO_END) + r")|[A-Z])\.( +)"
_HELD = f"regexp_replace(regexp_replace(p, '{_ABBREVIATION}', '\\1\\2' || chr(1) || '\\3', 'g'), '{_ABBREVIATION}', '\\1\\2' || chr(1) || '\\3', 'g')"
_SENTENCES = f"""
s0 AS (SELECT book_id, chapter_index, unnest(range(len(ps))) AS paragraph_index, unnest(ps) AS p FROM (SELECT book_id, chapter_index, {_PARAGRAPHS} AS ps FROM ({fixtures.NARRATIVE}))),
s1 AS (SELECT book_id, chapter_index, paragraph_index, replace({_HELD}, '...', chr(2)) AS p FROM s0),
s2 AS (SELECT book_id, chapter_index, paragraph_index, list_filter(list_transform(string_split(regexp_replace(p, '([.!?][''"”’)\\]]*)\\s+([A-ZÀ-ÜЀ-ӿ"''“‘(\\[])', '\\1' || chr(3) || '\\2', 'g'), chr(3)), lambda s: regexp_replace(replace(replace(s, chr(1), '.'), chr(2), '...'), '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS l FROM s1),
s3 AS (SELECT book_id, chapter_index, paragraph_index, unnest(l) AS text, unnest(range(len(l))) AS pos, len(l) AS n FROM s2),
s4 AS (SELECT book_id, chapter_index, CAST(paragraph_index AS INT) AS paragraph_index, CAST(row_number() OVER (PARTITION BY book_id ORDER BY paragraph_index, pos) - 1 AS INT) AS sentence_index, text, pos = n - 1 AS is_paragraph_end FROM s3)
"""
ORACLE_SQL["sentences"] = f"WITH {_SENTENCES} SELECT * FROM s4"

ORACLE_SQL["sentence_chunks"] = f"""
WITH RECURSIVE {_SENTENCES},
f AS (
  SELECT book_id, sentence_index, 0 AS chunk_index, CAST(length(text) AS BIGINT) AS chars, true AS is_open, 0 AS next_chunk FROM s4 WHERE sentence_index = 0
  UNION ALL
  SELECT s.book_id, s.sentence_index,
    CASE WHEN f.is_open AND f.chars + 1 + length(s.text) > 400 THEN f.next_chunk + 1 ELSE f.next_chunk END,
    CASE WHEN NOT f.is_open OR f.chars + 1 + length(s.text) > 400 THEN length(s.text) WHEN s.is_paragraph_end AND f.chars + 1 + length(s.text) >= 200 THEN 0 ELSE f.chars + 1 + length(s.text) END,
    NOT (f.is_open AND f.chars + 1 + length(s.text) <= 400 AND s.is_paragraph_end AND f.chars + 1 + length(s.text) >= 200),
    CASE WHEN f.is_open AND f.chars + 1 + length(s.text) > 400 THEN f.next_chunk + 1 WHEN f.is_open AND s.is_paragraph_end AND f.chars + 1 + length(s.text) >= 200 THEN f.next_chunk + 1 ELSE f.next_chunk END
  FROM f JOIN s4 s ON s.book_id = f.book_id AND s.sentence_index = f.sentence_index + 1)
SELECT book_id, 0 AS chapter_index, chunk_index, min(sentence_index) AS start_sentence, max(sentence_index) AS end_sentence, CAST(count(*) AS INT) AS n_sentences,
  CAST(sum(length(text)) AS BIGINT) AS n_chars, string_agg(text, ' ' ORDER BY sentence_index) AS text
FROM f JOIN s4 USING (book_id, sentence_index) GROUP BY book_id, chunk_index
"""

_VERBS = "|".join(ATTRIBUTION_VERBS)
_TURNS = f"""
t0 AS (SELECT CAST(conv_id AS VARCHAR) AS book_id, 0 AS chapter_index, CAST(turn AS INT) AS sentence_index, text, turn % 3 = 2 AS is_paragraph_end FROM ({fixtures.DIALOGUE})),
t1 AS (SELECT *, coalesce(list_sum(list_transform(regexp_extract_all(text, '"[^"\\n]{{1,500}}"'), lambda s: length(s))), 0) AS d,
  coalesce(list_sum(list_transform(regexp_extract_all(text, '(?:^|[^\\pL\\pN_])''([^\\s''][^''\\n]{{1,198}}[^\\s''])''(?:[^\\pL\\pN_]|$)', 1), lambda s: length(s))), 0)
  + coalesce(list_sum(list_transform(regexp_extract_all(text, '_[^_\\n]{{1,200}}_'), lambda s: length(s))), 0) AS h FROM t0),
t2 AS (SELECT * EXCLUDE (d, h), CASE WHEN d > 0 AND h > 0 THEN 'mixed' WHEN d > 0 AND length(text) - d - h > greatest(20, 0.4 * length(text)) THEN 'mixed' WHEN d > 0 THEN 'dialogue' WHEN h > 0 THEN 'thought' ELSE 'prose' END AS narration_mode,
  d > 0 AS contains_dialogue, lower(regexp_extract(text, '(?i)\\b({_VERBS})\\b', 1)) AS attribution_verb FROM t1),
t3 AS (SELECT *, CASE WHEN narration_mode IN ('dialogue', 'mixed') AND contains_dialogue THEN 'character' ELSE 'narrator' END AS speaker FROM t2)
"""
ORACLE_SQL["dialogue"] = f"WITH {_TURNS} SELECT * FROM t3"

_VERB_CASE_E = "CASE attribution_verb " + " ".join(f"WHEN '{v}' THEN '{e}'" for v, e, _ in VERB_EMOTIONS) + " END"
_VERB_CASE_I = "CASE attribution_verb " + " ".join(f"WHEN '{v}' THEN {i}" for v, _, i in VERB_EMOTIONS) + " END"
_STRONG = _list(STRONG_WORDS)
_EMOTIONS = f"""
{_TURNS},
e0 AS (SELECT *, trim(text) AS tt, CASE WHEN narration_mode = 'dialogue' THEN {_VERB_CASE_E} END AS me, CASE WHEN narration_mode = 'dialogue' THEN {_VERB_CASE_I} END AS mi, len(regexp_extract_all(text, '\\b[A-Z]{{2,}}\\b')) AS caps FROM t3),
e1 AS (SELECT *, coalesce(me, CASE WHEN narration_mode = 'thought' THEN 'calm' ELSE 'neutral' END) AS ev, coalesce(mi, 3000) AS iv FROM e0),
e2 AS (SELECT *, CASE WHEN tt LIKE '%...' THEN greatest(iv - 1000, 1000) WHEN tt LIKE '%!' THEN least(iv + 1500, 7000) ELSE iv END AS jv FROM e1),
e3 AS (SELECT book_id, chapter_index, sentence_index, text, is_paragraph_end, narration_mode, contains_dialogue, attribution_verb, speaker,
  CASE WHEN tt LIKE '%...' THEN 'calm' WHEN tt LIKE '%?' AND narration_mode = 'dialogue' AND ev = 'neutral' THEN 'curious' ELSE ev END AS emotion,
  CAST(least(CASE WHEN caps >= 2 THEN jv + 1000 ELSE jv END, 7000) AS INT) AS level FROM e2)
"""
_AMBIGUOUS = f"(emotion = 'neutral' AND contains_dialogue) OR (length(text) > 20 AND list_has_any(regexp_extract_all(lower(text), '[\\pL\\pN_]+'), {_STRONG}))"
ORACLE_SQL["emotions"] = f"WITH {_EMOTIONS} SELECT book_id, sentence_index, emotion, level, {_AMBIGUOUS} AS ambiguous FROM e3"

_GUARDED = f"""
{_EMOTIONS},
g0 AS (SELECT *, list(level) OVER (PARTITION BY book_id ORDER BY sentence_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM e3),
g1 AS (SELECT * EXCLUDE (level, so_far), list_reduce(so_far, lambda a, x: least(x, a + 3000)) AS lv FROM g0),
g2 AS (SELECT *, row_number() OVER (PARTITION BY book_id, emotion <> 'neutral' ORDER BY lv, sentence_index) AS rk, count(*) FILTER (emotion <> 'neutral') OVER (PARTITION BY book_id) AS loud, greatest(count(*) OVER (PARTITION BY book_id) * 30 // 100, 1) AS allowed FROM g1),
g3 AS (SELECT *, CASE WHEN emotion <> 'neutral' AND rk <= loud - allowed THEN 'neutral' ELSE emotion END AS final_emotion, lv / 10000.0 AS intensity FROM g2)
"""
ORACLE_SQL["guarded_emotions"] = f"WITH {_GUARDED} SELECT book_id, sentence_index, final_emotion AS emotion, CAST(intensity AS DOUBLE) AS intensity, CAST(CASE WHEN is_paragraph_end THEN 500 ELSE 250 END AS INT) AS pause_after_ms FROM g3"
ORACLE_SQL["annotation_metrics"] = f"WITH {_GUARDED} SELECT book_id, count(*) AS n_sentences, count(*) FILTER (contains_dialogue) AS n_dialogue, avg(CASE WHEN final_emotion <> 'neutral' THEN 1.0 ELSE 0.0 END) AS emotional_share, CAST(max(intensity) AS DOUBLE) AS max_intensity FROM g3 GROUP BY book_id"

_SPEED = "CASE final_emotion " + " ".join(f"WHEN '{e}' THEN CAST({f} AS DOUBLE)" for e, f in SPEED_FACTORS) + " END"
_TAG = "CASE final_emotion " + " ".join(f"WHEN '{e}' THEN '{w}'" for e, w in TAG_WORDS) + " END"
ORACLE_SQL["delivery_plan"] = f"""
WITH {_GUARDED}
SELECT book_id, sentence_index, greatest(CAST(0.5 AS DOUBLE), least(CAST(2 AS DOUBLE), CAST(1 AS DOUBLE) + ({_SPEED} - CAST(1 AS DOUBLE)) * CAST(intensity AS DOUBLE))) AS speed,
  CAST(CASE WHEN is_paragraph_end THEN 24000 ELSE 6000 END AS BIGINT) AS pause_samples, greatest(CAST(1 AS DOUBLE), length(text) / CAST(15 AS DOUBLE)) AS seconds,
  CASE WHEN {_TAG} = '' THEN text ELSE '[' || CASE WHEN intensity > 0.6 THEN 'very ' ELSE '' END || {_TAG} || '] ' || text END AS tagged
FROM g3
"""
ORACLE_SQL["refinement_merge"] = f"""
WITH {_EMOTIONS}
SELECT book_id, sentence_index, CASE CAST(book_id AS BIGINT) % 4 WHEN 0 THEN 'sad' WHEN 3 THEN 'angry' ELSE emotion END AS emotion,
  CAST(CASE WHEN CAST(book_id AS BIGINT) % 4 IN (0, 3) THEN CASE WHEN sentence_index % 2 = 0 THEN 7000 ELSE 1000 END ELSE level END AS INT) AS level FROM e3
"""
ORACLE_SQL["refinement_batches"] = f"""
WITH {_TURNS}, r AS (SELECT CAST(CAST(book_id AS BIGINT) % 7 AS VARCHAR) AS b FROM t3 WHERE contains_dialogue), c AS (SELECT b, count(*) AS n FROM r GROUP BY b)
SELECT b AS book_id, CAST(i AS INT) AS batch_id, CAST(least(20, n - 20 * i) AS INT) AS n FROM (SELECT b, n, unnest(range((n + 19) // 20)) AS i FROM c)
"""

_ROMAN = "M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})"
_NUM, _ROM = r"(?i)^chapter\s+(\d+)(?:\s*[:.\-–—]\s*(.+))?$", rf"(?i)^chapter\s+({_ROMAN})(?:\s*[:.\-–—]\s*(.+))?$"
_CAPS = "^[A-Z][A-Z\\s\\d\\-:\'\'\"]{0,48}[A-Z\\d]$"
_CASED = "array_to_string(list_transform(regexp_extract_all({t}, '\\pL+|\\PL+'), lambda w: upper(w[1]) || lower(w[2:])), '')"


def _heading(line: str, blank: str) -> str:
    chapter = lambda p: f"'Chapter ' || regexp_extract({line}, '{p}', 1) || CASE WHEN regexp_extract({line}, '{p}', 2) = '' THEN '' ELSE ': ' || trim(regexp_extract({line}, '{p}', 2)) END"
    return f"""CASE WHEN {line} = '' THEN NULL WHEN regexp_matches({line}, '{_NUM}') THEN {chapter(_NUM)} WHEN regexp_matches({line}, '{_ROM}') THEN {chapter(_ROM)}
      WHEN regexp_matches({line}, '(?i)^part\\s+[\\pL\\pN_]+$') THEN 'Part ' || upper(regexp_extract({line}, '(?i)^part\\s+([\\pL\\pN_]+)$', 1)[1]) || lower(regexp_extract({line}, '(?i)^part\\s+([\\pL\\pN_]+)$', 1)[2:])
      WHEN regexp_matches({line}, '(?i)^{_ROMAN}\\.?$') THEN rtrim({line}, '.') WHEN regexp_matches({line}, '{_CAPS}') AND {blank} AND length({line}) < 50 THEN {_CASED.format(t=line)} END"""


ORACLE_SQL["heading_lines"] = f"""
WITH l AS (SELECT p_partkey, trim(CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN 'CHAPTER ' || p_partkey WHEN 1 THEN 'chapter iv - ' || p_name WHEN 2 THEN 'part ' || lower(p_brand) WHEN 3 THEN 'XIV.' WHEN 4 THEN upper(p_name) WHEN 5 THEN 'Chapter ' || p_partkey || ': ' || p_name WHEN 6 THEN p_name WHEN 7 THEN 'part two' ELSE '.' END) AS line FROM part)
SELECT p_partkey, {_heading('line', 'p_partkey % 2 = 0')} AS title FROM l
"""
ORACLE_SQL["text_chapters"] = f"""
WITH b AS (SELECT source AS book_id, string_agg('Chapter ' || CAST(doc_id AS VARCHAR) || ': Doc ' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || text, chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY source),
l AS (SELECT book_id, unnest(range(len(x))) AS n, unnest(x) AS raw FROM (SELECT book_id, string_split(text, chr(10)) AS x FROM b)),
m AS (SELECT *, trim(raw, ' ' || chr(9)) AS line, trim(coalesce(lag(raw) OVER (PARTITION BY book_id ORDER BY n), ''), ' ' || chr(9)) = '' AS blank FROM l),
h AS (SELECT *, {_heading('line', 'blank')} AS heading FROM m),
p AS (SELECT *, count(heading) OVER (PARTITION BY book_id ORDER BY n) AS part FROM h),
g AS (SELECT book_id, part, max(heading) AS title, trim(regexp_replace(regexp_replace(string_agg(raw, chr(10) ORDER BY n) FILTER (heading IS NULL), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), ' ' || chr(9) || chr(10)) AS text FROM p GROUP BY book_id, part)
SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY part) - 1 AS INT) AS chapter_index, title, text FROM g WHERE text <> ''
"""
ORACLE_SQL["toc_chapters"] = """
WITH d AS (SELECT source, doc_id, CASE WHEN doc_id % 3 <> 0 THEN 0 ELSE 1 END AS late, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN 'Doc ' || CAST(doc_id AS VARCHAR) ELSE '' END AS t, text FROM documents WHERE doc_id % 11 <> 0 AND trim(text) <> ''),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY late, doc_id) - 1 AS INT) AS chapter_index FROM d)
SELECT source AS book_id, chapter_index, CASE WHEN t = '' THEN 'Chapter ' || CAST(chapter_index + 1 AS VARCHAR) ELSE t END AS title, text FROM n
"""
ORACLE_SQL["book_covers"] = """
WITH i AS (SELECT p_size, p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'img/Cover' ELSE 'img/' END || CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_partkey % 4 = 0 THEN 'jpg' ELSE 'png' END AS cover_ext,
  CASE WHEN p_partkey % 50 = 0 THEN 0 WHEN p_partkey = max(p_partkey) OVER (PARTITION BY p_size) THEN 1 WHEN p_partkey % 13 = 0 THEN 2 ELSE 3 END AS rank FROM part)
SELECT CAST(p_size AS VARCHAR) AS book_id, name, cover_ext FROM i WHERE p_partkey % 4 IN (0, 2) QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY rank, p_partkey) = 1
"""

_AUDIO = "SELECT CAST(l_suppkey AS VARCHAR) AS book_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS INT) AS chapter_index, 'Part = ' || CAST(l_partkey AS VARCHAR) || '; #' AS title, l_extendedprice / CAST(37 AS DOUBLE) AS duration_seconds, 'it''s/' || CAST(l_orderkey AS VARCHAR) || '.wav' AS path FROM lineitem"
_TIMES = f"a AS (SELECT *, CAST(round_even(duration_seconds * 1000, 0) AS BIGINT) AS ms FROM ({_AUDIO})), t AS (SELECT book_id, chapter_index, title, CAST(sum(ms) OVER (PARTITION BY book_id ORDER BY chapter_index) AS BIGINT) AS end_ms, ms FROM a)"
ORACLE_SQL["timeline"] = f"WITH {_TIMES} SELECT book_id, chapter_index, title, end_ms - ms AS start_ms, end_ms FROM t"
ORACLE_SQL["metadata_text"] = f"""
WITH {_TIMES}
SELECT book_id, ';FFMETADATA1' || chr(10) || 'title=Book ' || book_id || chr(10) || 'artist=A\\=B' || chr(10) || 'album_artist=A\\=B' || chr(10) || 'album=Book ' || book_id || chr(10) || 'composer=' || chr(10) || 'date=1999' || chr(10) || 'genre=Audiobook' || chr(10) || 'comment=Created by lectern' || chr(10) || chr(10)
  || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || CAST(end_ms - ms AS VARCHAR) || chr(10) || 'END=' || CAST(end_ms AS VARCHAR) || chr(10) || 'title=' || replace(replace(replace(title, '=', '\\='), ';', '\\;'), '#', '\\#') || chr(10), chr(10) ORDER BY chapter_index) AS value
FROM t GROUP BY book_id
"""
ORACLE_SQL["concat_lists"] = f"SELECT book_id, string_agg('file ''' || replace(path, '''', '''\\''''') || '''', chr(10) ORDER BY chapter_index) || chr(10) AS value FROM ({_AUDIO}) GROUP BY book_id"

_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({t}), '\[.*?\]', '', 'g'), '\(.*?\)', '', 'g'), '[^\pL\pN_\s'']', ' ', 'g'), '''($|[^\pL\pN_])|(^|[^\pL\pN_])''', '\1 \2', 'g'), '\s+', ' ', 'g'))"
ORACLE_SQL["wer_normalized"] = "SELECT item_id, " + _NORM.format(t="('[sigh] ' || text || ' (aside) it''s ''so''')") + " AS text FROM benchmark"
_PAIRS = f"""
w0 AS (SELECT doc_id, {_NORM.format(t='reference')} AS r, {_NORM.format(t='hyp_sub')} AS s, {_NORM.format(t='hyp_del')} AS d FROM ({fixtures.WER_PAIRS})),
w1 AS (SELECT doc_id, len(list_filter(string_split(r, ' '), lambda w: w <> '')) AS n, len(list_filter(string_split(s, ' '), lambda w: w = 'xxx')) AS k, len(list_filter(string_split(d, ' '), lambda w: w <> '')) AS m FROM w0),
w2 AS (SELECT CAST(doc_id % 20 AS VARCHAR) AS book_id, CAST(doc_id AS INT) AS chapter_index, CAST(CASE WHEN doc_id % 2 = 0 THEN k ELSE 0 END AS INT) AS substitutions, CAST(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE n - m END AS INT) AS deletions,
  CAST(n AS INT) AS reference_words, CAST(CASE WHEN doc_id % 2 = 0 THEN n ELSE m END AS INT) AS hypothesis_words FROM w1),
w3 AS (SELECT *, 0 AS insertions, reference_words - substitutions - deletions AS hits FROM w2),
w4 AS (SELECT *, CAST(substitutions + deletions AS DOUBLE) / reference_words AS wer FROM w3)
"""
ORACLE_SQL["validation"] = f"WITH {_PAIRS} SELECT book_id, chapter_index, substitutions, deletions, insertions, hits, reference_words, hypothesis_words, wer, wer AS mer, CAST(1 AS DOUBLE) - (CAST(hits AS DOUBLE) / reference_words) * (CAST(hits AS DOUBLE) / hypothesis_words) AS wil, wer > 0.15 AS flagged FROM w4"
ORACLE_SQL["validation_summary"] = f"""
WITH {_PAIRS}, b AS (SELECT book_id, CAST(sum(substitutions + deletions) AS DOUBLE) / sum(reference_words) AS aggregate_wer, CAST(sum(reference_words) AS BIGINT) AS total_reference_words, CAST(sum(substitutions + deletions) AS BIGINT) AS total_errors, count(*) FILTER (wer > 0.15) AS flagged_chapters, count(*) AS chapters FROM w4 GROUP BY book_id)
SELECT *, CASE WHEN aggregate_wer * 100 <= 5 THEN 'Excellent — near-perfect transcription fidelity.' WHEN aggregate_wer * 100 <= 10 THEN 'Good — minor deviations, likely acceptable for most listeners.' WHEN aggregate_wer * 100 <= 15 THEN 'Fair — noticeable errors; review flagged chapters.' WHEN aggregate_wer * 100 <= 25 THEN 'Poor — significant errors; consider re-generating affected chapters.' ELSE 'Unacceptable — major issues; check TTS engine and text normalization.' END AS quality FROM b
"""
ORACLE_SQL["character_errors"] = f"WITH n AS (SELECT item_id, {_NORM.format(t='text')} AS r, {_NORM.format(t='replace(text, chr(101), chr(120))')} AS h FROM benchmark) SELECT item_id, CAST(levenshtein(r, h) AS DOUBLE) / length(r) AS cer FROM n"

_EVENTS = "SELECT CAST(user_id AS VARCHAR) AS book_id, event_id, CAST(event_id % 5 AS INT) AS chapter_index, CAST(event_id % 7 AS INT) AS chunk_index, event_type <> 'click' AS completed, 'a' || CAST(event_id AS VARCHAR) AS audio_path, ts FROM events"
ORACLE_SQL["pending_chunks"] = f"""
WITH l AS (SELECT * FROM ({_EVENTS}) QUALIFY row_number() OVER (PARTITION BY book_id, chapter_index, chunk_index ORDER BY ts DESC, completed DESC, audio_path DESC) = 1)
SELECT DISTINCT CAST(user_id AS VARCHAR) AS book_id, CAST(event_id % 5 AS INT) AS chapter_index, CAST(event_id % 9 AS INT) AS chunk_index FROM events e
WHERE NOT EXISTS (SELECT 1 FROM l WHERE completed AND l.book_id = CAST(e.user_id AS VARCHAR) AND l.chapter_index = e.event_id % 5 AND l.chunk_index = e.event_id % 9)
"""
ORACLE_SQL["progress_status"] = f"""
WITH k AS (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN NULL ELSE chunk_index END AS chunk_index), event_id % 3 = 0 AS is_chapter FROM ({_EVENTS})),
l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY book_id, is_chapter, chapter_index, chunk_index ORDER BY ts DESC, completed DESC, audio_path DESC) = 1),
c AS (SELECT book_id, count(*) FILTER (completed AND is_chapter) AS completed_chapters, count(*) FILTER (completed AND NOT is_chapter) AS completed_chunks FROM l GROUP BY book_id)
SELECT book_id, 7 AS total_chapters, 40 AS total_chunks, completed_chapters, completed_chunks, CAST(round_even(100.0 * completed_chapters / 7, 1) AS DOUBLE) AS percent FROM c
"""
ORACLE_SQL["chapter_eta"] = """
WITH e AS (SELECT CAST(l_suppkey AS VARCHAR) AS book_id, CAST(row_number() OVER w AS INT) AS chapter_index, avg(l_quantity) OVER w AS m, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT book_id, chapter_index, round(m * (n - chapter_index), 6) AS eta_seconds FROM e
"""
ORACLE_SQL["title_forms"] = f"""
WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name || ': "' || p_type || '"?' END AS raw FROM part),
f AS (SELECT p_partkey, raw, CASE WHEN raw = '' THEN 'Chapter ' || CAST(p_partkey + 1 AS VARCHAR) ELSE raw END AS title FROM t)
SELECT p_partkey, title, regexp_replace(title, '[<>:"/\\\\|?*]', '_', 'g') AS file_name, CASE WHEN length(title) > 35 THEN title[:33] || '..' ELSE title END AS short, regexp_replace(title || '=#;\\', '([\\\\=#;])', '\\\\\\1', 'g') AS escaped,
  {_CASED.format(t="(lower(raw) || ' o''neil rabbit-hole')")} AS cased FROM f
"""
ORACLE_SQL["probe_json"] = "SELECT l_orderkey, l_linenumber, l_quantity AS seconds, -l_quantity AS input_i, CAST(-2 AS DOUBLE) AS input_tp, CAST(3.5 AS DOUBLE) AS input_lra FROM lineitem"
