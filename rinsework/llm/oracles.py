"""DuckDB SQL of the operators that SQL can express, over the same whole tables."""

from __future__ import annotations

from . import chat, codes, lines, mixing, sketch

_WORD = "[^ \\t-\\r]+"

# letters and marks of scripts that part words by spaces; words of them that hold a digit; rows of such words
_UNSPACED = "".join(rf"\p{{{script}}}" for script in "Han Hiragana Katakana Thai Lao Khmer Myanmar Tibetan".split())
_PLAIN = rf"[^\P{{L}}{_UNSPACED}]|[^\P{{M}}{_UNSPACED}]|_"
_NUMBERED = rf"(?:{_PLAIN})*[0-9](?:{_PLAIN}|[0-9])*"
_FIELD = rf"{_NUMBERED}(?:[.,:/-]{_NUMBERED})*"
_SPACE = r" \t\n\x0b\f\r"
_SIGNS = rf"[^{_SPACE}\p{{L}}\p{{M}}\x01]*\x01[^{_SPACE}\p{{L}}\p{{M}}]*"
_CONSTANT = rf"[{_UNSPACED}]{{1,2}}|[^{_SPACE}{_UNSPACED}]+"
_ends = [f"{lines.DEPTH} + ((n - {lines.DEPTH}) * {k}) // {lines.FIELDS}" for k in range(lines.FIELDS + 1)]
_runs = ", ".join([f"w[1:{lines.DEPTH}]", *(f"w[{a} + 1:{b}]" for a, b in zip(_ends, _ends[1:]))])
_whole = "{'t': concat_ws(chr(1), n, array_to_string(w, ' ')), 'c': list_sum(c)}"
_open = ", ".join(
    f"{{'t': concat_ws(chr(1), n, {k}, array_to_string(w[1:{a}], ' '), array_to_string(w[{b} + 1:], ' ')), 'c': list_sum(c) - c[{k + 2}]}}"
    for k, (a, b) in enumerate(zip(_ends, _ends[1:])))

LINE_DEDUP = f"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
numbered AS (SELECT doc_id, text, i, l[i] AS v FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM split)),
masked AS (
  SELECT doc_id, text, i, string_split(replace(regexp_replace(v, '{_FIELD}', '{lines.VARIABLE}', 'g'), chr(9), ' '), ' ') AS w
  FROM numbered WHERE trim(v, ' ') <> ''),
sized AS (SELECT *, len(w) AS n FROM masked),
counted AS (
  SELECT *, list_transform(CASE WHEN n >= {lines.MIN_FIELD_TOKENS} THEN [{_runs}] ELSE [w] END, lambda r: len(regexp_extract_all(
    regexp_replace(replace(array_to_string(r, ' '), '{lines.VARIABLE}', chr(1)), '{_SIGNS}', ' ', 'g'), '{_CONSTANT}'))) AS c
  FROM sized),
parsed AS (
  SELECT doc_id, text, i, unnest(CASE WHEN n >= {lines.MIN_FIELD_TOKENS} THEN [{_whole}, {_open}] ELSE [{_whole}] END) AS x FROM counted),
recurring AS (
  SELECT x.t AS t, min(doc_id) AS first FROM parsed GROUP BY x.t
  HAVING count(DISTINCT doc_id) > 1 AND count(DISTINCT doc_id) * max(x.c) >= {lines.EVIDENCE}),
lost AS (SELECT DISTINCT doc_id, text, i FROM parsed JOIN recurring ON x.t = t WHERE doc_id <> first),
kept AS (
  SELECT n.doc_id, n.text, string_agg(n.v, chr(10) ORDER BY n.i) FILTER (WHERE o.i IS NULL) AS after, count(o.i) AS gone
  FROM (SELECT DISTINCT * FROM numbered) n LEFT JOIN lost o ON n.doc_id = o.doc_id AND n.text = o.text AND n.i = o.i
  GROUP BY n.doc_id, n.text)
SELECT d.doc_id, CASE WHEN gone > 0 THEN coalesce(after, '') ELSE d.text END AS text, d.lang, d.source,
  CASE WHEN gone > 0 THEN length(coalesce(after, '')) ELSE d.n_chars END AS n_chars
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text
"""

_marks = " ".join(f"WHEN role = '{r}' THEN {len(a) + len(b)}" for r, (a, b) in chat.MARKS.items())
CHAT_FORMATTING = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
told AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\\\\\[<]', '', 'g')) + CASE {_marks}
    ELSE {sum(map(len, chat.OTHER))} + length(role) + length(regexp_replace(role, '[^\\\\\\[<|]', '', 'g')) END AS chars,
    CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM told GROUP BY conv_id
"""

_cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
MIXED = f"""
sized AS (
  SELECT row_number() OVER () AS rid, *, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM mix_input),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sources),
weighed AS (SELECT *, CASE (rank - 1) % {len(mixing.WEIGHTS)} {_cases} END AS weight FROM ranked),
levels AS (
  SELECT *, source_size * {mixing.PASSES} / weight AS lim, (sum(source_size) OVER () - {mixing.PASSES} * coalesce(sum(source_size) OVER o, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM weighed WINDOW o AS (ORDER BY source_size * {mixing.PASSES} / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, rank, least(source_size * {mixing.PASSES}.0::DOUBLE, weight * coalesce(
    (SELECT level FROM levels WHERE level <= lim ORDER BY lim, rank LIMIT 1), 0.0)) AS target FROM levels),
timed AS (
  SELECT s.*, t.source_size, t.rank, t.target, sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
items AS (
  SELECT rid, size, rank, (pass * source_size + CAST(upto AS BIGINT)) / target AS finish
  FROM timed, range({mixing.PASSES}) p(pass) WHERE size > 0 AND target > 0 AND pass < ceil(target / source_size)),
ordered AS (SELECT rid, sum(size) OVER (ORDER BY finish, rank) AS running FROM items),
taken AS (SELECT rid, count(*) AS passes FROM ordered WHERE running <= (SELECT sum(size) FROM sized) GROUP BY rid)
"""
SOURCE_MIXING = f"""
WITH mix_input AS (SELECT doc_id, text, source FROM documents), {MIXED}
SELECT doc_id, size, source_size, target, size * coalesce(passes, 0) AS taken FROM timed LEFT JOIN taken USING (rid)
"""

_low = f"list_filter(all_hashes, lambda h: h < '{sketch.THRESHOLD}')"


def _sketch(column: str, out: str) -> str:
    words = f"regexp_extract_all({column}, '{_WORD}')"
    hashes = (f"list_transform(range(1, greatest(len(w) - {sketch.SHINGLE - 1}, 1) + 1), "
              f"lambda i: substr(md5(array_to_string(w[i:i + {sketch.SHINGLE - 1}], ' ')), 1, 16))")
    return f"""{out}_s AS (
  SELECT rid, list_sort(CASE WHEN len({_low}) > 0 THEN {_low} WHEN len(all_hashes) > 0 THEN [list_min(all_hashes)] ELSE [] END) AS s
  FROM (SELECT rid, CASE WHEN len(w) > 0 THEN list_distinct({hashes}) ELSE [] END AS all_hashes
        FROM (SELECT rid, {words} AS w FROM edits)))"""


def _likeness(b: str) -> str:
    both = f"len(list_intersect(own_s.s, {b}.s))"
    return f"CASE WHEN len(own_s.s) = 0 AND len({b}.s) = 0 THEN 1.0 ELSE {both} / (len(own_s.s) + len({b}.s) - {both}) END"


FINGERPRINTS = f"""
WITH named AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pairs AS (
  SELECT row_number() OVER o AS rid, doc_id, text, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text
  FROM named WINDOW o AS (ORDER BY doc_id NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
edits AS (SELECT *, left(text, length(text) - length(text) // 4) || left(next_text, length(text) // 4) AS edited FROM pairs),
{_sketch("text", "own")}, {_sketch("edited", "edited")}, {_sketch("next_text", "next")}
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(own_s.s, ',') AS fingerprint,
  array_to_string(edited_s.s, ',') AS edited_fingerprint, CAST({_likeness("edited_s")} AS DOUBLE) AS near_edited,
  CAST({_likeness("next_s")} AS DOUBLE) AS near_next
FROM edits JOIN own_s USING (rid) JOIN edited_s USING (rid) JOIN next_s USING (rid)
"""

_distance = "list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v)"


def _round(k: int) -> str:
    """The nearest entry of every part, and the codebooks after that."""
    return f"""
near{k} AS MATERIALIZED (
  SELECT x.rid, x.p, min({{'d': {_distance}, 'e': e}}) AS m FROM parts x JOIN book{k} b ON x.p = b.p GROUP BY x.rid, x.p),
means{k} AS (
  SELECT p, e, list(mean ORDER BY i) AS v FROM (
    SELECT x.p, n.m.e AS e, i, floor(sum(x.v[i]) / count(*)) AS mean
    FROM near{k} n JOIN parts x ON x.rid = n.rid AND x.p = n.p, unnest(range(1, len(x.v) + 1)) t(i) GROUP BY ALL) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m ON b.p = m.p AND b.e = m.e)"""


VECTOR_CODES = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid FROM kept),
parts AS MATERIALIZED (
  SELECT rid, p, v[len(v) * p // {codes.PARTS} + 1 : len(v) * (p + 1) // {codes.PARTS}] AS v FROM numbered, range({codes.PARTS}) t(p)),
book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, v FROM parts WHERE rid <= {codes.ENTRIES}),
{",".join(_round(k) for k in range(codes.ROUNDS + 1))},
told AS (
  SELECT rid, string_agg(format('{{:02x}}', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error
  FROM near{codes.ROUNDS} GROUP BY rid),
digest AS (
  SELECT sha256(string_agg(list_aggregate(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), 'string_agg', ','), ','
    ORDER BY p, e)) AS codebooks_sha256 FROM book{codes.ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM numbered JOIN told USING (rid), digest
"""

ORACLES = {
    "op2_line_dedup": LINE_DEDUP,
    "op5_chat_formatting": CHAT_FORMATTING,
    "op7_source_mixing": SOURCE_MIXING,
    "op10_fingerprints": FINGERPRINTS,
    "op13_vector_codes": VECTOR_CODES,
}
