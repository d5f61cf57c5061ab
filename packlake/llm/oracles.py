"""The same results as SQL, where SQL can express them."""

from __future__ import annotations

OP10 = r"""
WITH words AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), windows AS (
  SELECT row_id, pos, ws[pos : pos + 7] AS eight
  FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 6)) AS pos FROM words WHERE len(ws) > 8)
), repeated AS (
  SELECT row_id, unnest(list(pos)) AS pos FROM windows GROUP BY row_id, eight HAVING count(*) > 1
), covered AS (
  SELECT row_id, count(DISTINCT word) AS n
  FROM (SELECT row_id, unnest(range(pos, pos + 8)) AS word FROM repeated) GROUP BY row_id
), filled AS (
  SELECT row_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT row_id, unnest(string_split(t, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_id
), features AS (
  SELECT words.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(filled.dup, 0)::BIGINT AS n_dup_lines, coalesce(filled.n, 0) AS n_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS upper_letters,
         length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters
  FROM words LEFT JOIN covered USING (row_id) LEFT JOIN filled USING (row_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM features
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * upper_letters > letters
            OR 2 * n_dup_lines > n_lines OR word_chars > 40 * n_words) AS kept
FROM judged
"""


def _way(state: str, cost: str, edit: str, turn: str = "''") -> str:
    return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{edit}', t := {state}.t || {turn})"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _turn_ways(state: str, initial: str, role: str, origins: tuple[str, ...]) -> str:
    """The cheapest way into a state with one turn: delete it, or keep or re-label it from another state."""
    text = "chr(10) || {} || ':' || text"
    kept = [f"CASE WHEN free AND i = '{initial}' THEN {_way(o, 'late', 'K', text.format('role'))} ELSE never END" for o in origins]
    changed = [f"CASE WHEN free THEN {_way(o, '2 + late', 'R', text.format(repr(role)))} ELSE never END" for o in origins if role]
    return _least(_way(state, "3", "D"), *kept, *changed)


_USER, _REPLY = "chr(10) || 'user:'", "chr(10) || 'assistant:'"

OP11 = rf"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda k: list_reduce(list_concat([k], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS t
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), damage AS (
  SELECT keyed.*, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(range(1, length(k) + 1), lambda j: ascii(k[j])::BIGINT)),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) % 20 AS d
  FROM keyed, tab
), damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM damage WHERE d <> 0
), counted AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS pos,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
  FROM counted
), turns AS (
  SELECT *, left(role, 1) AS i, last = '' AS blank, last <> '' AND nth > 1 AS duplicate,
         last <> '' AND nth = 1 AND NOT contains('.!?', last) AS truncated,
         last <> '' AND nth = 1 AS free,
         CASE WHEN last <> '' AND nth = 1 AND NOT contains('.!?', last) THEN 1 ELSE 0 END AS late
  FROM ordered
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
         count_if(NOT pair) AS illegal
  FROM (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i IN ('su', 'ua', 'au') AS pair FROM turns)
  GROUP BY conv_id
), start AS (
  SELECT struct_pack(c := 0::BIGINT, a := '', t := '') AS none,
         struct_pack(c := 1000000000::BIGINT, a := '', t := '') AS never
), search AS (
  SELECT conv_id, 0::BIGINT AS step_no, none AS e, never AS s, {_way('none', '2', 'I', _USER)} AS u,
         struct_pack(c := 4::BIGINT, a := 'II', t := {_USER} || {_REPLY}) AS r, never FROM ids, start
  UNION ALL
  SELECT conv_id, step_no + 1, e1, s1, {_least('u2', _way('r1', '2', 'I', _USER))},
         {_least('r1', _way('u2', '2', 'I', _REPLY))}, never
  FROM (
    SELECT *, {_least('u1', _way('e1', '2', 'I', _USER), _way('s1', '2', 'I', _USER))} AS u2
    FROM (
      SELECT search.conv_id, step_no, never, {_way('e', '3', 'D')} AS e1, {_turn_ways('s', 's', '', ('e',))} AS s1,
             {_turn_ways('u', 'u', 'user', ('e', 's', 'r'))} AS u1, {_turn_ways('r', 'a', 'assistant', ('u',))} AS r1
      FROM search JOIN turns ON search.conv_id IS NOT DISTINCT FROM turns.conv_id AND turns.pos = search.step_no + 1
    )
  )
), ended AS (
  SELECT conv_id, {_least('e', 'r')} AS won FROM search
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY step_no DESC) = 1
)
SELECT ended.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, won.c AS cost, won.a AS audit,
       sha256(substr(won.t, 2)) AS repaired_sha256
FROM ended LEFT JOIN facts ON ended.conv_id IS NOT DISTINCT FROM facts.conv_id
"""

OP13 = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, row_number() OVER () AS row_no
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.row_no AS anchor, a.vec_id AS anchor_id, b.vec_id, b.row_no, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
  FROM kept a JOIN kept b ON b.vec_id IS DISTINCT FROM a.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       (row_number() OVER (PARTITION BY p.anchor, p.row_no ORDER BY n.score DESC, n.vec_id NULLS LAST))::INT AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor
WHERE NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""

ORACLES: dict[str, str] = {"op10_quality": OP10, "op11_conversations": OP11, "op13_hard_negatives": OP13}
