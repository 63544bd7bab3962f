"""SQL that registered queries must equal, where SQL can express them and is quick enough on whole tables."""

from __future__ import annotations

from runlattice.llm import bagminhash, conversations, hard_negatives, hnsw, mixing, substrings

ORACLES: dict[str, str] = {}

#: Words of a text, and their places.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op2_bagminhash"] = f"""
WITH RECURSIVE texts AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY 1),
words AS (SELECT id, {_WORDS} AS w FROM texts),
runs AS (SELECT id, unnest(CASE WHEN len(w) < {bagminhash.WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {bagminhash.WORDS} + 2), lambda i: array_to_string(w[i : i + {bagminhash.WORDS} - 1], ' ')) END) AS s
  FROM words WHERE len(w) > 0),
bags AS (SELECT id, s, count(*) AS n FROM runs GROUP BY 1, 2),
totals AS (SELECT id, sum(n) AS total FROM bags GROUP BY 1),
common AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS n FROM bags a JOIN bags b ON a.s = b.s AND a.id <> b.id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN totals x ON x.id = a JOIN totals y ON y.id = b WHERE n >= {bagminhash.LIKENESS} * (x.total + y.total - n)),
reach AS (SELECT id AS a, id AS b FROM texts UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, t.id AS class_id, component_id, copies, d.doc_id = component_id AS kept
FROM documents d JOIN texts t ON t.text = coalesce(d.text, '') JOIN least ON least.id = t.id"""

ORACLES["op4_pfair"] = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '')
    ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST) - 1 AS i FROM documents),
sizes AS (SELECT source, count(*) AS n FROM docs GROUP BY 1),
rated AS (SELECT source, n, pow(n, {mixing.POWER}) / sum(pow(n, {mixing.POWER})) OVER () * ({mixing.CYCLE} - count(*) OVER ()) AS ideal,
  count(*) OVER () AS k FROM sizes),
ranked AS (SELECT *, floor(ideal) AS whole, row_number() OVER (ORDER BY ideal - floor(ideal) DESC, source) AS place,
  {mixing.CYCLE} - k - sum(floor(ideal)) OVER () AS rest FROM rated),
plan AS (SELECT source, n, CAST(1 + whole + CASE WHEN place <= rest THEN 1 ELSE 0 END AS BIGINT) AS share,
  row_number() OVER (ORDER BY source) AS j FROM ranked),
steps AS (
  SELECT 0 AS next, list(share ORDER BY j) AS w, list(CAST(0 AS BIGINT)) AS had, CAST(0 AS BIGINT) AS j FROM plan
  UNION ALL
  SELECT next + 1, w, list_transform(range(1, len(w) + 1), lambda i: had[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick
  FROM (SELECT *, list_min(list_transform(list_filter(range(1, len(w) + 1), lambda i: had[i] * {mixing.CYCLE} < w[i] * (next + 1)),
    lambda i: CAST(ceil((had[i] + 1) * CAST({mixing.CYCLE} AS DOUBLE) / w[i]) AS BIGINT) * 1000000 + i)) % 1000000 AS pick
    FROM steps WHERE next < {mixing.CYCLE})),
slots AS (SELECT j, next - 1 AS slot, row_number() OVER (PARTITION BY j ORDER BY next) - 1 AS i FROM steps WHERE next > 0),
last AS (SELECT (n + {mixing.BLOCK} - 1) // {mixing.BLOCK} - 1 AS b, p.* FROM plan p),
horizon AS (SELECT max(b // share * {mixing.CYCLE} + slot) + 1 AS h FROM last l JOIN slots s ON s.j = l.j AND s.i = b % share),
taken AS (SELECT p.j, any_value(p.source) AS source, any_value(n) AS n, any_value(share) AS share,
  (any_value(h) // {mixing.CYCLE} * any_value(share) + count(*) FILTER (slot < h % {mixing.CYCLE})) * {mixing.BLOCK} AS taken
  FROM plan p JOIN slots s ON s.j = p.j, horizon GROUP BY 1),
each AS (SELECT doc_id, t.*, epoch, i + epoch * n AS nth, (i + epoch * n) // {mixing.BLOCK} AS b
  FROM docs d JOIN taken t ON t.source = d.source, unnest(range(0, greatest(0, (taken - 1 - i) // n + 1))) AS u(epoch) WHERE i < taken)
SELECT doc_id, source, CAST(share AS INTEGER) AS share, epoch, (b // share * {mixing.CYCLE} + slot) * {mixing.BLOCK} + nth % {mixing.BLOCK} AS position,
  b // share * {mixing.CYCLE} + slot AS slot, b * {mixing.CYCLE} // share AS release,
  ((b + 1) * {mixing.CYCLE} + share - 1) // share AS deadline
FROM each e JOIN slots s ON s.j = e.j AND s.i = b % share"""

#: Base 32 of the digest: 40 hex digits in eights of 5, each of which is 20 bits, four letters.
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(sha1(payload), 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '')"""

ORACLES["op5_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
r AS (SELECT payload, max(page_id) AS response FROM p GROUP BY 1)
SELECT page_id, CAST(octet_length(encode(p.payload)) AS BIGINT) AS payload_bytes, {_BASE32.replace('payload', 'p.payload')} AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to
FROM p JOIN r ON r.payload = p.payload"""

ORACLES["op6_seed_extend"] = f"""
WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place,
  unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i + {substrings.LENGTH} - 1 <= len(w)
    THEN array_to_string(w[i : i + {substrings.LENGTH} - 1], ' ') END)) AS win FROM words),
judged AS (SELECT doc_id, word, place,
  win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, place) > 1 AS again FROM placed),
covered AS (SELECT doc_id, word, place, bool_or(again) OVER (PARTITION BY doc_id ORDER BY place
  ROWS BETWEEN {substrings.LENGTH} - 1 PRECEDING AND CURRENT ROW) AS gone FROM judged),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY place) FILTER (NOT gone), '') AS text
  FROM covered GROUP BY 1)
SELECT words.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept ON kept.doc_id = words.doc_id"""

ORACLES["op8_hnsw"] = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {hnsw.LIKENESS}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.vec_id = e.vec_id LEFT JOIN counted ON counted.vec_id = e.vec_id"""

#: CRC-32 of the bytes of an ASCII string `name`, a bit at a time.
_CRC32 = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, len(name) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS BIGINT))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


def _ways() -> str:
    """Every way a row, or the end (no symbol), is met from a grammar state, after up to two inserted rows: from, symbol, audit, cost, to, role."""
    start, legal = 0, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    out = []
    for begin in range(4):
        state, inserts = begin, 0
        while inserts < 3:
            made = "a" if state == 2 else "u"
            for symbol in [conversations.GONE, *"suaoSUAO", ""]:
                ways = [("", 0, state, "")] if symbol == "" else [("D", 4, state, "")]
                if symbol not in ("", conversations.GONE):
                    cut = 3 if symbol.isupper() else 0
                    if (state, symbol.lower()) in legal:
                        ways.append(("K", cut, legal[state, symbol.lower()], "="))
                    ways.append(("R", 3 + cut, legal[state, made], made))
                if symbol == "" and state not in (start, 3):
                    ways = []
                out += [(begin, symbol, "I" * inserts + edit, 3 * inserts + cost, to) for edit, cost, to, _ in ways]
            state, inserts = legal[state, made], inserts + 1
    return ", ".join(f"({a}, '{b}', '{c}', {d}, {e})" for a, b, c, d, e in out)


ORACLES["op12_suffix_dawg"] = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
kinds AS (SELECT name, {_CRC32} % 20 AS kind FROM (SELECT DISTINCT name FROM named)),
after AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM named n JOIN kinds k ON k.name = n.name, unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS u(copy)),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth,
  rtrim(text, e' \t\n\x0b\x0c\r') AS trimmed FROM after),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), nth) AS place FROM told),
faults AS (SELECT *, CASE WHEN trimmed = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial FROM placed),
symbols AS (SELECT *, CASE WHEN fault IN (1, 2) THEN '{conversations.GONE}' WHEN fault = 3 THEN upper(initial) ELSE initial END AS symbol,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair FROM faults),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
  count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
  count(*) AS n, list(symbol ORDER BY place) AS symbols, list(role ORDER BY place) AS roles, list(text ORDER BY place) AS texts FROM symbols GROUP BY 1),
ways(origin, symbol, edits, price, target) AS (VALUES {_ways()}),
best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS place, 0 AS state, 0 AS cost, '' AS audit FROM counted
  UNION ALL
  SELECT b.conv_id, b.place + 1, target, CAST(min(cost + price) AS INTEGER), CAST(arg_min(audit || edits, (cost + price, audit || edits)) AS VARCHAR)
  FROM best b JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.place <= c.n
  JOIN ways w ON w.origin = b.state AND w.symbol = CASE WHEN b.place = c.n THEN '' ELSE c.symbols[b.place + 1] END
  GROUP BY b.conv_id, b.place, target),
ended AS (SELECT b.conv_id, min(b.cost) AS cost, arg_min(b.audit, (b.cost, b.audit)) AS audit FROM best b
  JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.place = c.n + 1 GROUP BY 1),
edits AS (SELECT e.conv_id, step, substr(audit, step, 1) AS edit, len(replace(substr(audit, 1, step), 'I', '')) AS place,
    len(replace(substr(audit, 1, step), 'D', '')) AS nth, roles, texts
  FROM ended e JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id, unnest(range(1, len(audit) + 1)) AS u(step)),
made AS (SELECT *, first_value(CASE WHEN edit = 'K' AND left(roles[place], 1) = 's' THEN 1 ELSE 0 END)
    OVER (PARTITION BY conv_id ORDER BY step) AS led FROM edits WHERE edit <> 'D'),
lines AS (SELECT conv_id, step, CASE edit WHEN 'K' THEN roles[place] WHEN 'I' THEN own ELSE own END || ':' || CASE edit WHEN 'I' THEN '' ELSE texts[place] END AS line
  FROM (SELECT *, CASE WHEN (nth - led) % 2 = 1 THEN 'user' ELSE 'assistant' END AS own FROM made)),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY step) AS whole FROM lines GROUP BY 1),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM ids i LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM i.conv_id"""

ORACLES["op13_threshold"] = f"""
WITH taking AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM taking a JOIN taking b ON a.vec_id % {hard_negatives.EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {hard_negatives.POSITIVES}),
negatives AS (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND {hard_negatives.LEAST} * p.score <= 100 * n.score AND 100 * n.score <= {hard_negatives.MOST} * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= {hard_negatives.NEGATIVES}"""
