"""What the registered queries return, as SQL for DuckDB over the same tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
spots AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs WHERE len(w) > 0),
windows AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS content,
    count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n
  FROM spots),
judged AS (
  SELECT doc_id, i, (doc_id, i) > min((doc_id, i)) OVER (PARTITION BY content) AS again FROM windows WHERE n = 20),
covered AS (
  SELECT s.doc_id, s.i, s.word, coalesce(bool_or(j.again) OVER (PARTITION BY s.doc_id ORDER BY s.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM spots s LEFT JOIN judged j USING (doc_id, i)),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS t
  FROM covered GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

OP3 = """
WITH whole AS (
  SELECT vec_id, list_resize(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT), (SELECT max(len(embedding)) FROM embeddings), 0) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP8 = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM firsts
"""

# CRC-32 with the reflected polynomial, a byte at a time from a table that is computed by its rule.
_TABLE = """
  SELECT list(list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
"""


def _crc32(bytes_: str) -> str:
    return f"xor(list_reduce({bytes_}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _best(*offers: str) -> str:
    return f"list_min([{', '.join(offers)}])"


def _edit(state: str, condition: str, cost: str, letter: str, line: str | None) -> str:
    more = f"list_append(p.{state}.o, {line})" if line else f"p.{state}.o"
    new = f"{{'c': p.{state}.c + {cost}, 's': p.{state}.s || '{letter}', 'o': {more}}}"
    return f"CASE WHEN p.{state} IS NOT NULL AND ({condition}) THEN {new} END"


def _inserted(state: str, role: str, struct: str) -> str:
    part = f"{struct}.{state}"
    return f"CASE WHEN {part} IS NOT NULL THEN {{'c': {part}.c + 3, 's': {part}.s || 'I', 'o': list_append({part}.o, '{role}:')}} END"


def _op11() -> str:
    """A fold over the rows of a conversation; the accumulator holds the best (cost, audit, lines) of each state."""
    may, more, own = "r.f NOT IN ('blank', 'duplicate')", "CASE WHEN r.f = 'truncated' THEN 3 ELSE 0 END", "r.role || ':' || r.txt"
    delete = {q: _edit(q, "true", "4", "D", None) for q in ("b", "y", "u", "a")}
    to_user = [x for q in ("b", "y", "a") for x in (
        _edit(q, f"{may} AND r.role[1] = 'u'", more, "K", own), _edit(q, may, f"3 + {more}", "R", "'user:' || r.txt"))]
    to_assistant = [_edit("u", f"{may} AND r.role[1] = 'a'", more, "K", own), _edit("u", may, f"3 + {more}", "R", "'assistant:' || r.txt")]
    system = _edit("b", f"{may} AND r.role[1] = 's'", more, "K", own)
    moved = f"{{'b': {delete['b']}, 'y': {_best(delete['y'], system)}, 'u': {_best(delete['u'], *to_user)}, 'a': {_best(delete['a'], *to_assistant)}}}"

    def spread(struct: str) -> str:
        """Insertions: to the user state from all others, then to the assistant state."""
        user = _best(f"{struct}.u", *[_inserted(q, "user", struct) for q in ("b", "y", "a")])
        with_user = f"{{'b': {struct}.b, 'y': {struct}.y, 'u': {user}, 'a': {struct}.a}}"
        return (
            f"list_transform([{with_user}], lambda m: {{'b': m.b, 'y': m.y, 'u': m.u, 'a': {_best('m.a', _inserted('u', 'assistant', 'm'))}}})[1]"
        )

    empty = "{'c': 0, 's': '', 'o': []::VARCHAR[]}"
    start = f"{{'b': {empty}, 'y': CASE WHEN false THEN {empty} END, 'u': CASE WHEN false THEN {empty} END, 'a': CASE WHEN false THEN {empty} END}}"
    begin = spread(f"({start})")
    step = f"list_transform([{moved}], lambda n: {spread('n')})[1]"
    blank = r"[^\x20\x09-\x0D]"
    key = "encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))"
    digits = f"list_transform(range(octet_length({key})), lambda i: ('0x' || hex({key})[2 * i + 1 : 2 * i + 2])::BIGINT)"
    return f"""
WITH crc AS ({_TABLE}),
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt, {_crc32(digits)} % 20 AS h FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN translate(txt, '.!?', '') ELSE txt END AS txt,
    unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE h <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY turn NULLS FIRST, copy) AS nth,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt, copy) AS i,
    regexp_extract_all(txt, '{blank}')[-1] AS tail
  FROM damaged),
faulty AS (
  SELECT *, CASE WHEN tail IS NULL THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS f,
    lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS earlier
  FROM numbered),
grouped AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'blank') AS blank,
    count(*) FILTER (f = 'duplicate') AS duplicate, count(*) FILTER (f = 'truncated') AS truncated,
    count(*) FILTER (earlier IS NOT NULL AND earlier[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'role': role, 'txt': txt, 'f': f}} ORDER BY i) AS rows
  FROM faulty GROUP BY conv_id),
folded AS (SELECT *, list_reduce(rows, lambda p, r: {step}, {begin}) AS z FROM grouped),
chosen AS (SELECT *, list_min([z.b, z.a]) AS won FROM folded)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(won.c, 0)::BIGINT AS cost, coalesce(won.s, '') AS audit,
  sha256(coalesce(array_to_string(won.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN chosen c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
"""


_BYTES = "list_transform(range(octet_length(encode(txt))), lambda i: ('0x' || hx[2 * i + 1 : 2 * i + 2])::BIGINT)"

OP12 = f"""
WITH crc AS ({_TABLE}),
docs AS (SELECT doc_id, source, coalesce(text, '') AS txt, hex(encode(coalesce(text, ''))) AS hx, md5('20000:' || doc_id) AS luck FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY luck) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM docs),
placed AS (SELECT *, row_number() OVER (ORDER BY (r + 0.5::DOUBLE) / n, luck) - 1 AS p, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, p * 24 // total AS shard FROM placed)
SELECT doc_id, octet_length(encode(txt)) + 8 AS size, {_crc32(_BYTES)}::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY p) - 1 AS slot, NULL::INT AS grown_shard
FROM cut, crc
"""

OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
parts AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM parts, (SELECT unnest([1, 2, 3, 4]) AS k)),
counted AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM parts GROUP BY lang),
cuts AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM counted WHERE k > 1),
sides AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : cut], ' ')
  JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1 :], ' ')),
lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM sides),
inner_parts AS (
  SELECT lang, f, unnest(list_filter(list_transform(range(16), lambda z: CASE WHEN z // 4 + z % 4 + 1 <= k AND z % 4 + 1 BETWEEN 2 AND k - 1
    THEN array_to_string(string_split(phrase, ' ')[z // 4 + 1 : z // 4 + z % 4 + 1], ' ') END), lambda p: p IS NOT NULL)) AS phrase
  FROM counted WHERE k > 2),
hiding AS (SELECT lang, phrase, max(f) AS f FROM inner_parts GROUP BY ALL),
open_ AS (
  SELECT o.* FROM lowest o LEFT JOIN hiding h USING (lang, phrase) WHERE nth = 1 AND (h.f IS NULL OR 100::HUGEINT * h.f < 80::HUGEINT * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM open_)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN words USING (lang) WHERE rank <= 2000
"""

SQL: dict[str, str] = {
    "op1_substring_dedup": OP1,
    "op3_exact_topk": OP3,
    "op8_warc": OP8,
    "op11_conversation_repair": _op11(),
    "op12_sharding": OP12,
    "op13_phrases": OP13,
}
