"""DuckDB SQL for the corpus operators that SQL can express."""

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP2 = rf"""
WITH sized AS (
  SELECT doc_id, source, {WORDS} AS size, md5(concat('42|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))) AS h
  FROM documents
), sums AS (
  SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS turn FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE turn WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight FROM sums
), ordered AS (
  SELECT *, row_number() OVER w AS place, 2.0 * source_size / weight AS ratio,
         (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighted
  WINDOW w AS (ORDER BY 2.0 * source_size / weight, source ASC NULLS LAST),
         before AS (ORDER BY 2.0 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), final AS (
  SELECT min_by(level, place) AS level FROM ordered WHERE level <= ratio
), targets AS (
  SELECT source, source_size, CAST(least(2.0 * source_size, coalesce(final.level * weight, 2.0 * source_size)) AS DOUBLE) AS target FROM ordered, final
), rated AS (
  SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0.0 END AS rate,
         CAST(('0x' || substr(h, 1, 13)) AS BIGINT) / 4503599627370496.0 AS coin
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * least(floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken
FROM rated
"""


def _escaped(column: str) -> str:
    out = rf"replace({column}, '\', '\\')"
    for c in ("<<SYS>>", "<</SYS>>", "<|", "|>", "</s>", "<s>", "[INST]", "[/INST]"):
        out = rf"replace({out}, '{c}', '{c[0]}\{c[1:]}')"
    return out


OP8 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), said AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'tool' THEN 't' ELSE 'x' END, '' ORDER BY turn NULLS FIRST, role, text) AS roles,
         sum(length({_escaped('role')}) + length({_escaped('text')}) + 32) AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars,
       regexp_matches(roles, '^s?ut*a([ut]t*a)*$') AS valid,
       CASE WHEN length(allowed) < length(roles) THEN length(allowed) END AS wrong_turn
FROM (SELECT *, regexp_extract(roles, '^(s?(u(t|a[ut])*a?)?)?') AS allowed FROM said)
"""

_LEAF = ", ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 of an id's decimal digits: eight steps for each.
_CRC32 = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(CAST(doc_id AS VARCHAR)[i])::BIGINT)), lambda crc, b:
  list_reduce(list_prepend(xor(crc, b), [0,0,0,0,0,0,0,0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT) + z)), 4294967295::BIGINT)"""
#: Levels of the sources' trees and of the tree over them.
_LOW, _HIGH = 5, 3


def _level(k: int, before: str, group: str) -> str:
    """Table n{k}: nodes of the level above, what each is made of, and how many are left in the group."""
    return f"""n{k} AS (
  SELECT {group} AS g, place // 16 AS place, CASE WHEN any_value(total) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY place)) END AS h,
         string_agg(h, '' ORDER BY place) AS made, any_value(total) AS below, (any_value(total) + 15) // 16 AS total
  FROM {before} GROUP BY {group}, place // 16
)"""


def _merkle() -> str:
    tables = [_level(1, "ranked", "g")] + [_level(k, f"n{k - 1}", "g") for k in range(2, _LOW + 1)]
    tables.append(f"tops AS (SELECT g AS source, h, row_number() OVER (ORDER BY g ASC NULLS FIRST) - 1 AS place, count(*) OVER () AS total, 0 AS zero FROM n{_LOW})")
    tables += [_level(_LOW + 1, "tops", "zero")] + [_level(k, f"n{k - 1}", "g") for k in range(_LOW + 2, _LOW + _HIGH + 1)]
    found, joins = [], []
    for k in range(1, _LOW + _HIGH + 1):
        low = k <= _LOW
        digit = f"(r.place // {16 ** (k - 1)})" if low else f"(t.place // {16 ** (k - _LOW - 1)})"
        joins.append(f"JOIN n{k} ON n{k}.place = {digit} // 16" + (f" AND n{k}.g IS NOT DISTINCT FROM r.g" if low else ""))
        at = f"{digit} % 16 * 64"
        found.append(f"CASE WHEN n{k}.below > 1 THEN [substr(n{k}.made, 1, {at}), substr(n{k}.made, {at} + 65)] ELSE NULL END")
        if k == _LOW:
            joins.append("JOIN tops AS t ON t.source IS NOT DISTINCT FROM r.g")
    last = _LOW + _HIGH
    return f"""
WITH leaves AS (
  SELECT doc_id, source AS g, sha256(concat({_LEAF}, coalesce(strlen(text) || ':' || text, '-'))) AS h,
         CASE WHEN {_CRC32} % 5 = 0 THEN sha256(concat({_LEAF}, coalesce(strlen(text) || ':' || {_LOWER}, '-'))) END AS changed
  FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id ASC NULLS FIRST, h) - 1 AS place, count(*) OVER (PARTITION BY g) AS total FROM leaves
), {", ".join(tables)}, paths AS (
  SELECT r.doc_id, r.h AS leaf, coalesce(r.changed, r.h) AS shown, t.h AS subroot, n{last}.h AS root, list_filter([{", ".join(found)}], lambda x: x IS NOT NULL) AS path
  FROM ranked AS r {" ".join(joins)}
), folded AS (
  SELECT *, list_reduce(list_prepend([shown, ''], path), lambda a, p: [sha256(concat(p[1], a[1], p[2])), '']) AS f FROM paths
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(flatten(path), ''), '')) AS proof_sha256, f[1] AS folded_root, f[1] = root AS verified FROM folded
"""


OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), sizes AS (
  SELECT lang, sum(len(words)) AS n FROM pieces GROUP BY lang
), said AS (
  SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(list_slice(words, i, i + k - 1), ' '))) AS phrase
  FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(words) >= k
), counted AS (
  SELECT lang, k, phrase, count(*) AS f FROM said GROUP BY ALL HAVING count(*) >= 100
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS words FROM counted WHERE k > 1
), parts AS (
  SELECT DISTINCT lang, array_to_string(list_slice(words, i, j), ' ') AS part, f
  FROM candidates, (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(1, 6)) AS j)
  WHERE j > i AND j <= k AND j - i + 1 < k
), dropped AS (
  SELECT lang, part, max(f) AS f FROM parts GROUP BY lang, part
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, cut, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM candidates AS c JOIN (SELECT unnest(range(1, 5)) AS cut) ON cut < c.k
  JOIN counted AS l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.words, 1, cut), ' ')
  JOIN counted AS r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.words, cut + 1, c.k), ' ')
  JOIN sizes ON sizes.lang = c.lang
  WHERE NOT EXISTS (SELECT 1 FROM dropped AS d WHERE d.lang = c.lang AND d.part = c.phrase AND 100 * d.f >= 100 * c.f)
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

ORACLES = {"op2_mixing": OP2, "op8_chat": OP8, "op12_merkle": _merkle(), "op13_phrases": OP13}
