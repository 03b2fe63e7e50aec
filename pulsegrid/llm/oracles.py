"""The registered queries that SQL can express, in DuckDB's SQL."""

from pulsegrid.llm import pii

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(separators: str) -> str:
    return f"list_filter(string_split_regex({_LOW}, '[{separators}]+'), lambda w: w <> '')"


def _runs(table: str, reach: int) -> str:
    """Each word's place and the words from there on, ``reach`` further ones at most."""
    return f"""SELECT r, long, p, list(w) OVER (PARTITION BY r ORDER BY p
               ROWS BETWEEN CURRENT ROW AND {reach} FOLLOWING) AS run
        FROM (SELECT r, len(ws) AS long, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM {table})"""


_NOT_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"

OP6 = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, {_words(_NOT_WORD)} AS ws FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, row_number() OVER () AS r, {_words(_NOT_WORD)} AS ws
  FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item, run AS win, len(run) AS n FROM ({_runs("items", 12)}) JOIN items USING (r)
  WHERE len(run) = 13 OR (long < 13 AND p = 1)),
hits AS (
  SELECT r, p, n, item
  FROM (SELECT r, p, run[1:n] AS win, n FROM ({_runs("docs", 12)}), (SELECT DISTINCT n FROM windows)
        WHERE len(run) >= n)
  JOIN windows USING (win, n)),
covered AS (
  SELECT r, count(DISTINCT q) AS n_hit
  FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM hits)) GROUP BY r),
found AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids
  FROM hits GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)"""

OP7 = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, row_number() OVER () AS r, {_words(chr(92) + "x20" + chr(92) + "x09-" + chr(92) + "x0D")} AS ws FROM documents),
shingles AS (SELECT DISTINCT r, run FROM ({_runs("docs", 4)}) WHERE len(run) = 5 OR (long < 5 AND p = 1)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (
  SELECT a.r AS x, b.r AS y, count(*) AS common
  FROM shingles a JOIN shingles b ON a.run = b.run AND a.r < b.r GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes sx ON sx.r = x JOIN sizes sy ON sy.r = y
  WHERE 100 * common >= 75 * (sx.n + sy.n - common)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(a, b) AS (SELECT r, r FROM docs UNION SELECT reach.a, edges.y FROM reach JOIN edges ON reach.b = edges.x)
SELECT any_value(d.doc_id) AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN docs d ON d.r = reach.a JOIN docs o ON o.r = reach.b LEFT JOIN sizes ON sizes.r = reach.a
GROUP BY reach.a"""

OP9 = """
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n
  FROM documents),
starts AS (
  SELECT r, doc_id, k, substr(x, 2 * k + 1, 100) AS s
  FROM (SELECT r, doc_id, x, unnest(range(0, n - 49)) AS k FROM docs)),
gone AS (
  SELECT r, k, lag(k) OVER (PARTITION BY r ORDER BY k) AS before
  FROM starts JOIN (SELECT s, min(doc_id) AS first FROM starts GROUP BY s) USING (s) WHERE doc_id > first),
spans AS (
  SELECT r, min(k) AS low, max(k) + 50 AS high
  FROM (SELECT r, k, sum(CASE WHEN before IS NULL OR k > before + 50 THEN 1 ELSE 0 END)
               OVER (PARTITION BY r ORDER BY k) AS island FROM gone)
  GROUP BY r, island),
gaps AS (
  SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS since FROM spans),
cut AS (
  SELECT r, count(*) AS n_spans, CAST(sum(high - low) AS BIGINT) AS n_removed, max(high) AS last,
         string_agg(substr(x, 2 * since + 1, 2 * (low - since)), '' ORDER BY low) AS kept
  FROM gaps JOIN docs USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM docs LEFT JOIN cut USING (r)"""

_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
_LUHN = """list_sum(list_transform(range(1, length({0}) + 1), lambda i:
  CASE WHEN i % 2 = 1 THEN CAST(reverse({0})[i] AS INT)
       WHEN CAST(reverse({0})[i] AS INT) > 4 THEN 2 * CAST(reverse({0})[i] AS INT) - 9
       ELSE 2 * CAST(reverse({0})[i] AS INT) END)) % 10 = 0"""
_MOD97 = """list_reduce(list_prepend(0, list_transform(
  string_split(substr(replace({0}, ' ', ''), 5) || substr(replace({0}, ' ', ''), 1, 4), ''),
  lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
  lambda a, c: (CASE WHEN c < 10 THEN a * 10 ELSE a * 100 END + c) % 97) = 1"""

#: Pattern (RE2 needs no possessive forms) and test of a match, by kind.
_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        rf"regexp_full_match({{0}}, '{pii._BYTE}(\.{pii._BYTE}){{3}}')",
    ),
    "card": (
        r"[0-9]([\x20-]?[0-9])+",
        f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN.replace('{0}', _DIGITS)}",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    "iban": (r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", _MOD97),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT regexp_matches({0}, '^(000|666|9..)|-00-|0000$')"),
    "local_phone": (r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", "true"),
}


def _pii_kind(kind: pii.Kind) -> str:
    """Rows r, k, low, high of a kind's spans."""
    pattern, test = _PII[kind.name]
    good = test.replace("{0}", "v")
    if not kind.base:
        low = f"lower(substr(text, greatest(low - {pii.CONTEXT}, 0) + 1, low - greatest(low - {pii.CONTEXT}, 0)))"
        score = (
            f"{kind.score + pii.CHECKSUM_GAIN * kind.checked} + CASE WHEN regexp_matches({low}, "
            f"'(?:^|[^a-z])(?:{'|'.join(kind.words)})') THEN {pii.CONTEXT_GAIN} ELSE 0 END + CASE WHEN "
            f"regexp_matches({low}, '(?:order|invoice|version|serial|test)[^a-z]*$') THEN {pii.AGAINST} ELSE 0 END"
        )
        joined = "'^[A-Za-z0-9_+-]'"
        good += (
            f" AND NOT (low > 0 AND regexp_matches(substr(text, low, 1), {joined}))"
            f" AND NOT regexp_matches(substr(text, low + length(v) + 1, 1), {joined})"
            f" AND CAST({score} AS DOUBLE) >= {pii.REPORTED}"
        )
    return f"""
  SELECT r, '{kind.name}' AS kind, low, low + length(v) AS high FROM (
    SELECT r, text, v, CAST(sum(length(gap)) OVER w + coalesce(sum(length(v)) OVER (
             PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS low
    FROM (SELECT r, text, unnest(vs) AS v, unnest(gaps[1:len(vs)]) AS gap, generate_subscripts(vs, 1) AS i
          FROM (SELECT r, text, regexp_extract_all(text, '{pattern}') AS vs,
                       string_split_regex(text, '{pattern}') AS gaps FROM docs))
    WINDOW w AS (PARTITION BY r ORDER BY i))
  WHERE {good}"""


_BASE = [k.name for k in pii.KINDS if k.base]
_ORDER = "list_position([" + ", ".join(f"'{k.name}'" for k in pii.KINDS) + "], kind)"

OP10 = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
base AS ({" UNION ALL ".join(_pii_kind(k) for k in pii.KINDS if k.base)}),
added AS ({" UNION ALL ".join(_pii_kind(k) for k in pii.KINDS if not k.base)}),
spans AS (
  SELECT *, true AS own FROM base UNION ALL
  SELECT a.*, false FROM added a WHERE NOT EXISTS (
    SELECT 1 FROM base b WHERE b.r = a.r AND b.low < a.high AND a.low < b.high)),
texts AS (
  SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _BASE)},
         string_agg(kind || ':' || low || ':' || high, ',' ORDER BY {_ORDER}, low) FILTER (own) AS base,
         string_agg(kind || ':' || low || ':' || high, ',' ORDER BY {_ORDER}, low) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN texts USING (r)"""

_NOT_TERM = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"

OP11 = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, {_words(_NOT_TERM)} AS ws FROM documents),
corpus AS (SELECT count(*) FILTER (len(ws) > 0) AS big_n, sum(len(ws))::BIGINT AS big_l FROM docs),
tfs AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM docs) GROUP BY r, t),
dfs AS (SELECT t, count(*) AS df FROM tfs GROUP BY t),
ms AS (SELECT r, doc_id, 100 - 50 + (50 * len(ws) * big_n) // big_l AS m FROM docs, corpus WHERE len(ws) > 0),
items AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_words(_NOT_TERM)}) AS ts FROM benchmark),
asked AS (
  SELECT i, t, CAST(floor(1000 * ln((2.0 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT i, unnest(ts) AS t FROM items) JOIN dfs USING (t), corpus),
scores AS (
  SELECT i, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (t) JOIN ms USING (r) GROUP BY i, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank
      FROM scores JOIN ms USING (r) WHERE score > 0) JOIN items USING (i)
WHERE rank <= 50"""


def _merkle(levels: int, top_levels: int) -> str:
    """Trees of eight over ``leaves``, one a language, and one over their roots, ``levels`` and
    ``top_levels`` high at most; the proof and the claim of every leaf, level by level."""
    steps = []

    def climb(name: str, base: str, high: int) -> None:
        steps.append(f"{name}0 AS ({base})")
        for k in range(high):
            steps.append(f"""{name}{k + 1} AS (
  SELECT tree, pos // 8 AS pos, CASE WHEN any_value(total) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h,
         (any_value(total) + 7) // 8 AS total
  FROM {name}{k} GROUP BY tree, pos // 8)""")

    def walk(name: str, nodes: str, base: str, high: int) -> None:
        steps.append(f"{name}0 AS ({base})")
        for k in range(high):
            steps.append(f"""{name}{k + 1} AS (
  SELECT w.r, w.tree, w.pos // 8 AS pos,
         w.proof || coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos <> w.pos), '') AS proof,
         CASE WHEN any_value(n.total) = 1 THEN w.claim
              ELSE sha256(string_agg(CASE WHEN n.pos = w.pos THEN w.claim ELSE n.h END, '' ORDER BY n.pos)) END AS claim
  FROM {name}{k} w JOIN {nodes}{k} n ON n.tree = w.tree AND n.pos // 8 = w.pos // 8
  GROUP BY w.r, w.tree, w.pos, w.proof, w.claim)""")

    climb("n", "SELECT tree, pos, leaf AS h, total FROM placed", levels)
    climb("t", f"""SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, count(*) OVER () AS total, tree AS name
                   FROM n{levels}""", top_levels)
    walk("w", "n", "SELECT r, tree, pos, '' AS proof, claim FROM placed", levels)
    walk("v", "t", f"SELECT w.r, 0 AS tree, t.pos, w.proof, w.claim FROM w{levels} w JOIN t0 t ON t.name = w.tree", top_levels)
    return ",\n".join(steps)


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 of a number's decimal digits, by the table of the reversed polynomial.
_CRC = """list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]))"""

OP12 = f"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i FROM range(256) x(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS crcs FROM steps WHERE k = 8),
leaves AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('v' || lang, 'n') AS tree, {_leaf("text")} AS leaf,
         CASE WHEN xor({_CRC}, 4294967295) % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
  FROM documents, crc),
placed AS (
  SELECT r, doc_id, tree, leaf, coalesce(tampered, leaf) AS claim,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, tampered NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS total
  FROM leaves),
{_merkle(7, 3)}
SELECT p.doc_id, p.leaf, n7.h AS subroot, t3.h AS root, sha256(v.proof) AS proof_sha256, v.claim AS folded_root, v.claim = t3.h AS verified
FROM placed p JOIN v3 v ON v.r = p.r JOIN n7 ON n7.tree = p.tree, t3"""
