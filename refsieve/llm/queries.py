"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers

from refsieve.llm import (
    bpe, bytespans, compression, langid, lattice, merkle, mixing, rules, secrets, simhash, substrings, topk, turns,
)
from refsieve.llm.common import table


def op1_compression_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return compression.score_quality(docs, compression.fit(docs, labels))


def op2_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


OP2 = """
WITH whole AS (
  SELECT row_number() OVER () AS row_no, vec_id,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.row_no, q.vec_id AS query_id, c.vec_id,
    list_inner_product(q.x, c.x)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.row_no <> c.row_no
)
SELECT query_id, vec_id, score,
  (row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank
FROM scored
QUALIFY rank <= 5"""


def op3_quality_rules(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rules.apply_rules(docs, rules.fit(docs, labels))


def op4_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, *langid.fit(docs))


def op5_lattice_lm(spark, sf_dir):
    pieces = lattice.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return lattice.score_documents(table(spark, sf_dir, "documents"), pieces)


def op6_secrets(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def _either_case(pattern: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


def _op6_sql() -> str:
    """Places from the gaps between matches; entropy of every window by itself."""
    words = _either_case("(?:password|passwd|secret|token|api_?key)")
    assign = words + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    patterns = {
        "assign": (assign, 1, 6), "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24),
        "run": (secrets.CANDIDATE, 0, 0),
    }

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    found = " UNION ALL ".join(f"""
      SELECT row_no, {place} AS kind, hit, start, start + length(hit) AS stop FROM (
        SELECT row_no, hit, part, sum(length(gap) + length(hit)) OVER (
          PARTITION BY row_no ORDER BY i) - length(hit) AS start
        FROM (SELECT row_no, unnest(hits) AS hit, unnest(parts) AS part, unnest(gaps[:len(hits)]) AS gap,
            unnest(range(len(hits))) AS i
          FROM (SELECT row_no, regexp_extract_all(text, {quoted(pattern)}) AS hits,
              regexp_extract_all(text, {quoted(pattern)}, {group}) AS parts,
              regexp_split_to_array(text, {quoted(pattern)}) AS gaps FROM texts)))
      WHERE length(part) >= {least}""" for place, (pattern, group, least) in enumerate(patterns.values()))
    # A short unit repeated needs a back reference, which this dialect does not have.
    plain = [p for p in secrets.ALLOWED if "\\1" not in p]
    allowed = " OR ".join(f"regexp_matches(hit, {quoted(p)})" for p in plain)
    repeated = " OR ".join(
        f"((length(hit) - {rest}) % {k} = 0 AND length(hit) >= {2 * k + rest} AND left(hit, length(hit) - {rest})"
        f" = repeat(left(hit, {k}), (length(hit) - {rest}) // {k}))" for k in (1, 2, 3, 4) for rest in range(4)
    )
    bits = "CASE " + " ".join(f"WHEN regexp_matches(hit, {quoted(p)}) THEN {b}" for p, b in secrets.CLASSES) + " END"
    w = secrets.WINDOW
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
found AS MATERIALIZED ({found}),
windows AS (
  SELECT row_no, start AS run, start + i AS a FROM found, unnest(range(length(hit) - {w - 1})) AS t(i)
  WHERE kind = 3 AND NOT ({allowed}) AND NOT ({repeated})
    AND list_entropy(string_split(substr(hit, i + 1, {w}), '')) >= {bits} - 1e-9
), islands AS (
  SELECT *, sum(new) OVER (PARTITION BY row_no, run ORDER BY a) AS island FROM (
    SELECT *, (a - lag(a, 1, -1000) OVER (PARTITION BY row_no, run ORDER BY a) > {w})::INT AS new FROM windows)
), stretches AS (
  SELECT row_no, min(a) AS start, max(a) + {w} AS stop FROM islands GROUP BY row_no, run, island
), spans AS (
  SELECT row_no, kind, start, stop FROM found WHERE kind < 3
  UNION ALL SELECT row_no, 3, start, stop FROM stretches s WHERE NOT EXISTS (
    SELECT 1 FROM found f WHERE f.row_no = s.row_no AND f.kind < 3 AND f.start <= s.start AND s.stop <= f.stop)
), written AS (
  SELECT row_no, kind, start,
    ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start || ':' || stop AS span FROM spans
), grouped AS (
  SELECT row_no, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
    string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM written GROUP BY row_no
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN grouped USING (row_no)"""


def op7_mixing(spark, sf_dir):
    return mixing.Mix(table(spark, sf_dir, "documents")).report()


def op8_bpe(spark, sf_dir):
    content = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digest_documents(table(spark, sf_dir, "documents"), content, public_tokenizers.PATTERN)


def op9_substrings(spark, sf_dir):
    return substrings.without_repeats(table(spark, sf_dir, "documents"), digest=True)


OP9 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row_no, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), windows AS (
  SELECT row_no, i, array_to_string(words[i:i + 34], ' ') AS run
  FROM texts, unnest(range(1, greatest(len(words) - 33, 1))) AS t(i)
  WHERE len(words) >= 35
), repeated AS (
  SELECT row_no, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY run) > 1
), gone AS (
  SELECT DISTINCT row_no, i + j AS place FROM repeated, unnest(range(35)) AS t(j)
), places AS (
  SELECT row_no, list(place) AS gone_places FROM gone GROUP BY row_no
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone_places), 0)::BIGINT AS n_removed,
  sha256(coalesce(CASE WHEN gone_places IS NULL THEN array_to_string(words, ' ') ELSE (
    SELECT string_agg(w, ' ' ORDER BY i)
    FROM (SELECT unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i)
    WHERE NOT list_contains(gone_places, i)) END, '')) AS kept_sha256
FROM texts LEFT JOIN places USING (row_no)"""


def op10_simhash(spark, sf_dir):
    return simhash.near_report(table(spark, sf_dir, "documents"))


def op11_merkle(spark, sf_dir):
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


# CRC-32 of a list of bytes, from the table of its bytes' remainders.
CRC_TABLE = """crc AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t
  FROM range(256) AS r(i)
)"""


def _crc_sql(text: str) -> str:
    """CRC-32 of a text of ASCII characters, in a query that reads ``crc``."""
    return (
        f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),"
        " lambda c, b: xor(c >> 8, t[xor(c, b) & 255 + 1])), 4294967295)"
    ).replace("xor(c, b) & 255 + 1", "(xor(c, b) & 255) + 1")


def _op11_sql() -> str:
    """Levels by recursion, from all nodes of one to those of the next."""
    def part(field: str) -> str:
        return f"coalesce(strlen({field}::VARCHAR) || ':' || {field}::VARCHAR, '-')"

    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(part(f) for f in ("doc_id", "source", "lang", n_chars, "text")) + ")"

    def nodes(name: str, base: str) -> str:
        return f"""{name}(tree, level, i, n, digest) AS (
  {base}
  UNION ALL
  SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i))
  FROM {name} WHERE n > 1 GROUP BY tree, level, i // 2, n
)"""

    def steps(name: str, leaves: str) -> str:
        """Per leaf, level by level, its sibling with its side, or that it has none."""
        return f"""
  SELECT l.tree, l.i, list(CASE WHEN s.i IS NULL THEN '-' WHEN l.i >> k.level & 1 = 1 THEN 'l' || s.digest
    ELSE 'r' || s.digest END ORDER BY k.level) AS steps
  FROM {leaves} l JOIN (SELECT DISTINCT tree, level, n FROM {name}) k ON k.tree = l.tree AND k.n > 1
  LEFT JOIN {name} s ON s.tree = l.tree AND s.level = k.level AND s.i = xor(l.i >> k.level, 1)
  GROUP BY l.tree, l.i"""

    return f"""
WITH RECURSIVE {CRC_TABLE}, leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY tree) AS n
  FROM (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {leaf("n_chars")} AS leaf,
    CASE WHEN {_crc_sql("doc_id::VARCHAR")} % 7 = 0 AND n_chars IS NOT NULL THEN {leaf("(n_chars + 1)")} END AS tampered
    FROM documents, crc)
), {nodes("lower_nodes", "SELECT tree, 0, i, n, leaf FROM leaves")}, subroots AS MATERIALIZED (
  SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, digest
  FROM lower_nodes WHERE n = 1
), {nodes("upper_nodes", "SELECT tree, 0, i, n, digest FROM subroots")}, lower_steps AS ({steps("lower_nodes", "leaves")}
), upper_steps AS ({steps("upper_nodes", "subroots")}
), witnesses AS (
  SELECT doc_id, leaf, coalesce(tampered, leaf) AS given, s.digest AS subroot,
    (SELECT digest FROM upper_nodes WHERE n = 1) AS root, list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
  FROM leaves l JOIN subroots s ON s.name = l.tree
  LEFT JOIN lower_steps a ON a.tree = l.tree AND a.i = l.i LEFT JOIN upper_steps b ON b.i = s.i
), ends AS (
  SELECT doc_id, leaf, subroot, root,
    sha256(coalesce(array_to_string(list_transform(steps, lambda x: CASE WHEN x = '-' THEN '' ELSE x[2:] END), ''), '')) AS proof_sha256,
    list_reduce(list_prepend(given, steps), lambda d, x: CASE x[1] WHEN '-' THEN sha256(d)
      WHEN 'l' THEN sha256(x[2:] || d) ELSE sha256(d || x[2:]) END) AS folded_root
  FROM witnesses
)
SELECT *, folded_root = root AS verified FROM ends"""


def op12_suffixes(spark, sf_dir):
    return bytespans.without_repeats(table(spark, sf_dir, "documents"), digest=True)


# Bytes are pairs of hexadecimal digits; they are cut from parts of 100 bytes that run 50 bytes on.
OP12 = """
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, doc_id, hex(encode(coalesce(text, ''))) AS hex,
    strlen(coalesce(text, ''))::BIGINT AS n_bytes
  FROM documents
), parts AS MATERIALIZED (
  SELECT row_no, doc_id, n_bytes, 100 * k AS begin, substr(hex, 200 * k + 1, 300) AS part
  FROM texts, unnest(range(n_bytes // 100 + 1)) AS t(k)
), windows AS (
  SELECT row_no, doc_id, begin + i AS i, substr(part, 2 * i + 1, 100) AS bytes
  FROM parts, unnest(range(least(100, n_bytes - 49 - begin))) AS t(i)
), repeated AS (
  SELECT row_no, i, min(doc_id) OVER (PARTITION BY bytes) < doc_id AS gone FROM windows
), bytes AS (
  SELECT row_no, i, byte, coalesce(bool_or(gone) OVER w, false) AS gone
  FROM (SELECT row_no, begin + i AS i, substr(part, 2 * i + 1, 2) AS byte
    FROM parts, unnest(range(least(100, n_bytes - begin))) AS t(i)) LEFT JOIN repeated USING (row_no, i)
  WINDOW w AS (PARTITION BY row_no ORDER BY i ROWS 49 PRECEDING)
), runs AS (
  SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY row_no ORDER BY i) AS begins FROM bytes
), counted AS (
  SELECT row_no, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
    string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept
  FROM runs GROUP BY row_no
)
SELECT doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM texts LEFT JOIN counted USING (row_no)"""


def op13_turns(spark, sf_dir):
    return turns.repair_report(table(spark, sf_dir, "conversations"))


def _op13_sql() -> str:
    """The best repair of every end of a conversation in each state of the grammar, by recursion from its end."""
    after = {state: {role: to for (role, s), to in turns.AFTER.items() if s == state} for state in range(4)}

    def put(edit: str, price: str, rest: str, line: str) -> str:
        """``rest`` with one edit before it; a line goes before its lines where it is not null."""
        lines = f"list_prepend({line}, {rest}.lines)" if line else f"{rest}.lines"
        return f"{{'cost': {rest}.cost + {price}, 'audit': '{edit}' || {rest}.audit, 'lines': {lines}}}"

    def best(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def inserted(names: list[str]) -> list[str]:
        out = []
        for state in range(4):
            new = turns.WANTED[state]
            out.append(best(names[state], put("I", "2", names[after[state][new]], f"'{turns.ROLES[new]}:'")))
        return out

    def row(state: int) -> str:
        new = turns.WANTED[state]
        cases = [f"[{put('D', '3', f's{state}', '')}]"]
        change = put("R", "2 + (fault = 'truncated')::BIGINT", f"s{after[state][new]}", f"'{turns.ROLES[new]}:' || text")
        keeps = " ".join(
            f"WHEN role[1] = '{role}' THEN [{put('K', chr(40) + 'fault = ' + chr(39) + 'truncated' + chr(39) + ')::BIGINT', f's{to}', chr(39) * 2 + ' || role || ' + chr(39) + ':' + chr(39) + ' || text')}]"
            for role, to in after[state].items()
        )
        cases.append(f"CASE WHEN fault IN ('blank', 'duplicate') THEN [] ELSE [{change}] END")
        cases.append(f"CASE WHEN fault IN ('blank', 'duplicate') THEN [] {keeps} ELSE [] END")
        whole = cases[0]
        for c in cases[1:]:
            whole = f"list_concat({whole}, {c})"
        return f"list_sort({whole})[1]"

    names = [f"s{i}" for i in range(4)]
    far = "{'cost': 1000000::BIGINT, 'audit': '~', 'lines': []::VARCHAR[]}"
    none = "{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}"
    once = ", ".join(f"{e} AS s{i}" for i, e in enumerate(inserted(names)))
    return f"""
WITH RECURSIVE {CRC_TABLE}, given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(i)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM damaged
), faulty AS MATERIALIZED (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS words,
    CASE WHEN words = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
      WHEN words[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY place) || role[1] AS pair
  FROM ordered
), counted AS (
  SELECT conv_id, max(place) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), ends AS (
  SELECT conv_id, rows + 1 AS place, {once} FROM (
    SELECT conv_id, rows, {once} FROM (
      SELECT conv_id, rows, {none} AS s0, {far} AS s1, {far} AS s2, {none} AS s3 FROM counted))
), best(conv_id, place, s0, s1, s2, s3) AS (
  SELECT * FROM ends
  UNION ALL
  SELECT conv_id, place, {once} FROM (
    SELECT conv_id, place, {once} FROM (
      SELECT f.conv_id, f.place, {", ".join(f"{row(i)} AS s{i}" for i in range(4))}
      FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.place = b.place - 1))
), every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, {", ".join(f"coalesce(c.{n}, 0)::BIGINT AS {n}" for n in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
  coalesce(b.s0.cost, 0)::BIGINT AS cost, coalesce(b.s0.audit, '') AS audit,
  sha256(coalesce(array_to_string(b.s0.lines, chr(10)), '')) AS repaired_sha256
FROM every e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id AND b.place = 1 AND c.conv_id IS NOT DISTINCT FROM e.conv_id"""


QUERIES = {
    "op1_compression_quality": op1_compression_quality,
    "op2_topk": op2_topk,
    "op3_quality_rules": op3_quality_rules,
    "op4_langid": op4_langid,
    "op5_lattice_lm": op5_lattice_lm,
    "op6_secrets": op6_secrets,
    "op7_mixing": op7_mixing,
    "op8_bpe": op8_bpe,
    "op9_substrings": op9_substrings,
    "op10_simhash": op10_simhash,
    "op11_merkle": op11_merkle,
    "op12_suffixes": op12_suffixes,
    "op13_turns": op13_turns,
}

ORACLE: dict[str, str] = {
    "op2_topk": OP2,
    "op6_secrets": _op6_sql(),
    "op9_substrings": OP9,
    "op11_merkle": _op11_sql(),
    "op12_suffixes": OP12,
    "op13_turns": _op13_sql(),
}
