"""DuckDB SQL for those of the package's queries that SQL can express."""

from __future__ import annotations

WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _window(n: int) -> str:
    """The n words from here on, joined; null near the text's end. A word holds no space, so windows are equal iff these are."""
    return " || ' ' || ".join(["x", *(f"lead(x, {k}) OVER (PARTITION BY doc_id ORDER BY i)" for k in range(1, n))])


def quality(limits) -> str:
    """Op 6: the figures and the verdict of gridseek.llm.quality."""
    parts = [f"w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents)", "t AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w)"]
    for n in sorted({3, *limits.ngram_chars}):
        parts.append(f"g{n} AS (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, i, {_window(n)} AS g FROM t) WHERE g IS NOT NULL)")
        parts.append(f"c{n} AS (SELECT doc_id, count(*) AS n, sum(length(x)) AS chars FROM (SELECT DISTINCT doc_id, i + o AS i FROM g{n}, range(0, {n}) AS r(o) WHERE c > 1) JOIN t USING (doc_id, i) GROUP BY doc_id)")
    parts.append("l AS (SELECT doc_id, line, sum(length(x)) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS k FROM (SELECT doc_id, line, pos, unnest(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM w)) GROUP BY doc_id, line, pos)")
    parts.append("d AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (k > 1) AS n, coalesce(sum(chars) FILTER (k > 1), 0) AS chars FROM l GROUP BY doc_id)")
    joins = " ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in sorted({3, *limits.ngram_chars}))
    over = " OR ".join(f"100 * coalesce(c{n}.chars, 0) > {most} * word_chars" for n, most in limits.ngram_chars.items())
    parts.append(
        "m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, "
        f"coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(c3.n, 0)::BIGINT AS n_repeat_words, ({over}) AS repeats, coalesce(d.lines, 0) AS lines, coalesce(d.chars, 0) AS line_chars FROM w LEFT JOIN d USING (doc_id) {joins})"
    )
    return f"""WITH {", ".join(parts)}
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_words} * n_words AS base_failed,
          NOT (n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_words} * n_words OR repeats OR 100 * n_dup_lines > {limits.lines} * lines OR 100 * line_chars > {limits.line_chars} * word_chars OR 100 * n_symbols > {limits.symbols} * n_words) AS kept FROM m"""


#: Op 8: targets by the fill level, then whole buckets of the hash in order.
MIX = f"""
    WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY source),
    r AS (SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
    f AS (SELECT *, 2 * words / weight AS fill FROM r),
    k AS (SELECT *, sum(2 * words) OVER o - 2 * words AS taken_before, sum(weight) OVER () - sum(weight) OVER o + weight AS weight_left FROM f WINDOW o AS (ORDER BY fill, source NULLS LAST)),
    l AS (SELECT *, max((1.5::DOUBLE * (SELECT sum(words) FROM s) - taken_before) / weight_left) OVER () AS level FROM k),
    t AS (SELECT source, words, least(weight * level, 2 * words)::DOUBLE AS target FROM l),
    b AS (SELECT source, h >> 12 AS b, sum(size) AS n FROM d GROUP BY ALL),
    u AS (SELECT b.source, b, n, sum(n) OVER (PARTITION BY b.source ORDER BY b) AS upto, target - floor(target / words) * words AS rest FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source WHERE words > 0),
    e AS (SELECT source, min(b) FILTER (upto > rest) AS edge FROM u GROUP BY source),
    x AS (SELECT u.source, u.b FROM u JOIN e ON u.source IS NOT DISTINCT FROM e.source WHERE edge IS NULL OR b < edge OR (b = edge AND upto - n / 2 <= rest))
    SELECT doc_id, size, words AS source_size, target, (size * (CASE WHEN words > 0 THEN floor(target / words) ELSE 0 END + CASE WHEN x.b IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h >> 12 = x.b
"""

#: Op 4: every window, numbered among its equals.
SUBSTRING = f"""
    WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
    t AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
    g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM (SELECT doc_id, i, {_window(20)} AS g FROM t) WHERE g IS NOT NULL),
    r AS (SELECT DISTINCT doc_id, i + o AS i FROM g, range(0, 20) AS q(o) WHERE k > 1),
    m AS (SELECT t.doc_id, count(r.i) AS gone, string_agg(x, ' ' ORDER BY i) FILTER (r.i IS NULL) AS kept FROM t LEFT JOIN r USING (doc_id, i) GROUP BY t.doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN m USING (doc_id)
"""
_TEXT = "'<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)"
_SIDE = """string_agg({text}, '' ORDER BY k) AS {c}_text, string_agg((spot + length(t.role) + 5)::VARCHAR || '-' || (spot + length(t.role) + length(t.text) + 13)::VARCHAR, ',' ORDER BY k) FILTER (t.role = 'assistant') AS {c}_spans"""


def _side(c: str) -> str:
    """The completion of one side: its turns after the common ones, rendered, with the answers' places."""
    places = f"(SELECT conv_id, unnest({c}[n + 1:]) AS t, generate_subscripts({c}[n + 1:], 1) AS k FROM cut)"
    run = f"(SELECT *, coalesce(sum(length({_TEXT})) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM {places})"
    return f"{c}_side AS (SELECT conv_id, {_SIDE.format(text=_TEXT, c=c)} FROM {run} GROUP BY conv_id)"


#: Op 2: conversations 2i and 2i + 1 lend each other their last answers.
PREFERENCE = f"""
    WITH c AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn, role, text) AS chosen FROM conversations GROUP BY conv_id),
    l AS (SELECT *, coalesce(list_max(list_transform(chosen, lambda t, i: CASE WHEN t.role = 'assistant' THEN i ELSE 0 END)), 0) AS last FROM c),
    p AS (SELECT a.conv_id, b.conv_id AS partner, a.chosen, CASE WHEN a.last = 0 THEN a.chosen WHEN b.last > 0 THEN list_append(a.chosen[:a.last - 1], b.chosen[b.last]) ELSE a.chosen[:a.last - 1] END AS rejected FROM l a LEFT JOIN l b ON b.conv_id = xor(a.conv_id, 1)),
    m AS (SELECT *, list_position(list_transform(range(1, greatest(len(chosen), len(rejected)) + 1), lambda i: chosen[i] IS NOT DISTINCT FROM rejected[i]), false) AS d FROM p),
    cut AS (SELECT *, CASE WHEN d IS NULL OR d = 0 THEN len(chosen) ELSE d - 1 END AS n FROM m),
    {_side("chosen")}, {_side("rejected")},
    prompt AS (SELECT conv_id, string_agg({_TEXT}, '' ORDER BY k) AS prompt FROM (SELECT conv_id, unnest(chosen[:n]) AS t, generate_subscripts(chosen[:n], 1) AS k FROM cut) GROUP BY conv_id)
    SELECT conv_id, partner, n::INTEGER AS n_prompt_turns, sha256(coalesce(prompt, '')) AS prompt_sha256, sha256(coalesce(chosen_text, '')) AS chosen_sha256, coalesce(chosen_spans, '') AS chosen_spans,
      sha256(coalesce(rejected_text, '')) AS rejected_sha256, coalesce(rejected_spans, '') AS rejected_spans
    FROM cut LEFT JOIN prompt USING (conv_id) LEFT JOIN chosen_side USING (conv_id) LEFT JOIN rejected_side USING (conv_id)
"""


def sharding(table: list[int]) -> str:
    """Op 7: the slot from the id's md5, its shard from the table."""
    return f"""WITH s AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {len(table)} AS slot FROM documents)
        SELECT doc_id, slot, ({table})[slot + 1]::BIGINT AS shard FROM s"""


def vector_codes(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Op 13: Lloyd's rounds in the open, every part measured against every entry."""
    near = "(SELECT r, j, e, d FROM (SELECT x.r, x.j, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN {b} b USING (j)) QUALIFY row_number() OVER (PARTITION BY r, j ORDER BY d, e) = 1)"
    floor = "(s - ((s % n) + n) % n) // n"
    steps = [
        "k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        f"x AS MATERIALIZED (SELECT r, vec_id, j, list_transform(embedding[j * len(embedding) // {parts} + 1 : (j + 1) * len(embedding) // {parts}], lambda y: floor({scale} * y::DOUBLE)::BIGINT) AS v FROM k, range({parts}) AS t(j))",
        f"f AS (SELECT r, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS e FROM k QUALIFY e < {entries})",
        "b0 AS MATERIALIZED (SELECT j, e, v FROM x JOIN f USING (r))",
    ]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED {near.format(b=f'b{i}')}")
        steps.append(f"m{i} AS (SELECT j, e, c, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT j, e, unnest(v) AS y, generate_subscripts(v, 1) AS c FROM a{i} JOIN x USING (r, j)) GROUP BY ALL)")
        steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.j, b.e, coalesce(u.v, b.v) AS v FROM b{i} b LEFT JOIN (SELECT j, e, list(({floor})::BIGINT ORDER BY c) AS v FROM m{i} GROUP BY j, e) u USING (j, e))")
    steps.append(f"o AS MATERIALIZED (SELECT r, string_agg(printf('%02x', e), '' ORDER BY j) AS code, sum(d)::BIGINT AS error FROM {near.format(b=f'b{rounds}')} GROUP BY r)")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY j, e)) FROM b{rounds}) AS codebooks_sha256 FROM o JOIN k USING (r)"""


#: The remainders of the 256 bytes by the reflected polynomial of CRC-32.
_CRC = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384)))"

#: Op 12: features by string, each hashed once; DuckDB has no CRC-32, so it is made of the table above.
RESAMPLE = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws, false AS goal FROM documents
      UNION ALL SELECT -row_number() OVER (), NULL, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> ''), true FROM benchmark),
    f AS MATERIALIZED (SELECT r, goal, g, count(*) AS n FROM (SELECT r, goal, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM d) GROUP BY ALL),
    t AS MATERIALIZED (SELECT {_CRC} AS crc),
    h AS MATERIALIZED (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hex(g)) // 2), lambda i: ('0x' || hex(g)[2 * i + 1 : 2 * i + 2])::BIGINT)), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS b FROM (SELECT DISTINCT g FROM f), t),
    c AS (SELECT b, coalesce(sum(n) FILTER (NOT goal), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (goal), 0)::DOUBLE AS t FROM f JOIN h USING (g) GROUP BY b),
    k AS MATERIALIZED (SELECT b, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM c) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000))))::BIGINT AS gain FROM c),
    w AS (SELECT r, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS s FROM f JOIN h USING (g) JOIN k USING (b) WHERE NOT goal GROUP BY r),
    o AS (SELECT doc_id, len(ws) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce((s - ((s % n) + n) % n) // n, 0)::BIGINT AS weight, (('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS u FROM d LEFT JOIN w USING (r) WHERE NOT goal),
    p AS (SELECT *, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM o),
    q AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place FROM p)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * (SELECT count(*) FROM p WHERE n_words >= 20) // 100 THEN place END AS rank FROM q
"""
