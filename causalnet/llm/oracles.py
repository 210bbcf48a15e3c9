"""DuckDB SQL for those operators that SQL can express, over the same tables."""

from __future__ import annotations

from itertools import permutations

from causalnet.llm import rules
from causalnet.llm.textstats import CLASSES

_WORD = r"[^\x20\x09-\x0D]+"


def _classes() -> str:
    """Columns k0, k1, ...: characters of each class, each taken out of what the former left."""
    rest, out = "t", []
    for i, pattern in enumerate(CLASSES.values()):
        less = f"regexp_replace({rest}, '{pattern.replace(chr(39), chr(39) * 2).replace(chr(92) + 's', '[' + chr(92) + 't-' + chr(92) + 'r ]')}', '', 'g')"
        out.append(f"length({rest}) - length({less}) AS k{i}")
        rest = less
    return ", ".join([*out, f"length({rest}) AS k{len(CLASSES)}"])


def quality_rules() -> str:
    n_classes = len(CLASSES) + 1
    failed = f"(n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words)"
    part = lambda v: f"CASE WHEN {v} > 0 THEN {v} * log2({v} / ((p + q) / 2)) ELSE 0 END"
    js = f"sqrt(greatest(0, sum({part('p')} + {part('q')}) / 2))"

    def distances(name: str, refs: str) -> str:
        return (
            f"{name} AS (SELECT g.k, max(CASE WHEN g.kind = 'c' THEN js END) AS js_char, max(CASE WHEN g.kind = 'w' THEN js END) AS js_word FROM "
            f"(SELECT s.k, s.kind, {js} AS js FROM shares s JOIN x USING (k) JOIN {refs} r ON r.l = x.l AND r.kind = s.kind AND r.i = s.i GROUP BY 1, 2) g GROUP BY 1)"
        )

    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
named AS (SELECT lang FROM d WHERE lang <> '' GROUP BY 1 HAVING count(*) >= {rules.LEAST_DOCUMENTS}),
x AS (SELECT k, doc_id, t, CASE WHEN lang IN (SELECT lang FROM named) THEN lang ELSE '' END AS l, regexp_extract_all(t, '{_WORD}') AS w FROM d),
refs AS (SELECT l FROM x GROUP BY 1 HAVING l <> '' OR count(*) >= {rules.LEAST_DOCUMENTS}),
word AS (SELECT k, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM x),
frequent AS (SELECT l, v, row_number() OVER (PARTITION BY l ORDER BY n DESC, v) AS i FROM (SELECT l, lower(v) AS v, count(DISTINCT k) AS n FROM word JOIN x USING (k) WHERE l IN (SELECT l FROM refs) GROUP BY 1, 2) QUALIFY i <= {rules.FREQUENT}),
trio AS (SELECT k, i, v || ' ' || lead(v) OVER o || ' ' || lead(v, 2) OVER o AS g FROM word WINDOW o AS (PARTITION BY k ORDER BY i)),
twice AS (SELECT k, i FROM trio WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
again AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS s(j) GROUP BY 1),
base AS (SELECT x.k, doc_id, l, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
 len(list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '{_WORD}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '{_WORD}')))) AS n_dup_lines,
 coalesce(n_repeat_words, 0) AS n_repeat_words, {_classes()} FROM x LEFT JOIN again ON again.k = x.k),
counts AS ({" UNION ALL ".join(f"SELECT k, 'c' AS kind, {i} AS i, k{i} AS n FROM base" for i in range(n_classes))} UNION ALL
 SELECT x.k, 'w', f.i, count(word.v) FROM x JOIN frequent f USING (l) LEFT JOIN word ON word.k = x.k AND lower(word.v) = f.v GROUP BY 1, 2, 3),
every AS (SELECT * FROM counts UNION ALL SELECT b.k, 'w', 0, n_words - sum(n) FROM counts c JOIN base b ON b.k = c.k AND c.kind = 'w' GROUP BY b.k, n_words),
shares AS (SELECT k, kind, i, n, coalesce(n / nullif(sum(n) OVER (PARTITION BY k, kind), 0), 0) AS p FROM every),
first AS (SELECT base.l, kind, i, avg(p) AS q FROM shares JOIN base USING (k) WHERE NOT {failed} AND l IN (SELECT l FROM refs) GROUP BY 1, 2, 3),
{distances("far", "first")},
near AS (SELECT k FROM (SELECT base.k, l, sqrt(js_char ** 2 + js_word ** 2) AS j FROM far JOIN base USING (k) WHERE NOT {failed}) QUALIFY j <= avg(j) OVER (PARTITION BY l) + 1e-12),
second AS (SELECT base.l, kind, i, avg(p) AS q FROM shares JOIN base USING (k) WHERE k IN (SELECT k FROM near) GROUP BY 1, 2, 3),
{distances("fin", "second")}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, {failed} AS base_failed,
 NOT {failed} AND coalesce(sqrt(js_char ** 2 + js_word ** 2) <= {rules.LIMIT} + {rules.ALLOWANCE} / sqrt(n_words), true) AS kept, round(js_char, 6) + 0.0 AS js_char, round(js_word, 6) + 0.0 AS js_word
FROM base LEFT JOIN fin USING (k)""".strip()


def mixing(weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, cap: int = 2, seed: int = 42) -> str:
    """The fair queue: targets filled up by weight, flows in the order of md5, finish times cut at the budget."""
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size, md5(concat_ws('|', '{seed}', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))) AS turn FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS s FROM d GROUP BY 1),
w AS (SELECT *, CASE s % {len(weights)} {" ".join(f"WHEN {i} THEN {float(v)}" for i, v in enumerate(weights))} END AS weight, {budget} * sum(source_size) OVER () AS total FROM src),
o AS (SELECT *, {float(cap)} * source_size / weight AS ratio, row_number() OVER (ORDER BY {float(cap)} * source_size / weight, s) AS r FROM w),
lv AS (SELECT *, (total - {float(cap)} * coalesce(sum(source_size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM o),
f AS (SELECT min(r) AS r FROM lv WHERE level < ratio),
t AS (SELECT source, s, source_size, total, CASE WHEN (SELECT r FROM f) IS NULL OR lv.r < (SELECT r FROM f) THEN {float(cap)} * source_size ELSE (SELECT level FROM lv l2 WHERE l2.r = (SELECT r FROM f)) * weight END AS target FROM lv),
p AS (SELECT d.*, t.s, t.source_size, t.target, t.total, sum(size) OVER (PARTITION BY t.s ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT p.*, e, (upto + e * source_size) / target AS f FROM p, range(0, {cap}) AS r(e) WHERE size > 0 AND target > 0),
q AS (SELECT doc_id, turn, size, total, sum(size) OVER (ORDER BY f, turn, s, e ROWS UNBOUNDED PRECEDING) AS used FROM c),
n AS (SELECT doc_id, turn, count(*) AS n FROM q WHERE used <= total GROUP BY 1, 2)
SELECT p.doc_id, p.size::BIGINT AS size, p.source_size, round(p.target, 6) + 0.0 AS target, (coalesce(n.n, 0) * p.size)::BIGINT AS taken FROM p LEFT JOIN n ON n.doc_id IS NOT DISTINCT FROM p.doc_id AND n.turn = p.turn""".strip()


def filter_audit() -> str:
    """Verdicts as a bit mask per document, counted by mask and part, summed for each place in each order."""
    orders = ", ".join(f"('{''.join(o)}')" for o in permutations("ABCDE"))
    bit = "(1 << (position(f IN 'ABCDE') - 1))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
v AS (SELECT part, (len(w) < 200)::INTEGER + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INTEGER + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::INTEGER
 + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER + 16 * coalesce(first < doc_id, false)::INTEGER AS m, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, m, count(*) AS n, count_if(good) AS g, count_if(toxic) AS x FROM v GROUP BY 1, 2),
s AS (SELECT o AS filter_order, step, substr(o, step, 1) AS f, coalesce(list_sum([1 << (position(substr(o, j, 1) IN 'ABCDE') - 1) for j in range(1, step)]), 0)::INTEGER AS b FROM (VALUES {orders}) AS t(o), range(1, 6) AS r(step)),
k AS (SELECT part, filter_order, step, f, sum(CASE WHEN m & (b | {bit}) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & b = 0 AND m & {bit} <> 0 THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN m & b <> 0 AND m & {bit} <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = {bit} THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN m & b = 0 AND m & {bit} <> 0 THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN m & b = 0 AND m & {bit} <> 0 THEN x ELSE 0 END) AS toxic_lost FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
 toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM k""".strip()


def fill_in_middle(seed: int = 42, rate: int = 50, spm: int = 80) -> str:
    """Tokens as a list, cut by list slices. A text has no mark where the form is not plain, so it is its own restoration."""
    piece = lambda a, b: f"coalesce(array_to_string(list_slice(w, {a}, {b}), ''), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, {", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))} FROM d),
n AS (SELECT *, len(w) AS n, h1 % (len(w) + 1) AS r1, h2 % (len(w) + 1) AS r2 FROM w),
f AS (SELECT *, least(r1, r2) AS k1, greatest(r1, r2) AS k2, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, {piece('1', 'k1')} AS a, {piece('k1 + 1', 'k2')} AS m, {piece('k2 + 1', 'n')} AS z FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""".strip()


def near_vectors(threshold: float = 0.95) -> str:
    """All pairs; components by the least id that spreads along links."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_sum(list_transform(e, lambda c: c * c)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {threshold}),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id AND l.b > r.c),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY 1),
k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN k ON a = vec_id""".strip()


ORACLES: dict[str, str] = {"op5_quality_rules": quality_rules(), "op8_mixing": mixing(), "op11_filter_audit": filter_audit(), "op12_fill_in_middle": fill_in_middle(), "op13_vectors": near_vectors()}
