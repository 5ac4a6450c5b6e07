"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import chat, quality, secrets, urls
from .queries import LISTED_LABELS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(rule: secrets.Rule, rank: int) -> str:
    at = _quoted(rule.pattern)
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, {at})) + 1), lambda i: {{
        'start': CAST(list_sum(list_transform(string_split_regex(t, {at})[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(regexp_extract_all(t, {at})[1:i-1], lambda g: length(g))), 0) AS BIGINT),
        'n': length(regexp_extract_all(t, {at})[i]), 'rank': {rank}, 'kind': '{rule.kind}', 'of': length(regexp_extract_all(t, {at}, {rule.group})[i])}}), lambda s: s['of'] >= {rule.least})"""


def _secrets() -> str:
    rules = secrets.BASE + secrets.MORE
    text = "list_aggregate(list_transform({}, lambda s: s['kind'] || ':' || s['start'] || ':' || (s['start'] + s['n'])), 'string_agg', ',')"
    each = ", ".join(f"{_spans(r, k)} AS s{k}" for k, r in enumerate(rules))
    by = lambda names: f"list_transform(list_sort(list_transform(flatten([{', '.join(names)}]), lambda s: {{'start': s['start'], 'rank': s['rank'], 'n': s['n'], 'kind': s['kind']}})), lambda s: s)"
    base = by(["s0", "s1", "s2"])
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, {each} FROM d)
    SELECT doc_id, CAST(len(s0) AS BIGINT) AS n_assign, CAST(len(s1) AS BIGINT) AS n_access, CAST(len(s2) AS BIGINT) AS n_hex,
        sha256(coalesce({text.format(base)}, '')) AS base_sha256, coalesce({text.format(by([f's{k}' for k in range(len(rules))]))}, '') AS spans FROM f"""


def _urls() -> str:
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    fits = "(h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)
    return f"""WITH u AS (SELECT page_id, url, coalesce({rest}, '') AS rest FROM pages),
    h AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
        list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS q FROM u),
    c AS (SELECT *, CASE WHEN instr(url, '://') > 0 THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canon FROM h),
    listed AS (SELECT DISTINCT canon FROM c WHERE split_part(host, '.', 1) IN ({', '.join(map(_quoted, LISTED_LABELS))}) AND canon IS NOT NULL),
    r(verdict, host, path) AS (VALUES {rules})
    SELECT page_id, host, path,
        (SELECT r.host || r.path FROM r WHERE {fits} ORDER BY length(r.host || r.path) DESC LIMIT 1) AS rule,
        coalesce((SELECT r.verdict FROM r WHERE {fits} ORDER BY length(r.host || r.path) DESC LIMIT 1), CASE WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END) AS verdict,
        coalesce(canon IN (SELECT canon FROM listed), false) AS listed
    FROM c h"""


def _escaped(col: str) -> str:
    out = f"replace(coalesce({col}, ''), '\\', '\\\\')"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


def _chat() -> str:
    marks = len(chat.BEGIN + chat.SEP + chat.END), len(chat.INST + chat.SEP + chat.INST_END)
    said = "'</s>[INST] ok [/INST]'"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', {said} UNION ALL SELECT -1, 1, 'assistant', {said})
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(length({_escaped('role')}) + length({_escaped('text')}) + CASE WHEN role = 'assistant' THEN {marks[0]} ELSE {marks[1]} END) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id"""


def _branches() -> str:
    return """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS node, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
    p(conv_id, leaf, node, role, text, depth) AS (
        SELECT conv_id, node, node, role, text, 0 FROM t WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.conv_id = t.conv_id AND c.node // 2 = t.node AND c.node > 1)
        UNION ALL SELECT p.conv_id, p.leaf, t.node, t.role, t.text, p.depth + 1 FROM p JOIN t ON t.conv_id = p.conv_id AND t.node = p.node // 2 AND p.node > 1),
    l AS (SELECT conv_id, leaf, sum(length(text)) / count(*) AS mean, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY node) AS said,
        coalesce(string_agg(text, '' ORDER BY node) FILTER (role = 'assistant'), '') AS loss FROM p GROUP BY conv_id, leaf),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY mean DESC, leaf) AS place FROM l)
    SELECT conv_id, place, leaf, n_turns, sha256(said) AS turns_sha256, sha256(loss) AS loss_sha256 FROM r WHERE place <= 2"""


def _lines(limit: int = 10) -> str:
    return rf"""WITH l AS (SELECT d.rowid AS r, doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
        FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents) d, range(1, len(string_split(coalesce(text, ''), chr(10))) + 1) AS x(i)),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{urls.UPPER}', '{urls.LOWER}') AS key FROM l),
    f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= {limit})
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
    FROM k LEFT JOIN f ON f.key = k.key GROUP BY r"""


def _quality() -> str:
    risk = {"symbols": "n_symbols / greatest(n_words, 1)", "upper": "n_upper / greatest(word_chars, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "bangs": "n_bangs / greatest(n_words, 1)"}
    each = " UNION ALL ".join(f"SELECT doc_id, stratum, {k} AS r, '{r}' AS rule, CAST({risk[r]} AS DOUBLE) AS risk FROM f" for k, r in enumerate(quality.RULES))
    grid = ", ".join(f"({x})" for x in quality.GRID)
    return rf"""WITH d AS (SELECT doc_id, coalesce(lang, chr(1)) AS stratum, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\t-\r ]+'), lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\t-\r ]')) AS ls FROM documents),
    win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM d, range(1, len(w) - 1) AS n(i)),
    again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
    rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 3) AS m(k) GROUP BY doc_id),
    f AS (SELECT doc_id, stratum, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_bangs
        FROM d LEFT JOIN rep USING (doc_id)),
    v AS ({each}),
    y AS (SELECT doc_id, min(quality) AS y, substr(md5(CAST(doc_id AS VARCHAR) || '/half'), 1, 1) < '8' AS chooses FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
    n AS (SELECT stratum, count(*) FILTER (y = 1 AND NOT chooses) AS n_good FROM f JOIN y USING (doc_id) GROUP BY stratum),
    lev AS (SELECT {quality.DELTA} / count(*) AS level FROM n),
    c AS (SELECT stratum, v.r AS k, rule, cutoff, count(*) FILTER (y = 1 AND risk > cutoff) AS g, count(*) FILTER (y = 0 AND risk > cutoff) AS b FROM v JOIN y USING (doc_id), (VALUES {grid}) AS q(cutoff) WHERE chooses GROUP BY ALL),
    path AS (SELECT stratum, k, rule, cutoff, row_number() OVER (PARTITION BY stratum ORDER BY g, b DESC, k, cutoff DESC) AS j FROM c WHERE b > {quality.GOOD_COSTS} * g),
    fs AS (SELECT stratum, doc_id, min(j) AS j FROM path JOIN v USING (stratum, rule) JOIN y USING (doc_id) WHERE y = 1 AND NOT chooses AND risk > cutoff GROUP BY ALL),
    p AS (SELECT path.stratum, path.k, path.rule, path.cutoff, path.j, n_good, (SELECT count(*) FROM fs WHERE fs.stratum = path.stratum AND fs.j <= path.j) AS g FROM path JOIN n USING (stratum)),
    t AS (SELECT *, list_sum(list_transform(range(0, least(g, n_good) + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({quality.ALPHA!r}) + (n_good - i) * ln(1 - {quality.ALPHA!r})))) <= level AS holds FROM p, lev),
    z AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM t WHERE j < (SELECT coalesce(min(u.j), 1000) FROM t u WHERE u.stratum = t.stratum AND NOT u.holds) GROUP BY stratum, rule),
    no AS (SELECT doc_id, string_agg(rule, ',' ORDER BY v.r) AS rejected_by FROM v JOIN z USING (stratum, rule) WHERE risk > cutoff GROUP BY doc_id),
    j AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f LEFT JOIN no USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by FROM j"""


ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": _quality(),
    "op6_line_dedup": _lines(),
    "op7_secret_scan": _secrets(),
    "op8_url_filter": _urls(),
    "op10_chat_format": _chat(),
    "chat_branches": _branches(),
}
