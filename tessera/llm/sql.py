"""DuckDB SQL of the opN_ queries."""

import re

from tessera.llm.licenses import TEMPLATES

_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {}

ORACLE["op1_decontaminate"] = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g, least(10, len(w)) AS n
  FROM b, unnest(range(1, greatest(2, len(w) - 8))) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item FROM dw JOIN win USING (g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _pattern(template: str) -> str:
    """A template as a regular expression over words with one blank before each and after the last."""
    out = []
    for mark in re.findall(r"<<.*?>>|[^<]+", template):
        if m := re.fullmatch(r"<<var (\d+)>>", mark):
            out.append(f"( [^ ]+){{0,{m[1]}}}")
        elif mark.startswith("<<"):
            out.append("(" if mark == "<<optional>>" else ")?")
        else:
            out += [f" {w}" for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", mark.lower())]
    return "".join(out) + " "


ORACLE["op3_licenses"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (
  SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' AND w[i + 1] = 'by') AS cc,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS gpl,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved') AS res
  FROM d),
l AS (
  SELECT doc_id, len(w) AS n_words, list_sort(list_concat(cc, list_concat(gpl, res))) AS places,
    list_filter([CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(res) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL) AS base,
    list_distinct(list_filter([
      {", ".join(f"CASE WHEN regexp_matches(t, '{_pattern(t)}') THEN '{label}' END" for label, t in TEMPLATES)}
    ], lambda x: x IS NOT NULL)) AS found
  FROM p)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
  CAST(places[1] - 1 AS BIGINT) AS first_word, CAST(places[len(places)] - 1 AS BIGINT) AS last_word,
  array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, found))), ',') AS labels,
  CASE WHEN len(found) > 0 THEN 1.0 WHEN len(places) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM l
"""

ORACLE["op4_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS was, lead(role) OVER w AS next
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (
  SELECT *, length(regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?s>|ROLE |/ROLE\]|\+\])', '\1\\\2\3', 'g'))
    + CASE WHEN was = role THEN 3 WHEN role = 'user' THEN 6 WHEN role = 'assistant' THEN 3 ELSE 7 + length(url_encode(role)) END
    + CASE WHEN next = role THEN 0 WHEN role = 'user' THEN 7 WHEN role = 'assistant' THEN 4 ELSE 7 END AS n
  FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


def _ranks(name: str, seed: str, edges: str, steps: int = 64, damping: float = 0.85) -> str:
    out = [
        f"{name}m AS (SELECT greatest(CAST(1 AS DOUBLE), sum({seed})) AS mass FROM nodes)",
        f"{name}0 AS MATERIALIZED (SELECT host, {1 - damping} * {seed} / mass AS base, {1 - damping} * {seed} / mass AS rank FROM graph LEFT JOIN nodes USING (host), {name}m)",
    ]
    for k in range(steps):
        out.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT r.host, r.base, coalesce(r.base, 0) + {damping} * coalesce(f.flow, 0) AS rank FROM {name}{k} r LEFT JOIN "
            f"(SELECT e.dst, sum(coalesce(q.rank, 0) * e.share) AS flow FROM {name}{k} q JOIN {edges} e ON q.host = e.src GROUP BY e.dst) f ON f.dst = r.host)"
        )
    return ",\n".join(out)


ORACLE["op10_url_filter"] = rf"""
WITH u AS (
  SELECT page_id, html,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_ASCII}), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (
  SELECT *, CASE
      WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
      WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
      WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
      WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
      WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule FROM u),
v AS MATERIALIZED (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM r),
nodes AS MATERIALIZED (
  SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS trusted, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS blocked
  FROM v WHERE host <> '' GROUP BY host),
links AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)href=["'']?(?:https?:)?//([^/"''?#\s>]+)', 1)), {_ASCII}) AS dst FROM v WHERE host <> ''),
linked AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM links WHERE dst <> '' AND dst <> src GROUP BY src, dst),
hosts AS (SELECT host FROM nodes UNION SELECT dst FROM linked),
parents AS (
  SELECT src, dst FROM (
    SELECT DISTINCT host AS src, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS dst
    FROM hosts, unnest(range(2, len(string_split(host, '.')))) AS x(i)) WHERE dst <> '' AND dst <> src AND contains(dst, '.')),
edges AS (
  SELECT src, dst, sum(weight) AS weight FROM (
    SELECT src, dst, weight FROM linked UNION ALL SELECT src, dst, 1.0 FROM parents UNION ALL SELECT dst, src, 1.0 FROM parents) GROUP BY src, dst),
graph AS (SELECT host FROM hosts UNION SELECT dst FROM edges),
fwd AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM edges),
bwd AS MATERIALIZED (SELECT dst AS src, src AS dst, weight / sum(weight) OVER (PARTITION BY dst) AS share FROM edges),
{_ranks("t", "trusted", "fwd")},
{_ranks("d", "blocked", "bwd")}
SELECT page_id, v.host, path, rule, coalesce(ruled, CASE WHEN coalesce(d64.rank, 0) - coalesce(t64.rank, 0) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN t64 ON t64.host = v.host LEFT JOIN d64 ON d64.host = v.host
"""

ORACLE["op5_vectors"] = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(id, seen) AS (SELECT vec_id, vec_id FROM e UNION SELECT l.b, r.seen FROM reach r JOIN l ON l.a = r.id),
c AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

ORACLE["op11_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])), 0) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

_HASH = "CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), {}, 8) AS BIGINT)"

ORACLE["op13_fill_middle"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    {", ".join(f"{_HASH.format(8 * k + 1)} AS h{k + 1}" for k in range(4))}
  FROM documents),
c AS (
  SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, array_to_string(list_slice(u, 1, a), '') AS prefix, array_to_string(list_slice(u, a + 1, b), '') AS middle,
    array_to_string(list_slice(u, b + 1, len(u)), '') AS suffix
  FROM c)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
