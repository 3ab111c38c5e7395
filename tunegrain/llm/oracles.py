"""SQL twins, for DuckDB, of the queries that SQL can say."""

from __future__ import annotations

from tunegrain.llm import license_scan, mixing
from tunegrain.llm.url_filter import LOWER, UPPER


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _components(nodes: str, links: str) -> str:
    """``node, component`` by following ``links`` (a, b in both directions) from every node."""
    return f"""
        reach AS (SELECT node AS a, node AS b FROM {nodes} UNION SELECT r.a, l.b FROM reach r JOIN {links} l ON r.b = l.a),
        components AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)"""


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

NEAR_DUPS = f"""
    WITH RECURSIVE good AS (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, len(embedding) AS n FROM embeddings
        WHERE {_FINITE} AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
        SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.label = q.label AND p.n = q.n AND p.vec_id <> q.vec_id
        WHERE list_inner_product(p.e, q.e) / sqrt(list_inner_product(p.e, p.e) * list_inner_product(q.e, q.e)) >= 0.98),
    nodes AS (SELECT vec_id AS node FROM embeddings), {_components("nodes", "links")}
    SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, c.component AS component_id,
           v.vec_id = c.component AS kept
    FROM embeddings v JOIN components c ON c.node = v.vec_id"""

TOP_K = f"""
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {_FINITE}),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
    ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

JACCARD = f"""
    WITH RECURSIVE split AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    sets AS (
        SELECT doc_id, CASE WHEN len(w) > 0 THEN list_distinct(list_transform(
            range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) ELSE [] END AS s FROM split),
    rows AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
    shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM rows p JOIN rows q ON p.shingle = q.shingle AND p.doc_id <> q.doc_id GROUP BY 1, 2),
    links AS (
        SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
        WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)),
    nodes AS (SELECT doc_id AS node FROM documents), {_components("nodes", "links")}
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component AS component_id FROM sets s JOIN components c ON c.node = s.doc_id"""


def _canonical(text: str) -> str:
    low = f"translate({text}, '{UPPER}', '{LOWER}')"
    plain = f"regexp_replace({low}, {_text(license_scan.COPYRIGHT_LINE)}, chr(10), 'g')"
    out = f"' ' || replace(trim(regexp_replace({plain}, {_text(license_scan.NO_WORD)}, ' ', 'g')), ' ', '  ') || ' '"
    for other, one in license_scan.SPELLINGS:
        out = f"replace({out}, ' {other.replace(' ', '  ')} ', ' {one} ')"
    return f"trim(replace({out}, '  ', ' '))"


_KNOWN = ", ".join(f"({_text(name)}, {_text(text)})" for name, text in license_scan.KNOWN)

LICENSES = f"""
    WITH known AS (SELECT md5({_canonical("t")}) AS digest, min(l) AS license FROM (VALUES {_KNOWN}) AS k(l, t) GROUP BY 1),
    docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
    found AS (
        SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses
        FROM lines JOIN known ON md5({_canonical("line")}) = known.digest
        WHERE regexp_matches(translate(line, '{UPPER}', '{LOWER}'), 'licen|released|permission|redistribution') GROUP BY doc_id)
    SELECT d.doc_id, d.digest, known.license, coalesce(found.line_licenses, '') AS line_licenses
    FROM (SELECT doc_id, md5({_canonical("text")}) AS digest FROM docs) d
    LEFT JOIN known ON known.digest = d.digest LEFT JOIN found ON found.doc_id = d.doc_id"""


def _case(name: str, weights: dict[str, int]) -> str:
    whens = " ".join(f"WHEN {_text(k)} THEN {v}" for k, v in weights.items())
    return f"CASE {name} {whens} ELSE 1 END" if whens else "1"


def _deal(children: str, parent: str, name: str, keep: str) -> str:
    """``keep``, ``share``: each parent's budget dealt to its children."""
    order = f"PARTITION BY {parent} ORDER BY most / weight, {name}"
    return f"""
        SELECT {keep}, CAST(CASE WHEN fits THEN most ELSE base.rest * weight // base.w END AS BIGINT) AS share
        FROM (SELECT *, min({{'r': most / weight, 'n': {name}, 'rest': rest, 'w': weights}}) FILTER (NOT fits) OVER (PARTITION BY {parent}) AS base
              FROM (SELECT *, most * weights <= rest * weight AS fits
                    FROM (SELECT *, budget - coalesce(sum(most) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                                 sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM ({children}))))"""


def mixing_sql(plan: mixing.Plan) -> str:
    domain = " ".join(f"WHEN regexp_matches(coalesce(source, ''), {_text(p)}) THEN {_text(d)}" for d, p in plan.domains.items())
    root = f"SELECT domain, most, {_case('domain', plan.domain_weights)} AS weight, 0 AS root, budget FROM (SELECT domain, sum(most) AS most FROM leaves GROUP BY domain), total"
    middle = f"SELECT l.domain, lang, l.most, {_case('lang', plan.language_weights)} AS weight, t.share AS budget FROM (SELECT domain, lang, sum(most) AS most FROM leaves GROUP BY ALL) l JOIN top t ON t.domain = l.domain"
    low = f"SELECT l.domain, l.lang, source, l.most, {_case('source', plan.source_weights)} AS weight, m.share AS budget FROM leaves l JOIN middle m ON m.domain = l.domain AND m.lang = l.lang"
    return f"""
        WITH placed AS (
            SELECT doc_id, CASE {domain} ELSE 'other' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens,
                   md5('{plan.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
            FROM documents),
        leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens, sum(tokens) * {plan.epochs} AS most FROM placed GROUP BY ALL),
        total AS (SELECT sum(tokens) * {plan.percent} // 100 AS budget FROM leaves),
        top AS ({_deal(root, "root", "domain", "domain")}),
        middle AS ({_deal(middle, "domain", "lang", "domain, lang")}),
        dealt AS ({_deal(low, "domain, lang", "source", "domain, lang, source")}),
        taken AS (
            SELECT p.*, CASE WHEN l.tokens > 0 THEN share // l.tokens ELSE 0 END AS whole, share, l.tokens AS all_tokens,
                   sum(p.tokens) OVER (PARTITION BY p.domain, p.lang, p.source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto
            FROM placed p JOIN leaves l ON l.domain = p.domain AND l.lang = p.lang AND l.source = p.source
            JOIN dealt d ON d.domain = p.domain AND d.lang = p.lang AND d.source = p.source)
        SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS tokens,
               CAST(least({plan.epochs}, whole + CASE WHEN upto <= share - whole * all_tokens THEN 1 ELSE 0 END) AS BIGINT) AS times
        FROM taken WHERE whole + CASE WHEN upto <= share - whole * all_tokens THEN 1 ELSE 0 END > 0"""

AUDIT = f"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
    l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    u AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
    w AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN u ON g.lang = u.lang AND g.source = u.source GROUP BY g.lang, g.source),
    p AS (SELECT w.lang, w.source, k.term, coalesce(c, 0) AS c,
                 CAST(1 + 1000000000::HUGEINT * (coalesce(c, 0) + 1) // (w.n + v) AS HUGEINT) AS p,
                 CAST(1 + 1000000000::HUGEINT * (k.n + 1) // (l.n + v) AS HUGEINT) AS q
          FROM w JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN u ON u.lang = w.lang AND u.source = w.source AND u.term = k.term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN (SELECT one.lang, one.source, two.source AS item, sum((one.p - two.p) * (one.p - two.p) // two.p) AS value
                         FROM p one JOIN p two ON one.lang = two.lang AND one.term = two.term AND one.source <> two.source
                         GROUP BY one.lang, one.source, two.source) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
    terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE c > 0 AND p > q)
    SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value,
           CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM pairs
    UNION ALL
    SELECT * FROM (SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value,
           CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM terms) WHERE rank <= 200"""


def _assigned(turn: int) -> str:
    """Each vector's nearest centroid of ``c<turn>``; ties go to the smaller number."""
    return f"""
    a{turn} AS (
        SELECT v.r, v.id, v.x, arg_min(c.k, (s.d, c.k)) AS k, min(s.d) AS d
        FROM v CROSS JOIN c{turn} c, LATERAL (
            SELECT CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d) s
        GROUP BY v.r, v.id, v.x)"""


def _moved(turn: int) -> str:
    """The centroids after a round: floors of the means; empty ones stay."""
    return f"""
    m{turn} AS (
        SELECT k, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
            SELECT k, i, sum(e) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{turn}) GROUP BY k, i)),
    c{turn + 1} AS (
        SELECT c.k, coalesce(y.x, c.x) AS x FROM c{turn} c LEFT JOIN (SELECT k, list(x ORDER BY i) AS x FROM m{turn} GROUP BY k) y ON y.k = c.k)"""


CLUSTERS = f"""
    WITH v AS (
        SELECT row_number() OVER () AS r, vec_id AS id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings WHERE {_FINITE} AND len(embedding) = 64 AND vec_id IS NOT NULL),
    c0 AS (
        SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('1:' || id) AS h, x FROM v ORDER BY h, x LIMIT 16)),
    {",".join(f"{_assigned(turn)},{_moved(turn)}" for turn in range(3))},{_assigned(3)}
    SELECT id AS vec_id, CAST(a3.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a3.k) AS BIGINT) AS cluster_inertia,
           CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
    FROM a3 JOIN c3 ON c3.k = a3.k"""


ORACLES = {
    "op3_embedding_near_dups": NEAR_DUPS,
    "op5_ngram_jaccard": JACCARD,
    "op7_mixing": mixing_sql(mixing.Plan()),
    "op8_license_scan": LICENSES,
    "op9_topk_products": TOP_K,
    "op12_source_audit": AUDIT,
    "op13_va_clusters": CLUSTERS,
}
