"""Thin queries that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .conversations import damaged, repair_conversations
from .exact_dedup import exact_dedup
from .html_text import extract_pages
from .jaccard_join import similar_components
from .kmeans import clusters
from .minhash import minhash_components
from .mixing import mix_documents
from .packing import harmonic_pack
from .quality import quality_model, quality_scores
from .token_counts import token_counts
from .topk import exact_top_k
from .url_filter import DAMPING, EXCESS, RULES, judge_urls
from .warc import REVISIT_BYTES, archive_round_trip


def tokenizer_path(name: str) -> str:
    """Place of an installed public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(_table(spark, sf_dir, "pages"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of shingle similarity 0.75."""
    return similar_components(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = _table(spark, sf_dir, "documents")
    model = quality_model(docs, _table(spark, sf_dir, "labels"))
    return quality_scores(docs, model).select("doc_id", "held_out", "score", "predicted")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row that stays for every document's text."""
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best matches of every 50th vector."""
    return exact_top_k(_table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of every document's tokens in sequences of at most 4096."""
    return harmonic_pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rate and copies of every document."""
    return mix_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every page after an archive was written and read."""
    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return judge_urls(_table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    conversations = _table(spark, sf_dir, "conversations")
    return repair_conversations(damaged(conversations), conversations)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after five rounds."""
    return clusters(_table(spark, sf_dir, "embeddings"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of shingle similarity 0.8."""
    return minhash_components(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_text,
        op2_jaccard_join,
        op3_quality,
        op4_exact_dedup,
        op5_top_k,
        op6_packing,
        op7_mixing,
        op8_warc,
        op9_url_filter,
        op10_token_counts,
        op11_conversation_repair,
        op12_centroids,
        op13_minhash,
    )
}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _url_sql(rounds: int = 80) -> str:
    """Rules as a case expression, and as many rounds of both propagations, one by one, as bring any change below what is looked at."""
    rules = sorted(RULES, key=lambda r: -len(r.name))
    fits = [f"(host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}')" for r in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r.name}'" for f, r in zip(fits, rules)) + " END"
    says = "CASE " + " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, rules)) + " END"
    out = []
    for name, seed, a, b in (("t", "good", "src", "dst"), ("d", "bad", "dst", "src")):
        out.append(f"{name}s AS (SELECT {a} AS a, {b} AS b, w / sum(w) OVER (PARTITION BY {a}) AS share FROM links)")
        out.append(f"{name}0 AS (SELECT host, {1 - DAMPING} * {seed} AS score FROM seeds WHERE {seed} > 0)")
        for k in range(1, rounds + 1):
            moved = f"SELECT s.b AS host, {DAMPING} * p.score * s.share AS score FROM {name}s s JOIN {name}{k - 1} p ON p.host = s.a"
            out.append(f"{name}{k} AS (SELECT host, sum(score) AS score FROM ({moved} UNION ALL SELECT * FROM {name}0) GROUP BY host)")
    link = r"""(?i)<a\s[^>]*?href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"''\s>]*)"""
    return rf"""
        WITH u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), {_UPPER}, {_LOWER}) AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        j AS (SELECT *, {rule} AS rule, {says} AS says FROM p),
        seeds AS (SELECT host, avg(CASE WHEN says = 'allow' THEN 1.0 ELSE 0 END) AS good, avg(CASE WHEN says = 'block' THEN 1.0 ELSE 0 END) AS bad
                  FROM j WHERE host <> '' GROUP BY host),
        named AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), {_UPPER}, {_LOWER}) AS dst FROM p),
        links AS (SELECT src, dst, count(*)::DOUBLE AS w FROM named WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
        {", ".join(out)},
        blocked AS (SELECT d.host FROM d{rounds} d LEFT JOIN t{rounds} t USING (host)
                    WHERE round(d.score - coalesce(t.score, 0), 12) > {EXCESS * (1 - DAMPING)})
        SELECT page_id, host, path, rule,
               coalesce(says, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM j
    """


def _near_sql(width: int, percent: int, more: str) -> str:
    return rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(1, len(words) - {width - 1}) + 1), lambda i: array_to_string(words[i:i + {width - 1}], ' ')))) AS shingle
              FROM w WHERE len(words) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id{more}
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id
    """


def _cluster_sql(rounds: int = 5, k: int = 40) -> str:
    """Every distance in each round, rounds one by one."""
    apart = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    near = lambda r: f"SELECT rn, min({{'d': {apart}, 'j': c.j}}) AS m FROM v CROSS JOIN c{r} c GROUP BY rn"
    steps = []
    for r in range(1, rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({near(r - 1)})")
        steps.append(f"p{r} AS (SELECT a.m.j AS j, unnest(v.q) AS x, unnest(range(1, 65)) AS i FROM a{r} a JOIN v USING (rn))")
        steps.append(f"s{r} AS (SELECT j, i, sum(x)::BIGINT AS s, count(*) AS n FROM p{r} GROUP BY j, i)")
        steps.append(f"m{r} AS (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM s{r} GROUP BY j)")
        steps.append(f"c{r} AS MATERIALIZED (SELECT c.j, coalesce(m.q, c.q) AS q FROM c{r - 1} c LEFT JOIN m{r} m ON m.j = c.j)")
    return f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, row_number() OVER () AS rn, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
        o AS (SELECT q, row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), q) - 1 AS j FROM v WHERE vec_id IS NOT NULL),
        c0 AS MATERIALIZED (SELECT j, q FROM o WHERE j < {k}),
        {", ".join(steps)},
        z AS MATERIALIZED ({near(rounds)})
        SELECT v.vec_id, z.m.j::INTEGER AS cluster, z.m.d AS distance, sum(z.m.d) OVER (PARTITION BY z.m.j)::BIGINT AS cluster_inertia,
               sum(z.m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
        FROM z JOIN v USING (rn) JOIN c{rounds} c ON c.j = z.m.j
    """


def _repair_sql() -> str:
    """The lattice read turn by turn: least (cost, audit) of each grammar state, with insertions before each turn and at the end."""

    def least(*paths: tuple[str, int, str, str]) -> str:
        """Least of paths: a state before, a cost, an edit, and when it is allowed."""
        one = "{{'c': {0}.c + {1}, 'a': {0}.a || '{2}'}}"
        some = [one.format(s, c, e) if not when else f"CASE WHEN {when} THEN {one.format(s, c, e)} END" for s, c, e, when in paths]
        return f"list_min([{', '.join(some)}])"

    ins = (("z", 3, "I", ""), ("s", 3, "I", ""), ("a", 3, "I", ""))
    closed = f"SELECT conv_id, i, z, s, {least(('u', 0, '', ''), *ins)} AS u, a"
    full = f"SELECT conv_id, i, z, s, u, {least(('a', 0, '', ''), ('u', 3, 'I', ''))} AS a"
    go, cut = "fault IN ('', 't')", "CASE WHEN fault = 't' THEN 3 ELSE 0 END"
    keep = lambda s, k: (s, cut, "K", f"{go} AND initial = '{k}'")
    write = lambda s: (s, f"3 + {cut}", "R", go)
    gone = lambda s: (s, 4, "D", "")
    z, st = least(gone("z")), least(gone("s"), keep("z", "s"))
    u = least(gone("u"), *[x for s in "zsa" for x in (keep(s, "u"), write(s))])
    a = least(gone("a"), keep("u", "a"), write("u"))
    far = "{'c': 1000000000000::BIGINT, 'a': ''}"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    bits = f"list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({key}, ''), lambda b: [ascii(b)::BIGINT, 0, 0, 0, 0, 0, 0, 0])))"
    crc = f"xor(list_reduce({bits}, lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"
    order = "turn NULLS FIRST, role, left(text, 64), sha256(len(role) || ':' || role || text)"
    return rf"""
        WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS hit FROM conversations),
        d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
                     CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS again FROM h WHERE hit <> 0),
        n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {order}) AS i FROM d),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM n),
        f AS MATERIALIZED (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior,
                     CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'r'
                          WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM o),
        p AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS z, {far} AS s, {far} AS u, {far} AS a FROM f
              UNION ALL
              SELECT f.conv_id, f.i, {z}, {st}, {u}, {a} FROM ({full} FROM ({closed} FROM p)) q JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.i = q.i + 1),
        e AS (SELECT conv_id, i, list_min([z, a]) AS best FROM ({full} FROM ({closed} FROM p))),
        g AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'r') AS duplicate,
                     count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
        b AS (SELECT g.*, e.best.c AS cost, e.best.a AS audit FROM g JOIN e ON e.conv_id IS NOT DISTINCT FROM g.conv_id AND e.i = g.n),
        x AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, len(audit) + 1)) AS pos FROM b WHERE audit <> ''),
        y AS (SELECT *, sum((edit <> 'I')::INT) OVER w AS i, sum((edit <> 'D')::INT) OVER w AS m FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
        t AS (SELECT y.conv_id, y.pos, y.m, y.edit, f.text, f.role, max(CASE WHEN y.m = 1 AND y.edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY y.conv_id) AS led
              FROM y LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM y.conv_id AND f.i = y.i WHERE y.edit <> 'D'),
        l AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS body
              FROM t GROUP BY conv_id),
        ids AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT ids.conv_id, coalesce(b.gaps, 0)::BIGINT AS gaps, coalesce(b.blank, 0)::BIGINT AS blank, coalesce(b.duplicate, 0)::BIGINT AS duplicate, coalesce(b.truncated, 0)::BIGINT AS truncated,
               coalesce(b.illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(l.body, '')) AS repaired_sha256
        FROM ids LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM ids.conv_id
    """


ORACLES = {
    "op2_jaccard_join": _near_sql(5, 75, ""),
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_NORM} AS norm, length(coalesce(text, '')) AS n FROM documents),
        r AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id,
                     count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w AS place
              FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
    """,
    "op5_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
              FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op8_warc": f"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        s AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM s)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < top THEN top END AS refers_to FROM m
    """,
    "op9_url_filter": _url_sql(),
    "op11_conversation_repair": _repair_sql(),
    "op12_centroids": _cluster_sql(),
    "op13_minhash": _near_sql(4, 80, ", d.doc_id = m.component_id AS kept"),
}
