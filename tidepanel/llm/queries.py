"""Registered queries of the subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.workers import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, tables: str | tuple[str, ...], sql: str | None = None, native: bool = False):
    def wrap(fn: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if not native:
                ship_package(spark)
            return fn(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ([tables] if isinstance(tables, str) else tables)])

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query("op10_exact_dedup", "documents", f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS t FROM documents)""", native=True)
def op10(docs: DataFrame) -> DataFrame:
    from tidepanel.llm.exact import exact_duplicates

    return exact_duplicates(docs)


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query("op7_token_counts", "documents")
def op7(docs: DataFrame) -> DataFrame:
    from tidepanel.llm.token_counts import count_tokens

    return count_tokens(docs, _tokenizer())


@_query("op8_token_files", "documents")
def op8(docs: DataFrame) -> DataFrame:
    from tidepanel.llm.binary_tokens import binary_round_trip

    return binary_round_trip(docs.sparkSession, docs, _tokenizer())


@_query("op4_best_fit_packing", "documents")
def op4(docs: DataFrame) -> DataFrame:
    from tidepanel.llm.packing import pack_documents

    return pack_documents(docs, _tokenizer())


@_query("op2_source_mix", "documents", r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST) AS r FROM s),
l AS (SELECT *, CAST((SELECT sum(size) FROM d) - coalesce(sum(3 * source_size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / CAST(sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM o),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), (SELECT arg_min(level, r) FROM l WHERE level * w <= 3 * source_size) * w) AS target FROM l),
f AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words FROM t),
g AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS full_, CASE WHEN source_size > 0 THEN words % source_size ELSE 0 END AS rest FROM f),
c AS (SELECT d.*, g.source_size, g.target, g.full_, g.rest, size > 0 AND sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) <= rest AS first_,
             CASE WHEN size > 0 THEN CAST(floor(log2(size)) AS INT) END AS j
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
h AS (SELECT *, sum(size) OVER (PARTITION BY source, first_, j ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM c),
z AS (WITH RECURSIVE st AS (
        SELECT source, 40 AS j, CAST(max(rest) - coalesce(sum(size) FILTER (WHERE first_), 0) AS BIGINT) AS lft FROM c GROUP BY source
        UNION ALL SELECT source, j - 1, CAST(lft - coalesce((SELECT max(upto) FROM h WHERE NOT h.first_ AND h.j = st.j AND h.source IS NOT DISTINCT FROM st.source AND h.upto <= st.lft), 0) AS BIGINT)
        FROM st WHERE j >= 0) SELECT * FROM st),
e AS (SELECT h.*, first_ OR coalesce(upto <= z.lft, false) AS once FROM h LEFT JOIN z ON z.j = h.j AND z.source IS NOT DISTINCT FROM h.source),
m AS (SELECT *, rest - sum(CASE WHEN once THEN size ELSE 0 END) OVER (PARTITION BY source) AS missing FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY source, NOT once AND size > 0 AND abs(missing - size) < missing ORDER BY abs(missing - size), k, doc_id, size) AS near FROM m)
SELECT doc_id, size, source, source_size, round(target, 6) AS target,
       CAST(size * (full_ + CASE WHEN once OR (near = 1 AND size > 0 AND abs(missing - size) < missing) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM n""")
def op2(docs: DataFrame) -> DataFrame:
    from tidepanel.llm.mixing import mix_sources

    return mix_sources(docs).withColumn("target", F.round("target", 6))


@_query("op5_simhash", "documents")
def op5(docs: DataFrame) -> DataFrame:
    from tidepanel.llm.simhash import simhash_groups

    return simhash_groups(docs)


@_query("op6_language_id", "documents")
def op6(docs: DataFrame) -> DataFrame:
    from tidepanel.llm.language import identify_language

    return identify_language(docs)


@_query("op1_embedding_dedup", "embeddings")
def op1(vectors: DataFrame) -> DataFrame:
    from tidepanel.llm.embeddings import embedding_links

    return embedding_links(vectors)


@_query("op3_html_text", "pages")
def op3(pages: DataFrame) -> DataFrame:
    from tidepanel.llm.html_text import extract_text

    return extract_text(pages)


@_query("op9_repeated_bytes", "documents")
def op9(docs: DataFrame) -> DataFrame:
    from tidepanel.llm.suffix import remove_repeats

    return remove_repeats(docs)


@_query("op11_warc_packages", "pages", """
SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN octet_length(encode(h)) >= 100 AND page_id > min(page_id) OVER (PARTITION BY h) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(h)) >= 100 AND page_id > min(page_id) OVER (PARTITION BY h) THEN min(page_id) OVER (PARTITION BY h) END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)""")
def op11(pages: DataFrame) -> DataFrame:
    from tidepanel.llm.warc_zip import package_round_trip

    return package_round_trip(pages.sparkSession, pages)


@_query("op12_importance_resampling", ("documents", "benchmark"), rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
bf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
step AS (WITH RECURSIVE r AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
         UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM r WHERE k < 8)
         SELECT list(c ORDER BY i) AS t FROM r WHERE k = 8),
fs AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
fb AS (SELECT f, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
             lambda c, v: xor(step.t[CAST(xor(c, v) & 255 AS BIGINT) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket FROM fs CROSS JOIN step),
s AS (SELECT bucket, count(*) AS s FROM df JOIN fb USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN fb USING (f) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000)::DOUBLE
             / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + 10000)::DOUBLE))) AS BIGINT) AS gain
      FROM (SELECT DISTINCT bucket FROM fb) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM df JOIN fb USING (f) JOIN g USING (bucket) GROUP BY 1),
a AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
             CASE WHEN n_features IS NULL THEN 0 WHEN total < 0 THEN -((n_features - 1 - total) // n_features) ELSE total // n_features END AS weight,
             CAST('0x' || substr(sha256('7:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (doc_id)),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (WHERE n_words >= 20) OVER () AS eligible FROM e)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN n_words >= 20 AND r <= 25 * eligible // 100 THEN CAST(r AS BIGINT) END AS rank FROM k""")
def op12(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    from tidepanel.llm.resample import resample

    return resample(docs, benchmark)


@_query("op13_collocations", "documents", rf"""
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT row_number() OVER () AS piece_id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM q GROUP BY 1),
g AS (SELECT lang, len(x) AS k, array_to_string(x, ' ') AS phrase, x FROM (
      SELECT lang, unnest(list_transform(range(1, len(ws) + 2 - k), lambda i: ws[i:i + k - 1])) AS x FROM q, range(1, 5) t(k) WHERE len(ws) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, any_value(x) AS x, count(*) AS a FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30),
p2 AS MATERIALIZED (SELECT lang, phrase, k, a, j AS cut, array_to_string(x[1:j], ' ') AS lp, array_to_string(x[j + 1:], ' ') AS rp FROM f, range(1, 4) t(j) WHERE j < k),
c AS (SELECT p2.lang, p2.phrase, p2.a, p2.cut, l.a AS l, r.a AS r, CAST((2000000::HUGEINT * p2.a) // (l.a + r.a) AS BIGINT) AS score
      FROM p2 JOIN f l ON l.lang = p2.lang AND l.phrase = p2.lp JOIN f r ON r.lang = p2.lang AND r.phrase = p2.rp),
w AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM c),
o AS (SELECT lang, array_to_string(x[i:i + m - 1], ' ') AS phrase, max(a) AS cover
      FROM f, range(2, 4) t(m), range(1, 4) u(i) WHERE k > m AND i + m - 1 <= k GROUP BY 1, 2),
e AS (SELECT w.lang, w.phrase, w.a, w.l, w.r, w.score, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.phrase) AS rank
      FROM w LEFT JOIN o USING (lang, phrase) WHERE w.nth = 1 AND (cover IS NULL OR 100::HUGEINT * cover < 80::HUGEINT * w.a))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM e JOIN n USING (lang) WHERE rank <= 2000""")
def op13(docs: DataFrame) -> DataFrame:
    from tidepanel.llm.collocations import collocations

    return collocations(docs)
