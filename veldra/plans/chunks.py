"""Queries of chunking, embedding, reranking, prompts and the chunk store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.functions import text as T
from veldra.functions import vec
from veldra.operators import chunking, embed, knn, ordered, quality, rank, store
from veldra.runtime import materialize, read_table, scratch_path

DIM, RETRIEVED, KEPT = 64, 20, 5
#: Templates of the news search.
TEMPLATES = ("disease outbreak {location}", "health advisory {location}", "{location} virus flu season", "{location} public health alert")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def token_estimate(spark, d):
    return _docs(spark, d).filter("text is not null").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


def chunk_fixed(spark, d):
    return _long(chunking.chunk(_docs(spark, d), "fixed"), "chunk_id")


def chunk_recursive(spark, d):
    return _long(chunking.chunk(_docs(spark, d)), "chunk_id")


def chunk_with_metadata(spark, d):
    rows = chunking.chunk(_docs(spark, d), "fixed", keep=("doc_id", "lang", "source"), size=1000, overlap=100)
    return _long(rows, "chunk_id").select("doc_id", "lang", "source", "chunk_id", F.length("chunk").cast("bigint").alias("chars"))


def chunk_stats(spark, d):
    chunks = _docs(spark, d).filter("length(text) > 0").select(chunking.recursive(F.col("text")).alias("c"))
    sizes = chunks.select(F.size("c").cast("bigint").alias("n"), F.aggregate("c", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x)).alias("chars"))
    return sizes.agg(F.count("*").alias("docs"), F.sum("n").alias("chunks"), F.expr("sum(chars) div greatest(sum(n), 1)").alias("mean_chars"))


def sentences(spark, d):
    rows = _docs(spark, d).filter("length(text) > 0").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return _long(rows, "pos")


def chunk_semantic(spark, d):
    return _long(chunking.chunk(_docs(spark, d), "semantic"), "chunk_id")


def heading_split(spark, d):
    """Parts of documents that begin at headings, whole."""
    parts = F.split("text", r"\n(?=#+ |== )", -1)
    rows = _docs(spark, d).filter("length(text) > 0").select("doc_id", F.posexplode(parts).alias("pos", "part"))
    heading = F.regexp_extract("part", r"^(?:#+|==) ([^\n]*)", 1)
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), heading.alias("heading"), F.length("part").cast("bigint").alias("chars"))


def _first_chunks(spark, d) -> DataFrame:
    """One vector of each chunk of each document: that of the lowest row."""
    rows = read_table(spark, d, "chunks").filter("doc_id is not null and chunk_id is not null").select("row_id", "doc_id", "chunk_id")
    firsts = rows.groupBy("doc_id", "chunk_id").agg(F.min("row_id").alias("row_id"))
    vectors = read_table(spark, d, "vector_store").filter(vec.usable(F.col("embedding"), 128)).select("row_id", vec.normalize(F.col("embedding")).alias("v"))
    return firsts.join(vectors, "row_id").select("doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "v")


def _boundaries(spark, d) -> DataFrame:
    now = _first_chunks(spark, d)
    before = now.select("doc_id", (F.col("chunk_id") + 1).alias("chunk_id"), F.col("v").alias("last"))
    sim = vec.dot(F.col("v"), F.col("last"))
    return now.join(before, ["doc_id", "chunk_id"], "left").select("doc_id", "chunk_id", F.round(sim, 6).alias("sim"), F.coalesce(sim < 0.5, F.lit(True)).alias("boundary"))


def semantic_boundaries(spark, d):
    """Similarity of each chunk to the one before it; a document's first chunk, or one after a gap, is a boundary."""
    return _boundaries(spark, d)


def semantic_segments(spark, d):
    """Number of boundaries so far, as the segment of each chunk."""
    rows = ordered.running_sum(materialize(_boundaries(spark, d), "boundaries"), "doc_id", "chunk_id", F.col("boundary").cast("bigint"), "segment")
    return rows.select("doc_id", "chunk_id", "segment")


def embed_hashing(spark, d):
    docs = embed.embed(_docs(spark, d).filter("text is not null").select("doc_id", "text"))
    rows = docs.select("doc_id", F.posexplode("embedding").alias("pos", "x")).filter("x <> 0")
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def e5_prefix(spark, d):
    title = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("query: "), "title")).otherwise(F.col("title"))
    return _docs(spark, d).select("doc_id", T.prefixed(title).alias("title"), T.is_prefix_model(F.coalesce("category", F.lit("E5-base"))).alias("prefix_model"))


def _retrieved(spark, d) -> DataFrame:
    """The best documents for the title of every document whose id is divisible by 20."""
    docs = _docs(spark, d).filter("length(text) > 0")
    asked = _docs(spark, d).filter("doc_id % 20 = 0 and length(title) > 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))
    vectors = materialize(embed.embed(docs.select("doc_id", "text")).select("doc_id", "embedding"), "vectors")
    queries = materialize(embed.embed(asked, text_col="query").select("query_id", "embedding"), "queries")
    hits = knn.search(queries, vectors, RETRIEVED, DIM, id_col="doc_id")
    return hits.select("query_id", F.col("rank").alias("retrieved_rank"), F.col("id").alias("doc_id")).join(docs.select("doc_id", "text"), "doc_id").join(asked, "query_id")


def _reranked(spark, d) -> DataFrame:
    return materialize(rank.rerank(_retrieved(spark, d), KEPT, rank.overlap(T.tokens(F.col("query")), T.tokens(F.col("text")))), "reranked")


def rerank_lexical(spark, d):
    return _reranked(spark, d).select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


def prompt_budget(spark, d):
    rows = rank.budgeted(_reranked(spark, d), 3000)
    return rows.select("query_id", F.col("rank").cast("bigint").alias("rank"), "line")


def _prompts(spark, d) -> DataFrame:
    return rank.documents(_reranked(spark, d))


def prompt_replug(spark, d):
    return _prompts(spark, d).select("query_id", rank.replug(F.col("documents"), F.col("query")).alias("prompt"))


def prompt_rag_sequence(spark, d):
    return _prompts(spark, d).select("query_id", rank.rag_sequence(F.col("documents"), F.col("query")).alias("prompt"))


def prompt_fid(spark, d):
    return rank.separate(_reranked(spark, d)).select("query_id", F.col("rank").cast("bigint").alias("rank"), "prompt")


def fallback_answer(spark, d):
    return rank.answer(prompt_replug(spark, d)).select("query_id", "answer")


def coverage_bands(spark, d):
    best = _reranked(spark, d).groupBy("query_id").agg(F.max("score").alias("best"))
    coverage = F.round(F.col("best") * 1000, 6)
    return best.select("query_id", F.when(coverage >= 90, "high").when(coverage >= 70, "medium").otherwise("low").alias("band"), (F.col("best") > 0.08).alias("enough"))


def query_expand(spark, d):
    places = read_table(spark, d, "forecasts").filter("city is not null").select(F.trim("city").alias("location")).distinct()
    made = F.array(*[F.struct(F.lit(i).cast("bigint").alias("template"), F.replace(F.lit(t), F.lit("{location}"), F.col("location")).alias("query")) for i, t in enumerate(TEMPLATES)])
    return places.select("location", F.inline(made))


def append_row_ids(spark, d):
    rows = read_table(spark, d, "chunks").select("doc_id", "chunk_id", F.col("row_id").alias("old_id"))
    return store.with_row_ids(rows, ["doc_id", "chunk_id", "old_id"], base=1000).select("row_id", "doc_id", "old_id")


def hit_metadata_join(spark, d):
    hits = read_table(spark, d, "vector_store").select("row_id", "chunk_offset")
    return store.hydrate(hits, read_table(spark, d, "chunks")).select("row_id", "chunk_offset", "doc_id", "source_file", F.substring("text", 1, 500).alias("preview"))


def _encoded(spark, d) -> DataFrame:
    known = {c: F.col(c) for c in store.KNOWN}
    return read_table(spark, d, "chunks").select("row_id", store.encode_json(known, F.col("extra")).alias("line"))


def json_encode(spark, d):
    return _encoded(spark, d)


def json_open_tail(spark, d):
    """Keys beyond the known fields, from the encoded lines."""
    _, extra = store.decode_json(F.col("line"))
    return _encoded(spark, d).select("row_id", F.explode(extra).alias("key", "value"))


def scan_jsonl(spark, d):
    """Documents written as JSON lines and scanned again, blank lines skipped."""
    from veldra.sources import documents

    path = scratch_path(spark, "jsonl")
    _docs(spark, d).select(F.concat(F.to_json(F.struct("doc_id", "text", "lang")), F.when(F.col("doc_id") % 3 == 0, "\n").otherwise("")).alias("value")).write.mode("overwrite").text(path)
    return documents.scan_json_lines(spark, path, "doc_id bigint, text string, lang string").select("doc_id", F.coalesce(F.length("text"), F.lit(-1)).cast("bigint").alias("chars"), F.md5("text").alias("digest"), "lang")


def doc_defaults(spark, d):
    from veldra.sources import documents

    rows = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("category")).alias("id"), "title", F.col("source").alias("name"), "text")
    return documents.with_defaults(rows).select("doc_id", "id", F.length("text").cast("bigint").alias("chars"))


def format_hits(spark, d):
    rows = _reranked(spark, d)
    line = F.format_string("[%d] score=%.4f | doc=%s\n    %s...", F.col("rank") + 1, F.round("score", 4), F.col("doc_id").cast("string"), F.substring("text", 1, 300))
    return rows.select("query_id", F.col("rank").cast("bigint").alias("rank"), line.alias("line"))


def result_envelope(spark, d):
    asked = _docs(spark, d).filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"))
    some = _reranked(spark, d).filter("score > 0.03").groupBy("query_id").agg(F.count("*").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("results"))
    total = F.coalesce("total", F.lit(0).cast("bigint"))
    return asked.join(some, "query_id", "left").select("query_id", store.envelope(total, F.slice(F.coalesce("results", F.array().cast("array<bigint>")), 1, 3)).alias("result"))


def coerce_literal(spark, d):
    rows = read_table(spark, d, "news_items").filter("date is not null").select("item_id", T.coerced(F.col("date")).alias("v"))
    return rows.select("item_id", "v.kind", "v.flag", "v.whole", "v.real", "v.text")


def unranked(spark, d):
    """The best passages as they were found: the way without a reranker."""
    return rank.unranked(_retrieved(spark, d), KEPT).select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id")


def attack_similarity(spark, d):
    """Titles that are close to a known injected instruction, and to which: by the cosine of hashed words."""
    patterns = embed.hash_texts(list(quality.ATTACKS), DIM)
    titles = embed.embed(_docs(spark, d).filter("length(title) > 0").select("doc_id", "title"), text_col="title")
    near = F.array(*[F.struct(F.round(vec.dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in row])), 6).alias("similarity"), F.lit(-i).alias("at")) for i, row in enumerate(patterns)])
    best = titles.withColumn("best", F.array_max(near)).select("doc_id", (-F.col("best.at")).cast("bigint").alias("pattern"), F.col("best.similarity").alias("similarity"))
    return best.filter(F.col("similarity") >= quality.ATTACK_LEAST)


def doc_by_position(spark, d):
    """Documents without an id are named by how many chunks come before them."""
    rows = _docs(spark, d).filter("length(text) > 0").select("doc_id", F.ceil(F.length("text") / 462).alias("n"))
    numbered = ordered.running_sum(rows.withColumn("_all", F.lit(0)), "_all", "doc_id", F.col("n"), "upto")
    return numbered.select("doc_id", F.concat(F.lit("doc_"), (F.col("upto") - F.col("n")).cast("string")).alias("id"))


QUERIES = {
    f.__name__: f
    for f in (
        token_estimate, chunk_fixed, chunk_recursive, chunk_with_metadata, chunk_stats, sentences, chunk_semantic, heading_split, semantic_boundaries, semantic_segments, embed_hashing, e5_prefix, rerank_lexical, prompt_budget,
        prompt_replug, prompt_rag_sequence, prompt_fid, fallback_answer, coverage_bands, query_expand, append_row_ids, hit_metadata_join, json_encode, json_open_tail, scan_jsonl, doc_defaults, format_hits, result_envelope, coerce_literal, unranked, attack_similarity, doc_by_position,
    )
}


def _windows(size: int, step: int, keep: str) -> str:
    return f"SELECT {keep}, o // {step} AS chunk_id, substring(text, (o + 1)::BIGINT, {size}) AS chunk FROM (SELECT *, unnest(range(0, len(text), {step})) AS o FROM documents WHERE len(text) > 0)"


def _offsets(source: str) -> str:
    run = "sum(len(chunk) // 4) OVER (PARTITION BY doc_id ORDER BY chunk_id)"
    return f"SELECT doc_id, chunk_id, chunk, ({run} - len(chunk) // 4)::BIGINT AS token_start, ({run})::BIGINT AS token_end FROM ({source})"


def _recursive(text: str, separators: tuple[str, ...], level: int = 0, size: int = 512, step: int = 462) -> str:
    if separators[0] == "":
        return f"list_transform(range(0, len({text}), {step}), lambda i{level}: substring({text}, (i{level} + 1)::BIGINT, {size}))"
    p, z, a, x, r = (f"{n}{level}" for n in "pzaxr")
    sep = "'" + separators[0].replace("\n", "' || chr(10) || '") + "'"
    parts = f"flatten(list_transform(string_split({text}, {sep}), lambda {p}: CASE WHEN len({p}) <= {size} THEN [{p}] ELSE {_recursive(p, separators[1:], level + 1)} END))"
    fold = f"list_reduce(list_transform({parts}, lambda {z}: {{'m': []::VARCHAR[], 'c': {z}}}), lambda {a}, {x}: CASE WHEN len({a}.c) + len({x}.c) <= {size} THEN {{'m': {a}.m, 'c': {a}.c || {x}.c}} ELSE {{'m': list_append({a}.m, {a}.c), 'c': {x}.c}} END)"
    return f"list_transform([{fold}], lambda {r}: list_append({r}.m, {r}.c))[1]"


_CHUNKED = f"SELECT doc_id, unnest(range(0, len(c))) AS chunk_id, unnest(c) AS chunk FROM (SELECT doc_id, {_recursive('text', chunking.SEPARATORS)} AS c FROM documents WHERE len(text) > 0)"
_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
_HASHED = (
    "SELECT {id} AS id, h % 64 AS pos, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE) AS x FROM (SELECT {id}, ('0x' || substring(md5(w), 1, 8))::BIGINT AS h FROM (SELECT {id}, unnest("
    + _WORDS
    + ") AS w FROM {source})) GROUP BY {id}, h % 64"
)
_DOC_VECTORS = f"dv AS ({_HASHED.format('text', id='doc_id', source='(SELECT * FROM documents WHERE len(text) > 0)')}), dn AS (SELECT id, sqrt(sum(x * x)) AS n FROM dv GROUP BY id)"
_ASKED = "asked AS (SELECT doc_id AS query_id, title AS query FROM documents WHERE doc_id % 20 = 0 AND len(title) > 0)"
_QUERY_VECTORS = f"qv AS ({_HASHED.format('query', id='query_id', source='asked')}), qn AS (SELECT id, sqrt(sum(x * x)) AS n FROM qv GROUP BY id)"
_SCORED = "sc AS (SELECT a.query_id, b.doc_id, coalesce(s.s / (qn.n * dn.n), 0) AS score FROM asked a CROSS JOIN (SELECT doc_id FROM documents WHERE len(text) > 0) b LEFT JOIN (SELECT qv.id AS q, dv.id AS i, sum(qv.x * dv.x) AS s FROM qv JOIN dv USING (pos) GROUP BY 1, 2) s ON s.q = a.query_id AND s.i = b.doc_id LEFT JOIN qn ON qn.id = a.query_id AND qn.n > 0 LEFT JOIN dn ON dn.id = b.doc_id AND dn.n > 0)"
_RETRIEVED = f"hits AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rr FROM sc QUALIFY rr < {RETRIEVED})"
_RANKED = f"rr AS (SELECT *, CASE WHEN len(qw) + len(dw) - len(list_intersect(qw, dw)) > 0 THEN len(list_intersect(qw, dw))::DOUBLE / (len(qw) + len(dw) - len(list_intersect(qw, dw))) ELSE 0 END AS score FROM (SELECT h.query_id, h.doc_id, h.rr, a.query, t.text, {_WORDS.format('a.query')} AS qw, {_WORDS.format('t.text')} AS dw FROM hits h JOIN asked a USING (query_id) JOIN documents t ON t.doc_id = h.doc_id)), ranked AS (SELECT query_id, query, doc_id, text, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rr) - 1 AS rank FROM rr QUALIFY rank < {KEPT})"
_PASSAGES = f"WITH {_ASKED}, {_DOC_VECTORS}, {_QUERY_VECTORS}, {_SCORED}, {_RETRIEVED}, {_RANKED}"


def _lines(budget: int) -> str:
    used = "coalesce(sum(len(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f"lines AS (SELECT query_id, query, rank, 'Document ' || (rank + 1) || ': ' || substring(text, 1, ({budget} - used)::BIGINT) AS line FROM (SELECT *, {used} AS used FROM ranked) WHERE used < {budget})"


_DOCUMENTS = f"{_PASSAGES}, {_lines(15_000)}, documents_of AS (SELECT query_id, query, string_agg(line, chr(10) || chr(10) ORDER BY rank) AS docs FROM lines GROUP BY query_id, query)"
_REPLUG = "docs || chr(10) || chr(10) || 'Question: ' || query || chr(10) || 'Answer:'"
_SPLIT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
_FIRSTS = "v AS (SELECT f.doc_id, f.chunk_id::BIGINT AS chunk_id, e.embedding::DOUBLE[] AS e FROM (SELECT doc_id, chunk_id, min(row_id) AS row_id FROM chunks WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY doc_id, chunk_id) f JOIN vector_store e USING (row_id) WHERE e.embedding IS NOT NULL AND len(e.embedding) = 128 AND len(list_filter(e.embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e.embedding, lambda x: x <> 0)) > 0)"
_SIMS = f"{_FIRSTS}, s AS (SELECT a.doc_id, a.chunk_id, list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) AS sim FROM v a LEFT JOIN v b ON b.doc_id = a.doc_id AND b.chunk_id + 1 = a.chunk_id)"

ORACLES = {
    "token_estimate": "SELECT doc_id, len(text) // 4 AS tokens FROM documents WHERE text IS NOT NULL",
    "chunk_fixed": _offsets(_windows(512, 462, "doc_id")),
    "chunk_recursive": _offsets(_CHUNKED),
    "chunk_with_metadata": f"SELECT doc_id, lang, source, chunk_id, len(chunk) AS chars FROM ({_windows(1000, 900, 'doc_id, lang, source')})",
    "chunk_stats": f"SELECT (SELECT count(*) FROM documents WHERE len(text) > 0) AS docs, count(*) AS chunks, (sum(len(chunk)) // greatest(count(*), 1))::BIGINT AS mean_chars FROM ({_CHUNKED})",
    "sentences": f"SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_SPLIT} AS s FROM documents WHERE len(text) > 0)",
    "heading_split": r"SELECT doc_id, pos, regexp_extract(part, '^(?:#+|==) ([^\n]*)', 1) AS heading, len(part) AS chars FROM (SELECT doc_id, unnest(range(0, len(p))) AS pos, unnest(p) AS part FROM (SELECT doc_id, string_split(regexp_replace(text, '\n(#+ |== )', chr(1) || '\1', 'g'), chr(1)) AS p FROM documents WHERE len(text) > 0))",
    "semantic_boundaries": f"WITH {_SIMS} SELECT doc_id, chunk_id, round(sim, 6) AS sim, coalesce(sim < 0.5, true) AS boundary FROM s",
    "semantic_segments": f"WITH {_SIMS} SELECT doc_id, chunk_id, (sum(CASE WHEN coalesce(sim < 0.5, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_id))::BIGINT AS segment FROM s",
    "embed_hashing": f"WITH dv AS ({_HASHED.format('text', id='doc_id', source='documents')}) SELECT id AS doc_id, pos, round(x / n, 6) AS x FROM dv JOIN (SELECT id, sqrt(sum(x * x)) AS n FROM dv GROUP BY id) USING (id) WHERE x <> 0",
    "e5_prefix": "SELECT doc_id, CASE WHEN t LIKE 'passage: %' OR t LIKE 'query: %' THEN t ELSE 'passage: ' || t END AS title, regexp_matches(lower(coalesce(category, 'E5-base')), 'e5|intfloat') AS prefix_model FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'query: ' || title ELSE title END AS t FROM documents)",
    "rerank_lexical": f"{_PASSAGES} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ranked",
    "prompt_budget": f"{_PASSAGES}, {_lines(3000)} SELECT query_id, rank, line FROM lines",
    "prompt_replug": f"{_DOCUMENTS} SELECT query_id, {_REPLUG} AS prompt FROM documents_of",
    "prompt_rag_sequence": f"{_DOCUMENTS} SELECT query_id, 'Context:' || chr(10) || {_REPLUG} AS prompt FROM documents_of",
    "prompt_fid": f"{_PASSAGES} SELECT query_id, rank, 'question: ' || query || ' context: ' || text AS prompt FROM ranked",
    "fallback_answer": f"{_DOCUMENTS} SELECT query_id, CASE WHEN len(b) > 500 THEN substring(b, 1, 500) || '...' ELSE b END AS answer FROM (SELECT query_id, regexp_replace(regexp_extract({_REPLUG}, '(?s)Document \\d+:\\s*(.*?)(?:\\n\\nDocument|\\z)', 1), '^\\s+|\\s+$', '', 'g') AS b FROM documents_of)",
    "coverage_bands": f"{_PASSAGES} SELECT query_id, CASE WHEN round(max(score) * 1000, 6) >= 90 THEN 'high' WHEN round(max(score) * 1000, 6) >= 70 THEN 'medium' ELSE 'low' END AS band, max(score) > 0.08 AS enough FROM ranked GROUP BY query_id",
    "query_expand": "SELECT location, i AS template, replace(t, '{location}', location) AS query FROM (SELECT DISTINCT trim(city) AS location FROM forecasts WHERE city IS NOT NULL), (SELECT unnest(range(0, 4)) AS i, unnest(["
    + ", ".join(f"'{t}'" for t in TEMPLATES)
    + "]) AS t)",
    "append_row_ids": "SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, chunk_id NULLS FIRST, row_id) - 1 + 1000 AS row_id, doc_id, row_id AS old_id FROM chunks",
    "hit_metadata_join": "SELECT row_id, v.chunk_offset, c.doc_id, c.source_file, substring(c.text, 1, 500) AS preview FROM vector_store v JOIN chunks c USING (row_id)",
    "json_encode": "SELECT row_id, CASE WHEN extra IS NULL OR cardinality(extra) = 0 THEN k ELSE substring(k, 1, len(k) - 1) || ',' || substring(e, 2) END AS line FROM (SELECT row_id, extra, to_json({'chunk_id': chunk_id, 'doc_id': doc_id, 'text': text, 'token_start': token_start, 'token_end': token_end, 'source_file': source_file})::VARCHAR AS k, to_json(extra)::VARCHAR AS e FROM chunks)",
    "json_open_tail": "SELECT row_id, unnest(map_keys(extra)) AS key, unnest(map_values(extra)) AS value FROM chunks WHERE extra IS NOT NULL",
    "scan_jsonl": "SELECT doc_id, coalesce(len(text), -1) AS chars, md5(text) AS digest, lang FROM documents",
    "doc_defaults": "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN category END, title, source, 'doc_' || (('0x' || substring(md5(substring(coalesce(text, record), 1, 50)), 1, 8))::BIGINT % 1000000)) AS id, len(coalesce(text, record)) AS chars FROM (SELECT *, to_json({'doc_id': doc_id, 'id': CASE WHEN doc_id % 2 = 0 THEN category END, 'title': title, 'name': source, 'text': text})::VARCHAR AS record FROM documents)",
    "format_hits": f"{_PASSAGES} SELECT query_id, rank, printf('[%d] score=%.4f | doc=%s', rank + 1, round(score, 4), doc_id::VARCHAR) || chr(10) || '    ' || substring(text, 1, 300) || '...' AS line FROM ranked",
    "result_envelope": f"{_PASSAGES}, r AS (SELECT query_id, count(*) AS total, list(doc_id ORDER BY rank) AS ids FROM ranked WHERE score > 0.03 GROUP BY query_id) SELECT d.doc_id AS query_id, to_json({{'status': CASE WHEN coalesce(total, 0) > 0 THEN 'ok' ELSE 'empty' END, 'total': coalesce(total, 0), 'results': coalesce(ids[1:3], []::BIGINT[])}})::VARCHAR AS result FROM documents d LEFT JOIN r ON r.query_id = d.doc_id WHERE d.doc_id % 20 = 0",
    "unranked": f"WITH {_ASKED}, {_DOC_VECTORS}, {_QUERY_VECTORS}, {_SCORED}, {_RETRIEVED} SELECT query_id, rr AS rank, doc_id FROM hits WHERE rr < {KEPT}",
    "attack_similarity": f"WITH asked AS (SELECT doc_id AS query_id, title AS query FROM documents WHERE len(title) > 0), {_QUERY_VECTORS}, known AS (SELECT unnest(range(0, {len(quality.ATTACKS)})) AS query_id, unnest({list(quality.ATTACKS)}) AS query), {_QUERY_VECTORS.replace('qv AS', 'pv AS').replace('qn AS', 'pn AS').replace('FROM qv', 'FROM pv').replace('asked', 'known')}, s AS (SELECT query_id AS doc_id, p.query_id AS pattern, round(coalesce((SELECT sum(qv.x * pv.x) FROM qv JOIN pv USING (pos) WHERE qv.id = a.query_id AND pv.id = p.query_id) / (nullif(qn.n, 0) * pn.n), 0), 6) AS similarity FROM asked a CROSS JOIN known p LEFT JOIN qn ON qn.id = a.query_id LEFT JOIN pn ON pn.id = p.query_id) SELECT doc_id, pattern, similarity FROM s WHERE similarity >= {quality.ATTACK_LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, pattern) = 1".replace("SELECT query_id AS doc_id, p.", "SELECT a.query_id AS doc_id, p."),
    "doc_by_position": "SELECT doc_id, 'doc_' || (coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS id FROM (SELECT doc_id, ceil(len(text) / 462.0)::BIGINT AS n FROM documents WHERE len(text) > 0)",
    "coerce_literal": "SELECT item_id, kind, CASE WHEN kind = 'bool' THEN lower(date) = 'true' END AS flag, CASE WHEN kind = 'int' THEN try_cast(replace(trim(date), '_', '') AS BIGINT) END AS whole, CASE WHEN kind = 'float' THEN try_cast(replace(trim(date), '_', '') AS DOUBLE) END AS real, CASE WHEN kind = 'str' THEN date END AS text FROM (SELECT item_id, date, CASE WHEN lower(date) IN ('true', 'false') THEN 'bool' WHEN regexp_matches(date, '^\\s*[+-]?\\d+(_\\d+)*\\s*$') THEN 'int' WHEN regexp_matches(date, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$|^\\s*[+-]?(?i:inf|infinity|nan)\\s*$') THEN 'float' ELSE 'str' END AS kind FROM news_items WHERE date IS NOT NULL)",
}
