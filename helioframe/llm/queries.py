"""Registered queries of the operators and the SQL that DuckDB can run on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import chat, decontaminate, embedding_dedup, lexical_search, line_dedup, lm_score, merkle, mixing, near_dedup, token_counts, tokenids, topk_search, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
ALNUM_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    weights = toxicity.train(documents, labels.where(toxicity.fold(F.col("doc_id")) != 0))
    held_out = toxicity.fold(F.col("row.doc_id")) == 0
    return toxicity.score(documents, weights, keep=["doc_id"]).select("row.doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


OP2 = f"""
WITH bw AS (SELECT item_id, {ALNUM_WORDS.format(LOWER.format('text'))} AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, list_slice(w, i + 1, i + least(13, len(w))) AS g
          FROM bw, LATERAL unnest(range(greatest(len(w) - 12, least(len(w), 1)))) AS u(i)),
sizes AS (SELECT DISTINCT len(g) AS n FROM grams),
dw AS (SELECT doc_id, {ALNUM_WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
pos AS (SELECT doc_id, n, i, list_slice(w, i + 1, i + n) AS g FROM dw, sizes, LATERAL unnest(range(greatest(len(w) - n + 1, 0))) AS u(i)),
found AS (SELECT doc_id, i, n, item_id FROM pos JOIN grams USING (g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM found), LATERAL unnest(range(i, i + n)) AS u(p) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query("op2_decontaminate", OP2)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep=["doc_id"])
    ids = F.array_join("items", ",")
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


OP3 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({SPACE_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total, coalesce(sum(2 * source_size) OVER p, 0) AS capped, sum(w) OVER q AS open
      FROM s WINDOW p AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    q AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT max((total - capped) / open) AS level FROM o),
t AS (SELECT source, source_size, CAST(least(2 * source_size, level * w) AS DOUBLE) AS target FROM s, l),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""


@query("op3_mixing", OP3)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    rated = mixing.rated(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return rated.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {SPACE_WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + least(5, len(w))), ' ') AS g
      FROM d, LATERAL unnest(range(greatest(len(w) - 4, least(len(w), 1)))) AS u(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
         JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
         GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


@query("op4_near_dedup", OP4)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.classes(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op8_lm_score")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.scores(table(spark, folder, "documents"))


ESCAPED = r"replace(replace(replace({}, '\', '\e'), '###', '\h'), '</turn>', '\t')"
OP9 = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER w - 1 AS k, coalesce(lag(role) OVER w, 'start') AS state, lead(role) OVER w IS NULL AS ends FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
b AS (SELECT *, (state, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) AS allowed FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(replace({ESCAPED.format('role')}, ':', '\\c')) + 2 + length({ESCAPED.format('text')}) + 8) AS BIGINT) AS formatted_chars,
       bool_and(allowed) AND bool_or(ends AND role = 'assistant') AS valid, CAST(min(k) FILTER (NOT allowed) AS INTEGER) AS breaks_at,
       string_agg(CASE WHEN role = 'assistant' THEN '010' ELSE '000' END, '' ORDER BY k) AS loss_flags
FROM b GROUP BY conv_id
"""


@query("op9_chat", OP9)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(who).alias("role"), F.lit(said).alias("text")) for k, who in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    back = chat.read_back(chat.formatted(rows.unionByName(extra)))
    every = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(every).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        digest(F.col("loss_text")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "breaks_at", "loss_flags")


OP10 = f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT doc_id, lines, list_transform(lines, lambda x: {LOWER.format("trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")}) AS keys FROM l),
f AS (SELECT key FROM (SELECT doc_id, unnest(list_distinct(keys)) AS key FROM k) WHERE key <> '' GROUP BY key HAVING count(*) >= 10),
m AS (SELECT list(key) AS frequent FROM f)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(list_filter(keys, lambda x: list_contains(coalesce(frequent, []), x))) AS BIGINT) AS n_dropped,
       sha256(array_to_string(list_filter(lines, lambda x, i: NOT list_contains(coalesce(frequent, []), keys[i])), chr(10))) AS kept_sha256
FROM k, m
"""


@query("op10_line_dedup", OP10)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, folder, "documents"), keep=["doc_id"])
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op5_token_counts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    vocabulary = token_counts.byte_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.counted(table(spark, folder, "documents"), vocabulary, keep=["doc_id"]).select("row.doc_id", "n_words", "n_tokens", "longest")


OP6 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON reach.r = link.a),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


@query("op6_embedding_dedup", OP6)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    out = embedding_dedup.linked(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))
    return out.select("row.vec_id", "n_links", "component_id", "kept")


@query("op7_token_ids")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return tokenids.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


CRC = """xor(4294967295, list_reduce(flatten([[4294967295]] || list_transform(range(1, len({0}) + 1), lambda p: [ascii(substr({0}, p, 1)), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a // 2, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END))"""


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"


def _levels(name: str, levels: int) -> str:
    """The levels over {name}0 (g, i, h, n), and the siblings of every node as {name}s0, ..."""
    out = []
    for k in range(levels):
        now = f"{name}{k}"
        out.append(f"{now[0]}s{k} AS (SELECT g, i, n > 1 AS up, coalesce(string_agg(h, '') OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                   f"coalesce(string_agg(h, '') OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {now} WINDOW b AS (PARTITION BY g, i // 8 ORDER BY i))")
        out.append(f"{name}{k + 1} AS (SELECT g, i // 8 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (n + 7) // 8 AS n FROM {now} WHERE n > 1 GROUP BY g, i // 8, n UNION ALL SELECT g, i, h, n FROM {now} WHERE n = 1)")
    return ",\n".join(out)


def _way(start: str, name: str, levels: int, keys: str, fold: str, proof: str) -> str:
    """Walks every row of ``start`` (g, i, ...) up the levels: extends ``fold`` and ``proof``."""
    out, now = [], start
    for k in range(levels):
        out.append(f"{start}w{k} AS (SELECT {keys}, t.g, t.i, CASE WHEN up THEN sha256(l || {fold} || r) ELSE {fold} END AS {fold}, CASE WHEN up THEN {proof} || l || r ELSE {proof} END AS {proof} "
                   f"FROM {now} t JOIN {name}s{k} s ON s.g = t.g AND s.i = t.i // {8**k})")
        now = f"{start}w{k}"
    return ",\n".join(out)


#: Unrolled to 8**6 rows a language and 8**2 languages.
OP11 = f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
  CASE WHEN {CRC.format("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", LOWER.format("text")))}) END AS other FROM documents),
p AS (SELECT doc_id, g, leaf, coalesce(other, leaf) AS f, '' AS proof, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
a0 AS (SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p),
{_levels("a", 6)},
b0 AS (SELECT '' AS g, g AS lang, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n FROM a6),
{_levels("b", 2)},
{_way("p", "a", 6, "doc_id, leaf", "f", "proof")},
q AS (SELECT doc_id, leaf, b0.h AS subroot, f, proof, b0.g, b0.i FROM pw5 JOIN b0 ON b0.lang = pw5.g),
{_way("q", "b", 2, "doc_id, leaf, subroot", "f", "proof")}
SELECT doc_id, leaf, subroot, b2.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b2.h AS verified FROM qw1, b2
"""


@query("op11_merkle", OP11)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = merkle.leaf([*map(F.col, fields[:-1]), merkle.lower_ascii(F.col("text"))])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lowered)
    found = merkle.manifest(table(spark, folder, "documents").select(*fields), fields, carry={"tampered": tampered})
    found = found.select(
        F.col("data.order").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle.fold(F.coalesce("data.tampered", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


OP12 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 5
"""


@query("op12_topk", OP12)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return topk_search.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
p AS (SELECT r, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) GROUP BY r, doc_id, len(w), term),
c AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY term, docs),
i AS (SELECT x, item_id, term, count(*) AS times FROM (SELECT x, item_id, unnest({TERMS.format(LOWER.format("coalesce(text, '')"))}) AS term FROM (SELECT row_number() OVER () AS x, * FROM benchmark)) GROUP BY ALL),
s AS (SELECT x, item_id, doc_id, r, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
      FROM i JOIN p USING (term) JOIN f USING (term), c GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""


@query("op13_lexical", OP13)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
