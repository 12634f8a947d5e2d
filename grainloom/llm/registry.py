"""The thin queries: each applies one operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chatfmt, collocations, crosstok, decontam, jaccard, langid, neardup, pii, secrets, sharding, tokenfiles, toxicity
from .common import count_kind, folder, span_digest, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=40)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("email", "ip", "card", "phone"))
    return found.select(
        "doc_id",
        *(count_kind(F.col("spans"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")),
        F.sha2(span_digest(base), 256).alias("base_sha256"),
        span_digest(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.round(s["score"] * 10).cast("int").cast("string")), ",").alias("tenths"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select(
        "doc_id",
        *(count_kind(F.col("spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(span_digest(base), 256).alias("base_sha256"),
        span_digest(F.col("spans")).alias("spans"),
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    one_more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chatfmt.read_back(chatfmt.format_conversations(talks.unionByName(one_more)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def vocabulary_path() -> str:
    """The production vocabulary: its place is found at run time and it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_texts(table(spark, sf_dir, "documents"), vocabulary_path())


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "token-files")
    tokenfiles.write(table(spark, sf_dir, "documents"), path, vocabulary_path())
    return tokenfiles.checksums(tokenfiles.read(spark, path))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return crosstok.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_pii": op3_pii,
    "op4_secrets": op4_secrets,
    "op5_language": op5_language,
    "op6_chat": op6_chat,
    "op7_toxicity": op7_toxicity,
    "op8_embeddings": op8_embeddings,
    "op9_jaccard": op9_jaccard,
    "op10_bpe": op10_bpe,
    "op11_collocations": op11_collocations,
    "op12_token_files": op12_token_files,
    "op13_alignment": op13_alignment,
}
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(regexp_split_to_array({_LOWER.format('text')}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_NEAR = "translate(right(gaps[j], 48) || ' ' || left(gaps[j + 1], 48), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLACED = """SELECT doc_id, {k} AS k, '{name}' AS kind, vals[j] AS v, (list_sum(list_transform(gaps[1:j], lambda g: length(g))) + coalesce(list_sum(list_transform(vals[1:j-1], lambda g: length(g))), 0))::BIGINT AS s,
            {score} + CASE WHEN regexp_matches({near}, '{words}') THEN 2 ELSE 0 END - CASE WHEN regexp_matches({near}, '{against}') THEN 3 ELSE 0 END AS tenths
            FROM (SELECT doc_id, gaps, vals, unnest(range(1, len(vals) + 1)) AS j FROM (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS vals FROM t WHERE regexp_matches(text, '{pattern}')))"""
_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": rf"\b(?:{pii.iban_body()})\b", "national": r"\b[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}\b", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
_PERSONAL = " UNION ALL ".join(_PLACED.format(k=i, name=k.name, pattern=_KINDS[k.name], score=round(k.score * 10), near=_NEAR, words=k.words, against=k.against) for i, k in enumerate(pii.KINDS))
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {_DIGITS}[-i]::INT WHEN {_DIGITS}[-i]::INT > 4 THEN 2 * {_DIGITS}[-i]::INT - 9 ELSE 2 * {_DIGITS}[-i]::INT END)) % 10 = 0"
_MOD97 = "list_reduce(list_prepend(0, list_transform(string_split(replace(v, ' ', '')[5:] || replace(v, ' ', '')[1:4], ''), lambda c: ascii(c))), lambda acc, c: CASE WHEN c < 58 THEN (acc * 10 + c - 48) % 97 ELSE (acc * 100 + c - 55) % 97 END) = 1"

#: Conversations in SQL: constants of the template cost 3 characters a conversation and 20 a turn, and each escaped character one more.
_ESCAPED_LENGTH = r"length({0}) + length(regexp_replace({0}, '[^<\[\\]', '', 'g'))"
ORACLES: dict = {
    "op1_decontamination": f"""
        WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
             bw AS (SELECT DISTINCT item_id, len(x) AS k, array_to_string(x, ' ') AS win FROM (SELECT item_id, w[i + 1:i + 10] AS x FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0))),
             dw AS (SELECT doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
             m AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (win, k)),
             h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
             cnt AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY word), wid AS (SELECT DISTINCT win, k, string_split(win, ' ') AS ws FROM bw),
             rk AS (SELECT win, word, p, row_number() OVER (PARTITION BY win ORDER BY n, p) AS r, min(coalesce(n, 0)) OVER (PARTITION BY win) AS least_n FROM (SELECT win, unnest(ws) AS word, unnest(range(0, k)) AS p FROM wid) LEFT JOIN cnt USING (word)),
             two AS (SELECT win, max(word) FILTER (r = 1) AS w1, max(p) FILTER (r = 1) AS p1, max(word) FILTER (r = least(2, m)) AS w2, max(p) FILTER (r = least(2, m)) AS p2 FROM (SELECT *, max(r) OVER (PARTITION BY win) AS m FROM rk WHERE least_n > 0) GROUP BY win),
             pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
             nr AS (SELECT DISTINCT a.doc_id, win FROM two JOIN pos a ON a.word = w1 JOIN pos b ON b.doc_id = a.doc_id AND b.word = w2 AND abs(b.p - (a.p - p1 + p2)) <= 2 JOIN d ON d.doc_id = a.doc_id JOIN wid USING (win) WHERE list_has_all(d.w[greatest(a.p - p1 - 2, 0) + 1:a.p - p1 + k + 2], ws)),
             ni AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM nr JOIN bw USING (win) GROUP BY doc_id),
             it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN ni USING (doc_id)""",
    "op3_pii": f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             raw AS ({_PERSONAL}),
             ok AS (SELECT doc_id, k, kind, s, tenths, kind || ':' || s || ':' || (s + length(v)) AS span FROM raw WHERE CASE kind
                    WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(nullif(ltrim(x, '0'), '') AS INT), 0) <= 255))
                    WHEN 'card' THEN length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN} WHEN 'phone' THEN length({_DIGITS}) BETWEEN 8 AND 15 WHEN 'iban' THEN {_MOD97} WHEN 'national' THEN tenths >= 5 WHEN 'ssn' THEN tenths >= 5 ELSE true END),
             g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{n}') AS n_{n}" for n in _KINDS)}, string_agg(span, ',' ORDER BY k, s) FILTER (k < 4) AS base, string_agg(span, ',' ORDER BY k, s) AS spans, string_agg(tenths::VARCHAR, ',' ORDER BY k, s) AS tenths FROM ok GROUP BY doc_id)
        SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0)::BIGINT AS n_{n}" for n in ("email", "ip", "card", "phone"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(tenths, '') AS tenths FROM t LEFT JOIN g USING (doc_id)""",
    "op8_embeddings": """
        WITH RECURSIVE good AS (SELECT vec_id, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings)
                                WHERE vec_id IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
             links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON len(a.u) = len(b.u) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.u, b.u) >= 0.9),
             reach AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id WHERE reach.root < links.b),
             n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a), c AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN n ON a = vec_id JOIN c ON c.id = vec_id""",
    "op9_jaccard": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
             s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
             e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
             links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
             reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id WHERE reach.root < links.b),
             c AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN c ON c.id = doc_id""",
    "op6_chat": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               (3 + sum(20 + {_ESCAPED_LENGTH.format("role")} + {_ESCAPED_LENGTH.format("text")}))::BIGINT AS formatted_chars
        FROM turns GROUP BY conv_id""",
    "op11_collocations": """
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
             w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
             n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
             g AS (SELECT lang, size, phrase, count(*) AS f FROM (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, range(1, 5) s(size) WHERE len(w) >= size)) GROUP BY ALL HAVING count(*) >= 30),
             c AS (SELECT lang, phrase, f AS a, size, string_split(phrase, ' ') AS ws FROM g WHERE size > 1),
             k AS (SELECT c.*, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c),
             s AS (SELECT k.lang, k.phrase, a, arg_min({'l': gl.f, 'r': gr.f}, (2000000::HUGEINT * a // (gl.f + gr.f)) * 4 + k) AS p, min(2000000::HUGEINT * a // (gl.f + gr.f)) AS score FROM k JOIN g gl ON gl.lang = k.lang AND gl.phrase = x JOIN g gr ON gr.lang = k.lang AND gr.phrase = y GROUP BY k.lang, k.phrase, a),
             d AS (SELECT DISTINCT s.lang, s.phrase FROM s JOIN (SELECT lang, f, array_to_string(ws[i:i + m - 1], ' ') AS part FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT c.*, a AS f, unnest(range(2, size)) AS m FROM c))) b ON b.lang = s.lang AND part = s.phrase AND 100::HUGEINT * f >= 80 * a)
        SELECT lang, rank, phrase, a, p.l AS l, p.r AS r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s ANTI JOIN d USING (lang, phrase)) JOIN n USING (lang) WHERE rank <= 2000""",
}
