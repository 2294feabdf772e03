"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm import (
    chat, decontaminate, language, main_text, minhash, packing, quality, repair, secret_scan, spelling, substring, vectors, warc)

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


# ---------------------------------------------------------------- op1
PROBE = r"\### Assistant: </turn> ok"


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees: each row answers the one before it by (turn, role, text)."""
    order = Window.partitionBy("tree_id").orderBy("turn", "role", "text")
    at = conversations.select(F.col("conv_id").alias("tree_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                              F.coalesce("text", F.lit("")).alias("text")).withColumn("msg_id", F.row_number().over(order))
    return at.select("tree_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text",
                     F.lit(0.0).alias("score"))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    out = chat.conversations(chains(rows), best=1)
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select(F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                      F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
                      F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


OP1_SQL = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
safe AS (
    SELECT *, replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '<\/turn>'), chr(10), '\' || chr(10)) AS r,
           replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '<\/turn>') AS t FROM said)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(r) + length(t) + 14)::BIGINT AS formatted_chars
FROM safe GROUP BY conv_id
"""


# ---------------------------------------------------------------- op2
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, listing = warc.write_archives(table(spark, sf_dir, "pages"))
    found = warc.read_archives(folder, listing)
    return found.where("record_type <> 'gap'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = r"""
WITH said AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
firsts AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first, sha1(html) AS hex FROM said)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to
FROM firsts
"""


# ---------------------------------------------------------------- op3
def packed(docs: DataFrame) -> DataFrame:
    crc = F.crc32("ids").alias("ids_crc32")
    out = packing.pack(docs, public_tokenizers.path(TOKENIZER), carry=[crc])
    return out.withColumn("length", F.col("length").cast("long"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- op4
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


OP4_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
    FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
    HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id
"""


# ---------------------------------------------------------------- op5
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(4) == 2
    model = language.fit(docs.where("lang IS NOT NULL").where(~held_out))
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


# ---------------------------------------------------------------- op6
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"), length=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
firsts AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM firsts WHERE first < doc_id),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (
    SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS text, count(*) AS n
    FROM placed p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""


# ---------------------------------------------------------------- op7
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# ---------------------------------------------------------------- op8
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


# ---------------------------------------------------------------- op9
def quality_model(docs: DataFrame, labels: DataFrame, held_out: bool) -> quality.Model:
    labels = labels.select("doc_id", F.col("quality").alias("label"))
    return quality.fit(docs, labels.where(remainder(5) != 0) if held_out else labels)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"), held_out=True)
    return quality.score(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score",
                                             (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


# ---------------------------------------------------------------- op10
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.fit(docs))

    def many(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    def joined(name: str) -> Column:
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    return found.select("doc_id", *map(many, secret_scan.KINDS), F.sha2(joined("base"), 256).alias("base_sha256"),
                        joined("spans").alias("spans"))


# ---------------------------------------------------------------- op11
def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


# ---------------------------------------------------------------- op12
def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` dropped, emptied, cut of their ends, repeated or given to the user, by a checksum of their place."""
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                     F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hurt = F.crc32(place.cast("binary")) % 20
    rows = rows.withColumn("hurt", hurt).where("hurt <> 0")
    rows = rows.withColumns({
        "text": F.when(F.col("hurt") == 1, "").when(F.col("hurt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("hurt") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("hurt") == 3, 2).otherwise(1)))).drop("hurt", "copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.repair(damaged(rows)).withColumnRenamed("conv_id", "c")
    whole = rows.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def crc32_sql(text: str) -> str:
    """The CRC-32 of a DuckDB string expression, byte by byte from the reflected polynomial 0xEDB88320."""
    code = f"hex(encode({text}))"
    number = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr({code}, (2 * i + 1)::INT, 2))::BIGINT)"
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    one = f"list_reduce(range(8), lambda x, k: {bit}, xor(c, b))"
    return f"xor(list_reduce({number}, lambda c, b: {one}, 4294967295::BIGINT), 4294967295)"


def _moves(to: str, plain: list[tuple[str, str]]) -> str:
    """The cheapest of several {cost, audit, text}; each as (state before, SQL of the step from it)."""
    return f"list_min(list_filter([{', '.join(step.replace('@', state) for state, step in plain)}], lambda m: m.c IS NOT NULL)) AS {to}"


_STATE = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
_STEP = "CASE WHEN @ IS NULL THEN NULL ELSE {{'c': @.c + {c}, 'a': @.a || '{a}', 't': @.t || {t}}} END"
_INSERT_USER = _STEP.format(c=5, a="I", t="'user:' || chr(10)")
_INSERT_ASSISTANT = _STEP.format(c=5, a="I", t="'assistant:' || chr(10)")


def _inserts(states: str) -> str:
    """Three rounds of insertions over the states e (nothing), s, u and a."""
    sql = states
    for _ in range(3):
        sql = f"""SELECT * REPLACE ({_moves('u', [('u', '@'), ('e', _INSERT_USER), ('s', _INSERT_USER), ('a', _INSERT_USER)])},
            {_moves('a', [('a', '@'), ('u', _INSERT_ASSISTANT)])}) FROM ({sql})"""
    return sql


def _edit(initial: str, role: str, cost: str, audit: str) -> str:
    return (f"CASE WHEN @ IS NULL OR must OR NOT ({initial}) THEN NULL "
            f"ELSE {{'c': @.c + late + {cost}, 'a': @.a || '{audit}', 't': @.t || {role} || ':' || text || chr(10)}} END")


_DELETE = _STEP.format(c=2, a="D", t="''")
OP12_SQL = rf"""
WITH RECURSIVE said AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS hurt
    FROM conversations),
hurt AS (
    SELECT conv_id, turn, CASE WHEN hurt = 4 THEN 'user' ELSE role END AS role,
           CASE hurt WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM (SELECT *, unnest(range(CASE hurt WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM said)),
placed AS (
    SELECT *, row_number() OVER w AS place,
           lag(left(role, 1)) OVER w AS before, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
    FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
faults AS (
    SELECT *, CASE WHEN body = '' THEN 'blank' WHEN place > min(place) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated'
                   ELSE '' END AS fault FROM placed),
ready AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS late FROM faults),
walk AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS place, {{'c': 0::BIGINT, 'a': '', 't': ''}}::{_STATE} AS e, NULL::{_STATE} AS s, NULL::{_STATE} AS u,
           NULL::{_STATE} AS a FROM hurt
    UNION ALL
    SELECT w.conv_id, w.place + 1, {_moves('e', [('e', _DELETE)])},
           {_moves('s', [('s', _DELETE), ('e', _edit("left(role, 1) = 's'", 'role', '0', 'K'))])},
           {_moves('u', [('u', _DELETE), *[(q, step) for q in 'esa' for step in (
               _edit("left(role, 1) = 'u'", 'role', '0', 'K'), _edit('true', "'user'", '1', 'R'))]])},
           {_moves('a', [('a', _DELETE), ('u', _edit("left(role, 1) = 'a'", 'role', '0', 'K')), ('u', _edit('true', "'assistant'", '1', 'R'))])}
    FROM ({_inserts('SELECT * FROM walk')}) w JOIN ready r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.place = w.place + 1),
ends AS (
    SELECT conv_id, list_min(list_filter([e, a], lambda m: m.c IS NOT NULL)) AS best
    FROM ({_inserts('SELECT * FROM walk QUALIFY place = max(place) OVER (PARTITION BY conv_id)')})),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (place > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id)
SELECT i.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
       coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(x.best.c, 0)::BIGINT AS cost,
       coalesce(x.best.a, '') AS audit, sha256(coalesce(left(x.best.t, length(x.best.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ends x ON x.conv_id IS NOT DISTINCT FROM i.conv_id
"""


# ---------------------------------------------------------------- op13
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-zÀ-ÿ]+')) AS run FROM documents),
distinct_runs AS (
    SELECT run, n, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h
    FROM (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run)),
words AS (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word,
           sum(n)::BIGINT AS n
    FROM distinct_runs GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
holes AS (
    SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
pairs AS (
    SELECT a.word AS a, b.word AS b, b.n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.rest
    UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.rest),
best AS (SELECT a, count(*) AS n_near, arg_min(b, {{'less': -n, 'word': b}}) AS form, max(n) AS form_n FROM pairs GROUP BY a),
formed AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.form_n >= 5 * w.n THEN b.form END AS form,
           CASE WHEN b.form_n >= 5 * w.n THEN b.form_n END AS form_n
    FROM words w LEFT JOIN best b ON b.a = w.word),
ways AS (
    SELECT word, word AS root, form AS next FROM formed
    UNION ALL SELECT w.word, f.word, f.form FROM ways w JOIN formed f ON f.word = w.next)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN ways w ON w.word = f.word AND w.next IS NULL
"""


QUERIES = {f.__name__: f for f in (
    op1_chat, op2_warc, op3_packing, op4_near_duplicates, op5_language, op6_substring_dedup, op7_decontamination,
    op8_neighbours, op9_quality, op10_secrets, op11_main_text, op12_conversation_repair, op13_spelling)}
ORACLE = {"op1_chat": OP1_SQL, "op2_warc": OP2_SQL, "op4_near_duplicates": OP4_SQL, "op6_substring_dedup": OP6_SQL,
          "op12_conversation_repair": OP12_SQL, "op13_spelling": OP13_SQL}
