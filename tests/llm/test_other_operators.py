"""Conversations, archives, vectors and the pipeline against plain versions."""
import gzip
import random
import time

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import chat, queries, vectors, warc

MESSAGES = "tree_id long, msg_id long, parent_id long, role string, text string, score double"


def test_reply_trees(spark):
    rng, rows, parent = random.Random(2), [], {}
    for tree in range(6):
        for m in range(1 if tree == 5 else 25):
            above = rng.randrange(m) if m and rng.random() < 0.95 else None
            parent[tree, m] = above
            text = rng.choice([None, "", "a ### b", "\\### Assistant: </turn> ok", "x\\", "</turn>\n### user:\n", "née\n"])
            rows.append((tree, m, above, rng.choice(["user", "assistant", None, "a:\n###"]), text, rng.choice([None, 1.0, 2.0])))
    rows += [(9, 1, 2, "user", "on a cycle", 1.0), (9, 2, 1, "user", "on a cycle", 1.0), (9, 3, 1, "user", "below it", 1.0)]
    df = spark.createDataFrame(rows, MESSAGES).withColumn("path", F.lit("clash"))
    said = {(t, m): (r or "", x or "", s or 0.0) for t, m, _, r, x, s in rows}
    want = {}
    for t, m in parent:
        if m not in {p for (tt, _), p in parent.items() if tt == t}:
            line = [m]
            while parent[t, line[0]] is not None:
                line.insert(0, parent[t, line[0]])
            want[t, m] = line
    out = chat.conversations(df).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()
    assert {(r.tree_id, r.leaf_id) for r in out} == set(want)
    for r in out:
        turns = [said[r.tree_id, m] for m in want[r.tree_id, r.leaf_id]]
        assert [(t.role, t.text) for t in r.turns] == [t[:2] for t in turns]
        assert r.loss == "".join(t[1] for t in turns if t[0] == "assistant") and r.n_turns == len(turns)
    best = {(r.tree_id, r.leaf_id) for r in chat.conversations(df, best=1).collect()}
    score = {k: sum(said[k[0], m][2] for m in line) / len(line) for k, line in want.items()}
    assert best == {min((k for k in want if k[0] == t), key=lambda k: (-score[k], k[1])) for t in range(6)}
    assert chat.conversations(df.where("false")).collect() == []


def test_reply_trees_of_a_null_tree(spark):
    rows = [(None, 1, None, "user", "ask", 1.0), (None, 2, 1, "assistant", "first", 2.0), (None, 3, 2, "user", "more", 2.0),
            (None, 4, 1, "assistant", "other", 0.0), (3, 1, None, "user", "ask", 1.0), (3, 2, 1, "assistant", "reply", 1.0)]
    out = chat.conversations(spark.createDataFrame(rows, MESSAGES))
    got = {(r.tree_id, r.leaf_id): [t.text for t in r.turns] for r in out.withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert got == {(None, 3): ["ask", "first", "more"], (None, 4): ["ask", "other"], (3, 2): ["ask", "reply"]}
    best = chat.conversations(spark.createDataFrame(rows, MESSAGES), best=1).collect()
    assert {(r.tree_id, r.leaf_id) for r in best} == {(None, 3), (3, 2)}


def test_op1_gives_a_row_for_null_conversations(spark, tmp_path):
    rows = [(None, 1, "user", "hello"), (None, 2, "assistant", "hi"), (None, None, "user", None), (5, 1, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in queries.op1_chat(spark, str(tmp_path)).collect()}
    assert got.pop(-7)[0] == 2 and got == {None: (3, 2), 5: (1, 0)}


def test_archives_round_trip(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "a\r\nb", ""), (5, "u", "é" * 9000), (2, "u", "same"), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = warc.read_archives(*warc.write_archives(pages)).collect()
    plain = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got)
    want = [(0, "revisit", 2, b"same"), (1, "revisit", 2, b"same"), (2, "response", None, b"same"), (2, "response", None, b"same"),
            (3, "revisit", 4, b""), (4, "response", None, b""), (5, "response", None, "é".encode() * 9000)]
    assert plain == [(*w[:3], len(w[3]), warc.bare_digest(w[3])) for w in want]
    assert warc.read_archives(*warc.write_archives(pages, least=5)).where("record_type = 'revisit'").count() == 0


def test_salvage():
    raw = [warc.record(i, "u", f"payload {i} ".encode() * 50, None) for i in range(6)]
    for pack in (warc.member, lambda r: r):
        parts = [pack(r) for r in raw]
        cut = bytearray(parts[2])
        cut[len(cut) // 2] ^= 0xFF
        data = b"".join([parts[0], parts[1], bytes(cut), parts[3], b"noise WARC/1.1 \x1f\x8b", parts[4], parts[5][:-9]])
        out = list(warc.salvage(data))
        assert [f["warc-record-id"] for _, _, f, _, _ in out if f] == [f"<urn:page:{i}>" for i in (0, 1, 3, 4)]
        assert [(s, e) for s, e, *_ in out][0][0] == 0 and out[-1][1] == len(data)
        assert all(a[1] == b[0] for a, b in zip(out, out[1:], strict=False))
        assert sum(f is None for _, _, f, _, _ in out) == 3 and all(r for *_, f, _, r in out if f is None)
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(gzip.compress(b"x")))[0][2] is None


def test_salvage_members_with_several_records():
    raw = [warc.record(i, "u", f"payload {i} ".encode() * 50, None) for i in range(6)]
    cut = bytearray(warc.member(raw[0] + raw[1] + random.Random(3).randbytes(20_000)))
    cut[-3000] ^= 0xFF  # two records are sound before the damage
    data = warc.member(b"".join(raw[:3])) + warc.member(raw[3] + b"noise" + raw[4]) + bytes(cut) + warc.member(raw[5]) + gzip.compress(b"x")
    out = list(warc.salvage(data))
    assert [f["warc-record-id"] if f else None for _, _, f, _, _ in out] == [
        *(f"<urn:page:{i}>" for i in (0, 1, 2, 3)), None, "<urn:page:4>", "<urn:page:0>", "<urn:page:1>", None, "<urn:page:5>", None]
    assert out[0][0] == 0 and out[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(out, out[1:], strict=False))
    assert "bytes" in out[4][4] and out[8][1] - out[8][0] == len(cut)
    bad = raw[0].replace(b"Content-Length: ", b"Content-Length: " + "²".encode())
    assert [f is None for _, _, f, _, _ in warc.salvage(bad + raw[1])] == [True, False]


def test_salvage_is_linear_in_false_marks():
    start = time.process_time()
    for piece in (b"\x1f\x8b\x08", b"\x1f\x8b\x08\x08name", b"WARC/1.1\r\n", b"WARC/1.1\r\nA: b\r\n"):
        noise = piece * (1_000_000 // len(piece))
        assert [(a, b, f) for a, b, f, _, _ in warc.salvage(noise)] == [(0, len(noise), None)]
    assert time.process_time() - start < 30


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 12)) * rng.uniform(0.2, 3, (600, 1))
    x[100:300] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(700, None), (720, [0.0] * 12), (740, [float("nan")] * 12), (760, [1.0] * 3), (780, [1.0, None] * 6), (None, [1.0] * 12), (0, x[0].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = {}
    for r in vectors.nearest(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1 and abs(r.score - float((x[r.query_id] * x[r.vec_id]).sum())) < 1e-12
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20)) and all(len(v) == 20 and v == sorted(v, key=lambda p: (-p[1], p[0])) for v in got.values())
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len({v for v, _ in found} & set(np.lexsort((np.arange(600), -np.round(s, 9)))[:20].tolist()))
    assert hit / (20 * len(got)) >= 0.9
    few = df.where("vec_id < 5")
    assert vectors.nearest(few, few, 20).count() == 20 and vectors.nearest(df.where("false"), df, 20).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    word = lambda: rng.choice(["ti", "la", "mo", "re", "su"]) + str(rng.randint(0, 300))
    text = [" ".join(word() for _ in range(80)) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(text)]
    rows += [(100, text[3], "en", "s", 1), (101, text[4] + " tail", "en", "s", 1), (102, None, None, None, None)]
    item = " ".join(word() for _ in range(20))
    rows += [(103, text[5][:100] + " " + item, "en", "s", 1), (104, "AAA!! " * 40, "en", "s", 1), (105, "BBB!! " * 50, "en", "s", 1),
             (106, " ".join(text[6].split()[::-1]) + " password=abcdefghijkl12", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(104, 0, 0), (105, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = queries.table(spark, str(tmp_path), "documents")
    lost = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in after.collect()}
        lost.append(gone - {102})
        docs = after
    assert lost[0] == {104, 105} and lost[1] == {100, 101} and lost[2] == {103} and lost[3] == set()
    assert "password" not in docs.where("doc_id = 106").first().text
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}


def test_encoder_equals_the_tokenizer_run_by_run():
    import public_tokenizers
    from tickloom.llm.packing import Encoder

    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["İstanbul don't 'tis a's क़ x!! İ! ǅ!?' ﬁ... ª² ᾳ! <|startoftext|> a<|endoftext|>! _a é ̈́ 한국어! ß'",
             "", " a! b　c d\x85e\x0b f\n\n", "Word word, word!? 15.1 x=y (755) ok'S", "word, again"]
    for text, want in zip(texts, encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == want.ids
