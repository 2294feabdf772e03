"""Main text, conversation repair and spelling variants against plain versions."""
import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import pytest

from tickloom.llm import queries, repair, spelling
from tickloom.llm.main_text import extract, main_text

# ---------------------------------------------------------------- main text
LONG = "The committee met on Tuesday and agreed on the new rules for the harbour after a debate of three hours. "


def test_article_is_kept_whole_and_the_rest_goes():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body>
    <header><h1>Site</h1><p>{LONG}</p></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>gone</p> -->
    <div class="ad">{LONG}</div><article><header><h1>Head &amp; line</h1></header><p><b>First.<br><p>Second
       line &#233;&nbsp;x</p><div class="ad-box">Buy</div><ul><li>one<li>two</ul><p>End.</p>
    <section id="comments"><article><p>{LONG}</p></article></section></article>
    <aside><p>{LONG}</p></aside><div class="cookie-notice">{LONG}</div><form>{LONG}<input value="v"></form><footer>&copy; {LONG}</footer>"""
    assert main_text(page) == "Head & line\n\nFirst.\n\nSecond line é x\n\none\n\ntwo\n\nEnd."


def test_distribution_finds_an_unmarked_article():
    side = "".join(f"<li><a href='/{i}'>Entry number {i}</a></li>" for i in range(40))
    page = f"""<body class="has-sidebar"><div><span>Home</span></div><div><ul>{side}</ul></div><div id="x"><h1>Head</h1><div class="entry">
    <p>{LONG}</p><p>Short.</p><h2>Part</h2><p>{LONG * 3}</p><blockquote><p>Quote.</p></blockquote><p>Last.</p></div></div>
    <div><ul>{side}</ul></div><div>Contact</div>"""
    assert main_text(page).split("\n\n") == ["Head", LONG.strip(), "Short.", "Part", (LONG * 3).strip(), "Quote.", "Last."]


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("plain", "plain"), ("<p>Hi", "Hi"), ("<nav>menu</nav>", ""), ("<!-- open", ""), ("a < b &lt; c &unknown; d", "a < b < c &unknown; d"),
    ("<script>never closed <p>x</p>", ""), ("<p>a<br>b  \n c</p><p> </p>", "a b c"), ("<a href='/x'>only a link</a>", ""),
    ("<article></article>", ""), ("<article><p class='ad'>x</p></article>", ""), ("<p title='a > b'>x</p>", "x")])
def test_small_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("piece", ["<!-- ", '<a "', "<div>", "<script>", "<li><a=\"", "</p>", "<", "<p>w</p>", "<div><li>"])
def test_hostile_pages_take_linear_time(piece):
    start = time.time()
    main_text(piece * 60_000)
    assert time.time() - start < 10


def test_pages_keep_their_rows(spark):
    rows = [(1, "u", "<article><p>x</p></article>"), (1, "u", "<article><p>x</p></article>"), (2, None, None), (None, "v", ""),
            (3, "w", "<article>" + "<p>word</p>" * 20_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS text", "1 AS n_chars")
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "x", 1), (1, "u", "x", 1), (2, None, "", 0), (None, "v", "", 0),
                          (3, "w", "\n\n".join(["word"] * 20_000), 6 * 20_000 - 2)], key=str)
    assert extract(df.where("false")).collect() == []


def test_op11_equals_the_articles_of_the_table(spark):
    def article(html):
        inner = html.split("<article>", 1)[1].split("</article>")[0]
        from html import unescape
        parts = (" ".join(unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", inner))
        return "\n\n".join(p for p in parts if p)

    sf = "/root/testdata/sf0.001"
    want = {r.page_id: article(r.html) for r in queries.table(spark, sf, "pages").collect()}
    assert {r.page_id: r.text for r in queries.op11_main_text(spark, sf).collect()} == want


# ---------------------------------------------------------------- conversation repair
def plain_repair(rows):
    """(cost, audit, repaired rows) of sorted (turn, role, text): the best edits from each place on, from the end to the start."""
    seen, fault = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\f\r")
        fault.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {}
    for i in range(len(rows), -1, -1):
        new = {}
        for q in ("", "s", "u", "a"):
            options = [(0, "", ())] if i == len(rows) and q in ("", "a") else []
            if i < len(rows):
                _, role, text = rows[i]
                c, a, out = best[q]
                options.append((2 + c, "D" + a, out))
                if fault[i] in ("", "truncated"):
                    late = 5 * (fault[i] == "truncated")
                    for to in after[q]:
                        name = {"u": "user", "a": "assistant"}.get(to)
                        if role[:1] == to:
                            c, a, out = best[to]
                            options.append((late + c, "K" + a, ((role, text), *out)))
                        elif name:
                            c, a, out = best[to]
                            options.append((late + 1 + c, "R" + a, ((name, text), *out)))
            new[q] = min(options) if options else (10 ** 9, "", ())
        for _ in range(4):
            for q in ("", "s", "u", "a"):
                for to in set(after[q]) - {"s"}:
                    c, a, out = new[to]
                    new[q] = min(new[q], (c + 5, "I" + a, (({"u": "user", "a": "assistant"}[to], ""), *out)))
        best = new
    return *best[""], Counter(fault)


def _summary(conv, rows):
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
                  key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), m[2].encode()))
    cost, audit, out, fault = plain_repair(rows)
    turns = {t for t, *_ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    text = "\n".join(f"{r}:{x}" for r, x in out)
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, fault["blank"], fault["duplicate"], fault["truncated"], illegal,
            cost, audit, hashlib.sha256(text.encode()).hexdigest())


def _rows(rng, n):
    said = ["Yes.", "No", "Why?", "", " \n", "Fine. ", "née!", None, "a.b"]
    return [(rng.choice([None, *range(n)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), rng.choice(said))
            for _ in range(n)]


def test_folding_equals_the_best_edits():
    rng = random.Random(5)
    for _ in range(3000):
        rows = [(i, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["x.", "x", "", f"{i}!"])) for i in range(rng.randrange(9))]
        cost, audit, out, _ = plain_repair(rows)
        seen, symbols = set(), ""
        for _, role, text in rows:
            own = role[0] if role[0] in "sua" else "x"
            symbols += "d" if not text or (role, text) in seen else own if text[-1] in ".!" else own.upper()
            seen.add((role, text))
        assert repair.closing(repair.fold(0, symbols))[:2] == (cost, audit)
        assert repair.replay(0, audit, [r for _, r, _ in rows], [t for *_, t in rows])[0] == list(out)


def test_blocks_equal_whole_conversations():
    rng = random.Random(6)
    for _ in range(300):
        rows = [(i, rng.choice(["system", "user", "assistant", "tool"]), f"{i}" + rng.choice([".", "", "?"]), 1) for i in range(1, 14)]
        cost, audit, _, fault = plain_repair([r[:3] for r in rows])
        choice, at, block = repair._Choice(1), 0, 0
        while at < len(rows):
            end = at + rng.randrange(1, 5)
            part = [(*r, "" if r[2][-1] in ".?" else "truncated") for r in rows[at:end]]
            choice.add(dict(zip(repair._NAMES, repair._block(1, block, part, at == 0), strict=True)))
            at, block = end, block + 1
        out = list(choice.rows())
        assert "".join(r[3] for r in out) + out[-1][4] == audit and out[-1][10] == cost and out[-1][8] == fault["truncated"]


def test_repair_equals_the_plain_version(spark):
    rng = random.Random(7)
    talks = {conv: _rows(rng, rng.randrange(1, 9)) for conv in [None, *range(150)]}
    talks[500] = [(i // 3, "user" if i % 2 else "assistant", f"{i}" + ("." if i % 5 else "")) for i in range(3 * repair.BLOCK_ROWS)]
    talks[501] = [(4, "user", "same.")] * 500 + [(5, "assistant", "x" * 200_000 + ".")]
    rows = [(conv, *m) for conv, said in talks.items() for m in said]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS block", "'x' AS audit")
    got = {r.conv_id: tuple(r) for r in repair.repair(df.repartition(7)).collect()}
    assert got == {conv: _summary(conv, said) for conv, said in talks.items()}
    assert repair.repair(df.where("false")).collect() == []
    said = repair.repaired_messages(df).where("conv_id = 500").orderBy("block", "at").collect()
    text = "\n".join(f"{r.role}:{r.text}" for r in said)
    assert hashlib.sha256(text.encode()).hexdigest() == got[500][-1]


def test_op12_returns_every_conversation(spark, tmp_path):
    turn = next(t for t in range(99) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    whole = next(c for c in range(10, 99) if zlib.crc32(f"{c}: ".encode()) % 20 > 4)
    spark.createDataFrame([(9, turn, "user", "gone."), (whole, None, None, None)], "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[9] == (0, 0, 0, 0, 0, 0, "", empty) and got[whole][1] == 1 and got[whole][-2:] == ("D", empty)


# ---------------------------------------------------------------- spelling variants
def plain_variants(words):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        beside = [v for v in words if near(v, w)]
        top = min(beside, key=lambda v: (-words[v], v), default=None)
        form = top if top is not None and words[top] >= 5 * n else None
        out[w] = [form, None, n, len(beside), words[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def _word_set(rng, size):
    letters = "abeéÀ×z"
    words = {}
    while len(words) < size:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 9)))
        words[w] = rng.choice([5, 6, 7, 30, 200, 5000])
        if rng.random() < 0.7:
            i = rng.randrange(len(w))
            words[w[:i] + rng.choice(["", rng.choice(letters), w[i] + rng.choice(letters)]) + w[i + 1:]] = rng.choice([5, 50, 900])
    words["a" * 3000], words["a" * 3001] = 10, 90
    return {w: n for w, n in words.items() if len(w) >= 6}


@pytest.mark.parametrize("limit", [1 << 15, 4])
def test_variants_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(spelling, "NODE_LIMIT", limit)  # small: nodes are split level by level, leaves into blocks
    words = _word_set(random.Random(limit), 700 if limit > 4 else 160)
    df = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("form", queries.F.lit(1))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df.select("word", "n")).collect()}
    assert got == plain_variants(words)


def test_leaves_beyond_the_limit_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "NODE_LIMIT", 3)
    # one leaf: code points of the last groups that differ by a multiple of the number of groups
    words = {"".join(chr(0xC0 + 6 * x) for x in digits): 5 + i for i, digits in enumerate(itertools.product(range(3), repeat=6)) if i % 7 == 0}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {(r.word, r.n_near) for r in spelling.variants(df).collect()}
    assert got == {(w, v[3]) for w, v in plain_variants(words).items()}


def test_words_are_counted_over_whole_texts(spark, docs):
    texts = [(1, "Harbour harbour, HARBOUR! harbour1harbour"), (2, None), (3, ""), (4, "ÉCOLIÈRE écolière " * 5000), (4, "kurz kurzes " * 6),
             (None, "harbour " * 3), (5, "x" * 70_000 + " harbour_harbours")]
    rows = docs(texts, extra=True)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            want[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    want = {w: n for w, n in want.items() if n >= 5 and len(w) >= 6}
    assert {r.word: r.n for r in spelling.counted_words(rows).collect()} == want
    assert spelling.group_variants(rows.where("false")).collect() == []
    assert {r.word for r in spelling.group_variants(rows).collect()} == set(want)


def test_some_words_lose_a_letter(spark, docs):
    doc = next(d for d in range(9999) if zlib.crc32(f"{d}:harbours".encode()) % 199 == 0)
    h = zlib.crc32(f"{doc}:harbours".encode()) % 8
    got = spelling.counted_words(docs([(doc, "harbours " * 5)])).collect()
    assert [r.word for r in got] == ["harbours"[:h] + "harbours"[h + 1:]]
