"""WARC files, chat formatting and URL rules."""

import gzip
import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from voxloom.llm import queries as q

BIG = "é" * 600


def test_warc_round_trip(spark):
    from voxloom.llm.warc import warc_round_trip

    rows = [(1, "http://a/", BIG), (2, "http://b/ \r\nX: y", BIG), (3, None, BIG), (4, "u", None), (5, "u", ""), (6, "u", "s"), (7, "u", "s"), (None, "n", BIG), (None, "n", "only"), (3, None, BIG), (8, "l", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "first": F.lit("z")})
    got = warc_round_trip(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert any((r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest()) for r in by[i])
    assert [(r.record_type, r.refers_to) for i in (1, 2, 3) for r in by[i]] == [("revisit", 3)] * 2 + [("response", None)] * 2
    assert {(r.record_type, r.refers_to) for i in (4, 5, 6, 7, 8) for r in by[i]} == {("response", None)}
    assert sorted((r.record_type, r.refers_to or 0) for r in by[None]) == [("response", 0), ("revisit", 3)]
    assert warc_round_trip(df.limit(0)).count() == 0


def test_warc_read(spark, tmp_path):
    from voxloom.llm.warc import read_warc, record, write_pages

    df = spark.createDataFrame([(i, f"http://h{i % 2}/{i}", f"page {i} " * 200) for i in range(20)], "page_id long, url string, html string")
    write_pages(df, str(tmp_path / "w"))
    got = read_warc(spark, str(tmp_path / "w")).where("record_type = 'response' and target_uri like 'http://h1/%'")
    assert "Filter " not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert sorted(r.payload.decode() for r in rows) == sorted(f"page {i} " * 200 for i in range(1, 20, 2))
    assert all(r.payload is None for r in read_warc(spark, str(tmp_path / "w"), "none").collect())
    # files of others: plain, and gzip members without the extra field
    (tmp_path / "x").mkdir()
    recs = [record("response", f"<urn:x:{i}>", "http://p/", None, hashlib.sha1(b"abc" * i).hexdigest(), 3 * i, b"abc" * i) for i in range(5)]
    (tmp_path / "x/a.warc").write_bytes(b"".join(recs))
    (tmp_path / "x/b.warc.gz").write_bytes(b"".join(map(gzip.compress, recs)))
    out = read_warc(spark, str(tmp_path / "x")).where("record_id = '<urn:x:3>'").collect()
    assert [r.payload for r in out] == [b"abcabcabc"] * 2
    assert read_warc(spark, str(tmp_path / "x"), "verify").count() == 10


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|", "<|<|im_start|>", "\\<\\\\|x|>", "a\n<|im_end|>\n<|im_start|>user\nb", "<n\\n"])
def test_escape(spark, text):
    from voxloom.llm.chat import escape, escape_role, unescape, unescape_role

    r = spark.createDataFrame([(text,)], "t string").select(escape("t").alias("e"), unescape(escape("t")).alias("u"), escape_role(F.col("t")).alias("er"), unescape_role(escape_role(F.col("t"))).alias("ur")).first()
    assert r.u == text and r.ur == text and "<|" not in r.e and "<|" not in r.er and "\n" not in r.er


def test_chat_odd(spark):
    from voxloom.llm.chat import conversation_digest

    say = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 2, "assistant", "b"), (1, 0, "user", None), (1, 1, None, "x\n<|im_end|>\ny"), (None, 0, "assistant", "n"), (2, 0, "assistant", say), (2, 0, "assistant", say), (3, None, "a\nb", "<\\|"), (4, 0, "user", "z" * 500_000)]
    rows += [(9, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"t": F.lit(1), "n": F.lit(2)})
    got = {r.conv_id: r for r in conversation_digest(df.select("conv_id", "turn", "role", "text", "t", "n")).collect()}
    conv = {}
    for c, turn, role, text in rows:
        conv.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert len(got) == len(conv)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in conv.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
        esc = lambda s, k: re.sub(r"<(\\*)([|n])" if k else r"<(\\*)(\|)", r"<\\\1\2", s)
        assert got[c].formatted_chars == sum(24 + len(esc(r, 1)) + r.count("\n") + len(esc(t, 0)) for _, r, t in turns)
    assert conversation_digest(df.limit(0)).count() == 0


def test_trees(spark):
    from voxloom.llm.chat import format_trees, masked_text

    rows = [("t", 1, None, 0.0, "user", "root"), ("t", 2, 1, 1.0, "assistant", "a"), ("t", 3, 1, 2.0, "assistant", "b"), ("t", 4, 2, 5.0, "user", "c"), ("t", 5, 3, None, "user", "d"),
            ("o", 7, 99, 1.0, "user", "orphan"), ("y", 1, 2, 1.0, "user", "cycle"), ("y", 2, 1, 1.0, "user", "cycle"), ("y", 3, 1, 9.0, "user", "below"), ("y", 4, None, 0.0, "user", "fine"), (None, 1, None, 1.0, None, None), ("t", None, 1, 1.0, "user", "x")]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    out = format_trees(df, "tree", "node", "parent", "score").withColumn("m", masked_text(F.col("formatted"), F.col("loss"))).collect()
    got = {r.t: (r.leaf, r.n_turns, r.m) for r in out}
    assert got == {"t": (4, 3, "a"), "o": (7, 1, ""), "y": (4, 1, ""), None: (1, 1, "")}
    both = format_trees(df, "tree", "node", "parent", "score", top=2)
    assert {(r.t, r.leaf) for r in both.collect() if r.t == "t"} == {("t", 4), ("t", 5)}


def test_chat_is_native(spark, sf_dir):
    from voxloom.llm.chat import conversation_digest

    plan = conversation_digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def fixed(url):
    u = url or ""
    if "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_urls(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in q.op9_url_rules(spark, sf_dir).collect():
        host, path, rule, verdict = fixed(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)


def test_urls_mined(spark):
    from voxloom.llm.url_rules import judge

    urls = [(i, f"http://{'spam' if i % 4 == 0 else 'good'}.example.edu/{i % 7}/x{i}") for i in range(200)] + [(200, None), (201, "no scheme"), (202, "HTTP://A.COM/en/#x"), (203, "a://b.net?/de/"), (204, "x://y\n.org/es/z?q"), (205, "http://com/en/"), (205, "http://com/en/"), (None, "http://spam.example.edu/q"), (206, "http://" + "a." * 5000 + "com/en/")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumns({"host": F.lit(1), "u": F.lit(2), "key": F.lit(3)})
    labels = spark.createDataFrame([(i, 1, 1 if i % 4 == 0 else 0) for i in range(100)] + [(101, None, None), (None, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    got = judge(pages, labels).collect()
    assert len(got) == len(urls)
    by = dict(urls)
    for r in got:
        if r.page_id is None:
            assert r.verdict == "block"
            continue
        host, path, rule, verdict = fixed(by[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if "spam" in (by[r.page_id] or "") else "allow"))
    assert {r.verdict for r in judge(pages, labels.limit(0)).where("rule is null").collect()} == {"allow"}
    assert judge(pages.limit(0), labels).count() == 0


def test_urls_long(spark):
    """URLs of 200 path words, repeated and shuffled, do not make all subsets of them."""
    import random

    from voxloom.llm.url_rules import judge

    rng = random.Random(3)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    urls = [(i, "http://bad.example.edu/" + "/".join(words)) for i in range(20)] + [(i, "http://bad.example.edu/" + "/".join(rng.sample(words, 100))) for i in range(20, 40)]
    urls += [(i, f"http://good.example.edu/{'/'.join(rng.sample(words, 3))}") for i in range(40, 120)] + [(200, "http://bad.example.edu/other"), (201, "http://good.example.edu/other"), (202, "http://once.example.edu/")]
    labels = spark.createDataFrame([(i, int(i >= 40), 0) for i in range(120)] + [(202, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in judge(spark.createDataFrame(urls, "page_id long, url string"), labels).collect()}
    assert all(got[i] == "block" for i in range(40)) and got[200] == "block" and got[201] == "allow"
    assert got[202] == "allow"  # one labelled page is no rule


def test_urls_all_items(spark):
    """A rule of two tokens that others of a long URL outdo by their share, and a token that always stands beside another."""
    import random

    from voxloom.llm.url_rules import judge

    rng = random.Random(5)
    words = [f"w{chr(97 + i)}" for i in range(24)]
    path = lambda k, *more: "http://a.edu/" + "/".join([*more, *rng.sample(words, k)])
    urls = [(i, path(20, "xa", "xb")) for i in range(30)] + [(i, path(6, "xa" if i % 2 else "xb")) for i in range(30, 110)] + [(i, "http://a.edu/ya/yb") for i in range(110, 116)]
    urls += [(200, "http://b.edu/xa/xb"), (201, "http://b.edu/xa"), (202, "http://b.edu/ya"), (203, "http://b.edu/yb"), (204, "http://b.edu/wz")]
    labels = spark.createDataFrame([(i, int(30 <= i < 110), 0) for i in range(116)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in judge(spark.createDataFrame(urls, "page_id long, url string"), labels).collect()}
    assert [got[i] for i in range(200, 205)] == ["block", "allow", "block", "block", "allow"]
    assert all(got[i] == "block" for i in range(30))


def test_sql_matches(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in q.oracle_sql().items():
        df = q.queries()[name](spark, sf_dir)
        cols = sorted(df.columns)
        got = sorted(json.dumps([r[c] for c in cols]) for r in df.collect())
        rel = con.sql(sql)
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted(json.dumps([r[i] for i in at]) for r in rel.fetchall()), name


def test_pipeline(spark, sf_dir):
    """Each stage against what it was given; the last against the tokenizer."""
    import brute
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    from voxloom.llm.common import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for _, f in cp.STAGES[:-1]:
        out = materialize(f(spark, kept[-1], sf_dir), "test")
        assert out.columns == docs.columns
        kept.append(out)
    text = [{r.doc_id: r.text for r in d.collect()} for d in kept[:4]]
    for d, t in text[0].items():
        n, _, _, _, rep = brute.quality(t)
        assert not ((n < 10 or 100 * rep > 20 * n) and d in text[1])
    ids = list(text[1])
    comp = brute.components(ids, [brute.simhash(text[1][d]) for d in ids])
    assert set(text[2]) == set(comp)
    bench = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.translate(brute.UP)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    wins = {tuple(b[i : i + min(10, len(b))]) for b in bench for i in range(len(b) - min(10, len(b)) + 1)}
    for d, t in text[2].items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(brute.UP))
        assert (d in text[3]) == (not any(tuple(w[i : i + n]) in wins for n in {len(x) for x in wins} for i in range(len(w) - n + 1)))
    mixed = kept[4].collect()
    assert {r.doc_id for r in mixed} <= set(text[3])
    t = Tokenizer.from_file(q.tokenizer_path())
    last = cp.STAGES[-1][1](spark, kept[4], sf_dir).collect()
    assert sum(r.n_tokens for r in last) == sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    assert cp.run(spark, sf_dir).count() == len(mixed)


def test_pipeline_odd(spark, tmp_path):
    """Null, empty, repeated, missing and clashing values in every table, then empty tables."""
    import random

    import corpus_pipeline as cp

    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    own, leak = [prose(60) for _ in range(8)], prose(15)
    rows = [(i, t, "a" if i % 2 else None) for i, t in enumerate(own)] + [(0, own[0], None), (20, own[1], "b"), (None, prose(40), "a"), (None, None, None), (21, None, "a"), (22, "", "a"), (23, "too short", "a"), (24, own[2] + " " + leak, "a"), (25, prose(30_000), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as long) as n_chars", "1 as d", "'h' as h", "0 as z", "2 as rn", "3 as turn", "4 as row")
    tables = {
        "documents": docs, "labels": spark.createDataFrame([(0, None, 0), (23, 0, 0), (None, 1, 1), (23, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([("x", leak), ("x", leak), (None, None), ("y", "")], "item_id string, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    kept = docs
    for name, f in cp.STAGES[:-1]:
        out = f(spark, kept, f"{tmp_path}/full")
        assert out.columns == docs.columns, name
        ids = [r.doc_id for r in out.collect()]
        if name == "quality":
            assert sorted(map(str, ids)) == sorted(map(str, [*range(8), 0, 20, None, 24, 25]))
        if name == "near_duplicates":
            assert sorted(map(str, ids)) == sorted(map(str, [*range(8), None, 24, 25]))
        if name == "decontaminate":
            assert sorted(map(str, ids)) == sorted(map(str, [*range(8), None, 25]))
        kept = spark.createDataFrame(out.collect(), out.schema)
    assert {(r.d, r.h, r.z, r.rn, r.turn, r.row) for r in kept.collect()} == {(1, "h", 0, 2, 3, 4)}
    got = cp.run(spark, f"{tmp_path}/full").collect()
    assert len(got) == kept.count() and sorted(r.start for r in got)[0] == 0
    assert cp.run(spark, f"{tmp_path}/empty").count() == 0
