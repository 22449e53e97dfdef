"""Passage and line dedup against brute force."""

import random

import brute
import pytest

SCHEMA = "doc_id long, text string"


def lev(a, b, k):
    if abs(len(a) - len(b)) > k:
        return k + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def near(a, b, k):
    """Whether ``a`` and ``b`` are within ``k`` edits, by a band that ends when all of it is beyond."""
    row = {j: j for j in range(k + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - k), min(len(b), i + k) + 1):
            new[j] = i if not j else min(row.get(j, k) + 1, new.get(j - 1, k) + 1, row.get(j - 1, k + 1) + (x != b[j - 1]))
        row = new
        if not row or min(row.values()) > k:
            return False
    return row.get(len(b), k + 1) <= k


def prose(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    """Passages of 50 words at odd places, exact and with a word changed; clean documents."""
    rng = random.Random(5)
    rows, want = [], {}
    for k in range(20):
        p = prose(rng, 50 if k % 2 else 70)
        for c in range(2 + k % 3):
            q = list(p)
            if c == 1 and k % 2 == 0:
                q[35] = "changed"
            rows.append((len(rows), " ".join(prose(rng, rng.randrange(0, 90)) + q + prose(rng, rng.randrange(0, 90)))))
            want[len(rows) - 1] = len(rows) - 1 - c
    clean = range(len(rows), len(rows) + 40)
    rows += [(i, " ".join(prose(rng, 150))) for i in clean]
    return rows, want, set(clean)


def test_passages(spark, planted):
    from voxloom.llm.substring_dedup import dedup_passages, substring_report

    rows, want, clean = planted
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in substring_report(df).collect()}
    assert all(got[d].component_id == first and got[d].n_repeated >= 20 for d, first in want.items())
    assert all(got[d].n_removed >= 20 for d, first in want.items() if d != first)
    assert all(got[d].n_repeated == 0 and got[d].component_id == d for d in clean)
    out = {r.doc_id: r.text for r in dedup_passages(df).collect()}
    text = dict(rows)
    for d, r in got.items():
        assert len(brute.words(text[d])) - len(brute.words(out[d])) == r.n_removed
        assert r.n_removed or out[d] == text[d]


def test_passages_odd(spark):
    from voxloom.llm.substring_dedup import substring_report

    p = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (None, p), (3, p), (3, p), (4, "x " * 100_000 + p), (5, "short"), (None, None), (6, p.upper())]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as d", "'x' as h", "2 as pos")
    got = substring_report(df).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.n_words >= 60} == {3}
    assert substring_report(df.limit(0)).count() == 0


def test_passage_bucket_grid(spark):
    from voxloom.llm.components import connected_components
    from voxloom.llm.substring_dedup import PARAGRAPHS, paragraph_links, units

    rng = random.Random(2)
    base = prose(rng, 20)
    rows = []
    for i in range(60):
        q = list(base)
        if i:
            q[-1 if i % 2 else 0] = f"z{i}"
        rows.append((i, " ".join(q)))
    df = spark.createDataFrame(rows, SCHEMA)
    roots = connected_components(paragraph_links(df, units(df).where(f"kind = {PARAGRAPHS}"), cell=8)).collect()
    assert len(roots) == 60 and len({r.root for r in roots}) == 1


def test_substring_scratch(spark, sf_dir):
    """The rows of picks and paragraphs, the largest table, are gone before the windows' sides are shuffled."""
    from voxloom.llm import common
    from voxloom.llm.substring_dedup import repeated_passages

    before = len(common.made())
    repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    left = [p for p in common.made()[before:] if (x := common._hadoop(spark, p))[1].exists(x[0])]
    assert not [p for p in left if "substring-units" in p or "substring-own" in p]


@pytest.mark.parametrize("edits,hot", [(1, 64), (1, 2), (2, 64)])
def test_lines_brute(spark, edits, hot):
    from voxloom.llm.line_dedup import line_links

    rng = random.Random(edits * 10 + hot)
    lines = set()
    for _ in range(40):
        base = "".join(rng.choice("abcdé 日") for _ in range(rng.randrange(4, 30)))
        for _ in range(6):
            x = list(base)
            for _ in range(rng.randrange(0, 4)):
                k = rng.randrange(len(x))
                rng.choice([lambda: x.insert(k, "q"), lambda: x.__setitem__(k, "w"), lambda: x.pop(k) if len(x) > 3 else None])()
                if not x:
                    x = ["a"]
            lines.add("".join(x))
    lines = sorted(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    got = {(r.u, r.v) for r in line_links(df, edits, 4, hot).collect()}
    want = {(i, j) for j in range(len(lines)) for i in range(j) if min(len(lines[i]), len(lines[j])) >= 4 and lev(lines[i], lines[j], edits) <= edits}
    assert {tuple(sorted(x)) for x in got} == want


def test_line_report(spark):
    from voxloom.llm.line_dedup import dedup_lines, line_report

    a, b = "the quick brown fox jumps", "the quick brown fox jump"
    rows = [(3, f"{a}\nx\n{a}"), (1, f"{b}\n\n \ny"), (2, None), (4, ""), (None, f"{a}\nown line here"), (5, "x"), (5, "x"), (None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as lid", "'q' as line")
    got = {(r.doc_id, r.n_lines): r for r in line_report(df).collect()}
    assert (got[3, 3].n_repeated, got[3, 3].n_removed, got[3, 3].component_id, got[3, 3].first_docs) == (3, 2, 1, [1, 3])
    assert (got[1, 2].n_repeated, got[1, 2].n_removed) == (1, 0)
    assert got[2, 0].component_id == 2 and got[None, 2].n_removed == 1 and got[5, 1].n_removed == 1
    out = {(r.doc_id, r.text) for r in dedup_lines(df).collect()}
    assert {(3, "x"), (1, f"{b}\n\n \ny"), (None, "own line here"), (5, ""), (2, None)} <= out
    assert line_report(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot,spanning", [(64, False), (4, False), (4, True)])
def test_lines_edits_by_length(spark, hot, spanning):
    """One edit in ten code points, up to four; numbered lines and common starts make hot segments."""
    from voxloom.llm.line_dedup import EDITS, LEAST, PER, line_links

    rng = random.Random(hot)
    lines = {f"copyright notice of the page number {k:04d} of all" for k in rng.sample(range(10_000), 60)}
    lines |= {"a start that very many lines have in common " + " ".join(prose(rng, 3)) for _ in range(40)}
    for _ in range(30):
        base = "".join(rng.choice("abcdé 日") for _ in range(rng.randrange(18, 80)))
        for _ in range(5):
            x = list(base)
            for _ in range(rng.randrange(0, 6)):
                k = rng.randrange(len(x))
                rng.choice([lambda: x.insert(k, "q"), lambda: x.__setitem__(k, "w"), lambda: x.pop(k)])()
            lines.add("".join(x))
    lines = sorted(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    got = {tuple(sorted(r)) for r in line_links(df, hot=hot, per=PER, spanning=spanning).collect()}
    want = set()
    for j, y in enumerate(lines):
        for i, x in enumerate(lines[:j]):
            n = min(len(x), len(y))
            if n >= LEAST and lev(x, y, min(EDITS, n // PER)) <= min(EDITS, n // PER):
                want.add((i, j))
    assert len([p for p in want if lev(lines[p[0]], lines[p[1]], 1) > 1]) > 100
    if not spanning:
        assert got == want
        return

    def classes(pairs):
        root = list(range(len(lines)))
        for i, j in sorted(pairs):
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
        return {frozenset(i for i in range(len(lines)) if root[i] == r) for r in set(root)}

    assert got <= want and classes(got) == classes(want)


def test_lines_blocks(spark):
    """Links across the borders of blocks of lengths, with few segment rows a line."""
    from pyspark.sql import functions as F

    from voxloom.llm.line_dedup import EDITS, LEAST, PER, _probes, _rows, line_links

    rng = random.Random(11)
    lines = {}
    for n in (20, 30, 40, 64, 128, 256):
        base = "".join(rng.choice("abcdefgh é") for _ in range(n))
        lines[base] = n
        for k in range(1, EDITS + 1):
            at = rng.randrange(n - k)
            for x in ("q" * k + base, base + "q" * k, base[k:], base[:-k], base[:at] + base[at + k :], base[:at] + "w" * k + base[at + k :], base[k:] + "q" * k, base[:at] + "q" * k + base[at:]):
                lines[x] = n
            x = list(base)
            for _ in range(k):
                j = rng.randrange(len(x))
                rng.choice([lambda: x.insert(j, "q"), lambda: x.__setitem__(j, "w"), lambda: x.pop(j)])()
            lines["".join(x)] = n
    family = list(lines.values())
    lines = list(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    got = {tuple(sorted(r)) for r in line_links(df, per=PER).collect()}
    want = set()
    for j, y in enumerate(lines):
        for i, x in enumerate(lines[:j]):
            n = min(len(x), len(y))
            if family[i] == family[j] and n >= LEAST and abs(len(x) - len(y)) <= EDITS and lev(x, y, min(EDITS, n // PER)) <= min(EDITS, n // PER):
                want.add((i, j))
    assert got == want
    assert len(want) > 100
    long = spark.range(320).select(F.col("id").alias("row"), F.col("id").alias("lid"), F.lit(0).alias("edits"), F.lit(0).alias("grp"), F.lit(0).alias("path"), F.expr("repeat('x', int(200 + id))").alias("line"), F.expr("int(200 + id)").alias("len"))
    assert _rows(long, _probes(spark, EDITS, PER)).count() < 15 * 320


def test_lines_near_copies(spark):
    """Lines with a word or two replaced in a long common text: all links, without splitting each line again and again."""
    from voxloom.llm import common
    from voxloom.llm.line_dedup import PER, line_links

    rng = random.Random(3)
    base = prose(rng, 60)
    lines = {" ".join(base)}
    for _ in range(45):
        x = list(base)
        for k in rng.sample(range(60), rng.randrange(1, 3)):
            x[k] = "".join(rng.choice("bcdfgklmp") for _ in range(rng.randrange(9, 14)))
        for k in (0, 1, 2):
            # the copy's own near copies: one more letter, one changed, both
            y = " ".join(x)
            at = rng.randrange(len(y) - 1)
            lines.add(y if not k else y[:at] + "q" + y[at + k - 1 :])
    lines = sorted(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    before = len(common.made())
    got = {tuple(sorted(r)) for r in line_links(df, hot=40, per=PER).collect()}
    assert got == {(i, j) for j in range(len(lines)) for i in range(j) if near(lines[i], lines[j], 4)}
    assert len(got) > 100
    again = sum(spark.read.parquet(p).count() for p in common.made()[before:] if "line-rest" in p)
    assert again < 2 * len(lines)


def test_lines_placed(spark):
    """A hit's code alone gives its segment's place, so hot segments need no join with the table of segments."""
    from pyspark.sql import functions as F

    from voxloom.llm.line_dedup import EDITS, PER, _placed, _probes, _rows

    x = spark.range(20, 500, 7).select("id", F.col("id").alias("row"), F.col("id").alias("lid"), F.lit(0).alias("edits"), F.lit(0).alias("grp"), F.lit(0).alias("path"), F.expr("int(id)").alias("len"))
    x = x.withColumn("line", F.expr("array_join(transform(sequence(1, len), k -> char(int(33 + pmod(xxhash64(k, id), 90)))), '')")).drop("id")
    placed = _placed(_rows(x, _probes(spark, EDITS, PER)).join(x.select("row", "len", "line"), "row"))
    again = F.xxhash64(F.expr("substring(line, at + 1, size)"), F.expr("int(len - back)"), F.expr("int(i)"), F.col("t"), F.lit(0))
    n = placed.count()
    assert n > 500 and placed.where(again.eqNullSafe(F.col("key"))).count() == n


def test_line_report_edits(spark):
    from voxloom.llm.line_dedup import line_report

    rows = [(1, "A inglysh outionat in er, ntoush lyonen and more of the words it had."), (2, "A inglysh outionat in tion ntoush lyonen and more of the words it had."), (3, "a short line of words 12"), (4, "a short line of words 98")]
    got = {r.doc_id: r.component_id for r in line_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def common_words(a, b, least=49):
    """Places of ``a`` in runs of ``least`` words or more that ``b`` holds too."""
    out, row = set(), [0] * (len(b) + 1)
    for i, x in enumerate(a):
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        n = max(row)
        if n >= least:
            out |= set(range(i - n + 1, i + 1))
    return out


def test_passages_whole(spark):
    """Every word of a common passage, by a search of all runs."""
    from voxloom.llm.substring_dedup import dedup_passages, substring_report

    rng = random.Random(11)
    rows = []
    for n in (49, 50, 60, 60, 75, 100, 200):
        p = prose(rng, n)
        longer = prose(rng, 15) + p + prose(rng, 12)
        for q in (p, longer, longer, p):
            rows.append((len(rows), prose(rng, rng.randrange(100, 160)) + q + prose(rng, rng.randrange(100, 160))))
    got_rows = [(d, " ".join(w)) for d, w in rows]
    df = spark.createDataFrame(got_rows, SCHEMA)
    got = {r.doc_id: r for r in substring_report(df).collect()}
    out = {r.doc_id: r.text.split() for r in dedup_passages(df).collect()}
    for d, w in rows:
        mates = [(e, v) for e, v in rows if e != d and e // 4 == d // 4]
        some = set().union(*(common_words(w, v) for _, v in mates))
        gone = set().union(*(common_words(w, v) for e, v in mates if e < d))
        # a paragraph that hangs over an end by a word or two is similar enough (or by a chain of links) to count whole
        assert len(some) <= got[d].n_repeated <= len(some) + 2
        assert len(gone) <= got[d].n_removed <= len(gone) + 2 * bool(gone)
        at, end = min(gone, default=0), max(gone, default=-1) + 1
        cuts = [(i, j) for i in range(3) for j in range(3 - i)]
        assert out[d] in [w[: at - i] + w[end + j :] for i, j in cuts] if gone else out[d] == w
        assert got[d].component_id == d - d % 4


def test_short_texts(spark):
    """Exact copies of any length, and near-copies by the Jaccard similarity of their shingles."""
    from voxloom.llm.substring_dedup import SIMILARITY, WHOLE, dedup_passages, substring_report

    rng = random.Random(17)
    rows, want = [], {}
    for n in [1, 2, 4, 5, 6, 12, 19, 20, 21, 35, 49, 50, 60, 80, WHOLE - 1] * 2:
        p = prose(rng, n)
        q = list(p)
        q[n // 2] = f"changed{len(rows)}"
        grams = [{tuple(x[i : i + 5]) for i in range(n - 4)} for x in (p, q)]
        near = n >= 5 and len(grams[0] & grams[1]) >= SIMILARITY * len(grams[0] | grams[1])
        first = len(rows)
        for w in (p, p, q):
            want[len(rows)] = (n, w is not q or near, first)
            rows.append((len(rows), " ".join(w)))
    assert len({t for _, t in rows}) == 60
    df = spark.createDataFrame([*rows, (-1, ""), (-2, None), (-3, "? !")], SCHEMA)
    got = {r.doc_id: r for r in substring_report(df).collect()}
    out = {r.doc_id: r.text for r in dedup_passages(df).collect()}
    for d, (n, whole, first) in want.items():
        if whole:
            assert (got[d].n_repeated, got[d].n_removed, got[d].component_id) == (n, n * (d != first), first)
            assert len(brute.words(out[d])) == n * (d == first)
    assert [got[d].n_repeated for d in (-1, -2, -3)] == [0, 0, 0] and out[-2] is None and out[-3] == "? !"
    assert sum(whole and d % 3 == 2 for d, (_, whole, _) in want.items()) >= 8
