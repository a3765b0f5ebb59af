import hashlib
import itertools
import math
import random
import re
import time

import pytest

from txscore.llm import decontaminate, jaccard, line_dedup, tokens
from txscore.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, token long, component string"


def docs(spark, texts, first=0):
    rows = [(t if isinstance(t, tuple) else (k + first, t)) for k, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x") for i, t in rows], DOCS)


def words(r, n, vocabulary=40):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# near copies


def shingles(t, n):
    w = [x for x in re.split("[\x20\x09-\x0d]+", lower(t)) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(texts, n, percent):
    s = {k: shingles(t, n) for k, t in texts.items()}
    parent = {k: k for k in s}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(s[k]), root(k)) for k in s}


def copies(seed, n=120):
    """A large group of near copies, chains of copies, exact copies, very short and odd texts."""
    r = random.Random(seed)
    base, out = [f"b{i}" for i in range(150)], []
    for _ in range(n // 2):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
        out.append(" ".join(w))
    chain = [f"c{i}" for i in range(60)]
    for k in range(n // 4):
        chain = [*chain, f"d{k}"][1 if k % 2 else 0 :]
        out.append(" ".join(chain))
    out += [words(r, r.randrange(1, 60)) for _ in range(n // 4)]
    return [*out, *out[:5], out[0].upper(), "", None, " \t\n", "one", "One", "two words", "a b c", "a\x0bb c", "é É", "x" * 200_000, "a b c " * 30_000, "a b c"]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, n, percent):
    texts = copies(n)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(spark, texts), n, percent).collect()}
    assert got == components(dict(enumerate(texts)), n, percent)


def test_no_large_bucket_pair_is_lost(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    monkeypatch.setattr(jaccard, "SMALL", 2)
    r = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2])):
            w[r.randrange(100)] = f"x{r.randrange(5)}"
        texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(spark, texts)).collect()}
    assert got == components(dict(enumerate(texts)), 3, 90)


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    texts = dict(enumerate(copies(3)))
    s = {k: shingles(t, 3) for k, t in texts.items()}
    linked = {(a, b) for a in s for b in s if a != b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 90 * len(s[a] | s[b])}
    got = {r.doc_id: r.n_links for r in jaccard.jaccard_join(docs(spark, list(texts.values()))).collect()}
    assert got == {k: sum(a == k for a, _ in linked) for k in s}
    first = {k: min(b for b in s if s[b] == s[k]) for k in s}
    pairs = [(r.a, r.b) for r in jaccard.near_pairs(docs(spark, list(texts.values()))).collect()]
    assert len(pairs) > 200 and sorted(pairs) == sorted({(first[a], first[b]) for a, b in linked if first[a] < first[b]})


@pytest.mark.parametrize("few", [500_000, 0])
def test_links_of_repeated_rows(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 5)
    monkeypatch.setattr(jaccard, "BROADCAST_NODES", few)
    base = [f"b{i}" for i in range(60)]
    texts = {k: " ".join([*base, f"x{k % 9}", f"y{k}"]) for k in range(30)}
    s = {k: shingles(t, 3) for k, t in texts.items()}
    want = {a: sum(a != b and 100 * len(s[a] & s[b]) >= 90 * len(s[a] | s[b]) for b in s) for a in s}
    rows = [(k, t) for k, t in texts.items() for _ in range(4)]
    got = jaccard.jaccard_join(docs(spark, rows).repartition(5)).collect()
    assert len(got) == 120 and {(r.doc_id, r.n_links) for r in got} == set(want.items())


def test_links_defined_cases(spark):
    assert jaccard.jaccard_join(docs(spark, [])).count() == 0
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (9, "a b c d"), (2, None)]
    got = {(r.doc_id, r.n_links) for r in jaccard.jaccard_join(docs(spark, rows)).collect()}
    assert got == {(5, 1), (None, 0), (9, 1), (2, 0)}


def test_near_duplicates_defined_cases(spark):
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (9, "a b c d"), (2, None)]
    got = sorted(map(tuple, jaccard.near_duplicates(docs(spark, rows)).collect()), key=repr)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, None), (9, 2, 5), (2, 0, 2)], key=repr)


def test_keep_one(spark):
    d = docs(spark, copies(7))
    kept = jaccard.keep_one(d)
    want = {k for k, (_, c) in components({r.doc_id: r.text for r in d.collect()}, 5, 80).items() if k == c}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == d.columns


def test_filters_hold_at_the_edge():
    limit = jaccard.Threshold(90)
    for n in range(1, 400):
        assert 1 <= limit.prefix(n) <= n
        need = limit.overlap(2 * n)
        assert 190 * need >= 90 * 2 * n > 190 * (need - 1)
    with pytest.raises(ValueError):
        jaccard.Threshold(0)


def test_connected_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (300, 300), (None, 5), (200, 100)] + [(r.randrange(500, 600), r.randrange(500, 600)) for _ in range(60)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    for a, b in edges:
        if a is not None and a != b:
            parent.setdefault(a, a)
            parent.setdefault(b, b)
    for _ in range(600):
        for a, b in edges:
            if a is not None and a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# repeated lines


def brute_lines(rows, least):
    """Every run of lines by its contents; the later copies of shortest passages, joined where they touch, go but for their first copy."""
    by_doc = {}  # (line, text, words) of the lines with words
    for d, t in sorted({(d, t) for d, t in rows if d is not None and t is not None}):
        by_doc[d] = [(k, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for k, x in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for d, full in by_doc.items():
        for a in range(len(full)):
            for b in range(a, len(full)):
                n = sum(x[2] for x in full[a : b + 1])
                if n >= least and min(n - full[a][2], n - full[b][2]) < least:
                    places.setdefault(tuple(x[1] for x in full[a : b + 1]), []).append((d, a, b))
    diagonals = {}
    for found in places.values():
        first = min(found)
        for d, a, b in found:
            if (d, a) != first[:2]:
                diagonals.setdefault((d, first[0], a - first[1]), set()).update(range(a, b + 1))
    gone = set()
    for (d, source, away), lines in diagonals.items():
        line = {k: x[0] for k, x in enumerate(by_doc[d])}
        for a in sorted(k for k in lines if k - 1 not in lines):
            b = next(k for k in itertools.count(a) if k + 1 not in lines)
            first_copy = range(line[a - away], line[b - away] + 1) if source == d else ()
            gone |= {(d, k) for k in range(line[a], line[b] + 1) if k not in first_copy}
    return {(d, t): t if d is None or t is None or not any(g == d for g, _ in gone) else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows}


@pytest.mark.parametrize("seed", range(3))
def test_lines_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", [2, 10, 10**6][seed])
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", [0, 10**6, 0][seed])
    r = random.Random(seed)
    pool = [words(r, r.choice([1, 2, 3, 7])) for _ in range(6)] + ["", "  ", "ü"]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 9)))) for k in range(25)]
    rows += [(30, None), (31, ""), (32, rows[0][1]), (33, "\n".join([pool[0]] * 30)), (34, rows[33 - 33][1] + "\n\n"), (None, rows[0][1]), (35, "z " * 3000)]
    least = 6
    got = {(x.doc_id, x.before): x.text for x in line_dedup.dedup_lines(docs(spark, rows).selectExpr("*", "text before"), least).collect()}
    assert got == brute_lines(rows, least)


def test_lines_defined_cases(spark):
    out = line_dedup.dedup_lines(docs(spark, []))
    assert out.count() == 0 and out.columns == [*DOCS.replace(",", "").split()[::2], "n_lines", "n_removed"]
    line = words(random.Random(1), 60)
    rows = line_dedup.dedup_lines(docs(spark, [(2, line + "\nb"), (2, line + "\nb"), (1, "a\n" + line), (3, f"x\n{line}\n\ny")])).collect()
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in rows)
    assert got == [(1, "a\n" + line, 2, 0), (2, "b", 2, 1), (2, "b", 2, 1), (3, "x\n\ny", 4, 1)]
    with pytest.raises(ValueError):
        line_dedup.repeated_lines(docs(spark, []), 0)


def test_first_copy_stays_where_copies_overlap(spark):
    line = words(random.Random(1), 10)
    texts = ["\n".join([line] * 30), "\n".join([line, line + " b"] * 20), "\n".join(f"{line} {k % 3} {j}" for j in range(2) for k in range(30))]
    got = [r.text.split("\n") for r in line_dedup.dedup_lines(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got[0] == [line] * 5
    assert 5 <= len(got[1]) <= 6 and set(got[1]) == {line, line + " b"}
    assert set(got[2]) == set(texts[2].split("\n")) and 10 <= len(got[2]) <= 16


def test_maximal_runs(spark):
    passage = [words(random.Random(k), 20) for k in range(8)]
    texts = ["\n".join(["a", *passage, "b"]), "\n".join(["c", "", *passage[:3], "", *passage[3:], "d", *passage[:2]])]
    got = sorted((r._doc, r.top, r.bottom, r.first_doc, r.first_top) for r in line_dedup.maximal_runs(docs(spark, texts)).collect())
    assert got == [(1, 2, 10, 0, 1)]


def test_lines_keep_columns_of_any_name(spark):
    names = ["doc_id", "text", "gone", "_doc", "_hash", "_lines", "_row", "_text", "line", "a.b", "times"]
    line = words(random.Random(1), 60)
    rows = [(k, f"{k}\n{line}", *[f"{n}{k}" for n in names[2:]]) for k in range(3)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, names))
    assert out.columns == [*names, "n_lines", "n_removed"]
    assert sorted(map(tuple, out.collect())) == [(k, f"0\n{line}" if not k else str(k), *rows[k][2:], 2, int(k > 0)) for k in range(3)]


def test_lines_run_no_python(spark):
    plan = line_dedup.dedup_lines(docs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# benchmark passages


def brute_hits(text, items, window=13):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    hit, ids = set(), set()
    for item, t in items:
        v = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
        m = min(window, len(v))
        windows = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if v else set()
        for i in range(len(w) - m + 1):
            if m and tuple(w[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                ids.add(item)
    sha = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
    return len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_contamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 200)
    r = random.Random(3)
    items = [(k, words(r, r.choice([0, 1, 2, 5, 13, 14, 30]), 300)) for k in range(25)] + [(99, None), (98, "..."), (10, "W1 W2"), (11, "w7")]
    texts = [None, "", "...", "w7", "W7!"]
    for _ in range(60):
        part = r.choice(items)[1] or ""
        texts.append(" ".join([words(r, r.randrange(40), 300), part.upper(), words(r, r.randrange(200), 300)]))
    texts.append(" ".join(texts[7:30]) * 20)
    bench = spark.createDataFrame([(k, t, "x") for k, t in items] + [(None, "w1 w2 w3", "x")], "item_id long, text string, n_words string")
    got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontaminate.contamination(docs(spark, texts), bench).collect()}
    want = {k: brute_hits(t, items) for k, t in enumerate(texts)}
    assert got == want
    clean = decontaminate.decontaminate(docs(spark, texts), bench)
    assert {x.doc_id for x in clean.collect()} == {k for k, v in want.items() if not v[4]} and clean.columns == docs(spark, []).columns


def test_longest_match_and_empty_tables(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    bench = spark.createDataFrame([(5, "start " + passage)], "item_id long, text string")
    r = decontaminate.contamination(docs(spark, ["a b c " + " ".join(passage.split()[3:33]) + " z"]), bench).first()
    assert (r.longest_match, r.longest_item, r.longest_start, r.longest_item_start) == (30, 5, 3, 4)
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0
    r = decontaminate.contamination(docs(spark, ["a"]), bench.where("false")).first()
    assert (r.n_words, r.n_hit, r.contaminated, r.longest_match, r.matches) == (1, 0, False, 0, [])
    with pytest.raises(ValueError):
        decontaminate.TestIndex([], 0)


def split_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))


def brute_matching(text, items):
    """From each place the words of the longest match with any item."""
    w, out = split_words(text), []
    for i in range(len(w)):
        best = 0
        for _, t in items:
            v = split_words(t)
            for j in range(len(v)):
                n = 0
                while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                    n += 1
                best = max(best, n)
        out.append(best)
    return out


@pytest.mark.parametrize(("block", "piece"), [(1 << 24, 1 << 14), (200, 1 << 14), (200, 20)])
def test_matches_equal_brute_force(spark, monkeypatch, block, piece):
    """Of every benchmark suffix the longest matches, however short or long, and where they are."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    r = random.Random(9)
    items = [(k, words(r, n, 12)) for k, n in enumerate([1, 2, 5, 12, 13, 25, 60, 60, 150])]
    items += [(20, items[8][1]), (21, "w1 w2 " + items[7][1])]
    texts = [None, "", "w1", "w1 w2", items[8][1], f"zz {items[8][1]} {items[6][1]} zz", " ".join(items[7][1].split()[3:15])]
    texts += [" ".join([words(r, 20, 12), "zz", *r.choice(items)[1].split()[r.randrange(3) :], words(r, 9, 400)]) for _ in range(20)]
    bench = spark.createDataFrame([(k, t) for k, t in items], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", piece)
    by_item = dict(items)
    for row in decontaminate.contamination(docs(spark, texts), bench).collect():
        text = texts[row.doc_id]
        best, w = brute_matching(text, items), split_words(text)
        for m in row.matches:
            assert w[m.start : m.start + m.words] == split_words(by_item[m.item_id])[m.item_start : m.item_start + m.words]
        reach = [0] * len(w)
        for m in row.matches:
            for i in range(m.start, m.start + m.words):
                reach[i] = max(reach[i], m.start + m.words - i)
        if block > 1000:  # blocks tell their own longest matches, all of them
            assert all(a == n if n >= 3 else a <= n for a, n in zip(reach, best, strict=True))
            assert len(row.matches) <= sum(n >= 3 for n in best)
        assert row.longest_match == max([n for n in best if n >= 3], default=0) or piece == 20
        hits = brute_hits(text, items)
        assert (row.n_words, row.n_hit, row.n_items, row.items_sha256, row.contaminated) == hits


def test_twelve_words_are_a_match_but_no_hit(spark):
    bench = spark.createDataFrame([(7, " ".join(f"p{i}" for i in range(30)))], "item_id long, text string")
    r = decontaminate.contamination(docs(spark, ["x " + " ".join(f"P{i}," for i in range(5, 17)) + " y"]), bench).first()
    assert (r.n_hit, r.longest_match, r.longest_item, r.longest_start, r.longest_item_start) == (0, 12, 7, 1, 5)


def test_a_prompt_that_all_items_share(spark):
    prompt = " ".join(f"q{i}" for i in range(15))
    bench = spark.createDataFrame([(k, f"{prompt} item{k} of many") for k in range(3000)], "item_id long, text string")
    d = docs(spark, [f"{prompt} {k}" for k in range(300)])
    decontaminate.contamination(d, bench).count()
    began = time.time()
    got = decontaminate.contamination(d, bench).select("n_items", "n_hit", "n_words").distinct().collect()
    assert time.time() - began < 15 and [tuple(x) for x in got] == [(3000, 15, 16)]


def test_many_distinct_benchmark_words():
    r = random.Random(2)
    index = decontaminate.TestIndex([(k, 0, 1000, " ".join(f"{r.getrandbits(64):x}" for _ in range(1000)).encode()) for k in range(2500)])
    assert len(index.vocab) > 2_400_000 and len(index.window_at) == 2500 * 988


def test_decontamination_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "_n", "_spans", "_items", "_longest", "state", "matches", "item_id", "a.b"]
    rows = [(k, f"x {k}", *[f"{n}{k}" for n in names[2:]]) for k in (0, 1, 1)]
    bench = spark.createDataFrame([(1, "x 0")], "item_id long, text string")
    out = decontaminate.decontaminate(spark.createDataFrame(rows, names), bench)
    assert out.columns == names and sorted(map(tuple, out.collect())) == rows[1:]


# tokens


def brute_tokens(word, pieces):
    s = tokens.SPACE + word
    unknown = min(pieces.values()) - tokens.PENALTY
    best = [(0.0, 0)]
    for i in range(1, len(s) + 1):
        options = [(best[j][0] + pieces[s[j:i]], best[j][1] - 1) for j in range(i) if s[j:i] in pieces]
        if s[i - 1] not in pieces:
            options.append((best[i - 1][0] + unknown, best[i - 1][1] - len(s[i - 1].encode())))
        best.append(max(options))
    return -best[-1][1]


def test_tokens_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tokens, "NODES", 50)
    r = random.Random(5)
    pieces = {tokens.SPACE: -9.0, "a": -5.0, "b": -6.0, "ab": -6.5, "ba": -7.0, tokens.SPACE + "a": -7.0, "aba": -8.0, "é": -9.0}
    texts = [" ".join("".join(r.choice("abé日") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(30))) for _ in range(40)]
    texts += [None, "", " \n\t", "ab\tab\nab", "ab" * 2000, "ab ab"]
    got = {x.doc_id: (x.n_words, x.n_tokens) for x in tokens.count_tokens(docs(spark, texts), pieces=pieces).collect()}
    split = [[x for x in re.split("[\x20\x09-\x0d]+", t or "") if x] for t in texts]
    assert got == {k: (len(w), sum(brute_tokens(x, pieces) for x in w)) for k, w in enumerate(split)}
    assert tokens.count_tokens(docs(spark, []), pieces=pieces).count() == 0


def test_real_vocabulary(spark):
    """Every word against a plain dynamic program, and totals near those of the vocabulary's own tokenizer."""
    sentencepiece = pytest.importorskip("sentencepiece")
    pieces = tokens.load_pieces()
    assert abs(sum(math.exp(s) for s in pieces.values()) - 1) < 1e-9
    counter = tokens.Counter(pieces)
    for word in ["the", "international", "responsibility", "government", "and"]:
        assert counter.count(word.encode()) == 1
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    longest = max(map(len, pieces))
    own = sentencepiece.SentencePieceProcessor(model_file=tokens.VOCABULARY)
    distinct = sorted({w for t in texts.values() for w in re.split("[\x20\x09-\x0d]+", t) if w})
    best = {}
    for word in distinct[:: max(1, len(distinct) // 1500)] + ["日本語", "é\u0301", "7", "x" * 300]:
        s, table = tokens.SPACE + word, [(0.0, 0)]
        for i in range(1, len(s) + 1):
            options = [(table[j][0] + pieces[s[j:i]], table[j][1] - 1) for j in range(max(0, i - longest), i) if s[j:i] in pieces]
            if s[i - 1] not in pieces:
                options.append((table[i - 1][0] + min(pieces.values()) - tokens.PENALTY, table[i - 1][1] - len(s[i - 1].encode())))
            table.append(max(options))
        best[word] = -table[-1][1]
    assert {w: counter.count(w.encode()) for w in best} == best
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(d).collect()}
    total = sum(len(own.encode(t)) for t in texts.values())
    assert abs(sum(got.values()) / total - 1) < 0.1


def test_tokens_of_repeated_rows_and_other_columns(spark):
    rows = spark.createDataFrame([(1, "a b", 9, "x"), (1, "a b", 9, "x"), (None, "a", None, None)], "doc_id long, text string, n_tokens long, n_words string")
    got = sorted(map(tuple, tokens.count_tokens(rows).collect()), key=repr)
    assert got == [(1, 2, 2), (1, 2, 2), (None, 1, 1)]
