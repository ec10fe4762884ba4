"""Near duplicates against brute force: components, n-gram join, embeddings, lines."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestq.llm import embeddings, jaccard, lines
from nestq.llm.common import HASHED, LONG_WORD, components, cut, word_hashes


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(df).df.collect()}
    nodes = {n for link in links if link[0] != link[1] for n in link}
    assert found == roots(nodes, links)
    assert components(df.limit(0)).df.count() == 0


def test_tables_give_back_memory(spark):
    """What the driver's JVM has freed outside its heap goes back to the machine when a table is written, for queries of many tables."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    resident = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/statm"

    def mb():
        jvm.System.gc()
        with open(resident) as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    data, out = (gateway.new_array(jvm.byte, 100_000) for _ in range(2))
    before, held = mb(), [jvm.java.util.zip.Deflater() for _ in range(1000)]
    for x in held:
        x.setInput(data)
        x.deflate(out)
    for i, x in enumerate(held):
        if i % 50:  # the others stand between what is freed and the end of the memory
            x.end()
    freed = mb()
    assert freed - before > 200
    cut(spark.range(1))
    assert mb() < freed - 100


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    common = " ".join(rng.choice(vocabulary) for _ in range(40))
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.6:
            w = rng.choice(docs).split()
            for _ in range(rng.randint(0, 5)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
            docs.append(" ".join(w) or "x")
        else:
            own = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90)))
            docs.append(own + " " + common if rng.random() < 0.4 else own)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_is_exact(spark, seed):
    docs = dict(enumerate(corpus(seed)))
    docs |= {900: None, 901: "", 902: " \t", 903: "one two", 904: "ONE  two", 905: docs[3], 906: "long " * 3000}
    sets = {d: shingle_set(t) for d, t in docs.items()}
    links = [(a, b) for a, b in itertools.combinations(docs, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(links) > 20
    want = roots(docs, links)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs.items()] + [(None, docs[3], 1), (5, docs[5], 1)], "doc_id long, text string, n_shingles int").repartition(4)
    got = jaccard.similar_documents(df, n_cells=1 << 10).collect()  # a crowded sketch
    assert len(got) == len(docs) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]]), r


def test_jaccard_hot_group(spark):
    """A group of near copies whose tokens are dealt to several salts is one component."""
    base = [f"b{i}" for i in range(60)]
    docs = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.similar_documents(df, hot=8).collect()} == {0}
    assert jaccard.similar_documents(df.limit(0)).collect() == []


def test_word_hashes():
    """A word has one hash wherever it stands, across the pieces in which a text is hashed; different words have different ones."""
    rng = random.Random(3)
    words = ["a", "aa", "ab", "ba", "aaa", "\u00e9t\u00e9", "\ud800", "x" * LONG_WORD, "x" * (LONG_WORD + 1), "y" * LONG_WORD, "z" * (HASHED + 9), *(f"w{i}" for i in range(3000))]
    known = {}
    for fill in (0, 1, HASHED - 3, HASHED - LONG_WORD, HASHED, 2 * HASHED - 1):
        text = "f" * fill + rng.choice([" ", "\t\n "]) + " ".join(rng.choice([w, w.upper()]) if w.isascii() else w for w in rng.choices(words, k=9000)) + rng.choice(["", " \r"])
        split = text.encode("utf-8", "surrogatepass").lower().split()
        found = word_hashes(text.encode("utf-8", "surrogatepass")).tolist()
        assert len(found) == len(split)
        assert all(known.setdefault(w, h) == h for w, h in zip(split, found, strict=True))
    assert len(set(known.values())) == len(known)
    assert len(word_hashes(b"")) == len(word_hashes(b" \x0b\n")) == 0


def test_jaccard_shuffles_and_jobs(spark):
    """Postings go through the shuffle as four numbers, and a bitmap is fetched in one job whatever the number of partitions."""
    names = spark._jvm.scala.jdk.javaapi.CollectionConverters
    store = spark.sparkContext._jsc.sc().statusStore()
    sql = spark._jsparkSession.sharedState().statusStore()
    seen = sql.executionsCount()
    df = spark.createDataFrame([(i, " ".join(f"w{i % 7}x{k}" for k in range(30))) for i in range(40)], "doc_id long, text string")
    assert len(jaccard.similar_documents(df, n_cells=1 << 10).collect()) == 40
    plans = [e.physicalPlanDescription() for e in names.asJava(sql.executionsList()) if e.executionId() >= seen]
    windows = [p for p in plans if "Window" in p]
    assert windows and not any("_w0" in line for p in windows for line in p.splitlines() if "Exchange" in line or "Input" in line)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        before = len(list(names.asJava(store.jobsList(None))))
        bits = jaccard._filter_of(spark.range(100).toDF("rep").repartition(30), 1 << 16)
        jobs = len(list(names.asJava(store.jobsList(None)))) - before
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 90 <= sum(int(x).bit_count() for x in bits.view(np.uint64)) <= 100
    assert jobs <= 3


def test_prefixes_meet():
    """Any two similar sets share as many tokens of their prefixes as the smaller l asks for."""
    rng = random.Random(5)
    sketch = np.array([rng.choice([1, 1, 1, 50, 3000]) for _ in range(jaccard.CELLS)], np.uint32)
    for _ in range(200):
        pool = np.array([rng.getrandbits(63) for _ in range(rng.randint(8, 60))], np.uint64)
        keep = [np.unique(pool[np.array([rng.random() < 0.93 for _ in pool])]) for _ in range(2)]
        a, b = keep
        both = len(np.intersect1d(a, b))
        if not len(a) or not len(b) or both * 100 < 75 * (len(a) + len(b) - both):
            continue
        (x, lx, _), (y, ly, _) = jaccard.prefix(a, sketch), jaccard.prefix(b, sketch)
        low = min(lx, ly)
        nx, ny = (len(s) - jaccard.least_overlap(len(s)) + low for s in (a, b))
        assert len(np.intersect1d(x[:nx], y[:ny])) >= low


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 32))
    x = np.concatenate([c + rng.standard_normal((25, 32)) * s for c, s in zip(centres, np.linspace(0.02, 0.35, 12), strict=True)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[3].tolist()) for i in range(30)]
    odd = [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] * 32), (2003, [1.0, None]), (2004, []), (2005, [1.0, 2.0]), (2006, [2.0, 4.0]), (None, x[3].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(4)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, miss=1e-4).collect()}
    all_x = np.array([v for _, v in rows], np.float64)
    unit = all_x / np.linalg.norm(all_x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    ids = [i for i, _ in rows]
    links = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True) if i < j]
    want = dict(zip(ids, near.sum(1) - 1, strict=True))
    found, total = sum(got[i]["n_links"] for i in ids), sum(want.values())
    assert total > 1000 and all(got[i]["n_links"] <= want[i] for i in ids) and found >= 0.99 * total
    truth = roots(ids, links)
    assert np.mean([got[i]["component_id"] == truth[i] for i in ids]) > 0.98
    for i in (2000, 2001, 2002, 2003, 2004):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[2005]["component_id"] == got[2006]["component_id"] == 2005 and got[None]["n_links"] == 0
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_block_pairs_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    rng = np.random.default_rng(3)
    x = (np.ones(16) + rng.standard_normal((60, 16)) * 0.01).tolist()
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    assert {(r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()} == {(59, 0)}


def test_edit_distance(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        pairs.append((a, "".join(b)))
    pairs += [("x" * 50 + a + "y" * 60, "x" * 50 + b + "y" * 60) for a, b in pairs[:80]] + [("é" * 9 + "a", "é" * 9 + "b")]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    p = lines._common_prefix(a, b)
    for r in df.select("a", "b", lines.within_edits(a, b).alias("w"), lines.within_edits(a, b, 2, p).alias("v"), lines.still_possible(a, b, p).alias("s")).collect():
        near = edits(r["a"], r["b"]) <= 2
        assert (r["w"], r["v"]) == (near, near) and (r["s"] or not near), r
    cut = lines._unlike(df.select(F.col("a").alias("of"), F.col("b").alias("to"), "a", "b"), "a", "b")
    for r in cut.withColumns({"w": lines.within_edits(a, b), "s": lines.still_possible(a, b, F.lit(0))}).collect():
        near = edits(r["of"], r["to"]) <= 2
        assert (r["w"] and r["s"]) == near and len(r["a"]) <= len(r["of"]) and edits(r["a"], r["b"]) == edits(r["of"], r["to"]), r


def test_common_beginnings_and_ends_of_long_lines(spark):
    """Near lines of any length are verified over what lies between their edits only."""
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefgh é", k=70_000))
    cases = [(long, long[:k] + "z" + long[k + 1 :], 1, 1) for k in (0, 4094, 4095, 4096, 69_999)]
    cases += [(long, long[:9000] + "zz" + long[9000:], 0, 2), (long, long, 0, 0), (long[:4096], long, 0, 70_000 - 4096), ("", long, 0, 70_000)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(cases)], "i int, a string, b string")
    cut = lines._unlike(df, "a", "b").withColumn("w", lines.within_edits(F.col("a"), F.col("b")))
    for r in cut.collect():
        _, _, x, y = cases[r["i"]]
        assert (len(r["a"]), len(r["b"]), r["w"]) == (x, y, y <= 2), r["i"]


def line_oracle(docs):
    places = [((d, i), line) for d, t in docs.items() if d is not None and t is not None for i, line in enumerate(t.split("\n")) if len(line) >= lines.MIN_CHARS]
    by = {p: k for k, (p, _) in enumerate(sorted(places))}
    ordered = [line for _, line in sorted(places)]
    links = [(i, j) for i, j in itertools.combinations(range(len(ordered)), 2) if abs(len(ordered[i]) - len(ordered[j])) <= 2 and edits(ordered[i], ordered[j]) <= 2]
    root = roots(range(len(ordered)), links)
    gone = {p for p, k in by.items() if root[k] != k}
    return {d: ",".join(str(i) for i in range(len(t.split("\n"))) if (d, i) in gone) if t is not None else "" for d, t in docs.items()}


def test_lines(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(28, 60))) for _ in range(25)]
    docs = {}
    for d in range(30):
        chosen = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                k = rng.randrange(len(line))
                line[k : k + rng.randint(0, 1)] = rng.choice(["", "z", "é"])
            chosen.append("".join(line))
        docs[d] = "\n".join(chosen)
    docs |= {50: None, 51: "", 52: "short\nshort", 53: "\n" + base[0] + "\n\n", 54: base[1] + "\n" + base[1]}
    df = spark.createDataFrame([(d, t, d, "q") for d, t in docs.items()], "doc_id long, text string, n_chars long, dropped string").repartition(3)
    want = line_oracle(docs)
    assert sum(bool(v) for v in want.values()) > 15
    assert {r["doc_id"]: r["dropped"] for r in lines.line_report(df).collect()} == want
    cleaned = {r["doc_id"]: r for r in lines.dedup_lines(df).collect()}
    for d, t in docs.items():
        gone = {int(i) for i in want[d].split(",")} if want[d] else set()
        assert cleaned[d]["text"] == (t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
        assert cleaned[d]["dropped"] == "q"
    assert lines.line_report(df.limit(0)).count() == 0


def test_lines_of_repeated_and_unnamed_rows(spark):
    line = "the same line of quite enough characters"
    df = spark.createDataFrame([(1, line), (1, line), (None, line), (2, line)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in lines.dedup_lines(df).collect()) == [(0, line), (1, line), (1, line), (2, "")]


def test_short_lines(spark):
    """Short lines go too: equal ones from MIN_CHARS characters on, and near ones by as many edits as their length allows."""
    rng = random.Random(6)
    allowed = lambda n: 0 if n < lines.ONE_EDIT else 1 if n < lines.ALL_EDITS else 2
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in range(6, 33) for _ in range(2)] + ["All rights reserved.", "Licensed under CC BY-NC 4.0."]
    docs = {}
    for d in range(60):
        chosen = []
        for _ in range(4):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                k = rng.randrange(len(line))
                line[k : k + rng.randint(0, 1)] = rng.choice(["", "z", "é"])
            chosen.append("".join(line))
        docs[d] = "\n".join(chosen)
    docs |= {70: "All rights reserved.\nx", 71: "All rights reserved", 72: "y\nAll rights reserved.", 73: " " * 40, 74: " " * 40, 75: "a line of 29 characters, one,", 76: "a line of 29 characters, one,!"}
    places = sorted(((d, i), x) for d, t in docs.items() for i, x in enumerate(t.split("\n")) if len(x) >= lines.MIN_CHARS and x.strip())
    near = [(p, q) for (p, x), (q, y) in itertools.combinations(places, 2) if edits(x, y) <= allowed(min(len(x), len(y)))]
    root = roots([p for p, _ in places], near)
    want = {d: ",".join(str(i) for i in range(t.count("\n") + 1) if root.get((d, i), (d, i)) != (d, i)) for d, t in docs.items()}
    assert want[72] == "1" and want[71] == want[76] == "0" and want[74] == ""
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["dropped"] for r in lines.line_report(df).collect()} == want
