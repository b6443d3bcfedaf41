"""SimHash, suffix merging, pivot index, components, and the whole pipeline."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from codelattice.llm import components, pivot_index, simhash_vptree, suffix_merge
from helpers import odd_rows, prose, table, words


def roots(n, links):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return [find(a) for a in range(n)]


# ---------------------------------------------------------------- components

def test_components(spark):
    random.seed(1)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    want = roots(600, links)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: want[i] for i in got} and {i for i in range(600) if want[i] != i} <= set(got)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- SimHash

def simhash(text):
    ws = words(text, True)
    shingles = [b" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] if len(ws) >= 4 else [b" ".join(ws)] if ws else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_copies():
    rows, base = [], prose(60, size=300)
    random.seed(3)
    for i, text in enumerate(base):
        rows.append((10 * i, text))
        for j in range(random.choice([0, 0, 1, 4])):
            w = text.split()
            w[random.randrange(len(w))] = "changed"
            rows.append((10 * i + j + 1, " ".join(w) if j != 2 else text))
    return rows


def test_fingerprints_and_groups(spark):
    rows = [*near_copies(), *[(1000 + (k or 0), t) for k, t in odd_rows()]]
    docs = table(spark, rows)
    got = simhash_vptree.near_duplicates(docs, sample=64).select("doc_id", simhash_vptree.hex_of("fp").alias("fp"), "component_id").collect()
    prints = [simhash(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4 or rows[i][0] == rows[j][0]]
    root = roots(len(rows), links)
    smallest = {}
    for i, (k, _) in enumerate(rows):
        smallest[root[i]] = min(smallest.get(root[i], k), k)
    want = sorted((k, format(prints[i], "016x"), smallest[root[i]]) for i, (k, _) in enumerate(rows))
    assert sorted(map(tuple, got)) == want
    kept = simhash_vptree.keep_one(docs.withColumn("kept_key", docs["doc_id"]).withColumn("key", docs["text"]).withColumn("first", docs["text"]))
    assert kept.columns == [*docs.columns, "kept_key", "key", "first"]
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None) == kept_rows(rows)


def kept_rows(rows):
    """Smallest (key, digest) of each group of texts; rows that share a key and differ in text are apart."""
    rows = [r for r in rows if r[0] is not None]
    prints = [simhash(t) for _, t in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4])
    digest = lambda t: "" if t is None else hashlib.md5(t.encode()).hexdigest()
    least = {}
    for i, (k, t) in enumerate(rows):
        least[root[i]] = min(least.get(root[i], (k, digest(t), t)), (k, digest(t), t), key=lambda x: x[:2])
    return sorted((k, t) for k, _, t in least.values())


def test_rows_of_one_key_stay_apart(spark):
    a, b = prose(2, seed=21, size=200)
    docs = table(spark, [(1, a), (1, b), (1, b), (2, b), (None, a), (3, None), (3, "")])
    got = sorted((str(r["doc_id"]), r["text"]) for r in simhash_vptree.keep_one(docs).collect())
    assert got == sorted([("1", a), ("1", b), ("None", a), ("3", None)], key=lambda x: (x[0], x[1] or ""))
    assert simhash_vptree.keep_one(table(spark, [])).count() == 0


def test_null_key_and_empty(spark):
    got = simhash_vptree.near_duplicates(table(spark, [(None, "a b c d e"), (4, "a b c d e"), (None, "quite another text here")])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("4", "4"), ("None", "4"), ("None", "None")]
    assert simhash_vptree.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("dense", [False, True])
def test_trees_lose_no_pair(dense, monkeypatch):
    """Shards of all four trees together give the components of a brute-force comparison."""
    monkeypatch.setattr(simhash_vptree, "PAIRS", 300)
    draw = np.random.default_rng(5)
    x = draw.integers(0, 2**64, 1500, dtype=np.uint64)
    if dense:
        x[:900] = x[0]
    for i in range(1, 900 if dense else 300):
        flips = draw.choice(64, draw.integers(0, 7), replace=False)
        x[i] = x[draw.integers(0, i)] ^ np.uint64(sum(1 << int(b) for b in flips))
    x = np.unique(x)
    near = [(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= 4).tolist()]
    found = []
    for block in range(4):
        tree = simhash_vptree.grow(x[:400], block, 12)[0]
        row, leaf, home = simhash_vptree.route(tree, x)
        assert np.bincount(row[home], minlength=len(x)).tolist() == [1] * len(x)
        for one in np.unique(leaf):
            own = leaf == one
            labels = simhash_vptree.link_shard(x[row[own]], home[own], block)
            found += [(int(row[own][i]), int(row[own][labels[i]])) for i in range(len(labels)) if labels[i] != i]
    assert roots(len(x), found) == roots(len(x), near)


# ---------------------------------------------------------------- suffix merging

def test_loser_tree_merges():
    random.seed(2)
    for k in (1, 2, 3, 5, 8):
        runs = [sorted("".join(random.choice("ab") for _ in range(random.randint(0, 12))).encode() for _ in range(random.randint(0 if k > 1 else 1, 40))) for _ in range(k)]
        coded = [suffix_merge.front_code(r) for r in runs]
        assert [suffix_merge.front_decode(p, np.array([len(s) for s in r]), rest) for r, (p, rest) in zip(runs, coded, strict=True)] == runs
        run, place, prefix = suffix_merge.merge_runs(runs, [p.tolist() for p, _ in coded])
        merged = [runs[r][p] for r, p in zip(run, place, strict=True)]
        assert merged == sorted(s for r in runs for s in r)
        assert prefix == [suffix_merge.shared_prefix(a, b) for a, b in zip([b"", *merged], merged, strict=False)]


def repeated_rows(length):
    random.seed(6)
    passage = prose(3, seed=9, size=length)
    rows = []
    for i, text in enumerate(prose(60, size=length // 2)):
        at = random.randrange(len(text))
        cut = random.randrange(len(passage[i % 3]))
        rows.append((i, text[:at] + (passage[i % 3][cut:] if i % 4 else passage[i % 3]) + text[at:] if i % 2 else text))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "abc" * 400), (103, "x" * 700), (104, "x" * 650 + "y"), (105, "é" * 300), (106, "zé" * 300), (107, "a\x00" * 300), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize(("length", "hot"), [(400, 50_000), (90, 50_000), (90, 3)])
def test_removed_bytes_equal_brute_force(spark, length, hot):
    rows = [*repeated_rows(length), *odd_rows()]
    got = suffix_merge.deduplicate(table(spark, rows), length=length, hot_group=hot).collect()
    texts = [(t or "").encode() for _, t in rows]
    want = []
    for (k, _), raw, spans in zip(rows, texts, suffix_merge.brute_force(texts, length), strict=True):
        covered = {p for a, b in spans for p in range(a, b)}
        kept = bytes(c for p, c in enumerate(raw) if p not in covered)
        want.append((str(k), len(raw), len(covered), len(spans), hashlib.sha256(kept).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got) == sorted(want)
    assert all(sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_whole_characters_and_columns(spark):
    docs = table(spark, [(1, "aé" * 400), (2, "éa" * 400), (3, None), (4, "kept")]).selectExpr("*", "7L as n_chars")
    out = suffix_merge.remove_repeats(docs)
    assert out.columns == docs.columns
    assert all("�" not in r["text"] and r["n_chars"] == len(r["text"]) for r in out.collect())
    assert suffix_merge.deduplicate(table(spark, [])).count() == 0


def test_stage_cuts_passages_of_51_words(spark):
    random.seed(12)
    fresh = lambda n: " ".join(f"{random.getrandbits(20):x}" for _ in range(n))
    passage, short, one_letter = fresh(51), fresh(50), " ".join(random.choice("abcdefgh") for _ in range(51))
    left, right = fresh(30), fresh(30)
    assert 250 < len(passage) < 400 and len(one_letter) == 101
    parts = {1: passage, 2: passage + ".", 3: short, 4: short, 5: one_letter, 6: one_letter, 7: left + " " + right, 8: left, 9: right}
    around = {k: (fresh(40), fresh(40)) for k in parts}
    docs = table(spark, [(k, f"{a} {parts[k]} {b}") for k, (a, b) in around.items()]).selectExpr("*", "7L as n_chars")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    for k, (a, b) in around.items():
        cut = k in (1, 2, 5, 6)
        assert got[k].startswith(a) and got[k].endswith(b) and (parts[k] in got[k]) != cut, k
        assert not cut or len(got[k]) <= len(a) + len(b) + 3


# ---------------------------------------------------------------- pivot index

def vectors():
    draw = np.random.default_rng(8)
    x = draw.normal(size=(400, 16))
    for i in range(100, 250):
        x[i] = x[draw.integers(0, 60)] + 0.12 * draw.normal(size=16)
    x[300:330] = x[5]
    x[330:395] = x[6] + 0.05 * draw.normal(size=(65, 16))
    return x.astype(np.float32)


@pytest.mark.parametrize("tile", [2048, 10])
def test_links_against_brute_force(spark, tile):
    x = vectors().astype(np.float64)
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]
    bad = [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [float("nan")] * 16, "x"), (903, [None, *[1.0] * 15], "x"), (904, [1.0], "x"), (None, rows[0][1], "x"), (905, [float("inf"), *[1.0] * 15], "x"), (906, [], "x")]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>, component string").repartition(3)
    got = {r["vec_id"]: r for r in pivot_index.near_duplicates(df, tile=tile).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    links = near.sum(1) - 1
    assert all(got[i]["n_links"] <= links[i] for i in range(len(x)))
    assert sum(got[i]["n_links"] for i in range(len(x))) >= 0.97 * links.sum() > 0
    for k in (900, 901, 902, 903, 904, 905, 906):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, False)
    want = roots(len(x), [(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True) if i > j])
    assert np.mean([got[i]["component_id"] == want[i] for i in range(len(x))]) > 0.97
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(x)))


def test_blocks_change_nothing(spark):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(vectors())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    one, many = (sorted(map(tuple, pivot_index.near_duplicates(df, tile=t).collect())) for t in (2048, 7))
    assert one == many
    assert pivot_index.near_duplicates(df.limit(0)).count() == 0
    assert sorted(tuple(r)[1] for r in pivot_index.near_duplicates(df.limit(2)).collect()) == [0, 0]


# ---------------------------------------------------------------- pipeline

def cut_passages(texts, least):
    """Texts without the runs of bytes of which each window of the shortest passage occurs again, if a run has the words or 400 bytes."""
    size, raws, counts = 2 * least - 1, [t.encode() for t in texts], {}
    for raw in raws:
        for at in range(len(raw) - size + 1):
            counts[raw[at : at + size]] = counts.get(raw[at : at + size], 0) + 1
    letter = lambda c: c >= 128 or chr(c).isalnum()
    out = []
    for raw in raws:
        again = [counts[raw[at : at + size]] > 1 for at in range(len(raw) - size + 1)]
        gone, at = bytearray(len(raw)), 0
        while at < len(again):
            if not again[at]:
                at += 1
                continue
            stop = at
            while stop < len(again) and again[stop]:
                stop += 1
            a, b, at = at, stop - 1 + size, stop
            broken = sum(0 < x < len(raw) and letter(raw[x - 1]) and letter(raw[x]) for x in (a, b))
            if b - a >= 400 or len(raw[a:b].split()) - broken >= least:
                gone[a:b] = b"x" * (b - a)
        kept, place = [], 0
        for char in raw.decode():
            width = len(char.encode())
            if not all(gone[place : place + width]):
                kept.append(char)
            place += width
        out.append("".join(kept))
    return out


def test_pipeline_stages(spark, tmp_path, sf_dir):
    """Every stage acts on all rows its predecessor kept, and its decisions take effect."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(p.STAGES) - 1:
            assert out.columns == columns
        kept.append((docs, out))
        docs = out
    prints = [(r["doc_id"], simhash(r["text"])) for r in kept[2][0].collect()]
    links = [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i][1] ^ prints[j][1]).count("1") <= 4]
    assert kept[2][1].count() == len(set(roots(len(prints), links)))
    before = {r["doc_id"]: r["text"] for r in kept[3][0].collect()}
    want = dict(zip(before, cut_passages(list(before.values()), p.PASSAGE_WORDS), strict=True))
    after = {r["doc_id"]: r["text"] for r in kept[3][1].collect()}
    assert after == want and after != before
    assert kept[4][1].select("doc_id").distinct().count() == kept[3][1].count()
    assert sorted(map(tuple, p.run(spark, sf_dir).select("doc_id", "doc_tokens").distinct().collect())) == sorted(map(tuple, docs.select("doc_id", "doc_tokens").distinct().collect()))


def test_registered_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
