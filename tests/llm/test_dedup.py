"""SimHash classes and repeated spans against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import base, components, gray, similar, simhash, substring

from .cases import frame, texts


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(prints, most=4):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", ["", " ", "a", "A b", "a b c d", "a b c d e", "É é ÀB \x0bc", "w " * 300, "x y z " * 30_000])
def test_fingerprint(text):
    assert int.from_bytes(simhash.fingerprint(text.encode()), "big") == slow_fingerprint(text)


def near_prints(rng, n, groups, flips):
    base = rng.integers(0, 1 << 63, size=groups, dtype=np.uint64)
    fp = base[rng.integers(0, groups, n)]
    for _ in range(flips):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    fp = np.unique(fp)
    return fp[np.argsort(gray.gray_rank(fp))]


def slow_links(fp, most=4):
    return {(int(a), int(b)) for i, a in enumerate(fp) for b in fp[:i] if (int(a) ^ int(b)).bit_count() <= most}


@pytest.mark.parametrize("seed", range(8))
def test_two_orders_find_every_link(seed):
    """The members of one part, asked by all of them and by queries from elsewhere, in both orders."""
    rng = np.random.default_rng(seed)
    fp = near_prints(rng, int(rng.integers(2, 500)), int(rng.integers(1, 20)), seed % 6)
    away = near_prints(rng, 40, 3, 2) ^ np.uint64(1)
    away = np.setdiff1d(np.r_[away, fp[:30] ^ np.uint64(5)], fp)
    links = []
    for order in range(2):
        part = gray.Part(gray.turned(fp, order), 4, gray.leading_bits(4, order))
        links += [(gray.turned(a, order), gray.turned(b, order)) for a, b in [part.neighbours(), *(part.links(gray.turned(q, order)) for q in (fp[::2], fp[1::2], away))]]
    every = np.r_[fp, away]
    index = {int(x): i for i, x in enumerate(every)}
    pairs = [(index[int(a)], index[int(b)]) for u, v in links for a, b in zip(u, v)]
    inside = slow_classes([int(x) for x in fp])
    got = gray.roots(np.arange(len(every)), *(np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), ()))))
    want = np.arange(len(every))
    joined = [(i, inside[i]) for i in range(len(fp))] + [(j, i) for i, a in enumerate(fp) for j, b in enumerate(every) if j >= len(fp) and (int(a) ^ int(b)).bit_count() <= 4]
    want = gray.roots(want, *(np.array(x, np.int64) for x in zip(*joined)))
    assert got.tolist() == want.tolist()


def test_each_pair_is_near_in_one_order():
    rng = np.random.default_rng(1)
    for _ in range(500):
        flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any((int(gray.turned(np.uint64(flip), o)) >> 32).bit_count() <= gray.leading_bits(4, o) for o in range(2))


def test_upper_masks_are_factored_out():
    fp = near_prints(np.random.default_rng(3), 600, 30, 3)
    tree = gray.Tree(fp, fp)
    for i in range(len(fp)):
        seen = [int(tree.mask[k][i // gray.FAN_OUT**k]) for k in range(len(tree.mask))]
        assert sum(seen) == (1 << 64) - 1 and sum(x.bit_count() for x in seen) == 64  # each bit once
        for k in range(len(tree.mask)):
            assert not (int(tree.pattern[k][i // gray.FAN_OUT**k]) ^ int(fp[i])) & seen[k]


@pytest.mark.parametrize("part_rows,queries", [(1 << 14, 1 << 16), (50, 40), (7, 13)])
def test_links_over_many_parts(spark, monkeypatch, part_rows, queries):
    monkeypatch.setattr(gray, "PART_ROWS", part_rows)
    monkeypatch.setattr(gray, "QUERIES", queries)
    fp = near_prints(np.random.default_rng(part_rows), 400, 25, 4)
    prints = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    links = gray.near_links(prints, 4).collect()
    index = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    pairs = np.array([(index[r["u"]], index[r["v"]]) for r in links], np.int64).reshape(-1, 2)
    assert gray.roots(np.arange(len(fp)), pairs[:, 0], pairs[:, 1]).tolist() == slow_classes([int(x) for x in fp])
    assert len(slow_links(fp)) > 50


def test_classes_match_brute_force(spark):
    rows = texts()
    got = simhash.near_duplicates(frame(spark)).toPandas()
    assert len(got) == len(rows)
    prints = [slow_fingerprint(t) for _, t, _ in rows]
    root = slow_classes(prints)
    least = {}
    for (i, _, _), r in zip(rows, root):
        least[r] = min(x for x in (least.get(r), i) if x is not None) if (i is not None or least.get(r) is not None) else None
    expected = sorted(((i, p, least[r]) for (i, _, _), p, r in zip(rows, prints, root)), key=str)
    none = lambda x: None if x != x or x is None else int(x)
    assert sorted(((none(a), int(b) & (1 << 64) - 1, none(c)) for a, b, c in zip(got["doc_id"], got["fp"], got["component_id"])), key=str) == expected


def test_query_is_brute_force_at_sf001(spark):
    """The registered query, and every link out of the index, on a table of a thousand documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    prints = [slow_fingerprint(r["text"]) for r in docs]
    root = slow_classes(prints)
    least = {}
    for r, k in zip(docs, root):
        least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r["doc_id"]: (f"{p:016x}", least[k]) for r, p, k in zip(docs, prints, root)}


def test_hot_keys_are_salted(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "if(id < 2900, 7L, id) AS fp")
    keyed = rows.groupBy("fp").count().withColumnRenamed("count", "n").selectExpr("fp", "n", "fp + 1 AS of")
    got = base.join_salted(rows, keyed, ["fp"])
    assert got.count() == 3000 and got.where("of <> fp + 1").count() == 0


def test_one_of_each_keeps_columns_and_clean_documents(spark):
    docs = frame(spark)
    kept = similar.one_of_each(docs)
    assert kept.dtypes == docs.dtypes
    ids = [r["doc_id"] for r in kept.collect()]
    assert 62 not in ids and 0 in ids and ids.count(3) == 3 and None in ids


def slow_similar(rows, percent=80):
    """Class of each text by brute force over sets of 5 words."""
    sets = []
    for _, t, _ in rows:
        w = (t or "").lower().encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and parent[i] != parent[j]:
                a, b = parent[i], parent[j]
                parent = [b if p == a else p for p in parent]
    return parent


def near_rows(seed=9):
    """Originals with copies in which single words are changed, so that Jaccard lies on both sides of 0.8."""
    rng = random.Random(seed)
    rows = []
    for _ in range(40):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(40, 400))]
        rows.append(" ".join(words))
        for _ in range(4):
            other = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 30))):
                other[rng.randrange(len(other))] = f"new{rng.randint(0, 10**6)}"
            rows.append(" ".join(other))
    return [(i, t, "en") for i, t in enumerate(rows)]


def test_stage_matches_jaccard(spark):
    rows = near_rows()
    classes = slow_similar(rows)
    kept = {min(i for (i, _, _), c in zip(rows, classes) if c == k) for k in set(classes)}
    assert 40 < len(kept) < 200  # some copies are near, some aren't
    assert {r["doc_id"] for r in similar.one_of_each(frame(spark, rows)).collect()} == kept
    wide = {r["doc_id"] for r in simhash.near_duplicates(frame(spark, rows)).where("doc_id = component_id").collect()}
    assert len(wide) > len(kept)  # op9's four bits don't reach these copies


@pytest.mark.parametrize("ask_bytes", [2000, 1 << 25])
def test_groups_without_a_pivot_are_settled(spark, monkeypatch, ask_bytes):
    """Chains of copies: neighbours are alike, ends aren't, so no pivot reaches all."""
    monkeypatch.setattr(similar, "ASK_BYTES", ask_bytes)
    rng = random.Random(4)
    rows = []
    for c in range(6):
        words = [f"{c}w{rng.randint(0, 3000)}" for _ in range(200)]
        for _ in range(25):
            rows.append((len(rows), " ".join(words), "en"))
            at = rng.randrange(190)
            words = words[:at] + [f"x{rng.random()}", f"y{rng.random()}"] + words[at + 2 :]
    classes = slow_similar(rows)
    got = {r["doc_id"]: r["component_id"] for r in similar.similar(frame(spark, rows)).collect()}
    least = {k: min(i for i, x in enumerate(classes) if x == k) for k in set(classes)}
    assert len(least) < 60
    assert got == {i: least[k] for i, k in enumerate(classes)}


def test_similar_takes_odd_texts(spark):
    rows = texts()
    classes = slow_similar(rows)
    least = {}
    for (i, _, _), c in zip(rows, classes):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    got = similar.similar(frame(spark)).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted(((i, least[c]) for (i, _, _), c in zip(rows, classes)), key=str)


def test_empty_tables(spark):
    assert similar.similar(frame(spark, [])).count() == 0
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert substring.remove_repeats(frame(spark, [])).count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
def test_components(spark, pairs):
    got = components.components(spark.createDataFrame(pairs, "u long, v long"))
    parent = {x: x for p in pairs for x in p}
    for _ in range(len(parent)):
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert {r["node"]: r["root"] for r in got.collect()} == {x: parent[x] for x in linked}


def test_components_by_rounds(spark, monkeypatch):
    """A path, a star around its largest node and a clique, more than one task's worth of them, against the same in one task."""
    draw = random.Random(5)
    path, leaves = draw.sample(range(-900, 900), 300), range(2000, 2200)
    pairs = [*zip(path, path[1:]), *((5000, x) for x in leaves), *itertools.combinations(range(-2000, -1980), 2), (7, 7)] * 2
    draw.shuffle(pairs)
    want = dict.fromkeys(path, min(path)) | dict.fromkeys([*leaves, 5000], 2000) | dict.fromkeys(range(-2000, -1980), -2000)
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(7)
    assert {r["node"]: r["root"] for r in components.components(edges).collect()} == want
    monkeypatch.setattr(components, "TASK_EDGES", 20)
    got = components.components(edges).collect()
    assert len(got) == len(want) and {r["node"]: r["root"] for r in got} == want


def test_small_components_cost_few_tasks(spark):
    """The driver remembers each task; a round over a small table had ten exchanges with one for each partition."""
    edges = base.materialize(spark.range(64).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).coalesce(2), "path")
    context = spark.sparkContext
    context.setJobGroup("small components", "")
    assert components.components(edges).agg(F.max("root")).first()[0] == 0
    context.setJobGroup("other", "")
    status = context.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("small components") for s in status.getJobInfo(j).stageIds]
    assert sum(s.numTasks for s in stages if s) <= 24


def slow_removal(texts_, window):
    docs = [(t or "").encode().split() for t in texts_]
    where = {}
    for n, w in enumerate(docs):
        for s in range(len(w) - window + 1):
            where.setdefault(tuple(w[s : s + window]), []).append((n, s))
    gone = [set() for _ in docs]
    for places in where.values():
        if len(places) > 1:
            for n, s in places:
                gone[n].update(range(s, s + window))
    return [(len(w), len(g), b" ".join(x for i, x in enumerate(w) if i not in g)) for w, g in zip(docs, gone)]


def test_repeats_match_brute_force(spark):
    rows = texts()
    cut = rows[5][1].split()
    while len(cut) < 120:
        cut += rows[6][1].split() + [str(len(cut))]
    shared = " ".join(cut[:70])
    rows += [(200, f"begin {shared} tail " + "a b " * 30, "en"), (201, f"{' '.join(cut[3:40])} {shared}", "en"), (202, "p q r " * 14, "en"), (203, " ".join(cut[:34]), "en"), (204, " ".join(cut[:35]), "en")]
    got = substring.remove_repeats(frame(spark, rows)).collect()
    key = lambda x: (str(x[0]), x[1:])
    expected = [(i, *r) for (i, _, _), r in zip(rows, slow_removal([t for _, t, _ in rows], 35))]
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in got), key=key) == sorted(expected, key=key)
    assert sum(r[2] for r in expected) > 100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=140), st.integers(7, 20))
def test_every_window_has_one_anchor(words, window):
    words = [w.encode() for w in words]
    _, _, first, last = substring.anchors(substring.Hasher(), words, window, 4)
    starts = [s for a, b in zip(first.tolist(), last.tolist()) for s in range(a, b + 1)]
    assert starts == list(range(max(0, len(words) - window + 1)))


def slow_paths(arcs):
    """(id, path, edges before it) by walking, for arcs (id, source, end, size); of a cycle, only which arcs are together."""
    ins, outs = {}, {}
    for i, a, b, _ in arcs:
        outs.setdefault(a, []).append(i)
        ins.setdefault(b, []).append(i)
    up = {outs[n][0]: ins[n][0] for n in ins if n in outs and len(ins[n]) == len(outs[n]) == 1 and ins[n] != outs[n]}
    size, found = {i: n for i, _, _, n in arcs}, {}
    for i, *_ in arcs:
        seen, at = [i], 0
        while seen[-1] in up and up[seen[-1]] != i:
            seen.append(up[seen[-1]])
            at += size[seen[-1]]
        found[i] = ("cycle", frozenset(seen)) if up.get(seen[-1]) == i else (seen[-1], at)
    return found


@pytest.mark.parametrize("seed", range(6))
def test_paths_are_compacted(spark, seed):
    """Random graphs with chains, branches and cycles; sources that agree with chains, and sources that don't."""
    rng = random.Random(seed)
    arcs, at = [], 0
    for _ in range(rng.randint(1, 8)):
        n = rng.randint(1, 30)
        nodes = [at + k for k in range(n + 1)]
        at += n + 1
        if rng.random() < 0.3:
            nodes[-1] = nodes[0]
        elif rng.random() < 0.5:
            nodes[-1] = rng.randrange(at)  # runs into another chain, or into itself
        doc, first = rng.randrange(5), 0
        for a, b in zip(nodes, nodes[1:]):
            size = rng.randint(1, 9)
            if rng.random() < 0.2:
                doc, first = rng.randrange(5), rng.randint(1000, 9000)
            arcs.append((len(arcs) * 7919 % 10007, a, b, size, doc, first))
            first += size
    rng.shuffle(arcs)
    table = spark.createDataFrame(arcs, "id long, source_node long, end_node long, size int, doc long, first int")
    got = {r["id"]: (r["path"], r["at"]) for r in substring.paths(table).collect()}
    want = slow_paths([a[:4] for a in arcs])
    size = {a[0]: a[3] for a in arcs}
    assert got.keys() == want.keys()
    for i, (path, at) in want.items():
        if path != "cycle":
            assert got[i] == (path, at)
    for cycle in {c for p, c in want.values() if p == "cycle"}:
        assert {got[i][0] for i in cycle} <= cycle and len({got[i][0] for i in cycle}) == 1
        places = sorted((got[i][1], size[i]) for i in cycle)
        assert [p for p, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]


def test_spans_of_copies_are_whole(spark):
    """Two documents with one passage get one span each, whatever number of arcs it was found in."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    passage = [word() for _ in range(400)]
    rows = [(i, " ".join([word() for _ in range(50)] + passage + [word() for _ in range(50)]), "en") for i in range(2)]
    _, spans = substring.repeated_spans(frame(spark, rows))
    assert [[tuple(x) for x in r["spans"]] for r in spans.collect()] == [[(50, 415)]] * 2


def test_words_decide():
    """Segments whose first hash agrees by accident aren't repeated: the words are read."""
    hasher = substring.Hasher()
    a, b = ([f"{c}{i}".encode() for i in range(40)] for c in "xy")
    asked = [np.array([0]), np.array([5]), np.array([True]), np.array([False])]
    one, two, again = (substring.read_edges(hasher, w, asked) for w in (a, b, list(a)))
    assert one[1].tolist() == again[1].tolist() != two[1].tolist() and one[3].tolist() == [6]


def test_removing_spans():
    assert substring.remove_spans(b"a b c d", [(0, 0), (1, 1)], 2) == (4, 3, b"d")
    assert substring.sha256_hex(b"") == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("piece", [8, 64, 1 << 20])
def test_words_are_hashed_alike_wherever_they_stand(monkeypatch, piece):
    """Pieces and neighbours don't matter, and other words have other hashes."""
    monkeypatch.setattr(substring, "_PIECE", piece)
    rng = random.Random(piece)
    known = ["a", "aa", "a\0", "\0", "\0a", "é", "word", "worde", "x" * 9, "x" * 10, "x" * 200] + [f"w{i}" for i in range(300)]
    texts_ = [b"", b" \t\n", *(rng.choice([" ", "\n", " \t "]).join(rng.choices(known, k=rng.randint(0, 90))).encode() for _ in range(60))]
    found = {}
    for text, each in zip(texts_, substring._hashed(substring.Hasher(), pa.array(texts_, pa.binary()))):
        words = text.split()
        starts, ends = substring.cut(text)
        assert [text[s:e] for s, e in zip(starts.tolist(), ends.tolist())] == words and len(each) == len(words)
        for word, h in zip(words, each.tolist()):
            assert found.setdefault(word, h) == h
    assert len(set(found.values())) == len(found)
