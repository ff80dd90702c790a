"""Packing, mixing, URL filtering, resharding and the pipeline."""

import itertools
import json
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import mixing, packing, pii, resharding, similar, urls

from .cases import frame, texts
from .test_dedup import slow_similar

VOCABULARY = open(public_tokenizers.path(packing.VOCABULARY), encoding="utf-8").read()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_str(VOCABULARY)


def test_every_token_alone_merges_to_itself():
    """Then merging by the rank of the result is the same as by pair."""
    model = json.loads(VOCABULARY)["model"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    rank = {p: i for i, p in enumerate(pairs)}
    assert len(rank) == len(pairs) and len({a + b for a, b in pairs}) == len(pairs)
    for a, b in pairs:
        token = a + b
        parts = list(token.removesuffix("</w>"))
        if token.endswith("</w>"):
            parts[-1] += "</w>"
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 60))
            assert (parts[best], parts[best + 1]) in rank, token
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert parts == [token]


ODD = ["<|endoftext|>", "a<|ENDOFTEXT|>b", "İstanbul", "ΣΑΣ", "é", "e\u0301", "don't", "'S", "it's12.5%", "ﬁ", "x\u200b", "\x00a", "ß", "ẞ", "Ǆ", "ŉ", "½", "²", "日本語", "a\xa0b", "…", "🎉🎉", "K", "'lls", "don''ts", "\x1fab", "'d'm't", "1234", "</w>", "ab</w>", "\xad", "THE the The", "", " \n", "ÀÉÎ ĲĴ ſ"]


def test_ids_are_the_tokenizers(tokenizer):
    read = packing.Reader(VOCABULARY)
    for text in [*ODD, *(t or "" for _, t, _ in texts())]:
        assert read.ids(text.encode()).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def test_a_worker_lets_go_of_what_other_operators_remember(spark):
    read = packing.reader(VOCABULARY)
    assert packing.reader(VOCABULARY) is read and read.ids(b"some words").size and len(read)
    assert similar._shingles_udf(5).func(pa.array([b"a b", None]))[1].as_py() == b""
    again = packing.reader(VOCABULARY)
    assert again is not read and not len(again)
    similar._sketch_udf(5).func(pa.array([b"a b"]))
    assert packing.reader(VOCABULARY) is not again


def test_near_duplicates_cut_batches_small(spark):
    similar.one_of_each(frame(spark)).count()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_readers_forget(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "REMEMBERED", 500)
    read = packing.Reader(VOCABULARY)
    text = " ".join(t or "" for _, t, _ in texts(20))
    assert read.ids(text.encode()).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
    assert len(read) < 20


def pieces_are_whole(got, ids):
    """``ids`` by row; rows of equal ids are told apart by nothing, so the pieces of an id are checked as multisets."""
    for key, rows in itertools.groupby(sorted(got, key=lambda r: (str(r["doc_id"]), r["doc_tokens"])), key=lambda r: (r["doc_id"], r["doc_tokens"])):
        same = [x for i, x in ids if i == key[0] and len(x) == key[1]]
        assert same
        by_start = defaultdict(int)
        for r in rows:
            assert any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in same)
            for k in range(r["start"], r["start"] + r["length"]):
                by_start[k] += 1
        assert dict(by_start) == dict.fromkeys(range(key[1]), len(same))
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == 4096 or at & (at - 1) == 0 and at < 4096
    return sequences


def test_packing(spark, tokenizer):
    rows = texts()
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, _ in rows]
    pieces_are_whole(packing.pack(frame(spark)).collect(), ids)
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_over_many_shards(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 3000)
    monkeypatch.setattr(packing.shards, "__defaults__", (3000,))
    rows = texts(150)
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, _ in rows]
    got = packing.pack(frame(spark, rows)).collect()
    pieces_are_whole(got, ids)
    assert len({r["sequence_id"] >> 32 for r in got}) > 2


def test_neighbours_share_rare_terms():
    rng = np.random.default_rng(0)
    topic = [rng.integers(1000 * k, 1000 * k + 60, size=(8, 200)).astype(np.uint16) for k in range(1, 6)]
    docs = [d for group in topic for d in group]
    index = packing.Index(docs, np.ones(1 << 16), 200.0)
    unused = np.ones(len(docs), bool)
    unused[0] = False
    assert set(index.neighbours(0, unused)[:7].tolist()) == set(range(1, 8))
    slow = {}
    for j in range(1, len(docs)):
        shared = set(index.ask[0].tolist()) & set(docs[j].tolist())
        tf = {t: int((docs[j] == t).sum()) for t in shared}
        slow[j] = sum(n * 2.2 / (n + 1.2) for n in tf.values())
    best = index.neighbours(0, unused).tolist()
    assert best == sorted([j for j in slow if slow[j] > 0], key=lambda j: (-round(slow[j], 3), j)) or set(best) == {j for j in slow if slow[j] > 0}


def test_windows_take_neighbours_while_there_are_any():
    """Hundreds of short leftovers of two topics, in turns: a window has one topic as long as that has documents left."""
    rng = np.random.default_rng(1)
    docs = [rng.integers(1000 * (i % 2 + 1), 1000 * (i % 2 + 1) + 30, size=20).astype(np.uint16) for i in range(800)]
    index = packing.Index(docs, np.ones(1 << 16), 20.0)
    sequences = packing.pack_shard(np.full(800, 20, np.int64), index)
    assert sorted((i, a) for s in sequences for i, a, _ in s if a == 0) == [(i, 0) for i in range(800)]
    topics = [{i % 2 for i, _, _ in s} for s in sequences if sum(p[2] for p in s) == packing.WINDOW]
    assert topics[0] == {0} and sum(len(t) == 2 for t in topics) <= 1
    unused = np.ones(800, bool)
    unused[0] = False
    assert len(list(index.all_neighbours(0, unused))) == 399


@pytest.mark.parametrize("seed", range(4))
def test_filling_matches_plain_bm25(monkeypatch, seed):
    """Windows filled by scoring every pair of documents anew."""
    monkeypatch.setattr(packing, "WINDOW", 256)
    monkeypatch.setattr(packing, "ASK", 1000)
    monkeypatch.setattr(packing, "RETURNED", 1000)
    rng = np.random.default_rng(seed)
    docs = [rng.choice(200, p=(w := rng.dirichlet(np.full(200, 0.05))) / w.sum(), size=rng.integers(5, 120)).astype(np.uint16) for _ in range(60)]
    idf = np.r_[rng.uniform(0.5, 6, 200), np.ones((1 << 16) - 200)]
    mean = float(np.mean([len(d) for d in docs]))

    def score(a, b):
        total = 0.0
        for t in set(docs[a].tolist()) & set(docs[b].tolist()):
            tf = int((docs[b] == t).sum())
            total += np.float32(idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[b]) / mean)))
        return total

    left = {i: len(d) for i, d in enumerate(docs)}
    plain, lead = [], None
    while left:
        first = lead if lead is not None else min(left)
        near = sorted((j for j in left if j != first), key=lambda j: (-round(score(first, j), 5), j))
        window, room, lead = [], 256, None
        for j in [first, *near]:
            used = min(room, left[j])
            window.append((j, len(docs[j]) - left[j], used))
            room -= used
            left[j] -= used
            if left[j]:
                lead = j
            else:
                del left[j]
            if not room:
                break
        plain.append(window)
    got = packing.pack_shard(np.array([len(d) for d in docs]), packing.Index(docs, idf, mean))
    assert got[: len(plain) - 1] == plain[:-1]


def test_terms_past_the_first_are_asked():
    seed = np.arange(200, dtype=np.uint16)
    index = packing.Index([seed, np.array([5000] * 9, np.uint16), np.array([199] * 9, np.uint16)], np.r_[np.linspace(9, 1, 200), np.ones((1 << 16) - 200)], 70.0)
    assert list(index.all_neighbours(0, np.array([False, True, True]))) == [2]


def test_shards_are_bounded():
    rng = random.Random(2)
    cells = [(i, rng.randint(1, 400)) for i in range(100)] + [(100, 9000)]
    size = defaultdict(float)
    for (cell, first, parts), (_, n) in zip(packing.shards(cells, 1000), cells):
        for s in range(first, first + parts):
            size[s] += n / parts
    assert max(size.values()) <= 1000 and sorted(size) == list(range(len(size)))


def slow_share(budget, caps, weights):
    """Water-filling by rounds: each round the open children share what is left by weight."""
    got, open_, left = dict.fromkeys(caps, 0.0), set(caps), float(budget)
    while open_ and left > 1e-9:
        total = sum(weights[c] for c in open_)
        over = [c for c in open_ if caps[c] <= left * weights[c] / total]
        if not over:
            for c in open_:
                got[c] = left * weights[c] / total
            break
        for c in over:
            got[c] = float(caps[c])
        left -= sum(caps[c] for c in over)
        open_ -= set(over)
    return got


def test_targets_match_rounds(spark):
    rng = random.Random(3)
    leaves = [(d, lang, f"s{i}", rng.choice([0, 5, 40, 3000, 100_000])) for d in mixing.DOMAIN_WEIGHTS for lang in ("en", "de", "xx") for i in range(4)]
    got = mixing.targets(spark.createDataFrame(leaves, "domain string, lang string, source string, supply long"), 60, 2).collect()
    budget = sum(x[3] for x in leaves) * 0.6
    cap = lambda *path: sum(2 * x[3] for x in leaves if x[: len(path)] == path)
    top = slow_share(budget, {d: cap(d) for d in mixing.DOMAIN_WEIGHTS}, mixing.DOMAIN_WEIGHTS)
    for d, share in top.items():
        langs = slow_share(share, {x: cap(d, x) for x in ("en", "de", "xx")}, mixing.LANGUAGE_WEIGHTS | {"xx": 1})
        for lang, part in langs.items():
            want = slow_share(part, {f"s{i}": cap(d, lang, f"s{i}") for i in range(4)}, {f"s{i}": 1 for i in range(4)})
            for r in got:
                if (r["domain"], r["lang"]) == (d, lang):
                    assert abs(r["target"] - want[r["source"]]) <= 1
                    assert r["target"] == r["passes"] * r["supply"] + r["rest"] and (r["rest"] < r["supply"] or r["supply"] == 0)
    assert abs(sum(r["target"] for r in got) - budget) <= len(leaves)


def test_mixture_takes_prefixes(spark):
    docs = frame(spark)
    got = mixing.mix(docs).collect()
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= r["tokens"]
        taken[r["domain"], r["lang"], r["source"]] += r["taken"]
    own = docs.select(mixing.domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("unknown")).alias("lang"), "source", mixing.words(F.col("text")).alias("n"))
    leaves = own.groupBy("domain", "lang", "source").agg(F.sum("n").alias("supply"))
    for r in mixing.targets(leaves, mixing.BUDGET_PERCENT, mixing.MAX_EPOCHS).collect():
        assert taken[r["domain"], r["lang"], r["source"]] == r["target"]
    assert mixing.mix(frame(spark, [])).count() == 0
    kept = mixing.selected(docs, 90)
    assert kept.dtypes == docs.dtypes and 0 < kept.count() <= docs.count()


@pytest.mark.parametrize("percent,epochs", [(90, 1), (35, 1), (60, 2)])
def test_selection_keeps_to_the_budget(spark, percent, epochs):
    """Null ids and rows that repeat count like all others: the words kept of a leaf are its target."""
    rows = [(i, f"w{i} " * (i % 9), "en") for i in range(60)] + [(None, "no name here", "en")] * 20 + [(None, f"n{i} x", "en") for i in range(15)] + [(7, "again and again", "en")] * 25
    docs = frame(spark, rows)
    leaves = docs.select(mixing.domain_of(F.col("source")).alias("domain"), "lang", "source", mixing.words(F.col("text")).alias("n")).groupBy("domain", "lang", "source").agg(F.sum("n").alias("supply"))
    want = {r["source"]: r["target"] for r in mixing.targets(leaves, percent, epochs).collect()}
    kept = mixing.selected(docs, percent, epochs)
    assert kept.dtypes == docs.dtypes
    got = defaultdict(int)
    for r in kept.collect():
        got[r["source"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_mixing_sql(spark, tmp_path):
    rows = [r for r in texts() if r[0] is not None]
    frame(spark, rows).dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(mixing.SQL).df()
    got = mixing.query(spark, str(tmp_path)).toPandas()
    assert sorted(map(str, got[sorted(got.columns)].values.tolist())) == sorted(map(str, want[sorted(want.columns)].values.tolist()))


PAGES = [
    (1, "http://WWW.Example.com/en/1"), (2, "https://example.com/en/2?x"), (3, "http://sub.example.com/en"), (4, "ftp://a.net/es/x#y"), (5, "http://a.net/fr/"), (6, "no scheme"), (7, None), (8, "x://"),
    (9, "http://a.org/2024-01-02/deadbeef01/7.html"), (10, "http://a.org/a/b/c/d/e/f"), (11, "http://com/q"), (12, "http://a.com"), (13, "http://é.org/ß"), (None, "http://a.org/x"), (1, "http://WWW.Example.com/en/1"),
]


def test_rules_of_urls(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([(9, 1), (9, 0), (None, 1)], "label_id long, bad int")
    got = urls.judge(pages, labels).collect()
    assert len(got) == len(PAGES)
    by_id = {r["page_id"]: r for r in got}
    assert [by_id[i]["rule"] for i in range(1, 14)] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/", "net/fr/", None, None, None, None, None, "com/", None, None]
    assert [by_id[i]["verdict"] for i in range(1, 6)] == ["allow", "block", "allow", "block", "block"]
    assert (by_id[1]["host"], by_id[1]["path"]) == ("www.example.com", "/en/1")
    assert (by_id[6]["host"], by_id[6]["path"], by_id[7]["host"], by_id[8]["path"]) == ("", "", "", "")
    assert by_id[10]["template"] == "/a/b/c/d/e/f"
    assert urls.judge(pages.limit(0), labels).count() == 0


def test_templates_learn_from_labels(spark):
    bad = [(i, f"http://spam.org/buy/{i}") for i in range(20)]
    good = [(100 + i, f"http://news.org/{2000 + i}/story-{i}/") for i in range(40)]
    pages = spark.createDataFrame([*bad, *good], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in [*bad, *good] if i % 2], "label_id long, bad int")
    got = {r["page_id"]: r for r in urls.judge(pages, labels).collect()}
    assert {got[i]["verdict"] for i, _ in bad} == {"block"} and {got[i]["verdict"] for i, _ in good} == {"allow"}
    assert len({got[i]["template"] for i, _ in good}) == 1  # 40 names at one level become one wildcard


def test_siblings_merge_at_every_level(spark):
    """Deep branches of one kind merge, those of another stay apart; nothing is cut at any depth."""
    rows = [(100 * k + i, f"http://a.org/x/y/z/u/{kind}/part{k}/more/{i}") for k, kind in enumerate(["news", "news", "news", "spam", "spam", "spam"]) for i in range(40)]
    pages = spark.createDataFrame([*rows, *[(900 + i, f"http://a.org/x/y/z/u/news/new{i}/more/{i}") for i in range(3)]], "page_id long, url string")
    labels = spark.createDataFrame([(i, int("spam" in u)) for i, u in rows], "label_id long, bad int")
    got = {r["page_id"]: r for r in urls.judge(pages, labels).collect()}
    assert {got[i]["verdict"] for i, u in rows if "spam" in u} == {"block"} and {got[i]["verdict"] for i, u in rows if "news" in u} == {"allow"}
    assert {got[i]["template"] for i, _ in rows} == {"/x/y/z/u/news/*/more/{number}", "/x/y/z/u/spam/*/more/{number}"}
    assert {(got[900 + i]["template"], got[900 + i]["n_labelled"]) for i in range(3)} == {("/x/y/z/u/news/*/more/{number}", 120)}  # no labels of their own


def test_urls_sql(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"http://{rng.choice(['a.org', 'b.net', 'www.c.com'])}/{rng.choice(['en', 'de', 'x', str(i)])}/{rng.choice(['p', str(i), f'{i}.html'])}{rng.choice(['', '/', '/q/r/s/t'])}?k") for i in range(300)]
    spark.createDataFrame(rows + [p for p in PAGES if p[0] is not None][:0], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want, got = con.sql(urls.SQL).df(), urls.query(spark, str(tmp_path)).toPandas()
    plain = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist()))
    assert plain(got) == plain(want)


def cheapest(cells, n):
    """Fewest bytes moved, by trying every way to round and every number of rows each cell gives up."""
    rows = sum(c[2] for c in cells)
    floor, extra = divmod(rows, n)
    best = None
    for up in itertools.combinations(range(n), extra):
        size = [floor + (j in up) for j in range(n)]
        cost = 0
        for j in range(n):
            over = sum(c[2] for c in cells if c[0] == j) - size[j]
            for c in sorted((c for c in cells if c[0] == j), key=lambda c: c[3] // c[2]):
                moved = min(max(over, 0), c[2])
                cost, over = cost + moved * (c[3] // c[2]), over - moved
        best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(10))
def test_flow_moves_the_fewest_bytes(seed):
    rng = random.Random(seed)
    n = rng.randint(2, 5)
    cells = [(s, c, k := rng.randint(1, 9), k * (1 << c)) for s in range(rng.randint(1, n)) for c in rng.sample(range(8), rng.randint(1, 4))]
    stay, takes = resharding.solve(cells, n)
    moved = sum((c[2] - stay[c[0], c[1]]) * (c[3] // c[2]) for c in cells)
    assert moved == cheapest(cells, n)
    assert sum(takes) == sum(c[2] - stay[c[0], c[1]] for c in cells)


def fewest_bytes(rows, n):
    """Bytes that have to move, for rows (old shard, size): smallest first, and the dearest last rows spared."""
    floor, extra = divmod(len(rows), n)
    must, last = 0, []
    for shard in {s for s, _ in rows}:
        sizes = sorted(z for s, z in rows if s == shard)
        over = len(sizes) if shard >= n else len(sizes) - floor
        must += sum(sizes[: max(over, 0)])
        if shard < n and over > 0:
            last.append(sizes[over - 1])
    return must - sum(sorted(last)[-extra:] if extra else [])


@pytest.mark.parametrize("block_rows", [3, 50_000])
def test_resharding(spark, monkeypatch, block_rows):
    monkeypatch.setattr(resharding, "BLOCK_ROWS", block_rows)
    rows = [*texts(200), *[(None, "again", "en")] * 30]
    got = resharding.reshard(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["moved"] == (r["shard"] != r["old_shard"])
    assert sorted(slots) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sum(r["size"] for r in got if r["moved"]) == fewest_bytes([(r["old_shard"], r["size"]) for r in got], 40)
    assert resharding.reshard(frame(spark, [])).count() == 0


@pytest.mark.parametrize("old_shards,new_shards", [(7, 5), (5, 5), (3, 8), (1, 4)])
def test_the_fewest_bytes_move(spark, old_shards, new_shards):
    rng = random.Random(old_shards)
    docs = frame(spark, [(i, "x" * int(rng.paretovariate(0.7) * 20) if i % 9 else "same", "en") for i in range(150)])
    got = resharding.reshard(docs, resharding.old_shard(old_shards), new_shards).collect()
    assert sum(r["size"] for r in got if r["moved"]) == fewest_bytes([(r["old_shard"], r["size"]) for r in got], new_shards)
    count = defaultdict(int)
    for r in got:
        count[r["shard"]] += 1
    assert max(count.values()) - min(count.values()) <= 1 and len(count) == new_shards


def test_rewrite_touches_affected_shards(spark, tmp_path):
    kinds = "doc_id long, text string, shard string, slot int, size string, moved long, old_shard string, text_crc32 int, row string"
    docs = spark.createDataFrame([(i, "t" * (i % 7), f"s{i}", i, "z", 1, "o", 2, "r") for i in range(8)], kinds)
    old = F.when(F.col("doc_id") < 4, 0).when(F.col("doc_id") < 6, 1).otherwise(2)
    placed = resharding.rewrite(docs, str(tmp_path / "out"), old, 4).collect()
    assert sorted((r["doc_id"], r["old_shard"]) for r in placed) == [(i, 0 if i < 4 else 1 if i < 6 else 2) for i in range(8)]
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == 4 and {r["shard"] for r in written.collect()} == {0, 3}
    assert sorted(tuple(r["row"]) for r in written.collect()) == sorted(tuple(r) for r in docs.where("doc_id < 4").collect())


def test_resharding_query(spark):
    """The registered query: every document once, from the files that were written."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = resharding.query(spark, "/root/testdata/sf0.01").collect()
    want = {r["doc_id"]: (len(r["text"].encode()) + 16, zlib.crc32(r["text"].encode())) for r in docs}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == want and len(got) == len(docs)
    assert sum(r["size"] for r in got if r["moved"]) == fewest_bytes([(r["old_shard"], r["size"]) for r in got], 40)


def test_many_equal_rows_are_parted(spark, monkeypatch):
    """Rows of one id and text share a cell, which still becomes several shards."""
    monkeypatch.setattr(packing.shards, "__defaults__", (3000,))
    got = packing.pack(frame(spark, [(None, "the same text " * 20, "en")] * 200)).collect()
    assert len({r["sequence_id"] >> 32 for r in got}) > 3 and sum(r["length"] for r in got) == 200 * got[0]["doc_tokens"]


def test_pipeline_stages(spark, tmp_path, tokenizer):
    rows = [r for r in texts(120) if r[0] is not None]
    frame(spark, rows).dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first, kinds = docs, docs.dtypes
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"stage{len(seen)}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{len(seen)}"))
        seen.append((name, before, docs))
        if len(seen) < 5:
            assert docs.dtypes == kinds
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(first) - ids(seen[0][2]) == {124, 125, 126, 128, 129}  # null, empty, blank, null again, no letters
    before = [(r["doc_id"], r["text"], r["lang"]) for r in seen[1][1].orderBy("doc_id").collect()]
    classes = slow_similar(before)
    assert ids(seen[1][2]) == {min(i for (i, _, _), c in zip(before, classes) if c == k) for k in set(classes)}
    assert ids(seen[2][2]) == ids(seen[1][2])
    for r in seen[2][2].collect():
        assert not pii.base_spans(r["text"])[0]
    named = {r["doc_id"] for r in mixing.mix(seen[3][1], corpus_pipeline.MIX_PERCENT, 1).collect()}
    assert ids(seen[3][2]) == named
    packed = [(r["doc_id"], [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2]) for r in seen[4][1].collect()]
    pieces_are_whole(seen[4][2].collect(), packed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4][2].count()
