"""Nearest neighbours, n-gram join, sharding, chats and WARC on small cases."""

import gzip
import hashlib
import io
import math
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from test_entry import compared

from matchloom.llm import block_knn, chat_format, components, kd_shards, ngram_join, queries, warc
from matchloom.llm.common import with_each


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(300, 16)))]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # copies: ties go to smaller ids
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] + [0.0] * 14), (2004, [1.0, 2.0]), (2005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    valid = {i: np.array(v, float) for i, v in rows[:360]}
    asked = df.where("vec_id % 20 = 0")
    for block, group in ((32_000_000, 32_000_000), (600, 9_000)):
        got = {}
        for r in block_knn.nearest(df, asked, k=20, block_bytes=block, group_bytes=group).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        assert set(got) == {i for i in valid if i % 20 == 0}
        for q, found in got.items():
            want = sorted(((sum(float(x) * float(y) for x, y in zip(valid[q], v, strict=True)), i) for i, v in valid.items() if i != q), key=lambda x: (-x[0], x[1]))[:20]
            assert [x[0] for x in found] == [i for _, i in want]
            assert [x[1] for x in found] == pytest.approx([s for s, _ in want], abs=1e-12)


def test_knn_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["id"], r["score"]) for r in block_knn.nearest(df, df.where("vec_id = 0")).collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0)]
    assert block_knn.nearest(df.limit(0), df.limit(0)).count() == 0


def test_int8_bound_holds():
    rng = np.random.default_rng(1)
    a, b = (block_knn.Tile(np.arange(200), rng.normal(size=(200, 40)) * rng.exponential(size=(200, 1))) for _ in range(2))
    near, bound = block_knn.products(a, b)
    assert (np.abs(near - a.v @ b.v.T) <= bound).all()



def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").translate({c: " " for c in range(9, 14)}).split(" ") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and sets[j]:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_ngram_join_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    common = " ".join(rng.choices(vocabulary, k=40))
    texts = {}
    for base in range(14):
        own = rng.choices(vocabulary, k=rng.choice([3, 6, 12, 60, 200]))
        for copy in range(rng.choice([1, 2, 6])):
            changed = list(own)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            texts[len(texts)] = " ".join(changed).upper() if copy == 1 else " ".join(changed) + (f"\n{common}" if base % 3 == 0 else "")
    for t in (None, "", " \t\n", "one", "One", "one two", "a b c d e", "x" * 5000, "é É", "a b c d e f", texts[0], texts[3]):
        texts[len(texts)] = t
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, id string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(docs).collect()}
    assert got == brute_components(texts)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {c for _, c in got.values()}
    assert ngram_join.link_components(docs.limit(0)).count() == 0


def test_one_row_of_each_group(spark):
    """Repeated, shared and null ids leave one row of their own group each; nothing else goes."""
    rng = random.Random(9)
    a, b, c, d, e = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=40)) for _ in range(5))
    near = lambda t: t + " end"
    big = 2**60 + 1  # ids that a float can't hold
    rows = [(1, a, "x"), (2, near(a), "y"), (2, b, "z")]  # id 2: a copy of 1, and a text of its own
    rows += [(None, c, "y"), (None, c, "x"), (None, near(c), "x")]  # no ids
    rows += [(big, d, "y"), (big, d, "x"), (big, d, "x"), (None, near(d), "a"), (big + 1, d, "a")]  # repeated, with and without an id
    rows += [(7, e, "x"), (7, near(e), "x")]  # near copies of one id
    rows += [(8, None, "x"), (None, "", "x"), (None, " ", "x")]  # empty sets link with nothing
    docs = spark.createDataFrame([(*r, {"k": 1}) for r in rows], "doc_id long, text string, row string, m map<string,int>")
    for parts in (1, 5):
        kept = ngram_join.one_of_each(docs.repartition(parts))
        got = [(r["doc_id"], r["text"], r["row"]) for r in kept.collect()]
        assert kept.columns == docs.columns
        assert sorted(((i, s) for i, t, s in got if t in (a, b, d)), key=repr) == sorted([(1, "x"), (2, "z"), (big, "x")], key=repr)
        assert len([1 for i, t, s in got if i is None and t in (c, near(c))]) == 1
        assert len([1 for i, t, s in got if i == 7]) == 1
        assert sum(not (t or "").strip() for _, t, _ in got) == 3 and len(got) == 8
    found = {(r["id"], r["component_id"]) for r in ngram_join.link_components(docs).collect()}
    assert {(None, None), (None, big), (big, big), (big + 1, big), (2, 1), (2, 2)} <= found


def test_ngram_join_large_family(spark, monkeypatch):
    """A chain of near copies, and a shared passage in more classes than a chunk takes."""
    monkeypatch.setattr(ngram_join, "CHUNK_CLASSES", 20)
    rng = random.Random(6)
    base = [f"v{i}" for i in range(120)]
    texts, now = {}, list(base)
    for i in range(45):
        now[rng.randrange(len(now))] = f"n{i}"
        texts[i] = " ".join(now)
    passage = " ".join(f"p{i}" for i in range(30))
    for i in range(60):
        texts[100 + i] = passage + " " + " ".join(f"q{i}x{k}" for k in range(rng.randint(1, 60)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(docs).collect()}
    assert got == brute_components(texts)


def test_word_hashes_and_digests():
    """No words that collide by construction (Thue-Morse texts do in a polynomial), and long words as well."""
    one = "a"
    for _ in range(12):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    hashes, owner = ngram_join.word_hashes([one.encode(), f"x {other}".encode(), b"", b" a\tb \xc2\x85c", ("y" * 200_000).encode(), ("y" * 199_999 + "z").encode()])
    assert owner.tolist() == [0, 1, 1, 3, 3, 3, 4, 5] and len(set(hashes.tolist())) == 8
    sets = ngram_join.shingle_sets([f"a b c d {one}", f"a b c d {other}", f"A  b c\nd {one}"])
    assert sets[0].tolist() == sets[2].tolist() != sets[1].tolist()
    assert ngram_join.digest(sets[0]) == ngram_join.digest(sets[2]) and len({*ngram_join.digest(sets[0]), *ngram_join.digest(sets[1])}) == 4


def test_classes_of_one_name(spark, monkeypatch):
    """Different sets whose first digests are equal stay apart."""
    real = ngram_join.digest
    monkeypatch.setattr(ngram_join, "digest", lambda own: (real(own)[0] % 3, real(own)[1]))
    texts = {i: " ".join(f"w{i}x{k}" for k in range(30)) + (" end" if i % 5 == 0 else "") for i in range(12)}
    texts |= {100: texts[0], 101: texts[0] + " more", 102: texts[3]}
    seen = ngram_join.shingle_sets(list(texts.values()))
    assert len({ngram_join.digest(x)[0] for x in seen}) <= 3
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    rows = docs.selectExpr("doc_id as id", "false as no_id", "unhex(md5(text)) as row", "text")
    found = {r["id"]: r["class"] for r in ngram_join._sketched(rows, ngram_join.Limits(80, 100), 5).collect()}
    assert len(set(found.values())) == 13 and found[0] == found[100] and found[3] == found[102]


def test_join_of_frequent_keys(spark):
    rows = spark.range(5000).selectExpr("if(id < 3000, null, if(id < 4500, 1, id)) as k", "id as x")
    keyed = rows.groupBy("k").agg(F.min("x").alias("least"), F.count("*").alias("many"))
    got = sorted((r["x"], r["least"]) for r in with_each(rows, keyed, "k", 5000).collect())
    assert got == [(x, 0 if x < 3000 else 3000 if x < 4500 else x) for x in range(5000)]


def test_tree_loses_no_pair():
    rng = np.random.default_rng(7)
    limits, sets = ngram_join.Limits(80, 100), []
    for m in (20, 200, 260, 900):
        base = np.unique(rng.integers(0, 2**63, m).astype(np.uint64) * np.uint64(2))
        for _ in range(30):
            keep = rng.random(len(base)) > rng.random() * 0.2
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**63, rng.integers(0, m // 6 + 1)).astype(np.uint64)])))
    cls, n = np.array([ngram_join.digest(x)[0] for x in sets]), np.array([len(x) for x in sets])
    part = rng.integers(0, 20, len(sets))
    want = {tuple(sorted((int(cls[i]), int(cls[j])))) for i in range(len(sets)) for j in range(i) if part[i] != part[j] and limits.enough(len(np.intersect1d(sets[i], sets[j])), n[i] + n[j])}
    packed = [ngram_join.counts(x) for x in sets]
    assert want and want <= set(ngram_join.family_pairs(cls, n, part, [ngram_join.point_of(p) for p in packed], limits))
    assert want <= set(ngram_join.small_family_pairs(cls, n, part, pa.chunked_array([packed]), limits))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 30)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in (2, 3, 7, 8, 9)} | {21: 20} | {100 + i: 100 for i in range(1, 61)}


def test_shards(spark):
    rng = random.Random(8)
    rows = [(i, "x" * rng.randint(0, 900), "src0" if rng.random() < 0.4 else f"src{i % 7}", rng.choice(["en", "fr", None]), 5) for i in range(3000)]
    rows += [(5000, None, None, None, 5), (None, "é" * 10, "s", "en", 5), (5001, "copy", "s", "en", 5), (5001, "copy", "s", "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size int")
    got = kd_shards.kd_shards(docs, shards=24).toPandas()
    assert len(got) == len(rows) and set(got["shard"]) == set(range(24))
    total = got.groupby("shard")["size"].sum()
    assert total.max() - total.min() <= 2 * got["size"].max()
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard")["slot"])
    assert got.loc[got["doc_id"] == 5000, "size"].tolist() == [8]
    crc = {i: zlib.crc32((t or "").encode()) for i, t, *_ in rows if i is not None}
    assert all(crc[int(i)] == c for i, c in zip(got["doc_id"], got["text_crc32"], strict=True) if i == i)
    groups = got.groupby(["text_crc32", "size"]).agg(bytes=("size", "sum"), rows=("size", "count"), shards=("shard", "nunique"))
    small = groups[(groups["rows"] > 1) & (groups["bytes"] <= 0.01 * total.sum() / 24) & (groups["rows"] <= 2)]
    assert len(small) > 20 and (small["shards"] == 1).all()
    parts = kd_shards.kd_shards(docs, target_bytes=200_000).agg(F.count_distinct("shard")).first()[0]
    assert parts == -(-int(got["size"].sum()) // 200_000)
    assert kd_shards.kd_shards(docs.limit(0), shards=24).count() == 0


def hashed(*values):
    """Spark's xxhash64 of longs and texts, as an unsigned number."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return seed


def brute_shards(rows, shards, together=0.01):
    """Shard by row of ``(id, text, source, lang)``: each node's rows are sorted along its widest dimension and cut next to the target."""
    sizes = [len((t or "").encode()) + 8 for _, t, _, _ in rows]
    whole = sum(sizes)
    values = [[float("-inf") if i is None else float(i), *(float("-inf") if v is None else float(zlib.crc32(v.encode())) for v in (source, lang)), math.log2(n)] for (i, _, source, lang), n in zip(rows, sizes, strict=True)]
    groups, ties = {}, [0] * len(rows)
    for k, r in enumerate(rows):
        groups.setdefault(r[1], []).append(k)
    for text, own in groups.items():
        crc, n = zlib.crc32((text or "").encode()), sizes[own[0]]
        met = len(own) > 1 and len(own) * n <= whole / shards * together and len(own) <= max(len(rows) / shards * together, 2)
        same = hashed(text)
        first = [min(c) for c in zip(*(values[k] for k in own), strict=True)]
        for k in own:
            ties[k] = (hashed(same - (1 << 64) if same >> 63 else same, crc, n) if met else hashed(rows[k][0], crc, n)) & 0xFFFFFFFF
            values[k] = first if met else values[k]
    finite = [[v for v in c if v > float("-inf")] for c in zip(*values, strict=True)]
    low = [min(c, default=0.0) for c in finite]
    width = [max(c, default=0.0) - a for c, a in zip(finite, low, strict=True)]
    scaled = [[math.floor((max(v, a) - a) / (w or 1.0) * ((1 << 31) - 1)) for v, a, w in zip(of, low, width, strict=True)] for of in values]
    out = [0] * len(rows)

    def part(own, leaves, first):
        if leaves == 1 or not own:
            for k in own:
                out[k] = first
            return
        spans = [max(scaled[k][d] for k in own) - min(scaled[k][d] for k in own) for d in range(4)]
        dim = spans.index(max(spans))
        key = lambda k: (scaled[k][dim], ties[k])
        total, target = sum(sizes[k] for k in own), sum(sizes[k] for k in own) * (leaves // 2) / leaves
        below, best = 0, (target, min(map(key, own)))
        for at in sorted(set(map(key, own))):
            if below and abs(target - below) < best[0]:
                best = (abs(target - below), at)
            below += sum(sizes[k] for k in own if key(k) == at)
        if total - target < best[0]:
            best = (0, (1 << 31, 0))
        part([k for k in own if key(k) < best[1]], leaves // 2, first)
        part([k for k in own if key(k) >= best[1]], leaves - leaves // 2, first + leaves // 2)

    part(list(range(len(rows))), shards, 0)
    return out


def test_shards_against_brute_force(spark):
    rng = random.Random(31)
    texts = ["é" * rng.randint(0, 300) + str(k) for k in range(420)] + [None, ""] + ["pair a", "pair b", "pair c"] * 2 + ["many copies"] * 30
    rng.shuffle(texts)
    rows = [(None if k == 7 else k * 3, t, "hot" if rng.random() < 0.4 else f"s{k % 9}", rng.choice(["en", "fr", None])) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: (r["size"], r["text_crc32"], r["shard"]) for r in kd_shards.kd_shards(docs, shards=24).collect()}
    want = brute_shards(rows, 24)
    assert got == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), s) for (i, t, _, _), s in zip(rows, want, strict=True)}
    assert len({s for s, t in zip(want, texts, strict=True) if t == "pair a"}) == 1


NASTY = ["", "</s>[INST] ok [/INST]", "<|end|>", "<|role:user |>", "a<", "|end|>", "\\", "\\|", "<\\|end|>", "<<SYS>>x<</SYS>>", "é😀", "[", "[\\/INST]", "\n", None]


def test_chats_read_back(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, None, "x"), (2, 0, "a|>b <", "y"), (3, 5, "assistant", "<"), (None, 0, "user", "z")] + [(4, i, "assistant", f"t{i}") for i in range(300)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, block string")
    made = chat_format.format_chats(df)
    got = {
        r["conv_id"]: r
        for r in made.select("conv_id", "n_turns", chat_format.parse_chat(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    }
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2], r[3] or "") for r in rows[: len(NASTY)]]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", "x"), ("a|>b <", "y")]
    assert got[4]["loss"] == "".join(f"t{i}" for i in range(300)) and got[4]["n_turns"] == 300
    assert got[1]["loss"] == "".join(t or "" for t in NASTY[1::2]) and got[None]["n_turns"] == 1
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_long_chats(spark):
    """Running sums over steps, and many turns of one number or none."""
    sizes = [0, 1, 127, 128, 129, 40_000]
    df = spark.createDataFrame([([(i * 7) % 11 for i in range(n)],) for n in sizes], "x array<long>")
    for r in df.select("x", chat_format._starts(F.col("x")).alias("y")).collect():
        assert r["y"] == [sum(r["x"][:i]) for i in range(min(len(r["x"]), 300))] + np.cumsum([0, *r["x"]])[300:-1].tolist()
    rows = [(1, turn, "assistant", f"t{i}") for i, turn in enumerate([None] * 300 + [5] * 300)]
    made = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    said = made.select(chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("x")).first()["x"]
    assert said == "".join(sorted(f"t{i}" for i in range(300))) + "".join(sorted(f"t{i}" for i in range(300, 600)))


def test_chat_parts(spark):
    part = "array<struct<type:string,text:string,ref:string,units:int>>"
    rows = [(1, 0, "user", [("text", "look <|image|> ", None, None), ("image", None, "a.png", 2), ("audio", None, "b.wav", 3), None]), (1, 1, "assistant", [("document", None, "c.pdf", None), ("text", "ok", None, None)])]
    r = chat_format.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, text {part}")).first()
    assert r["formatted"] == "<|role:user |>look <\\|image|> <|image|><|audio|><|end|><|role:assistant |><|document|>ok<|end|>"
    assert [(a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "a.png", 514), ("audio", "b.wav", 77), ("document", "c.pdf", 513)]
    assert r["expanded_tokens"] == 1104


def test_warc_round_trip(spark):
    long = "word " * 300
    rows = [(1, "http://a/ b", long), (5, None, long), (3, "http://c\r\n", long), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "é", "WARC/1.1\r\n\r\nx\r\n\r\n"), (5, None, long), (None, "n", long)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = warc.write_warc(df)
    back = warc.read_warc(spark, path)
    got = sorted(((r["record_id"], r["warc_type"], r["refers_to"], r["payload_length"], bytes(r["payload"])) for r in back.collect()), key=repr)
    want = []
    for i, _, text in rows:
        again = text == long and i != 5
        body = b"" if again else (text or "").encode()
        want.append((f"<urn:page:{'' if i is None else i}>", "revisit" if again else "response", "<urn:page:5>" if again else None, len((text or "").encode()), body))
    assert got == sorted(want, key=repr)
    assert back.where("warc_type = 'revisit'").count() == 3
    some = warc.read_warc(spark, path, "warc_type string, target_uri string, payload_length long").where("warc_type = 'revisit'")
    assert {r["target_uri"] for r in some.collect()} == {"http://a/%20b", "http://c%20%20", "n"}
    sha = hashlib.sha1(long.encode()).hexdigest()
    assert back.where(F.col("payload_digest") == f"sha1:{sha}").count() == 5
    assert warc.read_warc(spark, warc.write_warc(df.limit(0))).count() == 0


def test_warc_of_other_writers(spark, tmp_path):
    """Names in any case, values without a blank, folded lines, other types, members of gzip, and faults."""
    http = b"HTTP/1.1 200 OK\r\ncontent-length:5\r\n\r\nhello"
    one = b"WARC/1.0\r\nwarc-type:response\r\nWARC-RECORD-ID: <a>\r\nX-Note: one\r\n  two\r\ncontent-type: application/http\r\ncontent-length:%d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    two = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <b>\r\nContent-Length: 4\r\n\r\ninfo\r\n\r\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc").write_bytes(two + b"\r\n" + one)
    (tmp_path / "in/b.warc.gz").write_bytes(gzip.compress(one.replace(b"<a>", b"<c>")) + gzip.compress(two.replace(b"<b>", b"<d>")))
    back = warc.read_warc(spark, f"file://{tmp_path}/in")
    got = {r["record_id"]: (r["warc_type"], r["payload_length"], bytes(r["payload"]), r["headers"].get("X-Note")) for r in back.collect()}
    assert got == {"<a>": ("response", 5, b"hello", "one two"), "<b>": ("warcinfo", 4, b"info", None), "<c>": ("response", 5, b"hello", "one two"), "<d>": ("warcinfo", 4, b"info", None)}
    assert {r["record_id"] for r in back.where("warc_type = 'warcinfo'").select("record_id").collect()} == {"<b>", "<d>"}
    for bad in (b"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 0\r\n\r\n", b"HTTP/1.1 200 OK\r\n\r\n", one[:-9]):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(bad), True, lambda head: True))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    got, want = compared(spark, queries.QUERIES[name], queries.ORACLES[name])
    assert got == want
