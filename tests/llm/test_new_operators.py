"""Ranked search, token files and fill-in-the-middle against plain Python, the tokenizers library and SQL."""

import glob
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_entry import compared

from matchloom.llm import fim, queries, ranked_search, token_files
from matchloom.llm.common import slices

BYTE_BPE = queries.tokenizer_path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", ["op11_ranked_search", "op13_fill_in_middle"])
def test_against_sql(spark, name):
    got, want = compared(spark, queries.QUERIES[name], queries.ORACLES[name])
    assert got == want and got


def test_slices():
    batch = pa.RecordBatch.from_pydict({"text": ["aa", None, "bbbb", "", "c" * 50, "d"], "k": list(range(6))})
    assert [p["k"].to_pylist() for p in slices(batch, "text", 6)] == [[0, 1, 2, 3], [4], [5]]
    assert [p["k"].to_pylist() for p in slices(batch.slice(2), "text", 1000)] == [[2, 3, 4, 5]]
    assert list(slices(batch.slice(0, 0), "text", 6)) == []


# Fill in the middle.

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(doc_id, text):
    text = text or ""
    units, n = UNITS.findall(text), len(UNITS.findall(text))
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, three, four = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((one % (n + 1), two % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in fim.MARKS) or three % 100 >= 50:
        return n, "plain", None, None, text
    if four % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fim_against_plain_python(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "\t\n ", "x", " x", "x ", "a<P>b", "<S>", "a <M", "<<P", "café　wide x\x1cy\x85z", "名前 は\n\nだ", "a\x00b \xff c", "w " * 70_000, "z" * 300_000]
    texts += ["".join(rng.choice("ab<PSM> \n\té漢😀") for _ in range(rng.randint(0, 40))) for _ in range(600)]
    rows = [(i - 5, t, t, i) for i, t in enumerate(texts)] + [(None, "no id here", None, 0), (7, "same row", None, 0), (7, "same row", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")  # columns of the operator's own names
    made = fim.fill_in_middle(df)
    back = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r["id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in back), key=repr)
    assert got == sorted(((i, *brute_fim(i, t)) for i, t, *_ in rows), key=repr)
    assert sorted(r["back"] for r in back) == sorted(t or "" for _, t, *_ in rows)
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, marks=("<P>", "<P>", "<M>"))


def test_fim_in_small_slices():
    """Rows arranged a few at a time are those arranged together."""
    texts = ["one two three", "", "  lead and trail  ", "x", "héé  wörld\n"] * 9
    rows = pa.RecordBatch.from_pydict({"id": list(range(45)), "text": texts, "form": ["plain", "spm", "psm"] * 15, "one": [k * 7 for k in range(45)], "two": [k * 5 + 3 for k in range(45)]})
    whole = fim.arranged(rows, fim.MARKS)
    parts = pa.concat_batches([fim.arranged(p, fim.MARKS) for p in slices(rows, "text", 20)])
    assert whole.equals(parts)


# Token files.


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_BPE)


def brute_tokens(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0　'sltre1é,."), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_parts_are_encoded_as_whole_texts(text):
    made = token_files._encoder(BYTE_BPE)
    assert np.frombuffer(made.encode([text])[0], "<u4").tolist() == made.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_tables_and_other_tokenizers(library, monkeypatch):
    texts = ["", "\n", "a\nb\nc d", "The cat  sat.\nIt's 12 o'clock\n\n x", "a <|endoftext|> b", "w" * 500 + " " + "w" * 500, "é   x", " lead\ntrail "] * 3
    monkeypatch.setattr(token_files, "TABLE_BYTES", 300)  # starts anew all the time
    made = token_files.Encoder(BYTE_BPE)
    assert made.cuts and made.parts("ab cd\nef\n g") == [["ab", "cd"], "ef\n g"] and made.parts("") == [""]
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in made.encode([t])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    other = token_files.Encoder(queries.tokenizer_path("word_bpe_49k.json"))  # normalizes, so texts stay whole
    assert not other.cuts
    assert np.frombuffer(other.encode(["Two  Words\nhere"])[0], "<u4").tolist() == other.tokenizer.encode("Two  Words\nhere", add_special_tokens=False).ids


def test_words_reach_the_model_once_without_their_marks(monkeypatch):
    """Words of letters go to the model many at a time, in a block of texts each once however it is marked; the ids are those of whole texts, for blocks of any size."""
    monkeypatch.setattr(token_files, "CHUNK", 3)
    made, sent = token_files.Encoder(BYTE_BPE), []

    class Lines:
        def encode_batch_fast(self, texts, *, whole=made.lines, **kw):
            sent.extend(w for t in texts for w in t.split("\n"))
            return whole.encode_batch_fast(texts, **kw)

    made.lines = Lines()
    texts = ["An alpha, alpha. alpha beta!", "A beta; gamma: \u00e9t\u00e9! \u00e9t\u00e9", "", "The gamma alpha) \u0120 \u0120, delta\nalpha beta\n\nat x1 delta?!", "A beta alpha"]
    want = [x.ids for x in made.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in made.encode(texts)] == want
    assert len(sent) == len(set(sent)) == 6  # alpha, beta, gamma, delta and two that aren't ASCII
    monkeypatch.setattr(token_files, "BLOCK_CHARS", 20)
    assert [np.frombuffer(x, "<u4").tolist() for x in token_files.Encoder(BYTE_BPE).encode(texts)] == want


def test_token_files_against_library(spark, library):
    rng = random.Random(9)
    words = "the of and naïve straße 東京 42 it's x,y \n \t".split(" ")
    rows = [(i * 3 - 40, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), i) for i in range(400)]
    rows += [(None, "no id", 0), (None, None, 0), (5, "", 0), (5, None, 0), (8, "twice", 0), (8, "twice", 0), (8, "thrice and more", 0), (99999, "long words " * 30_000, 0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(5)
    path = token_files.write_tokens(df, tokenizer=BYTE_BPE, row_group_bytes=4096, page_bytes=512, page_rows=20)
    got = sorted(((r["id"], r["start"], r["ids"]) for r in token_files.read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert [(i is not None, i or 0) for i, _, _ in got] == sorted((i is not None, i or 0) for i, *_ in rows)
    assert sorted((repr(i), ids) for i, _, ids in got) == sorted((repr(i), brute_tokens(library, t)) for i, t, _ in rows)
    at = 0
    for _, start, ids in got:
        assert start == at
        at += len(ids)
    said = {(r["id"], r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in token_files.digests(token_files.read_tokens(spark, path)).collect()}
    assert said == {(i, s): (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, ids in got}
    whole = [x for _, _, ids in got for x in ids]
    for first, upto in ((0, 1), (0, at), (100, 100), (137, 1500), (at - 5, at + 5), (at, at + 9), (700, 705)):
        cut = sorted((r["start"], r["ids"]) for r in token_files.read_span(spark, path, first, upto).collect())
        assert [x for _, ids in cut for x in ids] == whole[first:upto]
        assert all(whole[s : s + len(ids)] == ids for s, ids in cut)


def test_token_files_layout(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words and "), F.col("id").cast("string")).alias("text"))
    path = token_files.write_tokens(df, tokenizer=BYTE_BPE, row_group_bytes=16_384, page_bytes=1024, page_rows=50)
    groups = pages = 0
    for name in glob.glob(path.removeprefix("file://") + "/tokens/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        groups = max(groups, meta.num_row_groups)
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids = columns["ids.list.element"]
            assert "RLE_DICTIONARY" in ids.encodings and ids.has_dictionary_page and ids.compression == "ZSTD"
            for c in ("id", "at", "n_tokens"):
                assert "DELTA_BINARY_PACKED" in columns[c].encodings and not columns[c].has_dictionary_page
            assert all(x.has_offset_index and x.has_column_index for x in columns.values() if x.path_in_schema != "ids.list.element")
            pages += 1
    assert groups > 1
    # Numbers alone: the ids are not in the scan; a range of ids is pushed to it.
    plan = token_files.read_tokens(spark, path).select("id", "start", "n_tokens").where("id between 100 and 120")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in re.search(r"ReadSchema: (\S+)", plan)[1] and "GreaterThanOrEqual(id,100)" in plan
    empty = token_files.write_tokens(df.limit(0), tokenizer=BYTE_BPE)
    assert token_files.digests(token_files.read_tokens(spark, empty)).count() == 0
    assert token_files.read_span(spark, empty, 0, 10).count() == 0


# Ranked search.


def brute_search(docs, items, k=10):
    terms = lambda t: ranked_search.TERM.findall((t or "").translate(ranked_search.LOWER))
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(held), sum(sum(h.values()) for _, h in held)
    df = Counter(x for _, h in held for x in h)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        found = []
        for i, h in held:
            m = 10 + (90 * sum(h.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * h[x]) // (1000 * h[x] + 8 * m)) for x in words if x in h)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def test_search_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["Été", "été", "x1", "X1", "rare-one"]
    text = lambda n: " ".join(rng.choice(words[: rng.choice((5, 20, 65))]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(500)] + [(700 + i, "w1 w2 w3 same text") for i in range(30)]
    docs += [(None, "w1 w2 rare null"), (None, None), (3, "w4 w4 again"), (3, "w4 w4 again"), (900, "!!! ..."), (901, ""), (902, "w7 " * 50_000)]
    items = [(k, text(rng.randint(1, 30))) for k in range(25)] + [(100, "w1 same"), (100, "text"), (101, "unknown words"), (102, None), (None, "rare"), (103, "again AGAIN w4")]
    one = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, terms int").repartition(3)
    two = spark.createDataFrame(items, "item_id long, text string")
    want = brute_search(docs, items)
    for group, block in ((ranked_search.GROUP_TERMS, ranked_search.BLOCK_TERMS), (400, 40)):
        made = ranked_search.search(one, two, group_terms=group, block_terms=block)
        assert sorted((tuple(r) for r in made.select("item_id", "rank", "id", "score").collect()), key=repr) == want
    assert ranked_search.search(one.limit(0), two).count() == 0
    assert ranked_search.search(one, two.limit(0)).count() == 0


def test_bounds_leave_most_documents_unscored():
    """A few documents that hold an item's words stand out; intervals without them go by their bounds."""
    rng = np.random.default_rng(2)
    docs, words = 4000, 300
    term, doc = np.nonzero(rng.random((words, docs)) < 0.05)
    impact = rng.integers(1, 100, len(term))
    asked = np.arange(20)
    for d in (17, 1200, 3999):
        term, doc, impact = np.concatenate([term, asked]), np.concatenate([doc, np.full(20, d)]), np.concatenate([impact, np.full(20, 100)])
    keep = np.unique(np.stack([term, doc]), axis=1, return_index=True)[1]
    order = keep[np.argsort(doc[keep], kind="stable")]
    lists = ranked_search.Postings(term[order], doc[order], impact[order], words, docs)
    scores, found, scored = ranked_search.best_documents(lists, asked, 3)
    whole = np.zeros(docs, np.int64)
    used = term[order] < 20
    np.add.at(whole, doc[order][used], impact[order][used])
    want = np.lexsort([np.arange(docs), -whole])[:3]
    assert found.tolist() == want.tolist() and scores.tolist() == whole[want].tolist()
    assert scored < docs // 4


# Bounds of earlier operators.


def test_products_beyond_doubles(spark):
    """Vectors whose products overflow: every query keeps its k nearest."""
    from matchloom.llm import block_knn

    big = [(0, [1e200, 1.0]), (20, [1e160, -1e160])] + [(k, [1e200 * k, 1.0]) for k in range(1, 6)] + [(9, [-1e200, 0.0]), (10, [1.0, 1.0]), (11, [1e190, 1e190])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = {}
    for r in block_knn.nearest(df, df.where("vec_id % 20 = 0"), k=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    for q, vector in big[:2]:
        scores = [(sum(np.float64(x) * np.float64(y) for x, y in zip(vector, v, strict=True)), i) for i, v in big if i != q]
        want = sorted(((-np.inf if np.isnan(s) else s, i) for s, i in scores), key=lambda x: (-x[0], x[1]))[:2]
        assert sorted(got[q]) == [(n, i, s) for n, (s, i) in enumerate(want, 1)]


def test_runs_beside_many_spans():
    from matchloom.llm import secret_scan

    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab1 /-") for _ in range(60))
        spans = sorted(("hex", a, a + rng.randint(1, 15)) for a in (rng.randrange(60) for _ in range(rng.randint(0, 6))))
        spans = sorted(spans, key=lambda s: s[1])
        want = [m.span() for m in secret_scan.RUN.finditer(text) if not secret_scan.PLAIN.fullmatch(m[0]) and not any(s < m.end() and m.start() < e for _, s, e in spans)]
        assert secret_scan.candidates(text, spans) == want
    log = "".join(f"h4sh/{k:024} {k:032x} t0k3n-{k:024}-x9\n" for k in range(40_000))  # 40,000 spans and 80,000 other runs
    base = secret_scan.base_spans(log)
    assert len(base) == 40_000 and len(secret_scan.candidates(log, base)) == 80_000


def test_table_of_long_words():
    """The worker's table is emptied by bytes, not by words alone; the ids stay right."""
    import pandas as pd

    from matchloom.llm import bpe

    path, pattern = queries.tokenizer_path(), queries.tokenizer_pattern()
    texts = ["".join(random.Random(k).choices("abcdefgh", k=20_000)) for k in range(30)]
    held = []
    plain = bpe.Words.__init__

    def counted(self):
        held.append(self.number.bytes if hasattr(self, "number") else 0)
        plain(self)

    bpe._LOADED.pop((path, pattern), None)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bpe.Words, "__init__", counted)
        patch.setattr(bpe, "TABLE_BYTES", 2_000_000)
        got = [list(x) for _, lists in bpe.encoded(iter([pd.DataFrame({"id": range(30), "text": texts})]), path, pattern, 100_000) for x in lists]
    bpe._LOADED.pop((path, pattern), None)
    ranks = bpe._ranks(path, pattern)
    assert got == [list(ranks.one_word(t.encode())) for t in texts]
    assert len(held) > 3 and max(held) < 2_000_000 + 10 * 20_000 * bpe.CHAR_BYTES


def test_a_header_that_never_ends():
    import io

    from matchloom.llm import warc

    class Counted(io.BytesIO):
        asked = 0

        def read(self, n=-1):
            self.asked += n
            return super().read(n)

    f = Counted(b"WARC/1.1\r\n" + b"x: " + b"y" * 30_000_000)
    with pytest.raises(ValueError, match="does not end"):
        list(warc.records(f, True, lambda row: True))
    assert f.asked <= warc.HEADER_BYTES + (1 << 17)


LONG = "The long text of the article goes on for more than one hundred and twenty characters, as running text of pages mostly does, so that it surges."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<form><article><p>{LONG}</p></article></form>", LONG),
        (f"<form><div><p>{LONG}</p></div></form>", LONG),
        (f"<div class='layout sidebar-right'><article><p>{LONG}</p></article></div>", LONG),
        (f"<div id='page' class='side by'><main><p>{LONG}</p></main></div>", LONG),
        (f"<section class='news alert'><article><p>{LONG}</p></article></section>", LONG),
        *((f"<article><p>{LONG}</p><div class='{k}'>buy this now</div></article>", LONG) for k in ("ad-slot", "cookie-bar", "site-notice", "comments-area", "newsletter-box")),
        (f"<article><p>{LONG}</p></article><section id='comment-section'><article><p>{LONG} No!</p></article></section>", LONG),
        (f"<article><p>{LONG}</p></article><article class='comment'><p>{LONG} Yes!</p></article>", LONG),
        (f"<p>{LONG}</p><form><label>mail</label></form><p>{LONG}</p>", f"{LONG} {LONG}"),
        (f"<div class='single comments-open'><h1>Title</h1><p>{LONG}</p></div>", f"Title {LONG}"),
        (f"<div class=sidebar><div class=promo><article><p>{LONG}</p></article></div><div class=ad>{LONG}</div></div>", LONG),
        (f"<article><p>{LONG}</p></article><div class=sidebar>{LONG * 5}</div>", LONG),
        (f"<p>Short.</p><div class=notice>{LONG[:100]}</div>", "Short."),
    ],
)
def test_what_is_set_aside(page, want):
    """Wrappers of articles and of whole pages come back, whatever their class; adverts, notices and comments don't."""
    from matchloom.llm import html_text

    assert html_text.main_text(page) == want
