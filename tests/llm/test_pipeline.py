"""The pipeline stage by stage on the smallest table, and whole against plain Python."""

import base64
import hashlib
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from matchloom import stage as stage_module
from matchloom.llm import ngram_join, queries
from test_table_operators import brute_components
from test_text_operators import brute_bits, brute_spans, brute_tiles

SF = "/root/testdata/sf0.001"

LETTERS = {"en": "eeeattoinshrdl ", "fr": "éeeaaisntrulà ", "ru": "оеаинтсрвлкм "}


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def held(text, items, least=5):
    """Whether tiles of an item cover half of its words, by brute force over the pairs that share a window."""
    words = words_of(text)
    for _, item in items:
        own = words_of(item)
        k = min(least, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
        if own and any(tuple(words[i : i + k]) in windows for i in range(len(words) - k + 1)) and brute_tiles(words, own, k) >= 0.5 * len(own):
            return True
    return False


def plain_pipeline(rows, items, library):
    """The five stages one row after the other; ids are distinct and no run but the base spans looks like a secret."""
    learned = {}
    for i, text, lang in rows:
        if lang and re.search(r"[^\W\d_]", text or "") and zlib.crc32(str(i).encode()) % 3 != 1:
            learned.setdefault(lang, []).append(text)
    told = []
    for i, text, _ in rows:
        if re.search(r"[^\W\d_]", text or ""):
            bits = min(brute_bits(v, text, 3, least=2) for v in learned.values())
            if bits / len(text.encode()) < 8:
                told.append((i, text))
    groups = brute_components(dict(told))
    alone = [(i, text) for i, text in told if groups[i][1] == i]
    out = {}
    for i, text in alone:
        if held(text, items):
            continue
        hidden = np.zeros(len(text) + 1, bool)
        for _, a, b in brute_spans(text):
            hidden[a:b] = True
        clean = "".join("[SECRET]" if hidden[k] and (k == 0 or not hidden[k - 1]) else "" if hidden[k] else c for k, c in enumerate(text))
        ids = library.encode_ordinary(clean)
        out[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(clean.encode()).hexdigest())
    return out, [len(told), len(alone), len(out)]


def small_corpus(rng):
    word = lambda lang: "".join(rng.choice(LETTERS[lang].strip()) for _ in range(rng.randint(2, 8)))
    passage = lambda lang, n: [word(lang) for _ in range(n)]
    items = [(k, " ".join(passage("en", rng.choice([4, 12, 20])))) for k in range(6)]
    texts = []
    for _ in range(36):
        lang = rng.choice(list(LETTERS))
        own = passage(lang, rng.choice([3, 20, 40, 60]))
        texts.append((" ".join(own), rng.choice([lang, lang, None])))
        if rng.random() < 0.4:  # copies, near copies, and texts that share just a part
            changed = list(own)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(changed))] = word(lang)
            texts.append((" ".join(changed), lang))
            texts.append((" ".join(own[: len(own) // 2] + passage(lang, 20)), lang))
    for _, item in items:  # whole, in another order, or too little of it
        w = item.split()
        texts.append((" ".join(passage("en", 9)) + " " + item.title() + ". " + " ".join(passage("en", 9)), "en"))
        texts.append((" ".join(w[len(w) // 2 :] + passage("en", 15) + w[: len(w) // 2]), "en"))
        texts.append((" ".join(passage("en", 10) + w[: len(w) // 3] + passage("en", 10)), "en"))
    code = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts += [(f'{" ".join(passage("en", 15))} password = "{code(10)}" {word("en")} {code(34)} {word("en")} AKIA{"AB12" * 4} end', "en") for _ in range(4)]
    texts += [(None, "en"), ("", "fr"), ("12 34 56", None), (" \n ", None), ("\U00010331\U0001033c" * 20, None), ("\u4e00\u9fa5\u3042" * 9, None)]
    order = list(range(100, 100 + len(texts)))
    rng.shuffle(order)
    return [(i, t, lang) for i, (t, lang) in zip(order, texts, strict=True)], items


def test_run_against_plain_python(spark, tmp_path):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=queries.tokenizer_pattern(), mergeable_ranks=ranks, special_tokens={})
    rows, items = small_corpus(random.Random(21))
    docs = [(i, t, lang, "s", None) for i, t, lang in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want, left = plain_pipeline(rows, items, library)
    assert len(rows) > left[0] > left[1] > left[2]  # every stage decides something
    made = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in made} == want and len(made) == len(want)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
        docs = seen[name] = stage_module.staged(docs, name)
    ids = {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in seen.items()}
    assert ids["language"] == set(before)  # all have letters
    groups = ngram_join.link_components(seen["language"]).collect()
    assert ids["near_duplicates"] == {r["component_id"] for r in groups}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids["near_duplicates"] - ids["benchmark_leaks"] == {i for i in ids["near_duplicates"] if held(before[i]["text"], items)}
    assert ids["secrets"] == ids["benchmark_leaks"] == ids["tokens"]
    for r in seen["secrets"].collect():
        assert r["n_chars"] == len(r["text"])
        assert "token = \"" not in r["text"]


def test_clashing_input(spark):
    rows = [(1, None, None, None, None), (2, "some words that are a plain text", "en", "s", 1), (2, "some words that are a plain text", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage_module.staged(stage(spark, docs, SF), "t")
    assert [r["doc_id"] for r in docs.collect()] == [2]  # rows of one id and text are one group
