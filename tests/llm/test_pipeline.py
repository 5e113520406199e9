"""The pipeline against a plain-Python version of its stages, and on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from test_near import brute_force

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, keep int, total long, h1 long"


def words(text):
    return WORD.findall(text or "")


def passes(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j + o for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for o in range(3)}
    return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)


def mixed(rows):
    """rows (identifier, text, source), each as often as systematic sampling along (size, identifier) takes it."""
    order = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(words(t)) for _, t, x in rows if x == s) for s in order}
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, total = set(), sum(size.values())
    while True:
        rest, left = total - sum(3 * size[s] for s in full), [s for s in order if s not in full]
        target = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    target |= {s: 3.0 * size[s] for s in full}
    out = []
    for s in order:
        u = int(hashlib.md5(("mix-1:" + ("null" if s is None else "s" + s)).encode()).hexdigest()[:8], 16) / 2**32
        copies = target[s] / size[s] if size[s] else 0.0
        own = sorted(((len(words(t)), i is None, i or 0, t, i) for i, t, x in rows if x == s), key=lambda r: r[:3])
        for k, (*_, t, i) in enumerate(own, 1):
            out += [(i, t)] * int(math.floor(copies * k + u) - math.floor(copies * (k - 1) + u))
    return out


def expected(rows):
    import public_tokenizers
    import tiktoken

    from sparkloom.llm import byte_bpe

    kept = [r for r in rows if passes(r[1])]
    first = {}
    for r in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    unique = list(first.values())
    component = brute_force([(i, t) for i, t, *_ in unique if i is not None])
    unique = [r for r in unique if r[0] is None or component[r[0]] == r[0]]
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY)), special_tokens={})
    out = []
    for i, t in mixed([(i, t, s) for i, t, _, s in unique]):
        ids = lib.encode_ordinary(t)
        out.append((i, len(ids), hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, folder, rows, labels=()):
    full = [(*r, len(r[1] or ""), "clash", 1, 2, 3) for r in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_against_plain_python(spark, tmp_path):
    deal = random.Random(12)
    rows = []
    for i in range(150):
        w = [f"{deal.choice(['alpha', 'Beta', 'été', '日本'])}{deal.randint(0, 10**6)}" for _ in range(deal.randint(30, 160))]
        rows.append((i, " ".join(w), deal.choice(["en", "de", None]), deal.choice(["a", "b", "c", None])))
        if i % 6 == 0:  # a copy that differs in white space, and a near one
            rows.append((1000 + i, "\n".join(w), "en", "b"))
            rows.append((2000 + i, " ".join([*w, "more", "words"]), "en", "c"))
    rows += [(3000, None, None, None), (3001, "", "de", "a"), (None, None, "en", "a"), (None, "too short", None, None), (3002, " ".join(f"long{i}" for i in range(20_000)), "en", "a")]
    rows += [(3003, "same words again " * 60, "en", "b"), (None, " ".join(f"nameless{i}" for i in range(333)), "de", "b"), (5, rows[5][1], "en", "a")]
    deal.shuffle(rows)
    got = run(spark, tmp_path, rows, [(1, 1, 0), (2, None, 1), (None, 1, 0)])
    assert sorted(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=repr) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None), (None, "", "en", "a")], [(4, "w " * 60, None, None)] * 3])
def test_tables_without_a_document_to_keep(spark, tmp_path, rows):
    got = run(spark, tmp_path, rows)
    assert got.count() == 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns)


ODD = [None, "", " ", "a b a b", "don't  stop\n\n\tnow 12345 ", "<|endoftext|> x", "été 日本語 👍🏽", "x" * 5_000 + " " + "ab" * 40, " " * 300 + "\n" * 70, "tail " * 900]


@pytest.mark.parametrize("block_chars", [1, 700, 16_000_000])
def test_folded_words_against_the_library(spark, block_chars):
    import public_tokenizers
    import tiktoken

    from sparkloom.llm import byte_bpe

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY)), special_tokens={})
    rows = [(f"n{i % 7}" if i % 7 else None, t, 1) for i, t in enumerate(ODD * 2)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, block int").repartition(3)
    got = byte_bpe.encode_folded(docs, block_chars=block_chars)
    want = []
    for i, t, _ in rows:
        ids = lib.encode_ordinary(t or "")
        want.append((i, len(ids), ids, (t or "").encode(), hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"]
    assert sorted(((*r[:3], bytes(r[3]), *r[4:]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert byte_bpe.encode_folded(docs.limit(0)).count() == 0


def test_encoding_stage_folds_and_decodes_all_words_by_higher_order_functions(spark, tmp_path, monkeypatch):
    """Its rows come from encode_words and decode_words: with these changed, the rows change."""
    import public_tokenizers
    import regex
    from pyspark.sql import functions as F

    from sparkloom.llm import byte_bpe

    texts = [t for t in ODD if not t or len(t) < 60] + [f"rare{i} 字{i}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    split = [regex.findall(public_tokenizers.PATTERN, t or "") for t in texts]
    folded, encode_words = [], byte_bpe.encode_words

    def one_id_a_word(words, path, *rest):
        folded.extend(bytes(r.word) for r in words.collect())
        return encode_words(words, path, *rest).withColumn("ids", F.array(F.lit(7)))

    monkeypatch.setattr(byte_bpe, "encode_words", one_id_a_word)
    monkeypatch.setattr(byte_bpe, "decode_words", lambda words: words.withColumn("decoded", F.lit(b"z")))
    got = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["byte_bpe"](spark, docs, str(tmp_path)).collect()}
    assert sorted(folded) == sorted({w.encode() for ws in split for w in ws})
    assert [got[i].n_tokens for i in range(len(texts))] == [len(ws) for ws in split]
    assert [got[i].decoded_sha256 for i in range(len(texts))] == [hashlib.sha256(b"z" * len(ws)).hexdigest() for ws in split]


def test_plans_of_folded_words_do_not_hold_the_ranks(spark):
    """The text of a plan is rendered in the driver for each of its events; as literals the ranks made it 2.1 MB long."""
    import public_tokenizers

    from sparkloom.llm import byte_bpe

    ranks = byte_bpe.read_ranks(path := public_tokenizers.path(byte_bpe.VOCABULARY))
    words = spark.createDataFrame([(w.encode(),) for w in (" the", " xq7#", "")] + [(None,)], "word binary")
    coded = byte_bpe.decode_words(byte_bpe.encode_words(words, path))
    assert coded.columns == ["word", "pieces", "ids", "decoded"]
    plan = coded._jdf.queryExecution()
    assert len(plan.toString()) < 50_000
    # The subquery is in the fold, so that no row carries all ranks.
    assert "AS __ranks" not in plan.executedPlan().toString()
    got = {r.word and bytes(r.word): r.ids for r in coded.collect()}
    assert got == {w and bytes(w): None if w is None else [ranks[p] for p in byte_bpe.fold(w, ranks)] if w else [] for w in (b" the", b" xq7#", b"", None)}
